"""The training-text operators against brute force, on planted cases and on edge cases."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import conversations, crf, grammars, lookalike, mixing, packing, pairs, percentiles, provenance, queries, reading, tokens, validity
from tesserae.sources.tables import table

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")


def clashing(df, *names):
    """Columns that the operator might use for itself."""
    return df.withColumns({n: F.lit("clash") for n in names if n not in df.columns})


# 1: pairs

MODEL = None


def model(spark):
    global MODEL
    if MODEL is None:
        root = "/root/testdata/sf0.1"
        MODEL = pairs.fit(pairs.question_pairs(table(spark, root, "eval_sessions"), table(spark, root, "query_results")))
    return MODEL


JA, EN = "`scoreQuery` の役割を教えてください。", "What does `scoreQuery` do when the limit is set?"
CASES = [
    (EN, None, "empty"), (EN, "", "empty"), (EN, "\u200b\n", "empty"), (EN, "[C:1]", "empty"), (EN, "Answer:", "empty"), (JA, "(なし)", "empty"), (JA, "```\n```", "empty"), (EN, "N/A", "empty"), (EN, "**", "empty"),
    (EN, EN, "copy"), (EN, f"> {EN}", "copy"), (EN, f"Question: {EN}\nAnswer: {EN}", "copy"), (JA, "「`scoreQuery` の役割を教えてください」", "copy"), (JA, "ご質問は`scoreQuery` の役割を教えてください", "copy"), (EN, f"You asked: {EN}", "copy"),
    (EN, "I'm sorry, but I do not know.", "refusal"), (EN, "There is not enough evidence to say. Try asking something else.", "refusal"), (JA, "申し訳ありませんが、お答えできません。別の質問をお試しください。", "refusal"),
    (JA, "The result is passed to `rank_shard`, which returns a list of at most 41 items. Both modules share it.", "language"), (EN, "Nach Artikel 44 beträgt die Frist 56 Tage. Der Wert wird durch `A_B` ersetzt.", "language"),
    (JA, "根据第27条，期限为30天。`mergeCitation` 函数位于 `a.py` 中，负责处理这个请求[C:4]。", "language"), (EN, "제44조에 따라 기한은 30일입니다. 결과는 실행 로그에 기록됩니다.", "language"), (JA, "検索結果一覧。安全管理規程第三条。", None),
    (JA + "英語で答えてください。", "処理時間は約102ミリ秒で、大半は `split_anchor` が占めます。", "language"),
    (EN, "Most of the time is spent in `run`. The default is passed to `trim`, wh", "truncated"), (JA, "既定値は480で、変わります。変更する場合は、`lib/a.py` の", "truncated"), (EN, "It is set here.\n\n```\nx = f(y\n", "truncated"),
    (EN, "Most of the 27 ms is spent in `run_it` [C:2].", None), (JA, "失敗すると「確認できません」という表示が出て、`run` が再実行されます。", None), (EN, "`src/a/b.py` [C:1]", None),
    (EN, f"You asked: {EN} The default of 12 is replaced when it is set.", None), (EN, "The main items are:\n- `a_b`: draft\n- `c_d` (12)", None), (EN, "It runs once. ※123", None),
]


@needs_data
@pytest.mark.parametrize(("question", "answer", "want"), CASES)
def test_defects(spark, question, answer, want):
    assert pairs.defect(question, answer, model(spark)) == want


def test_long_answer_is_read_whole(spark):
    text = "The value is passed to the next stage. " * 20_000
    assert pairs.defect(EN, text, model(spark)) is None
    assert pairs.defect(EN, text + "It then goes to", model(spark)) == "truncated"


def test_pairs_edge_cases(spark):
    turn = "struct<turn_id:int,question:string,reference_answer:string>"
    sessions = spark.createDataFrame([("s", [(1, EN, None), (2, None, "x")]), ("s", [(1, EN, None)]), (None, [(1, EN, "x")]), ("e", [])], f"session_id string, turns array<{turn}>")
    results = clashing(spark.createDataFrame([("s", 1, 7, "TODO"), ("s", 1, 7, "TODO"), ("s", 9, 8, "x"), (None, 1, 9, "x")], "session_id string, turn_id int, result_id bigint, answer string"), "question", "salt", "origin", "pair")
    both = pairs.question_pairs(sessions, results)
    got = sorted(map(tuple, pairs.defects(both, pairs.fit(both)).collect()))
    assert got == [("eval", "s", 1, 0, "empty"), ("result", "s", 1, 7, "empty")]
    assert pairs.fit(both.limit(0))[0] == {}


@needs_data
def test_tags_decide_the_defects(spark):
    root = "/root/testdata/sf0.01"
    both = pairs.question_pairs(table(spark, root, "eval_sessions"), table(spark, root, "query_results"))
    vocabulary, w, tr = model(spark)
    found = Counter(r.defect for r in pairs.defects(both, model(spark)).collect())
    untold = Counter(r.defect for r in pairs.defects(both, (vocabulary, w * 0, tr * 0)).collect())
    assert set(found) == set(pairs.DEFECTS) and set(untold) == {"empty"}
    # Held out: what rules say of pairs that the field was not fitted on.
    rows = [(r.question, r.answer) for r in both.where("answer is not null").limit(600).collect()]
    right = total = 0
    for question, answer in rows:
        want = pairs.labels(question, answer)
        rows_, asked = pairs.analyse(question, answer)[2], pairs.asked(question)[0]
        got = crf.decode([pairs.known_ids(clause, asked, vocabulary) for clause in rows_], w, tr) if rows_ else []
        right += sum(a == b for a, b in zip(got, want, strict=True))
        total += len(want)
    assert right / total > 0.98


def test_crf_learns_a_chain():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(200):
        y = np.zeros(8, dtype=int)
        for t in range(1, 8):
            y[t] = 1 - y[t - 1] if rng.random() < 0.9 else y[t - 1]
        seen = np.where(rng.random(8) < 0.7, y, 1 - y)
        xs.append([[0, 1 + int(v), *([3] if t == 0 else [])] for t, v in enumerate(seen)])
        ys.append(y.tolist())
    w, tr = crf.fit(xs[:150], ys[:150], np.ones((4, 2)))
    hit = np.mean([np.mean(np.array(crf.decode(x, w, tr)) == y) for x, y in zip(xs[150:], ys[150:], strict=True)])
    assert hit > 0.78 and tr[0, 1] > tr[0, 0]  # single features reach 0.7


# 2: provenance

CODE = "import os\n\n\ndef run(path):\n    with open(path) as fh:\n        return fh.read()\n\n\ndef stop(path):\n    os.remove(path)\n    return None\n\n\ndef again(path):\n    stop(path)\n    return run(path)\n\n\nclass Holder:\n    limit = 12\n    name = 'holder of paths'\n"


@pytest.mark.parametrize(("path", "language", "text", "want"), [
    ("a/b.py", "python", CODE, None), ("a/b.py", "python", "# Code generated by x-gen v1. DO NOT EDIT.\n" + CODE, "generated"), ("a/generated/b.py", "python", CODE, "generated"), ("build_generated_x.py", "python", CODE, None),
    ("vendors/b.py", "python", CODE, None), ("a/node_modules/x/b.py", "python", CODE, None), ("a/b.py", "python", "# vendored from the kit package, release 4.9; upstream: kit\n" + CODE, None),
    ("a/b.py", "python", "# Copyright the repository owners. All rights reserved.\n" + CODE, None), ("a/b.py", "python", CODE + '\nTEXT = "generated report, do not edit"\n', None),
    ("a/b.py", "python", "import os\n\n# Code generated by x-gen v1. DO NOT EDIT.\n" + CODE, "generated"), ("a/gen.py", "python", CODE + 'def w(out):\n    out.write("// Code generated by w. DO NOT EDIT.")\n', None),
    ("a/p.py", "python", 'PAYLOAD = """\n' + ("MTjeQYsicgVwmj8b9LoSOknl2HpD/3VU2yZLz5IrqWK9Ebr7ZYYI1ac+LIgf\n" * 20) + '"""\n', "data"),
    ("package-lock.json", "json", '{\n  "lockfileVersion": 3\n}', "lock"), ("block.json", "json", '{"a": 1}', None), ("a/t.py", "python", "T = [\n" + "    1, 22, 333, 4,\n" * 80 + "]\n", "data"),
    ("a/r.json", "json", '{"rows": [' + ",".join('{"id": %d, "h": "fc2447d2", "v": 2.34}' % i for i in range(90)) + "]}", "data"), ("a/b.js", "javascript", "// one long pattern\nconst a = /^(" + "|".join(f"publish_part_{i}" for i in range(90)) + ")$/;\n", None),
    ("a/m.js", "javascript", "!function(t,n){" + "".join(f"var a{i}=function(b,c){{return b<c?b:{{c:b}}}};" for i in range(40)) + "}(this);", "minified"), (None, None, None, None), ("a", "python", "", None),
])
def test_single_file_rules(path, language, text, want):
    assert provenance.mark(path, language, text) == want


SOURCES = "file_id bigint, repo_id string, repo_commit string, rel_path string, language string, content string"


def test_merkle_trees_mark_shared_code(spark):
    other = CODE.replace("run", "walk")
    rows = [
        (1, "r1", "c", "lib/kit/a.py", "python", CODE), (2, "r1", "c", "lib/kit/__init__.py", "python", ""), (3, "r1", "c", "own.py", "python", other),
        (4, "r2", "c", "copy/a.py", "python", CODE.replace("\n", "\r\n")), (5, "r2", "c", "copy/__init__.py", "python", ""), (6, "r2", "c", "mine.py", "python", CODE.replace("run", "go")),
        (7, "r1", "d", "own.py", "python", other), (8, "r2", "c", "x/__init__.py", "python", ""), (9, None, "c", "z.py", "python", CODE), (10, "r3", "c", None, None, None), (6, "r2", "c", "mine.py", "python", CODE.replace("run", "go")),
    ]
    files = clashing(spark.createDataFrame(rows, SOURCES), "h1", "rule", "family", "dir", "parts", "depth", "chars")
    got = {r.file_id: r.rule for r in provenance.not_handwritten(files).collect()}
    assert {1, 2, 4, 5} <= set(got) and not {3, 6, 7, 8, 10} & set(got)
    assert provenance.not_handwritten(files.limit(0)).count() == 0
    fork = [(i, r, "c", f"f{i % 3}.py", "python", CODE.replace("run", f"run{i % 3}")) for i, r in enumerate(["a", "a", "a", "b", "b", "b"])]
    assert provenance.not_handwritten(spark.createDataFrame(fork, SOURCES)).count() == 0


@needs_data
def test_shared_hashes_decide_what_is_vendored(spark, monkeypatch):
    files = table(spark, "/root/testdata/sf0.01", "source_files")
    with_hashes = {r.file_id for r in provenance.not_handwritten(files).where("rule = 'shared'").collect()}
    monkeypatch.setattr(provenance, "shared", lambda rows, families, hashes: rows.select(*hashes).limit(0))
    rest = {r.file_id for r in provenance.not_handwritten(files).collect()}
    assert len(with_hashes) > 10 and not with_hashes & rest


def test_changed_copies_are_found_by_their_segments(spark):
    package = "\n".join(f"def part_{i}(value):\n    return value * {i * 37 % 101} + offset_{i}\n" for i in range(60))
    changed = package.replace("offset_20\n", "offset_20 - 1\n").replace("def part_41", "# kept here\ndef part_41")
    rows = [(1, "a", "c", "x/kit.py", "python", package), (2, "b", "c", "y/other.py", "python", "# Note.\n" + changed), (3, "c", "c", "own.py", "python", package[:200] + CODE * 3), (4, "d", "c", "z.py", "python", CODE)]
    assert {r.file_id for r in provenance.not_handwritten(spark.createDataFrame(rows, SOURCES)).collect()} == {1, 2}
    assert sum(s["n"] for s in provenance.segments(package)) == 120 and provenance.segments("") == []


def test_directory_hash_ignores_order_and_name(spark):
    rows = [(1, "a", "c", "x/k/1.py", "python", CODE), (2, "a", "c", "x/k/2.py", "python", CODE * 2), (3, "b", "c", "other/2.py", "python", CODE * 2), (4, "b", "c", "other/1.py", "python", CODE)]
    dirs = provenance.directory_hashes(provenance.leaves(spark.createDataFrame(rows, SOURCES))).collect()
    h = {(r.repo_id, r.dir): (r.h1, r.h2, r.n_files) for r in dirs}
    assert h["a", "x/k"] == h["b", "other"] and h["a", "x"] != h["b", ""]


# 3: conversations

PREDICTIONS = "session_id string, turn_id int, question string, answer string, logged_at timestamp"


def broken_sessions(rows):
    """The rules, plainly."""
    stand_in = re.compile(r"(?i)\W*(none|null|n/?a|empty|\(empty\)|-)\W*")

    def says(t):
        t = re.sub(r"\[C:\d+\]", "", re.sub("[\u200b\u3000]", " ", t or "")).strip()
        return bool(re.search(r"\w", t)) and not stand_in.fullmatch(t)

    by = defaultdict(list)
    for r in rows:
        if r.session_id is not None:
            by[r.session_id].append(r)
    out = set()
    for s, rs in by.items():
        turns = {r.turn_id for r in rs}
        if None in turns or min(turns) not in (0, 1) or max(turns) - min(turns) + 1 != len(turns):
            out.add(s)
            continue
        for t in turns:
            own = [r for r in rs if r.turn_id == t]
            qs, answers = {r.question.strip() for r in own if says(r.question)}, [r for r in own if says(r.answer)]
            if len(qs) != 1 or not answers:
                out.add(s)
    return out


@needs_data
def test_dropped_as_by_plain_rules(spark):
    rows = table(spark, SMALL, "predictions")
    got = {r.session_id for r in conversations.dropped(rows).collect()}
    assert got == broken_sessions(rows.collect()) and got


@needs_data
@pytest.mark.parametrize("part", ["all", "mentions of turns"])
def test_link_scores_decide_what_is_dropped(spark, monkeypatch, part):
    rows = table(spark, SMALL, "predictions")
    sound = {r.session_id for r in conversations.dropped(rows).collect()}
    if part == "all":
        monkeypatch.setattr(conversations, "link_score", lambda *a: F.lit(0.0))
    else:
        monkeypatch.setattr(conversations, "TURN_WEIGHT", 0.0)
    assert {r.session_id for r in conversations.dropped(rows).collect()} != sound


def test_lone_answers_take_the_likeliest_question(spark):
    at = "2025-01-01 00:0{}:00".format
    rows = [
        ("s", 1, "What does `runJob` do?", None, at(0)), ("s", 1, None, "It starts `runJob`.", at(1)), ("s", 2, "Why?", "Because.", at(2)), ("s", 1, None, "Nothing of the kind.", at(4)),
        ("b", 63, "q", "a", at(1)), ("b", 64, "r", "b", at(2)), ("x", 1, "q", "a", at(1)), ("x", 2, None, "b", at(2)), ("x", 3, "r", "c", at(3)),
    ]
    rows += [("b", n, "q", "a", at(1)) for n in range(1, 63)]
    df = spark.createDataFrame(rows, PREDICTIONS.replace("timestamp", "string")).withColumn("logged_at", F.to_timestamp("logged_at"))
    turns, sessions = conversations.conversations(df)
    assert {r.session_id: (r.defect, r.n_trees) for r in sessions.collect()} == {"s": (None, 1), "b": (None, 1), "x": ("question_missing", 3)}
    told = {(r.session_id, r.turn_id): r.parent for r in turns.collect()}
    assert told[("s", 2)] == 1 and told[("b", 64)] == 63 and told[("b", 63)] == 62 and told[("x", 3)] is None
    said = [(r.role, r.text, r.n_alternatives) for r in conversations.ordered_messages(df).where("session_id = 's'").orderBy("position").collect()]
    assert said[1] == ("assistant", "It starts `runJob`.", 1) and len(said) == 4


def test_questions_follow_by_number_alone(spark):
    """Links between turns need no times; a turn follows the answered turn before it, across blocks too, and never one further back."""
    b = conversations.BLOCK
    rows = [("s", b - 2, "q", "a"), ("s", b - 1, "q", "a"), ("s", b, "q", None), ("s", b + 1, "q", "a"), ("s", b + 3, "q", "a"), ("s", b + 4, None, "a"), ("s", None, "q", "a")]
    turns = spark.createDataFrame(rows, "session_id string, turn_id bigint, q string, a string")
    turns = turns.select("session_id", "turn_id", F.when(F.col("q").isNotNull(), F.struct("q")).alias("question"), F.when(F.col("a").isNotNull(), F.struct("a")).alias("reply"))
    assert {r.turn_id: r.parent for r in conversations.follow(turns).collect()} == {b - 2: None, b - 1: b - 2, b: b - 1, b + 1: None, b + 3: None, b + 4: None, None: None}


def test_conversation_edge_cases(spark):
    rows = [
        ("ok", 1, "q one", None, "2025-01-01 00:00:00"), ("ok", 1, None, "a one", "2025-01-01 00:00:05"), ("ok", 2, " q two ", "a two", "2025-01-01 00:01:00"), ("ok", 2, "q two", "another", "2025-01-01 00:02:00"), ("ok", 2, "q two", "a two", "2025-01-01 00:03:00"),
        ("late", 0, "q", "a", None), ("gap", 1, "q", "a", "2025-01-01 00:00:00"), ("gap", 3, "q", "a", "2025-01-01 00:00:00"), ("two", 1, "q", "a", "2025-01-01 00:00:00"), ("two", 1, "r", "a", "2025-01-01 00:00:00"),
        ("none", 1, "q", "N/A", "2025-01-01 00:00:00"), ("ask", 1, "\u3000", "a", "2025-01-01 00:00:00"), ("off", None, "q", "a", "2025-01-01 00:00:00"), ("start", 2, "q", "a", "2025-01-01 00:00:00"), (None, 1, "q", "a", "2025-01-01 00:00:00"), ("nil", 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, PREDICTIONS.replace("timestamp", "string")).withColumn("logged_at", F.to_timestamp("logged_at"))
    df = clashing(df, "role", "text", "at", "root", "tree", "m", "parent")
    trees, sessions = conversations.conversations(df)
    defects = {r.session_id: r.defect for r in sessions.collect()}
    assert defects == {"ok": None, "late": None, "gap": "turn_gap", "two": "two_questions", "none": "answer_missing", "ask": "question_missing", "off": "no_turn_id", "start": "turn_gap", "nil": "question_missing"}
    told = [(r.position, r.role, r.text) for r in conversations.ordered_messages(df).where("session_id = 'ok'").orderBy("position").collect()]
    assert told == [(1, "user", "q one"), (2, "assistant", "a one"), (3, "user", "q two"), (4, "assistant", "a two")]
    assert conversations.dropped(df.limit(0)).count() == 0


# 4: percentiles

def test_rank_error_is_certified(spark):
    rng = random.Random(5)
    rows = [(("hot" if i % 3 else f"g{i % 40}"), rng.lognormvariate(3, 2), None if i % 11 else 5.0) for i in range(30_000)] + [("nan", float("nan"), -1.0), (None, 1.0, 2.0), (None, 1.0, float("inf"))]
    df = clashing(spark.createDataFrame(rows, "g string, x double, y double"), "metric", "salt", "i", "n", "means").repartition(7)
    found = percentiles.quantiles(percentiles.digests(df, ["g"], ("x", "y")), ["g"])
    done = percentiles.certify(df, found, ["g"], ("x", "y")).collect()
    assert all(r.certified for r in done) and len(done) == len({(r.g, r.metric, r.q) for r in done})
    exact = sorted(x for g, x, _ in rows if g == "hot")
    for r in done:
        if r.g == "hot" and r.metric == "x":
            assert abs(np.searchsorted(exact, r.value) / len(exact) - r.q) <= percentiles.RANK_ERROR
        if r.g is None:
            assert r.value == (1.0 if r.metric == "x" else 2.0)
    assert not any(r.g == "nan" for r in done)
    assert percentiles.digests(df.limit(0), ["g"], ("x", "y")).count() == 0


def test_digests_merge(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(d), float(v)) for d, v in zip(rng.integers(0, 9, 20_000), rng.gamma(2, 50, 20_000), strict=True)], "day int, x double").withColumn("all", F.lit(1))
    daily = percentiles.digests(df, ["all", "day"], ("x",))
    whole = percentiles.quantiles(percentiles.merge_digests(daily, ["all"]), ["all"])
    assert all(r.certified and r.n == 20_000 for r in percentiles.certify(df, whole, ["all"], ("x",)).collect())
    assert max(len(r.means) for r in daily.collect()) <= percentiles.DELTA + 1


# 5: validity

VALID = {
    "python": "def f(x: int) -> int:\n    return x\n", "json": '{"a": [1, 2.5, null]}', "toml": 'a = 1\n[b]\nc = "d"\n', "yaml": "# x\nname: a-b\nlist:\n  - one\n  - 'two {'\nmap:\n  k: v # c\ntext: |\n  any: [thing\nflow: {a: [1, 2]}\n",
    "javascript": "const a = require('./b');\nclass A {\n  #p = 1;\n  get x() { return this.#p; }\n}\nfor (let i = 0; i < 3; i += 1) { if (a[i] === /[)(]/g) break; }\nmodule.exports = { a, f: (x) => x ? 1 : 2, [`k${1 + 2}`]: 3 };\nlabel: for (;;) { continue label; }\n",
    "typescript": "import type { A } from './a';\nexport interface B<T> { rows: Array<{ id: string; n?: number }>; f(x: T): void; }\nexport const g = async (id: string): Promise<number | null> => { try { return await h(id, { t: 1 }); } catch (e) { return null; } };\nabstract class C<T> extends D implements E { private readonly m: Map<string, T[]> = new Map(); }\n",
    "go": "package a\n\nimport \"errors\"\n\ntype T struct {\n\tID string\n\tM  map[string][]int\n}\n\nfunc (t *T) F(xs []string, n int) ([]string, error) {\n\tfor _, x := range xs {\n\t\tif x != \"\" && n > 0 {\n\t\t\treturn nil, errors.New(`a {`)\n\t\t}\n\t}\n\treturn xs, nil\n}\n",
    "java": "package a.b;\n\nimport java.util.*;\n\n@Deprecated\npublic class A<T> extends B {\n    private final Map<String, List<Integer>> m = new HashMap<>();\n    @Override\n    public int f(String id, int[] n) throws E {\n        for (String s : rows) { if (s == null || (int) x > 3) { return 1; } }\n        switch (n.length) { case 1: break; default: g(); }\n        return m.size() + 'c';\n    }\n}\n",
    "rust": "//! x\nuse std::fmt;\n\n#[derive(Debug, Clone)]\npub struct A<'a> { pub id: &'a str, n: [u32; 4] }\n\nimpl<'a> A<'a> {\n    pub fn f<T: Clone>(&self, r: &[String]) -> Result<usize, String> {\n        match r.len() { 0 => Ok(0), _ if true => Err(format!(\"{}\", 1)), _ => r.iter().filter(|x| x.len() > 1).map(|x| x.len()).max().ok_or(\"e\".to_string()) }\n    }\n}\n",
    "kotlin": "package a.b\n\nimport x.*\n\ndata class A(val id: String, val n: Double = 1.0)\n\nfun f(id: String?): Int = when (id) {\n    null -> 0\n    else -> id.length\n}\n\nobject B {\n    private val c = mutableMapOf<String, Int>()\n    fun g(r: List<String>) = r.filter { it.length > 2 }.map { \"$it-x\" }\n}\n",
    "shell": "#!/usr/bin/env bash\nset -euo pipefail\ncase \"${1:-}\" in\n  a|b) echo \"x\" ;;\n  *) echo \"usage: $0\" >&2 ;;\nesac\nf() {\n  local t=\"$1\"\n  if [ ! -d \"$t\" ]; then\n    return 1\n  fi\n  for n in a b; do printf '%s\\n' \"$n\"; done\n}\ncat <<'NOTE'\n} don't (\nNOTE\nx=$(f \"$(echo a)\" | head -n 1) && [[ $x == a* ]]\n",
}


@pytest.mark.parametrize("language", sorted(VALID))
def test_valid_text_parses(language):
    assert grammars.why(VALID[language], language) == ""
    assert grammars.parses(VALID[language].replace("\n", "\r\n"), language)


@pytest.mark.parametrize("language", sorted(set(VALID) - {"yaml", "toml"}))
def test_broken_text_does_not_parse(language):
    text = VALID[language]
    close = max(text.rfind(c) for c in "}])")
    assert not grammars.parses(text[:close] + text[close + 1 :], language) or language in ("python", "shell")
    lines = text.rstrip("\n").split("\n")
    middle = len(lines) // 2
    assert not grammars.parses("\n".join([*lines[:middle], "<<<<<<< HEAD", *lines[middle:]]), language)
    assert not grammars.parses("<!DOCTYPE html>\n<html><body>x</body></html>\n", language)


@pytest.mark.parametrize(("language", "text"), [
    ("yaml", "a: [1, 2\n"), ("yaml", "a: @b\n"), ("yaml", "a:\n\tb: 1\n"), ("yaml", "a: 'b\n"), ("toml", "a = \n"), ("json", ""), ("json", "{'a': 1}"), ("json", "[1,]"), ("json", "[NaN]"), ("go", ""), ("javascript", "function f(x: string) {}\n"),
    ("javascript", "const a = 1\nconst b = = 2\n"), ("java", "class A { void f() { int x = 1 } }\n"), ("typescript", "const x;\n"), ("shell", "if true; then\necho a\n"), ("shell", "for a in b; echo; done\n"), ("python", "def f(:\n"), ("kotlin", "fun f(x: Int) {\n"), ("rust", "fn f() { let x = ; }\n"),
])
def test_other_breaks(language, text):
    assert not grammars.parses(text, language)


def test_files_and_rates(spark):
    rows = [(1, "r", "javascript", VALID["python"]), (2, "r", "python", "def ("), (3, "r", "markdown", "# anything {"), (4, "r", "python", ""), (5, "r", "python", None), (6, None, None, "x"), (7, "r", "python", VALID["python"]), (7, "r", "python", VALID["python"]), (2, "r", "python", "def (")]
    files = clashing(spark.createDataFrame(rows, "file_id bigint, repo_id string, language string, content string"), "valid", "parses_as", "reason")
    done = validity.checked(files)
    assert sorted((r.file_id, r.reason, r.parses_as) for r in validity.invalid(done).collect()) == [(1, "wrong_extension", "python"), (2, "corrupt", None)]
    rates = {(r.repo_id, r.language): (r.files, r.invalid_files) for r in validity.rates(done).collect()}
    assert rates["r", "python"] == (6, 2) and rates["r", "javascript"] == (1, 1)
    assert validity.invalid(validity.checked(files.limit(0))).count() == 0
    assert not grammars.parses("(" * 200_000, "python") and grammars.parses("x = 1\n" * 20_000, "python")


# 6: look-alikes

SAME = [
    ("ＡＢＣ１２３", "ABC123"), ("ﾃﾞｰﾀ", "データ"), ("e\u0301te\u0301", "été"), ("ﬁle", "file"), ("a\u200bb\u00adc\u2060", "abc"), ("a\u00a0b\u3000c\u202fd", "a b c d"), ("re\u2011run", "re-run"), ("\u0441\u0430\u0441\u04bb\u0435", "cache"), ("ΑΒΕ", "ABE"), ("⼒と⽇", "力と日"), ("（注）", "(注)"), ("a\r\nb", "a\nb"),
]
DIFFERENT = [("A", "a"), ("x²", "x2"), ("①", "1"), ("a  b", "a b"), ("カ", "力"), ("は", "ば"), ("e", "é")]


def canon(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return {r.k: r for r in lookalike.canonical(clashing(rows, "visible", "n", "t")).collect()}


def test_forms(spark):
    got = canon(spark, [x for pair in SAME + DIFFERENT for x in pair])
    for i in range(len(SAME)):
        assert got[2 * i].canon == got[2 * i + 1].canon, SAME[i]
    for i in range(len(SAME), len(SAME) + len(DIFFERENT)):
        assert got[2 * i].canon != got[2 * i + 1].canon, DIFFERENT[i - len(SAME)]
    odd = canon(spark, [None, "", "\u200b\u3000", "x" * 300_000 + "ﬁ"])
    assert [odd[i].visible for i in range(4)] == [False, False, False, True] and odd[0].canon is None and odd[3].canon.endswith("fi")
    again = canon(spark, [got[k].canon for k in sorted(got)])
    assert all(again[i].canon == got[k].canon for i, k in enumerate(sorted(got)))


def test_slices_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 5, None, "b" * 50, "", "c" * 4, "d" * 4, "e" * 4], "k": list(range(7))})
    parts = list(lookalike.sliced(iter([batch, batch.slice(0, 0)]), "t", 10))
    assert [r for p in parts for r in p.column(1).to_pylist()] == list(range(7)) and [p.num_rows for p in parts] == [2, 1, 3, 1]


@needs_data
def test_pairs_as_by_brute_force(spark):
    texts = lookalike.text_fields(table(spark, SMALL, "query_results"), table(spark, SMALL, "chunks")).cache()
    rows = lookalike.canonical(texts).collect()
    groups = defaultdict(list)
    for r in rows:
        if r.visible:
            groups[r.field, r.scope, r.canon].append((r.key, r.text))
    want = {(f, *sorted((a, b))) for (f, _, _), v in groups.items() for a, x in v for b, y in v if x != y}
    got = lookalike.same_look_pairs(texts).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_pairs_edge_cases(spark):
    rows = [("f", None, 1, "ab"), ("f", None, 2, "ａb"), ("f", "", 3, "ab"), ("f", "s", 4, "ab"), ("f", None, 2, "ａb"), ("f", None, None, "ａb"), ("f", None, 5, None), ("f", None, 6, "\u200b"), ("f", None, 7, "")]
    texts = spark.createDataFrame(rows, "field string, scope string, key bigint, text string")
    assert sorted(map(tuple, lookalike.same_look_pairs(clashing(texts, "salt", "lo", "canon_key", "key_a")).collect())) == [("f", 1, 2), ("f", 2, 3)]
    assert lookalike.same_look_pairs(texts.limit(0)).count() == 0


# 7: packing

def check_containers(rows, sizes, capacity):
    held, taken = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.container_id].append((r.token_offset, r.n_tokens))
        taken[r.doc_id].append((r.piece, r.n_tokens, r.n_pieces))
    for spans in held.values():
        end = 0
        for at, n in sorted(s for s in spans if s[1]):
            assert at >= end
            end = at + n
        assert end <= capacity
    for doc, n in sizes.items():
        n = n or 0
        got = sorted(taken[doc])
        assert sum(x for _, x, _ in got) == n and len(got) == max(1, -(-n // capacity)) and all(p == len(got) for _, _, p in got)


def test_every_document_gets_one_place(spark):
    rng = random.Random(4)
    sizes = {i: rng.choice([0, 1, 7, 7, 7, 50, 99, 100, 101, 250, rng.randint(1, 300)]) for i in range(3000)} | {-1: None, -2: 100_000}
    df = clashing(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint"), "kind", "length", "salt", "piece", "r")
    limits = spark.createDataFrame([("a", 100), ("b", 17), ("b", 17), ("bad", None), ("zero", 0), (None, 5)], "container_kind string, capacity_tokens int")
    rows = packing.pack(df, limits, salts=3).collect()
    assert {r.container_kind for r in rows} == {"a", "b"}
    for kind, capacity in (("a", 100), ("b", 17)):
        check_containers([r for r in rows if r.container_kind == kind], sizes, capacity)
    fill = {r.container_kind: r.unused_share for r in packing.fill_report(packing.pack(df, limits), limits).collect()}
    assert fill["a"] < 0.02
    assert packing.pack(df.limit(0), limits).count() == 0 and packing.pack(df, limits.limit(0)).count() == 0


def test_plan_is_exact_and_small():
    rng = random.Random(1)
    counts = {length: rng.randint(1, 10**9) for length in rng.sample(range(1, 2049), 900)}
    slots, containers = packing.plan(counts, 2048)
    placed = Counter()
    for length, first, ranks, _, _, _ in sorted(slots):
        assert first == placed[length]
        placed[length] += ranks
    assert placed == counts
    used = sum(k * n for k, n in counts.items()) / (containers * 2048)
    assert used > 0.98 and len(slots) < 20_000
    assert packing.plan({}, 8) == ([], 0)


def test_token_counts(spark):
    rows = clashing(spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "word " * 50_000)], "doc_id bigint, text string"), "n_tokens")
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(rows.drop("n_tokens"), ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and 50_000 <= got[4] <= 50_002


# 8: mixing

def mixed(spark, sizes, targets):
    streams = mixing.token_streams(sizes, buckets=5).cache()
    quota = mixing.quotas(streams, targets).cache()
    chosen = mixing.select(streams, quota)
    return quota, chosen, mixing.mix(chosen, mixing.shard_blocks(quota, block_tokens=200, shard_tokens=3000), block_tokens=200)


def test_shares_repeats_and_shards(spark):
    rng = random.Random(6)
    sizes = [("big" if i % 3 else "small", i, rng.choice([1, 5, 40, 400])) for i in range(900)] + [("tiny", 5000, 30), ("tiny", 5001, 11), (None, 1, 5), ("big", 7000, 0), ("big", 7001, None)]
    df = clashing(spark.createDataFrame(sizes, "source string, doc_id bigint, n_tokens bigint"), "h", "start", "bucket", "offset")
    goals = [("m", "big", 0.5, 2, None), ("m", "small", 0.49, 2, None), ("m", "tiny", 0.01, 20, None), ("m", "gone", 0.3, 2, None), ("n", "big", 1.0, 1, 1000), ("n", "big", 1.0, 1, 1000), ("o", "gone", 1.0, 1, None), (None, "big", 1.0, 1, None), ("p", "big", None, 1, None)]
    targets = spark.createDataFrame(goals, "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint")
    quota, chosen, out = mixed(spark, df, targets)
    shares = {(r.mix_name, r.source): r for r in mixing.shares(chosen, quota).collect()}
    assert abs(shares["m", "big"].actual_share - 0.5) < 0.005 and abs(shares["m", "tiny"].actual_share - 0.01) < 0.005 and shares["m", "gone"].tokens == 0 and shares["o", "gone"].tokens == 0
    assert abs(shares["n", "big"].tokens - 1000) <= 1
    rows = out.collect()
    repeats = {(m, s): r for m, s, _, r, _ in goals}
    uses = Counter((r.mix_name, r.source, r.doc_id) for r in rows)
    assert all(n <= repeats[m, s] for (m, s, _), n in uses.items())
    assert len({(r.mix_name, r.source, r.doc_id, r.copy_no) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows if r.mix_name == "m") == sum(v.tokens for (m, _), v in shares.items() if m == "m")
    for (m, s), n in Counter((r.mix_name, r.shard) for r in rows).items():
        assert sorted(r.position for r in rows if (r.mix_name, r.shard) == (m, s)) == list(range(1, n + 1))
    assert mixed(spark, df.limit(0), targets)[2].count() == 0 and mixed(spark, df, targets.limit(0))[2].count() == 0


def test_blocks_are_permuted_by_the_seed():
    for size in (1, 2, 3, 7, 100, 1000, 4097):
        orders = [mixing.permuted(np.arange(size), size, seed, "m", "a") for seed in range(3)]
        assert all(sorted(o) == list(range(size)) for o in orders)
        whole = np.concatenate([mixing.permuted(np.arange(0, size // 2), size, 0, "m", "a"), mixing.permuted(np.arange(size // 2, size), size, 0, "m", "a")])
        assert (whole == orders[0]).all()
        if size >= 100:
            assert (orders[0] != orders[1]).mean() > 0.9 and abs(np.corrcoef(orders[0][:-1], orders[0][1:])[0, 1]) < 0.35


def test_splitting_tree_keeps_quotas(spark):
    quota = spark.createDataFrame([("m", "a", 10_000), ("m", "b", 5_050), ("m", "c", 1)], "mix_name string, source string, quota bigint")
    got = mixing.shard_blocks(quota, block_tokens=10, shard_tokens=700).collect()
    blocks = Counter((r.source, r.block) for r in got)
    assert set(blocks.values()) == {1}
    assert Counter(s for s, _ in blocks) == {"a": 1000, "b": 505, "c": 1}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= len(sizes)


# 9: reading level

def test_reading_words_of_many_sentences():
    """Sentences cut into words together have those of each alone, whatever came before them."""
    found = ["The ledger keeps `a b` every row.", "Yes.", "", "検索の結果はログに残ります。", "See https://x.y/z or a/b for the old plan.", "The ledger keeps every row of the ledger.", "ΟΔΟΣ ist lang und straße breit."]

    def plain(sentence: str) -> set[int]:
        text = reading.SPAN.sub(" ", sentence).lower()
        tokens = reading.TOKEN.findall(text)
        n = sum(reading.token_slots(t)[1] for t in tokens)
        if n < 2.5:
            return set()
        script = "j" if tokens[-1][0] > "\u3000" else "l"
        features = [f"\x00{script}{min(int(n**0.5 * 2), 16)}", f"\x01{script}{min(int(len(text) / n), 9)}"]
        return {h for t in [*tokens, *features] for h in reading.token_slots(t)[0]}

    table = reading.Slots()
    for many in (found, found[::-1], found * 3):
        parts = [reading.slots_of(piece, table) for piece in reading.pieces(many, 60)]
        words, sizes = (np.concatenate(x) for x in zip(*parts))
        ends = np.cumsum(sizes)
        assert [sorted(words[e - n : e].tolist()) for e, n in zip(ends, sizes)] == [sorted(plain(s)) for s in many]
    assert len(parts) > 1 and [len(x) for x in reading.slots_of([], table)] == [0, 0]


def test_sentences():
    text = "# Title\n\nThe note is here. You can read it!\n\n| a | b |\n|---|---|\n\n```\nx = 1.\n```\n2025-03-23 09:24:02 INFO A.b rows=1.\n- これは文です。次の文です。\n> Look at\n> the list.\nkey: value\n"
    assert reading.sentences(text) == ["The note is here.", "You can read it!", "これは文です。", "次の文です。", "the list."]
    assert reading.sentences(None) == [] and reading.sentences("# only a title") == []
    assert reading.slots("Yes.") == [] and reading.slots("`a` `b`.") == []


@needs_data
def test_held_out_judgements(spark):
    root = "/root/testdata/sf0.01"
    known = reading.anchors(table(spark, root, "reading_labels"))
    ids = sorted(known)
    held = set(ids[::3])
    prose = reading.units(table(spark, root, "documents")).cache()
    model = reading.fit(prose, {k: v for k, v in known.items() if k not in held})
    got = {r.doc_id: r.band for r in reading.levels(prose, model).collect()}
    sure = [i for i in held if known[i] in (-1.0, 0.0, 1.0) and i in got]
    assert np.mean([reading.BANDS[int(known[i]) + 1] == got[i] for i in sure]) >= 0.8 and len(sure) > 15


@needs_data
def test_turns_help_where_few_documents_are_judged(spark):
    root = "/root/testdata/sf0.1"
    prose = reading.units(table(spark, root, "documents")).cache()
    known = reading.anchors(table(spark, root, "reading_labels"))
    ids = sorted(known, key=lambda i: hash((i, 7)))
    random.Random(3).shuffle(ids)
    bands = {-1.0: "basic", 0.0: "intermediate", 1.0: "advanced"}
    held_out = {i: bands[known[i]] for i in ids[len(ids) // 2 :] if known[i] in bands}
    hits = []
    for turns in (0, reading.TURNS):
        model = reading.fit(prose, {i: known[i] for i in ids[:12]}, turns)
        got = {r.doc_id: r.band for r in reading.levels(prose, model).select("doc_id", "band").collect()}
        hits.append(sum(got.get(i) == band for i, band in held_out.items()) / len(held_out))
    prose.unpersist()
    assert hits[1] > hits[0] + 0.05


def test_reading_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "One line only."), (4, "The dog runs home. The cat sits here. We go out now. It is a red door."), (4, "The dog runs home. The cat sits here. We go out now. It is a red door."), (5, "The cat sits here. " * 20_000)]
    df = clashing(spark.createDataFrame(docs, "doc_id bigint, text string"), "chars", "sizes", "slots", "band", "level")
    labels = spark.createDataFrame([(4, "a", "basic"), (4, "b", None), (None, "a", "basic"), (9, "a", "odd")], "doc_id bigint, rater string, band string")
    prose = reading.units(df)
    known = reading.anchors(labels)
    assert known == {4: -1.0}
    got = [(r.doc_id, r.n_sentences) for r in reading.levels(prose, reading.fit(prose, known)).collect()]
    assert sorted(got) == [(4, 4), (4, 4), (5, 20_000)]
    empty = reading.units(df.limit(0))
    assert reading.levels(empty, reading.fit(empty, {})).count() == 0


# All queries

@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).count() > 0
