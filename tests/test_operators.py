"""Operators against plain versions and on edge cases."""

from __future__ import annotations

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking, citations, evidence, index, retrieval, sampling, sessions
from tesserae.operators.selection import POSITIONS, percentiles
from tesserae.plans import registry
from tesserae.sources import files as src
from tesserae.streaming.events import streamed_segments


METHODS = ("linear", "nearest_rank", "even_index", "upper_median", "round_rank", "floor_index")


def percentile(x, q, method):
    """Aggregate ``x`` at quantile ``q``; nulls are left out and no values give null.

    ``linear`` interpolates, ``nearest_rank`` takes the lowest value with a share of at least q up to it. The
    others index the sorted values: ``even_index`` at round-half-even q(n-1), ``upper_median`` at n/2,
    ``round_rank`` at round-half-even qn, minus 1, and ``floor_index`` at the floor of q(n-1). Those gather a group's values in one
    row, so they are for groups that fit in a task.
    """
    if method == "linear":
        return F.percentile(x, q)
    values = F.sort_array(F.collect_list(x))
    n = F.size(values)
    index = {
        "nearest_rank": F.greatest(F.ceil(F.lit(q) * n).cast("int") - 1, F.lit(0)),
        "even_index": F.bround(F.lit(q) * (n - 1), 0).cast("int"),
        "upper_median": F.floor(n / 2).cast("int"),
        "round_rank": F.greatest(F.bround(F.lit(q) * n, 0).cast("int") - 1, F.lit(0)),
        "floor_index": F.floor(F.lit(q) * (n - 1)).cast("int"),
    }[method]
    return F.when(n > 0, F.get(values, index))


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", expr(F.col("x")).alias("y")).collect())]


def test_tokens(spark):
    got = column(spark, ["parseHTTPQuery snake_case a 区", "認定基準", "!!", "", None, "x1 漢"], T.bm25_tokens)
    assert got == [["parse", "httpquery", "snake_case", "区"], ["認定", "定基", "基準"], [], [], [], ["x1", "漢"]]


def test_features_and_overlap(spark):
    assert column(spark, ["Alpha  beta 検索", "a", "", None], T.text_features) == [["alpha", "beta", "検索"], ["a"], [], []]
    pairs = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["b"]), (["a"], [])], "l array<string>, r array<string>")
    assert [r[0] for r in pairs.select(T.overlap(F.col("l"), F.col("r"))).collect()] == [0.5, 0.0, 0.0]


def test_language_and_slug(spark):
    assert column(spark, ["これは日本語", "plain words", "12345", "", None], T.language) == ["ja", "en", "other", "other", "other"]
    assert column(spark, ["Hello, World!", "???", None, "A" * 200], T.slug) == ["hello-world", "document", "document", "a" * 80]


def test_normalised(spark):
    text = "Ａ​B \r\n\r\n\r\n\tc  d e\r"
    assert column(spark, [text, None, ""], T.normalised) == ["AB\n\nc d e\n", None, "\n"]
    assert unicodedata.is_normalized("NFKC", T.normalised_text("①ﬁ"))


@pytest.mark.parametrize("method", METHODS)
def test_percentile_definitions(spark, method):
    random.seed(3)
    values = [random.choice([1.0, 2.5, 7.0, -3.0, 100.0, 0.0]) for _ in range(57)]
    rows = spark.createDataFrame([("g", v) for v in values] + [("n", None), ("one", 4.0)], "g string, v double")
    for q in (0.5, 0.9, 0.95):
        gathered = {r.g: r.p for r in rows.groupBy("g").agg(percentile(F.col("v"), q, method).alias("p")).collect()}
        exact = {r.g: r.p for r in percentiles(rows, ["g"], "v", {"p": (q, method)}).collect()}
        assert gathered["n"] is None and "n" not in exact
        for g in ("g", "one"):
            assert math.isclose(gathered[g], exact[g], abs_tol=1e-9)
    assert set(METHODS) == set(POSITIONS)


def test_percentiles_keep_null_keys(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", float("nan"))], "g string, v double")
    assert [tuple(r) for r in percentiles(rows, ["g"], "v", {"p": (0.5, "linear")}).collect()] == [(None, 2.0)]


def test_bm25_matches_plain(spark):
    docs = {1: "alpha beta beta", 2: "beta gamma", 3: "delta", 4: "alpha alpha delta"}
    texts = spark.createDataFrame(list(docs.items()), "chunk_no int, text string")
    posts = index.postings(texts, "chunk_no", F.col("text"))
    terms = index.term_statistics(posts, F.lit(len(docs)))
    queries = spark.createDataFrame([(1, "alpha beta beta"), (2, "unknown"), (3, None)], "query_id int, query string")
    got = {(r.query_id, r.chunk_no): r.score for r in retrieval.bm25_scores(queries, posts, terms, index.length_statistics(texts, F.col("text")), "chunk_no").collect()}
    tokens = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, tokens.values())) / len(tokens)
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t in {x for v in tokens.values() for x in v} for n in [sum(t in v for v in tokens.values())]}
    mean = sum(raw.values()) / len(raw)
    idf = {t: v if v >= 0 else 0.25 * mean for t, v in raw.items()}
    for k, v in tokens.items():
        want = sum(idf[t] * v.count(t) * 2.5 / (v.count(t) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for t in ["alpha", "beta", "beta"] if t in v)
        if any(t in v for t in ("alpha", "beta")):
            assert math.isclose(got[1, k], want)
    assert all(q == 1 for q, _ in got)


def test_bm25_topk_in_blocks(spark):
    """The blocked search ranks as all scores do, ties by place included, whatever the blocks."""
    random.seed(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(i, f"p{i % 3}", " ".join(random.choices(words, k=i % 5))) for i in range(60)]
    texts = spark.createDataFrame(rows, "chunk_no bigint, path string, text string")
    tokens = index.tokenised(texts, "chunk_no", F.col("text"), "path").cache()
    posts = index.postings_of(tokens, "chunk_no")
    terms, lengths = index.term_statistics(posts, F.lit(len(rows))), index.length_statistics(texts, F.col("text"))
    queries = spark.createDataFrame([(1, "alpha beta beta"), (2, "unknown"), (3, None), (4, "delta"), (5, "eps gamma alpha")], "query_id bigint, query string")
    every = retrieval.bm25_scores(queries, posts, terms, lengths, "chunk_no").join(texts.drop("text"), "chunk_no").withColumn("score", F.round("score", 6))
    want = retrieval.top_k(every, 7, ["query_id"], [F.desc("score"), F.asc("path"), F.asc("chunk_no")]).select("query_id", "chunk_no", "path", "score", "rank").collect()
    for blocks in ({}, {"query_block": 2, "text_block": 7}):
        got = retrieval.bm25_topk(queries, tokens, terms, lengths, "chunk_no", 7, ("path",), **blocks).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 21
    assert retrieval.bm25_topk(queries, tokens.limit(0), terms, lengths, "chunk_no", 7).count() == 0


def test_token_vectors_match_postings(spark):
    texts = spark.createDataFrame([(1, "alpha beta beta"), (2, ""), (3, "検索エンジン and more"), (4, None)], "chunk_no bigint, text string")
    tokens = index.tokenised(texts, "chunk_no", F.col("text"))
    want = {r.chunk_no: r.vector for r in index.vectors_of(index.postings_of(tokens, "chunk_no"), "chunk_no").collect()}
    got = {r.chunk_no: r.vector for r in index.token_vectors(tokens, "chunk_no").collect()}
    assert got.keys() == want.keys() == {1, 3} and all(math.isclose(a, b) for k in want for a, b in zip(got[k], want[k], strict=True))


def shuffled(spark, work) -> int:
    """Rows that ``work`` writes to shuffles."""
    sc = spark.sparkContext
    store, bus = sc._jsc.sc().statusStore(), sc._jsc.sc().listenerBus()

    def written() -> int:
        bus.waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    work()
    return written() - before


def test_searches_read_items_in_place(spark):
    """Texts and vectors are met where they are read: only what is found goes through a shuffle."""
    n = 500
    texts = spark.range(n).select(F.col("id").alias("chunk_no"), F.concat(F.lit("word"), "id").alias("text"))
    tokens = index.tokenised(texts, "chunk_no", F.col("text")).cache()
    terms = index.term_statistics(index.postings_of(tokens, "chunk_no"), F.lit(n)).where("token in ('word3', 'word5')").cache()
    lengths = index.length_statistics(texts, F.col("text")).cache()
    items = spark.range(n).select(F.col("id").alias("item_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector")).cache()
    counted = [tokens.count(), terms.count(), lengths.count(), items.count()]
    assert counted == [n, 2, 1, n]
    queries = spark.createDataFrame([(1, "word3 word5")], "query_id bigint, query string")
    assert shuffled(spark, lambda: retrieval.bm25_topk(queries, tokens, terms, lengths, "chunk_no", 2).collect()) < 100
    assert shuffled(spark, lambda: retrieval.dense_topk(items.where("item_id = 7").withColumnRenamed("item_id", "query_id"), items, 2).collect()) < 100


def test_searches_shuffle_no_pairs(spark, tmp_path):
    """All questions share a token with all chunks, and yet no row per pair of them is shuffled."""
    n = 400
    chunks = spark.range(n).select(
        F.col("id").alias("chunk_no"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("r").alias("repo_id"), F.lit("x").alias("repo_commit"), F.concat(F.lit("f"), "id").alias("rel_path"), F.lit("python").alias("language"),
        F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.concat(F.lit("common word"), "id").alias("content"), F.array().cast("array<string>").alias("symbols"), F.lit(None).cast("string").alias("section_header"),
    )
    turn = F.struct(F.lit(1).alias("turn_id"), F.concat(F.lit("common question"), "id").alias("question"))
    chunks.write.parquet(f"{tmp_path}/chunks.parquet")
    spark.range(n).select(F.concat(F.lit("s"), "id").alias("session_id"), F.array(turn).alias("turns")).write.parquet(f"{tmp_path}/eval_sessions.parquet")
    spark.range(n).select((F.col("id") * 50).alias("result_id"), F.concat(F.lit("s"), "id").alias("session_id"), F.lit(1).alias("turn_id")).write.parquet(f"{tmp_path}/query_results.parquet")
    for name, k in (("ret_01_bm25_topk", 10), ("ret_05_hybrid_fusion", 20)):
        rows = []
        assert shuffled(spark, lambda: rows.extend(registry.queries()[name](spark, str(tmp_path)).collect())) < n * n * 0.8
        assert len(rows) == n * k


def test_dense_blocks_agree(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id bigint, vector array<double>")
    queries = items.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    one = retrieval.dense_topk(queries, items, 5).collect()
    many = retrieval.dense_topk(queries, items, 5, query_block=2, item_block=7).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many)) and len(one) == 30
    assert retrieval.dense_topk(queries, items.limit(0), 5).count() == 0


def test_fusion_and_variants(spark):
    a = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (2, 9, 0.0)], "query_id int, chunk_no int, score double")
    b = spark.createDataFrame([(1, 11, 1.0), (1, 12, 0.5)], "query_id int, chunk_no int, score double")
    got = {(r.query_id, r.chunk_no): round(r.score, 4) for r in retrieval.fuse(a, b, "chunk_no").collect()}
    assert got == {(1, 10): 0.45, (1, 11): 0.675, (1, 12): 0.225, (2, 9): 0.0}
    both = a.withColumn("variant", F.lit(1)).unionByName(a.withColumn("variant", F.lit(0)))
    assert {r.variant for r in retrieval.merge_variants(both, "chunk_no").collect()} == {0}


def test_zero_rows_fill(spark):
    hits = spark.createDataFrame([(1, 5, 2.0, 0)], "query_id int, chunk_no int, score double, ord int")
    queries = spark.createDataFrame([(1,), (2,)], "query_id int")
    filled = retrieval.with_zero_rows(hits, queries, [(5, 10), (6, 11)], "chunk_no", 2).collect()
    assert sorted((r.query_id, r.chunk_no, r.score) for r in filled) == [(1, 5, 2.0), (1, 6, 0.0), (2, 5, 0.0), (2, 6, 0.0)]


def test_expansion(spark):
    got = column(spark, ["検索 of parseTree and a.b.c", "nothing here", None], lambda c: retrieval.expanded_query(c, {"検索": ["search", "SEARCH"]}))
    assert got[0] == "search" and got[1] == ""
    got = column(spark, ["(parseTree)parse_tree,x"], lambda c: retrieval.expanded_query(c, {"検索": ["search"]}))
    assert got == ["parseTree parse_tree"]


def test_neighbours_and_pack(spark):
    chunks = spark.createDataFrame([(i, "r", "c", "f", i) for i in range(1, 6)], "chunk_no int, repo_id string, repo_commit string, rel_path string, start_line int")
    seeds = spark.createDataFrame([(1, 1), (1, 3)], "query_id int, chunk_no int")
    near = sorted((r.seed, r.chunk_no, r.distance) for r in retrieval.file_neighbours(seeds, chunks).collect())
    assert near == [(1, 2, 1), (3, 2, -1), (3, 4, 1)]
    edges = spark.createDataFrame([(1, 2), (2, 5), (5, 1)], "from_chunk int, to_chunk int")
    hops = sorted((r.chunk_no, r.hop) for r in retrieval.symbol_neighbours(seeds, edges, 2).collect())
    assert hops == [(2, 1), (5, 2)]
    found = seeds.withColumn("ord", F.col("chunk_no"))
    graph = spark.createDataFrame([(1, 3, 1), (1, 9, 2)], "query_id int, chunk_no int, ord int")
    grown = retrieval.expand(found, graph, graph.limit(0), 2).collect()
    assert {(r.chunk_no, r.source) for r in grown} == {(1, "retrieval"), (3, "retrieval")}
    sized = spark.createDataFrame([(1, 1, 1, 50, False, False), (1, 2, 2, 30, True, False), (1, 3, 3, 100, False, True)], "query_id int, chunk_no int, position int, chars int, pinned boolean, recent boolean")
    pack = sorted((r.citation_index, r.chunk_no) for r in retrieval.evidence_pack(sized, 8, 33).collect())
    assert pack == [(1, 2), (2, 3)]


def test_headings(spark):
    assert column(spark, ["A > B > C", "A", ""], retrieval.parent_heading) == ["A > B", "", ""]


def test_citations(spark):
    a = F.col("x")
    assert column(spark, ["a【C：02】b［ C : 3 ］", "none", None], citations.cited_indices) == [[2, 3], [], []]
    assert column(spark, ["a【C：02】"], citations.normalised_markers) == ["a[C:2]"]
    rng = random.Random(5)
    cases = [("x [C:9]。y [C:1] z [C:7]", [1, 2], "x [C:1]。y [C:1] z [C:2]"), ("x [C:9] 。", [], "x。"), (None, [1], None), ("", [1], ""), ("no marks", [1], "no marks"), ("a [C:3] b [C:3] c [C: 2 ]", [2], "a [C:2] b  c [C: 2 ]")]
    for _ in range(40):
        text = " ".join(rng.choice(["word", "。", f"[C:{rng.randint(1, 6)}]", "[Ｃ:1]"]) for _ in range(12))
        allowed = rng.sample(range(1, 6), rng.randint(0, 4))
        cases.append((text, allowed, within_budget(text, allowed)))
    rows = spark.createDataFrame([(i, t, a) for i, (t, a, _) in enumerate(cases)], "i int, t string, a array<int>")
    got = {r.i: r.out for r in rows.select("i", citations.budgeted(F.col("t"), F.col("a")).alias("out")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]
    few = spark.createDataFrame([("[C:3] [C:1] [C:3] [C:2] [C:2] [C:10]",), ("none",)], "t string").select(citations.by_frequency(F.col("t")).alias("o")).collect()
    assert [r.o for r in few] == [[2, 3, 1, 10], []]
    answers = spark.createDataFrame([(1, "[C:1][C:5]"), (2, None), (3, "no")], "answer_id int, answer string")
    packs = spark.createDataFrame([(1, 1, "k")], "answer_id int, citation_index int, chunk string")
    got = {r.answer_id: (r.cited, r.wrong, r.no_citation) for r in citations.resolve(answers, packs).collect()}
    assert got == {1: (["k"], [5], False), 2: ([], [], True), 3: ([], [], True)}
    assert column(spark, ["一つ[C:1]。次に二つ[C:2]"], citations.contexts)[0][1].citation_index == 2
    assert a is not None


def within_budget(text, allowed):
    """The budget of markers, plainly."""
    used = set()

    def turn(m):
        index = int(m.group(1))
        if index in allowed:
            used.add(index)
            return m.group()
        other = next((a for a in allowed if a not in used and a != index), None)
        used.add(other)
        return f"[C:{other}]" if other else ""

    return re.sub(r"\s+([。.,、])", r"\1", re.sub(citations.MARKER, turn, text))


MARKDOWN = "intro\n# One #\nbody\n#\n# \n## Two\n第1条 目的\ntext\n第2条の規定による\n  第3条\n````\n# no\n```\n# no\n````\n~~~\n#### four\n第四節\nend\n"


def test_markdown_sections():
    got = [(a, b, path) for a, b, _, path in chunking.sections(MARKDOWN)]
    assert got == [(1, 1, ""), (3, 5, "One #"), (7, 17, "One # > Two"), (18, 19, "One # > Two")]
    assert list(chunking.sections("")) == [] and [x[3] for x in chunking.sections("# A\n### C\nx\n## B\ny\n")] == ["A > C", "A > B"]
    assert chunking.paragraphs("a" * 6 + "\n \n\n" + "b" * 5, 8, 2) == ["a" * 6, "b" * 5]
    assert chunking.paragraphs("x" * 20, 8, 2) == ["x" * 8, "x" * 8, "x" * 8]


def test_call_edges_join_definitions(spark):
    rows = [
        (1, "r", "python", "def load():\n    return save(1)\n", ["load"]), (2, "r", "python", "def save(x):\n    return x.load()\n", ["save"]), (3, "r", "python", "def (broken", ["broken"]),
        (4, "other", "python", "save()\n", []), (5, "r", "go", "save()", []), (6, "r", "python", None, None),
    ]
    chunks = spark.createDataFrame(rows, "chunk_no int, repo_id string, language string, content string, symbols array<string>")
    edges = {(r.from_chunk, r.to_chunk, r.symbol) for r in index.call_edges(chunks, index.definitions(chunks)).collect()}
    assert edges == {(1, 2, "save"), (2, 1, "load")}


def test_pack_with_pins(spark):
    rows = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 12, 5), (2, 10, 1)], "query_id int, chunk_no int, position int")
    pins = spark.createDataFrame([(1, 12, 1), (1, 99, 2), (1, 12, 3)], "query_id int, chunk_no int, position int")
    recent = spark.createDataFrame([(1, 11), (1, 11)], "query_id int, chunk_no int")
    sizes = spark.createDataFrame([(10, 8), (11, 8), (12, 8), (99, 8)], "chunk_no int, chars int")
    got = [(r.query_id, r.citation_index, r.chunk_no, r.priority) for r in evidence.pack_with_pins(rows, pins, recent, sizes, 8, 7).orderBy("query_id", "citation_index").collect()]
    assert got == [(1, 1, 12, 0), (1, 2, 99, 0), (1, 3, 11, 1), (2, 1, 10, 2)]
    assert evidence.pack_with_pins(rows.limit(0), pins.limit(0), recent, sizes).count() == 0


def test_segments_follow_the_rules(spark):
    told = ["アプリの概要を教えて", "それはどこですか", "x" * 60 + " zebra quartz " + " ".join(f"word{i}" for i in range(30)), " ".join(f"other{i}" for i in range(30)), "short one", "料金プラン改定について", None, ""]
    turns = spark.createDataFrame([("s", i, q) for i, q in enumerate(told, 1)], "session_id string, turn_id int, question string")
    got = {r.turn_id: (r.segment, r.carryover) for r in sessions.segments(turns).collect()}
    assert got[1] == (0, "independent") and got[2][1] == "mixed" and got[3] == (1, "weak") and got[4] == (2, "weak") and got[5] == (2, "mixed") and got[6] == (3, "weak")


def test_full_width_titles_have_slugs(spark):
    assert column(spark, ["Ｈｅｌｌｏ　Ｗｏｒｌｄ１", "ﬁle①", "第３条"], T.slug) == ["hello-world1", "file1", "3"]


def test_segments_streamed_as_batch(spark, tmp_path):
    questions = ["How does `alpha_index` work?", "And that?", "What is the penalty of gamma rules?", "用語集の更新について教えてください", "それは何ですか"]
    turns = spark.createDataFrame([(s, i, q) for s in ("a", "b") for i, q in enumerate(questions)], "session_id string, turn_id int, question string")
    batch = sorted(map(tuple, sessions.segments(turns).collect()))
    assert len(batch) == 10 and batch[0][3] == "independent"
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
    run = streamed_segments(stream).writeStream.format("memory").queryName("segments_test").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(map(tuple, spark.table("segments_test").collect())) == batch
    assert sessions.segments(turns.limit(0)).count() == 0


def test_line_chunks_step_back():
    lines = ["x" * 49 + "\n"] * 10
    assert [(a, b) for a, b, _ in chunking.line_chunks(lines, 2400, 300)] == [(1, 10), (5, 10)]
    assert list(chunking.line_chunks([], 10, 2)) == []


def test_chunks_by_language(spark):
    python = "import os\n\n\ndef a():\n    return 1\n\n\ndef b():\n    return 2\n"
    got = chunking.chunk_text(python, "python", 2400, 300)
    assert [(a, b, s) for a, b, _, _, s, _ in got] == [(1, 3, []), (4, 9, ["a", "b"])]
    md = "# One\ntext\n```\n# no heading\n```\n## Two\nmore\n#### four\nx\n"
    assert [(p, h) for _, _, p, h, _, _ in chunking.chunk_text(md, "markdown")] == [("text\n```\n# no heading\n```\n", "One"), ("more\n#### four\nx\n", "One > Two")]
    long = "# A\n" + "\n\n".join("p" * 1000 for _ in range(4)) + "\n"
    assert [s for *_, s in chunking.chunk_text(long, "markdown")] == ["#part1of2", "#part2of2"]
    assert chunking.chunk_text("", "go") == [] and len(chunking.chunk_text("def (", "python")) == 1
    files = spark.createDataFrame([(1, "r", "c", "a.py", "python", None), (2, "r", "c", "b.go", "go", "package x\n")], "file_id bigint, repo_id string, repo_commit string, rel_path string, language string, content string")
    assert [r.chunk_id for r in chunking.chunk_files(files).collect()] == ["r::b.go::1-1"]


def test_char_and_token_windows(spark):
    texts = spark.createDataFrame([(1, "a" * 25), (2, ""), (3, None), (4, "b" * 10)], "k int, t string")
    got = sorted((r.k, r.start_char, r.end_char) for r in chunking.char_windows(texts, "k", "t", 10, 3).collect())
    assert got == [(1, 0, 10), (1, 7, 17), (1, 14, 24), (1, 21, 25), (2, 0, 0), (4, 0, 10)]
    tokens = spark.createDataFrame([(1, list(range(5))), (2, [])], "k int, tokens array<int>")
    assert sorted((r.part, r.tokens) for r in chunking.token_windows(tokens, "k", "tokens", 2).collect()) == [(0, [0, 1]), (1, [2, 3]), (2, [4])]


def test_sampling(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), F.pmod("id", F.lit(3)).alias("s"))
    parts = sampling.split(rows, "k", 0.1, seed=2).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"val": 50, "train": 450}
    assert sampling.stratified(rows, "s", "k", 7).groupBy("s").count().where("count = 7").count() == 3
    assert sampling.full_batches(rows, "s", "k", 100).count() == 300
    weights = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "n string, w int")
    assert sampling.allocation(weights, 10, "n", "w").agg(F.sum("scenarios")).first()[0] == 10


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("[T](https://a.b/c)",), ("U | https://d.e",), ("https://f.g",), ("",), ("# no",)], "line string")
    assert sorted(map(tuple, src.parsed_urls(lines).collect()), key=str) == sorted([("https://a.b/c", "T"), ("https://d.e", "U"), ("https://f.g", None)], key=str)
    with pytest.raises(Exception, match="no URL"):
        src.parsed_urls(spark.createDataFrame([("oops",)], "line string")).collect()
    page = "<html><head><title> A  b </title><style>x</style></head><body><h2>Top</h2><p>one<br>two</p><ul><li>x</li></ul><script>no</script></body></html>"
    assert src.page_markdown(page) == ("A b", "## Top\n\none\ntwo\n\n- x\n") and src.page_markdown(None) == (None, None)
    assert src.page_markdown("<script><style></style>x</script><div>a  b</div>") == ("Untitled", "a b\n") and src.page_markdown("<title>Only</title>") == ("Only", "Only\n")
    kinds = spark.createDataFrame([("text/html", "https://a/x"), (None, "https://a/x.PDF"), ("", "https://a/x.md"), ("text/plain", "https://a/x"), (None, None)], "c string, u string")
    assert [r[0] for r in kinds.select(src.kind_of(F.col("c"), F.col("u"))).collect()] == ["html", "pdf", "markdown", "text", "html"]
    for name, body in (("a/x.py", "p = 1\n"), ("root.py", "q\n"), ("a/skip/y.py", "z\n")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    scanned = src.scan(spark, str(tmp_path), ["**/*.py"], ["*/skip/*"], "r", "c").collect()
    assert [(r.rel_path, r.language, r.line_count) for r in scanned] == [("a/x.py", "python", 2)]
    assert column(spark, ["A.TSX", "noext", "d/x.KT"], src.language_of) == ["typescript", "text", "kotlin"]
    rows = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, v int, t string")
    assert sorted(r.t for r in src.upserted(rows, ["k"], [F.desc("v")]).collect()) == ["new", "only"]


def test_more_retrieval(spark):
    hits = spark.createDataFrame([(1, 1, "a.md", 2.0), (1, 2, "b.PY", 1.8)], "query_id int, chunk_no int, rel_path string, score double")
    assert [r.chunk_no for r in retrieval.boosted(hits, ".py", 0.5).orderBy("rank").collect()] == [2, 1]
    assert [r.chunk_no for r in retrieval.boosted(hits, ".py", 0.0).orderBy("rank").collect()] == [1, 2]
    one = hits.select("query_id", "chunk_no", F.col("chunk_no").alias("ord"))
    union = retrieval.ordered_union([one.where("chunk_no = 2"), one, one.limit(0)], "chunk_no").orderBy("position").collect()
    assert [r.chunk_no for r in union] == [2, 1]
    assert {r.chunk_no: r.score for r in retrieval.score_map([hits, hits.withColumn("score", F.lit(-1.0))], "chunk_no").collect()} == {1: 1.0, 2: 0.9}
    ids = spark.createDataFrame([("r::f::1-9#part2of3",), ("r::f::1-9",)], "chunk_id string")
    assert sorted(r.sibling for r in retrieval.split_siblings(ids).collect()) == [f"r::f::1-9#part{i}of3" for i in (1, 2, 3)]
    near = spark.createDataFrame([(0.5, 0.2, 0.6)], "retrieval double, current double, session double")
    got = near.select(retrieval.dual_scores(near, F.lit(True)), retrieval.dual_scores(near, F.lit(False))).first()
    assert [round(x, 6) for x in got] == [0.367, 0.26]


def test_grids_and_weights(spark):
    phase = sampling.grid({"a": [1, 2, 3], "b": [1, 2, 3], "c": [1, 2, 3]}, spark).where("not (a = 1 and b = 3)")
    assert phase.count() == 24
    seeds = spark.createDataFrame([(5, 5)], "a int, b int")
    assert sorted(map(tuple, sampling.neighbours(seeds, {"a": [-1, 1], "b": [-1, 0, 1]}).collect())) == [(4, 5), (5, 4), (5, 6), (6, 5)]


def test_weighted_mix(spark):
    rows = spark.createDataFrame([("x" if i % 7 else "y", i) for i in range(350)] + [("z", 999), (None, 1000)], "source string, doc_id int")
    mixed = sampling.weighted_mix(rows.withColumn("n", F.lit("clash")).drop("n"), "source", "doc_id", {"x": 0.75, "y": 0.25}, 0.1).collect()
    assert sorted(r.place for r in mixed) == list(range(1, 201)) and sum(r.source == "x" for r in mixed) == 150 and sum(r.part == "val" for r in mixed) == 20
    assert {r.part for r in mixed if r.place > 180} == {"val"}
    assert sampling.weighted_mix(rows, "source", "doc_id", {"x": 0.5, "gone": 0.5}).count() == 0 and sampling.weighted_mix(rows.limit(0), "source", "doc_id", {"x": 1.0}).count() == 0
    for bad in ({"x": 0.5}, {}, {"x": 1.5, "y": -0.5}):
        with pytest.raises(ValueError, match="add up"):
            sampling.weighted_mix(rows, "source", "doc_id", bad)


def test_ranks_of_large_groups(spark):
    rng = random.Random(8)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.randrange(50), i) for i in range(400)]
    got = sampling.group_ranks(spark.createDataFrame(rows, "g string, o int, i int"), ["g"], ["o", "i"], ranges=16).collect()
    for group in ("hot", "a", None):
        own = sorted((o, i) for g, o, i in rows if g == group)
        assert {r.i: (r.rank, r.n) for r in got if r.g == group} == {i: (k, len(own)) for k, (_, i) in enumerate(own, 1)}


def test_picks_faults_and_variants(spark):
    index = spark.createDataFrame([(i, True, i % 2 == 0, i == 3) for i in range(8)], "doc_id int, always boolean, has_a boolean, has_b boolean")
    picks = sampling.category_picks(index, {"all": ("always",), "a": ("has_a",), "both": ("has_a", "has_b"), "b": ("always", "has_b")}, "doc_id", 3).collect()
    by = {c: {r.doc_id for r in picks if r.category == c} for c in ("all", "a", "both", "b")}
    assert len(by["all"]) == 3 and len(by["a"]) == 3 and by["a"] <= {0, 2, 4, 6} and by["both"] <= {0, 2, 4, 6} and by["b"] == {3}
    lines = spark.createDataFrame([(1, [1, 2]), (2, []), (3, None), (4, [1] * 9), (5, [1, -1]), (6, [1, None]), (7, [8])], "i int, t array<int>")
    assert {r.i: (r.n_tokens, r.fault) for r in sampling.token_faults(lines, "i", "t", 8, 5).collect()} == {2: (0, "empty"), 3: (0, "empty"), 4: (9, "too_long"), 5: (2, "out_of_range"), 6: (2, "out_of_range"), 7: (1, "out_of_range")}
    runs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "v string, n int")
    assert {(r.v, r.position) for r in sampling.chosen_variants(runs, "v", "c, a").collect()} == {("c", 0), ("a", 1)}
    with pytest.raises(Exception, match="unknown variant"):
        sampling.chosen_variants(runs, "v", "a,nope").collect()


def test_grades_and_phrases(spark):
    rows = spark.createDataFrame(
        [([1], [], ["a::b::1"], False), ([], ["a::b::1"], ["a::b::1"], True), ([], ["a::b::2"], ["a::b::1"], False), ([], [], ["a::b::1"], False), ([], ["z::z::1"], ["a::b::1"], True), ([], ["z::z::1"], [], False)],
        "w array<int>, c array<string>, t array<string>, r boolean",
    )
    from tesserae.operators.evalstats import citation_grade

    assert [r[0] for r in rows.select(citation_grade(F.col("w"), F.col("c"), F.col("t"), F.col("r"))).collect()] == ["WRONG", "CORRECT_CHUNK", "ARTICLE_LEVEL", "NO_CITATION", "NO_CITATION", "WRONG"]
    assert column(spark, ["x罰則と例外", "なし", None], lambda c: index.keyword_of(c, ["例外", "罰則"])) == ["例外", None, None]


def test_repeated_deliveries(spark):
    from tesserae.operators.evalstats import delivered_once

    rows = spark.createDataFrame([("q", None, 1.0, 1), ("q", None, 1.0, 2), (None, "q", 1.0, 3), ("q", None, float("nan"), 4), ("q", None, float("nan"), 5)], "question string, answer string, ms double, received_at int")
    assert delivered_once(rows).count() == 3 and delivered_once(rows, ["ms"]).count() == 3 and delivered_once(rows.limit(0)).count() == 0


def test_related_questions_of_some_sessions(spark, small):
    """sessions that nothing asks about aren't worked on, and the others' related questions stay the same."""
    from tesserae.plans import memory

    every = sorted(map(tuple, memory.related(spark, small).collect()))
    wanted = sorted({r[0] for r in every})[::3]
    of = spark.createDataFrame([(s,) for s in wanted] + [("none",), (None,)], "session_id string")
    got = sorted(map(tuple, memory.related(spark, small, of).collect()))
    assert got and got == [r for r in every if r[0] in wanted] and len(got) < len(every)
    assert {r.session_id for r in memory.question_turns(spark, small, of).collect()} == set(wanted)


def test_calls_by_several_names_count_once(spark):
    """pairs of chunks that call each other by several names are told apart where chunks are reached, not in a shuffle of all edges."""
    edges = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (1, 2, "a"), (2, 3, "c"), (2, 1, "d"), (3, 4, "e"), (9, 8, "f")], "from_chunk long, to_chunk long, symbol string")
    seeds = spark.createDataFrame([(7, 1), (7, 1), (5, 3)], "query_id long, chunk_no long")
    got = retrieval.symbol_neighbours(seeds, edges, 2)
    assert sorted(map(tuple, got.collect())) == [(5, 4, 1), (7, 2, 1), (7, 3, 2)]
    one_hop = retrieval.symbol_neighbours(seeds, edges, 1)._jdf.queryExecution().analyzed().toString()
    # The seeds, once for each of their uses, and the chunks reached.
    assert one_hop.count("Deduplicate") + one_hop.count("Distinct") == 4


def test_expansion_is_made_once(spark, small):
    """debug rows read the expanded chunks three times, which are stored and not made again for each."""
    from tesserae.plans.evidence import Steps

    steps = Steps(spark, small)
    assert steps.expanded is steps.expanded
    assert steps.expanded.count() > 0 and "Window" not in steps.expanded._jdf.queryExecution().optimizedPlan().toString()


def test_source_counts_are_those_of_the_debug_rows(spark, small):
    """sources are counted over all debug rows, expanded and rejected ones."""
    rows: dict[str, list] = {}
    for r in registry.queries()["ret_18_19_debug_rows"](spark, small).collect():
        rows.setdefault(r.source, []).append(r)
    want = {s: (len(x), sum(r.reranker_score is not None for r in x), len({r.query_id for r in x})) for s, x in rows.items()}
    got = {r.source: (r.rows, r.scored, r.queries) for r in registry.queries()["agg_22_source_counts"](spark, small).collect()}
    assert set(want) == {"retrieval", "neighbor"} and got == want
