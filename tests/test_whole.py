"""Queries give the whole job's rows: every run, turn, phrase and record, against plain versions on planted tables."""

from __future__ import annotations

import itertools
import random

import duckdb
import pytest

from tesserae.plans import registry

RESULTS = "result_id bigint, run_label string, session_id string, turn_id int, no_citation boolean, cited_chunk_ids array<string>, latency struct<total_ms:double>"


def written(spark, folder, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Results of four runs, some without labels or turns, several per turn."""
    rng = random.Random(3)
    rows = [
        (i, rng.choice(["a", "b", "c", "d", None]), rng.choice(["s", "t", None]), rng.choice([1, 2, 3, None]), rng.random() < 0.3, rng.choice([None, [], ["x"], ["x", "y", "x"], ["z"]]), (float(rng.randrange(100, 200)),))
        for i in range(90)
    ]
    return written(spark, tmp_path_factory.mktemp("runs"), query_results=(rows, RESULTS)), rows


@pytest.mark.parametrize("name", ["agg_19_winners_all_runs", "agg_20_21_deltas_all_runs"])
def test_every_pair_of_runs_is_compared(spark, runs, name):
    root, rows = runs
    got = registry.queries()[name](spark, root)
    columns, found = got.columns, sorted(map(tuple, got.collect()))
    con = duckdb.connect()
    con.execute(f"create view query_results as select * from '{root}/query_results.parquet/*.parquet'")
    assert found == sorted(con.execute(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall())
    turns = {}
    for _, run, session, turn, *_ in rows:
        if run and session and turn:
            turns.setdefault((session, turn), set()).add(run)
    want = sum(len(list(itertools.combinations(x, 2))) for x in turns.values())
    assert want > 20 and (sum(r[-1] for r in found) if "winners" in name else len(found)) == want
    assert {r[:2] for r in found} == set(itertools.combinations("abcd", 2))


def test_citations_cumulate_per_run_over_all_results(spark, runs):
    root, rows = runs
    want = {}
    for _, run, session, turn, *_ in rows:
        if session and turn:
            before = [x[5] or [] for x in rows if x[1:3] == (run, session) and x[3] and x[3] <= turn]
            want[run, session, turn] = len(set(itertools.chain(*before)))
    got = registry.queries()["ses_01_cumulative_citations"](spark, root).collect()
    assert len(got) == len(want) and {(r.run_label, r.session_id, r.turn_id): r.distinct_citations for r in got} == want


def test_every_question_is_expanded_by_the_whole_dictionary(spark, tmp_path):
    questions = ["ミドルウェアの実行順序", "HTTPSリダイレクト", "デッドロックの検索", "nothing", None, "penalty of parse_tree()"]
    turns = [(i, q, "", []) for i, q in enumerate(questions)]
    kind = "session_id string, turns array<struct<turn_id:int, question:string, reference_answer:string, reference_chunk_ids:array<string>>>"
    root = written(spark, tmp_path, eval_sessions=([("s", turns), ("t", turns[:1])], kind), query_results=([(1, "a", "s", 0, False, [], (1.0,))], RESULTS))
    got = {(r.session_id, r.turn_id): r.expansion for r in registry.queries()["ret_07_query_expansion"](spark, root).collect()}
    assert got == {
        ("s", 0): "middleware BaseHTTPMiddleware execution order order stack", ("t", 0): "middleware BaseHTTPMiddleware execution order order stack",
        ("s", 1): "HTTPSRedirectMiddleware add_middleware middleware", ("s", 2): "run_in_threadpool asyncio anyio concurrency retrieve search", ("s", 3): "", ("s", 5): "clause fine parse_tree",
    }


def test_more_than_a_thousand_runs_are_counted(spark, tmp_path):
    turns = [(i, "q", "", []) for i in range(4)]
    kind = "session_id string, turns array<struct<turn_id:int, question:string, reference_answer:string, reference_chunk_ids:array<string>>>"
    rows = [(i, f"run{i:04}", "s", i % 4, False, [], (1.0,)) for i in range(1100)] + [(5000, "run0000", "s", 1, False, [], (1.0,)), (5001, "run0000", "s", 1, False, [], (1.0,)), (5002, "stray", "other", 1, False, [], (1.0,))]
    root = written(spark, tmp_path, eval_sessions=([("s", turns)], kind), query_results=(rows, RESULTS))
    got = {r.run_label: (r.expected, r.found, r.missing) for r in registry.queries()["orc_01_runs"](spark, root).collect()}
    assert got == {f"run{i:04}": (4, 1, 3) for i in range(1, 1100)} | {"run0000": (4, 2, 2), "stray": (4, 0, 4)}


def test_titles_with_the_lists_own_marks_have_rows(spark, tmp_path):
    titles = ["plain", "a [b] c", "[x](http://y.z)", "a | b", "# head", "  # head", "", None, "a\nb", "C#", "[", "]", "|", "#"]
    rows = [(3 * i + k, t) for i, t in enumerate(titles) for k in range(3)]
    root = written(spark, tmp_path, documents=(rows, "doc_id bigint, title string"))
    got = sorted(map(tuple, registry.queries()["src_05_06_url_lists_all"](spark, root).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{root}/documents.parquet/*.parquet'")
    assert len(got) == len(rows) and got == sorted(con.execute(registry.oracle_sql()["src_05_06_url_lists_all"]).fetchall(), key=str)
    assert {r[2] for r in got} >= {"a ［b］ c", "［x］(http://y.z)", "a ｜ b", "＃ head", "none", "a b", "C#", "＃", None}
