"""Queries on sessions, citations, sources and chunks."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import REFUSALS
from tesserae.operators import citations, sessions
from tesserae.operators.chunking import chunk_files
from tesserae.plans.fragments import features
from tesserae.sources import files as src
from tesserae.sources.tables import shared_folder, table
from tesserae.streaming.events import streamed_segments, windowed_rates

QUERIES: dict = {}
SQL: dict[str, str] = {}
TURNS = "turns as (select session_id, t.turn_id as turn_id, min(t.question) as question, min(t.reference_answer) as answer from (select session_id, unnest(turns) as t from eval_sessions) group by all)"

SIGNALS = f"""{TURNS}, g as (select session_id, turn_id, question, {features('question')} as f, {' or '.join(f"contains(lower(question), '{w}')" for w in sessions.FOLLOW_UP)} as marked, {' or '.join(f"contains(lower(question), '{w}')" for w in sessions.COMPARISON)} as compares,
list_distinct(list_filter(list_transform(regexp_extract_all(question, '{sessions.ANCHOR}', 1), lambda x: regexp_replace(x, '[ \\t\\n]', '', 'g')), lambda x: length(x) >= 6 and {' and '.join(f"not contains(x, '{n}')" for n in sessions.ANCHOR_NOISE)})) as anchors from turns),
w as (select *, lag(f, 1) over o as p1, lag(f, 2) over o as p2, row_number() over o as rn from g window o as (partition by session_id order by turn_id)),
o as (select *, case when len(f) > 0 and len(p1) > 0 then len(list_intersect(f, p1)) / len(f) else 0 end as s1, case when len(f) > 0 and len(p2) > 0 then len(list_intersect(f, p2)) / len(f) else 0 end as s2, list_transform(anchors, lambda x: {features('x')}) as af from w),
base as (select *, greatest(s1, s2) as similarity, not marked and not compares and len(anchors) > 0 as named, list_bool_and(list_transform(af, lambda x: coalesce(len(list_intersect(x, p1)) / len(x), 0) < 0.08)) as fresh1, list_bool_and(list_transform(af, lambda x: coalesce(len(list_intersect(x, p2)) / len(x), 0) < 0.08)) as fresh2 from o),
s as (select *, coalesce(rn > 1 and named and s1 < 0.25 and fresh1, false) as switch1, coalesce(rn > 1 and named and similarity < 0.25 and fresh1 and (fresh2 or p2 is null), false) as switch2 from base)"""

#: The segment fold as a recursion over turns.
SEGMENT_FOLD = f"""with recursive {SIGNALS}, fold as (
select session_id, turn_id, rn, 0 as segment, 1 as n, 'independent' as carryover from s where rn = 1 union all
select session_id, turn_id, rn, segment + starts::int, case when starts then 1 else n + 1 end, case when starts then 'weak' when marked and own >= 0.08 then 'strong' when marked or own >= 0.18 or held then 'mixed' else 'weak' end from (
  select *, not marked and similarity < 0.18 and not held as starts from (
    select *, not switch2 and not switch_own and (marked or len(f) <= 24 or own >= 0.06) as held from (
      select s.*, fold.segment, fold.n, case when fold.n > 1 then s.similarity else s.s1 end as own, case when fold.n > 1 then s.switch2 else s.switch1 end as switch_own from fold join s on s.session_id = fold.session_id and s.rn = fold.rn + 1))))"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def eval_turns(spark: SparkSession, root: str, of: DataFrame | None = None) -> DataFrame:
    """Turns of all sessions, or of those whose ``session_id`` is in ``of``."""
    sessions = table(spark, root, "eval_sessions")
    turns = (sessions if of is None else sessions.join(of, "session_id", "left_semi")).select("session_id", F.explode("turns").alias("t"))
    return turns.groupBy("session_id", F.col("t.turn_id").alias("turn_id")).agg(F.min("t.question").alias("question"), F.min("t.reference_answer").alias("answer"))


def vector_turns(spark: SparkSession, root: str) -> DataFrame:
    """Vectors as turns of sessions of 25, in the order of their ids."""
    v = table(spark, root, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 25).alias("session_id"), F.pmod("vec_id", F.lit(25)).cast("int").alias("turn_id"), F.col("embedding").alias("vector"))


VECTORS = "v as (select vec_id // 25 as session_id, vec_id % 25 as turn_id, embedding::double[] as vector from embeddings)"


@query(f"""with {TURNS}, l as (select session_id, turn_id, 'Q' || turn_id || ': ' || coalesce(question, '') || chr(10) || 'A' || turn_id || ': ' || case when length(a) > 400 then left(a, 400) || '...' else a end as line
from (select *, regexp_replace(coalesce(answer, ''), '\\[C:[0-9]+\\]', '', 'g') as a from turns))
select session_id, turn_id, md5(coalesce(array_to_string(list(line) over (partition by session_id order by turn_id rows between 4 preceding and 1 preceding), chr(10)), '')) as digest from l""")
def txt_12_history(spark: SparkSession, root: str) -> DataFrame:
    return sessions.history_text(eval_turns(spark, root)).select("session_id", "turn_id", F.md5("history").alias("digest"))


@query(f"""with {TURNS} select session_id, turn_id, {' or '.join(f"contains(lower(question), '{w}')" for w in sessions.FOLLOW_UP)} as follow_up, {' or '.join(f"contains(lower(question), '{w}')" for w in sessions.COMPARISON)} as comparison from turns""")
def ses_04_markers(spark: SparkSession, root: str) -> DataFrame:
    q = F.col("question")
    return eval_turns(spark, root).select("session_id", "turn_id", sessions.follow_up(q).alias("follow_up"), sessions.comparison(q).alias("comparison"))


@query(f"""with {SIGNALS} select session_id, turn_id, case when rn = 1 then 'independent' when marked and similarity >= 0.08 then 'strong' when marked or similarity >= 0.18 then 'mixed' else 'weak' end as carryover, round(similarity, 6) as similarity, len(anchors) as anchors, switch2 as switch from s""")
def ses_05_06_topic_switch(spark: SparkSession, root: str) -> DataFrame:
    return sessions.topic_switch(eval_turns(spark, root)).select("session_id", "turn_id", "carryover", F.round("similarity", 6).alias("similarity"), F.size("anchors").alias("anchors"), "switch")


@query(SEGMENT_FOLD + " select session_id, turn_id, segment, carryover from fold")
def ses_10_segments(spark: SparkSession, root: str) -> DataFrame:
    """Topic segments, a fold over each session."""
    return sessions.segments(eval_turns(spark, root))


@query()
def ses_10_segments_streamed(spark: SparkSession, root: str) -> DataFrame:
    """The same segments from a stream of the turns, with state per session."""
    path = f"{shared_folder(spark)}/{uuid4()}"
    eval_turns(spark, root).write.parquet(f"{path}/turns")
    stream = spark.readStream.schema("session_id string, turn_id int, question string, answer string").parquet(f"{path}/turns")
    running = streamed_segments(stream).writeStream.outputMode("append").format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(sessions.SEGMENTS).parquet(f"{path}/out")


@query(f"""with {VECTORS}, l as (select *, lag(vector) over (partition by session_id order by turn_id) as last from v)
select session_id, turn_id, round(case when last is null then 0 else 1 - list_cosine_similarity(vector, last) end, 6) as drift from l""")
def ses_13_drift(spark: SparkSession, root: str) -> DataFrame:
    return sessions.drift(vector_turns(spark, root)).select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), F.round("drift", 6).alias("drift"))


@query(f"""with {VECTORS}, p as (select a.session_id, a.turn_id, pow(0.7, a.turn_id - b.turn_id) as w, b.vector from v a join v b on a.session_id = b.session_id and b.turn_id between a.turn_id - 7 and a.turn_id),
e as (select session_id, turn_id, w, unnest(vector) as x, generate_subscripts(vector, 1) as i from p), s as (select session_id, turn_id, i, sum(w * x) / sum(w) as x from e group by all)
select session_id, turn_id, round(sqrt(sum(x * x)), 5) as norm from s group by all""")
def ses_16_coarse_state(spark: SparkSession, root: str) -> DataFrame:
    from tesserae.functions.vectors import norm

    return sessions.coarse_state(vector_turns(spark, root)).select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), F.round(norm(F.col("state")), 5).alias("norm"))


@query(f"""with {VECTORS}, p as (select a.session_id, a.turn_id, exp(list_cosine_similarity(a.vector, b.vector)) as w, b.vector from v a join v b on a.session_id = b.session_id and b.turn_id between a.turn_id - 8 and a.turn_id - 1 union all select session_id, turn_id, 1, vector from v where turn_id = 0),
e as (select session_id, turn_id, w, unnest(vector) as x, generate_subscripts(vector, 1) as i from p), s as (select session_id, turn_id, i, sum(w * x) / sum(w) as x from e group by all)
select session_id, turn_id, round(sqrt(sum(x * x)), 5) as norm from s group by all""")
def ses_17_attention_state(spark: SparkSession, root: str) -> DataFrame:
    from tesserae.functions.vectors import norm

    return sessions.attention_state(vector_turns(spark, root)).select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), F.round(norm(F.col("state")), 5).alias("norm"))


@query(f"""with {VECTORS}, p as (select a.session_id, a.turn_id, b.turn_id as past_turn, round(list_cosine_similarity(a.vector, b.vector), 9) as similarity from v a join v b on a.session_id = b.session_id and b.turn_id between a.turn_id - 8 and a.turn_id - 1),
r as (select *, row_number() over (partition by session_id, turn_id order by similarity desc, past_turn desc) as k from p)
select session_id, turn_id, past_turn, round(similarity, 6) as similarity from r where k = 1 and similarity >= 0.2""")
def ses_19_relevant_past(spark: SparkSession, root: str) -> DataFrame:
    found = sessions.relevant_past(vector_turns(spark, root), least=0.2)
    return found.select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), F.col("past_turn").cast("bigint").alias("past_turn"), F.round("similarity", 6).alias("similarity"))


@query(r"""select result_id, md5(regexp_replace(answer, '[\[【［]\s*C\s*[:：]\s*0*([0-9]+)\s*[\]】］]', '[C:\1]', 'g')) as digest, len(list_distinct(regexp_extract_all(answer, '[\[【［]\s*C\s*[:：]\s*0*([0-9]+)\s*[\]】］]', 1))) as indices from query_results where answer is not null""")
def cit_01_markers(spark: SparkSession, root: str) -> DataFrame:
    a = F.col("answer")
    return table(spark, root, "query_results").where("answer is not null").select("result_id", F.md5(citations.normalised_markers(a)).alias("digest"), F.size(citations.cited_indices(a)).cast("bigint").alias("indices"))


@query(r"""with m as (select distinct result_id, i::int as citation_index from (select result_id, unnest(regexp_extract_all(answer, '[\[【［]\s*C\s*[:：]\s*0*([0-9]+)\s*[\]】］]', 1)) as i from query_results)),
p as (select result_id, unnest(cited_chunk_ids) as chunk, generate_subscripts(cited_chunk_ids, 1) as citation_index from query_results)
select r.result_id, array_to_string(list(p.chunk order by m.citation_index) filter (p.chunk is not null), ',') as cited, array_to_string(list(m.citation_index order by m.citation_index) filter (p.chunk is null and m.citation_index is not null), ',') as wrong, count(m.citation_index) = 0 as no_citation
from query_results r left join m on m.result_id = r.result_id left join p on p.result_id = m.result_id and p.citation_index = m.citation_index group by r.result_id""")
def cit_02_resolved(spark: SparkSession, root: str) -> DataFrame:
    """Markers of the answers resolved against the chunks each result gave, in order."""
    r = table(spark, root, "query_results")
    packs = r.select(F.col("result_id").alias("answer_id"), F.posexplode("cited_chunk_ids").alias("at", "chunk")).select("answer_id", (F.col("at") + 1).alias("citation_index"), "chunk")
    found = citations.resolve(r.select(F.col("result_id").alias("answer_id"), "answer"), packs)
    return found.select(F.col("answer_id").alias("result_id"), F.nullif(F.array_join("cited", ","), F.lit("")).alias("cited"), F.nullif(F.array_join(F.transform("wrong", lambda i: i.cast("string")), ","), F.lit("")).alias("wrong"), "no_citation")


@query("select result_id, case when " + " or ".join(f"contains(coalesce(answer, ''), '{r}')" for r in REFUSALS) + " then 1 else 0 end as refusal_score from query_results")
def cit_03_refusals(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "query_results").select("result_id", citations.refusal_score(F.col("answer")).cast("int").alias("refusal_score"))


@query()
def cit_05_contexts(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "query_results").select("result_id", F.explode(citations.contexts(F.col("answer"))).alias("c"))
    return c.select("result_id", "c.citation_index", F.md5("c.context").alias("digest"))


@query()
def cit_07_budgeted(spark: SparkSession, root: str) -> DataFrame:
    """Answers rewritten to at most two chunks cited, the most frequent ones; a fold over markers, tested against a plain version."""
    r = table(spark, root, "query_results").where("answer is not null")
    return r.select("result_id", citations.budgeted(F.col("answer"), F.slice(citations.by_frequency(F.col("answer")), 1, 2)).alias("answer"))


@query("""select session_id, c as chunk_id, count(*) as turns from (select session_id, unnest(turn.reference_chunk_ids) as c from (select session_id, unnest(turns) as turn from (select distinct session_id, turns from eval_sessions))) group by all having count(*) > 1""")
def cit_10_repeated_references(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that a session's turns refer to more than once."""
    once = table(spark, root, "eval_sessions").select("session_id", "turns").distinct()
    ids = once.select("session_id", F.explode("turns").alias("t")).select("session_id", F.explode("t.reference_chunk_ids").alias("chunk_id"))
    return ids.groupBy("session_id", "chunk_id").agg(F.count("*").alias("turns")).where("turns > 1")


@query("""select language, expected, count(*) as files, sum(lines) as lines from (select language, case lower(regexp_extract(rel_path, '(\\.[^./]+)$', 1)) when '.py' then 'python' when '.ts' then 'typescript' when '.tsx' then 'typescript' when '.js' then 'javascript' when '.jsx' then 'javascript'
when '.go' then 'go' when '.rs' then 'rust' when '.java' then 'java' when '.kt' then 'kotlin' when '.md' then 'markdown' when '.yaml' then 'yaml' when '.yml' then 'yaml' when '.json' then 'json' when '.toml' then 'toml' when '.sh' then 'shell' else 'text' end as expected,
length(content) - length(replace(content, chr(10), '')) + 1 as lines from source_files) group by all""")
def src_03_04_languages(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "source_files")
    return f.groupBy("language", src.language_of(F.col("rel_path")).alias("expected")).agg(F.count("*").alias("files"), F.sum(src.line_count(F.col("content"))).alias("lines"))


@query("""select repo_id, count(*) as files from source_files where regexp_matches(rel_path, '^(.*/.*\\.py|.*/.*\\.md)$') and not regexp_matches(rel_path, '^(.*/vendor/.*|.*/node_modules/.*)$') group by repo_id""")
def src_02_path_patterns(spark: SparkSession, root: str) -> DataFrame:
    path = F.col("rel_path")
    kept = src.matches_any(path, ["**/*.py", "**/*.md"]) & ~src.matches_any(path, ["*/vendor/*", "*/node_modules/*"])
    return table(spark, root, "source_files").where(kept).groupBy("repo_id").agg(F.count("*").alias("files"))


@query("""with r as (select *, row_number() over (partition by chunk_id order by ingested_at desc, chunk_no desc) as k from chunks) select repo_id, repo_commit, count(*) as chunks, sum(chunk_no) as checksum from r where k = 1 group by all""")
def src_12_15_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The chunk table after upserts, counted per repository and commit."""
    last = src.upserted(table(spark, root, "chunks"), ["chunk_id"], [F.desc("ingested_at"), F.desc("chunk_no")])
    return last.groupBy("repo_id", "repo_commit").agg(F.count("*").alias("chunks"), F.sum("chunk_no").alias("checksum"))


@query("""select r.result_id, generate_subscripts(cited_chunk_ids, 1) - 1 as position, unnest(cited_chunk_ids) as chunk_id from query_results r""".replace("select r.result_id", "select * from (select r.result_id") + """) c where exists (select 1 from chunks k where k.chunk_id = c.chunk_id)""")
def src_14_multi_get(spark: SparkSession, root: str) -> DataFrame:
    """Chunks cited by results, in the order cited; missing ones are left out."""
    wanted = table(spark, root, "query_results").select("result_id", F.posexplode("cited_chunk_ids").alias("position", "chunk_id"))
    return wanted.join(table(spark, root, "chunks").select("chunk_id").distinct(), "chunk_id").select("result_id", F.col("position").cast("bigint").alias("position"), "chunk_id")


@query("""select f.repo_id, arg_max(f.repo_commit, r.commit_rank) as newest from source_files f join repos r on r.repo_id = f.repo_id and r.repo_commit = f.repo_commit group by f.repo_id""")
def src_16_newest_commit(spark: SparkSession, root: str) -> DataFrame:
    f, r = table(spark, root, "source_files").select("repo_id", "repo_commit").distinct(), table(spark, root, "repos")
    return f.join(r, ["repo_id", "repo_commit"]).groupBy("repo_id").agg(F.max_by("repo_commit", "commit_rank").alias("newest"))


@query("""select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint) as k from events group by event_type""")
def src_17_json_fields(spark: SparkSession, root: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, root, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("""select file_id, sha256(content) as digest from source_files where content is not null""")
def src_28_checksums(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "source_files").where("content is not null").select("file_id", F.sha2("content", 256).alias("digest"))


@query("""select epoch(time_bucket(interval 1 hour, ts))::bigint as window_start, count(*) as events, count(*) filter (event_type = 'error') as errors, round(sum(value), 4) as value from events group by 1""")
def stream_windowed_rates(spark: SparkSession, root: str) -> DataFrame:
    """The streaming aggregate run over the table as a batch."""
    return windowed_rates(table(spark, root, "events"))


@query()
def chk_07_chunks(spark: SparkSession, root: str) -> DataFrame:
    """All files chunked by language."""
    return chunk_files(table(spark, root, "source_files")).select("file_id", "chunk_id", "start_line", "end_line", F.md5("content").alias("digest"), F.size("symbols").alias("symbols"), "section_header")


@query(f"""with {TURNS}, e as (select count(*) as expected from turns), f as (select run_label, count(t.turn_id) as found from (select distinct run_label, session_id, turn_id from query_results) r left join turns t on t.session_id = r.session_id and t.turn_id = r.turn_id group by run_label)
select run_label, expected, found, expected - found as missing from f, e""")
def orc_01_runs(spark: SparkSession, root: str) -> DataFrame:
    """Turns expected of each run, found in it and missing from it, to resume by."""
    turns = eval_turns(spark, root).select("session_id", "turn_id")
    results = table(spark, root, "query_results")
    asked = turns.withColumn("asked", F.lit(True))
    found = results.select("run_label", "session_id", "turn_id").distinct().join(asked, ["session_id", "turn_id"], "left").groupBy("run_label").agg(F.count("asked").alias("found"))
    expected = F.broadcast(turns.agg(F.count("*").alias("expected")))  # one row
    return found.crossJoin(expected).select("run_label", "expected", "found", (F.col("expected") - F.col("found")).alias("missing"))


@query("""with r as (select run_label, session_id, turn_id, unnest(cited_chunk_ids) as chunk from query_results where session_id is not null and turn_id is not null),
t as (select distinct run_label, session_id, turn_id from query_results where session_id is not null and turn_id is not null)
select t.run_label, t.session_id, t.turn_id, count(distinct r.chunk) as distinct_citations from t left join r on r.run_label = t.run_label and r.session_id = t.session_id and r.turn_id <= t.turn_id group by all""")
def ses_01_cumulative_citations(spark: SparkSession, root: str) -> DataFrame:
    """Distinct chunks cited so far in each session of each run, over all results."""
    r = table(spark, root, "query_results").where("session_id is not null and turn_id is not null")
    return sessions.cumulative_citations(r.select("run_label", "session_id", "turn_id", F.col("cited_chunk_ids").alias("cited")))


SQL["ses_10_segments_streamed"] = SQL["ses_10_segments"]
