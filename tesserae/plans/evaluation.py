"""Queries on run logs: rates, percentiles, comparisons, sampling and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import REFUSALS, any_of
from tesserae.operators import evalstats as S
from tesserae.operators import sampling
from tesserae.operators.citations import jaccard
from tesserae.operators.selection import percentiles
from tesserae.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


ONCE = """with p as (select run_id, variant_name, repo_id, session_id, turn_id, question, answer, cited_chunk_ids, no_citation, is_refusal, true_failure, generator_used, latency_ms, retrieval_ms, generation_ms, memory_peak_mb, logged_at from predictions group by all)"""
REFUSED = " or ".join(f"contains(coalesce(answer, ''), '{r}')" for r in REFUSALS)
OK = "{0} is not null and not isnan({0}) and {0} >= 0"


def rows(spark: SparkSession, root: str, *keep: str) -> DataFrame:
    return S.delivered_once(table(spark, root, "predictions"), list(keep))


def refused():
    return any_of(F.coalesce("answer", F.lit("")), REFUSALS)


@query(ONCE + f""" select variant_name, count(*) as n, round(avg(case when {OK.format('latency_ms')} then latency_ms end), 3) as mean_ms, round(quantile_cont(case when {OK.format('latency_ms')} then latency_ms end, 0.5), 3) as p50,
round(quantile_cont(case when {OK.format('latency_ms')} then latency_ms end, 0.9), 3) as p90, min(case when {OK.format('latency_ms')} then latency_ms end) as min_ms, max(case when {OK.format('latency_ms')} then latency_ms end) as max_ms,
round(count(*) filter (no_citation) / count(*), 6) as no_citation_rate from p group by variant_name""")
def agg_01_run_report(spark: SparkSession, root: str) -> DataFrame:
    p = rows(spark, root, "variant_name", "latency_ms", "no_citation").withColumn("ms", S.measured("latency_ms"))
    basic = p.groupBy("variant_name").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.round(S.rate(F.col("no_citation")), 6).alias("no_citation_rate"))
    found = percentiles(p, ["variant_name"], "ms", {"p50": (0.5, "linear"), "p90": (0.9, "linear")})
    return basic.join(found, "variant_name").withColumn("p50", F.round("p50", 3)).withColumn("p90", F.round("p90", 3))


@query(ONCE + f""" select coalesce(repo_id, 'all') as repo_id, grouping(repo_id) as is_total, count(*) as n, count(*) filter (coalesce(no_citation, false) and not ({REFUSED})) as true_no_citation,
round(100.0 * count(*) filter (coalesce(no_citation, false) and not ({REFUSED})) / count(*), 4) as percent from p where repo_id is not null group by rollup (repo_id)""")
def agg_03_no_citation_by_repo(spark: SparkSession, root: str) -> DataFrame:
    """Refusal-aware rates per repository with a total row."""
    p = rows(spark, root, "repo_id", "no_citation", "answer").where("repo_id is not null").withColumn("bad", S.true_no_citation(F.col("no_citation"), refused()))
    per = p.rollup("repo_id").agg(F.grouping("repo_id").cast("bigint").alias("is_total"), F.count("*").alias("n"), F.count_if("bad").alias("true_no_citation"))
    return per.select(F.coalesce("repo_id", F.lit("all")).alias("repo_id"), "is_total", "n", "true_no_citation", F.round(100 * F.col("true_no_citation") / F.col("n"), 4).alias("percent"))


def indexed(position: str, q: str) -> str:
    return ONCE + f""", v as (select variant_name, {q} as x from p where {OK.format(q)}), r as (select variant_name, x, row_number() over (partition by variant_name order by x) - 1 as i, count(*) over (partition by variant_name) as n from v)
select variant_name, {position} from r group by variant_name"""


@query(indexed("""max(x) filter (i = round_even(0.5 * (n - 1), 0)) as even_p50, max(x) filter (i = round_even(0.95 * (n - 1), 0)) as even_p95, max(x) filter (i = greatest(ceil(0.95 * n) - 1, 0)) as nearest_p95,
max(x) filter (i = n // 2) as upper_median, max(x) filter (i = greatest(round_even(0.95 * n, 0) - 1, 0)) as round_p95, max(x) filter (i = floor(0.95 * (n - 1))) as floor_p95""", "generation_ms"))
def agg_04_08_10_24_25_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """The index-based percentile definitions, exact and without gathering a group."""
    p = rows(spark, root, "variant_name", "generation_ms").withColumn("ms", S.measured("generation_ms"))
    asked = {"even_p50": (0.5, "even_index"), "even_p95": (0.95, "even_index"), "nearest_p95": (0.95, "nearest_rank"), "upper_median": (0.5, "upper_median"), "round_p95": (0.95, "round_rank"), "floor_p95": (0.95, "floor_index")}
    return percentiles(p, ["variant_name"], "ms", asked)


@query(ONCE + f""", f as (select *, coalesce(no_citation, false) and not ({REFUSED}) as bad from p where repo_id is not null), r as (select *, row_number() over (partition by repo_id order by not bad, logged_at, session_id, turn_id, run_id, coalesce(question, ''), coalesce(answer, '')) as k from f)
select repo_id, session_id, turn_id, run_id, bad from r where k = 1""")
def agg_05_failure_examples(spark: SparkSession, root: str) -> DataFrame:
    """Per repository the first failing row, else the first row."""
    p = rows(spark, root, "repo_id", "session_id", "turn_id", "run_id", "logged_at", "question", "answer", "no_citation").where("repo_id is not null").withColumn("bad", S.true_no_citation(F.col("no_citation"), refused()))
    nulls = [F.asc_nulls_last("logged_at"), F.asc_nulls_last("session_id"), F.asc_nulls_last("turn_id"), F.asc_nulls_last("run_id")]
    picked = S.first_per_group(p, ["repo_id"], [F.asc(~F.col("bad")), *nulls, F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))])
    return picked.select("repo_id", "session_id", "turn_id", "run_id", "bad")


@query(ONCE + """, s as (select session_id, turn_id, max(case when latency_ms is not null and not isnan(latency_ms) and latency_ms >= 0 then latency_ms end) as ms from p where session_id is not null and turn_id is not null group by all),
o as (select *, row_number() over (partition by session_id order by turn_id) as k, count(*) over (partition by session_id) as n from s)
select session_id, max(n) as turns, round(avg(ms), 3) as mean_ms, round(max(ms) filter (k = 1), 3) as first_ms, round(coalesce(sum(ms) filter (k > 1), 0) / greatest(max(n) - 1, 1), 3) as follow_up_ms from o group by session_id""")
def agg_11_session_latency(spark: SparkSession, root: str) -> DataFrame:
    from pyspark.sql import Window

    p = rows(spark, root, "session_id", "turn_id", "latency_ms").where("session_id is not null and turn_id is not null").withColumn("ms", S.measured("latency_ms"))
    turns = p.groupBy("session_id", "turn_id").agg(F.max("ms").alias("ms")).withColumn("k", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id")))
    return turns.groupBy("session_id").agg(
        F.count("*").alias("turns"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.max(F.when(F.col("k") == 1, F.col("ms"))), 3).alias("first_ms"),
        F.round(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("ms"))), F.lit(0.0)) / F.greatest(F.count("*") - 1, F.lit(1)), 3).alias("follow_up_ms"),
    )


@query("""select run_label, count(*) as n, round(count(*) filter (generator_fallback_reason is not null) / count(*), 6) as fallback_rate,
round(count(*) filter (generator_fallback_reason is not null and no_citation) / nullif(count(*) filter (no_citation), 0), 6) as recall, round(count(*) filter (generator_fallback_reason is not null and no_citation) / nullif(count(*) filter (generator_fallback_reason is not null), 0), 6) as precision
from query_results group by run_label""")
def agg_13_fallback_recall(spark: SparkSession, root: str) -> DataFrame:
    fell, bad = F.col("generator_fallback_reason").isNotNull(), F.coalesce("no_citation", F.lit(False))
    per = table(spark, root, "query_results").groupBy("run_label").agg(F.count("*").alias("n"), F.count_if(fell).alias("f"), F.count_if(bad).alias("b"), F.count_if(fell & bad).alias("fb"))
    zero = F.lit(0)
    return per.select("run_label", "n", F.round(F.col("f") / F.col("n"), 6).alias("fallback_rate"), F.round(F.col("fb") / F.nullif("b", zero), 6).alias("recall"), F.round(F.col("fb") / F.nullif("f", zero), 6).alias("precision"))


@query(ONCE + """ select variant_name, generator_used, count(*) as n, round(avg(case when latency_ms >= 0 and not isnan(latency_ms) then latency_ms end), 3) as mean_ms, count(*) filter (turn_id >= 5 and no_citation) as late_no_citation from p where generator_used is not null group by all""")
def agg_14_matrix(spark: SparkSession, root: str) -> DataFrame:
    p = rows(spark, root, "variant_name", "generator_used", "latency_ms", "turn_id", "no_citation").where("generator_used is not null").withColumn("ms", S.measured("latency_ms"))
    return p.groupBy("variant_name", "generator_used").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 3).alias("mean_ms"), F.count_if((F.col("turn_id") >= 5) & F.col("no_citation")).alias("late_no_citation"))


@query("select run_label, generator_used, count(*) as n from query_results where generator_used is not null group by all")
def agg_14_value_counts(spark: SparkSession, root: str) -> DataFrame:
    counts = S.value_counts(table(spark, root, "query_results"), ["run_label"], "generator_used")
    return counts.select("run_label", F.explode("generator_used_counts").alias("generator_used", "n"))


AB = """with r as (select session_id, turn_id, run_label, latency.total_ms as ms, no_citation, cited_chunk_ids, row_number() over (partition by session_id, turn_id, run_label order by result_id) as k from query_results where session_id is not null and turn_id is not null),
labels as (select min(run_label) as a, max(run_label) as b from query_results),
a as (select r.* from r, labels where run_label = a and k = 1), b as (select r.* from r, labels where run_label = b and k = 1),
j as (select a.session_id, a.turn_id, case when a.no_citation then 0 else 1 end as score_a, case when b.no_citation then 0 else 1 end as score_b, a.ms as latency_a, b.ms as latency_b, coalesce(a.cited_chunk_ids, []) as ca, coalesce(b.cited_chunk_ids, []) as cb from a join b on a.session_id = b.session_id and a.turn_id = b.turn_id)"""


def _first_answers(results: DataFrame) -> DataFrame:
    """Each run's first result of a turn, with what runs are compared by."""
    first = S.first_per_group(results, ["session_id", "turn_id", "run_label"], [F.asc("result_id")])
    return first.select("session_id", "turn_id", "run_label", F.when(F.coalesce("no_citation", F.lit(False)), 0).otherwise(1).alias("score"), F.col("latency.total_ms").alias("latency"), F.coalesce("cited_chunk_ids", F.array()).alias("cited"))


def _ab(spark: SparkSession, root: str) -> DataFrame:
    """The first run of the alphabet against the last one, as the SQL has it; ``_all_runs`` compares every pair."""
    r = table(spark, root, "query_results").where("session_id is not null and turn_id is not null")
    ends = r.agg(F.min("run_label").alias("a"), F.max("run_label").alias("b")).first()
    first = _first_answers(r)
    a, b = first.where(F.col("run_label") == ends.a), first.where(F.col("run_label") == ends.b)
    both = S.compare(a, b, ["session_id", "turn_id"])
    cited = a.select("session_id", "turn_id", F.col("cited").alias("ca")).join(b.select("session_id", "turn_id", F.col("cited").alias("cb")), ["session_id", "turn_id"])
    return both.join(cited, ["session_id", "turn_id"])


def _deltas(both: DataFrame, *keys: str) -> DataFrame:
    return both.select(*keys, "session_id", "turn_id", F.round(F.col("latency_b") - F.col("latency_a"), 4).alias("delta_ms"), F.round(jaccard(F.col("ca"), F.col("cb")), 6).alias("jaccard"), F.size(F.array_except("ca", "cb")).cast("bigint").alias("only_a"), F.size(F.array_except("cb", "ca")).cast("bigint").alias("only_b"))


@query(AB + """ select winner, count(*) as turns from (select case when score_a > score_b then 'a' when score_b > score_a then 'b' when latency_a < latency_b * 0.85 then 'a' when latency_b < latency_a * 0.85 then 'b' else 'tie' end as winner from j) group by winner""")
def agg_19_winners(spark: SparkSession, root: str) -> DataFrame:
    return _ab(spark, root).groupBy("winner").agg(F.count("*").alias("turns"))


@query(AB + """ select session_id, turn_id, round(latency_b - latency_a, 4) as delta_ms, case when len(list_distinct(list_concat(ca, cb))) > 0 then round(len(list_intersect(list_distinct(ca), list_distinct(cb))) / len(list_distinct(list_concat(ca, cb))), 6) else 0 end as jaccard,
len(list_distinct(ca)) - len(list_intersect(list_distinct(ca), list_distinct(cb))) as only_a, len(list_distinct(cb)) - len(list_intersect(list_distinct(ca), list_distinct(cb))) as only_b from j""")
def agg_20_21_deltas(spark: SparkSession, root: str) -> DataFrame:
    return _deltas(_ab(spark, root))


ALL_RUNS = """with r as (select session_id, turn_id, run_label, latency.total_ms as ms, no_citation, cited_chunk_ids, row_number() over (partition by session_id, turn_id, run_label order by result_id) as k from query_results where session_id is not null and turn_id is not null),
f as (select session_id, turn_id, run_label, case when no_citation then 0 else 1 end as score, ms as latency, coalesce(cited_chunk_ids, []) as cited from r where k = 1),
j as (select a.session_id, a.turn_id, a.run_label as run_a, b.run_label as run_b, a.score as score_a, b.score as score_b, a.latency as latency_a, b.latency as latency_b, a.cited as ca, b.cited as cb from f a join f b on a.session_id = b.session_id and a.turn_id = b.turn_id and a.run_label < b.run_label)"""


def _all_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every two runs that share a turn, ``run_a`` before ``run_b``, with their citations ``ca`` and ``cb``."""
    first = _first_answers(table(spark, root, "query_results").where("session_id is not null and turn_id is not null"))
    a = first.select("session_id", "turn_id", F.col("run_label").alias("run_a"), "score", "latency", F.col("cited").alias("ca"))
    b = first.select("session_id", "turn_id", F.col("run_label").alias("run_b"), "score", "latency", F.col("cited").alias("cb"))
    return S.compare(a, b, ["session_id", "turn_id"], carry_left=["run_a", "ca"], carry_right=["run_b", "cb"]).where("run_a < run_b")


@query(ALL_RUNS + """ select run_a, run_b, winner, count(*) as turns from (select run_a, run_b, case when score_a > score_b then 'a' when score_b > score_a then 'b' when latency_a < latency_b * 0.85 then 'a' when latency_b < latency_a * 0.85 then 'b' else 'tie' end as winner from j) group by all""")
def agg_19_winners_all_runs(spark: SparkSession, root: str) -> DataFrame:
    """Wins and ties of every pair of runs over the turns that both answered."""
    return _all_runs(spark, root).groupBy("run_a", "run_b", "winner").agg(F.count("*").alias("turns"))


@query(ALL_RUNS + """ select run_a, run_b, session_id, turn_id, round(latency_b - latency_a, 4) as delta_ms, case when len(list_distinct(list_concat(ca, cb))) > 0 then round(len(list_intersect(list_distinct(ca), list_distinct(cb))) / len(list_distinct(list_concat(ca, cb))), 6) else 0 end as jaccard,
len(list_distinct(ca)) - len(list_intersect(list_distinct(ca), list_distinct(cb))) as only_a, len(list_distinct(cb)) - len(list_intersect(list_distinct(ca), list_distinct(cb))) as only_b from j""")
def agg_20_21_deltas_all_runs(spark: SparkSession, root: str) -> DataFrame:
    """Latency and citation differences of every pair of runs, turn by turn."""
    return _deltas(_all_runs(spark, root), "run_a", "run_b")


@query("""with d as (select distinct text from documents where text <> ''), e as (select distinct t.question as text from (select unnest(turns) as t from eval_sessions))
select (select count(*) from d) as corpus_texts, (select count(*) from e) as eval_texts, (select count(*) from (select text from d intersect select text from e)) as shared""")
def agg_23_corpus_overlap(spark: SparkSession, root: str) -> DataFrame:
    """Texts of the corpus, of the eval questions, and of both."""
    d = table(spark, root, "documents").where("text <> ''").select("text").distinct()
    e = table(spark, root, "eval_sessions").select(F.explode("turns.question").alias("text")).distinct()
    counts = [t.agg(F.count("*").alias(n)) for t, n in ((d, "corpus_texts"), (e, "eval_texts"), (d.where("text is not null").intersect(e), "shared"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each


@query("""with r as (select doc_id, source, row_number() over (partition by source order by md5('7:' || doc_id::varchar), doc_id) as pick from documents) select doc_id, source, pick from r where pick <= 20""")
def smp_02_stratified(spark: SparkSession, root: str) -> DataFrame:
    return sampling.stratified(table(spark, root, "documents").select("doc_id", "source"), "source", "doc_id", 20, seed=7)


@query("""with r as (select doc_id, row_number() over (order by md5('3:' || doc_id::varchar), doc_id) as k, count(*) over () as n from documents) select doc_id, case when k <= greatest(1, floor(n * 0.05)) then 'val' else 'train' end as part from r""")
def smp_03_split(spark: SparkSession, root: str) -> DataFrame:
    return sampling.split(table(spark, root, "documents").select("doc_id"), "doc_id", 0.05, seed=3)


@query("""with cited as (select distinct split_part(c, '::', 1) as repo_id, split_part(c, '::', 2) as rel_path from (select unnest(t.reference_chunk_ids) as c from (select unnest(turns) as t from eval_sessions)))
select language, count(*) as files from source_files f where not exists (select 1 from cited c where c.repo_id = f.repo_id and c.rel_path = f.rel_path) group by language""")
def smp_04_leak_exclusion(spark: SparkSession, root: str) -> DataFrame:
    """Files left for training when those that eval questions refer to are out."""
    ids = table(spark, root, "eval_sessions").select(F.explode("turns").alias("t")).select(F.explode("t.reference_chunk_ids").alias("c"))
    cited = ids.select(F.split_part("c", F.lit("::"), F.lit(1)).alias("repo_id"), F.split_part("c", F.lit("::"), F.lit(2)).alias("rel_path")).distinct()
    return table(spark, root, "source_files").join(cited, ["repo_id", "rel_path"], "left_anti").groupBy("language").agg(F.count("*").alias("files"))


@query("""with r as (select doc_id, source, row_number() over (partition by source order by md5('0:' || doc_id::varchar), doc_id) - 1 as r, count(*) over (partition by source) as n from documents) select doc_id, source, r // 16 as batch from r where r < (n // 16) * 16""")
def smp_07_full_batches(spark: SparkSession, root: str) -> DataFrame:
    return sampling.full_batches(table(spark, root, "documents").select("doc_id", "source"), "source", "doc_id", 16)


@query("""with w as (select source, count(*) as n from documents group by source), s as (select source, round_even(1000.0 * n / sum(n) over (), 0)::bigint as want from w),
u as (select *, sum(want) over (order by source) as upto, sum(want) over () as total, row_number() over (order by source) as k from s)
select source, greatest(0, least(want, 1000 - (upto - want)))::bigint + case when k = 1 then greatest(0, 1000 - total)::bigint else 0 end as scenarios from u""")
def smp_09_allocation(spark: SparkSession, root: str) -> DataFrame:
    weights = table(spark, root, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sampling.allocation(weights, 1000, "source", "n")


@query("""with d as (select doc_id, n_chars::bigint as n, sum(n_chars) over (order by doc_id) - n_chars as start, sum(n_chars) over () as total from documents where n_chars > 0),
c as (select doc_id, start, n, total, unnest(range((start // 4096)::bigint, ((start + n - 1) // 4096)::bigint + 1)) as context_no from d)
select doc_id, context_no, greatest(context_no * 4096 - start, 0)::bigint as from_token, least((context_no + 1) * 4096 - start, n)::bigint as to_token from c where (context_no + 1) * 4096 <= total""")
def chk_09_sequence_packing(spark: SparkSession, root: str) -> DataFrame:
    """Documents in a row cut into full contexts, with characters for tokens; the rest at the end is dropped."""
    from tesserae.operators.chunking import packed_lengths

    return packed_lengths(table(spark, root, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 4096)


@query("""select event_type, count(*) as n, round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.95), 4) as p95, count(distinct user_id) as users from events group by event_type""")
def agg_12_event_latency(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events")
    basic = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.countDistinct("user_id").alias("users"))
    found = percentiles(events, ["event_type"], "value", {"p50": (0.5, "linear"), "p95": (0.95, "linear")})
    return basic.join(found, "event_type").withColumn("p50", F.round("p50", 4)).withColumn("p95", F.round("p95", 4))
