"""Queries on checks of results, corpora and samples: static checks, rubrics, recall, corpus reports, picks, mixes and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import evalstats, sampling
from tesserae.operators.chunking import token_windows
from tesserae.operators.selection import percentiles
from tesserae.plans.conversation import eval_turns
from tesserae.plans.evidence import STEPS, Steps
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


CHECK = """u as (select distinct session_id, t.turn_id as turn_id from (select session_id, unnest(turns) as t from eval_sessions) where t.reference_answer is null),
r as (select q.*, coalesce(no_citation, false) as missing, u.session_id is not null as unanswerable from query_results q left join u on u.session_id = q.session_id and u.turn_id = q.turn_id)"""


def checked_results(spark: SparkSession, root: str) -> DataFrame:
    """Results with ``unanswerable``: the turn has no reference answer in one of its copies."""
    turns = table(spark, root, "eval_sessions").select("session_id", F.explode("turns").alias("t")).where("t.reference_answer is null")
    none = turns.select("session_id", F.col("t.turn_id").alias("turn_id")).distinct().withColumn("unanswerable", F.lit(True))
    return table(spark, root, "query_results").join(none, ["session_id", "turn_id"], "left").withColumn("unanswerable", F.coalesce("unanswerable", F.lit(False)))


@query(f"""with {CHECK} select run_label, count(*) as total, round(count(*) filter (missing) / count(*), 6) as no_citation_rate, count(*) filter (len(wrong_citation_indices) > 0) as wrong_citation_count, round(coalesce(median(latency.total_ms), 0), 3) as latency_p50,
count(*) filter (unanswerable and missing) as correct_abstains, count(*) filter (not unanswerable) as answerable_total, count(*) filter (not unanswerable and missing) as answerable_no_cite,
round(coalesce(count(*) filter (not unanswerable and missing) / nullif(count(*) filter (not unanswerable), 0), 0), 6) as true_nc_rate from r group by run_label""")
def agg_06_static_check(spark: SparkSession, root: str) -> DataFrame:
    """Each run checked, with and without the turns that have no answer."""
    results = checked_results(spark, root).withColumn("ms", F.col("latency.total_ms"))
    per = evalstats.static_check(results, "run_label", F.col("unanswerable"))
    medians = percentiles(results, ["run_label"], "ms", {"latency_p50": (0.5, "linear")})
    out = per.join(medians, "run_label", "left").withColumn("latency_p50", F.round(F.coalesce("latency_p50", F.lit(0.0)), 3))
    return out.withColumns({c: F.round(c, 6) for c in ("no_citation_rate", "true_nc_rate")})


@query("""with s as (select run_label, count(*) filter (coalesce(no_citation, false)) / count(*) as nc, median(latency.total_ms) as p50 from query_results group by run_label), r as (select *, row_number() over (order by nc, p50, run_label) as place from s)
select place, run_label, round(nc, 6) as no_citation_rate, round(p50, 3) as p50_ms from r where place <= 3""")
def agg_09_best_runs(spark: SparkSession, root: str) -> DataFrame:
    """The three runs of the fewest missing citations, then the lowest median latency: a top-k report."""
    from pyspark.sql import Window

    results = table(spark, root, "query_results").withColumn("ms", F.col("latency.total_ms"))
    stats = results.groupBy("run_label").agg(evalstats.rate(F.coalesce("no_citation", F.lit(False))).alias("nc")).join(percentiles(results, ["run_label"], "ms", {"p50": (0.5, "linear")}), "run_label", "left")
    best = stats.orderBy("nc", F.asc_nulls_last("p50"), "run_label").limit(3)
    return best.select(F.row_number().over(Window.orderBy("nc", F.asc_nulls_last("p50"), "run_label")).alias("place"), "run_label", F.round("nc", 6).alias("no_citation_rate"), F.round("p50", 3).alias("p50_ms"))


@query("""with s as (select run_label, case when coalesce(no_citation, false) then 0 else 2 end as grounding, case when len(wrong_citation_indices) > 0 then 0 else 1 end as correctness, coalesce(confidence, 0) as confidence from query_results),
m as (select run_label, count(*) as n, sum(grounding) / count(*) as g, sum(correctness) / count(*) as c, sum(confidence) / count(*) as f from s group by run_label)
select run_label, n, round(g, 6) as grounding_mean, round(c, 6) as correctness_mean, round(f, 6) as confidence_mean, round(g + c + f, 6) as total_mean, round((g + c + f) / 4 * 100, 4) as total_100 from m""")
def agg_15_rubric(spark: SparkSession, root: str) -> DataFrame:
    """Rubric dimensions taken from the results: citations given (2), none wrong (1) and confidence (1)."""
    r = table(spark, root, "query_results")
    scores = r.select("run_label", F.when(F.coalesce("no_citation", F.lit(False)), 0.0).otherwise(2.0).alias("grounding"), F.when(F.size("wrong_citation_indices") > 0, 0.0).otherwise(1.0).alias("correctness"), "confidence")
    out = evalstats.rubric_aggregate(scores, "run_label", {"grounding": 2.0, "correctness": 1.0, "confidence": 1.0})
    return out.withColumns({c: F.round(c, 6) for c in ("grounding_mean", "correctness_mean", "confidence_mean", "total_mean")}).withColumn("total_100", F.round("total_100", 4))


@query("""with t as (select session_id, t.turn_id as turn_id, min(t.expected_citation_patterns) as patterns from (select session_id, unnest(turns) as t from eval_sessions) group by all),
a as (select distinct r.run_label, r.result_id, unnest(t.patterns) as pattern from query_results r join t on t.session_id = r.session_id and t.turn_id = r.turn_id),
texts as (select result_id, content || chr(10) || coalesce(section_header, '') as text from (select distinct result_id, unnest(cited_chunk_ids) as chunk_id from query_results) join (select distinct chunk_id, content, section_header from chunks) using (chunk_id)),
h as (select run_label, result_id, pattern, coalesce(bool_or(contains(text, pattern)), false) as hit from a left join texts using (result_id) where pattern <> '' group by all),
p as (select run_label, result_id, count(*) filter (hit) / count(*) as recall from h group by all)
select run_label, count(*) as answers, round(avg(recall), 6) as recall from p group by run_label""")
def agg_17_pattern_recall(spark: SparkSession, root: str) -> DataFrame:
    """How many of a turn's expected patterns occur in the chunks that an answer cites."""
    turns = table(spark, root, "eval_sessions").select("session_id", F.explode("turns").alias("t")).groupBy("session_id", F.col("t.turn_id").alias("turn_id")).agg(F.min("t.expected_citation_patterns").alias("patterns"))
    results = table(spark, root, "query_results")
    wanted = results.join(turns.where("size(patterns) > 0"), ["session_id", "turn_id"]).select("run_label", "result_id", "patterns")
    texts = table(spark, root, "chunks").select("chunk_id", F.concat("content", F.lit("\n"), F.coalesce("section_header", F.lit(""))).alias("text")).distinct()
    packs = results.select("run_label", "result_id", F.explode(F.array_distinct("cited_chunk_ids")).alias("chunk_id")).join(texts, "chunk_id").select("run_label", "result_id", "text")
    found = evalstats.pattern_recall(packs, wanted, ["run_label", "result_id"])
    return found.groupBy("run_label").agg(F.count("*").alias("answers"), F.round(F.avg("recall"), 6).alias("recall"))


@query(STEPS + """, every as (select query_id, chunk_no, source from expanded union all select query_id, chunk_no, 'retrieval' from reranked r where not kept and not exists (select 1 from expanded e where e.query_id = r.query_id and e.chunk_no = r.chunk_no))
select e.source, count(*) as rows, count(r.reranker_score) as scored, count(distinct e.query_id) as queries from every e left join reranked r on r.query_id = e.query_id and r.chunk_no = e.chunk_no group by e.source""")
def agg_22_source_counts(spark: SparkSession, root: str) -> DataFrame:
    """Where the rows of all packs' debug tables come from, and how many carry a reranker score."""
    from tesserae.operators import evidence

    steps = Steps(spark, root)
    rows = evidence.debug_rows(steps.expanded, steps.raw, steps.reranked, steps.chunks, steps.raw.limit(0).withColumn("citation_index", F.lit(0)), steps.raw.limit(0))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count("reranker_score").alias("scored"), F.countDistinct("query_id").alias("queries"))


@query(r"""with s as (select distinct session_id, scenario, turns from eval_sessions), q as (select session_id, string_agg(t.question, ' ' order by t.turn_id) as text from (select session_id, unnest(turns) as t from s) group by all),
l as (select count(*) as n, count(*) filter (length(text) > 0 and (length(text) - length(regexp_replace(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]', '', 'g'))) / length(text) >= 0.3) as ja from q),
d as (select scenario, count(distinct session_id) as n from s group by scenario), o as (select count(*) as n from (select distinct session_id from predictions intersect select distinct session_id from eval_sessions))
select 'scenario' as metric, scenario as name, round(n / (select sum(n) from d), 6) as value from d union all select 'ja_sequence_ratio', null, round(ja / n, 6) from l union all select 'eval_overlap', null, n from o""")
def agg_23_corpus_report(spark: SparkSession, root: str) -> DataFrame:
    """The eval sessions as a corpus: shares of scenarios, of Japanese sessions, and ids that the logs share."""
    s = table(spark, root, "eval_sessions").select("session_id", "scenario", "turns").distinct()
    per = s.groupBy("scenario").agg(F.countDistinct("session_id").alias("n"))
    whole = F.broadcast(per.agg(F.sum("n").alias("whole")))  # one row
    scenarios = per.join(whole).select(F.lit("scenario").alias("metric"), F.col("scenario").alias("name"), F.round(F.col("n") / F.col("whole"), 6).alias("value"))
    told = F.explode("turns").alias("t")
    texts = s.select("session_id", told).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t.turn_id", "t.question"))), lambda x: x["question"]), " ").alias("text"))
    ratio = texts.agg(F.round(F.count_if(T.language(F.col("text")) == "ja") / F.count("*"), 6).alias("value")).select(F.lit("ja_sequence_ratio").alias("metric"), F.lit(None).cast("string").alias("name"), "value")
    shared = table(spark, root, "predictions").select("session_id").intersect(s.select("session_id")).agg(F.count("*").cast("double").alias("value"))
    return scenarios.unionByName(ratio).unionByName(shared.select(F.lit("eval_overlap").alias("metric"), F.lit(None).cast("string").alias("name"), "value"))


FLAGS = r"""d as (select doc_id, true as always, coalesce(regexp_matches(text, '第\d+条'), false) as has_articles, coalesce(regexp_matches(text, '(罰則|罰金|懲役|過料)'), false) as has_penalty, coalesce(regexp_matches(text, '(但し書き|ただし|例外|除く)'), false) as has_exception from documents where source = 'institutional')"""


def document_index(spark: SparkSession, root: str, source: str = "institutional") -> DataFrame:
    """Documents of a source with what they contain; null texts contain nothing."""
    flag = lambda p: F.coalesce(F.regexp_like("text", F.lit(p)), F.lit(False))
    d = table(spark, root, "documents").where(F.col("source") == source)
    return d.select("doc_id", "repo_id", "title", "lang", F.lit(True).alias("always"), flag(T.ARTICLE).alias("has_articles"), flag(T.PENALTY).alias("has_penalty"), flag(T.EXCEPTION).alias("has_exception"))


@query("with " + FLAGS + """ select d.doc_id, has_articles, has_penalty, has_exception, x.title, x.lang, r.corpus from d join documents x using (doc_id) left join (select distinct repo_id, corpus from repos) r on r.repo_id = x.repo_id""")
def idx_08_document_index(spark: SparkSession, root: str) -> DataFrame:
    """Institutional documents with their flags and what is known of them."""
    meta = table(spark, root, "repos").select("repo_id", "corpus").distinct()
    return document_index(spark, root).join(meta, "repo_id", "left").select("doc_id", "has_articles", "has_penalty", "has_exception", "title", "lang", "corpus")


CATEGORIES = {"definition": ("always",), "article_lookup": ("has_articles",), "penalty": ("has_articles", "has_penalty"), "exception": ("has_articles", "has_exception")}


def _picks() -> str:
    parts = []
    for name, (first, *more) in CATEGORIES.items():
        rest = "".join(f" and ({f} or not exists (select 1 from d where {first} and {f}))" for f in more)
        parts.append(f"select '{name}' as category, doc_id, md5('0:{name}:' || doc_id) as h from d where {first}{rest}")
    return " union all ".join(parts)


@query("with " + FLAGS + f", p as ({_picks()}), r as (select *, row_number() over (partition by category order by h, doc_id) as pick from p) select category, doc_id, pick from r where pick <= 25")
def smp_01_category_picks(spark: SparkSession, root: str) -> DataFrame:
    """Up to 25 documents for each kind of question, from those that can be asked it."""
    return sampling.category_picks(document_index(spark, root), CATEGORIES, "doc_id", 25)


WEIGHTS = {"institutional": 0.5, "wiki": 0.3, "issue_thread": 0.2}
WEIGHT_ROWS = ", ".join(f"('{k}', {v}::double)" for k, v in WEIGHTS.items())


@query(f"""with w(source, w) as (values {WEIGHT_ROWS}), c as (select source, w, row_number() over (partition by source order by md5('0:' || doc_id), doc_id) as k, doc_id from documents join w using (source)),
t as (select min(floor(coalesce(n, 0) / w + 1e-9)) as total from w left join (select source, count(*) as n from documents group by source) using (source)),
m as (select source, doc_id from c, t where k <= floor(total * w + 1e-9)), o as (select *, row_number() over (order by md5('1:' || doc_id), doc_id) as place, count(*) over () as n from m)
select source, doc_id, place, case when place > n - floor(n * 0.1) then 'val' else 'train' end as part from o""")
def smp_06_weighted_mix(spark: SparkSession, root: str) -> DataFrame:
    """Documents of three sources by weight, in one order with the tail held out."""
    return sampling.weighted_mix(table(spark, root, "documents").select("source", "doc_id"), "source", "doc_id", WEIGHTS, 0.1)


@query(r"""with t as (select doc_id, octet_length(encode(text)) as n, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) as ascii from documents)
select doc_id, coalesce(n, 0)::int as n_tokens, case when coalesce(n, 0) = 0 then 'empty' when n > 20000 then 'too_long' else 'out_of_range' end as fault from t where coalesce(n, 0) = 0 or n > 20000 or n > ascii""")
def smp_08_token_faults(spark: SparkSession, root: str) -> DataFrame:
    """Documents as lines of byte tokens, checked against a vocabulary of 128 and 20,000 tokens a line."""
    lines = table(spark, root, "documents").select("doc_id", T.byte_tokens(F.col("text")).alias("tokens"))
    return sampling.token_faults(lines, "doc_id", "tokens", 128, 20_000)


@query("""select variant_name, position, count(*) as n, count(distinct session_id) as sessions from predictions join (values ('baseline_summary', 0), ('baseline', 1), ('grid_small', 2)) v(variant_name, position) using (variant_name) group by all""")
def smp_12_chosen_variants(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the variants asked for, in the order asked."""
    chosen = sampling.chosen_variants(table(spark, root, "predictions"), "variant_name", "baseline_summary, baseline,grid_small")
    return chosen.groupBy("variant_name", "position").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"))


@query("""select doc_id, unnest(range(0, ceil(n / 512)::bigint)) as part, unnest(list_transform(range(0, ceil(n / 512)::bigint), lambda i: least(512, n - i * 512))) as n_tokens from (select doc_id, octet_length(encode(text)) as n from documents where octet_length(encode(text)) > 0)""")
def chk_08_token_windows(spark: SparkSession, root: str) -> DataFrame:
    """Documents as byte tokens, cut into lines of at most 512."""
    parts = token_windows(table(spark, root, "documents").select("doc_id", T.byte_tokens(F.col("text")).alias("tokens")), "doc_id", most=512)
    return parts.select("doc_id", F.col("part").cast("bigint").alias("part"), F.size("tokens").cast("bigint").alias("n_tokens"))


@query("""with t as (select distinct session_id, t.turn_id as turn_id from (select session_id, unnest(turns) as t from eval_sessions)), e as (select count(*) as expected from t),
f as (select run_label, count(t.turn_id) as found from (select distinct run_label, session_id, turn_id from query_results) r left join t on t.session_id = r.session_id and t.turn_id = r.turn_id group by run_label)
select run_label, expected, found, expected - found as missing, expected = found as complete from f, e""")
def orc_02_resumable_runs(spark: SparkSession, root: str) -> DataFrame:
    """Which runs answered every expected turn and may be skipped; the others start again."""
    turns = eval_turns(spark, root).select("session_id", "turn_id").withColumn("asked", F.lit(True))
    done = table(spark, root, "query_results").select("run_label", "session_id", "turn_id").distinct().join(turns, ["session_id", "turn_id"], "left").groupBy("run_label").agg(F.count("asked").alias("found"))
    expected = F.broadcast(turns.agg(F.count("*").alias("expected")))  # one row
    return done.join(expected).select("run_label", "expected", "found", (F.col("expected") - F.col("found")).alias("missing"), (F.col("expected") == F.col("found")).alias("complete"))
