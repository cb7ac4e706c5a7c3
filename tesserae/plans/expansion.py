"""More queries on retrieval, sessions, gradings and corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.text import REFUSALS, any_of, sanitised
from tesserae.operators import evalstats, index, retrieval, sessions
from tesserae.plans.conversation import eval_turns, vector_turns
from tesserae.plans.fragments import BM25
from tesserae.plans.retrieval import lexical_top
from tesserae.sources import files as src
from tesserae.sources.tables import stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
# Phrases looked up in the corpus, in the order in which they name a cluster.
PHRASES = ["罰則", "手続", "例外", "期限", "検索", "引用", "通知", "条"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


TOP = BM25 + """, placed as (select query_id, chunk_no, rel_path, round(score, 6) as score, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as rank from scores join chunks using (chunk_no))"""


@query(TOP + """, b as (select query_id, chunk_no, round(case when lower(rel_path) like '%.py' then score + 0.5 else score end, 6) as score from placed where rank <= 20)
select query_id, chunk_no, score, row_number() over (partition by query_id order by score desc, chunk_no) as rank from b""")
def ret_12_boosted(spark: SparkSession, root: str) -> DataFrame:
    top = lexical_top(spark, root, 20).select("query_id", "chunk_no", "rel_path", "score")
    out = retrieval.boosted(top.withColumn("score", F.round("score", 6)), ".py", 0.5).withColumn("score", F.round("score", 6))
    return out.select("query_id", "chunk_no", "score", "rank")


@query(TOP + """, m as (select query_id, rel_path, max(score) as s from placed where rank <= 40 group by all)
select query_id, rel_path, round(case when max(s) over (partition by query_id) > 0 then s / max(s) over (partition by query_id) else s end, 5) as score from m""")
def ret_24_score_map(spark: SparkSession, root: str) -> DataFrame:
    """The best score of each file over a question's chunks, over the question's best."""
    top = stored(lexical_top(spark, root, 40).select("query_id", "rel_path", "score", "rank"))
    return retrieval.score_map([top.where("rank <= 20"), top.where("rank > 20")], "rel_path").select("query_id", "rel_path", F.round("score", 5).alias("score"))


@query(TOP + """, p as (select query_id, chunk_no, rank as ord, 0 as phase from placed where rank <= 3 union all select query_id, chunk_no, row_number() over (partition by query_id order by rel_path, chunk_no), 1 from placed where rank <= 12),
f as (select query_id, chunk_no, min(phase * 1000 + ord) as pos from p group by all)
select query_id, chunk_no, row_number() over (partition by query_id order by pos, chunk_no) as position from f""")
def ret_21_protected_union(spark: SparkSession, root: str) -> DataFrame:
    """The first three of a list, then another order of the list, without repeats."""
    top = stored(lexical_top(spark, root, 12).select("query_id", "chunk_no", "rel_path", "rank")).withColumn("other", F.row_number().over(Window.partitionBy("query_id").orderBy("rel_path", "chunk_no")))
    lists = [top.where("rank <= 3").select("query_id", "chunk_no", F.col("rank").alias("ord")), top.select("query_id", "chunk_no", F.col("other").alias("ord"))]
    return retrieval.ordered_union(lists, "chunk_no")


@query("""select session_id, turn_id, past, greatest(1, least(4, round_even(4 * pow(0.6, (turn_id - past - 1)), 0)))::bigint as k from (select distinct session_id, turn_id, unnest(range(greatest(min_turn, turn_id - 4), turn_id)) as past
from (select session_id, t.turn_id as turn_id, min(t.turn_id) over (partition by session_id) as min_turn from (select session_id, unnest(turns) as t from (select distinct session_id, turns from eval_sessions)) where t.turn_id is not null))""")
def ret_26_related_k(spark: SparkSession, root: str) -> DataFrame:
    """How many chunks each of the last four turns may bring to a turn."""
    turns = eval_turns(spark, root).select("session_id", "turn_id").withColumn("first", F.min("turn_id").over(Window.partitionBy("session_id")))
    low = F.greatest("first", F.col("turn_id") - 4)
    past = turns.where(low < F.col("turn_id")).select("session_id", "turn_id", F.explode(F.sequence(low, F.col("turn_id") - 1)).alias("past"))
    return past.select("session_id", "turn_id", F.col("past").cast("bigint").alias("past"), retrieval.related_k(F.col("turn_id") - F.col("past")).cast("bigint").alias("k"))


@query("select phrase, count(*) as df from (select unnest(['" + "', '".join(PHRASES) + "']) as phrase) p join documents d on contains(d.text, p.phrase) group by phrase")
def idx_11_phrase_frequencies(spark: SparkSession, root: str) -> DataFrame:
    return index.document_frequencies(table(spark, root, "documents"), "doc_id", F.col("text"), PHRASES)


@query("select keyword, count(*) as questions from (select coalesce(" + ", ".join(f"case when contains(q, '{k}') then '{k}' end" for k in PHRASES) + ") as keyword from (select distinct t.question as q from (select unnest(turns) as t from eval_sessions))) where keyword is not null group by keyword")
def idx_10_question_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Distinct questions by the first keyword they contain."""
    q = table(spark, root, "eval_sessions").select(F.explode("turns.question").alias("q")).distinct()
    return q.select(index.keyword_of(F.col("q"), PHRASES).alias("keyword")).where("keyword is not null").groupBy("keyword").agg(F.count("*").alias("questions"))


REFUSED = " or ".join(f"contains(coalesce(r.answer, ''), '{x}')" for x in REFUSALS)


@query(f"""with t as (select session_id, t.turn_id as turn_id, min(t.reference_chunk_ids) as want from (select session_id, unnest(turns) as t from eval_sessions) group by all),
g as (select r.run_label, case when len(coalesce(r.wrong_citation_indices, [])) > 0 then 'WRONG' when len(list_intersect(r.cited_chunk_ids, t.want)) > 0 then 'CORRECT_CHUNK'
when len(list_intersect(list_transform(r.cited_chunk_ids, lambda c: split_part(c, '::', 1) || '::' || split_part(c, '::', 2)), list_transform(t.want, lambda c: split_part(c, '::', 1) || '::' || split_part(c, '::', 2)))) > 0 then 'ARTICLE_LEVEL'
when len(coalesce(r.cited_chunk_ids, [])) = 0 or {REFUSED} then 'NO_CITATION' else 'WRONG' end as grade from query_results r join t on t.session_id = r.session_id and t.turn_id = r.turn_id)
select run_label, grade, count(*) as n from g group by all""")
def agg_16_citation_grades(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "eval_sessions").select("session_id", F.explode("turns").alias("t")).groupBy("session_id", F.col("t.turn_id").alias("turn_id")).agg(F.min("t.reference_chunk_ids").alias("want"))
    empty = F.array().cast("array<string>")
    r = table(spark, root, "query_results").join(turns, ["session_id", "turn_id"])
    grade = evalstats.citation_grade(F.coalesce("wrong_citation_indices", F.array().cast("array<int>")), F.coalesce("cited_chunk_ids", empty), F.coalesce("want", empty), any_of(F.coalesce("answer", F.lit("")), REFUSALS))
    return r.select("run_label", grade.alias("grade")).groupBy("run_label", "grade").agg(F.count("*").alias("n"))


@query("""with s as (select run_label, count(*) as n, count(*) filter (no_citation) / count(*) as no_citation_rate, count(*) filter (len(wrong_citation_indices) > 0) / count(*) as wrong_rate, quantile_cont(latency.total_ms, 0.5) as p50_ms from query_results group by run_label)
select run_label, round(no_citation_rate, 6) as no_citation_rate, round(wrong_rate, 6) as wrong_rate, (case when no_citation_rate > 0.3 then 1 else 0 end + case when wrong_rate > 0 then 1 else 0 end + case when p50_ms > 25000 then 1 else 0 end)::int as violations from s where no_citation_rate > 0.3 or wrong_rate > 0 or p50_ms > 25000""")
def agg_07_threshold_violations(spark: SparkSession, root: str) -> DataFrame:
    from tesserae.operators.selection import percentiles

    r = table(spark, root, "query_results").withColumn("ms", F.col("latency.total_ms"))
    stats = r.groupBy("run_label").agg(evalstats.rate(F.col("no_citation")).alias("no_citation_rate"), evalstats.rate(F.size("wrong_citation_indices") > 0).alias("wrong_rate"))
    stats = stats.join(percentiles(r, ["run_label"], "ms", {"p50_ms": (0.5, "linear")}), "run_label", "left")
    over = evalstats.over_thresholds(stats, {"no_citation_rate": 0.3, "wrong_rate": 0.0, "p50_ms": 25_000.0})
    return over.select("run_label", F.round("no_citation_rate", 6).alias("no_citation_rate"), F.round("wrong_rate", 6).alias("wrong_rate"), F.size("violations").alias("violations"))


@query("select language, count(*) as chunks, count(*) filter (length(content) >= 64) as kept, sum(length(content)) filter (length(content) >= 64) as chars from chunks group by language")
def smp_05_length_filter(spark: SparkSession, root: str) -> DataFrame:
    n = F.length("content")
    return table(spark, root, "chunks").groupBy("language").agg(F.count("*").alias("chunks"), F.count_if(n >= 64).alias("kept"), F.sum(F.when(n >= 64, n)).alias("chars"))


@query("""with l as (select doc_id, case doc_id % 3 when 0 then '[' || coalesce(title, 'none') || '](https://example.org/' || doc_id || '.md)' when 1 then coalesce(title, 'none') || ' | https://example.org/' || doc_id || '.pdf' else 'https://example.org/' || doc_id end as line from documents where coalesce(title, '') not like '%]%' and coalesce(title, '') not like '%|%' and coalesce(title, '') not like '#%' and coalesce(title, '') not like '%[%')
select 'https://example.org/' || doc_id || case doc_id % 3 when 0 then '.md' when 1 then '.pdf' else '' end as url, case doc_id % 3 when 0 then 'markdown' when 1 then 'pdf' else 'html' end as kind from l""")
def src_05_06_url_lists(spark: SparkSession, root: str) -> DataFrame:
    """A URL list written from the documents' titles, in its three forms, and read again; without the titles of its own marks, as the SQL has it."""
    title = F.coalesce("title", F.lit("none"))
    d = table(spark, root, "documents").where(~F.regexp_like(F.coalesce("title", F.lit("")), F.lit(r"[\[\]|]|^#")))
    url = F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))
    third = F.col("doc_id") % 3
    line = F.when(third == 0, F.concat(F.lit("["), title, F.lit("]("), url, F.lit(".md)"))).when(third == 1, F.concat(title, F.lit(" | "), url, F.lit(".pdf"))).otherwise(url)
    parsed = src.parsed_urls(d.select(line.alias("line")))
    return parsed.select("url", src.kind_of(F.lit(None).cast("string"), F.col("url")).alias("kind"))


@query("""select 'https://example.org/' || doc_id || case doc_id % 3 when 0 then '.md' when 1 then '.pdf' else '' end as url, case doc_id % 3 when 0 then 'markdown' when 1 then 'pdf' else 'html' end as kind,
case when doc_id % 3 < 2 then nullif(trim(regexp_replace(translate(coalesce(title, 'none'), '[]|' || chr(10) || chr(13), '［］｜  '), '^(\\s*)#', '\\1＃')), '') end as title from documents""")
def src_05_06_url_lists_all(spark: SparkSession, root: str) -> DataFrame:
    """The list with all documents: what the list's own marks are made of is written in full width in titles."""
    title = F.translate(F.coalesce("title", F.lit("none")), "[]|\n\r", "［］｜  ")
    title = F.trim(F.regexp_replace(title, r"^(\s*)#", "$1＃"))
    url = F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))
    third = F.col("doc_id") % 3
    line = F.when(third == 0, F.concat(F.lit("["), title, F.lit("]("), url, F.lit(".md)"))).when(third == 1, F.concat(title, F.lit(" | "), url, F.lit(".pdf"))).otherwise(url)
    parsed = src.parsed_urls(table(spark, root, "documents").select(line.alias("line")))
    return parsed.select("url", src.kind_of(F.lit(None).cast("string"), F.col("url")).alias("kind"), "title")


@query()
def src_07_html_pages(spark: SparkSession, root: str) -> DataFrame:
    """Documents wrapped as pages and turned back into markdown."""
    escape = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>"), F.coalesce(sanitised(F.col("title")), F.lit("")), F.lit("</title></head><body><h1>Text</h1><p>"), escape, F.lit("</p><script>x</script></body></html>"))
    pages = table(spark, root, "documents").select("doc_id", src.html_markdown(page).alias("m"))
    return pages.select("doc_id", "m.title", F.md5("m.body").alias("digest"), F.length("m.body").alias("chars"))


@query("""with v as (select vec_id // 25 as session_id, vec_id % 25 as turn_id, embedding::double[] as vector from embeddings), l as (select *, lag(vector) over (partition by session_id order by turn_id) as last from v),
d as (select case when last is null then 0 else 1 - list_cosine_similarity(vector, last) end as drift from l)
select case when round(drift, 9) > 1.0 then 'alert' when round(drift, 9) > 0.8 then 'warn' else 'ok' end as badge, count(*) as turns from d group by badge""")
def ses_27_drift_badges(spark: SparkSession, root: str) -> DataFrame:
    badges = sessions.drift(vector_turns(spark, root)).select(sessions.drift_badge(F.round("drift", 9), 1.0).alias("badge"))
    return badges.groupBy("badge").agg(F.count("*").alias("turns"))


@query("""with t as (select session_id, t.turn_id as turn_id, min(t.question) as q from (select session_id, unnest(turns) as t from eval_sessions) group by all)
select session_id, count(*) as turns, min(turn_id) as first_turn, max(turn_id) as last_turn, max(turn_id) - min(turn_id) + 1 = count(*) as gapless from t group by session_id""")
def ses_03_session_shapes(spark: SparkSession, root: str) -> DataFrame:
    t = F.col("turn_id")
    return eval_turns(spark, root).groupBy("session_id").agg(F.count("*").alias("turns"), F.min(t).alias("first_turn"), F.max(t).alias("last_turn"), (F.max(t) - F.min(t) + 1 == F.count("*")).alias("gapless"))
