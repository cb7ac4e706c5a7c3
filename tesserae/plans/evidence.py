"""Queries on evidence: reranking with rejected rows, packs with pins, debug and audit rows, prompts, related-past retrieval."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import evidence, memory, retrieval
from tesserae.plans import memory as M
from tesserae.plans.conversation import eval_turns
from tesserae.plans.fragments import BM25, HYBRID, QUESTIONS, features, tokens
from tesserae.plans.retrieval import hybrid, lexical_top, questions, searched
from tesserae.sources.tables import stored, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def noisy(path: str) -> str:
    return " or ".join(f"contains({path}, '{n}')" for n in retrieval.NOISE)


#: Reranked rows of the fused lists (place up to 8 kept, up to 18 rejected), the chunks expanded to, those cited, recently cited and pinned.
STEPS = HYBRID + f""", asked_at as (select result_id as query_id, run_label, session_id, turn_id, cited_chunk_ids from query_results where result_id % 50 = 0),
ids as (select chunk_id, min(chunk_no) as chunk_no from chunks group by chunk_id),
pool as (select f.query_id, f.chunk_no, f.score, {noisy('c.rel_path')} as noise, {features('q.query')} as qf, {features("concat('Document path: ', rel_path, chr(10), 'Section: ', coalesce(section_header, ''), chr(10), 'Content: ', left(content, 600))")} as pf from fused f join chunks c using (chunk_no) join queries q using (query_id) where f.rank <= 30),
clean as (select *, count(*) filter (not noise) over (partition by query_id) as n_clean from pool),
ranked as (select *, row_number() over (partition by query_id order by reranker_score desc, score desc, chunk_no) as place from (select query_id, chunk_no, score, round(case when len(qf) > 0 and len(pf) > 0 then len(list_intersect(qf, pf)) / len(qf) else 0 end, 6) as reranker_score from clean where not noise or n_clean = 0)),
reranked as (select *, place <= 8 as kept from ranked where place <= 18),
o as (select chunk_no, repo_id, repo_commit, rel_path, row_number() over (partition by repo_id, repo_commit, rel_path order by start_line, chunk_no) as rn from chunks),
phases as (select query_id, chunk_no, 0 as phase, place as ord from reranked where kept union all select r.query_id, b.chunk_no, 2, 1 from reranked r join o a using (chunk_no) join o b using (repo_id, repo_commit, rel_path) where r.kept and abs(a.rn - b.rn) = 1),
firsts as (select query_id, chunk_no, min((phase, ord)) as sn from phases group by all),
expanded as (select query_id, chunk_no, case when sn[1] = 0 then 'retrieval' else 'neighbor' end as source, row_number() over (partition by query_id order by sn, chunk_no) as position from firsts),
was_cited as (select distinct query_id, i.chunk_no from (select query_id, unnest(cited_chunk_ids) as chunk_id from asked_at) join ids i using (chunk_id)),
recent as (select distinct query_id, i.chunk_no from (select a.query_id, unnest(r.cited_chunk_ids) as chunk_id from asked_at a join query_results r on r.run_label = a.run_label and r.session_id = a.session_id and r.turn_id between a.turn_id - 2 and a.turn_id - 1) join ids i using (chunk_id)),
refs as (select session_id, turn_id, min(ids) as ids from (select session_id, t.turn_id as turn_id, t.reference_chunk_ids as ids from (select session_id, unnest(turns) as t from eval_sessions)) group by all),
pins as (select query_id, i.chunk_no, min(position) as position from (select a.query_id, unnest(r.ids[1:3]) as chunk_id, unnest(range(1, least(3, len(r.ids))::int + 1)) as position from asked_at a join refs r on r.session_id = a.session_id and r.turn_id = a.turn_id - 1 where query_id in (select query_id from queries)) join ids i using (chunk_id) group by all),
packable as (select coalesce(e.query_id, p.query_id) as query_id, coalesce(e.chunk_no, p.chunk_no) as chunk_no, coalesce(p.position, e.position) as position, case when p.position is not null then 0 when c.chunk_no is not null then 1 else 2 end as priority
  from expanded e full join pins p on p.query_id = e.query_id and p.chunk_no = e.chunk_no left join recent c on c.query_id = coalesce(e.query_id, p.query_id) and c.chunk_no = coalesce(e.chunk_no, p.chunk_no)),
numbered as (select p.*, length(content) as chars, row_number() over (partition by query_id order by priority, position, chunk_no) as k from packable p join chunks using (chunk_no)),
pack as (select * from (select query_id, chunk_no, k as citation_index, priority, sum(chars) over (partition by query_id order by k) as used from numbered where k <= 8) where used <= 6000)"""


def asked_at(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "query_results").where("result_id % 50 = 0").select(F.col("result_id").alias("query_id"), "run_label", "session_id", "turn_id", "cited_chunk_ids")


def numbers(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Rows with a ``chunk_id`` with the lowest number of that id's chunks."""
    return ids.join(table(spark, root, "chunks").groupBy("chunk_id").agg(F.min("chunk_no").alias("chunk_no")), "chunk_id").drop("chunk_id")


def pins_of(spark: SparkSession, root: str) -> DataFrame:
    """The first chunks that the turn before each question refers to."""
    now = asked_at(spark, root).join(questions(spark, root).select("query_id"), "query_id", "left_semi").select("query_id", "session_id", (F.col("turn_id") - 1).alias("turn_id"))
    refs = now.join(M.cited_chunks(spark, root), ["session_id", "turn_id"]).select("query_id", F.posexplode(F.slice("chunk_ids", 1, 3)).alias("at", "chunk_id"))
    return numbers(spark, root, refs.select("query_id", "chunk_id", (F.col("at") + 1).alias("position")))


class Steps:
    """The steps of evidence for all questions, each stored where several later ones read it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.chunks = spark, root, table(spark, root, "chunks")
        fused = hybrid(spark, root).withColumn("score", F.round("score", 6))
        self.raw = stored(retrieval.top_k(fused, 30, ["query_id"], [F.desc("score"), F.asc("chunk_no")]))

    @cached_property
    def reranked(self) -> DataFrame:
        passage = F.concat(F.lit("Document path: "), "rel_path", F.lit("\nSection: "), F.coalesce("section_header", F.lit("")), F.lit("\nContent: "), F.left("content", F.lit(600)))
        # Scores are taken where question and passage meet, so passages go no further.
        scorer = F.round(T.overlap(T.text_features(F.col("query")), T.text_features(F.col("passage"))), 6)
        pool = self.raw.select("query_id", "chunk_no", "score").join(questions(self.spark, self.root), "query_id").join(self.chunks.select("chunk_no", "rel_path", passage.alias("passage")), "chunk_no")
        pool = pool.select("query_id", "chunk_no", "score", "rel_path", scorer.alias("overlap"))
        return stored(evidence.reranked_and_rejected(pool, F.col("overlap")).select("query_id", "chunk_no", "score", "reranker_score", "place", "kept"))

    @cached_property
    def expanded(self) -> DataFrame:
        kept = self.reranked.where("kept").select("query_id", "chunk_no", F.col("place").alias("ord"))
        near = retrieval.file_neighbours(kept.select("query_id", "chunk_no"), self.chunks).select("query_id", "chunk_no", F.abs("distance").alias("ord"))
        return stored(retrieval.expand(kept, kept.limit(0), near))

    def cited(self) -> DataFrame:
        return numbers(self.spark, self.root, asked_at(self.spark, self.root).select("query_id", F.explode("cited_chunk_ids").alias("chunk_id"))).distinct()

    def recent(self) -> DataFrame:
        """Chunks that the same run cited in the two turns before."""
        now = asked_at(self.spark, self.root).select("query_id", "run_label", "session_id", F.explode(F.array(F.col("turn_id") - 1, F.col("turn_id") - 2)).alias("turn_id"))
        past = table(self.spark, self.root, "query_results").select("run_label", "session_id", "turn_id", "cited_chunk_ids")
        return numbers(self.spark, self.root, now.join(past, ["run_label", "session_id", "turn_id"]).select("query_id", F.explode("cited_chunk_ids").alias("chunk_id"))).distinct()

    def pack(self) -> DataFrame:
        return evidence.pack_with_pins(self.expanded, pins_of(self.spark, self.root), self.recent(), self.chunks.select("chunk_no", F.length("content").alias("chars")))


@query(STEPS + " select query_id, chunk_no, score, reranker_score, place, kept from reranked")
def ret_11_reranked_and_rejected(spark: SparkSession, root: str) -> DataFrame:
    """The eight best rows by the default scorer, and the ten after them."""
    return Steps(spark, root).reranked


@query(STEPS + " select query_id, chunk_no, citation_index, priority, used::bigint as used from pack")
def ret_17_pack_with_pins(spark: SparkSession, root: str) -> DataFrame:
    """Evidence packs with the chunks of the turn before pinned and those cited in the last two turns preferred."""
    return Steps(spark, root).pack()


@query(STEPS + """, every as (select query_id, chunk_no, source from expanded union all select query_id, chunk_no, 'retrieval' from reranked r where not kept and not exists (select 1 from expanded e where e.query_id = r.query_id and e.chunk_no = r.chunk_no))
select e.query_id, e.chunk_no, e.source, c.rel_path, c.section_header, case when source = 'retrieval' then round(f.lexical_score, 6) end as lexical_score, case when source = 'retrieval' then round(f.dense_score, 6) end as dense_score, case when source = 'retrieval' then f.score end as fused_score, r.reranker_score,
p.citation_index is not null as used, case when w.chunk_no is not null then p.citation_index end as citation_index from every e left join fused f on f.query_id = e.query_id and f.chunk_no = e.chunk_no and f.rank <= 30 left join reranked r on r.query_id = e.query_id and r.chunk_no = e.chunk_no
join chunks c on c.chunk_no = e.chunk_no left join pack p on p.query_id = e.query_id and p.chunk_no = e.chunk_no left join was_cited w on w.query_id = e.query_id and w.chunk_no = e.chunk_no""")
def ret_18_19_debug_rows(spark: SparkSession, root: str) -> DataFrame:
    """What happened to every chunk on its way to the pack."""
    steps = Steps(spark, root)
    rows = evidence.debug_rows(steps.expanded, steps.raw, steps.reranked, steps.chunks, steps.pack(), steps.cited())
    return rows.withColumns({c: F.round(c, 6) for c in ("lexical_score", "dense_score")})


@query(STEPS + """ select f.query_id, f.chunk_no, f.rank, f.score, c.rel_path, c.section_header, w.chunk_no is not null as cited from fused f join chunks c using (chunk_no) left join was_cited w on w.query_id = f.query_id and w.chunk_no = f.chunk_no where f.rank <= 20""")
def ret_20_audit_rows(spark: SparkSession, root: str) -> DataFrame:
    """The first twenty fused rows with their place and whether the answer cited them."""
    steps = Steps(spark, root)
    return evidence.audit_rows(steps.raw.select("query_id", "chunk_no", "rank", "score"), steps.chunks, steps.cited())


@query(STEPS + """ select query_id, md5(string_agg('[C:' || citation_index || '] ' || rel_path || '  (lines ' || start_line || '–' || end_line || ')' || case when length(section_header) > 0 then '  [' || section_header || ']' else '' end || chr(10) || regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by citation_index)) as digest
from pack join chunks using (chunk_no) group by query_id""")
def txt_13_prompts(spark: SparkSession, root: str) -> DataFrame:
    """The evidence text of every pack."""
    steps = Steps(spark, root)
    return evidence.prompts(steps.pack(), steps.chunks).select("query_id", F.md5("prompt").alias("digest"))


@query(STEPS + f""", past as (select a.query_id, t.question from asked_at a join turns t on t.session_id = a.session_id and t.turn_id = a.turn_id - 1),
cand as (select f.query_id, f.chunk_no, f.rank, f.lexical_score as retrieval, f.dense_score as current, {features('p.question')} as pf, {features('c.content')} as cf, coalesce(contains(lower(q.query), 'それ') or contains(lower(q.query), 'では'), false) as strong from fused f join chunks c using (chunk_no) join queries q using (query_id) left join past p using (query_id) where f.rank <= 20),
dual as (select *, case when len(pf) > 0 and len(cf) > 0 then len(list_intersect(pf, cf)) / len(pf) else 0 end as session from cand),
sc as (select query_id, chunk_no, rank, rank <= 4 as kept, round(case when strong then 0.45 * retrieval + 0.35 * current + 0.2 * session - 0.12 * greatest(0, session - current) else 0.6 * retrieval + 0.4 * current - 0.3 * greatest(0, session - current) end, 6) as dual_score from dual),
pl as (select *, row_number() over (partition by query_id order by kept desc, case when kept then rank end, dual_score desc, rank) as place from sc)
select query_id, chunk_no, dual_score, place from pl where place <= 8""")
def ret_22_dual_selection(spark: SparkSession, root: str) -> DataFrame:
    """Candidates after the protected ones by retrieval, closeness to the question and to the question before."""
    steps = Steps(spark, root)
    now = asked_at(spark, root).select("query_id", "session_id", (F.col("turn_id") - 1).alias("turn_id"))
    past = now.join(eval_turns(spark, root).select("session_id", "turn_id", "question"), ["session_id", "turn_id"]).select("query_id", "question")
    rows = steps.raw.where("rank <= 20").join(questions(spark, root), "query_id").join(past, "query_id", "left").join(steps.chunks.select("chunk_no", "content"), "chunk_no")
    session = T.overlap(T.text_features(F.col("question")), T.text_features(F.col("content")))
    strong = F.contains(F.lower("query"), F.lit("それ")) | F.contains(F.lower("query"), F.lit("では"))
    return evidence.dual_selection(rows.select("query_id", "chunk_no", "rank", F.col("lexical_score").alias("retrieval"), F.col("dense_score").alias("current"), session.alias("session"), strong.alias("strong")))


#: Lexical lists of the related questions of every asked turn, as many rows of each as its distance allows.
PAST = BM25.replace(f"with {QUESTIONS}", M.RELATED + """, asked_at as (select result_id, session_id, turn_id from query_results where result_id % 50 = 0),
pairs as (select a.result_id * 1000 + r.past_turn as query_id, a.result_id, r.past_turn, r.distance, r.question as query from asked_at a join related r on r.session_id = a.session_id and r.turn_id = a.turn_id), queries as (select query_id, query from pairs)""") + """,
lists as (select query_id, chunk_no, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as k from scores join chunks using (chunk_no)),
past_rows as (select p.result_id as query_id, l.chunk_no, p.past_turn * 10 + k as ord from lists l join pairs p using (query_id) where k <= greatest(1, least(4, round_even(4 * pow(0.6, p.distance - 1), 0)::int))),
past_found as (select query_id, chunk_no, min(ord) as ord from past_rows group by all)"""


def related_past(spark: SparkSession, root: str) -> DataFrame:
    """``query_id, chunk_no, ord``: chunks found for the related earlier questions of each asked turn, in the order of those turns."""
    now = asked_at(spark, root).select("query_id", "session_id", "turn_id")
    sessions = stored(now.select("session_id").distinct())  # Spark knows its size, and turns of other sessions aren't shuffled
    pairs = stored(now.join(M.related(spark, root, sessions), ["session_id", "turn_id"]).select("query_id", "past_turn", "distance", "question"))
    asked = pairs.select((F.col("query_id") * 1000 + F.col("past_turn")).alias("query_id"), F.col("question").alias("query"))
    lists = searched(spark, root, asked, 4)
    found = lists.join(pairs.select((F.col("query_id") * 1000 + F.col("past_turn")).alias("query_id"), F.col("query_id").alias("asked"), "past_turn", "distance"), "query_id")
    rows = found.where(F.col("rank") <= retrieval.related_k(F.col("distance"))).select(F.col("asked").alias("query_id"), "chunk_no", (F.col("past_turn") * 10 + F.col("rank")).alias("ord"))
    return rows.groupBy("query_id", "chunk_no").agg(F.min("ord").alias("ord"))


@query(PAST + " select query_id, chunk_no, row_number() over (partition by query_id order by ord, chunk_no) as position from past_found")
def ret_26_related_past(spark: SparkSession, root: str) -> DataFrame:
    """Evidence for related earlier questions, fewer rows the longer ago."""
    found = related_past(spark, root).withColumn("source", F.lit("related_past"))
    return memory.seen_first([found], "chunk_no").drop("source")


@query(PAST + """, places as (select chunk_no, repo_id, repo_commit, rel_path, row_number() over (partition by repo_id, repo_commit, rel_path order by start_line, chunk_no) as rn from chunks),
every as (select query_id, chunk_no, 0 as phase, ord, 'related_past' as source from past_found union all select p.query_id, b.chunk_no, 1, p.ord, 'related_past_neighbor' from past_found p join places a using (chunk_no) join places b using (repo_id, repo_commit, rel_path) where abs(a.rn - b.rn) = 1),
f as (select query_id, chunk_no, min((phase, ord, source)) as sn from every group by all)
select query_id, chunk_no, sn[3] as source, row_number() over (partition by query_id order by sn[1], sn[2], chunk_no) as position from f""")
def ret_25_related_past_expanded(spark: SparkSession, root: str) -> DataFrame:
    """Related-past evidence with the other parts of split chunks and the neighbours in the file."""
    chunks, found = table(spark, root, "chunks"), stored(related_past(spark, root))
    near = retrieval.file_neighbours(found.select("query_id", "chunk_no"), chunks).withColumnRenamed("chunk_no", "near")
    near = near.join(found.select("query_id", F.col("chunk_no").alias("seed"), "ord"), ["query_id", "seed"]).select("query_id", F.col("near").alias("chunk_no"), "ord", F.lit("related_past_neighbor").alias("source"))
    own = found.withColumn("source", F.lit("related_past"))
    return memory.seen_first([own, evidence.with_siblings(found, chunks).unionByName(near)], "chunk_no")


OWN = PAST + f""", own_asked as (select query_id, token, count(*) as qf from (select a.result_id as query_id, unnest({tokens('t.question')}) as token from asked_at a join turns t on t.session_id = a.session_id and t.turn_id = a.turn_id) group by all),
own_scores as (select query_id, chunk_no, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from own_asked join terms using (token) join posts using (token), lens group by all),
current as (select * from (select query_id, chunk_no, row_number() over (partition by query_id order by round(score, 6) desc, rel_path, start_line, chunk_no) as ord from own_scores join chunks using (chunk_no)) where ord <= 3)"""


@query(OWN + """,
ids as (select chunk_id, min(chunk_no) as chunk_no from chunks group by chunk_id), refs as (select session_id, turn_id, min(ids) as ids from (select session_id, t.turn_id as turn_id, t.reference_chunk_ids as ids from (select session_id, unnest(turns) as t from eval_sessions)) group by all),
mem as (select query_id, i.chunk_no, min(position) as ord from (select a.result_id as query_id, unnest(r.ids[1:3]) as chunk_id, unnest(range(1, least(3, len(r.ids))::int + 1)) as position from asked_at a join turns q on q.session_id = a.session_id and q.turn_id = a.turn_id and q.question is not null join refs r on r.session_id = a.session_id and r.turn_id = a.turn_id - 1) join ids i using (chunk_id) group by all),
every as (select query_id, chunk_no, 0 as phase, ord, 'current' as source from current union all select query_id, chunk_no, 1, ord, 'memory' from mem union all select query_id, chunk_no, 2, ord, 'related_past' from past_found),
f as (select query_id, chunk_no, min((phase, ord, source)) as sn from every group by all)
select query_id, chunk_no, sn[3] as source, row_number() over (partition by query_id order by sn[1], sn[2], chunk_no) as position from f""")
def ret_28_frame_pins(spark: SparkSession, root: str) -> DataFrame:
    """Pins of the evidence frame: what the question found itself, then the turn before's chunks, then related-past evidence."""
    own = lexical_top(spark, root, 3)
    pins = pins_of(spark, root).groupBy("query_id", "chunk_no").agg(F.min("position").alias("ord"))
    parts = [own.select("query_id", "chunk_no", F.col("rank").alias("ord"), F.lit("current").alias("source")), pins.withColumn("source", F.lit("memory")), related_past(spark, root).withColumn("source", F.lit("related_past"))]
    return memory.seen_first(parts, "chunk_no")
