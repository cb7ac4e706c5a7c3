"""Queries on what sessions remember: matched turns, carryover, visible history, stored vectors and related questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.vectors import norm
from tesserae.operators import index, memory, sessions
from tesserae.plans.conversation import SEGMENT_FOLD, SIGNALS, VECTORS, eval_turns, vector_turns
from tesserae.plans.fragments import tokens
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


def matches_sql(back: int, least: float) -> str:
    """Cosines of each turn's hashed question vector with those of the turns before it."""
    return f"""v as (select session_id, turn_id, ('0x' || left(md5(token), 4))::int % 64 as slot, count(*)::double as n from (select session_id, turn_id, unnest({tokens('question')}) as token from turns) group by all),
vn as (select session_id, turn_id, sqrt(sum(n * n)) as norm from v group by all),
near as (select a.session_id, a.turn_id, a.marked, b.turn_id as past_turn, a.rn - b.rn as back from s a join s b on a.session_id = b.session_id and b.rn < a.rn and b.rn >= a.rn - {back}),
sims as (select p.session_id, p.turn_id, p.past_turn, p.marked, round(coalesce(sum(x.n * y.n), 0) / (any_value(xn.norm) * any_value(yn.norm)), 9) as similarity from near p join vn xn on xn.session_id = p.session_id and xn.turn_id = p.turn_id join vn yn on yn.session_id = p.session_id and yn.turn_id = p.past_turn
  join v x on x.session_id = p.session_id and x.turn_id = p.turn_id left join v y on y.session_id = p.session_id and y.turn_id = p.past_turn and y.slot = x.slot group by all),
matches as (select session_id, turn_id, past_turn, similarity from sims where similarity >= least(1, {least} + case when marked then 0 else 0.1 end))"""
CARRIED = "carried as (select *, case when rn = 1 then 'independent' when marked and similarity >= 0.08 then 'strong' when marked or similarity >= 0.18 then 'mixed' else 'weak' end as carryover from s)"


def question_turns(spark: SparkSession, root: str, of: DataFrame | None = None) -> DataFrame:
    """Turns of the eval sessions, or those in ``of``, with hashed vectors of their questions; those without a token have none."""
    turns = eval_turns(spark, root, of).withColumn("key", F.concat_ws("#", "session_id", "turn_id"))
    vectors = index.hashed_vectors(turns, "key", F.col("question"))
    return turns.join(vectors, "key").select("session_id", "turn_id", "vector", sessions.follow_up(F.col("question")).alias("marked"))


def matches(spark: SparkSession, root: str, recent: int = 2, least: float = 0.75, of: DataFrame | None = None) -> DataFrame:
    return memory.matched_turns(question_turns(spark, root, of), recent, least)


@query(f"with {SIGNALS}, {matches_sql(2, 0.75)} select session_id, turn_id, past_turn, round(similarity, 6) as similarity from matches")
def ses_20_matched_turns(spark: SparkSession, root: str) -> DataFrame:
    """Past turns, of the two before each, whose question is similar enough to carry context over."""
    return matches(spark, root).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {SIGNALS}, {matches_sql(2, 0.5)}, {CARRIED}, m as (select session_id, turn_id, max(similarity) as best from matches group by all)
select c.session_id, c.turn_id, case when best is not null and carryover in ('weak', 'independent') then case when marked then 'strong' else 'mixed' end else carryover end as carryover,
round(case when best is not null and carryover in ('weak', 'independent') then greatest(similarity, best) else similarity end, 6) as similarity from carried c left join m on m.session_id = c.session_id and m.turn_id = c.turn_id""")
def ses_08_boosted_carryover(spark: SparkSession, root: str) -> DataFrame:
    carried = sessions.carryover(eval_turns(spark, root))
    return memory.boosted_carryover(carried, matches(spark, root, least=0.5)).withColumn("similarity", F.round("similarity", 6))


@query(f"""with {SIGNALS}, {CARRIED}, q as (select *, array_to_string(list_filter([lag(question, 2) over o, lag(question, 1) over o], lambda x: length(x) > 0), ' ') as context from carried window o as (partition by session_id order by turn_id))
select session_id, turn_id, md5(case when carryover in ('strong', 'mixed') and length(context) > 0 then context || ' ' || question else question end) as digest from q""")
def ses_07_rewritten_query(spark: SparkSession, root: str) -> DataFrame:
    """The retrieval query of each turn: earlier questions before its own where it carries over."""
    return memory.rewritten_query(sessions.carryover(eval_turns(spark, root))).select("session_id", "turn_id", F.md5("query").alias("digest"))


@query(f"""{SEGMENT_FOLD}, h as (select f.*, 'Q' || f.turn_id || ': ' || coalesce(t.question, '') || chr(10) || 'A' || f.turn_id || ': ' || case when length(a) > 400 then left(a, 400) || '...' else a end as line from fold f
join (select *, regexp_replace(regexp_replace(coalesce(answer, ''), '\\[C:[0-9]+\\]', '', 'g'), '^\\s+|\\s+$', '', 'g') as a from turns) t on t.session_id = f.session_id and t.turn_id = f.turn_id),
l as (select *, coalesce(list(line) over (partition by session_id, segment order by turn_id rows between 4 preceding and 1 preceding), []) as lines from h)
select session_id, turn_id, md5(coalesce(array_to_string(case carryover when 'strong' then lines when 'mixed' then lines[greatest(len(lines) - 1, 1):] else [] end, chr(10)), '')) as digest from l""")
def ses_11_visible_history(spark: SparkSession, root: str) -> DataFrame:
    """The history that generation may see at each turn, within its topic segment."""
    turns = eval_turns(spark, root)
    joined = turns.join(sessions.segments(turns), ["session_id", "turn_id"])
    return memory.visible_history(joined).select("session_id", "turn_id", F.md5("history").alias("digest"))


@query(f"with {VECTORS} select a.session_id, a.turn_id, round(sum(pow(0.6, greatest(0, a.turn_id - b.turn_id - 1))), 6) as weight from v a join v b on a.session_id = b.session_id and b.turn_id between a.turn_id - 8 and a.turn_id - 1 group by all")
def ses_12_turn_decay(spark: SparkSession, root: str) -> DataFrame:
    """The weight that the eight turns before each turn have together."""
    turns = vector_turns(spark, root)
    past = F.collect_list("turn_id").over(sessions.before(8))
    weighed = turns.select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), F.transform(past, lambda p: memory.turn_decay(F.col("turn_id") - p)).alias("w"))
    return weighed.where(F.size("w") > 0).select("session_id", "turn_id", F.round(F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 6).alias("weight"))


def _norms(held: int, decay: float, name: str) -> str:
    return f"""{name}_p as (select a.session_id, a.turn_id, pow({decay}, a.turn_id - b.turn_id) as w, b.vector from v a join v b on a.session_id = b.session_id and b.turn_id between a.turn_id - {held - 1} and a.turn_id),
{name}_e as (select session_id, turn_id, w, unnest(vector) as x, generate_subscripts(vector, 1) as i from {name}_p), {name}_s as (select session_id, turn_id, i, sum(w * x) / sum(w) as x from {name}_e group by all),
{name} as (select session_id, turn_id, round(sqrt(sum(x * x)), 5) as norm from {name}_s group by all)"""


@query(f"""with {VECTORS}, {_norms(10, 0.5, 'whole')}, {_norms(2, 0.5, 'top')}, {_norms(8, 0.5, 'summary')}
select f.session_id, f.turn_id, least(f.turn_id + 1, 2) as n_live, least(greatest(f.turn_id - 1, 0), 8) as n_compressed, f.norm as full_norm, t.norm as top_level_norm, s.norm as summary_norm
from whole f join top t using (session_id, turn_id) join summary s using (session_id, turn_id)""")
def ses_15_storage_modes(spark: SparkSession, root: str) -> DataFrame:
    """What the three storage modes hold after each turn, two turns live, and the length of the coarse vector of each."""
    states = memory.stored_turns(vector_turns(spark, root), "full", 2)
    for mode, name in (("full", "full_norm"), ("top_level_only", "top_level_norm"), ("summary_only", "summary_norm")):
        states = memory.stored_state(states, mode, 2).withColumn(name, F.round(norm(F.col("state")), 5)).drop("state")
    return states.select("session_id", *[F.col(c).cast("bigint").alias(c) for c in ("turn_id", "n_live", "n_compressed")], "full_norm", "top_level_norm", "summary_norm")


@query(f"""with {VECTORS}, {_norms(8, 0.5, 'weighted')},
p as (select a.session_id, a.turn_id, exp(list_cosine_similarity(a.vector, b.vector)) as w, b.vector from v a join v b on a.session_id = b.session_id and b.turn_id between a.turn_id - 8 and a.turn_id - 1 union all select session_id, turn_id, 1, vector from v where turn_id = 0),
e as (select session_id, turn_id, w, unnest(vector) as x, generate_subscripts(vector, 1) as i from p), att as (select session_id, turn_id, i, sum(w * x) / sum(w) as x from e group by all),
d as (select session_id, turn_id, 1 - list_cosine_similarity(vector, lag(vector) over (partition by session_id order by turn_id)) as drift from v),
c as (select session_id, turn_id, case when turn_id + 1 <= 3 then 'weighted' else 'attention' end as by_position, case when lag(coalesce(drift, 0)) over (partition by session_id order by turn_id) > 0.5 then 'attention' else 'weighted' end as by_drift, greatest(0, least(1, 0.5 + 0.1 * greatest(0, turn_id + 1 - 3)))::double as alpha from d)
select c.session_id, c.turn_id, by_position, by_drift, round(alpha, 6) as alpha, round(sqrt(sum(pow((1 - alpha) * w.x + alpha * a.x, 2))), 5) as norm from c join weighted_s w on w.session_id = c.session_id and w.turn_id = c.turn_id join att a on a.session_id = c.session_id and a.turn_id = c.turn_id and a.i = w.i group by all""")
def ses_18_dynamic_aggregation(spark: SparkSession, root: str) -> DataFrame:
    """How each turn's state is aggregated by position and by drift, and the hybrid of both means."""
    states = memory.hybrid_state(vector_turns(spark, root))
    return states.select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), "by_position", "by_drift", F.round("alpha", 6).alias("alpha"), F.round(norm(F.col("state")), 5).alias("norm"))


CITED = "cited as (select session_id, turn_id, min(ids) as ids from (select session_id, t.turn_id as turn_id, t.reference_chunk_ids as ids from (select session_id, unnest(turns) as t from eval_sessions)) group by all)"


def cited_chunks(spark: SparkSession, root: str) -> DataFrame:
    turns = table(spark, root, "eval_sessions").select("session_id", F.explode("turns").alias("t"))
    return turns.groupBy("session_id", F.col("t.turn_id").alias("turn_id")).agg(F.min("t.reference_chunk_ids").alias("chunk_ids"))


@query(f"""with {SIGNALS}, {matches_sql(2, 0.3)}, {CITED}, b as (select session_id, turn_id, arg_max(past_turn, (similarity, past_turn)) as past_turn from matches group by all)
select b.session_id, b.turn_id, past_turn, unnest(range(0, least(3, len(ids))::int)) as position, unnest(ids[1:3]) as chunk_id from b join cited c on c.session_id = b.session_id and c.turn_id = b.past_turn""")
def ses_21_pinned_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks that the most similar recent turn refers to, pinned for the next pack."""
    pins = memory.pinned_chunks(matches(spark, root, least=0.3), cited_chunks(spark, root))
    return pins.withColumn("position", F.col("position").cast("bigint"))


def related(spark: SparkSession, root: str, of: DataFrame | None = None) -> DataFrame:
    """Related questions of all sessions, or of those whose ``session_id`` is in ``of``; no session's depend on another's."""
    turns = eval_turns(spark, root, of)
    return memory.related_pairs(matches(spark, root, 8, 0.3, of), sessions.segments(turns), turns)


RELATED = f"""{SEGMENT_FOLD}, {matches_sql(8, 0.3)}, related as (
select m.session_id, m.turn_id, m.past_turn, m.turn_id - m.past_turn as distance, trim(t.question) as question from matches m join fold a on a.session_id = m.session_id and a.turn_id = m.turn_id
join fold b on b.session_id = m.session_id and b.turn_id = m.past_turn and b.segment = a.segment join turns t on t.session_id = m.session_id and t.turn_id = m.past_turn where trim(t.question) <> '' and pow(0.6, greatest(0, m.turn_id - m.past_turn - 1)) >= 0.25)"""


@query(RELATED + " select session_id, turn_id, past_turn, distance, question from related")
def ses_22_related_questions(spark: SparkSession, root: str) -> DataFrame:
    """Similar earlier questions of a turn's own segment that haven't decayed away."""
    return related(spark, root)
