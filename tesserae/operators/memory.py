"""What a session remembers for a turn: similar past turns, visible history, kept vectors and related evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.vectors import added, cosine, scaled
from tesserae.operators.sessions import attention_state, coarse_state, drift

#: A past turn matches from this cosine on, and from so much more for a question without a follow-up marker.
MATCH, UNMARKED = 0.75, 0.1
#: Turns kept live, and how many times as many are kept as compressed history before them.
KEPT, COMPRESSED_TIMES = 8, 4


def turn_decay(distance: Column, decay: float = 0.6) -> Column:
    """``decay`` to the turns of distance beyond the first; a decay outside 0 to 1 counts as the nearer end."""
    return F.pow(F.lit(min(1.0, max(0.0, decay))), F.greatest(F.lit(0), distance - 1).cast("double"))


def matched_turns(turns: DataFrame, recent: int = 2, least: float = MATCH, unmarked: float = UNMARKED) -> DataFrame:
    """``session_id, turn_id, past_turn, similarity`` of each turn's similar turns among the ``recent`` before it.

    ``turns`` has ``session_id, turn_id, vector, marked``. The frame is a fixed number of turns, so nothing grows with a session.
    """
    order = Window.partitionBy("session_id").orderBy("turn_id")
    past = F.array_compact(F.array(*[F.when(F.lag("turn_id", n).over(order).isNotNull(), F.struct(F.lag("turn_id", n).over(order).alias("past_turn"), F.lag("vector", n).over(order).alias("vector"))) for n in range(recent, 0, -1)]))
    found = turns.withColumn("past", past).select("session_id", "turn_id", "vector", "marked", F.explode("past").alias("p"))
    found = found.withColumn("similarity", F.round(cosine(F.col("vector"), F.col("p.vector")), 9))
    return found.where(F.col("similarity") >= F.least(F.lit(1.0), F.lit(least) + F.when(F.col("marked"), 0.0).otherwise(unmarked))).select("session_id", "turn_id", "p.past_turn", "similarity")


def boosted_carryover(carried: DataFrame, matches: DataFrame) -> DataFrame:
    """Raise ``carryover`` of turns with similar past turns: weak and independent ones become strong if marked, else mixed.

    ``carried`` has ``session_id, turn_id, carryover, similarity, marked``; others keep theirs.
    """
    best = matches.groupBy("session_id", "turn_id").agg(F.max("similarity").alias("best"))
    rows = carried.join(best, ["session_id", "turn_id"], "left")
    raised = F.col("best").isNotNull() & F.col("carryover").isin("weak", "independent")
    return rows.select(
        "session_id", "turn_id", F.when(raised & F.col("marked"), "strong").when(raised, "mixed").otherwise(F.col("carryover")).alias("carryover"),
        F.when(raised, F.greatest("similarity", "best")).otherwise(F.col("similarity")).alias("similarity"),
    )


def rewritten_query(carried: DataFrame, recent: int = 2) -> DataFrame:
    """Add ``query``: the last questions before the turn's own if it carries over (strong or mixed), else the question alone."""
    past = Window.partitionBy("session_id").orderBy("turn_id").rowsBetween(-recent, -1)
    context = F.array_join(F.filter(F.collect_list("question").over(past), lambda q: F.length(q) > 0), " ")
    carries = F.col("carryover").isin("strong", "mixed")
    return carried.withColumn("context", context).withColumn("query", F.when(carries & (F.length("context") > 0), F.concat_ws(" ", "context", "question")).otherwise(F.col("question"))).drop("context")


def visible_history(turns: DataFrame, most: int = 4, preview: int = 400) -> DataFrame:
    """Add ``history``: what generation may see of earlier turns of the segment.

    ``turns`` has ``session_id, segment, turn_id, carryover, question, answer``. Weak and independent turns see none, mixed ones two, others ``most`` turns.
    """
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("answer", F.lit("")), r"\[C:\d+\]", ""), r"^\s+|\s+$", "")
    short = F.when(F.length(bare) > preview, F.concat(F.left(bare, F.lit(preview)), F.lit("..."))).otherwise(bare)
    line = F.concat(F.lit("Q"), F.col("turn_id").cast("string"), F.lit(": "), F.coalesce("question", F.lit("")), F.lit("\nA"), F.col("turn_id").cast("string"), F.lit(": "), short)
    past = Window.partitionBy("session_id", "segment").orderBy("turn_id").rowsBetween(-most, -1)
    lines = turns.withColumn("line", line).withColumn("lines", F.collect_list("line").over(past))
    n = F.when(F.col("carryover").isin("weak", "independent"), 0).when(F.col("carryover") == "mixed", min(2, most)).otherwise(most)
    seen = F.slice("lines", F.greatest(F.lit(1), F.size("lines") - n + 1), n)
    return lines.withColumn("history", F.array_join(F.when(n > 0, seen).otherwise(F.array().cast("array<string>")), "\n")).drop("line", "lines")


def stored_turns(turns: DataFrame, mode: str, kept: int = KEPT) -> DataFrame:
    """Add ``n_live`` and ``n_compressed``: how many turns a storage mode holds after each turn.

    ``full`` keeps ``kept`` turns live and pools four times as many before them, ``top_level_only`` drops what overflows, and ``summary_only`` pools every turn.
    """
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id"))
    live = F.least(n, F.lit(kept)) if mode != "summary_only" else F.lit(0)
    pooled = {"full": F.least(F.greatest(n - kept, F.lit(0)), F.lit(kept * COMPRESSED_TIMES)), "top_level_only": F.lit(0), "summary_only": F.least(n, F.lit(kept * COMPRESSED_TIMES))}[mode]
    return turns.withColumn("n_live", live).withColumn("n_compressed", pooled)


def stored_state(turns: DataFrame, mode: str, kept: int = KEPT, decay: float = 0.5, width: int = 64) -> DataFrame:
    """Add ``state``: the coarse vector over all that a storage mode holds, live and pooled."""
    held = {"full": kept * (1 + COMPRESSED_TIMES), "top_level_only": kept, "summary_only": kept * COMPRESSED_TIMES}[mode]
    return coarse_state(turns, held, decay, width)


def chosen_aggregation(turns: DataFrame, until: int = 3, drift_least: float = 0.5, base: float = 0.5, per_turn: float = 0.1) -> DataFrame:
    """Add ``by_position`` and ``by_drift`` (weighted or attention) and ``alpha``, the part of attention in the hybrid, at each turn.

    Drift is the previous turn's, as a turn chooses before its own is known.
    """
    order = Window.partitionBy("session_id").orderBy("turn_id")
    n = F.row_number().over(order)
    rows = drift(turns)
    last = F.lag("drift").over(order)
    return rows.select(
        *turns.columns, F.when(n <= until, "weighted").otherwise("attention").alias("by_position"), F.when(last > drift_least, "attention").otherwise("weighted").alias("by_drift"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + per_turn * F.greatest(F.lit(0), n - until))).alias("alpha"),
    )


def hybrid_state(turns: DataFrame, kept: int = KEPT, decay: float = 0.5, width: int = 64) -> DataFrame:
    """Add ``state``: the weighted mean and the attention mean of past turns, mixed by each turn's ``alpha``."""
    both = attention_state(coarse_state(chosen_aggregation(turns), kept, decay, width).withColumnRenamed("state", "weighted"), kept, width)
    return both.withColumn("state", added(scaled(F.col("weighted"), 1 - F.col("alpha")), scaled(F.col("state"), F.col("alpha")))).drop("weighted")


def pinned_chunks(matches: DataFrame, cited: DataFrame, most: int = 3) -> DataFrame:
    """``session_id, turn_id, past_turn, position, chunk_id``: the first chunks cited by the most similar past turn, ties to the newest.

    ``cited`` has ``session_id, turn_id, chunk_ids``, one row per turn.
    """
    best = matches.groupBy("session_id", "turn_id").agg(F.max(F.struct("similarity", "past_turn")).alias("b")).select("session_id", "turn_id", "b.past_turn")
    past = cited.select("session_id", F.col("turn_id").alias("past_turn"), F.slice("chunk_ids", 1, most).alias("chunk_ids"))
    return best.join(past, ["session_id", "past_turn"]).select("session_id", "turn_id", "past_turn", F.posexplode("chunk_ids").alias("position", "chunk_id"))


def related_pairs(matches: DataFrame, segments: DataFrame, questions: DataFrame, decay: float = 0.6, least: float = 0.25) -> DataFrame:
    """``session_id, turn_id, past_turn, distance, question`` of similar past turns of the turn's own segment that haven't decayed away."""
    own = segments.select("session_id", "turn_id", "segment")
    past = own.select("session_id", F.col("turn_id").alias("past_turn"), F.col("segment").alias("past_segment"))
    asked = questions.select("session_id", F.col("turn_id").alias("past_turn"), F.trim("question").alias("question")).where("question <> ''")
    rows = matches.join(own, ["session_id", "turn_id"]).join(past, ["session_id", "past_turn"]).where("segment = past_segment").join(asked, ["session_id", "past_turn"])
    rows = rows.withColumn("distance", F.col("turn_id") - F.col("past_turn"))
    return rows.where(turn_decay(F.col("distance"), decay) >= least).select("session_id", "turn_id", "past_turn", "distance", "question")


def seen_first(parts: list[DataFrame], key: str) -> DataFrame:
    """``query_id, key, source, position`` of lists one after the other, each key where first seen. Parts have ``query_id, key, ord, source``."""
    every = reduce(DataFrame.unionByName, [p.select("query_id", key, "ord", "source", F.lit(i).alias("phase")) for i, p in enumerate(parts)])
    first = every.groupBy("query_id", key).agg(F.min(F.struct("phase", "ord", "source")).alias("at"))
    return first.select("query_id", key, "at.source", F.row_number().over(Window.partitionBy("query_id").orderBy("at.phase", "at.ord", key)).alias("position"))
