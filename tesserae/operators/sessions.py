"""Conversation state as windows over turns, and the one fold that no window can express."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import any_of, overlap, text_features
from tesserae.functions.vectors import added, cosine, scaled

# Words that mark a follow-up or a comparison, and what a topic anchor stands before.
FOLLOW_UP = (
    "その", "それ", "これ", "この", "あの", "上記", "前述", "さっき", "先ほど", "先程", "場合", "同じ", "違い", "比較", "続き", "申請では", "必要ですか", "書きますか", "含まれ", "ありますか", "どう", "では？",
    "it", "that", "those", "these", "they", "same", "difference", "compare", "above", "previous",
)
COMPARISON = ("比較", "違い", "違う", "比べ", "差分", "同じ", "異な", "versus", " vs ")
ANCHOR = r"([A-Za-z0-9_\-぀-ヿ㐀-鿿・ー（）()]+?)(?:の(?:概要|対象|必要書類|認定条件)|について|とは)"
ANCHOR_NOISE = ("場合", "それ", "その", "どの", "どんな", "今回", "前回", "申請では", "文書")


def follow_up(question: Column) -> Column:
    return any_of(F.lower(question), FOLLOW_UP)


def comparison(question: Column) -> Column:
    return any_of(F.lower(question), COMPARISON)


def topic_anchors(question: Column) -> Column:
    """Names a question introduces, of 6 characters or more, without noise words or repeats."""
    found = F.transform(F.regexp_extract_all(question, F.lit(ANCHOR), 1), lambda a: F.regexp_replace(a, r"\s", ""))
    noisy = lambda a: F.exists(F.array(*[F.lit(n) for n in ANCHOR_NOISE]), lambda n: F.contains(a, n))
    return F.coalesce(F.array_distinct(F.filter(found, lambda a: (F.length(a) >= 6) & ~noisy(a))), F.array().cast("array<string>"))


def before(k: int) -> Window:
    """The ``k`` turns before a turn of its session."""
    return Window.partitionBy("session_id").orderBy("turn_id").rowsBetween(-k, -1)


def history_text(turns: DataFrame, k: int = 4, preview: int = 400) -> DataFrame:
    """Add ``history``: the last ``k`` turns as numbered questions and answer previews without markers."""
    answer = F.regexp_replace(F.coalesce("answer", F.lit("")), r"\[C:\d+\]", "")
    short = F.when(F.length(answer) > preview, F.concat(F.left(answer, F.lit(preview)), F.lit("..."))).otherwise(answer)
    line = F.concat(F.lit("Q"), F.col("turn_id").cast("string"), F.lit(": "), F.coalesce("question", F.lit("")), F.lit("\nA"), F.col("turn_id").cast("string"), F.lit(": "), short)
    return turns.withColumn("line", line).withColumn("history", F.array_join(F.collect_list("line").over(before(k)), "\n")).drop("line")


def carryover(turns: DataFrame, recent: int = 2) -> DataFrame:
    """Add ``similarity`` to the last questions and ``carryover``: independent, strong, mixed or weak."""
    featured = turns.withColumn("features", text_features(F.col("question")))
    past = F.collect_list("features").over(before(recent))
    similarity = F.coalesce(F.array_max(F.transform(past, lambda p: overlap(F.col("features"), p))), F.lit(0.0))
    marked = follow_up(F.col("question"))
    out = featured.withColumn("n_past", F.size(past)).withColumn("similarity", similarity).withColumn("marked", marked)
    decision = (
        F.when(F.col("n_past") == 0, "independent").when(F.col("marked") & (F.col("similarity") >= 0.08), "strong").when(F.col("marked"), "mixed")
        .when(F.col("similarity") >= 0.18, "mixed").otherwise("weak")
    )
    return out.withColumn("carryover", decision)


def topic_switch(turns: DataFrame, recent: int = 2) -> DataFrame:
    """Add ``switch``: neither marker nor comparison, anchors of its own, and hardly any overlap with any of the last questions."""
    rows = carryover(turns, recent).withColumn("anchors", topic_anchors(F.col("question")))
    rows = rows.withColumn("past", F.collect_list("features").over(before(recent)))
    fresh = F.forall("anchors", lambda a: F.forall("past", lambda p: overlap(text_features(a), p) < 0.08))
    plain = ~F.col("marked") & ~comparison(F.col("question"))
    return rows.withColumn("switch", plain & (F.size("anchors") > 0) & (F.col("similarity") < 0.25) & fresh & (F.col("n_past") > 0)).drop("past")


SEGMENTS = "session_id string, turn_id int, segment int, carryover string"
#: A turn of up to this many features, or of this overlap with its segment's last questions, stays in the segment.
SHORT_TURN, MEMORY_OVERLAP = 24, 0.06


def turn_signals(turns: DataFrame) -> DataFrame:
    """What the segment fold reads of a turn: ``session_id, turn_id, features, marked, anchors``; features are null without a question, anchors are features of each anchor."""
    q = F.col("question")
    anchors = F.when(comparison(q), F.array().cast("array<array<string>>")).otherwise(F.transform(topic_anchors(q), text_features))
    return turns.select("session_id", "turn_id", F.when(F.length(q) > 0, text_features(q)).alias("features"), F.coalesce(follow_up(q), F.lit(False)).alias("marked"), F.coalesce(anchors, F.array().cast("array<array<string>>")).alias("anchors"))


def shared_part(features: set[str], others: list[set[str]]) -> float:
    """The largest part of ``features`` that one of the others has."""
    return max((len(features & o) / len(features) for o in others if features and o), default=0.0)


class Segmenter:
    """The fold over a session's turns: a turn that stays weak starts the next segment.

    A turn is weak without a marker and with little overlap with the session's last questions. Unless it names a topic of its own, it
    stays in the segment all the same if it is short or overlaps with the segment's last questions. Which questions are the segment's depends on the
    segments found so far, so turns are taken in order; only the last questions of the session and of the segment are kept.
    """

    def __init__(self, recent: int = 2, segment: int = 0, seen: bool = False, window: list[set[str]] | None = None, own: list[set[str]] | None = None) -> None:
        self.recent, self.segment, self.seen, self.window, self.own = recent, segment, seen, window or [], own or []

    def take(self, features: set[str] | None, marked: bool, anchors: list[set[str]]) -> tuple[int, str]:
        """The turn's segment and how it carries over from it."""
        told = features or set()

        def switches(past: list[set[str]]) -> bool:
            return bool(past and anchors) and not marked and shared_part(told, past) < 0.25 and all(shared_part(a, past) < 0.08 for a in anchors)

        def mode(past: list[set[str]]) -> str:
            best = shared_part(told, past)
            if marked:
                return "strong" if best >= 0.08 else "mixed"
            return "mixed" if best >= 0.18 else "weak"

        def remembered() -> bool:
            past = self.own or self.window
            near = marked or len(told) <= SHORT_TURN or shared_part(told, past) >= MEMORY_OVERLAP
            return bool(past) and not switches(self.window) and not switches(past) and near

        if not self.seen:
            kind = "independent"
        elif mode(self.window) == "weak" and not remembered():
            kind = "weak"
            self.segment, self.own = self.segment + 1, []
        else:
            kind = mode(self.own)
            kind = "mixed" if kind == "weak" and remembered() else kind
        self.seen = True
        if features is not None:
            self.window, self.own = [*self.window, told][-self.recent :], [*self.own, told][-self.recent :]
        return self.segment, kind


def segments(turns: DataFrame, recent: int = 2) -> DataFrame:
    """``session_id, turn_id, segment, carryover`` of every turn.

    Turns are sorted by session within partitions and folded batch by batch, so that even a session of very many turns is never held as a whole.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = object(), Segmenter(recent)
        for pdf in frames:
            out = []
            for key, turn, features, marked, anchors in pdf.itertuples(index=False):
                if key != session:
                    session, state = key, Segmenter(recent)
                out.append((key, turn, *state.take(None if features is None else set(features), bool(marked), [set(a) for a in anchors])))
            yield pd.DataFrame(out, columns=["session_id", "turn_id", "segment", "carryover"])

    return turn_signals(turns).repartition("session_id").sortWithinPartitions("session_id", "turn_id").mapInPandas(fold, SEGMENTS)


def drift(turns: DataFrame) -> DataFrame:
    """Add ``drift``: cosine distance of a turn's vector from the previous turn's, 0 at the first."""
    order = Window.partitionBy("session_id").orderBy("turn_id")
    last = F.lag("vector").over(order)
    return turns.withColumn("drift", F.when(last.isNull(), 0.0).otherwise(1 - cosine(F.col("vector"), last)))


def drift_badge(x: Column, threshold: float) -> Column:
    return F.when(x > threshold, "alert").when(x > 0.8 * threshold, "warn").otherwise("ok")


def coarse_state(turns: DataFrame, turns_kept: int = 8, decay: float = 0.7, width: int = 64) -> DataFrame:
    """Add ``state``: the mean of the last turns' vectors, weighted by ``decay`` to the turns of distance."""
    frame = Window.partitionBy("session_id").orderBy("turn_id").rowsBetween(-(turns_kept - 1), 0)
    past = F.collect_list("vector").over(frame)
    n = F.size(past)
    weights = F.transform(past, lambda v, i: F.pow(F.lit(decay), (n - i - 1).cast("double")))
    zero = F.array_repeat(F.lit(0.0), width)
    total = F.aggregate(F.zip_with(past, weights, lambda v, w: scaled(v, w)), zero, lambda s, v: added(s, v))
    size = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return turns.withColumn("past", past).withColumn("state", scaled(total, 1 / size)).drop("past")


def attention_state(turns: DataFrame, turns_kept: int = 8, width: int = 64) -> DataFrame:
    """Add ``state``: the past turns' vectors weighted by the softmax of their cosine with the turn's; its own vector without a past."""
    frame = Window.partitionBy("session_id").orderBy("turn_id").rowsBetween(-turns_kept, -1)
    rows = turns.withColumn("past", F.collect_list("vector").over(frame))
    rows = rows.withColumn("weights", F.transform("past", lambda v: F.exp(cosine(F.col("vector"), v))))
    total = F.aggregate("weights", F.lit(0.0), lambda s, w: s + w)
    mixed = F.aggregate(F.zip_with("past", "weights", lambda v, w: scaled(v, w)), F.array_repeat(F.lit(0.0), width), lambda s, v: added(s, v))
    own = F.transform("vector", lambda x: x.cast("double"))
    return rows.withColumn("state", F.when(F.size("past") > 0, scaled(mixed, 1 / total)).otherwise(own)).drop("past", "weights")


def relevant_past(turns: DataFrame, turns_kept: int = 8, least: float = 0.7) -> DataFrame:
    """``session_id, turn_id, past_turn, similarity``: the most similar of the turns kept, from a similarity on, ties to the newest."""
    frame = Window.partitionBy("session_id").orderBy("turn_id").rowsBetween(-turns_kept, -1)
    rows = turns.withColumn("past", F.collect_list(F.struct("turn_id", "vector")).over(frame))
    best = F.array_max(F.transform("past", lambda p: F.struct(F.round(cosine(F.col("vector"), p["vector"]), 9).alias("similarity"), p["turn_id"].alias("past_turn"))))
    return rows.withColumn("best", best).where(F.col("best.similarity") >= least).select("session_id", "turn_id", "best.past_turn", "best.similarity")


def cumulative_citations(results: DataFrame) -> DataFrame:
    """``run_label, session_id, turn_id, distinct_citations``: chunks that a run has cited in a session up to each of its turns.

    ``results`` has the keys and ``cited``, with any number of rows per turn. A chunk counts at its earliest turn, so a running sum is all that is kept of a session.
    """
    keys = ["run_label", "session_id", "turn_id"]
    first = results.select(*keys, F.explode("cited").alias("chunk")).groupBy("run_label", "session_id", "chunk").agg(F.min("turn_id").alias("turn_id"))
    fresh = results.select(*keys, F.lit(0).alias("n")).unionByName(first.select(*keys, F.lit(1).alias("n"))).groupBy(*keys).agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy("run_label", "session_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    return fresh.select(*keys, F.sum("n").over(so_far).alias("distinct_citations"))
