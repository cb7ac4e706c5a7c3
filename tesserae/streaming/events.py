"""Streaming versions: windowed log rates with late data, and topic segments with state per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tesserae.operators.sessions import SEGMENTS, Segmenter, turn_signals


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, errors and mean value per window; rows later than the watermark allows are dropped, as Spark does on streams only."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", window))
    out = per.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("value").alias("value"))
    return out.select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("window_start"), "events", "errors", F.round("value", 4).alias("value"))


STATE = "segment int, window array<array<string>>, own array<array<string>>"


def streamed_segments(turns: DataFrame, recent: int = 2) -> DataFrame:
    """Topic segments of a stream of turns that comes in order per session; the state is the fold's own, the last questions of session and segment."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, window, own = state.get if state.exists else (0, [], [])
        fold = Segmenter(recent, segment, state.exists, [set(w) for w in window], [set(w) for w in own])
        pdf = pd.concat(list(frames)).sort_values("turn_id", kind="stable")
        rows = zip(pdf["turn_id"], pdf["features"], pdf["marked"], pdf["anchors"], strict=True)
        out = [(key[0], int(t), *fold.take(None if f is None else set(f), bool(m), [set(a) for a in anchors])) for t, f, m, anchors in rows]
        state.update((fold.segment, [sorted(w) for w in fold.window], [sorted(w) for w in fold.own]))
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "segment", "carryover"])

    return turn_signals(turns).groupBy("session_id").applyInPandasWithState(step, SEGMENTS, STATE, "append", GroupStateTimeout.NoTimeout)
