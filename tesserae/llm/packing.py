"""Problem 7: filling containers of fixed capacity.

The plan is made over the histogram of lengths, never over documents: best fit decreasing on counts
gives container patterns, each used as often as the counts allow. Documents then take planned slots by
their rank within their length. The histogram has at most ``capacity`` entries, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import stored

#: Shares in which the documents of one length are ranked; a length may hold a third of all rows.
SALTS = 64


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit decreasing over counts: slots ``(length, first rank, ranks, first container, per container, offset)``.

    A pattern starts with the longest length left and takes, as often as fits, the longest length that
    still fits; it is repeated until one of its lengths has too few items left. Every pattern at least
    halves the count of a length once that is below what one container holds, so there are at most about
    2.5 x capacity patterns of at most sqrt(2 x capacity) lengths, however many items there are.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    taken = np.zeros(capacity + 1, dtype=np.int64)
    slots, containers = [], 0

    def longest(limit: int) -> int:
        path = []
        while limit > 0 and not left[k := int(below[limit])]:
            if k == 0:
                limit = 0
                break
            path.append(limit)
            limit = k - 1
        found = int(below[limit]) if limit > 0 else 0
        for p in path:
            below[p] = found
        return found

    left[0] = 0
    while top := longest(capacity):
        pattern, room, length = [], capacity, top
        while length:
            n = int(min(room // length, left[length]))
            pattern.append((length, n, capacity - room))
            room -= n * length
            length = longest(min(room, length - 1)) if room > 0 else 0
        times = min(int(left[length]) // n for length, n, _ in pattern)
        for length, n, offset in pattern:
            slots.append((length, int(taken[length]), n * times, containers, n, offset))
            taken[length] += n * times
            left[length] -= n * times
        containers += times
    return slots, containers


SLOTS = "container_kind string, capacity int, length int, first bigint, ranks bigint, base bigint, per int, offset int, containers bigint"


def plans(histogram: DataFrame) -> DataFrame:
    """The planned slots of every kind of container; each kind is planned in one task, from a histogram of at most ``capacity`` rows.

    A kind without items of any length has one row of null length, which tells its number of containers.
    """

    def run(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind, capacity = keys
        slots, n = plan({int(k): int(v) for k, v in zip(pdf["length"], pdf["n"], strict=True) if k}, int(capacity))
        rows = [(kind, capacity, *slot, max(n, 1)) for slot in slots] + [(kind, capacity, 0, 0, 0, 0, 1, 0, max(n, 1))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SLOTS.split(", ")])

    return histogram.groupBy("container_kind", "capacity").applyInPandas(run, SLOTS)


def pack(sizes: DataFrame, limits: DataFrame, salts: int = SALTS) -> DataFrame:
    """Assign every document to containers of every kind.

    ``sizes`` has ``doc_id`` and ``n_tokens``; ``limits`` has ``container_kind`` and ``capacity_tokens``.
    Result: ``container_kind, doc_id, piece, n_pieces, n_tokens, container_id, token_offset``. Only a
    document above the capacity is split, into full containers and one rest that is packed like any other.
    Null sizes count as 0; documents of 0 tokens take no room and are spread over the containers. Kinds with
    a null or non-positive capacity are left out; an equal capacity given twice for one kind counts once.

    A length's items are ranked in ``salts`` shares, as a length may be a third of all rows. Counts, offsets of shares
    and the parts of slots that fall into a share are tables that Spark joins; nothing passes through the driver.
    """
    kinds = limits.where("capacity_tokens > 0 and container_kind is not null").select("container_kind", F.col("capacity_tokens").cast("int").alias("capacity")).distinct()
    cells = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), kinds.agg(F.collect_set(F.struct("container_kind", "capacity"))).scalar().alias("kinds"))
    cells = cells.select("doc_id", "n", F.explode("kinds").alias("k")).select("doc_id", "n", "k.*")
    cells = cells.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity"))).cast("int"))
    pieces = cells.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("length", F.least("capacity", F.col("n") - F.col("piece") * F.col("capacity")).cast("int"))
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    length, share = ["container_kind", "capacity", "length"], ["container_kind", "capacity", "length", "salt"]
    pieces = pieces.select(*share, "doc_id", "piece", "n_pieces")

    counts = stored(pieces.groupBy(*share).agg(F.count("*").alias("n")))
    earlier = Window.partitionBy(*length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    slots = stored(plans(counts.groupBy(*length).agg(F.sum("n").alias("n"))))
    # The slots that a share's ranks fall into: those of its length that begin before the share ends and end after it begins.
    slot = F.struct("first", "base", "per", "offset")
    meets = (F.col("first") < F.col("before") + F.col("n")) & (F.col("first") + F.col("ranks") > F.col("before"))
    near = before.where("length > 0").join(slots.where("length > 0").drop("containers"), length).where(meets).groupBy(*share).agg(F.collect_list(slot).alias("slots"))
    containers = slots.where("length = 0").select("container_kind", "capacity", "containers")
    places = stored(before.drop("n").join(near, share, "left").join(containers, ["container_kind", "capacity"]))

    in_share = Window.partitionBy(*share).orderBy("doc_id", "piece")
    ranked = pieces.withColumn("r", F.row_number().over(in_share) - 1).join(places, share).withColumn("rank", F.col("before") + F.col("r"))
    at = F.array_max(F.filter("slots", lambda s: s["first"] <= F.col("rank")))
    found = ranked.withColumn("slot", at)
    own = F.col("rank") - F.col("slot.first")
    return found.select(
        "container_kind", "doc_id", "piece", "n_pieces", F.col("length").alias("n_tokens"),
        F.when(F.col("slot").isNull(), F.col("rank") % F.col("containers")).otherwise(F.col("slot.base") + F.floor(own / F.col("slot.per"))).cast("bigint").alias("container_id"),
        F.when(F.col("slot").isNull(), 0).otherwise(F.col("slot.offset") + own % F.col("slot.per") * F.col("length")).cast("int").alias("token_offset"),
    )


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens held and the share of the room that stays empty."""
    per = packed.groupBy("container_kind").agg(F.max("container_id").alias("last"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_pieces") > 1).alias("split_pieces"))
    room = (F.col("last") + 1) * F.col("capacity_tokens")
    return per.join(limits.dropDuplicates(["container_kind"]), "container_kind").select(
        "container_kind", "capacity_tokens", (F.col("last") + 1).alias("containers"), "tokens", "split_pieces", (1 - F.col("tokens") / room).alias("unused_share"),
    )
