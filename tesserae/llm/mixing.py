"""Problem 8: mixing sources to target weights.

Every source's records stand in a random order, each with its place in the source's token stream; a mix
takes whole passes and a last part of that stream, cut into blocks of equal token length. A
multivariate-hypergeometric splitting tree divides the exact block quotas of all sources among the output
shards, each shard then draws its own permuted blocks and shuffles its records locally.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import stored

SEED = 20
#: Buckets of a source's random order; running totals are taken inside buckets, so that no source is one task's work.
BUCKETS = 1024
BLOCK_TOKENS = 16_384
SHARD_TOKENS = 1_000_000
#: Parts in which the records of one length are ranked, so that a frequent length isn't one task's work.
RANK_SHARES = 64
#: Rounds of the seeded network that permutes a source's blocks.
PERMUTE_ROUNDS = 4


def token_streams(sizes: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Records of ``sizes`` (``source, doc_id, n_tokens``) in random order per source, with ``start`` in its token stream.

    Records of no tokens (null, empty) or without a source add to no share and are left out.
    """
    keyed = sizes.where("n_tokens > 0 and source is not null").select("source", "doc_id", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    keyed = keyed.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    totals = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(totals, ["source", "bucket"]).select("source", "doc_id", "n_tokens", "h", (F.col("offset") + F.col("within")).alias("start"))


def quotas(streams: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens that each mix takes of each source.

    A mix is as large as its total and its scarcest source allow: shares are kept and the size gives way.
    Sources without records have a quota of 0; the shares of the others are scaled to add up to 1. Targets
    with a null mix or source, or a share that isn't positive, are left out; a target given twice counts once.
    """
    stock = streams.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("records"))
    wanted = targets.where("mix_name is not null and source is not null and target_share > 0").dropDuplicates(["mix_name", "source"])
    wanted = wanted.select("mix_name", "source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), "total_tokens")
    both = wanted.join(stock, "source", "left").fillna(0, ["available", "records"])
    mix = Window.partitionBy("mix_name")
    usable = (F.col("available") > 0) & (F.col("max_repeats") > 0)
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(mix)).otherwise(0.0)
    both = both.withColumn("share", share)
    fits = F.min(F.when(usable, F.col("available") * F.col("max_repeats") / F.col("share"))).over(mix)
    size = F.coalesce(F.least(F.min("total_tokens").over(mix).cast("double"), fits), F.lit(0.0))
    both = both.withColumn("quota", F.floor(size * F.col("share") + 1e-6).cast("bigint"))
    both = both.withColumn("passes", F.when(usable, F.least(F.floor(F.col("quota") / F.col("available")), F.col("max_repeats"))).otherwise(0).cast("int"))
    return both.withColumn("rest", F.when(usable, F.col("quota") - F.col("passes") * F.col("available")).otherwise(0).cast("bigint"))


def fill_gap(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one mix and source, how many records of each length close the gap: the longest that still fits, again and again."""
    room, reached, rows = int(pdf["gap"].iloc[0]), int(pdf["reached"].iloc[0]), []
    for n, count in pdf[["n_tokens", "n"]].sort_values("n_tokens", ascending=False).itertuples(index=False):
        take = min(int(count), room // int(n))
        if take:
            rows.append((pdf["mix_name"].iloc[0], pdf["source"].iloc[0], n, take, reached))
            room -= take * int(n)
            reached += take * int(n)
    return pd.DataFrame(rows, columns=["mix_name", "source", "n_tokens", "take", "first_place"])


def fillers_of(spare: DataFrame) -> DataFrame:
    """``mix_name, source, start, place`` of the records that close the gaps.

    ``spare`` has the records that fit into their mix's gap. Only counts per length are gathered, at most as many as the gap has tokens;
    the records are then told by their rank within length, in shares by hash, and shares from which none is taken aren't sorted.
    """
    length = ["mix_name", "source", "n_tokens"]
    spare = spare.withColumn("share", F.pmod("h", F.lit(RANK_SHARES)).cast("int"))
    counts = spare.groupBy(*length, "share", "reached", "gap").agg(F.count("*").alias("n"))
    sums = counts.groupBy(*length, "reached", "gap").agg(F.sum("n").alias("n"))
    takes = stored(sums.groupBy("mix_name", "source").applyInPandas(fill_gap, sums.select(*length, F.lit(0).cast("bigint").alias("take"), F.lit(0).cast("bigint").alias("first_place")).schema))
    before = Window.partitionBy(*length).orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.join(takes, length).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = stored(parts.where("before < take").select(*length, "share", (F.col("take") - F.col("before")).alias("left"), (F.col("first_place") + F.col("before") * F.col("n_tokens")).alias("from_place")))
    ranked = spare.join(parts, [*length, "share"]).withColumn("rank", F.row_number().over(Window.partitionBy(*length, "share").orderBy("h", "start")))
    return ranked.where("rank <= left").select("mix_name", "source", "start", (F.col("from_place") + (F.col("rank") - 1) * F.col("n_tokens")).alias("place"))


def select(streams: DataFrame, quota: DataFrame) -> DataFrame:
    """The records of each mix with ``copies`` and their ``last_start`` in the last part of the stream.

    Of the last part of a source come the records that end within its quota. The first that doesn't may be
    long, so the gap is closed by others: the longest that still fits is taken, of all records, until none does.
    """
    ends = F.col("start") + F.col("n_tokens")
    records = streams.join(quota.select("mix_name", "source", "available", "passes", "rest", "max_repeats", "quota").where("quota > 0"), "source")
    inside = ends <= F.col("rest")
    last = (F.col("rest") > 0) & (F.col("passes") < F.col("max_repeats"))
    reached = records.where(last).groupBy("mix_name", "source", "rest").agg(F.coalesce(F.max(F.when(inside, ends)), F.lit(0)).alias("reached"))
    reached = stored(reached.select("mix_name", "source", "reached", (F.col("rest") - F.col("reached")).alias("gap")))
    spare = records.where(last & ~inside).join(reached, ["mix_name", "source"]).where("n_tokens <= gap")
    fillers = stored(fillers_of(spare.select("mix_name", "source", "n_tokens", "h", "start", "reached", "gap")))
    chosen = records.join(fillers, ["mix_name", "source", "start"], "left")
    extra = (last & (inside | F.col("place").isNotNull())).cast("int")
    chosen = chosen.withColumn("copies", F.col("passes") + extra).where("copies > 0")
    return chosen.select("mix_name", "source", "doc_id", "n_tokens", "h", "copies", "passes", "start", F.coalesce("place", "start").alias("last_start"), "available")


def node_draw(counts: np.ndarray, take: int, *node: object) -> np.ndarray:
    """How many of ``take`` blocks come from each source, without replacement: a multivariate hypergeometric draw, fixed for a tree node."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(node).encode(), digest_size=8).digest(), "big"))
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts):
        rest -= int(n)
        out[i] = rng.hypergeometric(int(n), rest, take) if take else 0
        take -= int(out[i])
    return out


def permuted(at: np.ndarray, size: int, *key: object) -> np.ndarray:
    """Places of ``at`` in a random order of ``range(size)`` that the key fixes, without making the order.

    A Feistel network on the next even number of bits, walked on until it lands below ``size``, is a permutation.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.blake2b(repr(key).encode(), digest_size=8 * PERMUTE_ROUNDS).digest(), dtype=np.uint64)
    out = at.astype(np.uint64)
    todo = np.ones(len(out), dtype=bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (mixed >> np.uint64(32)) & mask
        out[todo] = left << np.uint64(half) | right
        todo = out >= size
    return out.astype(np.int64)


def shard_blocks(quota: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Which blocks go to which shard: ``mix_name, source, block, shard``.

    Each shard walks its own path down the splitting tree; the draw at a node depends on the node alone, so
    all shards agree on it without meeting. Left children take the first part of a source's permuted blocks.
    """
    blocks = F.ceil(F.col("quota") / F.lit(block_tokens)).cast("bigint")
    mixes = quota.where("quota > 0").groupBy("mix_name").agg(
        F.sort_array(F.collect_list(F.struct("source", blocks.alias("blocks")))).alias("parts"),
        F.greatest(F.lit(1), F.round(F.sum("quota") / F.lit(shard_tokens))).cast("bigint").alias("shards"),
    )
    shards = mixes.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).repartition("mix_name", "shard")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for mix, parts, n_shards, shard in zip(pdf["mix_name"], pdf["parts"], pdf["shards"], pdf["shard"], strict=True):
                names = [p["source"] for p in parts]
                whole = np.array([p["blocks"] for p in parts], dtype=np.int64)
                counts, first, lo, hi = whole.copy(), np.zeros_like(whole), 0, int(n_shards)
                while hi - lo > 1:
                    middle = (lo + hi) // 2
                    left = node_draw(counts, int(counts.sum()) * (middle - lo) // (hi - lo), seed, mix, lo, hi)
                    if shard < middle:
                        counts, hi = left, middle
                    else:
                        counts, first, lo = counts - left, first + left, middle
                for name, n, start, total in zip(names, counts, first, whole, strict=True):
                    if n:
                        block = permuted(np.arange(start, start + n), int(total), seed, mix, name)
                        yield pd.DataFrame({"mix_name": mix, "source": name, "block": block, "shard": np.int64(shard)})

    return shards.mapInPandas(walk, "mix_name string, source string, block bigint, shard bigint")


def mix(chosen: DataFrame, blocks: DataFrame, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixed records: ``mix_name, source, doc_id, copy_no, n_tokens, shard, position``.

    A shard holds about ``shard_tokens`` tokens, so its local shuffle is small.
    """
    copies = chosen.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    at = F.col("copy_no") * F.col("available") + F.when(F.col("copy_no") == F.col("passes"), F.col("last_start")).otherwise(F.col("start"))
    copies = copies.withColumn("block", F.floor(at / F.lit(block_tokens)).cast("bigint"))
    drawn = copies.join(blocks, ["mix_name", "source", "block"])
    local = Window.partitionBy("mix_name", "shard").orderBy(F.xxhash64(F.lit(seed), "h", "copy_no", "shard"), "source", "doc_id", "copy_no")
    return drawn.select("mix_name", "source", "doc_id", "copy_no", "n_tokens", "shard", F.row_number().over(local).alias("position"))


def shares(chosen: DataFrame, quota: DataFrame) -> DataFrame:
    """Target and actual share of every source of every mix."""
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records_used"), F.max("copies").alias("most_copies"))
    both = quota.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "records_used", "most_copies"])
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return both.select(
        "mix_name", "source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"),
        "tokens", "quota", "available", "records", "records_used", "most_copies", "max_repeats",
    )
