"""Deterministic sampling, splits, allocation and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import stored


def hash_key(*columns: str, seed: int = 0) -> Column:
    """A fixed pseudo-random order: the MD5 of the seed and the columns, the same in other engines."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum; Spark limits each task's rows before the shuffle."""
    order = Window.partitionBy(stratum).orderBy(hash_key(key, seed=seed), key)
    return rows.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def split(rows: DataFrame, key: str, share: float, seed: int = 0) -> DataFrame:
    """Add ``part``: ``val`` for the ``max(1, floor(n * share))`` rows lowest in hash order, else ``train``.

    The cut is found from counts of hash prefixes, and only the prefix it falls into is ranked, so no task sorts all rows.
    """
    keyed = rows.withColumn("_h", hash_key(key, seed=seed)).withColumn("_p", F.substring("_h", 1, 3))
    counts = keyed.groupBy("_p").count()
    running = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_p", "count", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy(F.lit(1))).alias("_n"))  # at most 4096 rows
    placed = keyed.join(F.broadcast(counts), "_p")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
    limit = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    return placed.withColumn("part", F.when(rank <= limit, "val").otherwise("train")).drop("_h", "_p", "count", "_before", "_n")


def group_ranks(rows: DataFrame, by: list[str], order: list[str], ranges: int = 256) -> DataFrame:
    """Add ``rank`` (from 1, in the columns' order) and ``n`` within each group, however large one is.

    Rows are cut into ranges of the order, stored, and counted per group and range; a row's rank is the count of the ranges before plus its rank
    inside its range, so a group of a third of all rows is spread over all ranges. Null groups are groups.
    """
    ranged = stored(rows.withColumn("_g", F.struct(*by)).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    per = ranged.groupBy("_g", "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_g", "_range", before.alias("_before"), F.sum("_n").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy("_g", "_range").orderBy(*order))
    return ranged.withColumn("_r", inside).join(per, ["_g", "_range"]).withColumn("rank", F.col("_before") + F.col("_r")).drop("_g", "_range", "_before", "_r")


def full_batches(rows: DataFrame, by: str, key: str, size: int) -> DataFrame:
    """Add ``batch`` per group in hash order, dropping the rows of a batch that isn't full: the operator's purpose."""
    placed = group_ranks(rows.withColumn("_h", hash_key(key)), [by], ["_h", key])
    return placed.where(F.col("rank") <= F.floor(F.col("n") / size) * size).withColumn("batch", F.floor((F.col("rank") - 1) / size)).drop("rank", "n", "_h")


def allocation(weights: DataFrame, n: int, name: str, weight: str) -> DataFrame:
    """``n`` scenarios by weight, rounded half to even; the first takes what is missing and a surplus goes from the end."""
    order = Window.orderBy(name)
    shares = weights.select(name, F.bround(F.lit(float(n)) * F.col(weight) / F.sum(weight).over(Window.partitionBy(F.lit(1))), 0).cast("bigint").alias("want"))
    upto = F.sum("want").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = shares.withColumn("upto", upto).withColumn("all", F.sum("want").over(Window.partitionBy(F.lit(1))))
    first = F.row_number().over(order) == 1
    got = F.greatest(F.lit(0), F.least(F.col("want"), n - (F.col("upto") - F.col("want"))))
    return kept.select(name, (got + F.when(first, F.greatest(F.lit(0), n - F.col("all"))).otherwise(0)).alias("scenarios"))


def grid(axes: dict[str, list], spark) -> DataFrame:
    """Every combination of an axis's values, for parameter searches; as large as the axes say, whatever the data."""
    rows = spark.range(1).select()
    for name, values in axes.items():
        rows = rows.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return rows


def neighbours(seeds: DataFrame, steps: dict[str, list]) -> DataFrame:
    """Settings one step from the seeds on one axis, without the seeds."""
    moves = [F.array(*[F.struct(*[(F.col(c) + F.lit(s) if c == axis else F.col(c)).alias(c) for c in seeds.columns]) for s in values]) for axis, values in steps.items()]
    moved = seeds.select(F.explode(F.concat(*moves)).alias("m")).select("m.*").distinct()
    return moved.join(seeds, seeds.columns, "left_anti")


def weighted_mix(rows: DataFrame, pool: str, key: str, weights: dict[str, float], val_share: float = 0.0, seed: int = 0) -> DataFrame:
    """Rows of weighted pools in one order, with ``place`` and ``part``: as many of each pool as its weight of the total allows, where the total is what the scarcest pool allows.

    Rows are taken in hash order; the last ``val_share`` of the whole order are ``val``, the others ``train``. Weights must be positive and add up to 1.
    A pool without rows leaves the mix empty. Rows of other pools are left out.
    """
    if not weights or abs(sum(weights.values()) - 1) > 1e-6 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive and add up to 1")
    pools = rows.sparkSession.createDataFrame(list(weights.items()), f"{pool} string, _w double")
    counted = group_ranks(rows.join(F.broadcast(pools), pool).withColumn("_h", hash_key(key, seed=seed)), [pool], ["_h", key]).drop("_h")  # weights: given with the call
    sizes = pools.join(counted.groupBy(pool).agg(F.first("n").alias("_n")), pool, "left")
    total = sizes.agg(F.min(F.floor(F.coalesce("_n", F.lit(0)) / F.col("_w") + 1e-9)).alias("_total"))
    taken = counted.join(F.broadcast(total)).where(F.col("rank") <= F.floor(F.col("_total") * F.col("_w") + 1e-9)).drop("rank", "n", "_w", "_total")  # one row
    mixed = group_ranks(taken.withColumn("_h", hash_key(key, seed=seed + 1)).withColumn("_all", F.lit(0)), ["_all"], ["_h", key]).drop("_h", "_all")
    return mixed.withColumn("part", F.when(F.col("rank") > F.col("n") - F.floor(F.col("n") * val_share), "val").otherwise("train")).withColumnRenamed("rank", "place").drop("n")


def category_picks(index: DataFrame, categories: dict[str, tuple[str, ...]], key: str, n: int, seed: int = 0) -> DataFrame:
    """``category, key, pick``: up to ``n`` documents for each category, in hash order.

    A category names flags: the first is required, each further one only where some document with the flags before it has it too.
    """
    parts = []
    for name, flags in categories.items():
        pool = index.withColumn("category", F.lit(name)).withColumn("_h", hash_key("category", key, seed=seed))
        for i, flag in enumerate(flags):
            if i:
                some = pool.agg(F.coalesce(F.max(F.col(flag)), F.lit(False)).alias("_some"))
                pool = pool.join(F.broadcast(some)).where(F.col(flag) | ~F.col("_some")).drop("_some")  # one row
            else:
                pool = pool.where(F.col(flag))
        parts.append(pool.select("category", key, "_h"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = Window.partitionBy("category").orderBy("_h", key)
    return every.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n).drop("_h")


def token_faults(lines: DataFrame, key: str, tokens: str, vocabulary: int, most: int) -> DataFrame:
    """``key, n_tokens, fault`` of lines of token ids that can't be trained on: ``empty``, ``too_long`` or ``out_of_range``, the first that applies. Null ids are out of range."""
    t = F.col(tokens)
    fault = F.when(t.isNull() | (F.size(t) == 0), "empty").when(F.size(t) > most, "too_long").when(F.exists(t, lambda x: x.isNull() | (x < 0) | (x >= vocabulary)), "out_of_range")
    return lines.select(key, F.coalesce(F.greatest(F.size(t), F.lit(0)), F.lit(0)).alias("n_tokens"), fault.alias("fault")).where("fault is not null")


def chosen_variants(rows: DataFrame, variant: str, wanted: str) -> DataFrame:
    """The rows of the variants in a list with commas, with ``position`` in it; an unknown variant is an error when the rows are read."""
    names = [w.strip() for w in wanted.split(",") if w.strip()]
    asked = rows.sparkSession.createDataFrame([(w, i) for i, w in enumerate(dict.fromkeys(names))], f"{variant} string, position int")
    known = rows.select(variant).distinct().withColumn("_known", F.lit(True))
    checked = asked.join(known, variant, "left").select(variant, F.when(F.col("_known"), F.col("position")).otherwise(F.raise_error(F.concat(F.lit("unknown variant "), F.col(variant))).cast("int")).alias("position"))
    return rows.join(F.broadcast(checked), variant)  # as long as the list given
