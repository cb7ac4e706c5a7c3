"""Exact percentiles per group without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of the percentile definitions: the position among n sorted values, counted from 0.
POSITIONS = {
    "linear": lambda q, n: q * (n - 1),
    "nearest_rank": lambda q, n: F.greatest(F.ceil(q * n) - 1, F.lit(0)),
    "even_index": lambda q, n: F.bround(q * (n - 1), 0),
    "upper_median": lambda q, n: F.floor(n / 2),
    "round_rank": lambda q, n: F.greatest(F.bround(q * n, 0) - 1, F.lit(0)),
    "floor_index": lambda q, n: F.floor(q * (n - 1)),
}


def value_bucket(x: Column) -> Column:
    """A bucket number that grows with the value, about 6 % wide."""
    return F.floor(F.signum(x) * F.ln(1 + F.abs(x)) * 16).cast("int")


def percentiles(rows: DataFrame, keys: list[str], value: str, asked: dict[str, tuple[float, str]]) -> DataFrame:
    """One row per group with a column for each of ``asked``: name to (quantile, definition in POSITIONS).

    Nulls and NaN are left out; a group without values has no row; nulls in keys form groups. Equal values are counted first,
    then the buckets of value ranges, and only the buckets that hold a wanted position are sorted.
    """
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(1).alias("all"))
    x = F.col(value).cast("double")
    cells = rows.select(group.alias("g"), x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    cells = cells.groupBy("g", "x").count().withColumn("bucket", value_bucket(F.col("x")))
    buckets = cells.groupBy("g", "bucket").agg(F.sum("count").alias("n"))
    order = Window.partitionBy("g").orderBy("bucket")
    buckets = buckets.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = buckets.withColumn("total", F.sum("n").over(Window.partitionBy("g")))
    wants = []
    for name, (q, method) in asked.items():
        at = POSITIONS[method](F.lit(q), F.col("total")).cast("double")
        low = F.floor(at + 1e-9)
        share = at - low
        wants.append(F.struct(F.lit(name).alias("name"), low.alias("k"), (1 - share).alias("share")))
        if method == "linear":
            wants.append(F.struct(F.lit(name).alias("name"), F.least(low + 1, F.col("total") - 1).alias("k"), share.alias("share")))
    picks = buckets.select("g", "bucket", "before", "n", F.explode(F.array(*wants)).alias("w"))
    picks = picks.where((F.col("w.k") >= F.col("before")) & (F.col("w.k") < F.col("before") + F.col("n")))
    picks = picks.select("g", "bucket", "w.name", "w.share", (F.col("w.k") - F.col("before")).alias("k"))
    inside = picks.groupBy("g", "bucket").agg(F.collect_list(F.struct("name", "share", "k")).alias("wanted"))
    run = Window.partitionBy("g", "bucket").orderBy("x")
    sorted_cells = cells.join(inside, ["g", "bucket"]).withColumn("upto", F.sum("count").over(run))
    hits = sorted_cells.select("g", "x", "count", "upto", F.explode("wanted").alias("w")).where("w.k < upto and w.k >= upto - `count`")
    found = hits.groupBy("g").pivot("w.name", list(asked)).agg(F.sum(F.col("x") * F.col("w.share")))
    return found.select(*[F.col(f"g.{k}").alias(k) for k in keys], *asked)
