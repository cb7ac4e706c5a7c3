"""Problem 4: percentiles with bounded rank error from digests that can be merged.

A digest is a list of centroids (mean, weight). Sorted values are clustered under the arcsine size
function, which keeps clusters at the tails small and the middle ones at most ``1/delta`` wide or so;
digests merge by clustering their centroids again. Every partition makes its own digests, so the rows
themselves are never shuffled for this; a second pass counts the rows below and up to every estimate,
which certifies the rank error actually reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.9, 0.95, 0.99)
METRICS = ("latency_ms", "retrieval_ms", "generation_ms", "memory_peak_mb")
#: Clusters of a digest at most. The arcsine size function gives a cluster at quantile q a share of at
#: most pi * sqrt(q * (1 - q)) / DELTA: 0.8 % of the rows in the middle, 0.16 % at p99.
DELTA = 200
#: The stated bound on the rank error of each estimate; the counting pass reports those within it.
RANK_ERROR = 0.01


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: int = DELTA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster the weighted values of every group; arrays must be ordered by group, then by value.

    A value belongs to the cluster of its middle rank under ``delta * asin(2q - 1) / pi``; heavy
    centroids therefore stay apart, and groups with few values keep each as it is.
    """
    if not len(mean):
        return group, mean, weight
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, len(group)])
    total = np.add.reduceat(weight, first)
    ends = np.cumsum(weight)
    before = np.repeat(ends[first] - weight[first], sizes)
    middle = (ends - before - weight / 2) / np.repeat(total, sizes)
    bucket = np.floor(delta * (np.arcsin(np.clip(2 * middle - 1, -1, 1)) / np.pi + 0.5))
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (bucket[1:] != bucket[:-1])])
    weights = np.add.reduceat(weight, starts)
    sums = np.add.reduceat(mean * weight, starts)
    return group[starts], sums / weights, weights


def estimate(mean: np.ndarray, weight: np.ndarray, q: float) -> float:
    """Value at quantile ``q`` of one digest.

    Single values are met exactly (the lowest value with a share of at least q below or at it); within a
    cluster of more the value is interpolated towards the neighbours.
    """
    ends = np.cumsum(weight)
    rank = q * ends[-1]
    k = min(int(np.searchsorted(ends, rank - 1e-9 * ends[-1])), len(mean) - 1)
    if weight[k] <= 1 or len(mean) == 1:
        return float(mean[k])
    lo = (mean[k - 1] + mean[k]) / 2 if k else mean[k]
    hi = (mean[k] + mean[k + 1]) / 2 if k + 1 < len(mean) else mean[k]
    share = (rank - (ends[k] - weight[k])) / weight[k]
    return float(lo + (mean[k] - lo) * share * 2) if share < 0.5 else float(mean[k] + (hi - mean[k]) * (share * 2 - 1))


def measured(name: str) -> Column:
    """The metric, or null where it was not measured: null, NaN, infinite or negative."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x) & (x >= 0) & (x < float("inf")), x)


def digests(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, delta: int = DELTA) -> DataFrame:
    """One digest per ``keys`` and metric: keys, ``metric``, ``n``, ``means``, ``weights``.

    Partitions make digests of their own rows, so a hot group sends at most ``delta + 1`` centroids per
    partition. Nulls in keys form groups of their own; groups without a measured value have no row.
    """
    wide = rows.select(*keys, *[measured(m).alias(m) for m in metrics])

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _merged_batches(frames):
            code, index = _codes(pdf, keys)
            for metric in metrics:
                x = pdf[metric].to_numpy(dtype=float, na_value=np.nan)
                kept = np.flatnonzero(~np.isnan(x))
                order = kept[np.lexsort((x[kept], code[kept]))]
                yield _rows(index.assign(metric=metric), *cluster(code[order], x[order], np.ones(len(order)), delta))

    return merge_digests(wide.mapInPandas(partial, _schema(rows, keys)), keys, delta)


def merge_digests(parts: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """Merge digests (of partitions, days or runs) into groups ``keys``, without the rows they came from.

    Digests are shuffled and sorted by group and clustered again, many groups in one vectorised step; of
    a group that goes on in the next batch the merged digest is carried over, so memory stays bounded.
    """
    by = [*keys, "metric"]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            code, index = _codes(pdf, by)
            sizes = pdf["means"].map(len).to_numpy()
            g, mean, weight = np.repeat(code, sizes), np.concatenate(pdf["means"].to_list()), np.concatenate(pdf["weights"].to_list())
            order = np.lexsort((mean, g))
            merged = _rows(index, *cluster(g[order], mean[order], weight[order], delta))
            held = merged.iloc[[-1]]
            yield merged.iloc[:-1]
        if held is not None:
            yield held

    kinds = _schema(parts, keys)
    sorted_parts = parts.select(*by, "means", "weights").repartition(*by).sortWithinPartitions(*by)
    whole = sorted_parts.mapInPandas(merge, kinds)
    return whole.select(*by, F.aggregate("weights", F.lit(0.0), lambda a, w: a + w).cast("bigint").alias("n"), "means", "weights")


def _schema(rows: DataFrame, keys: list[str]) -> str:
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    return f"{kinds}metric string, means array<double>, weights array<double>"


def _merged_batches(frames: Iterator[pd.DataFrame], rows: int = 200_000) -> Iterator[pd.DataFrame]:
    """Batches put together, so that a partition yields few digests and a task holds a bounded number of rows."""
    held, n = [], 0
    for pdf in frames:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _codes(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, pd.DataFrame]:
    grouped = pdf.groupby(keys, dropna=False, sort=False)
    code = grouped.ngroup().to_numpy()
    first = np.unique(code, return_index=True)[1]
    return code, pdf[keys].iloc[first].reset_index(drop=True)


def _rows(index: pd.DataFrame, g: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> pd.DataFrame:
    groups, starts = np.unique(g, return_index=True)
    out = index.iloc[groups].reset_index(drop=True)
    out["means"] = pd.Series(np.split(mean, starts[1:]) if len(groups) else [], dtype=object)
    out["weights"] = pd.Series(np.split(weight, starts[1:]) if len(groups) else [], dtype=object)
    return out


def quantiles(parts: DataFrame, keys: list[str], qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Estimates from digests: keys, ``metric``, ``n`` and an array ``estimates`` in the order of ``qs``."""

    @F.pandas_udf("array<double>")
    def values(means: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([[estimate(np.asarray(m), np.asarray(w), q) for q in qs] for m, w in zip(means, weights, strict=True)])

    return parts.select(*keys, "metric", "n", values("means", "weights").alias("estimates"))


def certify(rows: DataFrame, found: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, qs: tuple[float, ...] = QUANTILES, bound: float = RANK_ERROR, salts: int = 8) -> DataFrame:
    """The second pass: count rows below and up to each estimate, one result row per group, metric and quantile.

    ``rank_error`` is how far q lies outside the ranks that the estimate takes among the rows, as a share
    of them; ``certified`` is ``rank_error <= bound``, with one row's share as slack for groups so small that
    a row weighs more than the bound. Estimates are few per row and join on the group; the rows of a group
    are spread over ``salts`` copies of its estimates. The join keys treat null as a value.
    """
    per_group = found.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first("estimates"))
    per_group = per_group.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], *[F.col(m).alias(f"e_{m}") for m in metrics])
    per_group = per_group.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    wide = rows.select(*[F.col(k).alias(f"r_{i}") for i, k in enumerate(keys)], *[measured(m).alias(m) for m in metrics])
    wide = wide.withColumn("salt_", F.pmod(F.xxhash64(*metrics), F.lit(salts)).cast("int"))
    on = F.col("salt") == F.col("salt_")
    for i in range(len(keys)):
        on &= F.col(f"k_{i}").eqNullSafe(F.col(f"r_{i}"))
    counts = []
    for m in metrics:
        for i in range(len(qs)):
            e = F.col(f"e_{m}")[i]
            counts += [F.count_if(F.col(m) < e).alias(f"lt_{m}_{i}"), F.count_if(F.col(m) <= e).alias(f"le_{m}_{i}")]
    counted = wide.join(per_group, on).groupBy(*[F.col(f"k_{i}") for i in range(len(keys))]).agg(*counts)
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(i).alias("i"), F.col(f"lt_{m}_{i}").alias("n_below"), F.col(f"le_{m}_{i}").alias("n_upto"))
        for m in metrics for i in range(len(qs))
    ]))
    cells = counted.select(*[F.col(f"k_{i}") for i in range(len(keys))], cells.alias("cell")).select("*", "cell.*").drop("cell").withColumnRenamed("metric", "m_")
    join = F.col("metric") == F.col("m_")
    for i, k in enumerate(keys):
        join &= F.col(k).eqNullSafe(F.col(f"k_{i}"))
    both = found.join(cells, join)
    q = F.element_at(F.array(*[F.lit(x) for x in qs]), F.col("i") + 1)
    error = F.greatest(F.lit(0.0), q - F.col("n_upto") / F.col("n"), F.col("n_below") / F.col("n") - q)
    return both.select(
        *keys, "metric", q.alias("q"), F.element_at("estimates", F.col("i") + 1).alias("value"), "n", "n_below", "n_upto",
        error.alias("rank_error"), (error <= F.greatest(F.lit(bound), 1 / F.col("n"))).alias("certified"),
    )


def with_day(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("day", F.to_date("logged_at"))
