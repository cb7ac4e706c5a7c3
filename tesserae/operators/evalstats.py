"""Evaluation analytics over run logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def delivered_once(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``received_at`` by default) without repeated deliveries: rows equal but for ``received_at`` count once.

    Equality is told by 128 bits of hashes over all columns and their nulls, made where the rows are read, so that only they and the
    columns wanted are shuffled.
    """
    others = [c for c in rows.columns if c != "received_at"]
    keep = others if keep is None else keep
    whole = [F.col(c) for c in others] + [F.col(c).isNull() for c in others]
    keyed = rows.select(F.xxhash64(*whole).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(whole)).alias("_h2"), *keep)
    return keyed.groupBy("_h1", "_h2", *keep).agg(F.count("*").alias("_n")).drop("_h1", "_h2", "_n")


def rate(hit: Column) -> Column:
    """Share of rows where a condition holds; 0 without rows."""
    return F.coalesce(F.count_if(hit) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))


def measured(name: str) -> Column:
    """A metric, or null where it wasn't measured: null, NaN or negative."""
    return F.when(~F.isnan(F.col(name)) & (F.col(name) >= 0), F.col(name))


def true_no_citation(no_citation: Column, refused: Column) -> Column:
    """No citation although the answer is none of the refusals, which need none."""
    return F.coalesce(no_citation, F.lit(False)) & ~F.coalesce(refused, F.lit(False))


def first_per_group(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def value_counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group a map from value to count; for columns of few values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).count()
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(value, "count")))).alias(f"{value}_counts"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], margin: float = 0.15, carry_left: list[str] | None = None, carry_right: list[str] | None = None) -> DataFrame:
    """Two variants' rows side by side with the winner: the higher score, else the lower latency by more than ``margin``.

    Inputs have the keys, ``score`` and ``latency``, one row per key, and the columns to carry along; with several rows per key all of them meet.
    """
    a = left.select(*keys, *(carry_left or []), F.col("score").alias("score_a"), F.col("latency").alias("latency_a"))
    b = right.select(*keys, *(carry_right or []), F.col("score").alias("score_b"), F.col("latency").alias("latency_b"))
    faster = lambda x, y: F.col(x) < F.col(y) * (1 - margin)
    winner = (
        F.when(F.col("score_a") > F.col("score_b"), "a").when(F.col("score_b") > F.col("score_a"), "b")
        .when(faster("latency_a", "latency_b"), "a").when(faster("latency_b", "latency_a"), "b").otherwise("tie")
    )
    return a.join(b, keys).withColumn("winner", winner)


def citation_grade(wrong: Column, cited: Column, wanted: Column, refused: Column) -> Column:
    """WRONG with indices outside the pack, CORRECT_CHUNK with a wanted chunk, ARTICLE_LEVEL with one of the same file, else NO_CITATION without
    citations or for a refusal, else WRONG."""
    same_file = F.arrays_overlap(F.transform(cited, lambda c: F.substring_index(c, "::", 2)), F.transform(wanted, lambda c: F.substring_index(c, "::", 2)))
    return (
        F.when(F.size(wrong) > 0, "WRONG").when(F.arrays_overlap(cited, wanted), "CORRECT_CHUNK").when(same_file, "ARTICLE_LEVEL")
        .when((F.size(cited) == 0) | refused, "NO_CITATION").otherwise("WRONG")
    )


def over_thresholds(stats: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows of statistics that exceed a limit, with the names of the measures that do."""
    over = F.array_compact(F.array(*[F.when(F.col(c) > x, F.lit(c)) for c, x in limits.items()]))
    return stats.withColumn("violations", over).where(F.size("violations") > 0)


def static_check(results: DataFrame, by: str, unanswerable: Column) -> DataFrame:
    """Per group: citation rates over all rows and over the answerable ones, and correct abstentions.

    ``results`` has ``no_citation`` and ``wrong_citation_indices``; rates without rows are 0.
    """
    missing = F.coalesce("no_citation", F.lit(False))
    per = results.withColumn("_u", unanswerable).withColumn("_m", missing).groupBy(by).agg(
        F.count("*").alias("total"), rate(F.col("_m")).alias("no_citation_rate"), F.count_if(F.size("wrong_citation_indices") > 0).alias("wrong_citation_count"),
        F.count_if(F.col("_u") & F.col("_m")).alias("correct_abstains"), F.count_if(~F.col("_u")).alias("answerable_total"), F.count_if(~F.col("_u") & F.col("_m")).alias("answerable_no_cite"),
    )
    return per.withColumn("true_nc_rate", F.coalesce(F.col("answerable_no_cite") / F.nullif("answerable_total", F.lit(0)), F.lit(0.0)))


def rubric_aggregate(scores: DataFrame, by: str, dimensions: dict[str, float]) -> DataFrame:
    """Mean of each rubric dimension, of their sum and of the sum as a share of 100; ``dimensions`` gives each one's highest score, a missing score counts 0."""
    means = scores.groupBy(by).agg(F.count("*").alias("n"), *[(F.sum(F.coalesce(F.col(d), F.lit(0.0))) / F.count("*")).alias(f"{d}_mean") for d in dimensions])
    total = sum((F.col(f"{d}_mean") for d in dimensions), F.lit(0.0))
    top = sum(dimensions.values())
    return means.withColumn("total_mean", total).withColumn("total_100", F.col("total_mean") / top * 100 if top > 0 else F.lit(0.0))


def pattern_recall(packs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, wanted, hits, recall``: the share of an answer's expected patterns that occur in any text of its pack; answers without patterns are left out.

    ``packs`` has ``keys`` and ``text``; ``wanted`` has ``keys`` and the array ``patterns``, one row per answer. Texts of a pack are few.
    """
    asked = wanted.select(*keys, F.explode(F.filter(F.array_distinct("patterns"), lambda p: p != "")).alias("pattern"))
    found = asked.join(packs, keys, "left").groupBy(*keys, "pattern").agg(F.coalesce(F.max(F.contains("text", F.col("pattern"))), F.lit(False)).alias("hit"))
    return found.groupBy(*keys).agg(F.count("*").alias("wanted"), F.count_if("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("wanted"))
