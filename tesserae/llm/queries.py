"""The p-queries: each problem's operator over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import conversations, lookalike, mixing, packing, pairs, percentiles, provenance, reading, tokens, validity
from tesserae.sources.tables import cut, stored, table

GROUP = ["repo_id", "variant_name", "day"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Defective pairs of question and answer."""
    both = cut(pairs.question_pairs(table(spark, root, "eval_sessions"), table(spark, root, "query_results")))
    return pairs.defects(both, pairs.fit(both))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that aren't hand-written."""
    return provenance.not_handwritten(table(spark, root, "source_files")).select("file_id")


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    """Files left out and kept per repository, by rule."""
    files = table(spark, root, "source_files")
    return provenance.repository_report(files, provenance.not_handwritten(files))


def p2_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of hand-written files."""
    files, chunks = table(spark, root, "source_files"), table(spark, root, "chunks")
    return provenance.handwritten_chunks(chunks, files, provenance.not_handwritten(files)).select("chunk_no", "repo_id", "rel_path")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Conversations to drop."""
    return conversations.dropped(table(spark, root, "predictions")).select("session_id")


def p3_messages(spark: SparkSession, root: str) -> DataFrame:
    """Ordered messages of the sound conversations."""
    return conversations.ordered_messages(table(spark, root, "predictions"))


def p3_dropped(spark: SparkSession, root: str) -> DataFrame:
    """The conversations dropped, each with its first defect."""
    return conversations.dropped(table(spark, root, "predictions"))


def p4_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Certified percentiles per repository, variant and day."""
    rows = percentiles.with_day(table(spark, root, "predictions"))
    found = cut(percentiles.quantiles(percentiles.digests(rows, GROUP), GROUP))
    return percentiles.certify(rows, found, GROUP)


def p4_repo_rollup(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles per repository over all days and variants, merged from the daily digests alone."""
    rows = percentiles.with_day(table(spark, root, "predictions"))
    found = percentiles.quantiles(percentiles.merge_digests(percentiles.digests(rows, GROUP), ["repo_id"]), ["repo_id"])
    return percentiles.certify(rows, cut(found), ["repo_id"])


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Files that don't parse."""
    return validity.invalid(validity.checked(table(spark, root, "source_files"))).select("file_id")


def p5_rates(spark: SparkSession, root: str) -> DataFrame:
    """Invalid files per repository and language."""
    return validity.rates(validity.checked(table(spark, root, "source_files")))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of texts that differ as stored and look the same."""
    return lookalike.same_look_pairs(lookalike.text_fields(table(spark, root, "query_results"), table(spark, root, "chunks")))


def p6_classes(spark: SparkSession, root: str) -> DataFrame:
    """Classes of texts that look the same, with a representative each."""
    return lookalike.same_look_classes(lookalike.text_fields(table(spark, root, "query_results"), table(spark, root, "chunks")))


def p6_canonical(spark: SparkSession, root: str) -> DataFrame:
    """The consistent form of every text of the three fields."""
    texts = lookalike.text_fields(table(spark, root, "query_results"), table(spark, root, "chunks"))
    return lookalike.canonical(texts).select("field", "scope", "key", "canon", "visible")


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """Every document's place in containers of each kind."""
    sizes = stored(tokens.with_token_counts(table(spark, root, "documents"), ["doc_id"]))
    return packing.pack(sizes, table(spark, root, "pack_limits"))


def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """Containers used and room left empty per kind."""
    return packing.fill_report(p7_containers(spark, root), table(spark, root, "pack_limits"))


def _mix_parts(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    sizes = stored(tokens.with_token_counts(table(spark, root, "documents"), ["source", "doc_id"]))
    streams = stored(mixing.token_streams(sizes))
    quota = stored(mixing.quotas(streams, table(spark, root, "mix_targets")))
    return mixing.select(streams, quota), quota


def p8_mix(spark: SparkSession, root: str) -> DataFrame:
    """The records of every mix, in shards, in shuffled order."""
    chosen, quota = _mix_parts(spark, root)
    return mixing.mix(chosen, mixing.shard_blocks(quota))


def p8_shares(spark: SparkSession, root: str) -> DataFrame:
    """The shares reached."""
    return mixing.shares(*_mix_parts(spark, root))


def _levels(spark: SparkSession, root: str) -> DataFrame:
    prose = cut(reading.units(table(spark, root, "documents")))
    return reading.levels(prose, reading.fit(prose, reading.anchors(table(spark, root, "reading_labels"))))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """The band of each document of running prose."""
    return _levels(spark, root).select("doc_id", "band")


def p9_levels(spark: SparkSession, root: str) -> DataFrame:
    """Level, band and shares of prose per band of each document."""
    return _levels(spark, root)


def p9_profile(spark: SparkSession, root: str) -> DataFrame:
    """Documents and mean level per source and band."""
    documents = table(spark, root, "documents").select("doc_id", "source")
    return documents.join(_levels(spark, root), "doc_id").groupBy("source", "band").agg(F.count("*").alias("documents"), F.avg("level").alias("mean_level"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_report, p2_chunks, p3_found, p3_messages, p3_dropped, p4_percentiles, p4_repo_rollup, p5_found, p5_rates, p6_found, p6_classes, p6_canonical, p7_containers, p7_fill, p8_mix, p8_shares, p9_found, p9_levels, p9_profile)}


def oracle_sql() -> dict[str, str]:
    return {}
