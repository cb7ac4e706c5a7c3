"""From retrieved lists to evidence: reranked and rejected rows, packs with pins, debug and audit rows, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.retrieval import dual_scores, evidence_pack, rerank, split_siblings, without_noise

REJECTED = 10


def reranked_and_rejected(candidates: DataFrame, scorer, k: int = 8, rejected: int = REJECTED) -> DataFrame:
    """The first ``k`` rows by a reranker and the next ``rejected``, with ``reranker_score``, ``place`` and ``kept``; noise paths are dropped first, unless all are.

    ``candidates`` has ``query_id, chunk_no, score, rel_path`` and what the scorer reads.
    """
    return rerank(without_noise(candidates), scorer, k + rejected).withColumnRenamed("rank", "place").withColumn("kept", F.col("place") <= k)


def pack_with_pins(candidates: DataFrame, pins: DataFrame, recent: DataFrame, sizes: DataFrame, max_chunks: int = 8, max_tokens: int = 1500) -> DataFrame:
    """``query_id, chunk_no, citation_index, priority, used`` within a budget: pins first, in their order and also where retrieval missed them, then recently cited chunks, then the others.

    ``candidates`` has ``query_id, chunk_no, position``, ``pins`` too; ``recent`` has ``query_id, chunk_no``; ``sizes`` has ``chunk_no, chars``.
    """
    pinned = pins.groupBy("query_id", "chunk_no").agg(F.min("position").alias("pin"))
    every = candidates.groupBy("query_id", "chunk_no").agg(F.min("position").alias("position")).join(pinned, ["query_id", "chunk_no"], "full_outer")
    cited = recent.select("query_id", "chunk_no").distinct().withColumn("recent", F.lit(True))
    flagged = every.join(cited, ["query_id", "chunk_no"], "left").join(sizes.select("chunk_no", "chars"), "chunk_no")
    flagged = flagged.select("query_id", "chunk_no", F.coalesce("pin", "position").alias("position"), "chars", F.col("pin").isNotNull().alias("pinned"), F.coalesce("recent", F.lit(False)).alias("recent"))
    return evidence_pack(flagged, max_chunks, max_tokens)


def debug_rows(expanded: DataFrame, raw: DataFrame, reranked: DataFrame, chunks: DataFrame, pack: DataFrame, cited: DataFrame) -> DataFrame:
    """One row per chunk that a query expanded to, then its rejected rows that aren't among those.

    ``expanded`` has ``query_id, chunk_no, source``; ``raw`` has the scores before reranking, which only retrieved rows show; ``pack`` tells
    which rows were used, and rows in the pack that the answer cited (``cited``: ``query_id, chunk_no``) show their citation index.
    """
    keys = ["query_id", "chunk_no"]
    rejected = reranked.where(~F.col("kept")).select(*keys, F.lit("retrieval").alias("source")).join(expanded.select(*keys), keys, "left_anti")
    rows = expanded.select(*keys, "source").unionByName(rejected)
    rows = rows.join(raw.select(*keys, "lexical_score", "dense_score", F.col("score").alias("fused_score")), keys, "left").join(reranked.select(*keys, "reranker_score"), keys, "left")
    rows = rows.join(chunks.select("chunk_no", "rel_path", "section_header"), "chunk_no", "left").join(pack.select(*keys, "citation_index"), keys, "left").join(cited.select(*keys).distinct().withColumn("was_cited", F.lit(True)), keys, "left")
    shown = F.col("source") == "retrieval"
    return rows.select(
        *keys, "source", "rel_path", "section_header", *[F.when(shown, F.col(c)).alias(c) for c in ("lexical_score", "dense_score", "fused_score")], "reranker_score",
        F.col("citation_index").isNotNull().alias("used"), F.when(F.col("was_cited"), F.col("citation_index")).alias("citation_index"),
    )


def audit_rows(ranked: DataFrame, chunks: DataFrame, cited: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` rows of each query with where they come from and whether the answer cited them; ``ranked`` has ``query_id, chunk_no, rank``."""
    flag = cited.select("query_id", "chunk_no").distinct().withColumn("was_cited", F.lit(True))
    rows = ranked.where(F.col("rank") <= most).join(chunks.select("chunk_no", "rel_path", "section_header"), "chunk_no", "left").join(flag, ["query_id", "chunk_no"], "left")
    return rows.withColumn("cited", F.coalesce("was_cited", F.lit(False))).drop("was_cited")


def prompts(pack: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, prompt``: the pack's chunks in order, each with its citation index, place and section. A pack is small by its budget."""
    rows = pack.select("query_id", "chunk_no", "citation_index").join(chunks.select("chunk_no", "rel_path", "start_line", "end_line", "section_header", "content"), "chunk_no")
    section = F.when(F.length("section_header") > 0, F.concat(F.lit("  ["), "section_header", F.lit("]"))).otherwise("")
    head = F.concat(F.lit("[C:"), F.col("citation_index").cast("string"), F.lit("] "), "rel_path", F.lit("  (lines "), F.col("start_line").cast("string"), F.lit("–"), F.col("end_line").cast("string"), F.lit(")"), section)
    part = F.struct("citation_index", F.concat(head, F.lit("\n"), F.regexp_replace("content", r"^\s+|\s+$", "")).alias("text"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n---\n\n").alias("prompt"))


def dual_selection(candidates: DataFrame, protected: int = 4, extra: int = 4) -> DataFrame:
    """The first ``protected`` candidates of each query and of the others the ``extra`` best by dual score: ``query_id, chunk_no, dual_score, place``.

    ``candidates`` has ``query_id, chunk_no, rank, retrieval, current, session, strong``; ties go to the lower rank.
    """
    scored = candidates.withColumn("dual_score", F.round(dual_scores(candidates, F.col("strong")), 6)).withColumn("kept", F.col("rank") <= protected)
    order = Window.partitionBy("query_id").orderBy(F.desc("kept"), F.when(F.col("kept"), F.col("rank")), F.desc("dual_score"), "rank")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= protected + extra).select("query_id", "chunk_no", "dual_score", "place")


def with_siblings(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, chunk_no, ord, source``: the other parts of split chunks among the rows found (``query_id, chunk_no, ord``)."""
    ids = found.join(chunks.select("chunk_no", "chunk_id"), "chunk_no")
    parts = split_siblings(ids).where("sibling <> chunk_id").select("query_id", "ord", F.col("sibling").alias("chunk_id"))
    known = chunks.groupBy("chunk_id").agg(F.min("chunk_no").alias("chunk_no"))
    return parts.join(known, "chunk_id").select("query_id", "chunk_no", "ord", F.lit("related_past_neighbor").alias("source"))
