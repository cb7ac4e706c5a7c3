"""Index tables: postings, document and term statistics, hashed vectors, definitions, calls, headings, phrases."""

from __future__ import annotations

import ast
import hashlib
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import bm25_tokens, ngrams
from tesserae.functions.vectors import unit

#: Okapi BM25 as the usual library computes it.
K1, B, EPSILON = 1.5, 0.75, 0.25


def indexed_text(path: str = "rel_path", header: str = "section_header", content: str = "content") -> Column:
    return F.concat_ws(" ", path, F.coalesce(F.col(header), F.lit("")), content)


def tokenised(texts: DataFrame, key: str, text: Column, *keep: str) -> DataFrame:
    """``key, keep, tokens, dl`` of every text; all of an index derives from it, so texts are read and cut into tokens once."""
    return texts.select(key, *keep, bm25_tokens(text).alias("tokens")).withColumn("dl", F.size("tokens"))


def postings_of(tokens: DataFrame, key: str) -> DataFrame:
    """``key, token, tf, dl`` of tokenised texts, in the order of tokens within partitions, which keeps stored postings small."""
    counts = tokens.select(key, "dl", F.explode("tokens").alias("token")).groupBy(key, "token", "dl").agg(F.count("*").alias("tf"))
    return counts.sortWithinPartitions("token", key)


def postings(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, token, tf, dl``: how often a token occurs in a text of ``dl`` tokens. Null texts have no tokens."""
    return postings_of(tokenised(texts, key, text), key)


def term_statistics(posts: DataFrame, n_texts: Column) -> DataFrame:
    """``token, df, idf``; a negative idf is replaced by a quarter of the mean over the vocabulary."""
    df = posts.groupBy("token").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.ln(n_texts - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    joined = raw.join(F.broadcast(mean))  # one row
    return joined.select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def length_statistics(texts: DataFrame, text: Column) -> DataFrame:
    """One row: ``n_texts, avgdl``."""
    return texts.select(F.size(bm25_tokens(text)).alias("dl")).agg(F.count("*").alias("n_texts"), F.avg("dl").alias("avgdl"))


def hashed_vectors(texts: DataFrame, key: str, text: Column, width: int = 64) -> DataFrame:
    """``key, vector``: unit vectors of token counts in ``width`` hashed slots; the default for a text encoder, which would be a pandas UDF."""
    return vectors_of(texts.select(key, F.explode(bm25_tokens(text)).alias("token"), F.lit(1).alias("tf")), key, width)


def vectors_of(posts: DataFrame, key: str, width: int = 64) -> DataFrame:
    """The hashed vectors of texts whose postings are given; texts without tokens have none."""
    slot = (F.conv(F.substring(F.md5("token"), 1, 4), 16, 10).cast("int") % width).alias("slot")
    counts = posts.select(key, slot, "tf").groupBy(key, "slot").agg(F.sum("tf").alias("count"))
    slots = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "count"))).alias("m"))  # at most `width` entries
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    return slots.select(key, unit(dense).alias("vector"))


def token_vectors(tokens: DataFrame, key: str, width: int = 64) -> DataFrame:
    """The hashed vectors of ``tokenised`` texts, as ``vectors_of`` their postings, made row by row without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            words = lists.flatten().dictionary_encode()
            slots = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % width for w in words.dictionary.to_pylist()], np.int64)
            rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            counts = np.bincount(rows * width + slots[words.indices.to_numpy()], minlength=len(lists) * width).reshape(-1, width).astype(float)
            flat = (counts / np.linalg.norm(counts, axis=1, keepdims=True)).ravel()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * width, pa.int32()), pa.array(flat))], [key, "vector"])

    return tokens.where("dl > 0").select(key, "tokens").mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, vector array<double>")


def definitions(chunks: DataFrame) -> DataFrame:
    """``symbol, chunk_no, repo_id``: where each symbol is defined."""
    return chunks.select("repo_id", "chunk_no", F.explode("symbols").alias("symbol")).distinct()


def names_called(code: str | None) -> list[str]:
    """Distinct names that Python code calls, plain or as an attribute; none where it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    calls = [n.func for n in ast.walk(tree) if isinstance(n, ast.Call)]
    return sorted({c.id if isinstance(c, ast.Name) else c.attr for c in calls if isinstance(c, ast.Name | ast.Attribute)})


def called_names(content: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(names_called)

    return F.pandas_udf(run, "array<string>")(content)


def call_edges(chunks: DataFrame, defined: DataFrame) -> DataFrame:
    """``from_chunk, to_chunk, symbol``: calls between chunks of one repository, none to itself."""
    calls = chunks.where("language = 'python'").select("repo_id", F.col("chunk_no").alias("from_chunk"), F.explode(called_names(F.col("content"))).alias("symbol"))
    return calls.join(defined.withColumnRenamed("chunk_no", "to_chunk"), ["repo_id", "symbol"]).where("from_chunk <> to_chunk").select("repo_id", "from_chunk", "to_chunk", "symbol")


def headings(chunks: DataFrame) -> DataFrame:
    """``repo_id, repo_commit, section_header, chunk_no, ord``: markdown chunks with a usable heading path."""
    parts = F.split("section_header", " > ")
    usable = (F.col("section_header") != "") & (F.size(parts) <= 10) & F.forall(parts, lambda p: F.length(p).between(1, 500))
    order = Window.partitionBy("repo_id", "repo_commit", "section_header").orderBy("rel_path", "start_line", "chunk_no")
    return chunks.where("language = 'markdown'").where(usable).select("repo_id", "repo_commit", "section_header", "chunk_no", F.row_number().over(order).alias("ord"))


def phrase_table(texts: DataFrame, key: str, text: Column, min_df: int = 5, min_tf: int = 10) -> DataFrame:
    """``phrase, tf, df`` of Japanese phrases of 2 to 8 characters found often enough."""
    per = texts.select(key, F.explode(ngrams(text)).alias("phrase")).groupBy(key, "phrase").agg(F.count("*").alias("n"))
    return per.groupBy("phrase").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("tf") >= min_tf))


def keyword_of(phrase: Column, keywords: list[str]) -> Column:
    """The first of a fixed list's keywords that a phrase contains, or null."""
    return F.coalesce(*[F.when(F.contains(phrase, F.lit(k)), F.lit(k)) for k in keywords]) if keywords else F.lit(None).cast("string")


def document_frequencies(texts: DataFrame, key: str, text: Column, phrases: list[str]) -> DataFrame:
    """``phrase, df``: how many texts contain each phrase of a fixed list, in one pass over the texts."""
    found = F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(text, p))
    return texts.select(key, F.explode(found).alias("phrase")).groupBy("phrase").agg(F.countDistinct(key).alias("df"))
