"""Chunking of files: character windows in SQL, the language-aware chunkers as per-file folds in Arrow batches."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources.tables import stored

MAX_CHARS, OVERLAP = 2400, 300
# Section openers of markdown and of articles.
HEADING = re.compile(r"^(#{1,3})\s+(.+?)\s*$")
ARTICLE = re.compile(r"^第[0-9０-９〇一二三四五六七八九十百千]+[条節](?:\s|$)")
BLANK_LINES = re.compile(r"\n[ \t]*\n+")


def char_windows(texts: DataFrame, key: str, text: str, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """``key, start_char, end_char, piece``: overlapping windows that stop with the one that reaches the end. Null texts have none, empty ones one."""
    step = max(1, size - overlap)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    at = texts.where(F.col(text).isNotNull()).select(key, text, F.explode(F.sequence(F.lit(0), last)).alias("w"))
    start = F.col("w") * step
    return at.select(key, start.cast("bigint").alias("start_char"), F.least(start + size, n).cast("bigint").alias("end_char"), F.substring(F.col(text), start + 1, F.lit(size)).alias("piece"))


def line_chunks(lines: list[str], size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Lines packed until their characters reach ``size``; the next chunk steps back over whole lines of at least ``overlap`` characters."""
    at = 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and chars < size:
            chars += len(lines[end])
            end += 1
        yield at + 1, end, "".join(lines[at:end])
        back, chars = end, 0
        while overlap and back > at and chars < overlap:
            back -= 1
            chars += len(lines[back])
        if back <= at or end >= len(lines) and chars >= sum(map(len, lines[at:end])):
            back = end
        if end >= len(lines) and (back >= end or at == back):
            return
        if end >= len(lines):
            yield back + 1, end, "".join(lines[back:end])
            return
        at = back


def python_chunks(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str, str | None, list[str]]]:
    """Top-level definitions merged while they fit; what comes before the first is a chunk of its own."""
    lines = text.splitlines(keepends=True)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    spans = [(n.lineno, n.end_lineno or n.lineno, n.name) for n in (tree.body if tree else []) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    if not spans:
        for start, end, piece in line_chunks(lines, size, overlap):
            yield start, end, piece, None, []
        return
    if spans[0][0] > 1 and "".join(lines[: spans[0][0] - 1]).strip():
        yield 1, spans[0][0] - 1, "".join(lines[: spans[0][0] - 1]), None, []
    start, end, names = spans[0][0], spans[0][1], [spans[0][2]]
    for a, b, name in spans[1:]:
        if len("".join(lines[start - 1 : b])) <= size:
            end, names = b, [*names, name]
        else:
            yield start, end, "".join(lines[start - 1 : end]), names[0], names
            start, end, names = a, b, [name]
    yield start, end, "".join(lines[start - 1 : end]), names[0], names


def sections(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Markdown sections ``(first line, last line, body, heading path)``; blank bodies are left out.

    Headings of level 1 to 3 open a section and change the path; an article's line opens one below the same path and belongs to its
    body. Lines within a fence of backticks open nothing; a fence ends with a run at least as long as the one it began with.
    """
    path: list[tuple[int, str]] = []
    body, first, fence = [], 1, 0
    lines = text.splitlines(keepends=True)

    def closed(last: int) -> Iterator[tuple[int, int, str, str]]:
        whole = "".join(body)
        if whole.strip():
            yield first, last, whole, " > ".join(title for _, title in path if title)

    for n, line in enumerate(lines, 1):
        plain = line.rstrip("\r\n")
        ticks = len(plain) - len(plain.lstrip("`"))
        if ticks >= 3 and (not fence or ticks >= fence):
            fence = 0 if fence else ticks
        elif not fence and (heading := HEADING.match(plain)):
            yield from closed(n - 1)
            level = len(heading[1])
            path = [*(x for x in path if x[0] < level), (level, heading[2].strip())]
            body, first = [], n + 1
            continue
        elif not fence and ticks < 3 and ARTICLE.match(plain):
            yield from closed(n - 1)
            body, first = [], n
        body.append(line)
    yield from closed(len(lines))


def paragraphs(body: str, size: int, overlap: int) -> list[str]:
    """A body above ``size`` in greedy runs of paragraphs; a paragraph above it in character windows."""
    if len(body) <= size:
        return [body]
    out, held = [], ""
    for p in filter(str.strip, BLANK_LINES.split(body)):
        if len(p) > size:
            out += [held] if held else []
            held, at = "", 0
            while True:
                out.append(p[at : at + size])
                if at + size >= len(p):
                    break
                at += max(1, size - overlap)
        elif held and len(held) + 2 + len(p) > size:
            out.append(held)
            held = p
        else:
            held = f"{held}\n\n{p}" if held else p
    return out + ([held] if held else [])


def chunk_text(text: str, language: str | None, size: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, str, str | None, list[str], str]]:
    """``(start line, end line, content, header, symbols, suffix)`` of a file's chunks, by its language."""
    if not text:
        return []
    if language == "python":
        return [(a, b, piece, header, names, "") for a, b, piece, header, names in python_chunks(text, size, overlap)]
    if language == "markdown":
        out = []
        for a, b, body, path in sections(text):
            pieces = paragraphs(body, size, overlap)
            out += [(a, b, p, path or None, [], f"#part{i}of{len(pieces)}" if len(pieces) > 1 else "") for i, p in enumerate(pieces, 1)]
        return out
    return [(a, b, piece, None, [], "") for a, b, piece in line_chunks(text.splitlines(keepends=True), size, overlap)]


CHUNKS = "file_id bigint, chunk_id string, repo_id string, repo_commit string, rel_path string, language string, start_line int, end_line int, content string, symbols array<string>, section_header string, file_header string"


def chunk_files(files: DataFrame, size: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """All chunks of all files, each file a fold of its own; null and empty texts have none."""
    columns = ["file_id", "repo_id", "repo_commit", "rel_path", "language", "content"]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_id", pa.int64()), *((c, pa.string()) for c in names[1:6]), ("start_line", pa.int32()), ("end_line", pa.int32()), ("content", pa.string()), ("symbols", pa.list_(pa.string())), ("section_header", pa.string()), ("file_header", pa.string())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                for a, b, piece, header, symbols, suffix in chunk_text(r["content"] or "", r["language"], size, overlap):
                    rows.append({
                        "file_id": r["file_id"], "chunk_id": f"{r['repo_id']}::{r['rel_path']}::{a}-{b}{suffix}", "repo_id": r["repo_id"], "repo_commit": r["repo_commit"], "rel_path": r["rel_path"],
                        "language": r["language"], "start_line": a, "end_line": b, "content": piece, "symbols": symbols, "section_header": header, "file_header": r["content"][:300],
                    })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(*columns).mapInArrow(run, CHUNKS)


def token_windows(tokens: DataFrame, key: str, column: str = "tokens", most: int = 8192) -> DataFrame:
    """Arrays of at most ``most`` token ids: ``key, part, tokens``."""
    parts = F.ceil(F.size(column) / F.lit(most)).cast("int")
    cells = tokens.where(F.size(column) > 0).select(key, column, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return cells.select(key, "part", F.slice(column, F.col("part") * most + 1, F.lit(most)).alias(column))


def packed_lengths(lengths: DataFrame, key: str, n: str, context: int, buckets: int = 256) -> DataFrame:
    """Sequence packing: which stretch of each text falls into which full context; the rest at the end is dropped.

    Texts follow each other by key. Running totals are taken inside ranges of keys and offset by the ranges' sums, so no task
    sees more than its range. Result: ``key, context_no, from_token, to_token``.
    """
    ranged = lengths.where(F.col(n) > 0).select(key, F.col(n).cast("bigint").alias("n"))
    # Stored once: a range exchange samples its bounds, so computing it twice could cut the ranges differently.
    ranged = stored(ranged.repartitionByRange(buckets, key).withColumn("range", F.spark_partition_id()))
    sums = ranged.groupBy("range").agg(F.sum("n").alias("size"))
    sums = sums.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy(F.lit(1))).alias("total"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("within", within).join(sums, "range").withColumn("start", F.col("base") + F.col("within"))
    first, last = F.floor(F.col("start") / context), F.floor((F.col("start") + F.col("n") - 1) / context)
    cells = placed.select(key, "start", "n", "total", F.explode(F.sequence(first, last)).alias("context_no"))
    low = F.greatest(F.col("context_no") * context - F.col("start"), F.lit(0))
    high = F.least((F.col("context_no") + 1) * context - F.col("start"), F.col("n"))
    return cells.where((F.col("context_no") + 1) * context <= F.col("total")).select(key, "context_no", low.alias("from_token"), high.alias("to_token"))
