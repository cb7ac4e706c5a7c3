"""Problem 2: generated, minified, vendored and data files among source.

Merkle hashes are computed bottom-up over the trees of all scans: segments of lines make files, files make
directories. Segments, files and directories that unrelated repositories share mark vendored code, and nothing else
does; rules on headers and layout find generated, minified and data files.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import cut

# What leading comments of generated files say.
GENERATED = re.compile(
    r"(?i)\b(?:auto[- ]?|machine[- ]?|automatically )generated\b|\bcode generated\b|@generated|<auto-generated|^\W*generated (?:on|by|from|at|with|file)\b|\bgenerated (?:by|from) \S+.*(?:do not|don't|edit|compiler|tool|protoc)|"
    r"\bdo not (?:edit|modify|change)\b.*(?:hand|manual|generat|file)?|\b(?:produced|created|written|emitted|built) by [`'\"]?(?:make|tool|script|the)\b.*(?:edit|instead|do not)|\bmanual change.*\b(?:lost|overwritten)|"
    r"自動生成|機械的に(?:出力|生成)|(?:直接|手で|手動で)(?:編集|変更|修正)(?:しない|禁止)|automatisch (?:erzeugt|generiert)",
    re.M,
)
# Folders and suffixes of build output, and names of lock files.
OUTPUT_PATH = re.compile(r"(?i)(?:^|/)(?:generated|__generated__|build_out|autogen)/|(?:\.generated|\.g|\.pb|_pb2|_pb2_grpc|\.designer|\.pb\.gw|_generated)\.\w+$")
LOCK_NAME = re.compile(r"(?i)(?:^|/)(?:(?:[\w.-]+[-_.])?lock(?:file)?\.(?:json|yaml|yml|toml)|[\w.-]*\.lock(?:\.json)?|[\w.-]+-lock\.\w+|npm-shrinkwrap\.json|go\.sum|[\w.-]+\.lockb?)$")
LOCK_TEXT = re.compile(r'(?m)^\s*"(?:lockfileVersion|lockfile-version|content-hash)"\s*:|^# (?:yarn lockfile|This file is automatically @generated by)|^lockfileVersion:')
COMMENT_LINE = re.compile(r"\s*(?://|#(?!\[|include)|--|;;|/\*|\*|<!--|\"\"\"|''')")
TOP_COMMENT = re.compile(r"(?m)^(?://|#(?![\[!])|/\*| \*)[^\n]*")
BLOB_LINE = re.compile(r"(?m)^\s*[\"']?[A-Za-z0-9+/=]{40,}[\"']?[,\\]?\s*$")
WORD = re.compile(r"[^\W\d]\w*")
NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][\da-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])")
TEXT_LITERAL = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`")
BLOB = re.compile(r"^(?:[0-9a-fA-F]{6,}|[A-Za-z0-9+/=_-]{40,}|(?:\\x[0-9a-fA-F]{2}){4,}|data:[\w/+-]+;base64,.*)$")
CALL = re.compile(r"\b(?:def|function|func|fn|fun|class|return|if|for|while|switch|match|struct|interface)\b|=>")

#: A shared file or folder counts from this much text on; less may be the same by chance.
SHARED_CHARS, SHARED_LINES = 200, 8
#: A segment ends with a line whose hash is a multiple of SEGMENT_EVERY, from SEGMENT_LINES lines on, so that segments of
#: copies fall together again after a local change.
SEGMENT_LINES, SEGMENT_EVERY = 6, 3
#: The part of a file's lines in segments of unrelated repositories from which on it is a (changed) copy.
COPIED_SHARE = 0.65


def leading_comment(text: str) -> tuple[str, str]:
    """The comment block that the text begins with, and the rest."""
    lines, i, inside = text.split("\n"), 0, ""
    for i, line in enumerate(lines):
        s = line.strip()
        if inside:
            inside = "" if inside in s else inside
            continue
        if not s or s.startswith(("#!", "<?php", "package ", '"use strict"', "'use strict'")):
            continue
        if not COMMENT_LINE.match(line):
            return "\n".join(lines[:i]), "\n".join(lines[i:])
        for start, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''"), ("<!--", "-->")):
            if s.startswith(start) and end not in s[len(start) :]:
                inside = end
    return text, ""


def is_minified(body: str, language: str) -> bool:
    """Whether code was compressed: hardly any space, long lines and mostly one- or two-letter names."""
    if language not in ("javascript", "typescript", "css"):
        return False
    code = TEXT_LITERAL.sub('""', re.sub(r"/\*[\s\S]*?\*/", "", body))
    names = WORD.findall(code)
    if len(names) < 40:
        return False
    tight = sum(map(str.isspace, code)) / len(code) < 0.12
    lines = [x for x in code.split("\n") if x.strip()]
    dense = sum(len(x) for x in lines) / len(lines) > 60
    return tight and dense and sum(len(x) <= 2 for x in names) / len(names) > 0.4


def is_data(body: str, language: str) -> bool:
    """Whether the text holds mainly embedded data: numbers and encoded strings against words and logic."""
    if language in ("markdown", "text"):
        return False
    literals = [x[1:-1] for x in TEXT_LITERAL.findall(body)]
    blobs = [x for x in literals if BLOB.match(x)]
    numbers = NUMBER.findall(TEXT_LITERAL.sub('""', body))
    blob_chars = sum(map(len, blobs))
    long_blob = max(sum(len(x) for x in blobs if len(x) >= 40), sum(map(len, BLOB_LINE.findall(body))))
    if long_blob > 0.5 * len(body) and long_blob >= 200:
        return True
    items = len(numbers) + len(blobs)
    if items < 80:
        return False
    if language in ("json", "yaml", "toml"):
        values = re.findall(r"[:=,\[-]\s*(\"(?:\\.|[^\"\\\n])*\"|-?\d[\d.eE+-]*|true|false|null)\s*(?=[,\]}\n])", body)
        rows = len(re.findall(r"\{[^{}\[\]]*\}|\[[^{}\[\]]*\]", body))
        return len(values) >= 80 and items / len(values) > 0.85 and rows >= 20
    calls = len(CALL.findall(TEXT_LITERAL.sub('""', body)))
    data_chars = blob_chars + sum(len(x) + 2 for x in numbers)
    return data_chars > 0.45 * len(re.sub(r"\s+", "", body)) and items > 20 * calls


def mark(rel_path: str | None, language: str | None, content: str | None) -> str | None:
    """The rule by which a single file isn't hand-written, or None.

    A generator's notice counts in the leading comment and in comments that stand by themselves at a line's start, not in
    strings or in comments within code, where hand-written generators have it.
    """
    path, language, text = rel_path or "", (language or "").lower(), (content or "").replace("\r\n", "\n").replace("\r", "\n")
    head, body = leading_comment(text)
    if LOCK_NAME.search(path) and language != "markdown" or LOCK_TEXT.search(text):
        return "lock"
    if GENERATED.search(head) or OUTPUT_PATH.search(path) or language != "markdown" and any(GENERATED.search(x) for x in TOP_COMMENT.findall(body)):
        return "generated"
    if is_minified(body or text, language):
        return "minified"
    return "data" if is_data(body or text, language) else None


def digest(text: str) -> tuple[int, int]:
    raw = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


LEAVES = "file_id bigint, repo_id string, repo_commit string, rel_path string, rule string, h1 bigint, h2 bigint, chars bigint, lines bigint, segments array<struct<h:bigint,n:int>>"
SEGMENTS = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))


def segments(text: str) -> list[dict[str, int]]:
    """The text's segments of lines, empty lines and widths of space aside: hash ``h`` and number of lines ``n``."""
    out, held = [], []
    for line in text.split("\n"):
        line = " ".join(line.split())
        if line:
            held.append(line)
            if len(held) >= SEGMENT_LINES and zlib.crc32(line.encode("utf-8", "surrogatepass")) % SEGMENT_EVERY == 0:
                out.append(held)
                held = []
    return [{"h": digest("\n".join(x))[0], "n": len(x)} for x in (*out, *([held] if held else []))]


def leaves(files: DataFrame) -> DataFrame:
    """Each file with its rule, its segments and the hash of its text below the leading comment, line ends aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules, h1, h2, chars, lines, parts = [], [], [], [], [], []
            for path, language, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                text = (text or "").replace("\r\n", "\n").replace("\r", "\n")
                rules.append(mark(path, language, text))
                body = leading_comment(text)[1].strip()
                a, b = digest(body)
                h1.append(a)
                h2.append(b)
                chars.append(len(body))
                lines.append(body.count("\n") + 1 if body else 0)
                parts.append(segments(text))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(rules, pa.string()), *(pa.array(x, pa.int64()) for x in (h1, h2, chars, lines)), pa.array(parts, SEGMENTS)],
                names=["file_id", "repo_id", "repo_commit", "rel_path", "rule", "h1", "h2", "chars", "lines", "segments"],
            )

    return files.select("file_id", "repo_id", "repo_commit", "rel_path", "language", "content").mapInArrow(run, LEAVES)


def directory_hashes(files: DataFrame) -> DataFrame:
    """Merkle hashes of all directories: ``repo_id, repo_commit, dir, depth, h1, h2, n_files, chars``.

    A directory's hash combines its files' hashes with their paths below it. Paths are distinct, so hashes are combined by exclusive or,
    in any order and on the map side first: every file adds to each directory above it, in one shuffle for all depths.
    """
    tree = ["repo_id", "repo_commit"]
    entries = files.where("repo_id is not null and rel_path is not null").dropDuplicates([*tree, "rel_path"])
    parts = F.split("rel_path", "/")
    above = F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "dir")
    placed = entries.select(*tree, "rel_path", "h1", "h2", "chars", above)
    below = F.expr("if(depth = 0, rel_path, substring(rel_path, length(dir) + 2))")
    return placed.groupBy(*tree, "dir", (F.col("depth") - 1).alias("depth")).agg(
        F.bit_xor(F.xxhash64(below, "h1", "h2")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(7), "h2", "h1", below)).alias("h2"),
        F.count("*").alias("n_files"), F.sum("chars").alias("chars"),
    )


def shared(rows: DataFrame, families: DataFrame, hashes: list[str]) -> DataFrame:
    """Values of ``hashes`` that repositories of different families hold: the lowest and the highest family, combined on the map side first."""
    owned = rows.join(families, "repo_id").groupBy(*hashes).agg(F.min("family").alias("lo"), F.max("family").alias("hi"))
    return owned.where("lo <> hi").select(*hashes)


def unrelated(folders: DataFrame) -> DataFrame:
    """``repo_id, family`` of every repository: a number, the same for repositories that ever had an equal root, as forks are no vendoring."""
    roots = folders.where("depth = -1").select("repo_id", "h1", "h2").distinct()
    alike = roots.groupBy("h1", "h2").agg(F.min(F.xxhash64("repo_id")).alias("family"))
    return roots.join(alike, ["h1", "h2"]).groupBy("repo_id").agg(F.min("family").alias("family"))


def not_handwritten(files: DataFrame) -> DataFrame:
    """Files that aren't hand-written: ``file_id, repo_id, rule``, each file once.

    ``rule`` is shared where the hashes tell (the whole folder, the whole file, or COPIED_SHARE of the file's lines in segments that
    unrelated repositories hold too), else lock, generated, minified or data. A package that only one repository
    holds can't be told from its own code. Null paths and texts count as empty; files without a repository are judged by rules alone.
    """
    narrow = cut(leaves(files))
    folders = cut(directory_hashes(narrow))
    families = unrelated(folders)
    big = (F.col("chars") >= SHARED_CHARS) & (F.col("lines") >= SHARED_LINES)
    candidates = narrow.where(big & F.col("repo_id").isNotNull())
    pieces = candidates.select("file_id", "repo_id", "lines", F.explode("segments").alias("s")).select("file_id", "repo_id", "lines", "s.h", "s.n")
    known = shared(pieces, families, ["h"]).withColumn("known", F.lit(True))
    copied = pieces.join(known, "h").groupBy("file_id").agg(F.sum("n").alias("copied"))
    total = candidates.select("file_id", F.aggregate("segments", F.lit(0), lambda t, x: t + x["n"]).alias("total"))
    same_text = copied.join(total, "file_id").where(F.col("copied") >= COPIED_SHARE * F.col("total")).select("file_id")
    same_file = candidates.join(shared(candidates, families, ["h1", "h2"]), ["h1", "h2"], "left_semi").select("file_id")
    trees = folders.where((F.col("depth") >= 0) & (F.col("n_files") > 1) & (F.col("chars") >= SHARED_CHARS))
    same_tree = trees.join(shared(trees, families, ["h1", "h2"]), ["h1", "h2"], "left_semi").select("repo_id", "repo_commit", "dir")
    parts = F.split("rel_path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = narrow.where("rel_path like '%/%'").select("file_id", "repo_id", "repo_commit", F.explode(above).alias("dir"))
    inside = inside.join(same_tree, ["repo_id", "repo_commit", "dir"]).select("file_id")
    by_hash = same_text.unionByName(same_file).unionByName(inside).select("file_id", F.lit(0).alias("order"), F.lit("shared").alias("rule"))
    by_rule = narrow.where("rule is not null").select("file_id", F.lit(1).alias("order"), "rule")
    first = by_hash.unionByName(by_rule).groupBy("file_id").agg(F.min(F.struct("order", "rule")).alias("r")).select("file_id", "r.rule")
    owners = narrow.groupBy("file_id").agg(F.min("repo_id").alias("repo_id"))
    return first.join(owners, "file_id").select("file_id", "repo_id", "rule")


def handwritten_chunks(chunks: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """The chunks left when the files found are left out, joined on repository, commit and path."""
    gone = files.join(found.select("file_id"), "file_id", "left_semi").select("repo_id", "repo_commit", "rel_path").distinct()
    return chunks.join(gone, ["repo_id", "repo_commit", "rel_path"], "left_anti")


def repository_report(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files and files left out per repository and rule's share."""
    marked = files.select("file_id", "repo_id").join(found.select("file_id", "rule"), "file_id", "left")
    return marked.groupBy("repo_id").agg(
        F.count("*").alias("files"), *[F.count_if(F.col("rule") == r).alias(r) for r in ("lock", "generated", "minified", "data", "shared")], F.count_if(F.col("rule").isNull()).alias("handwritten"),
    )
