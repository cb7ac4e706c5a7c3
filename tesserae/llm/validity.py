"""Problem 5: source files that do not parse.

Languages are ranked for each file by the tokens it shows; a file that its own grammar refuses is tried
against all others in that order. One that parses there has a wrong extension, one that none takes is corrupt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm import grammars

# Words and marks by which a language shows itself.
SIGNS = {
    "python": "def import from elif self None True False except lambda pass async await with as yield",
    "javascript": "function const let var require module exports => === async await",
    "typescript": "interface type export import const let readonly private string number boolean => === implements",
    "java": "package import public private class static final void new String @Override extends throws",
    "go": "package func import type struct range := nil errors defer chan map",
    "rust": "fn let mut pub use impl struct enum match &str -> :: String trait",
    "kotlin": "fun val var package import when object data class companion it private String",
    "shell": "fi done esac then echo local export do set case",
    "json": '": ", {" true false null',
    "yaml": "- : name paths",
    "toml": "= [ ] title",
}
SIGN_SETS = {k: frozenset(v.split()) for k, v in SIGNS.items()}
SIGN_TOKEN = re.compile(r"@?[A-Za-z_]+|:=|=>|===|->|::|\":|&str|[-=:\[\]{}]")


def ranked(text: str) -> list[str]:
    """All languages, from the likeliest to the least likely by the share of their signs among the tokens."""
    seen = Counter(SIGN_TOKEN.findall(text))
    return sorted(SIGNS, key=lambda k: (-sum(seen[s] > 0 for s in SIGN_SETS[k]) / len(SIGN_SETS[k]), -sum(seen[s] for s in SIGN_SETS[k]), k))


def foreign(text: str, language: str) -> str | None:
    """The likeliest other language whose grammar takes the text; every grammar is tried until one does.

    A parse counts if the text shows a word or mark of the language too (two of YAML), as many a text of other kinds is an
    expression, a scalar or a command by chance.
    """
    for k in ranked(text):
        if k != language and grammars.parses(text, k):
            seen = set(SIGN_TOKEN.findall(text))
            if len(SIGN_SETS[k] & seen) >= 1 + (k == "yaml"):
                return k
    return None


def verdict(text: str | None, language: str | None) -> tuple[bool | None, str | None]:
    """Whether the text is valid in the language, and else the language it parses as, if any.

    Null without a text, a language or a grammar for it, except markdown and plain text, in which everything is valid.
    """
    if text is None or language is None:
        return None, None
    language = language.strip().lower()
    if language in ("markdown", "text"):
        return True, None
    if language not in grammars.PARSERS:
        return None, None
    if grammars.parses(text, language):
        return True, None
    return False, foreign(text, language) if text.strip() else None


def checked(files: DataFrame) -> DataFrame:
    """``file_id, repo_id, language, valid, parses_as`` of every file, whole texts parsed.

    ``parses_as`` names the foreign language of a file with a wrong extension; null for a corrupt one. Repeated
    file rows give repeated results; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verdict(t, k) for t, k in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([v for v, _ in found], pa.bool_()), pa.array([k for _, k in found], pa.string())],
                names=["file_id", "repo_id", "language", "valid", "parses_as"],
            )

    return files.select("file_id", "repo_id", "language", "content").mapInArrow(run, "file_id bigint, repo_id string, language string, valid boolean, parses_as string")


def invalid(done: DataFrame) -> DataFrame:
    """The files that don't parse, each once, with ``reason`` wrong_extension or corrupt."""
    reason = F.when(F.col("parses_as").isNotNull(), "wrong_extension").otherwise("corrupt")
    return done.where("not valid").select("file_id", "repo_id", "language", reason.alias("reason"), "parses_as").distinct()


def rates(done: DataFrame) -> DataFrame:
    """Files, invalid files and their share per repository and language."""
    return done.groupBy("repo_id", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid_files"), F.count_if(~F.col("valid") & F.col("parses_as").isNotNull()).alias("wrong_extension"),
    ).withColumn("invalid_share", F.col("invalid_files") / F.col("files"))
