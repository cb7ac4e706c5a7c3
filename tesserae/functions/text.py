"""Text expressions: tokens, features, language, slugs, histories and prompts, all on built-in functions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the retrieval system whose results are matched.
CJK = "[々〇぀-ヿ一-鿿]"
FEATURE = "[぀-ヿ㐀-鿿]"
PIPELINE_TOKEN, ELIGIBILITY_TOKEN = "[a-z0-9_]{2,}", "[a-z0-9_][a-z0-9_.-]*"
ARTICLE = r"第\d+条"
PENALTY = "(罰則|罰金|懲役|過料)"
EXCEPTION = "(但し書き|ただし|例外|除く)"
LEAK_MARKERS = ("Thinking Process:", "Here's a thinking process", "Analyze the Request:", "<|channel|>thought")
REFUSALS = (
    "根拠が不足しています", "根拠不足", "情報がありません", "情報はありません", "わかりません", "判断できません", "特定できません",
    "確認できません", "確認できない", "該当する情報は含まれていません", "該当する情報が含まれていません", "見当たりません",
)


def any_of(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether any needle occurs in the text."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def overlapping(text: Column, characters: str, size: int, lone: bool = False) -> Column:
    """All overlapping runs of ``size`` of the characters, in order, and with ``lone`` those that stand alone; one pass with a look-ahead."""
    pattern = characters * size + (f"|(?<!{characters}){characters}(?!{characters})" if lone else "")
    return F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), 1)


def bm25_tokens(text: Column) -> Column:
    """Lower-case words with camel case split, of two characters or more, then bigrams of each CJK run; repeats stay. Null text has none."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")), F.lit("([a-z0-9_]{2,})"), 1)
    return F.coalesce(F.concat(words, overlapping(text, CJK, 2, lone=True)), F.array().cast("array<string>"))


def text_features(text: Column, token: str = PIPELINE_TOKEN) -> Column:
    """Distinct words, and 2- and 3-grams of each CJK run (runs up to 2 whole); a text with neither has its character 3-grams."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))
    words = F.regexp_extract_all(plain, F.lit(f"({token})"), 1)
    found = F.array_distinct(F.concat(words, overlapping(plain, FEATURE, 2, lone=True), overlapping(plain, FEATURE, 3)))
    compact = F.regexp_replace(plain, " ", "")
    grams = F.when(F.length(compact) < 3, F.array(compact)).otherwise(F.array_distinct(overlapping(compact, r"[\s\S]", 3)))
    rest = F.when(F.length(compact) == 0, F.array().cast("array<string>")).otherwise(grams)
    return F.when(F.size(found) > 0, found).otherwise(rest)


def overlap(left: Column, right: Column) -> Column:
    """Share of the left features that the right has; 0 if either side is empty."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.size(left)).otherwise(0.0)


def language(text: Column) -> Column:
    """``ja`` from 30 % kana and ideographs on, ``en`` from 50 % Latin letters of what isn't space on, else ``other``."""
    n = F.length(text)
    ja = n - F.length(F.regexp_replace(text, "[぀-ヿ一-鿿]", ""))
    solid = F.length(F.regexp_replace(text, r"\s", ""))
    en = n - F.length(F.regexp_replace(text, "[A-Za-z]", ""))
    return F.when((n > 0) & (ja / n >= 0.3), "ja").when((solid > 0) & (en / solid >= 0.5), "en").otherwise("other")


def compatible(text: Column) -> Column:
    """NFKC. It has no built-in function, so texts of other than ASCII characters pass through Python in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(run, "string")(text)


def slug(text: Column, fallback: str = "document", most: int = 80) -> Column:
    """Lower-case file name of ASCII letters, digits, dots, underscores and hyphens, of the text's compatibility form (full-width letters count as letters)."""
    plain = F.regexp_replace(F.lower(compatible(text)), "[^a-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(plain, "^[-._]+|[-._]+$", ""), 1, most), F.lit("")), F.lit(fallback))


def sanitised(text: Column, most: int = 2048) -> Column:
    """Without control characters other than tab and line ends, at most ``most`` characters."""
    return F.left(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), F.lit(most))


def leaks_reasoning(text: Column) -> Column:
    return any_of(F.lower(text), tuple(m.lower() for m in LEAK_MARKERS))


def refusals(text: Column) -> Column:
    """The refusal phrases in the text, in the list's order."""
    return F.filter(F.array(*[F.lit(r) for r in REFUSALS]), lambda r: F.contains(text, r))


def ngrams(text: Column, shortest: int = 2, longest: int = 8) -> Column:
    """All substrings of the text's Japanese runs between two lengths, but for those in hiragana only."""
    sizes = [overlapping(text, CJK, k) for k in range(shortest, longest + 1)]
    return F.filter(F.concat(*sizes), lambda g: ~F.regexp_like(g, F.lit("^[ぁ-ゟ]+$")))


def byte_tokens(text: Column, vocabulary: int = 256) -> Column:
    """The text's UTF-8 bytes, modulo the vocabulary."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("([0-9A-F]{2})"), 1)
    return F.coalesce(F.transform(pairs, lambda p: F.conv(p, 16, 10).cast("int") % vocabulary), F.array().cast("array<int>"))


def normalised_text(text: str | None) -> str | None:
    """NFKC, line feeds, no control or format characters, single spaces, at most one blank line, one final line feed."""
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", text).replace("\r\n", "\n").replace("\r", "\n")
    text = "".join(c for c in text if c in "\n\t" or unicodedata.category(c)[0] != "C")
    out: list[str] = []
    for line in (" ".join(x.split()) for x in text.split("\n")):
        if line or out and out[-1]:
            out.append(line)
    return "\n".join(out).strip() + "\n"


def normalised(text: Column) -> Column:
    """``normalised_text`` on a column; NFKC has no built-in function."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(normalised_text)

    return F.pandas_udf(run, "string")(text)
