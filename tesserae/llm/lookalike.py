"""Problem 6: one consistent form for text that looks the same.

DuckDB runs inside every Arrow partition: ``nfc_normalize``, ``translate`` and regular expressions map
compatibility forms, invisible characters and look-alike letters in embedded SQL. Spark does the
rest: grouping by the canonical form's digest and joining the variants.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.tables import cut

# Characters that take no space, kinds of space and of hyphen (RE2 classes).
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0B}-\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}"
    r"\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}"
    r"\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}]"
)
SPACES = r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
HYPHENS = r"[\x{2010}-\x{2013}\x{2043}\x{2212}\x{FE58}\x{FE63}\x{FF0D}\x{2D7}]"
LINE_ENDS = r"\r\n?|\x{2028}|\x{2029}"
# Cyrillic, Greek and other letters drawn like a Latin one, each followed by that one.
LOOKALIKES = (
    "аa еe оo рp сc уy хx ѕs іi јj ԁd һh ӏl ԛq ԝw үy ɡg ɑa ıi "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ЅS ІI ЈJ ԌG ԚQ ԜW ӀI ҮY "
    "οo νv ρp ϲc ϳj αa ιi "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "օo ոn սu հh ցg գq ԼL ՕO ՍU "
    "ǃ! ։: ꞉: ∶: ‚, ٫, ∕/ ⁄/"
).split()
#: Text that DuckDB gets at once.
SLICE_BYTES = 4_000_000
#: Kinds of compatibility decomposition that change neither look nor meaning; others (superscripts,
#: circles, fractions) are visible differences.
SAME_LOOK = ("<wide>", "<narrow>", "<font>")


@cache
def tables() -> tuple[str, str, list[tuple[str, str]]]:
    """``translate`` alphabets and the one-to-many replacements, derived from the Unicode database."""
    one, many = {}, []
    for code in [*range(0x2100, 0x2150), *range(0x2E80, 0x2FE0), *range(0x3000, 0x3100), *range(0xFB00, 0xFB07), *range(0xFE30, 0xFE70), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:
        ch = chr(code)
        kind = unicodedata.decomposition(ch).split(" ")[0]
        radical = kind == "<compat>" and 0x2E80 <= code < 0x2FE0
        ligature = kind == "<compat>" and 0xFB00 <= code < 0xFB07
        if not (kind in SAME_LOOK or radical or ligature):
            continue
        to = unicodedata.normalize("NFKC", ch) if code not in (0xFF9E, 0xFF9F) else chr(code - 0xFF9E + 0x3099)
        (one.__setitem__(ch, to) if len(to) == 1 else many.append((ch, to)))
    one |= {pair[0]: pair[1] for pair in LOOKALIKES}
    many += [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x1C4, 0x1CD) if unicodedata.decomposition(chr(c)).startswith("<compat>")]
    return "".join(one), "".join(one.values()), many


@cache
def canonical_sql(column: str) -> str:
    """DuckDB expression for the canonical form of ``column``."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    source, target, many = tables()
    e = f"regexp_replace(nfc_normalize({column}), {quoted(LINE_ENDS)}, chr(10), 'g')"
    e = f"regexp_replace({e}, {quoted(INVISIBLE)}, '', 'g')"
    e = f"regexp_replace(regexp_replace({e}, {quoted(SPACES)}, ' ', 'g'), {quoted(HYPHENS)}, '-', 'g')"
    for one, text in many:
        e = f"replace({e}, {quoted(one)}, {quoted(text)})"
    return f"nfc_normalize(translate({e}, {quoted(source)}, {quoted(target)}))"


def sliced(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text, or one row: the nested expressions hold a copy of the text each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def canonical(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``canon`` (the canonical form), ``canon_key``, ``stored_key`` (digests) and ``visible``.

    Null text stays null, with null digests and ``visible`` false; an empty text, or one made only of
    invisible characters and spaces, gets an empty or blank form and ``visible`` false. Other columns
    pass through whatever their names, but for the four result names, which are replaced. With
    ``keep_text`` false the text and its form are left out, so that only digests are shuffled later.
    """
    results = ["canon", "canon_key", "stored_key", "visible"]
    others = [c for c in df.columns if c not in results and (keep_text or c != text)]
    passed = df.select(*dict.fromkeys([*others, text]))
    fields = [passed.schema[c].simpleString().partition(":")[2] for c in others]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in zip(others, fields, strict=True))
    schema += (", " if schema else "") + ("canon string, " if keep_text else "") + "canon_key string, stored_key string, visible boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        expression = canonical_sql("t")
        for batch in sliced(batches, text):
            part = pa.table({"t": batch.column(batch.schema.get_field_index(text)).cast(pa.string()), "n": pa.array(range(batch.num_rows), pa.int64())})
            con.register("part", part)
            done = con.sql(
                f"with c as (select n, t, {expression} as canon from part) "
                "select canon, md5(canon) as canon_key, md5(t) as stored_key, "
                r"coalesce(regexp_matches(canon, '\S'), false) as visible from c order by n"
            ).to_arrow_table()
            con.unregister("part")
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in others}
            out |= {c: done[c].combine_chunks() for c in results if keep_text or c != "canon"}
            yield from pa.table(out).to_batches()

    return passed.mapInArrow(run, schema)


#: Rows of a class that one task pairs with the whole class.
SHARE_ROWS = 10_000


def forms(texts: DataFrame) -> DataFrame:
    """``field, scope, canon_key, key, stored_key`` of every visible text with a key, stored for the passes that follow."""
    keyed = canonical(texts.select("field", F.coalesce("scope", F.lit("")).alias("scope"), "key", "text"), keep_text=False)
    return cut(keyed.where("visible and key is not null").drop("visible"))


def same_look_pairs(texts: DataFrame, share_rows: int = SHARE_ROWS) -> DataFrame:
    """Pairs ``(field, key_a, key_b)``, ``key_a < key_b``, that differ as stored and look the same.

    ``texts`` has ``field``, ``scope`` (pairs stay within one), ``key`` and ``text``. Exact copies are
    never paired with each other: forms that have only one stored spelling are left out before the join.
    A class is counted first and joined in as many shares as it has ``share_rows``, so that one held by a third of all rows
    is spread in proportion and the others aren't copied. Null and invisible texts have no pairs; a repeated row gives its pairs once.
    """
    keyed = forms(texts)
    group = ["field", "scope", "canon_key"]
    mixed = keyed.groupBy(*group).agg(F.min("stored_key").alias("lo"), F.max("stored_key").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = mixed.select(*group, F.ceil(F.col("n") / share_rows).cast("int").alias("shares"))
    rows = keyed.join(mixed, group).dropDuplicates([*group, "key", "stored_key"])
    left = rows.select(*group, F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("salt"), F.col("key").alias("key_a"), F.col("stored_key").alias("stored_a"))
    right = rows.select(*group, F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.col("key").alias("key_b"), F.col("stored_key").alias("stored_b"))
    pairs = left.join(right, [*group, "salt"]).where("key_a < key_b and stored_a <> stored_b")
    return pairs.select("field", "key_a", "key_b")


def same_look_classes(texts: DataFrame) -> DataFrame:
    """Classes of texts that look the same and are stored in several spellings: ``field, scope, canon_key, texts, spellings, first_key``.

    One row per class, however many pairs it stands for, and all of it is combined on the map side first.
    """
    spelled = forms(texts).groupBy("field", "scope", "canon_key", "stored_key").agg(F.countDistinct("key").alias("n"), F.min("key").alias("first"))
    classes = spelled.groupBy("field", "scope", "canon_key").agg(F.sum("n").alias("texts"), F.count("*").alias("spellings"), F.min("first").alias("first_key"))
    return classes.where("spellings > 1")


def text_fields(query_results: DataFrame, chunks: DataFrame) -> DataFrame:
    """The three fields of the problem as rows ``(field, scope, key, text)``."""
    answers = query_results.select(F.lit("answer").alias("field"), F.lit("").alias("scope"), F.col("result_id").alias("key"), F.col("answer").alias("text"))
    contents = chunks.select(F.lit("content").alias("field"), F.lit("").alias("scope"), F.col("chunk_no").alias("key"), F.col("content").alias("text"))
    paths = chunks.groupBy("repo_id", "rel_path").agg(F.min("chunk_no").alias("key"))
    paths = paths.select(F.lit("rel_path").alias("field"), F.col("repo_id").alias("scope"), "key", F.col("rel_path").alias("text"))
    return answers.unionByName(contents).unionByName(paths)
