"""Problem 9: how demanding each document's prose is to read.

A Rasch-style model places sentences and words on one scale: a word's difficulty is the level of the
sentences it occurs in, a sentence's level that of its words, each word counting by how well it tells levels
apart. Both are estimated in turns over all documents, with the judged ones as anchors. A sentence's
level falls into a band between two thresholds, and a document has the band of most of its prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS = ("basic", "intermediate", "advanced")

FENCE = re.compile(r"^\s*(?:```|~~~)")
# Lines that are headings, tables, settings, log lines or code rather than prose.
NOT_PROSE = re.compile(
    r"^\s*(?:#{1,6}\s|\||[-=*_]{3,}\s*$|\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\[\d+/\d+\]|\[?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b|level=|at [\w.$]+\(|Traceback|File \"|<[!/a-zA-Z][^>]*>\s*$|[\w.\"'-]+\s*[:=]\s*(?:[\w\"'\[{(./-]*\s*)?$|"
    r"[\w.-]+ = |(?:def|class|import|from|return|const|let|var|func|fn|pub|package|public|private|if|for|while|export|fun|use)\b.*[({;:=]\s*$|[{}()\[\];]+\s*$|\$ |>>> )"
)
LEAD = re.compile(r"^\s*(?:(?:>|[-*+•]|\d+[.)])\s+)+")
SENTENCE_END = re.compile(r"(?<=[。!?！？])|(?<=[.!?])(?=\s|$)")
ENDED = re.compile(r"[。.!?！？][」』)\"'*_]*$")
SPAN = re.compile(r"`[^`\n]*`|https?://\S+|\w[\w.-]*/[\w./-]+")
INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
TOKEN = re.compile(r"[a-zà-öø-ÿß]+|[一-鿿]+|[ァ-ヺー]+|[ぁ-ゖ]+")
TOKEN_OR_END = re.compile(TOKEN.pattern + "|\n")
CODE_MARK = re.compile(r"[{};]|=>|\w\(|==|&&|\|\|")


def sentences(text: str | None) -> list[str]:
    """The sentences of running prose: without code, tables, headings, settings and log lines."""
    out: list[str] = []
    inside, held = False, ""
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        if FENCE.match(line):
            inside = not inside
            line = ""
        elif inside or NOT_PROSE.match(line) or line.startswith(("    ", "\t")) and CODE_MARK.search(line):
            line = ""
        item = LEAD.match(line)
        if item or not line.strip():
            held and out.append(held)
            held = ""
        if item:
            line = line[item.end() :]
        parts = SENTENCE_END.split(line)
        if len(parts) > 1:
            parts[0] = held + (" " if held and held[-1].isascii() else "") + parts[0]
            out += parts[:-1]
            held = parts[-1]
        else:
            held = (held + " " + line).strip() if held else line
    held and out.append(held)
    return [s for s in (INVISIBLE.sub("", x).strip() for x in out) if s and (s[-1] in "。.!?！？" or ENDED.search(s))]


def word_hash(word: str) -> int:
    """64 bits that stand for a word: among a million words, two share them with a chance of 3 in 100 million."""
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=1 << 16)
def token_slots(token: str) -> tuple[tuple[int, ...], float]:
    """The hashes of a run of one script, and the words it stands for: a word, an ideograph or katakana run, or a hiragana run's triples."""
    if token[0] < "\u3000":
        return (word_hash(token),), 1.0
    if token[0] <= "\u3096":
        return tuple({word_hash(token[i : i + 3]) for i in range(max(1, len(token) - 2))}), len(token) / 2.5
    return (word_hash(token),), max(1.0, len(token) / 2)


class Slots(dict):
    """Of each token met so far its number, of each number the hashes that ``token_slots`` gives it, the words it stands for and its script."""

    def __init__(self) -> None:
        self["\n"] = 0
        self.hashes, self.words, self.japanese = [[]], [0.0], [False]

    def __missing__(self, token: str) -> int:
        own, n = token_slots(token)
        self.hashes.append(list(own))
        self.words.append(n)
        self.japanese.append(token[0] > "\u3000")
        self[token] = len(self.words) - 1
        return self[token]


#: Hashes of a sentence's features, by script.
LONG, WIDE = (np.array([[token_slots(f"{mark}{script}{i}")[0][0] for i in range(n)] for script in "lj"]) for mark, n in (("\x00", 17), ("\x01", 10)))
#: Distinct tokens that a table of numbers holds at most before a new one is begun, and characters cut into tokens at once.
MOST_TOKENS, MOST_CHARS = 1 << 16, 1 << 20


def slots_of(found: list[str], table: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words of sentences, which hold no line ends, one sentence after the other, and how many each has: none if it has too few words to be one."""
    plain = "\n".join([SPAN.sub(" ", s) if "`" in s or "/" in s else s for s in found]).lower()
    at = np.array(list(map(table.__getitem__, TOKEN_OR_END.findall(plain))), dtype=np.int64)
    of = np.cumsum(at == 0)[at > 0]
    at = at[at > 0]
    n = np.bincount(of, np.array(table.words)[at], len(found))
    chars = np.array([len(s) for s in plain.split("\n")])
    some = n >= 2.5
    # Features of each sentence: its script and length, and its script and the length of its words.
    ends, i = np.searchsorted(of, np.arange(len(found)), "right") - 1, np.flatnonzero(some)
    script = np.array(table.japanese)[at[ends[i]]].astype(int)
    long, wide = np.minimum(np.sqrt(n[i]) * 2, 16).astype(int), np.minimum(chars[i] / n[i], 9).astype(int)
    # Numbers of all hashes, so that one sort of whole numbers finds the distinct words of every sentence.
    many = np.array([len(h) for h in table.hashes])
    known, number = np.unique(np.array([*LONG.ravel(), *WIDE.ravel(), *(h for own in table.hashes for h in own)], dtype=np.int64), return_inverse=True)
    own, starts = number[LONG.size + WIDE.size :], np.cumsum(many) - many
    kept = some[of]
    of, at = of[kept], at[kept]
    each = many[at]
    words = own[np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    keys = np.concatenate([np.repeat(of, each) * len(known) + words, i * len(known) + number[script * LONG.shape[1] + long], i * len(known) + number[LONG.size + script * WIDE.shape[1] + wide]])
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return known[keys % len(known)], np.bincount(keys // len(known), minlength=len(found))


def pieces(found: list[str], most: int = MOST_CHARS) -> Iterator[list[str]]:
    """Sentences in runs that end with the one that reaches ``most`` characters."""
    start, n = 0, 0
    for i, sentence in enumerate(found, 1):
        n += len(sentence)
        if n >= most:
            yield found[start:i]
            start, n = i, 0
    if start < len(found) or not found:
        yield found[start:]


def slots(sentence: str) -> list[int]:
    """Hashed distinct words of a sentence, or none if it has too few to be one."""
    return slots_of([sentence.replace("\n", " ")], Slots())[0].tolist()


#: Judged documents that anchor the scale, at most: those of the smallest hash.
ANCHORS = 5000
#: Turns at most, and the mean move of the words' difficulties (the scale reaches from -1 to 1) from which on they have settled.
TURNS, SETTLED = 6, 0.025
#: Sentences from which on a text is running prose.
SEVERAL = 3
#: Prior weight of a word's mean and of a sentence without telling words, and the least variance of a word's levels.
PRIOR, WEAK, LEAST_VARIANCE = 1.0, 0.5, 0.08
#: An anchored sentence's level is this much the judges' and else its words'.
ANCHOR_WEIGHT, FREE_WEIGHT = 0.4, 0.5
REACH, BINS = 1.2, 48
UNITS = "doc_id bigint, chars array<int>, sizes array<int>, slots array<bigint>"


@dataclass(frozen=True)
class Model:
    """Difficulty and information of each word of the sorted vocabulary and of all others (last), the scale of sentence levels and the thresholds between bands."""

    difficulty: np.ndarray
    information: np.ndarray
    vocabulary: np.ndarray
    scale: float = 1.0
    thresholds: tuple[float, float] = (-0.4, 0.4)

    def levels(self, words: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Raw levels of ``n`` sentences, and the information each rests on."""
        weight = np.bincount(of, self.information[words], n)
        return np.bincount(of, (self.information * self.difficulty)[words], n) / (weight + WEAK), weight


def units(documents: DataFrame) -> DataFrame:
    """Per document the characters of its sentences, and the hashed words of each, whole texts read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Slots()
        for batch in batches:
            per = [sentences(text) for text in batch.column(1).to_pylist()]
            found = [s for own in per for s in own]
            parts = []
            for piece in pieces(found):
                table = table if len(table) < MOST_TOKENS else Slots()
                parts.append(slots_of(piece, table))
            words, sizes = (np.concatenate(x) for x in zip(*parts))
            some = sizes > 0
            of_doc = np.repeat(np.arange(len(per)), [len(own) for own in per])
            ends = [np.concatenate([[0], np.cumsum(np.bincount(of_doc, w, len(per)).astype(np.int64))]) for w in (some, sizes)]
            chars = np.array([len(s) for s in found], dtype=np.int32)[some]
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(x)) for o, x in ((ends[0], chars), (ends[0], sizes[some].astype(np.int32)), (ends[1], words))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "chars", "sizes", "slots"])

    return documents.select("doc_id", "text").mapInArrow(run, UNITS)


def anchors(labels: DataFrame, most: int = ANCHORS) -> dict[int, float]:
    """Mean judged level, -1 to 1, of at most ``most`` documents; unknown bands and nulls are no judgement."""
    level = F.when(F.col("band") == BANDS[0], -1.0).when(F.col("band") == BANDS[1], 0.0).when(F.col("band") == BANDS[2], 1.0)
    judged = labels.withColumn("level", level).where("level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("level").alias("level"))
    return {r.doc_id: r.level for r in judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}


def vocabulary(prose: DataFrame) -> np.ndarray:
    """All distinct hashed words, sorted: 8 bytes of each go to the driver and the workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(batch.column("slots").flatten().to_numpy(zero_copy_only=False)).astype(np.int64))], names=["word"])

    return np.sort(prose.select("slots").mapInArrow(run, "word bigint").distinct().toPandas()["word"].to_numpy(dtype=np.int64))


def indices(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where words stand in a sorted vocabulary, at its length if they don't."""
    if not len(known):
        return np.zeros(len(words), dtype=np.int64)
    return pc.fill_null(pc.index_in(pa.array(words), value_set=pa.array(known)), len(known)).to_numpy().astype(np.int64)


def _unpacked(batch: pa.RecordBatch, known: dict[int, float], words_known: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a batch of units: indices of words, their sentences, the sentences' documents and characters, and the documents' judged levels."""
    lists = [batch.column(c) for c in ("chars", "sizes", "slots")]
    chars, sizes, words = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    of_doc = np.repeat(np.arange(batch.num_rows), np.diff(lists[0].offsets.to_numpy()))
    of_sentence = np.repeat(np.arange(len(sizes)), sizes)
    judged = np.array([known.get(i, np.nan) for i in batch.column("doc_id").to_pylist()], dtype=float)
    return indices(words_known, words), of_sentence, of_doc, chars.astype(float), judged


def _word_turn(prose: DataFrame, known: dict[int, float], words_known: np.ndarray, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """New difficulty and information of all words from the sentences' present levels; the first turn knows the anchors' only."""

    size = len(words_known) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size))
        for batch in batches:
            words, of_sentence, of_doc, _, judged = _unpacked(batch, known, words_known)
            given = judged[of_doc]
            anchored = ~np.isnan(given)
            if model is None:
                level, use = np.where(anchored, given, 0.0), anchored.astype(float)
            else:
                raw, weight = model.levels(words, of_sentence, len(of_doc))
                own = np.clip(raw * model.scale, -REACH, REACH)
                level = np.where(anchored, ANCHOR_WEIGHT * given + (1 - ANCHOR_WEIGHT) * own, own)
                use = np.where(anchored, 1.0, FREE_WEIGHT * (weight > 0))
            w, t = use[of_sentence], level[of_sentence]
            for k, x in enumerate((w, w * t, w * t * t)):
                sums[k] += np.bincount(words, x, size)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x[some]) for x in sums)], names=["slot", "n", "s", "q"])

    parts = prose.mapInArrow(run, "slot int, n double, s double, q double").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    got = parts.toPandas()
    n, s, q = (np.zeros(size) for _ in range(3))
    at = got["slot"].to_numpy()
    n[at], s[at], q[at] = got["n"], got["s"], got["q"]
    mean = s / np.maximum(n, 1e-9)
    variance = np.maximum(q / np.maximum(n, 1e-9) - mean**2, 0)
    return s / (n + PRIOR), np.where(n > 0, n / (n + 2) / (variance + LEAST_VARIANCE), 0.0)


def _scale(prose: DataFrame, model: Model) -> float:
    """What brings the 80th percentile of the raw levels' sizes to 1, from a histogram over all sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2001)
        for batch in batches:
            words, of_sentence, of_doc, *_ = _unpacked(batch, {}, model.vocabulary)
            raw, _ = model.levels(words, of_sentence, len(of_doc))
            counts += np.bincount(np.minimum(np.abs(raw) * 1000, 2000).astype(int), minlength=2001)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bin", "n"])

    got = prose.mapInArrow(run, "bin int, n double").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
    if got.empty:
        return 1.0
    reached = got["n"].cumsum() >= 0.8 * got["n"].sum()
    return 1000.0 / max(float(got["bin"][reached].iloc[0]), 1.0)


def _thresholds(prose: DataFrame, known: dict[int, float], model: Model) -> tuple[float, float]:
    """The thresholds under which most anchors get the band their judges gave; of equal ones those in the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, of_sentence, of_doc, chars, judged = _unpacked(batch, known, model.vocabulary)
            raw, _ = model.levels(words, of_sentence, len(of_doc))
            bins = np.clip((raw * model.scale / REACH + 1) / 2 * BINS, 0, BINS - 1).astype(int)
            held = np.bincount(of_doc * BINS + bins, chars, batch.num_rows * BINS).reshape(-1, BINS)
            some = np.flatnonzero(~np.isnan(judged) & (held.sum(axis=1) > 0))
            yield pa.RecordBatch.from_arrays([pa.array(judged[some]), pa.array(list(held[some]), pa.list_(pa.float64()))], names=["judged", "held"])

    got = prose.mapInArrow(run, "judged double, held array<double>").toPandas()
    got = got[got["judged"].isin([-1.0, 0.0, 1.0])]
    if got.empty:
        return Model.thresholds
    held, want = np.stack(got["held"].to_list()), got["judged"].to_numpy().astype(int) + 1
    before = np.c_[np.zeros(len(held)), held.cumsum(axis=1)]
    hits = {}
    for low in range(1, BINS - 1):
        for high in range(low + 1, BINS):
            shares = np.c_[before[:, low], before[:, high] - before[:, low], before[:, -1] - before[:, high]]
            hits[low, high] = int((shares.argmax(axis=1) == want).sum())
    best = [k for k, n in hits.items() if n == max(hits.values())]
    low = sorted(x for x, _ in best)[len(best) // 2]
    highs = sorted(y for x, y in best if x == low)
    edge = lambda i: (i / BINS * 2 - 1) * REACH
    return edge(low), edge(highs[len(highs) // 2])


def moved(old: Model, new: Model) -> float:
    """How far the words' difficulties moved in a turn, each word counting by its information."""
    total = new.information.sum()
    return float((new.information * np.abs(new.difficulty - old.difficulty)).sum() / total) if total else 0.0


def fit(prose: DataFrame, known: dict[int, float], turns: int = TURNS, settled: float = SETTLED) -> Model:
    """Estimate words and sentences in turns, until the words' difficulties have settled or ``turns`` are done.

    Each turn is a pass over all units; what comes to the driver has one row per word, bin or anchor.
    """
    words = vocabulary(prose)

    def scaled(difficulty: np.ndarray, information: np.ndarray) -> Model:
        model = Model(difficulty, information, words)
        return Model(difficulty, information, words, _scale(prose, model))

    model = scaled(*_word_turn(prose, known, words, None))
    for _ in range(turns):
        before, model = model, scaled(*_word_turn(prose, known, words, model))
        if moved(before, model) <= settled:
            break
    return Model(model.difficulty, model.information, words, model.scale, _thresholds(prose, known, model))


def levels(prose: DataFrame, model: Model, several: int = SEVERAL) -> DataFrame:
    """``doc_id, band, level, n_sentences, basic, intermediate, advanced`` (shares of the prose's characters) of each document of running prose.

    Documents with fewer than ``several`` sentences, empty and null texts have no row; repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, of_sentence, of_doc, chars, _ = _unpacked(batch, {}, model.vocabulary)
            raw, _ = model.levels(words, of_sentence, len(of_doc))
            level = np.clip(raw * model.scale, -REACH, REACH)
            band = (level >= model.thresholds[0]).astype(int) + (level >= model.thresholds[1])
            n = np.bincount(of_doc, minlength=batch.num_rows)
            held = np.bincount(of_doc * 3 + band, chars, batch.num_rows * 3).reshape(-1, 3)
            total = np.maximum(held.sum(axis=1), 1)
            mean = np.bincount(of_doc, chars * level, batch.num_rows) / total
            some = np.flatnonzero(n >= several)
            names = [BANDS[i] for i in held[some].argmax(axis=1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some)), pa.array(names, pa.string()), pa.array(mean[some]), pa.array(n[some].astype(np.int32)), *(pa.array(held[some, k] / total[some]) for k in range(3))],
                names=["doc_id", "band", "level", "n_sentences", *BANDS],
            )

    return prose.mapInArrow(run, "doc_id bigint, band string, level double, n_sentences int, basic double, intermediate double, advanced double")
