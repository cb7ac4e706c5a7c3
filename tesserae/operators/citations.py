"""Citation markers of answers: one spelling, resolution against packs, contexts and the budget of markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import refusals

MARKER = r"[\[【［]\s*C\s*[:：]\s*([0-9]+)\s*[\]】］]"


def normalised_markers(answer: Column) -> Column:
    """Every marker as ``[C:n]`` without leading zeros."""
    return F.regexp_replace(answer, r"[\[【［]\s*C\s*[:：]\s*0*([0-9]+)\s*[\]】］]", "[C:$1]")


def cited_indices(answer: Column) -> Column:
    """Distinct indices of an answer's markers in ascending order; null answers have none."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(MARKER), 1), lambda d: d.cast("int"))
    return F.coalesce(F.sort_array(F.array_distinct(found)), F.array().cast("array<int>"))


def resolve(answers: DataFrame, packs: DataFrame) -> DataFrame:
    """``answer_id, cited, wrong, no_citation``: the pack chunks an answer's markers name, and indices outside its pack.

    ``answers`` has ``answer_id, answer``; ``packs`` has ``answer_id, citation_index, chunk``. Lists are in ascending index order.
    """
    marks = answers.select("answer_id", F.explode_outer(cited_indices(F.col("answer"))).alias("citation_index"))
    found = marks.join(packs, ["answer_id", "citation_index"], "left")
    pair = F.struct("citation_index", "chunk")
    hit, miss = F.col("chunk").isNotNull(), F.col("chunk").isNull() & F.col("citation_index").isNotNull()
    per = found.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.when(hit, pair))).alias("hits"), F.sort_array(F.collect_list(F.when(miss, F.col("citation_index")))).alias("wrong"), F.count("citation_index").alias("n"))
    return per.select("answer_id", F.transform("hits", lambda p: p["chunk"]).alias("cited"), "wrong", (F.col("n") == 0).alias("no_citation"))


def refusal_score(answer: Column) -> Column:
    """1 if a refusal phrase occurs, else 0; null counts as none."""
    return F.when(F.size(refusals(F.coalesce(answer, F.lit("")))) > 0, 1.0).otherwise(0.0)


def contexts(answer: Column) -> Column:
    """``(citation_index, context)`` of every marker: the sentence or line that holds it."""
    sentences = F.filter(F.split(answer, r"(?<=[。.!?！？])\s+|\n+|(?<=。)"), lambda s: F.regexp_like(s, F.lit(MARKER)))
    pairs = F.transform(sentences, lambda s: F.transform(F.regexp_extract_all(s, F.lit(MARKER), 1), lambda d: F.struct(d.cast("int").alias("citation_index"), s.alias("context"))))
    return F.coalesce(F.flatten(pairs), F.array().cast("array<struct<citation_index:int,context:string>>"))


def by_frequency(answer: Column) -> Column:
    """Distinct indices of an answer's markers, the most frequent first, then the lowest."""
    every = F.transform(F.regexp_extract_all(answer, F.lit(MARKER), 1), lambda d: d.cast("int"))
    counted = F.transform(F.array_distinct(every), lambda i: F.struct((-F.size(F.filter(every, lambda x: x == i))).alias("n"), i.alias("i")))
    return F.transform(F.array_sort(counted), lambda c: c["i"])


def budgeted(answer: Column, allowed: Column) -> Column:
    """The answer with markers of ``allowed`` indices only, rewritten from left to right.

    An allowed index stays, another becomes the next allowed one not used yet, or goes; spaces before a closing mark go too. A marker's
    rewriting depends on those before it, so it is a fold over the answer's markers. Null answers stay null.
    """
    parts = F.split(answer, MARKER, -1)
    marks = F.transform(F.regexp_extract_all(answer, F.lit(MARKER), 1), lambda d, n: F.struct(d.cast("int").alias("i"), F.get(F.regexp_extract_all(answer, F.lit(MARKER), 0), n).alias("own"), F.get(parts, n + 1).alias("text")))

    def step(state: Column, mark: Column) -> Column:
        index = mark["i"]
        stays = F.array_contains(allowed, index)
        other = F.get(F.filter(allowed, lambda a: ~F.array_contains(state["used"], a) & (a != index)), 0)
        used = F.when(stays, index).otherwise(other)
        written = F.when(stays, mark["own"]).when(other.isNotNull(), F.concat(F.lit("[C:"), other.cast("string"), F.lit("]"))).otherwise("")
        return F.struct(F.concat(state["out"], written, mark["text"]).alias("out"), F.when(used.isNull(), state["used"]).otherwise(F.array_append(state["used"], used)).alias("used"))

    start = F.struct(F.get(parts, 0).alias("out"), F.array().cast("array<int>").alias("used"))
    return F.regexp_replace(F.aggregate(marks, start, step, lambda s: s["out"]), r"\s+([。.,、])", "$1")


def jaccard(a: Column, b: Column) -> Column:
    """Shared members over all members; 0 if there are none."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)
