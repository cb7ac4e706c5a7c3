"""Training-text operators give the whole job's rows, against plain versions on planted tables."""

from __future__ import annotations

import itertools

import numpy as np

from tesserae.llm import mixing, reading


def test_a_long_border_records_gap_is_closed_by_few_lengths(spark):
    schema = "source string, doc_id bigint, n_tokens bigint"
    short = [("s", i, 12) for i in range(5000)]
    order = mixing.token_streams(spark.createDataFrame(short, schema), buckets=5).orderBy("start").collect()
    long = order[100].doc_id
    sizes = spark.createDataFrame([(s, i, 30_000 if i == long else n) for s, i, n in short], schema)
    targets = spark.createDataFrame([("m", "s", 1.0, 1, 1200 + 29_999), ("n", "s", 1.0, 1, 1200 + 30_000)], "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint")
    streams = mixing.token_streams(sizes, buckets=5).cache()
    quota = mixing.quotas(streams, targets).cache()
    chosen = mixing.select(streams, quota)
    got = {r.mix_name: r.tokens for r in mixing.shares(chosen, quota).collect()}
    assert got == {"m": 1200 + 29_988, "n": 1200 + 30_000}
    taken = sorted((r.last_start, r.n_tokens) for r in chosen.where("mix_name = 'm'").collect())
    assert [p for p, _ in taken] == list(range(0, 1200 + 29_988, 12))


def test_every_word_has_a_parameter_of_its_own(spark):
    words = ["".join(w) for w in itertools.product("abcdefghijklmnopqr", repeat=4)][:60_000]
    assert len({reading.token_slots(w)[0] for w in words}) == len(words)
    docs = [(i, ". ".join(" ".join(words[j : j + 6]) for j in range(i * 600, i * 600 + 600, 6)) + ".") for i in range(100)]
    model = reading.fit(reading.units(spark.createDataFrame(docs, "doc_id bigint, text string")).cache(), {i: float(i % 3 - 1) for i in range(100)})
    assert len(words) <= len(model.vocabulary) <= len(words) + 40
    at = reading.indices(model.vocabulary, np.array([reading.token_slots(words[i * 600 + 7])[0][0] for i in range(100)]))
    assert all(np.sign(model.difficulty[k]) == i % 3 - 1 or i % 3 == 1 for i, k in enumerate(at))
