import math
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward, documents, empty
from test_hpylm import brute_tokens

from ordertide.llm import queries
from ordertide.llm.mixing import fly, land, mixed_documents, mixture

SF_DIR = "/root/testdata/sf0.01"


def brute_targets(sizes):
    """Targets of {source: words} by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not above:
            return target | {s: level * weight[s] for s in open_}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def check(rows, docs):
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    size_of = sorted((repr(r.doc_id), len(brute_tokens(r.text)) - 1) for r in docs)
    assert sorted((repr(r.doc_id), r["size"]) for r in rows) == size_of
    for r in docs:
        n = len(brute_tokens(r.text)) - 1
        sizes[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    want = brute_targets(sizes)
    source_of = {(repr(r.doc_id), len(brute_tokens(r.text)) - 1): r.source for r in docs}
    for r in rows:
        source = source_of[repr(r.doc_id), r["size"]]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert r.taken in {0, r["size"], 2 * r["size"]}
        taken[source] += r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 2 * largest[source]
    return taken, want


def test_query_meets_the_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = queries.op5_source_mixing(spark, SF_DIR).collect()
    taken, want = check(rows, docs)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.02)
    again = queries.op5_source_mixing(spark, SF_DIR).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert mixture(docs).count() == docs.count()
    assert mixture(empty(spark)).count() == 0
    assert mixed_documents(empty(spark)).count() == 0
    clean = documents(spark, [(1, "a b c", None), (2, None, None), (3, "", "x"), (4, "d e", "x"), (None, "f", "y")])
    check(mixture(clean).collect(), clean.collect())


def test_the_mix_repeats_documents(spark):
    docs = documents(spark, [(i, "word " * (i % 7 + 1), f"s{i % 2}") for i in range(400)])
    copies = {r.doc_id: r.copies for r in mixture(docs).collect()}
    mix = mixed_documents(docs)
    assert mix.columns == [*docs.columns, "copy"]
    assert sum(copies.values()) == mix.count()
    clash = mixed_documents(docs.withColumn("copy", docs.doc_id).withColumn("row", docs.doc_id))
    assert clash.columns == [*docs.columns, "copy", "row", "copy_"]
    assert clash.filter("copy <> doc_id").isEmpty() and clash.count() == mix.count()


@pytest.mark.parametrize("rounds", [(8, 2), (16, 256)])
def test_rounds_of_groups_keep_both_totals(spark, monkeypatch, rounds):
    monkeypatch.setattr("ordertide.llm.mixing.GROUP", rounds[0])
    monkeypatch.setattr("ordertide.llm.mixing.FAN", rounds[1])
    docs = documents(spark, [(i, "w " * (i * 7919 % 100 + 1), f"s{i % 3}") for i in range(1500)])
    check(mixture(docs).collect(), docs.collect())


def test_flight_keeps_documents_and_words_and_expectation():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 10_000, 300)
    start = np.full(300, 0.37)
    mean = np.zeros(300)
    for i in range(300):
        flown = fly(start, size, np.random.default_rng(i))
        assert math.isclose(flown.sum(), start.sum(), rel_tol=1e-6)
        assert math.isclose((flown * size).sum(), (start * size).sum(), rel_tol=1e-6)
        assert ((flown > 0) & (flown < 1)).sum() <= 2
        landed = land(flown, size, np.random.default_rng(i))
        assert set(landed) <= {0.0, 1.0}
        mean += landed / 300
    assert abs(mean.mean() - 0.37) < 0.01


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_alike_do_not_share_a_group(spark, monkeypatch, doc_id):
    """A third of all rows are one row repeated: no group holds more than a few times GROUP of them."""
    from pyspark.sql import functions as F

    from ordertide.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 64)
    planned = []
    write = mixing.stored

    def kept(frame, label):
        out = write(frame, label)
        if label.endswith("-planned"):
            planned.append(out)
        return out

    monkeypatch.setattr(mixing, "stored", kept)
    rows = [(i, f"own text {i}", "a") for i in range(4000)] + [(doc_id, "the same text", "a")] * 2000
    docs = documents(spark, rows)
    mix = mixed_documents(docs)
    words = sum(len(r.text.split()) for r in mix.select("text").collect())
    assert abs(words - 1.5 * 18_000) <= 6
    sizes = planned[0].groupBy("source_hash", "bucket").agg(F.count("*").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 2 * 64
