import binascii

import numpy as np
import pytest
from helpers import awkward, documents, empty

from ordertide.llm import queries
from ordertide.llm.quality_model import DEPTH, WIDTH, fit, score_quality, statistics

SF_DIR = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    rows = queries.op9_quality_classifier(spark, SF_DIR).collect()
    assert len(rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 40 and np.mean([p == q for p, q in judged]) > 0.95
    assert {q for _, q in judged} == {0, 1}


def test_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 0), (6, None, 0), (None, 1, 0)], LABELS)
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(empty(spark), labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in score_quality(docs, none).collect()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(9)], LABELS)
    same = documents(spark, [(i, f"text {i}") for i in range(9)])
    assert all(r.score > 0.9 for r in score_quality(same, one_kind).collect())


def test_an_id_that_repeats_teaches_once(spark, monkeypatch):
    """A third of all rows have one labelled id: what is collected stays one row per label."""
    from ordertide.llm import quality_model

    collected = []
    learn = quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda rows, marks: collected.append(len(rows)) or learn(rows, marks))
    docs = documents(spark, [(i, f"text {i} of many") for i in range(40)] + [(7, f"again {i}") for i in range(20)] * 2)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    assert score_quality(docs, labels).count() == 80
    assert len(collected) == 1 and collected[0] <= 40


def test_statistics_of_empty_and_long_texts():
    assert statistics(None) == statistics(b"") and len(statistics(b"")) == WIDTH
    assert all(np.isfinite(statistics(t)).all() for t in (b"", b" \n", b"a", "é\n" .encode() * 100_000))


def test_flattened_trees_equal_walking_them():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(3000, 4))
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 2] < -0.5)).astype(float)
    trees = fit(rows[:2000], labels[:2000])
    found = trees.scores(rows[2000:])
    assert ((found > 0.5) == labels[2000:]).mean() > 0.97
    for row, score in zip(rows[2000:2050], found, strict=False):
        total = trees.start
        for feature, cut, value in zip(trees.feature, trees.cut, trees.value, strict=True):
            at = 0
            for _ in range(DEPTH):
                at = 2 * at + (1 if row[feature[at]] <= cut[at] else 2)
            total += value[at]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_splits_are_the_best_of_all_candidates():
    """Every split of a grown tree has the gain of the best one among all features and cuts, tried one by one."""
    from ordertide.llm.quality_model import LEAST_ROWS, RIDGE, _cuts, _grow

    rng = np.random.default_rng(8)
    rows = np.round(rng.normal(size=(600, 5)), 1)  # with ties
    labels = (rows[:, 1] + 0.5 * rows[:, 3] + rng.normal(size=600) > 0.4).astype(float)
    cuts = [_cuts(rows[:, f]) for f in range(5)]
    bins = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    slope, curve = 0.5 - labels, np.full(600, 0.25)
    feature, cut, value, leaf = _grow(bins, cuts, slope, curve)

    def gain(inside, f, c):
        left = inside & (rows[:, f] <= c)
        right = inside & ~left
        if left.sum() < LEAST_ROWS or right.sum() < LEAST_ROWS:
            return 0.0
        parts = [slope[m].sum() ** 2 / (curve[m].sum() + RIDGE) for m in (left, right, inside)]
        return parts[0] + parts[1] - parts[2]

    members, split = {0: np.ones(600, bool)}, 0
    for node in range(2**DEPTH - 1):
        inside = members[node]
        best = max(gain(inside, f, c) for f in range(5) for c in cuts[f])
        if np.isfinite(cut[node]):
            split += 1
            assert gain(inside, feature[node], cut[node]) == pytest.approx(best)
        else:
            assert best <= 1e-9
        right = rows[:, feature[node]] > cut[node]
        members[2 * node + 1], members[2 * node + 2] = inside & ~right, inside & right
    assert split > 5
    for node in range(2**DEPTH - 1, 2 ** (DEPTH + 1) - 1):
        at = members[node]
        assert (leaf[at] == node).all()
        assert np.sign(value[node]) == -np.sign(round(slope[at].sum(), 9)) if at.any() else value[node] == 0
