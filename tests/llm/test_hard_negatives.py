import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordertide.llm.hard_negatives import Search, Tree, hard_negatives, shards, str_runs, whole_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=10):
    taken = [
        (i, vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector])
        for i, (vec_id, vector, label) in enumerate(rows)
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    def order(pair):
        return (-pair[0], pair[1] is None, pair[1] or 0, pair[2])

    found = []
    for rid, vec_id, label, vector in taken:
        if vec_id is None or vec_id % every:
            continue
        scored = [(score(vector, v), i, r, lab) for r, i, lab, v in taken if r != rid]
        positives = sorted((s for s in scored if s[3] == label), key=order)[:5]
        for p in positives:
            window = [s for s in scored if s[3] != label and 80 * p[0] <= 100 * s[0] <= 100 * p[0]]
            for rank, n in enumerate(sorted(window, key=order)[:5], 1):
                found.append((vec_id, p[1], rank, n[1], p[0], n[0]))
    return sorted(found, key=repr)


def mined(spark, rows, every=10, schema=SCHEMA, **options):
    frame = spark.createDataFrame(rows, schema).coalesce(1)
    vectors = whole_vectors(frame, "vec_id", "embedding", F.col("label"))
    found = hard_negatives(vectors, F.col("id") % every == 0, **options)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clustered(n, width, labels, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, width))
    return [
        (i, [float(x) for x in centres[i % 4] + spread * rng.normal(size=width)], int(rng.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 16, "chunk_anchors": 4}, {"shard_rows": 60}])
def test_equals_brute_force(spark, options):
    rows = clustered(300, 6, 3, seed=1)
    expected = brute(rows)
    assert len(expected) > 300
    assert mined(spark, rows, **options) == expected


def test_ties_and_repeated_vectors(spark):
    """Few different vectors, so most scores tie; a third of all rows is one vector."""
    rng = random.Random(2)
    rows = [(i, [0.5, 0.25, 0.0] if i % 3 == 0 else [rng.choice([0.5, 0.25]) for _ in range(3)], i % 4) for i in range(240)]
    rows += rows[:30]  # repeated rows are rows of their own
    assert mined(spark, rows, shard_rows=20) == brute(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(40, 3, 2, seed=5) + [
        (100, None, 1), (101, [0.1, None, 0.2], 1), (102, [nan, 0.1, 0.2], 1), (103, [inf, 0.1, 0.2], 0),
        (104, [0.1, 0.2, 0.3], None), (None, [0.3, 0.2, 0.1], 1), (None, [0.3, 0.2, 0.1], 0), (110, [], 1),
        (120, [0.5], 0), (130, [0.0, 0.0, 0.0], 1), (140, [-1.0, -2.0, -0.5, 9.0], 0), (-10, [1.0, 1.0, 1.0], 1),
    ]
    assert mined(spark, rows) == brute(rows)
    clash = f"{SCHEMA}, rid string, id string, shard int, chunk int, vector string"
    wide = [(*r, "x", "y", 7, 8, "z") for r in rows]
    assert mined(spark, wide, schema=clash) == brute(rows)
    assert mined(spark, [], schema=SCHEMA) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_huge_components_stay_exact(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    rows = [(0, [1e7, 1.0], 1), (1, [1e7, 0.5], 1), (2, [1e7, 0.25], 2), (3, [9e6, 1.0], 2), (4, [1e300, 1.0], 2)]
    exact = (256 * 10_000_000) ** 2
    expected = [(0, 1, 1, 2, exact + 256 * 128, exact + 256 * 64), (0, 1, 2, 3, exact + 256 * 128, exact // 10 * 9 + 256**2)]
    assert mined(spark, rows, schema=schema) == expected
    most = (1 << 63) - 1  # scores beyond the range are held at its end
    rows = [(0, [1e18], 1), (1, [1e18], 1), (2, [9e17], 2)]
    assert mined(spark, rows, schema=schema) == [(0, 1, 1, 2, most, most)]


def test_boxes_hold_all_scores_and_prune(spark):
    rows = clustered(2_000, 4, 2, seed=9, spread=0.01)
    vectors = np.floor(256 * np.array([r[1] for r in rows]))
    tree = Tree(vectors, leaf=16, fanout=4)
    anchors = vectors[:20]
    least, greatest = tree.intervals(anchors)
    assert sorted(tree.order) == list(range(2_000))
    for node, (start, end) in enumerate(tree.children):
        if node < tree.leaves:
            scores = anchors @ tree.vectors[start:end].T
            assert (scores.min(axis=1) >= least[:, node]).all() and (scores.max(axis=1) <= greatest[:, node]).all()
            assert end - start <= 16
    search = Search(tree, anchors[0], least[0], greatest[0])
    found = search.best(5, np.ones(2_000, bool), np.arange(2_000))
    assert sorted(-s for s, _ in found) == sorted(-(tree.vectors @ anchors[0]))[:5]
    assert len(search.scored) < tree.leaves / 2  # boxes of other clusters were never opened


def test_runs_are_bounded_whatever_the_values(spark):
    for vectors in (np.zeros((1_000, 3)), np.arange(1_000.0).reshape(-1, 1), np.empty((50, 0))):
        runs = str_runs(vectors, 32)
        assert max(map(len, runs)) <= 32
        assert sorted(np.concatenate(runs)) == list(range(len(vectors)))


def test_shards_are_even_when_vectors_repeat(spark):
    rows = spark.range(4_000).select(F.col("id").alias("rid"), F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")).alias("vector"))
    dealt, count = shards(rows, 4_000, 250)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert count == 16 and len(sizes) == 16 and max(sizes) <= 300
