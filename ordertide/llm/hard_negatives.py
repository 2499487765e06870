"""Hard negatives by best-first search in STR-packed R-trees.

Vectors are integers, and a row's score for an anchor is their inner product. An anchor's positives are its best
``positives`` other rows of its label. Its hard negatives for one of them are the best ``negatives`` rows of other
labels that score between ``low`` and ``high`` percent of that positive. Best is the higher score, ties by the
smaller id (null ids last), then by row.

Shards. The table is cut by sort-tile-recursive packing: into slabs by quantiles of the first coordinate, each slab
into tiles by quantiles of the second. A fraction drawn from the row number parts equal coordinates, so that rows
which repeat one vector spread as evenly as others. Anchors are dealt into chunks of bounded size, and every chunk
meets every shard: one task holds one shard and one chunk, whatever the table's size.

Trees. A task packs its shard into leaves and upper nodes by the same rule over all coordinates. The minimum
bounding box of a node holds an interval for every coordinate; with the anchor's signs these add up to the interval
that all scores below the node lie in. Nodes wait in a queue, the highest possible score first. A node whose interval
misses the score window is dropped, and the search ends when the next node lies strictly below the last of the best
found so far. What shards return, a few rows an anchor, is merged by score and id.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part. Of vectors of
unequal length the shorter counts as filled up with zeros. A null id is never an anchor. Rows repeated are rows of
their own: each is an anchor, and each may be a positive or negative of another. Components and scores are 64-bit
integers and stay at the ends of their range beyond it. An empty table gives an empty result.

Scale: every anchor must be compared with every shard where boxes do not exclude it, so work is anchors times rows
over the shard's size in boxes, and down to the leaves where vectors have no structure. Two shuffles carry rows once
per chunk and anchors once per shard. Nothing is broadcast or collected but quantiles, two per slab.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordertide.llm.common import stored

SCALE = 256  # fixed
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SHARD_ROWS, CHUNK_ANCHORS = 4_096, 4_096
LEAF, FANOUT = 128, 8
MOST_TASKS = 20_000
EXACT = float(1 << 53)  # doubles hold integers up to here
ENDS = (-(1 << 63), (1 << 63) - 1)


# --- trees --------------------------------------------------------------------------------------


def held(scores: np.ndarray) -> np.ndarray:
    """Scores within 64 bits; doubles are only used where no score leaves them."""
    return np.clip(scores, *ENDS) if scores.dtype == object else scores


def str_runs(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers cut into runs of at most ``size`` by sort-tile-recursive packing."""
    done: list[np.ndarray] = []
    waiting = [(np.arange(len(vectors)), 0)]
    while waiting:
        rows, axis = waiting.pop()
        pages = math.ceil(len(rows) / size)
        if pages <= 1:
            if len(rows):
                done.append(rows)
            continue
        left = vectors.shape[1] - axis
        if left <= 1:
            slices = pages
        else:
            slices = max(2, math.ceil(pages ** (1 / left)))
        ordered = rows if left < 1 else rows[np.argsort(vectors[rows, axis], kind="stable")]
        step = size * math.ceil(pages / slices)
        cut = [ordered[i : i + step] for i in range(0, len(ordered), step)]
        waiting += [(part, axis + 1) for part in reversed(cut)]
    return done


class Tree:
    """An R-tree of integer vectors: rows in leaf order, and the boxes and children of all nodes.

    Leaves come first, then each level above; the last node is the root. ``children`` are row ranges of leaves and
    node ranges of others.
    """

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        runs = str_runs(vectors, leaf)
        self.order = np.concatenate(runs) if runs else np.empty(0, int)
        self.vectors = vectors[self.order]
        ends = np.cumsum([len(run) for run in runs])
        self.leaves = len(runs)
        self.children = list(zip([0, *ends[:-1]], ends, strict=True)) if runs else []
        low = [self.vectors[a:b].min(axis=0) for a, b in self.children]
        high = [self.vectors[a:b].max(axis=0) for a, b in self.children]
        first, last = 0, self.leaves
        while last - first > 1:
            for start in range(first, last, fanout):
                end = min(start + fanout, last)
                self.children.append((start, end))
                low.append(np.min(low[start:end], axis=0))
                high.append(np.max(high[start:end], axis=0))
            first, last = last, len(self.children)
        self.low, self.high = np.array(low), np.array(high)

    def intervals(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each anchor may have below each node."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        least = up @ self.low.T + down @ self.high.T
        return held(least), held(up @ self.high.T + down @ self.low.T)


class Search:
    """Best-first searches of one anchor; leaves scored once serve all of its windows."""

    def __init__(self, tree: Tree, anchor: np.ndarray, least: np.ndarray, greatest: np.ndarray):
        self.tree, self.anchor, self.least, self.greatest = tree, anchor, least, greatest
        self.scored: dict[int, np.ndarray] = {}

    def scores(self, leaf: int) -> np.ndarray:
        if leaf not in self.scored:
            start, end = self.tree.children[leaf]
            self.scored[leaf] = held(self.tree.vectors[start:end] @ self.anchor)
        return self.scored[leaf]

    def best(self, k: int, wanted: np.ndarray, ranks: np.ndarray, low=None, high=None) -> list[tuple]:
        """(score, row) of the best ``k`` rows with ``wanted`` that score from ``low`` to ``high``.

        ``ranks`` orders rows of equal score. Rows are in leaf order.
        """
        tree, found, waiting = self.tree, [], []
        if not tree.children:
            return []

        def wait(node: int) -> None:
            top = self.greatest[node]
            if (low is None or top >= low) and (high is None or self.least[node] <= high):
                heapq.heappush(waiting, (-(top if high is None else min(top, high)), node))

        wait(len(tree.children) - 1)
        while waiting:
            top, node = heapq.heappop(waiting)
            if len(found) == k and -top < found[-1][0]:
                break
            start, end = tree.children[node]
            if node >= tree.leaves:
                for child in range(start, end):
                    wait(child)
                continue
            scores = self.scores(node)
            keep = wanted[start:end].copy()
            if low is not None:
                keep &= scores >= low
            if high is not None:
                keep &= scores <= high
            if len(found) == k:
                keep &= scores >= found[-1][0]
            rows = np.flatnonzero(keep)
            if len(rows) > k:  # no more than those that reach the k-th score, ties included
                rows = rows[scores[rows] >= np.sort(scores[rows])[-k]]
            if len(rows):
                found += [(scores[row], start + row) for row in rows]
                found.sort(key=lambda item: (-item[0], ranks[item[1]]))
                del found[k:]
        return found


# --- tasks --------------------------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of integers as rows of Python integers, shorter ones filled up with zeros."""
    rows = column.combine_chunks()
    values = rows.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(rows.offsets.to_numpy())
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    ends = np.cumsum(lengths)
    for i, (length, end) in enumerate(zip(lengths, ends, strict=True)):
        out[i, :length] = values[end - length : end]
    return out


def _number_type(*parts: np.ndarray) -> type:
    """Doubles while every sum of products is an exact integer, else Python integers."""
    width = max(part.shape[1] for part in parts)
    bounds = [max(abs(int(part.max(initial=0))), abs(int(part.min(initial=0)))) for part in parts]
    return float if bounds[0] * bounds[1] * max(width, 1) < EXACT else object


def _ranks(ids: Sequence, rids: Sequence[int]) -> np.ndarray:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, rids[i]))
    ranks = np.empty(len(ids), np.int64)
    ranks[order] = np.arange(len(ids))
    return ranks


def _task(k: int, low: int | None, high: int | None, schema: pa.Schema):
    """Arrow function of one shard and one chunk of anchors.

    Without ``low`` and ``high`` it returns the best rows of the anchor's label, else for each score in the
    anchor's ``targets`` the best rows of other labels within those percentages of it.
    """

    def found(shard: pa.Table, anchors: pa.Table) -> pa.Table:
        width = max([0, *(len(v) for t in (shard, anchors) for v in t["vector"])])
        rows, queries = _matrix(shard["vector"], width), _matrix(anchors["vector"], width)
        number = _number_type(rows, queries) if width else float
        tree = Tree(rows.astype(number))
        queries = queries.astype(number)
        order = tree.order.tolist()
        column = {name: shard[name].to_pylist() for name in ("rid", "id", "label")}
        rids, ids, labels = ([column[name][i] for i in order] for name in ("rid", "id", "label"))
        ranks, rid_of = _ranks(ids, rids), np.array(rids, np.int64)
        numbers = {label: i for i, label in enumerate(dict.fromkeys(labels))}
        label_of = np.array([numbers[label] for label in labels], np.int64)
        least, greatest = tree.intervals(queries) if order else (np.empty((len(queries), 0)),) * 2
        out: list[tuple] = []
        for i, (rid, label) in enumerate(
            zip(anchors["rid"].to_pylist(), anchors["label"].to_pylist(), strict=True)
        ):
            search = Search(tree, queries[i], least[i], greatest[i])
            same = label_of == numbers.get(label, -1)
            if low is None:
                best = search.best(k, same & (rid_of != rid), ranks)
                out += [(rid, 0, rids[row], ids[row], int(score)) for score, row in best]
                continue
            for place, target in enumerate(anchors["targets"][i].as_py()):
                least_score = -(-low * target // 100)
                most = high * target // 100
                if least_score <= most:
                    best = search.best(k, ~same, ranks, least_score, most)
                    out += [(rid, place, rids[row], ids[row], int(score)) for score, row in best]
        columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
        return pa.Table.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    return found


# --- shards -------------------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, vector) of the rows that take part; each component x becomes floor(scale * x)."""
    value = F.col(vector_col)
    broken = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.filter(value.isNotNull() & label.isNotNull()).filter(~broken)
    whole = F.transform(value, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return kept.select(F.col(id_col).alias("id"), label.alias("label"), whole.alias("vector"))


def _spread(axis: int) -> Column:
    """A coordinate and a fraction that parts rows of equal coordinates, whatever number they have."""
    fraction = F.pmod(F.xxhash64(F.lit(axis), "rid"), F.lit(1 << 20)) / float(1 << 20)
    return F.coalesce(F.get("vector", F.lit(axis)), F.lit(0)).cast("double") + fraction


def _cut(value: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c < value))


def _quantiles(value: Column, parts: int) -> Column:
    wanted = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else None
    return F.percentile_approx(value, wanted, max(10_000, 20 * parts)) if parts > 1 else F.array().cast("array<double>")


def shards(rows: DataFrame, n_rows: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """``rows`` with ``shard``, a number below the count that comes with them."""
    pages = max(1, math.ceil(n_rows / shard_rows))
    slabs = math.ceil(math.sqrt(pages))
    tiles = math.ceil(pages / slabs)
    spread = rows.withColumns({"first": _spread(0), "second": _spread(1)})
    by_first = spread.agg(_quantiles(F.col("first"), slabs).alias("cuts")).first()["cuts"] or []
    cuts = F.array(*map(F.lit, by_first)) if by_first else F.array().cast("array<double>")
    slabbed = spread.withColumn("slab", _cut(F.col("first"), cuts))
    by_second = slabbed.groupBy("slab").agg(_quantiles(F.col("second"), tiles).alias("cuts"))
    shard = F.col("slab") * tiles + _cut(F.col("second"), F.col("cuts"))
    dealt = slabbed.join(by_second, "slab").withColumn("shard", shard.cast("int"))
    return dealt.drop("first", "second", "slab", "cuts"), slabs * tiles


def _searched(
    sharded: DataFrame, n_shards: int, anchors: DataFrame, n_chunks: int, k: int,
    low: int | None = None, high: int | None = None,
) -> DataFrame:
    """(anchor, place, rid, id, score): the best ``k`` of every shard for each anchor (and place of a target)."""
    id_type = sharded.schema["id"].dataType.simpleString()
    tasks = min(n_shards * n_chunks, MOST_TASKS)

    def dealt(frame: DataFrame, missing: str, count: int) -> DataFrame:
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(missing)
        return frame.select("*", everywhere).repartition(tasks, "shard", "chunk").groupBy("shard", "chunk")

    schema = f"anchor bigint, place int, rid bigint, id {id_type}, score bigint"
    arrow = pa.schema([
        ("anchor", pa.int64()), ("place", pa.int32()), ("rid", pa.int64()),
        ("id", _arrow_type(id_type)), ("score", pa.int64()),
    ])
    right = dealt(anchors, "shard", n_shards)
    left = dealt(sharded.select("rid", "id", "label", "vector", "shard"), "chunk", n_chunks)
    return left.cogroup(right).applyInArrow(_task(k, low, high, arrow), schema)


def _arrow_type(name: str) -> pa.DataType:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}
    if name not in kinds:
        raise ValueError(f"Ids are integers or strings, not {name}")
    return kinds[name]


def _merged(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "rid")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    shard_rows: int = SHARD_ROWS,
    chunk_anchors: int = CHUNK_ANCHORS,
    label: str = "negatives",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all that `whole_vectors` left.

    ``is_anchor`` is a condition on ``id``. ``rank`` counts the negatives of one anchor and positive from 1.
    """
    numbered = vectors.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "vector")
    rows = stored(numbered, f"{label}-rows")
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors")).first()
    sharded, n_shards = shards(rows, counts["rows"], shard_rows)
    sharded = stored(sharded, f"{label}-shards")
    n_chunks = max(1, math.ceil(counts["anchors"] / chunk_anchors))
    chunk = F.pmod(F.xxhash64("rid"), F.lit(n_chunks)).cast("int").alias("chunk")
    anchors = rows.filter(is_anchor).select("rid", "id", "label", "vector", chunk)
    asked = anchors.select("rid", "label", "vector", "chunk")
    near = _searched(sharded, n_shards, asked, n_chunks, positives)
    best = stored(
        _merged(near, ["anchor"], positives).select(
            "anchor",
            (F.col("rank") - 1).alias("place"),
            F.col("id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        f"{label}-positives",
    )
    targets = best.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("found")
    )
    windows = asked.join(targets, asked["rid"] == targets["anchor"]).select(
        *asked.columns, F.col("found.positive_score").alias("targets")
    )
    hard = _searched(sharded, n_shards, windows, n_chunks, negatives, low, high)
    merged = _merged(hard, ["anchor", "place"], negatives).select(
        "anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return merged.join(best, ["anchor", "place"]).join(named, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
