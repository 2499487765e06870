"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each text (shares of kinds of characters, words, lines, repetition) are cut into quantile bins.
Each tree is grown level by level from histograms of the loss's gradients; the finished trees are flattened
into arrays, and all rows walk all trees at once in numpy.

Labels come only from rows outside the hold-out fold, at most about ``TRAIN_ROWS`` of them (chosen by a hash of
the id); language, source and id are never inputs.

Defined results: a null text is scored as an empty one. Rows without a label, or with a null one, are scored and
not learnt from; several labels of one id are averaged, and of several texts of one id the one with the least
statistics teaches. Without any label every score is 0.5; with labels of one
kind only, that kind's. A null id counts as the text '' in the hold-out rule. Repeated rows stay. An empty table
gives an empty result. Other columns are not read.

Scale: the sample is the only thing collected. Scoring is one pass over the texts without a shuffle; the
model is a few kilobytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD_OUT_FOLD, CUT = 5, 0, 0.3  # fixed
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 100, 4, 64, 0.1, 20, 1.0

KINDS = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (9, 11, 12, 13, 32),
    "stop": b".!?",
    "comma": b",;:",
    "quote": b"'\"`()",
    "symbol": b"#*$%&|<>{}[]\\^~_=+@",
    "high": range(128, 256),
}
KIND_ROWS = np.zeros((len(KINDS), 256))
for _row, _members in enumerate(KINDS.values()):
    KIND_ROWS[_row, list(_members)] = 1.0
_ENDING = re.compile(rb"[#*$%&|<>]+(?=\s|$)")
_SENTENCE = re.compile(rb"[.!?](?:\s|$)")


def statistics(text: bytes | None) -> list[float]:
    """Figures of one UTF-8 text; an empty text has zeros."""
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    n, n_words, n_lines = len(text), len(words), len(lines)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = histogram[histogram > 0] / max(n, 1)
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, n_words) if words else np.zeros(1)
    line_lengths = np.fromiter(map(len, lines), np.int64, n_lines) if lines else np.zeros(1)
    per_word = 1.0 / max(n_words, 1)
    return [
        float(np.log1p(n)),
        float(np.log1p(n_words)),
        float(np.log1p(n_lines)),
        *(KIND_ROWS @ histogram / max(n, 1)),
        -float((share * np.log2(share)).sum()),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        float(line_lengths.mean()),
        float(line_lengths.std()),
        len(counts) * per_word,
        max(counts.values(), default=0) * per_word,
        sum(n for n in pairs.values() if n > 1) * per_word,
        max(pairs.values(), default=0) * per_word,
        1.0 - len(set(lines)) / n_lines if n_lines else 0.0,
        len(_ENDING.findall(text)) * per_word,
        len(_SENTENCE.findall(text)) * per_word,
        sum(c for w, c in counts.items() if len(w) == 1) * per_word,
    ]


WIDTH = len(statistics(b""))


# --- trees ---------------------------------------------------------------------------------------


class Trees:
    """Boosted trees of one depth, flattened: node i of a tree has the children 2 i + 1 and 2 i + 2."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.cut, self.value = start, feature, cut, value

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        n_trees = len(self.feature)
        if not n_trees or not len(rows):
            return np.full(len(rows), _sigmoid(self.start))
        at = np.zeros((len(rows), n_trees), np.int64)
        tree = np.arange(n_trees)
        line = np.arange(len(rows))[:, None]
        for _ in range(DEPTH):
            right = rows[line, self.feature[tree, at]] > self.cut[tree, at]
            at = 2 * at + 1 + right
        return _sigmoid(self.start + self.value[tree, at].sum(axis=1))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _cuts(column: np.ndarray) -> np.ndarray:
    """Values between bins: quantiles of the column."""
    return np.unique(np.quantile(column, np.arange(1, BINS) / BINS))


def fit(rows: np.ndarray, labels: np.ndarray) -> Trees:
    """Trees for ``labels`` between 0 and 1."""
    if not len(rows):
        nothing = np.empty((0, 1))
        return Trees(0.0, nothing.astype(int), nothing, nothing)
    share = labels.mean()
    start = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    cuts = [_cuts(rows[:, f]) for f in range(rows.shape[1])]
    bins = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(rows), start)
    feature, cut, value = [], [], []
    for _ in range(TREES):
        p = _sigmoid(margin)
        f, c, v, leaf = _grow(bins, cuts, p - labels, p * (1 - p))
        feature.append(f), cut.append(c), value.append(v)
        margin += v[leaf]
    return Trees(start, np.stack(feature), np.stack(cut), np.stack(value))


def _grow(bins: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, curve: np.ndarray):
    """One tree: feature, cut and value of each node, and the leaf of each row."""
    n_rows, width = bins.shape
    size = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.zeros(size, np.int64), np.full(size, np.inf), np.zeros(size)
    at = np.zeros(n_rows, np.int64)
    for depth in range(DEPTH):
        first, nodes = 2**depth - 1, 2**depth
        place = (((at - first) * width)[:, None] + np.arange(width)) * BINS + bins
        shape, length = (nodes, width, BINS), nodes * width * BINS

        def histogram(weight, place=place, shape=shape, length=length):
            flat = None if weight is None else np.repeat(weight, width)
            return np.bincount(place.ravel(), weights=flat, minlength=length).reshape(shape).cumsum(axis=2)

        g, h, n = histogram(slope), histogram(curve), histogram(None)
        whole_g, whole_h, whole_n = g[..., -1:], h[..., -1:], n[..., -1:]
        gain = g**2 / (h + RIDGE) + (whole_g - g) ** 2 / (whole_h - h + RIDGE) - whole_g**2 / (whole_h + RIDGE)
        gain[(n < LEAST_ROWS) | (whole_n - n < LEAST_ROWS)] = 0.0
        best = gain.reshape(nodes, -1).argmax(axis=1)
        split_at = np.full(nodes, BINS)
        for node in range(nodes):
            f, b = divmod(int(best[node]), BINS)
            if gain[node, f, b] > 1e-9 and b < len(cuts[f]):
                feature[first + node], cut[first + node], split_at[node] = f, cuts[f][b], b
        node = at - first
        right = bins[np.arange(n_rows), feature[at]] > split_at[node]
        at = 2 * at + 1 + right
    leaves = at - (2**DEPTH - 1)
    g = np.bincount(leaves, weights=slope, minlength=2**DEPTH)
    h = np.bincount(leaves, weights=curve, minlength=2**DEPTH)
    value[2**DEPTH - 1 :] = -RATE * g / (h + RIDGE)
    return feature, cut, value, at


# --- Spark ---------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % FOLDS == HELD_OUT_FOLD


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array(rows, pa.list_(pa.float64()))],
            ["id", "label", "statistics"],
        )


def _scores(trees: Trees):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = [statistics(text.as_py()) for text in batch.column("text")]
            found = trees.scores(np.array(rows).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(found)], ["id", "held_out", "score"]
            )

    return batches


def train(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int
) -> Trees:
    """Trees from the labelled rows outside the hold-out fold."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("labelled")).agg(F.avg(label_col).cast("double").alias("label"))
    total = known.count()
    keep = min(1.0, train_rows / max(total, 1))
    sample = known.filter(F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(keep * 1_000_000))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # The sample has about train_rows rows at most, of two numbers each.
    learnt = texts.join(F.broadcast(sample), F.col("id") == F.col("labelled")).select("id", "label", "text")
    id_type = texts.schema["id"].dataType.simpleString()
    measured = learnt.mapInArrow(_statistic_rows, f"id {id_type}, label double, statistics array<double>")
    # An id that repeats teaches one of its texts, so what is collected keeps the bound of the sample.
    found = measured.groupBy("id").agg(F.first("label").alias("label"), F.min("statistics").alias("statistics"))
    found = found.select("label", "statistics").toArrow()
    rows = np.array(found["statistics"].to_pylist()).reshape(-1, WIDTH)
    marks = found["label"].to_numpy()
    order = np.lexsort([*rows.T, marks])  # the same trees in whatever order the rows arrive
    return fit(rows[order], marks[order])


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id_col, held_out, score, predicted) of every row of ``docs``."""
    trees = train(docs, labels, id_col, text_col, label_col, train_rows)
    rows = docs.select(
        F.col(id_col).alias("id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(_scores(trees), f"id {id_type}, held_out boolean, score double")
    return scored.select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted")
    )
