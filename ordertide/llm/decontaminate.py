"""Benchmark decontamination by winnowing.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Of every window of ten words the
least hash of its six 5-grams is kept; equal windows keep the same hash, so a shared span of ten words
is always found. Document windows whose hash the benchmark also keeps are extended to the whole window
and joined with the benchmark's windows on hash and words, so hashes never decide. An item of fewer than ten
words is one window, fingerprinted by all its words.

Defined results: null or empty texts have no words and no hits; an item without words has no window. A null
item id counts as the empty string; items repeated under one id count once. Repeated documents keep one row
each. An empty benchmark leaves every document clean. Other columns are not read.

Scale: texts are read once, with vectorised hashing over blocks of bytes. A Bloom bitmap of the benchmark's
hashes, at most ``2 ** MAX_BITMAP_BITS`` bits whatever the benchmark's size, is broadcast to drop
almost all windows before any shuffle; the exact join follows, so a fuller bitmap costs time and never rows.
A document window joins at most one distinct benchmark window, so no pair of common phrases is multiplied;
adaptive execution splits a passage that many documents hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import stored, text_hash
from ordertide.llm.wordhash import ALPHANUMERIC, Words, mixed

WINDOW = 10  # fixed
GRAM = 5
MAX_BITMAP_BITS = 29  # 64 MiB
BITS_PER_HASH = 256

class Windows(Words):
    """The windows of one text and the hash that winnowing keeps of each."""

    def __init__(self, text: bytes | None):
        super().__init__(text, ALPHANUMERIC)

    def kept(self, length: int) -> np.ndarray:
        """For every window of ``length`` words the hash that winnowing keeps."""
        if length < WINDOW:
            return self.grams(length)
        grams = self.grams(GRAM)
        n = len(grams) - (length - GRAM)
        if n <= 0:
            return np.empty(0, np.uint64)
        least = grams[:n].copy()
        for i in range(1, length - GRAM + 1):
            np.minimum(least, grams[i : i + n], out=least)
        return least

    def window(self, start: int, length: int) -> str:
        raw = self.plain[self.starts[start] : self.ends[start + length - 1]]
        return b" ".join(raw.split()).decode()


_HITS = pa.list_(
    pa.struct([("print", pa.int64()), ("start", pa.int32()), ("length", pa.int32()), ("words", pa.string())])
)


def _bits(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in a bitmap of ``2 ** bits``."""
    return prints >> np.uint64(64 - bits), mixed(prints) >> np.uint64(64 - bits)


def _scan(bitmap, lengths: list[int] | None):
    """Arrow function: id, number of words, and the windows that may be in the benchmark.

    Without ``lengths`` the rows are benchmark items: all windows of each are kept.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bitmap is None else bitmap.value
        for batch in parts:
            counts, hits = [], []
            for text in batch.column("text"):
                words = Windows(text.as_py())
                counts.append(words.count)
                found = []
                for length in lengths or [min(WINDOW, words.count)]:
                    prints = words.kept(length) if length else np.empty(0, np.uint64)
                    places = np.arange(len(prints))
                    if table is not None:
                        for at in _bits(prints, (len(table) * 64).bit_length() - 1):
                            seen = table[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
                            places = places[seen[places] == 1]
                    signed = prints.view(np.int64)
                    found += [
                        {
                            "print": int(signed[p]),
                            "start": int(p),
                            "length": length,
                            "words": words.window(p, length),
                        }
                        for p in places
                    ]
                hits.append(found)
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(hits, _HITS)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "hits"])

    return batches


def _scanned(frame: DataFrame, bitmap=None, lengths: list[int] | None = None) -> DataFrame:
    """``frame`` (id, text) as (id, n_words, hits)."""
    id_type = frame.schema["id"].dataType.simpleString()
    rows = frame.select("id", F.col("text").cast("binary").alias("text"))
    hit = "struct<print: bigint, start: int, length: int, words: string>"
    return rows.mapInArrow(_scan(bitmap, lengths), f"id {id_type}, n_words bigint, hits array<{hit}>")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Bloom bitmap of distinct ``print`` values as 64-bit words; its size has a fixed bound."""
    spread = math.ceil(math.log2(max(1, prints.count()) * BITS_PER_HASH))
    bits = min(max(spread, 16), MAX_BITMAP_BITS)

    def places(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            values = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(_bits(values, bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], ["word", "bit"])

    words = (
        prints.mapInArrow(places, "word bigint, bit bigint")
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit AS int)))").alias("set"))
        .toArrow()
    )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words["word"].to_numpy()] = words["set"].to_numpy().view(np.uint64)
    return table


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    label: str = "winnowing",
) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, n_items, items_sha256 and contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("id"), F.col(item_text_col).alias("text")
    )
    windows = stored(
        _scanned(items).select("id", F.inline("hits")).select("id", "print", "length", "words").distinct(),
        f"{label}-items",
    )
    lengths = [row[0] for row in windows.select("length").distinct().collect()]  # ten at most
    bitmap = spark.sparkContext.broadcast(_bitmap(windows.select("print").distinct()))

    texts = docs.select(
        F.struct(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("text_hash")).alias("id"),
        F.col(text_col).alias("text"),
    )
    scanned = stored(
        _scanned(texts, bitmap, lengths or [WINDOW]).select(
            F.monotonically_increasing_id().alias("row"), "id.*", "n_words", "hits"
        ),
        f"{label}-documents",
    )
    hits = scanned.select("row", F.inline("hits"))
    known = windows.select("print", "words").distinct()
    found = stored(hits.join(known, ["print", "words"]), f"{label}-hits")
    end = F.col("start") + F.col("length")
    span = F.struct("start", end.alias("end"))
    spans = found.groupBy("row").agg(F.sort_array(F.collect_set(span)).alias("spans"))
    nothing = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto"))
    n_hit = F.aggregate(
        "spans",
        nothing,
        lambda acc, s: F.struct(
            (acc.hit + F.greatest(s.end - F.greatest(s.start, acc.upto), F.lit(0))).alias("hit"),
            F.greatest(acc.upto, s.end).alias("upto"),
        ),
        lambda acc: acc.hit.cast("long"),
    )
    windows_held = found.select("row", "print", "words").distinct()
    held = windows_held.join(windows, ["print", "words"]).select("row", "id").distinct()
    ids = held.groupBy("row").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    result = scanned.drop("hits").join(spans.select("row", n_hit.alias("n_hit")), "row", "left")
    zero = F.lit(0).cast("long")
    return result.join(ids, "row", "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("ids").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) that share no window with the benchmark.

    The list of those that do is written first, so that Spark knows its size: it is broadcast while it is below the
    session's threshold, and texts then stay where they are.
    """
    marked = decontaminate(docs, benchmark).filter("contaminated")
    marked = marked.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    marked = stored(marked.distinct(), "winnowing-marked")
    whole = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (text_hash(F.col("doc.text")) == F.col("hash"))
    return whole.join(marked, same, "left_anti").select("doc.*")
