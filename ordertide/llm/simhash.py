"""SimHash near-duplicates, with candidates from pigeonring filtering.

A text's words are lower-cased (A-Z) and cut into shingles of three words; bit i of the fingerprint is 1 if
it is set in over half of the shingles' XXH64 values. Fingerprints link at ``max_diff`` or fewer
differing bits; links are closed to components.

Pigeonring. The 64 bits are cut into m consecutive segments on a ring. If two fingerprints differ in at
most t bits, then from some segment on *every* chain of l segments differs in at most l * t / m bits. Chains
short enough for a budget below one must be equal, which gives the join key: (start, bits of that chain), m
keys per fingerprint. The longer chains are checked on each candidate before the full Hamming distance.

A key that more than ``bucket_limit`` different fingerprints share is not paired up. Its members are
instead listed under every fingerprint at distance 0 or 1 (65 keys): two members differ in two or fewer bits
exactly if they share such a key, and no key can have over 65 members, which are linked as a star.

Defined results: a null or empty text has fingerprint zero, linked like any other; a text of one or two
words is one shingle. The id of a component is its smallest id; null ids are ignored unless there is no
other. Repeated rows keep one row each. An empty table gives an empty result. Other columns are not read.

Scale: one Python pass over the texts (Arrow batches, long texts in blocks) leaves an id and eight bytes per
document. Equal fingerprints are grouped before anything is paired, so exact copies cost nothing. All later
steps are joins and aggregates over distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import stored, text_hash
from ordertide.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 64  # fixed
MAX_DIFF, SEGMENTS, BUCKET_LIMIT = 2, 7, 128
BLOCK = 50_000  # shingles held at a time


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, BLOCK):
        ends = range(start, min(n, start + BLOCK))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in ends),
            dtype="<u8",
            count=len(ends),
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), prints], ["doc_id", "text_hash", "print"]
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, print) of every row."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text_hash(F.col(text_col)).alias("text_hash"),
        F.col(text_col).cast("binary").alias("text"),
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"doc_id {id_type}, text_hash bigint, print bigint")


# --- pigeonring ---------------------------------------------------------------------------------


def ring(segments: int) -> list[int]:
    """First bit of every segment, and BITS at the end."""
    return [round(i * BITS / segments) for i in range(segments + 1)]


def chain_widths(start: int, segments: int, max_diff: int) -> list[tuple[int, int]]:
    """(bits of the chain, differences it may have) for chains of 1, 2, ... segments from ``start``."""
    edges = ring(segments)
    width, found = 0, []
    for length in range(1, segments + 1):
        at = (start + length - 1) % segments
        width += edges[at + 1] - edges[at]
        found.append((width, length * max_diff // segments))
    return found


def _mask(bits: int) -> Column:
    return F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("bigint")


def _rotated(value: Column, by: int) -> Column:
    if not by:
        return value
    return F.shiftrightunsigned(value, by).bitwiseOR(F.shiftleft(value, BITS - by))


def _keys(prints: DataFrame, segments: int, max_diff: int) -> DataFrame:
    """A row (start, key, print) for every start on the ring: the bits of the chain that must be equal."""
    edges = ring(segments)
    keys = []
    for start in range(segments):
        width = max(w for w, budget in chain_widths(start, segments, max_diff) if budget == 0)
        key = _rotated(F.col("print"), edges[start]).bitwiseAND(_mask(width))
        keys.append(F.struct(F.lit(start).alias("start"), key.alias("key")))
    return prints.select("print", F.inline(F.array(*keys)))


def _chains_hold(start: Column, differing: Column, segments: int, max_diff: int) -> Column:
    """All chains from ``start`` stay within their budgets; the last chain is the full Hamming distance."""
    edges = ring(segments)
    holds = F.lit(False)
    for at in range(segments):
        turned = _rotated(differing, edges[at])
        within = F.lit(True)
        for width, budget in chain_widths(at, segments, max_diff):
            if budget:
                within = within & (F.bit_count(turned.bitwiseAND(_mask(width))) <= budget)
        holds = F.when(start == at, within).otherwise(holds)
    return holds


def _ball_links(prints: DataFrame) -> DataFrame:
    """Links of all prints at distance two or less, as stars around shared neighbours."""
    flips = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(_bit(i))) for i in range(BITS)])
    balls = prints.select("print", F.explode(flips).alias("ball"))
    members = balls.groupBy("ball").agg(F.collect_set("print").alias("members"))
    return members.filter(F.size("members") > 1).select(
        F.explode("members").alias("a"), F.array_min("members").alias("b")
    )


def _bit(i: int) -> int:
    return (1 << i) - (1 << 64 if i == 63 else 0)


def links(
    prints: DataFrame,
    max_diff: int = MAX_DIFF,
    segments: int = SEGMENTS,
    bucket_limit: int = BUCKET_LIMIT,
    label: str = "simhash",
) -> DataFrame:
    """(a, b) of different ``print`` values; closing them gives every component of distance ``max_diff``."""
    if max_diff != 2:
        raise ValueError("crowded keys are only solved for max_diff 2")
    keyed = _keys(prints.select("print").distinct(), segments, max_diff)
    sizes = keyed.groupBy("start", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(keyed.join(sizes, ["start", "key"]), f"{label}-keys")
    few = shared.filter(F.col("n") <= bucket_limit).drop("n")
    left = few.withColumnRenamed("print", "a")
    right = few.withColumnRenamed("print", "b")
    differing = F.col("a").bitwiseXOR(F.col("b"))
    near = (
        left.join(right, ["start", "key"])
        .filter(F.col("a") > F.col("b"))
        .filter(_chains_hold(F.col("start"), differing, segments, max_diff))
        .select("a", "b")
    )
    crowded = shared.filter(F.col("n") > bucket_limit).select("print").distinct()
    balls = _ball_links(crowded)
    return near.unionByName(balls)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    segments: int = SEGMENTS,
    bucket_limit: int = BUCKET_LIMIT,
    label: str = "simhash",
) -> DataFrame:
    """One row per document: doc_id, text_hash, print, and of its component the least id and text hash."""
    rows = stored(fingerprints(docs, id_col, text_col), f"{label}-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    prints = rows.groupBy("print").agg(first.alias("first"))
    roots = components(
        links(prints, segments=segments, bucket_limit=bucket_limit, label=label), f"{label}-components"
    )
    linked = prints.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", F.coalesce("root", "print").alias("root"), "first"
    )
    linked = stored(linked, f"{label}-roots")
    firsts = linked.groupBy("root").agg(F.min("first").alias("kept"))
    of_print = linked.select("print", "root").join(firsts, "root").select("print", "kept")
    return rows.join(of_print, "print").select(
        "doc_id",
        "text_hash",
        "print",
        F.col("kept.doc_id").alias("component_id"),
        F.col("kept.text_hash").alias("component_text"),
    )


def drop_near_duplicates(docs: DataFrame, label: str = "simhash") -> DataFrame:
    """One row of each component of ``docs``: the one with the least doc_id, ties by text hash."""
    found = near_duplicates(docs, label=label)
    kept = found.filter(
        F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("component_text"))
    ).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    whole = docs.select(F.struct("*").alias("doc"), text_hash(F.col("text")).alias("text_hash"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    once = whole.join(kept, same).groupBy("id", "hash").agg(F.first("doc").alias("doc"))
    return once.select("doc.*")
