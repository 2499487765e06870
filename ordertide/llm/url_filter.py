"""URL filters: a sorted array of 64-bit digests, probed by vectorised binary search.

An entry of the list is a host, a slash and the beginning of a path (``example.org/en/``) with a verdict. It fits
its host and all subdomains if the path of the url starts with the entry's; the longest entry wins (of equally
long ones the one with the longer host). For every url the candidate strings an entry would have to equal are
digested (XXH64), found in the sorted array by binary search, and confirmed against the stored full strings, so
that a collision of digests cannot decide. A url without an entry gets ``default``.

The array is one file that Spark copies to every executor once; its Python workers map it and share its pages.

Defined results: a null url or one without ``://`` has an empty host and path and fits no entry. An entry listed
with several verdicts is blocked if one of them blocks; null entries and entries without a slash are refused.
Repeated rows stay. An empty table gives an empty result; an empty list lets everything through. Extra columns
do not matter.

Scale: pages are read once, only their id and url. Up to ``max_bytes`` the list goes to every executor; beyond, distinct
candidates and list are dealt by digest into shards, each probed the same way where it lies.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.llm.common import lower_ascii, stored
from ordertide.plans.settings import file_system, scratch_path

ALLOW, BLOCK = "allow", "block"
MAX_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


# --- the array -----------------------------------------------------------------------------------


def array_bytes(entries: list[str], verdicts: list[str], names: list[str]) -> bytes:
    """The array as bytes: its length, sorted digests, ends of strings, places of verdicts in ``names``, strings."""
    raw = [e.encode() for e in entries]
    digests = np.array([xxhash.xxh64_intdigest(e) for e in raw], np.uint64)
    order = np.argsort(digests, kind="stable")
    ends = np.cumsum([len(raw[i]) for i in order], dtype=np.int64)
    codes = np.array([names.index(verdicts[i]) for i in order], np.uint16)
    length = np.array([len(raw)], np.int64)
    numbers = [length, digests[order], ends, codes]
    return b"".join([*(column.tobytes() for column in numbers), *(raw[i] for i in order)])


class DigestArray:
    """Sorted digests with their strings and verdicts, as views of bytes in memory or of a mapped file."""

    def __init__(self, data: np.ndarray, names: list[str]):
        n = int(data[:8].view(np.int64)[0])
        self.digests = data[8 : 8 + 8 * n].view(np.uint64)
        self.ends = data[8 + 8 * n : 8 + 16 * n].view(np.int64)
        self.codes = data[8 + 16 * n : 8 + 18 * n].view(np.uint16)
        self.strings = data[8 + 18 * n :]
        self.names = names

    def value(self, at: int) -> str:
        return self.names[self.codes[at]]

    def probe(self, candidates: list[str]) -> list[int]:
        """For every candidate its place in the array, or -1."""
        raw = [c.encode() for c in candidates]
        wanted = np.array([xxhash.xxh64_intdigest(c) for c in raw], np.uint64)
        found = np.full(len(raw), -1)
        low = np.searchsorted(self.digests, wanted, "left")
        high = np.searchsorted(self.digests, wanted, "right")
        for i in np.flatnonzero(high > low):
            for at in range(low[i], high[i]):
                begin = self.ends[at - 1] if at else 0
                if self.strings[begin : self.ends[at]].tobytes() == raw[i]:
                    found[i] = at
        return found.tolist()


def _shipped(spark: SparkSession, data: bytes, label: str) -> str:
    """Write the array to the shared folder and have Spark copy it to the executors; the file's name there."""
    path = scratch_path(spark, f"{label}-array")
    target, files = file_system(spark, path)
    stream = files.create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(str(target.toString()))
    return target.getName()


_ARRAYS: dict[str, DigestArray] = {}


def _array_of(file: str, names: list[str]) -> DigestArray:
    """The array in ``file``, mapped once per Python worker."""
    if file not in _ARRAYS:
        _ARRAYS.clear()
        _ARRAYS[file] = DigestArray(np.memmap(SparkFiles.get(file), np.uint8, "r"), names)
    return _ARRAYS[file]


# --- probing -------------------------------------------------------------------------------------


def candidates(host: str, path: str, shape: tuple[list[int], list[int]]) -> list[str]:
    """The entries that would fit, for entries of the given numbers of labels and lengths of path."""
    labels = host.split(".")
    hosts = [".".join(labels[-n:]) for n in shape[0] if n <= len(labels)]
    paths = [path[:n] for n in shape[1] if n <= len(path)]
    return [h + p for h, p in itertools.product(hosts, paths)] if host else []


def _candidate_rows(shape):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            found = pa.array([candidates(h, p, shape) for h, p in pairs], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), found], ["row", "entries"])

    return batches


def _rank(entry: str) -> tuple[int, int]:
    return len(entry), entry.index("/")


def _probe_batches(shape, file: str, names: list[str]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _array_of(file, names)
        for batch in parts:
            pairs = zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)
            listed = [candidates(h, p, shape) for h, p in pairs]
            flat = list(itertools.chain.from_iterable(listed))
            places = iter(array.probe(flat))
            rules, verdicts = [], []
            for entries in listed:
                hits = [(e, at) for e, at in zip(entries, places, strict=False) if at >= 0] if entries else []
                best = max(hits, key=lambda hit: _rank(hit[0]), default=None)
                rules.append(best and best[0])
                verdicts.append(best and array.value(best[1]))
            columns = [batch.column(c) for c in ("id", "host", "path")]
            columns += [pa.array(rules, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "rule", "verdict"])

    return batches


def _probe_shard(key: tuple, wanted: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
    entries = wanted["entry"].tolist()
    verdicts = listed["verdict"].tolist()
    names = list(dict.fromkeys(verdicts))
    data = array_bytes(listed["entry"].tolist(), verdicts, names)
    array = DigestArray(np.frombuffer(data, np.uint8), names)
    hits = [(e, array.value(at)) for e, at in zip(entries, array.probe(entries), strict=True) if at >= 0]
    return pd.DataFrame(hits, columns=["entry", "verdict"])


def _probed_in_shards(urls: DataFrame, entries: DataFrame, shape, shards: int, label: str) -> DataFrame:
    """The same for a list that is too large for every executor."""
    rows = stored(urls.withColumn("row", F.monotonically_increasing_id()), f"{label}-urls")
    listed = rows.select("row", "host", "path").mapInArrow(
        _candidate_rows(shape), "row bigint, entries array<string>"
    )
    pairs = stored(listed.select("row", F.explode("entries").alias("entry")), f"{label}-candidates")
    shard = F.pmod(F.xxhash64("entry"), F.lit(shards)).alias("shard")
    wanted = pairs.select("entry").distinct().select("entry", shard).groupBy("shard")
    known = entries.select("entry", "verdict", shard).groupBy("shard")
    hits = wanted.cogroup(known).applyInPandas(_probe_shard, "entry string, verdict string")
    rank = F.struct(F.length("entry"), F.instr("entry", "/"))
    best = pairs.join(hits, "entry").groupBy("row").agg(
        F.max_by(F.struct(F.col("entry").alias("rule"), "verdict"), rank).alias("best")
    )
    return rows.join(best, "row", "left").select("id", "host", "path", "best.rule", "best.verdict")


def filter_urls(
    pages: DataFrame,
    entries: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = ALLOW,
    max_bytes: int = MAX_BYTES,
    label: str = "url-filter",
) -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row of ``pages``; ``entries`` has entry and verdict."""
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    listed = entries.groupBy("entry").agg(F.max("verdict").alias("verdict"))  # block is after allow
    slash = F.instr("entry", "/")
    labels = F.size(F.split(F.substring_index("entry", "/", 1), "\\."))
    facts = listed.agg(
        F.coalesce(F.sum(F.octet_length("entry") + 24), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set(labels)).alias("labels"),
        F.sort_array(F.collect_set(F.length("entry") - slash + 1)).alias("paths"),
        F.coalesce(F.bool_and(slash > 0), F.lit(True)).alias("valid"),
        F.count(F.when(F.col("entry").isNull(), 1)).alias("nulls"),
    ).first()
    if not facts.valid or facts.nulls:
        raise ValueError("every entry needs a host, a slash and the beginning of a path")
    shape = (facts.labels, facts.paths)
    if facts.bytes <= max_bytes:
        found = listed.toArrow()
        verdicts = found["verdict"].to_pylist()
        names = list(dict.fromkeys(verdicts))
        data = array_bytes(found["entry"].to_pylist(), verdicts, names)
        file = _shipped(pages.sparkSession, data, label)
        id_type = urls.schema["id"].dataType.simpleString()
        result = urls.mapInArrow(
            _probe_batches(shape, file, names),
            f"id {id_type}, host string, path string, rule string, verdict string",
        )
    else:
        result = _probed_in_shards(urls, listed, shape, 2 * -(-facts.bytes // max_bytes), label)
    return result.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
