"""Mixing sources to target weights with the cube method.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times all words. A target
stops at ``max_epochs`` times its source's words; the excess goes to the others by weight. A source whose target
is r times its words takes every document floor(r) times, and once more a balanced sample with inclusion
probability r - floor(r).

Balanced sampling. The flight moves three documents' probabilities along the one direction that changes
neither their sum (documents) nor their sum weighted by size (words), until one of them is 0 or 1, and goes on
with the next document; two documents stay open. Documents fly in groups of about ``GROUP``; those left open
by ``FAN`` groups fly together in the next round, until each source has one group. Its last two documents land:
the document total is given up first, then the last one is drawn.

Defined results: a null or empty text has size 0; a source without words has target 0. Null ids and sources are
values like others; repeated rows are documents of their own. An empty table gives an empty result. Extra
columns do not matter. Draws are seeded by source, group and round, so reruns agree.

Scale: one pass counts words; after that rows are a few numbers. A hot source only means more groups. Ranks
come from a range sort and a count per partition; the shares from sums over the source table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import count_words, stored

WEIGHTS = (5.0, 2.0, 1.0)  # fixed: by the rank of the source
SHARE, MAX_EPOCHS = 1.5, 2.0  # fixed
GROUP, FAN = 512, 256


# --- targets -------------------------------------------------------------------------------------


def source_targets(units: DataFrame, label: str) -> DataFrame:
    """(source, source_size, documents, target) from ``units`` (source, size)."""
    totals = units.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("documents")
    )
    ordered = stored(
        totals.orderBy(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()),
        f"{label}-sources",
    )
    # place is (partition << 33) + row: counting rows by partition gives the rank.
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, offsets = 0, []
    for r in counts:
        offsets.append((r.part, before))
        before += r.n
    spark = units.sparkSession
    starts = spark.createDataFrame(offsets or [(0, 0)], "part bigint, start bigint")
    ranked = ordered.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("start") + row)
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int"))
    weighted = ranked.select("source", "source_size", "documents", weight.alias("weight"))
    level = _level(weighted)
    target = F.least(F.lit(level) * F.col("weight"), MAX_EPOCHS * F.col("source_size"))
    return weighted.select("source", "source_size", "documents", target.cast("double").alias("target"))


def _level(sources: DataFrame) -> float:
    """Words per unit of weight, once the sources that reach their limit have got it."""
    limit = MAX_EPOCHS * F.col("source_size")
    level = 0.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        total, given, weights = sources.agg(
            F.coalesce(F.sum("source_size") * SHARE, F.lit(0.0)),
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        raised = (total - given) / weights if weights else level
        if raised <= level:
            return level
        level = raised


# --- the cube method -----------------------------------------------------------------------------


def fly(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move chances to 0 or 1, keeping their sum and their sum weighted by size; two may stay open."""
    chance = chance.astype(float).copy()
    waiting = np.flatnonzero((chance > 0) & (chance < 1)).tolist()[::-1]
    draws = rng.random(len(waiting) + 1)
    open_: list[int] = []
    turn = 0
    while True:
        while len(open_) < 3 and waiting:
            open_.append(waiting.pop())
        if len(open_) < 3:
            return chance
        a, b, c = (float(size[i]) for i in open_)
        direction = (c - b, a - c, b - a)
        if not any(direction):
            direction = (1.0, -1.0, 0.0)
        _move(chance, open_, direction, draws[turn])
        turn += 1
        open_ = [i for i in open_ if 0.0 < chance[i] < 1.0]


def _move(chance: np.ndarray, at: list[int], direction: tuple, draw: float) -> None:
    """One step along ``direction`` or against it, as far as the cube goes, with unchanged expectation."""
    up = down = math.inf
    for i, d in zip(at, direction, strict=True):
        if d:
            above, below = (1.0 - chance[i]) / abs(d), chance[i] / abs(d)
            up, down = (min(up, above), min(down, below)) if d > 0 else (min(up, below), min(down, above))
    step = up if draw < down / (up + down) else -down
    for i, d in zip(at, direction, strict=True):
        moved = chance[i] + step * d
        chance[i] = 0.0 if moved < 1e-9 else 1.0 if moved > 1 - 1e-9 else moved


def land(chance: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last open documents, keeping the words as long as two are left."""
    chance = chance.astype(float).copy()
    open_ = np.flatnonzero((chance > 0) & (chance < 1)).tolist()
    while len(open_) > 1:
        a, b = open_[:2]
        direction = (float(size[b]), -float(size[a])) if size[a] or size[b] else (1.0, -1.0)
        _move(chance, [a, b], direction, rng.random())
        open_ = [i for i in open_ if 0.0 < chance[i] < 1.0]
    for i in open_:
        chance[i] = float(rng.random() < chance[i])
    return chance


def _flight(round_: int, last: bool):
    def flown(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "row"], kind="stable").reset_index(drop=True)
        seed = [int(group["source_hash"][0]) % (1 << 63), int(group["bucket"][0]), round_]
        rng = np.random.default_rng(seed)
        size = group["size"].to_numpy()
        chance = fly(group["chance"].to_numpy(), size, rng)
        group["chance"] = land(chance, size, rng) if last else chance
        return group

    return flown


def copies(units: DataFrame, label: str) -> DataFrame:
    """``units`` (row, order, source, size) with source_size, target and how many times each is taken."""
    sources = stored(source_targets(units, label), f"{label}-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("ratio") + 1e-12)
    n_groups = F.ceil(F.col("documents") / GROUP)
    to_join = sources.withColumnRenamed("source", "named")
    planned = (
        units.join(to_join, F.col("source").eqNullSafe(F.col("named")))
        .drop("named")
        .withColumn("ratio", ratio)
        .withColumn("whole", whole.cast("int"))
        .withColumn("chance", F.greatest(F.col("ratio") - whole, F.lit(0.0)))
        .withColumn("source_hash", F.xxhash64(F.col("source").isNull(), "source"))
    )
    # Rows alike share their order. Where they are more than a group holds, they are dealt by row.
    alike = units.groupBy(F.col("order").alias("many")).agg(F.count("*").alias("n")).filter(F.col("n") > GROUP)
    dealt = F.when(F.col("many").isNotNull(), F.xxhash64("order", "row")).otherwise(F.col("order"))
    planned = (
        planned.join(alike.select("many"), F.col("order") == F.col("many"), "left")
        .withColumn("bucket", F.pmod(dealt, n_groups))
        .drop("many")
    )
    planned = stored(planned, f"{label}-planned")
    most = sources.agg(F.coalesce(F.max(F.ceil(F.col("documents") / GROUP)), F.lit(1))).first()[0]
    open_ = planned.select("row", "order", "source_hash", "bucket", "size", "chance")
    settled = None
    round_ = 0
    while True:
        last = most <= 1
        flown = stored(
            open_.groupBy("source_hash", "bucket").applyInPandas(_flight(round_, last), open_.schema),
            f"{label}-round-{round_}",
        )
        done = flown.filter("chance <= 0 OR chance >= 1").select("row", "chance")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        open_ = flown.filter("chance > 0 AND chance < 1").withColumn("bucket", F.expr(f"bucket div {FAN}"))
        most, round_ = math.ceil(most / FAN), round_ + 1
    extra = settled.select("row", F.col("chance").cast("int").alias("extra"))
    return planned.join(extra, "row").withColumn("copies", F.col("whole") + F.col("extra"))


def _units(docs: DataFrame, row: Column, id_col: Column, text: Column, source: Column) -> DataFrame:
    return docs.select(
        row.alias("row"),
        F.xxhash64(id_col, text).alias("order"),
        source.alias("source"),
        count_words(text).alias("size"),
        id_col.alias("doc_id"),
    )


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    label: str = "mixing",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, and the words taken."""
    row = F.monotonically_increasing_id()
    units = _units(docs, row, F.col(id_col), F.col(text_col), F.col(source_col))
    units = stored(units, f"{label}-units")
    taken = (F.col("size") * F.col("copies")).cast("bigint")
    return copies(units, label).select(
        "doc_id", "size", "source_size", "target", "copies", taken.alias("taken")
    )


def mixed_documents(docs: DataFrame, label: str = "mixing") -> DataFrame:
    """The mix itself: each row of ``docs`` (doc_id, text, source, ...) as often as it is taken.

    ``copy`` counts a row's copies from 1; underscores follow its name if ``docs`` has that column.
    """
    copy = "copy"
    while copy in docs.columns:
        copy += "_"
    row = F.monotonically_increasing_id().alias("row")
    whole = stored(docs.select(row, F.struct("*").alias("doc")), f"{label}-docs")
    doc = F.col("doc")
    units = _units(whole, F.col("row"), doc["doc_id"], doc["text"], doc["source"]).drop("doc_id")
    counts = copies(stored(units, f"{label}-units"), label).filter("copies > 0").select("row", "copies")
    taken = F.explode(F.sequence(F.lit(1), "copies")).alias(copy)
    return whole.join(counts, "row").select("doc", taken).select("doc.*", copy)
