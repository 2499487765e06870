"""History in buckets: tables hashed and sorted by key, so that a batch is resolved against them without moving them.

A join or window by the bucketed key finds the rows of a key in one bucket. Only the batch is shuffled, into as many
partitions as there are buckets; the history is read where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.operators import resolve


def bucketed_table(
    spark: SparkSession, name: str, path: str, columns: str, key: str, buckets: int
) -> DataFrame:
    """Register the bucketed Parquet table at ``path`` under ``name``; ``columns`` is DDL.

    Its files stay if the table is dropped.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet"
        f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(name)


def write_bucketed(frame: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``frame`` as a bucketed table, one file a bucket, and return it read back."""
    columns = ", ".join(f"`{column}` {kind}" for column, kind in frame.dtypes)
    stored = bucketed_table(frame.sparkSession, name, path, columns, key, buckets)
    frame.repartition(buckets, key).write.insertInto(name, overwrite=True)
    return stored


def newer_than(
    history: DataFrame, arrived: DataFrame, key: str, recency: Sequence[str]
) -> DataFrame:
    """Rows of ``arrived`` (one per key) that come after the row ``history`` has of their key, or have none there.

    Columns are those of ``arrived``; ``history`` has the key and the columns of ``recency``. The row of a NULL key is
    found by filter, so that the join is one on equal keys, which buckets serve.
    """
    after: Column = F.struct(*(F.col(f"a.{n}") for n in recency)) > F.struct(*(F.col(f"h.{n}") for n in recency))
    named = arrived.filter(F.col(key).isNotNull()).alias("a")
    known = history.select(key, *recency).withColumn("_known", F.lit(True))
    joined = named.join(known.filter(F.col(key).isNotNull()).alias("h"), key, "left")
    newer = joined.filter(F.col("_known").isNull() | F.coalesce(after, F.lit(False))).select(
        key, *(F.col(f"a.{n}") for n in arrived.columns if n != key)
    )
    nameless = arrived.filter(F.col(key).isNull()).withColumn("_new", F.lit(True))
    before = history.filter(F.col(key).isNull()).select(*arrived.columns).withColumn("_new", F.lit(False))
    order = [*(F.col(name).desc() for name in recency), F.col("_new").asc()]
    latest = resolve.latest_per_key(nameless.unionByName(before), [key], order).filter("_new")
    return newer.select(*arrived.columns).unionByName(latest.drop("_new"))


def changed_winners(history: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose winning copy ``events`` changes, given the winners in ``history`` (bucketed by event_id)."""
    return newer_than(history, resolve.dedup_latest_event(events), "event_id", resolve.EVENT_RECENCY)


def changed_orders(history: DataFrame, accepted: DataFrame) -> DataFrame:
    """Order states that newly ``accepted`` events replace, given the states in ``history`` (bucketed by order_id).

    For events that only arrive; where a winner may move to another order or turn bad, see
    `ordertide.streaming.incremental`.
    """
    return newer_than(history, resolve.current_order_state(accepted), "order_id", resolve.STATE_RECENCY)
