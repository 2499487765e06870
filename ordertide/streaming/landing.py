"""Append-only bronze landing from files and from Kafka."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ordertide.contract import DEFAULT_TOPIC, EVENT_COLUMNS
from ordertide.plans.layout import Layout
from ordertide.plans.settings import STATE_STORE, applied, apply_settings, path_bytes, require_utc
from ordertide.sources.files import (
    FILE_BRONZE_SCHEMA,
    RAW,
    read_parquet_if_exists,
    stream_event_files,
)
from ordertide.sources.kafka import records_to_bronze, stream_records
from ordertide.streaming.progress import recorded_progress

POLL_SECONDS = 1
FILES_PER_DATE = 8
# Shuffled bytes a landing task sorts by date, about eight times as much in its memory.
PARTITION_BYTES = 32 << 20
MAX_PARTITIONS = 4096


def gather_dates(events: DataFrame, files_per_date: int | None) -> DataFrame:
    """Shuffle events so that a micro-batch writes at most ``files_per_date`` files per date.

    Without it (None) every task writes a file for every date it meets. The salt spreads a hot date.
    """
    if files_per_date is None:
        return events
    salt = F.pmod(F.xxhash64("event_id", "order_id", "ingest_ts"), F.lit(files_per_date))
    return events.repartition("event_date", salt)


def landing_settings(spark: SparkSession, incoming: str) -> dict[str, str]:
    """Shuffle settings of a stateless landing of the files under ``incoming``.

    JSON lines are shuffled as about a quarter of their bytes. Eight times as many partitions as these need keep dates
    apart that meet by chance, and adaptive execution merges small ones, so files that landed before cost little.
    """
    partitions = math.ceil(path_bytes(spark, incoming) / (PARTITION_BYTES // 2))
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(fixed, min(partitions, MAX_PARTITIONS))),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
    }


def drop_replays(events: DataFrame, within: str) -> DataFrame:
    """Drop exact copies of events that arrived up to ``within`` before.

    Time is that of arrival, so no row is ever late: what came longer ago is forgotten, and its copy lands once
    more. A copy that differs in any field is another row; which one counts is decided in silver, as without this.
    """
    apply_settings(events.sparkSession, STATE_STORE)
    arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", within)
    return arrived.dropDuplicatesWithinWatermark([*EVENT_COLUMNS, RAW]).drop("_arrived")


def landing_name(path: str) -> str:
    return f"landing to {path}"


def start_bronze_append(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Append a stream to a Parquet path partitioned by event date.

    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``; None runs micro-batches back to
    back. Restarting with the same checkpoint resumes after the last committed batch, a new path and
    checkpoint replay everything.
    """
    require_utc(events.sparkSession)
    writer = (
        events.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .queryName(landing_name(path))
        .partitionBy("event_date")
        .outputMode("append")
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def drain(query: StreamingQuery) -> dict[str, int | None]:
    """Wait until the query ends; its last batch id and input rows over *all* its micro-batches.

    Spark keeps only the latest progress records, so they are gathered while the query runs.
    """
    rows_by_batch: dict[int, int] = {}
    done = False
    while not done:
        done = query.awaitTermination(POLL_SECONDS)
        for progress in query.recentProgress:
            rows_by_batch[progress["batchId"]] = progress["numInputRows"]
    return {
        "batch_id": max(rows_by_batch, default=None),
        "input_rows": sum(rows_by_batch.values()),
    }


def bronze_rows(spark: SparkSession, path: str) -> int:
    """Rows committed at a bronze path (no column is read), 0 if it does not exist."""
    bronze = read_parquet_if_exists(spark, path, FILE_BRONZE_SCHEMA)
    return 0 if bronze is None else bronze.count()


def land_file_stream(
    spark: SparkSession,
    incoming: str,
    root: str,
    max_files_per_trigger: int | None = None,
    files_per_date: int | None = FILES_PER_DATE,
    count_bronze: bool = False,
    replays_within: str | None = None,
    archive: str | None = None,
    metrics: str | None = None,
) -> dict[str, int | None]:
    """Land every file not seen before exactly once, then stop.

    ``files_per_date`` bounds the files a micro-batch writes per date, at the price of a shuffle;
    None saves it where input files hold few dates. ``rows_landed`` is what the stream read;
    ``count_bronze`` counts the bronze rows before and after, which opens all footers.
    ``replays_within`` drops exact copies that arrive so soon after the first (see `drop_replays`); a checkpoint
    keeps the choice it was started with. ``archive`` is where landed files go, ``metrics`` a table of all batches.
    """
    layout = Layout(str(root))
    before = bronze_rows(spark, layout.file_bronze) if count_bronze else None
    events = stream_event_files(spark, str(incoming), max_files_per_trigger, archive)
    sizes = {}
    if replays_within is None:
        sizes = landing_settings(spark, str(incoming))
    else:  # keyed state has the partitions of its first start
        events = drop_replays(events, replays_within)
    with recorded_progress(spark, metrics, [landing_name(layout.file_bronze)]):
        with applied(spark, sizes):  # the query keeps the settings it is started with
            query = start_bronze_append(
                gather_dates(events, files_per_date),
                layout.file_bronze,
                layout.checkpoint("file_orders_to_bronze"),
                {"availableNow": True},
            )
        progress = drain(query)
    after = bronze_rows(spark, layout.file_bronze) if count_bronze else None
    return {
        "rows_before": before,
        "rows_after": after,
        "rows_landed": after - before if count_bronze else progress["input_rows"],
        **progress,
    }


def stream_from_kafka(
    spark: SparkSession,
    root: str,
    *,
    bootstrap: str,
    topic: str = DEFAULT_TOPIC,
    trigger: dict | None = None,
    files_per_date: int | None = FILES_PER_DATE,
    replays_within: str | None = None,
    metrics: str | None = None,
    **options: str,
) -> None:
    """Land a topic until stopped (or until drained, with an availableNow trigger).

    Every batch is recorded in the table ``metrics`` while the stream runs.
    """
    records = records_to_bronze(stream_records(spark, bootstrap, topic, **options))
    follow_records(spark, records, root, trigger, files_per_date, replays_within, metrics)


def follow_records(
    spark: SparkSession,
    records: DataFrame,
    root: str,
    trigger: dict | None = None,
    files_per_date: int | None = FILES_PER_DATE,
    replays_within: str | None = None,
    metrics: str | None = None,
) -> None:
    """Append decoded records (see `records_to_bronze`) to the topic's bronze until the stream ends."""
    layout = Layout(str(root))
    if replays_within is not None:
        records = drop_replays(records, replays_within)
    with recorded_progress(spark, metrics, [landing_name(layout.kafka_bronze)]):
        query = start_bronze_append(
            gather_dates(records, files_per_date),
            layout.kafka_bronze,
            layout.checkpoint("kafka_orders_to_bronze"),
            trigger,
        )
        query.awaitTermination()
