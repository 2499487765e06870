"""File sinks. All of them write in parallel from the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.contract import EVENT_COLUMNS, WIRE_TIMESTAMP_FORMAT
from ordertide.plans.settings import applied

CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Text files a task keeps open, some KB each; rows of further dates are sorted by date, as without it.
OPEN_FILES = 64


def write_table(frame: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Overwrite a Parquet table and return it read back, so later steps start from the files."""
    writer = frame.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    columns = [name for name in frame.columns if name not in partition_by]
    stored = frame.select(*columns, *partition_by).schema
    return frame.sparkSession.read.schema(stored).parquet(path)


def _plain_number(value: Column) -> Column:
    """Two-place decimal text instead of Spark's 1.23E9 form; NaN and the like stay as they are."""
    return F.coalesce(value.try_cast("decimal(38,2)").cast("string"), value.cast("string"))


def export_csv(frame: DataFrame, path: str, order_by: list[str]) -> None:
    """Globally sorted CSV with a header, as a directory of parts in sort order.

    The sort is range-partitioned. Adaptive execution merges its partitions, so a small mart gives
    one part, and a large one is never squeezed through one task.
    """
    text = frame.orderBy(*order_by).select(
        *(
            _plain_number(F.col(name)).alias(name) if kind == "double" else F.col(name)
            for name, kind in frame.dtypes
        )
    )
    writer = text.write.mode("overwrite").option("header", "true")
    writer.option("timestampFormat", CSV_TIMESTAMP_FORMAT).csv(path)


def write_event_files(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, one directory per event date, with full microseconds.

    A task writes to the files of its dates side by side, so it holds no rows to sort them by date.
    """
    dated = events.select(*EVENT_COLUMNS, F.to_date("event_ts").alias("event_date"))
    writer = dated.write.mode("append").partitionBy("event_date")
    with applied(events.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}):
        writer.option("timestampFormat", WIRE_TIMESTAMP_FORMAT).json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as JSON, NULL fields included."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
