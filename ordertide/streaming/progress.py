"""The progress of streams as a table, for drains and for streams that run until they are stopped."""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

WAIT_MS = 60_000
PROGRESS_DDL = (
    "name string, run_id string, started_at string, input_rows bigint, trigger_ms bigint, state_rows bigint,"
    " late_groups bigint, observed string"
)


class ProgressTable(StreamingQueryListener):
    """Writes every micro-batch of the named queries (of all, without ``names``) to a Parquet table.

    Spark keeps only the latest progress records of a query in memory, and none of a query that has ended with its
    session. Here each batch is one directory named by query and batch id, so a batch that is reported twice is
    still one row, and a restart from the same checkpoint goes on in the same table.
    """

    def __init__(self, spark: SparkSession, path: str, names: Collection[str] = ()) -> None:
        self.spark, self.path, self.names = spark, str(path), set(names)

    def onQueryStarted(self, event) -> None:
        """Only batches are recorded."""

    def onQueryIdle(self, event) -> None:
        """Nothing arrived, so there is no batch."""

    def onQueryTerminated(self, event) -> None:
        """Only batches are recorded."""

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.names and progress.name not in self.names:
            return
        state = progress.stateOperators
        observed = {name: row.asDict() for name, row in progress.observedMetrics.items()}
        row = (
            progress.name,
            str(progress.runId),
            progress.timestamp,
            progress.numInputRows,
            progress.durationMs.get("triggerExecution"),
            sum(operator.numRowsTotal for operator in state),
            sum(operator.numRowsDroppedByWatermark for operator in state),
            json.dumps(observed),
        )
        target = f"{self.path}/query_id={progress.id}/batch_id={progress.batchId}"
        one = self.spark.createDataFrame([row], PROGRESS_DDL).coalesce(1)
        one.write.mode("overwrite").parquet(target)


@contextmanager
def recorded_progress(
    spark: SparkSession, path: str | None, names: Collection[str] = ()
) -> Iterator[None]:
    """Record progress for the time of a block; all batches that ended in it are in the table after it.

    Without a ``path`` nothing is recorded.
    """
    if path is None:
        yield
        return
    listener = ProgressTable(spark, path, names)
    spark.streams.addListener(listener)
    try:
        yield
    finally:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(WAIT_MS)
        spark.streams.removeListener(listener)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query and batch id."""
    return spark.read.schema(f"{PROGRESS_DDL}, query_id string, batch_id bigint").parquet(str(path))


def arrived_rows(progress: DataFrame) -> int:
    """Rows that the streams read in all their batches."""
    return progress.agg(F.coalesce(F.sum("input_rows"), F.lit(0))).first()[0]


def observed_total(progress: DataFrame, name: str, metric: str) -> int:
    """Sum over all batches of one number that a query observed."""
    value = F.get_json_object("observed", f"$.{name}.{metric}").cast("long")
    return progress.agg(F.coalesce(F.sum(value), F.lit(0))).first()[0]
