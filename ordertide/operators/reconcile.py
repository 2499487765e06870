"""Reconciliation counts and release gates, as one-row frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ordertide.contract import CANCELLED, FORECAST_HORIZON
from ordertide.operators.quality import REASON
from ordertide.operators.resolve import COPIES
from ordertide.sinks.files import write_table


def bronze_counts(bronze: DataFrame) -> DataFrame:
    return bronze.agg(F.count("*").alias("bronze"))


def classification_columns() -> list[Column]:
    """Rows by outcome, and the copies that were collapsed into them."""
    return [
        F.count("*").alias("deduplicated"),
        F.count_if(F.col(REASON).isNull()).alias("accepted"),
        F.count_if(F.col(REASON).isNotNull()).alias("quarantined"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("surplus_copies"),
    ]


def state_columns() -> list[Column]:
    return [
        F.count("*").alias("current"),
        F.count_if(F.col("event_type") != CANCELLED).alias("active"),
        F.count_if(F.col("event_type") == CANCELLED).alias("cancelled"),
    ]


def revenue_columns() -> list[Column]:
    """Total active revenue, not rounded; 0.0 if there is none."""
    exact, stray = F.sum("amount"), F.sum("stray")
    whole = F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(stray, F.lit(0.0))
    return [whole.alias("revenue_vnd")]


def row_columns(name: str) -> list[Column]:
    return [F.count("*").alias(name)]


COUNT_DDL = ", ".join(
    f"{name} bigint"
    for name in (
        "bronze", "deduplicated", "accepted", "quarantined", "surplus_copies", "current", "active", "cancelled",
        "daily_sales", "province_sales", "sales_velocity", "forecast_rows",
    )
) + ", revenue_vnd double"


def observed_write(
    frame: DataFrame, path: str, columns: Sequence[Column], *partition_by: str
) -> tuple[DataFrame, dict]:
    """Write a table and count it in the same pass; the table read back, and its numbers.

    The counts are taken where the rows are written, in the stage that returns to the driver, so a task that
    runs again after an executor was lost does not count twice.
    """
    seen = Observation()
    stored = write_table(frame.observe(seen, *columns), path, *partition_by)
    return stored, seen.get


def counts_of(spark: SparkSession, numbers: Mapping[str, float | None]) -> DataFrame:
    """All reconciliation numbers of one run in one row, from what was counted on the way."""
    names = [part.split()[0] for part in COUNT_DDL.split(", ")]
    row = tuple(numbers.get(name) or (0.0 if name == "revenue_vnd" else 0) for name in names)
    return spark.createDataFrame([row], COUNT_DDL).withColumn(
        "duplicates", F.col("bronze") - F.col("deduplicated")
    )


def row_count(frame: DataFrame, name: str) -> DataFrame:
    return frame.agg(F.count("*").alias(name))


def one_row(*parts: DataFrame) -> DataFrame:
    """Merge one-row frames with different columns into one wide row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*(F.max(name).alias(name) for name in stacked.columns))


def quality_counts(
    *,
    bronze: DataFrame | None = None,
    occurrences: DataFrame | None = None,
    classified: DataFrame,
    state: DataFrame,
    cells: DataFrame,
    daily: DataFrame,
    province: DataFrame,
    velocity: DataFrame,
    forecast: DataFrame,
) -> DataFrame:
    """All reconciliation numbers of one run in one row.

    ``classified`` carries ``copies`` (see `dedup_counting_copies`): bronze rows and the sum of
    copies are counted on either side of the deduplication, so they differ if a row got lost.
    ``occurrences`` (one row: bronze, surplus_copies) stands for both where they were counted before.
    """
    outcomes = classified.agg(*classification_columns())
    if occurrences is not None:
        outcomes = outcomes.drop("surplus_copies")
    return one_row(
        bronze_counts(bronze) if occurrences is None else occurrences,
        outcomes,
        state.agg(*state_columns()),
        row_count(daily, "daily_sales"),
        row_count(province, "province_sales"),
        row_count(velocity, "sales_velocity"),
        row_count(forecast, "forecast_rows"),
        cells.agg(*revenue_columns()),
    ).withColumn("duplicates", F.col("bronze") - F.col("deduplicated"))


def gate_columns(horizon: int = FORECAST_HORIZON) -> list[Column]:
    """The release gates as boolean columns over ``quality_counts``."""
    c = F.col
    gates = {
        "event_occurrences_reconcile": c("bronze") == c("deduplicated") + c("surplus_copies"),
        "classification_reconciles": c("deduplicated") == c("accepted") + c("quarantined"),
        "current_state_reconciles": c("current") == c("active") + c("cancelled"),
        "daily_sales_nonempty": c("daily_sales") > 0,
        "province_sales_nonempty": c("province_sales") > 0,
        "forecast_horizon_is_seven": c("forecast_rows") == horizon,
        # Spark orders NaN above every number; a NaN total is not a positive revenue.
        "positive_revenue": (c("revenue_vnd") > 0) & ~F.isnan("revenue_vnd"),
    }
    return [gate.alias(name) for name, gate in gates.items()]


def release_gates(counts: DataFrame, horizon: int = FORECAST_HORIZON) -> DataFrame:
    return counts.select(*gate_columns(horizon))
