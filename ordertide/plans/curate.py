"""Curate bronze into silver and gold, check the gates, export, then publish.

Every run writes tables and exports to its own directory. Readers follow the publication log, to
which a run is appended only after its gates passed and its exports are complete; nothing that
readers reach through the log is ever overwritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from functools import partial

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ordertide.contract import (
    DEFAULT_CONTRACT,
    FORECAST_HORIZON,
    REPORT_PROFILE,
    REPORT_SEED,
    OrderContract,
)
from ordertide.operators import forecast as fc
from ordertide.operators import marts, quality, reconcile, resolve
from ordertide.plans.layout import Layout
from ordertide.plans.settings import (
    applied,
    at_once,
    file_system,
    path_bytes,
    require_utc,
    session_settings,
)
from ordertide.sinks.files import export_csv, write_report
from ordertide.sources.files import read_bronze

# Bytes as they are stored and shuffled. Sorted for a deduplication, rows take about eight times as much in a task.
PARTITION_BYTES = 32 << 20
# Stored bytes of a scan task. It sorts its rows as well before copies are collapsed, decoded from compressed Parquet.
SPLIT_BYTES = 8 << 20

# Published table -> (layer, stored table). The clean and rejected events are the two partitions of
# one stored table, so one job resolves the events and writes both.
TABLES = {
    "order_events_clean": ("silver", "order_events"),
    "order_events_rejected": ("silver", "order_events"),
    "current_order_state": ("silver", "current_order_state"),
    "sales_cells": ("gold", "sales_cells"),
    "daily_sales": ("gold", "daily_sales"),
    "province_sales": ("gold", "province_sales"),
    "sales_velocity": ("gold", "sales_velocity"),
    "sales_forecast": ("gold", "sales_forecast"),
}
EXPORT_ORDER = {
    "daily_sales": ["order_date", "province", "category"],
    "province_sales": ["province"],
    "sales_velocity": ["sales_hour", "province"],
    "sales_forecast": ["forecast_date"],
}
STREAM_DDL = (
    "rows_before bigint, rows_after bigint, rows_landed bigint, batch_id bigint, input_rows bigint"
)
REPORT_DDL = f"""
    status string,
    profile string,
    seed int,
    generated_at string,
    events struct<bronze bigint, deduplicated bigint, duplicates bigint, accepted bigint,
                  quarantined bigint>,
    orders struct<current bigint, active bigint, cancelled bigint>,
    gold struct<daily_sales bigint, province_sales bigint, sales_velocity bigint,
                forecast_rows bigint, revenue_vnd double>,
    assertions struct<event_occurrences_reconcile boolean, classification_reconciles boolean,
                      current_state_reconciles boolean, daily_sales_nonempty boolean,
                      province_sales_nonempty boolean, forecast_horizon_is_seven boolean,
                      positive_revenue boolean>,
    stream struct<{STREAM_DDL}>
"""


class ContractViolation(RuntimeError):
    """A required field is missing or incompatible."""


class GateFailure(RuntimeError):
    """A release gate failed; the run was not published."""


def require_fields(bronze: DataFrame) -> None:
    """Raise if any required field of any occurrence is NULL."""
    broken = quality.required_field_violations(bronze).filter("null_rows > 0").collect()
    if broken:
        found = ", ".join(f"{row['field']}: {row['null_rows']}" for row in broken)
        raise ContractViolation(f"NULL in required fields ({found})")


def quality_report(
    numbers: Row,
    gates: list[str],
    stream: dict | None = None,
    profile: str = REPORT_PROFILE,
    seed: int = REPORT_SEED,
) -> dict:
    """The report document from one row that holds the counts and the columns named ``gates``."""

    def pick(*names: str) -> dict:
        return {name: numbers[name] for name in names}

    assertions = pick(*gates)

    return {
        "status": "PASS" if all(assertions.values()) else "FAIL",
        "profile": profile,
        "seed": seed,
        "generated_at": datetime.now(timezone.utc).isoformat(),
        "events": pick("bronze", "deduplicated", "duplicates", "accepted", "quarantined"),
        "orders": pick("current", "active", "cancelled"),
        "gold": pick(
            "daily_sales", "province_sales", "sales_velocity", "forecast_rows", "revenue_vnd"
        ),
        "assertions": assertions,
        "stream": stream,
    }


def curate_and_publish(
    spark: SparkSession,
    root: str,
    *,
    export_dir: str | None = None,
    contract: OrderContract = DEFAULT_CONTRACT,
    horizon: int = FORECAST_HORIZON,
    enforce_required: bool = False,
    quarantine_missing: bool = False,
    stream: dict | None = None,
    profile: str = REPORT_PROFILE,
    seed: int = REPORT_SEED,
    settings: dict[str, str] | None = None,
) -> dict:
    """Resolve, classify, build state, marts and forecast, check the gates, export and publish.

    Each table is written once and read back, so bronze is resolved once and the order state is
    scanned once for all marts. NULLs in required fields pass by default; ``enforce_required``
    refuses to curate them, ``quarantine_missing`` rejects those occurrences one by one instead.
    ``stream`` (the result of the landing), ``profile`` and ``seed`` go into the report.
    ``settings`` replaces the session settings that follow from the size of bronze; they hold for
    this run only. ``export_dir`` gets a copy of the exports after the run is published.
    """
    require_utc(spark)
    layout = Layout(str(root))
    if settings is None:
        size = sum(path_bytes(spark, path) for path in layout.bronze_sources)
        settings = session_settings(size, PARTITION_BYTES, split_bytes=SPLIT_BYTES)
    with applied(spark, settings):
        run_id, report = _curate(
            spark, layout, contract, horizon, enforce_required, quarantine_missing,
            partial(quality_report, stream=stream, profile=profile, seed=seed),
        )
        release(spark, layout, run_id, report, export_dir)
    return report


def release(
    spark: SparkSession, layout: Layout, run_id: str, report: dict, export_dir: str | None = None
) -> None:
    """Export and publish a run whose gates passed."""
    if report["status"] != "PASS":
        raise GateFailure(f"Release gates failed; see {layout.report(run_id)}")
    export_tables(spark, layout.root, run_id)
    _publish(spark, layout, run_id)
    if export_dir is not None:
        export_tables(spark, layout.root, run_id, str(export_dir))


def _curate(
    spark: SparkSession,
    layout: Layout,
    contract: OrderContract,
    horizon: int,
    enforce_required: bool,
    quarantine_missing: bool,
    report_of: Callable[[Row, list[str]], dict],
) -> tuple[str, dict]:
    """Write all tables and the report of a new run from bronze; its id and report."""
    bronze = read_bronze(spark, layout.bronze_sources)
    if enforce_required:
        require_fields(bronze)
    whole = bronze.filter(quality.is_complete()) if quarantine_missing else bronze
    classified = quality.classify_events(resolve.dedup_counting_copies(whole), contract)
    if quarantine_missing:
        classified = classified.unionByName(quality.quarantine_incomplete(bronze))
    return write_run(spark, layout, classified, horizon, report_of, bronze=bronze)


def write_run(
    spark: SparkSession,
    layout: Layout,
    classified: DataFrame,
    horizon: int,
    report_of: Callable[[Row, list[str]], dict],
    *,
    bronze: DataFrame | None = None,
    occurrences: DataFrame | None = None,
    state: DataFrame | None = None,
    cells: DataFrame | None = None,
) -> tuple[str, dict]:
    """Write the tables that follow from ``classified`` events, and their report; run id and report.

    Order ``state`` and sales ``cells`` are derived unless they are known already.
    """
    run_id = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S%fZ}-{uuid.uuid4().hex[:8]}"
    numbers: dict[str, float | None] = {}

    def stage(
        frame: DataFrame, table: str, counts: list[Column], *partition_by: str
    ) -> DataFrame:
        """Write a table; what the report needs of it is counted while it is written."""
        layer, stored = TABLES[table]
        path = layout.run_table(run_id, layer, stored)
        written, found = reconcile.observed_write(frame, path, counts, *partition_by)
        numbers.update(found)
        return written

    if occurrences is not None:
        numbers.update(occurrences.first().asDict())
    elif bronze is not None:
        numbers.update(reconcile.bronze_counts(bronze).first().asDict())
    known = dict(numbers)
    outcomes = reconcile.classification_columns()
    classified = stage(_with_outcome(classified), "order_events_clean", outcomes, "outcome")
    numbers.update(known)  # copies that were counted before the run count
    if state is None:
        state = resolve.current_order_state(_clean(classified))
    state = stage(state, "current_order_state", reconcile.state_columns())
    if cells is None:
        cells = marts.sales_cells(resolve.active_orders(state))
    cells = stage(cells, "sales_cells", reconcile.revenue_columns())
    daily, _, _ = at_once(
        spark,
        *(
            partial(stage, mart(cells), table, reconcile.row_columns(table))
            for table, mart in (
                ("daily_sales", marts.daily_sales),
                ("province_sales", marts.province_sales),
                ("sales_velocity", marts.sales_velocity),
            )
        ),
    )
    if not numbers["daily_sales"]:
        raise RuntimeError("Cannot forecast: the daily sales series is empty")
    outlook = fc.sales_forecast(daily, horizon)
    stage(outlook, "sales_forecast", reconcile.row_columns("forecast_rows"))

    counts = reconcile.counts_of(spark, numbers)
    gates = reconcile.release_gates(counts, horizon)
    checked = counts.select("*", *reconcile.gate_columns(horizon)).first()
    report = report_of(checked, gates.columns)
    write_report(spark.createDataFrame([report], REPORT_DDL), layout.report(run_id))
    return run_id, report


def export_tables(
    spark: SparkSession, root: str, run_id: str | None = None, export_dir: str | None = None
) -> None:
    """Sorted CSV of the gold tables, into the run's directory or a copy to ``export_dir``."""
    layout = Layout(str(root))
    run = run_id or latest_run(spark, root)
    at_once(
        spark,
        *(
            partial(
                export_csv,
                open_table(spark, root, table, run),
                f"{export_dir}/{table}.csv" if export_dir else layout.run_export(run, table),
                order,
            )
            for table, order in EXPORT_ORDER.items()
        ),
    )


def exported_path(spark: SparkSession, root: str, table: str, run_id: str | None = None) -> str:
    """Where the CSV export of a published table is, of the latest run unless one is named."""
    return Layout(str(root)).run_export(run_id or latest_run(spark, root), table)


def expire_runs(spark: SparkSession, root: str, keep: int) -> list[str]:
    """Delete all runs before the last ``keep`` published ones; the ids of the deleted runs.

    Runs that failed go with the published ones around them. A run in progress is later than every
    published run, so it is never touched, nor is the published one.
    """
    if keep < 1:
        raise ValueError("The published run must be kept")
    layout = Layout(str(root))
    published = spark.read.parquet(layout.published).select("run_id").distinct()
    kept = [row.run_id for row in published.orderBy(F.desc("run_id")).limit(keep).collect()]
    oldest = min([*kept, latest_run(spark, root)])
    target, files = file_system(spark, layout.runs)
    found = sorted(status.getPath().getName() for status in files.listStatus(target))
    expired = [run_id for run_id in found if run_id < oldest]
    for run_id in expired:
        files.delete(file_system(spark, layout.run(run_id))[0], True)
    return expired


def _with_outcome(classified: DataFrame) -> DataFrame:
    accepted = F.col(quality.REASON).isNull()
    return classified.withColumn("outcome", F.when(accepted, "accepted").otherwise("rejected"))


def _clean(stored: DataFrame) -> DataFrame:
    return stored.filter("outcome = 'accepted'").drop("outcome", quality.REASON, resolve.COPIES)


def _rejected(stored: DataFrame) -> DataFrame:
    return stored.filter("outcome = 'rejected'").drop("outcome", resolve.COPIES)


def _publish(spark: SparkSession, layout: Layout, run_id: str) -> None:
    entry = spark.createDataFrame([(run_id,)], "run_id string")
    entry.select("run_id", F.current_timestamp().alias("published_at")).coalesce(1).write.mode(
        "append"
    ).parquet(layout.published)


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """The report of every run, published or not, with its ``run_id``."""
    return spark.read.schema(f"{REPORT_DDL}, run_id string").json(Layout(str(root)).reports)


def latest_run(spark: SparkSession, root: str) -> str:
    """Id of the run published last. Run ids start with their time, so they sort by it."""
    published = spark.read.parquet(Layout(str(root)).published)
    return published.agg(F.max_by("run_id", F.struct("published_at", "run_id"))).first()[0]


def open_table(
    spark: SparkSession, root: str, table: str, run_id: str | None = None
) -> DataFrame:
    """A published table, of the latest run unless ``run_id`` names one."""
    layer, stored = TABLES[table]
    run = run_id or latest_run(spark, root)
    frame = spark.read.parquet(Layout(str(root)).run_table(run, layer, stored))
    if table == "order_events_clean":
        return _clean(frame)
    if table == "order_events_rejected":
        return _rejected(frame)
    return frame
