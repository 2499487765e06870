"""Curation end to end: tables, gates, report, exports and publication."""

import json
import re
from pathlib import Path

import pytest
from events import as_dicts, event, frame, write_jsonl
from test_streaming import land_history, rows_of

from ordertide.operators import forecast as fc
from ordertide.operators import marts, quality, resolve
from ordertide.plans import curate
from ordertide.plans.curate import (
    ContractViolation,
    GateFailure,
    curate_and_publish,
    expire_runs,
    exported_path,
    latest_run,
    open_table,
    read_reports,
)
from ordertide.plans.layout import Layout
from ordertide.plans.settings import applied, apply_settings, scratch_path, session_settings
from ordertide.sources.files import read_bronze, read_province_dimension
from ordertide.operators.measures import with_geography
from ordertide.sinks import files
from ordertide.streaming import landing
from ordertide.streaming.landing import land_file_stream


def land(spark, tmp_path, rows):
    write_jsonl(tmp_path / "incoming" / "a.jsonl", rows)
    land_file_stream(spark, tmp_path / "incoming", tmp_path / "data")
    return tmp_path / "data"


def test_full_run(spark, tmp_path):
    _, root, landing = land_history(spark, tmp_path)
    exports = tmp_path / "exports"
    report = curate_and_publish(spark, root, export_dir=exports, stream=landing)
    assert report["status"] == "PASS" and all(report["assertions"].values())
    assert len(report["assertions"]) == 7
    events, orders, gold = report["events"], report["orders"], report["gold"]
    assert (events["bronze"], events["duplicates"], events["deduplicated"]) == (208, 8, 200)
    assert (events["accepted"], events["quarantined"]) == (184, 16)
    assert orders["current"] == orders["active"] + orders["cancelled"]
    assert gold["forecast_rows"] == 7 and gold["revenue_vnd"] > 0

    bronze = read_bronze(spark, Layout(str(root)).bronze_sources)
    classified = quality.classify_events(resolve.dedup_latest_event(bronze))
    accepted = quality.accepted_events(classified)
    state = resolve.current_order_state(accepted)
    cells = marts.order_cells(resolve.active_orders(state))
    expected = {
        "order_events_clean": accepted,
        "order_events_rejected": quality.rejected_events(classified),
        "current_order_state": state,
        "daily_sales": marts.daily_sales(cells),
        "province_sales": marts.province_sales(cells),
        "sales_velocity": marts.sales_velocity(cells),
        "sales_forecast": fc.sales_forecast(marts.daily_sales(cells)),
    }
    for table, frame in expected.items():
        stored = open_table(spark, root, table)
        assert stored.columns == frame.columns, table
        assert rows_of(stored) == rows_of(frame), table

    (stored_report,) = as_dicts(read_reports(spark, root))
    assert stored_report["run_id"] == latest_run(spark, root)
    assert stored_report["stream"]["rows_landed"] == 208
    assert stored_report["assertions"]["positive_revenue"] is True

    for name in ("daily_sales", "province_sales", "sales_velocity", "sales_forecast"):
        parts = sorted((exports / f"{name}.csv").glob("part-*.csv"))
        lines = [line for part in parts for line in part.read_text().splitlines()]
        assert lines[0].split(",") == open_table(spark, root, name).columns
        assert len(lines) == 1 + open_table(spark, root, name).count()
        assert lines[1:] == sorted(lines[1:]), "exports are sorted"
        assert not re.search(r"\dE\d", "".join(lines)) and "T" not in lines[1].split(",")[0]


def test_failing_export_leaves_the_old_run_published(spark, tmp_path, monkeypatch):
    root = land(spark, tmp_path, [event("e1")])
    curate_and_publish(spark, root)
    first = latest_run(spark, root)
    exported = exported_path(spark, root, "daily_sales")
    before = sorted(Path(exported).iterdir())

    def refuse(*_):
        raise OSError("no space")

    monkeypatch.setattr("ordertide.plans.curate.export_csv", refuse)
    with pytest.raises(OSError, match="no space"):
        curate_and_publish(spark, root)
    assert latest_run(spark, root) == first
    assert exported_path(spark, root, "daily_sales") == exported
    assert sorted(Path(exported).iterdir()) == before
    assert read_reports(spark, root).count() == 2


def test_a_lost_row_fails_the_occurrence_gate_only(spark, tmp_path, monkeypatch):
    rows = [event("e1"), event("e1", ingest_ts="2025-01-06T11:00:00+00:00"), event("e2", order_id="O2")]
    root = land(spark, tmp_path, rows)
    assert curate_and_publish(spark, root)["assertions"]["event_occurrences_reconcile"] is True
    whole = resolve.dedup_counting_copies

    def lossy(events):
        return whole(events).filter("event_id <> 'e2'")

    monkeypatch.setattr("ordertide.plans.curate.resolve.dedup_counting_copies", lossy)
    with pytest.raises(GateFailure):
        curate_and_publish(spark, root)
    failed = read_reports(spark, root).filter("status = 'FAIL'").select("assertions.*").first()
    assert [name for name, holds in failed.asDict().items() if not holds] == [
        "event_occurrences_reconcile"
    ]


def test_broken_lines_through_landing_and_curation(spark, tmp_path):
    rows = [
        event("e1"),
        "{broken",
        "not json",
        "{broken",
        json.dumps(event("e2", order_id="O2")).replace('"quantity": 2', '"quantity": "7"'),
    ]
    root = land(spark, tmp_path, rows)
    bronze = read_bronze(spark, Layout(str(root)).bronze_sources)
    raw = [r.raw_record for r in bronze.filter("raw_record IS NOT NULL").collect()]
    assert sorted(raw) == sorted(rows[1:])
    with pytest.raises(ContractViolation, match="event_id: 3"):
        curate_and_publish(spark, root, enforce_required=True)
    with pytest.raises(GateFailure):
        curate_and_publish(spark, root)  # broken lines have no event type
    report = curate_and_publish(spark, root, quarantine_missing=True)
    assert report["events"] == {
        "bronze": 5, "deduplicated": 5, "duplicates": 0, "accepted": 1, "quarantined": 4,
    }
    rejected = open_table(spark, root, "order_events_rejected")
    assert {r.rejection_reason for r in rejected.collect()} == {"missing_required_field"}
    assert sorted(r.raw_record for r in rejected.collect()) == sorted(raw)


def test_a_run_uses_settings_for_its_size_and_gives_them_back(spark, tmp_path, monkeypatch):
    root = land(spark, tmp_path, [event("e1")])
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    seen = []
    stage = resolve.current_order_state

    def spy(accepted):
        seen.append(spark.conf.get(key, None))
        return stage(accepted)

    monkeypatch.setattr("ordertide.plans.curate.resolve.current_order_state", spy)
    before = spark.conf.get(key, None)
    curate_and_publish(spark, root)
    curate_and_publish(spark, root, settings={key: "3"})
    curate_and_publish(spark, root, settings={})
    assert seen == ["8", "3", before]
    assert spark.conf.get(key, None) == before


def test_old_runs_expire_and_the_published_one_stays(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1")])
    runs = []
    for _ in range(3):
        curate_and_publish(spark, root)
        runs.append(latest_run(spark, root))
    later = Path(Layout(str(root)).run("99991231T000000000000Z-running"))
    later.mkdir(parents=True)
    assert expire_runs(spark, root, keep=2) == runs[:1]
    assert expire_runs(spark, root, keep=1) == runs[1:2]
    assert expire_runs(spark, root, keep=1) == [] and later.exists()
    assert open_table(spark, root, "daily_sales").count() == 1
    with pytest.raises(ValueError, match="published"):
        expire_runs(spark, root, keep=0)


def test_report_names_its_profile(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1")])
    report = curate_and_publish(spark, root, profile="nightly", seed=7)
    assert (report["profile"], report["seed"]) == ("nightly", 7)


def test_second_run_publishes_beside_the_first(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1")])
    curate_and_publish(spark, root)
    first = latest_run(spark, root)
    old = open_table(spark, root, "daily_sales", first)
    write_jsonl(tmp_path / "incoming" / "b.jsonl", [event("e2", order_id="O2")])
    land_file_stream(spark, tmp_path / "incoming", root)
    curate_and_publish(spark, root)
    assert latest_run(spark, root) != first
    assert open_table(spark, root, "daily_sales").first()["orders"] == 2
    assert old.first()["orders"] == 1


def test_failing_gate_writes_the_report_but_publishes_nothing(spark, tmp_path):
    """A latest event without a type is neither active nor cancelled."""
    root = land(spark, tmp_path, [event("e1"), event("e2", order_id="O2", event_type=None)])
    with pytest.raises(GateFailure):
        curate_and_publish(spark, root)
    (report,) = as_dicts(read_reports(spark, root))
    assert report["status"] == "FAIL"
    assert report["assertions"]["current_state_reconciles"] is False
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        latest_run(spark, root)


def test_nan_revenue_fails_its_gate(spark, tmp_path):
    rows = [event("e1"), event("e2", order_id="O2", unit_price_vnd=float("nan"))]
    root = land(spark, tmp_path, rows)
    with pytest.raises(GateFailure):
        curate_and_publish(spark, root)
    (report,) = as_dicts(read_reports(spark, root))
    assert report["assertions"]["positive_revenue"] is False
    assert str(report["gold"]["revenue_vnd"]) == "nan"


def test_only_cancelled_orders_cannot_be_forecast(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1", event_type="cancelled")])
    with pytest.raises(RuntimeError, match="Cannot forecast"):
        curate_and_publish(spark, root)


def test_empty_bronze_cannot_be_forecast(spark, tmp_path):
    root = land(spark, tmp_path, [])
    with pytest.raises(RuntimeError, match="Cannot forecast"):
        curate_and_publish(spark, root)


def test_strict_mode_refuses_missing_required_fields(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1"), event("e2", order_id="O2", quantity=None)])
    assert curate_and_publish(spark, root)["status"] == "PASS"
    with pytest.raises(ContractViolation, match="quantity: 1"):
        curate_and_publish(spark, root, enforce_required=True)


def test_horizon_is_checked_by_its_gate(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1")])
    assert curate_and_publish(spark, root, horizon=3)["gold"]["forecast_rows"] == 3


def test_missing_bronze(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        curate_and_publish(spark, tmp_path)


def test_province_dimension_from_csv(spark, tmp_path):
    path = tmp_path / "provinces.csv"
    path.write_text("province,latitude,longitude\nHa Noi,21.0278,105.8342\n")
    mart = spark.createDataFrame([("Ha Noi", 1.0), ("Hue", 2.0)], "province string, revenue double")
    joined = with_geography(mart, read_province_dimension(spark, str(path)))
    assert {r["province"]: r["latitude"] for r in as_dicts(joined)} == {
        "Ha Noi": 21.0278,
        "Hue": None,
    }


def test_scratch_paths_are_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(f"{shared}/x-")


def test_a_session_in_another_zone_is_refused(spark, tmp_path):
    root = land(spark, tmp_path, [event("e1")])
    spark.conf.set("spark.sql.session.timeZone", "Asia/Ho_Chi_Minh")
    try:
        with pytest.raises(RuntimeError, match="timeZone"):
            curate_and_publish(spark, root)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_local_session_without_shared_folder_gets_its_own(spark, monkeypatch):
    from ordertide.plans import settings

    monkeypatch.setattr(settings, "CHECKPOINT_DIR", "spark.ordertide.unset")
    assert settings.shared_dir(spark) == settings.shared_dir(spark)
    assert "ordertide-" in settings.shared_dir(spark)


def test_settings_grow_with_the_input(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    small, middle, large = (session_settings(n) for n in (1 << 20, 1 << 40, 100 << 40))
    assert [int(s[key]) for s in (small, middle)] == [8, 12_288]
    split = int(large["spark.sql.files.maxPartitionBytes"])
    splits, partitions = (100 << 40) / split, int(large[key])
    assert splits * partitions == pytest.approx(4e9, rel=0.01)
    assert 3 * (100 << 40) / partitions == pytest.approx(split, rel=0.01)
    before = {name: spark.conf.get(name, None) for name in small}
    apply_settings(spark, small)
    assert spark.conf.get(key) == "8"
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_a_task_of_a_run_sorts_a_bounded_share_of_bronze(spark, tmp_path, monkeypatch):
    """640 MB of bronze were 3.5 GB when shuffled to be resolved, and eight times that when sorted."""
    root, seen = land(spark, tmp_path, [event("e1"), event("e1")]), []
    monkeypatch.setattr(curate, "path_bytes", lambda spark, path: 320 << 20)

    def spied(spark, settings):
        seen.append(settings)
        return applied(spark, settings)

    monkeypatch.setattr(curate, "applied", spied)
    curate_and_publish(spark, root)
    assert int(seen[0]["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) >= 60
    assert int(seen[0]["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) <= 32 << 20
    # A copy is held once while its latest is looked for.
    plan = resolve.dedup_counting_copies(frame(spark, [event("e1")]))._jdf.queryExecution().optimizedPlan()
    assert "max_by" not in plan.toString()


def test_a_task_of_a_landing_sorts_a_bounded_share_of_its_files(spark, tmp_path, monkeypatch):
    """1.6 GB of JSON lines were dealt into the session's shuffle partitions, however many bytes each got."""
    seen = []

    def spied(spark, settings):
        seen.append(settings)
        return applied(spark, settings)

    for module in (landing, files):
        monkeypatch.setattr(module, "applied", spied)
    monkeypatch.setattr(landing, "path_bytes", lambda spark, path: 1600 << 20)
    files.write_event_files(frame(spark, [event("e1"), event("e2")]), str(tmp_path / "incoming"))
    assert int(seen[0]["spark.sql.maxConcurrentOutputFileWriters"]) > 31  # dates of a month side by side, not sorted
    land_file_stream(spark, tmp_path / "incoming", tmp_path / "data")
    assert int(seen[1]["spark.sql.adaptive.coalescePartitions.initialPartitionNum"]) == 100
    assert read_bronze(spark, Layout(str(tmp_path / "data")).bronze_sources).count() == 2
    land_file_stream(spark, tmp_path / "incoming", tmp_path / "again", replays_within="1 day")
    assert seen[2] == {}


def test_a_scan_task_of_a_run_reads_less_than_a_reducer(spark):
    """Rows are sorted in the scan as well, decoded from compressed files."""
    scan = session_settings(1 << 30, curate.PARTITION_BYTES, split_bytes=curate.SPLIT_BYTES)
    assert int(scan["spark.sql.files.maxPartitionBytes"]) == 8 << 20
    assert scan["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == str(32 << 20)
