"""The physical plans scale: no Python, no Cartesian joins, keys trimmed before shuffles."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as entry_module
from checks.queries import QUERIES
from ordertide.contract import EVENT_COLUMNS
from ordertide.operators import resolve
from ordertide.plans import mapping
from ordertide.plans.bucketed import changed_orders, changed_winners, write_bucketed
from ordertide.plans.settings import applied

SF_DIR = "/root/testdata/sf0.001"
# Queries that run jobs of their own and then read files back.
PREFIXES = ("stream_", "incremental_", "curated_", "exported_", "replayed_", "bucketed_")
STREAMS = {name for name in QUERIES if name.startswith(PREFIXES)} | {
    "quality_report",
    "failed_quality_report",
    "quarantined_missing_events",
    "quality_counts",
    "release_gates",
}


def plan_of(capsys, frame) -> str:
    capsys.readouterr()
    frame.explain("formatted")
    return capsys.readouterr().out


def tree_of(plan: str) -> str:
    return plan.split("\n\n\n")[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_plans_stay_in_the_jvm_and_never_cross_join(spark, capsys, name):
    plan = plan_of(capsys, entry_module.queries()[name](spark, SF_DIR))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan


@pytest.mark.parametrize("name", ["dedup_latest_event", "current_order_state"])
def test_groups_are_trimmed_before_the_shuffle(spark, capsys, name):
    plan = tree_of(plan_of(capsys, entry_module.queries()[name](spark, SF_DIR)))
    above, below = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_a_single_mart_shuffles_orders_once(spark, capsys):
    """event id, order id, province, and the sort: no extra exchange for distinct orders."""
    plan = tree_of(plan_of(capsys, QUERIES["sales_velocity"](spark, SF_DIR)))
    top = plan.split("WindowGroupLimit")[0]
    assert len(re.findall(r"\+- Exchange", top)) == 2


def test_top_provinces_need_no_window_over_all_rows(spark, capsys):
    plan = tree_of(plan_of(capsys, QUERIES["top_provinces"](spark, SF_DIR)))
    assert "TakeOrderedAndProject" in plan
    assert not re.search(r"Window \(\d+\)\n +\+- .*Sort \(\d+\)\n +\+- Exchange SinglePartition", plan)


def test_lines_move_twice_to_find_part_order_and_place(spark):
    with applied(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        events = mapping.lineitem_events(spark, SF_DIR)
        lines = events._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Scan parquet" in line and "l_orderkey" in line)
    depth, moves = re.search(r"\w", lines[at]).start(), 0
    for line in reversed(lines[:at]):  # what stands above the scan of the lines
        if line.strip() and (start := re.search(r"\w", line).start()) < depth:
            depth, moves = start, moves + ("Exchange hashpartitioning" in line)
    assert moves == 2


def test_ranked_provinces_compute_the_mart_once(spark, capsys):
    """Ranks and rows are joined from what was stored, not from two runs over all lines."""
    assert "l_orderkey" not in plan_of(capsys, QUERIES["ranked_provinces"](spark, SF_DIR))


def test_copies_are_counted_before_the_shuffle(spark, capsys):
    events = mapping.activity_events(spark, SF_DIR)
    plan = tree_of(plan_of(capsys, resolve.dedup_counting_copies(events)))
    above, below = plan.split("Exchange", 1)
    assert "Aggregate" in above and "Aggregate" in below
    assert plan.count("Exchange") == 1


def test_mart_scans_read_only_the_columns_they_need(spark, capsys):
    plan = plan_of(capsys, entry_module.queries()["province_sales"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert not any("l_tax" in s or "l_discount" in s or "p_name" in s for s in schemas)


@pytest.mark.parametrize(
    "name", ["curated_sales_forecast", "incremental_release_gates", "stream_landing_metrics"]
)
def test_plans_of_the_jobs_that_write(spark, monkeypatch, name):
    """Runs, refreshes and streams: the plan of every table and file they write."""
    plans = []

    def spied(write):
        def call(self, *args, **options):
            plans.append(self._df._jdf.queryExecution().executedPlan().toString())
            return write(self, *args, **options)

        return call

    for kind in ("parquet", "json", "csv"):
        monkeypatch.setattr(DataFrameWriter, kind, spied(getattr(DataFrameWriter, kind)))
    QUERIES[name](spark, SF_DIR)
    assert plans
    for plan in plans:
        for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert operator not in plan


def test_filters_on_the_dedup_key_reach_the_scan(spark, tmp_path, capsys):
    from events import event, frame

    from ordertide.operators.resolve import dedup_latest_event

    frame(spark, [event("e1"), event("e2")]).write.parquet(str(tmp_path / "t"))
    resolved = dedup_latest_event(spark.read.parquet(str(tmp_path / "t")))
    assert "EqualTo(event_id,e1)" in plan_of(capsys, resolved.filter("event_id = 'e1'"))


@pytest.mark.parametrize(("key", "resolved"), [("event_id", changed_winners), ("order_id", changed_orders)])
def test_bucketed_history_is_not_shuffled(spark, tmp_path, capsys, key, resolved):
    """Only the batch moves: every exchange of the join lies above a scan of the batch."""
    state = resolve.current_order_state(resolve.dedup_latest_event(mapping.activity_events(spark, SF_DIR)))
    columns = state.columns if key == "order_id" else EVENT_COLUMNS
    history = write_bucketed(state.select(*columns), f"history_{key}", str(tmp_path / key), key, 8)
    batch = mapping.activity_events(spark, SF_DIR).limit(100)
    batch.write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    with applied(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        changed = resolved(history, batch.filter(f"{key} IS NOT NULL"))
        plan = plan_of(capsys, changed)
    details = plan.split("\n\n\n")[1]
    bucketed = [b for b in details.split("\n\n") if "Batched: true" in b and f"/{key}" in b]
    assert len([b for b in bucketed if "Bucketed: true" in b]) >= 1
    tree = tree_of(plan)
    join = tree[tree.index("SortMergeJoin") :]
    side = join.split("Scan parquet")  # the batch, then the history of the join
    assert "Exchange" in side[0] and "Exchange" not in side[1].split("Union")[0]
    spark.sql(f"DROP TABLE history_{key}")
