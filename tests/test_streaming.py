"""Landing, replay, several sources and the incremental marts."""

import json
import random
import time

import pyarrow as pa
import pytest
from events import as_dicts, event, frame, write_jsonl
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ordertide.contract import DEFAULT_CONTRACT, EVENT_COLUMNS
from ordertide.functions.payload import decode_payload, encode_payload
from ordertide.operators import marts, quality, resolve
from ordertide.plans.curate import GateFailure, latest_run, open_table
from ordertide.plans.layout import Layout
from ordertide.sinks.files import write_event_files
from ordertide.sinks.kafka import publish_events
from ordertide.sources.files import read_bronze, read_event_files, stream_event_files
from ordertide.sources.kafka import records_to_bronze
from ordertide.streaming import incremental, velocity
from ordertide.streaming.incremental import IncrementalMarts
from ordertide.streaming.landing import (
    bronze_rows,
    drain,
    follow_records,
    land_file_stream,
    landing_name,
    start_bronze_append,
    stream_from_kafka,
)
from ordertide.streaming.progress import arrived_rows, read_progress, recorded_progress


def day_file(incoming, day, rows):
    write_jsonl(incoming / f"event_date={day}" / "order_events.jsonl", rows)


def history(days=8, per_day=25):
    """Per day: one zero quantity, one unknown province and one exact copy."""
    rng = random.Random(7)
    for d in range(days):
        day = f"2025-01-{d + 1:02d}"
        rows = [
            event(
                f"{day}/{n}",
                order_id=f"{day}#{n if n < 20 else n - 20}",
                event_type="created" if n < 20 else rng.choice(["updated", "cancelled"]),
                quantity=rng.randint(1, 5),
                unit_price_vnd=1000.0 * rng.randint(1, 400),
                event_ts=f"{day}T{rng.randrange(24):02d}:{rng.randrange(60):02d}:00+00:00",
            )
            for n in range(per_day)
        ]
        rows[0]["quantity"], rows[1]["province"] = 0, "UNKNOWN"
        yield day, [*rows, dict(rows[2])]


def land_history(spark, tmp_path, **options):
    incoming, root = tmp_path / "incoming", tmp_path / "data"
    for day, rows in history():
        day_file(incoming, day, rows)
    return incoming, root, land_file_stream(spark, incoming, root, **options)


def test_drain_lands_every_row_once_and_a_rerun_lands_none(spark, tmp_path):
    incoming, root, first = land_history(spark, tmp_path, max_files_per_trigger=3, count_bronze=True)
    assert (first["rows_before"], first["rows_after"], first["rows_landed"]) == (0, 208, 208)
    assert first["input_rows"] == 208 and first["batch_id"] == 2
    second = land_file_stream(spark, incoming, root, count_bronze=True)
    assert (second["rows_before"], second["rows_landed"], second["input_rows"]) == (208, 0, 0)

    day_file(incoming, "2025-02-01", [event("late", event_ts="2025-02-01T00:00:00+00:00")])
    assert land_file_stream(spark, incoming, root)["rows_landed"] == 1
    quick = land_file_stream(spark, incoming, tmp_path / "quick", count_bronze=False)
    assert (quick["rows_before"], quick["rows_landed"]) == (None, 209)
    # A fresh root replays everything.
    assert land_file_stream(spark, incoming, tmp_path / "fresh")["rows_landed"] == 209


def test_a_stopped_stream_resumes_after_its_last_batch(spark, tmp_path):
    incoming, root = tmp_path / "incoming", tmp_path / "data"
    for day, rows in history():
        day_file(incoming, day, rows)
    layout = Layout(str(root))
    query = start_bronze_append(
        stream_event_files(spark, str(incoming), max_files_per_trigger=1),
        layout.file_bronze,
        layout.checkpoint("file_orders_to_bronze"),
        {"processingTime": "1 second"},
    )
    while not query.recentProgress:
        time.sleep(0.1)
    query.stop()
    landed = bronze_rows(spark, layout.file_bronze)
    assert 26 <= landed < 208
    rest = land_file_stream(spark, incoming, root, count_bronze=True)
    assert (rest["rows_before"], rest["rows_after"]) == (landed, 208)
    assert read_bronze(spark, layout.bronze_sources).count() == 208


def test_bronze_has_provenance_and_is_partitioned_by_event_date(spark, tmp_path, capsys):
    _, root, _ = land_history(spark, tmp_path)
    bronze = read_bronze(spark, Layout(str(root)).bronze_sources)
    assert bronze.columns == [*EVENT_COLUMNS, "source_file", "raw_record", "event_date"]
    assert bronze.filter(~F.col("source_file").contains("order_events.jsonl")).isEmpty()
    assert bronze.filter("event_date <> to_date(event_ts)").isEmpty()
    one_day = bronze.filter("event_date = DATE'2025-01-03'")
    assert one_day.count() == 26
    capsys.readouterr()
    one_day.explain("formatted")
    assert "PartitionFilters: [isnotnull(event_date" in capsys.readouterr().out


def test_files_per_date_bounds_the_files_of_a_micro_batch(spark, tmp_path):
    """Input files that mix dates: each task would write one file for each of them."""
    rows = [row for _, day in history() for row in day]
    for n in range(16):
        write_jsonl(tmp_path / "incoming" / f"{n}.jsonl", rows[n::16])
    files = {}
    for bound in (None, 2):
        root = tmp_path / f"data-{bound}"
        result = land_file_stream(spark, tmp_path / "incoming", root, files_per_date=bound)
        assert result["rows_landed"] == 208
        files[bound] = len(list((root / "lakehouse").glob("**/event_date=*/*.parquet")))
    assert files[2] <= 2 * 8 < files[None]


def test_empty_input_directory_lands_nothing(spark, tmp_path):
    (tmp_path / "incoming").mkdir()
    result = land_file_stream(spark, tmp_path / "incoming", tmp_path / "data")
    assert (result["rows_landed"], result["input_rows"]) == (0, 0)


def test_missing_bronze_is_reported(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_bronze(spark, Layout(str(tmp_path / "nowhere")).bronze_sources)


def test_bad_lines_and_fields_become_nulls(spark, tmp_path):
    rows = [
        event("e1", quantity="7"),
        event("e2", quantity=2_147_483_648),
        event("e3", event_ts="yesterday"),
        "{broken",
        {**event("e5"), "coupon": "X"},
    ]
    write_jsonl(tmp_path / "in" / "deep" / "er" / "a.jsonl", rows)
    got = as_dicts(read_event_files(spark, str(tmp_path / "in")))
    by_id = {r["event_id"]: r for r in got}
    assert by_id["e1"]["quantity"] is None and by_id["e2"]["quantity"] is None
    assert by_id["e3"]["event_ts"] is None
    assert all(value is None for value in by_id[None].values())
    assert set(by_id["e5"]) == set(EVENT_COLUMNS)
    corrupt = read_event_files(spark, str(tmp_path / "in"), keep_corrupt=True).collect()
    assert "{broken" in {r["_corrupt_record"] for r in corrupt}


def test_written_event_files_keep_microseconds(spark, tmp_path):
    rows = [event("e1", event_ts="2025-01-06T10:00:00.123456+00:00"), event("e2", category=None)]
    events = frame(spark, rows)
    write_event_files(events, str(tmp_path / "out"))
    back = read_event_files(spark, str(tmp_path / "out"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, events.collect()))


def test_payload_round_trip_and_broken_payloads(spark):
    events = frame(spark, [event("e1", event_ts="2025-01-06T10:00:00.000001+00:00")])
    records = encode_payload(events)
    assert records.select("key").first()[0] == "O1"
    assert decode_payload(records).collect() == events.collect()
    broken = spark.createDataFrame([(b"{oops",), (b"[]",), (None,)], "value binary")
    assert all(v is None for r in as_dicts(decode_payload(broken)) for v in r.values())


def kafka_like(records):
    return records.select(
        F.col("value").cast("binary").alias("value"),
        F.lit("ecommerce.order_events").alias("topic"),
        F.lit(0).alias("partition"),
        F.length("value").cast("long").alias("offset"),
    )


def test_two_sources_feed_one_bronze_without_losing_batches(spark, tmp_path):
    """Records read from text files stand in for a topic; both streams start at batch 0."""
    incoming, root, _ = land_history(spark, tmp_path)
    layout = Layout(str(root))
    extra = [event("late", order_id="OX"), dict(next(history())[1][2])]
    encode_payload(frame(spark, extra)).select("value").write.text(str(tmp_path / "topic"))
    records = spark.readStream.schema("value string").text(str(tmp_path / "topic"))
    query = start_bronze_append(
        records_to_bronze(kafka_like(records)),
        layout.kafka_bronze,
        layout.checkpoint("kafka_orders_to_bronze"),
        {"availableNow": True},
    )
    assert drain(query)["input_rows"] == 2
    bronze = read_bronze(spark, layout.bronze_sources)
    assert bronze.count() == 210
    assert bronze.filter("kafka_topic IS NOT NULL AND source_file IS NULL").count() == 2
    assert resolve.dedup_latest_event(bronze).count() == 201


def test_kafka_ends_reach_the_connector(spark, tmp_path):
    """The connector is not on the classpath here; Spark must get as far as looking for it."""
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        stream_from_kafka(spark, tmp_path, bootstrap="broker:9092")
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        publish_events(frame(spark, [event("e1")]), "broker:9092")


# --- progress, replays, archive ------------------------------------------------------------------


def test_every_batch_of_a_running_stream_is_recorded_once(spark, tmp_path):
    """A stream on a clock, stopped and started again from its checkpoint."""
    incoming, layout = tmp_path / "incoming", Layout(str(tmp_path / "data"))
    days = list(history())
    name = landing_name(layout.file_bronze)
    for part in (days[:5], days[5:]):
        for day, rows in part:
            day_file(incoming, day, rows)
        with recorded_progress(spark, tmp_path / "progress", [name]):
            query = start_bronze_append(
                stream_event_files(spark, str(incoming), max_files_per_trigger=1),
                layout.file_bronze,
                layout.checkpoint("file_orders_to_bronze"),
                {"processingTime": "200 milliseconds"},
            )
            query.processAllAvailable()
            query.stop()
        # Another stream of the session is not part of the table.
        land_file_stream(spark, incoming, tmp_path / f"other-{len(part)}")
    batches = read_progress(spark, tmp_path / "progress").orderBy("batch_id").collect()
    assert [b.batch_id for b in batches] == list(range(8))
    assert [b.input_rows for b in batches] == [26] * 8 and {b.name for b in batches} == {name}
    assert len({b.run_id for b in batches}) == 2 and len({b.query_id for b in batches}) == 1
    assert arrived_rows(read_progress(spark, tmp_path / "progress")) == bronze_rows(spark, layout.file_bronze)


def test_a_topic_records_its_batches_until_it_ends(spark, tmp_path):
    encode_payload(frame(spark, [event("e1"), event("e2")])).select("value").write.text(str(tmp_path / "topic"))
    records = spark.readStream.schema("value string").text(str(tmp_path / "topic"))
    follow_records(
        spark, records_to_bronze(kafka_like(records)), str(tmp_path), {"availableNow": True}, metrics=str(tmp_path / "progress")
    )
    assert arrived_rows(read_progress(spark, tmp_path / "progress")) == 2


def test_replayed_files_stop_before_bronze_and_state_stays_bounded(spark, tmp_path):
    incoming, root = tmp_path / "incoming", tmp_path / "data"
    first = [event("e1"), event("e1"), event("e1", ingest_ts="2025-02-01T00:00:00+00:00"), "{broken", "{broken"]
    write_jsonl(incoming / "a.jsonl", first)
    write_jsonl(incoming / "b.jsonl", [*first, event("old", ingest_ts="1999-01-01T00:00:00+00:00")])
    land_file_stream(spark, incoming, root, max_files_per_trigger=1, replays_within="1 day")
    write_jsonl(incoming / "c.jsonl", [event("e1"), event("e3")])  # again, after a restart
    land_file_stream(spark, incoming, root, replays_within="1 day")
    bronze = read_bronze(spark, Layout(str(root)).bronze_sources)
    ids = sorted((r.event_id or "", str(r.ingest_ts)[:4]) for r in bronze.collect())
    assert ids == [("", "None"), ("e1", "2025"), ("e1", "2025"), ("e3", "2025"), ("old", "1999")]
    assert resolve.dedup_latest_event(bronze).filter("event_id = 'e1'").first().ingest_ts.month == 2

    # What came longer ago than the bound leaves the state, however much has arrived.
    incoming, root = tmp_path / "many", tmp_path / "bounded"
    for k in range(6):
        write_jsonl(incoming / f"{k}.jsonl", [event(f"{k}/{i}") for i in range(50)])
        land_file_stream(spark, incoming, root, replays_within="0 seconds", metrics=tmp_path / "state")
    state = read_progress(spark, tmp_path / "state").orderBy("batch_id").collect()
    assert arrived_rows(read_progress(spark, tmp_path / "state")) == 300
    assert max(b.state_rows for b in state) <= 100
    assert bronze_rows(spark, Layout(str(root)).file_bronze) == 300


def test_archived_files_are_not_listed_and_not_landed_again(spark, tmp_path):
    incoming, root, archive = tmp_path / "incoming", tmp_path / "data", tmp_path / "archive"
    for k in range(3):
        write_jsonl(incoming / f"{k}.jsonl", [event(f"{k}/{i}") for i in range(4)])
        landed = land_file_stream(spark, incoming, root, archive=str(archive))
        assert landed["input_rows"] == 4
    left = sorted(p.name for p in incoming.glob("*.jsonl"))
    moved = sorted(p.name for p in archive.glob("**/*.jsonl"))
    assert left == ["2.jsonl"] and moved == ["0.jsonl", "1.jsonl"]
    assert land_file_stream(spark, incoming, root, archive=str(archive))["input_rows"] == 0
    bronze = read_bronze(spark, Layout(str(root)).bronze_sources)
    assert bronze.count() == 12 and bronze.select("event_id").distinct().count() == 12


# --- velocity preview -----------------------------------------------------------------------------


def test_sketches_of_hours_merge_within_their_bound(spark):
    """50,000 orders in 48 hours, each in two of them, and a third of all rows in one hour."""
    events = spark.range(150_000).select(
        F.concat(F.lit("e"), "id").alias("event_id"),
        F.concat(F.lit("O"), F.col("id") % 50_000).alias("order_id"),
        F.lit("Ha Noi").alias("province"),
        F.lit(1).alias("quantity"),
        F.lit(2.5).alias("unit_price_vnd"),
        F.lit("created").alias("event_type"),
        F.when(F.col("id") < 50_000, F.lit(0)).otherwise(F.col("id") % 48).alias("hour"),
    )
    start = F.to_timestamp(F.lit("2025-01-06 00:00:00"))
    hours = velocity.hourly_preview(events.withColumn("event_ts", F.timestamp_add("HOUR", "hour", start)))
    day = F.to_date("sales_hour").alias("day")
    days = velocity.merged_orders(hours, day)
    total = velocity.merged_orders(days).first()["orders"]
    exact = {r.day: r.n for r in events.groupBy((F.col("hour") >= 24).alias("day")).agg(F.countDistinct("order_id").alias("n")).collect()}
    for row, want in zip(days.orderBy("day").collect(), (exact[False], exact[True]), strict=True):
        assert abs(row["orders"] - want) <= 3 * velocity.STANDARD_ERROR * want
    assert abs(total - 50_000) <= 3 * velocity.STANDARD_ERROR * 50_000
    assert hours.agg(F.sum("events")).first()[0] == 150_000
    assert max(len(r.orders_sketch) for r in hours.collect()) <= 2 ** velocity.SKETCH_BITS + 64


def test_the_preview_updates_hours_and_counts_late_rows(spark, tmp_path):
    incoming, out, checkpoint = tmp_path / "in", str(tmp_path / "hours"), str(tmp_path / "checkpoint")

    def feed(name, rows):
        write_jsonl(incoming / f"{name}.jsonl", rows)
        with recorded_progress(spark, tmp_path / "progress", [velocity.preview_name(out)]):
            stream = stream_event_files(spark, str(incoming))
            drain(velocity.start_velocity_preview(stream, out, checkpoint, "2 hours", trigger={"availableNow": True}))
        hours = velocity.read_hours(spark, out)
        table = {r.sales_hour.hour: r.events for r in hours.collect()}
        return table, velocity.late_rows(hours, read_progress(spark, tmp_path / "progress"))

    def at(hour, n, **fields):
        return event(f"{hour}/{n}", order_id=f"O{hour}/{n}", event_ts=f"2025-01-06T{hour:02d}:30:00+00:00", **fields)

    assert feed("a", [at(8, 0), at(10, 0), at(10, 1, event_type="cancelled"), at(10, 2, quantity=0)]) == ({8: 1, 10: 1}, 0)
    # The watermark is 08:30: hour 8 is open until 09:00, hour 7 has ended.
    assert feed("b", [at(8, 1), at(7, 0), at(12, 0)]) == ({8: 2, 10: 1, 12: 1}, 1)
    assert feed("c", [at(8, 2), at(11, 0)]) == ({8: 2, 10: 1, 11: 1, 12: 1}, 2)
    preview = velocity.velocity_preview(velocity.read_hours(spark, out)).filter("hour(sales_hour) = 8").first()
    assert preview.approximate and preview.orders_per_hour == 2


# --- incremental marts ------------------------------------------------------------------------


def random_events(seed, n=400):
    """Out-of-order lifecycles, copies that name another order, bad rows, NULLs and stray prices."""
    rng = random.Random(seed)
    provinces = ["Ha Noi", "Da Nang", "Can Tho", "UNKNOWN"]
    for _ in range(n):
        yield event(
            rng.choice([f"e{rng.randrange(n // 2)}", f"x{rng.randrange(10**9)}", None])
            if rng.random() < 0.9
            else "hot",
            order_id=rng.choice([f"O{rng.randrange(60)}", "hot", None]),
            province=rng.choice(provinces),
            category=rng.choice(["Home", "Beauty", None]),
            quantity=rng.choice([0, 1, 2, 3, None]),
            unit_price_vnd=rng.choice([10.01, 99.995, 1e14, float("nan"), -1.0, 55.5, 7.25]),
            event_type=rng.choice(["created", "updated", "cancelled", "returned"]),
            event_ts=f"2025-01-0{rng.randint(1, 4)}T{rng.randrange(24):02d}:00:00+00:00",
            ingest_ts=f"2025-01-05T00:{rng.randrange(60):02d}:{rng.randrange(60):02d}+00:00",
        )


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def batch_tables(events):
    resolved = resolve.dedup_latest_event(events)
    accepted = quality.accepted_events(quality.classify_events(resolved, DEFAULT_CONTRACT))
    state = resolve.current_order_state(accepted)
    return state, marts.order_cells(resolve.active_orders(state))


def assert_matches_recompute(target, events):
    state, cells = batch_tables(events)
    assert rows_of(target.order_state()) == rows_of(state)
    assert rows_of(target.daily_sales()) == rows_of(marts.daily_sales(cells))
    assert rows_of(target.province_sales()) == rows_of(marts.province_sales(cells))
    assert rows_of(target.sales_velocity()) == rows_of(marts.sales_velocity(cells))


def follow(spark, target, incoming, rows, name, on_change=None):
    """Write ``rows`` as one more file and let the marts take in what is new."""
    write_jsonl(incoming / f"{name}.jsonl", rows)
    stream = stream_event_files(spark, str(incoming), max_files_per_trigger=1)
    return target.refresh(stream, on_change)


def test_incremental_marts_equal_the_full_recompute(spark, tmp_path):
    rows = list(random_events(seed=1))
    target, incoming = IncrementalMarts(spark, tmp_path / "inc", partitions=2), tmp_path / "in"
    for i, start in enumerate(range(0, len(rows), 100)):
        assert follow(spark, target, incoming, rows[start : start + 100], i)["input_rows"] == 100
        assert target.committed_batch() == i
        if i in (0, 1, 3):
            assert_matches_recompute(target, frame(spark, rows[: start + 100]))
    # Every event again: nothing changes but the number of copies.
    changed = []
    follow(spark, target, incoming, rows, "again", lambda cells, i: changed.extend(cells.collect()))
    assert not changed
    assert_matches_recompute(target, frame(spark, rows))


def test_empty_incremental_tables(spark, tmp_path):
    target = IncrementalMarts(spark, tmp_path / "inc", partitions=2)
    assert target.committed_batch() == -1
    assert target.order_state().isEmpty() and target.daily_sales().isEmpty()
    assert target.rejected_events().isEmpty() and tuple(target.occurrence_counts().first()) == (0, 0)


def test_incremental_marts_follow_a_stream(spark, tmp_path):
    incoming = tmp_path / "incoming"
    for day, rows in history():
        day_file(incoming, day, rows)
    target = IncrementalMarts(spark, tmp_path / "inc", partitions=2)
    for _ in range(2):
        target.refresh(stream_event_files(spark, str(incoming), max_files_per_trigger=3))
        assert target.committed_batch() == 2
        assert_matches_recompute(target, read_event_files(spark, str(incoming)))


def test_an_order_leaves_its_old_cell_and_may_lose_its_last_event(spark, tmp_path):
    target, incoming = IncrementalMarts(spark, tmp_path / "inc", partitions=2), tmp_path / "in"
    first = [event("e1", province="Ha Noi"), event("e2", order_id="O2")]
    follow(spark, target, incoming, first, "a")
    # e1 moves to another province, a later copy of e2 names another order.
    later = {"ingest_ts": "2025-02-01T00:00:00+00:00"}
    moved = [event("e1", province="Da Nang", **later), event("e2", order_id="O3", **later)]
    changed = []
    follow(spark, target, incoming, moved, "b", lambda cells, i: changed.extend(cells.collect()))
    assert {r.province for r in target.province_sales().collect()} == {"Ha Noi", "Da Nang"}
    assert {r.order_id for r in target.order_state().collect()} == {"O1", "O3"}
    assert_matches_recompute(target, frame(spark, first + moved))
    gone = [r for r in changed if r["rows"] == 0]
    assert all(r.amount == 0 for r in gone) and len(changed) >= 1
    # The copy of e1 that now wins is bad: its order is gone, and so is its cell.
    bad = [event("e1", quantity=0, ingest_ts="2025-03-01T00:00:00+00:00")]
    follow(spark, target, incoming, bad, "c")
    assert {r.order_id for r in target.order_state().collect()} == {"O3"}
    assert_matches_recompute(target, frame(spark, first + moved + bad))


def test_a_batch_that_failed_is_computed_again(spark, tmp_path):
    """A crash after the state was written and before the batch was committed."""
    rows = list(random_events(seed=2))
    target, incoming = IncrementalMarts(spark, tmp_path / "inc", partitions=2), tmp_path / "in"
    follow(spark, target, incoming, rows[:200], "a")
    before = rows_of(target.daily_sales())

    def crash(cells, batch_id):
        assert cells.count() > 0  # all state of the batch is written by now
        raise RuntimeError("crash")

    with pytest.raises(Exception, match="crash"):
        follow(spark, target, incoming, rows[200:], "b", crash)
    assert target.committed_batch() == 0 and rows_of(target.daily_sales()) == before
    target.refresh(stream_event_files(spark, str(incoming), max_files_per_trigger=1))
    assert target.committed_batch() == 1
    assert_matches_recompute(target, frame(spark, rows))
    assert target.occurrence_counts().first()["bronze"] == len(rows)


def test_a_hot_order_and_a_hot_event_spread(spark, tmp_path):
    """A third of all events in one order, and a third of all occurrences copies of one event."""
    rows = [event(f"e{i}", order_id="hot" if i % 2 else f"O{i}", event_ts=f"2025-01-01T{i % 24:02d}:00:00+00:00") for i in range(300)]
    rows += [event("e1", order_id="hot", ingest_ts=f"2025-01-07T00:00:{i % 60:02d}+00:00") for i in range(150)]
    target = IncrementalMarts(spark, tmp_path / "inc", partitions=2)
    follow(spark, target, tmp_path / "in", rows, "a")
    assert_matches_recompute(target, frame(spark, rows))
    parts = target._state("part_latest", ()).filter("key.order_id = 'hot'")
    assert parts.count() == incremental.SALTS
    batch = pa.RecordBatch.from_pylist(incremental._in_state(frame(spark, rows)).toArrow().to_pylist())
    folded = next(incremental._folded_copies(iter([batch])))
    assert folded.num_rows == 300 and max(folded.column("copies").to_pylist()) == 151


def test_a_bucket_of_the_state_holds_many_events(spark, tmp_path, monkeypatch):
    """A long history takes as many state entries as there are buckets, and removals leave the state."""
    monkeypatch.setattr(incremental, "BUCKETS", 4)
    monkeypatch.setattr(incremental, "CHUNK", 50)
    target, incoming, rows = IncrementalMarts(spark, tmp_path / "inc", partitions=2), tmp_path / "in", []
    for copy in range(4):  # every copy moves its events to another province, the last events of orders among them
        provinces = ["Ha Noi", "Da Nang", "Can Tho", "UNKNOWN"]
        rows += [
            event(
                f"e\t{i}\n" if i % 7 else None,
                order_id=f"O{(i + copy) % 90}",
                province=provinces[(i + copy) % 4],
                ingest_ts=f"2025-02-0{copy + 1}T00:00:{i % 60:02d}+00:00",
            )
            for i in range(600)
        ]
        progress = []
        write_jsonl(incoming / f"{copy}.jsonl", rows[-600:])
        query = target.start(stream_event_files(spark, str(incoming)), {"availableNow": True})
        query.awaitTermination()
        progress += [operator.numRowsTotal for operator in query.lastProgress.stateOperators]
        assert max(progress) <= 3 * 4 + 2 * 90, progress
        assert_matches_recompute(target, frame(spark, rows))
    assert target.occurrence_counts().first()["bronze"] == len(rows)


def test_a_row_for_the_state_holds_the_lines_of_a_bucket(spark):
    """Every event was a row that Python read field by field; fields are found in an event without reading it all."""
    rows = [event(f"e{i}", order_id=f"O{i % 3}") for i in range(1000)] + [event("e1")] * 2
    events = incremental._in_state(frame(spark, rows)).withColumn("bucket", F.expr("int(substring(event_id, 2)) % 4"))
    batches = events.select("bucket", "event_id", "event").toArrow().to_batches(max_chunksize=100)
    packed = [row for batch in incremental._packed_copies(iter(batches)) for row in batch.to_pylist()]
    assert len(packed) <= 4 * (1000 // 4 // incremental.ROW_LINES + 1)
    lines = [line.split("\t") for row in packed for line in row["lines"].split("\n")]
    assert len(lines) == 1000 and sum(int(copies) for copies, _ in lines) == 1002

    awkward = ['a","order_id":"x', "back\\slash", "tab\tline\n", '"event_ts":5', "é", "", None]
    rows = [event(name, order_id=other, event_type=name) for name in awkward for other in awkward]
    rows += [event("early", event_ts="1960-01-01T00:00:00.000001+00:00")]
    for (text,) in incremental._in_state(frame(spark, rows)).select("event").collect():
        for name in ("event_id", "order_id", "event_ts", "ingest_ts"):
            assert incremental._value(text, name) == json.loads(text).get(name)
    no_clock = frame(spark, [event("e")]).withColumn("ingest_ts", F.lit(None).cast("timestamp"))
    (text,) = incremental._in_state(no_clock).select("event").first()
    assert incremental._value(text, "event_ts") == json.loads(text)["event_ts"]
    assert incremental._value(text, "ingest_ts") is None


def test_incremental_rejects_and_counts_equal_the_full_run(spark, tmp_path):
    rows = list(random_events(seed=3))
    target = IncrementalMarts(spark, tmp_path / "inc", partitions=2)
    for i, start in enumerate(range(0, len(rows), 200)):
        follow(spark, target, tmp_path / "in", rows[start : start + 200], i)
    events = frame(spark, rows)
    classified = quality.classify_events(resolve.dedup_counting_copies(events))
    assert rows_of(target.winning_events()) == rows_of(classified)
    expected = quality.rejected_events(classified.drop("copies"))
    assert rows_of(target.rejected_events()) == rows_of(expected)
    surplus = classified.selectExpr("sum(copies - 1)").first()[0]
    assert tuple(target.occurrence_counts().first()) == (len(rows), surplus)


def test_publication_from_the_state(spark, tmp_path, monkeypatch):
    target, incoming, data = IncrementalMarts(spark, tmp_path / "inc", partitions=2), tmp_path / "in", tmp_path / "data"
    follow(spark, target, incoming, [event("e1"), event("e1"), event("e2", order_id="O2", quantity=0)], "a")
    report = target.publish(data, arrived=3)
    assert all(report["assertions"].values())
    assert report["events"] == {
        "bronze": 3, "deduplicated": 2, "duplicates": 1, "accepted": 1, "quarantined": 1,
    }
    follow(spark, target, incoming, [event("e3", order_id="O3")], "b")
    first = latest_run(spark, data)

    # A crash between the commit of the state and the publication: readers stay where they were.
    def crash(*args, **options):
        raise RuntimeError("crash")

    with monkeypatch.context() as broken:
        broken.setattr("ordertide.plans.curate.export_tables", crash)
        with pytest.raises(RuntimeError, match="crash"):
            target.publish(data)
    assert latest_run(spark, data) == first
    # A new process finds the committed state and publishes it.
    IncrementalMarts(spark, tmp_path / "inc", partitions=2).publish(data, arrived=4)
    assert latest_run(spark, data) != first
    assert open_table(spark, data, "daily_sales").first()["orders"] == 2
    assert open_table(spark, data, "order_events_rejected").count() == 1
    # An occurrence that the stream read and the state does not have fails the gate.
    published = latest_run(spark, data)
    with pytest.raises(GateFailure):
        target.publish(data, arrived=5)
    assert latest_run(spark, data) == published
