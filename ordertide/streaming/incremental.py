"""Marts that follow the stream, on Spark's keyed state.

One streaming query holds everything that a refresh needs to know in its state store (RocksDB):

* winners - per event id the winning copy, and how many copies arrived,
* parts   - per order and salt the accepted winning events, and the latest of them,
* orders  - per order the latest event of its parts: the order state,
* cells   - per hour, province and category the sums over active orders.

Every operator passes on what changed, the old row with sign -1 and the new one with sign +1. So a winner that
moves to another order, an event that turns bad, or an order that changes its day or province leaves its old place
by subtraction, and a micro-batch costs what its events touch, however long the history is. Spark commits the state
of all four operators with the batch; a batch that failed is computed again from the state before it.

Tables are read from the state of the last committed batch with Spark's state reader. ``publish`` writes them,
counts, gates, report and exports as a run beside those of full curations, and publishes it in the same log.

Scale. Copies of an event are folded by the task that reads them, before they are shuffled, and so are the changes of a
cell. A row that goes into the state holds the lines of one bucket that a task has at hand, not one event.
Event ids, order parts and orders are dealt into ``BUCKETS`` buckets, and a bucket is one entry of the state: a first
load of a long history reads and writes it in a few calls for many events, and 1,000 events touch 1,000 buckets
of some events each. Parts and orders append their changes and read them back only when a latest event is lost.
The events of an order are dealt over ``SALTS`` parts, so an order of a third of all events spreads over tasks. State is
partitioned by bucket; the first start fixes the number of partitions and of buckets for the life of a checkpoint.
"""

from __future__ import annotations

import decimal
import json
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ordertide.contract import (
    DEFAULT_CONTRACT,
    EVENT_COLUMNS,
    FORECAST_HORIZON,
    ORDER_EVENT_FIELDS,
    OrderContract,
)
from ordertide.functions.money import AMOUNT_TYPE
from ordertide.operators import forecast as fc
from ordertide.operators import marts, quality, resolve
from ordertide.plans import curate
from ordertide.plans.layout import Layout
from ordertide.plans.settings import (
    STATE_STORE,
    applied,
    apply_settings,
    file_system,
    let_workers_import,
    require_utc,
)
from ordertide.streaming.landing import drain

SALTS = 32
# Groups of event ids, of order parts and of orders that share a state entry, fixed for the life of a checkpoint.
BUCKETS = 1 << 14
CHUNK = 1000  # lines of one text in the state
# Lines that a task gathers to pack those of a bucket, at most so many bytes, and lines of a shuffled row.
PACKED, PACKED_BYTES, ROW_LINES = 1 << 17, 128 << 20, 100
CLOCKS = ("event_ts", "ingest_ts")
# Clocks are microseconds in the state, so that no Python time zone touches them.
STATE_FIELDS = tuple((n, "bigint" if n in CLOCKS else kind) for n, kind in ORDER_EVENT_FIELDS)
CELL_SUMS = (*((name, "bigint") for name in (*marts.CELL_COUNTS, "strays")), ("amount", AMOUNT_TYPE))


def _ddl(*fields: tuple[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


EVENT_DDL = _ddl(*STATE_FIELDS)
# In the state and between its operators an event is a line: numbers and its JSON, which holds no tab and no line end,
# with tabs between them. Up to CHUNK lines are one value, so Python copies few values and reads JSON only to compare.
LINES_DDL = "lines string"
PACKED_DDL = f"bucket int, {LINES_DDL}"
NUMBERS = {"winner": resolve.COPIES, "part_latest": "salt", "order_latest": "salt"}  # of the lines that are read


def _rank(value) -> tuple:
    """Orders values as Spark does: NULL first, NaN last."""
    if value is None:
        return (0,)
    return (2,) if value != value else (1, value)


def _fields(event: str) -> dict:
    fields = json.loads(event)
    price = fields.get("unit_price_vnd")
    if isinstance(price, str):  # JSON has no numbers for NaN and infinities
        fields["unit_price_vnd"] = float(price)
    return fields


def _ranks(fields: dict, names: Sequence[str]) -> tuple:
    return tuple(_rank(fields.get(name)) for name in names)


def _value(event: str, name: str):
    """A text or clock of an event, found without reading the other fields.

    Quotes inside of texts are escaped, so a name in quotes before a colon is that of a field.
    """
    mark = f'"{name}":'
    start = event.find(mark)
    if start < 0:
        return None
    start += len(mark)
    if event[start] == '"':
        text = event[start + 1 : event.find('"', start + 1)]
        return json.loads(event)[name] if "\\" in text else text
    stop = event.find(",", start)
    return int(event[start : stop if stop > 0 else -1])


def _texts(lines: Sequence[str], size: int = CHUNK) -> list[tuple[str]]:
    return [("\n".join(lines[start : start + size]),) for start in range(0, len(lines), size)]


def _replace(state, lines: Sequence[str]) -> None:
    """What a list state holds, one text a message."""
    state.clear()
    for text in _texts(lines):
        state.appendValue(text)


def _lines(texts) -> Iterator[list[str]]:
    """Lines of a list state or of rows with a column of lines, each as its fields."""
    for text in texts:
        for line in text[-1].split("\n"):
            yield line.split("\t")


class EventWinners(StatefulProcessor):
    """Per bucket of event ids the copy of each event ingested last. Passes on old and new winners that change.

    Lines taken in and held: copies, event; passed on: sign, event.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.winners = handle.getListState("winner", LINES_DDL)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held: dict = {}
        for copies, event in _lines(self.winners.get()):
            held[_value(event, "event_id")] = (event, int(copies))
        found: dict = {}
        for number, event in _lines(rows):
            name, copies = _value(event, "event_id"), int(number)
            known = found.get(name) or held.get(name)
            if known is not None:
                best, before = known
                later = event != best and self._recency(event) > self._recency(best)
                event, copies = event if later else best, before + copies
            found[name] = (event, copies)
        _replace(self.winners, [f"{copies}\t{event}" for event, copies in {**held, **found}.values()])
        changes = []
        for name, (event, _) in found.items():
            old = held[name][0] if name in held else None
            if event != old:
                if old is not None:
                    changes.append(f"-1\t{old}")
                changes.append(f"1\t{event}")
        for (text,) in _texts(changes):
            yield Row(lines=text)

    @staticmethod
    def _recency(event: str) -> tuple:
        return _ranks(_fields(event), resolve.EVENT_RECENCY)


class LatestMember(StatefulProcessor):
    """Per key the latest event among its members, for the keys of a bucket. Passes on old and new ones that change.

    ``keys`` and ``member`` are fields of the event, or ``salt``. Lines taken in, kept as changes and passed on: sign,
    salt, event; of the latest events: salt, event.

    A change names its member. A removal only counts while the member still is what is to be removed, so
    the removal and the replacement of one member may come in any order.

    Changes are appended to the state as they come, and only read when the latest event of a key was removed or
    when more than half of them are removals; then what is left of them replaces them.
    """

    def __init__(self, name: str, keys: Sequence[str], member: str):
        self.name, self.keys, self.member = name, tuple(keys), member

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.changes = handle.getListState(f"{self.name}_changes", LINES_DDL)
        self.latest = handle.getListState(f"{self.name}_latest", LINES_DDL)
        self.size = handle.getValueState(f"{self.name}_size", "changes bigint, removals bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held: dict = {}
        for salt, event in _lines(self.latest.get()):
            named, *entry = self._entry(salt, event)
            held[named] = tuple(entry)
        best, touched, pending, waiting = dict(held), set(), [], 0
        changes, removals = self.size.get() or (0, 0)
        for row in rows:
            lines = row[-1].split("\n")
            pending.append(row[-1])
            waiting += len(lines)
            if waiting >= CHUNK:
                self.changes.appendValue(("\n".join(pending),))
                pending, waiting = [], 0
            for line in lines:
                sign, salt, event = line.split("\t")
                changes, removals = changes + 1, removals + (sign == "-1")
                named, member, *entry = self._entry(salt, event)
                if named in held and held[named][0] == member:
                    touched.add(named)
                if sign == "1" and (named not in best or entry[-1] > best[named][-1]):
                    best[named] = (member, *entry)
        if pending:
            self.changes.appendValue(("\n".join(pending),))
        # Keys that lost their latest event and got no later one.
        lost = {named for named in touched if best[named] is held[named]}
        compact = changes > 64 and 2 * removals > changes
        if lost or compact:
            members = self._members(None if compact else lost)
            for named in lost:
                left = members.get(named)
                if left:
                    best[named] = max(left.values(), key=lambda entry: entry[-1])
                else:
                    del best[named]
            if compact:
                kept = [f"1\t{salt}\t{event}" for left in members.values() for _, salt, event, _ in left.values()]
                _replace(self.changes, kept)
                changes, removals = len(kept), 0
        self.size.update((changes, removals))
        signed = []
        for named in held | best:
            old, new = held.get(named), best.get(named)
            if (old and old[2]) != (new and new[2]):
                for sign, entry in ((-1, old), (1, new)):
                    if entry is not None:
                        signed.append(f"{sign}\t{entry[1]}\t{entry[2]}")
        if signed:
            _replace(self.latest, [f"{salt}\t{event}" for _, salt, event, _ in best.values()])
        for (text,) in _texts(signed):
            yield Row(lines=text)

    def _entry(self, salt: str, event: str) -> tuple:
        """Key, member, salt, event and recency of an event."""
        named = tuple(salt if name == "salt" else _value(event, name) for name in self.keys)
        member = salt if self.member == "salt" else _value(event, self.member)
        return named, member, salt, event, tuple(_rank(_value(event, name)) for name in resolve.STATE_RECENCY)

    def _members(self, wanted: set | None) -> dict:
        """What is left of the changes: per key, of those ``wanted`` or of all, the entry of every member."""
        members: dict = {}
        for sign, salt, event in _lines(self.changes.get()):
            named, member, *entry = self._entry(salt, event)
            if wanted is None or named in wanted:
                left = members.setdefault(named, {})
                if sign == "1":
                    left[member] = (member, *entry)
                elif member in left and left[member][2] == event:
                    del left[member]
        return members


class CellSums(StatefulProcessor):
    """Per cell the sums of all changes. Passes on the new sums; a cell without orders leaves the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("cell", _ddl(*CELL_SUMS))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        names = [name for name, _ in CELL_SUMS]
        sums = list(self.sums.get() or [0] * len(names))
        with decimal.localcontext(prec=60):
            for row in rows:
                sums = [total + row[name] for total, name in zip(sums, names, strict=True)]
            cell = dict(zip(names, sums, strict=True))
            if cell["rows"]:
                self.sums.update(tuple(sums))
            else:
                self.sums.clear()
            yield Row(**dict(zip(marts.CELL_KEYS, key, strict=True)), **cell)


def _folded_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: one row per event id of a batch, its latest copy, and how many copies there were."""
    for batch in batches:
        events = batch.column("event")
        best: dict = {}
        copies: dict = {}
        for i, name in enumerate(batch.column("event_id").to_pylist()):
            copies[name] = copies.get(name, 0) + 1
            if copies[name] == 1:
                best[name] = i
            elif EventWinners._recency(events[i].as_py()) > EventWinners._recency(events[best[name]].as_py()):
                best[name] = i
        kept = batch.take(pa.array(best.values(), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(copies.values(), pa.int64())], [*batch.schema.names, resolve.COPIES]
        )


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of several batches as one."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACKED or sum(b.nbytes for b in held) >= PACKED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _packed(buckets: Sequence[int], lines: Sequence[str]) -> pa.RecordBatch:
    held: dict = {}
    for bucket, line in zip(buckets, lines, strict=True):
        held.setdefault(bucket, []).append(line)
    texts = [(bucket, text) for bucket, found in held.items() for (text,) in _texts(found, ROW_LINES)]
    columns = [pa.array((bucket for bucket, _ in texts), pa.int32()), pa.array((text for _, text in texts), pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "lines"])


def _packed_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: events and their buckets to rows of lines, the copies of an event folded."""
    for folded in _folded_copies(_gathered(batches)):
        counted = zip(folded.column(resolve.COPIES).to_pylist(), folded.column("event").to_pylist(), strict=True)
        yield _packed(folded.column("bucket").to_pylist(), [f"{copies}\t{event}" for copies, event in counted])


def _packed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: lines and their buckets to rows of lines."""
    for batch in _gathered(batches):
        yield _packed(batch.column("bucket").to_pylist(), batch.column("line").to_pylist())


def _folded_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: the changes of a batch, summed per cell."""
    names = [name for name, _ in CELL_SUMS]
    for batch in batches:
        summed = pa.Table.from_batches([batch]).group_by(list(marts.CELL_KEYS), use_threads=False)
        sums = summed.aggregate([(name, "sum") for name in names])
        yield from sums.rename_columns({f"{name}_sum": name for name in names}).select(
            [*marts.CELL_KEYS, *names]
        ).cast(batch.schema).to_batches()


def _in_state(events: DataFrame) -> DataFrame:
    """Event id and the whole event as JSON; fields that are NULL are left out of it."""
    fields = (F.unix_micros(n).alias(n) if n in CLOCKS else F.col(n) for n in EVENT_COLUMNS)
    return events.select("event_id", F.to_json(F.struct(*fields)).alias("event"))


def _from_lines(texts: DataFrame, *numbers: str) -> DataFrame:
    """One row per line of the column ``lines``: its ``numbers`` and its ``event`` as text."""
    lines = texts.select(F.explode(F.split("lines", "\n")).alias("line"))
    fields = F.split("line", "\t")
    names = [(name, "bigint") for name in numbers] + [("event", "string")]
    return lines.select(*(F.get(fields, F.lit(i)).cast(kind).alias(name) for i, (name, kind) in enumerate(names)))


def _read_events(texts: DataFrame, *kept: str) -> DataFrame:
    """The ``kept`` columns and the fields of the JSON column ``event``, each text read once."""
    return texts.select(*kept, F.inline(F.array(F.from_json("event", EVENT_DDL))))


def _on_clock(events: DataFrame, *clocks: str) -> DataFrame:
    return events.withColumns({name: F.timestamp_micros(name) for name in clocks})


def _bucket(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int").alias("bucket")


class IncrementalMarts:
    """The keyed state under one root and the tables read from it."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        contract: OrderContract = DEFAULT_CONTRACT,
        partitions: int | None = None,
    ) -> None:
        """``partitions`` of the state, fixed by the first start; the session's shuffle partitions if not given."""
        self.spark = spark
        self.root = str(root)
        self.contract = contract
        self.partitions = partitions
        self.checkpoint = Layout(self.root).checkpoint("incremental_marts")
        apply_settings(spark, STATE_STORE)  # readers of the state need them as well
        let_workers_import(spark)

    # --- refresh ------------------------------------------------------------------------------

    def changed_cells(self, events: DataFrame) -> DataFrame:
        """The stateful plan: a stream of order events to the new sums of every cell that changed."""
        winners = (
            _in_state(events)
            .select(_bucket("event_id"), "*")
            .mapInArrow(_packed_copies, PACKED_DDL)
            .groupBy("bucket")
            .transformWithState(EventWinners(), LINES_DDL, "Append", "None")
        )
        read = _read_events(_from_lines(winners, "sign"), "sign", "event")
        accepted = quality.accepted_events(quality.classify_events(read, self.contract))
        salt = F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).alias("salt")
        line = F.concat_ws("\t", "sign", "salt", "event").alias("line")
        parts = (
            accepted.select("sign", "order_id", salt, "event")
            .select(_bucket("order_id", "salt"), line)
            .mapInArrow(_packed_lines, PACKED_DDL)
            .groupBy("bucket")
            .transformWithState(LatestMember("part", ("order_id", "salt"), "event_id"), LINES_DDL, "Append", "None")
        )
        latest = _read_events(_from_lines(parts, "sign", "salt"), "sign", "salt", "event")
        orders = (
            latest.select(_bucket("order_id"), line)
            .mapInArrow(_packed_lines, PACKED_DDL)
            .groupBy("bucket")
            .transformWithState(LatestMember("order", ("order_id",), "salt"), LINES_DDL, "Append", "None")
        )
        changes = self._signed_cells(orders).mapInArrow(
            _folded_cells, f"sales_hour bigint, province string, category string, {_ddl(*CELL_SUMS)}"
        )
        return changes.groupBy(*marts.CELL_KEYS).transformWithState(
            CellSums(),
            f"sales_hour bigint, province string, category string, {_ddl(*CELL_SUMS)}",
            "Append",
            "None",
        )

    @staticmethod
    def _signed_cells(orders: DataFrame) -> DataFrame:
        """What each changed order state adds to its cell or takes from it."""
        dated = _on_clock(_read_events(_from_lines(orders, "sign", "salt"), "sign"), "event_ts")
        cells = marts.order_cells(resolve.active_orders(dated), "sign")
        # Doubles outside the decimal range cannot be subtracted again: they are counted, and readers
        # rebuild the cells that hold any.
        strays = F.col("stray").isNotNull().cast("long").alias("strays")
        sums = cells.select("sign", *marts.CELL_KEYS, *marts.CELL_COUNTS, strays, "amount")
        return sums.select(
            F.unix_micros("sales_hour").alias("sales_hour"),
            "province",
            "category",
            *(
                (F.coalesce(name, F.lit(0)) * F.col("sign")).cast(kind).alias(name)
                for name, kind in CELL_SUMS
            ),
        )

    def start(
        self,
        events: DataFrame,
        trigger: dict | None = None,
        on_change: Callable[[DataFrame, int], None] | None = None,
    ) -> StreamingQuery:
        """Follow a stream of order events.

        ``on_change`` gets the changed cells of every micro-batch and its id, like a ``foreachBatch`` function; if it
        raises, the batch is not committed and is computed again after a restart. ``trigger`` holds the arguments of
        ``DataStreamWriter.trigger``.
        """
        require_utc(events.sparkSession)
        writer = self.changed_cells(events).writeStream.option("checkpointLocation", self.checkpoint)
        writer = writer.outputMode("append").queryName(f"incremental marts of {self.root}")
        if on_change is None:
            writer = writer.format("noop")
        else:
            hours = F.timestamp_micros("sales_hour")
            writer = writer.foreachBatch(lambda cells, i: on_change(cells.withColumn("sales_hour", hours), i))
        sizes = {} if self.partitions is None else {"spark.sql.shuffle.partitions": str(self.partitions)}
        with applied(self.spark, sizes):  # the query keeps the settings it is started with
            return (writer.trigger(**trigger) if trigger else writer).start()

    def refresh(
        self, events: DataFrame, on_change: Callable[[DataFrame, int], None] | None = None
    ) -> dict[str, int | None]:
        """Take in all that the stream has to offer now, then stop; batch id and input rows."""
        return drain(self.start(events, {"availableNow": True}, on_change))

    # --- tables -------------------------------------------------------------------------------

    def committed_batch(self) -> int:
        """The last batch whose state is committed, -1 before the first."""
        target, files = file_system(self.spark, f"{self.checkpoint}/commits")
        found = files.listStatus(target) if files.exists(target) else []
        names = [status.getPath().getName() for status in found]
        return max((int(name) for name in names if name.isdigit()), default=-1)

    def _state(self, variable: str, fields: Sequence[tuple[str, str]]) -> DataFrame:
        """(key, value) of a state variable as of the last committed batch; ``fields`` are those of both.

        Of a state of lines both are the event of a line, with its number before it.
        """
        if self.committed_batch() < 0:
            return self.spark.createDataFrame([], _ddl(*fields)).select(
                F.struct("*").alias("key"), F.struct("*").alias("value")
            )
        operators = self.spark.read.format("state-metadata").load(self.checkpoint)
        named = F.get_json_object("operatorProperties", "$.stateVariables[*].stateName")
        operator = operators.filter(named.contains(f'"{variable}"') | (named == variable)).first()
        reader = self.spark.read.format("statestore").option("operatorId", operator["operatorId"])
        state = reader.option("stateVarName", variable).load(self.checkpoint)
        if "list_element" not in state.columns:
            return state
        number = NUMBERS[variable]
        events = _read_events(_from_lines(state.select("list_element.lines"), number), number)
        return events.select(F.struct("*").alias("key"), F.struct("*").alias("value"))

    def winning_events(self) -> DataFrame:
        """The winning copy of every event, with its rejection reason and the copies it stands for."""
        winners = self._state("winner", (*STATE_FIELDS, (resolve.COPIES, "bigint"))).select("value.*")
        events = _on_clock(winners, *CLOCKS).select(*EVENT_COLUMNS, resolve.COPIES)
        return quality.classify_events(events, self.contract)

    def classified_events(self) -> DataFrame:
        return self.winning_events().drop(resolve.COPIES)

    def rejected_events(self) -> DataFrame:
        return quality.rejected_events(self.classified_events())

    def order_state(self) -> DataFrame:
        """Current order state as of the last committed batch."""
        latest = self._state("order_latest", STATE_FIELDS).select("value.*")
        return resolve.priced_orders(_on_clock(latest, *CLOCKS).select(*EVENT_COLUMNS))

    def sales_cells(self) -> DataFrame:
        """Sales cells as of the last committed batch."""
        state = self._state("cell", (*STATE_FIELDS, *CELL_SUMS, ("sales_hour", "bigint")))
        hour = F.timestamp_micros("key.sales_hour").alias("sales_hour")
        stray = F.lit(None).cast("double").alias("stray")
        sums = [F.col(f"value.{name}").alias(name) for name in (*marts.CELL_COUNTS, "amount")]
        cells = state.select(hour, "key.province", "key.category", *sums, stray, "value.strays")
        marked = cells.filter("strays > 0").select(*marts.CELL_KEYS)
        if marked.isEmpty():
            return cells.drop("strays")
        orders = marts.order_cells(resolve.active_orders(self.order_state())).alias("o")
        same = [F.col(f"o.{name}").eqNullSafe(F.col(f"m.{name}")) for name in marts.CELL_KEYS]
        rebuilt = marts.sum_cells(orders.join(marked.alias("m"), same, "left_semi"), *marts.CELL_KEYS)
        return cells.filter("strays = 0").drop("strays").unionByName(rebuilt)

    def occurrence_counts(self) -> DataFrame:
        """One row: all occurrences taken in, and those beyond the first of an event id."""
        copies = F.col(resolve.COPIES)
        return self.winning_events().agg(
            F.coalesce(F.sum(copies), F.lit(0)).alias("bronze"),
            F.coalesce(F.sum(copies - 1), F.lit(0)).alias("surplus_copies"),
        )

    def daily_sales(self) -> DataFrame:
        return marts.daily_sales(self.sales_cells())

    def province_sales(self) -> DataFrame:
        return marts.province_sales(self.sales_cells())

    def sales_velocity(self) -> DataFrame:
        return marts.sales_velocity(self.sales_cells())

    def sales_forecast(
        self, horizon: int = FORECAST_HORIZON, by: Sequence[str] = ()
    ) -> DataFrame:
        """Fitted anew on every read: the daily mart is small."""
        return fc.sales_forecast(self.daily_sales(), horizon, by)

    # --- publication --------------------------------------------------------------------------

    def publish(
        self,
        root: str,
        *,
        arrived: int | None = None,
        horizon: int = FORECAST_HORIZON,
        export_dir: str | None = None,
        stream: dict | None = None,
    ) -> dict:
        """Publish the last committed batch under ``root`` like a full curation; its report.

        Nothing is resolved again: winners, order state and cells are those of the state. ``arrived``, the rows
        that the stream read in all (see `ordertide.streaming.progress`), is held against the copies counted in the
        state by the gate on occurrences. A crash before the end publishes nothing and leaves the state as it was;
        publish again.
        """
        layout = Layout(str(root))
        occurrences = self.occurrence_counts()
        if arrived is not None:
            occurrences = occurrences.withColumn("bronze", F.lit(arrived).cast("long"))
        run_id, report = curate.write_run(
            self.spark,
            layout,
            self.winning_events(),
            horizon,
            partial(curate.quality_report, stream=stream),
            occurrences=occurrences,
            state=self.order_state(),
            cells=self.sales_cells(),
        )
        curate.release(self.spark, layout, run_id, report, export_dir)
        return report
