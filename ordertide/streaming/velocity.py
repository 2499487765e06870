"""A preview of sales velocity while events arrive: approximate, and ahead of curation.

Hours are event-time windows with a watermark, kept in Spark's state and sent on whenever they change (update mode).
The preview counts accepted events that are not cancellations. It is approximate in three ways, and marked so:
an order that is updated, moved or cancelled later is not taken back, copies of an event count as they arrive, and
orders are counted by a sketch. The exact mart is `marts.sales_velocity`.

Late rows. An event whose hour ended before the watermark (the latest event time seen, less ``late``) is dropped, so
that the state stays bounded by the hours between. Dropped rows are counted: what arrived is observed
in the plan, what was taken in is the sum of the windows.

Sketches. Each hour carries a HyperLogLog sketch of its order ids. Sketches merge without the ids, so days and totals
come from hours: `merged_orders`. The standard error is 1.04 / sqrt(2 ** SKETCH_BITS), 1.6 % with 12 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ordertide.contract import DEFAULT_CONTRACT, OrderContract
from ordertide.functions import money
from ordertide.operators import quality, resolve
from ordertide.plans.settings import require_utc
from ordertide.streaming.progress import observed_total

LATE = "2 hours"
SKETCH_BITS = 12
STANDARD_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)
ARRIVED = "arrived"
PREVIEW_DDL = (
    f"sales_hour timestamp, province string, events bigint, orders_sketch binary, amount {money.AMOUNT_TYPE},"
    " stray double"
)


def hourly_preview(
    events: DataFrame, late: str = LATE, contract: OrderContract = DEFAULT_CONTRACT
) -> DataFrame:
    """Event counts, a sketch of the orders and exact amounts per hour and province.

    Works on a stream and, without dropping anything, on a table.
    """
    accepted = quality.accepted_events(quality.classify_events(events, contract))
    sold = resolve.active_orders(accepted).observe(ARRIVED, F.count("*").alias("events"))
    quantity, price = F.col("quantity"), F.col("unit_price_vnd")
    hour = F.window("event_ts", "1 hour")
    return (
        sold.withWatermark("event_ts", late)
        .groupBy(hour, "province")
        .agg(
            F.count("*").alias("events"),
            F.hll_sketch_agg("order_id", F.lit(SKETCH_BITS)).alias("orders_sketch"),
            F.sum(money.exact_amount(quantity, price)).cast(money.AMOUNT_TYPE).alias("amount"),
            F.sum(money.stray_amount(quantity, price)).alias("stray"),
        )
        .select(F.col("window.start").alias("sales_hour"), "province", "events", "orders_sketch", "amount", "stray")
    )


def start_velocity_preview(
    events: DataFrame,
    path: str,
    checkpoint: str,
    late: str = LATE,
    contract: OrderContract = DEFAULT_CONTRACT,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the hours that change to ``path``, one directory per micro-batch; a batch run again replaces its own."""
    require_utc(events.sparkSession)

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = (
        hourly_preview(events, late, contract)
        .writeStream.foreachBatch(write)
        .queryName(preview_name(path))
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
    )
    return (writer.trigger(**trigger) if trigger else writer).start()


def preview_name(path: str) -> str:
    return f"velocity preview of {path}"


def read_hours(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of every hour and province."""
    versions = spark.read.schema(f"{PREVIEW_DDL}, batch_id bigint").parquet(str(path))
    values = F.struct("events", "orders_sketch", "amount", "stray")
    latest = versions.groupBy("sales_hour", "province").agg(F.max_by(values, "batch_id").alias("latest"))
    return latest.select("sales_hour", "province", "latest.*")


def velocity_preview(hours: DataFrame) -> DataFrame:
    """Hours in the columns of the exact mart, marked as approximate."""
    return hours.select(
        "sales_hour",
        "province",
        "events",
        F.hll_sketch_estimate("orders_sketch").alias("orders_per_hour"),
        money.rounded_total(F.col("amount"), F.col("stray")).alias("revenue_per_hour_vnd"),
        F.lit(True).alias("approximate"),
    )


def merged_orders(hours: DataFrame, *keys) -> DataFrame:
    """Distinct orders per ``keys`` (of all, without keys): sketches of hours merged, and their estimate."""
    merged = hours.groupBy(*keys).agg(F.hll_union_agg("orders_sketch").alias("orders_sketch"))
    return merged.withColumn("orders", F.hll_sketch_estimate("orders_sketch"))


def late_rows(hours: DataFrame, progress: DataFrame) -> int:
    """Accepted rows that arrived and are in no hour: those the watermark dropped."""
    taken = hours.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
    return observed_total(progress, ARRIVED, "events") - taken
