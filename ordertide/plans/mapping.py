"""The TPC-H-like tables seen as order events, so that the operators can run on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.contract import OrderContract

LINEITEM_CONTRACT = OrderContract(
    provinces=tuple(f"NATION_{n}" for n in range(24)),
    categories=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
)
ACTIVITY_CONTRACT = OrderContract(
    provinces=tuple(f"PROV_{n}" for n in range(12)),
    categories=tuple(f"CAT_{n}" for n in range(6)),
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event occurrence per line item.

    (l_orderkey, l_linenumber) repeats in the data, so those are natural re-deliveries; some
    quantities, prices, provinces and event types break the rules.
    """
    place = read_table(spark, sf_dir, "customer").join(
        read_table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    )
    # Orders find their place before the lines do: there are fewer of them, and lines are shuffled once less.
    orders = read_table(spark, sf_dir, "orders").join(place, F.expr("o_custkey = c_custkey"))
    lines = (
        read_table(spark, sf_dir, "lineitem")
        .join(read_table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey"))
        .join(orders, F.expr("l_orderkey = o_orderkey"))
    )
    shipped = F.col("l_shipdate").cast("timestamp")
    on_the_hour = F.timestamp_add("HOUR", F.expr("int(l_partkey % 24)"), shipped)
    event_ts = F.timestamp_add("MINUTE", F.expr("int(l_suppkey % 60)"), on_the_hour)
    event_type = (
        F.when(F.expr("l_linenumber = 7 AND l_linestatus = 'O'"), "returned")
        .when(F.col("l_returnflag") == "N", "created")
        .when(F.col("l_returnflag") == "A", "updated")
        .otherwise("cancelled")
    )
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("n_name").alias("province"),
        (F.col("l_quantity").cast("int") - 1).alias("quantity"),
        F.round(F.col("l_extendedprice") - 1000.0, 2).alias("unit_price_vnd"),
        event_type.alias("event_type"),
        event_ts.alias("event_ts"),
        F.timestamp_add("SECOND", F.expr("int(l_partkey % 120 + 1)"), event_ts).alias("ingest_ts"),
    )


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as order events. Every fiftieth id repeats the one before, and an
    order's events are spread over the whole month."""
    k = F.get_json_object("props", "$.k").cast("int")
    number, user = F.col("event_id"), F.col("user_id")
    delivered = F.when((number % 50 == 0) & (number > 0), number - 1).otherwise(number)
    event_type = (
        F.when(F.col("event_type").isin("purchase", "view"), "created")
        .when(F.col("event_type") == "click", "updated")
        .when(F.col("event_type") == "error", "cancelled")
        .otherwise(F.col("event_type"))
    )
    event_ts = F.col("ts").cast("timestamp")
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), delivered).alias("event_id"),
        F.concat(F.lit("O"), number % 4000).alias("order_id"),
        F.concat(F.lit("C"), user).alias("customer_id"),
        F.concat(F.lit("P"), k).alias("product_id"),
        F.concat(F.lit("CAT_"), k % 6).alias("category"),
        F.concat(F.lit("PROV_"), user % 13).alias("province"),
        (k % 20).alias("quantity"),
        F.col("value").alias("unit_price_vnd"),
        event_type.alias("event_type"),
        event_ts.alias("event_ts"),
        F.timestamp_add("SECOND", F.expr("int(event_id % 120 + 1)"), event_ts).alias("ingest_ts"),
    )


def nation_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their region: the many-to-one dimension the test tables offer for provinces."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    return nation.join(region, F.expr("n_regionkey = r_regionkey"), "left").select(
        F.col("n_name").alias("province"), F.col("r_name").alias("region")
    )
