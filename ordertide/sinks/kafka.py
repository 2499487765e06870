"""Publish order events to Kafka. Needs Spark's Kafka connector on the classpath."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ordertide.contract import DEFAULT_TOPIC
from ordertide.functions.payload import encode_payload

# Delivery settings of the published producer.
PRODUCER_OPTIONS = {"kafka.acks": "all", "kafka.retries": "5", "kafka.linger.ms": "25"}


def publish_events(events: DataFrame, bootstrap: str, topic: str = DEFAULT_TOPIC) -> int:
    """Write events keyed by order_id and return how many; executors write in parallel."""
    sent = Observation("published")
    records = encode_payload(events).observe(sent, F.count(F.lit(1)).alias("records"))
    writer = records.write.format("kafka").options(**PRODUCER_OPTIONS)
    writer.option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save()
    return sent.get["records"]
