"""Rule classification, quarantine split and contract checks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.contract import DEFAULT_CONTRACT, EVENT_COLUMNS, OrderContract, Rule
from ordertide.operators.resolve import COPIES

REASON = "rejection_reason"
MISSING_FIELD = "missing_required_field"


def rejection_reason(rules: Iterable[Rule]) -> Column:
    """Reason of the first broken rule, NULL if no rule fires."""
    return F.coalesce(*(F.when(rule.broken(), F.lit(rule.reason)) for rule in rules))


def classify_events(events: DataFrame, contract: OrderContract = DEFAULT_CONTRACT) -> DataFrame:
    """Add ``rejection_reason`` to deduplicated events."""
    return events.withColumn(REASON, rejection_reason(contract.rules()))


def classify_against_tables(
    events: DataFrame, contract: OrderContract, provinces: DataFrame
) -> DataFrame:
    """``classify_events`` with the province domain read from a table (first column of ``provinces``).

    For domains too large for literals. The join is an equi-join on the value and keeps every event;
    Spark broadcasts the domain only if its size is below the broadcast threshold.
    """
    domain = provinces.select(F.col(provinces.columns[0]).alias("province")).distinct()
    flagged = events.join(domain.withColumn("_listed", F.lit(True)), "province", "left")
    unknown = Rule(
        "unknown_province", lambda: F.col("province").isNotNull() & F.col("_listed").isNull()
    )
    rules = [unknown if r.reason == unknown.reason else r for r in contract.rules()]
    return flagged.select(*events.columns, rejection_reason(rules).alias(REASON))


def accepted_events(classified: DataFrame) -> DataFrame:
    return classified.filter(F.col(REASON).isNull()).drop(REASON)


def rejected_events(classified: DataFrame) -> DataFrame:
    """Quarantine: rejected events stay queryable with their reason."""
    return classified.filter(F.col(REASON).isNotNull())


def rejections_by_reason(rejected: DataFrame) -> DataFrame:
    return rejected.groupBy(REASON).agg(F.count("*").alias("events"))


def required_field_violations(events: DataFrame) -> DataFrame:
    """NULLs per required field, one row per field, in a single pass over the events."""
    nulls = events.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in EVENT_COLUMNS))
    return nulls.unpivot([], list(EVENT_COLUMNS), "field", "null_rows")


def is_complete() -> Column:
    """Whether a row has all required fields."""
    return reduce(Column.__and__, [F.col(name).isNotNull() for name in EVENT_COLUMNS])


def quarantine_incomplete(bronze: DataFrame) -> DataFrame:
    """Occurrences that lack a required field, each rejected as it is.

    A broken line has no event id, so collapsing copies would merge all of them into one row.
    """
    broken = bronze.filter(~is_complete())
    return broken.withColumns({COPIES: F.lit(1).cast("long"), REASON: F.lit(MISSING_FIELD)})


def repeated_event_ids(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once. Empty after ``dedup_latest_event``."""
    return events.groupBy("event_id").agg(F.count("*").alias("copies")).filter("copies > 1")
