"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordertide.plans.settings import scratch_path

# Fixed: what words are, and what is between them.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back: computed once, lineage cut, ids fixed."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_hash(text: Column) -> Column:
    """Tells texts of one id apart; null differs from empty."""
    return F.xxhash64(text.isNull(), text)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""

    def without_ends(parts: Column) -> Column:
        """Splitting leaves an empty string before a leading and after a trailing gap."""
        last = F.size(parts) - 1
        leading = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        trailing = F.when((last > 0) & (F.get(parts, last) == ""), 1).otherwise(0)
        return F.slice(parts, 1 + leading, F.greatest(last + 1 - leading - trailing, F.lit(0)))

    return let(F.split(F.coalesce(text, F.lit("")), GAP), without_ends)


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")
