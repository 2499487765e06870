"""JSON-lines event files, bronze Parquet and the province dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordertide.contract import ORDER_EVENT_FIELDS, schema_of

CORRUPT = "_corrupt_record"
RAW = "raw_record"
DIMENSION_DDL = "province string, latitude double, longitude double"


def _wire_schema(keep_corrupt: bool) -> T.StructType:
    return schema_of(*ORDER_EVENT_FIELDS, *([(CORRUPT, "string")] if keep_corrupt else []))


def read_event_files(spark: SparkSession, path: str, keep_corrupt: bool = False) -> DataFrame:
    """JSON-lines events at any depth under ``path``; directory names are not read as columns.

    A bad field becomes NULL and a broken line a row of NULLs. ``keep_corrupt`` adds the raw text
    of such lines as ``_corrupt_record``.
    """
    reader = spark.read.schema(_wire_schema(keep_corrupt)).option("recursiveFileLookup", "true")
    return reader.json(path)


def stream_event_files(
    spark: SparkSession,
    path: str,
    max_files_per_trigger: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Streaming form of ``read_event_files`` with the columns bronze stores.

    ``source_file`` and ``event_date`` are added; ``event_date`` is the UTC date of the event time.
    ``raw_record`` is the text of lines that are broken or hold a field of another type. Landed files are moved
    below ``archive`` when a later batch is planned, so that listings do not grow; without it they stay.
    """
    reader = spark.readStream.schema(_wire_schema(True)).option("recursiveFileLookup", "true")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(path).select(
        *(name for name, _ in ORDER_EVENT_FIELDS),
        F.col("_metadata.file_path").alias("source_file"),
        F.col(CORRUPT).alias(RAW),
        F.to_date("event_ts").alias("event_date"),
    )


FILE_BRONZE_SCHEMA = schema_of(
    *ORDER_EVENT_FIELDS, ("source_file", "string"), (RAW, "string"), ("event_date", "date")
)
KAFKA_BRONZE_SCHEMA = schema_of(
    *ORDER_EVENT_FIELDS,
    ("kafka_topic", "string"),
    ("kafka_partition", "integer"),
    ("kafka_offset", "long"),
    (RAW, "string"),
    ("event_date", "date"),
)


def read_parquet_if_exists(
    spark: SparkSession, path: str, schema: T.StructType
) -> DataFrame | None:
    """The Parquet dataset at ``path``, or None if nothing is there.

    Spark decides, so this works on any file system. The schema is explicit because a stream that
    found no input leaves a directory without data files.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def union_bronze(*sources: DataFrame) -> DataFrame:
    """One bronze frame over sources with their own provenance columns."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    columns = [name for name in merged.columns if name != "event_date"]
    return merged.select(*columns, "event_date")


def read_bronze(spark: SparkSession, sources: dict[str, T.StructType]) -> DataFrame:
    """All bronze datasets that exist among ``sources`` (path -> schema), as one frame."""
    frames = [read_parquet_if_exists(spark, path, schema) for path, schema in sources.items()]
    present = [frame for frame in frames if frame is not None]
    if not present:
        raise FileNotFoundError(f"No bronze dataset at {', '.join(sources)}")
    return union_bronze(*present)


def read_province_dimension(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header: province, latitude, longitude."""
    return spark.read.schema(DIMENSION_DDL).option("header", "true").csv(path)
