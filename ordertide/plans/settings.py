"""Where intermediate data goes, and session settings that follow from the input size."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Keyed state on the executors' disks with change logs in the checkpoint, so that a commit costs what changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state"
    ".RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
UTC_ZONES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


@cache
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="ordertide-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"Set {CHECKPOINT_DIR} to a folder that all executors share")
    return _local_dir(spark.sparkContext.applicationId)


def require_utc(spark: SparkSession) -> None:
    """Event dates and sales hours are UTC; refuse a session that would cut them elsewhere."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_ZONES:
        raise RuntimeError(f"Set spark.sql.session.timeZone to UTC, it is {zone}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of this session find this package where the driver found it.

    For sessions that run beside the code. Where it is installed on the executors, the path does no harm.
    """
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    home = str(Path(__file__).resolve().parents[2])
    if home not in known:
        environment["PYTHONPATH"] = os.pathsep.join([home, *filter(None, known)])


def session_settings(
    input_bytes: int,
    partition_bytes: int = 256 << 20,
    max_blocks: int = 4_000_000_000,
    split_bytes: int | None = None,
) -> dict[str, str]:
    """Runtime SQL settings for a run over ``input_bytes`` of bronze Parquet.

    Adaptive execution merges small shuffle partitions but cannot add any, so the initial number is
    sized for the data: rows grow about threefold when Parquet is decoded, and a reducer gets about
    ``partition_bytes`` of them, a scan task ``split_bytes`` of Parquet (the same if not given). A shuffle has one block per map task and partition. Beyond
    ``max_blocks`` scan splits and partitions grow by the same factor, so that their product stays
    there: at 100 TB that is about 37,000 map tasks over 3 GB each and 110,000 reducers with 3 GB of
    decoded rows, which sorts and aggregates spill. Concurrent writers avoid sorting rows by
    partition value before a partitioned write.
    """
    partitions = max(8, math.ceil(3 * input_bytes / partition_bytes))
    split_bytes = split_bytes or partition_bytes
    splits = max(1, math.ceil(input_bytes / split_bytes))
    growth = max(1.0, math.sqrt(partitions * splits / max_blocks))
    partitions, split_bytes = math.ceil(partitions / growth), math.ceil(split_bytes * growth)
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.maxConcurrentOutputFileWriters": "32",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    for key, value in settings.items():
        spark.conf.set(key, value)


def file_system(spark: SparkSession, path: str):
    """The Hadoop path object of ``path`` and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, 0 if nothing is there; asked of its file system."""
    target, files = file_system(spark, path)
    return files.getContentSummary(target).getLength() if files.exists(target) else 0


@contextmanager
def applied(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """``settings`` for the time of a block; the session's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in settings}
    apply_settings(spark, settings)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def at_once(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Run independent Spark jobs side by side, so that small ones do not leave executors idle."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [
            running.result()
            for running in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        ]
