"""Paths of the lakehouse under one root (a local path or any Hadoop URI)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from ordertide.sources.files import FILE_BRONZE_SCHEMA, KAFKA_BRONZE_SCHEMA


@dataclass(frozen=True)
class Layout:
    """Each stream owns its bronze path and its checkpoint.

    The file sink logs committed batch ids per path; two queries on one path would skip each
    other's batches.
    """

    root: str

    @property
    def file_bronze(self) -> str:
        return f"{self.root}/lakehouse/bronze/order_events/files"

    @property
    def kafka_bronze(self) -> str:
        return f"{self.root}/lakehouse/bronze/order_events/kafka"

    @property
    def bronze_sources(self) -> dict[str, T.StructType]:
        return {self.file_bronze: FILE_BRONZE_SCHEMA, self.kafka_bronze: KAFKA_BRONZE_SCHEMA}

    def checkpoint(self, stream: str) -> str:
        return f"{self.root}/checkpoints/{stream}"

    def run_table(self, run_id: str, layer: str, table: str) -> str:
        return f"{self.run(run_id)}/{layer}/{table}"

    @property
    def runs(self) -> str:
        return f"{self.root}/lakehouse/runs"

    def run(self, run_id: str) -> str:
        return f"{self.runs}/{run_id}"

    def run_export(self, run_id: str, table: str) -> str:
        return f"{self.run(run_id)}/exports/{table}.csv"

    @property
    def published(self) -> str:
        return f"{self.root}/lakehouse/published"

    @property
    def reports(self) -> str:
        return f"{self.root}/artifacts/quality-report"

    def report(self, run_id: str) -> str:
        return f"{self.reports}/run_id={run_id}"
