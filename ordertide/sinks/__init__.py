"""Parquet tables, CSV exports, JSON-lines events, Kafka records and the report."""
