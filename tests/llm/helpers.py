"""Small tables with awkward rows."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows, schema=DOCS):
    """``rows`` of (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, schema)


def awkward(spark):
    """Null ids, texts and sources, empty and repeated rows, a long text, and clashing extra columns."""
    from pyspark.sql import functions as F

    words = [f"w{i % 997}x{i}" for i in range(30_000)]
    rows = [
        (1, "plain words here", "a"),
        (1, "plain words here", "a"),
        (1, "other words of the same id", "a"),
        (2, None, "a"),
        (3, "", None),
        (None, "a text without id", "b"),
        (None, None, None),
        (4, " \t\n\x0b\f\r ", "b"),
        (5, " ".join(words), "b"),
        (6, "é ü ß 日本語 \U0001f600 ' \" \\", "c"),
    ]
    clash = {name: F.lit("x") for name in ("row", "hash", "words", "score", "size", "key", "n", "id", "kept")}
    return documents(spark, rows).withColumns(clash)


def empty(spark):
    return documents(spark, [(1, "x")]).limit(0)
