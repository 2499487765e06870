"""Quality rules: text statistics, and lines that too many documents of a host share.

Everything is a DataFrame expression; no Python runs on the executors.

Lines are normalised (runs of white space become one blank, A-Z lower case, digits 0) and hashed with
their host. A line is boilerplate if more than ``max_docs`` different texts of its host hold it: a number, not a
share, so that a line is judged alike in small and large hosts and however much else a host holds. Exact copies of a
text count once, so a group of copies does not make its own lines boilerplate. Boilerplate lines are removed, and
a document that loses more than ``max_removed`` of its words is rejected, as is one that fails the base rules.

Defined results: a null or empty text has no words and fails the base rules. Null hosts form one host.
Rows are judged by id, host and text, so repeated rows get the same verdict and each stays one row. An
empty table gives an empty result. Extra columns do not matter, whatever their names.

Scale: one pass over the texts leaves numbers and line hashes in a stored table of a few hundredths of
the input. Counting different texts per line is Spark's two-step distinct aggregate, so a line that a
third of all documents hold is spread by text before it is counted. The join that finds boilerplate
lines again has line hashes on both sides, and adaptive execution splits a hot one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import GAP, count_words, let, lower_ascii, stored, words_of

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8  # fixed: the base rules
SYMBOL = "[#*$%&|<>]"  # fixed
MAX_DOCS, MAX_REMOVED = 8, 0.5

A_WORD = r"[^\x20\x09-\x0D]"
NOT_PLAIN = r"[1-9]|[\x09-\x0D]|  "


def normalised_line(line: Column) -> Column:
    def rewritten(plain: Column) -> Column:
        single = F.trim(F.regexp_replace(plain, GAP, " "))
        return F.translate(single, "123456789", "000000000")

    # Most lines are lower case words with single blanks already.
    return let(
        F.trim(lower_ascii(line)),
        lambda plain: F.when(plain.rlike(NOT_PLAIN), rewritten(plain)).otherwise(plain),
    )


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur at least twice in the text.

    Hashes of eight words are built from pairs of pairs of pairs. Only a text in which some hash
    repeats is looked at closely, with the words themselves, so that hashes never decide.
    """

    def paired(hashes: Column, distance: int) -> Column:
        later = F.slice(hashes, F.lit(1 + distance), F.greatest(F.size(hashes), F.lit(1)))
        return F.zip_with(hashes, later, lambda a, b: F.xxhash64(a, b))

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).alias("words"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            starts,
            first,
            lambda acc, start: F.struct(
                (acc.words + F.least(F.lit(WINDOW), start - acc["last"])).alias("words"),
                start.alias("last"),
            ),
            lambda acc: acc.words,
        )

    def repeated_starts(windows: Column) -> Column:
        def same(window: Column, at: Column) -> Column:
            return F.coalesce(F.get(windows, at).w == window.w, F.lit(False))

        twice = F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def inspect(hashes: Column) -> Column:
        windows = F.sort_array(
            F.transform(
                hashes,
                lambda h, i: F.struct(
                    h.alias("h"), F.slice(words, i + 1, WINDOW).alias("w"), i.alias("i")
                ),
            )
        )
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            covered(let(windows, repeated_starts)),
        ).otherwise(F.lit(0))

    n_windows = F.greatest(F.size(words) - (WINDOW - 1), F.lit(0))
    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = let(let(let(one, lambda h: paired(h, 1)), lambda h: paired(h, 2)), lambda h: paired(h, 4))
    return let(F.slice(eight, F.lit(1), n_windows), inspect).cast("long")


def text_statistics(text: Column) -> dict[str, Column]:
    """The base figures of a text, from its words only."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(A_WORD))
    repeats = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return {
        "n_words": count_words(text),
        "word_chars": F.length(F.regexp_replace(full, GAP, "")).cast("long"),
        "n_symbols": F.regexp_count(full, F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": repeats.cast("long"),
        "n_repeat_words": let(words_of(text), _repeat_words),
    }


def _line_hashes(text: Column, host: Column) -> Column:
    """Hash (with the host) and word count of every line that has a word."""
    lines = F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(A_WORD)
    )
    return F.transform(
        lines,
        lambda x: F.struct(
            _line_hash(x, host).alias("line"), count_words(x).alias("words")
        ),
    )


def _line_hash(line: Column, host: Column) -> Column:
    return F.xxhash64(host.isNull(), host, normalised_line(line))


def _host_hash(host: Column) -> Column:
    return F.xxhash64(host.isNull(), host)


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def boilerplate_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """``line`` hashes (with their host) that more than ``max_docs`` texts hold; ``lines`` has line and text_hash."""
    counts = lines.groupBy("line").agg(F.count_distinct("text_hash").alias("n"))
    return counts.filter(F.col("n") > max_docs).select("line")


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs: int = MAX_DOCS,
    max_removed: float = MAX_REMOVED,
    label: str = "quality-rules",
) -> DataFrame:
    """One row per document: id, the base figures, ``base_failed``, ``n_removed`` words and ``kept``.

    Also ``host_hash``, ``text_hash`` and ``bad_lines`` (the hashes of its boilerplate lines) for `clean_documents`.
    """
    text, host = F.col("text"), F.col("host")
    names = {id_col: "doc_id", text_col: "text", host_col: "host"}
    rows = docs.select(*[F.col(name).alias(alias) for name, alias in names.items()])
    measured = stored(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            _host_hash(host).alias("host_hash"),
            _text_hash(text).alias("text_hash"),
            *[column.alias(name) for name, column in text_statistics(text).items()],
            _line_hashes(text, host).alias("lines"),
        ),
        label,
    )
    lines = measured.select("row", "text_hash", F.inline("lines"))
    bad = boilerplate_lines(lines, max_docs)
    lost = (
        lines.select("row", "line", "words")
        .join(bad, "line")
        .groupBy("row")
        .agg(F.sum("words").alias("n_removed"), F.collect_set("line").alias("bad_lines"))
    )
    n_words = F.col("n_words")
    failed = (n_words < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n_words)
    return (
        measured.drop("lines")
        .join(lost, "row", "left")
        .drop("row")
        .withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_removed") <= max_removed * n_words))
    )


def clean_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are kept, without their boilerplate lines; ``n_chars`` follows the text.

    Needs the columns doc_id, text and source; all other columns pass through.
    """
    verdicts = (
        quality_rules(docs, **options)
        .filter("kept")
        .select(
            F.col("doc_id").alias("id"),
            F.col("text_hash").alias("hash"),
            F.col("host_hash").alias("of_host"),
            "bad_lines",
        )
        .groupBy("id", "hash", "of_host")
        .agg(F.first("bad_lines", ignorenulls=True).alias("bad"))
    )
    whole = docs.select(
        F.struct("*").alias("doc"),
        _text_hash(F.col("text")).alias("hash"),
        _host_hash(F.col("source")).alias("of_host"),
    )
    same = F.col("doc.doc_id").eqNullSafe(F.col("id")) & (whole.hash == verdicts.hash)
    joined = whole.join(verdicts, same & (whole.of_host == verdicts.of_host))
    text, host = F.col("doc.text"), F.col("doc.source")
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(F.col("bad"), _line_hash(x, host)))
    cleaned = F.when(F.col("bad").isNull(), text).otherwise(F.array_join(rest, "\n"))
    changed = {"text": cleaned, "n_chars": F.length(cleaned)}
    return joined.select(
        *(
            changed[field.name].cast(field.dataType).alias(field.name)
            if field.name in changed
            else F.col(f"doc.`{field.name}`")
            for field in docs.schema
        )
    )
