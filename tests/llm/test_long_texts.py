"""Texts longer than the blocks that operators work in: whole texts count, as brute force says."""

import random

import pytest
from helpers import documents
from test_decontaminate import brute as brute_hits
from test_quality_rules import figures
from test_simhash import brute_print

from ordertide.llm.decontaminate import decontaminate
from ordertide.llm.mixing import mixture
from ordertide.llm.quality_rules import quality_rules
from ordertide.llm.simhash import near_duplicates


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(3_000)]
    long = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(4_000)]
    text = "\n".join([*long, *long[:50], "the very last line has ten words and one more"])
    return [(1, text), (2, text[: len(text) // 2]), (3, "short text")]


def test_benchmark_passages_at_the_end_of_long_texts(spark, rows):
    items = [("end", "the very last line has ten words and one more"), ("none", "not in there")]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontaminate(documents(spark, rows), benchmark).drop("text_hash")
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_hits(rows, items))


def test_fingerprints_of_more_shingles_than_a_block(spark, rows):
    found = {r.doc_id: r["print"] % (1 << 64) for r in near_duplicates(documents(spark, rows)).collect()}
    assert found == {i: brute_print(text) for i, text in rows}


def test_sizes_and_quality_figures(spark, rows):
    docs = documents(spark, rows)
    sizes = {r.doc_id: r["size"] for r in mixture(docs).collect()}
    assert sizes == {i: len(text.split()) for i, text in rows}
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = sorted(tuple(r) for r in quality_rules(docs).select(columns).collect())
    assert found == [(i, *figures(text)) for i, text in rows]
