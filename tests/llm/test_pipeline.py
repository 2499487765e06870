import pytest
from helpers import awkward, documents, empty
from pyspark.sql import functions as F
from test_decontaminate import brute as brute_hits
from test_mixing import brute_targets
from test_pii import brute as brute_spans
from test_quality_rules import brute as brute_rules
from test_simhash import brute_groups, brute_print

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """(docs before, docs after) of every stage."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.stored(stage(spark, docs, SF_DIR), f"test-{name}")
        found[name] = (docs, after)
        docs = after
    return found


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "simhash_near_dedup", "benchmark_decontamination", "personal_data", "source_mixing",
    ]
    for name, (before, after) in steps.items():
        if name != "source_mixing":
            assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rules(steps):
    before, after = steps["quality_rules"]
    rows = [(r.doc_id, r.text, r.source) for r in before.collect()]
    assert ids(after) == sorted(r[0] for r in brute_rules(rows) if r[7])


def test_boilerplate_is_found_in_large_sources(spark):
    """Nine texts hold the line, in a source of 12 and in one of 300."""
    line, rows = "subscribe to our newsletter", []
    for source, size in (("small", 12), ("large", 300)):
        for i in range(size):
            name = source + "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10] + "abcdefghij"[i % 10]
            own = " ".join(name + c for c in "abcdefghijklmnopqrstuvwxyz")
            rows.append((len(rows), f"{own}\n{line}" if i < 9 else own, source))
    clean = corpus_pipeline.quality(spark, documents(spark, rows), SF_DIR).collect()
    assert len(clean) == len(rows)
    assert not [r.doc_id for r in clean if line in r.text]


def test_near_dedup(steps):
    before, after = steps["simhash_near_dedup"]
    prints = {r.doc_id: brute_print(r.text) for r in before.collect()}
    group = brute_groups(prints.values())
    least = {}
    for i in sorted(prints):
        least.setdefault(group[prints[i]], i)
    assert ids(after) == sorted(least.values())


def test_decontamination(spark, steps):
    before, after = steps["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    clean = [r[0] for r in brute_hits(rows, items) if not r[5]]
    assert ids(after) == sorted(clean) and len(clean) < len(rows)


def test_personal_data(steps):
    before, after = steps["personal_data"]
    texts = {r.doc_id: r.text for r in after.collect()}
    assert ids(before) == ids(after)
    for r in before.collect():
        assert not brute_spans(texts[r.doc_id])
        if not brute_spans(r.text):
            assert texts[r.doc_id] == r.text


def test_mixing(steps):
    before, after = steps["source_mixing"]
    sizes, taken, largest = {}, {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
        largest[r.source] = max(largest.get(r.source, 0), len(r.text.split()))
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 2 * largest[source]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_empty_and_awkward_tables(spark, name, stage):
    """Null ids, texts and sources, repeated rows, a long text, clashing columns, and a narrow n_chars."""
    narrow = F.col("n_chars").cast("int")
    docs = awkward(spark).withColumn("n_chars", narrow)
    kept = stage(spark, docs, SF_DIR)
    added = ["copy"] if name == "source_mixing" else []
    assert kept.columns == docs.columns + added
    assert [f.dataType for f in kept.schema][: len(docs.columns)] == [f.dataType for f in docs.schema]
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)
    nothing = stage(spark, empty(spark).withColumn("n_chars", narrow), SF_DIR)
    assert nothing.count() == 0 and nothing.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_run_gives_the_rows_of_the_stages(spark, steps):
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, steps["source_mixing"][1].collect()))
