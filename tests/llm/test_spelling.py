import random
import re
import zlib
from collections import Counter

import pytest
from helpers import awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordertide.llm.spelling import Acceptor, near_pairs, near_words, spelling_variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_length=6, min_count=5, ratio=5, slip=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            name = "" if doc_id is None else str(doc_id)
            h = zlib.crc32(f"{name}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= min_count}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(near[w]), form[w], counts.get(form[w]), root(w)) for w, n in counts.items())


def rows_of(frame):
    columns = ("word", "n", "n_near", "form", "form_n", "root")
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def variants_text(seed, words=400):
    """Words of a small alphabet and their variants, some far more frequent than others."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÉé") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    text = []
    for _ in range(words):
        word = rng.choice(base[: rng.choice([2, 12])])
        at = rng.randrange(len(word))
        word = rng.choice([word, word, word[:at] + word[at + 1 :], word[:at] + "b" + word[at:], word[:at] + "a" + word[at + 1 :]])
        text.append(rng.choice([word, word.upper()]))
    return " ".join(text)


@pytest.mark.parametrize("limit", [1, 3, 2_000])
def test_equals_brute_force(spark, limit):
    chain = "abcdef " * 250 + "abcdeg " * 50 + "abcdegx " * 10 + "abcdegxy " * 2
    rows = [*((i, variants_text(i)) for i in range(8)), (8, chain)]
    found = spelling_variants(documents(spark, rows), min_count=2, group_limit=limit)
    expected = brute(rows, min_count=2)
    assert rows_of(found) == expected
    assert any(r[3] for r in expected) and any(r[5] not in (r[0], r[3]) for r in expected)


def test_slips_change_words(spark):
    rows = [(i, "slipping words appear everywhere") for i in range(400)]
    expected = brute(rows, min_count=1)
    assert len(expected) > 4
    assert rows_of(spelling_variants(documents(spark, rows), min_count=1)) == expected


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(spelling_variants(docs, min_count=1, min_length=3)) == brute(rows, 3, 1)
    assert spelling_variants(empty(spark)).count() == 0
    clash = documents(spark, [(1, "nothing happens here " * 6)]).withColumns(
        {c: F.lit("x") for c in ("word", "n", "near", "form", "root", "members", "low", "m")}
    )
    assert rows_of(spelling_variants(clash)) == brute([(1, "nothing happens here " * 6)])


def test_very_long_words(spark):
    """A run of letters is a word however long; its one-edit neighbours are found."""
    long = "ab" * 20_000
    rows = [(1, f"{long} {long}"), (2, f"{long}c {long[:-1]} {'a' * 30_000} {'a' * 30_001}")]
    found = {r.word: r.n_near for r in spelling_variants(documents(spark, rows), min_count=1, slip=None).collect()}
    assert found == {long: 2, f"{long}c": 1, long[:-1]: 1, "a" * 30_000: 1, "a" * 30_001: 1}


def test_a_crowded_partition_is_halved_until_it_fits(spark):
    """All words share their first half: every pair is found whatever a partition may hold."""
    rng = random.Random(3)
    words = sorted({"shared" + "".join(rng.choice("abc") for _ in range(6)) for _ in range(300)})
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    expected = {(a, b) for a in words for b in words if one_edit(a, b)}
    for limit in (2, 50):
        found = near_words(frame, group_limit=limit, label="t").collect()
        assert len(found) == len(expected)
        assert {(r.word, r.near) for r in found} == expected


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=7), max_size=25))
def test_composed_machines_accept_the_near_pairs(words):
    expected = {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}
    found = near_pairs(sorted(words))
    assert {frozenset(p) for p in found} == expected
    assert len(found) == len(expected)


def test_the_acceptor_is_minimal():
    machine = Acceptor(["tops", "taps", "top", "tap"])
    reached, waiting = {0}, [0]
    while waiting:
        for target in machine.out[waiting.pop()].values():
            if target not in reached:
                reached.add(target)
                waiting.append(target)
    assert len(reached) == 5  # t, (a|o), p, s and the end of s
    assert machine.common(0, 0) and set(machine.common(0, 0)) == {"tops", "taps", "top", "tap"}
