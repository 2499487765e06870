import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest
from helpers import awkward, documents, empty

from ordertide.llm.decontaminate import decontaminate, drop_contaminated
from ordertide.llm.wordhash import NOT_BLANK, Words

ITEMS = "item_id bigint, text string, words string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    for doc_id, text in rows:
        words, hit, held = words_of(text), set(), set()
        for n in range(1, 11):
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    held |= found
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        yield doc_id, len(words), len(hit), len(held), digest, bool(hit)


def run(spark, rows, items):
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    return decontaminate(documents(spark, rows), benchmark).drop("text_hash")


@pytest.mark.parametrize("bits", [16, 29])
def test_shared_spans_of_all_lengths(spark, monkeypatch, bits):
    """Also with a bitmap too small to tell hashes apart."""
    monkeypatch.setattr("ordertide.llm.decontaminate.MAX_BITMAP_BITS", bits)
    monkeypatch.setattr("ordertide.llm.decontaminate.BITS_PER_HASH", 1 if bits == 16 else 256)
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "x1", "日本", "the", "Of", "q"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(40)]
    items += [(3, items[3][1]), (None, items[4][1]), (50, None), (51, "?!"), (52, items[5][1])]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            source = (rng.choice(items)[1] or "").split()
            start = rng.randint(0, len(source))
            at = rng.randint(0, len(words))
            words[at:at] = source[start : start + rng.randint(5, 14)]
        rows.append((i, rng.choice([" ", ", ", "\n", " -- "]).join(words).upper()))
    assert sorted(map(tuple, run(spark, rows, items).collect())) == sorted(brute(rows, items))


def test_awkward_rows(spark):
    docs = awkward(spark)
    items = [(1, "plain WORDS"), (2, "text without"), (None, None), (9, "w1x1 w2x2 w3x3")]
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in items], ITEMS)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = decontaminate(docs, benchmark).drop("text_hash").collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows, items)))
    kept = drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    clean = [r[0] for r in brute(rows, items) if not r[5]]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, clean))
    assert decontaminate(empty(spark), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate(docs, benchmark.limit(0)).collect())


def test_word_hashes_do_not_depend_on_place_or_blocks(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 12))) for _ in range(3000)]
    monkeypatch.setattr("ordertide.llm.wordhash.HASH_BYTES", 64)
    small = Words(("  " + "\t ".join(words) + "\n").encode(), NOT_BLANK)
    monkeypatch.setattr("ordertide.llm.wordhash.HASH_BYTES", 1 << 20)
    large = Words(" ".join(words).encode(), NOT_BLANK)
    assert np.array_equal(small.hashes, large.hashes)
    by_word = dict(zip(words, large.hashes, strict=True))
    assert len(set(by_word.values())) == len(by_word)
    assert all(by_word[w] == h for w, h in zip(words, large.hashes, strict=True))


def test_hashing_a_long_word_takes_little_memory():
    text = "".join(random.Random(9).choices("abc", k=2 << 20)).encode()
    tracemalloc.start()
    found = [Words(b"a " + word, NOT_BLANK).hashes[1] for word in (text, text[:-1], b"x" + text[1:])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(found)) == 3
    assert peak < 32 * len(text)
