import binascii
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, documents, empty
from seating import Seating

from ordertide.llm import hpylm, queries
from ordertide.llm.hpylm import _dealt, _word_counts, score_texts, tokens
from ordertide.llm.restaurants import (
    Dishes,
    Seats,
    distinct_hashes,
    distinct_places,
    gathered,
    packed,
    part_numbers,
    seat,
    unpacked,
)

SF_DIR = "/root/testdata/sf0.001"


def brute_tokens(text):
    plain = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        plain = plain.replace(c, " ")
    return [w for w in plain.split(" ") if w] + [None]


def brute(rows):
    def out(doc_id):
        return binascii.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts = Counter(w for i, text in rows if not out(i) for w in brute_tokens(text))
    n, v = sum(counts.values()), len(counts)
    for doc_id, text in rows:
        words = brute_tokens(text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        yield doc_id, out(doc_id), len(words), sum(counts[w] > 0 for w in words), n, base


def test_counts_and_base_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = {r[0]: r[1:] for r in brute([(r.doc_id, r.text) for r in docs.collect()])}
    found = queries.op2_lm_scoring(spark, SF_DIR).collect()
    assert len(found) == len(expected)
    for r in found:
        want = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    unseen = [r for r in found if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_scores_do_not_depend_on_the_parts(spark):
    """One part, or many with the commonest words before a token spread over several of them.

    The root's numbers of words are exchanged as arrays, or for most words by joins.
    """
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    whole = {r.doc_id: r for r in score_texts(docs).collect()}
    total = sum(r.score for r in whole.values())
    for part_tokens, common in ((20_000, 1 << 18), (1_500, 50)):
        found = score_texts(docs, part_tokens=part_tokens, common_words=common).collect()
        assert len(found) == len(whole)
        for r in found:
            one = whole[r.doc_id]
            assert (r.n_tokens, r.n_known) == (one.n_tokens, one.n_known)
            assert r.base_score == pytest.approx(one.base_score, rel=1e-9)
            assert r.score == pytest.approx(one.score, rel=0.1, abs=2)  # other draws
        assert sum(r.score for r in found) == pytest.approx(total, rel=0.005)


def test_rows_alike_and_long_texts(spark):
    """A third of all rows are one row, learnt from as often as it occurs; one text is longer than a block."""
    alike = [(7, "the same text over and over")] * 60
    long = " ".join(f"w{i % 5000}" for i in range(900_000))
    rows = [*alike, *((i, f"own text {i} of many") for i in range(100, 220)), (3, long)]
    found = score_texts(documents(spark, rows), part_tokens=100_000).collect()
    assert len(found) == len(rows)
    same = {tuple(r) for r in found if r.doc_id == 7}
    assert len(same) == 1 and next(iter(same))[2] == 7
    counts = Counter(w for i, text in rows if not out(i) for w in brute_tokens(text))
    big = next(r for r in found if r.doc_id == 3)
    assert big.n_tokens == 900_001 and big.train_tokens == sum(counts.values())


def test_shared_restaurants_have_the_totals_of_all_parts():
    """Seats of one last spread over three parts: totals, shared, are those of one part with all its tokens."""
    rng = np.random.default_rng(4)
    names = np.sort(rng.integers(1, 1 << 62, 40).astype(np.uint64))
    word, before = rng.integers(0, 40, 3000), rng.integers(0, 40, 3000)
    last = np.full(3000, 5)

    def seats(at):
        held = gathered([[names, word[at], last[at], before[at], np.ones(at.sum(), bool)]])
        return Seats.first(held, Dishes(held), names[5:6])

    one = seats(np.ones(3000, bool)).shared()
    parts = [seats(word % 3 == k).shared() for k in range(3)]
    sums = {}
    for part in parts:
        for name, *totals in zip(*part, strict=True):
            sums[name] = np.add(sums.get(name, 0), totals)
    assert {k: tuple(v) for k, v in sums.items()} == {n: (c, t) for n, c, t in zip(*one, strict=True)}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = score_texts(docs).collect()
    key = lambda r: repr(tuple(r)[:4])
    for r, want in zip(sorted(found, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(r)[:5] == want[:5]
        assert r.base_score == pytest.approx(want[5]) and math.isfinite(r.score)
    assert score_texts(empty(spark)).count() == 0
    held_out_only = documents(spark, [(i, "some words") for i in range(60) if binascii.crc32(str(i).encode()) % 7 == 2])
    assert {r.n_known for r in score_texts(held_out_only).collect()} == {0}


def test_probabilities_of_each_restaurant_sum_to_one():
    rng = np.random.default_rng(5)
    size, n_words = 4, 50
    word = np.repeat(np.arange(n_words), size * size)
    place = np.tile(np.arange(size * size), n_words)
    legal = (place >= size) | (place == 0)
    word, place = word[legal], place[legal]
    train = rng.poisson(1.5, len(word))
    seating = Seating(word, place, train, n_words, size)
    uniform = 1 / (n_words + 1)
    for _ in range(4):
        totals = seating.totals().astype(float)
        _, _, own = seating.predictions(totals, uniform)
        unknown = np.full(size * size, uniform)
        for p in np.argsort(np.arange(size * size) % size, kind="stable"):
            level = 0 if p == 0 else 1 if p % size == 0 else 2
            parent = uniform if level == 0 else unknown[0] if level == 1 else unknown[p - p % size]
            unknown[p] = seating._predict(level, 0, 0, np.array([p]), parent, totals)[0]
        sums = np.bincount(place, weights=own, minlength=size * size) + unknown
        assert sums[np.unique(place)] == pytest.approx(1.0)
        assert (seating.tables <= seating.customers).all()
        assert (seating.root_tables <= seating.root_customers).all()
        seating.sweep(totals, uniform, rng)


def test_seats_of_a_common_dish_follow_the_restaurant_process():
    """Expected tables of a dish whose parent gives it probability one, in closed form."""
    n, d, s = 2000, 0.5, 3.0
    tables = []
    for i in range(200):
        rng, seated = np.random.default_rng(i), 1
        for c in range(1, n):
            seated += rng.random() < (s + d * seated) / (s + c)
        tables.append(seated)
    growth = math.exp(math.lgamma(s + d + n) - math.lgamma(s + n) + math.lgamma(s + 1) - math.lgamma(s + d))
    assert np.mean(tables) == pytest.approx(growth / d - s / d, rel=0.1)
    weight = np.full(400, 2.0)
    blocked = seat(np.full(400, n), weight, d, np.random.default_rng(0)).mean()
    single = []
    for i in range(100):
        rng, t = np.random.default_rng(1000 + i), 1
        for c in range(1, n):
            t += rng.random() < 2.0 / (2.0 + c - d * t)
        single.append(t)
    assert blocked == pytest.approx(np.mean(single), rel=0.1)


def out(doc_id):
    return binascii.crc32(str(doc_id).encode()) % 7 == 2


def test_every_context_is_learnt(spark):
    """400 words, each with one follower: whatever its frequency, a word's follower is not scored as a unigram."""
    rows = []
    for i in range(1400):
        rng = random.Random(i)
        rows.append((i, " ".join(f"a{k} b{k} c{k}" for k in rng.choices(range(400), k=10))))
    found = [r for r in score_texts(documents(spark, rows)).collect() if r.held_out]
    assert len(found) > 100
    gained = [(r.score - r.base_score) / r.n_tokens for r in found]
    assert min(gained) > 1.2  # two of three words are nearly certain, and one in 400 * 3 by itself


def test_tables_agree_with_the_sampler_in_memory(spark):
    rng = random.Random(3)
    names = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(300):
        text = [rng.choice(names)]
        while len(text) < 30:
            text.append(names[(names.index(text[-1]) + rng.choice([1, 1, 1, 2, 5])) % 12])
        rows.append((i, " ".join(text)))
    size = len(names) + 2
    start, ids = size - 1, {w: k + 1 for k, w in enumerate(names)}

    def dishes(text):
        last, before = start, 0
        for w in [*text.split(), None]:
            yield (ids[w] if w else 0), last * size + (0 if last == start else before)
            last, before = (ids[w] if w else start), last

    counts, every = Counter(), set()
    for i, text in rows:
        every.update(dishes(text))
        counts.update({} if out(i) else Counter(dishes(text)))
    keys = sorted(every)
    word, place = (np.array(c) for c in zip(*keys, strict=True))
    n_words = len(names) + 1
    seating = Seating(word, place, np.array([counts[k] for k in keys]), n_words, size)
    averaged = np.zeros(len(keys))
    draws = np.random.default_rng(1)
    for turn in range(5):
        totals = seating.totals().astype(float)
        if turn > 2:
            averaged += seating.predictions(totals, 1 / (n_words + 1))[2] / 2
        seating.sweep(totals, 1 / (n_words + 1), draws)
    score = dict(zip(keys, np.log10(averaged), strict=True))
    for r in score_texts(documents(spark, rows)).collect():
        text = dict(rows)[r.doc_id]
        assert r.score == pytest.approx(sum(score[k] for k in dishes(text)), rel=0.05)


def test_a_task_counts_each_word_once(monkeypatch):
    rng = random.Random(10)
    texts = [" ".join(f"w{rng.randint(0, 300)}" for _ in range(200)).encode() for _ in range(50)] + [None]
    monkeypatch.setattr("ordertide.llm.hpylm._groups", lambda texts, size=0: ((i, [t or b""]) for i, t in enumerate(texts)))
    batches = [pa.RecordBatch.from_pydict({"text": texts[:20]}), pa.RecordBatch.from_pydict({"text": texts[20:]})]
    expected = Counter(tokens([t or b"" for t in texts])[0].view(np.int64).tolist())
    found = [row for b in _word_counts(iter(batches)) for row in b.to_pylist()]
    assert {r["name"]: r["n"] for r in found} == expected and len(found) == len(expected)
    monkeypatch.setattr("ordertide.llm.hpylm.HELD_WORDS", 100)  # more words than a task holds
    found = Counter()
    for b in _word_counts(iter(batches)):
        found.update({r["name"]: r["n"] for r in b.to_pylist()})
    assert found == expected


@pytest.mark.parametrize("parts", [3, 5000])
def test_tokens_are_dealt_with_their_neighbours_and_texts(parts):
    rng = random.Random(11)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 40))).encode() for _ in range(60)]
    word, counts = tokens(texts)
    end = word[counts[0] - 1]
    frequent = np.sort(word[:1]), np.array([4])
    batch = pa.RecordBatch.from_pydict(
        {"held_out": [i % 7 == 2 for i in range(60)], "doc_id": list(range(60)), "text_hash": [0] * 60, "text": texts}
    )
    found = Counter()
    for rows in _dealt(parts, frequent, with_texts=True)(iter([batch])):
        for row in rows.to_pylist():
            names, *numbers, learnt, of_text, ids, _, lengths = unpacked(row["blob"])
            columns = (names[n].tolist() for n in numbers)
            where = [ids[i] for i in of_text]
            found.update((row["part"], *t) for t in zip(*columns, learnt.tolist(), where, lengths[of_text].tolist()))
    last = np.concatenate([[end], word[:-1]])
    before = np.concatenate([[end, end], word[:-2]])
    text = np.repeat(np.arange(60), counts)
    part = part_numbers(last, word, parts, frequent)
    columns = (part, word, last, before, text % 7 != 2, text, counts[text])
    assert found == Counter(zip(*(c.tolist() for c in columns), strict=True))


class Shipped:
    def __init__(self, value):
        self.value = value


def test_blocks_number_common_words(monkeypatch):
    """Blocks of several groups of texts hold ranks instead of hashes of common words, in far fewer bytes."""
    monkeypatch.setattr("ordertide.llm.hpylm.BLOCK_BYTES", 2000)
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(200)).encode() for _ in range(40)]
    words = np.unique(tokens(texts)[0])
    ranked = words[np.random.default_rng(0).permutation(len(words))][: len(words) - 50]
    batch = pa.RecordBatch.from_pydict({"held_out": [False] * 40, "doc_id": list(range(40)), "text": texts})
    none = np.empty(0, np.uint64), np.empty(0, np.int64)

    def dealt(ranked):
        found, size, groups = Counter(), 0, set()
        for rows in _dealt(5, none, with_texts=True, ranked=Shipped(ranked))(iter([batch])):
            for row in rows.to_pylist():
                block = hpylm._named(unpacked(row["blob"]), ranked)
                found.update((row["part"], *block[0][list(n)].tolist()) for n in zip(*block[1:4], strict=True))
                size += len(packed(unpacked(row["blob"])[0]))
                groups.add(row["name"])
        return found, size, groups

    plain, numbered = dealt(none[0]), dealt(ranked)
    assert numbered[0].keys() == plain[0].keys() and len(numbered[2]) > 5
    assert numbered[0] == plain[0] and numbered[1] < plain[1] / 2


def test_a_part_hands_on_rows_per_shard_not_per_word():
    """What a part exchanges with the root, and on restaurants that are spread, are a few rows however many words."""
    rng = np.random.default_rng(6)
    names = np.unique(rng.integers(1 << 33, 1 << 63, 4000).astype(np.uint64) * np.uint64(2))
    word, last, before = rng.integers(0, len(names), (3, 30_000)) // np.array([[1], [400], [1]])
    block = packed(names, word, last, before, np.ones(30_000, bool))
    rows = pa.Table.from_pydict({"part": [3], "blob": [block]})
    frequent = names[:1]
    out = hpylm._opened(frequent, Shipped(np.empty(0, np.uint64)), 4)(rows)
    assert out.num_rows < 2 * hpylm.SLICES + 10
    asked = hpylm._kind(out, hpylm.WORDS)
    roots = [hpylm._root_opened(asked.filter(pa.array(asked["name"].to_numpy() == k))) for k in range(4)]
    n = np.concatenate([hpylm._blobs(root, hpylm.SEATS, "name")[k][0] for k, root in enumerate(roots)])
    assert n.sum() == 30_000 and (n > 0).sum() == len(np.unique(word))
    shared = hpylm._kind(out, hpylm.SHARED)
    assert 1 <= shared.num_rows <= 4


def test_scores_do_not_depend_on_the_shards(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    expected = {r[0]: r[1:] for r in brute([(r.doc_id, r.text) for r in docs.collect()])}
    one = {r.doc_id: r for r in score_texts(docs, part_tokens=20_000, common_words=50).collect()}
    monkeypatch.setattr("ordertide.llm.hpylm.SHARD_WORDS", 500)
    many = score_texts(docs, part_tokens=20_000, common_words=50).collect()
    assert len(many) == len(expected)
    for r in many:
        want = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9)
    assert sum(r.score for r in many) == pytest.approx(sum(r.score for r in one.values()), rel=0.005)


def test_places_among_distinct_values():
    rng = np.random.default_rng(7)
    alike = np.uint64(1 << 60) + rng.integers(0, 5, 1000).astype(np.uint64)  # differ in their last bits only
    for hashes in (alike, rng.integers(0, 1 << 63, 1000).astype(np.uint64)[rng.integers(0, 1000, 3000)], alike[:0]):
        for found, want in zip(distinct_hashes(hashes), np.unique(hashes, return_inverse=True), strict=True):
            assert (found == want).all()
    for keys in (rng.integers(0, 300, 1000), rng.integers(0, 1 << 62, 50)[rng.integers(0, 50, 1000)]):
        for found, want in zip(distinct_places(keys), np.unique(keys, return_inverse=True, return_counts=True), strict=True):
            assert (found == want).all()
