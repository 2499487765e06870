import random

import public_tokenizers
import pytest
from helpers import awkward, empty
from tokenizers import Tokenizer

from ordertide.llm import queries
from ordertide.llm.token_counts import ChunkMap, Counter, Transducer, count_tokens, scan

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = (
    "abcdefghijklmnopqrstuvwxyz'' é ü ß 日本語\U0001f600 Σσς İ ı ǅ ́̈ ½²Ⅷ٣ \x1c\x85 　\xa0​﻿ "
    "'s 're 'll <|endoftext|> <|startoftext|>!!!???... 12345 \n\t\r\x0b\x00\x7f ﬁ Å Ａ"
)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return Counter(PATH)


def tokens_of(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op6_token_counts(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = tokens_of(library, texts[r.doc_id])
        assert tuple(r)[1:] == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def test_awkward_rows(spark, library):
    docs = awkward(spark)
    want = sorted((repr(r.doc_id), tokens_of(library, r.text)) for r in docs.collect())
    rows = count_tokens(docs, PATH).collect()
    assert sorted((repr(r.doc_id), r.n_tokens) for r in rows) == want
    assert count_tokens(empty(spark), PATH).count() == 0


def test_odd_texts_equal_the_library(library, counter):
    rng = random.Random(1)
    for _ in range(3000):
        letters = (rng.choice(ODD if rng.random() < 0.6 else "etaoinshr''") for _ in range(rng.randint(0, 40)))
        text = "".join(letters) + rng.choice(["", "'s", "'RE", "<|endoftext|>", "<|startoftext|>x", "don't I'VE"])
        assert counter.count(text) == tokens_of(library, text), repr(text)


def test_long_words_and_forgotten_states(library, counter, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr("ordertide.llm.token_counts.MAX_STATES", 50)
    monkeypatch.setattr("ordertide.llm.token_counts.MAX_WORDS", 3)
    for n in (1, 99, 100, 101, 5000):
        word = "".join(rng.choice("etaoinshrdluaaaa") for _ in range(n))
        assert counter.transducer.count(word.encode(), chunk=7) == tokens_of(library, word)
        assert counter.count(f"{word} {word[:9]} x {word}") == tokens_of(library, f"{word} {word[:9]} x {word}")


def test_prefix_scan_equals_reading_on(counter):
    data = b"thereisnowordthatisasimpleasthisoneaaaaaaaaaaaaaaaa" * 5
    machine = counter.transducer
    maps = [ChunkMap.read(machine, data[i : i + 6]) for i in range(0, len(data), 6)]
    for i, prefix in enumerate(scan(maps)):
        assert prefix(Transducer.START) == machine.run(Transducer.START, data[: 6 * (i + 1)])
    assert maps[0].then(maps[1].then(maps[2]))(0) == maps[0].then(maps[1]).then(maps[2])(0)
