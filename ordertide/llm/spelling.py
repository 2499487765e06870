"""Spelling variants: words one edit apart, found by composing finite-state machines.

Words are the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text with A-Z lower-cased. The vocabulary holds
those of at least ``min_length`` code points and ``min_count`` occurrences. Two words are near if one inserted,
deleted or replaced code point turns one into the other: the pairs that the vocabulary's acceptor, composed with
a one-edit transducer and the acceptor again, accepts. A word's form is its most frequent near word if that is
``ratio`` times as frequent; following forms leads to its root.

Partitions. A pair whose shorter word has m code points is looked for among words of m and m + 1. Its edit lies
in the second half, and the first halves agree, or in the first half, and the last halves agree. So every word goes
to partitions named by half of it, and what a partition's words share is walked once, from its initial state. A
partition of more than ``group_limit`` words is halved again where its words differ, as often as it takes. Once a
single place is open, an alphabet of 90 letters allows 90 words of m and 8,100 of m + 1 code points, so every
partition is bounded, and no pair is lost: halving only fixes what all its pairs share.

Defined results: a null text has no words; a null id counts as an empty one where ids matter. Repeated rows count
as often as they occur. No words give an empty result. Among near words of equal count the smallest in
code-point order is the form. Other columns are not read.

Scale: texts are read once and leave one row per word and batch of texts, summed before and after the shuffle, so
a word of a third of all occurrences is one row a task. All else works on the vocabulary. Pairs are rows of a table;
roots take one join per doubling of the longest chain of forms, whose counts grow ``ratio``-fold a step.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import LOWER, UPPER, stored

LETTERS = "A-Za-zÀ-ÿ"  # fixed
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
SLIP = 199
GROUP_LIMIT = 2_000
WORDS_HELD = 200_000  # distinct words that a task gathers before it hands them on
PAIRS = "word string, n bigint, near string, near_n bigint"


# --- the vocabulary -----------------------------------------------------------------------------


def slipped(doc_id: str, run: str, slip: int | None) -> str:
    """``run`` as the document ``doc_id`` spells it: one code point falls out of one in ``slip`` runs."""
    if slip:
        value = zlib.crc32(f"{doc_id}:{run}".encode())
        if value % slip == 0:
            at = value % len(run)
            return run[:at] + run[at + 1 :]
    return run


def _counted(min_length: int, slip: int | None):
    """Arrow function: (id, text) to (word, n), summed over the texts of a task."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{min_length},}}")  # shorter ones cannot grow
        lowered = str.maketrans(UPPER, LOWER)
        held: Counter[str] = Counter()

        def handed_on() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in parts:
            for doc_id, text in zip(batch.column("id"), batch.column("text"), strict=True):
                found = Counter(runs.findall((text.as_py() or "").translate(lowered)))
                name = doc_id.as_py() or ""
                for run, n in found.items():
                    held[slipped(name, run, slip)] += n
                if len(held) > WORDS_HELD:
                    yield handed_on()
        yield handed_on()

    return batches


def vocabulary(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    slip: int | None = SLIP,
) -> DataFrame:
    """(word, n) of all words that are long and frequent enough."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    words = rows.mapInArrow(_counted(min_length, slip), "word string, n bigint")
    long_enough = words.filter(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- machines -----------------------------------------------------------------------------------


class Acceptor:
    """The minimal acyclic machine that accepts a set of words: states are numbers, ``out`` their arcs."""

    def __init__(self, words: list[str]):
        self.out: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._known: dict[tuple, int] = {}
        path, before = [0], ""
        for word in sorted(set(words)):
            shared = 0
            while shared < len(before) and shared < len(word) and before[shared] == word[shared]:
                shared += 1
            self._settle(path, before, shared)
            for letter in word[shared:]:
                self.out.append({})
                self.final.append(False)
                self.out[path[-1]][letter] = len(self.out) - 1
                path.append(len(self.out) - 1)
            self.final[path[-1]] = True
            before = word
        self._settle(path, before, 0)

    def _settle(self, path: list[int], word: str, upto: int) -> None:
        """No word to come reaches the states of ``path`` beyond ``upto``: merge them with equal ones."""
        while len(path) > upto + 1:
            state = path.pop()
            kind = (self.final[state], tuple(self.out[state].items()))
            self.out[path[-1]][word[len(path) - 1]] = self._known.setdefault(kind, state)

    def common(self, first: int, second: int) -> list[str]:
        """What both states accept."""
        found, path = [], []
        stack = [(first, second, 0, "")]
        while stack:
            a, b, depth, letter = stack.pop()
            del path[max(depth - 1, 0) :]
            path.append(letter)
            if self.final[a] and self.final[b]:
                found.append("".join(path))
            arcs, others = self.out[a], self.out[b]
            for letter in arcs.keys() & others.keys():
                stack.append((arcs[letter], others[letter], depth + 1, letter))
        return found


def near_pairs(words: list[str]) -> set[tuple[str, str]]:
    """All pairs of different ``words`` one edit apart, the longer or else the smaller word first.

    The composed machine reads both words. Before the edit it is in one state of the acceptor twice, so it
    walks the words; at every state each edit leaves a pair of states, from which both words must end alike.
    A letter is only deleted where it does not follow itself: that names each deletion once.
    """
    machine = Acceptor(words)
    replaced: dict[int, list[tuple[str, str]]] = {}
    deleted: dict[tuple[int, str], list[str]] = {}
    found: set[tuple[str, str]] = set()
    path: list[str] = []
    stack = [(0, 0, "")]
    while stack:
        state, depth, letter = stack.pop()
        del path[max(depth - 1, 0) :]
        path.append(letter)
        arcs = machine.out[state]
        if state not in replaced:
            letters = sorted(arcs)
            replaced[state] = [
                (a + end, b + end)
                for i, a in enumerate(letters)
                for b in letters[i + 1 :]
                for end in machine.common(arcs[a], arcs[b])
            ]
        ends = list(replaced[state])
        for dropped in arcs:
            if dropped != letter:
                key = (state, dropped)
                if key not in deleted:
                    deleted[key] = machine.common(arcs[dropped], state)
                ends += [(dropped + end, end) for end in deleted[key]]
        if ends:
            start = "".join(path)
            found.update((start + a, start + b) for a, b in ends)
        stack += [(target, depth + 1, step) for step, target in arcs.items()]
    return found


def _composed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: the words of a partition and their counts to near pairs, in both directions."""
    for batch in parts:
        rows: list[tuple] = []
        for members in batch.column("members"):
            counts = {m["word"]: m["n"] for m in members.as_py()}
            for a, b in near_pairs(list(counts)):
                rows += [(a, counts[a], b, counts[b]), (b, counts[b], a, counts[a])]
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "near", "near_n"]
        )


# --- partitions ---------------------------------------------------------------------------------


def _halved(rows: DataFrame) -> DataFrame:
    """(word, n, m, low, high) twice: the edit lies in the second half of the open part, or in the first.

    The first ``low`` and the last ``m - high`` code points are those that the words of a partition share.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    second = F.struct(middle.alias("low"), F.col("high"))
    first = F.struct(F.col("low"), middle.alias("high"))
    return rows.select("word", "n", "m", F.inline(F.array(second, first)))


def _key() -> Column:
    shared = F.expr("substring(word, 1, low)"), F.expr("right(word, m - high)")
    return F.xxhash64("m", "low", "high", *shared)


def near_words(words: DataFrame, group_limit: int = GROUP_LIMIT, label: str = "spelling") -> DataFrame:
    """(word, n, near, near_n) of all near pairs of ``words`` (word, n), in both directions, each once."""
    length = F.char_length("word")
    lengths = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m"))
    level = lengths.withColumns({"low": F.lit(0), "high": F.col("m")})
    found: DataFrame | None = None
    while True:
        keyed = stored(_halved(level).withColumn("key", _key()), f"{label}-halves")
        short = F.count_if(F.char_length("word") == F.col("m"))
        sizes = keyed.groupBy("key").agg(F.count("*").alias("members"), short.alias("short"))
        shared = keyed.join(sizes.filter("members > 1 AND short > 0").drop("short"), "key")
        shared = stored(shared, f"{label}-shared")
        crowded = (F.col("members") > group_limit) & (F.col("high") - F.col("low") > 1)
        groups = shared.filter(~crowded).groupBy("key").agg(
            F.collect_list(F.struct("word", "n")).alias("members")
        )
        pairs = groups.select("members").mapInArrow(_composed, PAIRS)
        found = pairs if found is None else found.unionByName(pairs)
        level = shared.filter(crowded).drop("key", "members")
        if level.isEmpty():
            return found.distinct()


def _roots(forms: DataFrame, label: str) -> DataFrame:
    """(word, root) of all words with a form (word, form): forms followed to the last, by doubling."""
    current = stored(forms.select("word", F.col("form").alias("root")), f"{label}-roots")
    while True:
        ahead = current.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = current.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = stored(moved, f"{label}-roots")
        if moved.filter("moved").isEmpty():
            return moved.drop("moved")
        current = moved.drop("moved")


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    ratio: int = RATIO,
    slip: int | None = SLIP,
    group_limit: int = GROUP_LIMIT,
    label: str = "spelling",
) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n (null if no near word is frequent enough) and root."""
    words = stored(vocabulary(docs, id_col, text_col, min_length, min_count, slip), f"{label}-words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_words(words, group_limit, label).groupBy("word").agg(F.count("*").alias("n_near"), best)
    frequent = -F.col("best.minus") >= ratio * F.col("n")
    known = stored(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(frequent, F.col("best.near")).alias("form"),
            F.when(frequent, -F.col("best.minus")).alias("form_n"),
        ),
        f"{label}-forms",
    )
    roots = _roots(known.filter("form IS NOT NULL"), label)
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
