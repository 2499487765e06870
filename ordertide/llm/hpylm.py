"""Language-model scores from a hierarchical Pitman-Yor model, trained by Gibbs sampling.

Tokens are lower-cased words and one end per text. The restaurants form three levels: a root; one for every
word u of the training texts (and the start of a text) as the previous word; and below it one for every pair
(v, u) of words before a token. A token sits in the restaurant of its two previous words, the first of a text in
that of the start. Pairs share the parent u and all share the root, whose base is uniform over the vocabulary and
one unknown. A context that no training text has gives the probabilities of its parent.

Seating. A sweep takes each dish's customers out of its restaurant, seats them anew one by one given the parent's
predictive probability (beyond 256 in blocks of 1/128 of those seated), and passes the tables up as customers of the
parent; the totals of all restaurants are those before the sweep. After ``BURN_IN`` sweeps, predictive
probabilities are averaged over ``SAMPLES`` sweeps. Draws are seeded by sweep and part, in the root by sweep and
shard, so they follow the number of parts.

Defined results: a null or empty text is one end token. A null id counts as the text '' in the hold-out rule.
Repeated rows are scored, and learnt from, each. Without training rows all probabilities are the unknown's.
An empty table gives an empty result. Other columns are not read. Words and contexts are told apart by 64-bit
hashes.

Scale: tokens are dealt by the word before them into parts of about ``PART_TOKENS``, as compressed columns of numbers
in a small dictionary, whose most frequent words are numbers themselves; a word before more tokens than that is spread
over several parts. A part holds whole restaurants and sweeps them as arrays; what leaves it are counts of words for
the root, and the totals of restaurants that are spread. Dishes of one customer, most of all, are not sampled (they
always have one table). Texts are read three times: for the words, for the model, and for the scores, whose tokens
meet the model in their part and leave as sums per text. Tables of a sweep are deleted when the next one is written.
The model grows with the corpus, and nothing that does is broadcast or gathered in one task or the driver: the root
lies in shards, ranges of word hashes. A part names its words to each shard once; from then on the two exchange plain
arrays in that order, a row for a part and a shard. The ``COMMON`` most frequent words are broadcast.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ordertide.llm.restaurants import (
    DISCOUNT,
    END,
    STRENGTH,
    Dishes,
    Lookup,
    Root,
    Scorer,
    Seats,
    distinct,
    distinct_hashes,
    gathered,
    ordered,
    packed,
    part_numbers,
    predictive,
    seat,
    unpacked,
)
from ordertide.llm.wordhash import BLOCK_BYTES, NOT_BLANK, Words
from ordertide.plans.settings import file_system, scratch_path

FOLDS, HELD_OUT_FOLD = 7, 2  # fixed
BURN_IN, SAMPLES = 2, 2
PART_TOKENS = 1_500_000
COMMON, SLICES = 1 << 18, 16  # words whose numbers parts and the root exchange as arrays, cut into slices
MOST_SPREAD = 1 << 16  # words that may be spread over parts: those before more than this share of all tokens
GROUPS = 2  # blocks of texts that are dealt together
HELD_WORDS = 1 << 20  # distinct words whose counts a task adds up before it hands them on
SHARD_WORDS = 1 << 20  # words, of all parts together, that a shard of the root answers
NUMBERS = np.uint64(1 << 32)  # hashes are no smaller, so that smaller ones are numbers of common words

NO_TOTALS = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)  # names, customers, tables

# Rows of what parts, and shards of the root, exchange. A kind names what the row is; ``name`` is a shard's number,
# that of a slice, or that of texts that are dealt together.
BLOCK, STATE, SHARED, SAMPLE, PASSED_COMMON, SETTLED_COMMON = range(6)
WORDS, PASSED = 6, 7  # from a part to a shard
SEATS, ACTIVE, LINK = 8, 9, 10  # of a shard, the latter two for a part
ROOT = 11  # from a shard to a part
SUMS = 12  # from a part to a group of texts
FIXED = 1 << 32  # sums of logarithms are handed on in whole parts of this
ROW = "part int, kind int, sample int, name bigint, customers bigint, tables bigint, blob binary"
_ROW = pa.schema(
    [("part", pa.int32()), ("kind", pa.int32()), ("sample", pa.int32())]
    + [(name, pa.int64()) for name in ("name", "customers", "tables")]
    + [("blob", pa.binary())]
)


def held_out(doc_id: Column) -> Column:
    key = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(key) % FOLDS == HELD_OUT_FOLD


# --- tokens ---------------------------------------------------------------------------------------


def _groups(texts: Iterable[bytes | None], size: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``size`` bytes, with the index of the first."""
    group, held, first = [], 0, 0
    for i, text in enumerate(texts):
        group.append(text or b"")
        held += len(group[-1])
        if held >= size:
            yield first, group
            group, held, first = [], 0, i + 1
    if group:
        yield first, group


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of several texts in a row, and the number of tokens of each."""
    words = Words(b" ".join(texts), NOT_BLANK)
    own = np.diff(np.searchsorted(words.starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    text_of, counts = np.repeat(np.arange(len(texts)), own), own + 1
    found = np.empty(words.count + len(texts), np.uint64)
    found[np.arange(words.count) + text_of] = words.hashes
    found[np.cumsum(counts) - 1] = END
    return np.maximum(found, NUMBERS), counts


def _added(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, sorted, and the sums of their counts."""
    order = np.argsort(words)
    words = words[order]
    firsts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]])[: len(words)])
    return words[firsts], np.add.reduceat(counts[order], firsts) if len(firsts) else counts


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: texts to words and their counts, those of a task added up while they are few enough."""
    held, size = [], 0
    for batch in batches:
        for _, group in _groups(text.as_py() for text in batch.column("text")):
            held.append(np.unique(tokens(group)[0], return_counts=True))
            size += len(held[-1][0])
            if size >= 2 * HELD_WORDS:
                held = [_added(*(np.concatenate(columns) for columns in zip(*held, strict=True)))]
                size = len(held[0][0])
                if size >= HELD_WORDS:
                    yield _counted(*held.pop())
                    size = 0
    if held:
        yield _counted(*_added(*(np.concatenate(columns) for columns in zip(*held, strict=True))))


def _counted(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["name", "n"])


def _renumbered(size: int, *columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The numbers below ``size`` that occur, sorted, and the columns as places among them."""
    if size > 16 * len(columns[0]):  # few of many
        used = np.unique(np.concatenate(columns))
        return used, [np.searchsorted(used, column) for column in columns]
    listed = np.zeros(size, bool)
    for column in columns:
        listed[column] = True
    place = np.cumsum(listed, dtype=np.int32) - np.int32(1)
    return np.flatnonzero(listed), [place[column] for column in columns]


def _rows(**columns) -> pa.RecordBatch:
    """Rows with the given columns; the others are null."""
    n = len(next(c for c in columns.values() if isinstance(c, (list, np.ndarray, pa.Array))))
    arrays = []
    for field in _ROW:
        value = columns.get(field.name)
        if isinstance(value, np.ndarray) and value.dtype == np.uint64:
            value = value.view(np.int64)
        if value is None:
            arrays.append(pa.nulls(n, field.type))
        elif isinstance(value, (list, np.ndarray, pa.Array)):
            arrays.append(pa.array(value, field.type))
        else:
            arrays.append(pa.array(np.full(n, value), field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ROW)


def _ranked(names: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``names`` (sorted): first those that are common (sorted), by their rank, then the others by name.

    With it the names in that order, but ranks instead of common ones.
    """
    listed = _listed(names, common)
    ranks = rank[np.searchsorted(common, names[listed])]
    by_rank = np.argsort(ranks)
    order = np.concatenate([np.flatnonzero(listed)[by_rank], np.flatnonzero(~listed)])
    return order, np.concatenate([ranks[by_rank], names[~listed]])


def _named(block: list, ranked: np.ndarray) -> list:
    """A block with names instead of the numbers of common words."""
    names = block[0].copy()
    few = int(np.searchsorted(names, NUMBERS))
    names[:few] = ranked[names[:few].astype(np.int64)]
    return [names, *block[1:]]


def _dealt(parts: int, frequent: tuple[np.ndarray, np.ndarray], with_texts: bool, ranked=None):
    """Arrow function: texts to blocks of tokens, one row per part. For scores the blocks name their texts.

    ``ranked`` (broadcast) has the common words, most frequent first: their places are their numbers.
    """

    none = np.empty(0, np.uint64), np.empty(0, np.int64)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = ranked.value if ranked else none[0]
        context, group_number = TaskContext.get(), 0
        first_number = context.partitionId() << 32 if context else 0
        rank = np.argsort(common)
        common, rank = common[rank], rank.astype(np.uint64)
        for batch in rows:
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_pylist()
            texts_of = (text.as_py() for text in batch.column("text"))
            for first, group in _groups(texts_of, GROUPS * BLOCK_BYTES):
                found, counts = tokens(group)
                names, word = distinct_hashes(found)
                order, numbered = _ranked(names, common, rank)
                place = np.empty(len(order), np.int32)
                place[order] = np.arange(len(order), dtype=np.int32)
                size, end = len(names), place[np.searchsorted(names, END)]
                names, word = names[order], place[word]
                last, before = np.full_like(word, end), np.full_like(word, end)
                last[1:], before[2:] = word[:-1], word[:-2]
                text = np.repeat(np.arange(len(group), dtype=np.int32), counts)
                learnt = ~held[first : first + len(group)]
                part = part_numbers(names, names, parts, none)[last]
                spread = np.flatnonzero(np.isin(names, frequent[0])[last]) if len(frequent[0]) else none[1]
                part[spread] = part_numbers(names[last[spread]], found[spread], parts, frequent)
                del found
                # Equal neighbours compress; the order inside a part does not matter.
                bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
                order = ordered(last.astype(np.int64) * size + before)
                part = part[order].astype(np.min_scalar_type(parts))
                order = order[np.argsort(part, kind="stable")]
                del part
                numbers, blobs = [], []
                for number in np.flatnonzero(np.diff(bounds)).tolist():
                    at = order[bounds[number] : bounds[number + 1]]
                    used, columns = _renumbered(size, *(c[at] for c in (word, last, before)))
                    texts = text[at]
                    columns = [numbered[used], *columns, learnt[texts]]
                    if with_texts:
                        own, (of_text,) = _renumbered(len(group), texts)
                        columns += [of_text, [ids[first + i] for i in own], own, counts[own]]
                    numbers.append(number)
                    blobs.append(packed(*columns))
                yield _rows(part=numbers, kind=BLOCK, name=first_number + group_number, blob=blobs)
                group_number += 1

    return batches


# --- parts ----------------------------------------------------------------------------------------


def _common_tables(part: int, names: np.ndarray, counts: np.ndarray, common: np.ndarray, kind: int) -> pa.RecordBatch:
    """Counts of the common words among ``names`` as slices of one array."""
    whole = np.zeros(len(common), np.int64)
    listed = _listed(names, common)
    whole[np.searchsorted(common, names[listed])] = counts[listed]
    slices = np.array_split(whole, SLICES)
    return _rows(part=[part] * SLICES, kind=kind, name=list(range(SLICES)), blob=[packed(x) for x in slices])


def _listed(names: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which names are among ``common`` (sorted)."""
    if not len(common):
        return np.zeros(len(names), bool)
    return common[np.minimum(np.searchsorted(common, names), len(common) - 1)] == names


def _to_shards(part: int, kind: int, shards: int, names: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns of ``names`` (sorted) as one row per shard that has some of them: shards are ranges of hashes."""
    ends = np.searchsorted(names, np.array([(i << 64) // shards for i in range(1, shards)], np.uint64))
    bounds = [0, *ends.tolist(), len(names)]
    numbers = [i for i in range(shards) if bounds[i] < bounds[i + 1]]
    blobs = [packed(*(c[bounds[i] : bounds[i + 1]] for c in columns)) for i in numbers]
    return _rows(part=[part] * len(numbers), kind=kind, name=numbers, blob=blobs)


def _left(part: int, seats: Seats, common: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """What a part hands on after its customers are seated, but for the counts of words that are not common."""
    yield _rows(part=[part], kind=STATE, blob=[seats.packed()])
    yield _common_tables(part, seats.words, seats.passed(), common, PASSED_COMMON)
    names, *totals = seats.shared()
    order = np.argsort(names)
    yield _to_shards(part, SHARED, shards, names[order], names[order], *(t[order] for t in totals))


def _summed(rows: pa.Table) -> pa.Table:
    """Arrow function of one slice: the arrays of all parts added up."""
    total = sum(unpacked(b.as_py())[0] for b in rows["blob"])
    return pa.Table.from_pydict({"name": rows["name"][:1], "blob": pa.array([packed(total)], pa.binary())})


def _common_counts(rows: DataFrame, kind: int) -> np.ndarray:
    """Counts of the common words over all parts."""
    slices = rows.filter(F.col("kind") == kind).select("name", "blob").groupBy("name")
    found = slices.applyInArrow(_summed, "name bigint, blob binary").collect()  # SLICES rows, COMMON numbers at most
    return np.concatenate([np.empty(0, np.int64), *(unpacked(r.blob)[0] for r in sorted(found))])


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(list(batches), schema=_ROW)


def _opened(frequent: np.ndarray, ranked, shards: int):
    """Arrow function of a part: its blocks to its first state, and its words with their counts to the root."""

    def opened(rows: pa.Table) -> pa.Table:
        part, common = rows["part"][0].as_py(), np.sort(ranked.value)
        held = gathered([_named(unpacked(b.as_py()), ranked.value) for b in rows["blob"]])
        dishes = Dishes(held)
        seats = Seats.first(held, dishes, frequent)
        settled = np.bincount((dishes.pairs % dishes.size)[~dishes.active], minlength=dishes.size)
        passed = np.zeros(dishes.size, np.int64)
        passed[np.searchsorted(held.names, seats.words)] = seats.passed()
        n = np.bincount(held.word[held.learnt], minlength=dishes.size)
        rare = ~_listed(held.names, common)
        columns = (c[rare] for c in (held.names, n, settled, passed))
        return _table(
            [
                *_left(part, seats, common, shards),
                _common_tables(part, held.names, settled, common, SETTLED_COMMON),
                _to_shards(part, WORDS, shards, held.names[rare], *columns),
            ]
        )

    return opened


def _kind(rows: pa.Table, kind: int, sample: int | None = None) -> pa.Table:
    which = rows["kind"].to_numpy() == kind
    if sample is not None:
        which &= rows["sample"].to_numpy() == sample
    return rows.filter(pa.array(which))


def _blobs(rows: pa.Table, kind: int, key: str) -> dict[int, list]:
    """The arrays of a kind by part or by shard, in that order."""
    found = _kind(rows, kind)
    pairs = zip(found[key].to_pylist(), found["blob"].to_pylist(), strict=True)
    return {k: unpacked(blob) for k, blob in sorted(pairs)}


def _answered(rows: pa.Table, common: list[np.ndarray]) -> list[np.ndarray]:
    """What the shards answered about a part's words, and then the numbers of common ones."""
    answers = list(_blobs(rows, ROOT, "name").values())
    return [np.concatenate([*(a[i] for a in answers), c]) for i, c in enumerate(common)]


def _totals_by_name(rows: pa.Table, sample: int) -> Lookup:
    """The totals of shared restaurants."""
    found = [*_blobs(_kind(rows, SHARED, sample), SHARED, "name").values()]
    return Lookup(*(np.concatenate(c) for c in zip(NO_TOTALS, *found, strict=True)))


def _swept(turn: int, customers: int, tables: int, uniform: float, common, shards: int):
    """Arrow function of a part: its state, and the seats of the root and of shared restaurants, to its next state.

    ``common`` has the names, customers and tables of common words in the root.
    """

    def swept(rows: pa.Table) -> pa.Table:
        part = rows["part"][0].as_py()
        blobs = _kind(rows, STATE)["blob"]
        if not len(blobs):
            return _ROW.empty_table()
        seats = Seats.unpacked(blobs[0].as_py())
        names, *numbers = common.value
        rare = ~_listed(seats.words, names)
        own = Lookup(np.concatenate([seats.words[rare], names]), *_answered(rows, numbers))
        root = Root(own, customers, tables, uniform)
        seats.sweep(root, _totals_by_name(rows, 0), np.random.default_rng([1, turn, part]))
        passed = _to_shards(part, PASSED, shards, seats.words[rare], seats.passed()[rare])
        sample = _rows(part=[part], kind=SAMPLE, blob=[packed(seats.tables, seats.leaf_tables)])
        return _table([*_left(part, seats, names, shards), passed, sample])

    return swept


def _scored(
    samples: int, frequent: np.ndarray, n: int, v: int, totals: list[tuple[int, int]], common
):
    """Arrow function of a part: its blocks and the model to sums per text, a row for each block.

    ``common`` has the common words, most frequent first, and then their names, sorted, their counts and their seats
    in each sample; ``totals`` are those of the root.
    """
    def scored(rows: pa.Table) -> pa.Table:
        ranked, names, *numbers = common.value
        dealt = _kind(rows, BLOCK)
        part, numbers_of = rows["part"][0].as_py(), dealt["name"].to_pylist()
        blocks = [_named(unpacked(b.as_py()), ranked) for b in dealt["blob"]]
        rows = rows.filter(pa.array(rows["kind"].to_numpy() != BLOCK))
        if not blocks:
            return _ROW.empty_table()
        held = gathered([b[:5] for b in blocks])
        lengths = [len(b[1]) for b in blocks]
        blocks = [b[5:] for b in blocks]  # the tokens themselves are in ``held`` now
        dishes = Dishes(held)
        asked = np.concatenate([held.names[~_listed(held.names, names)], names])
        times, *seats = Lookup(asked, *_answered(rows, numbers)).of(held.names)[1]
        scorer = Scorer(held.names, dishes, frequent)
        for i in range(samples):
            base = predictive(0, *seats[2 * i : 2 * i + 2], *totals[i], 1.0 / (v + 1))
            tables = unpacked(_kind(rows, SAMPLE, i)["blob"][0].as_py())
            scorer.add(*tables, base, _totals_by_name(rows, i))
        end = int(np.searchsorted(held.names, END))
        out, low = [], 0
        for (of_text, ids, own, counts), length in zip(blocks, lengths, strict=True):
            high = low + length
            word, last, before = (column[low:high] for column in (held.word, held.last, held.before))
            times_here = times[word]
            chances = scorer.averaged(word, last, before)
            values = times_here > 0, -np.log10((times_here + 1) / (n + v + 1)), -np.log10(chances)
            known, *logs = (np.bincount(of_text, weights=x, minlength=len(own)) for x in values)
            ended = np.unique(of_text[word == end])  # the part with the end of a text names it
            sums = known.astype(np.int64), *(np.rint(x * FIXED).astype(np.int64) for x in logs)
            out.append(packed(own, *sums, own[ended], counts[ended], [ids[i] for i in ended]))
            low = high
        return _table([_rows(part=part, kind=SUMS, name=numbers_of, blob=out)])

    return scored


def _texts(id_type: pa.DataType):
    """Arrow function of texts that were dealt together: the sums of all parts to a row per text."""

    def texts(rows: pa.Table) -> pa.Table:
        held = list(_blobs(rows, SUMS, "part").values())
        size = 1 + max(int(own[-1]) for own, *_ in held)
        sums, n_tokens, doc_ids = np.zeros((3, size), np.int64), np.zeros(size, np.int64), [None] * size
        for own, known, base, score, ended, counts, ids in held:
            sums[:, own] += known, base, score
            n_tokens[ended] = counts
            for i, doc_id in zip(ended.tolist(), ids, strict=True):
                doc_ids[i] = doc_id
        columns = pa.array(doc_ids, id_type), n_tokens, sums[0], -sums[1] / FIXED, -sums[2] / FIXED
        return pa.table(dict(zip(("doc_id", "n_tokens", "n_known", "base_score", "score"), columns, strict=True)))

    return texts


# --- the root -------------------------------------------------------------------------------------


def _seated(shard: int, n, settled, customers, tables, active: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A shard's seats, and for each part those of its active words, in their order there."""
    sums = {"customers": [int(customers.sum())], "tables": [int(tables.sum())]}
    yield _rows(kind=SEATS, name=[shard], blob=[packed(n, settled, customers, tables)], **sums)
    blobs = [packed(customers[at], tables[at]) for at in active.values()]
    yield _rows(part=list(active), kind=ROOT, name=[shard] * len(blobs), blob=blobs)


def _root_opened(rows: pa.Table) -> pa.Table:
    """Arrow function of a shard: the words of all parts to its first seats, and where those of each part are."""
    shard, asked = rows["name"][0].as_py(), _blobs(rows, WORDS, "part")
    names = distinct(np.concatenate([a[0] for a in asked.values()]))
    sums, links, active = np.zeros((3, len(names)), np.int64), {}, {}
    for part, (own, *counts) in asked.items():
        links[part] = at = np.searchsorted(names, own)
        sums[:, at] += counts
        if (counts[2] > 0).any():
            active[part] = at[counts[2] > 0]
    n, settled, passed = sums
    customers = settled + passed
    found = list(_seated(shard, n, settled, customers, np.minimum(customers, 1), active))
    for kind, places in ((ACTIVE, active), (LINK, links)):
        blobs = [packed(at) for at in places.values()]
        found.append(_rows(part=list(places), kind=kind, name=[shard] * len(blobs), blob=blobs))
    return _table(found)


def _root_swept(turn: int, weight: float):
    """Arrow function of a shard: its seats and the tables that parts pass up to its next seats."""

    def swept(rows: pa.Table) -> pa.Table:
        shard = rows["name"][0].as_py()
        ((n, settled, *_),) = _blobs(rows, SEATS, "name").values()
        active = {part: at for part, (at,) in _blobs(rows, ACTIVE, "part").items()}
        customers = settled.copy()
        for part, (passed,) in _blobs(rows, PASSED, "part").items():
            customers[active[part]] += passed
        draws = np.random.default_rng([0, turn, shard])
        tables = seat(customers, np.full(len(customers), weight), DISCOUNT[0], draws)
        return _table(_seated(shard, n, settled, customers, tables, active))

    return swept


def _root_answers(rows: pa.Table) -> pa.Table:
    """Arrow function of a shard: for each part the counts of its words and their seats in every sample."""
    shard = rows["name"][0].as_py()
    seats = _blobs(rows, SEATS, "sample")
    numbers = [next(iter(seats.values()))[0], *(c for _, _, *own in seats.values() for c in own)]
    links = _blobs(rows, LINK, "part")
    blobs = [packed(*(c[at] for c in numbers)) for (at,) in links.values()]
    return _table([_rows(part=list(links), kind=ROOT, name=[shard] * len(blobs), blob=blobs)])


# --- the model ------------------------------------------------------------------------------------


class Scratch:
    """Tables of a run under one label, each deleted when it is done with."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.label}-{name}")
        frame.write.parquet(path)
        stored = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(stored)] = (path, stored)
        return stored

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables, and let Spark clean up the shuffles that wrote them."""
        for frame in frames:
            target, files = file_system(self.spark, self.paths.pop(id(frame))[0])
            files.delete(target, True)
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def _totals(root: DataFrame) -> tuple[int, int]:
    seats = root.filter(F.col("kind") == SEATS)
    return tuple(seats.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("customers", "tables"))).first())


def _shared_totals(rows: pa.Table) -> pa.Table:
    """Arrow function of a shard: what parts hold of shared restaurants to the totals, for each of those parts."""
    shard, held = rows["name"][0].as_py(), _blobs(rows, SHARED, "part")
    names = distinct(np.concatenate([names for names, *_ in held.values()]))
    places = {part: np.searchsorted(names, own) for part, (own, *_) in held.items()}
    sums = np.zeros((2, len(names)), np.int64)
    for part, (_, *totals) in held.items():
        sums[:, places[part]] += totals
    blobs = [packed(names[at], *sums[:, at]) for at in places.values()]
    return _table([_rows(part=list(places), kind=SHARED, name=[shard] * len(blobs), blob=blobs)])


def _shared(state: DataFrame, sample: int) -> DataFrame:
    totals = _grouped("name", _of_kind(state, SHARED)).applyInArrow(_shared_totals, ROW)
    return totals.withColumn("sample", F.lit(sample))


def _of_kind(state: DataFrame, kind: int, sample: int = 0) -> DataFrame:
    return state.filter(F.col("kind") == kind).withColumn("sample", F.lit(sample))


def _grouped(key: str, *frames: DataFrame):
    """Rows of several tables by part or by shard."""
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union.groupBy(key)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_tokens: int = PART_TOKENS,
    common_words: int = COMMON,
    label: str = "hpylm",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, label)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).cast("binary").alias("text"),
    )
    learnt = rows.filter(~F.col("held_out")).select("text")
    counted = learnt.mapInArrow(_word_counts, "name bigint, n bigint").groupBy("name").agg(F.sum("n").alias("n"))
    words = scratch.keep(counted, "words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    uniform = 1.0 / (v + 1)
    parts = max(1, math.ceil(n * FOLDS / (FOLDS - 1) / part_tokens))
    often = words.filter(F.col("n") > max(part_tokens // 2, n // MOST_SPREAD)).orderBy("name").collect()
    pairs = sorted((r["name"] % (1 << 64), 2 * math.ceil(r["n"] / part_tokens)) for r in often)
    frequent = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)

    # The most frequent words, COMMON at most whatever the corpus, are known to every part.
    most = scratch.keep(words.filter(F.col("n") > 1).orderBy(F.desc("n"), "name").limit(common_words), "common")
    listed = most.toArrow()
    names, common_n = listed["name"].to_numpy().view(np.uint64), listed["n"].to_numpy()
    by_rank, by_name = np.lexsort((names, -common_n)), np.argsort(names)
    ranked = spark.sparkContext.broadcast(names[by_rank])
    names, common_n = names[by_name], common_n[by_name]
    # A word is in no more parts than it has customers.
    asked = words.agg(F.coalesce(F.sum(F.least("n", F.lit(parts))), F.lit(0))).first()[0]
    shards = max(1, math.ceil((asked - int(np.minimum(common_n, parts).sum())) / SHARD_WORDS))
    blocks = rows.mapInArrow(_dealt(parts, frequent, with_texts=False, ranked=ranked), ROW)
    opened = _grouped("part", blocks).applyInArrow(_opened(frequent[0], ranked, shards), ROW)
    del blocks
    opened = scratch.keep(opened, "opened")
    scratch.drop(words, most)
    kind = F.col("kind")
    links = scratch.keep(_grouped("name", _of_kind(opened, WORDS)).applyInArrow(_root_opened, ROW), "root")
    common_settled = _common_counts(opened, SETTLED_COMMON)
    seats = common_settled + _common_counts(opened, PASSED_COMMON), np.ones(len(names), np.int64)
    state = scratch.keep(opened.filter(kind.isin(STATE, SHARED)), "state")
    scratch.drop(opened)

    root, samples = links, []
    for turn in range(BURN_IN + SAMPLES):
        totals = [a + int(b.sum()) for a, b in zip(_totals(root), seats, strict=True)]
        shipped = spark.sparkContext.broadcast((names, *seats))
        moved = _grouped("part", _of_kind(state, STATE), _of_kind(root, ROOT), _shared(state, 0))
        after = scratch.keep(moved.applyInArrow(_swept(turn, *totals, uniform, shipped, shards), ROW), "state")
        shipped.destroy()
        weight = (STRENGTH[0] + DISCOUNT[0] * totals[1]) * uniform
        held = common_settled + _common_counts(after, PASSED_COMMON)
        draws = np.random.default_rng([2, turn])
        seats = held, seat(held, np.full(len(held), weight), DISCOUNT[0], draws)
        passed = _grouped("name", _of_kind(root, SEATS), _of_kind(links, ACTIVE), _of_kind(after, PASSED))
        moved = scratch.keep(passed.applyInArrow(_root_swept(turn, weight), ROW), "root")
        if turn >= BURN_IN:  # of a sample only the tables are needed, and the totals of shared restaurants
            totals = [a + int(b.sum()) for a, b in zip(_totals(moved), seats, strict=True)]
            tables = scratch.keep(after.filter(kind.isin(SAMPLE, SHARED)), "sample")
            samples.append((tables, moved, seats, totals))
        scratch.drop(state, *([root] if 0 < turn <= BURN_IN else []))
        state, root = after, moved
    scratch.drop(state)

    # The root's numbers of words: of common ones to all parts, of the others to those that have them.
    models = [f for i, (tables, *_) in enumerate(samples) for f in (_of_kind(tables, SAMPLE, i), _shared(tables, i))]
    held = [_of_kind(root, SEATS, i) for i, (_, root, *_) in enumerate(samples)]
    answers = _grouped("name", _of_kind(links, LINK), *held).applyInArrow(_root_answers, ROW)
    found = names, common_n, *(c for _, _, seats, _ in samples for c in seats)
    found = spark.sparkContext.broadcast((ranked.value, *found))
    blocks = rows.mapInArrow(_dealt(parts, frequent, with_texts=True, ranked=ranked), ROW)
    dealt = _grouped("part", blocks, answers, *models)
    totals = [totals for *_, totals in samples]
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    sums = dealt.applyInArrow(_scored(len(samples), frequent[0], n, v, totals, found), ROW)
    columns = f"doc_id {id_kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    whole = scratch.keep(sums.groupBy("name").applyInArrow(_texts(id_type), columns), "scores")
    result = whole.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )
    for shipped in (found, ranked):
        shipped.destroy()
    scratch.drop(*(f for tables, root, *_ in samples for f in (tables, root)), links)
    return result.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
