"""Restaurants of a hierarchical Pitman-Yor model as arrays: what one part of them holds, its sweep and its scores.

A part has the tokens whose previous word (``last``) it is dealt, and so whole restaurants: those of one word (last)
and those of two words (a place: before and last). A dish of a last is a pair. Where a last is so frequent that its
tokens are spread by word over several parts, its restaurants are shared: every part has other dishes of them, and
their totals come from outside. So do the counts of words in the root.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ordertide.llm.wordhash import joined, mixed

DISCOUNT = (0.6, 0.7, 0.8)  # root, one word, two words
STRENGTH = (10.0, 5.0, 2.0)
END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text, and for what is before its first word
ZSTD = pa.Codec("zstd", compression_level=3)
BLOCKS = 128  # beyond twice as many customers, those of a dish are seated in blocks of 1 / BLOCKS


# --- packing -------------------------------------------------------------------------------------


def _plain(values):
    """An array as (type, bytes): whole numbers in the fewest bytes that hold them, sorted ones as differences, and
    the first bytes of all numbers, then the second and so on, as equal bytes in a row compress."""
    if not isinstance(values, np.ndarray) or values.dtype.kind not in "iu" or not len(values):
        return values
    sorted_ = bool((values[1:] >= values[:-1]).all())
    if sorted_:
        values = np.concatenate([values[:1], np.diff(values)])
    if values.dtype.kind == "u" or values.min() >= 0:
        values = values.astype(np.min_scalar_type(values.max()))
    columns = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return sorted_, values.dtype.str, columns.tobytes()


def _restored(value, kind: str):
    if not isinstance(value, tuple):
        return value
    sorted_, dtype, raw = value
    size = np.dtype(dtype).itemsize
    numbers = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()
    numbers = numbers.astype(np.uint64 if kind == "u" else np.int64)
    return np.cumsum(numbers, dtype=numbers.dtype) if sorted_ else numbers


def packed(*values) -> bytes:
    """Arrays of whole numbers (int64 or uint64), and other values, compressed."""
    kinds = [v.dtype.kind if isinstance(v, np.ndarray) else "" for v in values]
    raw = pickle.dumps([(kind, _plain(v)) for kind, v in zip(kinds, values, strict=True)], protocol=5)
    return len(raw).to_bytes(8, "little") + ZSTD.compress(raw, asbytes=True)


def unpacked(blob: bytes) -> list:
    values = pickle.loads(ZSTD.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))
    return [_restored(value, kind) for kind, value in values]


# --- sorting --------------------------------------------------------------------------------------
# Numbers are sorted much faster than places of numbers, so places are sorted as their last bits.


def ordered(keys: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on."""
    bits = len(keys).bit_length()
    if not len(keys) or int(keys.max()) >> (64 - bits):
        return np.argsort(keys, kind="stable")
    placed = keys.astype(np.uint64)
    placed <<= np.uint64(bits)
    placed |= np.arange(len(keys), dtype=np.uint64)
    placed.sort()
    placed &= np.uint64((1 << bits) - 1)
    return placed.view(np.int64)


def distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values, sorted."""
    values = np.sort(values)
    return values[_firsts(values)]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which of sorted values differ from the one before."""
    firsts = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=firsts[1:])
    return firsts


def _placed(values: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, sorted, the place of each value among them, and how often they occur; ``order`` sorts them."""
    values = values[order]
    firsts = _firsts(values)
    place = np.empty(len(values), np.int64)
    numbers = np.cumsum(firsts)
    numbers -= 1
    place[order] = numbers
    firsts = np.flatnonzero(firsts)
    return values[firsts], place, np.diff(firsts, append=len(values))


def distinct_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers from 0 on, sorted, the place of each number among them, and how often they occur."""
    return _placed(keys, ordered(keys))


def distinct_hashes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and the place of each hash among them."""
    bits = np.uint64(len(hashes).bit_length())
    order = ordered(hashes >> bits)
    found = hashes[order]
    if (found[1:] < found[:-1]).any():  # hashes that differ in their last bits only
        return np.unique(hashes, return_inverse=True)
    return _placed(hashes, order)[:2]


# --- tokens of a part -----------------------------------------------------------------------------


def part_numbers(
    last: np.ndarray, word: np.ndarray, parts: int, frequent: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    """The part of each token; the lasts of ``frequent`` (sorted) are spread by word over so many parts."""
    home = (mixed(last) >> np.uint64(8)) % np.uint64(parts)
    names, widths = frequent
    if len(names):
        at = np.minimum(np.searchsorted(names, last), len(names) - 1)
        width = np.where(names[at] == last, widths[at], 1).astype(np.uint64)
        home = (home + (mixed(word) >> np.uint64(8)) % width) % np.uint64(parts)
    return home.astype(np.int64)


class Tokens(NamedTuple):
    """Tokens of a part: numbers of word, last and before in ``names`` (sorted), and whether they are learnt from."""

    names: np.ndarray
    word: np.ndarray
    last: np.ndarray
    before: np.ndarray
    learnt: np.ndarray


def gathered(blocks: list[list]) -> Tokens:
    """The tokens of several blocks (names, word, last, before, learnt)."""
    names = distinct(np.concatenate([END[None], *(b[0] for b in blocks)]))  # of all blocks
    at = [np.searchsorted(names, b[0]) for b in blocks]
    word, last, before = (
        np.concatenate([a[b[i]] for a, b in zip(at, blocks, strict=True)]) if blocks else np.empty(0, np.int64)
        for i in (1, 2, 3)
    )
    learnt = np.concatenate([b[4] for b in blocks]) if blocks else np.empty(0, bool)
    return Tokens(names, word, last, before, learnt)


class Dishes:
    """The pairs and dishes that a part learns, in the order of their names.

    ``pairs`` are last * size + word; ``fixed`` are the customers of a pair that do not depend on seating (first words
    of texts, and dishes of one customer, which always have one table), ``many`` its dishes of several customers.
    ``dishes`` are pair * size + before, with ``n`` customers; ``places`` are last * size + before.
    """

    def __init__(self, tokens: Tokens):
        self.size = size = len(tokens.names)
        end = int(np.searchsorted(tokens.names, END))
        word, last, before = (a[tokens.learnt] for a in (tokens.word, tokens.last, tokens.before))
        self.pairs, of_pair, _ = distinct_places(last * size + word)
        direct = last == end
        count = len(self.pairs)
        self.dishes, _, self.n = distinct_places(of_pair[~direct] * size + before[~direct])
        self.dish_pair = self.dishes // size
        at = (self.pairs[self.dish_pair] // size) * size + self.dishes % size
        self.places, self.dish_place, _ = distinct_places(at)
        single = self.n == 1
        self.fixed = np.bincount(of_pair[direct], minlength=count) + np.bincount(self.dish_pair[single], minlength=count)
        self.many = np.bincount(self.dish_pair[~single], minlength=count)
        self.active = (self.fixed > 1) | (self.many > 0)  # all others have one customer at one table


class Seats:
    """What a sweep needs of a part: its active pairs, its dishes of several customers (leaves), and totals.

    ``shared_last`` and ``shared_place`` mark restaurants that other parts hold dishes of.
    """

    ARRAYS = (
        "words", "lasts", "last_alone", "shared_last", "pair_word", "pair_last", "fixed", "customers", "tables",
        "places", "shared_place", "place_customers", "place_alone", "leaf_pair", "leaf_place", "leaf_customers",
        "leaf_tables",
    )

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def first(cls, tokens: Tokens, dishes: Dishes, frequent: np.ndarray) -> Seats:
        """One table for every dish that has customers."""
        size, names = dishes.size, tokens.names
        active = np.flatnonzero(dishes.active)
        leaf = np.flatnonzero(dishes.n > 1)
        word_of, words = dishes.pairs[active] % size, np.unique(dishes.pairs[active] % size)
        last_of = dishes.pairs // size
        held = np.bincount(dishes.dish_place, weights=dishes.n, minlength=len(dishes.places)).astype(np.int64)
        alone = np.bincount(dishes.dish_place[dishes.n == 1], minlength=len(dishes.places))
        shared_names = np.isin(names, frequent)
        # Of shared restaurants all are kept: other parts may have leaves or pairs of them.
        lasts = np.unique(np.concatenate([last_of[active], np.unique(last_of)[shared_names[np.unique(last_of)]]]))
        place_last = dishes.places // size
        places = np.unique(np.concatenate([dishes.dish_place[leaf], np.flatnonzero(shared_names[place_last])]))
        settled = np.bincount(last_of[~dishes.active], minlength=size)
        return cls(
            words=names[words],
            lasts=names[lasts],
            last_alone=settled[lasts],
            shared_last=shared_names[lasts],
            pair_word=np.searchsorted(words, word_of),
            pair_last=np.searchsorted(lasts, last_of[active]),
            fixed=dishes.fixed[active],
            customers=(dishes.fixed + dishes.many)[active],
            tables=np.ones(len(active), np.int64),
            places=joined(names[dishes.places[places] % size], names[place_last[places]]),
            shared_place=shared_names[place_last[places]],
            place_customers=held[places],
            place_alone=alone[places],
            leaf_pair=np.searchsorted(active, dishes.dish_pair[leaf]),
            leaf_place=np.searchsorted(places, dishes.dish_place[leaf]),
            leaf_customers=dishes.n[leaf],
            leaf_tables=np.ones(len(leaf), np.int64),
        )

    def packed(self) -> bytes:
        return packed(*(getattr(self, name) for name in self.ARRAYS))

    @classmethod
    def unpacked(cls, blob: bytes) -> Seats:
        return cls(**dict(zip(cls.ARRAYS, unpacked(blob), strict=True)))

    def last_totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each last that lie in this part."""
        return tuple(
            self.last_alone + np.bincount(self.pair_last, weights=values, minlength=len(self.lasts)).astype(np.int64)
            for values in (self.customers, self.tables)
        )

    def place_totals(self) -> tuple[np.ndarray, np.ndarray]:
        passed = np.bincount(self.leaf_place, weights=self.leaf_tables, minlength=len(self.places)).astype(np.int64)
        return self.place_customers, self.place_alone + passed

    def passed(self) -> np.ndarray:
        """Tables of the active pairs of each word: customers of the root."""
        return np.bincount(self.pair_word, weights=self.tables, minlength=len(self.words)).astype(np.int64)

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, customers and tables of what this part holds of shared restaurants."""
        lasts, places = self.last_totals(), self.place_totals()
        pick = self.shared_last, self.shared_place
        return tuple(
            np.concatenate([a[pick[0]], b[pick[1]]])
            for a, b in zip((self.lasts, *lasts), (self.places, *places), strict=True)
        )

    def sweep(self, root: Root, shared: Lookup, rng: np.random.Generator) -> None:
        """Seat all customers anew, leaves first, given the totals before the sweep."""
        all_last = shared.instead(self.lasts, self.shared_last, self.last_totals())
        all_place = shared.instead(self.places, self.shared_place, self.place_totals())
        root_customers, root_tables = root.seats(self.words)
        base = predictive(0, root_customers, root_tables, root.customers, root.tables, root.uniform)
        pair, last = self.leaf_pair, self.pair_last[self.leaf_pair]
        left = np.maximum(self.customers[pair] - self.leaf_tables, 0)  # own tables leave the parent first
        there = np.minimum(self.tables[pair], left)
        parent = predictive(1, left, there, all_last[0][last], all_last[1][last], base[self.pair_word[pair]])
        weight = (STRENGTH[2] + DISCOUNT[2] * all_place[1][self.leaf_place]) * parent
        self.leaf_tables = seat(self.leaf_customers, weight, DISCOUNT[2], rng)
        moved = np.bincount(pair, weights=self.leaf_tables, minlength=len(self.fixed)).astype(np.int64)
        self.customers = self.fixed + moved
        left = np.maximum(root_customers[self.pair_word] - self.tables, 0)
        there = np.minimum(root_tables[self.pair_word], left)
        parent = predictive(0, left, there, root.customers, root.tables, root.uniform)
        weight = (STRENGTH[1] + DISCOUNT[1] * all_last[1][self.pair_last]) * parent
        self.tables = seat(self.customers, weight, DISCOUNT[1], rng)


class Lookup:
    """Numbers by name; names that are not listed have zeros."""

    def __init__(self, names: np.ndarray, *columns: np.ndarray):
        order = np.argsort(names)
        self.names, self.columns = names[order], [c[order] for c in columns]

    def of(self, names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each name is listed, and its numbers."""
        if not len(self.names):
            return np.zeros(len(names), bool), [np.zeros(len(names), c.dtype) for c in self.columns]
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        listed = self.names[at] == names
        return listed, [np.where(listed, c[at], 0) for c in self.columns]

    def instead(self, names, which, totals):
        """``totals``, but the listed ones where ``which``."""
        if not which.any():
            return totals
        listed, numbers = self.of(names)
        return tuple(np.where(which & listed, n, t) for n, t in zip(numbers, totals, strict=True))


class Root:
    """The root as a sweep sees it: seats of the words a part asked for, and the totals of all."""

    def __init__(self, seats: Lookup, customers: int, tables: int, uniform: float):
        self._seats, self.customers, self.tables, self.uniform = seats, customers, tables, uniform

    def seats(self, words: np.ndarray) -> list[np.ndarray]:
        return self._seats.of(words)[1]


def predictive(level: int, customers, tables, all_customers, all_tables, parent):
    """The probability of a dish, from its seats, its restaurant's totals and its parent's probability."""
    d, s = DISCOUNT[level], STRENGTH[level]
    return (np.maximum(customers - d * tables, 0.0) + (s + d * all_tables) * parent) / (s + all_customers)


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng) -> np.ndarray:
    """Tables that ``customers`` of one dish take; ``weight`` is (strength + discount * tables) * parent."""
    tables = (customers > 0).astype(np.int64)
    active = np.flatnonzero(customers > 1)
    seated = 1
    while len(active):
        block = max(1, seated // BLOCKS)
        step = np.minimum(block, customers[active] - seated)
        new = weight[active]
        chance = new / (new + seated - discount * tables[active])
        tables[active] += rng.binomial(step, np.clip(chance, 0.0, 1.0))
        seated += block
        active = active[customers[active] > seated]
    return tables


# --- scores ---------------------------------------------------------------------------------------


class Scorer:
    """Probabilities of a part's tokens; what does not depend on a sample is looked up once per run of tokens."""

    def __init__(self, names: np.ndarray, dishes: Dishes, frequent: np.ndarray):
        self.names, self.dishes = names, dishes
        self.is_shared = np.isin(names, frequent)
        self.samples: list[tuple] = []

    def add(self, pair_tables: np.ndarray, leaf_tables: np.ndarray, base: np.ndarray, shared: Lookup) -> None:
        """One more sample: tables of active pairs and of leaves; ``base`` has the root's probability of every name."""
        dishes, size = self.dishes, self.dishes.size
        tables = np.ones(len(dishes.pairs), np.int64)
        tables[dishes.active] = pair_tables
        dish_tables = np.ones(len(dishes.dishes), np.int64)
        dish_tables[dishes.n > 1] = leaf_tables
        leaf = dishes.dish_pair[dishes.n > 1]
        passed = np.bincount(leaf, weights=leaf_tables, minlength=len(dishes.pairs)).astype(np.int64)
        customers = dishes.fixed + passed
        last_of, places = dishes.pairs // size, len(dishes.places)
        last = tuple(np.bincount(last_of, weights=v, minlength=size) for v in (customers, tables))
        place = tuple(np.bincount(dishes.dish_place, weights=v, minlength=places) for v in (dishes.n, dish_tables))
        last = shared.instead(self.names, self.is_shared, last)
        # What is not there has zeros, behind the last.
        place, pair = (tuple(np.append(v, 0) for v in both) for both in (place, (customers, tables)))
        dish = np.append(dishes.n, 0), np.append(dish_tables, 0)
        self.samples.append((base, shared, last, place, pair, dish))

    @staticmethod
    def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Places of ``wanted`` in ``keys``; one behind the last where there is none."""
        at = np.searchsorted(keys, wanted)
        listed = keys[np.minimum(at, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)
        return np.where(listed, at, len(keys))

    def averaged(self, word: np.ndarray, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The mean probability of each token over the samples."""
        dishes, size = self.dishes, self.dishes.size
        pair = self._found(dishes.pairs, last * size + word)
        place = self._found(dishes.places, last * size + before)
        dish = self._found(dishes.dishes, np.where(pair < len(dishes.pairs), pair, -1) * size + before)
        inner = self.names[last] != END
        spread = np.flatnonzero(self.is_shared[last])
        places = joined(self.names[before[spread]], self.names[last[spread]])
        total = np.zeros(len(word))
        for base, shared, all_last, all_place, of_pair, of_dish in self.samples:
            p = predictive(1, *(v[pair] for v in of_pair), *(v[last] for v in all_last), base[word])
            totals = [v[place] for v in all_place]
            listed, numbers = shared.of(places)
            for whole, those in zip(totals, numbers, strict=True):
                whole[spread[listed]] = those[listed]
            own = (v[dish] for v in of_dish)
            total += np.where(inner, predictive(2, *own, *totals, p), p)
        return total / len(self.samples)
