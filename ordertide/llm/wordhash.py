"""The words of a text as positions and 64-bit hashes, by numpy."""

from __future__ import annotations

import numpy as np

BLOCK_BYTES = 4 << 20  # of texts taken together
HASH_BYTES = 256 << 10  # hashed at a time
LONG = 512  # bytes of a word beyond which it is hashed by itself
_BASE = np.uint64(0x9E3779B97F4A7C15)
GAP = 32  # the byte that separates words in a normalised text

# Byte translations: A-Z become lower case, the bytes between words become a blank.
ALPHANUMERIC = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else GAP
    for b in range(256)
)
NOT_BLANK = bytes(b + 32 if 65 <= b <= 90 else GAP if 9 <= b <= 13 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    return mixed(first * _BASE + second)


# Which bytes of eight belong to a word that has 0 to 8 bytes left.
_LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """The words of one text: where they begin and end in its normalised bytes, and their hashes."""

    def __init__(self, text: bytes | None, table: bytes):
        self.plain = (text or b"").translate(table)
        inside = np.frombuffer(self.plain, np.uint8) != GAP
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.count = len(self.starts)
        self.hashes = np.empty(self.count, np.uint64)
        first = 0
        while first < self.count:  # blocks of whole words, so that memory does not follow the text
            last = int(np.searchsorted(self.ends, self.starts[first] + HASH_BYTES, "right"))
            last = max(last, first + 1)
            self.hashes[first:last] = self._hash(first, last)
            first = last

    def _hash(self, first: int, last: int) -> np.ndarray:
        """Hashes of the words ``first`` to ``last``: of their lengths and of eight bytes after the other."""
        low, high = int(self.starts[first]), int(self.ends[last - 1])
        starts = self.starts[first:last] - low
        lengths = self.ends[first:last] - low - starts
        raw = self.plain[low:high] + bytes(8)
        eights = np.ndarray(high - low, "<u8", raw, strides=(1,))  # those from every byte on
        hashes = lengths.astype(np.uint64)
        at, left, done = np.flatnonzero(lengths <= LONG), lengths[lengths <= LONG], 0
        while len(at):
            held = eights[starts[at] + done] & _LEFT[np.minimum(left, 8)]
            hashes[at] = joined(hashes[at], held)
            more = left > 8
            at, left, done = at[more], left[more] - 8, done + 8
        for i in np.flatnonzero(lengths > LONG):
            word = raw[starts[i] : starts[i] + lengths[i]]
            held = np.frombuffer(word + bytes(-len(word) % 8), "<u8")
            places = np.arange(1, len(held) + 1, dtype=np.uint64) * _BASE
            hashes[i] = joined(hashes[i : i + 1], mixed(held + places).sum(keepdims=True))[0]
        return hashes

    def grams(self, size: int) -> np.ndarray:
        """Hashes of all runs of ``size`` words."""
        n = self.count - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total = np.full(n, size, np.uint64)
        for i in range(size):
            total = joined(total, self.hashes[i : i + n])
        return total
