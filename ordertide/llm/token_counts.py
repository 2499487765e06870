"""Token counts from a BPE tokenizer compiled to deterministic transducers.

Compilation. Each prefix of a word has one valid tokenization, known from its last token: the one token that ends
there and does not merge with what precedes it. A state is what later bytes can still depend on: the
longest suffix that some token begins with, and the last token and the count of tokens at each place in it. A
transition reads a byte and is annotated with how many tokens it adds; a second kind reads the last byte of a
word, whose symbols carry the end-of-word mark. States and transitions are compiled when first reached and kept,
at most ``MAX_STATES`` at a time.

Long words are cut into chunks. A chunk is a map from the state before it to the state after it and the tokens
emitted. All maps of a word are composed by a parallel prefix scan (each round composes neighbours at double
the distance). Whatever state a chunk is entered in, its run soon meets the run of a fresh entry; from there on
the two are one, so a map is a reference run plus what differs before the meeting. Chunks of a text that begin
where no word is open are constant maps, and composing them is adding their counts.

Normalisation (composed form, white space, lower case) and the cut into words follow the tokenizer's file, as do
its special strings, which count one token wherever they occur in a text.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows stay. An empty table gives an
empty result. Other columns are not read.

Scale: one pass over the texts, no shuffle. The distinct words of a batch are counted once; memory is bounded by
the batch and the bounded caches.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN_LIMIT = 2048  # fixed
MAX_STATES = 200_000
MAX_WORDS = 200_000
CHUNK = 4096
EXOTIC_BLANKS = regex.compile("[\x1c-\x1f]")  # blanks for str.split() only
SPACE = regex.compile(r"[\t-\r\x85\p{Z}]+")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Transducer:
    """The BPE merges of a tokenizer file as lazily compiled transitions over bytes."""

    START = 0

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        characters = byte_characters()
        self.mark = suffix
        self.ids: dict[str, int] = {}
        self.parts: list[tuple[int, int] | None] = []
        self.rank: dict[tuple[int, int], int] = {}
        for c in [*characters, *(c + suffix for c in characters)]:
            self._add(c, None)
        for rank, (left, right) in enumerate(merges):
            pair = self.ids[left], self.ids[right]
            self._add(left + right, pair)
            self.rank[pair] = rank
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        starts = {""}
        for token, at in self.ids.items():
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                self.final[token[: -len(suffix)]] = at
            else:
                self.inner[token] = at
        for table in (self.inner, self.final):
            for token in table:
                starts.update(token[:n] for n in range(1, len(token)))
        self.starts = starts
        self.characters = characters
        self.spines: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.whole: dict[int, bool] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.reset()

    def _add(self, token: str, pair: tuple[int, int] | None) -> None:
        if token not in self.ids:
            self.ids[token] = len(self.parts)
            self.parts.append(pair)

    def reset(self) -> None:
        """Forget all states; they are compiled again when reached."""
        # A state: the suffix, and (last token, tokens so far less tokens now) at each place from its start.
        start = ("", ((-1, 0),))
        self.states = [start]
        self.number = {start: self.START}
        self.steps: dict[int, tuple[int, int]] = {}
        self.ends: dict[int, int] = {}
        self.apart.clear()

    # --- which tokens can follow each other ---

    def _spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens at one edge of ``token`` as it is built, each with the rank of the merge that ends it."""
        key = (token, right)
        if key not in self.spines:
            steps, at, rank = [(token, float("inf"))], token, 0
            while self.parts[at] is not None:
                rank = self.rank[self.parts[at]]
                at = self.parts[at][right]
                steps.append((at, rank))
            self.spines[key] = steps[::-1]
        return self.spines[key]

    def separate(self, left: int, right: int) -> bool:
        """Whether no merge ever crosses the border between two tokens."""
        key = (left, right)
        if key not in self.apart:
            if len(self.apart) > 10 * MAX_STATES:
                self.apart.clear()
            self.apart[key] = self._separate(self._spine(left, True), self._spine(right, False))
        return self.apart[key]

    def _separate(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (a, a_rank), (b, b_rank) = left[i], right[j]
            crossing = self.rank.get((a, b), float("inf"))
            # Of equal ranks the leftmost pair merges first: left's own merge, then the crossing one.
            if crossing < a_rank and crossing <= b_rank:
                return False
            if a_rank == b_rank == float("inf"):
                return True
            if a_rank <= b_rank:
                i += 1
            else:
                j += 1

    def reachable(self, token: int) -> bool:
        """Whether the text of ``token`` is tokenized as that one token."""
        if token not in self.whole:
            pair = self.parts[token]
            self.whole[token] = pair is None or (
                self.reachable(pair[0]) and self.reachable(pair[1]) and self._joins(*pair)
            )
        return self.whole[token]

    def _joins(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are left alone until they merge with each other."""
        a, b = self._spine(left, True), self._spine(right, False)
        i = j = 0
        while i < len(a) - 1 or j < len(b) - 1:
            (x, x_rank), (y, y_rank) = a[i], b[j]
            crossing = self.rank.get((x, y), float("inf"))
            if crossing < x_rank and crossing <= y_rank:
                return False
            if x_rank <= y_rank:
                i += 1
            else:
                j += 1
        return True

    # --- states ---

    def _last(self, text: str, history: tuple, table: dict[str, int]) -> tuple[int, int]:
        """The last token of ``text`` (its end), and the tokens it makes more than before its last character."""
        for length in range(len(text), 0, -1):
            token = table.get(text[-length:])
            if token is None or not self.reachable(token):
                continue
            before, count = history[len(text) - length]
            if before < 0 or self.separate(before, token):
                return token, count + 1
        raise AssertionError("every single character is a token")

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after ``byte`` and the tokens it adds."""
        key = state << 8 | byte
        found = self.steps.get(key)
        if found is None:
            suffix, history = self.states[state]
            text = suffix + self.characters[byte]
            token, added = self._last(text, history, self.inner)
            places = (*((t, n - added) for t, n in history), (token, 0))
            keep = next(n for n in range(len(text), -1, -1) if text[len(text) - n :] in self.starts)
            new = (text[len(text) - keep :], places[len(places) - keep - 1 :])
            number = self.number.setdefault(new, len(self.states))
            if number == len(self.states):
                self.states.append(new)
            found = self.steps[key] = (number, added)
        return found

    def end(self, state: int, byte: int) -> int:
        """The tokens that ``byte`` adds as the last one of a word."""
        key = state << 8 | byte
        found = self.ends.get(key)
        if found is None:
            suffix, history = self.states[state]
            table = self.final if self.mark else self.inner
            found = self.ends[key] = self._last(suffix + self.characters[byte], history, table)[1]
        return found

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        total, steps, step = 0, self.steps, self.step
        for byte in data:
            found = steps.get(state << 8 | byte)
            state, added = found if found is not None else step(state, byte)
            total += added
        return state, total

    def count(self, word: bytes, chunk: int = CHUNK) -> int:
        """Tokens of a word."""
        if not word:
            return 0
        if len(self.states) > MAX_STATES:
            self.reset()
        if len(word) <= chunk:
            state, total = self.run(self.START, word[:-1])
        else:
            body = word[:-1]
            maps = [ChunkMap.read(self, body[i : i + chunk]) for i in range(0, len(body), chunk)]
            state, total = scan(maps)[-1](self.START)
        return total + self.end(state, word[-1])


class ChunkMap:
    """What a chunk does to any state before it: (state after it, tokens added)."""

    def __init__(self, apply):
        self.apply = apply
        self.known: dict[int, tuple[int, int]] = {}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            self.known[state] = self.apply(state)
        return self.known[state]

    @classmethod
    def read(cls, transducer: Transducer, data: bytes) -> ChunkMap:
        """The map of ``data``, from one reference run over it."""
        states, sums = [transducer.START], [0]
        for byte in data:
            state, added = transducer.step(states[-1], byte)
            states.append(state)
            sums.append(sums[-1] + added)

        def apply(state: int) -> tuple[int, int]:
            total = 0
            for i, byte in enumerate(data):
                if state == states[i]:  # met the reference run
                    return states[-1], total + sums[-1] - sums[i]
                state, added = transducer.step(state, byte)
                total += added
            return state, total

        return cls(apply)

    def then(self, later: ChunkMap) -> ChunkMap:
        def apply(state: int) -> tuple[int, int]:
            middle, first = self(state)
            last, second = later(middle)
            return last, first + second

        return ChunkMap(apply)


def scan(maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive prefix compositions; each round is independent for all places."""
    found, distance = list(maps), 1
    while distance < len(found):
        found = [
            found[i - distance].then(found[i]) if i >= distance else found[i] for i in range(len(found))
        ]
        distance *= 2
    return found


class Counter:
    """Counts the tokens of texts as a tokenizer file says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, normalizer, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in normalizer["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a BPE file with normalizers NFC, Replace and Lowercase is needed")
        self.transducer = Transducer([tuple(m) for m in model["merges"]], model["end_of_word_suffix"])
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", r"[^\t-\r\x85\p{Z}")
        self.pieces = regex.compile(pattern)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.words: dict[str, int] = {}

    def _blank_separated(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        plain = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if EXOTIC_BLANKS.search(plain):
            return [w for w in SPACE.split(plain) if w]
        return plain.split()

    def _count_word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = sum(self.transducer.count(p.encode()) for p in self.pieces.findall(word))
            if len(word) <= 64:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[word] = found
        return found

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = self.special.split(text)
        total = len(parts) - 1
        known, count = self.words, self._count_word
        for part in parts:
            for word in self._blank_separated(part):
                n = known.get(word)
                total += count(word) if n is None else n
        return total


_COUNTERS: dict[str, Counter] = {}


def _counts(path: str):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in parts:
            found = [counter.count(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    return batches


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = TOKEN_LIMIT,
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of every row. The file must exist on every executor."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_bytes = F.octet_length(text).cast("bigint").alias("n_bytes")
    rows = docs.select(F.col(id_col).alias("id"), n_bytes, text.alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(_counts(tokenizer_path), f"id {id_type}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
