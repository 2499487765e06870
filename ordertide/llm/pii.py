"""Personal data: fixed patterns, and spans a character-level BiLSTM with CRF transitions adds.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The labeller is trained in numpy on windows
of a bounded sample of documents, labelled with the patterns' spans. Each span is also taken out of its text, written
in another form (other separators, prefixes, brackets, spelled-out ``at`` and ``dot``) and set between words of its
document in new order, so that neither the form nor the sentence can be learnt by heart; numbers that are no personal
data (dates, prices, versions, ranges) are set there as well, unlabelled. It reads overlapping windows around every
digit, ``@``, bracketed ``at`` and the word ``dot``, in any case: a text without any of these is not read. A window is
decoded by Viterbi; of a character's tags the one from the window with most context counts, so a span is the same
wherever windows fall. Added spans that touch a pattern's span, or lack the digits of their kind, are dropped.

Defined results: a null or empty text has no spans. Without any labelled span in the sample nothing is added.
Repeated rows stay. An empty table gives an empty result. Other columns are not read.

Scale: one pass over the texts, no shuffle; whole texts are searched in linear time. The sample has at most
about ``SAMPLE_DOCS`` documents, read once; ``TRAIN_WINDOWS`` of their windows are collected. The model has a few
kilobytes.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.common import stored

KINDS = ("email", "ip", "card", "phone")  # fixed: their order in results
NONE = "none"
SAMPLE_DOCS, TRAIN_WINDOWS = 20_000, 6_000
LENGTH, STRIDE, REACH = 64, 32, 32

# --- patterns ------------------------------------------------------------------------------------

Span = tuple[str, int, int]

# Fixed patterns; where a run can be long they are anchored at its start, which finds the same matches.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")


def digits_of(text: str) -> str:
    return NOT_DIGITS.sub("", text)


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    if not any(hint in text for hint in "0123456789@"):
        return []
    found = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


# --- windows -------------------------------------------------------------------------------------

HINT = re.compile(r"[0-9@]|[(\[{<]\s?at\s?[)\]}>]|(?<![a-z])dot(?![a-z])", re.IGNORECASE)
AT = re.compile(r"@|(?<![a-z])at(?![a-z])", re.IGNORECASE)
DOT = re.compile(r"[.]|(?<![a-z])dot(?![a-z])", re.IGNORECASE)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD, LETTER, DIGIT, BLANK, BREAK, OTHER = range(6)
SYMBOLS = 6 + len(PUNCTUATION) + 26
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k is inside
_CODES = np.full(128, OTHER)
for _c in range(128):
    _s = chr(_c)
    _CODES[_c] = (
        6 + len(PUNCTUATION) + ord(_s.lower()) - ord("a") if _s.isalpha()
        else DIGIT if _s.isdigit() else BREAK if _s in "\n\r" else BLANK if _s.isspace()
        else 6 + PUNCTUATION.index(_s) if _s in PUNCTUATION else OTHER
    )


def encoded(text: str) -> np.ndarray:
    """A number per character: letters by name whatever their case, other scripts as one, digits as one."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], LETTER)


def windows_of(text: str) -> list[int]:
    """Starts of overlapping windows that cover the surroundings of every hint."""
    starts: list[int] = []
    begin = end = -1
    for m in HINT.finditer(text):
        low, high = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if low > end:
            starts += range(begin, max(begin + 1, end - STRIDE), STRIDE) if begin >= 0 else ()
            begin = low
        end = max(end, high)
    return starts + list(range(begin, max(begin + 1, end - STRIDE), STRIDE) if begin >= 0 else ())


def _tags(n: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, start, end in sorted(spans, key=lambda s: s[1] - s[2], reverse=True):  # longest last
        k = KINDS.index(kind)
        tags[start:end] = 2 + 2 * k
        tags[start] = 1 + 2 * k
    return tags


def spans_of(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence; an inside tag without its beginning begins one."""
    kinds = np.where(tags > 0, (tags - 1) // 2, -1)
    begins = (tags > 0) & ((tags % 2 == 1) | (kinds != np.concatenate([[-1], kinds[:-1]])))
    edges = np.flatnonzero(begins | (np.diff(kinds, prepend=-1) != 0)).tolist() + [len(tags)]
    return [(KINDS[kinds[a]], a, b) for a, b in pairwise(edges) if kinds[a] >= 0]


def _padded(codes: np.ndarray, start: int) -> np.ndarray:
    row = np.full(LENGTH, PAD)
    part = codes[start : start + LENGTH]
    row[: len(part)] = part
    return row


# --- the labeller --------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embedding, an LSTM each way, a linear layer, and a CRF over tags."""

    def __init__(self, width: int = 12, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)

        def weights(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        self.hidden = hidden
        self.w = {"embed": rng.normal(0, 0.5, (SYMBOLS, width)), "trans": np.zeros((TAGS, TAGS))}
        for way in ("ahead", "back"):
            self.w |= {f"{way}_x": weights(width, 4 * hidden), f"{way}_h": weights(hidden, 4 * hidden)}
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.w[f"{way}_b"] = bias
        self.w |= {"out": weights(2 * hidden, TAGS), "out_b": np.zeros(TAGS)}

    # Inputs, states and gates are (time, row, unit).

    def _lstm(self, x: np.ndarray, way: str):
        n = self.hidden
        steps, rows, _ = x.shape
        driven = x @ self.w[f"{way}_x"] + self.w[f"{way}_b"]
        h, c = np.zeros((steps + 1, rows, n)), np.zeros((steps + 1, rows, n))
        gates = np.empty((steps, rows, 4 * n))
        for t in range(steps):
            z = driven[t] + h[t] @ self.w[f"{way}_h"]
            gates[t, :, : 3 * n] = _sigmoid(z[:, : 3 * n])
            gates[t, :, 3 * n :] = np.tanh(z[:, 3 * n :])
            i, f, o, g = np.split(gates[t], 4, axis=1)
            c[t + 1] = f * c[t] + i * g
            h[t + 1] = o * np.tanh(c[t + 1])
        return h, c, gates

    def _lstm_slopes(self, x, way, state, dh, slopes):
        n = self.hidden
        h, c, gates = state
        dz = np.empty_like(gates)
        h_next, c_next = np.zeros_like(h[0]), np.zeros_like(c[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g = np.split(gates[t], 4, axis=1)
            bent = np.tanh(c[t + 1])
            d = dh[t] + h_next
            dc = d * o * (1 - bent**2) + c_next
            parts = (dc * g * i * (1 - i), dc * c[t] * f * (1 - f), d * bent * o * (1 - o), dc * i * (1 - g**2))
            dz[t] = np.concatenate(parts, axis=1)
            h_next, c_next = dz[t] @ self.w[f"{way}_h"].T, dc * f
        flat = dz.reshape(-1, 4 * n)
        slopes[f"{way}_x"] = x.reshape(-1, x.shape[2]).T @ flat
        slopes[f"{way}_h"] = h[:-1].reshape(-1, n).T @ flat
        slopes[f"{way}_b"] = flat.sum(axis=0)
        return dz @ self.w[f"{way}_x"].T

    def _forward(self, codes: np.ndarray):
        x = self.w["embed"][codes.T]
        ahead = self._lstm(x, "ahead")
        back = self._lstm(x[::-1], "back")
        both = np.concatenate([ahead[0][1:], back[0][:0:-1]], axis=2)
        return x, ahead, back, both, both @ self.w["out"] + self.w["out_b"]

    def loss(self, codes: np.ndarray, tags: np.ndarray):
        """Mean negative log-likelihood of ``tags`` and its slopes."""
        x, ahead, back, both, emit = self._forward(codes)
        steps, rows, _ = emit.shape
        moves, gold, line = np.exp(self.w["trans"]), tags.T, np.arange(rows)
        top = emit.max(axis=2)
        seen = np.exp(emit - top[:, :, None])
        # Forward and backward sums, scaled to one at each step.
        ahead_sums, back_sums = np.empty_like(seen), np.ones_like(seen)
        scale = np.empty((steps, rows, 1))
        for t in range(steps):
            total = seen[t] if t == 0 else (ahead_sums[t - 1] @ moves) * seen[t]
            scale[t] = total.sum(axis=1, keepdims=True)
            ahead_sums[t] = total / scale[t]
        for t in range(steps - 2, -1, -1):
            back_sums[t] = (seen[t + 1] * back_sums[t + 1]) @ moves.T / scale[t + 1]
        whole = (np.log(scale[:, :, 0]) + top).sum(axis=0)
        score = emit[np.arange(steps)[:, None], line, gold].sum(axis=0)
        score += self.w["trans"][gold[:-1], gold[1:]].sum(axis=0)
        d_emit = ahead_sums * back_sums
        d_emit[np.arange(steps)[:, None], line, gold] -= 1
        later = (seen[1:] * back_sums[1:] / scale[1:]).reshape(-1, TAGS)
        d_trans = moves * (ahead_sums[:-1].reshape(-1, TAGS).T @ later)
        d_trans -= np.bincount((gold[:-1] * TAGS + gold[1:]).ravel(), minlength=TAGS**2).reshape(TAGS, TAGS)
        d_emit /= rows
        slopes = {"trans": d_trans / rows, "out_b": d_emit.sum(axis=(0, 1))}
        slopes["out"] = both.reshape(-1, both.shape[2]).T @ d_emit.reshape(-1, TAGS)
        d_both = d_emit @ self.w["out"].T
        n = self.hidden
        dx = self._lstm_slopes(x, "ahead", ahead, d_both[:, :, :n], slopes)
        dx = dx + self._lstm_slopes(x[::-1], "back", back, d_both[::-1, :, n:], slopes)[::-1]
        chosen = np.eye(SYMBOLS)[codes.T.ravel()]
        slopes["embed"] = chosen.T @ dx.reshape(len(chosen), -1)
        return (whole - score).mean(), slopes

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 0.015):
        """Adam over shuffled batches, with steps that shrink to none."""
        rng = np.random.default_rng(11)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, steps = 0, epochs * -(-len(codes) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for low in range(0, len(order), batch):
                at = order[low : low + batch]
                _, slopes = self.loss(codes[at], tags[at])
                step += 1
                pace = rate * (1 - step / (steps + 1))
                for k, slope in slopes.items():
                    slope = np.clip(slope, -5, 5)
                    first[k] = 0.9 * first[k] + 0.1 * slope
                    second[k] = 0.999 * second[k] + 0.001 * slope**2
                    scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                    self.w[k] -= pace * first[k] / (1 - 0.9**step) / scale
        return self

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tags of each window."""
        emit = self._forward(codes)[-1]
        steps, rows, _ = emit.shape
        back = np.empty((steps, rows, TAGS), np.int64)
        score = emit[0]
        for t in range(1, steps):
            options = score[:, :, None] + self.w["trans"]
            back[t] = options.argmax(axis=1)
            score = options.max(axis=1) + emit[t]
        tags = np.empty((rows, steps), np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[t, np.arange(rows), tags[:, t]]
        return tags


def reconciled(n: int, starts: list[int], tags: np.ndarray) -> list[Span]:
    """Spans of a text of ``n`` characters from its windows' tags."""
    found: list[Span] = []
    groups: list[list[int]] = []
    for i, start in enumerate(starts):
        if groups and start < starts[groups[-1][-1]] + LENGTH:
            groups[-1].append(i)
        else:
            groups.append([i])
    for group in groups:
        low, high = starts[group[0]], min(n, starts[group[-1]] + LENGTH)
        best = np.zeros(high - low, np.int64)
        context = np.full(high - low, -1)
        for i in group:
            end = min(n, starts[i] + LENGTH)
            at = np.arange(end - starts[i])
            # A border of the text is no lack of context.
            before = at if starts[i] else np.full(len(at), LENGTH)
            after = at[::-1] if end < n else np.full(len(at), LENGTH)
            mine = np.minimum(before, after)
            part = slice(starts[i] - low, end - low)
            closer = mine > context[part]
            best[part] = np.where(closer, tags[i][: len(at)], best[part])
            context[part] = np.maximum(context[part], mine)
        found += [(kind, a + low, b + low) for kind, a, b in spans_of(best)]
    return found


def _plausible(kind: str, text: str) -> bool:
    n = len(digits_of(text))
    if kind == "email":
        return AT.search(text) is not None and DOT.search(text) is not None and len(text) >= 6
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 16 <= n <= 19 and luhn(digits_of(text)) if kind == "card" else 8 <= n <= 15


def all_spans(texts: list[str], model: Labeller | None, batch: int = 256) -> list[tuple[list[Span], list[Span]]]:
    """For every text its pattern spans, and all spans, both by kind and start."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    starts = [windows_of(t) for t in texts]
    rows = ((i, s) for i, found in enumerate(starts) for s in found)
    decoded: list[list[np.ndarray]] = [[] for _ in texts]
    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        for (i, _), tags in zip(pending, model.decode(np.stack([c for _, c in pending])), strict=True):
            decoded[i].append(tags)
        pending.clear()

    last, codes = -1, np.empty(0)
    for i, start in rows:
        if i != last:
            last, codes = i, encoded(texts[i])
        pending.append((i, _padded(codes, start)))
        if len(pending) == batch:
            flush()
    if pending:
        flush()
    result = []
    for text, known, at, tags in zip(texts, base, starts, decoded, strict=True):
        taken = sorted((a, b) for _, a, b in known)
        added = []
        for kind, a, b in reconciled(len(text), at, tags) if at else ():
            while a < b and text[a].isspace():
                a += 1
            while a < b and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
                b -= 1
            free = all(b <= x or a >= y for x, y in taken)
            if free and _plausible(kind, text[a:b]):
                added.append((kind, a, b))
        every = sorted(known + added, key=lambda s: (KINDS.index(s[0]), s[1]))
        result.append((known, every))
    return result


# --- training ------------------------------------------------------------------------------------


# Forms that training draws from; many others are combinations of these.
ATS = ("(at)", "[at]", " (at) ", " [at] ", "(AT)", " [AT] ", "{at}", "<at>", " at ", " AT ")
DOTS = (".", ".", " . ", "(dot)", " [dot] ")
SPELLED = (" dot ", " DOT ", " (dot) ")
BETWEEN = {
    "ip": (" . ", ". ", " .", "[.]", "(.)", "{.}", " dot "),
    "card": (".", "/", "_", "  ", " - ", ":", " : "),
    "phone": (" ", "-", ".", "/", ""),
}
TOP_LEVEL = ("com", "org", "net", "de", "fr", "es", "info", "io")
PREFIXES = ("", "0", "00", "(0", "+")
NUMBERS = (
    "##/##/20##", "20##-##-##", "##.##.20##", "##/##/20## ##:##", "20##-##-## ##:##:##", "##:##", "#.#.#",
    "#,###.##", "##-##", "#### ####", "No. ######", "#.##", "(##)", "20##", "v#.#.##", "at the dot",
    "dot by dot", "the dot at",
)


def _address(text: str, words: list[str], rng: random.Random) -> list[str]:
    """The two sides of an address, or two like them made of a document's words."""
    plain = [w.lower() for w in rng.choices(words, k=4) if w.isascii() and w.isalpha()] if words else []
    if len(plain) < 3 or rng.random() < 0.1:
        return text.split("@", 1)
    joined = f"{plain[0]}{rng.choice('._-')}{plain[1]}"
    local = rng.choice((plain[0], joined, f"{plain[0][:1]}.{plain[1]}", f"{plain[0]}{rng.randrange(100)}"))
    host = rng.choice((plain[2], f"{plain[2]}-{plain[1]}", f"{plain[0]}.{plain[2]}"))
    return [local, f"{host}.{rng.choice(TOP_LEVEL)}"]


def rewritten(kind: str, text: str, words: list[str], rng: random.Random) -> str:
    """A span's text in another form."""
    if kind == "email":
        local, domain = _address(text, words, rng)
        at = rng.choice(ATS)
        return f"{local}{at}{domain.replace('.', rng.choice(SPELLED if at.strip().lower() == 'at' else DOTS))}"
    if kind == "ip":
        return rng.choice(BETWEEN["ip"]).join(str(rng.randrange(rng.choice((10, 100, 256)))) for _ in range(4))
    digits, pieces = digits_of(text), []
    joint = rng.choice(BETWEEN[kind])
    if kind == "card":
        return joint.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    digits = "".join(str(rng.randrange(10)) for _ in range(rng.randint(7, 12)))
    while digits:
        cut = min(len(digits), rng.choice((2, 3, 3, 4, 5, 8)))
        cut = len(digits) if len(digits) - cut == 1 else cut
        pieces.append(digits[:cut])
        digits = digits[cut:]
    prefix = rng.choice(PREFIXES)
    if prefix in ("00", "+") and rng.random() < 0.7:  # a country's code by itself
        pieces.insert(0, f"{rng.randrange(10, 99)}")
    first = f"{prefix}{pieces[0]}" + (")" if prefix.startswith("(") else "")
    if prefix == "00" and rng.random() < 0.2:
        first = f"00 {pieces[0]}"
    return joint.join([first, *pieces[1:]])


def resettled(kind: str | None, text: str, words: list[str], rng: random.Random) -> tuple[str, list[Span]]:
    """``text`` between some of ``words`` in new order, as a text of its own with its span (none without a kind)."""
    before = " ".join(rng.choices(words, k=rng.randint(0, 7))) if words else ""
    after = " ".join(rng.choices(words, k=rng.randint(0, 7))) if words else ""
    start = f"{before}{rng.choice((' ', ': ', ' (', chr(10)))}" if before else ""
    end = f"{rng.choice((' ', '. ', ', ', ') ', chr(10)))}{after}" if after else rng.choice(("", "."))
    spans = [(kind, len(start), len(start) + len(text))] if kind else []
    return f"{start}{text}{end}", spans


def training_texts(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """A text as it is, and its spans and as many numbers of no interest in other forms and surroundings."""
    yield text, spans
    rng = random.Random(zlib.crc32(text.encode()))
    words = [w for w in text.split() if not HINT.search(w)]
    for kind, start, end in spans:
        for form in (text[start:end], *(rewritten(kind, text[start:end], words, rng) for _ in range(6))):
            yield resettled(kind, form, words, rng)
    for _ in range(1 + 2 * len(spans)):
        number = re.sub("#", lambda _: str(rng.randrange(10)), rng.choice(NUMBERS))
        yield resettled(None, number, words, rng)


def training_windows(text: str) -> list[tuple[list[int], list[int], str]]:
    """(codes, tags, kind of the first span or NONE) of the windows of all texts that training makes of one."""
    found = []
    for version, spans in training_texts(text, base_spans(text)):
        codes, tags = encoded(version), _tags(len(version), spans)
        for start in windows_of(version):
            part = np.zeros(LENGTH, np.int64)
            piece = tags[start : start + LENGTH]
            part[: len(piece)] = piece
            first = part[part > 0][:1]
            kind = KINDS[(first[0] - 1) // 2] if len(first) else NONE
            found.append((_padded(codes, start).tolist(), part.tolist(), kind))
    return found


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = pa.list_(pa.int64())
    schema = pa.schema([("order", pa.int64()), ("kind", pa.string()), ("codes", numbers), ("tags", numbers)])
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            for i, (codes, tags, kind) in enumerate(training_windows(text or "")):
                name = hashlib.blake2b(f"{i}:{codes}".encode(), digest_size=7).digest()
                rows.append({"order": int.from_bytes(name, "big"), "kind": kind, "codes": codes, "tags": tags})
        yield pa.RecordBatch.from_pylist(rows, schema)


def train(docs: DataFrame, text_col: str, sample_docs: int, windows: int) -> Labeller | None:
    """A labeller from a bounded sample of ``docs``; None if the sample has no span."""
    hinted = docs.select(F.col(text_col).alias("text")).filter(F.col("text").rlike(r"[0-9@]"))
    keep = min(1.0, sample_docs / max(hinted.count(), 1))
    sample = hinted.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(keep * 1_000_000))
    rows = sample.mapInArrow(
        _training_rows, "order bigint, kind string, codes array<bigint>, tags array<bigint>"
    )
    rows = stored(rows, "personal-data-windows").dropDuplicates(["order"])  # all shares are read from there
    chosen = []
    for kind in (*KINDS, NONE):  # half without a span, the rest in equal parts, random by the order
        share = windows // 2 if kind == NONE else windows // (2 * len(KINDS))
        chosen += rows.filter(F.col("kind") == kind).orderBy("order").limit(share).collect()
    if all(r.kind == NONE for r in chosen):
        return None
    return Labeller().fit(np.array([r.codes for r in chosen]), np.array([r.tags for r in chosen]))


# --- Spark ---------------------------------------------------------------------------------------


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _detect(model: Labeller | None):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = all_spans(texts, model)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS]
            digests = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            columns = [batch.column("id"), *(pa.array(c, pa.int64()) for c in counts)]
            columns += [pa.array(digests, pa.string()), pa.array([written(s) for _, s in found], pa.string())]
            names = ["id", *(f"n_{kind}" for kind in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return batches


def find_personal_data(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_docs: int = SAMPLE_DOCS,
    windows: int = TRAIN_WINDOWS,
) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; counts are the patterns'."""
    model = train(docs, text_col, sample_docs, windows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{kind} bigint" for kind in KINDS)
    found = rows.mapInArrow(_detect(model), f"id {id_type}, {counts}, base_sha256 string, spans string")
    return found.withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the whole stretch by the first's."""
    pieces, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            pieces += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def _mask(model: Labeller | None, text_at: int, length_at: int | None):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = batch.column(text_at).to_pylist()
            found = all_spans([t or "" for t in texts], model)
            clean = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(clean, columns[text_at].type)
            if length_at is not None:
                lengths = pa.array([None if t is None else len(t) for t in clean], pa.int64())
                columns[length_at] = lengths.cast(columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return batches


def mask_personal_data(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = TRAIN_WINDOWS
) -> DataFrame:
    """All rows of ``docs`` (text and any other columns) with personal data masked; ``n_chars`` follows."""
    model = train(docs, "text", sample_docs, windows)
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_mask(model, docs.columns.index("text"), length_at), docs.schema)
