"""License scans by template markup.

A template is license wording with two kinds of marked regions: ``<<optional>> ... <<end>>`` may be left out,
``<<any:N>>`` stands for up to N words of any kind (names, years, the wording of an addressee). Everything else is
mandatory. Templates and texts are compared as words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased, so
layout, case and punctuation do not matter and the mandatory wording must match exactly.

Each template is compiled to an automaton over words, made deterministic state by state as texts need it: a state
is the set of places of the template that the words read so far may have led to, and all words that no such
place names share one arc. A place in a text matches if the automaton accepts some run of words that begins there;
the longest one is its end. Phrases are counted as they are, wherever their words stand consecutively.

The labels of a document are those of its phrases and of the templates it matches. Its score says how sure the
finding is: 1 if a template's mandatory wording is there, 0.5 if only a phrase is, else 0.

Defined results: null and empty texts have no words, places or labels, and score 0. Repeated rows keep one row each.
An empty table gives an empty result. Other columns are not read.

Scale: one Python pass in Arrow batches, whole texts, without a shuffle; what is shipped to the workers is the
templates' wording. A text is searched for each template's longest mandatory run of words first, and only where
that occurs do automata run, from the words that templates may begin with; a start reads at most as many words as
its template has, its open regions at their widest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordertide.llm.wordhash import ALPHANUMERIC

# --- fixed values: phrases and labels, then the wording of public licenses and notices --------------
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
TEMPLATES = (
    ("apache-2.0", """
        licensed under the Apache License <<optional>> , <<end>> Version 2.0
        <<optional>> (the "License"); you may not use this file except in compliance with the License <<end>>"""),
    ("cc-by-nc-4.0", """
        licensed under <<optional>> a <<end>> <<optional>> Creative Commons <<end>> <<optional>> the <<end>>
        CC BY-NC 4.0 <<optional>> International License <<end>>"""),
    ("cc-by-nc-4.0", """
        licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons
        Attribution-NonCommercial 4.0 <<optional>> International <<end>> <<optional>> License <<end>>"""),
    ("cc-by-4.0", """
        licensed under <<optional>> a <<end>> <<optional>> Creative Commons <<end>> <<optional>> the <<end>>
        CC BY 4.0 <<optional>> International License <<end>>"""),
    ("cc-by-4.0", """
        licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons
        Attribution 4.0 <<optional>> International <<end>> <<optional>> License <<end>>"""),
    ("cc-by-sa-4.0", """
        licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons
        Attribution-ShareAlike 4.0 <<optional>> International <<end>> <<optional>> License <<end>>"""),
    ("gpl-3.0", """
        licensed under the GNU General Public License
        <<optional>> as published by the Free Software Foundation <<end>> , version 3
        <<optional>> or <<optional>> (at your option) <<end>> any later version <<end>>"""),
    ("gpl-3.0", """
        <<optional>> This program <<end>> is free software: you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
        the License, or (at your option) any later version."""),
    ("gpl-2.0", """
        <<optional>> This program <<end>> is free software; you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of
        the License, or (at your option) any later version."""),
    ("mpl-2.0", """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
        <<optional>> If a copy of the MPL was not distributed with this file, You can obtain one at
        <<any:8>> <<end>>"""),
    ("mit", """
        <<optional>> is <<end>> released under the <<optional>> terms of the <<end>> MIT License"""),
    ("mit", """
        Permission is hereby granted, free of charge, to any person obtaining a copy of <<any:8>> and associated
        documentation files (the <<any:3>>), to deal in the <<any:3>> without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
        the <<any:3>>, and to permit persons to whom the <<any:3>> is furnished to do so, subject to the following
        conditions:
        The above copyright notice and this permission notice
        <<optional>> (including the next paragraph) <<end>> shall be included in all copies or substantial portions
        of the <<any:3>>."""),
    ("isc", """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies."""),
    ("bsd-2-clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:
        <<any:1>> Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer.
        <<any:1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the
        distribution."""),
    ("bsd-3-clause", """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met:
        <<any:1>> Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer.
        <<any:1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<any:1>> Neither the name of <<any:12>> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission."""),
    ("unlicense", """
        This is free and unencumbered software released into the public domain."""),
    ("spdx-tag", """
        SPDX-License-Identifier: <<any:1>>"""),
)
# --- end of fixed values --------------------------------------------------------------------------

PLACE = "struct<kind: string, label: string, start: bigint, end: bigint>"
_PLACES = pa.list_(
    pa.struct([("kind", pa.string()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
)
_MARK = re.compile(r"<<(optional|end|any:\d+)>>")
OTHER = None  # stands for every word that a state does not name


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(ALPHANUMERIC).split()


class Template:
    """The automaton of one template.

    Its places are numbered: ``steps`` has the word (or OTHER for any) that leads from a place to the next, and
    ``skips`` the places reachable without reading. A template without mandatory words, or with regions that do
    not close, is refused.
    """

    def __init__(self, label: str, wording: str):
        self.label = label
        self.steps: list[bytes | None] = []
        self.skips: dict[int, list[int]] = {}
        opened: list[int] = []
        runs: list[list[bytes]] = [[]]
        for i, part in enumerate(_MARK.split(wording)):
            if i % 2 == 0:
                for word in words_of(part):
                    self.steps.append(word)
                    if not opened:
                        runs[-1].append(word)
                continue
            runs.append([])
            if part == "optional":
                opened.append(len(self.steps))
            elif part == "end":
                if not opened:
                    raise ValueError(f"Template {label}: a region ends that was not opened")
                self.skips.setdefault(opened.pop(), []).append(len(self.steps))
            else:
                first, width = len(self.steps), int(part.removeprefix("any:"))
                self.steps += [OTHER] * width
                for place in range(first, first + width):
                    self.skips.setdefault(place, []).append(first + width)
        self.needle = b" ".join(max(runs, key=lambda run: sum(map(len, run))))
        if opened or not self.needle:
            raise ValueError(f"Template {label}: an open region, or no mandatory word")
        self.places: list[frozenset[int]] = []
        self.accepts: list[bool] = []
        self.arcs: list[dict[bytes | None, int]] = []
        self._numbers: dict[frozenset[int], int] = {}
        self.initial = self._state({0})
        self.begins = {self.steps[p] for p in self.places[self.initial] if p < len(self.steps)}

    def _state(self, places: set[int]) -> int:
        """The number of the state of these places and all that can be reached from them without reading."""
        waiting, reached = list(places), set(places)
        while waiting:
            for skip in self.skips.get(waiting.pop(), ()):
                if skip not in reached:
                    reached.add(skip)
                    waiting.append(skip)
        state = frozenset(reached)
        if state not in self._numbers:
            self._numbers[state] = len(self.places)
            self.places.append(state)
            self.accepts.append(len(self.steps) in state)
            self.arcs.append({})
        return self._numbers[state]

    def _next(self, state: int, word: bytes) -> int:
        """The state after ``word``, -1 if there is none; arcs are made when they are first taken."""
        live = [p for p in self.places[state] if p < len(self.steps)]
        named = word if any(self.steps[p] == word for p in live) else OTHER
        arcs = self.arcs[state]
        if named not in arcs:
            after = {p + 1 for p in live if self.steps[p] in (named, OTHER)}
            arcs[named] = self._state(after) if after else -1
        return arcs[named]

    def end(self, words: Sequence[bytes], start: int) -> int:
        """Where the longest accepted run of words from ``start`` ends, -1 if there is none."""
        state, found = self.initial, -1
        for at in range(start, len(words)):
            following = self.arcs[state].get(words[at], OTHER)
            state = self._next(state, words[at]) if following is OTHER else following
            if state < 0:
                return found
            if self.accepts[state]:
                found = at + 1
        return found

    def matches(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """(start, end) of all places from left to right, none inside the one before."""
        found: list[tuple[int, int]] = []
        upto = 0
        for start, word in enumerate(words):
            if start >= upto and (word in self.begins or OTHER in self.begins):
                end = self.end(words, start)
                if end > start:
                    found.append((start, end))
                    upto = end
        return found


@lru_cache(maxsize=4)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[Template]:
    return [Template(label, wording) for label, wording in templates]


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words where ``phrase`` begins; ``joined`` has a blank before and after every word."""
    wanted, found = b" " + phrase + b" ", []
    at, seen, word = joined.find(wanted), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        found.append(word)
        seen, at = at, joined.find(wanted, at + 1)
    return found


def scan_words(
    words: Sequence[bytes], phrases: Sequence[tuple[bytes, str]], templates: Sequence[Template]
) -> list[dict]:
    joined = b" " + b" ".join(words) + b" "
    found = [
        {"kind": "phrase", "label": label, "start": start, "end": start + phrase.count(b" ") + 1}
        for phrase, label in phrases
        for start in phrase_places(joined, phrase)
    ]
    for template in templates:
        if b" " + template.needle + b" " in joined:
            found += [
                {"kind": "template", "label": template.label, "start": start, "end": end}
                for start, end in template.matches(words)
            ]
    return found


def _scan(phrases: tuple[tuple[str, str], ...], templates: tuple[tuple[str, str], ...]):
    """Arrow function: id and text to id, number of words and the places found."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        wanted = [(b" ".join(words_of(phrase)), label) for phrase, label in phrases]
        for batch in parts:
            counts, places = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                counts.append(len(words))
                places.append(scan_words(words, wanted, automata))
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, _PLACES)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "places"])

    return batches


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """One row per document: doc_id, n_words, places (of phrases and templates), labels (sorted) and score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    compiled(tuple(templates))  # refuses a broken template before any task starts
    scanned = rows.mapInArrow(
        _scan(tuple(phrases), tuple(templates)), f"doc_id {id_type}, n_words bigint, places array<{PLACE}>"
    )
    whole = F.exists("places", lambda p: p.kind == "template")
    score = F.when(whole, 1.0).when(F.size("places") > 0, 0.5).otherwise(0.0)
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p.label)))
    return scanned.select("doc_id", "n_words", "places", labels.alias("labels"), score.alias("score"))
