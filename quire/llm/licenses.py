"""License scanning by templates with markup, compiled to one token automaton.

A template is wording with two kinds of regions: `[ ... ]` may be missing, `<a..b>` stands for any a to b words. All
other words are mandatory and must match exactly, in order. All templates are compiled into one automaton over
words, made deterministic as its states are met (their number is bounded by the templates, not by the texts). It is
started at every word that can begin a template; the longest match of each label from there counts.

Words: A-Z in lower case, then runs of ASCII letters and digits and of all characters beyond ASCII.

Defined results: a null or empty text has no words, no labels and score 0. Rows are handled one by one, so ties and
repeated rows change nothing; other columns are kept, whatever their names; columns of the output's names are replaced.
An empty table gives no rows. Bytes that aren't UTF-8 count as U+FFFD, which is part of a word. A text's words are held
at once: memory grows with the longest text, by about 15 bytes for each of its bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import ASCII_LOWER
from quire.llm.frames import released, replace_column, slices, texts

#: The words of a text whose A-Z are in lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Plain phrases: any place counts.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Common notices in the markup above.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [ version 2 [ 0 ] ]"),
    ("apache-2.0", "licensed to the <1..6> under one or more contributor license agreements"),
    ("mit", "[ released | licensed | distributed ] under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "[ released | licensed ] under the <0..3> bsd license"),
    ("gpl", "licensed under the [ terms of the ] gnu [ lesser | affero ] general public license [ as published by the free software foundation ] [ either ] [ version <1..1> ]"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu <0..1> general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license [ v 2 0 ]"),
    ("cc", "licensed under [ a | the ] cc by [ nc ] [ sa | nd ] [ <1..1> 0 ] [ international ] [ license ]"),
    ("cc", "licensed under [ a | the ] creative commons <1..6> license"),
    ("cc0", "dedicated to the public domain under [ the ] cc0 [ 1 0 ]"),
    ("reserved", "copyright [ c ] <1..8> all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
_ANY = "*"


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    label: str
    phrase: bool


class Automaton:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.moves: list[dict[str, set[int]]] = []
        self.free: list[set[int]] = []
        self.accept: dict[int, tuple[str, bool]] = {}
        start = self._state()
        for label, text in phrases:
            self.accept[self._add(text.split(), start)] = (label, True)
        for label, text in templates:
            self.accept[self._add(text.split(), start)] = (label, False)
        self.alphabet = {w for m in self.moves for w in m} - {_ANY}
        self.start = self._closed({start})
        self.next: dict[tuple[frozenset[int], str], frozenset[int]] = {}
        self.labels: dict[frozenset[int], tuple[tuple[str, bool], ...]] = {}
        self.first = {w for s in self.start for w in self.moves[s]}
        if _ANY in self.first:
            raise ValueError("a template must begin with wording")

    def _state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def _add(self, tokens: list[str], start: int) -> int:
        """The state after the tokens; [ a | b ] is either or nothing."""
        at, opened = self._state(), []
        self.free[start].add(at)
        for t in tokens:
            if t == "[":
                end = self._state()
                self.free[at].add(end)
                opened.append((at, end))
            elif t == "|":
                begin, end = opened[-1]
                self.free[at].add(end)
                at = self._state()
                self.free[begin].add(at)
            elif t == "]":
                _, end = opened.pop()
                self.free[at].add(end)
                at = end
            elif m := re.fullmatch(r"<(\d+)\.\.(\d+)>", t):
                low, high = int(m[1]), int(m[2])
                end = self._state()
                for k in range(high + 1):
                    if k >= low:
                        self.free[at].add(end)
                    if k < high:
                        new = self._state()
                        self.moves[at].setdefault(_ANY, set()).add(new)
                        at = new
                at = end
            else:
                new = self._state()
                self.moves[at].setdefault(t, set()).add(new)
                at = new
        if opened:
            raise ValueError(f"unclosed [ in {tokens}")
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return frozenset(seen)

    def _step(self, state: frozenset[int], word: str) -> frozenset[int]:
        key = (state, word if word in self.alphabet else _ANY)
        if key not in self.next:
            self.next[key] = self._closed({x for s in state for w in {key[1], _ANY} for x in self.moves[s].get(w, ())})
            self.labels[self.next[key]] = tuple(sorted({self.accept[s] for s in self.next[key] if s in self.accept}))
        return self.next[key]

    def matches(self, words: list[str]) -> list[Match]:
        """The longest match of each label from each start."""
        out, first, n = [], self.first, len(words)
        for i in [i for i, w in enumerate(words) if w in first]:
            state, best, k = self.start, {}, i
            while k < n and (state := self._step(state, words[k])):
                k += 1
                for label in self.labels[state]:
                    best[label] = k
            out += [Match(i, end, label, phrase) for (label, phrase), end in best.items()]
        return out


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton()


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(ASCII_LOWER))


def score(matches: list[Match]) -> float:
    """From 0 for none towards 1 the more words the longest match has."""
    longest = max((m.end - m.start for m in matches), default=0)
    return longest / (longest + 2)


MATCHES = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("phrase", T.BooleanType())])
)
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("phrase", pa.bool_())]))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns, the number of words (license_words), the matches (license_matches) and their score (license_score)."""

    def run(batches):
        own = automaton()
        for b in batches:
            for s in slices(b, text):
                n, found, scores = [], [], []
                for t in texts(s.column(text)):
                    words = words_of(t)
                    matches = own.matches(words)
                    n.append(len(words))
                    found.append([vars(m) for m in matches])
                    scores.append(score(matches))
                s = replace_column(s, "license_words", pa.array(n, pa.int64()))
                s = replace_column(s, "license_matches", pa.array(found, _ARROW))
                yield replace_column(s, "license_score", pa.array(scores, pa.float64()))

    new = [T.StructField("license_words", T.LongType()), T.StructField("license_matches", MATCHES), T.StructField("license_score", T.DoubleType())]
    return df.mapInArrow(lambda b: released(run(b)), T.StructType([*(f for f in df.schema.fields if f.name not in {x.name for x in new}), *new]))
