"""Licence scans by a generalised suffix automaton of licence templates.

The automaton holds every run of words of every template. A text is streamed through it once: after each word it stands in the
state of the longest run that ends there and occurs in some template (the matching statistics). A run that the next word does
not carry on is a match; matches of SHORTEST words and more are anchors at each place where their state ends in a template.
Anchors of one template are chained in the order of both text and template, with at most GAP words between two on either side,
so reflowed, shortened and edited licences are found; a chain that covers enough of its template is a span and gives its label.
Phrases are templates that count only whole: each place where one ends is told by the state or one that its suffix links reach.

A text is read in blocks, and of a template only chains that can still grow are held, so memory does not grow with the text.
There is no shuffle: each task scans its own rows.

Cases: a null text counts as empty (no words, score 0); null and repeated ids and repeated rows are scanned each; an empty table
gives no rows; texts of any length are read whole. Of chains that an anchor could carry on, the one that covers most does, then
the earlier one; equal labels are told once. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A label and its words. whole: a phrase, which counts at each place where all its words stand and nowhere else."""

    label: str
    text: str
    whole: bool = False


# Phrases and labels, and the wording of public licences.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("mit", "released under the mit license"),
    Template("mit", "licensed under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    Template("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
)

#: Words of an anchor, words between two anchors of a chain, and the share of a template that a span covers.
SHORTEST, GAP, LEAST = 3, 8, 0.6
#: Bytes of text that are cut into words at a time.
BLOCK = 1 << 20

#: Words of a text in UTF-8, the letters A-Z in lower case: all bytes from 0x80 on are parts of characters beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about BLOCK bytes; a block ends where a word does."""
    at = 0
    while at < len(raw):
        found = _BREAK.search(raw, at + BLOCK)
        end = found.start() if found else len(raw)
        yield WORD.findall(raw[at:end].lower())
        at = end


@dataclass(order=True)
class Chain:
    """Anchors of one template in a row: words covered so far, and where the chain begins and ends in text and template (ends exclusive)."""

    covered: int
    start: int
    end: int
    at: int


@dataclass
class Found:
    """What a text holds: words, places of whole phrases (how many, first and last start), labels of both kinds, spans and the score."""

    n_words: int = 0
    n_base: int = 0
    first: int | None = None
    last: int | None = None
    base: set[str] = field(default_factory=set)
    labels: set[str] = field(default_factory=set)
    spans: list[tuple[str, int, int, float]] = field(default_factory=list)
    score: float = 0.0


class Automaton:
    """Suffix automaton of several templates. State 0 is the empty run."""

    def __init__(self, templates: tuple[Template, ...] = TEMPLATES):
        self.templates = templates
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        cut = [[w for part in words(t.text.encode()) for w in part] for t in templates]
        self.sizes = [len(x) for x in cut]
        runs = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own] for own in cut]
        for run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)
        # Where a state's runs end: each prefix of a template, handed up the suffix links.
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.phrases: list[list[int]] = [[] for _ in self.next]
        for t, run in enumerate(runs):
            v, at = 0, 0
            for c in run:
                v, at = self.next[v][c], at + 1
                u = v
                while u > 0 and not templates[t].whole:
                    self.ends[u].append((t, at))
                    u = self.link[u]
            if templates[t].whole and v:
                self.phrases[v].append(t)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrases[v] += self.phrases[self.link[v]]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of the runs of q no longer than p's and one word more."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        """The state of the run of `last` and the word c, with all runs that end it."""
        if (q := self.next[last].get(c)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        own, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = own
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[own] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return own

    def scan(self, raw: bytes) -> Found:
        """One pass over a text."""
        out, open_chains = Found(), {}
        after, link, length, known, phrases = self.next, self.link, self.length, self.vocabulary, self.phrases
        v = run = i = 0  # state, words of the run that ends before word i
        for block in words(raw):
            for w in block:
                c = known.get(w)
                if c is None:
                    if run >= SHORTEST:
                        self._anchor(open_chains, out, v, run, i)
                    v = run = 0
                elif (to := after[v].get(c)) is not None:
                    v, run = to, run + 1
                else:
                    if run >= SHORTEST:
                        self._anchor(open_chains, out, v, run, i)
                    while v and c not in after[v]:
                        v = link[v]
                    run = length[v]
                    if c in after[v]:
                        v, run = after[v][c], run + 1
                i += 1
                for t in phrases[v]:
                    if run >= self.sizes[t]:
                        start = i - self.sizes[t]
                        out.n_base += 1
                        out.first = start if out.first is None else min(out.first, start)
                        out.last = start if out.last is None else max(out.last, start)
                        out.base.add(self.templates[t].label)
                        out.score = 1.0
        if run >= SHORTEST:
            self._anchor(open_chains, out, v, run, i)
        for t, chains in open_chains.items():
            for chain in chains:
                self._close(out, t, chain)
        out.n_words, out.labels = i, out.labels | out.base
        return out

    def _anchor(self, open_chains: dict[int, list[Chain]], out: Found, v: int, run: int, end: int) -> None:
        """A match of `run` words that ends before word `end` joins the chains of its templates."""
        start = end - run
        for t, at in self.ends[v]:
            begin, alive, best = at - run, [], None
            for chain in open_chains.get(t, ()):
                if chain.end + GAP < start:
                    self._close(out, t, chain)
                    continue
                alive.append(chain)
                # Matches of one text may overlap by the words that both hold.
                if chain.start < start and chain.at < at and chain.end < end and begin - GAP <= chain.at and (best is None or (chain.covered, -chain.start) > (best.covered, -best.start)):
                    best = chain
            if best is None:
                alive.append(Chain(run, start, end, at))
            else:
                alive.remove(best)
                alive.append(Chain(best.covered + min(run, end - best.end, at - best.at), best.start, end, at))
            open_chains[t] = alive

    def _close(self, out: Found, t: int, chain: Chain) -> None:
        share = chain.covered / self.sizes[t]
        if share >= LEAST:
            out.spans.append((self.templates[t].label, chain.start, chain.end, share))
            out.labels.add(self.templates[t].label)
            out.score = max(out.score, share)


SCHEMA = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, share: double>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs: doc_id, text. Per document: its words, places of whole phrases, labels, the highest share of a template that is covered, and spans of words."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [automaton.value.scan(x.as_py() or b"") for x in batch.column("text")]
            join = lambda own: pa.array([",".join(sorted(x)) for x in own], pa.string())
            number = lambda own: pa.array(list(own), pa.int64())
            spans = [[{"label": a, "start": s, "end": e, "share": p} for a, s, e, p in sorted(f.spans, key=lambda x: x[1:3])] for f in found]
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
            columns = [number(f.n_words for f in found), number(f.n_base for f in found), number(f.first for f in found), number(f.last for f in found), join(f.base for f in found), join(f.labels for f in found), pa.array([f.score for f in found], pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(run, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))
