"""License scans by template markup.

A template is plain wording with two kinds of regions: ``[[...]]`` may be left out, and ``{{low-high}}`` stands for low
to high words of any kind (names, years, titles). It is compiled into an automaton over words; a text is accepted from a
word on when its words follow the mandatory wording exactly. Base phrases are templates without regions, so their
places come out of the same automata.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftway.llm.common import lower_words, map_batches

#: Phrases and labels of the base scan.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Template markup by label. Wording of well-known public license notices.
TEMPLATES = (
    ("mit-notice", "[[this {{1-3}} is]] released under the [[terms of the]] mit license"),
    ("mit-notice", "[[this {{1-3}} is]] licensed under the [[terms of the]] mit license"),
    ("mit-grant",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-notice", "[[this {{1-3}} is]] licensed under the apache license [[version 2 0]]"),
    ("apache-header",
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
     "the license"),
    ("gpl-notice", "[[this {{1-3}} is]] licensed under the [[gnu]] general public license [[version {{1-1}}]]"),
    ("gpl-header",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation [[either version {{1-1}} of the license or at your option any "
     "later version]]"),
    ("bsd-conditions",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met"),
    ("isc-grant",
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
     "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-notice", "[[this {{1-3}} is]] licensed under [[the]] cc by [[nc]] [[nd]] [[sa]] [[{{1-2}} license]]"),
    ("reserved", "all rights reserved"),
    ("spdx-tag", "spdx license identifier {{1-3}}"),
)
_MARKUP = re.compile(r"\[\[|\]\]|\{\{(\d+)-(\d+)\}\}|[^\s\[\]{}]+")


@dataclass
class Automaton:
    """States are numbered; ``words`` and ``gaps`` lead on by a given or by any word, ``free`` without one."""

    label: str
    words: list[dict[bytes, int]] = field(default_factory=list)
    gaps: list[int | None] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    mandatory: list[bytes] = field(default_factory=list)

    def _state(self) -> int:
        self.words.append({})
        self.gaps.append(None)
        self.free.append([])
        return len(self.words) - 1

    @classmethod
    def compile(cls, label: str, markup: str) -> Automaton:
        made = cls(label)
        at, opened = made._state(), []
        for token in _MARKUP.finditer(markup):
            text = token.group()
            if text == "[[":
                opened.append(at)
            elif text == "]]":
                made.free[opened.pop()].append(at)
            elif token.group(1):
                low, high = int(token.group(1)), int(token.group(2))
                leave = []
                for k in range(high):
                    if k >= low:
                        leave.append(at)
                    after = made._state()
                    made.gaps[at] = after
                    at = after
                for state in leave:
                    made.free[state].append(at)
            else:
                after = made._state()
                made.words[at][text.encode()] = after
                at = after
                if not opened:
                    made.mandatory.append(text.encode())
        if opened or not made.mandatory:
            raise ValueError(f"template {label}: an optional region is not closed, or no wording is mandatory.")
        made.closed = [made._closure({k}) for k in range(len(made.words))]
        made.starts = {w for k in made.closed[0] for w in made.words[k]}
        made.any_start = any(made.gaps[k] is not None for k in made.closed[0])
        made.final = at
        made.anchor = max(made.mandatory, key=len)
        return made

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for target in self.free[todo.pop()]:
                if target not in states:
                    states.add(target)
                    todo.append(target)
        return frozenset(states)

    def longest(self, words: Sequence[bytes], start: int) -> int:
        """The end of the longest accepted run that begins at ``start``, or -1."""
        now, best = self.closed[0], -1
        for at in range(start, len(words)):
            after: set[int] = set()
            for state in now:
                target = self.words[state].get(words[at])
                if target is not None:
                    after |= self.closed[target]
                if self.gaps[state] is not None:
                    after |= self.closed[self.gaps[state]]
            if not after:
                break
            now = frozenset(after)
            if self.final in now:
                best = at + 1
        return best

    def places(self, words: Sequence[bytes]) -> list[tuple[int, int]]:
        """(start, end) of every place where the template is accepted, overlapping ones too."""
        found = []
        if self.anchor in words:
            for at, word in enumerate(words):
                if (self.any_start or word in self.starts) and (end := self.longest(words, at)) >= 0:
                    found.append((at, end))
        return found


def scan_words(words: list[bytes], base: list[Automaton], templates: list[Automaton]) -> dict:
    """Base places, labels and accepted spans of one text."""
    known = set(words)
    starts, labels, accepted, spans = [], set(), set(), []
    for automaton in base:
        if automaton.anchor in known and (places := automaton.places(words)):
            starts += [start for start, _ in places]
            labels.add(automaton.label)
    for automaton in templates:
        if automaton.anchor in known and (places := automaton.places(words)):
            accepted.add(automaton.label)
            spans += [(automaton.label, start, end) for start, end in places]
    both = labels | accepted
    return {
        "starts": starts, "base_labels": sorted(labels), "labels": sorted(both), "spans": spans,
        "score": len(accepted) / len(both) if both else 0.0,
    }


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string"
)


def scan(docs: DataFrame, base=BASE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and places of the base phrases, labels, score and the accepted spans.

    ``score`` is the share of the labels that rest on a whole template. ``spans`` lists label:first-last (words, last
    included), comma-joined. Null and empty texts have no words: counts 0, places null, labels empty, score 0. Repeated
    rows stay; null ids stay null; other columns are ignored.
    """
    base = [Automaton.compile(label, phrase) for phrase, label in base]
    templates = [Automaton.compile(label, markup) for label, markup in templates]

    def rows(batch):
        out = {name: [] for name in (part.split()[0] for part in SCHEMA.split(", "))}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            words = lower_words(text)
            found = scan_words(words, base, templates)
            out["n_words"].append(len(words))
            out["n_base"].append(len(found["starts"]))
            out["first_word"].append(min(found["starts"], default=None))
            out["last_word"].append(max(found["starts"], default=None))
            out["base_labels"].append(",".join(found["base_labels"]))
            out["labels"].append(",".join(found["labels"]))
            out["score"].append(found["score"])
            out["spans"].append(",".join(f"{label}:{start}-{end - 1}" for label, start, end in found["spans"]))
        return out

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, SCHEMA)
