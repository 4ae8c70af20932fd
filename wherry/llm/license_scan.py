"""License scans: an exact set-similarity (containment) join of text blocks with templates."""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, texts_of

#: Words of the contract, its phrases and their labels.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices as their licenses or common practice word them.
TEMPLATES = (
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0."),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-program", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit-notice", "Released under the MIT License."),
)
#: Share of a template's distinct words that a block (a line, or a window of the template's size
#: over line ends) must hold; templates of seven words that differ in one are told apart.
THRESHOLD = 0.9

OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: WORDS for text whose A-Z are not yet lower-cased.
_ANY = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LINE_WORDS = re.compile(WORDS)


def template_lengths(templates) -> list[int]:
    """Words of each template, repeated ones too."""
    return [len(_LINE_WORDS.findall(text.translate(_LOWER))) for _, text in templates]


def template_words(templates) -> list[tuple[str, list[str]]]:
    return [(label, list(dict.fromkeys(_LINE_WORDS.findall(text.translate(_LOWER))))) for label, text in templates]


def word_counts(docs: DataFrame, words: set[str]) -> dict[str, int]:
    """Lines of all documents that hold each of ``words`` (the templates' words, a fixed few)."""
    known = frozenset(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for _, texts in texts_of(batch, "text"):
                for text in texts:
                    if text:
                        found.update(x for x in map(_lowered, _ANY.findall(text)) if x in known)
        yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}  # as many rows as templates have words


def _lowered(word: str) -> str:
    return word.translate(_LOWER)


class Join:
    """Containment of a block's words in each template, by prefix, length and position."""

    def __init__(self, templates, counts: dict[str, int], threshold: float, lengths: list[int] | None = None) -> None:
        self.labels = [label for label, _ in templates]
        ranked = sorted({w for _, words in templates for w in words}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(ranked)}
        self.sizes, self.need, self.sets = [], [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for t, (_, words) in enumerate(templates):
            ids = sorted(self.rank[w] for w in words)
            need = max(1, math.ceil(threshold * len(ids) - 1e-9))
            self.sizes.append(len(ids))
            self.need.append(need)
            self.sets.append(frozenset(ids))
            for at, i in enumerate(ids[: len(ids) - need + 1]):
                self.prefix.setdefault(i, []).append((t, at))
        #: Words of a window: a notice at the threshold may hold words that its template has not.
        self.spans = [math.ceil(n / threshold) for n in lengths or self.sizes]
        self.least = min(self.need, default=1)
        self.starts = frozenset(w for w, i in self.rank.items() if i in self.prefix)

    def matches(self, words: set[str]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        if len(words) < self.least:
            return []
        mine = sorted(self.rank[w] for w in words if w in self.rank)
        seen: set[int] = set()
        out = []
        for at, i in enumerate(mine):
            for t, there in self.prefix.get(i, ()):
                if t in seen:
                    continue
                seen.add(t)  # i is the rarest common word: what follows it bounds the overlap
                if len(mine) < self.need[t] or min(len(mine) - at, self.sizes[t] - there) < self.need[t]:
                    continue
                common = sum(x in self.sets[t] for x in mine)
                if common >= self.need[t]:
                    out.append((t, common / self.sizes[t]))
        return out

    def windows(self, words: list[str], t: int) -> float:
        """The largest containment of template ``t`` in a window of its span of consecutive words."""
        ids, span = self.sets[t], self.spans[t]
        inside: Counter = Counter()
        places: deque[tuple[int, int]] = deque()
        most = 0
        for at, w in enumerate(words):
            i = self.rank.get(w)
            if i not in ids:
                continue
            places.append((at, i))
            inside[i] += 1
            while places[0][0] <= at - span:
                gone = places.popleft()[1]
                inside[gone] -= 1
                if not inside[gone]:
                    del inside[gone]
            most = max(most, len(inside))
        return most / self.sizes[t] if most >= self.need[t] else 0.0


def license_scan(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are phrases whose words stand consecutively anywhere in the text. The join
    finds every block whose distinct words hold ``threshold`` of a template's distinct words.
    Blocks are lines, and windows of the template's words over ``threshold`` consecutive words
    wherever they start, so that a notice is found however it is wrapped. Words are ordered by
    their count over all documents, and only texts, then lines, with a word of a template's
    rarest few, enough words and enough left after the first common word are counted out.
    ``labels`` has both kinds. ``score`` is the largest containment found, 1 if a base phrase
    stands in the text, else 0.

    Null text is empty: no words, empty labels, score 0. Ties need no order (labels are sets).
    Repeated rows and null ids get a row each; other columns are ignored; an empty table gives
    an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = template_words(templates)
    join = Join(listed, word_counts(rows, {w for _, words in listed for w in words}), threshold, template_lengths(templates))
    sought = [(phrase.split(), label) for phrase, label in phrases]
    firsts = frozenset(words[0] for words, _ in sought)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def one(text: str | None) -> tuple:
        words = list(map(_lowered, _ANY.findall(text))) if text and not text.isascii() else _LINE_WORDS.findall((text or "").lower())
        have = set(words)
        places: list[int] = []
        base: set[str] = set()
        if have & firsts:
            for i, w in enumerate(words):
                if w in firsts:
                    for phrase, label in sought:
                        if words[i : i + len(phrase)] == phrase:
                            places.append(i)
                            base.add(label)
        score, labels = 1.0 if base else 0.0, set(base)
        near = join.matches(have) if have & join.starts else []  # no block of a text holds more than the text
        if near:
            found = [(t, join.windows(words, t)) for t, _ in near]
            for line in text.split("\n"):
                found += join.matches(set(map(_lowered, _ANY.findall(line))))
            for t, c in found:
                if c:
                    labels.add(join.labels[t])
                    score = max(score, c)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, "text"):
                found = [one(t) for t in texts]
                columns = [batch.column(0).slice(at, len(texts)), *map(list, zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema=schema)

    return rows.mapInArrow(scan, OUT)
