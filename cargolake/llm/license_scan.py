"""License scan: exact phrases, and an exact set-similarity join of text blocks
with license templates.

A block is a line, or one of the half-overlapping windows of a long line, and of
all words of the text where they cross a line end, so that any template-sized
stretch is in a block, also if it is wrapped over lines.  A block matches a template when it holds at
least the share ``threshold`` of the template's distinct words.  The join is
exact and filtered: words are ordered by how many blocks of the whole corpus
hold them, rarest first; only the prefix of a template that every match must
touch is indexed; a block shorter than the needed overlap is passed over; and
the first common word's places in both orders bound the overlap before it is
counted.  Templates are a stated set that travels to the tasks, so the join
needs no shuffle; the corpus order takes one pass with one count per word.

Edge cases: a null or empty text has no words, no places, empty labels, null
first and last word and score 0; repeated rows and null ids are scanned each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake.llm.common import per_text, prepare, raw_texts

# Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening or notice sentences of well-known licenses, (label, words).
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license version 2 0"),
)
THRESHOLD = 0.9

# every ASCII byte but digits and letters becomes a space; line ends stay
_SPACE = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256))


def word_lines(raw: bytes) -> list[list[bytes]]:
    return [line.split() for line in raw.lower().translate(_SPACE).split(b"\n")]


def blocks(lines: list[list[bytes]], longest: int) -> Iterator[set[bytes]]:
    """Word sets of lines, and of half-overlapping windows of long lines and of the whole text across line ends."""
    stream: list[bytes] = []
    ends: list[int] = []  # where each line ends in the stream
    for words in lines:
        if not words:
            continue
        stream += words
        ends.append(len(stream))
        if len(words) <= 2 * longest:
            yield set(words)
            continue
        for at in range(0, len(words) - longest, longest):
            yield set(words[at:at + 2 * longest])
    line = 0
    for at in range(0, max(1, len(stream) - longest), longest):
        while line < len(ends) and ends[line] <= at:
            line += 1
        if line < len(ends) and ends[line] < min(at + 2 * longest, len(stream)):
            yield set(stream[at:at + 2 * longest])


@dataclass(frozen=True)
class TemplateIndex:
    labels: list[str]
    words: list[list[bytes]]  # of each template, rarest first
    needed: list[int]  # least overlap
    order: dict[bytes, int]
    postings: dict[bytes, list[tuple[int, int]]]  # prefix word: (template, place)
    longest: int

    def matches(self, block: set[bytes]) -> Iterator[tuple[int, float]]:
        """(template, share of its words that the block holds), for all that reach the threshold."""
        if self.postings.keys().isdisjoint(block):
            return
        known = sorted((w for w in block if w in self.order), key=self.order.__getitem__)
        seen = set()
        for j, word in enumerate(known):
            for template, i in self.postings.get(word, ()):
                if template in seen:
                    continue
                seen.add(template)
                words, needed = self.words[template], self.needed[template]
                if len(block) < needed or 1 + min(len(words) - i - 1, len(known) - j - 1) < needed:
                    continue
                overlap = sum(w in block for w in words)
                if overlap >= needed:
                    yield template, overlap / len(words)


def template_index(templates, threshold: float, frequency: dict[bytes, int]) -> TemplateIndex:
    labels, words, needed = [], [], []
    for label, text in templates:
        own = sorted({w for line in word_lines(text.encode()) for w in line}, key=lambda w: (frequency.get(w, 0), w))
        if own:
            labels.append(label)
            words.append(own)
            needed.append(max(1, math.ceil(threshold * len(own) - 1e-9)))
    order = {w: i for i, w in enumerate(sorted({w for own in words for w in own}, key=lambda w: (frequency.get(w, 0), w)))}
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for t, own in enumerate(words):
        for i, w in enumerate(own[:len(own) - needed[t] + 1]):
            postings.setdefault(w, []).append((t, i))
    return TemplateIndex(labels, words, needed, order, postings, _longest(templates))


def _longest(templates) -> int:
    return max((sum(map(len, word_lines(text.encode()))) for _, text in templates), default=1) or 1


def block_frequency(docs: DataFrame, templates) -> dict[bytes, int]:
    """How many blocks of the corpus hold each template word: one row a word."""
    wanted = {w for _, text in templates for line in word_lines(text.encode()) for w in line}
    longest = _longest(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(wanted, 0)
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                for block in blocks(word_lines(raw), longest):
                    for w in wanted & block:
                        total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counted.collect()}


def phrase_places(lines: list[list[bytes]], phrases: list[tuple[list[bytes], str]]) -> tuple[int, list[int], set[str]]:
    """(number of words, starts of all places in order, labels found); phrases run on over line ends."""
    words = [w for line in lines for w in line]
    starts, labels = [], set()
    for phrase, label in phrases:
        last, size, at = phrase[-1], len(phrase), -1
        while True:
            try:
                at = words.index(last, at + 1)
            except ValueError:
                break
            if at - size + 1 >= 0 and words[at - size + 1:at + 1] == phrase:
                starts.append(at - size + 1)
                labels.add(label)
    return len(words), sorted(starts), labels


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
          ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())]
DDL = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
       "n_blocks long")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score (best share of a template found, 1 at
    a phrase) and n_blocks (blocks that match a template)."""
    prepare(docs.sparkSession)
    index = template_index(templates, threshold, block_frequency(docs, templates))
    wanted = [([w.encode() for w in phrase.split()], label) for phrase, label in phrases.items()]

    def row(raw: bytes) -> tuple:
        lines = word_lines(raw)
        n_words, starts, base = phrase_places(lines, wanted)
        labels, best, n_blocks = set(base), 1.0 if base else 0.0, 0
        for block in blocks(lines, index.longest):
            found = False
            for template, share in index.matches(block):
                labels.add(index.labels[template])
                best, found = max(best, share), True
            n_blocks += found
        return (n_words, len(starts), starts[0] if starts else None, starts[-1] if starts else None,
                ",".join(sorted(base)), ",".join(sorted(labels)), best, n_blocks)

    return docs.select("doc_id", per_text(FIELDS, DDL, row)(F.col("text")).alias("s")).select("doc_id", "s.*")
