"""Benchmark decontamination: rare n-gram seeds, then local alignment.

Words are runs of letters and digits, lowered.  Every word n-gram of a test
item is a possible seed; one is rare when at most ``rare_share`` of all
documents hold it, counted over the whole corpus.  A document and an item are
joined by one rare seed, or by two different seeds at nearly the same shift:
so a passage that is itself common (and its seeds with it) is still found.
The words of the document around the seeds are then aligned with the item
(Smith-Waterman: +1 match, -1 mismatch, -1 gap), and the pair counts when the
best local score reaches ``threshold`` of the item's length: a copy scores 1,
each replaced word costs about two words.

The test items are a stated set; they travel to the tasks in blocks of at most
``block_words`` words, one pass over the documents for each block, so what is
broadcast is bounded whatever the benchmark's size.  Documents are neither
shuffled nor gathered; only n-gram counts are.  Pairs come out one by one, at
most one for each item a document really holds.

Edge cases: null and empty texts and items match nothing; an item shorter than
the n-gram is one seed as a whole; equal item texts each give a pair; null ids
take part; repeated document rows each give pairs; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cargolake.llm.common import prepare, raw_texts

NGRAM = 3
RARE_SHARE = 0.001
THRESHOLD = 0.45
BLOCK_WORDS = 500_000
SLACK = 0.5  # words looked at before and after the item's place, as a share of its length
SHIFT = 4  # seeds support each other within so many words

_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    lowered = raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()
    return lowered.translate(_SPACE).split()


@dataclass(frozen=True)
class ItemBlock:
    """Items of one block, as word numbers, with their seeds."""

    ids: list
    vocabulary: dict[bytes, int]
    items: list[np.ndarray]
    keys: np.ndarray  # sorted distinct n-gram keys
    first: np.ndarray  # of each key, where its places begin (one more at the end)
    places: np.ndarray  # [(item, place)] by key
    ngram: int

    def hits(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in the text, index of the key found there); shorter items are looked up at their own length."""
        found = []
        for n in range(1, self.ngram + 1):
            if len(text) < n:
                break
            key, known = _keys(text, n, len(self.vocabulary))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            where = np.flatnonzero(known & (self.keys[at] == key))
            found.append(np.stack([where, at[where]]))
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return both[0], both[1]


def _keys(ids: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of each n-gram (different for each n) and whether all its words are known."""
    width = len(ids) - n + 1
    key, known = np.zeros(width, np.int64), np.ones(width, bool)
    for k in range(n):
        part = ids[k:k + width]
        key = key * (size + 1) + part + 1
        known &= part >= 0
    return key, known


def item_blocks(rows: list[tuple[object, str | None]], ngram: int = NGRAM) -> ItemBlock | None:
    ids, texts = [], []
    for item, text in rows:
        words = words_of((text or "").encode())
        if words:
            ids.append(item)
            texts.append(words)
    if not texts:
        return None
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    if (len(vocabulary) + 1) ** ngram >= 1 << 62:
        raise ValueError("too many different words in a block: take a smaller block_words")
    items = [np.array([vocabulary[w] for w in t], np.int64) for t in texts]
    seeds = []
    for i, item in enumerate(items):
        key, _ = _keys(item, min(ngram, len(item)), len(vocabulary))
        seeds.append(np.stack([key, np.full(len(key), i), np.arange(len(key))]))
    every = np.concatenate(seeds, axis=1)
    every = every[:, np.lexsort(every[::-1])]
    keys, first = np.unique(every[0], return_index=True)
    return ItemBlock(ids, vocabulary, items, keys, np.append(first, every.shape[1]), every[1:].T, ngram)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: (best score, start, end) of the part of ``text``; +1, -1, -1."""
    score = np.zeros(len(item) + 1, np.int64)
    begin = np.zeros(len(item) + 1, np.int64)
    best = (0, 0, 0)
    step = np.arange(len(item) + 1)
    for j, word in enumerate(text):
        before, began = score, begin
        diagonal = before[:-1] + np.where(item == word, 1, -1)
        fresh = np.where(before[:-1] > 0, began[:-1], j)
        up = before[1:] - 1
        take = diagonal >= up
        score = np.zeros_like(before)
        begin = np.full_like(began, j + 1)
        value = np.where(take, diagonal, up)
        score[1:] = np.maximum(value, 0)
        begin[1:] = np.where(value > 0, np.where(take, fresh, began[1:]), j + 1)
        # gaps in the text: running maximum of score + place, less the place
        lifted = score + step
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, step, 0))
        gapped = top - step
        better = gapped > score
        begin = np.where(better, begin[source], begin)
        score = np.where(better, gapped, score)
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), j + 1)
    return best


def matches(block: ItemBlock, common: np.ndarray, raw: bytes, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(index of item, score, first word, word after the last) of the items that a text holds."""
    lookup = block.vocabulary.get
    text = np.fromiter((lookup(w, -1) for w in words_of(raw)), np.int64)
    at, key = block.hits(text)
    if not len(at):
        return
    counts = block.first[key + 1] - block.first[key]
    rows = np.repeat(block.first[key] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    item, place = block.places[rows].T
    position, seldom = np.repeat(at, counts), np.repeat(~common[key], counts)
    shift = position - place
    order = np.lexsort((shift, item))
    item, shift, place, seldom = item[order], shift[order], place[order], seldom[order]
    group = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (shift[1:] - shift[:-1] > SHIFT)))
    found: dict[int, tuple[float, int, int]] = {}
    for a, b in zip(group, np.append(group[1:], len(item))):
        i = int(item[a])
        words = block.items[i]
        alone = len(words) <= block.ngram  # its only seed
        if not (seldom[a:b].any() or alone or len(set(place[a:b].tolist())) > 1):
            continue
        if found.get(i, (0,))[0] >= 1:
            continue
        slack = math.ceil(SLACK * len(words)) + 1
        start = max(0, int(shift[a]) - slack)
        stop = min(len(text), int(shift[b - 1]) + len(words) + slack)
        # a repeating passage makes one long group: windows of four items, half overlapping
        for low in range(start, stop, 2 * (len(words) + slack)):
            high = min(stop, low + 4 * (len(words) + slack))
            # no alignment scores more than the item's words that occur at all
            if np.isin(words, text[low:high]).sum() >= threshold * len(words):
                score, first, last = align(words, text[low:high])
                if score / len(words) >= threshold and score / len(words) > found.get(i, (0,))[0]:
                    found[i] = (score / len(words), low + first, low + last)
            if high == stop or found.get(i, (0,))[0] >= 1:
                break
    for i in sorted(found):
        yield i, *found[i]


def key_counts(docs: DataFrame, block: ItemBlock) -> tuple[np.ndarray, int]:
    """In how many documents each seed of a block stands, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(block.keys), np.int64), 0
        lookup = block.vocabulary.get
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                n += 1
                _, key = block.hits(np.fromiter((lookup(w, -1) for w in words_of(raw)), np.int64))
                total[np.unique(key)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], n))], names=["key", "n"])

    out, n = np.zeros(len(block.keys), np.int64), 0
    for r in docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        if r["key"] < 0:
            n = r["n"]
        else:
            out[r["key"]] = r["n"]
    return out, n


def blocks_of(items: DataFrame, block_words: int = BLOCK_WORDS, ngram: int = NGRAM) -> Iterator[ItemBlock]:
    """Blocks of (item_id, text), read one partition at a time."""
    rows, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").split()) + 1
        if size >= block_words:
            yield from filter(None, [item_blocks(rows, ngram)])
            rows, size = [], 0
    yield from filter(None, [item_blocks(rows, ngram)])


def _seeded(docs: DataFrame, items: DataFrame, rare_share: float, block_words: int) -> Iterator[tuple[ItemBlock, np.ndarray]]:
    for block in blocks_of(items, block_words):
        counts, n = key_counts(docs, block)
        yield block, counts > max(rare_share * n, 1)


FOUND = "array<struct<item_id: {kind}, score: double, first_word: int, end_word: int>>"


def _found(block: ItemBlock, common: np.ndarray, threshold: float, kind: str, arrow_kind: pa.DataType, text: Column) -> Column:
    entry = pa.struct([("item_id", arrow_kind), ("score", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())])

    @F.arrow_udf(FOUND.format(kind=kind))
    def find(column: pa.Array) -> pa.Array:
        return pa.array([[{"item_id": block.ids[i], "score": s, "first_word": a, "end_word": b} for i, s, a, b in matches(block, common, raw, threshold)]
                         for raw in raw_texts(column)], pa.list_(entry))

    return find(text)


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, rare_share: float = RARE_SHARE,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``items`` (item_id, text): doc_id,
    item_id, score, first_word, end_word (words of the document, from 0)."""
    prepare(docs.sparkSession)
    kind = items.schema["item_id"].dataType.simpleString()
    arrow_kind = to_arrow_type(items.schema["item_id"].dataType)
    out = docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {kind}, score double, first_word int, end_word int")
    for block, common in _seeded(docs, items, rare_share, block_words):
        pairs = docs.select("doc_id", F.explode(_found(block, common, threshold, kind, arrow_kind, F.col("text"))).alias("f"))
        out = out.unionByName(pairs.select("doc_id", "f.*"))
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, rare_share: float = RARE_SHARE,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds an item."""
    prepare(docs.sparkSession)
    kept, kind = docs, items.schema["item_id"].dataType
    for block, common in _seeded(docs, items, rare_share, block_words):
        kept = kept.filter(F.size(_found(block, common, threshold, kind.simpleString(), to_arrow_type(kind), F.col("text"))) == 0)
    return kept
