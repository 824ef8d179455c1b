"""Alignment of two tokenizers over the same texts.

A is a byte-level BPE of the ``tokenizers`` library, which reports character
offsets; B is a ``sentencepiece`` model, which reports byte spans in its proto
(``immutable_proto`` is refused by the installed version, which names ``proto``
as its successor).  Both kinds of span are coarse cuts: they place a token in
its stretch of the text and give its end where every character is one byte.
Where a character has more bytes, and for byte-fallback tokens, whose spans are
empty, ends are refined with the bytes that the tokens decode to.  Places where
a token of A and one of B both end cut the tokens into groups; all A-B pairs
within a group are links.

Stretches.  Neither tokenizer lets a token cross a single space that follows
something other than white space, or that precedes it: A's pre-tokenizer begins
a match there, and no piece of B holds a space after another character (checked
when the model is loaded).  So a text is cut before such spaces, stretches are
aligned once and remembered (a bounded memo), and a text's groups are those of
its stretches.  Unknown stretches of a batch are encoded in one call.

One pass over the texts stores each text's linked pairs; no text is shuffled.
The texts that hold a pair are counted with map-side combine.  The pairs of the
highest counts, at most ``head`` of them, travel to the tasks that add up each
text's sums; its other pairs meet their counts in a shuffle, where none is hot,
as its count is below the head's.  Every link is counted: the head only says by
which way.

Edge cases: a null or empty text, or one whose tokens' bytes differ from
space + text, has no tokens: zeros and an empty digest; repeated rows are texts
of their own; a text without spaces is one stretch; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from cargolake.llm.common import prepare, raw_texts, stored

HEAD = 1_000_000  # pairs sent to every task: at most 17 MB
MEMO = 500_000  # stretches remembered by a worker
LONGEST = 64  # longer stretches are not remembered
SOME = 200_000  # stretches learned at a time
CUT = re.compile(r"(?<=\S)(?= [^ ])|(?<=[^ ])(?= \S)")
UNEVEN = re.compile(r"\s \s|  ")
WHOLE = re.compile(r" \S(?:.*\S)?", re.DOTALL)  # may be encoded in a row with others


def byte_alphabet() -> dict[str, int]:
    """The characters that a byte-level BPE writes bytes as: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Tokenizer A: ids, the characters' offsets as coarse cuts, and each id's bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        self.bytes = {}
        for entry, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.sizes = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            self.sizes[i] = len(b)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first character, end character of ``text``."""
        found = self.library.encode(text, add_special_tokens=False)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        return np.array(found.ids, np.int64), spans[:, 0], spans[:, 1]


class Pieces:
    """Tokenizer B: ids, the proto's byte spans as coarse cuts, and each id's bytes."""

    SPACE = "▁"

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for i in range(self.library.vocab_size()):
            piece = self.library.id_to_piece(i)
            if self.SPACE in piece.lstrip(self.SPACE):
                raise ValueError(f"piece {i} holds a space after another character: texts cannot be cut at spaces")
            self.bytes[i] = bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(self.SPACE, " ").encode()
        self.sizes = np.array([len(self.bytes[i]) for i in range(len(self.bytes))], np.int64)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, first byte, end byte within space + ``text``, the space being what B adds."""
        pieces = self.library.encode(text, return_type="proto").pieces
        flat = np.array([x for p in pieces for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3)
        return flat[:, 0], flat[:, 1] + 1, flat[:, 2] + 1


def ends(ids: np.ndarray, coarse: np.ndarray, sizes: np.ndarray, ascii_only: bool) -> np.ndarray:
    """Byte at which each token ends: the span's, refined by decoded bytes where a character has several."""
    refined = np.cumsum(sizes[ids])
    return coarse if ascii_only and len(coarse) and np.array_equal(coarse, refined) else refined


class Alignments:
    """Aligned stretches by row number: first those remembered, then those of the stretches last asked for."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.digits = [str(i) for i in range(max(len(self.a.sizes), len(self.b.sizes)))]
        self.rows: dict[str, int] = {}
        self.names: list[str] = []
        self.text: list[str] = []  # groups as written into the digest
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A and B, groups, links; 1 if bytes differ
        self.links = np.empty(0, np.int64)  # a * 2^32 + b, of all rows one after the other
        self.starts = np.zeros(1, np.int64)
        self.kept = 0

    def learn(self, stretches: Iterable[str]) -> None:
        """Align those not known yet; rows beyond ``kept`` are given up first."""
        fresh = self.kept
        for name in self.names[fresh:]:
            del self.rows[name]
        del self.names[fresh:], self.text[fresh:]
        self.numbers, self.starts = self.numbers[:fresh], self.starts[:fresh + 1]
        self.links = self.links[:self.starts[-1]]
        new = list(set(stretches).difference(self.rows))
        room = MEMO - self.kept
        lasting = [s for s in new if len(s) <= LONGEST][:room]
        self._add(lasting)
        self.kept = len(self.names)
        self._add(list(set(new).difference(lasting)))

    def _add(self, stretches: list[str]) -> None:
        """Those that may stand in a row go to the libraries in one call, others alone."""
        together = [s for s in stretches if WHOLE.fullmatch(s)]
        runs = [together[at:at + 4096] for at in range(0, len(together), 4096)]
        runs += [[s] for s in stretches if not WHOLE.fullmatch(s)]
        for run in runs:
            if not self._align(run):
                for s in run:  # some stretch reads otherwise: find out which
                    if not self._align([s]):
                        self._append([s], [""], np.array([[0, 0, 0, 0, 1]]), np.empty(0, np.int64))

    def _append(self, names: list[str], text: list[str], numbers: np.ndarray, links: np.ndarray) -> None:
        self.rows.update(zip(names, range(len(self.names), len(self.names) + len(names))))
        self.names += names
        self.text += text
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links = np.concatenate([self.links, links])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(numbers[:, 3])])

    def _align(self, stretches: list[str]) -> bool:
        """False if either tokenizer's bytes differ from the stretches'."""
        text = "".join(stretches)
        raw = text.encode("utf-8", "replace")
        a, a_from, a_to = self.a.encode(text)
        b, b_from, b_to = self.b.encode(text[1:])
        if (b"".join(map(self.a.bytes.__getitem__, a.tolist())) != raw
                or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != raw):
            return False
        b_from[0] = 0
        n, plain = len(stretches), len(raw) == len(text)
        # coarse cuts: the stretch that each token begins in, by characters for A and by bytes for B
        lengths = np.array([len(s) for s in stretches])
        sizes = lengths if plain else np.array([len(s.encode("utf-8", "replace")) for s in stretches])
        a_at = np.searchsorted(np.cumsum(lengths), a_from, "right")
        b_at = np.searchsorted(np.cumsum(sizes), b_from, "right")
        a_ends, b_ends = ends(a, a_to, self.a.sizes, plain), ends(b, b_to, self.b.sizes, plain)
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        if not np.isin(np.cumsum(sizes), cuts).all():  # a token crosses a stretch's end: each alone then
            return n == 1
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        of_a, of_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        b_start = np.cumsum(of_b) - of_b
        # links: each token of A with every token of B of its group
        width = of_b[a_group]
        inner = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        links = (np.repeat(a, width) << 32) + b[np.repeat(b_start[a_group], width) + inner]
        # the groups' text: A's tokens of a group, then B's, each with the mark that follows it
        a_mark = np.where(np.diff(a_group, append=len(cuts)) > 0, "|", ",").tolist()
        b_mark = np.where(np.diff(b_group, append=len(cuts)) > 0, ";", ",").tolist()
        written = np.empty(len(a) + len(b), object)
        written[np.arange(len(a)) + b_start[a_group]] = [self.digits[i] + m for i, m in zip(a.tolist(), a_mark)]
        written[np.arange(len(b)) + np.cumsum(of_a)[b_group]] = [self.digits[i] + m for i, m in zip(b.tolist(), b_mark)]
        n_a, n_b = np.bincount(a_at, minlength=n), np.bincount(b_at, minlength=n)
        group_at = np.searchsorted(np.cumsum(sizes), cuts, "left")
        n_links = np.bincount(group_at, of_a * of_b, minlength=n).astype(np.int64)
        upto = np.cumsum(n_a + n_b).tolist()
        words = written.tolist()
        texts = ["".join(words[i:j])[:-1] for i, j in zip([0, *upto], upto)]
        self._append(stretches, texts, np.column_stack([n_a, n_b, np.bincount(group_at, minlength=n), n_links, np.zeros(n, np.int64)]), links)
        return True

    def stretches(self, text: str) -> list[str]:
        """The stretches of space + text."""
        whole = " " + text
        if text[0] == " " or text[-1] == " " or UNEVEN.search(whole):
            return CUT.split(whole)
        return [" " + s for s in text.split(" ")]

    def linked(self, rows: np.ndarray) -> np.ndarray:
        start, n = self.starts[rows], self.numbers[rows, 3]
        return self.links[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@cache
def alignments(path_a: str, path_b: str) -> Alignments:
    return Alignments(path_a, path_b)


def _decoded(memo: Alignments, raw: bytes) -> list[str]:
    """The stretches of a text; none if it is empty or no UTF-8."""
    try:
        return memo.stretches(raw.decode()) if raw else []
    except UnicodeDecodeError:
        return []


def _walk(memo: Alignments, column: pa.Array) -> Iterator[np.ndarray]:
    """Per text the row numbers of its stretches; none if it has no tokens."""
    waiting, held = [], 0

    def settled() -> Iterator[np.ndarray]:
        memo.learn(s for t in waiting for s in t)
        for t in waiting:
            rows = np.fromiter(map(memo.rows.__getitem__, t), np.int64, len(t))
            yield rows if not memo.numbers[rows, 4].any() else rows[:0]

    for raw in raw_texts(column):
        waiting.append(_decoded(memo, raw))
        held += len(waiting[-1])
        if held >= SOME:
            yield from settled()
            waiting, held = [], 0
    yield from settled()


LINKED_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                 ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))]
LINKED_DDL = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _linked(path_a: str, path_b: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = alignments(path_a, path_b)
        for batch in batches:
            numbers, digests, pairs, times = [], [], [], []
            for rows in _walk(memo, batch.column("text")):
                numbers.append(memo.numbers[rows, :4].sum(axis=0))
                text = ";".join(map(memo.text.__getitem__, rows.tolist()))
                digests.append(sha256(text.encode()).hexdigest() if len(rows) else "")
                found, n = np.unique(memo.linked(rows), return_counts=True)
                pairs.append(found)
                times.append(n.astype(np.int32))
            columns = [pa.array(c) for c in np.array(numbers, np.int64).reshape(-1, 4).T]
            columns += [pa.array(digests, pa.string()), _lists(pairs, pa.int64()), _lists(times, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *(name for name, _ in LINKED_FIELDS)])

    return run


def linked_texts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, row (unique), n_a, n_b, n_groups, n_links, groups_sha256, and its linked pairs
    (a * 2^32 + b) with the number of links of each.  Stored."""
    prepare(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", read.schema["id"].dataType), *StructType.fromDDL(LINKED_DDL).fields])
    return stored(read.mapInArrow(_linked(path_a, path_b), schema).withColumn("row", F.monotonically_increasing_id()), "linked-texts")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): the texts that hold an id pair linked, and whether no pair of its A id has more.  Stored."""
    found = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most B's vocabulary in one
    return stored(found.withColumn("best", F.col("n") == F.max("n").over(of_a)), "pairs")


def _head(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of the highest counts, whole powers of two, at most ``most`` of them; and the others."""
    size = F.floor(F.log2("n")).cast("int")
    at, held = 64, 0
    for r in counts.groupBy(size.alias("s")).count().orderBy(F.desc("s")).collect():  # at most 64 rows
        held += r["count"]
        if held > most:
            break
        at = r["s"]
    return counts.filter(size >= at), counts.filter(size < at)


SCORE_FIELDS = [("n_best", pa.int64()), ("count_sum", pa.int64()), ("rest", pa.list_(pa.int64())), ("rest_times", pa.list_(pa.int32()))]
SCORE_DDL = "n_best long, count_sum long, rest array<long>, rest_times array<int>"


def _scored(head) -> Callable:
    """Adds up the counts of each text's pairs of the head, and lists its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = head.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            pairs, start = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            start = start - start[0]
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            facts = np.zeros((3, len(pairs) + 1), np.int64)
            if len(keys):
                facts[0, 1:], facts[1, 1:] = known * best[at] * times, known * counts[at] * times
            facts[2, 1:] = ~known
            sums = np.diff(np.cumsum(facts, axis=1)[:, start], axis=1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sums[2])]).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known], k)) for x, k in ((pairs, pa.int64()), (times, pa.int32()))]
            others = [batch.column(c) for c in ("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(sums[0]), pa.array(sums[1]), *rest], names=[
                "id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(name for name, _ in SCORE_FIELDS)])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    linked = linked_texts(docs, path_a, path_b, id_col, text_col)
    top, rest = _head(pair_counts(linked), head)
    held = top.toArrow().sort_by("pair")  # at most ``head`` rows
    sent = docs.sparkSession.sparkContext.broadcast(tuple(held.column(c).to_numpy() for c in ("pair", "n", "best")))
    plain = [linked.schema[c] for c in ("id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
    scored = linked.mapInArrow(_scored(sent), StructType([*plain, *StructType.fromDDL(SCORE_DDL).fields]))
    names: list[Column] = [F.col("id").alias(id_col), *map(F.col, ("n_a", "n_b", "n_groups", "n_links"))]
    if rest.isEmpty():
        return scored.select(*names, "n_best", "count_sum", "groups_sha256")
    listed = scored.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("p")).select("row", "p.rest", "p.rest_times")
    more = listed.join(rest, listed["rest"] == rest["pair"]).groupBy("row").agg(
        F.sum(F.col("rest_times") * F.col("n")).alias("more"),
        F.sum(F.when(F.col("best"), F.col("rest_times")).otherwise(0)).alias("more_best"))
    added = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more"))]
    return scored.join(more, "row", "left").select(*names, *added, "groups_sha256")
