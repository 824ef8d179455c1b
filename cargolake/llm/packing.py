"""Best-fit packing of token pieces into sequences of fixed capacity.

Texts are encoded, ended by one separator id, and cut only where longer than a
sequence.  How many sequences of which make-up to use is decided on the length
histogram, which has at most ``capacity`` entries whatever the input:

1. the configuration linear program (fewest bins so that every length's count
   is covered by the chosen make-ups) is solved approximately by multiplicative
   weights; each round prices make-ups with an unbounded-knapsack dynamic
   program over the current weights of the lengths;
2. the fractional solution is rounded: its whole bins first, then one bin more of
   each make-up by largest remainder, where the counts allow and the make-up is
   full to a few tokens; the program is solved and rounded again for what is left;
3. the rest, a few pieces a length at most, is packed best fit decreasing, on
   counts, not on pieces.

The plan is a short list of (length, rank interval, first sequence, offset), so
pieces find their place from their rank within their length.  Ranks come from
counts per (length, hash slice) and their prefix sums: no length is gathered in
one task.

Edge cases: a null or empty text is one piece holding the separator alone;
repeated rows and null ids are separate pieces; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from cargolake.llm.common import prepare, raw_texts, stored

MEMO = 250_000  # words, and parts of other words, whose ids are remembered per worker
LONGEST_WORD = 64
ROUNDS, BATCH, RATE = 60, 48, 0.5
PASSES = 3  # times that the program is solved and rounded
ROWS_PER_SLICE = 20_000

Plan = dict[str, np.ndarray]


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


# ends of words that this vocabulary's splitting always parts from a letter or digit before them
TAIL = b".,!?;:#$%&*|"


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class WordIds:
    """Little-endian 32-bit ids of white-space-separated words, with a bounded memo."""

    def __init__(self, path: str):
        self.encode, self.known, self.parts = tokenizer(path).encode, {}, {}

    def ids(self, words: list[bytes]) -> bytes:
        known = self.known.get
        found = [known(w) for w in words]
        if None in found:
            fresh = self._fresh({w for w, ids in zip(words, found) if ids is None})
            found = [fresh[w] if ids is None else ids for w, ids in zip(words, found)]
        return b"".join(found)

    def _fresh(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words outside the memo: a word and the marks at its end are looked up apart, the unknown encoded in one call."""
        split, ask = {}, set()
        for w in words:
            core = w.rstrip(TAIL)
            # the last letter once lowered: one that lowers to a letter and a mark is not parted from what follows
            parts = (core, w[len(core):]) if core and core != w and core.decode()[-1].lower()[-1].isalnum() else (w,)
            split[w] = parts
            ask.update(p for p in parts if p not in self.parts)
        asked = sorted(ask)
        ids = dict(zip(asked, self._encoded([p.decode() for p in asked])))
        self._remember(self.parts, ids)
        known = self.parts.get
        out = {w: b"".join([ids.get(p) or known(p, b"") for p in parts]) for w, parts in split.items()}
        self._remember(self.known, out)
        return out

    @staticmethod
    def _remember(memo: dict[bytes, bytes], more: dict[bytes, bytes]) -> None:
        if len(memo) < MEMO:
            memo.update((w, x) for w, x in more.items() if len(w) <= LONGEST_WORD)

    def _encoded(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        encoding = self.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])  # white space parts words, so each token is of one of them
        ids = np.array(encoding.ids, dtype="<u4")
        first = np.searchsorted(np.array([o[0] for o in encoding.offsets], np.int64), starts)
        return [ids[a:b].tobytes() for a, b in zip(first, first[1:])]


@cache
def memo(path: str) -> WordIds:
    return WordIds(path)


def text_ids(raw: bytes, path: str) -> bytes:
    """The ids of a text.  This vocabulary drops white space and lowers case
    before all else, so words can be encoded one by one, unless the text holds
    the opening of a special string, which is matched before lowering."""
    if b"<|" in raw:
        return packed(tokenizer(path).encode(raw.decode(), add_special_tokens=False).ids)
    return memo(path).ids(raw.lower().split())


PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"
SALT = ", salt long"  # tells equal rows apart; stored with the pieces, so that their slices stay


def _pieces(path: str, capacity: int, separator: int):
    end = packed([separator])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() << 40
        for batch in batches:
            source, piece, start, length, crc = [], [], [], [], []
            for row, raw in enumerate(raw_texts(batch.column("text"))):
                ids = text_ids(raw, path) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    source.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            salts = np.arange(salt, salt + len(source))
            salt += len(source)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(v, pa.int64()) for v in (start, length, crc, salts)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: most worth of sizes (repeats allowed) adding up to c at most; took[c]: index of one taken, -1 for none."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(int(sizes[0]), capacity + 1):
        some = worth[:fitting[c]] + best[c - sizes[:fitting[c]]]
        k = int(np.argmax(some))
        if some[k] > best[c - 1]:
            best[c], took[c] = some[k], k
        else:
            best[c] = best[c - 1]
    return best, took


def _make_up(sizes: np.ndarray, took: np.ndarray, c: int) -> dict[int, int]:
    found: dict[int, int] = {}
    while c > 0:
        if took[c] < 0:
            c -= 1
            continue
        found[int(took[c])] = found.get(int(took[c]), 0) + 1
        c -= int(sizes[took[c]])
    return found


def configuration_program(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS,
                          batch: int = BATCH, rate: float = RATE) -> list[tuple[float, dict[int, int]]]:
    """Approximate fractional solution: (number of bins, {index of size: times in the bin})."""
    demand = counts.astype(float)
    weight = sizes / capacity  # a dual solution: no bin's worth exceeds 1
    cover = np.zeros(len(sizes))
    chosen: dict[tuple, float] = {}
    for _ in range(rounds):
        best, took = _knapsack(sizes, weight, capacity)
        # the best bin that holds each of the least covered lengths
        forced = np.argsort(cover - 1e-9 * sizes, kind="stable")[:batch]
        for i in forced:
            rest = _make_up(sizes, took, capacity - int(sizes[i]))
            rest[int(i)] = rest.get(int(i), 0) + 1
            index, times = np.array(list(rest)), np.array(list(rest.values()), float)
            bins = float(np.min(demand[index] / times)) / 4
            chosen[key] = chosen.get(key := tuple(sorted(rest.items())), 0.0) + bins
            cover[index] += bins * times / demand[index]
        gap = cover - cover.mean()
        weight = (sizes / capacity) * np.exp(-rate * np.clip(gap, -4, 4))
    scale = 1 / max(float(np.average(cover, weights=sizes * demand)), 1e-12)
    return sorted(((x * scale, dict(p)) for p, x in chosen.items()), key=lambda y: -y[0])


def _best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing on counts: (bins, make-up) pairs."""
    open_bins: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    for i in range(len(sizes) - 1, -1, -1):
        size, left, room = int(sizes[i]), int(counts[i]), int(sizes[i])
        while left and room <= capacity:
            while left and open_bins[room]:
                bins, inside = open_bins[room].pop()
                each = room // size
                used = min(bins, left // each)
                if used:
                    open_bins[room - each * size].append((used, inside | {i: each}))
                    left -= used * each
                    bins -= used
                if bins and left:  # one more bin takes the last few
                    open_bins[room - left * size].append((1, inside | {i: left}))
                    bins, left = bins - 1, 0
                if bins:
                    open_bins[room].append((bins, inside))
            room += 1
        each = capacity // size
        if left // each:
            open_bins[capacity - each * size].append((left // each, {i: each}))
        if left % each:
            open_bins[capacity - (left % each) * size].append((1, {i: left % each}))
    return [x for level in open_bins for x in level]


def rounded(sizes: np.ndarray, counts: np.ndarray, capacity: int,
            passes: int = PASSES) -> tuple[list[tuple[int, dict[int, int]]], np.ndarray]:
    """Whole bins by the program, as (bins, {index of size: times}) pairs, and how many of each size remain."""
    bins, left = [], counts.copy()
    for _ in range(passes):
        some = np.flatnonzero(left)
        if not len(some):
            break
        program = [(x, {int(some[i]): t for i, t in inside.items()})
                   for x, inside in configuration_program(sizes[some], left[some], capacity)]
        full = [(x, inside) for x, inside in program
                if capacity - sum(int(sizes[i]) * t for i, t in inside.items()) <= capacity // 512]
        wanted = [(int(x), inside) for x, inside in program]
        wanted += [(1, inside) for _, inside in sorted(full, key=lambda y: int(y[0]) - y[0])]
        for n, inside in wanted:
            n = min([n, *(int(left[i]) // t for i, t in inside.items())])
            if n > 0:
                for i, t in inside.items():
                    left[i] -= n * t
                bins.append((n, inside))
    return bins, left


def bin_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Where the pieces of each length go, by their rank within the length."""
    bins: list[tuple[int, dict[int, int]]] = []  # how many, {length: times}
    if histogram.get(capacity):
        bins.append((histogram[capacity], {capacity: 1}))
    sizes = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    if len(sizes):
        counts = np.array([histogram[int(k)] for k in sizes], dtype=np.int64)
        planned, left = rounded(sizes, counts, capacity)
        for n, inside in planned + _best_fit(sizes, left, capacity):
            bins.append((n, {int(sizes[i]): t for i, t in inside.items()}))
    rows, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for n, inside in bins:
        offset = 0
        for length, times in sorted(inside.items(), reverse=True):
            rows.append((length, used[length], times, sequence, offset))
            used[length] += n * times
            offset += length * times
        sequence += n
    rows.sort()
    columns = zip(*rows) if rows else [[]] * 5
    return dict(zip(("length", "rank", "times", "sequence", "offset"), (np.array(c, dtype=np.int64) for c in columns)))


def _placed(plan: Plan):
    # one searchable key: lengths are below 2^20, ranks below 2^43
    keys = (plan["length"] << 43) | plan["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = np.searchsorted(keys, (length << 43) | rank, side="right") - 1
            within, times = rank - plan["rank"][row], plan["times"][row]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                 pa.array(plan["sequence"][row] + within // times), pa.array(plan["offset"][row] + within % times * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def sliced(pieces: DataFrame, slices: int) -> DataFrame:
    """``pieces`` with a hash slice; the salt spreads equal rows over all slices."""
    return pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(slices)))


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their rank (from 0) within their length, by hash slices."""
    total = pieces.count()
    dealt = sliced(pieces, max(16, total // ROWS_PER_SLICE))
    sizes = dealt.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "salt")) - 1
    return (dealt.withColumn("own", own).join(starts, ["length", "slice"])
            .select(*pieces.drop("salt").columns, (F.col("own") + F.col("earlier")).alias("rank")))


def pack(docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start,
    length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text")
    pieces = stored(read.mapInArrow(_pieces(path, capacity, separator), PIECES.format(kind=kind) + SALT), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = bin_plan(histogram, capacity)
    return ranked(pieces).mapInArrow(_placed(plan), PIECES.format(kind=kind) + ", sequence_id long, offset long")
