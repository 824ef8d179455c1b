"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: signs after learned rotations (iterative
quantisation: principal axes, then a rotation fitted so that signs lose least),
several rotations side by side.  A code is split into substrings, each with its
own index from value to rows.  By the pigeonhole principle a code within
``radius`` bits of the query is within a known small radius in some substring,
so probing the near values of every substring retrieves every such code; the
full code's distance is checked, and the original vectors rank what is left.

The rotations and the radius (that holds ``coverage`` of the true neighbours)
are fitted on a bounded hash sample; every row is indexed.  Each task indexes
its rows in slices and answers a block of queries from them, keeping its best
``k`` a query, so vectors are never shuffled; only the best lists are.  Queries
are a stated set and are taken in blocks of about ``query_block``.  A query
that finds fewer than ``k`` is asked again without a radius, exactly.

Edge cases: a vector that is null, empty, zero, or holds a null or non-finite
component takes no part, nor does one of another dimension than most, or with
a null id; repeated rows of one id count once, as the nearer one (as a query,
the smaller); ties go to the smaller id; fewer than ``k`` candidates are all
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargolake.llm.common import hash_rate, prepare, stored

BITS, SUBSTRING = 256, 8
SAMPLE, PROBES = 4000, 300
COVERAGE = 0.985
SLICE = 8192  # rows indexed at once
QUERY_BLOCK = 2048


def _rotations(x: np.ndarray, bits: int, seed: int = 11, steps: int = 30) -> np.ndarray:
    """[dimension, bits]: iterative quantisation from several random starts, side by side."""
    dimension, random = x.shape[1], np.random.default_rng(seed)
    _, _, axes = np.linalg.svd(x, full_matrices=True)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn, _ = np.linalg.qr(random.normal(size=(dimension, dimension)))
        projected = x @ axes.T
        for _ in range(steps):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ signs)
            turn = left @ right
        parts.append(axes.T @ turn)
    return np.concatenate(parts, axis=1)[:, :bits]


@dataclass(frozen=True)
class Codes:
    mean: np.ndarray
    rotation: np.ndarray
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """[row, byte] codes."""
        return np.packbits((x - self.mean) @ self.rotation >= 0, axis=1, bitorder="little")

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]


def near_values(reach: int) -> list[np.ndarray]:
    """For each byte value, the values within ``reach`` bits (none if negative)."""
    every = np.arange(256, dtype=np.uint8)
    return [np.flatnonzero(np.bitwise_count(every ^ np.uint8(v)) <= reach) for v in range(256)]


def reaches(radius: int, parts: int) -> list[int]:
    """Least radius of each substring that together retrieve all codes within ``radius``."""
    whole, more = divmod(radius, parts)
    return [min(SUBSTRING, whole if j <= more else whole - 1) for j in range(parts)]


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


class Index:
    """Substring tables over one slice of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.order = np.argsort(codes, axis=0, kind="stable").T.copy()
        counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(self.parts)])
        self.first = np.concatenate([np.zeros((self.parts, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)

    def within(self, code: np.ndarray, radius: int, near: list[list[np.ndarray]]) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``; near: of each substring, the lists of ``near_values``."""
        values = [near[j][code[j]] for j in range(self.parts)]
        part = np.repeat(np.arange(self.parts), [len(v) for v in values])
        value = np.concatenate(values)
        start = self.first[part, value]
        size = self.first[part, value + 1] - start
        total = int(size.sum())
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)
        marked = np.zeros(len(self.codes), bool)
        marked[self.order[np.repeat(part, size), place]] = True
        rows = np.flatnonzero(marked)
        return rows[hamming(self.codes[rows], code) <= radius]


def best_of(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` nearest different ids, ties to the smaller id."""
    order = np.lexsort((ids, distance))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, as doubles, of any dimension."""
    x = F.col("embedding").cast("array<double>")
    plain = vectors.select("vec_id", x.alias("x")).filter("vec_id IS NOT NULL AND size(x) > 0")
    big = F.lit(float("inf"))
    return plain.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == big)) & F.exists("x", lambda v: v != 0))


def fit(rows: DataFrame, total: int, k: int, bits: int = BITS, sample: int = SAMPLE, coverage: float = COVERAGE) -> Codes:
    """Rotations and radius from about ``sample`` rows."""
    some = rows.filter(hash_rate(F.col("vec_id"), min(1.0, sample / max(total, 1)))).orderBy("vec_id").limit(2 * sample).collect()
    if not some:
        some = rows.limit(sample).collect()
    x = np.array([r["x"] for r in some])
    mean = x.mean(axis=0)
    rotation = _rotations(x - mean, bits)
    codes = Codes(mean, rotation, bits)
    packed = codes.of(x)
    away = []
    for i in np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int):
        distance = ((x - x[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        nearest = np.argsort(distance, kind="stable")[:min(k, len(x) - 1)]
        away.extend(hamming(packed[nearest], packed[i]).tolist())
    # neighbours in the sample are further off than those in the whole, so this radius errs on the wide side
    return Codes(mean, rotation, int(np.quantile(away, coverage, method="higher")) if away else bits)


def _answer(codes: Codes, radius: int, ids: np.ndarray, x: np.ndarray, k: int):
    own = codes.of(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_reach = {r: near_values(r) for r in set(reaches(radius, own.shape[1]))}
        near = [by_reach[r] for r in reaches(radius, own.shape[1])]
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting, ready = [], 0

        def ask() -> None:
            row_ids = np.concatenate([i for i, _ in waiting])
            rows = np.concatenate([v for _, v in waiting])
            index = Index(codes.of(rows))
            for q in range(len(ids)):
                some = index.within(own[q], radius, near)
                some = some[row_ids[some] != ids[q]]
                if not len(some):
                    continue
                distance = np.sqrt(((rows[some] - x[q]) ** 2).sum(axis=1))
                near_ids = row_ids[some]
                if q in found:
                    distance, near_ids = np.concatenate([found[q][0], distance]), np.concatenate([found[q][1], near_ids])
                best = best_of(distance, near_ids, k)
                found[q] = distance[best], near_ids[best]

        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            waiting.append((batch.column("vec_id").to_numpy(zero_copy_only=False), values.reshape(batch.num_rows, -1)))
            ready += batch.num_rows
            if ready >= SLICE:
                ask()
                waiting, ready = [], 0
        if ready:
            ask()
        if found:
            sizes = [len(found[q][0]) for q in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[list(found)], sizes)), pa.array(np.concatenate([v[1] for v in found.values()])),
                 pa.array(np.concatenate([v[0] for v in found.values()]))], names=["query_id", "vec_id", "score"])

    return run


def _search(rows: DataFrame, codes: Codes, radius: int, queries: list, k: int) -> DataFrame:
    ids = np.array([r["vec_id"] for r in queries], np.int64)
    x = np.array([r["x"] for r in queries], np.float64)
    lists = rows.mapInArrow(_answer(codes, radius, ids, x, k), "query_id long, vec_id long, score double")
    best = lists.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``vectors`` (vec_id, embedding): for each row whose id is divisible by
    ``every``, its ``k`` nearest others by Euclidean distance: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    prepare(spark)
    taking = usable(vectors)
    sizes = taking.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a dimension
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return out
    dimension, total = max(((r["d"], r["n"]) for r in sizes), key=lambda y: (y[1], -y[0]))
    rows = taking.filter(F.size("x") == dimension).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    codes = fit(rows, total, k)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-asked.count() // query_block))
    others = rows.agg(F.count_distinct("vec_id")).first()[0] - 1 if total <= k + 1 else k
    for b in range(blocks):
        queries = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # a block, about query_block rows
        if not queries:
            continue
        found = stored(_search(rows, codes, codes.radius, queries, k), "nearest")
        have = {r["query_id"] for r in found.groupBy("query_id").count().filter(F.col("count") >= min(k, others)).collect()}
        short = [r for r in queries if r["vec_id"] not in have]
        if short:
            exact = _search(rows, codes, codes.bits, short, k)
            found = found.filter(~F.col("query_id").isin([r["vec_id"] for r in short])).unionByName(exact)
        out = out.unionByName(found)
    return out
