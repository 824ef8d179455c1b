"""Log-bilinear language model, trained by noise-contrastive estimation.

A token's context vector is the sum of its two predecessors' vectors, each
weighted by place; its score with a target word is their inner product plus
the target's bias.  The model's words are the ``vocabulary`` most frequent of
the training tokens; all others share one symbol, whose probability is spread
over them by their smoothed counts, so that every word of any text has a
normalised probability.

Training reads all training documents: each partition runs numpy minibatches of
noise-contrastive estimation over its texts, and the partitions' parameters, of
fixed size, are averaged in two levels; this is repeated ``rounds`` times.  A
round takes every ``rounds``-th token of a text, the next one another offset, so
that each token of each text is the target once.  Scoring needs the normaliser of each pair of
predecessors: because the score is a sum over places, all of them come out of
one matrix product of exponentials.

Word counts cover the whole training corpus.  They are shuffled by word; the
``head`` most frequent words (a bounded list) are looked up in the tasks, the
rest of each text's words meet their counts in a shuffled join, where no word
can be hot.

Edge cases: a null or empty text is one end token; null ids are never learned
from and count as held out; repeated rows are scored each; with no training
text all words have the probability of an unseen one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake.llm.common import fold, prepare, raw_texts, stored

VOCABULARY, WIDTH, CONTEXT = 2048, 24, 2
HEAD = 131_072
ROUNDS, BATCH, NOISE, RATE = 2, 512, 64, 0.2
FLUSH = 300_000  # words counted in a task before they are sent on
LONGEST_HEAD = 64  # longer words are never in the head list
END_KEY = "\n"  # no word holds white space
END, REST = 0, 1  # model ids; words begin at 2
SPREAD = 64  # model blocks that are summed in one group


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, with one end token a text under ``END_KEY``."""
    def out(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())],
                                          names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                total.update(words_of(raw))
                total[END_KEY.encode()] += 1
                if len(total) > FLUSH:
                    yield out(total)
                    total.clear()
        yield out(total)

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Vocabulary:
    words: list[bytes]  # the head, most frequent first
    counts: np.ndarray
    ends: int
    tokens: int  # N
    distinct: int  # V
    size: int  # model ids, with END and REST

    @property
    def in_model(self) -> int:
        return min(self.size - 2, len(self.words))

    @property
    def rest_tokens(self) -> int:
        return self.tokens - self.ends - int(self.counts[:self.in_model].sum())

    @property
    def rest_distinct(self) -> int:
        return self.distinct - self.in_model - (self.ends > 0)

    def unigram(self) -> np.ndarray:
        p = np.full(self.size, 1e-3)
        p[END] += self.ends
        p[REST] += self.rest_tokens
        p[2:2 + self.in_model] += self.counts[:self.in_model]
        return p / p.sum()


def vocabulary(counts: DataFrame, size: int = VOCABULARY, head: int = HEAD) -> Vocabulary:
    """The head: all words above a count that at most ``head`` words reach."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                       F.coalesce(F.sum(F.when(F.col("word") == END_KEY, F.col("n"))), F.lit(0)).alias("ends")).first()
    short = counts.filter((F.col("word") != END_KEY) & (F.octet_length("word") <= LONGEST_HEAD))
    step = F.floor(F.log2("n") * 16)  # a few hundred steps whatever the corpus
    least, have = None, 0
    for r in sorted(short.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if have + r["count"] > head:
            break
        have, least = have + r["count"], r["step"]
    rows = short.filter(step >= least).collect() if least is not None else []
    rows.sort(key=lambda r: (-r["n"], r["word"]))
    return Vocabulary([r["word"].encode() for r in rows], np.array([r["n"] for r in rows], np.int64), total["ends"], total["n"], total["v"], size)


@dataclass
class LogBilinear:
    target: np.ndarray  # [word, width]
    context: np.ndarray  # [word, width]
    bias: np.ndarray
    place: np.ndarray  # [predecessor, width]

    @classmethod
    def start(cls, unigram: np.ndarray, width: int = WIDTH, seed: int = 7) -> LogBilinear:
        r, v = np.random.default_rng(seed), len(unigram)
        return cls(r.normal(0, 0.1, (v, width)), r.normal(0, 0.1, (v, width)), np.log(unigram), np.ones((CONTEXT, width)))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.target, self.context, self.bias, self.place)])

    @classmethod
    def of(cls, flat: np.ndarray, size: int, width: int) -> LogBilinear:
        a = size * width
        return cls(flat[:a].reshape(size, width), flat[a:2 * a].reshape(size, width), flat[2 * a:2 * a + size],
                   flat[2 * a + size:].reshape(CONTEXT, width))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per predecessor the scores of all words, and the log normaliser of each pair of predecessors."""
        one = (self.context * self.place[0]) @ self.target.T
        two = (self.context * self.place[1]) @ self.target.T + self.bias
        top_one, top_two = one.max(axis=1), two.max(axis=1)
        norm = np.exp(one - top_one[:, None]) @ np.exp(two - top_two[:, None]).T
        norm = np.log(np.maximum(norm, 1e-300)) + top_one[:, None] + top_two[None, :]
        return one.astype(np.float32), two.astype(np.float32), norm.astype(np.float32)


class Trainer:
    """Minibatch noise-contrastive estimation with Adagrad steps; noise is drawn once a batch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int, noise: int = NOISE, rate: float = RATE):
        self.m = LogBilinear(model.target.copy(), model.context.copy(), model.bias.copy(), model.place.copy())
        self.noise, self.rate = noise, rate
        self.log_noise = np.log(noise * unigram)
        self.edges, self.random = np.cumsum(unigram), np.random.default_rng(seed)
        self.past = [np.full_like(x, 1e-2) for x in (self.m.target, self.m.context, self.m.bias, self.m.place)]

    def step(self, word: np.ndarray, one: np.ndarray, two: np.ndarray) -> float:
        """The noise's matrix is in single precision, all sums and parameters are in double."""
        m, size = self.m, len(word)
        drawn = np.minimum(np.searchsorted(self.edges, self.random.random(self.noise)), len(self.edges) - 1)
        first, second, goal = m.context.take(one, axis=0), m.context.take(two, axis=0), m.target.take(word, axis=0)
        hidden = first * m.place[0] + second * m.place[1]
        real = np.einsum("ij,ij->i", hidden, goal) + m.bias[word] - self.log_noise[word]
        single, other = hidden.astype(np.float32), m.target[drawn].astype(np.float32)
        fake = single @ other.T
        fake += (m.bias[drawn] - self.log_noise[drawn]).astype(np.float32)
        g_real = 1 / (1 + np.exp(-np.clip(real, -30, 30))) - 1
        np.clip(fake, -30, 30, out=fake)
        np.exp(np.negative(fake, out=fake), out=fake)
        fake += 1
        g_fake = np.reciprocal(fake, out=fake)
        d_hidden = g_real[:, None] * goal + g_fake @ other
        rows, begins, order = _same(np.concatenate((word, drawn)))
        parts = np.concatenate((g_real[:, None] * hidden, g_fake.T @ single))
        self._move(0, rows, np.add.reduceat(parts.take(order, axis=0), begins) / size)
        self._move(2, rows, np.add.reduceat(np.concatenate((g_real, g_fake.sum(axis=0, dtype=np.float64)))[order], begins) / size)
        place = np.stack(((d_hidden * first).sum(axis=0), (d_hidden * second).sum(axis=0)))
        rows, begins, order = _same(np.concatenate((one, two)))
        parts = np.concatenate((d_hidden * m.place[0], d_hidden * m.place[1]))
        self._move(1, rows, np.add.reduceat(parts.take(order, axis=0), begins) / size)
        self._move(3, slice(None), place / size)
        return float(-np.log1p(-np.minimum(-g_real, 1 - 1e-9)).mean())

    def _move(self, k: int, rows: np.ndarray | slice, g: np.ndarray) -> None:
        """One step of some rows of the parameter ``k``; a row without gradient would not move."""
        x, past = (self.m.target, self.m.context, self.m.bias, self.m.place)[k], self.past[k]
        sums = past[rows] + g * g
        past[rows] = sums
        x[rows] -= self.rate * g / np.sqrt(sums)


def _same(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ids, where the group of each begins in the sorted order, and that order."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[begins], begins, order


@cache
def _lookup(words: tuple[bytes, ...]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(words)}


def _examples(ids: np.ndarray, start: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, one before, two before) at every ``stride``-th place of a text's model ids."""
    padded = np.concatenate(([END, END], ids))
    at = np.arange(start, len(ids), stride)
    return ids[at], padded[at + 1], padded[at]


def train_round(docs: DataFrame, words: list[bytes], unigram: np.ndarray, model: LogBilinear, turn: int, stride: int = ROUNDS) -> LogBilinear:
    """Round ``turn`` of ``stride`` over all texts of ``docs``: partitions train apart, then average by examples seen."""
    flat, size, width = model.flat(), *model.target.shape
    parts = math.ceil(len(flat) / 2048)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        trainer = Trainer(LogBilinear.of(flat, size, width), unigram, seed=1000 * turn + task)
        known, seen, waiting, ready = _lookup(tuple(words)), 0, [], 0
        for batch in batches:
            for raw in raw_texts(batch.column("text")):
                ids = np.array([known.get(w, -1) for w in words_of(raw)], np.int64)
                ids = np.append(np.where(ids < 0, REST, ids + 2), END)
                waiting.append(_examples(ids, (zlib.crc32(raw) + turn) % stride, stride))
                ready += len(waiting[-1][0])
                if ready >= BATCH:
                    word, one, two = (np.concatenate(c) for c in zip(*waiting))
                    whole = ready - ready % BATCH
                    for k in range(0, whole, BATCH):
                        trainer.step(word[k:k + BATCH], one[k:k + BATCH], two[k:k + BATCH])
                    waiting, ready, seen = [(word[whole:], one[whole:], two[whole:])], ready - whole, seen + whole
        if ready:
            word, one, two = (np.concatenate(c) for c in zip(*waiting))
            trainer.step(word, one, two)
            seen += ready
        if seen:
            summed = trainer.m.flat() * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(parts), pa.int32()), pa.array([task // SPREAD] * parts, pa.int32()), pa.array([float(seen)] * parts),
                 pa.array([summed[k * 2048:(k + 1) * 2048].tobytes() for k in range(parts)], pa.binary())],
                names=["part", "shard", "seen", "total"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.float64) for x in rows["total"]], axis=0)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "shard": [rows["shard"].iloc[0]], "seen": [rows["seen"].sum()], "total": [total.tobytes()]})

    schema = "part int, shard int, seen double, total binary"
    shards = docs.select("text").mapInArrow(run, schema).groupBy("part", "shard").applyInPandas(add, schema)
    rows = shards.groupBy("part").applyInPandas(add, schema).collect()  # one model
    if not rows:
        return model
    rows.sort(key=lambda r: r["part"])
    return LogBilinear.of(np.concatenate([np.frombuffer(r["total"], np.float64) / r["seen"] for r in rows]), size, width)


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    net: LogBilinear


def train(docs: DataFrame, counts: DataFrame, size: int = VOCABULARY, width: int = WIDTH, rounds: int = ROUNDS) -> Model:
    """Fit to all texts of ``docs``, whose word counts are ``counts``."""
    known = vocabulary(counts, size)
    unigram = known.unigram()
    net = LogBilinear.start(unigram, width)
    for turn in range(rounds if known.tokens else 0):
        net = train_round(docs, known.words[:known.in_model], unigram, net, turn, rounds)
    return Model(known, net)


_TABLES: dict[int, tuple] = {}


def _score_texts(model: Model):
    known = model.vocabulary
    words, flat, size, width = tuple(known.words), model.net.flat(), *model.net.target.shape
    in_model = known.in_model
    base_all = math.log10(known.tokens + known.distinct + 1)
    rest_all = math.log10(known.rest_tokens + known.rest_distinct + 1)
    log_count = np.log10(known.counts + 1.0)
    log_end = math.log10(known.ends + 1)
    ends = known.ends
    mark = zlib.crc32(flat.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _TABLES:  # one model is kept by a worker
            _TABLES.clear()
            _TABLES[mark] = (*LogBilinear.of(flat, size, width).tables(), {w: i for i, w in enumerate(words)})
        one, two, norm, lookup = _TABLES[mark]
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "n_tokens", "n_known", "base", "model", "words", "times")}
            for raw in raw_texts(batch.column("text")):
                text = words_of(raw)
                at = np.array([lookup.get(w, -1) for w in text], np.int64)
                tail = Counter(text[i] for i in np.flatnonzero(at < 0))
                head = at[at >= 0]
                base = log_count[head].sum() + log_end - base_all * (len(text) + 1)
                ids = np.append(np.where((at < 0) | (at >= in_model), REST, at + 2), END)
                padded = np.concatenate(([END, END], ids))
                first, second = padded[1:-1], padded[:-2]
                log_p = one[first, ids].astype(np.float64) + two[second, ids] - norm[first, second]
                total = log_p.sum() / math.log(10) + log_count[head[head >= in_model]].sum() - rest_all * int((ids == REST).sum())
                out["row"].append((task << 40) | row)
                out["n_tokens"].append(len(text) + 1)
                out["n_known"].append(len(head) + (ends > 0))
                out["base"].append(float(base))
                out["model"].append(float(total))
                out["words"].append(list(tail))
                out["times"].append(list(tail.values()))
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            arrays = [pa.array(v, k) for v, k in zip(out.values(), kinds)]
            arrays[5] = arrays[5].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names=["doc_id", "held_out", *out])

    return run


def score(docs: DataFrame, may_learn: Column, size: int = VOCABULARY, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (smoothed unigram) and score (the model), both log10."""
    prepare(docs.sparkSession)
    read = docs.select("doc_id", "text", (~may_learn).alias("held_out"))
    learned = read.filter("NOT held_out").select("text")
    counts = stored(count_words(learned), "words")
    model = train(learned, counts, size, width, rounds)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(read.mapInArrow(_score_texts(model), f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, "
                                                       "model double, words array<string>, times array<long>"), "scored")
    tail = (rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("t"))
            .select("row", F.col("t.words").alias("word"), F.col("t.times").alias("times"))
            .join(counts, "word", "left")
            .groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("logs"),
                                F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known")))
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.drop("words", "times").join(tail, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """``score`` with the fold ``held`` of crc32(doc_id) held out."""
    return score(docs, F.coalesce(fold(F.col("doc_id"), folds) != held, F.lit(False)))
