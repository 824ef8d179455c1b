"""Token counts by overlap resynchronisation.

A text of up to ``chunk`` characters is encoded whole.  A longer one is cut
into overlapping chunks that are spread over the cluster, each encoded with
the offsets of its tokens.  Two neighbours are spliced at a boundary that both
found in their overlap and that is proven stable: a byte-level pre-tokenizer
reads left to right and looks no further than one character beyond a match, so
a pre-token boundary of the left chunk is one of the whole text unless it lies
in the last pre-token or within a special string's length of the chunk's end;
and from a common boundary on, the right chunk reads as the whole text does.
Where two neighbours share none, they are joined into one wider chunk with a
wider overlap and encoded again, until all splices hold.

Short texts are encoded through a bounded memo of space-separated pieces.  In
text whose spaces are all single, with none at the end and no special string,
the position before a space is always a pre-token boundary, so the pieces'
counts add up to the library's count; other texts go to the library whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows and
null ids each get their own count; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from cargolake.llm.common import per_text, prepare, raw_texts, stored

CHUNK, OVERLAP = 32_768, 512
MEMO = 200_000  # pieces remembered per worker
LONGEST_PIECE = 64  # longer pieces are not remembered


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class PieceCounts(dict):
    """Tokens of a space and the piece after it; bounded."""

    def __init__(self, path: str):
        super().__init__()
        self.encode = tokenizer(path).encode

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(" " + piece, add_special_tokens=False).ids)
        if len(self) < MEMO and len(piece) <= LONGEST_PIECE:
            self[piece] = n
        return n


@cache
def memo(path: str) -> PieceCounts:
    return PieceCounts(path)


@cache
def special_strings(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())


def count_tokens(text: str, path: str) -> int:
    if not text:
        return 0
    if "  " in text or text[-1] == " " or any(s in text for s in special_strings(path)):
        return len(tokenizer(path).encode(text, add_special_tokens=False).ids)
    first, *rest = text.split(" ")
    head = len(tokenizer(path).encode(first, add_special_tokens=False).ids) if first else 0
    return head + sum(map(memo(path).__getitem__, rest))


def boundaries(text: str, path: str) -> tuple[list[int], list[int], int]:
    """Offsets at which a pre-token begins, the number of tokens before each, and the number of all tokens."""
    encoding = tokenizer(path).encode(text, add_special_tokens=False)
    places, before, last = [], [], None
    for i, ((start, _), word) in enumerate(zip(encoding.offsets, encoding.word_ids)):
        if i == 0 or word != last:
            places.append(start)
            before.append(i)
            last = word
    return places, before, len(encoding.ids)


PIECES = "id string, part int, start long, reach_head int, reach_tail int, piece string"
SUMMARY = "id string, part int, reach_head int, head array<long>, head_n array<long>, tail array<long>, tail_n array<long>, n long"


def _cut(chunk: int, overlap: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("id").to_pylist(), raw_texts(batch.column("text"))):
                text = raw.decode()
                starts = list(range(0, max(1, len(text) - overlap), chunk - overlap))
                for at in range(0, len(starts), 64):
                    some = starts[at:at + 64]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(some)), pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.int64()),
                        pa.array([overlap if p else 0 for p in some], pa.int32()),
                        pa.array([0 if p == starts[-1] else overlap for p in some], pa.int32()),
                        pa.array([text[p:p + chunk] for p in some]),
                    ], names=["id", "part", "start", "reach_head", "reach_tail", "piece"])

    return run


def _encode(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = max((len(s) for s in special_strings(path)), default=0) + 1
        for batch in batches:
            rows = []
            meta = zip(*(batch.column(k).to_pylist() for k in ("id", "part", "start", "reach_head", "reach_tail")))
            for (key, part, start, reach_head, reach_tail), raw in zip(meta, raw_texts(batch.column("piece"))):
                text = raw.decode()
                places, before, n = boundaries(text, path)
                found = list(zip(places, before))
                head = [x for x in found if 0 < x[0] <= reach_head]
                # the last pre-token may read on beyond the chunk, and so may a special string
                tail = [x for x in found[:-1] if len(text) - reach_tail <= x[0] <= len(text) - margin] if reach_tail else []
                rows.append((key, part, reach_head, [p + start for p, _ in head], [c for _, c in head],
                             [p + start for p, _ in tail], [c for _, c in tail], n))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.int64()]
            names = ["id", "part", "reach_head", "head", "head_n", "tail", "tail_n", "n"]
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds)], names=names)

    return run


def _spliced(summary: DataFrame) -> DataFrame:
    """Per text: n_tokens, null where two neighbours share no stable boundary."""
    order = Window.partitionBy("id").orderBy("part")
    seen = summary.select("*", *[F.lag(c).over(order).alias(f"left_{c}") for c in ("tail", "tail_n", "n")])
    common = F.array_min(F.array_intersect("left_tail", "head"))
    cut = seen.withColumn("at", F.when(F.col("part") > 0, common))
    left = F.expr("left_tail_n[array_position(left_tail, at) - 1]")
    right = F.expr("head_n[array_position(head, at) - 1]")
    own = F.when(F.col("part") == 0, F.col("n")).when(F.col("at").isNotNull(), F.col("n") - right - (F.col("left_n") - left))
    return cut.withColumn("own", own).groupBy("id").agg(
        F.when(F.count(F.lit(1)) == F.count("own"), F.sum("own")).alias("n_tokens"))


def _long_counts(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(id, n_tokens) of texts (id, text) longer than ``chunk``."""
    spark = texts.sparkSession
    # equal texts of one id are counted once; chunks are heavy, so their tasks are not merged by bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    done, todo = None, texts.dropDuplicates(["id"])
    while True:
        pieces = todo.mapInArrow(_cut(chunk, overlap), PIECES).repartition(tasks, "id", "part")
        summary = pieces.mapInArrow(_encode(path), SUMMARY)
        counts = stored(_spliced(summary), "splices")
        settled = counts.filter("n_tokens IS NOT NULL")
        done = settled if done is None else done.unionByName(settled)
        failed = counts.filter("n_tokens IS NULL")
        if failed.isEmpty():
            return done
        todo = texts.join(failed.select("id"), "id", "left_semi")
        chunk, overlap = chunk * 4, overlap * 8 if overlap * 16 <= chunk * 4 else chunk


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    if not 0 < overlap * 2 < chunk:
        raise ValueError("an overlap is less than half a chunk")
    prepare(docs.sparkSession)
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col), text.alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    count = per_text([("n", pa.int64())], "n long", lambda raw: (count_tokens(raw.decode(), path),))
    short = read.filter(F.length("text") <= chunk).select(id_col, size, count(F.col("text")).getField("n").alias("n_tokens"))
    key = F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64("text").cast("string"), F.length("text").cast("string"))
    long = read.filter(F.length("text") > chunk).select(id_col, "text", key.alias("id"))
    counts = _long_counts(long.select("id", "text"), path, chunk, overlap)
    spliced = long.select(id_col, size, "id").join(counts, "id").select(id_col, "n_bytes", "n_tokens")
    return short.unionByName(spliced).withColumn("over_limit", F.col("n_tokens") > limit)
