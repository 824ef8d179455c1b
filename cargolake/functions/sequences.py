"""Skew-safe per-key sequence primitives: previous value and position.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task;
when one key holds a third of the data that task is the whole job.  Here
each key is cut into chunks by a caller-given ``chunk`` column that is
monotone in the ordering (typically the hour of the event time).  Rows are
processed by (key, chunk) - a hot key spreads over as many tasks as it has
chunks - and chunk boundaries are stitched with a carry table holding one
row per (key, chunk): bounded by keys x chunks, never by the rows of a key.

Everything is a deterministic function of the data (no partition ids), so
recomputation after an executor loss gives identical results.

Requirements: ``key + order`` identifies a row (add a sequence column to
break ties) and ``chunk`` never decreases along ``order`` within a key
(nulls sort first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_chunk(df: DataFrame, key: list[str], chunk: Column) -> DataFrame:
    """Add ``_at``, the key and its chunk as one struct.  Structs compare null
    fields as equal, so windows, aggregates and the stitch join all hash the
    same column: the rows are shuffled once, null keys and chunks included."""
    return df.withColumn("_at", F.struct(*[F.col(c) for c in key], chunk.alias("_chunk")))


def _over_chunks(key: list[str]):
    """The chunks of a key in order (null first)."""
    return Window.partitionBy(*[F.col(f"_at.{c}") for c in key]).orderBy(F.col("_at._chunk").asc_nulls_first())


def hour_chunk(ts_col: str) -> Column:
    """Default chunking: the hour of a timestamp (null stays null = first)."""
    return F.date_trunc("hour", F.col(ts_col))


def seq_chunk(seq_col: str, rows: int = 1 << 16) -> Column:
    """Chunking by ranges of a whole-number sequence column."""
    return F.floor(F.col(seq_col) / F.lit(rows))


def keyed_last(df: DataFrame, key: list[str], order: list[str], value: str, chunk: Column, name: str) -> DataFrame:
    """Add ``name``: the last known (non-null) ``value`` in an earlier row of the
    same key (null: none)."""
    s = _with_chunk(df, key, chunk)
    before = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = s.withColumn("_near", F.last(value, ignorenulls=True).over(before))
    last = (s.groupBy("_at")
            .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) for c in order]))).alias("_known")))
    earlier = _over_chunks(key).rowsBetween(Window.unboundedPreceding, -1)
    carry = last.withColumn("_far", F.last("_known", ignorenulls=True).over(earlier)).select("_at", "_far")
    out = local.join(carry, "_at", "left")
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_at")


def keyed_lag(df: DataFrame, key: list[str], order: list[str], cols: list[str], chunk: Column,
              prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>``: the value of ``c`` in the previous row of the same key
    (null on the key's first row), for every c in ``cols``."""
    s = _with_chunk(df, key, chunk)
    w = Window.partitionBy("_at").orderBy(*order)
    local = s.withColumn("_first", F.row_number().over(w) == 1)
    for c in cols:
        local = local.withColumn(f"_lag_{c}", F.lag(c).over(w))
    ordering = F.struct(*[F.col(c) for c in order])
    last = (s.groupBy("_at")
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), ordering).alias("_last")))
    carry = last.withColumn("_carry", F.lag("_last").over(_over_chunks(key))).select("_at", "_carry")
    out = local.join(carry, "_at", "left")
    for c in cols:
        out = out.withColumn(f"{prefix}{c}",
                             F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(f"_lag_{c}")))
    return out.drop("_first", "_carry", "_at", *[f"_lag_{c}" for c in cols])


def crowded(df: DataFrame, key: list[str], rows: int = 1 << 16) -> DataFrame:
    """``df`` with ``_crowded``: true for all keys of more than ``rows`` rows (and
    for few others, whose hash meets theirs), false elsewhere.  Only hashes are
    counted and shuffled; there are at most total / ``rows`` crowded ones."""
    mark = F.xxhash64(*key)
    many = df.select(mark.alias("_mark")).groupBy("_mark").count().where(F.col("count") > rows).select("_mark", F.lit(True).alias("_many"))
    return (df.withColumn("_mark", mark).join(F.broadcast(many), "_mark", "left")
            .withColumn("_crowded", F.col("_many").isNotNull()).drop("_mark", "_many"))


def keyed_position(df: DataFrame, key: list[str], order: list[str], chunk: Column, name: str = "position",
                   start: int = 1) -> DataFrame:
    """Add a gap-free position of each row within its key, starting at
    ``start``: local row number inside the (key, chunk) + the row counts of
    the key's earlier chunks (a prefix sum over the small count table)."""
    s = _with_chunk(df, key, chunk)
    w = Window.partitionBy("_at").orderBy(*order)
    local = s.withColumn("_local", F.row_number().over(w))
    counts = s.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    w_prev = _over_chunks(key).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w_prev), F.lit(0))).select("_at", "_before")
    out = local.join(before, "_at", "left")
    return (out.withColumn(name, (F.col("_local") + F.col("_before") + F.lit(start - 1)).cast("bigint"))
            .drop("_local", "_before", "_at"))


def newest_first(df: DataFrame, key: str, ts_col: str, tie: str, name: str) -> DataFrame:
    """Add the position of each row within its key, newest first (null times
    last), in chunks of a day."""
    days_back = F.datediff(F.lit("9999-12-31").cast("date"), F.col(ts_col).cast("date"))
    return keyed_position(df, [key], [F.col(ts_col).desc_nulls_last(), F.col(tie).desc_nulls_last()],
                          F.coalesce(days_back, F.lit(1 << 30)), name)
