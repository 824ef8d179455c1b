"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolake.session import checkpoint_dir, ship_package

# Rows per Arrow batch.  Texts are unbounded, so a batch is kept short: its
# memory is about this many times the mean text length, not ten times that.
ROWS_PER_BATCH = 1000


def prepare(spark: SparkSession) -> None:
    """Make this package importable on the workers and keep Arrow batches short."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the
    lineage ends there, so a lost executor costs one read, not the work."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def hash_rate(id_col: Column, rate: float) -> Column:
    """True for about ``rate`` of all ids, always the same ones."""
    return F.pmod(F.xxhash64(id_col, F.lit("rate")), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000) + 1)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, one at a time; null gives no bytes."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    for value in binary:
        yield value.as_py() or b""


def struct_array(fields: list[tuple[str, pa.DataType]], columns: list[list]) -> pa.StructArray:
    arrays = [pa.array(values, type=kind) for (_, kind), values in zip(fields, columns, strict=True)]
    return pa.StructArray.from_arrays(arrays, names=[name for name, _ in fields])


def per_text(fields: list[tuple[str, pa.DataType]], ddl: str, row: Callable[[bytes], tuple]):
    """A vectorised function of one text column: ``row`` maps the bytes of a
    text to the values of ``fields``; Spark sees a struct column."""

    @F.arrow_udf(ddl)
    def apply(column: pa.Array) -> pa.Array:
        rows = [row(text) for text in raw_texts(column)]
        return struct_array(fields, [list(values) for values in zip(*rows)] or [[] for _ in fields])

    return apply
