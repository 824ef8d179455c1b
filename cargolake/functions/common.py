"""Scalar helpers built only from JVM-side Spark functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds_between(later, earlier) -> Column:
    """EXTRACT(EPOCH FROM later - earlier) as DOUBLE seconds (microsecond exact).

    Built on the exact day-time interval ``later - earlier`` so the result
    does not depend on the session time zone (zone-less inputs stay
    zone-less; ``timestamp_diff`` would shift across DST changes)."""
    return (col(later) - col(earlier)).cast("interval second").cast("decimal(20,6)").cast("double")


def ts_lit(value: str) -> Column:
    """A zone-less timestamp literal (fixtures are TIMESTAMP_NTZ)."""
    return F.expr(f"timestamp_ntz '{value}'")


def upper_trim(c) -> Column:
    return F.upper(F.trim(col(c)))


def normalised(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with these statuses written as they are compared, and marked so:
    the mark is column metadata, which Parquet files keep."""
    for name in names:
        df = df.withColumn(name, upper_trim(name)).withMetadata(name, {"normalised": True})
    return df


def status_of(df: DataFrame, name: str = "status") -> Column:
    """A status of ``df`` as it is compared.  Where the column is marked as
    normalised it is compared bare, so that a filter reaches the scan."""
    return F.col(name) if df.schema[name].metadata.get("normalised") else upper_trim(name)


def is_distinct(a, b) -> Column:
    """SQL ``a IS DISTINCT FROM b``."""
    return ~col(a).eqNullSafe(col(b))


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The smallest row of each key by ``order`` (nulls first): the same row on
    every run, unlike ``dropDuplicates``; combined map-side."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select("_row.*")
