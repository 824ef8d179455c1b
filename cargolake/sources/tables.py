"""Table scans (S10) and the fixture-view catalog the operators run on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from cargolake.sources import fixtures


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table.  Parquet gives column pruning and filter
    pushdown for free; nothing here forces a schema inference pass."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return spark.read.parquet(path)


class Tables:
    """Lazily built DataFrames for the base tables and fixture views of one
    data directory.

    Fixture views are defined in SQL (the text shared with the DuckDB
    oracle).  Temp-view names are session-global, so base tables are
    re-registered right before each view is analysed; the analysed plan is
    bound at that moment and later registrations cannot leak into it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._base: dict[str, DataFrame] = {}
        self._views: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        if name not in self._base:
            self._base[name] = read_table(self.spark, self.sf_dir, name)
        return self._base[name]

    def _register_inputs(self, sql: str) -> None:
        for name in fixtures.BASE_TABLES:
            if fixtures.re.search(rf"\b{name}\b", sql):
                self.base(name).createOrReplaceTempView(name)
        for name in fixtures.VIEW_NAMES:
            if fixtures.re.search(rf"\b{name}\b", sql):
                self.view(name).createOrReplaceTempView(name)

    def view(self, name: str) -> DataFrame:
        if name not in self._views:
            sql = fixtures.view_sql(name, "spark")
            self._register_inputs(sql)
            self._views[name] = self.spark.sql(sql)
        return self._views[name]

    def sql(self, text: str) -> DataFrame:
        """Run Spark SQL over the base tables and fixture views."""
        self._register_inputs(text)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in fixtures.VIEW_NAMES:
            return self.view(name)
        if name in fixtures.BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
