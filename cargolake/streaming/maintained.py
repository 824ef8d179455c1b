"""Statistics kept up from a change feed instead of computed anew.

A result row is a group's partial state: the number of rows, sums of whole numbers
(counts, microseconds, gas; as decimals, since some ten thousand durations of thirty
years pass the range of a long) and, where an extreme is wanted, how often each value
occurs.  All of these can be taken back, so a changed row is its old version with
weight -1 and its new one with weight 1; a group without rows goes.  Deltas are
added up per group with map-side combine before they meet the stored state, and
only the buckets of the groups that they name are read and written
(``store.SnapshotStore``).  A change set that is applied again under its batch
number changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolake.streaming.store import Change, SnapshotStore

TOTAL = "decimal(38,0)"


def microseconds(later: str, earlier: str) -> Column:
    """Whole microseconds between two times: sums of them are exact in any order."""
    return ((F.col(later) - F.col(earlier)).cast("interval second").cast("decimal(20,6)") * 1_000_000).cast("bigint")


@dataclass(frozen=True)
class Statistic:
    """``keys`` and ``sums`` by name (a null adds nothing), and the column whose extremes are wanted."""

    keys: dict[str, Column]
    sums: dict[str, Column]
    extremes: Column | None = None

    def rows(self, df: DataFrame, weight: int) -> DataFrame:
        keys = [c.alias(k) for k, c in self.keys.items()]
        sums = [(F.coalesce(c.cast("bigint"), F.lit(0)) * weight).cast(TOTAL).alias(s) for s, c in self.sums.items()]
        value = (F.lit(None).cast("int") if self.extremes is None else self.extremes).alias("value")
        found = df.select(*keys, F.lit(weight).cast("bigint").alias("n"), *sums, value)
        return found.withColumn("group", F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}))

    def added(self, rows: DataFrame) -> DataFrame:
        names = ["n", *self.sums]
        return rows.groupBy("group", *self.keys).agg(*[F.sum(c).alias(c) for c in names])

    def values(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("value").isNotNull()).groupBy("group", "value").agg(F.sum("n").alias("n")).where("n <> 0")


def _status(*names: str) -> Column:
    return F.upper(F.trim("status")).isin(*names).cast("int")


def saga_statistic() -> Statistic:
    """A2."""
    ended = F.col("completed_at").isNotNull() & F.col("started_at").isNotNull()
    return Statistic({"saga_type": F.col("saga_type")}, {
        "completed": _status("COMPLETED"), "failed": _status("FAILED"), "cancelled": _status("CANCELLED"),
        "in_progress": _status("STARTED", "COMPENSATING"), "duration_us": F.when(ended, microseconds("completed_at", "started_at")),
        "durations": ended.cast("int"), "retry_sum": F.col("retry_count"), "retries": F.col("retry_count").isNotNull().cast("int")},
        F.col("retry_count"))


def daily_chain_statistic() -> Statistic:
    """A5."""
    timed = F.col("confirmed_at").isNotNull() & F.col("created_at").isNotNull()
    return Statistic({"transaction_date": F.to_date("created_at"), "network": F.col("network")}, {
        "confirmed": _status("CONFIRMED"), "failed": _status("FAILED"), "gas": F.col("gas_used"),
        "gas_rows": F.col("gas_used").isNotNull().cast("int"), "duration_us": F.when(timed, microseconds("confirmed_at", "created_at")),
        "durations": timed.cast("int")})


def _mean(total: str, n: str, unit: float = 1.0) -> Column:
    return F.round(F.col(total).cast("double") / F.nullif(F.col(n), F.lit(0)).cast("double") / unit, 6)


def _whole(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


@dataclass
class Maintained:
    store: SnapshotStore
    statistic: Statistic

    @classmethod
    def start(cls, spark: SparkSession, path: str, rows: DataFrame, statistic: Statistic, buckets: int = 16) -> Maintained:
        marked = statistic.rows(rows, 1)
        tables = {"sums": (statistic.added(marked), "group"), "values": (statistic.values(marked), "group")}
        return cls(SnapshotStore.create(spark, path, tables, buckets), statistic)

    def apply(self, batch: int, before: DataFrame, after: DataFrame) -> bool:
        """Take ``before`` (the changed rows as they were counted) out and ``after`` in."""
        s = self.statistic
        delta = s.rows(before, -1).unionByName(s.rows(after, 1))
        sums, values = s.added(delta), s.values(delta)
        path = f"{self.store.path}/delta/batch={batch}"
        for name, df in (("sums", sums), ("values", values)):  # written, as keys and rows are read from them
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        read = self.store.spark.read
        sums, values = read.schema(sums.schema).parquet(f"{path}/sums"), read.schema(values.schema).parquet(f"{path}/values")
        return self.store.commit(batch, {
            "sums": Change(sums.select("group"), lambda old: s.added(old.unionByName(sums.select(old.columns))).where("n <> 0")),
            "values": Change(values.select("group"), lambda old: s.values(old.unionByName(values.select(old.columns))))})

    def table(self) -> DataFrame:
        """One row a group: keys, n, sums, least and most of the value."""
        ends = self.store.read("values").groupBy("group").agg(F.min("value").alias("least"), F.max("value").alias("most"))
        return self.store.read("sums").join(ends, "group", "left").drop("group")


def saga_statistics(state: Maintained) -> DataFrame:
    """A2 from its maintained state."""
    return state.table().select(
        "saga_type", F.col("n").alias("total_sagas"), *map(_whole, ("completed", "failed", "cancelled", "in_progress")),
        _mean("duration_us", "durations", 1e6).alias("avg_duration_seconds"), F.col("most").alias("max_retry_count"),
        _mean("retry_sum", "retries").alias("avg_retry_count"))


def daily_blockchain_statistics(state: Maintained) -> DataFrame:
    """A5 from its maintained state."""
    return state.table().select(
        "transaction_date", "network", F.col("n").alias("total_transactions"), _whole("confirmed"), _whole("failed"),
        F.when(F.col("gas_rows") > 0, F.col("gas").cast("bigint")).alias("total_gas_used"),
        _mean("duration_us", "durations", 1e6).alias("avg_confirmation_time_seconds"))
