"""The consuming workers as streams: each micro-batch is applied once to stored
snapshots (``store.SnapshotStore``), or goes through a stateful stream operator.

* ``split_stream`` (S3): one parse of an envelope log, two sinks.
* ``Compensation`` (T4, J6): failure events against a saga snapshot that changes.
* ``CommandWorker`` (T6a-T6d) and ``UpsertWorker`` (U1): commands and change sets
  applied to bucketed snapshots.
* ``confirmations`` (T8, J8): pending records wait for receipts in a
  stream-stream outer join, bounded in event time on both sides.
* ``LateAudit``: rows that come behind the watermark go to an audit.
* ``CounterIncrease`` (M9): the increase of counters that restart, from samples
  that arrive out of order.

A worker's outputs are written to a folder of the batch before the store commits
the batch.  A batch that is repeated before its commit rewrites equal files from
the same snapshot; one that is repeated after it is skipped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cargolake import schemas
from cargolake.functions.common import status_of, ts_lit
from cargolake.operators import chain, metrics, sagas
from cargolake.operators import writes as w
from cargolake.sources import envelopes
from cargolake.streaming.feeds import as_event_time
from cargolake.streaming.store import Change, SnapshotStore


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand every available micro-batch to ``handle``, going on where ``checkpoint`` left off."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def put(df: DataFrame, path: str, batch: int | str) -> DataFrame:
    """``df`` as the part of ``path`` that belongs to ``batch``, read back: a repeated batch replaces its own part."""
    part = f"{path}/batch={batch}"
    df.write.mode("overwrite").parquet(part)
    return df.sparkSession.read.schema(df.schema).parquet(part)


def parts(spark: SparkSession, path: str, schema) -> DataFrame:
    """All parts of ``path``."""
    return spark.read.schema(schema).parquet(path)


# ---- S3: two sinks

def split_stream(log: DataFrame, good_path: str, bad_path: str, checkpoint: str, value_col: str = "value") -> StreamingQuery:
    """S1/S3 (stream): each micro-batch of a log is parsed once; typed events go to one sink, rejects with
    their reason to the other.  Both parts carry the batch's number."""
    def handle(batch: DataFrame, number: int) -> None:
        parsed = envelopes.parse_events(batch, value_col).persist()
        try:
            put(envelopes.accepted_events(parsed, batch.columns, value_col), good_path, number)
            put(envelopes.quarantine(parsed, value_col), bad_path, number)
        finally:
            parsed.unpersist()

    return drain(log, checkpoint, handle)


# ---- T4/J6: compensation as events arrive

EVENT = "event_id, event_type, correlation_id, payload, ts"


@dataclass
class Compensation:
    """T4 on a stream: failure events meet the stored sagas of the moment.

    Which failure of a saga fires is a matter of event time, not of arrival: the
    earliest by (ts, event_id).  So a saga's failures wait until the running
    watermark (the largest ts of earlier batches less ``hold``) has passed the
    first of them; then they are planned together, and the saga's stored row turns
    to FAILED, which is how later failures of it are known to be too late.
    ``finish`` plans what still waits.  Repeated events: ``events`` should drop
    them first (``feeds.dedup_stream``, whose state the watermark bounds); those
    still waiting are also dropped here.

    The store holds ``sagas`` (by saga_id) and ``waiting`` (by correlation_id), which
    holds no more than the failures of the last ``hold``.  A batch reads and
    rewrites only the buckets of the sagas it names.  Outcomes, commands and saga
    updates are written under ``out``."""

    store: SnapshotStore
    out: str
    hold: dt.timedelta = dt.timedelta(minutes=10)

    @classmethod
    def start(cls, spark: SparkSession, path: str, sagas_now: DataFrame, events_schema, out: str, buckets: int = 16,
              hold: dt.timedelta = dt.timedelta(minutes=10)) -> Compensation:
        waiting = spark.createDataFrame([], events_schema).select(*EVENT.split(", "))
        store = SnapshotStore.create(spark, path, {"sagas": (sagas_now, "saga_id"), "waiting": (waiting, "correlation_id")}, buckets)
        return cls(store, out, hold)

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(events, checkpoint, self.handle)

    def handle(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.applied():
            return
        facts = self.store.facts()
        failures = batch.where(F.col("event_type").isin(*schemas.COMPENSATION_TRIGGER_EVENTS)).select(*EVENT.split(", "))
        seen = batch.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0]
        if seen is None:  # a batch without events moves nothing
            return
        latest = max(filter(None, (facts.get("latest"), seen.isoformat() if seen else None)), default=None)
        self._plan(failures, number, facts.get("latest"), {"latest": latest})

    def finish(self) -> None:
        """Plan all that waits: the log has ended."""
        none = self.store.read("waiting").limit(0)
        self._plan(none, None, None, self.store.facts(), everything=True)

    def _plan(self, failures: DataFrame, batch: int | None, latest: str | None, facts: dict, everything: bool = False) -> None:
        number = f"end{self.store.version()}" if batch is None else batch
        waiting = self.store.read("waiting")
        pool = put(waiting.unionByName(failures).dropDuplicates(["event_id"]), f"{self.out}/pool", number)
        bound = F.lit(None).cast("timestamp_ntz") if latest is None else ts_lit(str(dt.datetime.fromisoformat(latest) - self.hold))
        first = pool.where(F.col("correlation_id").isNotNull()).groupBy("correlation_id").agg(F.min(F.col("ts").cast("timestamp_ntz")).alias("_first"))
        ripe = F.lit(True) if everything else F.col("_first") <= bound
        due = first.where(ripe).select("correlation_id")
        now = pool.join(due, "correlation_id", "left_semi").unionByName(pool.where(F.col("correlation_id").isNull()))
        now = put(now, f"{self.out}/due", number)

        named = now.select("correlation_id").where(F.col("correlation_id").isNotNull()).distinct()
        held = self.store.touched("sagas", named)
        outcomes, commands, updates = sagas.plan_compensation(now, self.store.read("sagas", held))
        put(outcomes, f"{self.out}/outcomes", number)
        put(commands, f"{self.out}/commands", number)
        done = put(updates, f"{self.out}/updates", number)

        failed = done.where("status = 'FAILED'").select("saga_id", F.col("status").alias("_status"), F.col("failed_step").alias("_step"))

        def fail(stored: DataFrame) -> DataFrame:
            met = stored.join(failed, "saga_id", "left")
            return met.withColumn("status", F.coalesce("_status", "status")).withColumn("failed_step", F.coalesce("_step", "failed_step"))

        # every stored row that waits is in the pool, and so are its bucket's other rows
        still = pool.where(F.col("correlation_id").isNotNull()).join(now.select("event_id"), "event_id", "left_anti")
        self.store.commit(batch, {
            "sagas": Change(failed.select("saga_id"), fail),
            "waiting": Change(pool.select("correlation_id").where(F.col("correlation_id").isNotNull()), lambda stored: still)}, facts)


# ---- T6, U1: commands and change sets on stored snapshots

@dataclass
class CommandWorker:
    """T6a-T6d (stream): release, unassign and cancel commands on stored tables.

    Tables: ``inventory`` and ``items`` by shipment_id, ``shipments`` by
    shipment_id, ``deliveries`` by delivery_id.  Reports of a batch (release counts,
    absent ids, deletions, commands that no worker handles) go to ``out``.  A batch
    writes the ids that it takes away and the rows that it changes beside the stored
    rows, so what it moves follows its commands, not the tables."""

    store: SnapshotStore
    out: str

    @classmethod
    def start(cls, spark: SparkSession, path: str, inventory: DataFrame, deliveries: DataFrame, shipments: DataFrame,
              items: DataFrame, out: str, buckets: int = 16) -> CommandWorker:
        return cls(SnapshotStore.create(spark, path, {
            "inventory": (inventory, "shipment_id"), "deliveries": (deliveries, "delivery_id"),
            "shipments": (shipments, "shipment_id"), "items": (items, "shipment_id")}, buckets, gather=False), out)

    def run(self, commands: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(commands, checkpoint, self.handle)

    def handle(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.applied():
            return
        commands = put(batch, f"{self.out}/commands", number)
        put(sagas.unknown_commands(commands), f"{self.out}/unknown", number)
        # the ids that the commands name, as the batch operators read them
        blank = {name: self.store.read(name).limit(0) for name in ("inventory", "deliveries", "shipments", "items")}
        _, asked = sagas.apply_release(commands, blank["inventory"])
        _, absent = sagas.apply_unassign(commands, blank["deliveries"])
        gone = sagas.apply_cancel(commands, blank["shipments"], blank["items"])[2]

        def named(table: str, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
            """The ids and the stored rows that have them: all that the batch can meet."""
            keys = put(ids.select(key).where(F.col(key).isNotNull()).distinct(), f"{self.out}/named/{table}", number)
            stored = self.store.read(table, self.store.touched(table, keys))
            return keys, put(stored.join(keys, key, "left_semi"), f"{self.out}/met/{table}", number)

        _, inventory = named("inventory", asked, "shipment_id")
        unassigned, deliveries = named("deliveries", absent, "delivery_id")
        cancelled, shipments = named("shipments", gone, "shipment_id")

        updates, report = sagas.apply_release(commands, inventory)
        put(report, f"{self.out}/released", number)
        put(sagas.apply_unassign(commands, deliveries)[1], f"{self.out}/absent", number)
        put(sagas.apply_cancel(commands, shipments, blank["items"])[2], f"{self.out}/cancelled", number)

        set_to = updates.select("record_id", F.col("new_status").alias("_new")).distinct()
        turned = inventory.join(set_to, "record_id", "left").withColumn("_old", F.col("status")).withColumn("status", F.coalesce("_new", "status"))
        # rows that keep their status are written only beside others of their shipment that do not
        moved = put(turned.where(~F.col("status").eqNullSafe(F.col("_old"))).select("shipment_id").distinct(), f"{self.out}/moved", number)
        fresh = turned.join(moved, "shipment_id", "left_semi").drop("_new", "_old")

        self.store.commit(number, {
            "inventory": Change(more=fresh, gone=moved),
            "deliveries": Change(gone=unassigned.join(deliveries, "delivery_id", "left_semi")),
            "shipments": Change(gone=cancelled.join(shipments, "shipment_id", "left_semi")),
            "items": Change(gone=cancelled)})


@dataclass
class UpsertWorker:
    """U1/U11 (stream): change sets upserted into a bucketed table.

    The store also keeps, by key, the order of the change that each row last took
    (``applied``), so a change that arrives late, in a later batch than its successor,
    does not overwrite it."""

    store: SnapshotStore
    table: str
    key: str
    columns: list[str]
    order: list[str]
    as_of: str

    @classmethod
    def start(cls, spark: SparkSession, path: str, target: DataFrame, key: str, columns: list[str], order: list[str],
              change_schema, as_of: str, buckets: int = 16) -> UpsertWorker:
        none = spark.createDataFrame([], change_schema).select(key, *order)
        store = SnapshotStore.create(spark, path, {"target": (target, key), "applied": (none, key)}, buckets)
        return cls(store, "target", key, columns, order, as_of)

    def run(self, changes: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(changes, checkpoint, self.handle)

    def handle(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.applied():
            return
        last = w.latest_per_key(batch.where(F.col(self.key).isNotNull()), [self.key], self.order, [*self.columns, *self.order])
        fresh = put(last, f"{self.store.path}/incoming", number)
        touched = self.store.touched("applied", fresh.select(self.key))
        before = self.store.read("applied", touched)
        old = before.select(self.key, F.struct(*self.order).alias("_old"))
        newer = (fresh.join(old, self.key, "left").where(F.col("_old").isNull() | (F.struct(*self.order) > F.col("_old"))).drop("_old"))
        newer = put(newer, f"{self.store.path}/newer", number)

        def upsert(stored: DataFrame) -> DataFrame:
            return w.upsert(stored, newer, self.key, self.columns, self.order, self.as_of)

        def note(stored: DataFrame) -> DataFrame:
            return stored.join(newer.select(self.key), self.key, "left_anti").unionByName(newer.select(self.key, *self.order))

        self.store.commit(number, {"target": Change(touched, upsert), "applied": Change(touched, note)})


# ---- T8/J8: records wait for receipts

def confirmations(records: DataFrame, receipts: DataFrame, wait: str = "1 hour", delay: str = "10 minutes",
                  required: int = schemas.CONFIRMATIONS_REQUIRED) -> DataFrame:
    """T8 (stream): pending records (created_at) joined with the receipts of their hash whose block_time lies within
    ``wait`` after them.  A row comes out for each receipt, and one without when the watermark shows that none can come any
    more; then the join forgets the record, and a receipt is forgotten once no record can still come for it.  Settled
    records pass without state.  ``final_transitions`` reduces the rows to one a record."""
    r = as_event_time(records, "created_at").withWatermark("created_at", delay)
    c = as_event_time(receipts, "block_time").select(
        F.col("tx_hash").alias("r_hash"), F.col("block_number").alias("r_block"), F.col("confirmations").alias("r_conf"),
        F.lower("status").alias("r_status"), F.col("gas_used").alias("r_gas"), F.col("block_time").alias("r_time")).withWatermark("r_time", delay)
    pending = F.coalesce(status_of(records) == "PENDING", F.lit(False))
    near = (F.col("r_time") >= F.col("created_at")) & (F.col("r_time") <= F.col("created_at") + F.expr(f"interval {wait}"))
    met = r.where(pending).join(c, (F.col("tx_hash") == F.col("r_hash")) & near, "left_outer")
    failed = F.col("r_status") == "failed"
    confirmed = (F.col("r_status") == "success") & (F.col("r_conf") >= required)
    outcome = (F.when(confirmed, "confirmed").when(failed, "failed").when(F.col("r_status").isNull(), "no_receipt").otherwise("waiting"))
    kept = F.col("error_message") if "error_message" in records.columns else F.lit(None).cast("string")
    return met.select(
        "record_id", "shipment_id", "tx_hash",
        F.when(failed, "FAILED").when(confirmed, "CONFIRMED").otherwise(F.col("status")).alias("status"), _plain("created_at"),
        F.when(confirmed, _zoneless(F.col("r_time"))).otherwise(_zoneless(F.col("confirmed_at"))).alias("confirmed_at"),
        F.when(confirmed, F.col("r_block")).otherwise(F.col("block_number")).alias("block_number"),
        F.when(failed, F.lit(chain.REVERTED)).otherwise(kept).alias("error_message"),
        F.when(confirmed, F.col("r_gas")).otherwise(F.col("gas_used")).alias("gas_used"), "network", outcome.alias("transition"))


def _zoneless(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def _plain(name: str) -> Column:
    return _zoneless(F.col(name)).alias(name)


def settled(records: DataFrame) -> DataFrame:
    """T8 (stream): the records that wait for nothing, in the form of ``confirmations``."""
    kept = F.col("error_message") if "error_message" in records.columns else F.lit(None).cast("string")
    return records.where(~F.coalesce(status_of(records) == "PENDING", F.lit(False))).select(
        "record_id", "shipment_id", "tx_hash", "status", _plain("created_at"), _plain("confirmed_at"), "block_number",
        kept.alias("error_message"), "gas_used", "network", F.lit("not_pending").alias("transition"))


def final_transitions(rows: DataFrame) -> DataFrame:
    """One row a record: a final receipt before a waiting one before none; of several the latest block."""
    rank = F.when(F.col("transition").isin("confirmed", "failed"), 2).when(F.col("transition") == "waiting", 1).otherwise(0)
    best = F.max_by(F.struct(*rows.columns), F.struct(rank, F.coalesce("block_number", F.lit(-1)), "transition"))
    return rows.groupBy("record_id").agg(best.alias("_row")).select("_row.*")


# ---- late data

@dataclass
class LateAudit:
    """Splits a stream by the running watermark: rows behind it go to ``late``, the others to ``kept``.

    The watermark of a batch is the largest ``ts`` of the batches before it less ``delay``, as the engine has it; a row is late
    if its ts does not lie after it.  The largest ts is a fact of the store, so it survives a restart, and a repeated
    batch splits as it did before."""

    store: SnapshotStore
    kept: str
    late: str
    delay: dt.timedelta
    ts: str = "ts"

    @classmethod
    def start(cls, spark: SparkSession, path: str, kept: str, late: str, delay: dt.timedelta, ts: str = "ts") -> LateAudit:
        marks = spark.createDataFrame([], "batch long, rows long, late long")
        return cls(SnapshotStore.create(spark, path, {"marks": (marks, "batch")}, 1), kept, late, delay, ts)

    def run(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(rows, checkpoint, self.handle)

    def handle(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.applied():
            return
        latest = self.store.facts().get("latest")
        at = F.col(self.ts).cast("timestamp_ntz")
        behind = F.lit(False) if latest is None else at <= ts_lit(str(dt.datetime.fromisoformat(latest) - self.delay))
        split = batch.withColumn("_late", F.coalesce(behind, F.lit(False))).persist()
        try:
            put(split.where("NOT _late").drop("_late"), self.kept, number)
            put(split.where("_late").drop("_late").withColumn("behind", F.lit(latest).cast("string")), self.late, number)
            seen = split.agg(F.max(at).alias("latest"), F.count(F.lit(1)).alias("rows"), F.count_if("_late").alias("late")).first()
        finally:
            split.unpersist()
        newest = max(filter(None, (latest, seen["latest"].isoformat() if seen["latest"] else None)), default=None)
        mark = batch.sparkSession.createDataFrame([(number, seen["rows"], seen["late"])], "batch long, rows long, late long")
        self.store.commit(number, {"marks": Change(mark.select("batch"), lambda old: old.unionByName(mark))}, {"latest": newest})


# ---- M9: counters

@dataclass
class CounterIncrease:
    """M9 (stream): each series' total increase, restarts included, from samples that may come out of order.

    Samples wait until the running watermark (as in ``LateAudit``) has passed them; then they follow the series' last
    settled sample in the order of ts.  The store holds one row a series (its total and last sample) and the samples of the
    last ``delay``.  A sample behind the watermark is not counted (a ``LateAudit`` before this keeps it)."""

    store: SnapshotStore
    delay: dt.timedelta

    @classmethod
    def start(cls, spark: SparkSession, path: str, samples_schema, delay: dt.timedelta, buckets: int = 16) -> CounterIncrease:
        none = spark.createDataFrame([], samples_schema).select("service", "ts", "value")
        totals = none.select("service", F.col("ts").alias("last_ts"), F.col("value").alias("last_value"), F.lit(0).cast("bigint").alias("increase"))
        return cls(SnapshotStore.create(spark, path, {"totals": (totals, "service"), "waiting": (none, "service")}, buckets), delay)

    def run(self, samples: DataFrame, checkpoint: str) -> StreamingQuery:
        return drain(samples, checkpoint, self.handle)

    def handle(self, batch: DataFrame, number: int) -> None:
        if number <= self.store.applied():
            return
        latest = self.store.facts().get("latest")
        fresh = batch.select("service", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
        if latest is not None:
            fresh = fresh.where(F.col("ts") > ts_lit(str(dt.datetime.fromisoformat(latest) - self.delay)))
        seen = batch.agg(F.max(F.col("ts").cast("timestamp_ntz"))).first()[0]
        newest = max(filter(None, (latest, seen.isoformat() if seen else None)), default=None)
        settled_by = F.lit(False) if newest is None else F.col("ts") <= ts_lit(str(dt.datetime.fromisoformat(newest) - self.delay))
        self._settle(fresh, number, settled_by, {"latest": newest})

    def finish(self) -> DataFrame:
        """Settle all that waits; (service, increase)."""
        self._settle(self.store.read("waiting").limit(0), None, F.lit(True), self.store.facts())
        return self.store.read("totals").select("service", "increase")

    def _settle(self, fresh: DataFrame, batch: int | None, ripe: Column, facts: dict) -> None:
        number = f"end{self.store.version()}" if batch is None else batch
        pool = put(self.store.read("waiting").unionByName(fresh), f"{self.store.path}/pool", number)
        due, later = pool.where(ripe), pool.where(~ripe)
        named = due.select("service").distinct()
        touched = self.store.touched("totals", named)
        before = self.store.read("totals", touched).join(named, "service", "left_semi")
        known = before.select("service", F.col("last_ts").alias("ts"), F.col("last_value").alias("value"))
        line = known.unionByName(due)
        added = metrics.counter_increase(line).withColumnRenamed("increase", "_more")
        last = line.groupBy("service").agg(F.max_by(F.struct("ts", "value"), "ts").alias("_l"))
        fresh_totals = (last.join(added, "service").join(before.select("service", "increase"), "service", "left")
                        .select("service", F.col("_l.ts").alias("last_ts"), F.col("_l.value").alias("last_value"),
                                (F.coalesce("increase", F.lit(0)) + F.col("_more")).alias("increase")))
        totals = put(fresh_totals, f"{self.store.path}/moved", number)
        self.store.commit(batch, {
            "totals": Change(touched, lambda old: old.join(totals.select("service"), "service", "left_anti").unionByName(totals)),
            "waiting": Change(pool.select("service"), lambda old: later)}, facts)
