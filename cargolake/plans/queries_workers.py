"""The workers as streams (``streaming.workers``), each run over a log that is
recorded from a fixture table in several parts, one micro-batch or more a part.
Rows arrive out of order, and some come twice; the drained result must equal the
batch operator's, so the oracles are those of the batch queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake.functions.common import ts_lit
from cargolake.operators import metrics
from cargolake.plans import queries_metrics_text, queries_streams, queries_writes  # noqa: F401  (their oracles are used below)
from cargolake.plans.catalog import REGISTRY, query
from cargolake.plans.queries_streaming import _drain, _drain_upserts
from cargolake.plans.queries_streams import _ENVELOPES_SQL, _T4_BASE, _mixed
from cargolake.sources.fixtures import AS_OF_EVENTS as NOW
from cargolake.streaming import feeds, maintained, workers

LATE = "interval '6' hour"  # how much later than the others every seventh row arrives
HOLD = dt.timedelta(hours=7)
PARTS = 3


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def record_parts(t, df: DataFrame, part: Column, name: str, parts: int = PARTS) -> tuple[str, str, int]:
    """Write ``df`` part by part, in the order that a file stream reads; (path, schema, files a part)."""
    path = feeds.scratch_path(t.spark, name)
    files = t.spark.sparkContext.defaultParallelism
    marked = df.withColumn("_part", part)
    for k in range(parts):
        marked.where(F.col("_part") == k).drop("_part").repartition(files).write.mode("append").parquet(path)
    return path, ddl(df), files


def by_arrival(df: DataFrame, late: Column, ts: str = "ts") -> Column:
    """The part in which a row arrives: equal stretches of time, a ``late`` row six hours later."""
    span = df.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    if span["a"] is None:
        return F.lit(0)
    step = (span["b"] - span["a"] + dt.timedelta(seconds=1)) // PARTS
    arrival = F.col(ts) + F.when(late, F.expr(LATE)).otherwise(F.expr("interval '0' hour"))
    out = F.lit(0)
    for k in range(1, PARTS):
        out = out + (arrival >= ts_lit(str(span["a"] + step * k))).cast("int")
    return out


def seventh(*names: str) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(7)) == 0


def by_hash(key: str, parts: int = PARTS) -> Column:
    return (F.crc32(F.col(key).cast("string").cast("binary")) % parts).cast("int")


def log_stream(t, log: tuple[str, str, int]) -> DataFrame:
    path, schema, files = log
    return feeds.replay_files(t.spark, path, schema, max_files_per_trigger=files)


def scratch(t, name: str) -> str:
    return feeds.scratch_path(t.spark, name)


# ---- S1/S3: one parse, two sinks

def _split(t) -> tuple[str, str]:
    log = record_parts(t, _mixed(t), by_hash("value", 2), "mixed-log", 2)
    good, bad = scratch(t, "events"), scratch(t, "rejects")
    workers.split_stream(log_stream(t, log), good, bad, scratch(t, "split-ckpt"))
    return good, bad


@query("S1_stream_events", f"WITH {_ENVELOPES_SQL} SELECT event_id, event_type, aggregate_id, aggregate_type, payload, timestamp, correlation_id FROM env")
def s1_stream(t):
    return t.spark.read.parquet(_split(t)[0]).drop("batch")


@query("S3_stream_quarantine", REGISTRY["S3_quarantine"].oracle)
def s3_stream(t):
    return t.spark.read.parquet(_split(t)[1]).drop("batch")


# ---- T4/J6: compensation

def _compensate(t) -> workers.Compensation:
    events = t.domain_events
    once = events.withColumn("_part", by_arrival(events, F.col("event_id") % 7 == 0))
    # every fifth event comes again, in its own part and in the next
    again = once.where(F.col("event_id") % 5 == 0)
    all_rows = once.unionByName(again).unionByName(again.withColumn("_part", F.least(F.col("_part") + 1, F.lit(PARTS - 1))))
    path, schema, files = record_parts(t, all_rows.withColumnRenamed("_part", "_at"), F.col("_at"), "failure-log")
    stream = feeds.dedup_stream(feeds.replay_files(t.spark, path, schema, files).drop("_at"), f"{int(HOLD.total_seconds())} seconds")
    schema_in = stream.schema
    worker = workers.Compensation.start(t.spark, scratch(t, "saga-store"), t.saga_instances, schema_in, scratch(t, "compensation"), hold=HOLD)
    worker.run(stream, scratch(t, "compensation-ckpt"))
    worker.finish()
    return worker


@query("T4_stream_commands", REGISTRY["T4_compensation_commands"].oracle)
def t4_stream_commands(t):
    return t.spark.read.parquet(f"{_compensate(t).out}/commands").drop("batch")


@query("J6_stream_outcomes_and_sagas", f"""
WITH {_T4_BASE}
SELECT 'outcome' AS kind, event_id AS id, outcome AS value, cast(NULL AS varchar) AS failed_step FROM o
UNION ALL
SELECT 'saga', s.saga_id, CASE WHEN f.correlation_id IS NULL THEN s.status ELSE 'FAILED' END, coalesce(f.event_type, s.failed_step)
FROM saga_instances s LEFT JOIN (SELECT correlation_id, event_type FROM o WHERE outcome = 'fired') f ON s.saga_id = f.correlation_id""")
def j6_stream(t):
    """What became of every failure event, and the saga table that the stream has changed."""
    worker = _compensate(t)
    outcomes = t.spark.read.parquet(f"{worker.out}/outcomes")
    return (outcomes.select(F.lit("outcome").alias("kind"), F.col("event_id").alias("id"), F.col("outcome").alias("value"),
                            F.lit(None).cast("string").alias("failed_step"))
            .unionByName(worker.store.read("sagas").select(F.lit("saga").alias("kind"), F.col("saga_id").alias("id"),
                                                           F.col("status").alias("value"), "failed_step")))


# ---- T6, U1: commands and change sets on stored snapshots

def _command(t) -> workers.CommandWorker:
    log = record_parts(t, t.commands, by_hash("command_id"), "command-log")
    worker = workers.CommandWorker.start(t.spark, scratch(t, "command-store"), t.inventory_records, t.deliveries, t.shipments,
                                         t.items, scratch(t, "reports"))
    worker.run(log_stream(t, log), scratch(t, "command-ckpt"))
    return worker


_CANCELLED = """(SELECT try_cast(coalesce(nullif(json_extract_string(payload, '$.shipment_id'), ''), cast(aggregate_id AS varchar)) AS bigint)
  FROM commands WHERE command_type = 'shipment.cancel')"""


@query("T6_stream_command_tables", f"""
WITH sid AS (SELECT DISTINCT try_cast(json_extract_string(payload, '$.shipment_id') AS bigint) AS shipment_id FROM commands
             WHERE command_type = 'inventory.release')
SELECT 'inventory' AS kind, record_id AS id, r.shipment_id,
       CASE WHEN sid.shipment_id IS NOT NULL AND upper(trim(status)) <> 'SHIPPED' THEN 'received' ELSE status END AS status
FROM inventory_records r LEFT JOIN sid ON r.shipment_id = sid.shipment_id
UNION ALL SELECT 'delivery', cast(delivery_id AS varchar), shipment_id, status FROM deliveries WHERE delivery_id NOT IN (
  SELECT coalesce(try_cast(nullif(json_extract_string(payload, '$.delivery_id'), '') AS bigint), aggregate_id)
  FROM commands WHERE command_type = 'courier.unassign')
UNION ALL SELECT 'shipment', cast(shipment_id AS varchar), shipment_id, status FROM shipments WHERE shipment_id NOT IN {_CANCELLED}
UNION ALL SELECT 'item', item_id, shipment_id, NULL FROM items WHERE shipment_id NOT IN {_CANCELLED}
UNION ALL SELECT 'unknown', command_id, NULL, command_type FROM commands
  WHERE command_type NOT IN ('inventory.release', 'courier.unassign', 'shipment.cancel')""")
def t6_stream(t):
    """The four tables after the last command, and the commands that no worker handles."""
    worker = _command(t)
    unknown = t.spark.read.parquet(f"{worker.out}/unknown")

    def rows(kind: str, df: DataFrame, key: str, shipment: str | None, status: str | None) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"),
                         (F.col(shipment) if shipment else F.lit(None)).cast("bigint").alias("shipment_id"),
                         (F.col(status) if status else F.lit(None)).cast("string").alias("status"))

    read = worker.store.read
    return (rows("inventory", read("inventory"), "record_id", "shipment_id", "status")
            .unionByName(rows("delivery", read("deliveries"), "delivery_id", "shipment_id", "status"))
            .unionByName(rows("shipment", read("shipments"), "shipment_id", "shipment_id", "status"))
            .unionByName(rows("item", read("items"), "item_id", "shipment_id", None))
            .unionByName(rows("unknown", unknown, "command_id", None, "command_type")))


@query("U1_stream_upsert", REGISTRY["U1_upsert_shipment_status"].oracle)
def u1_stream(t):
    """Every part holds changes of all times, so most keys see an older change after a newer one."""
    log = record_parts(t, t.shipment_changes, by_hash("change_seq"), "change-log")
    worker = workers.UpsertWorker.start(t.spark, scratch(t, "shipment-store"), t.shipments, "shipment_id", ["status"],
                                        ["changed_at", "change_seq"], t.shipment_changes.schema, NOW)
    worker.run(log_stream(t, log), scratch(t, "upsert-ckpt"))
    return worker.store.read("target")


# ---- T8/J8: records wait for receipts

def _with_heartbeats(t, df: DataFrame, ts: str, log: tuple[str, str, int]) -> None:
    """Two micro-batches after the end of a log, which move the watermark past all of its rows.  Their hash is of no
    record, but not null: rows without a key are filtered before the watermark sees them."""
    path, _, files = log
    end = df.agg(F.max(ts)).first()[0] or dt.datetime(2000, 1, 1)
    fixed = {"status": F.lit("PENDING"), "tx_hash": F.lit(f"heartbeat:{ts}")}
    for hours in (24, 48):
        at = ts_lit(str(end + dt.timedelta(hours=hours)))
        values = [fixed.get(f.name, at if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        t.spark.range(0, files, 1, files).select(*values).write.mode("append").parquet(path)


def _confirm(t) -> DataFrame:
    records, receipts = t.blockchain_records, t.receipts
    left = record_parts(t, records, by_arrival(records, seventh("record_id"), "created_at"), "record-log")
    right = record_parts(t, receipts, by_arrival(receipts, seventh("block_number"), "block_time"), "receipt-log")
    _with_heartbeats(t, records, "created_at", left)
    _with_heartbeats(t, receipts, "block_time", right)
    delay = f"{int(HOLD.total_seconds())} seconds"
    waiting = _drain(t, workers.confirmations(log_stream(t, left), log_stream(t, right), delay=delay), "receipts")
    rest = _drain(t, workers.settled(log_stream(t, left)), "settled")
    return workers.final_transitions(waiting.unionByName(rest).where("record_id IS NOT NULL"))


@query("T8_stream_confirmations", REGISTRY["T8_confirmation_tracking"].oracle)
def t8_stream(t):
    return _confirm(t)


# ---- M2, M3/M4, M7, M9: dashboards as rows arrive

def _http_stream(t) -> DataFrame:
    log = t.http_log
    return log_stream(t, record_parts(t, log, by_arrival(log, seventh("ts", "service", "duration_s")), "http-log"))


WAIT = f"{int(HOLD.total_seconds())} seconds"


@query("M2_stream_errors_per_second", REGISTRY["M2_errors_per_second"].oracle)
def m2_stream(t):
    failed = _http_stream(t).where(F.col("status").between(500, 599))
    return _drain_upserts(t, feeds.windowed_request_rate(failed, WAIT), "error-rate", ["service", "window_start"])


@query("M3_M4_stream_quantiles", REGISTRY["M3_M4_latency_quantiles"].oracle)
def m3_stream(t):
    panes = _drain_upserts(t, feeds.latency_panes_stream(_http_stream(t), WAIT), "latency-panes", ["service", "pane"])
    return metrics.quantiles_of_panes(panes)


@query("M7_stream_error_ratio", """
WITH w AS (SELECT unnest([0, 1, 2, 3, 4]) AS k)
SELECT date_trunc('minute', ts) - k * INTERVAL 1 MINUTE AS window_start,
       100.0 * count(*) FILTER (WHERE status BETWEEN 500 AND 599) / count(*) AS error_pct
FROM http_log, w GROUP BY ALL""")
def m7_stream(t):
    """The error share of every five minutes, a window a minute."""
    panes = _drain_upserts(t, feeds.error_panes_stream(_http_stream(t), WAIT), "error-panes", ["pane"])
    return metrics.error_ratio_of_panes(panes)


@query("M9_stream_counter_increase", REGISTRY["M9_counter_increase"].oracle)
def m9_stream(t):
    samples = metrics.counter_samples(t.http_log)
    log = record_parts(t, samples, by_arrival(samples, seventh("ts", "service")), "sample-log")
    worker = workers.CounterIncrease.start(t.spark, scratch(t, "counter-store"), samples.schema, HOLD)
    worker.run(log_stream(t, log), scratch(t, "counter-ckpt"))
    return worker.finish()


# ---- late data

_PARTS_SQL = f"""span AS (SELECT min(ts) AS a, (epoch_us(max(ts)) - epoch_us(min(ts)) + 1000000) // {PARTS} AS step FROM domain_events),
arrived AS (
  SELECT event_id, ts, {' + '.join(f"(ts + CASE WHEN event_id % 7 = 0 THEN INTERVAL 6 HOUR ELSE INTERVAL 0 HOUR END >= a + to_microseconds({k} * step))::int" for k in range(1, PARTS))} AS part
  FROM domain_events, span),
seen AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM arrived GROUP BY part)"""


@query("S9_stream_late_audit", f"""
WITH {_PARTS_SQL}
SELECT event_id, ts, coalesce(ts <= latest - INTERVAL 3 HOUR, false) AS late FROM arrived JOIN seen USING (part)""")
def late_audit(t):
    """Rows that come up to six hours late against a watermark three hours behind: what is kept and what is audited."""
    events = t.domain_events
    log = record_parts(t, events, by_arrival(events, F.col("event_id") % 7 == 0), "audit-log")
    kept, late = scratch(t, "kept"), scratch(t, "late")
    worker = workers.LateAudit.start(t.spark, scratch(t, "audit-store"), kept, late, dt.timedelta(hours=3))
    worker.run(log_stream(t, log), scratch(t, "audit-ckpt"))
    return (t.spark.read.parquet(kept).select("event_id", "ts", F.lit(False).alias("late"))
            .unionByName(t.spark.read.parquet(late).select("event_id", "ts", F.lit(True).alias("late"))))


# ---- A13: statistics kept up from a change feed

def _versions(current: DataFrame, changes: DataFrame, key: str, kept: list[str]) -> tuple[DataFrame, DataFrame]:
    """The changed rows as they were and as they are; ``kept`` columns stay those of the stored row."""
    before = current.join(changes.select(key), key, "left_semi")
    after = changes.join(current.select(key, *kept), key, "left").select(*current.columns)
    return before, after


@query("A13_maintained_saga_statistics", """
WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY saga_id ORDER BY change_seq DESC) AS rn FROM saga_rows) WHERE rn = 1),
now AS (SELECT coalesce(l.saga_type, s.saga_type) AS saga_type, upper(trim(coalesce(l.status, s.status))) AS status,
               coalesce(l.started_at, s.started_at) AS started_at, s.completed_at, s.retry_count
        FROM saga_instances s FULL JOIN last l ON s.saga_id = l.saga_id)
SELECT saga_type, count(*) AS total_sagas, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
       count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled,
       count(*) FILTER (WHERE status IN ('STARTED', 'COMPENSATING')) AS in_progress,
       round(avg(epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 6) AS avg_duration_seconds,
       max(retry_count) AS max_retry_count, round(avg(retry_count), 6) AS avg_retry_count
FROM now GROUP BY saga_type""")
def a13_sagas(t):
    """A2 after two change sets (new versions of some sagas, and new ones), the second applied twice."""
    current = t.saga_instances.select("saga_id", "saga_type", "status", "started_at", "completed_at", "retry_count")
    state = maintained.Maintained.start(t.spark, scratch(t, "saga-statistics"), current, maintained.saga_statistic())
    for batch, versions in ((0, (1, 3)), (1, (2, 4))):
        changes = t.saga_rows.where(F.col("change_seq").isin(*versions)).select("saga_id", "saga_type", "status", "started_at")
        before, after = _versions(current, changes, "saga_id", ["completed_at", "retry_count"])
        state.apply(batch, before, after)
        current = current.join(changes.select("saga_id"), "saga_id", "left_anti").unionByName(after)
    state.apply(1, before, after)
    return maintained.saga_statistics(state)


@query("A13_maintained_daily_blockchain", """
WITH last AS (SELECT * FROM record_rows WHERE change_seq IN (1, 3)),
now AS (SELECT coalesce(l.created_at, b.created_at) AS created_at, coalesce(l.status, b.status) AS status,
               CASE WHEN l.record_id IS NULL THEN b.confirmed_at ELSE l.confirmed_at END AS confirmed_at,
               CASE WHEN l.record_id IS NULL THEN b.gas_used ELSE l.gas_used END AS gas_used, b.network
        FROM blockchain_records b FULL JOIN last l ON b.record_id = l.record_id)
SELECT cast(created_at AS date) AS transaction_date, network, count(*) AS total_transactions,
       count(*) FILTER (WHERE upper(trim(status)) = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE upper(trim(status)) = 'FAILED') AS failed,
       cast(sum(gas_used) AS bigint) AS total_gas_used,
       round(avg(epoch_us(confirmed_at) - epoch_us(created_at)) / 1e6, 6) AS avg_confirmation_time_seconds
FROM now GROUP BY ALL""")
def a13_chain(t):
    """A5 after a change set that moves records to another day and adds new ones."""
    columns = ["record_id", "created_at", "status", "confirmed_at", "gas_used", "network"]
    current = t.blockchain_records.select(*columns)
    state = maintained.Maintained.start(t.spark, scratch(t, "chain-statistics"), current, maintained.daily_chain_statistic())
    changes = t.record_rows.where(F.col("change_seq").isin(1, 3)).select(*columns[:-1])
    state.apply(0, *_versions(current, changes, "record_id", ["network"]))
    return maintained.daily_blockchain_statistics(state)
