"""Registered streaming queries (a stream run to completion with
``Trigger.AvailableNow`` over a log recorded from the fixture tables), and
those that read a snapshot which they have stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolake.functions.common import normalised
from cargolake.operators import reads, stats
from cargolake.operators import writes as w
from cargolake.plans.catalog import query
from cargolake.streaming import feeds
from cargolake.streaming.sagas import loaded_sagas, saga_state_machine


def _record(t, df, name):
    """Persist a derived log under the shared checkpoint dir (a new folder
    per run) and return (path, schema)."""
    path = feeds.scratch_path(t.spark, name)
    df.write.parquet(path)
    return path, df.schema.simpleString()[len("struct<"):-1].replace(":", " ")


def _drain(t, stream_df, name, mode="append"):
    sink, ckpt = feeds.scratch_path(t.spark, name + "-out"), feeds.scratch_path(t.spark, name + "-ckpt")
    feeds.run_available_now(stream_df, sink, ckpt, mode)
    return t.spark.read.parquet(sink)


def _drain_upserts(t, stream_df, name, keys):
    return feeds.run_upserts(stream_df, feeds.scratch_path(t.spark, name + "-out"), feeds.scratch_path(t.spark, name + "-ckpt"), keys)


def _event_log(t):
    # context ids for T5: warehouse / delivery references carried by the event
    return t.domain_events.withColumn("context_id", F.col("aggregate_id").cast("string"))


@query("S8_S9_log_replay", "SELECT * FROM domain_events")
def s9(t):
    path, schema = _record(t, t.domain_events, "event-log")
    return _drain(t, feeds.replay_files(t.spark, path, schema, max_files_per_trigger=1), "replay")


@query("T12_stream_dedup", "SELECT * FROM domain_events")
def t12s(t):
    path, schema = _record(t, t.domain_events.unionByName(t.domain_events), "dup-log")
    once = _drain(t, feeds.dedup_stream(feeds.replay_files(t.spark, path, schema)), "dedup")
    return once.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("T5_saga_state_machine")
def t5(t):
    path, schema = _record(t, _event_log(t), "saga-log")
    return _drain(t, saga_state_machine(feeds.replay_files(t.spark, path, schema)), "sagas")


@query("M1_stream_request_rate", """
SELECT service, date_trunc('minute', ts) AS window_start, count(*) / 60.0 AS per_second
FROM http_log GROUP BY ALL""")
def m1s(t):
    path, schema = _record(t, t.http_log, "http-log")
    return _drain_upserts(t, feeds.windowed_request_rate(feeds.replay_files(t.spark, path, schema)), "rate",
                          ["service", "window_start"])


@query("A5_stream_daily_blockchain", """
SELECT cast(created_at AS date) AS transaction_date, network, count(*) AS total_transactions,
       count(CASE WHEN upper(trim(status)) = 'CONFIRMED' THEN 1 END) AS confirmed,
       count(CASE WHEN upper(trim(status)) = 'FAILED' THEN 1 END) AS failed, cast(sum(gas_used) AS bigint) AS total_gas_used
FROM blockchain_records GROUP BY ALL""")
def a5s(t):
    path, schema = _record(t, t.blockchain_records, "chain-log")
    return _drain_upserts(t, feeds.daily_chain_stats_stream(feeds.replay_files(t.spark, path, schema)), "daily",
                          ["transaction_date", "network"])


@query("T5_saga_final_states", """
WITH e AS (SELECT cast(correlation_id AS varchar) AS saga_id, event_type,
                  row_number() OVER (PARTITION BY correlation_id ORDER BY ts, cast(event_id AS varchar)) AS n
           FROM domain_events WHERE correlation_id IS NOT NULL),
begun AS (SELECT saga_id, min(n) AS first_n FROM e WHERE event_type = 'shipment.created' GROUP BY saga_id),
ended AS (SELECT saga_id, arg_min(event_type, n) AS cause FROM e JOIN begun USING (saga_id)
          WHERE n > first_n AND event_type IN ('delivery.completed', 'delivery.failed', 'courier.unassigned', 'inventory.insufficient')
          GROUP BY saga_id)
SELECT saga_id, CASE WHEN cause IS NULL THEN 'STARTED' WHEN cause = 'delivery.completed' THEN 'COMPLETED' ELSE 'FAILED' END AS status,
       CASE WHEN cause <> 'delivery.completed' THEN cause END AS failed_step
FROM begun LEFT JOIN ended USING (saga_id)""")
def t5_final(t):
    """The last state of each saga that the drained state machine has reported."""
    path, schema = _record(t, _event_log(t), "saga-log")
    told = _drain(t, saga_state_machine(feeds.replay_files(t.spark, path, schema)), "sagas").where("kind = 'snapshot'")
    final = F.col("status").isin("COMPLETED", "FAILED").cast("int")
    last = told.groupBy("saga_id").agg(F.max(F.struct(final.alias("final"), "status")).alias("last"),
                                       F.max(F.when(F.col("status") == "COMPENSATING", F.col("detail"))).alias("failed_step"))
    return last.select("saga_id", "last.status", "failed_step")


_T5_ROWS = """
WITH loaded AS (SELECT cast(saga_id AS varchar) AS saga_id, upper(trim(status)) AS status, cast(warehouse_id AS varchar) AS warehouse_id,
                       cast(delivery_id AS varchar) AS delivery_id FROM saga_instances),
e AS (SELECT cast(correlation_id AS varchar) AS saga_id, event_type, cast(event_id AS varchar) AS event_id, ts,
             json_extract_string(payload, '$.reason') AS reason,
             row_number() OVER (PARTITION BY correlation_id ORDER BY ts, cast(event_id AS varchar)) AS n
      FROM domain_events WHERE correlation_id IS NOT NULL),
begun AS (SELECT saga_id, min(CASE WHEN event_type = 'shipment.created' THEN n END) AS first_n FROM e GROUP BY saga_id),
known AS (SELECT e.*, l.status AS old_status, l.warehouse_id, l.delivery_id, l.saga_id IS NOT NULL AS was,
                 l.saga_id IS NOT NULL OR n > first_n AS exists
          FROM e JOIN begun USING (saga_id) LEFT JOIN loaded l USING (saga_id)),
fail AS (SELECT *, CASE WHEN NOT coalesce(exists, false) THEN 'saga_not_found' WHEN was AND old_status <> 'STARTED' THEN 'already_final' END AS pre
         FROM known WHERE event_type IN ('delivery.failed', 'courier.unassigned', 'inventory.insufficient')),
firsts AS (SELECT saga_id, min(n) AS fired_n FROM fail WHERE pre IS NULL GROUP BY saga_id),
f AS (SELECT fail.*, CASE WHEN pre IS NOT NULL THEN pre WHEN n <> fired_n THEN 'already_final' ELSE 'fired' END AS outcome
      FROM fail LEFT JOIN firsts USING (saga_id))
SELECT saga_id, 'snapshot' AS kind, 'STARTED' AS status, 'saga_started' AS detail, NULL::varchar AS warehouse_id, NULL::varchar AS delivery_id, event_id, ts
FROM known JOIN begun USING (saga_id) WHERE NOT was AND n = begun.first_n
UNION ALL
SELECT saga_id, 'outcome', CASE WHEN outcome = 'already_final' THEN CASE WHEN was AND old_status <> 'STARTED' THEN old_status ELSE 'FAILED' END END,
       outcome, NULL, NULL, event_id, ts FROM f WHERE outcome <> 'fired'
UNION ALL
SELECT saga_id, 'command', 'courier.unassign', coalesce(reason, 'Triggered by ' || event_type), warehouse_id, delivery_id, event_id, ts
FROM f WHERE outcome = 'fired' AND event_type = 'delivery.failed' AND delivery_id IS NOT NULL
UNION ALL
SELECT saga_id, 'command', 'inventory.release', CASE event_type WHEN 'delivery.failed' THEN 'Delivery failed rollback' ELSE 'Courier unassigned rollback' END,
       warehouse_id, delivery_id, event_id, ts
FROM f WHERE outcome = 'fired' AND event_type IN ('delivery.failed', 'courier.unassigned') AND warehouse_id IS NOT NULL
UNION ALL
SELECT saga_id, 'command', 'shipment.cancel', CASE event_type WHEN 'delivery.failed' THEN 'Delivery failed rollback'
       WHEN 'courier.unassigned' THEN 'Courier unassigned rollback' ELSE 'Inventory insufficient' END, warehouse_id, delivery_id, event_id, ts
FROM f WHERE outcome = 'fired'
UNION ALL
SELECT saga_id, 'snapshot', 'COMPENSATING', event_type, warehouse_id, delivery_id, event_id, ts FROM f WHERE outcome = 'fired'
UNION ALL
SELECT saga_id, 'snapshot', 'FAILED', 'Compensation triggered by ' || event_type, warehouse_id, delivery_id, event_id, ts FROM f WHERE outcome = 'fired'"""


@query("T5_saga_rows", _T5_ROWS)
def t5_rows(t):
    """All that the machine reports of a log that starts from the saga snapshot, but for timeouts, which hang on the watermark."""
    events = _event_log(t)
    text = [F.col(c).cast("string").alias(c) if c in ("event_id", "correlation_id", "aggregate_id") else F.col(c) for c in events.columns]
    path, schema = _record(t, loaded_sagas(t.saga_instances).unionByName(events.select(text)), "saga-rows-log")
    told = _drain(t, saga_state_machine(feeds.replay_files(t.spark, path, schema)), "saga-rows").where("kind <> 'step_timeout'")
    return told.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("A13_incremental_refresh", """
WITH net AS (SELECT item_id, sum(delta) AS moved FROM item_quantity_changes GROUP BY item_id),
carried AS (SELECT shipment_id, count(*) AS n, sum(weight) AS mass,
                   sum(CASE WHEN quantity + moved >= 1 THEN quantity + moved ELSE quantity END) AS pieces
            FROM items LEFT JOIN net USING (item_id) WHERE item_id IS NOT NULL GROUP BY shipment_id)
SELECT shipments.* EXCLUDE (departure_date, arrival_date) REPLACE (upper(trim(status)) AS status), ifnull(n, 0) AS total_items,
       cast(ifnull(pieces, 0) AS bigint) AS total_quantity, cast(ifnull(mass, 0) AS decimal(20,2)) AS total_weight
FROM shipments LEFT JOIN carried USING (shipment_id)""")
def a13(t):
    """The stored shipment_statistics snapshot, with the rows of the shipments
    whose items changed (U7) computed anew."""
    stored = w.write_snapshot(stats.shipment_statistics(t.shipments, t.items), feeds.scratch_path(t.spark, "statistics"), 1)
    new_items, _ = w.adjust_quantity(t.items, t.item_quantity_changes)
    changed = t.items.join(t.item_quantity_changes.select("item_id"), "item_id", "left_semi").select("shipment_id")
    recomputed = stats.shipment_statistics(t.shipments.join(changed, "shipment_id", "left_semi"), new_items)
    return feeds.changed_keys_refresh(t.spark.read.parquet(stored), normalised(recomputed, "status"), "shipment_id")


@query("P3_deliveries_of_snapshot", """
SELECT * REPLACE (upper(trim(status)) AS status) FROM deliveries WHERE upper(trim(status)) = 'IN_TRANSIT'""")
def p3_snapshot(t):
    """P3/U11 on a stored snapshot: the status filter reaches the scan."""
    stored = w.write_snapshot(t.deliveries, feeds.scratch_path(t.spark, "deliveries"), 1)
    return reads.by_status(t.spark.read.parquet(stored), "in_transit", ("created_at", "delivery_id"))
