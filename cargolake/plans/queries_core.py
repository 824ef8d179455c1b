"""Registered queries for statistics, monitoring, reads and joins."""

from __future__ import annotations

from cargolake.operators import stats
from cargolake.functions.sequences import newest_first
from cargolake.plans.catalog import query


@query("A1_shipment_statistics", """
WITH carried AS (
  SELECT shipment_id, count(*) AS n, sum(quantity) AS pieces, sum(weight) AS mass
  FROM items WHERE item_id IS NOT NULL GROUP BY shipment_id)
SELECT shipments.* EXCLUDE (departure_date, arrival_date), ifnull(n, 0) AS total_items, cast(ifnull(pieces, 0) AS bigint) AS total_quantity,
       cast(ifnull(mass, 0) AS decimal(20,2)) AS total_weight
FROM shipments LEFT JOIN carried USING (shipment_id)""")
def a1(t):
    return stats.shipment_statistics(t.shipments, t.items)


from pyspark.sql import functions as F  # noqa: E402

from cargolake import schemas  # noqa: E402
from cargolake.operators import joins, monitor, reads, traces  # noqa: E402
from cargolake.sources.fixtures import AS_OF_EVENTS, AS_OF_ORDERS  # noqa: E402

_SECS = "epoch({a} - {b})"


def _avg_secs(a, b, cond=None):
    cond = cond or f"{a} IS NOT NULL"
    return f"round(avg(epoch({a} - {b})) FILTER (WHERE {cond}), 6)"


@query("A2_saga_statistics", f"""
SELECT saga_type, count(*) AS total_sagas,
       count(*) FILTER (WHERE upper(trim(status)) = 'COMPLETED') AS completed,
       count(*) FILTER (WHERE upper(trim(status)) = 'FAILED') AS failed,
       count(*) FILTER (WHERE upper(trim(status)) = 'CANCELLED') AS cancelled,
       count(*) FILTER (WHERE upper(trim(status)) IN ('STARTED', 'COMPENSATING')) AS in_progress,
       {_avg_secs('completed_at', 'started_at')} AS avg_duration_seconds,
       max(retry_count) AS max_retry_count,
       round(avg(retry_count), 6) AS avg_retry_count
FROM saga_instances GROUP BY saga_type""")
def a2(t):
    from cargolake.operators import stats as s
    return s.saga_statistics(t.saga_instances)


@query("A3_daily_saga_statistics", f"""
SELECT cast(started_at as date) AS saga_date, saga_type, count(*) AS total_sagas,
       count(*) FILTER (WHERE upper(trim(status)) = 'COMPLETED') AS completed,
       count(*) FILTER (WHERE upper(trim(status)) = 'FAILED') AS failed,
       {_avg_secs('completed_at', 'started_at')} AS avg_duration_seconds
FROM saga_instances GROUP BY 1, 2 ORDER BY saga_date DESC, saga_type""")
def a3(t):
    return stats.daily_saga_statistics(t.saga_instances)


@query("A4_blockchain_statistics", f"""
SELECT network, count(*) AS total_transactions,
       count(*) FILTER (WHERE upper(trim(status)) = 'CONFIRMED') AS confirmed,
       count(*) FILTER (WHERE upper(trim(status)) = 'PENDING') AS pending,
       count(*) FILTER (WHERE upper(trim(status)) = 'FAILED') AS failed,
       count(*) FILTER (WHERE upper(trim(status)) = 'DROPPED') AS dropped,
       {_avg_secs('confirmed_at', 'created_at')} AS avg_confirmation_time_seconds,
       cast(sum(gas_used) as bigint) AS total_gas_used,
       round(avg(gas_used), 6) AS avg_gas_used,
       min(created_at) AS first_transaction_at, max(created_at) AS last_transaction_at
FROM blockchain_records GROUP BY network""")
def a4(t):
    return stats.blockchain_statistics(t.blockchain_records)


@query("A5_daily_blockchain_statistics", f"""
SELECT cast(created_at as date) AS transaction_date, network, count(*) AS total_transactions,
       count(*) FILTER (WHERE upper(trim(status)) = 'CONFIRMED') AS confirmed,
       count(*) FILTER (WHERE upper(trim(status)) = 'FAILED') AS failed,
       cast(sum(gas_used) as bigint) AS total_gas_used,
       {_avg_secs('confirmed_at', 'created_at')} AS avg_confirmation_time_seconds
FROM blockchain_records GROUP BY 1, 2 ORDER BY transaction_date DESC, network""")
def a5(t):
    return stats.daily_blockchain_statistics(t.blockchain_records)


@query("A6_shipment_total_weight", """
SELECT s.shipment_id, cast(coalesce(sum(i.weight * i.quantity), 0) as decimal(20,2)) AS total_weight, 'kg' AS unit
FROM shipments s LEFT JOIN items i ON s.shipment_id = i.shipment_id GROUP BY s.shipment_id""")
def a6(t):
    return stats.shipment_total_weight(t.shipments, t.items)


@query("A7_shipment_item_count", """
SELECT s.shipment_id, count(i.item_id) AS items_count
FROM shipments s LEFT JOIN items i ON s.shipment_id = i.shipment_id GROUP BY s.shipment_id""")
def a7(t):
    return stats.shipment_item_count(t.shipments, t.items)


@query("A8_max_confirmations", """
SELECT record_id, max(confirmation_count) AS max_confirmations FROM transaction_confirmations GROUP BY record_id""")
def a8(t):
    return stats.max_confirmations(t.transaction_confirmations)


@query("V1_stuck_sagas", f"""
SELECT saga_id, saga_type, shipment_id, status, started_at, updated_at,
       epoch(timestamp '{AS_OF_ORDERS}' - updated_at) AS stuck_duration_seconds,
       retry_count, failed_step, cast(null as varchar) AS error_message
FROM saga_instances
WHERE upper(trim(status)) IN ('STARTED', 'COMPENSATING')
  AND updated_at < timestamp '{AS_OF_ORDERS}' - interval 10 minute
ORDER BY updated_at, saga_id""")
def v1(t):
    return monitor.stuck_sagas(t.saga_instances, AS_OF_ORDERS)


@query("V2_stuck_transactions", f"""
SELECT record_id, shipment_id, tx_hash, status, created_at,
       epoch(timestamp '{AS_OF_EVENTS}' - created_at) AS pending_duration_seconds,
       cast(null as bigint) AS gas_price, network, cast(null as varchar) AS error_message
FROM blockchain_records
WHERE upper(trim(status)) = 'PENDING' AND created_at < timestamp '{AS_OF_EVENTS}' - interval 30 minute
ORDER BY created_at, record_id""")
def v2(t):
    return monitor.stuck_transactions(t.blockchain_records, AS_OF_EVENTS)


@query("V3_confirmed_transactions_summary", """
WITH depth AS (
  SELECT record_id, confirmation_count AS max_confirmations FROM transaction_confirmations
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY confirmation_count DESC NULLS LAST) = 1)
SELECT * EXCLUDE (status, payload, created_at), cast(null AS bigint) AS gas_price,
       date_diff('microsecond', created_at, confirmed_at) / 1e6 AS confirmation_time_seconds
FROM blockchain_records LEFT JOIN depth USING (record_id) WHERE upper(trim(status)) = 'CONFIRMED'""")
def v3(t):
    return monitor.confirmed_transactions_summary(t.blockchain_records, t.transaction_confirmations)


@query("V4_timed_out_steps", f"""
SELECT saga_id, step_name, step_order, status, started_at,
       epoch(timestamp '{AS_OF_ORDERS}' - started_at) AS running_seconds
FROM saga_steps
WHERE upper(trim(status)) = 'RUNNING' AND started_at < timestamp '{AS_OF_ORDERS}' - interval 3600 second""")
def v4(t):
    return monitor.timed_out_steps(t.saga_steps, AS_OF_ORDERS)


@query("V5_unfinished_steps", """
SELECT saga_id, step_name, step_order, status, started_at,
       row_number() OVER (PARTITION BY saga_id ORDER BY step_order, step_name, started_at, status) AS position
FROM saga_steps WHERE upper(trim(status)) IN ('PENDING', 'RUNNING', 'COMPENSATING')""")
def v5(t):
    return monitor.unfinished_steps(t.saga_steps)


# ---- P: lookups, filters, ordering -----------------------------------------

@query("P1_lookup_shipments_by_event_keys", """
SELECT * FROM shipments WHERE shipment_id IN (SELECT aggregate_id FROM domain_events)""")
def p1(t):
    return reads.lookup_by_keys(t.shipments, t.domain_events, "shipment_id", "aggregate_id")


@query("P2_lookup_records_by_tx_hash", """
SELECT * FROM blockchain_records WHERE tx_hash IN (SELECT tx_hash FROM receipts)""")
def p2(t):
    return reads.lookup_by_keys(t.blockchain_records, t.receipts, "tx_hash")


@query("P3_deliveries_in_transit", """
SELECT * FROM deliveries WHERE upper(trim(status)) = 'IN_TRANSIT' ORDER BY created_at""")
def p3(t):
    return reads.by_status(t.deliveries, "IN_TRANSIT")


@query("P3_shipment_status_counts", """
SELECT upper(trim(status)) AS status, count(*) AS n FROM shipments GROUP BY 1""")
def p3b(t):
    return reads.status_counts(t.shipments)


@query("P4_active_shipments", """
SELECT * FROM shipments WHERE NOT (upper(trim(status)) IN ('COMPLETED'))""")
def p4a(t):
    return reads.in_statuses(t.shipments, ["completed"], negate=True)


@query("P4_pending_shipments", """
SELECT * FROM shipments WHERE upper(trim(status)) IN ('CREATED', 'RECEIVED')""")
def p4b(t):
    return reads.in_statuses(t.shipments, ["created", "received"])


@query("P4_active_sagas", """
SELECT * FROM saga_instances WHERE upper(trim(status)) IN ('STARTED', 'COMPENSATING') ORDER BY updated_at, saga_id""")
def p4c(t):
    return reads.active_sagas(t.saga_instances)


@query("P4_active_deliveries", """
SELECT * FROM deliveries WHERE upper(trim(status)) IN ('ASSIGNED', 'PICKED_UP', 'IN_TRANSIT')""")
def p4d(t):
    return reads.in_statuses(t.deliveries, schemas.DELIVERY_ACTIVE)


@query("P4_active_inventory", """
SELECT * FROM inventory_records WHERE NOT (upper(trim(status)) IN ('SHIPPED'))""")
def p4e(t):
    return reads.in_statuses(t.inventory_records, ["SHIPPED"], negate=True)


@query("P5_items_by_shipment", """
SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY name, item_id) AS position FROM items""")
def p5a(t):
    return reads.ranked_children(t.items, "shipment_id", [F.col("name"), F.col("item_id")])


@query("P5_deliveries_by_courier", """
SELECT *, row_number() OVER (PARTITION BY courier_id ORDER BY created_at DESC, delivery_id DESC) AS position
FROM deliveries""")
def p5b(t):
    return newest_first(t.deliveries, "courier_id", "created_at", "delivery_id", "position")


@query("P5_inventory_by_shipment", """
SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY received_at, record_id, warehouse_id, status) AS position
FROM inventory_records""")
def p5c(t):
    return reads.ranked_children(t.inventory_records, "shipment_id",
                                 [F.col("received_at"), F.col("record_id"), F.col("warehouse_id"), F.col("status")])


@query("P5b_inventory_by_saga_context", """
SELECT r.* FROM inventory_records r
WHERE EXISTS (SELECT 1 FROM saga_instances s WHERE s.shipment_id = r.shipment_id AND s.warehouse_id = r.warehouse_id)""")
def p5d(t):
    pairs = t.saga_instances.select("shipment_id", "warehouse_id")
    return t.inventory_records.join(pairs, ["shipment_id", "warehouse_id"], "left_semi")


@query("P6_shipments_page", """
SELECT * FROM shipments ORDER BY created_at DESC, shipment_id DESC LIMIT 50 OFFSET 100""")
def p6a(t):
    return reads.page(t.shipments, [F.col("created_at").desc(), F.col("shipment_id").desc()], 50, 100)


@query("P6_couriers_page", """
SELECT * FROM couriers ORDER BY name, courier_id LIMIT 20 OFFSET 20""")
def p6b(t):
    return reads.page(t.couriers, [F.col("name"), F.col("courier_id")], 20, 20)


@query("P6_deliveries_keyset_page", """
SELECT * FROM deliveries
WHERE created_at < timestamp '1998-07-01 00:00:00'
   OR (created_at = timestamp '1998-07-01 00:00:00' AND delivery_id < 1000000000)
ORDER BY created_at DESC, delivery_id DESC LIMIT 50""")
def p6c(t):
    return reads.keyset_page(t.deliveries, "created_at", "delivery_id", AS_OF_ORDERS, 1000000000, 50)


@query("P6b_items_by_name", """
SELECT * FROM items ORDER BY name, item_id""")
def p6d(t):
    return t.items.orderBy("name", "item_id")


@query("P7_latest_saga_per_shipment", """
SELECT shipment_id, saga_id, saga_type, status, started_at FROM (
  SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY started_at DESC, saga_id DESC) AS rn
  FROM saga_instances) WHERE rn = 1""")
def p7(t):
    return reads.latest_per_key(t.saga_instances, "shipment_id", ["started_at", "saga_id"],
                                ["saga_id", "saga_type", "status", "started_at"])


@query("P8_oldest_pending_records", """
SELECT * FROM blockchain_records WHERE upper(trim(status)) = 'PENDING' ORDER BY created_at, record_id LIMIT 50""")
def p8(t):
    return reads.oldest_pending(t.blockchain_records)


@query("P9_valid_tokens", f"""
SELECT * FROM refresh_tokens WHERE NOT revoked AND expires_at > timestamp '{AS_OF_ORDERS}'""")
def p9(t):
    return reads.valid_tokens(t.refresh_tokens, AS_OF_ORDERS)


@query("P10_shipment_lifecycle", """
SELECT shipment_id, lower(trim(status)) AS status, departure_date, arrival_date,
       upper(trim(status)) = 'COMPLETED' AS is_completed,
       upper(trim(status)) IN ('READY_FOR_DELIVERY', 'IN_TRANSIT') AS is_in_progress
FROM shipments""")
def p10(t):
    return reads.shipment_lifecycle(t.shipments)


@query("P11_recorder_target_events", """
SELECT * FROM domain_events
WHERE event_type IN ('shipment.created', 'shipment.updated', 'delivery.completed', 'inventory.released')""")
def p11a(t):
    return reads.event_types_in(t.domain_events, schemas.RECORDER_TARGET_EVENTS)


@query("P11_compensation_trigger_events", """
SELECT * FROM domain_events
WHERE event_type IN ('inventory.insufficient', 'delivery.failed', 'courier.unassigned', 'blockchain.verification_failed')""")
def p11b(t):
    return reads.event_types_in(t.domain_events, schemas.COMPENSATION_TRIGGER_EVENTS)


@query("P12_warehouses_flat", """
SELECT warehouse_id, name, json_extract_string(location, '$.country') AS country,
       json_extract_string(location, '$.city') AS city, json_extract_string(location, '$.address') AS address
FROM warehouses""")
def p12(t):
    return reads.flatten_location(t.warehouses)


@query("P13_item_token_search", """
SELECT * FROM items WHERE list_contains(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+'), 'red')""")
def p13a(t):
    return reads.token_search(t.items, ["name"], "red")


@query("P13_shipment_place_search", """
SELECT * FROM shipments
WHERE list_contains(regexp_extract_all(lower(origin), '[\\p{L}\\p{N}_]+'), 'europe')
   OR list_contains(regexp_extract_all(lower(destination), '[\\p{L}\\p{N}_]+'), 'europe')""")
def p13b(t):
    return reads.token_search(t.shipments, ["origin", "destination"], "europe")


@query("P14_latest_tracking_point", """
SELECT delivery_id, tracking_id, latitude, longitude, accuracy_meters, recorded_at FROM (
  SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY recorded_at DESC, tracking_id DESC) AS rn
  FROM delivery_tracking_points) WHERE rn = 1""")
def p14a(t):
    return reads.latest_per_key(t.delivery_tracking_points, "delivery_id", ["recorded_at", "tracking_id"],
                                ["tracking_id", "latitude", "longitude", "accuracy_meters", "recorded_at"])


@query("P14_track_history", """
SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY recorded_at DESC, tracking_id DESC) AS recency
FROM delivery_tracking_points""")
def p14b(t):
    return reads.track_history(t.delivery_tracking_points)


@query("P15_points_in_box", """
SELECT * FROM delivery_tracking_points
WHERE latitude BETWEEN -10 AND 45 AND longitude BETWEEN -30 AND 60""")
def p15(t):
    return reads.in_bounding_box(t.delivery_tracking_points, -10, 45, -30, 60)


@query("P16_records_by_payload_field", """
SELECT * FROM blockchain_records WHERE json_extract_string(payload, '$.k') = '9'""")
def p16a(t):
    return reads.json_field_equals(t.blockchain_records, "payload", "$.k", "9")


@query("P16_events_by_payload_reason", """
SELECT * FROM domain_events WHERE json_extract_string(payload, '$.reason') = 'r4'""")
def p16b(t):
    return reads.json_field_equals(t.domain_events, "payload", "$.reason", "r4")


# ---- J: joins --------------------------------------------------------------

@query("J1_deliveries_with_courier", """
SELECT d.delivery_id, d.shipment_id, d.courier_id, d.status, d.estimated_arrival, d.actual_arrival,
       d.created_at, d.updated_at, c.name AS courier_name, c.contact_info AS courier_contact
FROM deliveries d JOIN couriers c ON d.courier_id = c.courier_id""")
def j1(t):
    return joins.deliveries_with_courier(t.deliveries, t.couriers)


@query("J4_deliveries_with_known_courier", """
SELECT * FROM deliveries d WHERE EXISTS (SELECT 1 FROM couriers c WHERE c.courier_id = d.courier_id AND c.is_active)""")
def j4a(t):
    ok, _ = joins.split_by_parent(t.deliveries, t.couriers.where("is_active"), "courier_id")
    return ok


@query("J4_deliveries_with_inactive_courier", """
SELECT * FROM deliveries d WHERE NOT EXISTS (SELECT 1 FROM couriers c WHERE c.courier_id = d.courier_id AND c.is_active)""")
def j4b(t):
    _, bad = joins.split_by_parent(t.deliveries, t.couriers.where("is_active"), "courier_id")
    return bad


@query("J5_orphan_tracking_points", """
SELECT * FROM delivery_tracking_points p WHERE NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.delivery_id = p.delivery_id)""")
def j5(t):
    _, orphans = joins.split_by_parent(t.delivery_tracking_points, t.deliveries, "delivery_id")
    return orphans


@query("J10_tokens_with_user", """
SELECT t.user_id, t.token_id, t.token_hash, t.expires_at, t.revoked, u.username, u.role, u.is_active AS user_active
FROM refresh_tokens t JOIN users u ON t.user_id = u.user_id""")
def j10(t):
    return joins.tokens_with_user(t.refresh_tokens, t.users)


@query("S10_table_scan", """
SELECT delivery_id, courier_id, status, created_at FROM deliveries WHERE created_at >= timestamp '1998-01-01 00:00:00'""")
def s10(t):
    return (t.deliveries.select("delivery_id", "courier_id", "status", "created_at")
            .where(F.col("created_at") >= F.expr("timestamp_ntz '1998-01-01 00:00:00'")))


@query("J2_shipments_left_items", """
SELECT s.shipment_id, s.status, i.item_id, i.quantity, i.weight FROM shipments s LEFT JOIN items i ON s.shipment_id = i.shipment_id""")
def j2(t):
    return (t.shipments.select("shipment_id", "status")
            .join(t.items.select("shipment_id", "item_id", "quantity", "weight"), "shipment_id", "left"))


@query("A14_trace_assembly", """
SELECT correlation_id, event_id, event_type, ts,
       row_number() OVER (PARTITION BY correlation_id ORDER BY ts, event_id) AS position
FROM domain_events WHERE correlation_id IS NOT NULL""")
def a14(t):
    from cargolake.functions.sequences import hour_chunk, keyed_position
    ev = t.domain_events.where(F.col("correlation_id").isNotNull()).select("correlation_id", "event_id", "event_type", "ts")
    return keyed_position(ev, ["correlation_id"], ["ts", "event_id"], hour_chunk("ts"))


_TRACE_CAP = 60  # so that the fixture has traces of both forms
_STEPS_SQL = f"""steps AS (
  SELECT correlation_id, ts, 'event' AS kind, cast(event_id AS varchar) AS id, event_type AS label FROM domain_events
  UNION ALL SELECT correlation_id, ts, 'command', command_id, command_type FROM command_log
  UNION ALL SELECT correlation_id, ts, 'log', line_id, concat_ws(' ', level, message) FROM service_logs),
sized AS (SELECT *, count(*) OVER (PARTITION BY correlation_id) AS n FROM steps WHERE correlation_id IS NOT NULL)"""


@query("A14_short_traces", f"""
WITH {_STEPS_SQL}
SELECT correlation_id, cast(count(*) AS integer) AS n_steps, min(ts) AS first_ts, max(ts) AS last_ts,
       string_agg(kind || ':' || id || ':' || label, ' > ' ORDER BY ts, kind, id) AS path
FROM sized WHERE n <= {_TRACE_CAP} GROUP BY correlation_id""")
def a14_short(t):
    short, _ = traces.assemble(traces.steps(t.domain_events, t.command_log, t.service_logs), _TRACE_CAP)
    told = F.transform("steps", lambda s: F.concat_ws(":", s["kind"], s["id"], s["label"]))
    return short.select("correlation_id", "n_steps", "first_ts", "last_ts", F.array_join(told, " > ").alias("path"))


@query("A14_long_traces", f"""
WITH {_STEPS_SQL}
SELECT correlation_id, ts, kind, id, label, row_number() OVER (PARTITION BY correlation_id ORDER BY ts, kind, id) AS position
FROM sized WHERE n > {_TRACE_CAP}""")
def a14_long(t):
    return traces.assemble(traces.steps(t.domain_events, t.command_log, t.service_logs), _TRACE_CAP)[1]


@query("P12_deliveries_with_nested_courier", """
SELECT d.delivery_id, d.shipment_id, d.status, c.courier_id, c.name AS courier_name, c.contact_info AS courier_contact
FROM deliveries d JOIN couriers c ON d.courier_id = c.courier_id""")
def p12_nested(t):
    """The delivery read with its courier as one nested value."""
    rows = joins.deliveries_with_courier(t.deliveries, t.couriers, nested=True)
    return rows.select("delivery_id", "shipment_id", "status", F.col("courier.courier_id").alias("courier_id"),
                       F.col("courier.name").alias("courier_name"), F.col("courier.contact_info").alias("courier_contact"))
