"""Fixture views: the service tables derived from the driver's parquet tables.

The SELECT text of each view is written in the SQL subset shared by Spark and
DuckDB, so one string feeds both the Spark session and the DuckDB oracle
(inlined there as CTEs).  Views whose text must differ between the engines
carry a ``(spark, duckdb)`` pair.

Constant sides are never cross-joined: row counts enter as uncorrelated
scalar subqueries (Spark runs them once and inlines the literal), and the
three-way fan-out of ``transaction_confirmations`` is a generator.
"""

from __future__ import annotations

import re

from cargolake.operators.events import EVENT_REGISTRY

# Base tables shipped by the driver (one parquet file each).
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Default as_of instants (fixed values, see FIXTURES.md §3).
AS_OF_ORDERS = "1998-07-01 00:00:00"
AS_OF_EVENTS = "2024-01-30 12:00:00"

_ITEM_KEY = ("md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
             "cast(round(l_extendedprice * 100) as bigint), cast(l_quantity as int)))")

SHARED_VIEWS: dict[str, str] = {
    "shipments": """
SELECT o.o_orderkey AS shipment_id,
       concat('{"country":"', r.r_name, '","city":"', n.n_name, '","address":""}') AS origin,
       concat('{"country":"', r.r_name, '","city":"NATION_', cast((n.n_nationkey + 7) % 25 as string), '","address":""}') AS destination,
       case o.o_orderkey % 6 when 0 then 'created' when 1 then 'received' when 2 then 'ready_for_delivery'
            when 3 then 'in_transit' when 4 then 'delivered' else 'completed' end AS status,
       cast(o.o_orderdate as date) AS departure_date,
       case when o.o_orderkey % 6 >= 4 then cast(o.o_orderdate + interval '1' day * cast(o.o_orderkey % 30 as int) as date) end AS arrival_date,
       o.o_orderdate AS created_at,
       o.o_orderdate + interval '1' day * cast(o.o_orderkey % 30 as int) AS updated_at
FROM orders o join customer cu on o.o_custkey = cu.c_custkey
     join nation n on cu.c_nationkey = n.n_nationkey
     join region r on n.n_regionkey = r.r_regionkey""",
    "items": f"""
SELECT {_ITEM_KEY} AS item_id,
       l_orderkey AS shipment_id,
       p_name AS name,
       cast(l_quantity as int) AS quantity,
       cast(p_size as decimal(10,2)) AS weight
FROM lineitem join part on l_partkey = p_partkey""",
    "couriers": """
SELECT s_suppkey AS courier_id,
       s_name AS name,
       concat('{"phone":"+7900', cast(s_suppkey as string), '"}') AS contact_info,
       s_acctbal >= 0 AS is_active
FROM supplier""",
    "deliveries": """
SELECT o_orderkey AS delivery_id,
       o_orderkey AS shipment_id,
       o_custkey % (select cast(ceil(count(*) * 0.9) as bigint) from supplier) AS courier_id,
       case o_orderkey % 6 when 0 then 'ASSIGNED' when 1 then 'PICKED_UP' when 2 then 'IN_TRANSIT'
            when 3 then 'DELIVERED' when 4 then 'FAILED' else 'CANCELLED' end AS status,
       o_orderdate + interval '1' day * 5 AS estimated_arrival,
       case when o_orderkey % 6 = 3 then o_orderdate + interval '1' day * (cast(o_orderkey % 11 as int) - 1) end AS actual_arrival,
       o_orderdate AS created_at,
       o_orderdate + interval '1' day * cast(o_orderkey % 11 as int) AS updated_at
FROM orders""",
    "delivery_tracking_points": """
SELECT event_id AS tracking_id,
       event_id % (select cast(ceil(count(*) * 1.25) as bigint) from orders) AS delivery_id,
       cast(cast(event_id % 181 as int) - 90 as decimal(10,8)) AS latitude,
       cast(cast(event_id % 361 as int) - 180 as decimal(11,8)) AS longitude,
       case when event_type = 'error' then null else cast(event_id % 50 as int) end AS accuracy_meters,
       ts AS recorded_at
FROM events""",
    "warehouses": """
SELECT n_nationkey AS warehouse_id,
       n_name AS name,
       concat('{"country":"', r_name, '","city":"', n_name, '","address":""}') AS location
FROM nation join region on n_regionkey = r_regionkey""",
    "inventory_records": f"""
SELECT {_ITEM_KEY} AS record_id,
       l_orderkey AS shipment_id,
       s_nationkey AS warehouse_id,
       case when l_returnflag = 'A' then 'received' when l_returnflag = 'R' then 'shipped'
            when l_linestatus = 'O' then 'stored' else 'ready_for_delivery' end AS status,
       l_shipdate AS received_at,
       l_shipdate + interval '1' day AS updated_at
FROM lineitem join supplier on l_suppkey = s_suppkey""",
    "saga_instances": """
SELECT o_orderkey AS saga_id,
       o_orderpriority AS saga_type,
       o_orderkey AS shipment_id,
       case when o_orderkey % 5 = 0 then null else o_orderkey % 25 end AS warehouse_id,
       case when o_orderkey % 7 = 0 then null else o_orderkey end AS delivery_id,
       case o_orderkey % 5 when 0 then 'STARTED' when 1 then 'COMPENSATING' when 2 then 'COMPLETED'
            when 3 then 'FAILED' else 'CANCELLED' end AS status,
       o_orderdate AS started_at,
       o_orderdate + interval '1' hour * cast(o_orderkey % 30 as int) AS updated_at,
       case when o_orderkey % 5 >= 2 then o_orderdate + interval '1' hour * cast(o_orderkey % 30 as int) end AS completed_at,
       case when o_orderkey % 5 in (1, 3) then 'delivery.failed' end AS failed_step,
       cast(o_orderkey % 4 as int) AS retry_count
FROM orders""",
    "saga_steps": """
SELECT l_orderkey AS saga_id,
       concat('STEP_', cast(l_linenumber as string)) AS step_name,
       l_linenumber AS step_order,
       case when l_returnflag = 'A' then 'COMPLETED' when l_returnflag = 'R' then 'FAILED' else 'RUNNING' end AS status,
       l_shipdate AS started_at,
       case when l_returnflag <> 'N' then l_shipdate + interval '1' hour * l_linenumber end AS completed_at
FROM lineitem""",
    "shipment_changes": """
SELECT event_id AS change_seq,
       user_id AS shipment_id,
       case event_type when 'signup' then 'created' when 'view' then 'received' when 'click' then 'ready_for_delivery'
            when 'purchase' then 'in_transit' else 'delivered' end AS status,
       ts AS changed_at
FROM events""",
    "blockchain_records": """
SELECT event_id AS record_id,
       user_id AS shipment_id,
       concat('0x', md5(cast(event_id as string))) AS tx_hash,
       case event_type when 'click' then 'CONFIRMED' when 'view' then 'CONFIRMED' when 'purchase' then 'PENDING'
            when 'error' then 'FAILED' else 'DROPPED' end AS status,
       props AS payload,
       ts AS created_at,
       case when event_type in ('click', 'view') then ts + interval '1' second * cast(event_id % 3600 as int) end AS confirmed_at,
       100000 + event_id AS block_number,
       case when event_type = 'error' then null else cast(round(value * 100) as bigint) end AS gas_used,
       case event_id % 3 when 0 then 'ethereum' when 1 then 'polygon' else 'sepolia' end AS network
FROM events""",
    "receipts": """
SELECT concat('0x', md5(cast(case when event_id % 4 = 0 then -event_id - 1 else event_id end as string))) AS tx_hash,
       100000 + event_id AS block_number,
       cast(event_id % 12 as int) AS confirmations,
       case when event_id % 7 = 0 then 'failed' else 'success' end AS status,
       cast(21000 + event_id % 1000 as bigint) AS gas_used,
       ts + interval '1' minute AS block_time
FROM events
WHERE event_type = 'purchase'""",
    "domain_events": """
SELECT event_id AS event_id,
       case event_type when 'error' then 'delivery.failed' when 'click' then 'courier.unassigned'
            when 'view' then 'inventory.insufficient' when 'purchase' then 'shipment.updated' else 'shipment.created' end AS event_type,
       user_id AS aggregate_id,
       case when event_id % 10 = 0 then null
            else (event_id * 7) % (select cast(ceil(count(*) / 40) as bigint) from orders) + (case when event_id % 8 = 0 then 100000000 else 0 end) end AS correlation_id,
       case when event_id % 3 = 0 then '{}' else concat('{"reason":"r', cast(event_id % 9 as string), '"}') end AS payload,
       ts AS ts
FROM events""",
    "commands": """
SELECT md5(cast(event_id as string)) AS command_id,
       case event_type when 'error' then 'inventory.release' when 'click' then 'courier.unassign'
            when 'view' then 'shipment.cancel' else 'shipment.create' end AS command_type,
       case when event_id % 17 = 0 then -event_id - 1 else user_id end AS aggregate_id,
       concat('{"shipment_id":"', cast(case when event_id % 19 = 0 then -event_id - 1 else user_id end as string), '"}') AS payload,
       user_id AS correlation_id
FROM events""",
    "http_log": """
SELECT ts AS ts,
       concat('svc', cast(user_id % 5 as string)) AS service,
       case when event_type = 'purchase' then 'POST' else 'GET' end AS method,
       concat('/api/v1/', event_type) AS path,
       case when event_type = 'error' then 500 + cast(event_id % 3 as int) else 200 end AS status,
       value / 100 AS duration_s
FROM events""",
    "users": """
SELECT c_custkey AS user_id,
       c_name AS username,
       concat('u', cast(c_custkey % 1000 as string), '@example.com') AS email,
       case when c_custkey % 10 = 0 then 'admin' when c_custkey % 10 < 4 then 'viewer' else 'operator' end AS role,
       c_acctbal >= 0 AS is_active
FROM customer""",
    "refresh_tokens": """
SELECT o_orderkey AS token_id,
       o_custkey AS user_id,
       md5(cast(o_orderkey as string)) AS token_hash,
       o_orderdate + interval '1' day * 30 AS expires_at,
       o_orderkey % 5 = 0 AS revoked
FROM orders""",
    "messages": """
SELECT concat('@u', cast(conv_id as string)) AS username,
       conv_id * 1000 + turn AS message_id,
       text AS text
FROM conversations""",
}

# Change sets derived from the driver tables (inputs of the keyed writes).
SHARED_VIEWS.update({
    "shipment_patches": """
SELECT change_seq AS patch_seq, shipment_id,
       case when change_seq % 3 = 0 then null else status end AS status,
       case when change_seq % 7 = 0 then concat('{"country":"PATCHED","city":"C', cast(change_seq % 10 as string), '","address":""}') end AS destination
FROM shipment_changes""",
    "delivery_patches": """
SELECT event_id AS patch_seq, case when event_id % 11 = 0 then -event_id - 1 else aggregate_id end AS delivery_id,
       case when event_id % 2 = 0 then 'IN_TRANSIT' end AS status,
       case when event_id % 5 = 0 then ts end AS actual_arrival,
       case when event_id % 3 = 0 then ts + interval '2' day end AS estimated_arrival,
       case when event_id % 4 = 0 then event_id % (select cast(ceil(count(*) * 1.2) as bigint) from supplier) end AS courier_id
FROM domain_events""",
    "command_log": """
SELECT md5(concat('c', cast(event_id as string))) AS command_id,
       case event_type when 'delivery.failed' then 'courier.unassign' when 'courier.unassigned' then 'inventory.release' else 'shipment.cancel' end AS command_type,
       correlation_id AS correlation_id, ts + interval '1' second AS ts
FROM domain_events WHERE event_type in ('delivery.failed', 'courier.unassigned', 'inventory.insufficient')""",
    "service_logs": """
SELECT concat('log-', cast(event_id as string)) AS line_id, case when event_type = 'delivery.failed' then 'ERROR' else 'INFO' end AS level,
       concat('handled ', event_type) AS message, correlation_id AS correlation_id, ts + interval '2' second AS ts
FROM domain_events""",
    "saga_context_patches": """
SELECT event_id AS patch_seq, correlation_id AS saga_id,
       case when event_type = 'inventory.insufficient' then aggregate_id % 25 end AS warehouse_id,
       case when event_type = 'courier.unassigned' then aggregate_id end AS delivery_id
FROM domain_events WHERE correlation_id IS NOT NULL""",
    "item_quantity_changes": """
SELECT item_id, case when quantity % 3 = 0 then -quantity else 1 end AS delta FROM items""",
    "courier_contact_changes": """
SELECT event_id AS change_seq, event_id % (select cast(ceil(count(*) * 1.1) as bigint) from supplier) AS courier_id,
       concat('{"phone":"+7901', cast(event_id as string), '"}') AS contact_info
FROM events WHERE event_type = 'signup'""",
    "token_presentations": """
SELECT md5(cast(o_orderkey as string)) AS token_hash FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT md5(concat('unknown-', cast(o_orderkey as string))) AS token_hash FROM orders WHERE o_orderstatus = 'P'""",
    "saga_changes": """
SELECT event_id AS change_seq, correlation_id AS saga_id,
       case event_type when 'delivery.failed' then 'FAILED' when 'courier.unassigned' then 'COMPENSATING'
            when 'inventory.insufficient' then 'FAILED' when 'shipment.updated' then 'COMPLETED' else 'STARTED' end AS status,
       ts AS changed_at, 'AUTO' AS saga_type, aggregate_id AS shipment_id,
       case when event_type in ('delivery.failed', 'courier.unassigned', 'inventory.insufficient') then event_type end AS failed_step
FROM domain_events WHERE correlation_id IS NOT NULL""",
    "shipment_verbs": """
SELECT event_id AS verb_seq, user_id AS shipment_id,
       case event_type when 'view' then 'receive' when 'click' then 'ready' when 'purchase' then 'dispatch'
            when 'signup' then 'deliver' else 'complete' end AS verb
FROM events""",
    "delivery_requests": """
SELECT event_id AS request_seq, case when event_id % 13 = 0 then -event_id - 1 else user_id end AS delivery_id,
       case event_type when 'view' then 'receive' when 'click' then 'in_transit' when 'purchase' then 'deliver'
            when 'signup' then 'confirm' else 'ready' end AS verb,
       case when event_type = 'purchase' then ts end AS arrival
FROM events""",
    "inventory_requests": """
SELECT record_id, 1 AS request_seq, case when shipment_id % 2 = 0 then 'stored' else 'shipped' end AS new_status FROM inventory_records
UNION ALL
SELECT case when shipment_id % 9 = 0 then concat('unknown-', record_id) else record_id end AS record_id, 2 AS request_seq,
       case when shipment_id % 3 = 0 then 'shipped' else 'ready_for_delivery' end AS new_status FROM inventory_records
UNION ALL
SELECT record_id, 3 AS request_seq, 'stored' AS new_status FROM inventory_records WHERE status <> 'shipped'""",
    "saga_requests": """
SELECT event_id AS request_seq, correlation_id AS saga_id,
       case event_type when 'shipment.updated' then 'complete' when 'courier.unassigned' then 'compensate'
            when 'delivery.failed' then 'fail' else 'complete' end AS action
FROM domain_events WHERE correlation_id IS NOT NULL""",
    "courier_assignments": """
SELECT event_id AS assign_seq, aggregate_id AS delivery_id, event_id % (select count(*) from supplier) AS courier_id
FROM domain_events WHERE event_type = 'courier.unassigned'""",
})


def _changes(table: str, key: str, part: str, fresh: str, values: dict[str, str]) -> str:
    """Two versions of some rows of ``table`` and some rows it lacks; ``{n}`` in a
    value is the version."""
    def version(n: int, key_sql: str, every: int) -> str:
        cols = ", ".join(f"{sql.format(n=n)} AS {name}" for name, sql in values.items())
        return f"SELECT {n} AS change_seq, {key_sql} AS {key}, {cols} FROM {table} WHERE {part} % {every} = 0"

    return (version(1, key, 3) + "\nUNION ALL\n" + version(2, key, 6) + "\nUNION ALL\n" + version(3, fresh, 7)
            + "\nUNION ALL\n" + version(4, fresh, 14))


def _typed_events() -> str:
    """Events of every registered type and one unknown one; a payload holds every
    field that some type knows, or none."""
    types = " ".join(f"when {i} then '{name}'" for i, (name, _, _) in enumerate(EVENT_REGISTRY))
    texts = ", ".join(f"'\"{f}\":\"{f}-', cast(event_id as string), '\",'" for f in (
        "shipment_id", "origin", "destination", "status", "updated_at", "reason", "cancelled_at", "warehouse_id", "dispatched_at",
        "reserved_at", "released_at", "item_id", "delivery_id", "courier_id", "estimated_delivery", "assigned_at", "unassigned_at",
        "pickup_location", "started_at", "current_location", "delivered_at", "recipient_name", "recipient_signature", "failed_at",
        "retry_scheduled", "record_id", "transaction_hash", "recorded_at", "verified_at", "saga_id", "saga_type", "initiated_by",
        "completed_at", "error_message", "failed_step", "compensating_at"))
    numbers = ", ".join(f"'\"{f}\":', cast(event_id % 80 as string), '{tail},'" for f, tail in (
        ("latitude", ".5"), ("longitude", ".25"), ("new_quantity", ""), ("block_number", ""), ("confirmations", "")))
    lists = ", ".join(f"'\"{f}\":[{{\"item_id\":\"i', cast(event_id as string), '\",\"quantity\":\"2\"}}]{tail}'"
                      for f, tail in (("items", ","), ("missing_items", "}")))
    return f"""
SELECT event_id AS event_id, case event_id % {len(EVENT_REGISTRY) + 1} {types} else 'parcel.lost' end AS event_type,
       user_id AS aggregate_id, case when event_id % 10 = 0 then null else event_id % 7 end AS correlation_id,
       case when event_id % 10 = 3 then '{{}}' else concat('{{', {texts}, {numbers}, {lists}) end AS payload, ts AS ts
FROM events"""


_JULY = "timestamp '2024-07-0{n} 00:00:00'"
SHARED_VIEWS.update({
    "shipment_rows": _changes("shipments", "shipment_id", "shipment_id", "-shipment_id - 1", {
        "origin": "destination", "destination": "origin", "status": "case when {n} % 2 = 1 then 'received' else 'in_transit' end"}),
    "item_rows": _changes("items", "item_id", "shipment_id", "concat('new-', item_id)", {
        "shipment_id": "shipment_id", "name": "concat(name, ' v{n}')", "quantity": "quantity + {n}", "weight": "weight"}),
    "courier_rows": _changes("couriers", "courier_id", "courier_id", "-courier_id - 1", {
        "name": "concat(name, ' v{n}')", "contact_info": "contact_info"}),
    "delivery_rows": _changes("deliveries", "delivery_id", "delivery_id", "-delivery_id - 1", {
        "shipment_id": "shipment_id", "courier_id": "courier_id + {n}", "status": "case when {n} % 2 = 1 then 'IN_TRANSIT' else 'DELIVERED' end",
        "estimated_arrival": "estimated_arrival", "actual_arrival": "case when {n} % 2 = 0 then " + _JULY + " end",
        "created_at": _JULY, "updated_at": _JULY}),
    "warehouse_rows": _changes("warehouses", "warehouse_id", "warehouse_id", "-warehouse_id - 1", {
        "name": "concat(name, ' v{n}')", "location": "location"}),
    "inventory_rows": _changes("inventory_records", "record_id", "shipment_id", "concat('new-', record_id)", {
        "shipment_id": "shipment_id", "warehouse_id": "warehouse_id + {n}", "status": "'stored'", "received_at": _JULY, "updated_at": _JULY}),
    "saga_rows": _changes("saga_instances", "saga_id", "saga_id", "-saga_id - 1", {
        "saga_type": "concat('type v', cast({n} as string))", "shipment_id": "shipment_id", "warehouse_id": "warehouse_id", "delivery_id": "delivery_id",
        "status": "'FAILED'", "started_at": _JULY, "updated_at": _JULY, "failed_step": "concat('step ', cast({n} as string))"}),
    "record_rows": _changes("blockchain_records", "record_id", "record_id", "-record_id - 1", {
        "shipment_id": "shipment_id", "tx_hash": "tx_hash", "status": "'CONFIRMED'", "payload": "payload", "created_at": _JULY,
        "confirmed_at": _JULY, "block_number": "block_number + {n}", "gas_used": "gas_used"}),
    "user_rows": _changes("users", "user_id", "user_id", "-user_id - 1", {
        "username": "concat(username, ' v{n}')", "email": "email", "role": "'viewer'", "is_active": "not is_active"}),
    "posts": """
SELECT message_id, concat(text, case message_id % 7 when 0 then ' Ищу работа' when 1 then ' ОЗОН' when 2 then ' управляющий складом'
                                when 3 then ' помощник' when 4 then ' WB нужен менеджер' else '' end) AS text
FROM messages""",
    "warehouse_patches": """
SELECT event_id AS patch_seq, event_id % (select cast(ceil(count(*) * 1.2) as bigint) from nation) AS warehouse_id,
       case when event_id % 5 = 0 then concat('W', cast(event_id as string)) end AS name,
       case when event_id % 3 = 0 then concat('C', cast(event_id % 9 as string)) end AS country,
       case when event_id % 4 = 0 then concat('T', cast(event_id % 99 as string)) end AS city,
       cast(null as string) AS address
FROM events""",
    "item_weight_changes": """
SELECT 1 AS change_seq, case when shipment_id % 10 = 0 then concat('unknown-', item_id) else item_id end AS item_id,
       cast(weight + 0.5 as decimal(10,2)) AS weight FROM items WHERE shipment_id % 2 = 0""",
    "warehouse_locations": """
SELECT event_id AS change_seq, event_id % (select cast(ceil(count(*) * 1.2) as bigint) from nation) AS warehouse_id,
       concat('{"country":"C","city":"T', cast(event_id as string), '","address":"A"}') AS location
FROM events WHERE event_type = 'view'""",
    "typed_events": _typed_events(),
    "blockchain_events": """
SELECT event_id AS event_id, case when event_id % 9 = 0 then -event_id - 1 else event_id end AS record_id,
       case when event_id % 2 = 0 then 'ShipmentRecorded' else 'ShipmentVerified' end AS event_name,
       props AS event_data, 100000 + event_id AS block_number, ts AS detected_at
FROM events""",
})


def _staged(table: str, part: str, **columns: str) -> str:
    """Rows of ``table`` as a load might bring them: each listed column has its
    faults.  ``a | b`` in a column's text are faults of rows apart from each other
    (every 11th, 13th ... by ``part``); the column itself stays elsewhere."""
    steps, out = iter((11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59)), []
    for name, faults in columns.items():
        cases = " ".join(f"when {part} % {next(steps)} = 3 then {f.strip()}" for f in faults.split(" | ")) if faults else ""
        out.append(f"case {cases} else {name} end AS {name}" if faults else name)
    return f"SELECT {', '.join(out)} FROM {table}"


_NO_CITY, _NO_COUNTRY = """'{"country":"A","city":" "}'""", """'{"country":"","city":"B"}'"""
SHARED_VIEWS.update({
    "staged_shipments": _staged("shipments", "shipment_id", shipment_id="", origin=f"null | {_NO_COUNTRY}", destination=f"null | {_NO_CITY}",
                                status="null | 'lost' | repeat('x', 60)", created_at="null", updated_at="null"),
    "staged_items": _staged("items", "shipment_id", item_id="null", shipment_id="null", name="null | repeat('n', 300)",
                            quantity="null | 0 | -1", weight="null | 0 | -1"),
    "staged_couriers": _staged("couriers", "courier_id", courier_id="", name="'x' | repeat('n', 120)", contact_info="' 12 '"),
    "staged_deliveries": _staged("deliveries", "delivery_id", delivery_id="", shipment_id="null", courier_id="null", status="null | 'lost'",
                                 created_at="", actual_arrival="created_at - interval '1' day"),
    "staged_points": _staged("delivery_tracking_points", "tracking_id", tracking_id="", delivery_id="null",
                             latitude="null | cast(95 as decimal(10,8))", longitude="null | cast(-190 as decimal(11,8))",
                             accuracy_meters="0", recorded_at="null"),
    "staged_warehouses": _staged("warehouses", "warehouse_id", warehouse_id="", name="repeat('n', 300)", location=f"null | {_NO_CITY} | {_NO_COUNTRY}"),
    "staged_inventory": _staged("inventory_records", "shipment_id", record_id="", shipment_id="null", warehouse_id="null", status="null | 'lost'"),
    "staged_sagas": _staged("saga_instances", "saga_id", saga_id="", saga_type="null | repeat('t', 120)", shipment_id="null", status="null | 'LOST'",
                            started_at="null", completed_at="timestamp '1970-01-01 00:00:00'", retry_count="-1"),
    "staged_steps": _staged("saga_steps", "saga_id", saga_id="", step_name="", step_order="-1", status="'LOST'", started_at="",
                            completed_at="timestamp '1970-01-01 00:00:00'"),
    "staged_records": _staged("blockchain_records", "record_id", record_id="", shipment_id="null", tx_hash="null", status="null | 'LOST'",
                              block_number="-1", network="repeat('n', 60)"),
    "staged_checks": _staged("transaction_confirmations", "record_id", record_id="", block_number="-1", confirmation_count="-2"),
    "staged_users": _staged("users", "user_id", user_id="", username="null", email="null", role="'root'"),
    "staged_shipment_history": """
SELECT change_seq, case when change_seq % 11 = 3 then null else shipment_id end AS shipment_id,
       case change_seq % 7 when 0 then 'PENDING' when 1 then 'in_transit' when 2 then 'DELIVERED' when 3 then 'CANCELLED'
            when 4 then 'DELAYED' when 5 then null else status end AS new_status, changed_at AS changed_at FROM shipment_changes""",
    "staged_delivery_history": """
SELECT delivery_id, case when delivery_id % 13 = 3 then 'lost' when delivery_id % 17 = 3 then null else status end AS new_status,
       updated_at AS changed_at FROM deliveries""",
    "staged_saga_events": """
SELECT change_seq, case when change_seq % 13 = 3 then null else saga_id end AS saga_id,
       case change_seq % 5 when 0 then 'SAGA_STARTED' when 1 then 'STEP_FAILED' when 2 then 'SAGA_LOST' when 3 then null else 'SAGA_FAILED' end AS event_type,
       changed_at AS occurred_at FROM saga_changes""",
    "staged_nonces": """
SELECT concat(case when record_id % 11 = 3 then '0x0x' else '0x' end, substr(concat(tx_hash, tx_hash), 3, 40)) AS address,
       case when record_id % 13 = 3 then null else network end AS network, record_id % 17 - 1 AS current_nonce FROM blockchain_records
UNION ALL
SELECT concat('0x', substr(concat(tx_hash, tx_hash), 3, 40)) AS address, network, 1 AS current_nonce FROM blockchain_records WHERE record_id % 19 = 3""",
    "staged_envelopes": """
SELECT event_id AS row_id, case when event_id % 11 = 3 then 'no-uuid'
            else concat(substr(md5(cast(event_id as string)), 1, 8), '-0000-4000-8000-', substr(md5(cast(event_id as string)), 1, 12)) end AS event_id,
       concat('2024-01-01T00:00:00', case event_id % 5 when 0 then 'Z' when 1 then '+03:00' when 2 then '' else '+00:00' end) AS timestamp
FROM events""",
})

_CONF_COLS = """case when event_id % 10 = 0 then -event_id - 1 else event_id end AS record_id,
       100000 + event_id + k AS block_number,
       cast(k * (event_id % 5) as int) AS confirmation_count,
       ts + interval '1' minute * k AS checked_at"""

# Views whose text differs between the engines: (spark, duckdb).
ENGINE_VIEWS: dict[str, tuple[str, str]] = {
    "transaction_confirmations": (
        f"SELECT {_CONF_COLS}\nFROM events LATERAL VIEW explode(array(1, 2, 3)) z AS k",
        f"SELECT {_CONF_COLS}\nFROM events, unnest([1, 2, 3]) z(k)",
    ),
    # Distinct lower-case message tokens, each mapped to an embedding row by
    # the first 32 bits of md5(word), modulo the embedding row count.
    "word_vectors": (
        """SELECT w.word AS word, e.embedding AS vec
FROM (SELECT DISTINCT word,
             cast(conv(substr(md5(word), 1, 8), 16, 10) as bigint) % (select count(*) from embeddings) AS vid
      FROM (SELECT explode(regexp_extract_all(lower(text), '([\\\\p{L}\\\\p{N}_]+)', 1)) AS word FROM messages) t) w
JOIN embeddings e ON e.vec_id = w.vid""",
        """SELECT w.word AS word, e.embedding AS vec
FROM (SELECT DISTINCT word,
             cast(concat('0x', substr(md5(word), 1, 8)) as bigint) % (select count(*) from embeddings) AS vid
      FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM messages) t) w
JOIN embeddings e ON e.vec_id = w.vid""",
    ),
}

VIEW_NAMES = tuple(SHARED_VIEWS) + tuple(ENGINE_VIEWS)


def view_sql(name: str, engine: str) -> str:
    if name in SHARED_VIEWS:
        return SHARED_VIEWS[name]
    spark_text, duck_text = ENGINE_VIEWS[name]
    return spark_text if engine == "spark" else duck_text


def _referenced(sql: str, names) -> list[str]:
    return [n for n in names if re.search(rf"\b{n}\b", sql)]


def with_views(sql: str, engine: str = "duckdb") -> str:
    """Prefix ``sql`` with CTEs for every fixture view it (transitively) uses."""
    needed: list[str] = []
    frontier = _referenced(sql, VIEW_NAMES)
    while frontier:
        name = frontier.pop()
        if name in needed:
            continue
        needed.append(name)
        frontier.extend(n for n in _referenced(view_sql(name, engine), VIEW_NAMES) if n != name)
    # dependencies first: a view may only reference views defined before it
    ordered: list[str] = []

    def visit(n):
        if n in ordered:
            return
        for dep in _referenced(view_sql(n, engine), VIEW_NAMES):
            if dep != n:
                visit(dep)
        ordered.append(n)

    for n in needed:
        visit(n)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({view_sql(n, engine)}\n)" for n in ordered)
    body = sql.strip()
    recursive = re.match(r"(?i)^with\s+recursive\s", body)
    if recursive:
        return f"WITH RECURSIVE {ctes},\n{body[recursive.end():]}"
    if re.match(r"(?i)^with\s", body):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
