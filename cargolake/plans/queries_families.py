"""Registered members of operator families: typed payloads (T3), change events
(T11), cascades (U5), timelines (H10) and the side outputs of T1, T6 and T9."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolake.operators import chain, events as ev, history as h, sagas
from cargolake.operators import writes as w
from cargolake.plans import queries_history, queries_streams, queries_writes  # noqa: F401
from cargolake.plans.catalog import REGISTRY, query
from cargolake.plans.queries_streams import _ISO, _REG_VALUES, _T8_SQL, _duuid
from cargolake.plans.queries_writes import _policy_oracle, _policy_query
from cargolake.sources.fixtures import AS_OF_EVENTS as NOW

_T = f"timestamp '{NOW}'"
_NOW_TEXT = f"strftime({_T}, {_ISO})"

# ---- T3: one typed view per event type ---------------------------------------


def _field_sql(field: str, kind: str) -> str:
    if kind.startswith("ARRAY"):
        return f"json_extract(d.payload, '$.{field}')::varchar AS {field}"
    text = f"json_extract_string(d.payload, '$.{field}')"
    return f"{text} AS {field}" if kind == "STRING" else f"cast({text} as {kind}) AS {field}"


def _typed_oracle(event_type: str) -> str:
    fields = [f.split(" ", 1) for f in ev.PAYLOAD_SCHEMAS[event_type].split(", ")]
    return f"""
SELECT {_duuid('d.event_id')} AS event_id, {_duuid('d.aggregate_id')} AS aggregate_id, d.ts AS timestamp,
       CASE WHEN d.correlation_id IS NOT NULL THEN {_duuid('d.correlation_id')} END AS correlation_id,
       {', '.join(_field_sql(*f) for f in fields)}
FROM typed_events d WHERE d.event_type = '{event_type}'"""


def _typed_query(event_type: str):
    def build(t):
        df = ev.typed_payloads(ev.to_envelopes(t.typed_events)[0], event_type)
        return df.select(*[F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes])
    return build


for _type in ev.PAYLOAD_SCHEMAS:
    query(f"T3_payload_{_type.replace('.', '_')}", _typed_oracle(_type))(_typed_query(_type))


@query("T1_unknown_event_types", "SELECT event_id AS source_id, event_type, 'unknown_event_type' AS reason FROM typed_events WHERE event_type = 'parcel.lost'")
def t1_unknown(t):
    return ev.to_envelopes(t.typed_events)[1]


# ---- T6, T9: side outputs -----------------------------------------------------

@query("T6b_unassign_warnings", """
SELECT command_id, aggregate_id AS delivery_id, 'delivery_not_found' AS warning FROM commands c
WHERE command_type = 'courier.unassign' AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.delivery_id = c.aggregate_id)""")
def t6b_warnings(t):
    return sagas.apply_unassign(t.commands, t.deliveries)[1]


_CANCELLED = "(SELECT cast(json_extract_string(payload, '$.shipment_id') as bigint) FROM commands WHERE command_type = 'shipment.cancel')"


@query("T6c_cancel_remaining_items", f"SELECT * FROM items WHERE shipment_id NOT IN {_CANCELLED}")
def t6c_items(t):
    return sagas.apply_cancel(t.commands, t.shipments, t.items)[1]


@query("T6c_cancel_audit", """
SELECT c.command_id, cast(json_extract_string(c.payload, '$.shipment_id') as bigint) AS shipment_id,
       CASE WHEN s.shipment_id IS NULL THEN 'shipment_not_found' ELSE 'deleted' END AS result
FROM commands c LEFT JOIN shipments s ON s.shipment_id = cast(json_extract_string(c.payload, '$.shipment_id') as bigint)
WHERE c.command_type = 'shipment.cancel'""")
def t6c_audit(t):
    return sagas.apply_cancel(t.commands, t.shipments, t.items)[2]


_VERIFIED_ID = "'verified:' || cast(record_id as varchar)"


@query("T9_verified_envelopes", f"""
WITH {_T8_SQL}
SELECT {_duuid(_VERIFIED_ID)} AS event_id, 'blockchain.verified' AS event_type, {_duuid('record_id')} AS aggregate_id,
       'blockchain_record' AS aggregate_type, 'record_id' AS id_field,
       json_object('record_id', {_duuid('record_id')}, 'shipment_id', {_duuid('shipment_id')}, 'transaction_hash', tx_hash,
                   'verified_at', strftime(confirmed_at, {_ISO}), 'confirmations', 6)::varchar AS payload,
       confirmed_at AS timestamp, cast(null as varchar) AS correlation_id
FROM tr WHERE transition = 'confirmed'""")
def t9_envelopes(t):
    return chain.verified_envelopes(chain.track_confirmations(t.blockchain_records, t.receipts))


# ---- T11: change events of items, deliveries and inventory ---------------------

def _after(table: str, gone: str) -> str:
    return f"(SELECT * FROM ({_policy_oracle(table)}) z WHERE NOT ({gone}))"


@query("T11_item_change_events", f"""
SELECT coalesce(n.item_id, o.item_id) AS item_id, coalesce(n.shipment_id, o.shipment_id) AS aggregate_id, 'shipment.updated' AS event_type,
       json_object('shipment_id', cast(coalesce(n.shipment_id, o.shipment_id) as varchar), 'status', 'items_updated',
                   'updated_at', {_NOW_TEXT})::varchar AS payload, {_T} AS ts
FROM items o FULL JOIN {_after('items', 'quantity % 10 = 9')} n ON o.item_id = n.item_id
WHERE o.item_id IS NULL OR n.item_id IS NULL
   OR (o.shipment_id, o.name, o.quantity, o.weight) IS DISTINCT FROM (n.shipment_id, n.name, n.quantity, n.weight)""")
def t11_items(t):
    new = _policy_query("items")(t).where("NOT (quantity % 10 = 9)")
    return ev.item_change_events(t.items, new, NOW)


_DELIVERY_KEY = "'delivery_id', cast(n.delivery_id as varchar)"
_DELIVERY_CHANGED = f"FROM {_after('deliveries', 'delivery_id % 17 = 0')} n LEFT JOIN deliveries o ON o.delivery_id = n.delivery_id"


@query("T11_delivery_change_events", f"""
SELECT n.delivery_id, n.delivery_id AS aggregate_id, 'courier.assigned' AS event_type,
       json_object({_DELIVERY_KEY}, 'courier_id', cast(n.courier_id as varchar), 'shipment_id', cast(n.shipment_id as varchar),
                   'estimated_delivery', coalesce(strftime(date_trunc('day', n.estimated_arrival)::timestamp, {_ISO}), {_NOW_TEXT}),
                   'assigned_at', {_NOW_TEXT})::varchar AS payload, {_T} AS ts
{_DELIVERY_CHANGED} WHERE o.delivery_id IS NULL OR o.courier_id IS DISTINCT FROM n.courier_id
UNION ALL
SELECT n.delivery_id, n.delivery_id, 'delivery.in_transit',
       json_object({_DELIVERY_KEY}, 'current_location', 'Warehouse', 'latitude', null, 'longitude', null, 'updated_at', {_NOW_TEXT})::varchar, {_T}
{_DELIVERY_CHANGED} WHERE o.status <> 'IN_TRANSIT' AND n.status = 'IN_TRANSIT'
UNION ALL
SELECT n.delivery_id, n.delivery_id, 'delivery.completed',
       json_object({_DELIVERY_KEY}, 'delivered_at', {_NOW_TEXT}, 'recipient_name', 'Unknown', 'recipient_signature', null)::varchar, {_T}
{_DELIVERY_CHANGED} WHERE o.status <> 'DELIVERED' AND n.status = 'DELIVERED'""")
def t11_deliveries(t):
    new = _policy_query("deliveries")(t).where("NOT (delivery_id % 17 = 0)")
    return ev.delivery_change_events(t.deliveries, new, NOW)


_INVENTORY_AFTER = _after("inventory_records", "shipment_id % 11 = 0")


@query("T11_inventory_change_events", f"""
SELECT n.record_id, n.warehouse_id AS aggregate_id, 'inventory.reserved' AS event_type,
       json_object('warehouse_id', cast(n.warehouse_id as varchar), 'shipment_id', cast(n.shipment_id as varchar), 'items', json('[]'),
                   'reserved_at', {_NOW_TEXT})::varchar AS payload, {_T} AS ts
FROM {_INVENTORY_AFTER} n WHERE n.record_id NOT IN (SELECT record_id FROM inventory_records)
UNION ALL
SELECT n.record_id, n.warehouse_id, 'inventory.updated',
       json_object('warehouse_id', cast(n.warehouse_id as varchar), 'item_id', n.record_id, 'new_quantity', 0, 'updated_at', {_NOW_TEXT})::varchar, {_T}
FROM {_INVENTORY_AFTER} n JOIN inventory_records o ON o.record_id = n.record_id WHERE o.status <> n.status
UNION ALL
SELECT o.record_id, o.warehouse_id, 'inventory.released',
       json_object('warehouse_id', cast(o.warehouse_id as varchar), 'shipment_id', cast(o.shipment_id as varchar), 'items', json('[]'),
                   'released_at', {_NOW_TEXT}, 'reason', 'record_deleted')::varchar, {_T}
FROM inventory_records o WHERE o.record_id NOT IN (SELECT record_id FROM {_INVENTORY_AFTER} n)""")
def t11_inventory(t):
    new = _policy_query("inventory_records")(t).where("NOT (shipment_id % 11 = 0)")
    return ev.inventory_change_events(t.inventory_records, new, NOW)


# ---- U5, H10: children and histories --------------------------------------------

# derived tables: the registered query that gives them
HISTORIES = {"shipment_status_history": "H2_shipment_status_history", "delivery_status_history": "H1_delivery_status_history",
             "saga_events": "H3_saga_events"}


def child(t, name: str):
    return REGISTRY[HISTORIES[name]].build(t) if name in HISTORIES else getattr(t, name)


def child_sql(name: str) -> str:
    return f"({REGISTRY[HISTORIES[name]].oracle})" if name in HISTORIES else name


# child -> (foreign key, parent, its key, which parents are deleted)
_CASCADES = {
    "shipment_status_history": ("shipment_id", "shipments", "shipment_id", "shipment_id % 3 = 0"),
    "delivery_tracking_points": ("delivery_id", "deliveries", "delivery_id", "status = 'CANCELLED'"),
    "delivery_status_history": ("delivery_id", "deliveries", "delivery_id", "status = 'CANCELLED'"),
    "inventory_records": ("warehouse_id", "warehouses", "warehouse_id", "warehouse_id % 5 = 0"),
    "saga_steps": ("saga_id", "saga_instances", "saga_id", "status = 'CANCELLED'"),
    "saga_events": ("saga_id", "saga_instances", "saga_id", "status = 'CANCELLED'"),
    "transaction_confirmations": ("record_id", "blockchain_records", "record_id", "status = 'DROPPED'"),
    "blockchain_events": ("record_id", "blockchain_records", "record_id", "status = 'DROPPED'"),
    "refresh_tokens": ("user_id", "users", "user_id", "NOT is_active"),
}


def _cascade_query(name: str):
    fk, parent, key, gone = _CASCADES[name]

    def build(t):
        keys = getattr(t, parent).where(gone).select(key)
        return w.cascade_delete(keys, key, {name: (child(t, name), fk)})[name]
    return build


for _child, (_fk, _parent, _key, _gone) in _CASCADES.items():
    query(f"U5_cascade_{_child}", f"""
SELECT * FROM {child_sql(_child)} c
WHERE NOT EXISTS (SELECT 1 FROM {_parent} p WHERE {_gone.replace(_key, 'p.' + _key)} AND p.{_key} = c.{_fk})""")(_cascade_query(_child))


# name -> (table, key, time, tie)
_TIMELINES = {"shipment": ("shipment_status_history", "shipment_id", "changed_at", "change_seq"),
              "delivery": ("delivery_status_history", "delivery_id", "changed_at", "new_status"),
              "saga": ("saga_events", "saga_id", "occurred_at", "change_seq"),
              "chain": ("blockchain_events", "record_id", "detected_at", "event_id")}


def _timeline_query(name: str):
    table, key, at, tie = _TIMELINES[name]
    return lambda t: h.timeline(child(t, table), key, at, tie)


for _name, (_table, _key, _at, _tie) in _TIMELINES.items():
    query(f"H10_{_name}_timeline", f"""
SELECT *, row_number() OVER (PARTITION BY {_key} ORDER BY {_at} DESC, {_tie} DESC) AS recency FROM {child_sql(_table)} c""")(_timeline_query(_name))
