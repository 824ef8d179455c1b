"""Registered keyed-write queries (U1-U14).  Apply time = AS_OF_EVENTS."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolake.functions.common import ts_lit
from cargolake.operators import writes as w
from cargolake.plans.catalog import query
from cargolake.sources.fixtures import AS_OF_EVENTS as NOW
from cargolake.sources.fixtures import AS_OF_ORDERS as TOKEN_NOW

_T = f"timestamp '{NOW}'"


@query("U1_upsert_shipment_status", f"""
WITH last AS (
  SELECT shipment_id, status FROM (
    SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY changed_at DESC, change_seq DESC) AS rn
    FROM shipment_changes) WHERE rn = 1)
SELECT coalesce(s.shipment_id, l.shipment_id) AS shipment_id, s.origin, s.destination,
       CASE WHEN l.shipment_id IS NOT NULL THEN l.status ELSE s.status END AS status,
       s.departure_date, s.arrival_date,
       CASE WHEN s.shipment_id IS NULL THEN {_T} ELSE s.created_at END AS created_at,
       CASE WHEN l.shipment_id IS NOT NULL THEN {_T} ELSE s.updated_at END AS updated_at
FROM shipments s FULL OUTER JOIN last l ON s.shipment_id = l.shipment_id""")
def u1(t):
    return w.upsert(t.shipments, t.shipment_changes, "shipment_id", ["status"], ["changed_at", "change_seq"], NOW)


@query("U11_touched_rows", f"""
SELECT s.shipment_id, {_T} AS updated_at FROM shipments s
WHERE s.shipment_id IN (SELECT shipment_id FROM shipment_changes)""")
def u11(t):
    snap = w.upsert(t.shipments, t.shipment_changes, "shipment_id", ["status"], ["changed_at", "change_seq"], NOW)
    return snap.where(F.col("updated_at") == ts_lit(NOW)).select("shipment_id", "updated_at")


@query("U3_patch_shipments", f"""
WITH p AS (
  SELECT shipment_id,
         arg_max(status, patch_seq) FILTER (WHERE status IS NOT NULL) AS status,
         arg_max(destination, patch_seq) FILTER (WHERE destination IS NOT NULL) AS destination
  FROM shipment_patches GROUP BY shipment_id)
SELECT s.shipment_id, s.origin, coalesce(p.destination, s.destination) AS destination,
       coalesce(p.status, s.status) AS status, s.departure_date, s.arrival_date, s.created_at,
       CASE WHEN p.shipment_id IS NOT NULL THEN {_T} ELSE s.updated_at END AS updated_at
FROM shipments s LEFT JOIN p ON s.shipment_id = p.shipment_id""")
def u3(t):
    return w.patch(t.shipments, t.shipment_patches, "shipment_id", ["status", "destination"], ["patch_seq"], NOW)


_U3B_ACCEPTED = """
acc AS (
  SELECT * FROM delivery_patches p
  WHERE (p.courier_id IS NULL OR p.courier_id IN (SELECT courier_id FROM couriers))
    AND p.delivery_id IN (SELECT delivery_id FROM deliveries)),
f AS (
  SELECT delivery_id,
         arg_max(CASE WHEN actual_arrival IS NOT NULL THEN 'DELIVERED' ELSE status END, patch_seq)
           FILTER (WHERE actual_arrival IS NOT NULL OR status IS NOT NULL) AS status,
         arg_max(actual_arrival, patch_seq) FILTER (WHERE actual_arrival IS NOT NULL) AS actual_arrival,
         arg_max(estimated_arrival, patch_seq) FILTER (WHERE estimated_arrival IS NOT NULL) AS estimated_arrival,
         arg_max(courier_id, patch_seq) FILTER (WHERE courier_id IS NOT NULL) AS courier_id
  FROM acc GROUP BY delivery_id)"""


@query("U3b_delivery_patch", f"""
WITH {_U3B_ACCEPTED}
SELECT d.delivery_id, d.shipment_id, coalesce(f.courier_id, d.courier_id) AS courier_id,
       coalesce(f.status, d.status) AS status,
       coalesce(f.estimated_arrival, d.estimated_arrival) AS estimated_arrival,
       coalesce(f.actual_arrival, d.actual_arrival) AS actual_arrival, d.created_at,
       CASE WHEN f.delivery_id IS NOT NULL THEN {_T} ELSE d.updated_at END AS updated_at
FROM deliveries d LEFT JOIN f ON d.delivery_id = f.delivery_id""")
def u3b(t):
    snap, _ = w.delivery_patch(t.deliveries, t.delivery_patches, t.couriers, NOW)
    return snap


@query("U3b_delivery_patch_rejected", """
SELECT p.*, 'courier_not_found' AS reason FROM delivery_patches p
WHERE p.courier_id IS NOT NULL AND p.courier_id NOT IN (SELECT courier_id FROM couriers)
UNION ALL
SELECT p.*, 'delivery_not_found' AS reason FROM delivery_patches p
WHERE (p.courier_id IS NULL OR p.courier_id IN (SELECT courier_id FROM couriers))
  AND p.delivery_id NOT IN (SELECT delivery_id FROM deliveries)""")
def u3b_rej(t):
    _, rejected = w.delivery_patch(t.deliveries, t.delivery_patches, t.couriers, NOW)
    return rejected


@query("U3c_saga_context_patch", f"""
WITH acc AS (SELECT * FROM saga_context_patches WHERE saga_id IN (SELECT saga_id FROM saga_instances)),
f AS (SELECT saga_id,
             arg_max(warehouse_id, patch_seq) FILTER (WHERE warehouse_id IS NOT NULL) AS warehouse_id,
             arg_max(delivery_id, patch_seq) FILTER (WHERE delivery_id IS NOT NULL) AS delivery_id
      FROM acc GROUP BY saga_id)
SELECT s.saga_id, s.saga_type, s.shipment_id, coalesce(f.warehouse_id, s.warehouse_id) AS warehouse_id,
       coalesce(f.delivery_id, s.delivery_id) AS delivery_id, s.status, s.started_at,
       CASE WHEN f.saga_id IS NOT NULL THEN {_T} ELSE s.updated_at END AS updated_at,
       s.completed_at, s.failed_step, s.retry_count
FROM saga_instances s LEFT JOIN f ON s.saga_id = f.saga_id""")
def u3c(t):
    return w.saga_context_patch(t.saga_instances, t.saga_context_patches, NOW)


# ---- U1: one upsert for each table's policy ---------------------------------

_CHANGE_ROWS = {"shipments": "shipment_rows", "items": "item_rows", "couriers": "courier_rows", "deliveries": "delivery_rows",
                "warehouses": "warehouse_rows", "inventory_records": "inventory_rows", "saga_instances": "saga_rows",
                "blockchain_records": "record_rows", "users": "user_rows"}
# columns of the stored tables that no change set writes, with their value on insert
_UNWRITTEN = {"shipments": {"departure_date": "NULL", "arrival_date": "NULL", "created_at": _T, "updated_at": _T},
              "couriers": {"is_active": "true"}, "saga_instances": {"completed_at": "NULL", "retry_count": "0"},
              "blockchain_records": {"network": "'ethereum'"}}


def _policy_oracle(table: str) -> str:
    p = w.UPSERT_POLICIES[table]
    changed = _COLUMNS[table]
    old, new = [f"s.{p.key}"], [f"l.{p.key}"]
    for c in changed:
        old.append(f"CASE WHEN l.{p.key} IS NULL THEN s.{c} ELSE l.{c} END AS {c}" if c in p.update else f"s.{c}")
        new.append(f"l.{c}" if c in p.update else f"f.{c}")
    for c, value in _UNWRITTEN.get(table, {}).items():
        old.append(f"CASE WHEN l.{p.key} IS NOT NULL THEN {_T} ELSE s.{c} END AS {c}" if c == "updated_at" else f"s.{c}")
        new.append(value)
    return f"""
WITH l AS (SELECT * FROM {_CHANGE_ROWS[table]} QUALIFY row_number() OVER (PARTITION BY {p.key} ORDER BY change_seq DESC) = 1),
f AS (SELECT * FROM {_CHANGE_ROWS[table]} QUALIFY row_number() OVER (PARTITION BY {p.key} ORDER BY change_seq) = 1)
SELECT {', '.join(old)} FROM {table} s LEFT JOIN l ON s.{p.key} = l.{p.key}
UNION ALL
SELECT {', '.join(new)} FROM l JOIN f ON l.{p.key} = f.{p.key} WHERE l.{p.key} NOT IN (SELECT {p.key} FROM {table})"""


_COLUMNS = {
    "shipments": ("origin", "destination", "status"),
    "items": ("shipment_id", "name", "quantity", "weight"),
    "couriers": ("name", "contact_info"),
    "deliveries": ("shipment_id", "courier_id", "status", "estimated_arrival", "actual_arrival", "created_at", "updated_at"),
    "warehouses": ("name", "location"),
    "inventory_records": ("shipment_id", "warehouse_id", "status", "received_at", "updated_at"),
    "saga_instances": ("saga_type", "shipment_id", "warehouse_id", "delivery_id", "status", "started_at", "updated_at", "failed_step"),
    "blockchain_records": ("shipment_id", "tx_hash", "status", "payload", "created_at", "confirmed_at", "block_number", "gas_used"),
    "users": ("username", "email", "role", "is_active"),
}


def _policy_query(table: str):
    return lambda t: w.upsert_table(table, getattr(t, table), getattr(t, _CHANGE_ROWS[table]), ["change_seq"], NOW)


for _table in w.UPSERT_POLICIES:
    query(f"U1_policy_{_table}", _policy_oracle(_table))(_policy_query(_table))


@query("U3_patch_warehouse_location", """
WITH p AS (SELECT warehouse_id, arg_max(name, patch_seq) FILTER (WHERE name IS NOT NULL) AS name,
                  arg_max(country, patch_seq) FILTER (WHERE country IS NOT NULL) AS country,
                  arg_max(city, patch_seq) FILTER (WHERE city IS NOT NULL) AS city FROM warehouse_patches GROUP BY 1)
SELECT s.warehouse_id, coalesce(p.name, s.name) AS name,
       json_object('country', coalesce(p.country, json_extract_string(s.location, '$.country')),
                   'city', coalesce(p.city, json_extract_string(s.location, '$.city')),
                   'address', json_extract_string(s.location, '$.address'))::varchar AS location
FROM warehouses s LEFT JOIN p ON s.warehouse_id = p.warehouse_id""")
def u3_location(t):
    return w.patch_location(t.warehouses, t.warehouse_patches, "warehouse_id", ["name"], ["patch_seq"])


@query("U8_set_item_weight", """
SELECT i.item_id, i.shipment_id, i.name, i.quantity, coalesce(c.weight, i.weight) AS weight
FROM items i LEFT JOIN item_weight_changes c ON i.item_id = c.item_id""")
def u8_weight(t):
    return w.set_field(t.items, t.item_weight_changes, "item_id", "weight", ["change_seq"])[0]


@query("U8_unknown_items", "SELECT DISTINCT item_id FROM item_weight_changes WHERE item_id NOT IN (SELECT item_id FROM items)")
def u8_unknown_items(t):
    return w.set_field(t.items, t.item_weight_changes, "item_id", "weight", ["change_seq"])[1]


@query("U8_set_warehouse_location", """
SELECT s.warehouse_id, s.name, coalesce((SELECT arg_max(c.location, c.change_seq) FROM warehouse_locations c
                                         WHERE c.warehouse_id = s.warehouse_id), s.location) AS location FROM warehouses s""")
def u8_location(t):
    return w.set_field(t.warehouses, t.warehouse_locations, "warehouse_id", "location", ["change_seq"])[0]


_FAILED_KEYS = "(SELECT correlation_id FROM domain_events WHERE event_type = 'delivery.failed' AND correlation_id IS NOT NULL)"


@query("U4_delete_sagas_remaining", f"""
SELECT * FROM saga_instances WHERE saga_id NOT IN {_FAILED_KEYS}""")
def u4a(t):
    keys = t.domain_events.where("event_type = 'delivery.failed' AND correlation_id IS NOT NULL")
    remaining, _ = w.delete(t.saga_instances, keys, "saga_id", "correlation_id")
    return remaining


@query("U4_delete_sagas_not_found", f"""
SELECT DISTINCT correlation_id AS saga_id FROM domain_events
WHERE event_type = 'delivery.failed' AND correlation_id IS NOT NULL
  AND correlation_id NOT IN (SELECT saga_id FROM saga_instances)""")
def u4b(t):
    keys = t.domain_events.where("event_type = 'delivery.failed' AND correlation_id IS NOT NULL")
    _, missing = w.delete(t.saga_instances, keys, "saga_id", "correlation_id")
    return missing


@query("U5_cascade_items_after_cancel", """
SELECT * FROM items WHERE shipment_id NOT IN (SELECT aggregate_id FROM commands WHERE command_type = 'shipment.cancel')""")
def u5(t):
    keys = t.commands.where("command_type = 'shipment.cancel'").select(F.col("aggregate_id").alias("shipment_id"))
    return w.cascade_delete(keys, "shipment_id", {"items": (t.items, "shipment_id")})["items"]


@query("U6_restricted_delete_couriers", """
SELECT * FROM couriers c
WHERE NOT (NOT c.is_active AND NOT EXISTS (SELECT 1 FROM deliveries d WHERE d.courier_id = c.courier_id))""")
def u6(t):
    keys = t.couriers.where("NOT is_active")
    snap, _ = w.restricted_delete(t.couriers, keys, "courier_id", t.deliveries, "courier_id")
    return snap


@query("U6_restricted_delete_refused", """
SELECT c.courier_id FROM couriers c
WHERE NOT c.is_active AND EXISTS (SELECT 1 FROM deliveries d WHERE d.courier_id = c.courier_id)""")
def u6r(t):
    keys = t.couriers.where("NOT is_active")
    _, refused = w.restricted_delete(t.couriers, keys, "courier_id", t.deliveries, "courier_id")
    return refused


_U7_NET = "net AS (SELECT item_id, cast(sum(delta) as bigint) AS net_delta FROM item_quantity_changes GROUP BY item_id)"


@query("U7_adjust_quantity", f"""
WITH {_U7_NET}
SELECT i.item_id, i.shipment_id, i.name,
       CASE WHEN n.net_delta IS NOT NULL AND i.quantity + n.net_delta >= 1 THEN cast(i.quantity + n.net_delta as int)
            ELSE i.quantity END AS quantity,
       i.weight
FROM items i LEFT JOIN net n ON i.item_id = n.item_id""")
def u7(t):
    snap, _ = w.adjust_quantity(t.items, t.item_quantity_changes)
    return snap


@query("U7_adjust_quantity_rejected", f"""
WITH {_U7_NET}
SELECT i.item_id, i.shipment_id, i.quantity, n.net_delta FROM items i JOIN net n ON i.item_id = n.item_id
WHERE i.quantity + n.net_delta < 1""")
def u7r(t):
    _, rejected = w.adjust_quantity(t.items, t.item_quantity_changes)
    return rejected


@query("U8_set_courier_contact", """
WITH last AS (SELECT courier_id, arg_max(contact_info, change_seq) AS contact_info
              FROM courier_contact_changes GROUP BY courier_id)
SELECT c.courier_id, c.name,
       CASE WHEN l.courier_id IS NOT NULL THEN l.contact_info ELSE c.contact_info END AS contact_info, c.is_active
FROM couriers c LEFT JOIN last l ON c.courier_id = l.courier_id""")
def u8(t):
    known = t.courier_contact_changes.join(t.couriers.select("courier_id"), "courier_id", "left_semi")
    return w.upsert(t.couriers, known, "courier_id", ["contact_info"], ["change_seq"],
                    NOW, touch_col=None, created_col=None, defaults={"is_active": F.lit(True)})


@query("U8_unknown_couriers", """
SELECT DISTINCT courier_id FROM courier_contact_changes WHERE courier_id NOT IN (SELECT courier_id FROM couriers)""")
def u8_unknown(t):
    return t.courier_contact_changes.select("courier_id").distinct().join(t.couriers, "courier_id", "left_anti")


@query("U9_revoke_tokens", """
SELECT token_id, user_id, token_hash, expires_at,
       revoked OR token_hash IN (SELECT token_hash FROM token_presentations) AS revoked
FROM refresh_tokens""")
def u9(t):
    return w.revoke_tokens(t.refresh_tokens, t.token_presentations)


_U10_LAST = """last AS (SELECT delivery_id, arg_max(courier_id, assign_seq) AS courier_id, max(assign_seq) AS assign_seq
                FROM courier_assignments GROUP BY delivery_id)"""


@query("U10_reassign_courier", f"""
WITH {_U10_LAST},
ok AS (SELECT l.* FROM last l JOIN deliveries d ON l.delivery_id = d.delivery_id
       WHERE upper(trim(d.status)) NOT IN ('DELIVERED', 'CONFIRMED'))
SELECT d.delivery_id, d.shipment_id, coalesce(ok.courier_id, d.courier_id) AS courier_id, d.status,
       d.estimated_arrival, d.actual_arrival, d.created_at,
       CASE WHEN ok.delivery_id IS NOT NULL THEN {_T} ELSE d.updated_at END AS updated_at
FROM deliveries d LEFT JOIN ok ON d.delivery_id = ok.delivery_id""")
def u10(t):
    snap, _ = w.reassign_courier(t.deliveries, t.courier_assignments, NOW)
    return snap


@query("U10_reassign_refused", f"""
WITH {_U10_LAST}
SELECT l.delivery_id, l.courier_id, d.status FROM last l JOIN deliveries d ON l.delivery_id = d.delivery_id
WHERE upper(trim(d.status)) IN ('DELIVERED', 'CONFIRMED')""")
def u10r(t):
    _, refused = w.reassign_courier(t.deliveries, t.courier_assignments, NOW)
    return refused


@query("U12_delivery_patch_not_found", """
SELECT * FROM delivery_patches WHERE delivery_id NOT IN (SELECT delivery_id FROM deliveries)""")
def u12(t):
    _, missing = w.require_existing(t.deliveries, t.delivery_patches, "delivery_id")
    return missing


@query("U13_user_insert_defaults", f"""
SELECT user_id, username, email, 'operator' AS role, true AS is_active,
       {_T} AS created_at, {_T} AS updated_at FROM users""")
def u13(t):
    now = ts_lit(NOW)
    return w.apply_defaults(t.users.select("user_id", "username", "email"),
                            {"role": F.lit("operator"), "is_active": F.lit(True),
                             "created_at": now, "updated_at": now})


_TT = f"timestamp '{TOKEN_NOW}'"
_U14_VALID = f"""live AS (
  SELECT t.* FROM refresh_tokens t
  WHERE t.token_hash IN (SELECT token_hash FROM token_presentations)
    AND NOT t.revoked AND t.expires_at > {_TT}),
valid AS (SELECT * FROM live WHERE user_id IN (SELECT user_id FROM users))"""


@query("U14_token_rotation_report", f"""
WITH {_U14_VALID}
SELECT DISTINCT p.token_hash, CASE WHEN v.token_hash IS NOT NULL THEN 'rotated' ELSE 'rejected' END AS outcome
FROM token_presentations p LEFT JOIN valid v ON p.token_hash = v.token_hash""")
def u14(t):
    _, report = w.rotate_tokens(t.refresh_tokens, t.token_presentations, t.users, TOKEN_NOW)
    return report


@query("U2_append_token_successors", f"""
WITH {_U14_VALID}
SELECT token_id, user_id, token_hash, expires_at,
       revoked OR token_hash IN (SELECT token_hash FROM live) AS revoked
FROM refresh_tokens
UNION ALL
SELECT (SELECT max(token_id) FROM refresh_tokens) + row_number() OVER (ORDER BY md5(concat(token_hash, '@{TOKEN_NOW}'))) AS token_id, user_id,
       md5(concat(token_hash, '@{TOKEN_NOW}')) AS token_hash, {_TT} + interval 30 day AS expires_at, false AS revoked
FROM valid""")
def u2(t):
    snap, _ = w.rotate_tokens(t.refresh_tokens, t.token_presentations, t.users, TOKEN_NOW)
    return snap
