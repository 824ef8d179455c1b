"""Registered history / state-machine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolake.operators import history as h
from cargolake.operators import writes as w
from cargolake.plans.catalog import query
from cargolake.plans.queries_writes import _U3B_ACCEPTED
from cargolake.sources.fixtures import AS_OF_EVENTS as NOW

_T = f"timestamp '{NOW}'"

_H2_LAGGED = """lagged AS (
  SELECT *, lag(status) OVER (PARTITION BY shipment_id ORDER BY src, changed_at, change_seq) AS old_status FROM (
    SELECT shipment_id, status, 0 AS src, cast(null as timestamp) AS changed_at, cast(null as bigint) AS change_seq
    FROM shipments WHERE shipment_id IN (SELECT shipment_id FROM shipment_changes)
    UNION ALL
    SELECT shipment_id, status, 1, changed_at, change_seq FROM shipment_changes) u),
hist AS (
  SELECT shipment_id, old_status, status AS new_status, changed_at, change_seq FROM lagged
  WHERE src = 1 AND old_status IS DISTINCT FROM status)"""


def _h2(t):
    return h.status_history_from_log(t.shipments, t.shipment_changes, "shipment_id")


@query("H2_shipment_status_history", f"WITH {_H2_LAGGED} SELECT * FROM hist")
def h2(t):
    return _h2(t)


@query("H1_delivery_status_history", f"""
WITH {_U3B_ACCEPTED},
new AS (SELECT d.delivery_id, coalesce(f.status, d.status) AS status
        FROM deliveries d LEFT JOIN f ON d.delivery_id = f.delivery_id)
SELECT coalesce(o.delivery_id, n.delivery_id) AS delivery_id,
       CASE WHEN o.delivery_id IS NULL THEN NULL ELSE o.status END AS old_status,
       n.status AS new_status, {_T} AS changed_at
FROM deliveries o FULL OUTER JOIN new n ON o.delivery_id = n.delivery_id
WHERE n.delivery_id IS NOT NULL AND (o.delivery_id IS NULL OR o.status IS DISTINCT FROM n.status)""")
def h1(t):
    new, _ = w.delivery_patch(t.deliveries, t.delivery_patches, t.couriers, NOW)
    return h.status_history_from_snapshots(t.deliveries, new, "delivery_id", NOW)


_H3_LAGGED = """lagged AS (
  SELECT *, lag(status) OVER (PARTITION BY saga_id ORDER BY src, changed_at, change_seq) AS old_status,
            lag(src) OVER (PARTITION BY saga_id ORDER BY src, changed_at, change_seq) AS prev_src FROM (
    SELECT saga_id, status, 0 AS src, cast(null as timestamp) AS changed_at, cast(null as bigint) AS change_seq,
           saga_type, shipment_id, failed_step
    FROM saga_instances WHERE saga_id IN (SELECT saga_id FROM saga_changes)
    UNION ALL
    SELECT saga_id, status, 1, changed_at, change_seq, saga_type, shipment_id, failed_step FROM saga_changes) u)"""


@query("H3_saga_events", f"""
WITH {_H3_LAGGED}
SELECT saga_id,
       CASE WHEN prev_src IS NULL THEN 'SAGA_STARTED'
            WHEN upper(trim(status)) = 'COMPLETED' THEN 'SAGA_COMPLETED'
            WHEN upper(trim(status)) = 'FAILED' THEN 'SAGA_FAILED'
            WHEN upper(trim(status)) = 'COMPENSATING' THEN 'COMPENSATION_STARTED'
            ELSE 'SAGA_STARTED' END AS event_type,
       CASE WHEN prev_src IS NULL
            THEN json_object('saga_type', saga_type, 'shipment_id', shipment_id, 'status', status)
            ELSE json_object('old_status', old_status, 'new_status', status, 'failed_step', failed_step,
                             'error_message', cast(null as varchar)) END::varchar AS event_data,
       changed_at AS occurred_at, change_seq
FROM lagged WHERE src = 1 AND (prev_src IS NULL OR old_status <> status)""")
def h3(t):
    return h.saga_events_from_log(t.saga_instances, t.saga_changes)


@query("H4_saga_completed_at", f"""
WITH {_H3_LAGGED}
SELECT saga_id, min(changed_at) AS completed_at FROM lagged
WHERE src = 1 AND status IS DISTINCT FROM old_status
  AND upper(trim(status)) IN ('COMPLETED', 'FAILED', 'CANCELLED')
  AND (old_status IS NULL OR upper(trim(old_status)) NOT IN ('COMPLETED', 'FAILED', 'CANCELLED'))
GROUP BY saga_id""")
def h4(t):
    hist = h.status_history_from_log(t.saga_instances, t.saga_changes, "saga_id")
    return h.completion_times(hist, "saga_id")


@query("H5_shipment_transition_check", f"""
WITH {_H2_LAGGED},
allowed(from_status, to_status) AS (VALUES ('CREATED', 'RECEIVED'), ('RECEIVED', 'READY_FOR_DELIVERY'),
  ('READY_FOR_DELIVERY', 'IN_TRANSIT'), ('IN_TRANSIT', 'DELIVERED'), ('DELIVERED', 'COMPLETED'))
SELECT hist.*, EXISTS (SELECT 1 FROM allowed a WHERE a.from_status = upper(trim(hist.old_status))
                        AND a.to_status = upper(trim(hist.new_status))) AS allowed
FROM hist""")
def h5(t):
    return h.check_transitions(_h2(t))


@query("H5b_shipment_verbs", f"""
WITH m(verb, status) AS (VALUES ('receive', 'received'), ('ready', 'ready_for_delivery'), ('dispatch', 'in_transit'),
                                ('deliver', 'delivered'), ('complete', 'completed')),
newest AS (SELECT v.shipment_id, m.status, row_number() OVER (PARTITION BY v.shipment_id ORDER BY v.verb_seq DESC) AS rn
           FROM shipment_verbs v JOIN m ON v.verb = m.verb)
SELECT s.shipment_id, s.origin, s.destination, coalesce(l.status, s.status) AS status, s.departure_date,
       CASE WHEN s.shipment_id IN (SELECT shipment_id FROM shipment_verbs WHERE verb = 'deliver')
            THEN cast({_T} as date) ELSE s.arrival_date END AS arrival_date,
       s.created_at, CASE WHEN l.shipment_id IS NOT NULL THEN {_T} ELSE s.updated_at END AS updated_at
FROM shipments s LEFT JOIN newest l ON s.shipment_id = l.shipment_id AND l.rn = 1""")
def h5b(t):
    return h.apply_shipment_verbs(t.shipments, t.shipment_verbs, NOW)


# The oracles of the guards fold request after request in a recursive query.
_H6_FOLD = """WITH RECURSIVE q AS (
  SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY request_seq) AS rn FROM delivery_requests),
fold AS (
  SELECT q.request_seq, q.delivery_id, q.verb, q.arrival, q.rn, upper(trim(d.status)) AS before,
         CASE WHEN q.verb = 'deliver' THEN 'DELIVERED'
              WHEN q.verb = 'in_transit' AND upper(trim(d.status)) <> 'DELIVERED' THEN 'IN_TRANSIT'
              WHEN q.verb = 'confirm' AND upper(trim(d.status)) = 'DELIVERED' THEN 'CONFIRMED'
              ELSE upper(trim(d.status)) END AS later
  FROM q JOIN deliveries d ON q.delivery_id = d.delivery_id WHERE q.rn = 1
  UNION ALL
  SELECT q.request_seq, q.delivery_id, q.verb, q.arrival, q.rn, f.later,
         CASE WHEN q.verb = 'deliver' THEN 'DELIVERED'
              WHEN q.verb = 'in_transit' AND f.later <> 'DELIVERED' THEN 'IN_TRANSIT'
              WHEN q.verb = 'confirm' AND f.later = 'DELIVERED' THEN 'CONFIRMED' ELSE f.later END
  FROM fold f JOIN q ON q.delivery_id = f.delivery_id AND q.rn = f.rn + 1),
judged AS (
  SELECT request_seq, delivery_id, verb, before AS current_status,
         CASE WHEN verb IN ('receive', 'in_transit') AND before = 'DELIVERED' THEN 'already_delivered'
              WHEN verb = 'confirm' AND before <> 'DELIVERED' THEN 'not_delivered' END AS reason,
         later AS resulting_status, arrival FROM fold
  UNION ALL
  SELECT request_seq, delivery_id, verb, NULL, 'delivery_not_found', NULL, NULL FROM delivery_requests
  WHERE delivery_id NOT IN (SELECT delivery_id FROM deliveries))"""


@query("H6_delivery_guard", f"""
{_H6_FOLD}
SELECT request_seq, delivery_id, verb, current_status, reason IS NULL AS accepted, resulting_status,
       CASE WHEN verb = 'deliver' THEN arrival END AS actual_arrival, reason FROM judged""")
def h6(t):
    return h.delivery_guard(t.deliveries, t.delivery_requests)


@query("H6_delivery_snapshot", f"""
{_H6_FOLD},
ended AS (SELECT delivery_id, arg_max(resulting_status, request_seq) AS status FROM judged WHERE reason IS NULL GROUP BY 1),
came AS (SELECT delivery_id, arg_max(arrival, request_seq) AS at FROM judged WHERE verb = 'deliver' AND reason IS NULL GROUP BY 1)
SELECT d.delivery_id, d.shipment_id, d.courier_id, coalesce(e.status, d.status) AS status, d.estimated_arrival,
       CASE WHEN c.delivery_id IS NOT NULL THEN c.at ELSE d.actual_arrival END AS actual_arrival, d.created_at,
       CASE WHEN e.delivery_id IS NOT NULL THEN {_T} ELSE d.updated_at END AS updated_at
FROM deliveries d LEFT JOIN ended e ON d.delivery_id = e.delivery_id LEFT JOIN came c ON d.delivery_id = c.delivery_id""")
def h6_snapshot(t):
    return h.apply_delivery_requests(t.deliveries, h.delivery_guard(t.deliveries, t.delivery_requests), NOW)


@query("H7_inventory_guard", """
WITH RECURSIVE q AS (
  SELECT *, upper(trim(new_status)) AS asked, row_number() OVER (PARTITION BY record_id ORDER BY request_seq) AS rn FROM inventory_requests),
fold AS (
  SELECT q.request_seq, q.record_id, q.new_status, q.asked, q.rn, upper(trim(r.status)) AS before,
         CASE WHEN upper(trim(r.status)) = 'SHIPPED' THEN 'SHIPPED' ELSE q.asked END AS later
  FROM q JOIN inventory_records r ON q.record_id = r.record_id WHERE q.rn = 1
  UNION ALL
  SELECT q.request_seq, q.record_id, q.new_status, q.asked, q.rn, f.later,
         CASE WHEN f.later = 'SHIPPED' THEN 'SHIPPED' ELSE q.asked END
  FROM fold f JOIN q ON q.record_id = f.record_id AND q.rn = f.rn + 1)
SELECT request_seq, record_id, new_status, before AS current_status, NOT (before = 'SHIPPED' AND asked <> 'SHIPPED') AS accepted,
       CASE WHEN before = 'SHIPPED' AND asked <> 'SHIPPED' THEN 'already_shipped' END AS reason FROM fold
UNION ALL
SELECT request_seq, record_id, new_status, NULL, false, 'record_not_found' FROM inventory_requests
WHERE record_id NOT IN (SELECT record_id FROM inventory_records)""")
def h7(t):
    return h.inventory_guard(t.inventory_records, t.inventory_requests)


@query("H8_saga_guard", """
WITH RECURSIVE q AS (
  SELECT *, row_number() OVER (PARTITION BY saga_id ORDER BY request_seq) AS rn FROM saga_requests),
fold AS (
  SELECT q.request_seq, q.saga_id, q.action, q.rn, upper(trim(s.status)) AS before,
         CASE WHEN q.action = 'fail' THEN 'FAILED'
              WHEN q.action = 'complete' AND upper(trim(s.status)) = 'STARTED' THEN 'COMPLETED'
              WHEN q.action = 'compensate' AND upper(trim(s.status)) NOT IN ('COMPLETED', 'FAILED') THEN 'COMPENSATING'
              ELSE upper(trim(s.status)) END AS later
  FROM q JOIN saga_instances s ON q.saga_id = s.saga_id WHERE q.rn = 1
  UNION ALL
  SELECT q.request_seq, q.saga_id, q.action, q.rn, f.later,
         CASE WHEN q.action = 'fail' THEN 'FAILED' WHEN q.action = 'complete' AND f.later = 'STARTED' THEN 'COMPLETED'
              WHEN q.action = 'compensate' AND f.later NOT IN ('COMPLETED', 'FAILED') THEN 'COMPENSATING' ELSE f.later END
  FROM fold f JOIN q ON q.saga_id = f.saga_id AND q.rn = f.rn + 1)
SELECT request_seq, saga_id, action, before AS current_status,
       CASE WHEN action = 'complete' AND before <> 'STARTED' THEN 'noop'
            WHEN action = 'compensate' AND before IN ('COMPLETED', 'FAILED') THEN 'refused' ELSE 'applied' END AS outcome,
       later AS resulting_status FROM fold
UNION ALL
SELECT request_seq, saga_id, action, NULL, 'saga_not_found', NULL FROM saga_requests
WHERE saga_id NOT IN (SELECT saga_id FROM saga_instances)""")
def h8(t):
    return h.saga_guard(t.saga_instances, t.saga_requests)


@query("H10_confirmation_timeline", """
SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY checked_at DESC, block_number DESC) AS recency
FROM transaction_confirmations""")
def h10(t):
    return h.timeline(t.transaction_confirmations, "record_id", "checked_at", "block_number")


@query("H11_status_rebuilt_from_history", """
SELECT shipment_id, arg_max(status, struct_pack(changed_at := changed_at, change_seq := change_seq)) AS status
FROM shipment_changes GROUP BY shipment_id""")
def h11(t):
    return h.current_from_history(_h2(t), "shipment_id")
