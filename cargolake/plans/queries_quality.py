"""Registered data-quality queries (Q1-Q7)."""

from __future__ import annotations

from cargolake.operators import history as h
from cargolake.operators import quality as q
from cargolake.plans.catalog import query
from cargolake.plans.queries_families import HISTORIES, child, child_sql


def _row_family(family: str):
    tables = [t for t, rules in q.ROW_RULES.items() if any(r.family == family for r in rules)]
    oracle = "\nUNION ALL\n".join(q.row_violations_oracle(t, {family}) for t in tables)

    def build(t):
        return q.union_all([q.row_violations(getattr(t, name), name, {family}) for name in tables])
    return build, oracle


for _fam, _label in (("Q1", "domains"), ("Q2", "ranges"), ("Q3", "temporal"), ("Q4", "value_rules"),
                     ("Q7", "not_null_and_length")):
    _b, _o = _row_family(_fam)
    query(f"{_fam}_{_label}", _o)(_b)


@query("Q1to7_row_rules_one_pass", "\nUNION ALL\n".join(q.row_violations_oracle(t) for t in q.ROW_RULES))
def q_all(t):
    return q.union_all([q.row_violations(getattr(t, name), name) for name in q.ROW_RULES])


@query("Q5_uniqueness", "\nUNION ALL\n".join(q.duplicate_keys_oracle(*u) for u in q.UNIQUE_KEYS))
def q5(t):
    return q.union_all([q.duplicate_keys(getattr(t, tbl), tbl, cols, where) for tbl, cols, where in q.UNIQUE_KEYS])


_HISTORY_CTES = ",\n".join(f"{name} AS {child_sql(name)}" for name in HISTORIES)


@query("Q6_referential", f"WITH {_HISTORY_CTES}\n" + "\nUNION ALL\n".join(q.orphans_oracle(*fk) for fk in q.FOREIGN_KEYS))
def q6(t):
    """One join a parent; the histories that come from a change log are derived for parentless keys alone, of which
    no snapshot holds a row."""
    logs = {"shipment_status_history": (t.shipment_changes, lambda old, log: h.status_history_from_log(old, log, "shipment_id")),
            "saga_events": (t.saga_changes, h.saga_events_from_log)}
    found, children = [], {}
    for name, fk, parent, pk in q.FOREIGN_KEYS:
        if name in logs:
            log, history = logs[name]
            stored = getattr(t, parent)
            found.append(q.all_rows(history(stored.where("false"), q.parentless(log, fk, stored, pk)), name, fk, parent))
        else:
            children.setdefault((parent, pk), []).append((child(t, name), name, fk))
    found += [q.orphans_by_parent(some, getattr(t, parent), parent, pk) for (parent, pk), some in children.items()]
    return q.union_all(found)


# Stored shipments are checked against the CHECK-constraint vocabulary
# (the lifecycle enum used by the services is a different domain).
_CHECK_RULE = q.domain_rule("status", q.schemas.SHIPMENT_CHECK)


@query("Q1_shipment_check_domain", f"""
SELECT 'shipments' AS table_name, cast(shipment_id as varchar) AS row_key, 'domain:status' AS rule, status AS value
FROM shipments WHERE {_CHECK_RULE.violated}""")
def q1_check(t):
    return q.row_violations(t.shipments, "shipments", rules=[_CHECK_RULE])


# ---- the rules over rows as a load might bring them: every rule finds its faults ----

_STAGED = {"staged_shipments": "shipments", "staged_items": "items", "staged_couriers": "couriers", "staged_deliveries": "deliveries",
           "staged_points": "delivery_tracking_points", "staged_warehouses": "warehouses", "staged_inventory": "inventory_records",
           "staged_sagas": "saga_instances", "staged_steps": "saga_steps", "staged_records": "blockchain_records",
           "staged_checks": "transaction_confirmations", "staged_users": "users", "staged_shipment_history": "shipment_status_history",
           "staged_delivery_history": "delivery_status_history", "staged_saga_events": "saga_events", "staged_nonces": "nonce_state",
           "staged_envelopes": "envelopes"}


def _staged_rules(name: str, family: str) -> list[q.RowRule]:
    return [r for r in (q.ROW_RULES | q.ROW_RULES_OTHER)[_STAGED[name]] if r.family == family]


def _staged_query(family: str):
    return lambda t: q.union_all([q.row_violations(getattr(t, name), name, rules=_staged_rules(name, family))
                                  for name in _STAGED if _staged_rules(name, family)])


for _fam, _label in (("Q1", "domains"), ("Q2", "ranges"), ("Q3", "temporal"), ("Q4", "value_rules"), ("Q7", "not_null_and_length")):
    query(f"{_fam}_staged_{_label}", "\nUNION ALL\n".join(
        q.row_violations_oracle(name, rules=_staged_rules(name, _fam)) for name in _STAGED if _staged_rules(name, _fam)))(_staged_query(_fam))


@query("Q5_staged_nonce_keys", q.duplicate_keys_oracle("staged_nonces", ["address", "network"]))
def q5_nonces(t):
    return q.duplicate_keys(t.staged_nonces, "staged_nonces", ["address", "network"])
