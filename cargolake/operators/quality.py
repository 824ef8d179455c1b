"""Data-quality rules Q1-Q7.

Row rules are SQL predicates kept in a registry (the "schema registry" of
CHECK constraints, value objects and length caps).  Spark evaluates all row
rules of a table in ONE pass: each rule becomes ``when(violated, struct)``,
``array_compact`` drops the passing ones and ``explode`` emits one violation
row per failed rule.  Uniqueness (Q5) is a grouped count and referential
integrity (Q6) a left-anti join per foreign key.

Output schema of every rule: table_name, row_key, rule, value (all STRING).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake import schemas


@dataclass(frozen=True)
class RowRule:
    family: str       # Q1 .. Q7
    name: str
    violated: str     # SQL predicate, TRUE when the row breaks the rule
    value: str        # SQL expression reported for the offending row


def _dom(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def domain_rule(col: str, values) -> RowRule:
    return RowRule("Q1", f"domain:{col}", f"upper(trim({col})) NOT IN ({_dom(values)})", col)


def range_rule(name: str, violated: str, col: str) -> RowRule:
    return RowRule("Q2", name, violated, f"cast({col} as string)")


def not_null_rule(col: str) -> RowRule:
    return RowRule("Q7", f"not_null:{col}", f"{col} IS NULL", "cast(null as string)")


def max_len_rule(col: str, n: int) -> RowRule:
    return RowRule("Q7", f"max_len:{col}:{n}", f"length({col}) > {n}", col)


# Keys of each fixture table and its row rules (fixed values from the
# migrations and value objects; statuses compared after upper(trim())).
TABLE_KEYS: dict[str, list[str]] = {
    "shipments": ["shipment_id"], "items": ["item_id"], "couriers": ["courier_id"],
    "deliveries": ["delivery_id"], "delivery_tracking_points": ["tracking_id"],
    "warehouses": ["warehouse_id"], "inventory_records": ["record_id"],
    "saga_instances": ["saga_id"], "saga_steps": ["saga_id", "step_name"],
    "blockchain_records": ["record_id"], "transaction_confirmations": ["record_id", "block_number"],
    "users": ["user_id"], "refresh_tokens": ["token_id"], "blockchain_events": ["event_id"],
    "shipment_status_history": ["shipment_id", "change_seq"], "delivery_status_history": ["delivery_id"],
    "saga_events": ["saga_id", "change_seq"],
    "staged_shipments": ["shipment_id"], "staged_items": ["item_id"], "staged_couriers": ["courier_id"],
    "staged_deliveries": ["delivery_id"], "staged_points": ["tracking_id"], "staged_warehouses": ["warehouse_id"],
    "staged_inventory": ["record_id"], "staged_sagas": ["saga_id"], "staged_steps": ["saga_id", "step_name"],
    "staged_records": ["record_id"], "staged_checks": ["record_id", "block_number"], "staged_users": ["user_id"],
    "staged_shipment_history": ["change_seq"], "staged_delivery_history": ["delivery_id"], "staged_saga_events": ["change_seq"],
    "staged_nonces": ["address", "network"], "staged_envelopes": ["row_id"],
}


def _location_rules(col: str) -> list[RowRule]:
    out = []
    for field in ("country", "city"):
        expr = f"json_extract_{field}"
        out.append(RowRule("Q4", f"non_empty:{col}.{field}", expr, col))
    return out


ROW_RULES: dict[str, list[RowRule]] = {
    "shipments": [
        domain_rule("status", schemas.SHIPMENT_LIFECYCLE),
        *[not_null_rule(c) for c in ("shipment_id", "origin", "destination", "status", "created_at", "updated_at")],
        max_len_rule("status", 50),
        *_location_rules("origin"), *_location_rules("destination"),
    ],
    "items": [
        range_rule("range:quantity>0", "quantity <= 0", "quantity"),
        range_rule("range:weight>0", "weight <= 0", "weight"),
        RowRule("Q4", "value:quantity>=1", "quantity < 1", "cast(quantity as string)"),
        RowRule("Q4", "value:weight>=0", "weight < 0", "cast(weight as string)"),
        *[not_null_rule(c) for c in ("item_id", "shipment_id", "name", "quantity", "weight")],
        max_len_rule("name", 255),
    ],
    "couriers": [
        RowRule("Q4", "value:name_min_2", "length(trim(name)) < 2", "name"),
        RowRule("Q4", "value:name_max_100", "length(name) > 100", "name"),
        RowRule("Q4", "value:contact_min_5", "length(trim(contact_info)) < 5", "contact_info"),
        *[not_null_rule(c) for c in ("courier_id", "name", "contact_info")],
        max_len_rule("name", 255),
    ],
    "deliveries": [
        domain_rule("status", schemas.DELIVERY_CHECK),
        RowRule("Q3", "temporal:actual_arrival>=created_at", "actual_arrival < created_at",
                "cast(actual_arrival as string)"),
        *[not_null_rule(c) for c in ("delivery_id", "shipment_id", "courier_id", "status")],
    ],
    "delivery_tracking_points": [
        range_rule("range:latitude", "latitude < -90 OR latitude > 90", "latitude"),
        range_rule("range:longitude", "longitude < -180 OR longitude > 180", "longitude"),
        range_rule("range:accuracy>0", "accuracy_meters <= 0", "accuracy_meters"),
        *[not_null_rule(c) for c in ("tracking_id", "delivery_id", "latitude", "longitude", "recorded_at")],
    ],
    "warehouses": [*_location_rules("location"), max_len_rule("name", 255)],
    "inventory_records": [
        domain_rule("status", schemas.INVENTORY_CHECK),
        *[not_null_rule(c) for c in ("record_id", "shipment_id", "warehouse_id", "status")],
    ],
    "saga_instances": [
        domain_rule("status", schemas.SAGA_CHECK),
        range_rule("range:retry_count>=0", "retry_count < 0", "retry_count"),
        RowRule("Q3", "temporal:completed_at>=started_at", "completed_at < started_at",
                "cast(completed_at as string)"),
        max_len_rule("saga_type", 100),
        *[not_null_rule(c) for c in ("saga_id", "saga_type", "shipment_id", "status", "started_at")],
    ],
    "saga_steps": [
        domain_rule("status", schemas.STEP_CHECK),
        range_rule("range:step_order>=0", "step_order < 0", "step_order"),
        RowRule("Q3", "temporal:completed_at>=started_at", "completed_at < started_at",
                "cast(completed_at as string)"),
    ],
    "blockchain_records": [
        domain_rule("status", schemas.TX_STATUS),
        range_rule("range:block_number>=0", "block_number < 0", "block_number"),
        max_len_rule("network", 50),
        *[not_null_rule(c) for c in ("record_id", "shipment_id", "tx_hash", "status")],
    ],
    "transaction_confirmations": [
        range_rule("range:block_number>=0", "block_number < 0", "block_number"),
        range_rule("range:confirmation_count>=0", "confirmation_count < 0", "confirmation_count"),
    ],
    "users": [
        RowRule("Q1", "domain:role", f"lower(trim(role)) NOT IN ({_dom(schemas.USER_ROLES)})", "role"),
        *[not_null_rule(c) for c in ("user_id", "username", "email")],
    ],
}


UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

# Rules of tables that have no view of their own above.
ROW_RULES_OTHER: dict[str, list[RowRule]] = {
    "shipment_status_history": [domain_rule("new_status", schemas.SHIPMENT_CHECK),
                                *[not_null_rule(c) for c in ("shipment_id", "new_status", "changed_at")]],
    "delivery_status_history": [domain_rule("new_status", schemas.DELIVERY_CHECK),
                                *[not_null_rule(c) for c in ("delivery_id", "new_status", "changed_at")]],
    "saga_events": [domain_rule("event_type", schemas.SAGA_EVENT_TYPES),
                    *[not_null_rule(c) for c in ("saga_id", "event_type", "occurred_at")], max_len_rule("event_type", 100)],
    "nonce_state": [range_rule("range:current_nonce>=0", "current_nonce < 0", "current_nonce"), max_len_rule("address", 42),
                    *[not_null_rule(c) for c in ("address", "network", "current_nonce")]],
    "envelopes": [RowRule("Q4", "value:uuid:event_id", f"NOT regexp_like(event_id, '{UUID_PATTERN}')", "event_id"),
                  RowRule("Q3", "temporal:utc:timestamp", "NOT regexp_like(timestamp, '(Z|[+]00:00)$')", "timestamp")],
}


def _engine_rule_sql(rule: RowRule, engine: str) -> str:
    """Location rules need the JSON accessor of the engine."""
    v = rule.violated
    if v.startswith("json_extract_"):
        field = v[len("json_extract_"):]
        col = rule.value
        getter = (f"get_json_object({col}, '$.{field}')" if engine == "spark"
                  else f"json_extract_string({col}, '$.{field}')")
        return f"length(trim(coalesce({getter}, ''))) = 0"
    return v if engine == "spark" else v.replace("regexp_like(", "regexp_matches(")


def key_sql(table: str) -> str:
    cols = TABLE_KEYS[table]
    if len(cols) == 1:
        return f"cast({cols[0]} as string)"
    return "concat_ws('|', " + ", ".join(f"cast({c} as string)" for c in cols) + ")"


def row_violations(df: DataFrame, table: str, families=None, rules: list[RowRule] | None = None) -> DataFrame:
    """Q1-Q4, Q7: all row rules of one table in a single scan."""
    if rules is None:
        rules = [r for r in ROW_RULES.get(table, []) if families is None or r.family in families]
    if not rules:
        return df.sparkSession.createDataFrame([], "table_name string, row_key string, rule string, value string")
    hits = [F.when(F.expr(_engine_rule_sql(r, "spark")),
                   F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).cast("string").alias("value")))
            for r in rules]
    return (df.select(F.expr(key_sql(table)).alias("row_key"), F.array_compact(F.array(*hits)).alias("_v"))
            .where(F.size("_v") > 0)
            .select(F.lit(table).alias("table_name"), "row_key", F.explode("_v").alias("_h"))
            .select("table_name", "row_key", F.col("_h.rule").alias("rule"), F.col("_h.value").alias("value")))


def row_violations_oracle(table: str, families=None, rules: list[RowRule] | None = None) -> str:
    """The same rules as a UNION ALL of plain filters (DuckDB text)."""
    parts = []
    for r in ROW_RULES.get(table, []) if rules is None else rules:
        if families is not None and r.family not in families:
            continue
        parts.append(f"SELECT '{table}' AS table_name, {key_sql(table)} AS row_key, '{r.name}' AS rule, "
                     f"cast({r.value} as varchar) AS value FROM {table} WHERE {_engine_rule_sql(r, 'duckdb')}")
    return "\nUNION ALL\n".join(parts)


# ---- Q5 uniqueness ----------------------------------------------------------

UNIQUE_KEYS: list[tuple[str, list[str], str | None]] = [
    ("shipments", ["shipment_id"], None), ("items", ["item_id"], None),
    ("couriers", ["courier_id"], None), ("deliveries", ["delivery_id"], None),
    ("warehouses", ["warehouse_id"], None), ("inventory_records", ["record_id"], None),
    ("saga_instances", ["saga_id"], None), ("saga_steps", ["saga_id", "step_name"], None),
    ("blockchain_records", ["record_id"], None), ("blockchain_records", ["tx_hash"], None),
    ("users", ["user_id"], None), ("users", ["username"], None), ("users", ["email"], None),
    ("refresh_tokens", ["token_id"], None), ("refresh_tokens", ["token_hash"], None),
    # partial unique index: at most one active saga per shipment
    ("saga_instances", ["shipment_id"], "upper(trim(status)) IN ('STARTED', 'COMPENSATING')"),
]


def _unique_rule_name(cols, where) -> str:
    return "unique:" + ",".join(cols) + (":active" if where else "")


def duplicate_keys(df: DataFrame, table: str, cols: list[str], where: str | None = None) -> DataFrame:
    """Q5: keys held by more than one row, with the number of holders.
    A grouped count with map-side partial aggregation: a hot key costs one
    partial row per map task, not a skewed shuffle.  As in SQL a key with a
    null is never a duplicate.  Keys are grouped as they are; their text is
    made for the reported ones alone."""
    src = df.where(F.expr(where)) if where else df
    key = (F.col(cols[0]).cast("string") if len(cols) == 1
           else F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))
    return (src.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select(F.lit(table).alias("table_name"), key.alias("row_key"),
                    F.lit(_unique_rule_name(cols, where)).alias("rule"), F.col("n").cast("string").alias("value")))


def duplicate_keys_oracle(table: str, cols: list[str], where: str | None = None) -> str:
    key = (f"cast({cols[0]} as varchar)" if len(cols) == 1
           else "concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in cols) + ")")
    known = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    w = f"WHERE {known} AND {where}" if where else f"WHERE {known}"
    return (f"SELECT '{table}' AS table_name, {key} AS row_key, '{_unique_rule_name(cols, where)}' AS rule, "
            f"cast(count(*) as varchar) AS value FROM {table} {w} GROUP BY {', '.join(cols)} HAVING count(*) > 1")


# ---- Q6 referential integrity -----------------------------------------------

FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    # child, fk column, parent, parent key
    ("items", "shipment_id", "shipments", "shipment_id"),
    ("shipment_status_history", "shipment_id", "shipments", "shipment_id"),
    ("deliveries", "courier_id", "couriers", "courier_id"),
    ("delivery_tracking_points", "delivery_id", "deliveries", "delivery_id"),
    ("delivery_status_history", "delivery_id", "deliveries", "delivery_id"),
    ("inventory_records", "warehouse_id", "warehouses", "warehouse_id"),
    ("saga_steps", "saga_id", "saga_instances", "saga_id"),
    ("saga_events", "saga_id", "saga_instances", "saga_id"),
    ("transaction_confirmations", "record_id", "blockchain_records", "record_id"),
    ("blockchain_events", "record_id", "blockchain_records", "record_id"),
    ("refresh_tokens", "user_id", "users", "user_id"),
]


def orphans(child: DataFrame, child_name: str, fk: str, parent: DataFrame, parent_name: str, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent (null FKs pass)."""
    keys = parent.select(F.col(pk).alias(fk))
    return (child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")
            .select(F.lit(child_name).alias("table_name"), F.expr(key_sql(child_name)).alias("row_key"),
                    F.lit(f"fk:{fk}->{parent_name}").alias("rule"), F.col(fk).cast("string").alias("value")))


def orphans_by_parent(children: list[tuple[DataFrame, str, str]], parent: DataFrame, parent_name: str, pk: str) -> DataFrame:
    """Q6: ``orphans`` of several (child, name, foreign key) of one parent, whose keys are read and shuffled once."""
    rows = union_all([
        child.where(F.col(fk).isNotNull()).select(
            F.lit(name).alias("table_name"), F.expr(key_sql(name)).alias("row_key"), F.lit(f"fk:{fk}->{parent_name}").alias("rule"),
            F.col(fk).alias("_fk")) for child, name, fk in children])
    keys = parent.select(F.col(pk).alias("_fk"))
    return rows.join(keys, "_fk", "left_anti").select("table_name", "row_key", "rule", F.col("_fk").cast("string").alias("value"))


def parentless(changes: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """The changes of keys that the parent lacks.  A history depends on the rows of its own key alone, so the
    orphans of a history are the history of these: nothing else needs to be put in order."""
    return changes.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def all_rows(child: DataFrame, child_name: str, fk: str, parent_name: str) -> DataFrame:
    """Rows that are known to be orphans, as violations."""
    return child.select(F.lit(child_name).alias("table_name"), F.expr(key_sql(child_name)).alias("row_key"),
                        F.lit(f"fk:{fk}->{parent_name}").alias("rule"), F.col(fk).cast("string").alias("value"))


def orphans_oracle(child_name: str, fk: str, parent_name: str, pk: str) -> str:
    return (f"SELECT '{child_name}' AS table_name, {key_sql(child_name)} AS row_key, "
            f"'fk:{fk}->{parent_name}' AS rule, cast({fk} as varchar) AS value FROM {child_name} c "
            f"WHERE {fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent_name} p WHERE p.{pk} = c.{fk})")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
