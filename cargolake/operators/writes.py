"""Keyed writes U1-U14: change sets applied to table snapshots.

Snapshots are immutable DataFrames: every write returns the new snapshot
(and, for guarded writes, the rejected requests).  Nothing is updated in
place; ``write_snapshot`` persists a version to a new path so a reader of
the previous version is never disturbed.

Scale notes
* Change sets are reduced to one row per key first (``max_by`` with
  partial aggregation, so a key holding a third of all changes costs one
  partial row per map task, not a skewed shuffle partition).
* The snapshot-to-changes join is a key-equi join; with a target bucketed
  on its key only the (small) change side shuffles; upserts hash the
  change side and never sort the stored rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake.functions.common import normalised, ts_lit
from cargolake.functions.sequences import keyed_position


def _ordering(order_by: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in order_by])


def latest_per_key(changes: DataFrame, key: list[str], order_by: list[str], cols: list[str]) -> DataFrame:
    """The last change per key (ties on the order must be broken by a
    sequence column inside ``order_by``)."""
    payload = F.struct(*[F.col(c) for c in cols])
    return (changes.groupBy(*key).agg(F.max_by(payload, _ordering(order_by)).alias("_c"))
            .select(*key, *[F.col(f"_c.{c}").alias(c) for c in cols]))


def upsert(target: DataFrame, changes: DataFrame, key: list[str] | str, update_cols: list[str],
           order_by: list[str], as_of: str | None = None, touch_col: str | None = "updated_at",
           created_col: str | None = "created_at", defaults: dict[str, Column] | None = None,
           keep_cols: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """INSERT ... ON CONFLICT (key) DO UPDATE SET update_cols.

    New keys insert the change row (missing columns take ``defaults``;
    ``keep_cols`` those of the key's first change; created/updated = as_of);
    existing keys overwrite ``update_cols`` (null
    overwrites, as in SQL) and keep every other column of the stored row;
    ``touch_col`` becomes as_of on every written row."""
    key = [key] if isinstance(key, str) else key
    defaults = defaults or {}
    present = [c for c in update_cols if c in changes.columns]
    kept = [c for c in keep_cols if c in changes.columns]
    folded = changes.groupBy(*key).agg(
        F.max_by(F.struct(*present), _ordering(order_by)).alias("_c"),
        *([F.min_by(F.struct(*kept), _ordering(order_by)).alias("_k")] if kept else []))
    last = folded.select(*key, *[F.col(f"_c.{c}") for c in present], *[F.col(f"_k.{c}") for c in kept], F.lit(True).alias("_hit"))
    # stored rows, and their keys, meet the changes in joins that hash the changes,
    # one narrow row a key: to sort the stored ones takes memory by their number;
    # new keys are added apart, so the target is never outer-joined
    joined = target.alias("t").join(last.hint("shuffle_hash").alias("c"), key, "left")
    found = target.select(*key).join(last.select(*key).hint("shuffle_hash"), key, "left_semi")
    fresh = last.join(found, key, "left_anti")
    now = ts_lit(as_of) if as_of else None
    stored, added = [], []
    for name in target.columns:
        kind, hit = target.schema[name].dataType, F.col("c._hit")
        old = F.col(name) if name in key else F.col(f"t.{name}")
        if name in key:
            stored.append(old)
            added.append(F.col(name).cast(kind).alias(name))
        elif now is not None and name in (touch_col, created_col):
            stored.append((F.when(hit, now).otherwise(old) if name == touch_col else F.coalesce(old, F.when(hit, now))).alias(name))
            added.append(now.cast(kind).alias(name))
        elif name in present:
            stored.append(F.when(hit, F.col(f"c.{name}").cast(kind)).otherwise(old).alias(name))
            added.append(F.col(name).cast(kind).alias(name))
        elif name in kept:
            stored.append(old.alias(name))
            added.append(F.col(name).cast(kind).alias(name))
        else:
            stored.append(old.alias(name))
            added.append(defaults.get(name, F.lit(None)).cast(kind).alias(name))
    return joined.select(*stored).unionByName(fresh.select(*added))


@dataclass(frozen=True)
class Policy:
    """What an upsert of one table does with a stored key: ``update`` columns are
    overwritten, ``keep`` columns are written on insert alone, ``defaults`` fill
    what is never written; ``touched`` tables take as_of as their times."""

    key: str
    update: tuple[str, ...]
    keep: tuple[str, ...] = ()
    defaults: dict[str, object] = field(default_factory=dict)
    touched: bool = False


# fixed values: upsert policies of the nine tables
UPSERT_POLICIES: dict[str, Policy] = {
    "shipments": Policy("shipment_id", ("origin", "destination", "status"), touched=True),
    "items": Policy("item_id", ("shipment_id", "name", "quantity", "weight")),
    "couriers": Policy("courier_id", ("name", "contact_info"), defaults={"is_active": True}),
    "deliveries": Policy("delivery_id", ("shipment_id", "courier_id", "status", "estimated_arrival", "actual_arrival", "updated_at"),
                         keep=("created_at",)),
    "warehouses": Policy("warehouse_id", ("name", "location")),
    "inventory_records": Policy("record_id", ("shipment_id", "warehouse_id", "status", "updated_at"), keep=("received_at",)),
    "saga_instances": Policy("saga_id", ("warehouse_id", "delivery_id", "status", "updated_at", "failed_step", "error_message"),
                             keep=("saga_type", "shipment_id", "started_at"), defaults={"retry_count": 0}),
    "blockchain_records": Policy("record_id", ("status", "confirmed_at", "block_number", "error_message", "gas_used"),
                                 keep=("shipment_id", "tx_hash", "payload", "created_at"), defaults={"network": "ethereum"}),
    "users": Policy("user_id", ("username", "email", "hashed_password", "role", "is_active", "updated_at"),
                    keep=("created_at",), defaults={"role": "operator", "is_active": True}),
}


def upsert_table(name: str, target: DataFrame, changes: DataFrame, order_by: list[str], as_of: str) -> DataFrame:
    """Upsert by the table's own policy."""
    p = UPSERT_POLICIES[name]
    return upsert(target, changes, p.key, list(p.update), order_by, as_of if p.touched else None,
                  defaults={c: F.lit(v) for c, v in p.defaults.items()}, keep_cols=p.keep)


def set_field(target: DataFrame, changes: DataFrame, key: str, column: str, order_by: list[str]):
    """U8: absolute setter of one column of stored rows (U12 gate).  Returns
    (new snapshot, keys that were not found)."""
    known, missing = require_existing(target, changes, key)
    return upsert(target, known, key, [column], order_by, touch_col=None, created_col=None), missing.select(key).distinct()


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append-only insert (schemas aligned by name)."""
    return target.unionByName(rows, allowMissingColumns=True)


def patch(target: DataFrame, patches: DataFrame, key: list[str] | str, cols: list[str],
          order_by: list[str], as_of: str | None = None, touch_col: str | None = "updated_at") -> DataFrame:
    """Sequential PATCH requests where null means "keep".  Folding the
    patches of a key is per column "last non-null value", which is one
    ``max_by`` per column with the ordering nulled out for null values."""
    key = [key] if isinstance(key, str) else key
    order = _ordering(order_by)
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols]
    folded = patches.groupBy(*key).agg(*aggs, F.lit(True).alias("_hit"))
    t, p = target.alias("t"), folded.alias("p")
    joined = t.join(p, key, "left")
    now = ts_lit(as_of) if as_of else None
    out = []
    for name in target.columns:
        if name in key:
            out.append(F.col(name))
        elif name in cols:
            out.append(F.coalesce(F.col(f"p.{name}"), F.col(f"t.{name}")).alias(name))
        elif touch_col and name == touch_col and now is not None:
            out.append(F.when(F.col("p._hit"), now).otherwise(F.col(f"t.{name}")).alias(name))
        else:
            out.append(F.col(f"t.{name}"))
    return joined.select(*out)


def patch_location(target: DataFrame, patches: DataFrame, key: str, cols: list[str], order_by: list[str],
                   location: str = "location") -> DataFrame:
    """PATCH requests that may change the fields of a location one by one:
    a null field keeps what is stored."""
    fields = ("country", "city", "address")
    flat = target.select("*", *[F.get_json_object(location, f"$.{f}").alias(f) for f in fields])
    done = patch(flat, patches, key, [*cols, *fields], order_by, touch_col=None)
    whole = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return done.select(*[whole.alias(c) if c == location else F.col(c) for c in target.columns])


def require_existing(target: DataFrame, changes: DataFrame, key: list[str] | str):
    """(accepted changes, not-found changes) for update requests."""
    key = [key] if isinstance(key, str) else key
    keys = target.select(*key)
    return changes.join(keys, key, "left_semi"), changes.join(keys, key, "left_anti")


def delivery_patch(deliveries: DataFrame, patches: DataFrame, couriers: DataFrame, as_of: str):
    """Delivery PATCH precedence.

    A request naming an unknown courier is rejected whole (404); so is a
    request for an unknown delivery.  For accepted requests: actual_arrival
    set -> status DELIVERED (the request's status is ignored), else the
    request's status; estimated_arrival applies independently; the courier
    changes when given.  Returns (new snapshot, rejected requests)."""
    # requests that name no courier, most of them, stay out of the join: a null is one hot key
    named = patches.where(F.col("courier_id").isNotNull())
    known = couriers.select("courier_id")
    accepted_c = (patches.where(F.col("courier_id").isNull())
                  .unionByName(named.join(known, "courier_id", "left_semi")))
    rejected_c = named.join(known, "courier_id", "left_anti").withColumn("reason", F.lit("courier_not_found"))
    _, missing = require_existing(deliveries, accepted_c, "delivery_id")
    rejected = rejected_c.unionByName(missing.withColumn("reason", F.lit("delivery_not_found")))
    # the snapshot needs no check of the delivery: its left join passes over requests for unknown ones
    effective = accepted_c.select(
        "delivery_id", "patch_seq",
        F.when(F.col("actual_arrival").isNotNull(), F.lit("DELIVERED")).otherwise(F.col("status")).alias("status"),
        "actual_arrival", "estimated_arrival", "courier_id")
    snap = patch(deliveries, effective, "delivery_id", ["status", "actual_arrival", "estimated_arrival", "courier_id"],
                 ["patch_seq"], as_of)
    return snap, rejected


def truthy(c: Column) -> Column:
    """Python truthiness of an id: null and empty text are falsy."""
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(None)).otherwise(c)


def saga_context_patch(sagas: DataFrame, patches: DataFrame, as_of: str) -> DataFrame:
    """Only truthy warehouse_id / delivery_id values persist."""
    p = patches.select("saga_id", "patch_seq", truthy(F.col("warehouse_id")).alias("warehouse_id"),
                       truthy(F.col("delivery_id")).alias("delivery_id"))
    accepted, _ = require_existing(sagas, p, "saga_id")
    return patch(sagas, accepted, "saga_id", ["warehouse_id", "delivery_id"], ["patch_seq"], as_of)


def delete(target: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None):
    """U4: (remaining rows, requested keys that were not found)."""
    k = keys.select(F.col(keys_col or key).alias(key)).distinct()
    remaining = target.join(k, key, "left_anti")
    not_found = k.join(target.select(key), key, "left_anti")
    return remaining, not_found


def cascade_delete(keys: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """ON DELETE CASCADE - each child loses the rows whose FK is deleted."""
    k = keys.select(F.col(key)).distinct()
    return {name: df.join(k.withColumnRenamed(key, fk), fk, "left_anti") for name, (df, fk) in children.items()}


def restricted_delete(parents: DataFrame, keys: DataFrame, key: str, children: DataFrame, fk: str):
    """ON DELETE RESTRICT - keys still referenced are refused.
    Returns (new parent snapshot, refused keys)."""
    k = keys.select(F.col(key)).distinct()
    referenced = children.select(F.col(fk).alias(key)).distinct()
    refused = k.join(referenced, key, "left_semi")
    allowed = k.join(referenced, key, "left_anti")
    return parents.join(allowed, key, "left_anti"), refused


def adjust_quantity(items: DataFrame, deltas: DataFrame, as_of: str | None = None):
    """Net quantity change per item; the batch for an item is refused
    when the result would fall below 1 (the Quantity value object's rule).
    Returns (new snapshot, rejected items with the refused net delta)."""
    net = deltas.groupBy("item_id").agg(F.sum("delta").cast("bigint").alias("net_delta"))
    j = items.join(net, "item_id", "left")
    new_q = F.col("quantity").cast("bigint") + F.col("net_delta")
    ok = F.col("net_delta").isNull() | (new_q >= 1)
    cols = [F.when(ok & F.col("net_delta").isNotNull(), new_q.cast("int")).otherwise(F.col("quantity")).alias(c)
            if c == "quantity" else F.col(c) for c in items.columns]
    snap = j.select(*cols)
    rejected = j.where(~ok).select("item_id", "shipment_id", "quantity", "net_delta")
    return snap, rejected


def revoke_tokens(tokens: DataFrame, hashes: DataFrame) -> DataFrame:
    """revoked = true for every stored token whose hash is presented."""
    h = hashes.select("token_hash").distinct().withColumn("_hit", F.lit(True))
    return (tokens.join(h, "token_hash", "left")
            .withColumn("revoked", F.col("revoked") | F.coalesce(F.col("_hit"), F.lit(False)))
            .select(*tokens.columns))


def reassign_courier(deliveries: DataFrame, assignments: DataFrame, as_of: str):
    """Reassign couriers; refused for DELIVERED / CONFIRMED deliveries.
    Latest assignment per delivery wins.  Returns (snapshot, refused)."""
    last = latest_per_key(assignments, ["delivery_id"], ["assign_seq"], ["courier_id", "assign_seq"])
    state = deliveries.select("delivery_id", "status")
    j = last.join(state, "delivery_id", "inner")
    finished = F.upper(F.trim("status")).isin("DELIVERED", "CONFIRMED")
    accepted = j.where(~finished).select("delivery_id", "courier_id", "assign_seq")
    refused = j.where(finished).select("delivery_id", "courier_id", "status")
    snap = upsert(deliveries, accepted, "delivery_id", ["courier_id"], ["assign_seq"], as_of)
    return snap, refused


def apply_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Column defaults for inserted rows (missing column or null)."""
    out = df
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    return out


def rotate_tokens(tokens: DataFrame, presented: DataFrame, users: DataFrame, as_of: str, lifetime_days: int = 30):
    """Refresh-token rotation.  A presented token that is valid at as_of
    (P9) is revoked (U9); if its user still exists (J10) a successor is
    appended (U2), else it is rejected like any other.  Returns (snapshot, report)."""
    now = ts_lit(as_of)
    p = presented.select("token_hash").distinct()
    live = tokens.join(p, "token_hash", "inner").where(~F.col("revoked") & (F.col("expires_at") > now))
    valid = live.join(users.select("user_id"), "user_id", "left_semi")
    new_hash = F.md5(F.concat(F.col("token_hash"), F.lit("@" + as_of)))
    # successors take the numbers after the largest stored one, in the order of their hashes
    hashed = valid.select("user_id", new_hash.alias("token_hash"), F.lit("all").alias("_all"))
    numbered = keyed_position(hashed, ["_all"], ["token_hash"], F.substring("token_hash", 1, 3))
    largest = F.coalesce(tokens.agg(F.max("token_id")).scalar(), F.lit(0))
    successors = numbered.select(
        (largest + F.col("position")).cast("bigint").alias("token_id"), "user_id", "token_hash",
        (now + F.expr(f"interval {int(lifetime_days)} days")).alias("expires_at"),
        F.lit(False).alias("revoked"))
    snap = append(revoke_tokens(tokens, live.select("token_hash")), successors)
    report = (p.join(valid.select("token_hash", F.lit("rotated").alias("outcome")), "token_hash", "left")
              .select("token_hash", F.coalesce("outcome", F.lit("rejected")).alias("outcome")))
    return snap, report


def write_snapshot(df: DataFrame, base_path: str, version: int, partition_by: list[str] | None = None,
                   statuses: tuple[str, ...] = ("status",)) -> str:
    """Persist a snapshot version under ``base_path/v=<version>``; readers of
    older versions are untouched (never overwrite the path being read).
    ``statuses`` are normalised here, once, so that readers can push filters."""
    path = f"{base_path.rstrip('/')}/v={int(version)}"
    w = normalised(df, *[c for c in statuses if c in df.columns]).write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path
