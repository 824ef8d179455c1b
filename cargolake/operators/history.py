"""State machines, status history and event sourcing.

History is derived, never hand-written: either by diffing two immutable
snapshots (J9: full outer join on the key with a null-safe compare - what a
row trigger sees) or from a change log with a skew-safe per-key lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.functions.common import is_distinct, ts_lit
from cargolake.functions.sequences import crowded, hour_chunk, keyed_lag, keyed_last, newest_first, seq_chunk


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Old ⟗ new on key.  op = insert / update / delete / same, with
    old_<c> and new_<c> for each compared column."""
    o = old.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in cols], F.lit(True).alias("_o"))
    n = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in cols], F.lit(True).alias("_n"))
    j = o.join(n, key, "full_outer")
    changed = None
    for c in cols:
        d = is_distinct(f"old_{c}", f"new_{c}")
        changed = d if changed is None else (changed | d)
    op = (F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete")
          .when(changed, "update").otherwise("same"))
    return j.withColumn("op", op).drop("_o", "_n")


def status_history_from_snapshots(old: DataFrame, new: DataFrame, key: str, as_of: str) -> DataFrame:
    """H1/H2 (batch form): insert -> (null, new); update -> (old, new) only
    when the status IS DISTINCT FROM the old one; deletes log nothing."""
    d = snapshot_diff(old, new, key, ["status"])
    keep = (F.col("op") == "insert") | ((F.col("op") == "update") & is_distinct("old_status", "new_status"))
    return (d.where(keep)
            .select(key, F.when(F.col("op") == "insert", F.lit(None).cast("string"))
                    .otherwise(F.col("old_status")).alias("old_status"),
                    "new_status", ts_lit(as_of).alias("changed_at")))


def status_history_from_log(snapshot: DataFrame, changes: DataFrame, key: str,
                            ts_col: str = "changed_at", seq_col: str = "change_seq") -> DataFrame:
    """H1/H2 (change-log form): each change against the state before it.
    The stored snapshot status of a changed key is its starting state; a key
    absent from the snapshot starts with an insert (old_status null).
    Rows whose status equals the previous one log nothing."""
    changed_keys = changes.select(key).distinct()
    base = (snapshot.join(changed_keys, key, "left_semi")
            .select(key, "status", F.lit(0).alias("_src"), F.lit(None).cast("timestamp_ntz").alias(ts_col),
                    F.lit(None).cast("bigint").alias(seq_col)))
    log = changes.select(key, "status", F.lit(1).alias("_src"), F.col(ts_col), F.col(seq_col).cast("bigint"))
    seq = keyed_lag(base.unionByName(log), [key], ["_src", ts_col, seq_col], ["status"], hour_chunk(ts_col))
    return (seq.where((F.col("_src") == 1) & is_distinct("prev_status", "status"))
            .select(key, F.col("prev_status").alias("old_status"), F.col("status").alias("new_status"),
                    ts_col, seq_col))


_SAGA_EVENT_FOR = {"COMPLETED": "SAGA_COMPLETED", "FAILED": "SAGA_FAILED", "COMPENSATING": "COMPENSATION_STARTED"}


def saga_event_type(new_status: Column) -> Column:
    st = F.upper(F.trim(new_status))
    out = F.lit("SAGA_STARTED")
    for status, ev in reversed(list(_SAGA_EVENT_FOR.items())):
        out = F.when(st == status, F.lit(ev)).otherwise(out)
    return out


_JSON_NULLS = {"ignoreNullFields": "false"}


def saga_events_from_log(sagas: DataFrame, changes: DataFrame) -> DataFrame:
    """H3: event-sourcing rows for saga status changes.

    insert -> SAGA_STARTED {saga_type, shipment_id, status};
    update with a different status -> COMPLETED/FAILED/COMPENSATING map to
    SAGA_COMPLETED / SAGA_FAILED / COMPENSATION_STARTED, anything else to
    SAGA_STARTED, with {old_status, new_status, failed_step, error_message}."""
    changed = changes.select("saga_id").distinct()
    base = (sagas.join(changed, "saga_id", "left_semi")
            .select("saga_id", "status", F.lit(0).alias("_src"),
                    F.lit(None).cast("timestamp_ntz").alias("changed_at"), F.lit(None).cast("bigint").alias("change_seq"),
                    "saga_type", "shipment_id", "failed_step"))
    log = changes.select("saga_id", "status", F.lit(1).alias("_src"), "changed_at", F.col("change_seq").cast("bigint"),
                         "saga_type", "shipment_id", "failed_step")
    seq = keyed_lag(base.unionByName(log), ["saga_id"], ["_src", "changed_at", "change_seq"], ["status", "_src"],
                    hour_chunk("changed_at"))
    inserted = F.col("prev__src").isNull()
    upd = (~inserted) & (F.col("prev_status") != F.col("status"))
    started = F.to_json(F.struct(F.col("saga_type"), F.col("shipment_id"), F.col("status")), _JSON_NULLS)
    changed_json = F.to_json(F.struct(F.col("prev_status").alias("old_status"), F.col("status").alias("new_status"),
                                      F.col("failed_step"), F.lit(None).cast("string").alias("error_message")),
                             _JSON_NULLS)
    return (seq.where((F.col("_src") == 1) & (inserted | upd))
            .select("saga_id",
                    F.when(inserted, F.lit("SAGA_STARTED")).otherwise(saga_event_type(F.col("status"))).alias("event_type"),
                    F.when(inserted, started).otherwise(changed_json).alias("event_data"),
                    F.col("changed_at").alias("occurred_at"), "change_seq"))


def completion_times(history: DataFrame, key: str = "saga_id") -> DataFrame:
    """H4: completed_at = time of the first entry into a final status from a
    non-final one (per key; partial aggregation, no window)."""
    final = schemas.SAGA_FINAL
    entering = (F.upper(F.trim("new_status")).isin(*final)
                & (F.col("old_status").isNull() | ~F.upper(F.trim("old_status")).isin(*final)))
    return (history.groupBy(key)
            .agg(F.min(F.when(entering, F.col("changed_at"))).alias("completed_at"))
            .where(F.col("completed_at").isNotNull()))


def shipment_transitions(spark) -> DataFrame:
    """The allowed (from, to) pairs of the linear shipment chain - a
    constant of five rows (broadcast is safe: its size is fixed)."""
    chain = schemas.SHIPMENT_LIFECYCLE
    return spark.createDataFrame([(a, b) for a, b in zip(chain, chain[1:])], "from_status string, to_status string")


def check_transitions(history: DataFrame) -> DataFrame:
    """H5: flag each (old -> new) transition as allowed or not."""
    allowed = F.broadcast(shipment_transitions(history.sparkSession).withColumn("_ok", F.lit(True)))
    h = history.withColumn("from_status", F.upper(F.trim("old_status"))).withColumn("to_status", F.upper(F.trim("new_status")))
    return (h.join(allowed, ["from_status", "to_status"], "left")
            .withColumn("allowed", F.coalesce(F.col("_ok"), F.lit(False)))
            .drop("_ok", "from_status", "to_status"))


SHIPMENT_VERBS = {  # verb -> resulting status (fixed values)
    "receive": "received", "ready": "ready_for_delivery", "dispatch": "in_transit",
    "deliver": "delivered", "complete": "completed",
}


def apply_shipment_verbs(shipments: DataFrame, verbs: DataFrame, as_of: str) -> DataFrame:
    """Lifecycle setters (they do NOT check H5), applied in order.  The
    last verb per shipment gives the status; any ``deliver`` sets arrival_date
    to the as_of date, also when other verbs follow it."""
    m = F.create_map(*[x for kv in SHIPMENT_VERBS.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    v = verbs.select("shipment_id", "verb_seq", "verb", m[F.col("verb")].alias("status")).where(F.col("status").isNotNull())
    last = (v.groupBy("shipment_id").agg(F.max_by("status", "verb_seq").alias("_new"),
                                         F.bool_or(F.col("verb") == "deliver").alias("_arrived"))
            .withColumn("_hit", F.lit(True)))
    j = shipments.join(last, "shipment_id", "left")
    now = ts_lit(as_of)
    out = []
    for c in shipments.columns:
        if c == "status":
            out.append(F.coalesce("_new", "status").alias(c))
        elif c == "arrival_date":
            out.append(F.when(F.col("_arrived"), F.to_date(now)).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            out.append(F.when(F.col("_hit"), now).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def _first(condition: Column, seq: str) -> Column:
    """Sequence number of the first row that meets ``condition`` (null: none)."""
    return F.min(F.when(condition, F.col(seq)))


def _passed(mark: str, seq: str) -> Column:
    """True when the marked request came before this one."""
    return F.coalesce(F.col(mark) < F.col(seq), F.lit(False))


def delivery_guard(deliveries: DataFrame, requests: DataFrame) -> DataFrame:
    """H6: delivery verbs in order, each against the status its predecessors
    left.  received / in_transit are refused in DELIVERED; confirm needs
    DELIVERED; deliver always applies and sets actual_arrival.

    Set-based fold: a deliver starts a new segment in DELIVERED.  There the
    first confirm is accepted (CONFIRMED), the first in_transit after it gives
    IN_TRANSIT, and neither a confirm nor an in_transit changes that again.  In
    a segment that starts elsewhere only the first in_transit changes the
    status.  So two small aggregates per segment give every request its state;
    no key is folded in one task."""
    chunk = seq_chunk("request_seq")
    state = deliveries.select("delivery_id", F.upper(F.trim("status")).alias("_start"))
    r = keyed_last(requests.withColumn("_own", F.when(F.col("verb") == "deliver", F.col("request_seq"))),
                   ["delivery_id"], ["request_seq"], "_own", chunk, "_segment").drop("_own")
    r = r.join(state, "delivery_id", "left").withColumn(
        "_start", F.when(F.col("_segment").isNotNull() & F.col("_start").isNotNull(), F.lit("DELIVERED")).otherwise(F.col("_start")))
    r = r.withColumn("_segment", F.coalesce("_segment", F.lit(-1)))
    key, verb = ["delivery_id", "_segment"], F.col("verb")
    confirms = r.where((F.col("_start") == "DELIVERED") & (verb == "confirm")).groupBy(*key).agg(F.min("request_seq").alias("_confirm"))
    r = r.join(confirms, key, "left")
    moving = (verb == "in_transit") & ((F.col("_start") != "DELIVERED") | _passed("_confirm", "request_seq"))
    r = r.join(r.where(moving).groupBy(*key).agg(F.min("request_seq").alias("_moved")), key, "left")
    current = (F.when(_passed("_moved", "request_seq"), F.lit("IN_TRANSIT"))
               .when(_passed("_confirm", "request_seq"), F.lit("CONFIRMED")).otherwise(F.col("_start")))
    r = r.withColumn("current", current)
    refused = (F.when(F.col("current").isNull(), F.lit("delivery_not_found"))
               .when(verb.isin("receive", "in_transit") & (F.col("current") == "DELIVERED"), F.lit("already_delivered"))
               .when((verb == "confirm") & (F.col("current") != "DELIVERED"), F.lit("not_delivered")))
    new_status = (F.when(verb == "in_transit", F.lit("IN_TRANSIT")).when(verb == "deliver", F.lit("DELIVERED"))
                  .when(verb == "confirm", F.lit("CONFIRMED")).otherwise(F.col("current")))
    return r.select("request_seq", "delivery_id", "verb", F.col("current").alias("current_status"),
                    refused.isNull().alias("accepted"),
                    F.when(refused.isNull(), new_status).otherwise(F.col("current")).alias("resulting_status"),
                    F.when(refused.isNull() & (verb == "deliver"), F.col("arrival")).alias("actual_arrival"),
                    refused.alias("reason"))


def apply_delivery_requests(deliveries: DataFrame, guarded: DataFrame, as_of: str) -> DataFrame:
    """H6: the snapshot after all accepted requests; every accepted one touches
    updated_at, the last deliver gives actual_arrival."""
    seq = F.col("request_seq")
    last = guarded.where("accepted").groupBy("delivery_id").agg(
        F.max_by("resulting_status", seq).alias("_new"),
        F.max_by("actual_arrival", F.when(F.col("verb") == "deliver", seq)).alias("_arrival"),
        F.bool_or(F.col("verb") == "deliver").alias("_arrived"),
        F.bool_or(F.upper(F.trim("resulting_status")) != F.col("current_status")).alias("_moved"))
    moved = F.coalesce("_moved", F.lit(False))
    values = {"status": F.when(moved, F.col("_new")).otherwise(F.col("status")),
              "actual_arrival": F.when(F.col("_arrived"), F.col("_arrival")).otherwise(F.col("actual_arrival")),
              "updated_at": F.when(F.col("_new").isNotNull(), ts_lit(as_of)).otherwise(F.col("updated_at"))}
    return deliveries.join(last, "delivery_id", "left").select(
        *[values[c].alias(c) if c in values else F.col(c) for c in deliveries.columns])


def inventory_guard(records: DataFrame, requests: DataFrame) -> DataFrame:
    """H7: status requests in order; SHIPPED is terminal (SHIPPED -> SHIPPED is
    allowed), so every request before the first SHIPPED applies and only that
    status follows it.  Unknown records are refused."""
    start = records.select("record_id", F.upper(F.trim("status")).alias("_start"))
    asked = crowded(requests.withColumn("_asked", F.upper(F.trim("new_status"))), ["record_id"])
    shipped = _first(F.col("_asked") == "SHIPPED", "request_seq")
    # most records have few requests: one shuffle of them serves both windows and the join
    by_record = Window.partitionBy("record_id")
    few = (asked.where(~F.col("_crowded"))
           .withColumn("prev__asked", F.lag("_asked").over(by_record.orderBy("request_seq")))
           .withColumn("_shipped", shipped.over(by_record)))
    many = keyed_lag(asked.where("_crowded"), ["record_id"], ["request_seq"], ["_asked"], seq_chunk("request_seq"))
    many = many.join(F.broadcast(asked.where("_crowded").groupBy("record_id").agg(shipped.alias("_shipped"))), "record_id", "left")
    r = few.unionByName(many).join(start, "record_id", "left")
    current = (F.when(F.col("_start").isNull(), F.lit(None)).when(F.col("_start") == "SHIPPED", F.lit("SHIPPED"))
               .when(_passed("_shipped", "request_seq"), F.lit("SHIPPED"))
               .otherwise(F.coalesce("prev__asked", "_start")))
    r = r.withColumn("current_status", current)
    reason = (F.when(F.col("current_status").isNull(), F.lit("record_not_found"))
              .when((F.col("current_status") == "SHIPPED") & (F.col("_asked") != "SHIPPED"), F.lit("already_shipped")))
    return r.select("request_seq", "record_id", "new_status", "current_status", reason.isNull().alias("accepted"), reason.alias("reason"))


def saga_guard(sagas: DataFrame, requests: DataFrame) -> DataFrame:
    """H8: requests in order; complete only from STARTED (otherwise a no-op, not
    an error); compensate refused from COMPLETED / FAILED; fail always applies.

    Set-based fold: FAILED is never left, so the first fail decides everything
    after it; before it, the first complete or compensate to come decides (a
    STARTED saga takes either, a CANCELLED one only the compensate)."""
    action, seq = F.col("action"), "request_seq"
    marks = requests.groupBy("saga_id").agg(_first(action == "fail", seq).alias("_fail"),
                                            _first(action == "complete", seq).alias("_complete"),
                                            _first(action == "compensate", seq).alias("_compensate"))
    r = (requests.join(marks, "saga_id", "left")
         .join(sagas.select("saga_id", F.upper(F.trim("status")).alias("_start")), "saga_id", "left"))
    completes = ((F.col("_start") == "STARTED") & _passed("_complete", seq)
                 & (F.col("_compensate").isNull() | (F.col("_complete") < F.col("_compensate"))))
    compensates = ~F.col("_start").isin("COMPLETED", "FAILED") & _passed("_compensate", seq)
    current = (F.when(F.col("_start").isNull(), F.lit(None)).when(_passed("_fail", seq), F.lit("FAILED"))
               .when(completes, F.lit("COMPLETED")).when(compensates, F.lit("COMPENSATING")).otherwise(F.col("_start")))
    r = r.withColumn("current", current)
    outcome = (F.when(F.col("current").isNull(), F.lit("saga_not_found"))
               .when(action == "complete", F.when(F.col("current") == "STARTED", "applied").otherwise("noop"))
               .when(action == "compensate",
                     F.when(F.col("current").isin("COMPLETED", "FAILED"), "refused").otherwise("applied"))
               .when(action == "fail", F.lit("applied")).otherwise(F.lit("unknown_action")))
    result = (F.when(outcome != "applied", F.col("current"))
              .when(action == "complete", "COMPLETED").when(action == "compensate", "COMPENSATING")
              .otherwise("FAILED"))
    return r.select("request_seq", "saga_id", "action", F.col("current").alias("current_status"),
                    outcome.alias("outcome"), result.alias("resulting_status"))


def timeline(df: DataFrame, key: str, ts_col: str, tie: str) -> DataFrame:
    """Newest-first position of each row within its key."""
    return newest_first(df, key, ts_col, tie, "recency")


def current_from_history(history: DataFrame, key: str, ts_col: str = "changed_at", seq_col: str = "change_seq") -> DataFrame:
    """Current status = new_status of the latest history row per key."""
    return (history.groupBy(key)
            .agg(F.max_by("new_status", F.struct(F.col(ts_col), F.col(seq_col))).alias("status")))
