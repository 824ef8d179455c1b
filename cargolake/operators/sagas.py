"""Compensation planning and command application (T4, T6a-T6d, A12).

The planner is a set-based rewrite of the per-event worker: guards become
columns, "only the first failure per saga fires" becomes a ``min_by`` per
saga (partial aggregation, skew-safe), and the command fan-out is an
``explode`` of an ordered array of command structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake import schemas


def plan_compensation(events: DataFrame, sagas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T4: failure events + saga snapshot -> (outcomes, commands, saga updates).

    outcome per event: no_correlation / saga_not_found / already_final /
    fired / no_strategy.  Saga updates carry both transitions in order
    (COMPENSATING then FAILED, C12)."""
    failures = events.where(F.col("event_type").isin(*schemas.COMPENSATION_TRIGGER_EVENTS))
    s = sagas.select(F.col("saga_id").alias("_sid"), F.upper(F.trim("status")).alias("saga_status"),
                     "shipment_id", "warehouse_id", "delivery_id", "saga_type")
    # events without a correlation id stay out of the joins: a null is one hot key
    named = failures.where(F.col("correlation_id").isNotNull())
    j = named.join(s, named["correlation_id"] == s["_sid"], "left")
    final_or_comp = F.col("saga_status").isin("COMPLETED", "COMPENSATING", "FAILED", "CANCELLED")
    pre = F.when(F.col("_sid").isNull(), "saga_not_found").when(final_or_comp, "already_final")
    j = j.withColumn("_pre", pre)
    # no worker consumes a failed verification: it is reported, and neither starts nor ends a compensation
    unhandled = F.col("event_type") == "blockchain.verification_failed"
    eligible = j.where(F.col("_pre").isNull() & ~unhandled)
    first = (eligible.groupBy("correlation_id")
             .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("_first_event")))
    j = j.join(first, "correlation_id", "left")
    outcome = (F.when(F.col("_pre").isNotNull(), F.col("_pre"))
               .when(unhandled, "no_strategy")
               .when(F.col("event_id") != F.col("_first_event"), "already_final")
               .otherwise("fired"))
    j = j.withColumn("outcome", outcome)
    report = ("event_id", "event_type", F.col("correlation_id").alias("saga_id"))
    unnamed = failures.where(F.col("correlation_id").isNull())
    outcomes = j.select(*report, "outcome").unionByName(unnamed.select(*report, F.lit("no_correlation").alias("outcome")))

    fired = j.where(F.col("outcome") == "fired")
    etype = F.col("event_type")
    reason = F.coalesce(F.get_json_object(F.col("payload"), "$.reason"), F.concat(F.lit("Triggered by "), etype))

    def command(kind: str, why: str | None):
        topic, target, needs_target = schemas.COMMAND_TARGETS[kind]
        made = F.struct(F.lit(kind).alias("command_type"), F.lit(topic).alias("topic"), F.col(target).cast("string").alias("aggregate_id"),
                        (reason if why is None else F.lit(why)).alias("reason"))
        return F.when(F.col(target).isNotNull(), made) if needs_target else made

    plan = F.lit(None)
    for trigger, steps in schemas.COMPENSATION.items():
        plan = F.when(etype == trigger, F.array(*[command(*step) for step in steps])).otherwise(plan)
    commands = (fired.select("event_id", F.col("correlation_id").alias("saga_id"), "shipment_id", "warehouse_id",
                             "delivery_id", F.posexplode(F.array_compact(plan)).alias("step", "c"))
                .select("saga_id", "event_id", F.col("step").cast("int").alias("step"),
                        F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.col("step").cast("string"))).alias("command_id"),
                        "c.command_type", "c.topic", "c.aggregate_id", "c.reason"))
    trig = j.where(F.col("outcome") == "fired")
    updates = (trig.select(F.col("correlation_id").alias("saga_id"), "event_id", etype.alias("failed_step"),
                           F.explode(F.array(
                               F.struct(F.lit(1).alias("seq"), F.lit("COMPENSATING").alias("status"),
                                        F.lit(None).cast("string").alias("error_message")),
                               F.struct(F.lit(2).alias("seq"), F.lit("FAILED").alias("status"),
                                        F.concat(F.lit("Compensation triggered by "), etype).alias("error_message")))).alias("u"))
               .select("saga_id", "event_id", F.col("u.seq").alias("seq"), F.col("u.status").alias("status"),
                       "failed_step", F.col("u.error_message").alias("error_message")))
    return outcomes, commands, updates


def _payload_or_aggregate(field: str):
    v = F.get_json_object(F.col("payload"), f"$.{field}")
    return F.when((v.isNotNull()) & (v != ""), v)


def apply_release(commands: DataFrame, inventory: DataFrame):
    """T6a + A12: inventory.release -> every record of the shipment becomes
    RECEIVED, SHIPPED records are refused (H7).  Returns (one update per
    record, per-command report: released count or the reason it did nothing).
    Records are counted per shipment before commands join, so repeated commands
    of a shipment never multiply its records."""
    rel = commands.where(F.col("command_type") == "inventory.release").select(
        "command_id", _payload_or_aggregate("shipment_id").alias("shipment_ref"))
    sid = F.col("shipment_ref").try_cast("bigint") if dict(inventory.dtypes)["shipment_id"] != "string" else F.col("shipment_ref")
    rel = rel.withColumn("_sid", sid)
    refused = F.upper(F.trim("status")) == "SHIPPED"
    named = rel.where(F.col("_sid").isNotNull())
    held = inventory.select("record_id", F.col("shipment_id").alias("_sid"), refused.alias("_refused"))
    updates = (held.where(~F.col("_refused")).join(named.select("_sid"), "_sid", "left_semi")
               .select("record_id", F.lit("received").alias("new_status")))
    counts = held.groupBy("_sid").agg(F.count_if(~F.col("_refused")).cast("bigint").alias("released_count"),
                                      F.count_if(F.col("_refused")).cast("bigint").alias("refused_count"))
    unnamed = rel.where(F.col("_sid").isNull())
    counted = named.join(counts, "_sid", "left").unionByName(unnamed, allowMissingColumns=True)
    report = (counted
              .select("command_id", F.col("_sid").alias("shipment_id"),
                      F.coalesce("released_count", F.lit(0).cast("bigint")).alias("released_count"),
                      F.coalesce("refused_count", F.lit(0).cast("bigint")).alias("refused_count"),
                      F.when(F.col("shipment_ref").isNull(), "missing_shipment_id")
                      .when(F.col("_sid").isNull(), "invalid_shipment_id")
                      .when(F.col("released_count").isNull(), "no_records").alias("warning")))
    return updates, report


def apply_unassign(commands: DataFrame, deliveries: DataFrame):
    """Courier.unassign deletes the delivery (id from payload, else the
    aggregate id).  Returns (remaining deliveries, warnings for absent ids)."""
    u = commands.where(F.col("command_type") == "courier.unassign").select(
        "command_id", F.coalesce(_payload_or_aggregate("delivery_id"), F.col("aggregate_id").cast("string")).alias("_ref"))
    u = u.withColumn("delivery_id", F.col("_ref").try_cast(dict(deliveries.dtypes)["delivery_id"]))
    keys = u.select("delivery_id").where(F.col("delivery_id").isNotNull()).distinct()
    remaining = deliveries.join(keys, "delivery_id", "left_anti")
    absent = u.join(deliveries.select("delivery_id"), "delivery_id", "left_anti").select(
        "command_id", "delivery_id", F.lit("delivery_not_found").alias("warning"))
    return remaining, absent


def apply_cancel(commands: DataFrame, shipments: DataFrame, items: DataFrame):
    """Shipment.cancel deletes the shipment and cascades to its items.
    Returns (remaining shipments, remaining items, audit rows)."""
    c = commands.where(F.col("command_type") == "shipment.cancel").select(
        "command_id", F.coalesce(_payload_or_aggregate("shipment_id"), F.col("aggregate_id").cast("string")).alias("_ref"))
    c = c.withColumn("shipment_id", F.col("_ref").try_cast(dict(shipments.dtypes)["shipment_id"]))
    keys = c.select("shipment_id").where(F.col("shipment_id").isNotNull()).distinct()
    audit = c.join(shipments.select("shipment_id", F.lit(True).alias("_found")), "shipment_id", "left").select(
        "command_id", "shipment_id", F.when(F.col("_found"), "deleted").otherwise("shipment_not_found").alias("result"))
    return (shipments.join(keys, "shipment_id", "left_anti"), items.join(keys, "shipment_id", "left_anti"), audit)


HANDLED_COMMANDS = ("inventory.release", "courier.unassign", "shipment.cancel")


def unknown_commands(commands: DataFrame) -> DataFrame:
    """T6d: commands no worker handles, kept for audit instead of dropped."""
    return (commands.where(~F.col("command_type").isin(*HANDLED_COMMANDS))
            .select("command_id", "command_type", "aggregate_id", F.lit("unknown_command_type").alias("reason")))
