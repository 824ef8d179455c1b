"""Domain events: typing, routing, change-feed mapping, dedup (T1-T3,
T11-T13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake.functions.common import first_per_key, ts_lit
from cargolake.sources.envelopes import ISO_FORMAT, uuid_of

# fixed values: event registry (event type, aggregate type, id field)
EVENT_REGISTRY = [
    ("shipment.created", "shipment", "shipment_id"),
    ("shipment.updated", "shipment", "shipment_id"),
    ("shipment.cancelled", "shipment", "shipment_id"),
    ("shipment.dispatched", "shipment", "shipment_id"),
    ("inventory.reserved", "warehouse", "warehouse_id"),
    ("inventory.released", "warehouse", "warehouse_id"),
    ("inventory.insufficient", "warehouse", "warehouse_id"),
    ("inventory.updated", "warehouse", "warehouse_id"),
    ("courier.assigned", "delivery", "delivery_id"),
    ("courier.unassigned", "delivery", "delivery_id"),
    ("delivery.started", "delivery", "delivery_id"),
    ("delivery.in_transit", "delivery", "delivery_id"),
    ("delivery.completed", "delivery", "delivery_id"),
    ("delivery.failed", "delivery", "delivery_id"),
    ("blockchain.recorded", "blockchain_record", "record_id"),
    ("blockchain.verified", "blockchain_record", "record_id"),
    ("saga.started", "saga", "saga_id"),
    ("saga.completed", "saga", "saga_id"),
    ("saga.failed", "saga", "saga_id"),
    ("saga.compensating", "saga", "saga_id"),
]

# fixed values: typed payload schemas of the event catalogue
PAYLOAD_SCHEMAS = {
    "shipment.created": "shipment_id STRING, origin STRING, destination STRING, items ARRAY<MAP<STRING,STRING>>",
    "shipment.updated": "shipment_id STRING, status STRING, updated_at STRING",
    "shipment.cancelled": "shipment_id STRING, reason STRING, cancelled_at STRING",
    "shipment.dispatched": "shipment_id STRING, warehouse_id STRING, dispatched_at STRING",
    "inventory.reserved": "warehouse_id STRING, shipment_id STRING, items ARRAY<MAP<STRING,STRING>>, reserved_at STRING",
    "inventory.released": "warehouse_id STRING, shipment_id STRING, items ARRAY<MAP<STRING,STRING>>, released_at STRING, reason STRING",
    "inventory.insufficient": "warehouse_id STRING, shipment_id STRING, missing_items ARRAY<MAP<STRING,STRING>>",
    "inventory.updated": "warehouse_id STRING, item_id STRING, new_quantity INT, updated_at STRING",
    "courier.assigned": "delivery_id STRING, courier_id STRING, shipment_id STRING, estimated_delivery STRING, assigned_at STRING",
    "courier.unassigned": "delivery_id STRING, courier_id STRING, reason STRING, unassigned_at STRING",
    "delivery.started": "delivery_id STRING, courier_id STRING, pickup_location STRING, started_at STRING",
    "delivery.in_transit": "delivery_id STRING, current_location STRING, latitude DOUBLE, longitude DOUBLE, updated_at STRING",
    "delivery.completed": "delivery_id STRING, delivered_at STRING, recipient_name STRING, recipient_signature STRING",
    "delivery.failed": "delivery_id STRING, reason STRING, failed_at STRING, retry_scheduled STRING",
    "blockchain.recorded": "record_id STRING, shipment_id STRING, transaction_hash STRING, block_number BIGINT, recorded_at STRING",
    "blockchain.verified": "record_id STRING, shipment_id STRING, transaction_hash STRING, verified_at STRING, confirmations INT",
    "saga.started": "saga_id STRING, saga_type STRING, initiated_by STRING, started_at STRING",
    "saga.completed": "saga_id STRING, saga_type STRING, completed_at STRING",
    "saga.failed": "saga_id STRING, saga_type STRING, error_message STRING, failed_at STRING",
    "saga.compensating": "saga_id STRING, saga_type STRING, failed_step STRING, compensating_at STRING",
}


def to_envelopes(rows: DataFrame, id_col: str = "event_id", type_col: str = "event_type",
                 aggregate_col: str = "aggregate_id", ts_col: str = "ts", payload_col: str = "payload",
                 correlation_col: str = "correlation_id") -> tuple[DataFrame, DataFrame]:
    """Domain rows -> typed envelopes by the registry, a constant of twenty
    entries looked up as a map: no join.  Unknown types are returned apart.
    Ids become deterministic UUID text (T2 normalisation)."""
    entries = [x for name, aggregate, id_field in EVENT_REGISTRY
               for x in (F.lit(name), F.struct(F.lit(aggregate).alias("aggregate_type"), F.lit(id_field).alias("id_field")))]
    found = F.create_map(*entries)[F.col(type_col)]
    known = rows.where(found.isNotNull()).select(
        uuid_of(id_col).alias("event_id"), F.col(type_col).alias("event_type"),
        uuid_of(aggregate_col).alias("aggregate_id"), found.getField("aggregate_type").alias("aggregate_type"),
        found.getField("id_field").alias("id_field"), F.col(payload_col).alias("payload"), F.col(ts_col).alias("timestamp"),
        F.when(F.col(correlation_col).isNotNull(), uuid_of(correlation_col)).alias("correlation_id"))
    unknown = rows.where(found.isNull()).select(F.col(id_col).alias("source_id"), F.col(type_col).alias("event_type"),
                                                F.lit("unknown_event_type").alias("reason"))
    return known, unknown


def normalised_payload(struct_col) -> F.Column:
    """Payload struct -> JSON text with ISO timestamps (nulls kept)."""
    return F.to_json(struct_col, {"timestampFormat": ISO_FORMAT, "timestampNTZFormat": ISO_FORMAT,
                                  "ignoreNullFields": "false"})


def typed_payloads(envelopes: DataFrame, event_type: str) -> DataFrame:
    """One typed view per event type: filter + from_json(schema)."""
    schema = PAYLOAD_SCHEMAS[event_type]
    p = F.from_json(F.col("payload"), schema)
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    return (envelopes.where(F.col("event_type") == event_type)
            .select("event_id", "aggregate_id", "timestamp", "correlation_id", *[p[f].alias(f) for f in fields]))


def dedup_events(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """T12 (batch): at-least-once input -> one row per event id.  In a
    stream use ``dropDuplicatesWithinWatermark`` (see streaming module)."""
    order = [c for c in ("ts", "timestamp", "payload") if c in events.columns] or events.columns
    return first_per_key(events, [id_col], order)


def correlation_check(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with a correlation id, per-type count of skipped ones)."""
    has = F.col("correlation_id").isNotNull()
    skipped = events.where(~has).groupBy("event_type").agg(F.count(F.lit(1)).alias("skipped"))
    return events.where(has), skipped


def shipment_change_events(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Shipment mutations -> events.  insert -> shipment.created (cities
    only, empty items); update -> shipment.updated(status, updated_at);
    delete -> shipment.cancelled("User requested deletion")."""
    from cargolake.operators.history import snapshot_diff
    d = snapshot_diff(old.select("shipment_id", "status", "origin", "destination"),
                      new.select("shipment_id", "status", "origin", "destination"),
                      "shipment_id", ["status", "origin", "destination"])
    now = ts_lit(as_of)
    iso_now = F.date_format(now, ISO_FORMAT)
    city = lambda c: F.get_json_object(F.col(c), "$.city")
    payload = (F.when(F.col("op") == "insert", F.to_json(F.struct(
        F.col("shipment_id").cast("string").alias("shipment_id"), city("new_origin").alias("origin"),
        city("new_destination").alias("destination"), F.array().cast("array<string>").alias("items"))))
        .when(F.col("op") == "update", F.to_json(F.struct(
            F.col("shipment_id").cast("string").alias("shipment_id"), F.col("new_status").alias("status"),
            iso_now.alias("updated_at"))))
        .otherwise(F.to_json(F.struct(F.col("shipment_id").cast("string").alias("shipment_id"),
                                      F.lit("User requested deletion").alias("reason"),
                                      iso_now.alias("cancelled_at")))))
    etype = (F.when(F.col("op") == "insert", "shipment.created").when(F.col("op") == "update", "shipment.updated")
             .otherwise("shipment.cancelled"))
    return (d.where(F.col("op") != "same")
            .select("shipment_id", etype.alias("event_type"), payload.alias("payload"), now.alias("ts")))


_NULLS = {"ignoreNullFields": "false"}


def _mutations(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """J9 change feed of the rows that changed, with the surviving value of each column."""
    from cargolake.operators.history import snapshot_diff
    d = snapshot_diff(old.select(key, *cols), new.select(key, *cols), key, cols).where("op <> 'same'")
    return d.select("*", *[F.when(F.col("op") == "delete", F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in cols])


def _text(name: str):
    return F.col(name).cast("string").alias(name)


def item_change_events(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Any change of an item -> shipment.updated("items_updated") of its shipment."""
    now = ts_lit(as_of)
    d = _mutations(old, new, "item_id", ["shipment_id", "name", "quantity", "weight"])
    payload = F.to_json(F.struct(_text("shipment_id"), F.lit("items_updated").alias("status"),
                                 F.date_format(now, ISO_FORMAT).alias("updated_at")))
    return d.select("item_id", F.col("shipment_id").alias("aggregate_id"), F.lit("shipment.updated").alias("event_type"),
                    payload.alias("payload"), now.alias("ts"))


def delivery_change_events(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Insert or another courier -> courier.assigned; status to IN_TRANSIT ->
    delivery.in_transit("Warehouse"); to DELIVERED -> delivery.completed
    ("Unknown"); a delete emits nothing.  A row may emit several."""
    now = ts_lit(as_of)
    iso = F.date_format(now, ISO_FORMAT)
    d = _mutations(old, new, "delivery_id", ["shipment_id", "courier_id", "status", "estimated_arrival"])
    inserted, updated = F.col("op") == "insert", F.col("op") == "update"
    due = F.coalesce(F.date_format(F.date_trunc("day", "estimated_arrival"), ISO_FORMAT), iso)
    assigned = F.to_json(F.struct(_text("delivery_id"), _text("courier_id"), _text("shipment_id"),
                                  due.alias("estimated_delivery"), iso.alias("assigned_at")), _NULLS)
    moving = F.to_json(F.struct(_text("delivery_id"), F.lit("Warehouse").alias("current_location"),
                                F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
                                iso.alias("updated_at")), _NULLS)
    done = F.to_json(F.struct(_text("delivery_id"), iso.alias("delivered_at"), F.lit("Unknown").alias("recipient_name"),
                              F.lit(None).cast("string").alias("recipient_signature")), _NULLS)

    def event(condition, name, payload):
        return F.when(condition, F.struct(F.lit(name).alias("event_type"), payload.alias("payload")))

    def entered(status):
        return updated & (F.upper(F.trim("new_status")) == status) & ~F.upper(F.trim("old_status")).eqNullSafe(F.lit(status))

    emitted = F.array_compact(F.array(
        event(inserted | (updated & ~F.col("old_courier_id").eqNullSafe(F.col("new_courier_id"))), "courier.assigned", assigned),
        event(entered("IN_TRANSIT"), "delivery.in_transit", moving), event(entered("DELIVERED"), "delivery.completed", done)))
    return (d.select("delivery_id", F.explode(emitted).alias("e"))
            .select("delivery_id", F.col("delivery_id").alias("aggregate_id"), "e.event_type", "e.payload", now.alias("ts")))


def inventory_change_events(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Record insert -> inventory.reserved; another status -> inventory.updated
    (item_id = record id, quantity 0); delete -> inventory.released("record_deleted")."""
    now = ts_lit(as_of)
    iso = F.date_format(now, ISO_FORMAT)
    none = F.array().cast("array<string>").alias("items")
    d = _mutations(old, new, "record_id", ["shipment_id", "warehouse_id", "status"])
    d = d.where((F.col("op") != "update") | ~F.col("old_status").eqNullSafe(F.col("new_status")))
    payload = (F.when(F.col("op") == "insert", F.to_json(F.struct(_text("warehouse_id"), _text("shipment_id"), none, iso.alias("reserved_at")), _NULLS))
               .when(F.col("op") == "update", F.to_json(F.struct(_text("warehouse_id"), _text("record_id").alias("item_id"),
                                                                 F.lit(0).alias("new_quantity"), iso.alias("updated_at")), _NULLS))
               .otherwise(F.to_json(F.struct(_text("warehouse_id"), _text("shipment_id"), none, iso.alias("released_at"),
                                             F.lit("record_deleted").alias("reason")), _NULLS)))
    name = (F.when(F.col("op") == "insert", "inventory.reserved").when(F.col("op") == "update", "inventory.updated")
            .otherwise("inventory.released"))
    return d.select("record_id", F.col("warehouse_id").alias("aggregate_id"), name.alias("event_type"), payload.alias("payload"), now.alias("ts"))
