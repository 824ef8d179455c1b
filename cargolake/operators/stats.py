"""Statistics (materialised-view) operators A1-A14.

Pattern used throughout: aggregate the big child table on the join key
first (partial + final HashAggregate, so each map task ships one row per key
instead of every item), then join to the parent.  The aggregate output is
already hash-partitioned on the key, so only the parent side shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake.functions.common import seconds_between


def item_totals(items: DataFrame) -> DataFrame:
    """Per shipment: item count, Σ quantity, Σ weight (no zeros for missing)."""
    return (items.groupBy("shipment_id")
            .agg(F.count("item_id").alias("total_items"),
                 F.sum("quantity").cast("bigint").alias("total_quantity"),
                 F.sum("weight").cast("decimal(20,2)").alias("total_weight")))


def shipment_statistics(shipments: DataFrame, items: DataFrame) -> DataFrame:
    """A1: one row per shipment, zeros for shipments without items."""
    totals = item_totals(items)
    return (shipments.select("shipment_id", "status", "origin", "destination", "created_at", "updated_at")
            .join(totals, "shipment_id", "left")
            .select("shipment_id", "status", "origin", "destination",
                    F.coalesce("total_items", F.lit(0).cast("bigint")).alias("total_items"),
                    F.coalesce("total_quantity", F.lit(0).cast("bigint")).alias("total_quantity"),
                    F.coalesce("total_weight", F.lit(0).cast("decimal(20,2)")).alias("total_weight"),
                    "created_at", "updated_at"))


def _count_if(cond):
    return F.count_if(cond).cast("bigint")


def _avg_seconds(later: str, earlier: str, when=None):
    secs = seconds_between(later, earlier)
    cond = F.col(later).isNotNull() if when is None else when
    return F.round(F.avg(F.when(cond, secs)), 6)


def saga_statistics(sagas: DataFrame) -> DataFrame:
    """A2: per saga_type counts by outcome, mean duration of finished sagas,
    max / mean retry count.  One pass: conditional aggregates only."""
    st = F.upper(F.trim("status"))
    return (sagas.groupBy("saga_type")
            .agg(F.count(F.lit(1)).alias("total_sagas"),
                 _count_if(st == "COMPLETED").alias("completed"),
                 _count_if(st == "FAILED").alias("failed"),
                 _count_if(st == "CANCELLED").alias("cancelled"),
                 _count_if(st.isin("STARTED", "COMPENSATING")).alias("in_progress"),
                 _avg_seconds("completed_at", "started_at").alias("avg_duration_seconds"),
                 F.max("retry_count").alias("max_retry_count"),
                 F.round(F.avg("retry_count"), 6).alias("avg_retry_count")))


def daily_saga_statistics(sagas: DataFrame) -> DataFrame:
    """A3: per (start date, saga_type); date desc, type asc."""
    st = F.upper(F.trim("status"))
    return (sagas.groupBy(F.to_date("started_at").alias("saga_date"), "saga_type")
            .agg(F.count(F.lit(1)).alias("total_sagas"),
                 _count_if(st == "COMPLETED").alias("completed"),
                 _count_if(st == "FAILED").alias("failed"),
                 _avg_seconds("completed_at", "started_at").alias("avg_duration_seconds"))
            .orderBy(F.col("saga_date").desc(), F.col("saga_type").asc()))


def blockchain_statistics(records: DataFrame) -> DataFrame:
    """A4: per network counts by status, confirm time, gas, first/last."""
    st = F.upper(F.trim("status"))
    return (records.groupBy("network")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 _count_if(st == "CONFIRMED").alias("confirmed"),
                 _count_if(st == "PENDING").alias("pending"),
                 _count_if(st == "FAILED").alias("failed"),
                 _count_if(st == "DROPPED").alias("dropped"),
                 _avg_seconds("confirmed_at", "created_at").alias("avg_confirmation_time_seconds"),
                 F.sum("gas_used").cast("bigint").alias("total_gas_used"),
                 F.round(F.avg("gas_used"), 6).alias("avg_gas_used"),
                 F.min("created_at").alias("first_transaction_at"),
                 F.max("created_at").alias("last_transaction_at")))


def daily_blockchain_statistics(records: DataFrame) -> DataFrame:
    """A5: per (creation date, network); date desc, network asc."""
    st = F.upper(F.trim("status"))
    return (records.groupBy(F.to_date("created_at").alias("transaction_date"), "network")
            .agg(F.count(F.lit(1)).alias("total_transactions"),
                 _count_if(st == "CONFIRMED").alias("confirmed"),
                 _count_if(st == "FAILED").alias("failed"),
                 F.sum("gas_used").cast("bigint").alias("total_gas_used"),
                 _avg_seconds("confirmed_at", "created_at").alias("avg_confirmation_time_seconds"))
            .orderBy(F.col("transaction_date").desc(), F.col("network").asc()))


def shipment_total_weight(shipments: DataFrame, items: DataFrame) -> DataFrame:
    """Σ weight × quantity per shipment in kg (0 when it has no items)."""
    per = (items.groupBy("shipment_id")
           .agg(F.sum(F.col("weight") * F.col("quantity")).cast("decimal(20,2)").alias("total_weight")))
    return (shipments.select("shipment_id").join(per, "shipment_id", "left")
            .select("shipment_id",
                    F.coalesce("total_weight", F.lit(0).cast("decimal(20,2)")).alias("total_weight"),
                    F.lit("kg").alias("unit")))


def shipment_item_count(shipments: DataFrame, items: DataFrame) -> DataFrame:
    """Number of items per shipment (0 when none)."""
    per = items.groupBy("shipment_id").agg(F.count(F.lit(1)).alias("items_count"))
    return (shipments.select("shipment_id").join(per, "shipment_id", "left")
            .select("shipment_id", F.coalesce("items_count", F.lit(0).cast("bigint")).alias("items_count")))


def max_confirmations(confirmations: DataFrame) -> DataFrame:
    """Highest confirmation count seen per chain record."""
    return confirmations.groupBy("record_id").agg(F.max("confirmation_count").alias("max_confirmations"))
