"""On-chain record tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.functions.common import first_per_key, status_of, ts_lit
from cargolake.functions.sequences import hour_chunk, keyed_position
from cargolake.operators.events import normalised_payload, to_envelopes
from cargolake.sources.envelopes import fingerprint, uuid_of

REVERTED = "Transaction reverted on chain"


def register_pending(events: DataFrame, network: str = "ethereum") -> DataFrame:
    """Target events -> one pending record per event id (dedup, T12).
    Ids and the transaction hash are content-derived (S15) so a replayed
    event maps to the same record."""
    t = events.where(F.col("event_type").isin(*schemas.RECORDER_TARGET_EVENTS))
    t = first_per_key(t, ["event_id"], ["ts", "payload"])
    return t.select(F.md5(F.concat(F.lit("rec:"), F.col("event_id").cast("string"))).alias("record_id"),
                    F.col("aggregate_id").alias("shipment_id"),
                    F.concat(F.lit("0x"), fingerprint(F.concat_ws("|", F.col("event_id").cast("string"),
                                                                  F.col("payload")))).alias("tx_hash"),
                    F.lit("PENDING").alias("status"), "payload", F.col("ts").alias("created_at"),
                    F.lit(network).alias("network"))


def track_confirmations(records: DataFrame, receipts: DataFrame,
                        required: int = schemas.CONFIRMATIONS_REQUIRED) -> DataFrame:
    """Pending records against chain receipts (J8, left join).
    no receipt -> unchanged; failed -> FAILED with the revert message;
    success with >= ``required`` confirmations -> CONFIRMED (block, gas,
    block time); otherwise unchanged.  Non-pending rows pass through."""
    kept = F.col("error_message") if "error_message" in records.columns else F.lit(None).cast("string")
    r = receipts.select("tx_hash", F.col("block_number").alias("r_block"), F.col("confirmations").alias("r_conf"),
                        F.lower(F.col("status")).alias("r_status"), F.col("gas_used").alias("r_gas"),
                        F.col("block_time").alias("r_time"))
    # settled records meet no receipt, so they stay out of the join's shuffle
    pending = F.coalesce(status_of(records) == "PENDING", F.lit(False))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in r.schema.fields if f.name != "tx_hash"]
    settled = records.where(~pending).select("*", *none, F.lit(False).alias("_pending"))
    waiting = records.where(pending).join(r, "tx_hash", "left").withColumn("_pending", F.lit(True))
    j = waiting.unionByName(settled)
    pending = F.col("_pending")
    failed = pending & (F.col("r_status") == "failed")
    confirmed = pending & (F.col("r_status") == "success") & (F.col("r_conf") >= required)
    out = j.select(
        "record_id", "shipment_id", "tx_hash",
        F.when(failed, "FAILED").when(confirmed, "CONFIRMED").otherwise(F.col("status")).alias("status"),
        "created_at",
        F.when(confirmed, F.col("r_time")).otherwise(F.col("confirmed_at")).alias("confirmed_at"),
        F.when(confirmed, F.col("r_block")).otherwise(F.col("block_number")).alias("block_number"),
        F.when(failed, F.lit(REVERTED)).otherwise(kept).alias("error_message"),
        F.when(confirmed, F.col("r_gas")).otherwise(F.col("gas_used")).alias("gas_used"),
        "network",
        F.when(confirmed, "confirmed").when(failed, "failed").when(pending & F.col("r_status").isNull(), "no_receipt")
        .when(pending, "waiting").otherwise("not_pending").alias("transition"))
    return out


def verified_events(tracked: DataFrame, required: int = schemas.CONFIRMATIONS_REQUIRED) -> DataFrame:
    """One blockchain.verified payload per record confirmed in this pass."""
    return (tracked.where(F.col("transition") == "confirmed")
            .select("record_id", "shipment_id", F.col("tx_hash").alias("transaction_hash"),
                    F.col("confirmed_at").alias("verified_at"), F.lit(required).alias("confirmations")))


def verified_envelopes(tracked: DataFrame, required: int = schemas.CONFIRMATIONS_REQUIRED) -> DataFrame:
    """The typed envelope of each blockchain.verified event."""
    v = verified_events(tracked, required)
    payload = normalised_payload(F.struct(
        uuid_of("record_id").alias("record_id"), uuid_of("shipment_id").alias("shipment_id"), F.col("transaction_hash"),
        F.col("verified_at"), F.col("confirmations")))
    rows = v.select(F.concat(F.lit("verified:"), F.col("record_id").cast("string")).alias("event_id"),
                    F.lit("blockchain.verified").alias("event_type"), F.col("record_id").alias("aggregate_id"),
                    F.col("verified_at").alias("ts"), payload.alias("payload"), F.lit(None).cast("string").alias("correlation_id"))
    return to_envelopes(rows)[0]


def assign_nonces(records: DataFrame, address_col: str, order: list[str], start: int = 0,
                  stored: DataFrame | None = None) -> DataFrame:
    """Gap-free nonce per (address, network) continuing from the stored
    value (or ``start``).  One wallet may own every row, so numbering is
    chunked by hour and stitched with prefix sums - never one window."""
    key = [address_col, "network"]
    pos = keyed_position(records, key, order, hour_chunk(order[0]), name="_pos", start=0)
    base = F.lit(start).cast("bigint")
    if stored is not None:
        pos = pos.join(stored.select(*key, F.col("current_nonce").alias("_stored")), key, "left")
        base = F.coalesce(F.col("_stored"), base)
    return pos.withColumn("nonce", (base + F.col("_pos")).cast("bigint")).drop("_pos", "_stored")
