"""Monitoring views V1-V5.  ``as_of`` replaces NOW() so results are
reproducible; every view is a pushed-down filter plus a projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.functions.common import seconds_between, status_of, ts_lit
from cargolake.operators.stats import max_confirmations


def _col_or_null(df: DataFrame, name: str, dtype: str):
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


def stuck_sagas(sagas: DataFrame, as_of: str, threshold_s: int = schemas.STUCK_SAGA_SECONDS) -> DataFrame:
    """V1: active sagas not updated for ``threshold_s``; oldest first."""
    now = ts_lit(as_of)
    return (sagas
            .where(status_of(sagas).isin(*schemas.SAGA_ACTIVE)
                   & (F.col("updated_at") < now - F.expr(f"interval {threshold_s} seconds")))
            .select("saga_id", "saga_type", "shipment_id", "status", "started_at", "updated_at",
                    seconds_between(now, "updated_at").alias("stuck_duration_seconds"),
                    "retry_count", "failed_step", _col_or_null(sagas, "error_message", "string"))
            .orderBy("updated_at", "saga_id"))


def stuck_transactions(records: DataFrame, as_of: str, threshold_s: int = schemas.STUCK_TX_SECONDS) -> DataFrame:
    """V2: pending chain records older than ``threshold_s``; oldest first."""
    now = ts_lit(as_of)
    return (records
            .where((status_of(records) == "PENDING")
                   & (F.col("created_at") < now - F.expr(f"interval {threshold_s} seconds")))
            .select("record_id", "shipment_id", "tx_hash", "status", "created_at",
                    seconds_between(now, "created_at").alias("pending_duration_seconds"),
                    _col_or_null(records, "gas_price", "bigint"), "network",
                    _col_or_null(records, "error_message", "string"))
            .orderBy("created_at", "record_id"))


def confirmed_transactions_summary(records: DataFrame, confirmations: DataFrame) -> DataFrame:
    """V3: confirmed records with time-to-confirm and the highest confirmation
    count (J3: correlated scalar subquery = pre-aggregate + left join)."""
    confirmed = records.where(status_of(records) == "CONFIRMED")
    return (confirmed.join(max_confirmations(confirmations), "record_id", "left")
            .select("record_id", "shipment_id", "tx_hash", "block_number", "confirmed_at", "gas_used",
                    _col_or_null(records, "gas_price", "bigint"), "network",
                    seconds_between("confirmed_at", "created_at").alias("confirmation_time_seconds"),
                    "max_confirmations")
            .orderBy(F.col("confirmed_at").desc(), "record_id"))


def timed_out_steps(steps: DataFrame, as_of: str, timeout_s: int = schemas.STEP_TIMEOUT_SECONDS) -> DataFrame:
    """V4: running steps started more than ``timeout_s`` before as_of."""
    now = ts_lit(as_of)
    return (steps
            .where((status_of(steps) == "RUNNING")
                   & (F.col("started_at") < now - F.expr(f"interval {timeout_s} seconds")))
            .select("saga_id", "step_name", "step_order", "status", "started_at",
                    seconds_between(now, "started_at").alias("running_seconds")))


def unfinished_steps(steps: DataFrame) -> DataFrame:
    """V5: unfinished steps of each saga with their position in step order
    (window partitioned by saga_id - never a single-partition window)."""
    w = Window.partitionBy("saga_id").orderBy("step_order", "step_name", "started_at", "status")
    return (steps.where(status_of(steps).isin(*schemas.STEP_UNFINISHED))
            .select("saga_id", "step_name", "step_order", "status", "started_at",
                    F.row_number().over(w).alias("position")))
