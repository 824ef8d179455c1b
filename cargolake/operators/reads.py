"""Projections, filters, lookups, ordering and paging.

Lookups by a key set are semi-joins.  The key side is never broadcast
blindly: AQE turns the join into a broadcast at runtime when the measured
key set is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and keeps
the shuffled join otherwise.  Per-key ordering uses windows partitioned by
the key, never a global single-partition window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.functions.sequences import newest_first
from cargolake.functions.common import status_of, ts_lit


def lookup_by_keys(table: DataFrame, keys: DataFrame, key: str, keys_col: str | None = None) -> DataFrame:
    """Rows of ``table`` whose ``key`` is in ``keys`` (duplicates in the
    key set do not duplicate rows)."""
    k = keys.select(F.col(keys_col or key).alias(key))
    return table.join(k, key, "left_semi")


def by_status(df: DataFrame, status: str, order_by=("created_at",)) -> DataFrame:
    """Rows in one status (case-insensitive), ordered."""
    return df.where(status_of(df) == status.upper()).orderBy(*order_by)


def status_counts(df: DataFrame) -> DataFrame:
    """One pass over the table for every status list size."""
    return df.groupBy(status_of(df).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def in_statuses(df: DataFrame, statuses, negate: bool = False) -> DataFrame:
    """Status-set predicate; an IN filter of the scan where the snapshot was
    written with normalised statuses."""
    cond = status_of(df).isin(*[s.upper() for s in statuses])
    return df.where(~cond if negate else cond)


def active_sagas(sagas: DataFrame) -> DataFrame:
    """Started or compensating sagas, least recently updated first."""
    return in_statuses(sagas, schemas.SAGA_ACTIVE).orderBy("updated_at", "saga_id")


def ranked_children(df: DataFrame, fk: str, order: list[Column], rank_name: str = "position") -> DataFrame:
    """P5: children of each parent in the parent's order (a window per key, for
    children bounded by their parent: a courier's deliveries take ``newest_first``)."""
    return df.withColumn(rank_name, F.row_number().over(Window.partitionBy(fk).orderBy(*order)))


def page(df: DataFrame, order: list[Column], limit: int = schemas.PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """ORDER BY ... LIMIT ... OFFSET (TakeOrderedAndProject with offset).
    ``order`` must end in the primary key so pages are stable.  A limit outside
    1 to the largest page, or a negative offset, is refused, never clamped."""
    if not 1 <= int(limit) <= schemas.PAGE_MAX:
        raise ValueError(f"limit must be 1 to {schemas.PAGE_MAX}")
    if int(offset) < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*order).offset(int(offset)).limit(int(limit))


def keyset_page(df: DataFrame, ts_col: str, key_col: str, after_ts: str, after_key, limit: int) -> DataFrame:
    """P6 (deep pages): newest-first page strictly after the last row seen.
    A range filter reaches the scan instead of reading every earlier page."""
    after = ts_lit(after_ts)
    cond = (F.col(ts_col) < after) | ((F.col(ts_col) == after) & (F.col(key_col) < F.lit(after_key)))
    return df.where(cond).orderBy(F.col(ts_col).desc(), F.col(key_col).desc()).limit(int(limit))


def latest_per_key(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str]) -> DataFrame:
    """The newest row per key via ``max_by`` over a struct ordering
    (one hash aggregate with partial map-side combine, no sort)."""
    ordering = F.struct(*[F.col(c) for c in order_cols])
    payload = F.struct(*[F.col(c) for c in value_cols])
    return (df.groupBy(key).agg(F.max_by(payload, ordering).alias("_latest"))
            .select(key, *[F.col(f"_latest.{c}").alias(c) for c in value_cols]))


def oldest_pending(records: DataFrame, n: int = schemas.PENDING_BATCH) -> DataFrame:
    """The ``n`` oldest pending chain records (a top-n is the feature)."""
    return (records.where(status_of(records) == "PENDING")
            .orderBy("created_at", "record_id").limit(int(n)))


def valid_tokens(tokens: DataFrame, as_of: str) -> DataFrame:
    """Refresh tokens neither revoked nor expired at ``as_of``."""
    return tokens.where(~F.col("revoked") & (F.col("expires_at") > ts_lit(as_of)))


def shipment_lifecycle(shipments: DataFrame) -> DataFrame:
    """P10: lifecycle row with completion / in-progress flags."""
    st = status_of(shipments)
    return shipments.select(
        "shipment_id", F.lower(F.trim("status")).alias("status"), "departure_date", "arrival_date",
        (st == "COMPLETED").alias("is_completed"),
        st.isin("READY_FOR_DELIVERY", "IN_TRANSIT").alias("is_in_progress"))


def event_types_in(events: DataFrame, allowed) -> DataFrame:
    """Event-type allow-list."""
    return events.where(F.col("event_type").isin(*allowed))


LOCATION_SCHEMA = "country STRING, city STRING, address STRING"


def flatten_location(df: DataFrame, json_col: str = "location") -> DataFrame:
    """Location JSON text -> country, city, address columns."""
    loc = F.from_json(F.col(json_col), LOCATION_SCHEMA)
    return df.select(*[c for c in df.columns if c != json_col],
                     loc["country"].alias("country"), loc["city"].alias("city"),
                     loc["address"].alias("address"))


def tokens_of(c) -> Column:
    """Lower-case word tokens (letters, digits, underscore; Unicode aware)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def token_search(df: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows where any of ``columns`` holds ``term`` as a whole token
    (exact tokens, no stemming)."""
    t = term.lower()
    cond = None
    for c in columns:
        hit = F.array_contains(tokens_of(F.col(c)), t)
        cond = hit if cond is None else (cond | hit)
    return df.where(cond)


def track_history(points: DataFrame) -> DataFrame:
    """Every tracking point with its recency rank per delivery."""
    return newest_first(points, "delivery_id", "recorded_at", "tracking_id", "recency")


def in_bounding_box(points: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Tracking points inside a lat/lon box (range predicates pushed to
    the scan)."""
    return points.where(F.col("latitude").between(F.lit(lat_min).cast("decimal(10,8)"), F.lit(lat_max).cast("decimal(10,8)"))
                        & F.col("longitude").between(F.lit(lon_min).cast("decimal(11,8)"), F.lit(lon_max).cast("decimal(11,8)")))


def json_field_equals(df: DataFrame, json_col: str, path: str, value: str) -> DataFrame:
    """Predicate on one field of a JSON payload column."""
    return df.where(F.get_json_object(F.col(json_col), path) == F.lit(value))
