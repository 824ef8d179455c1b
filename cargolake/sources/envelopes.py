"""Event and command envelopes on log topics.

Read side: ``from_json`` with an explicit schema (PERMISSIVE, no schema
inference pass), then validation columns; rows that fail go to a
quarantine frame with a reason instead of being logged and dropped.
Write side: ``to_json`` of a struct (nulls kept), key = aggregate id, one
``topic`` column so a single Kafka/file sink writes every topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake.functions.common import col

UUID_RE = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"

EVENT_SCHEMA = ("event_id STRING, event_type STRING, aggregate_id STRING, aggregate_type STRING, "
                "payload STRING, timestamp STRING, correlation_id STRING")
EVENT_REQUIRED = ("event_id", "event_type", "aggregate_id", "aggregate_type", "payload", "timestamp")
COMMAND_SCHEMA = "command_id STRING, command_type STRING, aggregate_id STRING, payload STRING, correlation_id STRING"
COMMAND_REQUIRED = ("command_id", "command_type", "aggregate_id", "payload")

# fixed values: command topic per aggregate prefix of the command type
COMMAND_TOPICS = {"shipment": "shipment.commands", "inventory": "inventory.commands",
                  "courier": "delivery.commands", "blockchain": "blockchain.commands"}
# fixed values: one canonical event topic per aggregate type
EVENT_TOPICS = {"shipment": "shipment.events", "warehouse": "warehouse.events", "delivery": "delivery.events",
                "blockchain_record": "blockchain.events", "saga": "saga.events"}

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def uuid_of(c) -> Column:
    """Deterministic name-based UUID text for a non-UUID key (md5 of its text
    laid out 8-4-4-4-12).  Replaces random uuid4 so retries are stable."""
    return F.regexp_replace(F.md5(col(c).cast("string")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _map_lookup(mapping: dict, key: Column) -> Column:
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return m[key]


def _parse(df: DataFrame, value_col: str, schema: str, required, uuid_fields, ts_field: str | None) -> DataFrame:
    """Parse + one reason column (null = valid).  Checks in the order the
    reference's from_dict fails: JSON, required keys, UUIDs, timestamp."""
    # The one-element explode pins the parsed struct: the optimizer cannot
    # inline from_json into every field reference (one parse per record).
    parsed = df.select("*", F.explode(F.array(F.from_json(F.col(value_col), schema, {"mode": "PERMISSIVE"}))).alias("_e"))
    # from_json takes truncated objects and text after an object; the array of one that holds it must parse whole
    is_obj = F.coalesce(F.col(value_col).rlike(r"^\s*\{"), F.lit(False)) & (F.coalesce(F.json_array_length(F.concat(F.lit("["), F.col(value_col), F.lit("]"))), F.lit(0)) == 1)
    checks = [F.when(~is_obj, F.lit("bad_json"))]
    checks += [F.when(F.col(f"_e.{k}").isNull(), F.lit(f"missing_key:{k}")) for k in required]
    checks += [F.when(~F.col(f"_e.{k}").rlike(UUID_RE), F.lit(f"bad_uuid:{k}")) for k in uuid_fields]
    checks.append(F.when((F.col("_e.correlation_id").isNotNull()) & (F.col("_e.correlation_id") != "")
                         & ~F.col("_e.correlation_id").rlike(UUID_RE), F.lit("bad_uuid:correlation_id")))
    if ts_field:
        checks.append(F.when(F.try_to_timestamp(F.col(f"_e.{ts_field}")).isNull(), F.lit("bad_timestamp")))
    return parsed.withColumn("_reason", F.coalesce(*checks))


def parse_events(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Each record with its parsed envelope (``_e``) and the reason to reject it (``_reason``, null if valid)."""
    return _parse(df, value_col, EVENT_SCHEMA, EVENT_REQUIRED, ("event_id", "aggregate_id"), "timestamp")


def accepted_events(parsed: DataFrame, columns: list[str], value_col: str = "value") -> DataFrame:
    """The typed envelopes of the valid records, with the other ``columns`` of the log.  correlation_id: falsy -> null."""
    return parsed.where(F.col("_reason").isNull()).select(
        F.col("_e.event_id").alias("event_id"), F.col("_e.event_type").alias("event_type"),
        F.col("_e.aggregate_id").alias("aggregate_id"), F.col("_e.aggregate_type").alias("aggregate_type"),
        F.col("_e.payload").alias("payload"),
        F.try_to_timestamp(F.col("_e.timestamp")).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("_e.correlation_id") != "", F.col("_e.correlation_id")).alias("correlation_id"),
        *[c for c in columns if c != value_col])


def read_events(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S1 + S3: (typed events, quarantine)."""
    p = parse_events(df, value_col)
    return accepted_events(p, df.columns, value_col), quarantine(p, value_col)


def read_commands(df: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """S2 + S3: (typed commands, quarantine)."""
    p = _parse(df, value_col, COMMAND_SCHEMA, COMMAND_REQUIRED, ("command_id", "aggregate_id"), None)
    good = p.where(F.col("_reason").isNull()).select(
        F.col("_e.command_id").alias("command_id"), F.col("_e.command_type").alias("command_type"),
        F.col("_e.aggregate_id").alias("aggregate_id"), F.col("_e.payload").alias("payload"),
        F.when(F.col("_e.correlation_id") != "", F.col("_e.correlation_id")).alias("correlation_id"),
        *[c for c in df.columns if c != value_col])
    return good, quarantine(p, value_col)


def quarantine(parsed: DataFrame, value_col: str) -> DataFrame:
    """S3: rejected records with their log coordinates and the reason."""
    coords = [c for c in ("topic", "partition", "offset") if c in parsed.columns]
    return parsed.where(F.col("_reason").isNotNull()).select(*coords, F.col(value_col).alias("value"),
                                                            F.col("_reason").alias("reason"))


def event_json(event_id, event_type, aggregate_id, aggregate_type, payload_json, ts, correlation_id) -> Column:
    """The envelope JSON text (payload embedded as JSON, nulls kept)."""
    return F.to_json(F.struct(
        col(event_id).cast("string").alias("event_id"), col(event_type).alias("event_type"),
        col(aggregate_id).cast("string").alias("aggregate_id"), col(aggregate_type).alias("aggregate_type"),
        F.try_parse_json(col(payload_json)).alias("payload"),
        F.date_format(col(ts), ISO_FORMAT).alias("timestamp"),
        col(correlation_id).cast("string").alias("correlation_id")), {"ignoreNullFields": "false"})


def write_events(events: DataFrame) -> DataFrame:
    """(topic, key, value) rows for a Kafka or file sink.  Expects the
    typed envelope columns; topic = canonical topic of the aggregate type."""
    return events.select(
        _map_lookup(EVENT_TOPICS, F.col("aggregate_type")).alias("topic"),
        F.col("aggregate_id").cast("string").alias("key"),
        event_json("event_id", "event_type", "aggregate_id", "aggregate_type", "payload", "timestamp",
                   "correlation_id").alias("value"))


def command_json(command_id, command_type, aggregate_id, payload_json, correlation_id) -> Column:
    return F.to_json(F.struct(
        col(command_id).cast("string").alias("command_id"), col(command_type).alias("command_type"),
        col(aggregate_id).cast("string").alias("aggregate_id"), F.try_parse_json(col(payload_json)).alias("payload"),
        col(correlation_id).cast("string").alias("correlation_id")), {"ignoreNullFields": "false"})


def command_topic(command_type) -> Column:
    return _map_lookup(COMMAND_TOPICS, F.split(col(command_type), r"\.").getItem(0))


def write_commands(commands: DataFrame) -> DataFrame:
    """key = aggregate id; topic from the command's aggregate."""
    return commands.select(
        command_topic("command_type").alias("topic"), F.col("aggregate_id").cast("string").alias("key"),
        command_json("command_id", "command_type", "aggregate_id", "payload", "correlation_id").alias("value"))


def subscribe(log: DataFrame, topics) -> DataFrame:
    """The records of several topics from one scan of a log with a ``topic`` column."""
    return log.where(F.col("topic").isin(*topics))


def fan_in(streams: dict[str, DataFrame]) -> DataFrame:
    """Several topics consumed as one frame with a ``topic`` column."""
    frames = [df.withColumn("topic", F.lit(t)) if "topic" not in df.columns else df for t, df in streams.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fan_out(df: DataFrame, topics: list[str]) -> DataFrame:
    """One copy of each record per target topic."""
    return df.withColumn("topic", F.explode(F.array(*[F.lit(t) for t in topics])))


LOCATION_SCHEMA = "country STRING, city STRING, address STRING"


def location_struct(c) -> Column:
    """Location JSON text -> struct."""
    return F.from_json(col(c), LOCATION_SCHEMA)


def location_json(c) -> Column:
    """Struct -> location JSON text (nulls kept)."""
    return F.to_json(col(c), {"ignoreNullFields": "false"})


def payload_field(c, path: str, dtype: str = "string") -> Column:
    """Typed field of a JSONB-like payload via VARIANT."""
    return F.try_variant_get(F.try_parse_json(col(c)), path, dtype)


def payload_hex(c) -> Column:
    """JSON text -> 0x-prefixed lower-case hex of its UTF-8 bytes."""
    return F.concat(F.lit("0x"), F.lower(F.hex(F.encode(col(c), "UTF-8"))))


def payload_from_hex(c) -> Column:
    """Inverse of ``payload_hex``."""
    return F.decode(F.unhex(F.regexp_replace(col(c), "^0x", "")), "UTF-8")


def fingerprint(c) -> Column:
    """Stable SHA-256 content fingerprint of a payload text."""
    return F.sha2(col(c), 256)


LOG_FIELDS = ("timestamp", "level", "message", "logger", "correlation_id", "service", "environment")


def read_json_logs(df: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON log lines -> the fixed fields + an ``extra`` map of every
    other key (values as JSON text)."""
    fields = F.from_json(F.col(value_col), ", ".join(f"{f} STRING" for f in LOG_FIELDS))
    everything = F.from_json(F.col(value_col), "MAP<STRING, STRING>")
    extra = F.map_filter(everything, lambda k, v: ~k.isin(*LOG_FIELDS))
    return df.select(*[fields[f].alias(f) for f in LOG_FIELDS], extra.alias("extra"))
