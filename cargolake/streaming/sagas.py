"""T5: saga state machine over the event stream (applyInPandasWithState).

Key: a group of sagas, by a hash of the saga id (= correlation_id).  A call of
Python costs about five milliseconds whatever it gets, so a key for each saga is
hours for a million sagas; ``groups`` bounds the calls of a micro-batch.
State per saga is a handful of scalars (status, ids, timestamps, retry count,
when its time is up), so it stays small regardless of how many events a saga
receives; a group holds all sagas / ``groups``.  Only the events that a saga
handles reach Python, without their payloads, and are folded in (timestamp,
event_id) order; one group's events of one micro-batch are held at a time, so
the size of a trigger (``replay_files``' ``max_files_per_trigger``) bounds them.

Transitions (reference behaviour plus the C21 choices):
* shipment.created starts a saga (STARTED) when none exists;
* inventory.reserved / courier.assigned set warehouse / delivery id when
  the value is truthy;
* delivery.completed completes a STARTED saga (no-op otherwise);
* failure events: unknown saga -> saga_not_found; completed / compensating
  / failed / cancelled -> already_final; otherwise the compensation
  commands of T4 plus COMPENSATING then FAILED;
* no event for ``timeout`` of event time -> one step_timeout row, status
  kept (event-time timeout driven by the watermark, never wall clock).

State: a finished saga (completed, failed, cancelled) is forgotten ``keep`` of
event time after its last event, so state is bounded by the running sagas and
those that ended within ``keep``; a failure that comes later than that finds no
saga.  ``keep`` must therefore exceed how late an event may come.  Sagas that were
begun before the log are handed over as ``loaded_sagas``, rows at its start.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cargolake import schemas
from cargolake.session import ship_package

OUTPUT_SCHEMA = ("saga_id STRING, kind STRING, status STRING, detail STRING, "
                 "warehouse_id STRING, delivery_id STRING, event_id STRING, ts_us BIGINT")
STATE_SCHEMA = "sagas STRING"  # JSON: saga id -> the fields below
FIELDS = ("status", "shipment_id", "warehouse_id", "delivery_id", "started_us", "updated_us", "failed_step", "retry_count", "due_ms")
GROUPS = 1 << 13  # fixed for the life of a checkpoint
NO_TIME = (1 << 63) - 1  # a null event time, which comes last

_FINAL_OR_COMP = {"COMPLETED", "COMPENSATING", "FAILED", "CANCELLED"}
LOADED = "saga.loaded"  # a row of the saga snapshot, in the log
KEEP_SECONDS = 7 * 24 * 3600


_TARGET = {kind: (target, needed) for kind, (_, target, needed) in schemas.COMMAND_TARGETS.items()}
_HANDLED = (*schemas.SAGA_START_EVENTS, *schemas.COMPENSATION_TRIGGER_EVENTS, "inventory.reserved", "courier.assigned", "delivery.completed", LOADED)


def _commands(event_type: str, reason: str | None, saga: dict):
    """The ordered compensation commands of one fired failure event."""
    for kind, why in schemas.COMPENSATION[event_type]:
        target, needed = _TARGET[kind]
        if saga[target] or not needed:
            yield kind, why or reason or f"Triggered by {event_type}"


_EVENT = ("saga_id", "event_type", "event_id", "ts_us", "aggregate_id", "reason", "status", "warehouse_id", "delivery_id", "context_id")


def _events(pdfs: Iterator[pd.DataFrame]) -> list[tuple]:
    """Loaded sagas first, then by (time, event id)."""
    rows = [row for pdf in pdfs for row in zip(*[pdf[c].tolist() for c in _EVENT])]
    return sorted(rows, key=lambda r: (r[1] != LOADED, r[3], not isinstance(r[2], str), str(r[2])))


def _apply(saga_id: str, cur: dict | None, ev: dict, rows: list[tuple]) -> dict | None:
    """The saga after ``ev``; what it reports is added to ``rows``."""
    et, eid, ts = ev["event_type"], str(ev["event_id"]), ev["ts_us"]

    def tell(*what) -> None:
        rows.append((saga_id, *what, eid, ts))

    if et == LOADED:
        if cur is None:
            cur = {"status": ev["status"], "shipment_id": ev["aggregate_id"], "warehouse_id": ev["warehouse_id"], "delivery_id": ev["delivery_id"],
                   "started_us": ts, "updated_us": ts, "failed_step": None, "retry_count": 0}
    elif et in schemas.SAGA_START_EVENTS:
        if cur is None:
            cur = {"status": "STARTED", "shipment_id": str(ev["aggregate_id"]), "warehouse_id": None,
                   "delivery_id": None, "started_us": ts, "updated_us": ts, "failed_step": None, "retry_count": 0}
            tell("snapshot", "STARTED", "saga_started", None, None)
    elif et in schemas.COMPENSATION_TRIGGER_EVENTS:
        if cur is None:
            tell("outcome", None, "saga_not_found", None, None)
        elif cur["status"] in _FINAL_OR_COMP:
            tell("outcome", cur["status"], "already_final", None, None)
        elif et not in schemas.COMPENSATION:  # a failed verification is reported, no compensation
            tell("outcome", cur["status"], "no_strategy", None, None)
        else:
            where = cur["warehouse_id"], cur["delivery_id"]
            for ctype, why in _commands(et, ev["reason"], cur):
                tell("command", ctype, why, *where)
            cur.update(status="FAILED", failed_step=et, updated_us=ts)
            tell("snapshot", "COMPENSATING", et, *where)
            tell("snapshot", "FAILED", f"Compensation triggered by {et}", *where)
    elif cur is None:
        pass
    elif et == "inventory.reserved" and ev["context_id"]:
        cur.update(warehouse_id=ev["context_id"], updated_us=ts)
    elif et == "courier.assigned" and ev["context_id"]:
        cur.update(delivery_id=ev["context_id"], updated_us=ts)
    elif et == "delivery.completed" and cur["status"] == "STARTED":
        cur.update(status="COMPLETED", updated_us=ts)
        tell("snapshot", "COMPLETED", "saga_completed", cur["warehouse_id"], cur["delivery_id"])
    return cur


def fold_sagas(pdfs: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int, keep_ms: int) -> Iterator[pd.DataFrame]:
    """The sagas of one group: their new events, then those whose time is up."""
    packed = json.loads(state.get[0]) if state.exists else {}
    now, rows, seen = state.getCurrentWatermarkMs(), [], {}
    for row in [] if state.hasTimedOut else _events(pdfs):
        ev = {c: v if isinstance(v, str | int) else None for c, v in zip(_EVENT, row)}
        saga_id = ev["saga_id"]
        if saga_id not in seen:
            seen[saga_id] = dict(zip(FIELDS, packed[saga_id])) if saga_id in packed else None
        seen[saga_id] = _apply(saga_id, seen[saga_id], ev, rows)
    for saga_id, cur in seen.items():
        if cur is not None:
            # a running saga may be late, an ended one is forgotten
            last = now if cur["updated_us"] == NO_TIME else max(cur["updated_us"] // 1000, now)
            cur["due_ms"] = last + (keep_ms if cur["status"] in _FINAL_OR_COMP else timeout_ms)
            packed[saga_id] = [cur[f] for f in FIELDS]
    for saga_id in [s for s, v in packed.items() if v[-1] is not None and v[-1] < now and s not in seen]:
        cur = dict(zip(FIELDS, packed[saga_id]))
        if cur["status"] in _FINAL_OR_COMP:
            del packed[saga_id]
            continue
        # a running saga is reported once; it and its status stay, for what may still come
        rows.append((saga_id, "step_timeout", cur["status"], "no event within timeout", cur["warehouse_id"], cur["delivery_id"], None, cur["updated_us"]))
        packed[saga_id][-1] = None
    if packed:
        state.update((json.dumps(packed, separators=(",", ":")),))
        due = [v[-1] for v in packed.values() if v[-1] is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due), now))
    elif state.exists:
        state.remove()
    if rows:
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in OUTPUT_SCHEMA.split(", ")])


def loaded_sagas(sagas: DataFrame) -> DataFrame:
    """A saga snapshot as the first events of a log (event_id, event_type, aggregate_id, correlation_id, payload, ts,
    context_id): the state that the machine starts from."""
    text = F.to_json(F.struct(F.upper(F.trim("status")).alias("status"), F.col("warehouse_id").cast("string").alias("warehouse_id"),
                              F.col("delivery_id").cast("string").alias("delivery_id")))
    return sagas.select(F.concat(F.lit("loaded:"), F.col("saga_id").cast("string")).alias("event_id"), F.lit(LOADED).alias("event_type"),
                        F.col("shipment_id").cast("string").alias("aggregate_id"), F.col("saga_id").cast("string").alias("correlation_id"),
                        text.alias("payload"), F.coalesce("updated_at", "started_at").alias("ts"), F.lit(None).cast("string").alias("context_id"))


def saga_state_machine(events: DataFrame, watermark: str = "10 minutes", timeout_s: int = schemas.STEP_TIMEOUT_SECONDS,
                       keep_s: int = KEEP_SECONDS, groups: int = GROUPS) -> DataFrame:
    """T5 on a streaming (or batch) frame of events with columns event_id,
    event_type, aggregate_id, correlation_id, payload, ts[, context_id].
    ``groups`` must stay what it was when the checkpoint was begun."""
    ship_package(events.sparkSession)
    if "context_id" not in events.columns:
        events = events.withColumn("context_id", F.lit(None).cast("string"))
    e = (events.where(F.col("correlation_id").isNotNull())
         .select(F.col("correlation_id").cast("string").alias("saga_id"), F.col("event_id").cast("string").alias("event_id"),
                 "event_type", F.col("aggregate_id").cast("string").alias("aggregate_id"),
                 *[F.get_json_object("payload", f"$.{c}").alias(c) for c in ("reason", "status", "warehouse_id", "delivery_id")],
                 F.col("context_id").cast("string").alias("context_id"), F.col("ts").cast("timestamp").alias("ts"))
         .withWatermark("ts", watermark)
         .where(F.col("event_type").isin(*_HANDLED)))  # after the watermark, which all events move
    timeout_ms, keep_ms = int(timeout_s) * 1000, int(keep_s) * 1000
    grouped = (e.withColumn("ts_us", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)))
               .withColumn("saga_group", F.pmod(F.xxhash64("saga_id"), F.lit(groups))).groupBy("saga_group"))
    told = grouped.applyInPandasWithState(
        lambda k, p, s: fold_sagas(p, s, timeout_ms, keep_ms), OUTPUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
    names = [c.split(" ")[0] for c in OUTPUT_SCHEMA.split(", ")][:-1]
    return told.select(*names, F.timestamp_micros(F.when(F.col("ts_us") != NO_TIME, F.col("ts_us"))).alias("ts"))
