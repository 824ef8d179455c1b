"""Traces in both forms, on hand-made steps."""

import datetime as dt

from pyspark.sql import functions as F

from cargolake.operators import traces

T0 = dt.datetime(2024, 1, 1)
STEP = "correlation_id long, ts timestamp_ntz, kind string, id string, label string"


def test_no_long_trace_is_gathered(spark):
    rows = [(1, T0 + dt.timedelta(minutes=37 * i), "event", f"e{i:03}", "x") for i in range(40)]
    rows += [(2, T0, "log", "l", "b"), (2, T0, "event", "e", "a"), (2, None, "command", "c", "c"), (3, T0, "event", "only", "x")]
    short, long = traces.assemble(spark.createDataFrame(rows, STEP), cap=3)
    got = {r.correlation_id: [s.id for s in r.steps] for r in short.collect()}
    assert got == {2: ["c", "e", "l"], 3: ["only"]}  # no time: first
    assert [r.id for r in long.orderBy("position").collect()] == [f"e{i:03}" for i in range(40)]
    assert [r.position for r in long.orderBy("position").collect()] == list(range(1, 41))


def test_steps_without_an_id_are_in_no_trace(spark):
    events = spark.createDataFrame([("e", 1, T0, "t"), ("f", None, T0, "t")], "event_id string, correlation_id long, ts timestamp_ntz, event_type string")
    commands = spark.createDataFrame([("c", 1, T0, "t")], "command_id string, correlation_id long, ts timestamp_ntz, command_type string")
    logs = spark.createDataFrame([("l", 1, T0, "INFO", "done")], "line_id string, correlation_id long, ts timestamp_ntz, level string, message string")
    rows = traces.steps(events, commands, logs)
    assert {(r.kind, r.id, r.label) for r in rows.collect()} == {("event", "e", "t"), ("command", "c", "t"), ("log", "l", "INFO done")}
    none = traces.assemble(rows.where(F.lit(False)))
    assert none[0].count() == none[1].count() == 0
