"""Hand-made tables for guards, ties, nulls, empty input and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cargolake.functions.sequences import hour_chunk, keyed_lag, keyed_position
from cargolake.operators import history as h
from cargolake.operators import metrics as m
from cargolake.operators import sagas, text, writes
from cargolake.sources import envelopes as env

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)
U1 = "11111111-1111-1111-1111-111111111111"
U2 = "22222222-2222-2222-2222-222222222222"


def test_quarantine_reasons(spark):
    good = ('{"event_id":"%s","event_type":"x","aggregate_id":"%s","aggregate_type":"a","payload":{},'
            '"timestamp":"2024-01-01T00:00:00+00:00","correlation_id":""}' % (U1, U2))
    rows = [(good,), ("not json",), ('{"event_id":"%s"}' % U1,),
            (good.replace(U1, "nope"),), (good.replace("2024-01-01T00:00:00+00:00", "yesterday"),)]
    df = spark.createDataFrame(rows, "value string")
    ok, bad = env.read_events(df)
    assert ok.count() == 1 and ok.first().correlation_id is None
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["bad_json", "bad_timestamp", "bad_uuid:event_id", "missing_key:event_type"]


def test_envelope_roundtrip(spark):
    df = spark.createDataFrame([(U1, "shipment.created", U2, "shipment", '{"a":1}', T0, None)],
                               "event_id string, event_type string, aggregate_id string, aggregate_type string, "
                               "payload string, timestamp timestamp_ntz, correlation_id string")
    out = env.write_events(df)
    assert out.first().topic == "shipment.events"
    back, bad = env.read_events(out)
    assert bad.count() == 0
    r = back.first()
    assert (r.event_id, r.payload, r.timestamp) == (U1, '{"a":1}', T0)


def test_upsert_insert_update_tie(spark):
    target = spark.createDataFrame([(1, "a", "x", T0, T0)], "id long, status string, note string, created_at timestamp_ntz, updated_at timestamp_ntz")
    changes = spark.createDataFrame([(1, "b", 1, 10), (1, "c", 1, 11), (2, "n", 5, 12)],
                                    "id long, status string, ord int, seq int")
    out = {r.id: r for r in writes.upsert(target, changes, "id", ["status"], ["ord", "seq"], "2024-02-01 00:00:00").collect()}
    assert out[1].status == "c" and out[1].note == "x" and out[1].created_at == T0
    assert out[1].updated_at == dt.datetime(2024, 2, 1)
    assert out[2].status == "n" and out[2].note is None and out[2].created_at == dt.datetime(2024, 2, 1)
    # idempotent: applying the same changes again gives the same snapshot
    again = writes.upsert(writes.upsert(target, changes, "id", ["status"], ["ord", "seq"], "2024-02-01 00:00:00"),
                          changes, "id", ["status"], ["ord", "seq"], "2024-02-01 00:00:00")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.values()))


def test_patch_null_keeps(spark):
    target = spark.createDataFrame([(1, "a", "x")], "id long, status string, note string")
    patches = spark.createDataFrame([(1, None, "y", 1), (1, "b", None, 2)], "id long, status string, note string, seq int")
    r = writes.patch(target, patches, "id", ["status", "note"], ["seq"], touch_col=None).first()
    assert (r.status, r.note) == ("b", "y")


def test_status_history_null_and_repeat(spark):
    old = spark.createDataFrame([(1, None), (2, "A"), (3, "A")], "id long, status string")
    new = spark.createDataFrame([(1, "A"), (2, "A"), (3, None), (4, "B")], "id long, status string")
    out = {r.id: (r.old_status, r.new_status) for r in h.status_history_from_snapshots(old, new, "id", "2024-01-01 00:00:00").collect()}
    assert out == {1: (None, "A"), 3: ("A", None), 4: (None, "B")}


def test_keyed_lag_and_position_hot_key(spark):
    # one key holds most rows and spans many chunks
    rows = [(0 if i % 3 else i, T0 + dt.timedelta(minutes=7 * i), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, seq long").withColumn("v", F.col("seq") * 2)
    w = Window.partitionBy("k").orderBy("ts", "seq")
    ref = {(r.k, r.seq): (r.p, r.rn) for r in df.select("k", "seq", F.lag("v").over(w).alias("p"),
                                                         F.row_number().over(w).alias("rn")).collect()}
    lag = {(r.k, r.seq): r.prev_v for r in keyed_lag(df, ["k"], ["ts", "seq"], ["v"], hour_chunk("ts")).collect()}
    pos = {(r.k, r.seq): r.position for r in keyed_position(df, ["k"], ["ts", "seq"], hour_chunk("ts")).collect()}
    assert all(lag[k] == ref[k][0] for k in ref)
    assert all(pos[k] == ref[k][1] for k in ref)


def test_histogram_quantile_edges(spark):
    cols = m.BUCKET_COLS
    schema = ", ".join(f"{c} long" for c in cols)
    df = spark.createDataFrame([tuple([0] * 8 + [4]), tuple([0] * 9), tuple([2] * 9), tuple([0, 0, 0, 0, 0, 0, 0, 0, 0])], schema)
    got = [r.q for r in df.select(m.histogram_quantile(0.5).alias("q")).collect()]
    assert got[0] == 5.0          # everything above 5 s -> largest finite bound
    assert got[1] is None         # no data
    assert abs(got[2] - 0.005) < 1e-12  # all in the first bucket, interpolated from 0


def test_error_ratio_no_traffic_is_null(spark):
    req = spark.createDataFrame([("a", T0, 500), ("b", T0 - dt.timedelta(hours=3), 200)],
                                "service string, ts timestamp_ntz, status int")
    # one ratio over all services, as the panel has it; null without traffic in the window
    assert [r.error_pct for r in m.error_ratio(req, "2024-01-01 12:01:00").collect()] == [100.0]
    assert [r.error_pct for r in m.error_ratio(req, "2024-01-01 18:00:00").collect()] == [None]


def test_counter_reset(spark):
    s = spark.createDataFrame([("a", T0, 5), ("a", T0 + dt.timedelta(minutes=1), 9),
                               ("a", T0 + dt.timedelta(minutes=2), 3)], "service string, ts timestamp_ntz, value long")
    assert m.counter_increase(s).first().increase == 4 + 3


def test_zero_vector_and_cyrillic(spark):
    vecs = spark.createDataFrame([("работа", [1.0, 0.0]), ("озон", [0.0, 1.0])], "word string, vec array<double>")
    msgs = spark.createDataFrame([(1, "Ищу работа на ОЗОН"), (2, "nothing known")], "message_id long, text string")
    mv = {r.message_id: r.vec for r in text.mean_vectors(msgs, "message_id", "text", vecs, 2).collect()}
    assert mv[1] == [0.5, 0.5] and mv[2] == [0.0, 0.0]
    a = {r.message_id: r for r in text.analyse(msgs, vecs, 2, "работа", "озон", "работа", ["озон", "wb"], ["ищу"],
                                                ["менеджер"]).collect()}
    assert a[2].job_intent_score == 0.0 and not a[2].is_job_search
    assert a[1].has_marketplace and a[1].has_job_intent and a[1].is_job_search


def _saga(spark, status="started", warehouse=5, delivery=7):
    return spark.createDataFrame([(1, status.upper(), 100, warehouse, delivery, "t")],
                                 "saga_id long, status string, shipment_id long, warehouse_id long, delivery_id long, saga_type string")


def _ev(spark, rows):
    return spark.createDataFrame(rows, "event_id long, event_type string, correlation_id long, payload string, ts timestamp_ntz")


def test_saga_worker_three_commands_in_order(spark):
    o, c, u = sagas.plan_compensation(_ev(spark, [(1, "delivery.failed", 1, '{"reason":"broken"}', T0)]), _saga(spark))
    cmds = [(r.command_type, r.topic, r.reason) for r in c.orderBy("step").collect()]
    assert cmds == [("courier.unassign", "delivery.commands", "broken"),
                    ("inventory.release", "inventory.commands", "Delivery failed rollback"),
                    ("shipment.cancel", "shipment.commands", "Delivery failed rollback")]
    assert [r.status for r in u.orderBy("seq").collect()] == ["COMPENSATING", "FAILED"]


def test_saga_worker_guards(spark):
    ev = _ev(spark, [(1, "delivery.failed", None, "{}", T0), (2, "delivery.failed", 99, "{}", T0)])
    out = {r.event_id: r.outcome for r in sagas.plan_compensation(ev, _saga(spark))[0].collect()}
    assert out == {1: "no_correlation", 2: "saga_not_found"}
    for st in ("completed", "compensating", "failed", "cancelled"):
        o, c, _ = sagas.plan_compensation(_ev(spark, [(3, "delivery.failed", 1, "{}", T0)]), _saga(spark, st))
        assert o.first().outcome == "already_final" and c.count() == 0


def test_saga_worker_race_and_insufficient(spark):
    ev = _ev(spark, [(5, "courier.unassigned", 1, "{}", T0 + dt.timedelta(seconds=1)),
                     (4, "inventory.insufficient", 1, "{}", T0)])
    o, c, _ = sagas.plan_compensation(ev, _saga(spark))
    out = {r.event_id: r.outcome for r in o.collect()}
    assert out == {4: "fired", 5: "already_final"}
    assert [r.command_type for r in c.collect()] == ["shipment.cancel"]


def test_saga_worker_missing_ids_skip_commands(spark):
    o, c, _ = sagas.plan_compensation(_ev(spark, [(1, "delivery.failed", 1, "{}", T0)]),
                                      _saga(spark, warehouse=None, delivery=None))
    assert [(r.command_type, r.reason) for r in c.collect()] == [("shipment.cancel", "Delivery failed rollback")]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "event_id long, event_type string, correlation_id long, payload string, ts timestamp_ntz")
    o, c, u = sagas.plan_compensation(empty, _saga(spark))
    assert o.count() == c.count() == u.count() == 0


def test_seconds_between_ignores_session_zone(spark):
    from cargolake.functions.common import seconds_between
    df = spark.createDataFrame([(dt.datetime(1996, 4, 6), dt.datetime(1998, 7, 1))], "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        got = df.select(seconds_between("b", "a").alias("s")).first().s
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == (dt.datetime(1998, 7, 1) - dt.datetime(1996, 4, 6)).total_seconds()


def test_mean_vectors_alike_with_and_without_a_head(spark):
    rows = [(1, "the the cat"), (2, "the dog"), (3, "the nobody knows"), (4, ""), (5, None), (6, "nobody"), (6, "the cat")]
    docs = spark.createDataFrame(rows, "id long, text string")
    vecs = spark.createDataFrame([("the", [1.0, 0.0]), ("cat", [0.0, 3.0]), ("dog", [2.0, 2.0])], "word string, vec array<double>")
    got = []
    for head_words in (0, 1, 2, 100):
        out = text.mean_vectors(docs, "id", "text", vecs, 2, head_words)
        got.append(sorted((r.id, [round(x, 9) for x in r.vec]) for r in out.collect()))
    assert got[0] == got[1] == got[2] == got[3]
    means = dict(got[0])
    assert means[1] == [round(2 / 3, 9), 1.0] and means[3] == [1.0, 0.0] and means[4] == means[5] == [0.0, 0.0]


def test_a_hot_word_is_broadcast_and_stays_out_of_the_join_by_word(spark):
    docs = spark.createDataFrame([(i, f"the word{i}") for i in range(50)], "id long, text string")
    vecs = spark.createDataFrame([("the", [1.0])], "word string, vec array<double>")
    plan = text.mean_vectors(docs, "id", "text", vecs, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [word" in plan and "isnull(_head" in plan


def test_keyed_sequences_shuffle_the_rows_once(spark):
    df = spark.createDataFrame([(None, None, 1), ("a", dt.datetime(2024, 1, 1, 5), 2)], "k string, ts timestamp_ntz, seq long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keyed_position(df, ["k"], ["ts", "seq"], hour_chunk("ts"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the window's exchange and order serve the join: nothing lies between them
    lines = [line.strip() for line in plan.splitlines()]
    at = next(i for i, line in enumerate(lines) if "SortMergeJoin [_at#" in line)
    assert lines[at + 1].startswith(":- Window")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_never_sorts_the_stored_rows(spark):
    from cargolake.operators.writes import upsert
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.range(100).select(F.col("id").alias("k"), F.lit("wide text").alias("text"), F.lit("a").alias("status"))
        changes = spark.range(50, 150).select(F.col("id").alias("k"), F.lit("b").alias("status"), F.col("id").alias("n"))
        out = upsert(stored, changes, "k", ["status"], ["n"])
        joins = [line for line in _plan(out).splitlines() if "Join [" in line]
        assert [kind for line in joins for kind in ("LeftOuter", "LeftSemi") if kind in line and "ShuffledHashJoin" in line] == ["LeftOuter", "LeftSemi"]
        assert {(r.k, r.text, r.status) for r in out.collect()} == {
            (k, "wide text" if k < 100 else None, "a" if k < 50 else "b") for k in range(150)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("limit", [1, 3, 1 << 16])
def test_inventory_guard_of_crowded_records(spark, monkeypatch, limit):
    """Records of many requests go another way, to the same result."""
    from cargolake.functions import sequences
    from cargolake.operators import history
    monkeypatch.setattr(sequences.crowded, "__defaults__", (limit,))
    kept = spark.createDataFrame([("a", "stored"), ("b", "shipped"), (None, "stored")], "record_id string, status string")
    verbs = ["received", None, "stored", "shipped ", "stored", "shipped"]
    asked = [(i * 40_000, r, verbs[i % 6]) for i in range(6) for r in ("a", "b", "c", None)][:-3]
    out = history.inventory_guard(kept, spark.createDataFrame(asked, "request_seq long, record_id string, new_status string"))
    got = {(r.record_id, r.request_seq): (r.current_status, r.reason) for r in out.collect()}
    want = {}
    for seq, record, _ in asked:
        before = [v.strip().upper() if v else None for s, r, v in asked if r == record and s < seq]
        asks = next(v for s, r, v in asked if (s, r) == (seq, record))
        now = {"a": "STORED", "b": "SHIPPED"}.get(record)
        if now == "STORED":
            now = "SHIPPED" if "SHIPPED" in before else (before[-1] or "STORED") if before else now
        refused = now == "SHIPPED" and asks is not None and asks.strip().upper() != "SHIPPED"
        want[record, seq] = (now, "record_not_found" if now is None else "already_shipped" if refused else None)
    assert got == want


def test_inventory_guard_shuffles_the_requests_once(spark):
    from cargolake.operators import history
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = spark.range(9).select(F.col("id").cast("string").alias("record_id"), F.lit("stored").alias("status"))
        asked = kept.select(F.lit(1).alias("request_seq"), "record_id", F.lit("shipped").alias("new_status"))
        text = _plan(history.inventory_guard(kept, asked))
        assert text.count("Exchange hashpartitioning(record_id") <= 8
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
