"""One test for each fault found in review."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolake.functions.common import seconds_between
from cargolake.functions.sequences import hour_chunk, keyed_lag, keyed_position
from cargolake.operators import chain, events, history, quality, reads, sagas, writes
from cargolake.sources import envelopes
from cargolake.streaming import feeds
from cargolake.streaming.sagas import saga_state_machine

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_page_limits_are_refused_not_clamped(spark):
    df = spark.range(600)
    assert reads.page(df, [F.col("id")], 500).count() == 500
    for limit, offset in ((600, 0), (0, 0), (10, -1)):
        with pytest.raises(ValueError):
            reads.page(df, [F.col("id")], limit, offset)


def test_seconds_between_is_exact_in_any_zone(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-03-11 00:00:00.5' AS b, timestamp_ntz '2024-03-09 23:59:59.25' AS a")
    assert df.select(seconds_between("b", "a")).first()[0] == 86401.25


def test_null_chunks_keep_positions(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", None, 2), ("k", at(0), 3), (None, at(0), 4)], "k string, ts timestamp_ntz, n int")
    out = {r.n: r.position for r in keyed_position(df, ["k"], ["ts", "n"], hour_chunk("ts")).collect()}
    assert out == {1: 1, 2: 2, 3: 3, 4: 1}
    lag = {r.n: r.prev_n for r in keyed_lag(df, ["k"], ["ts", "n"], ["n"], hour_chunk("ts")).collect()}
    assert lag == {1: None, 2: 1, 3: 2, 4: None}


def test_uniqueness_ignores_nulls_and_separators(spark):
    df = spark.createDataFrame([(None, "x"), (None, "x"), ("a|b", "c"), ("a", "b|c"), ("q", "r"), ("q", "r")], "a string, b string")
    assert [(r.row_key, r.value) for r in quality.duplicate_keys(df, "t", ["a", "b"]).collect()] == [("q|r", "2")]


def test_failed_records_keep_their_error(spark):
    records = spark.createDataFrame([("r", "s", "0x1", "FAILED", at(0), None, None, "why", None, "n")], "record_id string, shipment_id string, "
                                    "tx_hash string, status string, created_at timestamp, confirmed_at timestamp, block_number long, "
                                    "error_message string, gas_used long, network string")
    receipts = spark.createDataFrame([], "tx_hash string, block_number long, confirmations int, status string, gas_used long, block_time timestamp")
    assert chain.track_confirmations(records, receipts).first().error_message == "why"


def test_token_of_unknown_user_is_revoked_without_successor(spark):
    tokens = spark.createDataFrame([(1, 7, "h", at(99999), False)], "token_id long, user_id long, token_hash string, expires_at timestamp_ntz, revoked boolean")
    users = spark.createDataFrame([(8,)], "user_id long")
    snap, report = writes.rotate_tokens(tokens, tokens.select("token_hash"), users, "2024-01-01 00:00:00")
    assert [r.revoked for r in snap.collect()] == [True] and report.first().outcome == "rejected"


def test_dedup_keeps_the_same_row(spark):
    df = spark.createDataFrame([("e", at(2), "b"), ("e", at(1), "z"), ("e", at(1), "a")], "event_id string, ts timestamp, payload string")
    assert [r.payload for r in events.dedup_events(df).collect()] == ["a"]


@pytest.mark.parametrize("tail, reason", [("", None), (" garbage", "bad_json"), (None, "bad_json")])
def test_envelopes_are_whole_json(spark, tail, reason):
    uuid = "11111111-1111-1111-1111-111111111111"
    text = (f'{{"event_id":"{uuid}","event_type":"x","aggregate_id":"{uuid}","aggregate_type":"shipment","payload":{{}},'
            '"timestamp":"2024-01-01T00:00:00","correlation_id":null}')
    text = text[:-1] if tail is None else text + tail
    good, bad = envelopes.read_events(spark.createDataFrame([(text,)], "value string"))
    assert [r.reason for r in bad.collect()] == ([reason] if reason else []) and good.count() == (reason is None)


def test_bad_payload_does_not_stop_the_job(spark):
    df = spark.createDataFrame([("{oops",), ('{"a": 1}',)], "p string")
    assert [r[0] for r in df.select(envelopes.payload_field("p", "$.a", "int")).collect()] == [None, 1]


def test_failed_verification_is_reported_and_starts_nothing(spark):
    made = spark.createDataFrame([("v", "blockchain.verification_failed", 1, at(0), "{}"), ("d", "delivery.failed", 1, at(1), "{}")],
                                 "event_id string, event_type string, correlation_id long, ts timestamp, payload string")
    saga = spark.createDataFrame([(1, "STARTED", 5, 6, 7, "t")], "saga_id long, status string, shipment_id long, warehouse_id long, delivery_id long, saga_type string")
    outcomes, commands, updates = sagas.plan_compensation(made, saga)
    assert {r.event_id: r.outcome for r in outcomes.collect()} == {"v": "no_strategy", "d": "fired"}
    assert commands.count() == 3 and {r.event_id for r in updates.collect()} == {"d"}


SCHEMA = "event_id string, event_type string, aggregate_id string, correlation_id string, payload string, ts timestamp"


def run_log(spark, tmp_path, batches):
    """One micro-batch for each list of events."""
    log = str(tmp_path / "log")
    ckpt, sink = str(tmp_path / "ckpt"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(log)
        feeds.run_available_now(saga_state_machine(feeds.replay_files(spark, log, SCHEMA), "1 minute", 600), sink, ckpt)
    return spark.read.parquet(sink).collect()


def test_saga_keeps_state_over_timeouts(spark, tmp_path):
    start = lambda k, m: (f"s{k}{m}", "shipment.created", "9", k, "{}", at(m))
    out = run_log(spark, tmp_path, [
        [start("a", 0), ("c0", "delivery.completed", "9", "a", "{}", at(1)), start("b", 0)],
        [start("z", 500)],
        [start("y", 501)],
        [("f1", "delivery.failed", "9", "b", "{}", at(502)), ("f2", "delivery.failed", "9", "a", "{}", at(502)),
         ("v", "blockchain.verification_failed", "9", "z", "{}", at(502))],
    ])
    late = {r.saga_id for r in out if r.kind == "step_timeout"}
    assert "b" in late and "a" not in late
    said = {r.event_id: r.detail for r in out if r.kind == "outcome"}
    assert said == {"f2": "already_final", "v": "no_strategy"}
    assert {r.status for r in out if r.event_id == "f1" and r.kind == "snapshot"} == {"COMPENSATING", "FAILED"}


def test_open_windows_are_in_the_drained_result(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = [("s", at(m)) for m in (0, 0, 1, 500)]
    spark.createDataFrame(rows, "service string, ts timestamp").write.parquet(log)
    stream = feeds.windowed_request_rate(feeds.replay_files(spark, log, "service string, ts timestamp"))
    out = feeds.run_upserts(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["service", "window_start"])
    assert sorted(round(r.per_second * 60) for r in out.collect()) == [1, 1, 2]


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_arrival_date_survives_a_later_verb(spark):
    ships = spark.createDataFrame([(1, "in_transit", None, at(0))], "shipment_id long, status string, arrival_date date, updated_at timestamp_ntz")
    verbs = spark.createDataFrame([(1, 1, "deliver"), (1, 2, "complete")], "shipment_id long, verb_seq long, verb string")
    out = history.apply_shipment_verbs(ships, verbs, "2024-01-02 00:00:00").first()
    assert out.status == "completed" and out.arrival_date == dt.date(2024, 1, 2)


def test_delivery_requests_see_their_predecessors(spark):
    kept = spark.createDataFrame([(1, "ASSIGNED")], "delivery_id long, status string")
    asked = spark.createDataFrame(
        [(1, 1, "confirm", None), (2, 1, "deliver", at(5)), (3, 1, "in_transit", None), (4, 1, "confirm", None), (5, 1, "confirm", None),
         (6, 1, "in_transit", None), (7, 1, "confirm", None), (8, 9, "deliver", at(6)), (70000, 1, "deliver", at(7)), (70001, 1, "receive", None)],
        "request_seq long, delivery_id long, verb string, arrival timestamp_ntz")
    out = history.delivery_guard(kept, asked).orderBy("request_seq")
    assert _rows(out, "current_status", "reason") == [
        ("ASSIGNED", "not_delivered"), ("ASSIGNED", None), ("DELIVERED", "already_delivered"), ("DELIVERED", None),
        ("CONFIRMED", "not_delivered"), ("CONFIRMED", None), ("IN_TRANSIT", "not_delivered"), (None, "delivery_not_found"),
        ("IN_TRANSIT", None), ("DELIVERED", "already_delivered")]
    assert [r.actual_arrival for r in out.collect()].count(at(7)) == 1


def test_inventory_requests_stop_at_shipped(spark):
    kept = spark.createDataFrame([("a", "stored")], "record_id string, status string")
    asked = spark.createDataFrame([(1, "a", "received"), (2, "a", "shipped"), (3, "a", "stored"), (4, "a", "shipped"), (5, "b", "stored")],
                                  "request_seq long, record_id string, new_status string")
    out = history.inventory_guard(kept, asked).orderBy("request_seq")
    assert _rows(out, "current_status", "accepted", "reason") == [
        ("STORED", True, None), ("RECEIVED", True, None), ("SHIPPED", False, "already_shipped"), ("SHIPPED", True, None),
        (None, False, "record_not_found")]


def test_saga_requests_see_their_predecessors(spark):
    kept = spark.createDataFrame([(1, "STARTED"), (2, "CANCELLED")], "saga_id long, status string")
    asked = spark.createDataFrame(
        [(1, 1, "complete"), (2, 1, "compensate"), (3, 1, "fail"), (4, 1, "complete"), (5, 2, "complete"), (6, 2, "compensate"),
         (7, 2, "complete"), (8, 2, "fail"), (9, 2, "compensate"), (10, 3, "fail")], "request_seq long, saga_id long, action string")
    out = history.saga_guard(kept, asked).orderBy("request_seq")
    assert _rows(out, "outcome", "resulting_status") == [
        ("applied", "COMPLETED"), ("refused", "COMPLETED"), ("applied", "FAILED"), ("noop", "FAILED"), ("noop", "CANCELLED"),
        ("applied", "COMPENSATING"), ("noop", "COMPENSATING"), ("applied", "FAILED"), ("refused", "FAILED"), ("saga_not_found", None)]
