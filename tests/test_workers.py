"""Stream workers over several micro-batches: repeats, restarts, late rows, state that falls, files that stay."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from cargolake.operators import metrics
from cargolake.streaming import feeds, workers
from cargolake.streaming.sagas import loaded_sagas, saga_state_machine
from cargolake.streaming.store import Change, SnapshotStore

T0 = dt.datetime(2024, 1, 1)
EVENTS = "event_id string, event_type string, aggregate_id string, correlation_id long, payload string, ts timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- the store

@pytest.fixture
def store(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)] + [(None, "null key")], "k int, v string")
    return SnapshotStore.create(spark, str(tmp_path / "store"), {"t": (df, "k"), "u": (df.limit(0), "k")}, buckets=8)


def set_to(spark, keys, value):
    new = spark.createDataFrame([(k, value) for k in keys], "k long, v string")
    return Change(new.select("k"), lambda old: old.join(new.select("k"), "k", "left_anti").unionByName(new.withColumn("k", F.col("k").cast("int"))))


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    before, root = files(tmp_path / "store" / "t"), tmp_path / "store" / "t"
    assert store.commit(0, {"t": set_to(spark, [7, 8], "new")})
    touched = set(store.touched("t", spark.createDataFrame([(7,), (8,)], "k long")))
    assert 1 <= len(touched) <= 2
    after = files(root)
    assert {p: after[p] for p in before} == before  # what was written before is as it was
    fresh = {int(p.split("store_bucket=")[1].split("/")[0]) for p in set(after) - set(before)}
    assert fresh == touched
    assert {b for b, v in store.places("t").items() if v == 1} == touched
    assert dict(rows(store.read("t").where("v = 'new'"))) == {7: "new", 8: "new"} and store.read("t").count() == 101
    assert store.read("t", version=0).where("v = 'new'").count() == 0  # the old version can still be read


def test_reads_are_pruned_to_the_buckets_of_the_keys(spark, store):
    found = store.read("t", spark.createDataFrame([(7,)], "k int"))
    assert 7 in {r.k for r in found.collect()} and found.count() < 60
    assert len(found.inputFiles()) < len(store.read("t").inputFiles())
    assert store.read("t", []).count() == 0 and store.read("u").count() == 0
    assert store.read("t", spark.createDataFrame([(None,)], "k int")).where("k IS NULL").count() == 1


def test_a_repeated_batch_changes_nothing(spark, store, tmp_path):
    store.commit(3, {"t": set_to(spark, [1], "a")}, {"note": 1})
    held = files(tmp_path)
    assert not store.commit(3, {"t": set_to(spark, [1], "b")}) and not store.commit(2, {"t": set_to(spark, [1], "b")})
    assert files(tmp_path) == held and store.facts() == {"note": 1}
    again = SnapshotStore(spark, store.path)  # as after a restart
    assert (again.applied(), again.version(), again.facts()) == (3, 1, {"note": 1})
    assert rows(again.read("t")) == rows(store.read("t"))


def test_files_without_a_ledger_entry_are_not_seen(spark, store):
    """A worker that died before its commit: the batch comes again and wins."""
    change = set_to(spark, [1], "half")
    store._write("t", 1, change.rows(store.read("t", change.keys)), "k", 8)
    again = SnapshotStore(spark, store.path)
    assert again.version() == 0 and again.read("t").where("v = 'half'").count() == 0
    assert again.commit(0, {"t": set_to(spark, [1], "whole")})
    assert [r.v for r in again.read("t").where("k = 1").collect()] == ["whole"]


def test_a_commit_writes_rows_from_where_they_are(spark, store):
    """No shuffle before the files: each task writes its own of a bucket."""
    every = store.read("t").select("k")
    store.commit(0, {"t": Change(every, lambda old: old.withColumn("v", F.lit("new")).repartition(3, "v", "k"))})
    counts = {}
    for p in store.read("t").inputFiles():
        counts[os.path.dirname(p)] = counts.get(os.path.dirname(p), 0) + 1
    assert max(counts.values()) == 3 and len(counts) == 8
    assert store.read("t").where("v = 'new'").count() == 101


def test_emptied_buckets_and_stray_rows(spark, store):
    every = Change(store.read("t").select("k"), lambda old: old.limit(0))
    store.commit(0, {"t": every})
    assert store.read("t").count() == 0 and set(store.places("t").values()) == {None}
    store.commit(1, {"t": set_to(spark, [5], "back")})
    assert rows(store.read("t")) == [(5, "back")]
    with pytest.raises(ValueError):  # a row of a bucket that the keys do not touch
        store.commit(2, {"t": Change(spark.createDataFrame([(5,)], "k int"), lambda old: spark.createDataFrame([(i, "x") for i in range(50)], "k int, v string"))})
    with pytest.raises(KeyError):
        store.read("nothing")


def test_rows_go_without_a_bucket_written_again(spark, store, monkeypatch):
    """What goes is noted beside the files, until a bucket has too many such parts; a null key goes like any other."""
    monkeypatch.setattr("cargolake.streaming.store.LAYERS", 3)
    base = files(f"{store.path}/t/store_version=0")
    want = {i: f"v{i}" for i in range(100)} | {None: "null key"}
    for batch, gone in enumerate([[1, 2, None, 500], [1, 3], [1, 4], [1, 5]]):
        more = spark.createDataFrame([(1, f"again {batch}"), (200 + batch, "new")], "k int, v string")
        keys = spark.createDataFrame([(k,) for k in gone], "gone long")
        assert store.commit(batch, {"t": Change(more=more, gone=keys)})
        want = {k: v for k, v in want.items() if k not in gone} | {1: f"again {batch}", 200 + batch: "new"}
        store = SnapshotStore(spark, store.path)  # as after a restart
        assert rows(store.read("t")) == sorted(want.items(), key=repr)
        assert files(f"{store.path}/t/store_version=0") == base
        assert any("store_version=0" in p for p in store.read("t", keys.limit(0).union(keys.where("gone = 1"))).inputFiles()) == (batch < 2)
    assert store.read("t", version=0).count() == 101 and store.read("t", version=1).where("k = 1").first().v == "again 0"
    store.commit(9, {"t": set_to(spark, [1], "whole")})  # a change that rewrites its buckets drops what they had noted
    assert rows(store.read("t")) == sorted((want | {1: "whole"}).items(), key=repr)


def test_commands_leave_the_stored_files(spark, tmp_path):
    """A batch writes what its commands change, not the buckets that they touch."""
    frame = lambda schema, row: spark.createDataFrame([row(i) for i in range(300)], schema)
    worker = workers.CommandWorker.start(
        spark, str(tmp_path / "s"), frame("record_id string, shipment_id long, status string", lambda i: (f"r{i}", i % 100, "SHIPPED" if i == 4 else "stored")),
        frame("delivery_id long, shipment_id long", lambda i: (i, i)), frame("shipment_id long, status string", lambda i: (i, "a")),
        frame("item_id string, shipment_id long", lambda i: (f"i{i}", i % 100)), str(tmp_path / "out"), 2)
    names = ("inventory", "deliveries", "shipments", "items")
    base = {n: set(worker.store.read(n).inputFiles()) for n in names}
    schema = "command_id string, command_type string, aggregate_id long, payload string"
    commands = [(f"{kind}{i}", kind, i, f'{{"shipment_id":"{i}"}}') for kind in ("inventory.release", "courier.unassign", "shipment.cancel") for i in (4, 5)]
    for number in (0, 1):
        worker.handle(spark.createDataFrame(commands, schema), number)
    for n in names:
        assert base[n] <= set(worker.store.read(n).inputFiles()), n
    assert {r.record_id for r in worker.store.read("inventory").where("status = 'received'").collect()} == {"r104", "r204", "r5", "r105", "r205"}
    assert worker.store.read("inventory").count() == 300
    assert [worker.store.read(n).count() for n in names[1:]] == [298, 298, 294]
    found = spark.read.parquet(f"{worker.out}/cancelled").select("batch", "result").distinct()
    assert rows(found) == [(0, "deleted"), (1, "shipment_not_found")]


# ---- S3

def test_split_stream_restarts_from_its_checkpoint(spark, tmp_path):
    uuid = "11111111-1111-1111-1111-11111111111"
    good = lambda i: (f'{{"event_id":"{uuid}{i}","event_type":"x","aggregate_id":"{uuid}{i}","aggregate_type":"shipment","payload":{{}},'  # noqa: E731
                      '"timestamp":"2024-01-01T00:00:00"}', "shipment.events", i)
    log, kept, bad, ckpt = (str(tmp_path / n) for n in ("log", "kept", "bad", "ckpt"))
    schema = "value string, topic string, offset long"
    for turn, batch in enumerate([[good(0), ("{", "t", 1)], [good(2), (None, "t", 3), ("[]", "t", 4)]]):
        add(spark, log, batch, schema)
        workers.split_stream(feeds.replay_files(spark, log, schema), kept, bad, ckpt)
        first = files(kept) if turn == 0 else first  # noqa: F821
    assert [r.event_id[-1] for r in spark.read.parquet(kept).orderBy("offset").collect()] == ["0", "2"]
    assert sorted((r.offset, r.reason) for r in spark.read.parquet(bad).collect()) == [(1, "bad_json"), (3, "bad_json"), (4, "bad_json")]
    assert {p: t for p, t in files(kept).items() if p in first} == first  # the first batch was not written again


# ---- T4

SAGAS = "saga_id long, saga_type string, shipment_id long, warehouse_id long, delivery_id long, status string, failed_step string"


def failure(eid, saga, minute, kind="delivery.failed"):
    return (eid, kind, "9", saga, '{"reason":"r"}', at(minute))


def compensate(spark, tmp_path, batches, hold=10):
    log, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    sagas = spark.createDataFrame([(1, "t", 5, 6, 7, "STARTED", None), (2, "t", 5, None, None, "started", None), (3, "t", 5, 6, 7, "COMPLETED", None)], SAGAS)
    empty = spark.createDataFrame([], EVENTS)
    worker = workers.Compensation.start(spark, str(tmp_path / "store"), sagas, empty.schema, str(tmp_path / "out"), 4, dt.timedelta(minutes=hold))
    for batch in batches:
        add(spark, log, batch, EVENTS)
        # a new process each time: only the folders are common
        worker = workers.Compensation(SnapshotStore(spark, worker.store.path), worker.out, worker.hold)
        worker.run(feeds.replay_files(spark, log, EVENTS), ckpt)
    return worker


def test_the_earliest_failure_fires_though_it_comes_late(spark, tmp_path):
    worker = compensate(spark, tmp_path, [
        [failure("b", 1, 20), failure("x", 9, 20), failure("n", None, 20)],
        [failure("a", 1, 15), failure("b", 1, 20), ("s", "shipment.created", "9", 4, "{}", at(24))],  # late, and one again
        [("s2", "shipment.created", "9", 4, "{}", at(60))],
        [failure("c", 1, 61), ("s3", "shipment.created", "9", 4, "{}", at(99))],
    ])
    read = lambda name: spark.read.parquet(f"{worker.out}/{name}")
    assert {r.event_id for r in read("commands").collect()} == {"a"}
    assert [r.status for r in worker.store.read("sagas").where("saga_id = 1").collect()] == ["FAILED"]
    assert worker.store.read("waiting", version=2).count() == 3  # until the watermark has passed the saga's first failure
    worker.finish()
    said = rows(read("outcomes").select("event_id", "outcome"))
    assert said == [("a", "fired"), ("b", "already_final"), ("c", "already_final"), ("n", "no_correlation"), ("x", "saga_not_found")]
    assert worker.store.read("waiting").count() == 0
    assert [(r.command_type, r.step) for r in read("commands").orderBy("step").collect()] == [
        ("courier.unassign", 0), ("inventory.release", 1), ("shipment.cancel", 2)]


def test_a_batch_that_comes_again_plans_nothing_twice(spark, tmp_path):
    worker = compensate(spark, tmp_path, [[failure("a", 1, 0), failure("z", 3, 5)], [failure("w", 2, 90)]], hold=1)
    held, version = files(worker.out), worker.store.version()
    again = spark.createDataFrame([failure("w", 2, 90)], EVENTS)
    worker.handle(again, worker.store.applied())
    assert files(worker.out) == held and worker.store.version() == version


def test_saga_table_of_the_moment_decides(spark, tmp_path):
    """A saga that another writer ends before the watermark passes is final when its failure is judged."""
    log, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    worker = compensate(spark, tmp_path, [[failure("a", 1, 0)]])
    done = spark.createDataFrame([(1,)], "saga_id long")
    worker.store.commit(None, {"sagas": Change(done, lambda old: old.withColumn("status", F.when(F.col("saga_id") == 1, "CANCELLED").otherwise(F.col("status"))))})
    add(spark, log, [("s", "shipment.created", "9", 4, "{}", at(60))], EVENTS)
    worker.run(feeds.replay_files(spark, log, EVENTS), ckpt)
    worker.finish()
    assert rows(spark.read.parquet(f"{worker.out}/outcomes").select("event_id", "outcome")) == [("a", "already_final")]


# ---- T6, U1

def test_command_worker(spark, tmp_path):
    inventory = spark.createDataFrame([("r1", 1, "stored"), ("r2", 1, "SHIPPED"), ("r3", 2, "stored")], "record_id string, shipment_id long, status string")
    deliveries = spark.createDataFrame([(1, 1), (2, 2)], "delivery_id long, shipment_id long")
    shipments = spark.createDataFrame([(1, "a"), (2, "b")], "shipment_id long, status string")
    items = spark.createDataFrame([("i1", 1), ("i2", 2), ("i3", 2)], "item_id string, shipment_id long")
    worker = workers.CommandWorker.start(spark, str(tmp_path / "s"), inventory, deliveries, shipments, items, str(tmp_path / "out"), 4)
    log, ckpt, schema = str(tmp_path / "log"), str(tmp_path / "ckpt"), "command_id string, command_type string, aggregate_id long, payload string"
    first = [("c1", "inventory.release", 1, '{"shipment_id":"1"}'), ("c2", "courier.unassign", 2, "{}"), ("c9", "ship.it", 1, "{}")]
    for batch in (first, [("c3", "shipment.cancel", 2, "{}"), ("c2", "courier.unassign", 2, "{}"), ("c4", "inventory.release", 8, '{"shipment_id":"x"}')]):
        add(spark, log, batch, schema)
        worker = workers.CommandWorker(SnapshotStore(spark, worker.store.path), worker.out)
        worker.run(feeds.replay_files(spark, log, schema), ckpt)
    worker.handle(spark.createDataFrame(first, schema), 0)  # again, after a failure of the stream: nothing
    assert worker.store.version() == 2
    assert rows(worker.store.read("inventory").select("record_id", "status")) == [("r1", "received"), ("r2", "SHIPPED"), ("r3", "stored")]
    assert rows(worker.store.read("deliveries")) == [(1, 1)] and rows(worker.store.read("shipments")) == [(1, "a")]
    assert rows(worker.store.read("items")) == [("i1", 1)]
    assert [r.command_id for r in spark.read.parquet(f"{worker.out}/unknown").collect()] == ["c9"]
    assert rows(spark.read.parquet(f"{worker.out}/released").select("command_id", "released_count", "refused_count", "warning")) == [
        ("c1", 1, 1, None), ("c4", 0, 0, "invalid_shipment_id")]
    assert rows(spark.read.parquet(f"{worker.out}/absent").select("command_id", "delivery_id")) == [("c2", 2)]


def test_a_late_change_does_not_overwrite_its_successor(spark, tmp_path):
    target = spark.createDataFrame([(1, "old", at(0), at(0)), (2, "old", at(0), at(0))], "shipment_id long, status string, created_at timestamp_ntz, updated_at timestamp_ntz")
    schema = "shipment_id long, status string, changed_at timestamp_ntz, change_seq long"
    worker = workers.UpsertWorker.start(spark, str(tmp_path / "s"), target, "shipment_id", ["status"], ["changed_at", "change_seq"],
                                        spark.createDataFrame([], schema).schema, "2024-02-01 00:00:00", 4)
    log, ckpt = str(tmp_path / "log"), str(tmp_path / "ckpt")
    for batch in ([(1, "b", at(5), 5), (3, "n", at(1), 1), (None, "x", at(1), 1)], [(1, "a", at(4), 9), (3, "m", at(1), 2)]):
        add(spark, log, batch, schema)
        workers.UpsertWorker(SnapshotStore(spark, worker.store.path), "target", "shipment_id", ["status"], ["changed_at", "change_seq"],
                             "2024-02-01 00:00:00").run(feeds.replay_files(spark, log, schema), ckpt)
    got = SnapshotStore(spark, worker.store.path).read("target")
    assert rows(got.select("shipment_id", "status")) == [(1, "b"), (2, "old"), (3, "m")]
    assert got.where("shipment_id = 2").first().updated_at == at(0)


# ---- T8

RECORD = "record_id long, shipment_id long, tx_hash string, status string, created_at timestamp_ntz, confirmed_at timestamp_ntz, block_number long, gas_used long, network string"
RECEIPT = "tx_hash string, block_number long, confirmations int, status string, gas_used long, block_time timestamp_ntz"


def test_records_wait_for_receipts_and_are_forgotten(spark, tmp_path):
    left, right, ckpt, sink = (str(tmp_path / n) for n in ("left", "right", "ckpt", "sink"))
    record = lambda i, m, s="PENDING": (i, 1, f"0x{i}", s, at(m), None, None, None, "n")
    receipt = lambda i, m, c=9, s="success": (f"0x{i}", i, c, s, 21, at(m))
    stages = [
        ([record(1, 0), record(2, 1), record(3, 2, "DROPPED"), record(4, 3)], [receipt(1, 5, 2), receipt(7, 6)]),
        ([record(7, 4), record(8, 20)], [receipt(1, 30), receipt(4, 200)]),  # 4's receipt is out of its hour
        ([record(9, 300)], [receipt(9, 301, s="failed")]),
        ([record(10, 600)], [receipt(99, 600)]),
        ([record(11, 601)], [receipt(98, 601)]),
    ]
    progress = []
    for some, answers in stages:
        add(spark, left, some, RECORD)
        add(spark, right, answers, RECEIPT)
        stream = workers.confirmations(feeds.replay_files(spark, left, RECORD), feeds.replay_files(spark, right, RECEIPT))
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        progress += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    out = spark.read.parquet(sink)
    final = {r.record_id: (r.transition, r.status) for r in workers.final_transitions(out).collect()}
    assert final[1] == ("confirmed", "CONFIRMED") and final[2] == ("no_receipt", "PENDING") and final[4] == ("no_receipt", "PENDING")
    assert final[7] == ("confirmed", "CONFIRMED") and final[8][0] == "no_receipt" and final[9] == ("failed", "FAILED") and 3 not in final
    assert max(progress) >= 5 and progress[-1] < max(progress)  # the join has let go of what can no longer match


# ---- late data, counters, state of finished sagas

def test_late_rows_are_those_that_the_engine_drops(spark, tmp_path):
    schema, delay = "id long, ts timestamp_ntz", dt.timedelta(minutes=10)
    log, kept, late, ckpt, other = (str(tmp_path / n) for n in ("log", "kept", "late", "ckpt", "other"))
    worker = workers.LateAudit.start(spark, str(tmp_path / "s"), kept, late, delay)
    dropped = 0
    for batch in ([(1, at(0)), (2, at(30))], [(3, at(20)), (4, at(19)), (5, at(60)), (6, None)], [(7, at(50)), (8, at(51)), (9, at(2))]):
        add(spark, log, batch, schema)
        worker = workers.LateAudit(SnapshotStore(spark, worker.store.path), kept, late, delay)
        worker.run(feeds.replay_files(spark, log, schema), ckpt)
        seen = feeds.as_event_time(feeds.replay_files(spark, log, schema)).withWatermark("ts", "10 minutes").dropDuplicates(["id", "ts"])
        q = (seen.writeStream.format("parquet").option("path", other).option("checkpointLocation", other + "-ckpt").trigger(availableNow=True).start())
        q.awaitTermination()
        dropped += sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"])
    audited = {r.id for r in spark.read.parquet(late).collect()}
    assert audited == {3, 4, 7, 9} and dropped == 4
    assert {r.id for r in spark.read.parquet(kept).collect()} | audited == set(range(1, 10))
    assert worker.store.read("marks").agg(F.sum("rows"), F.sum("late")).first()[:] == (9, 4)


def test_counter_increase_out_of_order_over_restarts(spark, tmp_path):
    schema = "service string, ts timestamp_ntz, value long"
    log, ckpt, delay = str(tmp_path / "log"), str(tmp_path / "ckpt"), dt.timedelta(minutes=10)
    worker = workers.CounterIncrease.start(spark, str(tmp_path / "s"), spark.createDataFrame([], schema).schema, delay, 2)
    batches = [[("a", at(0), 5), ("a", at(6), 9), ("b", at(1), 1)], [("a", at(3), 7), ("a", at(9), 2), ("a", at(30), 6)], [("b", at(40), 4), ("a", at(31), 1)]]
    for batch in batches:
        add(spark, log, batch, schema)
        worker = workers.CounterIncrease(SnapshotStore(spark, worker.store.path), delay)
        worker.run(feeds.replay_files(spark, log, schema), ckpt)
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    assert rows(worker.finish()) == rows(metrics.counter_increase(every)) == [("a", 2 + 2 + 2 + 4 + 1), ("b", 3)]


def test_state_of_finished_sagas_is_bounded(spark, tmp_path):
    schema = "event_id string, event_type string, aggregate_id string, correlation_id string, payload string, ts timestamp"
    log, ckpt, sink = (str(tmp_path / n) for n in ("log", "ckpt", "sink"))
    held = []
    for turn in range(6):
        batch = [(f"{kind}{turn}-{i}", name, "9", f"s{turn}-{i}", "{}", at(60 * turn + m))
                 for i in range(20) for kind, name, m in (("a", "shipment.created", 0), ("b", "delivery.completed", 1))]
        add(spark, log, batch, schema)
        stream = saga_state_machine(feeds.replay_files(spark, log, schema), "1 minute", 3600, keep_s=1800)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) <= 60 and spark.read.parquet(sink).where("status = 'COMPLETED'").count() == 120


def saga_turn(spark, tmp_path, name, batches, groups):
    """(all that is told, state rows held at most) of a log, one micro-batch for each list of events."""
    schema = "event_id string, event_type string, aggregate_id string, correlation_id string, payload string, ts timestamp"
    log, ckpt, sink = (str(tmp_path / f"{name}-{n}") for n in ("log", "ckpt", "sink"))
    held = [0]
    for batch in batches:
        add(spark, log, batch, schema)
        stream = saga_state_machine(feeds.replay_files(spark, log, schema), "1 minute", 600, groups=groups)
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
        held += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return rows(spark.read.parquet(sink)), max(held)


def test_many_sagas_share_a_call(spark, tmp_path):
    """Python is called once a group, not once a saga."""
    batch = [(f"{kind}{i}", name, "9", f"s{i}", "{}", at(m)) for i in range(300)
             for kind, name, m in (("a", "shipment.created", 0), ("b", "delivery.completed" if i % 3 else "delivery.failed", 1))]
    told, held = saga_turn(spark, tmp_path, "many", [batch], 4)
    assert held <= 4
    assert sum(r[2] == "COMPLETED" for r in told) == 200 and sum(r[2] == "FAILED" for r in told) == 100


def test_groups_do_not_change_what_is_told(spark, tmp_path):
    """Sagas that share a group keep their own states and times."""
    event = lambda k, name, m: (f"{k}{m}", name, "9", k, "{}", at(m))
    batches = [[event("a", "shipment.created", 0), event("a", "delivery.completed", 1), event("b", "shipment.created", 0)],
               [event("c", "shipment.created", 500)], [event("d", "shipment.created", 501)],
               [event("b", "delivery.failed", 502), event("a", "delivery.failed", 502), event("e", "delivery.failed", 502)]]
    alone, together = (saga_turn(spark, tmp_path, f"g{n}", batches, n)[0] for n in (1 << 13, 1))
    assert alone == together and {(r[0], r[1]) for r in together} >= {("b", "step_timeout"), ("a", "outcome"), ("b", "command"), ("e", "outcome")}


def test_sagas_of_the_snapshot_are_known(spark, tmp_path):
    sagas = spark.createDataFrame([(1, 5, 6, 7, "started", at(0), at(0)), (2, 5, None, None, "Completed", at(0), at(0))],
                                  "saga_id long, shipment_id long, warehouse_id long, delivery_id long, status string, started_at timestamp, updated_at timestamp")
    events = [("f1", "delivery.failed", "5", "1", "{}", at(3), None), ("f2", "delivery.failed", "5", "2", "{}", at(3), None),
              ("e0", "shipment.created", "5", "1", "{}", at(-9), None)]
    log = str(tmp_path / "log")
    df = loaded_sagas(sagas)
    df.unionByName(spark.createDataFrame(events, df.schema)).coalesce(1).write.parquet(log)
    feeds.run_available_now(saga_state_machine(feeds.replay_files(spark, log, df.schema)), str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    out = spark.read.parquet(str(tmp_path / "sink")).where("kind <> 'step_timeout'")
    assert {(r.kind, r.status, r.event_id) for r in out.collect()} == {
        ("command", "courier.unassign", "f1"), ("command", "inventory.release", "f1"), ("command", "shipment.cancel", "f1"),
        ("snapshot", "COMPENSATING", "f1"), ("snapshot", "FAILED", "f1"), ("outcome", "COMPLETED", "f2")}
