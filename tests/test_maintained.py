"""Maintained statistics equal a full recompute after any changes, and touch only the groups that change."""

import datetime as dt
import random

from pyspark.sql import functions as F

from cargolake.operators import stats
from cargolake.streaming import maintained
from cargolake.streaming.maintained import Maintained

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "saga_id int, saga_type string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, retry_count int"


def row(i):
    ended = random.random() < 0.6
    return (i, random.choice(["a", "b", "c", None]), random.choice(["started", "COMPLETED ", "FAILED", "CANCELLED"]), T0,
            T0 + dt.timedelta(microseconds=random.randint(0, 10 ** 10)) if ended else None, random.choice([0, 1, 2, 9, None]))


def told(df):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_equal_to_a_full_recompute(spark, tmp_path):
    random.seed(6)
    rows = {i: row(i) for i in range(60)}
    frame = lambda some: spark.createDataFrame(list(some), SCHEMA)
    state = Maintained.start(spark, str(tmp_path / "s"), frame(rows.values()), maintained.saga_statistic(), 4)
    for batch in range(3):
        changed = {i: row(i) for i in random.sample(range(60 + 10 * batch), 25)}
        gone = random.sample(sorted(rows), 8)
        before = [rows[i] for i in {*changed, *gone} if i in rows]
        after = [r for i, r in changed.items() if i not in gone]
        assert state.apply(batch, frame(before), frame(after))
        assert not state.apply(batch, frame(before), frame(after))  # again: nothing
        for i in {*changed, *gone}:
            rows.pop(i, None)
        rows.update({r[0]: r for r in after})
        columns = maintained.saga_statistics(state).columns
        assert told(maintained.saga_statistics(state)) == told(stats.saga_statistics(frame(rows.values())).select(*columns))


def test_extremes_are_taken_back_and_other_groups_stay(spark, tmp_path):
    rows = [(1, "a", "FAILED", T0, None, 9), (2, "a", "FAILED", T0, None, 3), (3, "b", "FAILED", T0, None, 1)]
    frame = lambda some: spark.createDataFrame(some, SCHEMA)
    state = Maintained.start(spark, str(tmp_path / "s"), frame(rows), maintained.saga_statistic(), 8)
    state.apply(0, frame(rows[:1]), frame([]))
    assert {r.saga_type: r.max_retry_count for r in maintained.saga_statistics(state).collect()} == {"a": 3, "b": 1}
    assert sum(v == 1 for v in state.store.places("sums").values()) == 1  # only the bucket of group a
    state.apply(1, frame(rows[1:]), frame([]))
    assert maintained.saga_statistics(state).count() == 0


def test_sums_of_long_durations_pass_a_long(spark, tmp_path):
    """Sagas that ended thirty years before their noted start, as a change set may have it."""
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("saga_id"), F.lit("a").alias("saga_type"), F.lit("FAILED").alias("status"),
                                      F.expr("timestamp_ntz '2024-01-01'").alias("started_at"), F.expr("timestamp_ntz '1994-01-01'").alias("completed_at"),
                                      F.lit(1).alias("retry_count"))
    state = Maintained.start(spark, str(tmp_path / "s"), rows, maintained.saga_statistic(), 2)
    state.apply(0, rows.where("saga_id < 10"), rows.where("saga_id < 10"))
    out = maintained.saga_statistics(state)
    assert [(r.total_sagas, r.failed, r.avg_duration_seconds) for r in out.collect()] == [(20_000, 20_000, -946684800.0)]
    assert dict(out.dtypes)["failed"] == "bigint"
