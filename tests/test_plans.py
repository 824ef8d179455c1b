"""Plan checks: no window over one partition, no pair joins, no Python in batch
plans; filters and pruning reach the scan."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.operators import reads
from cargolake.operators.writes import write_snapshot
from cargolake.plans.catalog import spark_callables

SF = "/root/testdata/sf0.001"
STREAMS = {"S8_S9_log_replay", "T12_stream_dedup", "T5_saga_state_machine", "M1_stream_request_rate",
           "A5_stream_daily_blockchain", "T5_saga_final_states"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def global_windows(plan):
    """Windows whose rows come from an exchange into one partition.  The table of
    counts that stitches the chunks of a sequence (one row a chunk) is none."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if "Window [" in line and "Window [sum(_n" not in line:
            below = next((x for x in lines[i + 1:] if "Exchange" in x), "")
            if "SinglePartition" in below:
                found.append(line)
    return found


def pair_joins(plan):
    return [x for x in plan.splitlines() if "CartesianProduct" in x or "BroadcastNestedLoopJoin" in x]


def test_the_checks_can_fail(spark):
    rows = spark.range(10)
    assert global_windows(_plan(rows.withColumn("n", F.row_number().over(Window.orderBy("id")))))
    assert not global_windows(_plan(rows.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("id")))))
    assert pair_joins(_plan(rows.crossJoin(spark.range(3).withColumnRenamed("id", "other"))))


@pytest.mark.parametrize("name", sorted(set(spark_callables()) - STREAMS))
def test_no_python_no_global_window_no_pair_join(spark, name):
    plan = _plan(spark_callables()[name](spark, SF))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" not in plan
    assert global_windows(plan) == []
    assert pair_joins(plan) == []


@pytest.mark.parametrize("name, pushed", [
    ("M6_requests_last_hour", "GreaterThan(ts,"), ("M7_error_ratio", "GreaterThan(ts,")])
def test_filters_reach_the_scan(spark, name, pushed):
    queries = spark_callables()
    scans = [x for x in _plan(queries[name](spark, SF)).splitlines() if "PushedFilters" in x]
    assert any(pushed in x for x in scans)


@pytest.mark.parametrize("read, pushed", [
    (lambda s: reads.by_status(s, "in_transit"), "EqualTo(status,IN_TRANSIT)"),
    (lambda s: reads.in_statuses(s, schemas.DELIVERY_ACTIVE), "In(status, ["),
    (lambda s: reads.oldest_pending(s.withColumnRenamed("delivery_id", "record_id")), "EqualTo(status,PENDING)")])
def test_status_filters_reach_the_scan_of_a_stored_snapshot(spark, tmp_path, read, pushed):
    rows = spark.createDataFrame([(1, " in_transit "), (2, "Pending"), (3, "lost"), (4, None)], "delivery_id long, status string")
    rows = rows.withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    stored = spark.read.parquet(write_snapshot(rows, str(tmp_path), 1))
    assert read(stored).count() == read(rows).count() == 1
    assert pushed in _plan(read(stored)) and pushed not in _plan(read(rows))


def test_settled_records_meet_no_join(spark):
    plan = _plan(spark_callables()["T8_confirmation_tracking"](spark, SF))
    assert "Union" in plan and "= PENDING" in plan


def test_only_the_needed_columns_are_read(spark):
    plan = _plan(spark_callables()["P15_points_in_box"](spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan


def test_unnamed_couriers_meet_no_join(spark):
    from cargolake.operators.writes import delivery_patch
    from cargolake.sources.tables import Tables
    t = Tables(spark, SF)
    _, rejected = delivery_patch(t.deliveries, t.delivery_patches, t.couriers, "2024-01-30 12:00:00")
    assert rejected.where("courier_id IS NULL AND reason = 'courier_not_found'").count() == 0
