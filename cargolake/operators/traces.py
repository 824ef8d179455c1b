"""The trace of a correlation id, over events, commands and logs in the order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolake.functions.sequences import hour_chunk, keyed_position

CAP = 500  # steps of a trace that are gathered in one row


def steps(events: DataFrame, commands: DataFrame, logs: DataFrame) -> DataFrame:
    """One row a step: correlation_id, ts, kind, id, label.  Records without a correlation id are in no trace."""
    parts = [events.select("correlation_id", "ts", F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("label")),
             commands.select("correlation_id", "ts", F.lit("command").alias("kind"), F.col("command_id").cast("string").alias("id"), F.col("command_type").alias("label")),
             logs.select("correlation_id", "ts", F.lit("log").alias("kind"), F.col("line_id").cast("string").alias("id"),
                         F.concat_ws(" ", "level", "message").alias("label"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(F.col("correlation_id").isNotNull())


def assemble(rows: DataFrame, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(short traces gathered, long traces in row form) of ``steps``.

    Traces are counted first, with map-side combine; only those of at most ``cap`` steps are gathered into an array, so no
    task ever holds a longer one.  Long traces stay rows, numbered by hour chunks and a carry (``keyed_position``): a trace
    that holds a third of all rows is never sorted in one task.  There are at most rows / ``cap`` of them."""
    long_ids = rows.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("correlation_id")
    step = F.struct("ts", "kind", "id", "label")
    short = (rows.join(long_ids, "correlation_id", "left_anti").groupBy("correlation_id")
             .agg(F.array_sort(F.collect_list(step)).alias("steps"))
             .select("correlation_id", F.size("steps").alias("n_steps"), F.element_at("steps", 1)["ts"].alias("first_ts"),
                     F.element_at("steps", -1)["ts"].alias("last_ts"), "steps"))
    long = rows.join(long_ids, "correlation_id", "left_semi")
    return short, keyed_position(long, ["correlation_id"], ["ts", "kind", "id"], hour_chunk("ts"))
