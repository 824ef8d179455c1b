"""Request-metric analytics (A9, A10, M1-M10) over request rows.

Histograms are built in ONE pass: each fixed bucket bound is a conditional
count (the bound list is a constant of eight values), so no theta join or
explode is needed.  Quantiles (M8) are a closed-form ``when`` ladder over
the cumulative counts.  Rates are exact counts divided by the window length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.functions.common import ts_lit
from cargolake.functions.sequences import keyed_lag


def bucket_name(b: float) -> str:
    return "le_" + (f"{b:g}".replace(".", "_"))


BUCKET_COLS = [bucket_name(b) for b in schemas.LATENCY_BUCKETS] + ["le_inf"]


def request_counter(requests: DataFrame) -> DataFrame:
    """Requests by (service, method, path, status); no response = 500."""
    return (requests.groupBy("service", "method", "path",
                             F.coalesce(F.col("status"), F.lit(500)).alias("status"))
            .agg(F.count(F.lit(1)).alias("requests")))


def histogram_aggs(duration: Column) -> list[Column]:
    """Cumulative bucket counts, sum and count of one latency column."""
    aggs = [F.count_if(duration <= F.lit(b)).cast("bigint").alias(bucket_name(b)) for b in schemas.LATENCY_BUCKETS]
    aggs.append(F.count(duration).alias("le_inf"))
    aggs.append(F.sum(duration).alias("sum_s"))
    aggs.append(F.count(duration).alias("count"))
    return aggs


def duration_histogram(requests: DataFrame, by=("service", "method", "path")) -> DataFrame:
    """A10: cumulative histogram per label set (J12 as conditional counts)."""
    return requests.groupBy(*by).agg(*histogram_aggs(F.col("duration_s")))


def histogram_quantile(q: float, cols: list[str] = BUCKET_COLS) -> Column:
    """M8: PromQL histogram_quantile over cumulative bucket columns.
    rank = q * total; the first bucket whose cumulative count reaches rank
    is interpolated linearly from the previous bound (0 for the first);
    reaching only the +Inf bucket returns the largest finite bound; no
    observations -> null."""
    bounds = list(schemas.LATENCY_BUCKETS)
    total = F.col(cols[-1])
    rank = F.lit(q) * total
    expr = F.lit(bounds[-1])  # rank falls in +Inf
    for i in reversed(range(len(bounds))):
        lo_b = F.lit(0.0) if i == 0 else F.lit(bounds[i - 1])
        lo_c = F.lit(0).cast("bigint") if i == 0 else F.col(cols[i - 1])
        hi_b, hi_c = F.lit(bounds[i]), F.col(cols[i])
        interp = lo_b + (hi_b - lo_b) * (rank - lo_c) / (hi_c - lo_c)
        expr = F.when(hi_c >= rank, F.when(hi_c == lo_c, hi_b).otherwise(interp)).otherwise(expr)
    return F.when(total > 0, expr)


def requests_per_second(requests: DataFrame, window: str = "1 minute", seconds: int = 60,
                        only_5xx: bool = False) -> DataFrame:
    """M1/M2: exact event rate per service per tumbling window."""
    r = requests.where(F.col("status").between(500, 599)) if only_5xx else requests
    return (r.groupBy("service", F.window("ts", window).start.alias("window_start"))
            .agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("per_second")))


def latency_quantiles(requests: DataFrame, qs=(0.99, 0.5), window_minutes: int = 5, slide_minutes: int = 1) -> DataFrame:
    """M3/M4: latency quantiles in ms per service over sliding windows, from the
    bucket counts (not from raw values), as the dashboard does.  Requests are
    counted once per pane of a slide's length; only panes, not requests, are
    repeated for the windows that hold them."""
    panes = (requests.groupBy("service", F.window("ts", f"{slide_minutes} minutes").start.alias("pane"))
             .agg(*histogram_aggs(F.col("duration_s"))))
    return quantiles_of_panes(panes, qs, window_minutes, slide_minutes)


def _windows(pane: str, window_minutes: int, slide_minutes: int) -> Column:
    """The starts of the windows that hold a pane."""
    if window_minutes % slide_minutes:
        raise ValueError("the window must be a whole number of slides")
    return F.array(*[F.col(pane) - F.expr(f"interval {k * slide_minutes} minutes") for k in range(window_minutes // slide_minutes)])


def quantiles_of_panes(panes: DataFrame, qs=(0.99, 0.5), window_minutes: int = 5, slide_minutes: int = 1) -> DataFrame:
    """M3/M4 from the bucket counts of panes (service, pane, one column a bucket), which add up."""
    h = (panes.withColumn("window_start", F.explode(_windows("pane", window_minutes, slide_minutes))).groupBy("service", "window_start")
         .agg(*[F.sum(c).cast("bigint").alias(c) for c in BUCKET_COLS]))
    return h.select("service", "window_start", *[
        (histogram_quantile(q) * 1000).alias(f"p{int(round(q * 100))}_ms") for q in qs])


def error_ratio_of_panes(panes: DataFrame, window_minutes: int = 5, slide_minutes: int = 1) -> DataFrame:
    """M7 over sliding windows: 5xx share in % from the counts of panes (pane, errors, requests)."""
    h = (panes.withColumn("window_start", F.explode(_windows("pane", window_minutes, slide_minutes))).groupBy("window_start")
         .agg(F.sum("errors").alias("errors"), F.sum("requests").alias("requests")))
    return h.select("window_start", (F.lit(100.0) * F.col("errors") / F.col("requests")).alias("error_pct"))


def services_up(samples: DataFrame) -> DataFrame:
    """M5: number of services whose latest ``up`` sample is 1."""
    latest = samples.groupBy("service").agg(F.max_by("up", F.struct("ts", "seq")).alias("up"))
    return latest.agg(F.count_if(F.col("up") == 1).cast("bigint").alias("services_up"))


def requests_last_hour(requests: DataFrame, as_of: str) -> DataFrame:
    """M6: total requests in (as_of - 1 hour, as_of]."""
    now = ts_lit(as_of)
    return (requests.where((F.col("ts") > now - F.expr("interval 1 hour")) & (F.col("ts") <= now))
            .agg(F.count(F.lit(1)).alias("requests")))


def error_ratio(requests: DataFrame, as_of: str, minutes: int = 5) -> DataFrame:
    """M7: 5xx share in % over the last ``minutes``, over all services: one row,
    null without traffic.  The time range reaches the scan."""
    now = ts_lit(as_of)
    inside = (F.col("ts") > now - F.expr(f"interval {minutes} minutes")) & (F.col("ts") <= now)
    return (requests.where(inside)
            .agg(F.count_if(F.col("status").between(500, 599)).alias("_err"), F.count(F.lit(1)).alias("_all"))
            .select((F.lit(100.0) * F.col("_err") / F.nullif(F.col("_all"), F.lit(0))).alias("error_pct")))


def counter_samples(requests: DataFrame) -> DataFrame:
    """Counter-sample form of the request log: per (service, minute) the
    running request count since the start of the day (the process restarts
    daily, so the counter resets)."""
    from pyspark.sql import Window
    per_min = requests.groupBy("service", F.date_trunc("minute", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("service", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return per_min.select("service", "ts", F.sum("n").over(w).cast("bigint").alias("value"))


def counter_increase(samples: DataFrame, as_of: str | None = None, minutes: int = 60) -> DataFrame:
    """M9: total increase per series with reset handling: a negative step
    means the counter restarted, so the new value itself is the increase.
    The first sample of a series contributes nothing.  With ``as_of`` only the
    samples of the last ``minutes`` before it count."""
    if as_of is not None:
        now = ts_lit(as_of)
        samples = samples.where((F.col("ts") > now - F.expr(f"interval {int(minutes)} minutes")) & (F.col("ts") <= now))
    lagged = keyed_lag(samples, ["service"], ["ts"], ["value"], F.date_trunc("day", "ts"))
    step = (F.when(F.col("prev_value").isNull(), F.lit(0))
            .when(F.col("value") < F.col("prev_value"), F.col("value"))
            .otherwise(F.col("value") - F.col("prev_value")))
    return lagged.groupBy("service").agg(F.sum(step).cast("bigint").alias("increase"))


def http_rollup(requests: DataFrame) -> DataFrame:
    """Per (service, method, path) counts, failures (>= 500) and the
    request duration in ms rounded to two digits, as the HTTP log writes it."""
    ms = F.round(F.col("duration_s") * 1000, 2)
    return (requests.groupBy("service", "method", "path")
            .agg(F.count(F.lit(1)).alias("requests"),
                 F.count_if(F.col("status") >= 500).cast("bigint").alias("failures"),
                 F.round(F.avg(ms), 2).alias("avg_duration_ms"),
                 F.max(ms).alias("max_duration_ms")))
