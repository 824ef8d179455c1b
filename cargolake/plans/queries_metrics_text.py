"""Registered metric (A9, A10, M1-M10) and text-matcher (X1-X8, A11) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolake import schemas
from cargolake.operators import metrics as m
from cargolake.operators import text as x
from cargolake.plans.catalog import query
from cargolake.sources.fixtures import AS_OF_EVENTS as NOW

_T = f"timestamp '{NOW}'"
_B = schemas.LATENCY_BUCKETS
_HIST_SQL = ", ".join([f"count(*) FILTER (WHERE duration_s <= {b}) AS {m.bucket_name(b)}" for b in _B]
                      + ["count(duration_s) AS le_inf", "sum(duration_s) AS sum_s", "count(duration_s) AS count"])


def _quantile_sql(q: float) -> str:
    cols = m.BUCKET_COLS
    expr = f"{_B[-1]}"
    for i in reversed(range(len(_B))):
        lo_b = "0.0" if i == 0 else f"{_B[i - 1]}"
        lo_c = "0" if i == 0 else cols[i - 1]
        hi_c = cols[i]
        interp = f"({lo_b} + ({_B[i]} - {lo_b}) * ({q} * le_inf - {lo_c}) / ({hi_c} - {lo_c}))"
        expr = (f"CASE WHEN {hi_c} >= {q} * le_inf THEN (CASE WHEN {hi_c} = {lo_c} THEN {_B[i]} ELSE {interp} END) "
                f"ELSE {expr} END")
    return f"CASE WHEN le_inf > 0 THEN {expr} END"


@query("A9_request_counter", """
SELECT service, method, path, coalesce(status, 500) AS status, count(*) AS requests FROM http_log GROUP BY 1, 2, 3, 4""")
def a9(t):
    return m.request_counter(t.http_log)


@query("A10_duration_histogram", f"SELECT service, method, path, {_HIST_SQL} FROM http_log GROUP BY 1, 2, 3")
def a10(t):
    return m.duration_histogram(t.http_log).withColumn("sum_s", F.round("sum_s", 6))


# the oracle rounds sum_s the same way (floating sums differ in the last bits between engines)
from cargolake.plans.catalog import REGISTRY, Query  # noqa: E402
REGISTRY["A10_duration_histogram"] = Query(
    "A10_duration_histogram", a10,
    f"SELECT service, method, path, {_HIST_SQL.replace('sum(duration_s) AS sum_s', 'round(sum(duration_s), 6) AS sum_s')} "
    "FROM http_log GROUP BY 1, 2, 3")


@query("M8_histogram_quantiles", f"""
SELECT service, method, path, round({_quantile_sql(0.5)}, 9) AS p50_s, round({_quantile_sql(0.9)}, 9) AS p90_s,
       round({_quantile_sql(0.99)}, 9) AS p99_s
FROM (SELECT service, method, path, {_HIST_SQL} FROM http_log GROUP BY 1, 2, 3) h""")
def m8(t):
    h = m.duration_histogram(t.http_log)
    return h.select("service", "method", "path", *[F.round(m.histogram_quantile(q), 9).alias(n)
                                                   for q, n in ((0.5, "p50_s"), (0.9, "p90_s"), (0.99, "p99_s"))])


@query("M1_requests_per_second", """
SELECT service, time_bucket(interval 1 minute, ts) AS window_start, count(*) / 60.0 AS per_second
FROM http_log GROUP BY 1, 2""")
def m1(t):
    return m.requests_per_second(t.http_log).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("M2_errors_per_second", """
SELECT service, time_bucket(interval 1 minute, ts) AS window_start, count(*) / 60.0 AS per_second
FROM http_log WHERE status BETWEEN 500 AND 599 GROUP BY 1, 2""")
def m2(t):
    return (m.requests_per_second(t.http_log, only_5xx=True)
            .withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("M3_M4_latency_quantiles", f"""
SELECT service, window_start, round({_quantile_sql(0.99)} * 1000, 6) AS p99_ms, round({_quantile_sql(0.5)} * 1000, 6) AS p50_ms
FROM (SELECT service, window_start, {_HIST_SQL} FROM (
        SELECT service, duration_s, time_bucket(interval 1 minute, ts) - k * interval 1 minute AS window_start
        FROM http_log, (VALUES (0), (1), (2), (3), (4)) o(k)) s
      GROUP BY 1, 2) h""")
def m3(t):
    q = m.latency_quantiles(t.http_log)
    return q.select("service", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.round("p99_ms", 6).alias("p99_ms"), F.round("p50_ms", 6).alias("p50_ms"))


_UP_SAMPLES = "up_samples AS (SELECT service, ts, CASE WHEN status >= 500 THEN 0 ELSE 1 END AS up, row_number() OVER () AS seq FROM http_log)"


@query("M5_services_up", """
SELECT count(*) FILTER (WHERE up = 1) AS services_up FROM (
  SELECT service, arg_max(CASE WHEN status >= 500 THEN 0 ELSE 1 END, struct_pack(ts := ts, st := status)) AS up
  FROM http_log GROUP BY service)""")
def m5(t):
    samples = t.http_log.select("service", "ts", F.when(F.col("status") >= 500, 0).otherwise(1).alias("up"),
                                F.col("status").alias("seq"))
    return m.services_up(samples)


@query("M6_requests_last_hour", f"""
SELECT count(*) AS requests FROM http_log WHERE ts > {_T} - interval 1 hour AND ts <= {_T}""")
def m6(t):
    return m.requests_last_hour(t.http_log, NOW)


@query("M7_error_ratio", f"""
SELECT avg(CASE WHEN status BETWEEN 500 AND 599 THEN 100.0 ELSE 0.0 END) AS error_pct
FROM http_log WHERE ts > {_T} - interval 5 minute AND ts <= {_T}""")
def m7(t):
    return m.error_ratio(t.http_log, NOW)


@query("M9_counter_increase", """
WITH per_min AS (SELECT service, date_trunc('minute', ts) AS ts, count(*) AS n FROM http_log GROUP BY 1, 2),
s AS (SELECT service, ts, sum(n) OVER (PARTITION BY service, cast(ts as date) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM per_min),
l AS (SELECT *, lag(value) OVER (PARTITION BY service ORDER BY ts) AS prev FROM s)
SELECT service, cast(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) as bigint) AS increase
FROM l GROUP BY service""")
def m9(t):
    return m.counter_increase(m.counter_samples(t.http_log))


@query("M9_increase_last_day", f"""
WITH per_min AS (SELECT service, date_trunc('minute', ts) AS ts, count(*) AS n FROM http_log GROUP BY 1, 2),
s AS (SELECT service, ts, sum(n) OVER (PARTITION BY service, cast(ts as date) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM per_min),
l AS (SELECT *, lag(value) OVER (PARTITION BY service ORDER BY ts) AS prev FROM s WHERE ts > {_T} - interval 24 hour AND ts <= {_T})
SELECT service, cast(sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) as bigint) AS increase
FROM l GROUP BY service""")
def m9_window(t):
    return m.counter_increase(m.counter_samples(t.http_log), NOW, minutes=24 * 60)


@query("M10_http_rollup", """
SELECT service, method, path, count(*) AS requests, count(*) FILTER (WHERE status >= 500) AS failures,
       round(avg(round(duration_s * 1000, 2)), 2) AS avg_duration_ms, max(round(duration_s * 1000, 2)) AS max_duration_ms
FROM http_log GROUP BY 1, 2, 3""")
def m10(t):
    return m.http_rollup(t.http_log)


# ---- X: text matcher -------------------------------------------------------
# Parameters for the fixture run: the messages hold no Russian text, so the
# keyword sentences and stems are words of the fixture vocabulary.
DIM = 64
JOB_TEXT, MARKET_TEXT, MANAGER_TEXT = "the of and", "de la en", "der die und"
MARKET_STEMS, INTENT_STEMS, MANAGER_STEMS = ("der", "die"), ("the", "of"), ("und", "la")

_TOKS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]+')"


def _mean_sql(name: str, src: str, id_col: str, text_col: str) -> str:
    return f"""{name}_wc AS (SELECT {id_col} AS id, w AS word, count(*) AS n FROM (
      SELECT {id_col}, unnest({_TOKS.format(t=text_col)}) AS w FROM {src}) GROUP BY 1, 2),
{name}_kn AS (SELECT c.id, c.n, v.vec FROM {name}_wc c JOIN word_vectors v ON c.word = v.word),
{name}_tot AS (SELECT id, sum(n) AS total FROM {name}_kn GROUP BY id),
{name}_dims AS (SELECT id, n, unnest(vec) AS xv, generate_subscripts(vec, 1) AS d FROM {name}_kn),
{name} AS (SELECT k.id, k.d, sum(cast(k.xv as double) * k.n) / any_value(t.total) AS v
           FROM {name}_dims k JOIN {name}_tot t ON k.id = t.id GROUP BY k.id, k.d)"""


def _x_base_sql() -> str:
    refs = (f"kw AS (SELECT * FROM (VALUES ('job', '{JOB_TEXT}'), ('market', '{MARKET_TEXT}'), "
            f"('manager', '{MANAGER_TEXT}')) k(rid, text))")
    return f"""{refs},
{_mean_sql('mv', 'messages', 'message_id', 'text')},
{_mean_sql('rv', 'kw', 'rid', 'text')},
sims AS (
  SELECT m.id AS message_id, r.id AS rid,
         sum(m.v * r.v) AS dotp, sqrt(sum(m.v * m.v)) AS nm, sqrt(any_value(rn.nr)) AS nr
  FROM mv m JOIN rv r ON m.d = r.d
  JOIN (SELECT id, sum(v * v) AS nr FROM rv GROUP BY id) rn ON rn.id = r.id
  GROUP BY m.id, r.id),
cos AS (SELECT message_id, rid, CASE WHEN nm = 0 OR nr = 0 THEN 0.0 ELSE dotp / (nm * nr) END AS c FROM sims),
scores AS (
  SELECT msg.*, coalesce(max(c) FILTER (WHERE rid = 'job'), 0.0) AS job_intent_score,
         coalesce(max(c) FILTER (WHERE rid = 'market'), 0.0) AS marketplace_score,
         coalesce(max(c) FILTER (WHERE rid = 'manager'), 0.0) AS manager_role_score
  FROM messages msg LEFT JOIN cos ON msg.message_id = cos.message_id
  GROUP BY msg.username, msg.message_id, msg.text),
flags AS (
  SELECT *, ({' OR '.join(f"contains(lower(text), '{s}')" for s in MARKET_STEMS)}) AS has_marketplace,
            ({' OR '.join(f"contains(lower(text), '{s}')" for s in INTENT_STEMS)}) AS has_job_intent,
            ({' OR '.join(f"contains(lower(text), '{s}')" for s in MANAGER_STEMS)}) AS has_manager_role
  FROM scores),
an AS (
  SELECT *, least(job_intent_score * 0.3 + marketplace_score * 0.4 + manager_role_score * 0.3
                  + CASE WHEN has_marketplace THEN 0.3 ELSE 0.0 END + CASE WHEN has_job_intent THEN 0.2 ELSE 0.0 END
                  + CASE WHEN has_manager_role THEN 0.2 ELSE 0.0 END, 1.0) AS confidence
  FROM flags),
res AS (SELECT *, confidence >= 0.35 OR (has_marketplace AND has_job_intent) AS is_job_search FROM an)"""


def _analysed(t):
    return x.analyse(t.messages, t.word_vectors, DIM, JOB_TEXT, MARKET_TEXT, MANAGER_TEXT,
                     MARKET_STEMS, INTENT_STEMS, MANAGER_STEMS)


_R6 = ["job_intent_score", "marketplace_score", "manager_role_score", "confidence"]


_FLAGS = {"has_marketplace": x.MARKET_STEMS, "has_job_intent": x.INTENT_STEMS, "has_manager_role": x.MANAGER_STEMS}


@query("X4_keyword_flags", "SELECT message_id, " + ", ".join(
    "(" + " OR ".join(f"contains(lower(text), '{stem}')" for stem in stems) + f") AS {name}" for name, stems in _FLAGS.items()) + " FROM posts")
def x4(t):
    return t.posts.select("message_id", *[x.any_substring(F.col("text"), stems).alias(name) for name, stems in _FLAGS.items()])


@query("X7_nested_analysis", f"""
WITH {_x_base_sql()}
SELECT username, message_id, text, is_job_search, round(confidence, 6) AS confidence,
       round(job_intent_score, 6) AS scores_job_intent, round(marketplace_score, 6) AS scores_marketplace,
       round(manager_role_score, 6) AS scores_manager_role,
       has_marketplace AS flags_marketplace, has_job_intent AS flags_job_intent, has_manager_role AS flags_manager_role FROM res""")
def x7(t):
    n = x.nested(_analysed(t))
    return n.select("username", "message_id", "text", "is_job_search", F.round("confidence", 6).alias("confidence"),
                    *[F.round(f"scores.{c}", 6).alias(f"scores_{c}") for c in ("job_intent", "marketplace", "manager_role")],
                    *[F.col(f"flags.{c}").alias(f"flags_{c}") for c in ("marketplace", "job_intent", "manager_role")])


@query("X1_tokens", f"""
SELECT message_id, unnest({_TOKS.format(t='text')}) AS token FROM messages""")
def x1(t):
    return t.messages.select("message_id", F.explode(x.tokens("text")).alias("token"))


@query("X2_message_vectors", f"""
WITH {_mean_sql('mv', 'messages', 'message_id', 'text')}
SELECT msg.message_id, CASE WHEN count(mv.d) = 0 THEN list_transform(range({DIM}), lambda i: 0.0)
       ELSE list_transform(list(mv.v ORDER BY mv.d), lambda e: round(e, 6)) END AS vec
FROM messages msg LEFT JOIN mv ON msg.message_id = mv.id GROUP BY msg.message_id""")
def x2(t):
    v = x.mean_vectors(t.messages, "message_id", "text", t.word_vectors, DIM)
    return v.select("message_id", F.transform("vec", lambda e: F.round(e, 6)).alias("vec"))


@query("X3_X7_analyse", f"""
WITH {_x_base_sql()}
SELECT username, message_id, text, {', '.join(f'round({c}, 6) AS {c}' for c in _R6)},
       has_marketplace, has_job_intent, has_manager_role, is_job_search FROM res""")
def x37(t):
    a = _analysed(t)
    return a.select("username", "message_id", "text", *[F.round(c, 6).alias(c) for c in _R6],
                    "has_marketplace", "has_job_intent", "has_manager_role", "is_job_search")


@query("X8_matches", f"""
WITH {_x_base_sql()} SELECT message_id, username FROM res WHERE is_job_search""")
def x8a(t):
    return _analysed(t).where("is_job_search").select("message_id", "username")


@query("X8_preview", f"""
WITH {_x_base_sql()}
SELECT message_id, substr(text, 1, 60) AS preview FROM res WHERE NOT is_job_search ORDER BY message_id LIMIT 5""")
def x8b(t):
    return x.preview(_analysed(t))


@query("A11_matcher_summary", f"""
WITH {_x_base_sql()}
SELECT count(*) AS total, count(*) FILTER (WHERE is_job_search) AS matches,
       round(count(*) FILTER (WHERE is_job_search) / nullif(count(*), 0), 6) AS match_share,
       round(coalesce(avg(confidence) FILTER (WHERE is_job_search), 0.0), 6) AS mean_confidence FROM res""")
def a11(t):
    s = x.summary(_analysed(t))
    return s.select("total", "matches", F.round("match_share", 6).alias("match_share"),
                    F.round("mean_confidence", 6).alias("mean_confidence"))
