"""Streaming monitors drained over the events table; each has a batch twin as its check."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions.urls import cache_key
from quotelens.operators.planning import fold_state
from quotelens.plans.evidence import VIEWS, _split_columns, spark_sql_text, table, with_views
from quotelens.plans.registry import query
from quotelens.streaming import monitors as mo


def _attempts(spark, sf_dir):
    """Attempts as a stream: the same columns as the batch view, plus ``ts``."""
    ev = mo.read_events(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    select = spark_sql_text(VIEWS["attempts"]).split("SELECT", 1)[1].rsplit("FROM", 1)[0]
    return ev.selectExpr("ts", *_split_columns(select))


TRIP_CHECK = with_views(["attempts"], """
WITH e AS (SELECT host, CASE WHEN status IN (403,429) THEN 1 ELSE 0 END AS b, CASE WHEN status BETWEEN 500 AND 599 OR contains(reason,'request_error') THEN 1 ELSE 0 END AS s, row_number() OVER (PARTITION BY host ORDER BY ts_us, attempt_id) AS ord FROM attempts),
w AS (SELECT host, ord, count(*) OVER f AS n, sum(b) OVER f AS nb, sum(s) OVER f AS ns FROM e WINDOW f AS (PARTITION BY host ORDER BY ord ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CASE WHEN n >= 10 AND nb / n::DOUBLE >= 0.25 THEN printf('circuit_open_block_rate rate=%.3f threshold=%.3f window=%d', nb / n::DOUBLE, 0.25::DOUBLE, n)
    WHEN n >= 10 AND ns / n::DOUBLE >= 0.4 THEN printf('circuit_open_server_error_rate rate=%.3f threshold=%.3f window=%d', ns / n::DOUBLE, 0.4::DOUBLE, n) END AS why FROM w)
SELECT host AS key, min(ord) AS trip_event_no, arg_min(why, ord) AS open_reason FROM t WHERE why IS NOT NULL GROUP BY host""")


@query("live_circuit_breaker", TRIP_CHECK)
def live_circuit_breaker(spark, sf_dir):
    return mo.run_ordered(lambda a: mo.breaker_stream(a, "host", block_rate=0.25, server_rate=0.4), _attempts(spark, sf_dir))


QUARANTINE_CTE = """e AS (SELECT resource, attempt_id, ts_us, CASE WHEN status <> 200 THEN 1 ELSE 0 END AS f, row_number() OVER (PARTITION BY resource ORDER BY ts_us, attempt_id) AS ord FROM attempts),
s AS (SELECT *, coalesce(max(CASE WHEN f = 0 THEN ord END) OVER (PARTITION BY resource ORDER BY ord), 0) AS ok, min(CASE WHEN f = 0 THEN ts_us END) OVER (PARTITION BY resource ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS good FROM e),
q AS (SELECT resource AS key, attempt_id, ts_us AS from_us, ts_us + 300000000 AS until_us, good, lead(ts_us) OVER (PARTITION BY resource ORDER BY ord) AS again FROM s WHERE f = 1 AND (ord - ok) % 3 = 0),
t AS (SELECT *, least(coalesce(good, until_us), coalesce(again, until_us)) AS next FROM q)"""


@query("live_resource_quarantine", with_views(["attempts"], f"""WITH {QUARANTINE_CTE} SELECT key, attempt_id, until_us FROM q"""))
def live_resource_quarantine(spark, sf_dir):
    return _quarantines(spark, sf_dir).select("key", "attempt_id", "until_us")


@query("live_resource_availability", with_views(["attempts"], f"""WITH {QUARANTINE_CTE}
SELECT key, attempt_id, from_us, until_us, least(next, until_us) AS to_us, CASE WHEN until_us <= next THEN 'cooldown' WHEN good = next THEN 'success' ELSE 'extended' END AS ended FROM t"""))
def live_resource_availability(spark, sf_dir):
    """When each resource was out of use, and what ended it; a timer ends a cooldown, with or without further attempts."""
    return _quarantines(spark, sf_dir)


def _quarantines(spark, sf_dir):
    a = _attempts(spark, sf_dir).withColumn("failed", F.col("status") != 200)
    return mo.run_ordered(lambda x: mo.quarantine_stream(x, "resource"), a)


@query("live_host_pacing", with_views(["attempts"], """
WITH l AS (SELECT host, attempt_id, ts_us - lag(ts_us) OVER (PARTITION BY host ORDER BY ts_us, attempt_id) AS gap FROM attempts)
SELECT host AS key, attempt_id, 900000000 - greatest(gap, 0) AS wait_us FROM l WHERE gap < 900000000"""))
def live_host_pacing(spark, sf_dir):
    return mo.run_ordered(lambda a: mo.pacing_stream(a, "host", 900_000_000), _attempts(spark, sf_dir))


@query("live_gate_rates", with_views(["attempts"], """
SELECT CAST(floor(ts_us / 86400000000) AS BIGINT) * 86400000000 AS window_us, stage, count(*) AS total, count(*) FILTER (WHERE status IN (403,429)) AS blocked, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS server_errors,
 round(count(*) FILTER (WHERE status IN (403,429)) / count(*)::DOUBLE, 4) AS block_rate, round(count(*) FILTER (WHERE status BETWEEN 500 AND 599) / count(*)::DOUBLE, 4) AS server_error_rate FROM attempts GROUP BY 1, 2"""))
def live_gate_rates(spark, sf_dir):
    return mo.run_complete(mo.gate_rates(_attempts(spark, sf_dir), ["stage"]))


@query("live_sliding_gate_rates", with_views(["attempts"], """
WITH s AS (SELECT CAST(floor(ts_us / 43200000000) AS BIGINT) * 43200000000 - o * 43200000000 AS window_us, status FROM attempts, range(0, 2) r(o))
SELECT window_us, count(*) AS total, count(*) FILTER (WHERE status IN (403,429)) AS blocked, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS server_errors,
 round(count(*) FILTER (WHERE status IN (403,429)) / count(*)::DOUBLE, 4) AS block_rate, round(count(*) FILTER (WHERE status BETWEEN 500 AND 599) / count(*)::DOUBLE, 4) AS server_error_rate FROM s GROUP BY 1"""))
def live_sliding_gate_rates(spark, sf_dir):
    return mo.run_complete(mo.gate_rates(_attempts(spark, sf_dir), [], "24 hours", "12 hours"))


@query("live_rate_windows", with_views(["attempts"], """
SELECT CAST(floor(ts_us / 60000000) AS BIGINT) * 60000000 AS window_us, host, count(*) AS requests, count(*) > 0.02 * 60 AS over_limit FROM attempts GROUP BY 1, 2"""))
def live_rate_windows(spark, sf_dir):
    return mo.run_complete(mo.rate_windows(_attempts(spark, sf_dir), "host", 0.02, 60))


@query("live_request_bursts", with_views(["attempts"], """
WITH l AS (SELECT host, ts_us, CASE WHEN ts_us - lag(ts_us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS s FROM attempts WINDOW w AS (PARTITION BY host ORDER BY ts_us)),
g AS (SELECT *, sum(s) OVER (PARTITION BY host ORDER BY ts_us) AS b FROM l)
SELECT host, min(ts_us) AS burst_us, count(*) AS requests FROM g GROUP BY host, b"""))
def live_request_bursts(spark, sf_dir):
    return mo.run_complete(mo.request_bursts(_attempts(spark, sf_dir), "host", "1 hour"))


@query("live_progress", with_views(["attempts"], "SELECT unit_status, count(*) AS units FROM attempts GROUP BY unit_status"))
def live_progress(spark, sf_dir):
    return mo.run_complete(mo.live_progress(_attempts(spark, sf_dir)))


@query("live_distinct_units", with_views(["attempts"], "SELECT stage, count(DISTINCT unit_id) AS units FROM attempts GROUP BY stage"))
def live_distinct_units(spark, sf_dir):
    a = _attempts(spark, sf_dir).withColumn("stage_unit", F.concat_ws("::", "unit_id", "stage"))
    d = mo.run_append(mo.suppress_repeats(a, "stage_unit").select("stage", "stage_unit"))
    return d.groupBy("stage").agg(F.count(F.lit(1)).alias("units"))


@query("live_unit_state", with_views(["attempts"], """
WITH l AS (SELECT unit_id, max(attempt_id) FILTER (WHERE unit_status='completed') AS c, max(attempt_id) FILTER (WHERE unit_status='failed') AS f, max(attempt_id) FILTER (WHERE unit_status='skipped') AS s FROM attempts GROUP BY 1)
SELECT unit_id, CASE WHEN c IS NOT NULL THEN 'completed' WHEN f IS NOT NULL THEN 'failed' WHEN s IS NOT NULL THEN 'skipped' ELSE 'pending' END AS state, greatest(c, f, s) AS updated FROM l"""))
def live_unit_state(spark, sf_dir):
    log = mo.run_state_table(_attempts(spark, sf_dir).select("unit_id", F.col("attempt_id").alias("seq"), F.col("unit_status").alias("status")), every=1)
    return fold_state(log).select("unit_id", "state", "updated")


@query("live_page_snapshots", r"""
WITH p AS (SELECT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END AS key,
  page_id AS attempt_id, 1700000000000000 + page_id * 3600000000 AS from_us FROM pages),
n AS (SELECT *, from_us + 7 * 86400000000 AS expires_us, lead(from_us) OVER (PARTITION BY key ORDER BY from_us, attempt_id) AS next FROM p)
SELECT key, attempt_id, from_us, expires_us, CASE WHEN next <= expires_us THEN next ELSE expires_us END AS to_us, CASE WHEN next <= expires_us THEN 'replaced' ELSE 'expired' END AS ended FROM n""")
def live_page_snapshots(spark, sf_dir):
    """When each page snapshot was the fresh one: until the next one of its page, or until its time to live was over."""
    pages = mo.read_events(spark, sf_dir, "pages.parquet", table(spark, sf_dir, "pages").schema)
    captured = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("page_id") * 3_600_000_000)
    p = pages.select(cache_key(F.col("url")).alias("key"), captured.alias("ts"), F.col("page_id").alias("attempt_id"))
    return mo.run_ordered(lambda x: mo.snapshot_stream(x, "key", 7), p)
