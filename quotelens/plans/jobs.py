"""Queries over units, state, attempts and stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.operators import gates, planning
from quotelens.operators.skew import with_ordinal
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.registry import query
from quotelens.sources.stage_policies import DEFAULTS, default_policies

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

POLICIES_SQL = "policies(stage_order, stage, unit_budget, workers, max_inflight, max_rps, jitter_ms, retries, base_ms, max_ms, min_units, min_success_rate, max_block_rate, max_server_error_rate) AS (VALUES " + ", ".join(
    f"({r[0]}, '{r[1]}', {r[2]}, {r[5]}, {r[6]}, {r[7]}, {r[8]}, {r[9]}, {r[10]}, {r[11]}, {r[12]}, {r[13]}, {r[14]}, {r[15]})"
    for r in DEFAULTS
) + ")"


def _bool(text: str) -> str:
    return f"CAST({text} AS INTEGER)"


# ---- stage gates ------------------------------------------------------------------------------------------------

GATE_SQL = f"""
WITH {POLICIES_SQL}, g AS (
  SELECT stage,
    count(*) FILTER (WHERE unit_status IN ('completed','failed')) AS total,
    count(*) FILTER (WHERE unit_status = 'skipped') AS skipped,
    count(*) FILTER (WHERE unit_status = 'completed') AS successes,
    count(*) FILTER (WHERE unit_status IN ('completed','failed') AND status IN (403, 429)) AS blocked,
    count(*) FILTER (WHERE unit_status IN ('completed','failed') AND (status BETWEEN 500 AND 599 OR contains(reason, 'request_error'))) AS server_errors
  FROM attempts GROUP BY stage),
m AS (SELECT p.*, g.total, g.skipped, g.successes, g.blocked, g.server_errors,
    g.successes / g.total::DOUBLE AS sr, g.blocked / g.total::DOUBLE AS br, g.server_errors / g.total::DOUBLE AS er
  FROM policies p JOIN g USING (stage)),
v AS (SELECT *, CASE WHEN total < min_units THEN printf('stage_gate_min_units total=%d required=%d', total, min_units)
    WHEN sr < min_success_rate THEN printf('stage_gate_success_rate rate=%.3f required=%.3f', sr, min_success_rate::DOUBLE)
    WHEN br > max_block_rate THEN printf('stage_gate_block_rate rate=%.3f limit=%.3f', br, max_block_rate::DOUBLE)
    WHEN er > max_server_error_rate THEN printf('stage_gate_server_error_rate rate=%.3f limit=%.3f', er, max_server_error_rate::DOUBLE) END AS reason
  FROM m)
"""


def _gate_rows(spark, sf_dir):
    a = view(spark, sf_dir, "attempts")
    return a.select(
        "stage", F.col("unit_status").alias("status"), (F.col("unit_status") == "completed").alias("success"),
        gates.is_blocked(F.col("status")).alias("blocked"),
        gates.is_server_error(F.col("status"), F.col("reason")).alias("server_error"),
    )


@query("stage_gate_metrics", with_views(["attempts"], GATE_SQL + """
SELECT stage, total, skipped, successes, blocked, server_errors, round(sr, 4) AS success_rate, round(br, 4) AS block_rate,
       round(er, 4) AS server_error_rate, reason IS NULL AS passed, reason FROM v"""))
def stage_gate_metrics(spark, sf_dir):
    return gates.gate_metrics(_gate_rows(spark, sf_dir), default_policies(spark)).drop("stage_order")


@query("stage_rollout_report", with_views(["attempts"], GATE_SQL + """
SELECT stage_order, stage,
  CASE WHEN NOT coalesce(min(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 THEN 'not_reached'
       WHEN reason IS NULL THEN 'completed' ELSE 'failed' END AS stage_status,
  CASE WHEN NOT coalesce(min(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 THEN 'earlier_stage_failed'
       ELSE reason END AS stage_reason, total, skipped
FROM v"""))
def stage_rollout_report(spark, sf_dir):
    return gates.stage_report(gates.gate_metrics(_gate_rows(spark, sf_dir), default_policies(spark)))


@query("stage_http_runtime", with_views(["attempts"], f"""
WITH {POLICIES_SQL}, n AS (SELECT stage, count(*) AS attempts, count(DISTINCT floor(ts_us / 1000000)) AS busy_seconds FROM attempts GROUP BY stage)
SELECT p.stage AS name, greatest(0, ceil(1000.0 / greatest(max_rps, 0.1)))::INTEGER AS min_delay_ms, greatest(50, jitter_ms) AS jitter_ms,
  least(2, retries) AS max_retries, greatest(400, base_ms) AS backoff_base_ms, greatest(5000, max_ms) AS backoff_max_ms,
  greatest(1, least(workers, max_inflight)) AS pool_size, n.attempts,
  n.attempts * greatest(0, ceil(1000.0 / greatest(max_rps, 0.1)))::BIGINT AS least_total_ms
FROM policies p JOIN n USING (stage)"""))
def stage_http_runtime(spark, sf_dir):
    base = {"min_delay_ms": 0, "jitter_ms": 50, "max_retries": 2, "backoff_base_ms": 400, "backoff_max_ms": 5000}
    runtime = gates.http_runtime(default_policies(spark), base)
    n = view(spark, sf_dir, "attempts").groupBy(F.col("stage").alias("name")).agg(F.count(F.lit(1)).alias("attempts"))
    return runtime.join(n, "name").withColumn("least_total_ms", F.col("attempts") * F.col("min_delay_ms"))


# ---- breaker, quarantine, pacing ------------------------------------------------------------------------------------

@query("circuit_breaker_trips", with_views(["attempts"], """
WITH e AS (SELECT host, attempt_id, CASE WHEN status IN (403,429) THEN 1 ELSE 0 END AS b,
    CASE WHEN status BETWEEN 500 AND 599 OR contains(reason,'request_error') THEN 1 ELSE 0 END AS s,
    row_number() OVER (PARTITION BY host ORDER BY ts_us, attempt_id) AS ord,
    ts_us FROM attempts),
w AS (SELECT host, ord, count(*) OVER f AS n, sum(b) OVER f AS nb, sum(s) OVER f AS ns FROM e
    WINDOW f AS (PARTITION BY host ORDER BY ord ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CASE WHEN n >= 10 AND nb / n::DOUBLE >= 0.2 THEN printf('circuit_open_block_rate rate=%.3f threshold=%.3f window=%d', nb / n::DOUBLE, 0.2::DOUBLE, n)
    WHEN n >= 10 AND ns / n::DOUBLE >= 0.3 THEN printf('circuit_open_server_error_rate rate=%.3f threshold=%.3f window=%d', ns / n::DOUBLE, 0.3::DOUBLE, n) END AS why FROM w)
SELECT host, count(*) AS events, min(ord) FILTER (WHERE why IS NOT NULL) AS trip_event_no,
  arg_min(why, ord) FILTER (WHERE why IS NOT NULL) AS open_reason FROM t GROUP BY host"""))
def circuit_breaker_trips(spark, sf_dir):
    a = view(spark, sf_dir, "attempts")
    return gates.breaker_trips(a, "host", ["ts_us", "attempt_id"], F.floor(F.col("ts_us") / DAY_US))


@query("resource_quarantine", with_views(["attempts"], """
WITH e AS (SELECT resource, attempt_id, CASE WHEN status <> 200 THEN 1 ELSE 0 END AS f,
    row_number() OVER (PARTITION BY resource ORDER BY ts_us, attempt_id) AS ord FROM attempts),
s AS (SELECT *, coalesce(max(CASE WHEN f = 0 THEN ord END) OVER (PARTITION BY resource ORDER BY ord), 0) AS ok FROM e),
k AS (SELECT resource, attempt_id, CASE WHEN f = 1 THEN ord - ok ELSE 0 END AS failure_streak FROM s)
SELECT resource, attempt_id, failure_streak, failure_streak > 0 AND failure_streak % 3 = 0 AS quarantine_starts FROM k"""))
def resource_quarantine(spark, sf_dir):
    a = view(spark, sf_dir, "attempts")
    d = gates.quarantine_audit(a, "resource", ["ts_us", "attempt_id"], F.floor(F.col("ts_us") / DAY_US), F.col("status") != 200)
    return d.select("resource", "attempt_id", "failure_streak", "quarantine_starts")


@query("host_pacing_audit", with_views(["attempts"], """
WITH l AS (SELECT host, attempt_id, ts_us, lag(ts_us) OVER (PARTITION BY host ORDER BY ts_us, attempt_id) AS prev_us FROM attempts)
SELECT host, attempt_id, prev_us, greatest(ts_us - prev_us, 0) AS gap_us,
  CASE WHEN prev_us IS NULL THEN 0 ELSE greatest(900000000 - greatest(ts_us - prev_us, 0), 0) END AS wait_us FROM l"""))
def host_pacing_audit(spark, sf_dir):
    a = view(spark, sf_dir, "attempts")
    d = gates.pacing_gaps(a, "host", "ts_us", ["ts_us", "attempt_id"], F.floor(F.col("ts_us") / DAY_US), 900_000_000)
    return d.select("host", "attempt_id", "prev_us", "gap_us", "wait_us")


@query("rate_limit_compliance", with_views(["attempts"], """
SELECT host, CAST(floor(ts_us / 60000000) AS BIGINT) AS slot, count(*) AS requests, count(*) > 0.02 * 60 AS over_limit
FROM attempts GROUP BY ALL"""))
def rate_limit_compliance(spark, sf_dir):
    return gates.rate_compliance(view(spark, sf_dir, "attempts"), "host", "ts_us", 0.02, 60)


@query("retry_backoff_audit", with_views(["attempts"], """
SELECT attempt_id, status, status IN (408,425,429,500,502,503,504) AS retryable,
  CASE WHEN status IN (408,425,429,500,502,503,504) THEN least(400.0 * pow(2.0, attempt_id % 6), 5000.0) END AS backoff_ms FROM attempts"""))
def retry_backoff_audit(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").select("attempt_id", "status")
    return gates.retry_schedule(a, 400, 5000, F.col("attempt_id") % 6)


@query("attempt_flags_by_unit", with_views(["attempts"], """
SELECT unit_id, stage, max(CASE WHEN status IN (403,429) THEN 1 ELSE 0 END) AS blocked,
  max(CASE WHEN status BETWEEN 500 AND 599 OR contains(reason,'request_error') THEN 1 ELSE 0 END) AS server_error
FROM attempts GROUP BY ALL"""))
def attempt_flags_by_unit(spark, sf_dir):
    return gates.unit_events(view(spark, sf_dir, "attempts"), ["unit_id", "stage"])


@query("attempt_log_summary", with_views(["attempts"], """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY attempt_id) AS rn FROM attempts)
SELECT unit_id, count(*) AS attempt_count, min(attempt_id) FILTER (WHERE status BETWEEN 200 AND 299) AS selected_attempt,
  arg_max(reason, attempt_id) AS last_reason,
  CASE WHEN count(*) FILTER (WHERE status BETWEEN 200 AND 299) > 0 THEN 'replayed' ELSE 'exhausted' END AS decision,
  string_agg(CAST(status AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 8) AS first_statuses
FROM r GROUP BY unit_id"""))
def attempt_log_summary(spark, sf_dir):
    return gates.attempt_summary(view(spark, sf_dir, "attempts"), "unit_id", "attempt_id")


@query("run_progress", with_views(["attempts"], """
WITH p AS (SELECT count(*) AS processed, count(*) FILTER (WHERE unit_status='completed') AS completed,
  count(*) FILTER (WHERE unit_status='failed') AS failed, count(*) FILTER (WHERE unit_status='skipped') AS skipped,
  (max(ts_us) - min(ts_us)) / 1e6 AS el FROM attempts), n AS (SELECT count(*) * 2 AS total FROM orders)
SELECT processed, completed, failed, skipped, round(el, 3) AS elapsed_seconds, round(processed / el, 4) AS throughput_units_per_second,
  round(greatest(total - processed, 0) / (processed / el), 1) AS eta_seconds FROM p, n"""))
def run_progress(spark, sf_dir):
    total = table(spark, sf_dir, "orders").count() * 2
    return gates.progress(view(spark, sf_dir, "attempts"), total, "ts_us")


@query("worker_progress", with_views(["attempts"], """
SELECT host, resource, count(*) FILTER (WHERE unit_status='completed') AS ok, count(*) FILTER (WHERE unit_status='failed') AS fail
FROM attempts GROUP BY ALL"""))
def worker_progress(spark, sf_dir):
    return gates.worker_progress(view(spark, sf_dir, "attempts"), ["host", "resource"])


@query("state_counts", with_views(["units"], """
SELECT count(*) FILTER (WHERE state='completed') AS completed, count(*) FILTER (WHERE state='failed') AS failed,
  count(*) FILTER (WHERE state='skipped') AS skipped, count(*) FILTER (WHERE state IN ('completed','failed','skipped')) AS total FROM units"""))
def state_counts(spark, sf_dir):
    return gates.status_counts(view(spark, sf_dir, "units"))


# ---- planning -----------------------------------------------------------------------------------------------------------

@query("unit_identity", with_views(["units"], """
SELECT unit_no, 'unit_' || sha1('{"expected_currency":"EUR","expected_price":' ||
   CAST(CAST(expected_cents // 100 AS BIGINT) AS VARCHAR) || '.' || CASE WHEN expected_cents % 10 = 0 THEN CAST((expected_cents % 100) // 10 AS VARCHAR) ELSE lpad(CAST(expected_cents % 100 AS VARCHAR), 2, '0') END ||
   ',"options":{"format":"' || format || '","quantity":"' || quantity || '"},"product_type":"' || product_type ||
   '","site_name":"' || site_name || '","url":"' || url || '"}') AS unit_id FROM units"""))
def unit_identity(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    options = F.create_map(F.lit("quantity"), F.col("quantity"), F.lit("format"), F.col("format"))
    uid = planning.unit_id(
        F.col("url"), F.col("site_name"), F.col("product_type"), F.col("expected_currency"), F.col("expected_cents") / 100, options
    )
    return u.select("unit_no", uid.alias("unit_id"))


def _state_log(spark, sf_dir):
    """Attempts as a state event log per unit."""
    return view(spark, sf_dir, "attempts").select(
        F.regexp_replace("unit_id", "unit", "").cast("bigint").alias("unit_id"),
        F.col("attempt_id").alias("seq"), F.col("unit_status").alias("status"),
    )


@query("unit_state_fold", with_views(["attempts"], """
WITH l AS (SELECT CAST(replace(unit_id,'unit','') AS BIGINT) AS unit_id,
  max(attempt_id) FILTER (WHERE unit_status='completed') AS c, max(attempt_id) FILTER (WHERE unit_status='failed') AS f,
  max(attempt_id) FILTER (WHERE unit_status='skipped') AS s FROM attempts GROUP BY 1)
SELECT unit_id, c IS NOT NULL AS is_completed, f IS NOT NULL AND (c IS NULL OR f > c) AS is_failed,
  s IS NOT NULL AND s > greatest(coalesce(c,-1), coalesce(f,-1)) AS is_skipped,
  CASE WHEN c IS NOT NULL THEN 'completed' WHEN f IS NOT NULL THEN 'failed' WHEN s IS NOT NULL THEN 'skipped' ELSE 'pending' END AS state,
  greatest(c, f, s) AS updated FROM l"""))
def unit_state_fold(spark, sf_dir):
    return planning.fold_state(_state_log(spark, sf_dir))


@query("latest_state_rows", with_views(["attempts"], """
SELECT unit_id, arg_max(attempt_id, attempt_id) AS attempt_id, arg_max(status, attempt_id) AS status,
  arg_max(stage, attempt_id) AS stage FROM attempts GROUP BY unit_id"""))
def latest_state_rows(spark, sf_dir):
    log = view(spark, sf_dir, "attempts").select("unit_id", "attempt_id", "status", "stage")
    return planning.latest_rows(log, "unit_id", ["attempt_id"])


@query("resume_decisions", with_views(["units"], """
SELECT u.unit_no, CASE s.state WHEN 'completed' THEN 'already_completed' WHEN 'failed' THEN 'already_failed' END AS skip_reason,
  s.state IS NULL OR s.state NOT IN ('completed','failed') AS should_process
FROM units u LEFT JOIN (SELECT unit_no, state FROM units WHERE state <> 'pending') s USING (unit_no)"""))
def resume_decisions(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    state = u.filter("state <> 'pending'").select("unit_no", "state")
    return planning.resume_decisions(u.select("unit_no"), state, "unit_no")


@query("resume_pending_units", with_views(["units"], """
SELECT unit_no, url FROM units WHERE state <> 'completed'"""))
def resume_pending_units(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    return planning.pending_units(u.select("unit_no", "url"), u.select("unit_no", "state"), "unit_no", retry_failed=True)


@query("stage_unit_selection", with_views(["units"], """
SELECT unit_no, 'unit' || CAST(unit_no AS VARCHAR) || '::staging' AS stage_unit_id FROM (
  SELECT unit_no FROM units WHERE state <> 'completed' ORDER BY unit_no LIMIT 1000)"""))
def stage_unit_selection(spark, sf_dir):
    u = view(spark, sf_dir, "units").select("unit_no", "state")
    consumed = u.filter("state = 'completed'")
    chosen = planning.select_stage_units(u, consumed, 1000, ["unit_no"], "unit_no")
    uid = F.concat(F.lit("unit"), F.col("unit_no").cast("string"))
    return chosen.select("unit_no", planning.stage_unit_id(uid, F.lit("staging")).alias("stage_unit_id"))


@query("repeat_first_unit", with_views(["units"], """
SELECT unit_no, repeat_no::INTEGER AS repeat_no, 'unit' || CAST(unit_no AS VARCHAR) || '::single_config::' || CAST(repeat_no AS VARCHAR) AS stage_unit_id
FROM (SELECT min(unit_no) AS unit_no FROM units), range(1, 4) t(repeat_no)"""))
def repeat_first_unit(spark, sf_dir):
    d = planning.repeat_first_unit(view(spark, sf_dir, "units").select("unit_no"), 3, ["unit_no"])
    uid = F.concat(F.lit("unit"), F.col("unit_no").cast("string"))
    return d.select("unit_no", "repeat_no", planning.stage_unit_id(uid, F.lit("single_config"), F.col("repeat_no")).alias("stage_unit_id"))


@query("combined_manifest_sites", with_views(["units"], """
SELECT site_name, product_type, count(*) AS n_units, count(generated) AS n_generated FROM (
  SELECT site_name, product_type, NULL AS generated FROM units UNION ALL
  SELECT 'gen-' || s_name, 'flyer', 1 FROM supplier) GROUP BY ALL"""))
def combined_manifest_sites(spark, sf_dir):
    u = view(spark, sf_dir, "units").select("site_name", "product_type")
    gen = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("gen-"), F.col("s_name")).alias("site_name"), F.lit("flyer").alias("product_type"), F.lit(1).alias("generated")
    )
    return planning.combine_manifests(u, gen).groupBy("site_name", "product_type").agg(
        F.count(F.lit(1)).alias("n_units"), F.count("generated").alias("n_generated")
    )


@query("unpriced_unit_quantities", """
WITH q AS (SELECT p_partkey, p_brand, quantity FROM part, (VALUES (25),(50),(100),(250),(500),(1000)) t(quantity)),
d AS (SELECT DISTINCT l_partkey, CAST(l_quantity AS INTEGER) * 25 AS quantity FROM lineitem WHERE l_returnflag <> 'R'
      UNION SELECT DISTINCT l_partkey, CAST(l_quantity AS INTEGER) * 50 FROM lineitem WHERE l_returnflag = 'R')
SELECT p_brand, quantity, count(*) AS open_units FROM q WHERE NOT EXISTS (
  SELECT 1 FROM d WHERE d.l_partkey = q.p_partkey AND d.quantity = q.quantity) GROUP BY ALL""")
def unpriced_unit_quantities(spark, sf_dir):
    units = planning.expand_quantities(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), [25, 50, 100, 250, 500, 1000])
    li = table(spark, sf_dir, "lineitem")
    pair = lambda f: [F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity").cast("int") * f).alias("quantity")]
    done = li.filter("l_returnflag <> 'R'").select(*pair(25))
    failed = li.filter("l_returnflag = 'R'").select(*pair(50))
    skip = planning.skip_pairs(done, failed, ["p_partkey", "quantity"])
    return units.join(skip, ["p_partkey", "quantity"], "left_anti").groupBy("p_brand", "quantity").agg(
        F.count(F.lit(1)).alias("open_units")
    )


@query("round_robin_chunks", """
SELECT p_brand, p_partkey, CAST((row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 3 AS INTEGER) AS chunk_no FROM part""")
def round_robin_chunks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return planning.round_robin(p, ["p_brand"], ["p_partkey"], F.floor(F.col("p_partkey") / 10_000), 3)


@query("merged_unit_options", with_views(["units"], """
SELECT unit_no, CASE WHEN unit_no % 3 = 0 THEN '999' ELSE quantity END AS quantity, format,
  CASE WHEN unit_no % 2 = 0 THEN 'matt' ELSE 'gloss' END AS finish,
  CASE WHEN unit_no % 3 = 0 THEN 'int' ELSE 'int' END AS quantity_type FROM units"""))
def merged_unit_options(spark, sf_dir):
    from quotelens.functions.text import option_value_type

    u = view(spark, sf_dir, "units")
    none = F.create_map().cast("map<string,string>")
    pair_text = F.when(F.col("unit_no") % 3 == 0, F.lit("quantity= 999")).otherwise(F.lit("broken"))
    pair = planning.split_option_pair(pair_text)
    pairs = F.when(pair.isNotNull(), F.create_map(pair["key"], pair["value"])).otherwise(none)
    json_options = F.when(F.col("unit_no") % 2 == 0, F.from_json(F.lit('{"finish":"matt"}'), "map<string,string>"))
    file_options = F.create_map(F.lit("finish"), F.lit("gloss"))
    spec = F.create_map(F.lit("quantity"), F.col("quantity"), F.lit("format"), F.col("format"))
    m = planning.merge_options(pairs, json_options, file_options, spec)
    d = u.select("unit_no", m.alias("m"))
    q = F.col("m")["quantity"]
    return d.select("unit_no", q.alias("quantity"), F.col("m")["format"].alias("format"), F.col("m")["finish"].alias("finish"),
                    option_value_type(q).alias("quantity_type"))


@query("attempt_ordinals", with_views(["attempts"], """
SELECT stage, attempt_id, row_number() OVER (PARTITION BY stage ORDER BY ts_us, attempt_id) AS ordinal FROM attempts"""))
def attempt_ordinals(spark, sf_dir):
    a = view(spark, sf_dir, "attempts").select("stage", "attempt_id", "ts_us")
    return with_ordinal(a, ["stage"], ["ts_us", "attempt_id"], F.floor(F.col("ts_us") / DAY_US)).drop("ts_us")
