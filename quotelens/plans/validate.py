"""Queries that validate runs, learn rules and report drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.operators import knowledge as kn
from quotelens.operators import validate as va
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.registry import query
from quotelens.plans.resolve import CATALOG_CTE, _outcomes


@query("accepted_configuration", with_views(["traces"], """
WITH b AS (SELECT trace_idx, response_body_preview AS j FROM traces WHERE json_valid(response_body_preview) AND response_body_preview LIKE '{%'),
l AS (SELECT trace_idx, it.value AS o, it.rowid AS n FROM b, LATERAL json_each(j) f, LATERAL json_each(CASE WHEN f.type = 'ARRAY' THEN f.value ELSE '[]' END) it)
SELECT trace_idx, o->>'$.name' AS option_key, o->>'$.value' AS accepted_value, 'pair' AS kind FROM l WHERE (o->>'$.name') IS NOT NULL AND (o->>'$.value') IS NOT NULL
UNION ALL SELECT trace_idx, 'propertyId:' || (o->>'$.propertyid'), o->>'$.value', 'property' FROM l WHERE (o->>'$.propertyid') IS NOT NULL AND (o->>'$.value') IS NOT NULL""".replace(", it.rowid AS n", "")))
def accepted_configuration(spark, sf_dir):
    return va.accepted_options(view(spark, sf_dir, "traces"), ["trace_idx"], "response_body_preview").filter("kind <> 'key'")


def _compared(spark, sf_dir):
    """Requested options of the units whose trace reports a configuration, against that report."""
    t = view(spark, sf_dir, "traces")
    accepted = va.accepted_options(t, ["trace_idx"], "response_body_preview", only=["quantity", "format"]).withColumnRenamed("trace_idx", "unit_no")
    u = view(spark, sf_dir, "units")
    rows = F.explode(F.array(F.struct(F.lit("quantity").alias("key"), F.col("quantity").alias("value")), F.struct(F.lit("format").alias("key"), F.col("format").alias("value"))))
    requested = u.select("unit_no", rows.alias("o")).select("unit_no", "o.key", "o.value")
    return va.compare_options(requested, accepted, ["unit_no"])


COMPARED_CTE = """fact AS (SELECT trace_idx AS unit_no, it.value->>'$.name' AS k, it.value->>'$.value' AS acc FROM traces, LATERAL json_each(CASE WHEN json_valid(response_body_preview) AND trace_idx % 10 = 5 THEN json_extract(response_body_preview, '$.configuration') ELSE '[]' END) it
  UNION ALL SELECT trace_idx, 'quantity', response_body_preview->>'$.price_matrix[1].quantity' FROM traces WHERE trace_idx % 10 = 0),
rq AS (SELECT unit_no, 'quantity' AS key, quantity AS value FROM units UNION ALL SELECT unit_no, 'format', format FROM units),
cm AS (SELECT rq.unit_no, key, value, coalesce(acc, value) AS accepted_value FROM rq LEFT JOIN fact ON fact.unit_no = rq.unit_no AND fact.k = rq.key),
cp AS (SELECT *, lower(trim(value)) = lower(trim(accepted_value)) OR (key = 'quantity' AND TRY_CAST(regexp_extract(value, '[0-9]+') AS BIGINT) = TRY_CAST(regexp_extract(accepted_value, '[0-9]+') AS BIGINT))
  OR (key = 'format' AND regexp_full_match(upper(value), 'A[0-9]+') AND contains(upper(accepted_value), upper(value))) AS matches FROM cm)"""


@query("requested_vs_accepted", with_views(["traces", "units"], f"""WITH {COMPARED_CTE}
SELECT unit_no, key, value, accepted_value, coalesce(matches, false) AS matches, CASE WHEN NOT coalesce(matches, false) THEN 'config_normalized key=' || key || ' requested=' || value || ' accepted=' || accepted_value END AS mismatch FROM cp"""))
def requested_vs_accepted(spark, sf_dir):
    return _compared(spark, sf_dir)


UNIT_CTE = """un AS (SELECT unit_no, priority, expected_cents / 100.0::DOUBLE AS expected_price, CASE WHEN unit_no % 11 = 0 THEN NULL WHEN unit_no % 7 = 0 THEN (expected_cents + 500) / 100.0::DOUBLE ELSE expected_cents / 100.0::DOUBLE END AS price,
  unit_no % 2 = 0 AS request_only, CASE unit_no % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'adapter' ELSE 'captured_trace' END AS replay_mode, CASE WHEN unit_no % 13 = 0 THEN 'heuristic' ELSE 'none' END AS fallback_mode,
  CASE WHEN unit_no % 17 = 0 THEN 2 ELSE 0 END AS synthesis_issues, CASE WHEN unit_no % 19 = 0 THEN 1 ELSE 0 END AS unmatched_required FROM units)"""


def _validated(spark, sf_dir):
    u = view(spark, sf_dir, "units").selectExpr(
        "unit_no", "priority", "expected_cents / 100 AS expected_price", "0.01D AS tolerance",
        "CASE WHEN unit_no % 11 = 0 THEN NULL WHEN unit_no % 7 = 0 THEN (expected_cents + 500) / 100 ELSE expected_cents / 100 END AS price",
        "unit_no % 11 <> 0 AS success", "unit_no % 2 = 0 AS request_only", "CASE unit_no % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'adapter' ELSE 'captured_trace' END AS replay_mode",
        "CASE WHEN unit_no % 13 = 0 THEN 'heuristic' ELSE 'none' END AS fallback_mode", "CASE WHEN unit_no % 17 = 0 THEN 2 ELSE 0 END AS synthesis_issues", "'paper' AS synthesis_keys",
        "CASE WHEN unit_no % 19 = 0 THEN 1 ELSE 0 END AS unmatched_required", "'cover' AS unmatched_keys",
    )
    return va.validate_runs(u, _compared(spark, sf_dir), ["unit_no"])


VALID_CTE = f"""{COMPARED_CTE}, {UNIT_CTE},
mm AS (SELECT unit_no, list_sort(list('config_normalized key=' || key || ' requested=' || value || ' accepted=' || accepted_value) FILTER (WHERE NOT coalesce(matches, false))) AS cfg,
  max(CASE WHEN key = 'quantity' AND NOT coalesce(matches, false) THEN 'quantity_normalized requested=' || value || ' accepted=' || accepted_value END) AS qn FROM cp GROUP BY unit_no),
vx AS (SELECT un.*, coalesce(cfg, []) AS cfg, qn, price IS NULL AS np, request_only AND replay_mode = 'captured_trace' AS wm, request_only AND fallback_mode <> 'none' AS uf, request_only AND synthesis_issues > 0 AS sy, price IS NOT NULL AND abs(expected_price - price) > 0.01 AS off FROM un JOIN mm USING (unit_no)),
vl AS (SELECT *, np::INT + wm::INT + uf::INT + sy::INT + np::INT + off::INT + (qn IS NOT NULL)::INT + len(cfg) + unmatched_required AS n_mismatches,
  CASE WHEN off THEN 'payload_or_normalization_mismatch' WHEN np AND wm THEN 'request_only_http_replay_failed' WHEN np THEN 'price_not_extracted' WHEN wm OR uf THEN 'request_only_violation' WHEN sy THEN 'request_only_option_synthesis_failed'
   WHEN len(cfg) > 0 THEN 'server_normalized_configuration' WHEN unmatched_required > 0 THEN 'required_options_unmatched' END AS failure_reason,
  array_to_string(list_filter(list_concat([CASE WHEN np THEN 'price_not_extracted' END, CASE WHEN wm THEN 'request_only_replay_mismatch expected=http_or_adapter actual=captured_trace' END, CASE WHEN uf THEN 'request_only_fallback_used fallback=heuristic' END, qn], cfg), lambda x: x IS NOT NULL), '; ') AS shown FROM vx)"""


@query("validated_runs", with_views(["traces", "units"], f"WITH {VALID_CTE} SELECT unit_no, n_mismatches = 0 AS is_valid, n_mismatches, failure_reason, shown FROM vl"))
def validated_runs(spark, sf_dir):
    d = _validated(spark, sf_dir)
    shown = F.filter("mismatches", lambda m: m.rlike("^(price_not|request_only_(replay|fallback)|quantity_norm|config_norm)"))
    return d.select("unit_no", "is_valid", F.size("mismatches").alias("n_mismatches"), "failure_reason", F.array_join(shown, "; ").alias("shown"))


@query("repair_plans", with_views(["traces", "units"], f"""WITH {VALID_CTE} SELECT unit_no, CASE failure_reason WHEN 'payload_or_normalization_mismatch' THEN 'hybrid' WHEN 'server_normalized_configuration' THEN 'direct_http' ELSE 'browser_automation' END AS next_strategy,
 CASE failure_reason WHEN 'payload_or_normalization_mismatch' THEN 0.85 WHEN 'server_normalized_configuration' THEN 0.8 ELSE 0.4 END AS next_confidence,
 CASE failure_reason WHEN 'payload_or_normalization_mismatch' THEN 'strict_validation' WHEN 'server_normalized_configuration' THEN 'dependent_options_added' ELSE 'unknown_failure' END AS next_note FROM vl WHERE n_mismatches > 0"""))
def repair_plans(spark, sf_dir):
    d = _validated(spark, sf_dir).withColumn("strategy", F.lit("direct_http")).withColumn("plan_confidence", F.lit(0.75))
    return va.next_plan(d).select("unit_no", "next_strategy", "next_confidence", "next_note")


@query("run_summaries", with_views(["traces", "units"], f"""WITH {VALID_CTE}, rf AS (SELECT unit_no, CAST(floor(expected_cents / 100) AS DOUBLE) AS r FROM units WHERE unit_no % 4 <> 0)
SELECT unit_no, CASE WHEN n_mismatches = 0 THEN 'completed' ELSE 'failed' END AS final_status, price, CAST(round(CAST(price AS DECIMAL(18,2)) - CAST(r AS DECIMAL(18,2)), 2) AS DOUBLE) AS site_price_delta,
 abs(CAST(price AS DECIMAL(18,2)) - CAST(r AS DECIMAL(18,2))) <= 0.01 AS site_price_within_tolerance, CASE WHEN r IS NULL THEN 'none' ELSE 'named_total' END AS reference_kind FROM vl LEFT JOIN rf USING (unit_no)"""))
def run_summaries(spark, sf_dir):
    ref = view(spark, sf_dir, "units").filter("unit_no % 4 <> 0").selectExpr("unit_no", "CAST(floor(expected_cents / 100) AS DOUBLE) AS reference_price", "'named_total' AS reference_kind")
    d = va.summarize(_validated(spark, sf_dir), ref, ["unit_no"])
    return d.select("unit_no", "final_status", "price", "site_price_delta", "site_price_within_tolerance", "reference_kind")


@query("synthesis_issue_summary", """
WITH k AS (SELECT l_suppkey, 'p' || CAST(l_partkey % 20 AS VARCHAR) AS k FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT l_suppkey, k, row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS rn FROM (SELECT DISTINCT * FROM k))
SELECT n.l_suppkey, n.issue_count, (SELECT string_agg(k, ',' ORDER BY k) FROM d WHERE d.l_suppkey = n.l_suppkey AND rn <= 10) AS issue_keys FROM (SELECT l_suppkey, count(*) AS issue_count FROM k GROUP BY 1) n""")
def synthesis_issue_summary(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_suppkey", F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("issue_key"))
    return va.synthesis_issue_summary(i, ["l_suppkey"])


@query("prevalidation_failures", with_views(["requests", "catalog_options"], f"""WITH {CATALOG_CTE}
SELECT unit_no, 'failed' AS final_status, false AS validated, 'prevalidation_failed' AS strategy, 'prevalidation_failed' AS extraction_reason, 0 AS attempts, 1 AS option_unmatched_count,
 'required_options_unmatched key=' || key || ' requested=' || value || ' reason=' || match_status AS mismatches FROM requests JOIN mt USING (snapshot_id, key, value) WHERE match_status <> 'catalog_option'"""))
def prevalidation_failures(spark, sf_dir):
    rows = _outcomes(spark, sf_dir, "match_status", (F.col("match_status") == "catalog_option").alias("valid"))
    return va.prevalidation_failures(rows, ["unit_no"])


@query("snapshot_refresh_reasons", with_views(["attempts"], """
WITH s AS (SELECT DISTINCT unit_id FROM attempts),
a AS (SELECT unit_id, arg_min(CASE WHEN reason IN ('no_matching_trace','request_error') THEN reason WHEN contains(lower(content_type),'html') AND reason <> 'success' THEN 'html_response_without_price' END, attempt_id)
  FILTER (WHERE reason IN ('no_matching_trace','request_error') OR (contains(lower(content_type),'html') AND reason <> 'success')) AS w FROM attempts GROUP BY unit_id),
m AS (SELECT unit_id, length(unit_id) % 2 = 0 AS ev, CAST(replace(unit_id,'unit','') AS BIGINT) AS n FROM s)
SELECT m.unit_id, CASE WHEN n % 3 <> 0 THEN coalesce(CASE WHEN n % 5 = 0 AND n % 2 = 0 THEN 'catalog_prevalidation_failed' END, CASE WHEN n % 7 = 0 THEN 'all_http_candidates_failed' END, w, CASE WHEN n % 11 = 0 THEN 'price_not_extracted' END, CASE WHEN n % 13 = 0 THEN 'price_not_extracted' END) END AS refresh_reason
FROM m LEFT JOIN a USING (unit_id)"""))
def snapshot_refresh_reasons(spark, sf_dir):
    a = view(spark, sf_dir, "attempts")
    n = F.regexp_replace("unit_id", "unit", "").cast("bigint")
    s = a.select("unit_id").distinct().withColumn("n", n).select(
        "unit_id", (F.col("n") % 3 != 0).alias("cache_hit"), (F.col("n") % 2 != 0).alias("request_only"), F.lit(True).alias("prevalidation_available"),
        (F.col("n") % 5 != 0).alias("prevalidation_valid"), F.when(F.col("n") % 7 == 0, "all_http_candidates_failed").alias("replay_reason"),
        F.when(F.col("n") % 11 == 0, "price_not_extracted").alias("extraction_reason"), (F.col("n") % 13 == 0).alias("price_missing"),
    )
    return va.refresh_reason(s, a, ["unit_id"], "attempt_id").select("unit_id", "refresh_reason")


@query("check_verdicts", with_views(["attempts"], """
WITH c AS (SELECT unit_id, stage AS check_name, CASE WHEN status = 503 THEN 'fail' WHEN status = 429 THEN 'warn' ELSE 'pass' END AS status FROM attempts),
g AS (SELECT unit_id, count(*) FILTER (WHERE status='fail') AS n_fail, count(*) FILTER (WHERE status='warn') AS n_warn, count(*) FILTER (WHERE status='pass') AS n_pass,
 array_to_string(list_sort(list(DISTINCT check_name) FILTER (WHERE status='fail')), ',') AS fail_checks, array_to_string(list_sort(list(DISTINCT check_name) FILTER (WHERE status='warn')), ',') AS warn_checks FROM c GROUP BY unit_id)
SELECT unit_id, n_fail, n_warn, n_pass, nullif(fail_checks, '') AS fail_checks, nullif(warn_checks, '') AS warn_checks, CASE WHEN n_fail > 0 THEN 'fail' WHEN n_warn > 0 THEN 'warn' ELSE 'pass' END AS worst_status,
 CASE WHEN n_fail > 0 THEN 'reject' WHEN n_warn > 0 THEN 'needs_more_evidence' ELSE 'promote' END AS verdict FROM g"""))
def check_verdicts(spark, sf_dir):
    c = view(spark, sf_dir, "attempts").select("unit_id", F.col("stage").alias("check_name"), F.when(F.col("status") == 503, "fail").when(F.col("status") == 429, "warn").otherwise("pass").alias("status"))
    return va.check_rollup(c, ["unit_id"], ["fail", "warn", "pass"], {"fail": "reject", "warn": "needs_more_evidence", "pass": "promote"})


# ---- learned rules ----------------------------------------------------------------------------------------------------------------

LOG_COLUMNS = """'shop' || CAST(o_custkey % 7 AS STRING) AS site, o_orderpriority AS option_key, CAST(25 * (1 + o_orderkey % 4) AS STRING) AS requested_norm,
  CASE WHEN o_orderstatus = 'P' THEN 'B' || CAST(o_orderkey % 2 AS STRING) ELSE 'A' END AS accepted_value, o_orderkey AS seq, o_orderkey % 997 = 0 AS trusted"""


def _rule_log(spark, sf_dir):
    from quotelens.plans.evidence import _split_columns

    return table(spark, sf_dir, "orders").selectExpr(*_split_columns(LOG_COLUMNS))


FOLD_CTE = f"""lg AS (SELECT {LOG_COLUMNS} FROM orders),
ch AS (SELECT *, CASE WHEN lag(accepted_value) OVER w IS DISTINCT FROM accepted_value THEN 1 ELSE 0 END AS c FROM lg WINDOW w AS (PARTITION BY site, option_key, requested_norm ORDER BY seq)),
rn AS (SELECT *, sum(c) OVER (PARTITION BY site, option_key, requested_norm ORDER BY seq) AS run FROM ch),
lr AS (SELECT *, max(run) OVER (PARTITION BY site, option_key, requested_norm) AS mr, bool_or(trusted) OVER (PARTITION BY site, option_key, requested_norm) AS tr FROM rn),
fd AS (SELECT site, option_key, requested_norm, arg_max(accepted_value, seq) AS accepted_value, count(*) AS hit_count, max(seq) AS last_seq, bool_or(tr) AS trusted FROM lr WHERE run = mr GROUP BY ALL)"""


@query("folded_normalization_rules", f"WITH {FOLD_CTE} SELECT * FROM fd")
def folded_normalization_rules(spark, sf_dir):
    return kn.fold_runs(_rule_log(spark, sf_dir), ["site", "option_key", "requested_norm"], "seq", "accepted_value", ["trusted"])


@query("rule_promotions", f"""WITH {FOLD_CTE}, ca AS (SELECT DISTINCT site, option_key, requested_norm, accepted_value FROM lg WHERE NOT trusted AND seq % 3 = 0)
SELECT ca.*, fd.hit_count FROM ca JOIN fd USING (site, option_key, requested_norm, accepted_value) WHERE NOT fd.trusted AND hit_count >= 3""")
def rule_promotions(spark, sf_dir):
    log = _rule_log(spark, sf_dir)
    folded = kn.fold_runs(log, ["site", "option_key", "requested_norm"], "seq", "accepted_value", ["trusted"])
    keys = F.when(F.col("seq") % 3 == 0, F.array(F.lit("total_gross_value"), F.lit("total_net_value"))).otherwise(F.array(F.lit("total_net")))
    runs = log.select(F.col("seq").alias("run_id"), F.lit("HTTP").alias("replay"), F.lit("https://x.example.com/api/p").alias("endpoint"), keys.alias("named_keys"))
    evidence = runs.filter(kn.strong_price_evidence(runs)).select("run_id")
    return kn.promotions(folded, log.withColumn("run_id", F.col("seq")), evidence)


@query("site_rule_ranking", f"""WITH {FOLD_CTE}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY hit_count DESC, last_seq DESC) AS place FROM fd) SELECT * FROM r WHERE place <= 10""")
def site_rule_ranking(spark, sf_dir):
    folded = kn.fold_runs(_rule_log(spark, sf_dir), ["site", "option_key", "requested_norm"], "seq", "accepted_value", ["trusted"])
    return kn.site_rows(folded, "site", 10)


@query("folded_replay_templates", with_views(["traces"], """
WITH l AS (SELECT run_id % 7 AS site, method AS template_kind, url AS endpoint, CASE WHEN status = 200 THEN resource_type ELSE 'other' END AS template, trace_idx AS seq FROM traces WHERE status <> 503 AND trace_idx % 6 <> 0),
c AS (SELECT *, CASE WHEN lag(template) OVER w IS DISTINCT FROM template THEN 1 ELSE 0 END AS c FROM l WINDOW w AS (PARTITION BY site, template_kind, endpoint ORDER BY seq)),
r AS (SELECT *, sum(c) OVER (PARTITION BY site, template_kind, endpoint ORDER BY seq) AS run FROM c), m AS (SELECT *, max(run) OVER (PARTITION BY site, template_kind, endpoint) AS mr FROM r)
SELECT site, template_kind, endpoint, arg_max(template, seq) AS template, count(*) AS hit_count, max(seq) AS last_seq FROM m WHERE run = mr GROUP BY ALL"""))
def folded_replay_templates(spark, sf_dir):
    t = view(spark, sf_dir, "traces").select(
        (F.col("run_id") % 7).alias("site"), F.col("method").alias("template_kind"), F.col("url").alias("endpoint"),
        F.when(F.col("status") == 200, F.col("resource_type")).otherwise("other").alias("template"), F.col("trace_idx").alias("seq"),
        (F.col("status") != 503).alias("is_valid"), F.lit(True).alias("success"), F.when(F.col("trace_idx") % 6 == 0, "heuristic").otherwise("none").alias("fallback"),
    )
    return kn.fold_runs(kn.templates_to_store(t), ["site", "template_kind", "endpoint"], "seq", "template")


@query("normalization_mappings", with_views(["units"], """
SELECT unit_no, 'quantity' AS option_key, quantity AS requested_norm, CAST(CAST(quantity AS INTEGER) + 1 AS VARCHAR) AS accepted_value, unit_no % 2 = 0 AS trusted FROM units WHERE unit_no % 3 = 0
UNION ALL SELECT unit_no, 'Format', lower(format), 'DIN ' || format, false FROM units WHERE unit_no % 5 = 0"""))
def normalization_mappings(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    two = lambda q, f: F.explode(F.array(F.struct(F.lit("quantity").alias("key"), q.alias("value")), F.struct(F.lit("Format").alias("key"), f.alias("value"))))
    req = u.select("unit_no", two(F.col("quantity"), F.col("format")).alias("o")).select("unit_no", "o.*")
    q = F.when(F.col("unit_no") % 3 == 0, (F.col("quantity").cast("int") + 1).cast("string")).otherwise(F.concat(F.lit(" "), F.col("quantity")))
    f = F.when(F.col("unit_no") % 5 == 0, F.concat(F.lit("DIN "), F.col("format"))).otherwise(F.lower("format"))
    acc = u.select("unit_no", two(q, f).alias("o")).select("unit_no", "o.*")
    matched = u.filter("unit_no % 2 = 0").select("unit_no", F.lit(" QUANTITY ").alias("key"))
    return kn.normalization_mappings(req, acc, matched, ["unit_no"])


# ---- snapshots and drift -------------------------------------------------------------------------------------------------------------

@query("fresh_page_snapshots", r"""
WITH p AS (SELECT regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^www\.', '') || CASE WHEN regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END AS cache_key,
  page_id, 1700000000000000 + page_id * 3600000000 AS cap FROM pages),
l AS (SELECT cache_key, max(cap) AS cap, arg_max(page_id, cap) AS page_id FROM p GROUP BY cache_key)
SELECT cache_key, page_id, cap + 7 * 86400000000 AS expires_us FROM l WHERE cap + 7 * 86400000000 >= 1700000000000000 + 200 * 3600000000""")
def fresh_page_snapshots(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(1700000000000000) + F.col("page_id") * 3600000000).alias("captured_us"))
    as_of = F.lit(1700000000000000 + 200 * 3600000000)
    return kn.fresh_snapshots(p, "url", "captured_us", as_of, 7).select("cache_key", "page_id", "expires_us")


@query("snapshot_drift", with_views(["traces"], """
WITH s AS (SELECT run_id % 400 AS k, CASE WHEN trace_idx % 3 = 0 THEN 1 ELSE 0 END AS side, url, method FROM traces),
g AS (SELECT k, side, count(*) AS trace_count, count(DISTINCT url) AS url_count, array_to_string(list_sort(list(DISTINCT url)), '|') AS urls, max(method) AS template FROM s GROUP BY ALL),
p AS (SELECT * FROM g WHERE side = 1), c AS (SELECT * FROM g WHERE side = 0),
j AS (SELECT coalesce(p.k, c.k) AS k, array_to_string(list_filter([CASE WHEN p.template IS DISTINCT FROM c.template THEN 'template' END, CASE WHEN p.trace_count IS DISTINCT FROM c.trace_count THEN 'trace_count' END, CASE WHEN p.url_count IS DISTINCT FROM c.url_count THEN 'url_count' END, CASE WHEN p.urls IS DISTINCT FROM c.urls THEN 'urls' END], lambda x: x IS NOT NULL), ',') AS changed_fields FROM p FULL JOIN c ON p.k = c.k)
SELECT k, changed_fields, CASE WHEN changed_fields <> '' THEN 'material_change' ELSE 'no_material_change' END AS verdict FROM j"""))
def snapshot_drift(spark, sf_dir):
    t = view(spark, sf_dir, "traces").select((F.col("run_id") % 400).alias("k"), (F.col("trace_idx") % 3 == 0).alias("old"), "url", "method")

    def side(d):
        counts = d.groupBy("k").agg(F.count(F.lit(1)).alias("trace_count"), F.max("method").alias("template"))
        prints = kn.set_fingerprint(d, ["k"], "url").select("k", F.col("n").alias("url_count"), F.col("fingerprint").alias("urls"))
        return counts.join(prints, "k")

    return kn.drift(side(t.filter("old")), side(t.filter("not old")), ["k"], ["trace_count", "url_count", "urls", "template"])


@query("reuse_verdicts", with_views(["units"], """
SELECT unit_no, CASE WHEN unit_no % 3 = 0 THEN 'cache_reused' WHEN unit_no % 2 = 0 THEN 'fresh_recon' ELSE 'not_available' END AS verdict FROM units"""))
def reuse_verdicts(spark, sf_dir):
    n = F.col("unit_no")
    return view(spark, sf_dir, "units").select("unit_no", kn.default_verdict(n % 3 == 0, n % 2 == 0).alias("verdict"))
