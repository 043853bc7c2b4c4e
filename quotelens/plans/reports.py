"""Queries that report run evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.operators import endpoints as ep
from quotelens.operators import matching as mt
from quotelens.operators import prices as pr
from quotelens.operators import reports as rp
from quotelens.plans import checksql as ck
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.prices import JSON_CAND_CTE
from quotelens.plans.registry import query
from quotelens.sources import capture

HINTS_CTE = ck.RANKED_CTE + """,
hn AS (SELECT r.run_id, r.rank, r.url, r.method, arg_min(t.post_data, t.trace_idx) AS body FROM ranked r JOIN traces t ON t.run_id = r.run_id AND t.url = r.url AND t.method = r.method GROUP BY ALL),
mu AS (SELECT run_id, rank, url, u.* FROM (SELECT *, CASE WHEN body LIKE '{"quantity%' THEN [{'k': 'quantity', 'p': 'quantity', 'r': 'path_token_match'}]
    WHEN body LIKE 'sku=%' THEN [{'k': 'quantity', 'p': 'quantity', 'r': 'form_key_match'}, {'k': 'format', 'p': 'format', 'r': 'form_key_match'}] ELSE [] END AS l FROM hn), LATERAL (SELECT unnest(l) AS u, generate_subscripts(l, 1) AS n))"""


def _hints(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    return rp.endpoint_traces(ep.rank_endpoints(ep.score_traces(t)), t)


@query("template_hints", with_views(["traces"], f"""WITH {ck.scored_cte()}, {HINTS_CTE}
SELECT run_id, rank, url, method, CASE WHEN json_valid(body) THEN 'json' WHEN contains(body, '=') AND contains(body, '&') THEN 'form' ELSE 'raw' END AS body_kind FROM hn"""))
def template_hints(spark, sf_dir):
    d = _hints(spark, sf_dir)
    return d.select("run_id", "rank", "url", "method", rp.body_kind(F.coalesce("post_data", F.lit(""))).alias("body_kind"))


@query("template_mutations", with_views(["traces"], f"""WITH {ck.scored_cte()}, {HINTS_CTE}
SELECT run_id, rank, url, u.k AS option_key, u.p AS path, u.r AS reason FROM (SELECT run_id, rank, url, unnest(CASE WHEN body LIKE '{{"quantity%' THEN [{{'k': 'quantity', 'p': 'quantity', 'r': 'path_token_match'}}]
    WHEN body LIKE 'sku=%' THEN [{{'k': 'quantity', 'p': 'quantity', 'r': 'form_key_match'}}, {{'k': 'format', 'p': 'format', 'r': 'form_key_match'}}] ELSE [] END) AS u FROM hn)""".replace(HINTS_CTE, HINTS_CTE.split(",\nmu AS")[0])))
def template_mutations(spark, sf_dir):
    return rp.template_mutations(_hints(spark, sf_dir)).drop("mutation_no")


@query("rewrite_evidence_gate", with_views(["traces"], f"""WITH {ck.scored_cte()}, {HINTS_CTE.split(",\nmu AS")[0]},
sl AS (SELECT run_id, arg_min(url, rank) AS sel FROM ranked GROUP BY run_id),
m AS (SELECT *, CASE WHEN body LIKE '{{"quantity%' THEN 1 WHEN body LIKE 'sku=%' THEN 2 ELSE 0 END AS n FROM hn),
h AS (SELECT sl.run_id, sel, count(m.url) AS hints, coalesce(bool_or(m.url = sel), false) AS ok, arg_min(m.url, (CASE WHEN m.url = sel THEN 0 ELSE 1 END, rank)) AS hint_url, coalesce(arg_min(n, (CASE WHEN m.url = sel THEN 0 ELSE 1 END, rank)), 0) AS n FROM sl LEFT JOIN m USING (run_id) GROUP BY ALL),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN hints = 0 THEN 'missing_trace_template_hints' END, CASE WHEN NOT ok THEN 'selected_endpoint_trace_hint_missing' END, CASE WHEN n = 0 THEN 'missing_candidate_mutations' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h)
SELECT run_id, ok AS matched_selected_endpoint, hint_url, reasons = '' AS sufficient, reasons FROM r"""))
def rewrite_evidence_gate(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    ranked = ep.rank_endpoints(ep.score_traces(t))
    hints = rp.endpoint_traces(ranked, t)
    runs = ranked.groupBy("run_id").agg(F.min_by("url", "rank").alias("selected_endpoint"))
    return rp.rewrite_gate(runs, hints, rp.template_mutations(hints))


@query("run_endpoint_evidence", with_views(["traces"], f"""WITH {ck.scored_cte()}, {ck.RANKED_CTE},
f AS (SELECT r.run_id, r.rank, r.url, r.method, r.role, r.score, arg_min(t.resource_type, t.trace_idx) AS resource_type, arg_min(t.post_data, t.trace_idx) AS b, arg_min(t.response_body_preview, t.trace_idx) AS p FROM ranked r JOIN traces t ON t.run_id = r.run_id AND t.url = r.url AND t.method = r.method WHERE r.rank <= 8 GROUP BY ALL)
SELECT run_id, rank, url, role, score, resource_type, p <> '' AS has_preview, CASE WHEN b LIKE 'sku=%' THEN 'sku,quantity,format' WHEN b = '' THEN '' ELSE b END AS post_keys FROM f"""))
def run_endpoint_evidence(spark, sf_dir):
    from quotelens.functions.urls import form_keys

    t = view(spark, sf_dir, "traces")
    d = rp.endpoint_traces(ep.rank_endpoints(ep.score_traces(t)), t, 8)
    sig = rp.response_signals(F.col("response_body_preview"))
    return d.select("run_id", "rank", "url", "role", "score", "resource_type", sig["has_preview"].alias("has_preview"), F.array_join(form_keys(F.col("post_data")), ",").alias("post_keys"))


@query("pricing_evidence", with_views(["traces"], """
WITH t AS (SELECT run_id, trace_idx, url, status, CASE WHEN trace_idx % 3 = 0 THEN true ELSE false END AS ws, CASE WHEN trace_idx % 4 = 0 THEN '12.5,' || CAST(trace_idx AS VARCHAR) ELSE '' END AS pr FROM traces WHERE contains(response_content_type, 'json')),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pr <> '' DESC, ws DESC, status DESC, trace_idx) AS evidence_no FROM t WHERE ws OR pr <> '')
SELECT run_id, evidence_no, trace_idx, url, status, ws AS contains_ws_ajax, pr AS pr_prices FROM r WHERE evidence_no <= 4"""))
def pricing_evidence(spark, sf_dir):
    n = F.col("trace_idx")
    body = F.concat(F.when(n % 3 == 0, '{"WS-Ajax-x":1}').otherwise("{}"), F.when(n % 4 == 0, F.concat(F.lit("prPrice='12.5' prPrice='"), n.cast("string"), F.lit("'"))).otherwise(""))
    t = view(spark, sf_dir, "traces").withColumn("response_body_preview", body)
    return rp.pricing_evidence(t).select("run_id", "evidence_no", "trace_idx", "url", "status", "contains_ws_ajax", "pr_prices")


@query("recipe_endpoints", with_views(["traces"], f"""WITH {ck.scored_cte()}, {ck.RANKED_CTE}, p AS (SELECT DISTINCT run_id, 'https://www.shop.example.com/repo/options/values' AS w FROM traces),
d AS (SELECT r.*, r.url = w AS hit FROM ranked r JOIN p USING (run_id)), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, rank) AS rn FROM d)
SELECT run_id, url, method, CASE WHEN hit THEN 'preferred_endpoint' ELSE 'top_endpoint_fallback' END AS source, score FROM n WHERE rn = 1"""))
def recipe_endpoints(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    pref = t.select("run_id").distinct().withColumn("url", F.lit("https://www.shop.example.com/repo/options/values")).withColumn("method", F.lit(""))
    return rp.recipe_endpoint(ep.ordered_endpoints(ep.score_traces(t)), pref).select("run_id", "url", "method", "source", "score")


@query("json_price_paths", with_views(["traces"], f"""WITH {JSON_CAND_CTE}, j AS (SELECT run_id, score, substr(source, 6) AS price_path FROM jcand WHERE starts_with(source, 'json:'))
SELECT run_id, arg_max(price_path, (score, price_path)) AS price_path, max(score) AS score FROM j GROUP BY run_id"""))
def json_price_paths(spark, sf_dir):
    return rp.price_paths(pr.json_candidates(view(spark, sf_dir, "traces"), ["run_id"], "response_body_preview"), ["run_id"])


@query("inferred_inject_rules", None)
def inferred_inject_rules(spark, sf_dir):
    """Inject rules from template mutations; checked by brute force on a fixture."""
    m = rp.template_mutations(_hints(spark, sf_dir))
    vm = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.lit("quantity").alias("option_key"), F.create_map(F.col("c_mktsegment"), F.col("c_name")).alias("value_map"))
    none = m.select("run_id", F.lit("x").alias("name"), F.lit(0).alias("property_pos")).distinct()
    return rp.inject_rules(m, vm, none)


@query("adapter_record_checks", with_views(["units"], r"""
SELECT unit_no AS run_id, 'shop' || CAST(run_id % 7 AS VARCHAR) || '.example.com' AS domain, CASE WHEN unit_no % 6 = 0 THEN 'sensitive_text' WHEN unit_no % 5 = 0 THEN 'missing_price_path' END AS rejected_because,
 'https?://(www\.)?shop' || CAST(run_id % 7 AS VARCHAR) || '\.example\.com/p/item\-' || CAST(unit_no AS VARCHAR) || '/(?:[/?#].*)?$' AS url_regex FROM units"""))
def adapter_record_checks(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    runs = u.select(
        F.col("unit_no").alias("run_id"), F.col("url").alias("product_url"), F.lit("https://api.example.com/p").alias("endpoint_url"), F.lit("POST").alias("method"),
        F.when(F.col("unit_no") % 6 == 0, '{"h":"Bearer abc"}').otherwise("{}").alias("template"), F.when(F.col("unit_no") % 5 == 0, "").otherwise("total").alias("price_path"),
    )
    rules = u.select(F.col("unit_no").alias("run_id"))
    return rp.adapter_records(runs, rules).select("run_id", "domain", "rejected_because", "url_regex")


@query("onboarding_steps", with_views(["traces"], f"""WITH {ck.scored_cte()}, s AS (SELECT run_id, bool_or({ck.any_of('u', ['/api','graphql','pricing','quote','calculate'])}) AS rs, count(*) FILTER (WHERE post_data <> '') AS n, bool_or(post_data LIKE 'sku=%') AS tp FROM fam GROUP BY run_id)
SELECT run_id, array_to_string(list_filter([CASE WHEN rs THEN 'confirm_session_headers' END, 'pick_pricing_endpoint', CASE WHEN NOT tp THEN 'capture_request_templates' END, CASE WHEN run_id % 2 = 0 THEN 'extract_option_catalog' END, 'add_site_rules', CASE WHEN n > 0 THEN 'use_candidate_mutations' END, 'add_regression_fixture'], lambda x: x IS NOT NULL), ',') AS next_steps FROM s"""))
def onboarding_steps(spark, sf_dir):
    s = ep.score_traces(view(spark, sf_dir, "traces"))
    more = s.groupBy("run_id").agg(F.count_if("has_post_data").alias("hint_count"), F.max(F.col("post_data").startswith("sku=")).alias("has_templates"))
    d = ep.discovery_rollup(s).join(more, "run_id").withColumn("catalog_groups", (F.col("run_id") % 2).cast("int"))
    return rp.onboarding_steps(d).select("run_id", "next_steps")


@query("run_targets", with_views(["units"], """
SELECT unit_no, CASE WHEN unit_no % 4 <> 0 THEN site_name WHEN unit_no % 8 = 0 THEN 'snap' ELSE 'unknown-site' END AS site_name, 0.01 AS expected_price_tolerance, 'EUR' AS expected_currency, CASE WHEN unit_no % 8 = 0 THEN unit_no END AS snapshot_id, 'true' AS request_only FROM units"""))
def run_targets(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    spec = u.select("unit_no", "url", F.when(F.col("unit_no") % 4 == 0, " ").otherwise(F.col("site_name")).alias("site_name"), F.lit(None).cast("double").alias("expected_price_tolerance"),
                    F.when(F.col("unit_no") % 2 == 0, F.col("expected_currency")).alias("expected_currency"))
    snaps = u.filter("unit_no % 8 = 0").select(F.regexp_replace("url", "/$", "?v=2").alias("url"), F.lit("snap").alias("site_name"), F.col("unit_no").alias("snapshot_id"))
    return rp.build_targets(spec, snaps, {"request_only": "true"}).drop("url")


# ---- capture signs ------------------------------------------------------------------------------------------------------------------

@query("session_flags", with_views(["traces"], """
SELECT run_id, bool_or(trace_idx % 4 = 0) AS requires_session, bool_or(trace_idx % 9 = 0) AS has_csrf, bool_or(trace_idx % 7 = 0) AS has_bearer, bool_or(trace_idx % 11 = 0) AS anti_bot_suspected FROM traces GROUP BY run_id"""))
def session_flags(spark, sf_dir):
    n = F.col("trace_idx")
    t = view(spark, sf_dir, "traces").withColumn(
        "request_headers", F.when(n % 7 == 0, F.create_map(F.lit("Authorization"), F.lit("Bearer t"))).otherwise(F.create_map(F.lit("Accept"), F.lit("*")))
    ).withColumn("response_headers", F.when(n % 4 == 0, F.create_map(F.lit("Set-Cookie"), F.lit("a"))).when(n % 11 == 0, F.create_map(F.lit("CF-Ray"), F.lit("x"))).otherwise(F.create_map(F.lit("Server"), F.lit("n"))))
    t = t.withColumn("post_data", F.when(n % 9 == 0, "CSRF=1").otherwise("")).withColumn("response_body_preview", F.when(n % 11 == 0, "solve the Captcha").otherwise(""))
    return capture.session_flags(t, ["run_id"])


@query("allowed_header_counts", with_views(["traces"], """
SELECT run_id, count(*) AS traces, count(*) AS kept FROM traces GROUP BY run_id"""))
def allowed_header_counts(spark, sf_dir):
    h = F.create_map(F.lit("Accept"), F.lit("*"), F.lit("Cookie"), F.lit("x"), F.lit("Host"), F.lit("y"))
    t = view(spark, sf_dir, "traces").select("run_id", F.size(capture.allowed_headers(h, capture.REQUEST_HEADERS)).alias("k"))
    return t.groupBy("run_id").agg(F.count(F.lit(1)).alias("traces"), F.sum("k").alias("kept"))


@query("configurator_request_counts", with_views(["traces"], """
SELECT run_id, count(*) FILTER (WHERE (contains(lower(url), '/api/') OR contains(lower(url), '://api.')) AND regexp_matches(lower(url), 'itemmaster|shopping-cart|calculation|product')) AS configurator_requests FROM traces GROUP BY run_id"""))
def configurator_request_counts(spark, sf_dir):
    return capture.configurator_requests(view(spark, sf_dir, "traces"), ["run_id"], "url")


@query("requests_after_baseline", with_views(["traces"], """
WITH f AS (SELECT run_id, url, min(trace_idx) AS first_seen FROM traces WHERE trace_idx > 5000 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY first_seen) AS place FROM f)
SELECT * FROM n WHERE place <= 80"""))
def requests_after_baseline(spark, sf_dir):
    return capture.new_requests(view(spark, sf_dir, "traces").select("run_id", "url", "trace_idx"), ["run_id"], "url", "trace_idx", F.lit(5000))


@query("semantic_trace_tokens", with_views(["traces"], f"""
WITH h AS (SELECT run_id, lower(url || ' ' || post_data || ' ' || response_body_preview || ' ' || response_content_type || ' ' || request_content_type) AS x FROM traces)
SELECT run_id, count(*) FILTER (WHERE {ck.any_of('x', ['price','total','gross','net'])}) AS price_traces, count(*) FILTER (WHERE {ck.any_of('x', ['quantity','qty','auflage'])}) AS quantity_traces FROM h GROUP BY run_id"""))
def semantic_trace_tokens(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    return t.groupBy("run_id").agg(
        F.count_if(mt.mentions_any(["price", "total", "gross", "net"])).alias("price_traces"), F.count_if(mt.mentions_any(["quantity", "qty", "auflage"])).alias("quantity_traces")
    )


@query("matched_traces", with_views(["traces"], f"""WITH {ck.scored_cte()}, {ck.RANKED_CTE},
en AS (SELECT run_id, url AS endpoint, rank, '/' || array_to_string(list_filter(list_transform(string_split(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: regexp_replace(s, '[^a-z0-9]+', '', 'g')), lambda s: s <> ''), '/') AS ep, regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) AS eh FROM ranked),
tn AS (SELECT *, '/' || array_to_string(list_filter(list_transform(string_split(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: regexp_replace(s, '[^a-z0-9]+', '', 'g')), lambda s: s <> ''), '/') AS tp, regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) AS th FROM traces),
pa AS (SELECT e.run_id, e.endpoint, e.rank, t.*EXCLUDE(run_id), ep, list_intersect(list_distinct(string_split(substr(ep, 2), '/')), list_distinct(string_split(substr(tp, 2), '/'))) AS sh, list_distinct(list_concat(string_split(substr(ep, 2), '/'), string_split(substr(tp, 2), '/'))) AS un,
   list_last(string_split(ep, '/')) AS eb, list_last(string_split(tp, '/')) AS tb, eh FROM en e JOIN tn t ON t.run_id = e.run_id),
bs AS (SELECT *, CASE WHEN eh || ep = th || tp THEN 'normalized_exact' WHEN ep = tp THEN 'normalized_path_exact' WHEN starts_with(tp, ep) OR starts_with(ep, tp) THEN 'path_prefix' WHEN contains(eb, tb) OR contains(tb, eb) THEN 'path_containment' WHEN len(sh) > 0 THEN 'semantic_overlap' END AS st FROM pa),
c0 AS (SELECT *, CASE st WHEN 'normalized_exact' THEN 1.0 WHEN 'normalized_path_exact' THEN 0.95 WHEN 'path_prefix' THEN 0.84 WHEN 'path_containment' THEN 0.78 ELSE least(0.72, 0.42 + len(sh)::DOUBLE / len(un)) END::DOUBLE AS b FROM bs WHERE st IS NOT NULL),
c1 AS (SELECT *, least(1.0, b + CASE method WHEN 'POST' THEN 0.08 ELSE 0.02 END) AS b1 FROM c0), c2 AS (SELECT *, CASE WHEN resource_type IN ('xhr','fetch') THEN least(1.0, b1 + 0.07) ELSE b1 END AS b2 FROM c1),
c3 AS (SELECT *, CASE WHEN status BETWEEN 200 AND 299 THEN least(1.0, b2 + 0.05) WHEN status >= 400 THEN greatest(0.0, b2 - 0.12) ELSE b2 END AS b3 FROM c2),
c4 AS (SELECT *, CASE WHEN contains(response_content_type, 'json') THEN least(1.0, b3 + 0.06) ELSE b3 END AS b4 FROM c3), c5 AS (SELECT *, CASE WHEN contains(request_content_type, 'json') THEN least(1.0, b4 + 0.03) ELSE b4 END AS b5 FROM c4),
c6 AS (SELECT *, CASE WHEN post_data <> '' THEN least(1.0, b5 + 0.05) ELSE b5 END AS b6 FROM c5), c7 AS (SELECT *, round(CASE WHEN trim(response_body_preview) <> '' THEN least(1.0, b6 + 0.02) ELSE b6 END, 6) AS conf FROM c6),
tg AS (SELECT *, lower(url || ' ' || post_data || ' ' || response_body_preview || ' ' || response_content_type || ' ' || request_content_type) AS hay, list_distinct(list_concat(string_split(substr(ep, 2), '/'), string_split(substr(tp, 2), '/'))) AS toks FROM c7),
sg AS (SELECT *, CASE WHEN {ck.any_of('hay', mt.SEMANTIC_PQ)} OR {ck.any_key('toks', mt.SEMANTIC_PQ)} THEN 2 ELSE 0 END + CASE WHEN {ck.any_of('hay', mt.SEMANTIC_C)} OR {ck.any_key('toks', mt.SEMANTIC_C)} THEN 1 ELSE 0 END
  + CASE WHEN method = 'POST' THEN 3 ELSE 0 END + CASE WHEN resource_type IN ('xhr','fetch') THEN 2 ELSE 0 END + CASE WHEN contains(response_content_type, 'json') THEN 2 ELSE 0 END + CASE WHEN contains(request_content_type, 'json') THEN 1 ELSE 0 END
  + CASE WHEN status BETWEEN 200 AND 299 THEN 1 ELSE 0 END + CASE WHEN post_data <> '' THEN 2 ELSE 0 END AS bonus FROM tg),
w AS (SELECT *, row_number() OVER (PARTITION BY run_id, endpoint ORDER BY conf DESC, bonus DESC, (post_data <> '')::INT DESC, (method = 'POST')::INT DESC, (resource_type IN ('xhr','fetch'))::INT DESC, status, trace_idx) AS rn FROM sg WHERE conf > 0)
SELECT run_id, endpoint, trace_idx, st AS match_strategy, round(conf, 3) AS match_confidence, bonus AS semantic_bonus FROM w WHERE rn = 1"""))
def matched_traces(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    ranked = ep.best_endpoints(ep.score_traces(t))
    d = mt.match_traces(ranked.select("run_id", F.col("url").alias("endpoint")), t)
    return d.select("run_id", "endpoint", "trace_idx", "match_strategy", F.round("match_confidence", 3).alias("match_confidence"), "semantic_bonus")


@query("trace_match_diagnostics", with_views(["traces"], """
WITH e AS (SELECT DISTINCT run_id, CASE run_id % 3 WHEN 0 THEN 'https://www.shop.example.com/repo/options/values' WHEN 1 THEN 'https://nowhere.example.org/zzz' ELSE ' ' END AS endpoint FROM traces),
n AS (SELECT run_id, count(*) AS c, count(*) FILTER (WHERE trace_idx % 10 = 2) AS hits, count(*) FILTER (WHERE trace_idx % 10 = 2 AND NOT (status >= 400 AND false)) AS h2 FROM traces GROUP BY run_id)
SELECT run_id, c AS candidate_trace_count, CASE run_id % 3 WHEN 1 THEN 'no_semantic_overlap' WHEN 2 THEN 'missing_endpoint' ELSE CASE WHEN hits = 0 THEN 'no_semantic_overlap' END END AS mismatch_reason FROM e JOIN n USING (run_id)"""))
def trace_match_diagnostics(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    e = t.select("run_id").distinct()
    url = F.when(F.col("run_id") % 3 == 0, "https://www.shop.example.com/repo/options/values").when(F.col("run_id") % 3 == 1, "https://nowhere.example.org/zzz").otherwise(" ")
    return mt.match_diagnostics(e.select("run_id", url.alias("endpoint")), t).select("run_id", "candidate_trace_count", "mismatch_reason")
