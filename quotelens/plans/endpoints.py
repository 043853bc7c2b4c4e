"""Queries that classify, rank and relate captured endpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions import text, urls, vocab
from quotelens.operators import endpoints as ep
from quotelens.plans import checksql as ck
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.registry import query


def scored(spark, sf_dir):
    return ep.score_traces(view(spark, sf_dir, "traces"))


def _traces(body: str) -> str:
    return with_views(["traces"], f"WITH {ck.scored_cte()} {body}")


@query("endpoint_roles", _traces("SELECT trace_idx, role, round(conf, 3) AS confidence, score FROM fam"))
def endpoint_roles(spark, sf_dir):
    d = ep.classify_role(ep.with_evidence(view(spark, sf_dir, "traces"))).withColumn("score", ep.endpoint_score())
    return d.select("trace_idx", "role", F.round("role_confidence", 3).alias("confidence"), "score")


@query("request_families", _traces("SELECT trace_idx, request_family, fb AS family_score, array_to_string(list_sort(infra), ',') AS infra_hits FROM fam"))
def request_families(spark, sf_dir):
    d = ep.classify_family(ep.with_evidence(view(spark, sf_dir, "traces")))
    return d.select("trace_idx", "request_family", "family_score", F.array_join("infra_hits", ",").alias("infra_hits"))


@query("endpoint_signals", _traces(f"""SELECT trace_idx, post_data <> '' AS has_post_data, len(pk) AS payload_key_count, len(rk) AS response_key_count,
 {ck.any_key('pk', vocab.PAYLOAD_PRICE_KEYS)} AS payload_has_price,
 {ck.any_key('rk', vocab.PAYLOAD_PRICE_KEYS)} OR {ck.any_of('prev', vocab.PAYLOAD_PRICE_KEYS)} AS response_has_price,
 {ck.any_key('pk', vocab.PAYLOAD_QUANTITY_KEYS)} AS payload_has_quantity,
 {ck.any_key('rk', vocab.PAYLOAD_QUANTITY_KEYS)} OR {ck.any_of('prev', vocab.PAYLOAD_QUANTITY_KEYS)} AS response_has_quantity,
 contains(rtype, 'json') AS response_is_json,
 array_to_string(list_sort(list_filter({ck.list_of(vocab.URL_NOISE)}, lambda t: contains(u, t))), ',') AS noise_hits,
 status >= 400 AS http_error,
 array_to_string(list_sort(list_distinct(list_concat(sem_pricing, sem_quantity, sem_config, sem_validation))), ',') AS semantic_tokens,
 array_to_string(list_filter([regexp_extract(u, '^[a-z]+://([^/?#]*)', 1), nullif(array_to_string(list_filter(regexp_split_to_array(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1:2], '/'), '')], lambda x: x IS NOT NULL), '/') AS url_prefix
FROM fam"""))
def endpoint_signals(spark, sf_dir):
    d = scored(spark, sf_dir)
    return d.select(
        "trace_idx", "has_post_data", "payload_key_count", "response_key_count", "payload_has_price", "response_has_price",
        "payload_has_quantity", "response_has_quantity", "response_is_json",
        F.array_join(F.sort_array("noise_hits"), ",").alias("noise_hits"), (F.col("_status") >= 400).alias("http_error"),
        F.array_join(F.sort_array("semantic_tokens"), ",").alias("semantic_tokens"), "url_prefix",
    )


@query("endpoint_rankings", _traces(f", {ck.RANKED_CTE} SELECT run_id, rank, url, method, status, role, confidence, score, request_family FROM ranked WHERE rank <= 30"))
def endpoint_rankings(spark, sf_dir):
    r = ep.rank_endpoints(scored(spark, sf_dir), limit=30)
    return r.select("run_id", "rank", "url", "method", "status", "role", "confidence", "score", "request_family")


@query("endpoint_candidates", _traces(""", b AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY score DESC, trace_idx) AS un FROM fam),
c AS (SELECT run_id, url, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, round(conf,3) DESC, trace_idx) AS candidate_no FROM b WHERE un = 1 AND score > 0 AND role <> 'noise')
SELECT * FROM c WHERE candidate_no <= 30"""))
def endpoint_candidates(spark, sf_dir):
    return ep.endpoint_candidates(scored(spark, sf_dir))


SIG_CTE = ck.RANKED_CTE + """,
sigf AS (SELECT run_id, url, bool_or(len(sem_pricing) > 0) AS p, bool_or(len(sem_quantity) > 0) AS q, bool_or(len(sem_config) > 0) AS c,
  bool_or(len(sem_validation) > 0) AS v, bool_or(len(infra) > 0) AS i,
  arg_min(request_family, (CASE WHEN request_family = 'unknown' THEN 1 ELSE 0 END, trace_idx)) AS fam,
  list_distinct(flatten(list(list_concat(sem_pricing, sem_quantity, sem_config, sem_validation)))) AS st,
  list_distinct(flatten(list(pk))) AS pks, list_distinct(flatten(list(rk))) AS rks FROM fam GROUP BY run_id, url),
mem AS (SELECT r.run_id, r.url, r.rank, r.request_family, s.* EXCLUDE (run_id, url),
  regexp_extract(r.u, '^[a-z]+://([^/?#]*)', 1) || '/' || array_to_string(list_filter(regexp_split_to_array(regexp_extract(r.url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')[1:2], '/') AS pre
  FROM ranked r JOIN sigf s USING (run_id, url))"""


@query("related_endpoints", _traces(", " + SIG_CTE + """,
pr AS (SELECT a.run_id, a.url, b.url AS related_url, b.rank AS related_rank,
  round(least(1.0, (CASE WHEN a.pre = b.pre THEN 0.25 ELSE 0 END) + (CASE WHEN a.fam = b.fam AND a.fam <> 'unknown' THEN CASE WHEN a.fam = 'infrastructure' THEN 0.12 ELSE 0.18 END ELSE 0 END)
   + (CASE WHEN len(list_intersect(a.st, b.st)) >= 2 THEN least(0.3, 0.08 + 0.02 * len(list_intersect(a.st, b.st))) ELSE 0 END)
   + (CASE WHEN len(list_intersect(a.pks, b.pks)) >= 2 THEN least(0.25, 0.05 + 0.02 * len(list_intersect(a.pks, b.pks))) ELSE 0 END)
   + (CASE WHEN len(list_intersect(a.rks, b.rks)) >= 2 THEN least(0.25, 0.05 + 0.02 * len(list_intersect(a.rks, b.rks))) ELSE 0 END)
   + (CASE WHEN a.p AND b.p THEN 0.1 ELSE 0 END) + (CASE WHEN a.q AND b.q THEN 0.1 ELSE 0 END) + (CASE WHEN a.c AND b.c THEN 0.08 ELSE 0 END) + (CASE WHEN a.v AND b.v THEN 0.06 ELSE 0 END))::DOUBLE, 6) AS relation
  FROM mem a JOIN mem b ON a.run_id = b.run_id AND a.url <> b.url),
rn AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY relation DESC, related_rank) AS relation_no FROM pr WHERE relation >= 0.35)
SELECT run_id, url, related_url, relation_no, round(relation, 3) AS relation FROM rn WHERE relation_no <= 4"""))
def related_endpoints(spark, sf_dir):
    s = ep.scored_once(scored(spark, sf_dir))
    rel = ep.related_endpoints(ep.rank_endpoints(s), ep.signatures(s))
    return rel.select("run_id", "url", "related_url", "relation_no", F.round("relation", 3).alias("relation"))


@query("family_clusters", _traces(", " + SIG_CTE + """,
sh AS (SELECT run_id, request_family, count(*) AS members, round(avg(p::INT), 3) AS pricing_relevance, round(avg(q::INT), 3) AS quantity_relevance,
  round(avg(i::INT), 3) AS infrastructure_likelihood FROM mem GROUP BY ALL),
tc AS (SELECT run_id, request_family, t, count(*) AS n FROM (SELECT run_id, request_family, unnest(st) AS t FROM mem) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY run_id, request_family ORDER BY n DESC, t) AS tn FROM tc),
tl AS (SELECT run_id, request_family, string_agg(t, ',' ORDER BY tn) AS dominant_signals FROM tr WHERE tn <= 8 GROUP BY ALL)
SELECT sh.*, tl.dominant_signals FROM sh LEFT JOIN tl USING (run_id, request_family)"""))
def family_clusters(spark, sf_dir):
    s = ep.scored_once(scored(spark, sf_dir))
    return ep.family_summary(ep.rank_endpoints(s), ep.signatures(s))


ROLLUP_CTE = f"""ro AS (SELECT run_id, bool_or({ck.any_of('u', vocab.API_LIKE)}) AS has_api_calls, bool_or(contains(u,'cookie')) AS ck,
  bool_or(status IN (403,429)) AS anti_bot_suspected, bool_or(contains(u,'csrf') OR contains(prev,'csrf')) AS has_token,
  sum((post_data <> '')::INT + {ck.any_key('pk', vocab.PAYLOAD_PROPERTY_KEYS)}::INT + {ck.any_key('pk', vocab.PAYLOAD_PRODUCT_KEYS)}::INT + {ck.any_key('pk', ['quantity','qty','auflage','pricescale'])}::INT)::BIGINT AS payload_signal_score,
  sum(contains(rtype,'json')::INT + (status BETWEEN 200 AND 299)::INT + (role IN ('pricing','schema','validation','quantity_matrix'))::INT)::BIGINT AS response_signal_score,
  bool_or(role = 'quantity_matrix') AS mx, bool_or({ck.any_key('pk', ['quantity','qty','auflage','pricescale'])}) AS qt,
  bool_or(role IN ('pricing','quantity_matrix')) AS has_pricing_role, bool_or(role = 'schema') AS has_schema_role, bool_or(role = 'validation') AS has_validation_role,
  bool_or(resource_type = 'document' AND regexp_matches(u, 'config|product|shop|/p/|druck|broschu|print')) AS has_script_heavy_ui FROM fam GROUP BY run_id),
r2 AS (SELECT *, has_api_calls OR ck AS requires_session, CASE WHEN mx THEN 'tiered_matrix' WHEN qt THEN 'explicit_quantity' ELSE 'unknown' END AS quantity_behavior_hint FROM ro),
r3 AS (SELECT *, array_to_string(list_filter([CASE WHEN requires_session THEN 'session_required' END, CASE WHEN has_token THEN 'token_management' END,
  CASE WHEN has_script_heavy_ui THEN 'stateful_configurator' END, CASE WHEN anti_bot_suspected THEN 'anti_bot_or_waf' END], lambda x: x IS NOT NULL), ',') AS blockers FROM r2)"""


@query("discovery_rollup", _traces(f", {ROLLUP_CTE} SELECT run_id, has_api_calls, requires_session, has_script_heavy_ui, payload_signal_score, response_signal_score, quantity_behavior_hint, blockers FROM r3"))
def discovery_rollup(spark, sf_dir):
    d = ep.discovery_rollup(scored(spark, sf_dir))
    return d.select("run_id", "has_api_calls", "requires_session", "has_script_heavy_ui", "payload_signal_score",
                    "response_signal_score", "quantity_behavior_hint", "blockers")


FEASIBLE_CTE = """fe AS (SELECT *, payload_signal_score >= 3 AND response_signal_score >= 3 AS strong FROM r3),
fs AS (SELECT *, CASE WHEN NOT has_api_calls AND NOT has_script_heavy_ui THEN 1 WHEN has_api_calls AND has_pricing_role AND NOT requires_session AND strong THEN 2
  WHEN requires_session AND has_api_calls AND has_pricing_role THEN 3 WHEN has_api_calls THEN 4 WHEN payload_signal_score > 0 OR response_signal_score > 0 THEN 8 WHEN has_script_heavy_ui THEN 9 ELSE 10 END AS decision_row FROM fe),
fz AS (SELECT *, CASE decision_row WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS complexity,
  CASE decision_row WHEN 1 THEN 'static_html' WHEN 2 THEN 'direct_http' WHEN 3 THEN CASE WHEN has_schema_role OR has_validation_role THEN 'hybrid' ELSE 'browser_automation' END
  WHEN 4 THEN CASE WHEN requires_session THEN 'hybrid' ELSE 'direct_http' END ELSE 'browser_automation' END AS strategy FROM fs)"""


@query("feasibility_decisions", _traces(f", {ROLLUP_CTE}, {FEASIBLE_CTE} SELECT run_id, complexity, strategy, decision_row, decision_row < 10 AS feasible FROM fz"))
def feasibility_decisions(spark, sf_dir):
    d = ep.feasibility(ep.discovery_rollup(scored(spark, sf_dir)))
    return d.select("run_id", "complexity", "strategy", "decision_row", "feasible")


PLAN_CTE = """pe AS (SELECT f.run_id, f.strategy, (SELECT arg_min(url, rank) FROM ranked r WHERE r.run_id = f.run_id AND r.score > 0) AS endpoint FROM fz f)"""


@query("planned_endpoints", _traces(f", {ck.RANKED_CTE}, {ROLLUP_CTE}, {FEASIBLE_CTE}, {PLAN_CTE} SELECT run_id, strategy, endpoint, CASE WHEN endpoint IS NULL THEN 0.65 ELSE 0.75 END AS plan_confidence, CASE WHEN endpoint IS NULL THEN 'none' ELSE 'ranked' END AS plan_source FROM pe"))
def planned_endpoints(spark, sf_dir):
    s = scored(spark, sf_dir)
    return ep.plan_endpoints(ep.feasibility(ep.discovery_rollup(s)), ep.ordered_endpoints(s))


@query("replay_candidate_list", _traces(f""", {ck.RANKED_CTE}, {ROLLUP_CTE}, {FEASIBLE_CTE}, {PLAN_CTE},
tg AS (SELECT run_id, 'https://www.shop.example.com/p/start-' || CAST(run_id AS VARCHAR) AS url FROM (SELECT DISTINCT run_id FROM traces)),
po AS (SELECT run_id, endpoint AS url, 0 AS tier, 0 AS ord, 'plan_endpoint' AS source FROM pe WHERE endpoint IS NOT NULL UNION ALL
  SELECT run_id, url, 1, rank, 'ranked_endpoint_' || CAST(rank - 1 AS VARCHAR) FROM ranked WHERE score > 0 UNION ALL
  SELECT run_id, url, 2, rank, 'family_rescued_' || request_family || '_' || CAST(rank - 1 AS VARCHAR) FROM ranked WHERE score <= 0 AND request_family IN {tuple(vocab.RESCUED_FAMILIES)}),
d1 AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY tier, ord) AS un FROM po),
e1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tier, ord) AS n FROM d1 WHERE un = 1) WHERE n <= 6),
la AS (SELECT run_id, url, 3 AS tier, 0 AS ord, 'target_product_url' AS source FROM tg UNION ALL
  SELECT run_id, url, 4, trace_idx, 'document_trace' FROM traces WHERE lower(resource_type) = 'document' AND status BETWEEN 200 AND 399),
d2 AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY tier, ord) AS un FROM la ANTI JOIN e1 USING (run_id, url)),
al AS (SELECT run_id, url, tier, ord, source FROM e1 UNION ALL SELECT run_id, url, tier, ord, source FROM d2 WHERE un = 1),
pl AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tier, ord) AS place FROM al)
SELECT run_id, place, url, source FROM pl WHERE place <= 8"""))
def replay_candidate_list(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    s = ep.score_traces(t)
    ranked = ep.rank_endpoints(s)
    planned = ep.plan_endpoints(ep.feasibility(ep.discovery_rollup(s)), ranked)
    targets = t.select("run_id").distinct().withColumn("url", F.concat(F.lit("https://www.shop.example.com/p/start-"), F.col("run_id").cast("string")))
    return ep.replay_candidates(ranked, planned, targets, t)


@query("remembered_endpoints", with_views(["traces"], f"""
WITH r AS (SELECT 'shop' || CAST(run_id % 7 AS VARCHAR) AS site_name, trace_idx AS run_no, url AS endpoint, method AS strategy FROM traces WHERE status = 200),
t AS (SELECT *, row_number() OVER (PARTITION BY site_name ORDER BY run_no DESC) AS rn FROM r),
u AS (SELECT * FROM t WHERE rn <= 10 AND NOT {ck.any_of('lower(endpoint)', vocab.UNUSABLE_ENDPOINT)})
SELECT site_name, arg_max(endpoint, run_no) AS endpoint, arg_max(strategy, run_no) AS strategy, max(run_no) AS run_no FROM u GROUP BY site_name"""))
def remembered_endpoints(spark, sf_dir):
    t = view(spark, sf_dir, "traces")
    runs = t.select(
        F.concat(F.lit("shop"), (F.col("run_id") % 7).cast("string")).alias("site_name"), F.col("trace_idx").alias("run_no"),
        F.col("url").alias("endpoint"), F.col("method").alias("strategy"), (F.col("status") == 200).alias("success"),
    )
    return ep.remembered_endpoints(runs)


# ---- URL expressions over the crawled pages ---------------------------------------------------------------------------

@query("page_url_keys", r"""
WITH p AS (SELECT page_id, url, lower(url) AS u, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, list_filter(list_transform(regexp_split_to_array(lower(path), '/'), lambda s: regexp_replace(s, '[^a-z0-9]+', '', 'g')), lambda s: s <> '') AS seg FROM p)
SELECT page_id, CASE WHEN len(seg) > 0 THEN '/' || array_to_string(seg, '/') ELSE '' END AS normalized_path,
  regexp_extract(u, '^([a-z]+)://', 1) || '://' || host || CASE WHEN len(seg) > 0 THEN '/' || array_to_string(seg, '/') ELSE '' END AS normalized_endpoint,
  regexp_replace(regexp_replace(host, ':[0-9]+$', ''), '^www\.', '') AS site_name,
  regexp_replace(host, '^www\.', '') || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END AS cache_key,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(u, '[^a-z0-9]+'), lambda t: t <> ''))), ' ') AS url_tokens
FROM q""")
def page_url_keys(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    u = F.col("url")
    return p.select(
        "page_id", urls.normalized_path(u).alias("normalized_path"), urls.normalized_endpoint(u).alias("normalized_endpoint"),
        urls.site_name(u).alias("site_name"), urls.cache_key(u).alias("cache_key"),
        F.array_join(F.sort_array(urls.url_tokens(u)), " ").alias("url_tokens"),
    )


@query("page_link_filters", f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, count(*) AS n, {ck.any_of('lower(href)', vocab.API_LIKE)} AS api_like, {ck.any_of('lower(href)', vocab.PRICE_NOISE_URL)} AS price_noise,
 {ck.any_of('lower(href)', vocab.UNUSABLE_ENDPOINT)} AS unusable FROM l GROUP BY href""")
def page_link_filters(spark, sf_dir):
    hrefs = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    n = hrefs.groupBy("href").agg(F.count(F.lit(1)).alias("n"))
    h = F.col("href")
    return n.select("href", "n", urls.is_api_like(h).alias("api_like"), urls.is_price_noise(h).alias("price_noise"),
                    urls.is_unusable_endpoint(h).alias("unusable"))


@query("slugged_sites", r"""
WITH s AS (SELECT page_id, url, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9._-]+', '-', 'g'), '-+', '-', 'g') AS s FROM pages)
SELECT page_id, coalesce(nullif(regexp_replace(s, '^[-._]+|[-._]+$', '', 'g'), ''), 'unknown') AS slug FROM s""")
def slugged_sites(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))
