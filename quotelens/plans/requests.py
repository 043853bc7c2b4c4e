"""Queries that build request tables and audit price-matrix responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions import optionlists as ol
from quotelens.functions.urls import encode_pairs, form_keys, form_pairs, redact_proxy
from quotelens.operators import matrix as mx
from quotelens.operators import requests as rq
from quotelens.operators.registry import SiteRule, site_candidates
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.registry import query


@query("template_traces", with_views(["traces"], """
WITH r(rule, url_part, body_part, url_points, body_points, post_points, min_score, take) AS (VALUES ('price', 'price-matrix', 'quantity', 10, 5, 2, 12, 'last'), ('detail', 'productdetails', 'configuration', 10, 5, 2, 10, 'first')),
s AS (SELECT run_id, rule, trace_idx, url, take, url_points + CASE WHEN contains(lower(post_data), body_part) THEN body_points ELSE 0 END + CASE WHEN method = 'POST' THEN post_points ELSE 0 END AS template_score, min_score FROM traces JOIN r ON contains(lower(url), url_part)),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, rule ORDER BY template_score DESC, CASE WHEN take = 'first' THEN -trace_idx ELSE trace_idx END DESC) AS rn FROM s WHERE template_score >= min_score)
SELECT run_id, rule, trace_idx, url, template_score FROM n WHERE rn = 1"""))
def template_traces(spark, sf_dir):
    rules = spark.createDataFrame(
        [("price", "price-matrix", "quantity", 10, 5, 2, 12, "last"), ("detail", "productdetails", "configuration", 10, 5, 2, 10, "first")],
        "rule string, url_part string, body_part string, url_points int, body_points int, post_points int, min_score int, take string",
    )
    return rq.pick_templates(view(spark, sf_dir, "traces"), rules, ["run_id"]).drop("post_data")


@query("last_template_values", with_views(["traces"], """
SELECT run_id, arg_max(CASE WHEN trace_idx % 10 = 1 THEN post_data->>'$.properties[0].value' END, trace_idx) FILTER (WHERE trace_idx % 10 = 1) AS last_value,
  coalesce(arg_min('de-' || upper(method), trace_idx) FILTER (WHERE method = 'POST'), 'de-DE') AS header_value FROM traces GROUP BY run_id"""))
def last_template_values(spark, sf_dir):
    t = view(spark, sf_dir, "traces").withColumn(
        "request_headers", F.create_map(F.lit("Accept-Language"), F.when(F.col("method") == "POST", F.concat(F.lit("de-"), F.upper("method"))).otherwise(" "))
    )
    value = F.nullif(F.regexp_extract("post_data", r'"id":44,"value":(\d+)', 1), F.lit(""))
    return rq.last_values(t, ["run_id"], value, "trace_idx").join(rq.first_header(t, ["run_id"], "accept-language", "trace_idx", "de-DE"), "run_id")


@query("endpoint_first_and_last_trace", with_views(["traces"], """
SELECT run_id, url, min(trace_idx) AS first_trace, max(trace_idx) AS last_trace, arg_max(status, trace_idx) AS last_status FROM traces GROUP BY ALL"""))
def endpoint_first_and_last_trace(spark, sf_dir):
    t = view(spark, sf_dir, "traces").select("run_id", "url", "trace_idx", "status")
    e = t.select("run_id", "url").distinct()
    first = rq.trace_by_url(e, t, ["run_id"]).select("run_id", "url", F.col("trace_idx").alias("first_trace"))
    last = rq.trace_by_url(e, t, ["run_id"], first=False).select("run_id", "url", F.col("trace_idx").alias("last_trace"), F.col("status").alias("last_status"))
    return first.join(last, ["run_id", "url"])


RULES = [
    ("a1", 1, "quantity", "$.items[0].qty", "int", None, False), ("a1", 2, "format", "format.code", "str", {"a5": "F5", "A4": "F4"}, True),
    ("a1", 3, "site", "$.meta.site", "", None, False), ("a1", 4, "format", "[0].x", "", None, False), ("a1", 5, "format", "meta.fmt", "float", None, False),
]
RULE_SCHEMA = "adapter_id string, rule_no int, input_key string, path string, cast_to string, value_map map<string,string>, require_mapped boolean"


def _inputs(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("input_key"), v.alias("raw_value")) for k, v in (
        ("quantity", F.when(F.col("unit_no") % 7 == 0, F.lit("many")).otherwise(F.col("quantity"))), ("format", F.col("format")), ("site", F.col("site_name")), ("cover", F.col("priority")))]))
    return u.select("unit_no", F.lit("a1").alias("adapter_id"), rows.alias("o")).select("unit_no", "adapter_id", "o.*")


AUDIT_SQL = """au AS (SELECT unit_no, 1 AS rule_no, 'quantity' AS input_key, CASE WHEN unit_no % 7 = 0 THEN 'cast_failed' ELSE 'applied' END AS status, CASE WHEN unit_no % 7 <> 0 THEN quantity END AS value_json FROM units
  UNION ALL SELECT unit_no, 2, 'format', CASE WHEN format IN ('A4','A5') THEN 'applied' ELSE 'value_not_in_map' END, CASE format WHEN 'A4' THEN '"F4"' WHEN 'A5' THEN '"F5"' END FROM units
  UNION ALL SELECT unit_no, 3, 'site', 'applied', '"' || site_name || '"' FROM units UNION ALL SELECT unit_no, 4, 'format', 'path_unreachable', NULL FROM units UNION ALL SELECT unit_no, 5, 'format', 'cast_failed', NULL FROM units)"""


@query("injection_audit", with_views(["units"], f"WITH {AUDIT_SQL} SELECT * FROM au"))
def injection_audit(spark, sf_dir):
    a = rq.injection_audit(_inputs(spark, sf_dir), spark.createDataFrame(RULES, RULE_SCHEMA), ["unit_no"])
    return a.select("unit_no", "rule_no", "input_key", "status", "value_json")


@query("adapter_requests", with_views(["units"], """
SELECT unit_no, 'https://www.shop' || CAST(run_id % 7 AS VARCHAR) || '.example.com/api/price' AS url, 'POST' AS method, 1 + CASE WHEN unit_no % 7 = 0 THEN 0 ELSE 1 END + CASE WHEN format IN ('A4','A5') THEN 1 ELSE 0 END AS injected,
 '{"items":[' || CASE WHEN unit_no % 7 = 0 THEN '' ELSE '{"qty":' || quantity || '}' END || '],"meta":{"v":1,"site":"' || site_name || '"}' || CASE format WHEN 'A4' THEN ',"format":{"code":"F4"}' WHEN 'A5' THEN ',"format":{"code":"F5"}' ELSE '' END || '}' AS body_text FROM units"""))
def adapter_requests(spark, sf_dir):
    audit = rq.injection_audit(_inputs(spark, sf_dir), spark.createDataFrame(RULES, RULE_SCHEMA), ["unit_no"])
    u = view(spark, sf_dir, "units").select(
        "unit_no", F.lit("a1").alias("adapter_id"), F.col("url").alias("target_url"), F.lit("/api/price").alias("endpoint_url"), F.lit("post").alias("endpoint_method"),
        F.lit('{"items":[],"meta":{"v":1}}').alias("request_template"),
    )
    d = rq.adapter_requests(rq.injected_bodies(u, audit, ["unit_no"]))
    return d.select("unit_no", "url", "method", "injected", "body_text")


@query("unsupported_inputs", with_views(["units"], "SELECT unit_no, 'a1' AS adapter_id, 'cover' AS input_key, priority AS raw_value FROM units"))
def unsupported_inputs(spark, sf_dir):
    return rq.unsupported_inputs(_inputs(spark, sf_dir), spark.createDataFrame(RULES, RULE_SCHEMA))


@query("adapter_matches", with_views(["units"], """
SELECT unit_no, 'shop' || CAST(run_id % 7 AS VARCHAR) || '.example.com' AS target_host, CASE WHEN run_id % 7 = 0 THEN 'zero' WHEN run_id % 7 = 1 AND regexp_matches(url, 'item-[0-9]*5/') THEN 'one' WHEN regexp_matches(url, 'item-77') THEN 'open' END AS adapter_id,
 CASE WHEN run_id % 7 = 0 OR (run_id % 7 = 1 AND regexp_matches(url, 'item-[0-9]*5/')) OR regexp_matches(url, 'item-77') THEN 'matched' ELSE 'url_regex_mismatch' END AS match_reason FROM units"""))
def adapter_matches(spark, sf_dir):
    a = spark.createDataFrame(
        [(0, "zero", ["WWW.shop0.example.com"], ""), (1, "one", ["shop1.example.com", "x.example.com"], r"item-\d*5/"), (2, "open", [], "item-77")],
        "adapter_no int, adapter_id string, domains array<string>, url_regex string",
    )
    return rq.match_adapters(view(spark, sf_dir, "units").select("unit_no", "url"), a, ["unit_no"])


@query("quantity_scale_requests", with_views(["units"], """
WITH u AS (SELECT unit_no, quantity, CASE WHEN CAST(quantity AS INTEGER) <= 200 AND unit_no % 2 = 0 THEN CAST(unit_no AS VARCHAR) END AS sid FROM units)
SELECT unit_no, 0 AS candidate_no, 'price_scale' AS kind, '{"a":1,"quantity":"' || quantity || '","isIndividualQuantity":false,"priceScaleId":"' || sid || '"}' AS body_text FROM u WHERE sid IS NOT NULL
UNION ALL SELECT unit_no, CASE WHEN sid IS NULL THEN 0 ELSE 1 END, 'quantity_manual', '{"a":1,"quantity":"' || quantity || '","isIndividualQuantity":true}' FROM u"""))
def quantity_scale_requests(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    preview = F.when(
        (F.col("quantity").cast("int") <= 200) & (F.col("unit_no") % 2 == 0),
        F.concat(F.lit('[{"id":9,"wert":1},{"id": '), F.col("unit_no").cast("string"), F.lit(',"wert": '), F.col("quantity"), F.lit("},{")),
    ).otherwise(F.lit('[{"id":9,"wert":1}'))
    d = u.select("unit_no", "quantity", preview.alias("preview"), F.lit('{"a":1,"quantity":"5"}').alias("template_body"))
    return rq.quantity_scale_requests(d).select("unit_no", "candidate_no", "kind", "body_text")


@query("query_parameter_requests", with_views(["units"], """
SELECT unit_no, 'https://t.example.com/-/content_size?' || 'AMOUNT=' || quantity || '&CONTENT_SIZE=' || format || '&PAGES=8&lang=de+at' AS request_url, CASE WHEN quantity = '100' THEN 'CONTENT_SIZE' ELSE 'AMOUNT,CONTENT_SIZE' END AS params_updated FROM units"""))
def query_parameter_requests(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    options = F.create_map(F.lit("auflage"), F.col("quantity"), F.lit("End Format"), F.col("format"), F.lit("pages"), F.lit(" 8 "), F.lit("cover"), F.lit(" "))
    d = u.select("unit_no", F.lit("https://t.example.com/-/content_size?lang=de+at&PAGES=8&AMOUNT=1&AMOUNT=100").alias("url"), options.alias("options"))
    return rq.query_requests(d, "url", "options").select("unit_no", "request_url", "params_updated")


@query("form_rewrite_requests", None)
def form_rewrite_requests(spark, sf_dir):
    """Form bodies with tile, free quantity and link updates; checked by brute force on a fixture."""
    p = view(spark, sf_dir, "form_posts")
    n = F.col("post_no")
    d = p.select(
        "post_no", "post_data", F.when(n % 5 == 0, F.lit("")).otherwise(F.lit("input_var_ZB_1_1")).alias("field_name"), F.lit("123").alias("field_value"),
        F.lit("AG7").alias("group_code"), F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("N"), n.cast("string"))).alias("option_code"),
        (n % 4 == 1).alias("code_unknown"), (n % 8 == 1).alias("is_selected"), F.when(n % 2 == 0, F.lit("interpolation")).alias("quantity_mode"),
    )
    return rq.form_requests(d).select("post_no", "body_text", "form_changed", "new_setlink", "skip_reason")


@query("form_body_keys", with_views(["form_posts"], """
SELECT post_no, 'sku,input_var_ZB_1_1,input_var_ZB_1_2,input_var_ZB_1_3,note,SetLink' AS form_keys, 6 AS pair_count FROM form_posts"""))
def form_body_keys(spark, sf_dir):
    p = view(spark, sf_dir, "form_posts")
    return p.select("post_no", F.array_join(form_keys(F.col("post_data")), ",").alias("form_keys"), F.size(form_pairs(F.col("post_data"))).alias("pair_count"))


@query("cover_form_bodies", with_views(["form_posts"], """
SELECT post_no, 'sku=4&b=1&input_var_ZBRNEW_1_2=C' || CAST(post_no % 4 AS VARCHAR) AS body_text FROM form_posts"""))
def cover_form_bodies(spark, sf_dir):
    body = F.concat(F.lit("sku=4&input_var_ZBRA1_1_2=old&b="), F.lit("1"), F.lit("&input_var_ZBR22_1_2=older"))
    pairs = mx.set_cover(form_pairs(body), F.lit("input_var_ZBRNEW_1_2"), F.concat(F.lit("C"), (F.col("post_no") % 4).cast("string")))
    return view(spark, sf_dir, "form_posts").select("post_no", encode_pairs(pairs).alias("body_text"))


@query("interpolated_quantity_forms", with_views(["units"], """
SELECT unit_no, CASE unit_no % 3 WHEN 0 THEN 'a=1&q=Interpolation&x=2&input_qty_1=' || quantity || '&input_qty_1=9' WHEN 1 THEN 'input_qty_1=7&q=Interpolation&input_qty_1=' || quantity || '&x=2' ELSE 'a=1&x=2' END AS body_text FROM units"""))
def interpolated_quantity_forms(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    n = F.col("unit_no") % 3
    body = F.when(n == 0, "a=1&q=50&x=2&input_qty_1=5&input_qty_1=9").when(n == 1, "input_qty_1=7&q=50&x=2").otherwise("a=1&x=2")
    return u.select("unit_no", encode_pairs(rq.interpolated_quantity(form_pairs(body), F.lit("q"), F.col("quantity"))).alias("body_text"))


@query("property_id_bodies", with_views(["units"], """
SELECT unit_no, '[{"name":"format","id":"' || format || '"},{"name":"quantity","id":"' || CASE WHEN unit_no % 2 = 0 THEN quantity ELSE '7' END || '"},{"name":"paper","id":"1"}]' AS properties,
 CASE WHEN unit_no % 2 = 0 THEN 'format,quantity' ELSE 'format' END AS changed FROM units"""))
def property_id_bodies(spark, sf_dir):
    props = F.from_json(F.lit('[{"name":"format","id":"1"},{"name":"quantity","id":"7"},{"name":"paper","id":"1"}]'), "array<struct<name:string,id:string>>")
    desired = F.when(F.col("unit_no") % 2 == 0, F.create_map(F.lit("format"), F.col("format"), F.lit("quantity"), F.col("quantity"))).otherwise(F.create_map(F.lit("format"), F.col("format")))
    new, changed = rq.property_id_body(props, desired)
    return view(spark, sf_dir, "units").select("unit_no", F.to_json(new).alias("properties"), changed.alias("changed"))


@query("property_configurations", """
WITH b AS (SELECT l_orderkey AS k, l_linenumber AS p, max(l_partkey) AS v FROM lineitem GROUP BY ALL),
o AS (SELECT l_orderkey AS k, l_linenumber AS p, arg_min(v, r) AS nv FROM (SELECT l_orderkey, l_linenumber, 0 AS r, max(l_suppkey) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL UNION ALL SELECT l_orderkey, l_linenumber, 1, min(l_partkey) FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY ALL),
j AS (SELECT b.k, b.p, coalesce(nv, v) AS x, nv IS NOT NULL AND nv <> v AS c FROM b LEFT JOIN o ON b.k = o.k AND b.p = o.p)
SELECT k AS l_orderkey, '[' || string_agg('{"id":' || CAST(p AS VARCHAR) || ',"value":' || CAST(x AS VARCHAR) || '}', ',' ORDER BY p) || ']' AS property_configuration, count(*) FILTER (WHERE c) AS properties_changed FROM j GROUP BY k""")
def property_configurations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_linenumber", "property_no")
    keys = ["l_orderkey", "property_no"]
    base = li.groupBy(*keys).agg(F.max("l_partkey").alias("value_no"))
    o1 = li.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.max("l_suppkey").alias("value_no")).withColumn("source_rank", F.lit(0))
    o2 = li.filter("l_linestatus = 'F'").groupBy(*keys).agg(F.min("l_partkey").alias("value_no")).withColumn("source_rank", F.lit(1))
    return rq.property_configuration(base, o1.unionByName(o2), ["l_orderkey"])


@query("brochure_properties", with_views(["units"], """
SELECT unit_no, CASE WHEN product_type = 'brochure' THEN CASE unit_no % 5 WHEN 0 THEN 36 WHEN 1 THEN 8 WHEN 2 THEN 10 WHEN 3 THEN 37 END END AS property_no FROM units"""))
def brochure_properties(spark, sf_dir):
    key = F.element_at(F.array(*[F.lit(k) for k in ("umschlag_material", "Material", "seiten", "umschlag__farbe_", "other")]), (F.col("unit_no") % 5 + 1).cast("int"))
    return view(spark, sf_dir, "units").select("unit_no", rq.brochure_property(key, F.col("product_type") == "brochure").alias("property_no"))


# ---- request audit ----------------------------------------------------------------------------------------------------------------

@query("redacted_request_headers", with_views(["traces"], """
SELECT trace_idx, 'Authorization=<redacted>;Cookie=<redacted>;accept=' || CASE WHEN response_content_type = '' THEN '*/*' ELSE response_content_type END AS headers,
 'http://p' || CAST(run_id % 9 AS VARCHAR) || '.example.com:8080' AS proxy FROM traces"""))
def redacted_request_headers(spark, sf_dir):
    from quotelens.functions import vocab

    h = F.create_map(F.lit("Cookie"), F.lit("sid=1"), F.lit("Authorization"), F.lit("Bearer x"), F.lit("accept"), F.coalesce(F.nullif("response_content_type", F.lit("")), F.lit("*/*")))
    safe = F.transform_values(h, lambda k, v: F.when(F.lower(F.trim(k)).isin(vocab.REDACTED_HEADERS), F.lit("<redacted>")).otherwise(v))
    flat = F.array_join(F.array_sort(F.transform(F.map_entries(safe), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    proxy = F.concat(F.lit("http://user:pw@p"), (F.col("run_id") % 9).cast("string"), F.lit(".example.com:8080"))
    return view(spark, sf_dir, "traces").select("trace_idx", flat.alias("headers"), redact_proxy(proxy).alias("proxy"))


@query("captured_preview_policy", with_views(["traces"], """
SELECT trace_idx, resource_type IN ('xhr','fetch') OR contains(response_content_type, 'json') OR contains(lower(url), '/api') AS captured, length(response_body_preview) AS body_len,
 CASE WHEN resource_type IN ('xhr','fetch') OR contains(response_content_type, 'json') OR contains(lower(url), '/api') THEN length(response_body_preview) > 100 END AS truncated FROM traces"""))
def captured_preview_policy(spark, sf_dir):
    from quotelens.sources.capture import preview_policy

    d = preview_policy(view(spark, sf_dir, "traces"), "response_body_preview", cap=100)
    return d.select("trace_idx", "captured", "body_len", "truncated")


# ---- price matrix --------------------------------------------------------------------------------------------------------------------


def _matrix(spark, sf_dir):
    """Stored bulk responses derived from orders: totals, cover inputs, typed quantity and link."""
    u = view(spark, sf_dir, "units")
    q = F.when(F.col("unit_no") % 3 == 0, F.lit(25000)).otherwise(F.col("quantity").cast("int"))
    cents = F.col("expected_cents")
    money = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    total = F.concat(
        F.lit("<span>netto</span><span class='n'> &euro; "), money(cents), F.lit("</span><b class=\"productConfigTotalPriceBruttoPrice\"> &euro; "),
        money(cents * 2), F.lit("</b>"),
    )
    cover = F.concat(F.lit('<input type="radio" name="input_var_ZBRA3_1_2" value="C0"'), F.when(F.col("unit_no") % 2 == 0, " checked").otherwise(""), F.lit('><input value="C1" '),
                     F.when(F.col("unit_no") % 2 == 1, "checked ").otherwise(""), F.lit('name="input_var_ZBRA3_1_2">'))
    config = F.concat(F.lit('<input name="input_var_ZB_3_1" checked value="Interpolation"><input type="number" name="input_qty_1" value="'), F.when(F.col("unit_no") % 9 == 0, F.lit("24000")).otherwise(q.cast("string")), F.lit('">'))
    link = F.when(F.col("unit_no") % 10 != 0, F.concat(F.lit("x;productPageObj.setLink='/c?a=1&amp;b="), F.col("unit_no").cast("string"), F.lit("';"))).otherwise("none")
    names = mx.PARTS
    body = F.to_json(F.struct(
        F.when(F.col("unit_no") % 13 != 0, total).alias(names["total"]), cover.alias(names["extra"]), F.lit("<p></p>").alias(names["essential"]), config.alias(names["config"]), link.alias(names["init"]),
    ))
    return u.select("unit_no", q.alias("quantity"), F.lit("ZB").alias("prod"), F.lit("C0").alias("cover"), body.alias("body"))


@query("price_matrix_audit", with_views(["units"], """
WITH q AS (SELECT *, CASE WHEN unit_no % 3 = 0 THEN 25000 ELSE CAST(quantity AS INTEGER) END AS qty FROM units)
SELECT unit_no, CASE WHEN unit_no % 13 <> 0 AND expected_cents > 0 AND expected_cents <= 100000000 THEN expected_cents / 100 END AS net, CASE WHEN unit_no % 13 <> 0 AND expected_cents * 2 <= 100000000 THEN expected_cents * 2 / 100 END AS gross,
 CASE WHEN unit_no % 10 <> 0 THEN '/c?a=1&b=' || CAST(unit_no AS VARCHAR) END AS next_setlink, CASE WHEN unit_no % 2 = 0 THEN 'C0' ELSE 'C1' END AS accepted_cover, CASE WHEN unit_no % 9 = 0 THEN 24000 ELSE qty END AS typed_quantity,
 array_to_string(list_filter([CASE WHEN unit_no % 13 = 0 THEN 'price_missing' END, CASE WHEN unit_no % 2 = 1 THEN 'cover_mismatch' END, CASE WHEN qty >= 20000 AND unit_no % 9 = 0 THEN 'quantity_mismatch' END, CASE WHEN unit_no % 10 = 0 THEN 'next_link_missing' END], lambda x: x IS NOT NULL), ',') AS issues FROM q"""))
def price_matrix_audit(spark, sf_dir):
    d = mx.audit(_matrix(spark, sf_dir), "body", "prod", "quantity", "cover")
    return d.select("unit_no", "net", "gross", "next_setlink", "accepted_cover", "typed_quantity", "issues")


@query("cover_value_offers", with_views(["units"], "SELECT unit_no, true AS offers_c1, false AS offers_c9 FROM units"))
def cover_value_offers(spark, sf_dir):
    d = mx.response_parts(_matrix(spark, sf_dir), "body")
    f = F.lit("input_var_ZBRA3_1_2")
    return d.select("unit_no", mx.offers_value(F.col("part_extra"), f, F.lit("C1")).alias("offers_c1"), mx.offers_value(F.col("part_extra"), f, F.lit("C9")).alias("offers_c9"))


@query("failed_matrix_pairs", """
SELECT DISTINCT 'U' || CAST(o_custkey AS VARCHAR) AS uid, CAST(25 * (1 + o_orderkey % 12) AS INTEGER) AS quantity FROM orders WHERE o_orderstatus = 'P'""")
def failed_matrix_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" U"), F.col("o_custkey").cast("string")).alias("UID"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("timeout at qty="), (25 * (1 + F.col("o_orderkey") % 12)).cast("string"), F.lit(" try 3"))).otherwise("bad response").alias("error"),
    )
    return mx.failed_pairs(o, "UID", "error")


# ---- option lists of responses, site rules ----------------------------------------------------------------------------------------

@query("quantity_value_lists", with_views(["option_bodies"], """
SELECT part_no, CASE part_no % 3 WHEN 2 THEN '' ELSE CAST(25 * size_no AS VARCHAR) || ',' || CAST(50 * size_no AS VARCHAR) END AS quantities, CASE part_no % 3 WHEN 2 THEN '' ELSE CAST(size_no AS VARCHAR) || ',' || CAST(size_no + 1 AS VARCHAR) END AS others,
 CASE part_no % 3 WHEN 2 THEN NULL ELSE CAST(50 * size_no AS VARCHAR) END AS runs FROM option_bodies"""))
def quantity_value_lists(spark, sf_dir):
    """Allowed quantities of whole and cut responses, and the print runs from one of them on."""
    b = view(spark, sf_dir, "option_bodies")
    ids = ol.quantity_value_options(F.col("body"), F.lit(44))
    # of the cut list of the first property every body has a closed one, but in the shortest its text ends in the second
    first = F.when(F.col("part_no") % 3 < 2, ol.quantity_value_options(F.col("body"), F.lit(7))).otherwise(F.array().cast("array<bigint>"))
    runs = ol.print_runs(ids, (F.col("size_no") * 50).cast("bigint"))
    return b.select("part_no", F.array_join(ids, ",").alias("quantities"), F.array_join(first, ",").alias("others"), F.array_join(runs, ",").alias("runs"))


@query("property_option_lists", with_views(["option_bodies"], """
SELECT part_no, unnest([7, 44])::BIGINT AS property_id, unnest([false, true]) AS is_range, unnest([CAST(size_no AS VARCHAR) || ',' || CAST(size_no + 1 AS VARCHAR), CAST(50 * size_no AS VARCHAR) || ',' || CAST(25 * size_no AS VARCHAR) || ',' || CAST(50 * size_no AS VARCHAR)]) AS value_ids FROM option_bodies WHERE part_no % 3 = 0"""))
def property_option_lists(spark, sf_dir):
    rows = view(spark, sf_dir, "option_bodies").select("part_no", F.inline(ol.property_options(F.col("body"))))
    return rows.withColumn("value_ids", F.array_join("value_ids", ","))


@query("preview_configurations", with_views(["option_bodies"], """
SELECT part_no, unnest(['Format', 'Papier']) AS field, unnest(['A' || CAST(size_no % 8 AS VARCHAR), paper]) AS value FROM option_bodies WHERE part_no % 3 < 2"""))
def preview_configurations(spark, sf_dir):
    return view(spark, sf_dir, "option_bodies").select("part_no", F.explode(ol.preview_configuration(F.col("body"))).alias("field", "value"))


def _query_rule(unit):
    yield "GET", f"{unit['url']}?AMOUNT={unit['quantity']}", None
    if unit["format"] == "A5":
        yield "GET", f"{unit['url']}?AMOUNT={unit['quantity']}&FORMAT=A5", None


def _form_rule(unit):
    if unit["product_type"] != "unknown":
        yield "POST", unit["url"], f"quantity={unit['quantity']}&format={unit['format']}"


SITE_RULES = [SiteRule("query", ("shop1.", "shop2."), _query_rule), SiteRule("form", ("shop2.", "shop3."), _form_rule)]


@query("site_rule_candidates", with_views(["units"], """
WITH g AS (SELECT * FROM units WHERE contains(site_name, 'shop1.') OR contains(site_name, 'shop2.')), f AS (SELECT * FROM units WHERE (contains(site_name, 'shop2.') OR contains(site_name, 'shop3.')) AND product_type <> 'unknown')
SELECT unit_no, 0 AS rule_no, 'query' AS rule, 0 AS candidate_no, 'GET' AS method, url || '?AMOUNT=' || quantity AS url, NULL AS body FROM g
UNION ALL SELECT unit_no, 0, 'query', 1, 'GET', url || '?AMOUNT=' || quantity || '&FORMAT=A5', NULL FROM g WHERE format = 'A5'
UNION ALL SELECT unit_no, 1, 'form', 0, 'POST', url, 'quantity=' || quantity || '&format=' || format FROM f"""))
def site_rule_candidates(spark, sf_dir):
    u = view(spark, sf_dir, "units").select("unit_no", "site_name", "url", "product_type", "quantity", "format")
    return site_candidates(u, SITE_RULES, "unit_no")
