"""Queries over option catalogs, page controls and form fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions.text import compact_key, match_text
from quotelens.operators import catalog as ct
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.registry import query

MT = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("label_match_keys", f"""
SELECT p_partkey, {MT.format("p_name || ' and ' || p_type || '-' || p_brand")} AS match_key,
  regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '', 'g') AS compact_key FROM part""")
def label_match_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat_ws("", "p_name", F.lit(" & "), "p_type", F.lit("-"), "p_brand")
    return p.select("p_partkey", match_text(text).alias("match_key"), compact_key(F.concat_ws(" ", "p_name", "p_brand")).alias("compact_key"))


@query("document_text_keys", r"""
SELECT doc_id, length(trim(regexp_replace(replace(x, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))) AS key_chars, sha1(trim(regexp_replace(replace(x, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))) AS key_sha
FROM (SELECT doc_id, regexp_replace(replace(replace(replace(replace(strip_accents(lower(trim(text))), '²', '2'), 'ª', 'a'), 'º', 'o'), '³', '3'), '[^\x00-\x7f]+', '', 'g') AS x FROM documents)""")
def document_text_keys(spark, sf_dir):
    k = match_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(k).alias("key_chars"), F.sha1(k).alias("key_sha"))


@query("label_similarity", f"""
WITH l AS (SELECT p_partkey, {MT.format('p_name')} AS a, {MT.format("CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' xl' WHEN 2 THEN replace(p_name, ' ', '') WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE 'zz' END")} AS b FROM part),
c AS (SELECT *, replace(a, ' ', '') AS ac, replace(b, ' ', '') AS bc FROM l)
SELECT p_partkey, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 30 WHEN contains(a, b) OR contains(b, a) THEN 20 WHEN ac = bc THEN 24 WHEN contains(ac, bc) OR contains(bc, ac) THEN 16
  ELSE least(14, 4 * len(list_intersect(string_split(a, ' '), string_split(b, ' ')))) END AS score FROM c""")
def label_similarity(spark, sf_dir):
    from quotelens.functions.text import match_score

    p = table(spark, sf_dir, "part")
    n, k = F.col("p_name"), F.col("p_partkey") % 5
    other = (
        F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" XL"))).when(k == 2, F.replace(n, F.lit(" "), F.lit("")))
        .when(k == 3, F.concat(F.split_part(n, F.lit(" "), F.lit(2)), F.lit(" "), F.split_part(n, F.lit(" "), F.lit(1)))).otherwise("zz")
    )
    return p.select("p_partkey", match_score(n, other).alias("score"))


CLUSTER_LABEL = """CASE p_partkey % 8 WHEN 0 THEN CAST(80 + p_size AS VARCHAR) || ' g/m² Offset' WHEN 1 THEN 'Umschlag ' || CAST(100 + p_size AS VARCHAR) || ' g/m2 matt' WHEN 2 THEN '4/0-farbig' WHEN 3 THEN 'Klebebindung ' || p_name
  WHEN 4 THEN 'UV-Lack ' || p_name WHEN 5 THEN '  ' ELSE p_name END"""


@query("regrouped_option_groups", rf"""
WITH g AS (SELECT p_brand AS snapshot_id, p_partkey AS group_ord, {CLUSTER_LABEL} AS group_label, CASE WHEN p_size > 40 THEN 3 ELSE 1 END AS option_count FROM part),
c AS (SELECT *, CASE WHEN option_count <> 1 OR trim(group_label) = '' THEN NULL
   WHEN regexp_matches(lower(group_label), '^\s*umschlag\s+[0-9]+\s*g\s*/\s*m[²2]?') THEN 'material (umschlag)' WHEN regexp_matches(lower(group_label), '^\s*[0-9]+\s*g\s*/\s*m[²2]?\s*\S') THEN 'material (innen)'
   WHEN regexp_matches(lower(group_label), '^\s*[0-9]+\s*/\s*[0-9]+\s*(?:-?\s*farbig|\s+euroskala|\s+pantone|\s+hks)') THEN 'color'
   WHEN regexp_matches(lower(group_label), '\b(klammerheftung|klebebindung|spiralbindung|wire[-\s]?o|fadenheftung|ringbindung)\b') THEN 'binding'
   WHEN regexp_matches(lower(group_label), '\b(cellophan|matt\s*folien|gl(?:a|ä)nz\s*folien|uv[-\s]*lack|hei(?:ß|ss)folien|pr(?:ä|a)gung)\b') THEN 'finishing' END AS cl FROM g),
n AS (SELECT *, count(cl) OVER (PARTITION BY snapshot_id, cl) AS n FROM c)
SELECT snapshot_id, group_ord, CASE WHEN cl IS NOT NULL AND n >= 2 THEN cl ELSE coalesce(nullif(trim(group_label), ''), 'unknown') END AS catalog_group, cl IS NOT NULL AND n >= 2 AS synthesized FROM n""")
def regrouped_option_groups(spark, sf_dir):
    g = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("snapshot_id"), F.col("p_partkey").alias("group_ord"),
        F.expr(CLUSTER_LABEL.replace("VARCHAR", "STRING")).alias("group_label"), F.expr("CASE WHEN p_size > 40 THEN 3 ELSE 1 END").alias("option_count"),
    )
    return ct.regroup_singletons(g, ["snapshot_id"]).select("snapshot_id", "group_ord", "catalog_group", "synthesized")


@query("option_group_profile", with_views(["catalog_options"], """
WITH f AS (SELECT snapshot_id, group_label, visible_label AS v, min(option_no) AS o FROM catalog_options GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, group_label ORDER BY o) AS rn, count(*) OVER (PARTITION BY snapshot_id, group_label) AS n FROM f)
SELECT r.snapshot_id, r.group_label, max(n) AS option_count, max(k.kinds) AS control_types, max(k.sel) AS selected_count, string_agg(v, '|' ORDER BY o) FILTER (WHERE rn <= 8) AS sample_values, max(n) > 30 AS truncated
FROM r JOIN (SELECT snapshot_id, group_label, array_to_string(list_sort(list(DISTINCT control_type)), ',') AS kinds, count(*) FILTER (WHERE selected) AS sel FROM catalog_options GROUP BY ALL) k USING (snapshot_id, group_label) GROUP BY 1, 2"""))
def option_group_profile(spark, sf_dir):
    d = ct.option_groups(view(spark, sf_dir, "catalog_options"), ["snapshot_id"], "option_no")
    return d.select("snapshot_id", "group_label", "option_count", "control_types", "selected_count", "sample_values", "truncated")


@query("option_dependency_edges", """
WITH s AS (SELECT l_suppkey, l_returnflag AS source, l_linestatus AS target, CASE WHEN l_linenumber % 2 = 0 THEN 'enabled' ELSE 'visible' END || '-' || CAST(l_linenumber % 3 AS VARCHAR) AS signal FROM lineitem)
SELECT l_suppkey, source, target, count(DISTINCT signal) AS strength, array_to_string(list_sort(list(DISTINCT signal)), ',') AS signals FROM s GROUP BY ALL""")
def option_dependency_edges(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("target"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN 'enabled' ELSE 'visible' END || '-' || CAST(l_linenumber % 3 AS STRING)").alias("signal"),
    )
    return ct.dependency_edges(s, ["l_suppkey"])


@query("probe_effect_groups", """
WITH b AS (SELECT p_brand, p_type AS group_label, count(*) AS t, count(*) FILTER (WHERE p_size > 5) AS e FROM part WHERE p_size < 45 GROUP BY ALL),
a AS (SELECT p_brand, p_type AS group_label, count(*) AS t, count(*) FILTER (WHERE p_size > 7) AS e FROM part WHERE p_size < 48 GROUP BY ALL)
SELECT coalesce(b.p_brand, a.p_brand) AS p_brand, coalesce(b.group_label, a.group_label) AS group_label, coalesce(b.t, 0) AS before_total, coalesce(b.e, 0) AS before_enabled,
 coalesce(a.t, 0) AS after_total, coalesce(a.e, 0) AS after_enabled, coalesce(b.t, 0) <> coalesce(a.t, 0) OR coalesce(b.e, 0) <> coalesce(a.e, 0) AS changed
FROM b FULL JOIN a ON b.p_brand = a.p_brand AND b.group_label = a.group_label""")
def probe_effect_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumnRenamed("p_type", "group_label")
    before = p.filter("p_size < 45").withColumn("enabled", F.col("p_size") > 5)
    after = p.filter("p_size < 48").withColumn("enabled", F.col("p_size") > 7)
    return ct.probe_effects(before, after, ["p_brand"])


@query("quantity_tile_signals", """
WITH o AS (SELECT p_brand, p_partkey AS no, CASE WHEN p_partkey % 11 = 0 THEN 'Interpolation' WHEN p_partkey % 7 = 0 THEN p_name ELSE CAST(p_size * 100 AS VARCHAR) END AS v, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'V' || CAST(p_partkey AS VARCHAR) END AS code FROM part),
t AS (SELECT p_brand, CAST(v AS INTEGER) AS n FROM o WHERE regexp_full_match(v, '[0-9]+') GROUP BY ALL),
l AS (SELECT p_brand, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS tile_presets, CAST(max(n) AS DOUBLE) AS max_tile_preset FROM t GROUP BY p_brand),
i AS (SELECT p_brand, arg_min(code, no) FILTER (WHERE v = 'Interpolation' AND code <> '') AS interpolation_code FROM o GROUP BY p_brand)
SELECT i.p_brand, interpolation_code, tile_presets, max_tile_preset, interpolation_code IS NOT NULL AS supports_interpolation FROM i LEFT JOIN l USING (p_brand)""")
def quantity_tile_signals(spark, sf_dir):
    o = table(spark, sf_dir, "part").selectExpr(
        "p_brand", "p_partkey AS no",
        "CASE WHEN p_partkey % 11 = 0 THEN 'Interpolation' WHEN p_partkey % 7 = 0 THEN p_name ELSE CAST(p_size * 100 AS STRING) END AS visible_value",
        "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'V' || CAST(p_partkey AS STRING) END AS varindex",
    )
    return ct.quantity_tiles(o, ["p_brand"], "no")


@query("quantity_control_mode", """
WITH c AS (SELECT p_name, CASE p_size % 4 WHEN 0 THEN 'number' ELSE 'radio' END AS ct, CAST(p_size * 7 AS VARCHAR) || ' pcs' AS v FROM part),
a AS (SELECT p_name, bool_or(ct = 'number') AS has_manual_input, count(DISTINCT CASE WHEN ct <> 'number' THEN TRY_CAST(nullif(regexp_extract(v, '\\b([0-9]{2,6})\\b', 1), '') AS INTEGER) END) AS preset_count FROM c GROUP BY p_name)
SELECT *, CASE WHEN has_manual_input AND preset_count > 0 THEN 'mixed' WHEN has_manual_input THEN 'manual_only' WHEN preset_count > 0 THEN 'preset_only' ELSE 'unknown' END AS mode FROM a""".replace("\\\\", "\\"))
def quantity_control_mode(spark, sf_dir):
    c = table(spark, sf_dir, "part").selectExpr("p_name", "CASE p_size % 4 WHEN 0 THEN 'number' ELSE 'radio' END AS control_type", "CAST(p_size * 7 AS STRING) || ' pcs' AS visible_value")
    return ct.quantity_mode(c, ["p_name"])


@query("print_run_tiers", """
WITH t AS (SELECT DISTINCT p_brand, p_size * 50 AS tier FROM part), q AS (SELECT DISTINCT 'Brand#' || CAST(1 + o_custkey % 25 AS VARCHAR) AS p_brand, CAST(25 * (1 + o_orderkey % 40) AS INTEGER) AS quantity FROM orders),
h AS (SELECT q.p_brand, q.quantity, t.tier, row_number() OVER (PARTITION BY q.p_brand, q.quantity ORDER BY t.tier) AS rn FROM q JOIN t ON q.p_brand = t.p_brand AND t.tier >= q.quantity
  WHERE EXISTS (SELECT 1 FROM t x WHERE x.p_brand = q.p_brand AND x.tier = q.quantity))
SELECT p_brand, quantity, string_agg(CAST(tier AS VARCHAR), ',' ORDER BY tier) AS print_runs FROM h WHERE rn <= 4 GROUP BY ALL""")
def print_run_tiers(spark, sf_dir):
    tiers = table(spark, sf_dir, "part").select("p_brand", (F.col("p_size") * 50).alias("tier"))
    want = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Brand#"), (1 + F.col("o_custkey") % 25).cast("string")).alias("p_brand"), (25 * (1 + F.col("o_orderkey") % 40)).cast("int").alias("quantity")
    )
    return ct.tier_slice(tiers, ["p_brand"], "tier", want, "quantity")


# ---- markup ---------------------------------------------------------------------------------------------------------------

@query("html_option_inputs", with_views(["option_html"], """
WITH p AS (SELECT snapshot_id, part_no, replace(replace(replace(html, chr(92) || '"', '"'), chr(92) || 'u003c', '<'), chr(92) || 'u003e', '>') AS h FROM option_html),
t AS (SELECT snapshot_id, part_no, unnest(regexp_extract_all(h, '<input\\b[^>]*>')) AS tag FROM p)
SELECT part_no, regexp_extract(tag, 'name="([^"]*)"', 1) AS field_name, regexp_extract(tag, ' value="([^"]*)"', 1) AS visible_value, regexp_extract(tag, 'data-varindex="([^"]*)"', 1) AS varindex
FROM t WHERE contains(tag, 'name="input_var_')"""))
def html_option_inputs(spark, sf_dir):
    return ct.option_inputs(view(spark, sf_dir, "option_html"), ["part_no"], F.col("html")).select("part_no", "field_name", "visible_value", "varindex")


@query("distinct_option_variants", with_views(["option_html"], """
WITH p AS (SELECT snapshot_id, part_no, replace(replace(replace(html, chr(92) || '"', '"'), chr(92) || 'u003c', '<'), chr(92) || 'u003e', '>') AS h FROM option_html),
v AS (SELECT snapshot_id, part_no, regexp_extract(h, 'name="(input_var_[^"]*)"', 1) AS field_name, regexp_extract(h, ' value="([^"]*)"', 1) AS visible_value, regexp_extract(h, 'data-varindex="([^"]*)"', 1) AS varindex FROM p)
SELECT snapshot_id, field_name, min(part_no) AS part_no, arg_min(visible_value, part_no) AS visible_value, arg_min(varindex, part_no) AS varindex FROM v GROUP BY snapshot_id, field_name, lower(visible_value)"""))
def distinct_option_variants(spark, sf_dir):
    v = ct.option_inputs(view(spark, sf_dir, "option_html"), ["snapshot_id", "part_no"], F.col("html"))
    d = ct.distinct_variants(v, ["snapshot_id"], [F.col("part_no"), F.col("tag_no")])
    return d.select("snapshot_id", "field_name", "part_no", "visible_value", "varindex")


@query("page_control_records", with_views(["option_html"], """
WITH t AS (SELECT part_no, unnest(regexp_extract_all(html, '<input\\b[^>]*>')) AS tag FROM option_html WHERE part_no % 2 = 0)
SELECT part_no, regexp_extract(tag, 'type="([^"]*)"', 1) AS control_type, regexp_extract(tag, ' name="([^"]*)"', 1) AS name, regexp_extract(tag, ' value="([^"]*)"', 1) AS value, regexp_matches(tag, ' checked') AS selected FROM t
UNION ALL SELECT part_no, 'input', 'input_var_ZB_1_' || CAST(1 + part_no % 3 AS VARCHAR), p_name, false FROM option_html JOIN part ON p_partkey = part_no WHERE part_no % 2 = 1"""))
def page_control_records(spark, sf_dir):
    c = ct.page_controls(view(spark, sf_dir, "option_html"), ["part_no"], F.col("html"))
    return c.select("part_no", "control_type", "name", "value", "selected")


@query("form_payload_pairs", with_views(["option_html"], """
SELECT part_no, 'input_var_ZB_1_' || CAST(1 + part_no % 3 AS VARCHAR) AS key, p_name AS value FROM option_html JOIN part ON p_partkey = part_no WHERE part_no % 2 = 1 OR part_no % 10 = 0
UNION ALL SELECT part_no, 'sid', 's' || CAST(p_size AS VARCHAR) FROM option_html JOIN part ON p_partkey = part_no WHERE part_no % 2 = 0"""))
def form_payload_pairs(spark, sf_dir):
    c = ct.page_controls(view(spark, sf_dir, "option_html"), ["part_no"], F.col("html"))
    return ct.form_payload(c, ["part_no"]).select("part_no", "key", "value")


@query("selected_configuration", with_views(["option_html"], """
SELECT snapshot_id, 'ZB 1 ' || CAST(1 + part_no % 3 AS VARCHAR) AS group_label, array_to_string(list_sort(list(DISTINCT p_name)), ' | ') AS selected_values
FROM option_html JOIN part ON p_partkey = part_no WHERE part_no % 10 = 0 GROUP BY ALL"""))
def selected_configuration(spark, sf_dir):
    c = ct.page_controls(view(spark, sf_dir, "option_html"), ["snapshot_id"], F.col("html"))
    return ct.selected_configuration(c, ["snapshot_id"])


@query("page_template_facts", r"""
SELECT page_id, len(regexp_extract_all(html, '<form\b')) AS form_count, len(regexp_extract_all(html, '<input\b[^>]*type="hidden"')) AS hidden_input_count, len(regexp_extract_all(html, '<script\b')) AS script_count,
 len(regexp_extract_all(html, '<a\b[^>]*href=')) AS link_count, 0 AS depvar_hints, '' AS current_setlink FROM pages""")
def page_template_facts(spark, sf_dir):
    return ct.template_facts(table(spark, sf_dir, "pages"), ["page_id"], F.col("html"))


# ---- form fields -----------------------------------------------------------------------------------------------------------

@query("form_field_map", with_views(["form_posts"], """
WITH o AS (SELECT o_orderkey AS post_no, o_orderkey FROM orders)
SELECT post_no, 'input_var_ZB_1_' || CAST(i AS VARCHAR) AS field_name, 'ZB' AS prod_code, 1 AS group_index, i::INTEGER AS position_index,
 CASE i WHEN 1 THEN CAST(25 * (1 + o_orderkey % 12) AS VARCHAR) WHEN 2 THEN 'red widget' ELSE '' END AS current_visible_value,
 CASE i WHEN 1 THEN 'AG' || CAST(o_orderkey % 9 AS VARCHAR) WHEN 2 THEN 'AG7' ELSE '' END AS depvar_group_code,
 CASE i WHEN 1 THEN 'A' || CAST(o_orderkey % 90 AS VARCHAR) WHEN 2 THEN 'A8' ELSE '' END AS depvar_option_code,
 CASE i WHEN 1 THEN 'depvar_index_setparent' WHEN 2 THEN 'depvar_index_set_1' ELSE '' END AS depvar_param_name
FROM o, range(1, 4) r(i)"""))
def form_field_map(spark, sf_dir):
    return ct.form_fields(view(spark, sf_dir, "form_posts"), ["post_no"]).drop("field_no")


@query("enriched_catalog_fields", None)
def enriched_catalog_fields(spark, sf_dir):
    """Catalog options with form field name and code; brute-force checked on a fixture."""
    o = ct.with_group_order(view(spark, sf_dir, "catalog_options"), ["snapshot_id"], "group_label").select(
        "snapshot_id", "group_ord", F.col("option_no").alias("option_ord"), "visible_label", "visible_value", F.col("group_label").alias("source_label"),
    )
    latest = ct.newest_rows(view(spark, sf_dir, "form_posts"), ["snapshot_id"], "post_no")
    fields = ct.form_fields(latest, ["snapshot_id"])
    v = ct.option_inputs(view(spark, sf_dir, "option_html"), ["snapshot_id", "part_no"], F.col("html"))
    v = ct.distinct_variants(v, ["snapshot_id"], [F.col("part_no"), F.col("tag_no")])
    return ct.enrich_with_form_fields(o, fields, v.withColumn("tag_no", F.col("part_no")), "snapshot_id")


# ---- backend ids ------------------------------------------------------------------------------------------------------------

DETAIL_JSON = """'{"prop_details":[{"box_name":"quantity","box_name_title":"Auflage","prop_id":' || CAST(o_orderkey AS STRING) || ',"prop_translated":"' || CAST(25 * (1 + o_orderkey % 12) AS STRING) || ' Stück","prop_name":"q"},{"box_name":"format","prop_id":"7","prop_name":"A5"},{"box_name":"","prop_id":"8"}]}'"""


@query("harvested_catalog_rows", """
SELECT o_orderkey, 0 AS group_ord, 'Auflage' AS group_label, 'quantity' AS name, CAST(25 * (1 + o_orderkey % 12) AS VARCHAR) || ' Stück' AS visible_label, 'q' AS visible_value, CAST(o_orderkey AS VARCHAR) AS property_id FROM orders
UNION ALL SELECT o_orderkey, 1, 'format', 'format', 'A5', 'A5', '7' FROM orders""")
def harvested_catalog_rows(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DETAIL_JSON).alias("response_body_preview"))
    return ct.harvest_detail_options(t, ["o_orderkey"])


@query("catalog_source_union", with_views(["catalog_options"], """
SELECT source_rank, group_label, count(*) AS options FROM (SELECT 0 AS source_rank, 'Auflage' AS group_label FROM orders UNION ALL SELECT 0, 'format' FROM orders UNION ALL SELECT 1, group_label FROM catalog_options) GROUP BY ALL"""))
def catalog_source_union(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(DETAIL_JSON).alias("response_body_preview"))
    harvested = ct.harvest_detail_options(t, ["o_orderkey"])
    d = ct.catalog_union(harvested, view(spark, sf_dir, "catalog_options").select("snapshot_id", "group_label", "visible_label"))
    return d.groupBy("source_rank", "group_label").agg(F.count(F.lit(1)).alias("options"))


@query("label_value_maps", """
SELECT p_brand, p_name AS label, arg_min(CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE 'S' || CAST(p_size AS VARCHAR) END, p_partkey) AS backend_value FROM part GROUP BY ALL""")
def label_value_maps(spark, sf_dir):
    o = table(spark, sf_dir, "part").selectExpr(
        "p_brand", "p_partkey", "p_name AS visible_label", "CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS STRING) ELSE ' ' END AS varindex", "'S' || CAST(p_size AS STRING) AS option_id"
    )
    return ct.label_value_map(o, ["p_brand"], "p_partkey", ["varindex", "option_id"])


@query("dropdown_label_ids", """
WITH d AS (SELECT p_partkey, string_split(p_name, ' ') AS l, CASE WHEN p_size % 4 = 0 THEN [p_partkey] ELSE [p_partkey + 1, p_size] END AS i FROM part),
z AS (SELECT p_partkey, unnest(l) AS lab, unnest(i) AS id, generate_subscripts(l, 1) AS p FROM d WHERE len(l) = len(i))
SELECT p_partkey, lower(lab) AS label_key, arg_min(id, p) AS value_id FROM z WHERE id > 0 GROUP BY ALL""")
def dropdown_label_ids(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "split(p_name, ' ') AS labels", "CASE WHEN p_size % 4 = 0 THEN array(p_partkey) ELSE array(p_partkey + 1, CAST(p_size AS BIGINT)) END AS ids"
    )
    return ct.zip_dropdown(d, ["p_partkey"], "labels", "ids")


@query("sideload_property_ids", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS override_no, p_size - 10 AS property_no, p_partkey::INTEGER AS value_no FROM part WHERE p_size > 10 AND p_partkey > 0 AND p_type <> 'PROMO'""")
def sideload_property_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 5 = 0 THEN 'prop' ELSE 'Property_' || CAST(p_size AS STRING) END AS k", "CAST(p_size - 10 AS STRING) AS prop",
        "CASE WHEN p_type = 'PROMO' THEN p_name ELSE ' ' || CAST(p_partkey AS STRING) END AS val",
    )
    d = ct.sideload_ids(p, "prop", "val")
    return d.select("p_partkey", ct.property_number(F.col("k")).alias("override_no"), "property_no", "value_no")

