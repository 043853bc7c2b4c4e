"""Queries that resolve requested options."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.text import value_equals
from quotelens.operators import resolve as rs
from quotelens.plans import checksql as ck
from quotelens.plans.catalog import MT
from quotelens.plans.evidence import table, view, with_views
from quotelens.plans.registry import query
from quotelens.session import cut_lineage


def score_sql(a: str, b: str) -> str:
    """Similarity of two normalised texts in check SQL."""
    ac, bc = f"replace({a}, ' ', '')", f"replace({b}, ' ', '')"
    return (
        f"CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 30 WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 20 WHEN {ac} = {bc} THEN 24 "
        f"WHEN contains({ac}, {bc}) OR contains({bc}, {ac}) THEN 16 ELSE least(14, 4 * len(list_intersect(string_split({a}, ' '), string_split({b}, ' ')))) END"
    )


def _alias_rows() -> str:
    rows = [(f, w.replace("_", " ")) for f, ws in vocab.KEY_ALIASES.items() for w in [f, *ws]]
    raw = [(f, w) for f, ws in vocab.KEY_ALIASES.items() for w in [f, *ws]]
    return (
        "al(fam, alias) AS (VALUES " + ", ".join(f"('{f}', '{w}')" for f, w in sorted(set(rows))) + "), "
        "am(fam, w) AS (VALUES " + ", ".join(f"('{f}', '{w}')" for f, w in sorted(set(raw))) + ")"
    )


CATALOG_CTE = f"""{_alias_rows()},
op AS (SELECT *, dense_rank() OVER (PARTITION BY snapshot_id ORDER BY group_label) AS group_ord FROM catalog_options),
rq AS (SELECT DISTINCT snapshot_id, key, value, {MT.format('key')} AS kn, {MT.format('value')} AS vn FROM requests),
ka AS (SELECT DISTINCT snapshot_id, key, value, kn AS a FROM rq UNION SELECT DISTINCT rq.snapshot_id, key, value, alias FROM rq JOIN am ON contains(kn, am.w) JOIN al USING (fam)),
vs0 AS (SELECT rq.snapshot_id, key, value, group_ord, option_no, op.visible_label, greatest({score_sql(MT.format('op.visible_label'), 'vn')}, {score_sql(MT.format('op.visible_value'), 'vn')}) AS vs FROM rq JOIN op USING (snapshot_id)),
vs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, key, value, group_ord ORDER BY vs DESC, option_no) AS rn FROM vs0) WHERE rn = 1),
gl AS (SELECT DISTINCT snapshot_id, group_ord, group_label FROM op),
gs AS (SELECT ka.snapshot_id, key, value, group_ord, group_label, max({score_sql(MT.format('group_label'), 'a')}) AS s FROM ka JOIN gl USING (snapshot_id) GROUP BY ALL),
gt AS (SELECT gs.*, vs.vs, vs.option_no, vs.visible_label, CASE WHEN s = 0 THEN CASE WHEN vs >= 20 THEN 8 ELSE 0 END ELSE s + 6 + CASE WHEN vs > 0 THEN least(10, vs // 3) ELSE 0 END END AS group_score FROM gs JOIN vs USING (snapshot_id, key, value, group_ord)),
gb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, key, value ORDER BY group_score DESC, group_ord) AS rn FROM gt WHERE group_score > 0) WHERE rn = 1),
mt AS (SELECT rq.snapshot_id, rq.key, rq.value, CASE WHEN group_score IS NULL THEN 'no_matching_group' WHEN vs >= 12 THEN 'catalog_option' ELSE 'value_not_in_catalog' END AS match_status,
  group_ord, group_label, group_score, CASE WHEN vs >= 12 THEN visible_label END AS matched_label, CASE WHEN vs >= 12 THEN option_no END AS option_ord, vs AS option_score
  FROM rq LEFT JOIN gb USING (snapshot_id, key, value))"""


def _options(spark, sf_dir):
    from pyspark.sql import Window

    o = view(spark, sf_dir, "catalog_options")
    # group order from the distinct groups (a small table), joined back
    g = o.select("snapshot_id", "group_label").distinct().withColumn("group_ord", F.row_number().over(Window.partitionBy("snapshot_id").orderBy("group_label")))
    # merged, as Spark takes the size of the options from their packed files and may broadcast them
    return o.join(g.hint("merge"), ["snapshot_id", "group_label"]).withColumn("option_ord", F.col("option_no"))


def _matches(spark, sf_dir):
    return rs.match_catalog(view(spark, sf_dir, "requests"), _options(spark, sf_dir), "snapshot_id")


def _outcomes(spark, sf_dir, *columns):
    """Every request with these columns of its match. Matches are written first: one row per distinct request, which a filter on
    the requests would otherwise carry into the plan of the matches, and a second use would repeat."""
    m = cut_lineage(_matches(spark, sf_dir).select("snapshot_id", "key", "value", *columns))
    return view(spark, sf_dir, "requests").select("unit_no", "snapshot_id", "key", "value").join(m.hint("merge"), ["snapshot_id", "key", "value"])


@query("catalog_option_matches", with_views(["requests", "catalog_options"], f"WITH {CATALOG_CTE} SELECT * FROM mt"))
def catalog_option_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query("unit_option_outcomes", with_views(["requests", "catalog_options"], f"WITH {CATALOG_CTE} SELECT r.unit_no, r.key, r.value, m.match_status, m.group_label, m.matched_label FROM requests r JOIN mt m USING (snapshot_id, key, value)"))
def unit_option_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir, "match_status", "group_label", "matched_label").drop("snapshot_id")


@query("option_suggestions", with_views(["requests", "catalog_options"], f"""WITH {CATALOG_CTE},
p AS (SELECT DISTINCT m.snapshot_id, m.key, m.value, o.visible_label, {score_sql(MT.format('o.visible_label'), MT.format('m.value'))} AS s FROM mt m JOIN op o USING (snapshot_id, group_ord) WHERE m.match_status = 'value_not_in_catalog'),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, key, value ORDER BY s DESC, visible_label DESC) AS rn FROM p)
SELECT snapshot_id, key, value, string_agg(visible_label, '|' ORDER BY rn) AS suggestions FROM r WHERE rn <= 3 GROUP BY ALL"""))
def option_suggestions(spark, sf_dir):
    return rs.suggestions(_matches(spark, sf_dir), _options(spark, sf_dir), "snapshot_id")


@query("prevalidation_summary", with_views(["requests", "catalog_options"], f"""WITH {CATALOG_CTE},
u AS (SELECT r.snapshot_id, r.unit_no, r.key, r.value, m.match_status = 'catalog_option' AS valid FROM requests r JOIN mt m USING (snapshot_id, key, value)),
n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, valid ORDER BY unit_no) AS rn FROM u)
SELECT snapshot_id, count(*) FILTER (WHERE valid) AS matched_count, count(*) FILTER (WHERE NOT valid) AS unmatched_count, bool_and(valid) AS valid,
  string_agg(key || '=' || value, ';' ORDER BY rn) FILTER (WHERE NOT valid AND rn <= 12) AS unmatched FROM n GROUP BY snapshot_id"""))
def prevalidation_summary(spark, sf_dir):
    rows = _outcomes(spark, sf_dir, (F.col("match_status") == "catalog_option").alias("valid"))
    return rs.prevalidation_summary(rows, ["snapshot_id"], [F.asc("unit_no")])


@query("quantity_outcomes", with_views(["units"], """
SELECT unit_no, CASE WHEN run_id % 5 = 0 THEN 'quantity_manual' WHEN quantity IN ('25','50','100') THEN 'quantity_preset' WHEN run_id % 5 = 1 THEN 'catalog_only' ELSE 'quantity_not_in_catalog' END AS outcome FROM units"""))
def quantity_outcomes(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    name = F.when(F.col("run_id") % 5 == 1, F.lit("quantity")).when(F.col("run_id") % 5 == 2, F.lit("input_var_ZB_1_1"))
    presets = F.array(F.lit("25"), F.lit("50"), F.lit("100"))
    out = rs.quantity_outcome(F.col("quantity"), F.col("run_id") % 5 == 0, presets, name, F.lit(None).cast("string"))
    return u.select("unit_no", out.alias("outcome"))


@query("option_key_families", with_views(["requests"], f"""WITH {_alias_rows()},
k AS (SELECT DISTINCT key, {MT.format('key')} AS kn FROM (SELECT key FROM requests UNION SELECT p_name || ' format' FROM part UNION SELECT 'menge ' || p_type FROM part)),
a AS (SELECT key, kn AS a FROM k UNION SELECT key, alias FROM k JOIN am ON contains(kn, am.w) JOIN al USING (fam))
SELECT k.key, (SELECT array_to_string(list_sort(list(DISTINCT a.a)), ',') FROM a WHERE a.key = k.key) AS aliases,
  CASE {' '.join(f"WHEN {ck.any_of('lower(trim(key))', v)} THEN '{f}'" for f, v in rs.CANONICAL_KEYS.items())} END AS canonical_key FROM k"""))
def option_key_families(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    keys = view(spark, sf_dir, "requests").select("key").union(p.select(F.concat("p_name", F.lit(" format")))).union(p.select(F.concat(F.lit("menge "), "p_type"))).distinct()
    k = F.col("key")
    return keys.select("key", F.array_join(F.sort_array(rs.key_aliases(k)), ",").alias("aliases"), rs.canonical_key(k).alias("canonical_key"))


@query("value_synonyms", with_views(["units"], """
SELECT format, count(*) AS n, CASE format WHEN 'A4' THEN 'a 4,a4,din a 4,din a4,endformat din a4,format a4' WHEN 'A5' THEN 'a 5,a5,din a5,endformat din a5,format a5' ELSE 'dl' END AS variants FROM units GROUP BY format""".replace("a 4,a4,din a 4,din a4", "a 4,a4,din a4")))
def value_synonyms(spark, sf_dir):
    n = view(spark, sf_dir, "units").groupBy("format").agg(F.count(F.lit(1)).alias("n"))
    return n.select("format", "n", F.array_join(F.sort_array(rs.value_variants(F.col("format"))), ",").alias("variants"))


SQUEEZE = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
VALUE_CTE = f"""w AS (SELECT DISTINCT site, canonical_key, value, {SQUEEZE.format('value')} AS rq FROM map_requests),
h AS (SELECT w.*, v.property_id, v.backend_id, v.label, v.confidence FROM w JOIN value_map v ON v.site = w.site AND v.canonical_key = w.canonical_key AND v.confidence IN ('confirmed','partial') AND contains({SQUEEZE.format('v.label')}, rq)),
f AS (SELECT site, canonical_key, value, count(*) AS match_count, count(DISTINCT property_id) AS pc, min(property_id) AS property_id, arg_min(backend_id, (property_id, label)) AS backend_id, arg_min(label, (property_id, label)) AS matched_label, arg_min(confidence, (property_id, label)) AS confidence FROM h GROUP BY ALL),
rv AS (SELECT w.site, w.canonical_key, w.value, CASE WHEN w.site NOT IN (SELECT site FROM value_map) THEN 'no_map' WHEN NOT EXISTS (SELECT 1 FROM value_map v WHERE v.site = w.site AND v.canonical_key = w.canonical_key) THEN 'no_property'
  WHEN match_count IS NULL THEN 'no_match' WHEN pc > 1 THEN 'key_collision' WHEN match_count > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, coalesce(match_count, 0) AS match_count, property_id, backend_id, matched_label, confidence
  FROM w LEFT JOIN f USING (site, canonical_key, value))"""


def _resolved(spark, sf_dir):
    vm = view(spark, sf_dir, "value_map")
    return rs.resolve_values(view(spark, sf_dir, "map_requests"), vm, vm)


@query("value_map_resolution", with_views(["map_requests", "value_map"], f"""WITH {VALUE_CTE} SELECT site, canonical_key, value, status, match_count, CASE WHEN status = 'resolved' THEN property_id END AS property_id,
 CASE WHEN status = 'resolved' THEN backend_id END AS backend_id, CASE WHEN status = 'resolved' THEN matched_label END AS matched_label, CASE WHEN status = 'resolved' THEN confidence END AS confidence FROM rv"""))
def value_map_resolution(spark, sf_dir):
    return _resolved(spark, sf_dir)


@query("sideload_augmented_units", with_views(["map_requests", "value_map"], f"""WITH {VALUE_CTE}
SELECT unit_no, CASE WHEN unit_no % 2 = 0 THEN 'catalog_option' WHEN status = 'resolved' THEN 'sideload_only' ELSE 'value_not_in_catalog' END AS match_type,
  CASE WHEN unit_no % 2 = 0 THEN 'shown' WHEN status = 'resolved' THEN rv.matched_label END AS matched_label, CASE WHEN status = 'resolved' THEN backend_id END AS backend_id, unit_no % 2 = 0 OR status = 'resolved' AS valid
FROM map_requests m JOIN rv ON rv.site = m.site AND rv.canonical_key = m.canonical_key AND rv.value = m.value"""))
def sideload_augmented_units(spark, sf_dir):
    m = view(spark, sf_dir, "map_requests").withColumn("match_status", F.when(F.col("unit_no") % 2 == 0, "catalog_option").otherwise("value_not_in_catalog"))
    m = m.withColumn("matched_label", F.when(F.col("unit_no") % 2 == 0, F.lit("shown")))
    d = rs.augment(m, _resolved(spark, sf_dir), ["site", "canonical_key", "value"])
    return d.select("unit_no", "match_type", "matched_label", "backend_id", "valid")


@query("value_map_summary", with_views(["value_map"], """
SELECT site, count(DISTINCT property_id) AS property_count, array_to_string(list_sort(list(DISTINCT canonical_key)), ',') AS canonical_keys FROM value_map GROUP BY site"""))
def value_map_summary(spark, sf_dir):
    return rs.describe_value_map(view(spark, sf_dir, "value_map"))


@query("learned_rule_application", with_views(["units"], """
WITH g AS (SELECT site_name AS site, quantity AS q, min(unit_no) AS m FROM units WHERE state = 'completed' GROUP BY 1, 2),
r AS (SELECT site, q, CAST(CAST(q AS INTEGER) * CASE WHEN m % 2 = 0 THEN 2 ELSE 1 END AS VARCHAR) AS acc FROM g)
SELECT unit_no, coalesce(CASE WHEN acc <> quantity THEN acc END, quantity) AS effective_value, coalesce(acc <> quantity, false) AS rule_applied FROM units u LEFT JOIN r ON r.site = u.site_name AND r.q = u.quantity"""))
def learned_rule_application(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    rules = u.filter("state = 'completed'").groupBy(F.col("site_name").alias("site"), F.col("quantity").alias("requested_norm")).agg(F.min("unit_no").alias("m")).selectExpr(
        "site", "'Quantity' AS option_key", "requested_norm", "CAST(CAST(requested_norm AS INT) * CASE WHEN m % 2 = 0 THEN 2 ELSE 1 END AS STRING) AS accepted_value"
    )
    o = u.select("unit_no", F.col("site_name").alias("site"), F.lit("quantity").alias("key"), F.col("quantity").alias("value"))
    return rs.apply_learned_rules(o, rules).select("unit_no", "effective_value", "rule_applied")


LOOSE = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query("backend_value_ids", with_views(["requests"], f"""
WITH w AS (SELECT DISTINCT snapshot_id, value, {LOOSE.format('value')} AS n FROM requests),
p AS (SELECT w.*, replace(n, ' ', '') AS c, v.p_partkey AS id, {LOOSE.format("v.p_name || ' ' || CAST(v.p_size AS VARCHAR)")} AS ln FROM w LEFT JOIN part v ON v.p_brand = w.snapshot_id),
t AS (SELECT *, replace(ln, ' ', '') = c AS e, regexp_full_match(n, '[0-9]+') AND list_contains(string_split(ln, ' '), n) AS m, length(c) >= 3 AND contains(replace(ln, ' ', ''), c) AS k FROM p),
a AS (SELECT snapshot_id, value, n, count(id) AS al, count(*) FILTER (WHERE e) AS ne, count(*) FILTER (WHERE m) AS nm, count(*) FILTER (WHERE k) AS nk, min(id) FILTER (WHERE e) AS ie, min(id) FILTER (WHERE m) AS im, min(id) FILTER (WHERE k) AS ik FROM t GROUP BY ALL),
z AS (SELECT *, CASE WHEN al = 0 THEN 'no_value_options' WHEN n = '' THEN 'empty_value' WHEN ne = 1 THEN 'exact' WHEN ne > 1 THEN 'ambiguous_exact' WHEN nm = 1 THEN 'numeric' WHEN nm > 1 THEN 'ambiguous_numeric' WHEN nk = 1 THEN 'contains' WHEN nk > 1 THEN 'ambiguous_contains' ELSE 'no_match' END AS match_kind FROM a)
SELECT snapshot_id, value, match_kind, CASE match_kind WHEN 'exact' THEN ie WHEN 'numeric' THEN im WHEN 'contains' THEN ik END AS value_id FROM z"""))
def backend_value_ids(spark, sf_dir):
    values = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("snapshot_id"), F.col("p_partkey").alias("value_id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("label")
    )
    return rs.match_value_ids(view(spark, sf_dir, "requests"), values, ["snapshot_id"])


@query("dropdown_for_key", with_views(["requests"], f"""
WITH d AS (SELECT p_brand AS snapshot_id, p_partkey AS dropdown_no, CASE p_partkey % 4 WHEN 0 THEN 'Size (' || p_type || ')' WHEN 1 THEN 'Material' ELSE p_name END AS trig FROM part),
w AS (SELECT DISTINCT snapshot_id, key, {LOOSE.format('key')} AS k FROM requests),
p AS (SELECT w.snapshot_id, key, dropdown_no, trig, k, {LOOSE.format('trig')} AS t FROM w JOIN d USING (snapshot_id)),
s AS (SELECT *, CASE WHEN t = k OR replace(t,' ','') = replace(k,' ','') THEN 40 ELSE 0 END + CASE WHEN contains(replace(t,' ',''), replace(k,' ','')) THEN 24 ELSE 0 END + CASE WHEN contains(replace(k,' ',''), replace(t,' ','')) THEN 12 ELSE 0 END
  + least(18, 6 * len(list_intersect(list_distinct(string_split(t,' ')), list_distinct(string_split(k,' '))))) AS dropdown_score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, key ORDER BY dropdown_score DESC, dropdown_no) AS rn FROM s)
SELECT snapshot_id, key, dropdown_no, trig AS trigger, dropdown_score FROM r WHERE rn = 1 AND dropdown_score >= 18"""))
def dropdown_for_key(spark, sf_dir):
    d = table(spark, sf_dir, "part").selectExpr("p_brand AS snapshot_id", "p_partkey AS dropdown_no", "CASE p_partkey % 4 WHEN 0 THEN 'Size (' || p_type || ')' WHEN 1 THEN 'Material' ELSE p_name END AS trigger")
    return rs.pick_dropdown(view(spark, sf_dir, "requests"), d, "snapshot_id")


@query("dropdown_assignment", """
WITH RECURSIVE dd AS (SELECT l_suppkey AS page, l_linenumber AS dn, count(DISTINCT l_quantity) AS oc FROM lineitem GROUP BY ALL),
pp AS (SELECT l_suppkey AS page, l_partkey % 5 AS pn, count(DISTINCT l_quantity) AS vc FROM lineitem GROUP BY ALL),
e AS (SELECT page, dn, pn, CAST(70 - least(50, 3 * abs(vc - oc)) + CASE WHEN vc = oc THEN 45 ELSE 0 END + CASE WHEN oc BETWEEN 3 AND 40 THEN 6 ELSE 0 END AS INTEGER) AS s FROM dd JOIN pp USING (page) WHERE oc >= 2 AND pn <> 4),
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s DESC, dn DESC, pn DESC) AS k FROM e WHERE s >= 30),
w AS (SELECT page, 0::BIGINT AS k, []::BIGINT[] AS ds, []::BIGINT[] AS ps, false AS free, 0::BIGINT AS dn, 0::BIGINT AS pn, 0 AS s FROM (SELECT DISTINCT page FROM o)
  UNION ALL SELECT page, k, CASE WHEN ok THEN list_append(ds, dn) ELSE ds END, CASE WHEN ok THEN list_append(ps, pn) ELSE ps END, ok, dn, pn, s
  FROM (SELECT o.page, o.k, w.ds, w.ps, NOT list_contains(w.ds, o.dn::BIGINT) AND NOT list_contains(w.ps, o.pn::BIGINT) AS ok, o.dn::BIGINT AS dn, o.pn::BIGINT AS pn, o.s FROM w JOIN o ON o.page = w.page AND o.k = w.k + 1))
SELECT page, dn AS dropdown_no, pn AS property_no, s AS assign_score FROM w WHERE free""")
def dropdown_assignment(spark, sf_dir):
    """Greedy assignment per supplier page."""
    li = table(spark, sf_dir, "lineitem")
    dd = li.groupBy(F.col("l_suppkey").alias("page"), F.col("l_linenumber").cast("bigint").alias("dropdown_no")).agg(F.count_distinct("l_quantity").alias("option_count"))
    pp = li.groupBy(F.col("l_suppkey").alias("page"), (F.col("l_partkey") % 5).alias("property_no")).agg(F.count_distinct("l_quantity").alias("value_count"))
    return rs.assign_dropdowns(dd, pp.withColumn("is_range", F.col("property_no") == 4), "page")


@query("override_precedence", with_views(["units", "map_requests"], """
WITH s AS (SELECT unit_no, 0 AS r, 'explicit' AS source, quantity AS v FROM units WHERE unit_no % 4 = 0 UNION ALL SELECT unit_no, 1, 'label', format FROM units WHERE unit_no % 3 = 0
  UNION ALL SELECT unit_no, 2, 'value_map', value FROM map_requests WHERE unit_no % 2 = 0 UNION ALL SELECT unit_no, 3, 'dropdown', priority FROM units)
SELECT unit_no, arg_min(source, r) AS source, arg_min(v, r) AS v FROM s GROUP BY unit_no"""))
def override_precedence(spark, sf_dir):
    u, m = view(spark, sf_dir, "units"), view(spark, sf_dir, "map_requests")
    rows = [
        u.filter("unit_no % 4 = 0").selectExpr("unit_no", "0 AS r", "'explicit' AS source", "quantity AS v"),
        u.filter("unit_no % 3 = 0").selectExpr("unit_no", "1 AS r", "'label' AS source", "format AS v"),
        m.filter("unit_no % 2 = 0").selectExpr("unit_no", "2 AS r", "'value_map' AS source", "value AS v"),
        u.selectExpr("unit_no", "3 AS r", "'dropdown' AS source", "priority AS v"),
    ]
    allr = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return rs.first_by_rank(allr, ["unit_no"], "r", ["source", "v"])


@query("format_variant_links", f"""
WITH l AS (SELECT p_brand, p_partkey AS no, '/p/' || replace(p_name, ' ', '-') || '-a' || CAST(p_size % 8 AS VARCHAR) AS href, CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 2 ELSE p_partkey % 2 END AS fh FROM part),
w AS (SELECT DISTINCT p_brand, 'A' || CAST(p_size % 8 AS VARCHAR) AS value, 'a' || CAST(p_size % 8 AS VARCHAR) AS k FROM part),
p AS (SELECT w.p_brand, value, no, href, k, {LOOSE.format('href')} AS t, fh FROM w JOIN l USING (p_brand) WHERE fh > 0),
s AS (SELECT *, CAST(least(16, fh * 4) + CASE WHEN contains(replace(t,' ',''), k) THEN 18 ELSE 0 END + CASE WHEN contains(t, k) THEN 8 ELSE 0 END + least(8, 2 * CASE WHEN list_contains(string_split(t,' '), k) THEN 1 ELSE 0 END) AS INTEGER) AS link_score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, value ORDER BY link_score DESC, no) AS rn FROM s WHERE link_score >= 20)
SELECT p_brand, value, href, link_score FROM r WHERE rn = 1""")
def format_variant_links(spark, sf_dir):
    links = table(spark, sf_dir, "part").selectExpr(
        "p_brand", "p_partkey AS link_no", "'/p/' || replace(p_name, ' ', '-') || '-a' || CAST(p_size % 8 AS STRING) AS href",
        "CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 2 ELSE CAST(p_partkey % 2 AS INT) END AS family_hits",
    )
    wanted = table(spark, sf_dir, "part").selectExpr("p_brand", "'A' || CAST(p_size % 8 AS STRING) AS value")
    return rs.best_variant_links(links, wanted, "p_brand")


@query("option_link_scores", f"""
WITH l AS (SELECT p_partkey, {LOOSE.format("p_name || ' ' || p_type")} AS t, {LOOSE.format("CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || '-' || p_type ELSE p_type || ' x' END")} AS w FROM part)
SELECT p_partkey, CAST(CASE WHEN t = w THEN 16 WHEN contains(t, w) AND w <> '' THEN 9 WHEN replace(t,' ','') = replace(w,' ','') THEN 6 ELSE len(list_intersect(list_distinct(string_split(t,' ')), list_distinct(string_split(w,' ')))) END
 + CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 3 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 12 ELSE -12 END AS INTEGER) AS score FROM l""")
def option_link_scores(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat_ws(" ", "p_name", "p_type")
    want = F.when(k % 3 == 0, F.col("p_name")).when(k % 3 == 1, F.concat_ws("-", "p_name", "p_type")).otherwise(F.concat("p_type", F.lit(" x")))
    return table(spark, sf_dir, "part").select("p_partkey", rs.option_link_score(text, want, k % 2 == 0, k % 5 == 0, k % 7 == 0).cast("int").alias("score"))


@query("ranked_page_controls", with_views(["requests", "catalog_options"], f"""
WITH w AS (SELECT DISTINCT snapshot_id, key, value, {MT.format('key')} AS k, {MT.format('value')} AS v FROM requests),
c AS (SELECT snapshot_id, {MT.format('visible_label')} AS l, {MT.format('group_label')} AS g, min(option_no) AS no FROM catalog_options GROUP BY ALL),
p AS (SELECT w.snapshot_id, key, value, no, g <> '' AND contains(g, k) AS hit, CASE WHEN l = v THEN 18 WHEN v <> '' AND contains(l, v) THEN 10 WHEN l <> '' AND contains(v, l) THEN 8 ELSE least(6, 2 * len(list_intersect(string_split(l,' '), string_split(v,' ')))) END AS b FROM w JOIN c USING (snapshot_id)),
s AS (SELECT *, CAST(b + CASE WHEN hit THEN 5 ELSE 0 END AS INTEGER) AS control_score FROM p),
r AS (SELECT *, CASE WHEN hit OR control_score >= 12 THEN 1 ELSE 2 END AS pass_no FROM s WHERE control_score > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, key, value ORDER BY pass_no, control_score DESC, no) AS place FROM r)
SELECT snapshot_id, key, value, place, no AS control_no, control_score, pass_no FROM n WHERE place <= 10"""))
def ranked_page_controls(spark, sf_dir):
    c = view(spark, sf_dir, "catalog_options").withColumn("control_no", F.col("option_no"))
    return rs.rank_controls(view(spark, sf_dir, "requests"), c, "snapshot_id")


@query("accepted_value_equality", with_views(["units"], """
SELECT unit_no, CASE WHEN unit_no % 4 = 3 THEN format IS NULL WHEN unit_no % 4 = 2 THEN false ELSE true END AS equal FROM units"""))
def accepted_value_equality(spark, sf_dir):
    n = F.col("unit_no") % 4
    other = F.when(n == 0, F.col("format")).when(n == 1, F.concat(F.lit("  "), F.lower("format"), F.lit(" "))).when(n == 2, F.lit("zz"))
    return view(spark, sf_dir, "units").select("unit_no", value_equals(F.col("format"), other).alias("equal"))
