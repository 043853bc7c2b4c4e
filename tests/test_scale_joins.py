"""Walks, matches and joins at sizes and shapes that the driver tables do not have, against plain versions."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quotelens.functions import jsonwalk
from quotelens.functions.money import parse_price
from quotelens.functions.text import match_score
from quotelens.operators import prices as pr
from quotelens.operators import requests as rq
from quotelens.operators import resolve as rs
from quotelens.operators.textindex import candidates


def plain_leaves(node, path="", key="", places=()):
    if isinstance(node, dict) and node:
        for i, (k, v) in enumerate(sorted(node.items())):
            yield from plain_leaves(v, f"{path}.{k}" if path else k, k, (*places, i))
    elif isinstance(node, list) and node:
        for i, v in enumerate(node):
            yield from plain_leaves(v, f"{path}[{i}]", key, (*places, i))
    else:
        yield path, key, places, node


def kind_of(v):
    return "empty" if v in ({}, []) and isinstance(v, (dict, list)) else "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"


BODIES = [
    {"a": {"l": [{"total": 1.5}, {"total": "2,50 €"}]}, "b": None, "c": [], "d": {}, "e": True, "f": ["x", [1, [2]]]},
    [1, "two", None, {"k\"q\\": "a \"quoted\" \\ text, with [brackets] {and} commas: yes"}],
    "12,34 EUR", 7, {"": {"": 1}}, {"long": "x" * 100_000, "ü": "é\n\t中"}, {"n": 12345678901234567890, "m": -0.001},
]


def test_walk_equals_plain_walk(spark):
    rows = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(BODIES)] + [(90, "no json"), (91, None), (92, '{"a":1')], "id int, body string")
    got = jsonwalk.walk(rows.withColumn("v", jsonwalk.parse(F.col("body"))), "v", ["id"]).collect()
    want = {(i, p, k, o): v for i, b in enumerate(BODIES) for p, k, o, v in plain_leaves(b)}
    assert {(r.id, r.path, r.leaf_key, tuple(r.ord)) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        v = want[r.id, r.path, r.leaf_key, tuple(r.ord)]
        assert r.kind == kind_of(v)
        if r.kind == "text":
            assert r.value == v
        elif r.kind == "number":
            assert r.number == float(v)
        elif r.kind == "null":
            assert r.value is None
    first = jsonwalk.walk(rows.filter("id = 0").withColumn("v", jsonwalk.parse(F.col("body"))), "v", ["id"], array_items=1)
    assert {r.path for r in first.collect()} == {"a.l[0].total", "b", "c", "d", "e", "f[0]"}


def test_walk_of_a_deep_body(spark):
    """One body 450 deep among flat ones: one plan, built without a job."""
    deep = '{"a":[' * 225 + '"end"' + "]}" * 225
    rows = spark.createDataFrame([(0, deep), (1, '{"x":1}')], "id int, body string").withColumn("v", jsonwalk.parse(F.col("body")))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    plan = jsonwalk.walk(rows, "v", ["id"])
    assert len(tracker.getJobIdsForGroup(None)) == before
    got = {r.id: r for r in plan.collect()}
    assert got[0].path == ".".join(["a[0]"] * 225) and len(got[0].ord) == 450 and got[0].value == "end" and got[1].path == "x"
    assert len(plan._jdf.queryExecution().executedPlan().toString()) < 4000


def test_scanner_is_not_recursive():
    text = "[" * 20_000 + "1" + "]" * 20_000
    (leaf,) = jsonwalk.leaves_of(text)
    assert len(leaf["ord"]) == 20_000


@pytest.mark.parametrize("seed", range(3))
def test_greedy_assignment(spark, seed):
    rng = random.Random(seed)
    pages = {f"p{i}": ([rng.randint(1, 9) for _ in range(rng.randint(0, 9))], [rng.randint(0, 12) for _ in range(rng.randint(0, 9))]) for i in range(25)}
    want = set()
    for page, (options, values) in pages.items():
        edges = sorted(((70 - min(50, 3 * abs(v - o)) + 45 * (v == o) + 6 * (3 <= o <= 40), d, p) for d, o in enumerate(options) for p, v in enumerate(values) if o >= 2 and v > 0), reverse=True)
        taken_d, taken_p = set(), set()
        for s, d, p in edges:
            if s >= 30 and d not in taken_d and p not in taken_p:
                taken_d.add(d)
                taken_p.add(p)
                want.add((page, d, p, s))
    dd = spark.createDataFrame([(g, i, n) for g, (o, _) in pages.items() for i, n in enumerate(o)], "page string, dropdown_no long, option_count long")
    pp = spark.createDataFrame([(g, i, n, False) for g, (_, v) in pages.items() for i, n in enumerate(v)], "page string, property_no long, value_count long, is_range boolean")
    assert {tuple(r) for r in rs.assign_dropdowns(dd, pp, "page").collect()} == want


def test_greedy_assignment_of_a_large_page(spark):
    d = spark.range(2000).selectExpr("'p' AS page", "id AS dropdown_no", "2 + id % 50 AS option_count")
    p = spark.range(2000).selectExpr("'p' AS page", "id AS property_no", "1 + id % 53 AS value_count", "false AS is_range")
    got = rs.assign_dropdowns(d, p, "page").collect()
    assert len(got) > 1900 and len({r.dropdown_no for r in got}) == len(got) == len({r.property_no for r in got})


def test_required_literals():
    patterns = ["item-77", r"item-\d*5/", "a|b", "(foo|bar)baz+", r"https?://x\.com/p", "[abc]def?", r"\x41bcd", "ab{0,2}cde", "(?i)Shop[0-9]{2}x", "^/p/.*$", r"a\/b\.c(d(e)f)ghi", "x*", "caf.é+bar", "[]a]bc", "((a)b)cd", r"\bfoo\b bar?", "a{2}b{,3}c"]
    texts = ["item-77", "item-5/", "item-1235/", "a", "bazz", "foobaz", "barbazzz", "https://x.com/p", "http://x.com/p", "ade", "bdef", "cde", "Abcd", "acde", "abbcde", "SHOP12X", "/p/", "/p/x", "a/b.cdefghi", "xxx", "caf-ébar", "]bc", "abcd", "foo ba", "foo bar", "aabc", "aabbc", "aac"]
    met = 0
    for p in patterns:
        need = rq.required_literal(p)
        for t in texts:
            if re.search(p, t):
                met += 1
                assert need is None or need in t.lower(), (p, need, t)
    assert met > 20 and rq.required_literal("item-77") == "item-77" and rq.required_literal(r"https?://x\.com/p") == "://x.com/p" and rq.required_literal(None) is None


def test_many_open_adapters(spark):
    """10,000 patterns without a domain: found through their literals, without a nested loop."""
    adapters = [(i, f"a{i}", [], f"/item-{i:05d}(/|$)") for i in range(10_000)]
    adapters += [(20_000, "class", [], r"[xyz]\d+q"), (20_001, "alt", None, "zzz|/item-00007/"), (5_000_000, "host", ["shop.example.com"], ""), (20_002, "short", [], "q="), (3, "dup", [], "(?i)/ITEM-00003$")]
    urls = [f"https://www.shop{i % 3}.example.com/item-{i:05d}" for i in range(0, 12_000, 40)] + ["https://a.b/item-00007/", "https://a.b/x12q", "https://shop.example.com/none", "https://a.b/?q=1", "https://a.b/other", "", "nohost", None, "https://a.b/item-00003"]
    a = spark.createDataFrame(adapters, "adapter_no int, adapter_id string, domains array<string>, url_regex string")
    t = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    out = rq.match_adapters(t, a, ["id"])
    got = {r.id: (r.adapter_id, r.match_reason) for r in out.collect()}
    compiled = [(n, x, d, re.compile(p)) for n, x, d, p in adapters]
    for i, u in enumerate(urls):
        if not u:
            assert got[i] == (None, "missing_target_url")
        elif "://" not in u:
            assert got[i] == (None, "missing_target_host")
        else:
            fits = [(n, x) for n, x, d, p in compiled if (not d and p.search(u)) or (d and "//shop.example.com" in u)]
            assert got[i] == ((min(fits)[1], "matched") if fits else (None, "url_regex_mismatch")), u
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


LABELS = ["A4", "a 5", "DIN A4", "rot", "dunkel rot", "blau matt", "matt", "300 g", "300g Bilderdruck matt", "", None, "x", "4/4 farbig", "farbig", "Papier & Karton", "papier und karton", "rotation", "1", "250 Stück", "25"]


def test_indexed_pairs_are_all_similar_pairs(spark):
    rng = random.Random(1)
    left = [(s, i, rng.choice(LABELS)) for s in ("s1", "s2") for i in range(15)]
    right = [(s, i, rng.choice(LABELS), rng.choice(LABELS)) for s in ("s1", "s2", "s3") for i in range(25)]
    a = spark.createDataFrame(left, "scope string, i int, t string").withColumn("n", rs.match_text(F.col("t")))
    b = spark.createDataFrame(right, "scope string, j int, u string, v string").withColumn("nu", rs.match_text(F.col("u"))).withColumn("nv", rs.match_text(F.col("v")))
    pairs = a.join(b, "scope").withColumn("s", F.greatest(match_score(F.col("u"), F.col("t")), match_score(F.col("v"), F.col("t"))))
    want = {(r.scope, r.i, r.j) for r in pairs.filter("s > 0").collect()}
    got = [(r.scope, r.i, r.j) for r in candidates(a, b, ["scope"], ["i"], ["j"], ["n"], ["nu", "nv"]).collect()]
    assert want <= set(got) and len(got) == len(set(got))
    assert len(want) > 100 and len(got) < 0.8 * pairs.count()


def test_entries_are_not_broadcast(spark):
    """A text has tens of entries, which Spark's estimate of a side leaves out: small tables must be merged, too."""
    a = spark.createDataFrame([("s", 1, "red")], "scope string, i long, n string")
    b = spark.createDataFrame([("s", 2, "dark red widget")], "scope string, j long, nu string")
    plan = candidates(a, b, ["scope"], ["i"], ["j"], ["n"], ["nu"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_ways_share_one_join(spark):
    """Each side stands once in the plan, whatever the number of ways: the driver plans and keeps it as often."""
    a = spark.createDataFrame([("s", 1, "red")], "scope string, i long, n string").withColumn("n", F.concat("n", F.lit(" left side")))
    b = spark.createDataFrame([("s", 2, "dark red widget")], "scope string, j long, nu string")
    pairs = candidates(a, b, ["scope"], ["i"], ["j"], ["n"], ["nu"])
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("left side") <= 3 and [tuple(r) for r in pairs.collect()] == [("s", 1, 2)]


def test_value_ids_of_repeated_labels(spark):
    values = [("k", 1, "Red 10"), ("k", 2, "red  10"), ("k", 3, "blue 20"), ("k", 3, "Blue 20"), ("k", 4, "green 30"), ("k", None, "grey 40")]
    want = spark.createDataFrame([("k", v) for v in ("red 10", "20", "blue", "green30", "10", "40", "none", "")] + [("l", "x")], "scope string, value string")
    got = rs.match_value_ids(want, spark.createDataFrame(values, "scope string, value_id long, label string"), ["scope"])
    assert {r.value: (r.match_kind, r.value_id) for r in got.collect()} == {
        "red 10": ("ambiguous_exact", None), "20": ("numeric", 3), "blue": ("contains", 3), "green30": ("exact", 4), "10": ("ambiguous_numeric", None), "40": ("numeric", None),
        "none": ("no_match", None), "": ("empty_value", None), "x": ("no_value_options", None),
    }


def test_suggestions_fill_up_with_last_labels(spark):
    o = spark.createDataFrame([("s", 1, x) for x in ("alpha", "beta", "gamma", "delta red", "zeta")], "scope string, group_ord int, visible_label string")
    w = spark.createDataFrame([("s", "k", "red", 1, "value_not_in_catalog"), ("s", "k", "nothing", 1, "value_not_in_catalog")], "scope string, key string, value string, group_ord int, match_status string")
    got = {r.value: r.suggestions for r in rs.suggestions(w, o, "scope").collect()}
    assert got == {"red": "delta red|zeta|gamma", "nothing": "zeta|gamma|delta red"}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_plan_their_inputs_once(spark):
    """Requests, options and texts stand in no further plan: the driver would plan and keep each copy."""
    o = spark.createDataFrame([("s", 1, "g", 1, "red widget", "5")], "scope string, group_ord int, group_label string, option_ord int, visible_label string, visible_value string")
    r = spark.createDataFrame([("s", "size", "red")], "scope string, key string, value string")
    found = rs.match_catalog(r, o, "scope")
    assert _plan(found).count("LogicalRDD [") > 2 and "visible_value" not in _plan(found) and [(x.match_status, x.matched_label) for x in found.collect()] == [("catalog_option", "red widget")]
    vm = spark.createDataFrame([("a", "p", "format", "l", "7", "Red Widget", "confirmed")], "site string, property_id string, canonical_key string, source_label string, backend_id string, label string, confidence string")
    w = spark.createDataFrame([("a", "format", "red")], "site string, canonical_key string, value string")
    got = rs.resolve_values(w, vm, vm)
    assert "Red" not in _plan(got) and _plan(got).count("label_") == 0 and _plan(got).count("source_label") <= 2 and [(x.status, x.backend_id) for x in got.collect()] == [("resolved", "7")]


def test_facts_are_scanned_once(spark):
    """One scan for pairs, property ids and plain keys; the plain rules over the leaves give the same facts."""
    from quotelens.operators import validate as va

    bodies = [*map(json.dumps, BODIES), '{"c":[{"Name":"Quantity","value":"50 St"},{"key":"k","name":null,"value":1},{"propertyid":9,"value":"rot","id":3},{"label":"L","id":{"a":1}}],"QUANTITY":7,"x.y":[{"name":"n","selected":true}]}', "no json"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    facts = va.accepted_options(rows, ["id"], "body")
    leaves = jsonwalk.walk(rows.withColumn("v", jsonwalk.parse(F.col("body"))), "v", ["id"])
    assert _plan(facts).count("ArrowEvalPython") == 1 and _plan(leaves).count("ArrowEvalPython") == 1
    got = {(r.id, r.option_key): (r.accepted_value, r.kind) for r in facts.collect()}
    n = len(BODIES)
    assert {k[1]: v for k, v in got.items() if k[0] == n} == {
        "Quantity": ("50 St", "pair"), "propertyId:9": ("rot", "property"), "n": ("true", "pair"), "name": ("n", "key"), "value": ("rot", "key"), "key": ("k", "key"),
        "propertyid": ("9", "key"), "id": ("3", "key"), "label": ("L", "key"), "a": ("1", "key"), "quantity": ("7", "key"), "selected": ("true", "key"),
    }
    few = va.accepted_options(rows, ["id"], "body", only=["quantity", "n"])
    assert {((r.id, r.option_key), (r.accepted_value, r.kind)) for r in few.collect()} == {x for x in got.items() if x[0][1].lower() in ("quantity", "n")}


def test_traces_are_scored_once(spark):
    """Rankings and relations read written evidence; the rules over texts stand in no plan that reads it."""
    from quotelens.operators import endpoints as ep

    rows = [(1, i, f"https://www.x.example.com/api/price/{i}", "POST", "xhr", 200, "application/json", '{"quantity":25,"format":"A5"}', '{"price":1.5,"total":2}') for i in range(3)]
    traces = spark.createDataFrame(rows, "run_id long, trace_idx long, url string, method string, resource_type string, status int, response_content_type string, post_data string, response_body_preview string")
    s = ep.scored_once(ep.score_traces(traces))
    ranked = ep.rank_endpoints(ep.score_traces(traces))
    related = ep.related_endpoints(ranked, ep.signatures(s))
    for d in (s, ranked, related):
        assert "LogicalRDD" not in _plan(d) and "regexp" not in _plan(d)
    assert [(r.url[-1], r.rank) for r in ranked.orderBy("rank").collect()] == [("0", 1), ("1", 2), ("2", 3)] and related.count() == 6


def trace(run, idx, url, body, kind="application/json"):
    return (run, idx, url, body, kind)


def test_price_pool(spark):
    """JSON without a price key is read as text; runs without a ranked endpoint use all their urls; page candidates only outside the API."""
    t = spark.createDataFrame(
        [
            trace(1, 1, "https://x.com/p", '{"note":"total 12,34 EUR"}'),
            trace(2, 1, "https://api.x.com/p", '{"note":"nothing"}'), trace(2, 2, "https://x.com/q", '{"note":"nothing"}'),
            trace(3, 1, "https://api.x.com/p", '{"note":"nothing"}'),
            trace(4, 1, "https://x.com/p", "plain text", "text/plain"), trace(4, 2, "https://x.com/z", '"total 9,99 EUR"'),
            trace(5, 1, "https://x.com/p", '{"price": 5.5, "note":"total 99,00 EUR"}'),
        ],
        "run_id int, trace_idx int, url string, response_body_preview string, response_content_type string",
    )
    ranked = spark.createDataFrame([(1, 1, "https://x.com/p", 5), (2, 1, "https://api.x.com/p", 9), (2, 2, "https://x.com/q", 5), (3, 1, "https://api.x.com/p", 9), (5, 1, "https://x.com/p", 3), (4, 1, "https://x.com/p", 0)], "run_id int, rank int, url string, score int")
    page = spark.createDataFrame([(r, 77.0, 12, "selected_config:total") for r in (2, 3, 4)], "run_id int, value double, score int, source string")
    got = {r.run_id: (r.url, r.price, r.endpoint_score) for r in pr.prices_from_traces(t, ranked, page=page).collect()}
    assert got == {1: ("https://x.com/p", 12.34, 5), 2: ("https://x.com/q", 77.0, 5), 4: ("https://x.com/z", 77.0, None), 5: ("https://x.com/p", 5.5, 3)}
    source = pr.trace_price_candidates(t.filter("run_id = 1"), ["run_id"]).collect()
    assert {r.source.split(":")[0] for r in source} == {"captured_trace_json_text"}


def test_lines_and_neighbours_across_blocks(spark):
    """Blocks of three positions, a gap in them, a null line and a further column: as looked up one by one."""
    rows = [(u, i, None if (u, i) == (2, 5) else f"{u}-{i}", i % 2) for u in (1, 2) for i in range(1, 12) if (u, i) != (1, 7)]
    lines = spark.createDataFrame(rows, "unit int, ord long, line string, odd int")
    text = {(u, i): t for u, i, t, _ in rows}
    want = {(u, i, t, " ".join(x for x in (text.get((u, i - 1)), t, text.get((u, i + 1))) if x), odd) for u, i, t, odd in rows if t}
    assert {tuple(r) for r in pr.line_context(lines, ["unit"], "ord", "line", block=3).collect()} == want
    plan = pr.line_context(lines, ["unit"], "ord", "line")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Aggregate" not in plan


def test_money_text_is_mentioned_once(spark):
    """A step written into another one is evaluated for every mention of it."""
    d = spark.createDataFrame([("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1.234.567", None), ("12.345.6", 123456.0), ("-3", None), ("", None), (None, None), (" 7 ,5", 7.5)], "t string, v double")
    got = d.select("v", parse_price(F.col("t")).alias("p"))
    assert got._jdf.queryExecution().analyzed().toString().splitlines()[0].count("t#") == 1
    assert all(r.v == r.p for r in got.collect())


@pytest.mark.parametrize("name", ["prevalidation_failures", "prevalidation_summary", "unit_option_outcomes"])
def test_outcomes_read_written_matches(spark, name):
    """The matches stand in no plan that reads them: a filter would be carried into it, and a second use repeat it."""
    import __spark_entry__ as entry

    out = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "group_score" not in plan and plan.count("Relation [") == plan.count("LogicalRDD")


def plain_interpolation(pairs, field, typed):
    keys = [k for k, _ in pairs]
    if field not in keys:
        return pairs
    at = keys.index(field)
    out = [(k, "Interpolation" if i == at else v) for i, (k, v) in enumerate(pairs)]
    if "input_qty_1" in keys[at + 1:]:
        spot = keys.index("input_qty_1", at + 1)
        return [(k, typed if i == spot else v) for i, (k, v) in enumerate(out)]
    return [*out[:at + 1], ("input_qty_1", typed), *out[at + 1:]]


def test_interpolation_reads_a_form_once(spark):
    from quotelens.functions.urls import encode_pairs, form_pairs

    rng = random.Random(5)
    forms = [[(rng.choice(["a", "q", "input_qty_1", "x"]), str(rng.randint(0, 9))) for _ in range(rng.randint(0, 6))] for _ in range(200)]
    text = lambda pairs: "&".join(f"{k}={v}" for k, v in pairs)
    rows = spark.createDataFrame([(i, text(f)) for i, f in enumerate(forms)], "id int, body string")
    out = rows.select("id", encode_pairs(rq.interpolated_quantity(form_pairs(F.col("body")), F.lit("q"), F.lit("77"))).alias("body"))
    assert {r.id: r.body for r in out.collect()} == {i: text(plain_interpolation(f, "q", "77")) for i, f in enumerate(forms)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_rules_do_not_gather_inputs(spark):
    """All inputs have the same few keys; a shuffle by them would put a share of all rows into one task."""
    inputs = spark.range(3000).selectExpr("id AS unit_no", "'a' AS adapter_id", "CASE id % 3 WHEN 0 THEN 'k' WHEN 1 THEN 'l' ELSE 'none' END AS input_key", "CAST(id AS STRING) AS raw_value")
    rules = spark.createDataFrame([("a", 1, "k", "x", "int", None, False), ("a", 2, "l", "y", "", None, False), ("b", 3, "k", "x", "", None, False)],
                                  "adapter_id string, rule_no int, input_key string, path string, cast_to string, value_map map<string,string>, require_mapped boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large inputs, of which no side looks small
    try:
        out = rq.injection_audit(inputs, rules, ["unit_no"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {(i, 1 + i % 3, str(i) if i % 3 == 0 else f'"{i}"') for i in range(3000) if i % 3 < 2}
    assert {(r.unit_no, r.rule_no, r.value_json) for r in out.collect()} == want
    assert "hashpartitioning" not in plan


def test_group_order_and_newest_rows(spark):
    """The same as a rank over all options and the largest row of a key, without sorting either."""
    from pyspark.sql import Window

    from quotelens.operators import catalog as ct

    rng = random.Random(8)
    rows = spark.createDataFrame([(rng.choice(["s", "t", None]), rng.choice(["b", "a", "c", None]), i, f"text {i}") for i in range(300)], "s string, label string, no int, body string")
    want = rows.withColumn("group_ord", F.dense_rank().over(Window.partitionBy("s").orderBy("label")))
    assert sorted(map(str, ct.with_group_order(rows, ["s"], "label").select(*want.columns).collect())) == sorted(map(str, want.collect()))
    newest = ct.newest_rows(rows, ["s"], "no")
    best = rows.groupBy("s").agg(F.max_by("body", "no").alias("body"))
    assert {(r.s, r.body) for r in newest.collect()} == {(r.s, r.body) for r in best.collect()}


def test_enriched_catalog_broadcasts_no_options(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["enriched_catalog_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "dense_rank" not in plan and "max_by(post_data" not in plan
    assert all("LeftSemi" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
