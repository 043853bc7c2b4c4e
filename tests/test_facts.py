"""Small literal-row facts and brute-force checks."""

import json

from pyspark.sql import functions as F

from quotelens.functions import jsonwalk, money, text, urls, vocab
from quotelens.operators import catalog as ct
from quotelens.operators import gates, knowledge, planning
from quotelens.operators import prices as pr
from quotelens.operators import requests as rq
from quotelens.operators import resolve as rs
from quotelens.operators import skew


def one(df):
    return df.collect()[0]


def test_money_rules(spark):
    rows = {"1.234,56": 1234.56, "1,234.56": 1234.56, "1.234": 1.234, "1.234.567": None, "12,50": 12.5, "0": None, "abc": None, "2.000.000,00": None}
    d = spark.createDataFrame([(k,) for k in rows], "t string").select("t", money.parse_price(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in d} == rows
    assert one(spark.sql("select '9.999,90'").select(money.coerce_price(F.lit("2.000.000,5"))))[0] == 2000000.5


def test_text_keys(spark):
    d = one(spark.range(1).select(
        text.match_text(F.lit("Größe & Stück 130 g/m²")), text.loose_key(F.lit("250 g/m² Naturpapier FSC®")), text.loose_key(F.lit("250 g/m2 Naturpapier FSCr")),
        text.label_matches(F.lit("80 g/m2 Offsetpapier"), F.lit("80 g/m² Offsetpapier")), text.label_matches(F.lit("A5 lang"), F.lit("A5")),
    ))
    assert d[0] == "groe and stuck 130 g m2" and d[1] == d[2] == "250 g m2 naturpapier fsc" and d[3] is True and d[4] is False


def test_option_semantics(spark):
    ok = one(spark.range(1).select(
        text.option_matches(F.lit("quantity"), F.lit("250"), F.lit("250 Stück")), text.option_matches(F.lit("format"), F.lit("A5"), F.lit("148 x 210 mm DIN A5 Hochformat")),
        text.option_matches(F.lit("paper"), F.lit("a"), F.lit("b")), text.value_equals(F.lit(None).cast("string"), F.lit("x")),
    ))
    assert list(ok) == [True, True, False, False]


def test_zero_price_loses(spark):
    c = spark.createDataFrame([(1, 0.0, 999, "json:a"), (1, 12.34, 5, "json:b")], "u int, value double, score int, source string")
    assert one(pr.select_best(c, ["u"])).price == 12.34


def test_price_selection_is_order_free(spark):
    rows = [(1, 10.0, 5, "x"), (1, 12.0, 5, "json:total_gross_value"), (1, 10.0, 9, "named:total"), (1, 7.0, 50, "json:shipping")]
    a = one(pr.select_best(spark.createDataFrame(rows, "u int, value double, score int, source string"), ["u"]))
    b = one(pr.select_best(spark.createDataFrame(rows[::-1], "u int, value double, score int, source string"), ["u"]))
    assert a == b and a.price == 12.0


def test_json_walk_has_no_depth_limit(spark):
    deep = 1
    for k in range(30, 0, -1):
        deep = {f"k{k}": deep} if k % 3 else [deep, "]{\\\""]
    rows = [(1, json.dumps({"a": {"b": {"c": 1}}})), (2, json.dumps(deep)), (3, "not json"), (4, None), (5, "[]")]
    d = spark.createDataFrame(rows, "id int, j string").withColumn("v", jsonwalk.parse(F.col("j")))
    assert {r.id: r.d for r in d.select("id", jsonwalk.nesting(F.col("v")).alias("d")).collect()} == {1: 3, 2: 30, 3: None, 4: None, 5: 1}
    got = jsonwalk.walk(d, "v", ["id"]).collect()
    assert [(r.path, r.number) for r in got if r.id == 1] == [("a.b.c", 1.0)]
    assert [r.path.count("k") for r in got if r.id == 2 and r.kind == "number"] == [20]
    assert len([r for r in got if r.id == 2]) == 11 and [r.kind for r in got if r.id == 5] == ["empty"]
    assert jsonwalk.walk(d.where("id = 3"), "v", ["id"]).count() == 0


def test_last_occurrence_wins_beyond_a_million_items(spark):
    from quotelens.operators import validate

    # positions 2 and 10 and those of more than six digits must compare as numbers
    body = "[" + ",".join("0" for _ in range(1_000_001)) + ',{"name":"x","value":"late"}]'
    d = spark.createDataFrame([(1, '[{"name":"x","value":"early"}' + "," + body[1:])], "id int, body string")
    got = [r for r in validate.accepted_options(d, ["id"], "body").collect() if r.option_key == "x"]
    assert [r.accepted_value for r in got] == ["late"]


def test_unit_id_matches_canonical_json(spark):
    import hashlib

    spec = {"url": "https://x.de/ü", "site_name": "x", "product_type": "flyer", "expected_currency": "EUR", "expected_price": 12.5, "options": {"b": "2", "a": "Größe"}}
    want = "unit_" + hashlib.sha1(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    options = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("Größe"))
    got = one(spark.range(1).select(planning.unit_id(F.lit(spec["url"]), F.lit("x"), F.lit("flyer"), F.lit("EUR"), F.lit(12.5), options)))[0]
    assert got == want


def test_state_fold(spark):
    ev = spark.createDataFrame([("a", 1, "completed"), ("a", 2, "failed"), ("b", 1, "failed"), ("b", 2, "completed"), ("c", 1, "skipped")], "unit_id string, seq int, status string")
    got = {r.unit_id: (r.state, r.is_failed) for r in planning.fold_state(ev).collect()}
    assert got == {"a": ("completed", True), "b": ("completed", False), "c": ("skipped", False)}


def test_breaker_trips_on_five_blocks(spark):
    rows = [("j", i, i, 429 if i > 5 else 200, "") for i in range(1, 11)]
    a = spark.createDataFrame(rows, "host string, attempt_id int, ts_us long, status int, reason string")
    r = one(gates.breaker_trips(a, "host", ["ts_us", "attempt_id"], F.lit(0)))
    assert r.trip_event_no == 10 and r.open_reason.startswith("circuit_open_block_rate rate=0.500")


def test_rolling_blocks_equal_plain_window(spark):
    from pyspark.sql import Window as W

    d = spark.range(20_000).select((F.col("id") % 3).alias("k"), "id", (F.hash("id") % 7).alias("x"))
    o = skew.with_ordinal(d, ["k"], ["id"], F.floor(F.col("id") / 500))
    got = skew.rolling(o, ["k"], "ordinal", 40, {"s": F.sum("x")}, block=100).select("id", "s")
    want = d.withColumn("s", F.sum("x").over(W.partitionBy("k").orderBy("id").rowsBetween(-39, 0))).select("id", "s")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_fold_runs_brute_force(spark):
    import random

    rnd = random.Random(1)
    rows = [(k, s, rnd.choice("AB")) for k in "xyz" for s in range(30)]
    want = {}
    for k, s, v in rows:
        old = want.get(k)
        want[k] = (v, old[1] + 1 if old and old[0] == v else 1)
    got = knowledge.fold_runs(spark.createDataFrame(rows, "k string, s int, v string"), ["k"], "s", "v").collect()
    assert {r.k: (r.v, r.hit_count) for r in got} == want


def test_value_map_outcomes(spark):
    vm = spark.createDataFrame([
        ("s", "44", "quantity", "", "25", "25", "confirmed"), ("s", "8", "material", "", "89", "80 g/m² Offsetpapier", "confirmed"), ("s", "8b", "material", "", "90", "80 g/m² Offsetpapier", "partial"),
        ("s", "1", "size", "", "1", "small", "confirmed"), ("s", "1", "size", "", "2", "small (variant)", "confirmed"), ("s", "9", "product_variant", "", "3", "Speziell", "ui_only"),
    ], "site string, property_id string, canonical_key string, source_label string, backend_id string, label string, confidence string")
    req = spark.createDataFrame([
        ("s", "quantity", "25"), ("s", "quantity", "12345"), ("s", "material", "80 g/m2 Offsetpapier"), ("s", "size", "small"), ("s", "binding", "Klebebindung"), ("s", "product_variant", "Speziell"), ("t", "quantity", "1"),
    ], "site string, canonical_key string, value string")
    got = {(r.site, r.canonical_key, r.value): r.status for r in rs.resolve_values(req, vm, vm).collect()}
    assert got == {
        ("s", "quantity", "25"): "resolved", ("s", "quantity", "12345"): "no_match", ("s", "material", "80 g/m2 Offsetpapier"): "key_collision", ("s", "size", "small"): "ambiguous",
        ("s", "binding", "Klebebindung"): "no_property", ("s", "product_variant", "Speziell"): "no_match", ("t", "quantity", "1"): "no_map",
    }
    assert one(rs.resolve_values(req.filter("canonical_key = 'product_variant'"), vm, vm, ui_only=True)).status == "resolved"


def test_regrouped_singletons(spark):
    labels = [f"{n} g/m² Papier" for n in range(80, 140, 10)] + ["Umschlag 130 g/m² matt", "Umschlag 170 g/m² matt", "Umschlag 250 g/m² matt", "4/4-farbig"]
    g = spark.createDataFrame([("s", i, x, 1) for i, x in enumerate(labels)], "s string, group_ord int, group_label string, option_count int")
    got = ct.regroup_singletons(g, ["s"]).groupBy("catalog_group").count().collect()
    assert {r.catalog_group: r["count"] for r in got} == {"material (innen)": 6, "material (umschlag)": 3, "4/4-farbig": 1}


def test_quantity_tiles(spark):
    vals = ["10", "100", "1000", "19000", "Interpolation"]
    d = spark.createDataFrame([("f", i, v, f"V{i}") for i, v in enumerate(vals)], "f string, no int, visible_value string, varindex string")
    r = one(ct.quantity_tiles(d, ["f"], "no"))
    assert (r.tile_presets, r.max_tile_preset, r.interpolation_code, r.supports_interpolation) == ("10,100,1000,19000", 19000.0, "V4", True)


def test_form_fields_and_inputs(spark):
    from urllib.parse import quote, urlencode

    link = "https://s/x?" + urlencode({"depvar_index_setparent": "<G1><O1>", "depvar_index_set_1": "<G2><O2>"})
    body = urlencode({"input_var_AB_1_1": "25", "input_var_AB_1_2": "matt", "SetLink": quote(link)})
    rows = ct.form_fields(spark.createDataFrame([(1, body)], "id int, post_data string"), ["id"]).orderBy("position_index").collect()
    assert [(r.depvar_param_name, r.depvar_group_code, r.depvar_option_code) for r in rows] == [("depvar_index_setparent", "G1", "O1"), ("depvar_index_set_1", "G2", "O2")]
    html = '{"h":"\\u003cinput value=\\"matt\\" data-varindex=\\"7\\" name=\\"input_var_AB_1_2\\"\\u003e"}'
    r = one(ct.option_inputs(spark.createDataFrame([(html,)], "h string"), [], F.col("h")))
    assert (r.field_name, r.visible_value, r.varindex) == ("input_var_AB_1_2", "matt", "7")


def test_enriched_catalog(spark):
    o = spark.createDataFrame([("s", 1, 1, "matt", "matt", "p"), ("s", 1, 2, "gloss", "gloss", "p"), ("s", 2, 1, "other", "other", "q")], "s string, group_ord int, option_ord int, visible_value string, visible_label string, source_label string")
    f = spark.createDataFrame([("s", 0, "input_var_A_1_1", "Matt", "O9", "G9", "depvar_index_setparent")], "s string, field_no int, field_name string, current_visible_value string, depvar_option_code string, depvar_group_code string, depvar_param_name string")
    v = spark.createDataFrame([("s", "input_var_A_1_1", "gloss", "V5", 1)], "s string, field_name string, visible_value string, varindex string, tag_no int")
    got = {(r.group_ord, r.option_ord): (r.field_name, r.option_code, r.enriched_selected, r.option_code_unknown) for r in ct.enrich_with_form_fields(o, f, v, "s").collect()}
    assert got[(1, 1)] == ("input_var_A_1_1", "O9", True, False) and got[(1, 2)] == ("input_var_A_1_1", "V5", False, False) and got[(2, 1)][0] is None


def test_greedy_assignment_brute_force(spark):
    import random

    rnd = random.Random(3)
    dd = [("p", i, rnd.randint(2, 12)) for i in range(6)]
    pp = [("p", j, rnd.randint(1, 12), False) for j in range(5)]
    edges = sorted(((70 - min(50, 3 * abs(c - v)) + 45 * (c == v) + 6 * (3 <= c <= 40), i, j) for _, i, c in dd for _, j, v, _ in pp), reverse=True)
    want, ds, ps = {}, set(), set()
    for s, i, j in edges:
        if s >= 30 and i not in ds and j not in ps:
            want[i] = j
            ds.add(i)
            ps.add(j)
    got = rs.assign_dropdowns(spark.createDataFrame(dd, "s string, dropdown_no long, option_count long"), spark.createDataFrame(pp, "s string, property_no long, value_count long, is_range boolean"), "s")
    assert {r.dropdown_no: r.property_no for r in got.collect()} == want


def test_injections_and_scales(spark):
    body = one(spark.range(1).select(rq.set_json(F.lit('{"a":[1]}'), {"$.a[2].b": F.lit("5"), "c.d": F.lit('"x"')})))[0]
    assert json.loads(body) == {"a": [1, {}, {"b": 5}], "c": {"d": "x"}}
    u = spark.createDataFrame([(1, "250", '{"quantity":"1"}', '[{"id":65315686,"wert":250}')], "id int, quantity string, template_body string, preview string")
    rows = {r.kind: json.loads(r.body_text) for r in rq.quantity_scale_requests(u).collect()}
    assert rows["price_scale"] == {"quantity": "250", "isIndividualQuantity": False, "priceScaleId": "65315686"} and rows["quantity_manual"]["isIndividualQuantity"] is True


def test_form_rewrite(spark):
    from urllib.parse import parse_qsl, urlencode, urlsplit

    body = urlencode([("q", "50"), ("x", "1"), ("SetLink", "https://s/c?depvar_index_setparent=%3CG%3E%3CO%3E")])
    u = spark.createDataFrame([(1, body, "q", "75", "G", "N", False, True, None), (2, body, "q", "75", "G", "N", True, False, None), (3, body, "", "", "G", "", False, False, None)],
                              "id int, post_data string, field_name string, field_value string, group_code string, option_code string, code_unknown boolean, is_selected boolean, quantity_mode string")
    rows = {r.id: r for r in rq.form_requests(u).collect()}
    pairs = dict(parse_qsl(rows[1].body_text))
    assert pairs["q"] == "75" and dict(parse_qsl(urlsplit(pairs["SetLink"]).query)) == {"depvar_index_setparent": "<G><N>"}
    assert rows[2].skip_reason == "option_code_unknown_for_value" and dict(parse_qsl(rows[2].body_text))["q"] == "50"
    assert rows[3].skip_reason == "catalog_row_missing_form_metadata"


def test_query_rewrite(spark):
    u = spark.createDataFrame([("https://v/-/content_size?PAGES=4&b=1", {"amount": "500", "format": "148x210", "pages": "8"})], "u string, o map<string,string>")
    r = one(rq.query_requests(u, "u", "o"))
    assert r.request_url == "https://v/-/content_size?AMOUNT=500&CONTENT_SIZE=148x210&PAGES=8&b=1"


def test_url_parts(spark):
    u = F.lit("https://WWW.Shop.de:80/a//b-c/Price_Matrix/?x=1")
    r = one(spark.range(1).select(urls.normalized_endpoint(u), urls.prefix_key(u), urls.cache_key(u), urls.site_name(u)))
    assert list(r) == ["https://www.shop.de:80/a/bc/pricematrix", "www.shop.de:80/a/b-c", "shop.de:80/a//b-c/Price_Matrix", "shop.de"]


def test_inferred_rules(spark):
    from quotelens.operators import reports as rp

    m = spark.createDataFrame([(1, 1, "u", "quantity", "properties[name=Menge].id", 1), (1, 1, "u", "quantity", "qty", 2), (1, 1, "u", "format", "fmt", 3)], "run_id int, rank int, url string, option_key string, path string, mutation_no int")
    vm = spark.createDataFrame([(1, "format", {"A5": "7"})], "run_id int, option_key string, value_map map<string,string>")
    named = spark.createDataFrame([(1, "menge", 2)], "run_id int, name string, property_pos int")
    got = {r.input_key: (r.path, r.value_map) for r in rp.inject_rules(m, vm, named).collect()}
    assert got == {"quantity": ("properties[2].id", None), "format": ("fmt", {"A5": "7"})}


def test_weights_of_sources_are_those_of_the_columns(spark):
    words = [*vocab.PATH_BONUS_VALUE, *vocab.PATH_BONUS_TOTAL, *vocab.PATH_MALUS_PART, *vocab.PATH_MALUS_EXTRA, *vocab.GROUP_SHIPPING, *vocab.GROUP_TOTAL, *vocab.GROUP_COMPONENT]
    sources = [None, "", "derived_vat:19.00%:x", "Selected_Config:value:A", *words, *(f"json:{a}.{b.upper()}" for a in words for b in words[::7])]
    d = spark.createDataFrame([(s,) for s in sources], "source string").withColumn("w", pr.source_weights(F.col("source")))
    grp = pr.candidate_group(F.col("source"))
    rows = d.select("source", "w", F.coalesce(pr.path_bonus(F.col("source")), F.lit(0)), grp, pr.group_priority(grp)).collect()
    assert len(rows) == len(sources) and all(tuple(r[1]) == tuple(r)[2:] for r in rows)


def test_first_dom_stages_are_merged(spark):
    """Written tables are small on disk and large in memory: the driver would hold the first stages of all runs."""
    dom = spark.createDataFrame([(1, 1, 5.0), (1, 0, 7.0), (1, 0, 6.0), (2, 2, 4.0), (3, 0, -1.0)], "run_id int, stage int, value double")
    others = spark.createDataFrame([(1, 9.0, 12, "selected_config:total"), (3, 8.0, 12, "selected_config:total")], "run_id int, value double, score int, source string")
    out = pr.prices_from_dom(dom, others, ["run_id"])
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.run_id, r.replay, r.lowest, r.price) for r in out.collect()) == [(1, "browser_dom_post_interaction", 6.0, 9.0), (2, "browser_dom", 4.0, 4.0)]


def test_template_mutations_are_not_capped(spark):
    from quotelens.operators import reports

    items = ",".join(f'{{"quantity": {i}}}' for i in range(20))
    form = "&".join(f"quantity{i}=1" for i in range(18))
    rows = [(1, 1, "json", f'{{"rows": [{items}]}}'), (1, 2, "form", form)]
    got = reports.template_mutations(spark.createDataFrame(rows, "run_id int, rank int, url string, post_data string")).collect()
    by_url = {u: sorted((r.mutation_no, r.path) for r in got if r.url == u and r.option_key == "quantity") for u in ("json", "form")}
    assert [p for _, p in by_url["form"]] == [f"quantity{i}" for i in range(18)] and [n for n, _ in by_url["form"]] == list(range(1, 19))
    assert {f"rows[{i}].quantity" for i in range(20)} <= {p for _, p in by_url["json"]}


def test_only_pages_of_the_units_are_mined(spark, monkeypatch):
    from quotelens.plans import prices as plans
    from quotelens.plans.evidence import view

    sf_dir, seen = "/root/testdata/sf0.001", []
    plain = pr.prices_from_dom
    monkeypatch.setattr(pr, "prices_from_dom", lambda dom, others, keys, *rest: seen.extend([dom, others]) or plain(dom, others, keys, *rest))
    plans.extraction_tiers(spark, sf_dir)
    units = {r.run_id for r in view(spark, sf_dir, "units").select("run_id").distinct().collect()}
    pages = {r.run_id for r in view(spark, sf_dir, "price_lines").select("run_id").distinct().collect()}
    assert not pages <= units and len(seen) == 2
    assert all({r.run_id for r in d.select("run_id").distinct().collect()} <= units for d in seen)


def test_run_prices_scores_traces_once(spark):
    from quotelens.plans import prices as plans

    plan = plans.run_prices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cdn.example.com/gtm" not in plan  # traces stand in written tables only
