"""Readers over small files."""

import json

from pyspark.sql import functions as F

from quotelens.operators.gates import gate_metrics, stage_report
from quotelens.sources import manifests, results, rules, stage_policies


def test_csv_manifest(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_bytes("Type;Auflage;option.Größe;options_json;Net price\nflyer;250;A5;\"{\"\"finish\"\":\"\"matt\"\"}\";12.5\n".encode("cp1252"))
    r = manifests.read_csv_manifest(spark, str(p), default_url="https://d/").collect()[0]
    assert (r.url, r.product_type, r.expected_price, r.options) == ("https://d/", "flyer", 12.5, {"finish": "matt", "Auflage": "250", "Größe": "A5"})


def test_json_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"targets": [{"url": "https://a", "options": {"quantity": 25}}, {"url": "https://b", "expected_price": 3}]}))
    rows = manifests.read_json_manifest(spark, str(p)).orderBy("unit_ord").collect()
    assert [r.url for r in rows] == ["https://a", "https://b"] and rows[0].options == {"quantity": "25"} and rows[1].expected_price == 3.0


def test_results_export_rules(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"unit_id":"a","summary":{"price":5,"site":"s"}}\n\nbad\n[1]\n{"unit_id":"b","price":null,"summary":{"price":7}}\n')
    rows = {r.unit_id: r for r in results.flatten_results(results.read_results(spark, str(p))).collect()}
    assert len(rows) == 2 and rows["a"].price == "5" and rows["b"].price is None and rows["a"].site == "s"


def test_checkpoint_and_snapshots(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"completed": {"u1": {"updated_at": "t"}}, "failed": {"u1": {}, "u2": {}}, "skipped": {"u3": {"reason": "r"}}}))
    assert {r.unit_id: r.state for r in results.read_checkpoint(spark, str(p)).collect()} == {"u1": "completed", "u2": "failed", "u3": "skipped"}
    run = tmp_path / "runs" / "site" / "r1"
    run.mkdir(parents=True)
    (run / "network_traces.json").write_text(json.dumps([{"url": "https://x", "method": "post", "request_headers": {"A": "b"}}, {"url": "https://y", "status": 200}]))
    (run / "bootstrap.json").write_text(json.dumps({"site_name": "s", "option_groups": [1], "new_field": {"a": 1}}))
    t = results.artifact_traces(results.read_run_artifacts(spark, str(tmp_path / "runs"), "network_traces.json")).orderBy("trace_idx").collect()
    assert [(r.run_id, r.method, r.status) for r in t] == [("r1", "POST", 0), ("r1", "GET", 200)] and t[0].request_headers == {"A": "b"}
    s = results.normalize_snapshots(results.read_run_artifacts(spark, str(tmp_path / "runs"), "bootstrap.json")).collect()[0]
    assert s.option_groups == "[1]" and s.cookies == "{}" and s.extra == {"new_field": '{"a":1}'}


def test_value_map_files(spark, tmp_path):
    good = {"schemaVersion": 1, "properties": [{"propertyId": 44, "canonicalKey": "Quantity", "options": [{"backendId": 25, "label": "25", "confidence": "confirmed"}]}]}
    for name, body in {"good": json.dumps(good), "old": '{"schemaVersion":2}', "list": "[]", "broken": "{"}.items():
        (tmp_path / f"{name}.json").write_text(body)
    rows, diag = rules.read_value_maps(spark, str(tmp_path))
    r = rows.collect()
    assert len(r) == 1 and (r[0].site, r[0].property_id, r[0].canonical_key, r[0].backend_id) == ("good", "44", "quantity", "25")
    assert {d.site: d.load_error for d in diag.collect()} == {"good": None, "old": "unsupported_schema_version", "list": "schema_root_not_object", "broken": "json_parse_failed"}


def test_adapter_files(spark, tmp_path):
    ok = {"id": "a", "match": {"domains": ["x.de"]}, "endpoint": {"url": "/p", "method": "post"}, "request_template": {}, "response_extract": {"price_path": "p"}, "inject": [{"input_key": "quantity", "path": "q", "cast": "int"}]}
    docs = {"1": ok, "2": ok | {"enabled": False}, "3": ok | {"enabled_when_env": "FLAG"}, "4": ok | {"match": {}}, "5": {"id": "z"}}
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    (tmp_path / "6.json").write_text("nope")
    a = rules.read_adapters(spark, str(tmp_path))
    got = {r.file: (r.kind, r.reason) for r in a.collect()}
    assert got == {"1": ("loaded", None), "2": ("skipped", "disabled_adapter"), "3": ("skipped", "disabled_by_env"), "4": ("invalid", "invalid_schema"), "5": ("invalid", "invalid_schema"), "6": ("invalid", "invalid_json")}
    r = rules.adapter_rules(a).collect()
    assert len(r) == 1 and (r[0].input_key, r[0].cast_to) == ("quantity", "int")
    assert {x.kind: x.records for x in rules.adapter_diagnostics(a).groupBy("kind").agg(F.sum("records").alias("records")).collect()} == {"loaded": 1, "skipped": 2, "invalid": 3}


def test_policies_are_clamped(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps({"stages": [{"name": " Probe ", "unit_budget": 0, "envelope": {"workers": "x", "max_rps": 0}, "gate": {"max_block_rate": 7}}]}))
    r = stage_policies.read_policies(spark, str(p)).collect()[0]
    assert (r["name"], r.unit_budget, r.workers, r.max_rps, r.max_block_rate) == ("probe", 1, 1, 0.1, 1.0)


def test_second_run_is_skipped(spark):
    rows = spark.createDataFrame([("single_config", "skipped", False, False, False)] * 3, "stage string, status string, success boolean, blocked boolean, server_error boolean")
    r = {x.stage: (x.stage_status, x.stage_reason) for x in stage_report(gate_metrics(rows, stage_policies.default_policies(spark))).collect()}
    assert r["single_config"] == ("skipped", "already_processed") and r["probe"] == ("skipped", "no_eligible_units")


def test_csv_folder_of_mixed_files(spark, tmp_path):
    """Each file has its own encoding, delimiter and header; quoted line ends and short rows are read as they stand."""
    (tmp_path / "a.csv").write_bytes("﻿url,Site-Name,menge,note\nhttps://a,Süd,5,\"two\nlines, one cell\"\n\nhttps://b,x,,\n".encode())
    (tmp_path / "b.csv").write_bytes("url;site_name;option.Größe;Net price;options\nhttps://c;Köln €;A5;1.5;\"{\"\"f\"\":\"\"m\"\",\"\"Größe\"\":\"\"A4\"\"}\"\nhttps://d;kurz\n".encode("cp1252"))
    (tmp_path / "c.csv").write_text("type\turl\tmenge\tmenge\nflyer\thttps://e\t1\t2\n")
    (tmp_path / "d.csv").write_text("")
    rows = {r.url: r for r in manifests.read_csv_manifest(spark, str(tmp_path)).collect()}
    assert set(rows) == {f"https://{x}" for x in "abcde"}
    assert rows["https://a"].options == {"menge": "5", "note": "two\nlines, one cell"} and rows["https://a"].site_name == "Süd" and rows["https://b"].options == {}
    assert rows["https://c"].options == {"Größe": "A5", "f": "m"} and rows["https://c"].site_name == "Köln €" and rows["https://c"].expected_price == 1.5
    assert rows["https://d"].site_name == "kurz" and rows["https://d"].options == {}
    assert rows["https://e"].options == {"menge": "2"} and rows["https://e"].product_type == "flyer" and rows["https://e"].row_no == 2


def test_option_lists_in_cut_texts(spark):
    from quotelens.functions import optionlists as ol

    whole = '{"propertyOptions":[{"id":"44","isRange":true,"propertyValueOptions":[{"id":50},{"id":25},{"id":50},{"id":-1},{"x":1},5]},{"id":0},7,{"id":9,"propertyValueOptions":null}]}'
    cases = [
        (whole, [25, 50]), ('{"a":[{"ID":44,"propertyValueOptions":[{"id":3,"n":[1]},{"id":2}]},{"id":1', [2, 3]), ('{"id":44,"propertyValueOptions":[{"id":3},{"id"', []),
        ('{"id":44,"x":1', []), ("", []), (None, []), ('{"propertyOptions":[]}', []), ('"id":441,"propertyValueOptions":[{"id":8}]', [8]), ('{"id":44,"propertyValueOptions":' + "[" * 3000 + '{"id":6}' + "]" * 3000 + "cut", [6]),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.ids for r in d.select("i", ol.quantity_value_options(F.col("t"), F.lit(44)).alias("ids")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    rows = d.filter("i = 0").select(F.inline(ol.property_options(F.col("t")))).collect()
    assert [(r.property_id, r.is_range, r.value_ids) for r in rows] == [(44, True, [50, 25, 50]), (9, False, [])]
    text = 'cut "propsTranslated": {"a":" 1 ","b":"","c":"x"} more "propGroupWithPropertyName":{"a":"2","d":{"e":1}} "propGroupsWithPropsTranslated":{"a":"0","z":"9"}'
    assert spark.createDataFrame([(text,)], "t string").select(ol.preview_configuration(F.col("t"))).first()[0] == {"a": "1", "c": "x", "z": "9"}
    runs = spark.createDataFrame([([1, 2, 3, 5, 8], 2), ([1], 1), ([1], 2)], "a array<long>, q long").select(ol.print_runs(F.col("a"), F.col("q")).alias("r")).collect()
    assert [r.r for r in runs] == [[2, 3, 5, 8], [1], None]


def test_site_rules(spark):
    from quotelens.operators.registry import SiteRule, site_candidates

    def many(unit):
        for i in range(unit["n"]):
            yield "GET", f"{unit['url']}/{i}", None

    rules = [SiteRule("many", ("alpha", "beta"), many), SiteRule("one", ("beta",), lambda u: iter([("POST", u["url"], "x=1")]))]
    u = spark.createDataFrame([(1, "Alpha", "https://x", 2), (2, "", "https://BETA.de", 1), (3, None, "https://gamma", 5), (4, "alpha", None, 0)], "id int, site_name string, url string, n int")
    got = sorted((r.id, r.rule, r.candidate_no, r.method, r.url, r.body) for r in site_candidates(u, rules, "id").collect())
    assert got == [(1, "many", 0, "GET", "https://x/0", None), (1, "many", 1, "GET", "https://x/1", None), (2, "many", 0, "GET", "https://BETA.de/0", None), (2, "one", 0, "POST", "https://BETA.de", "x=1")]


def test_manifest_files_stay_small(spark, tmp_path, monkeypatch):
    """A task reads a file whole: the query writes files of a bounded number of rows."""
    from quotelens.plans import transfer

    monkeypatch.setattr(transfer, "FILE_ROWS", 100)
    monkeypatch.setattr(transfer, "scratch", lambda _: str(tmp_path / "m"))
    n = transfer.csv_manifest_units(spark, "/root/testdata/sf0.001").count()
    sizes = [sum(1 for _ in f.open()) - 1 for f in (tmp_path / "m").glob("*.csv")]
    assert sum(sizes) == n and max(sizes) <= 100


def test_encoding_is_tried_piece_by_piece():
    piece = 1 << 20
    inside = b"a" * (piece - 1) + "ü".encode() + b"b" * piece
    assert manifests._csv_encoding(memoryview(inside)) == "utf-8-sig"
    assert manifests._csv_encoding(memoryview(inside + "ü".encode()[:1])) == "cp1252"
    assert manifests._csv_encoding(memoryview(b"a" * piece + b"\x81")) == "latin-1"
