"""Queries that write derived tables out and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quotelens.functions.text import slug
from quotelens.operators.planning import latest_rows
from quotelens.plans.evidence import view, with_views
from quotelens.plans.registry import query
from quotelens.session import checkpoint_root
from quotelens.sinks import writers as wr
from quotelens.sources import manifests as mf
from quotelens.sources import results as rs


#: Rows of a CSV file. A task reads a file whole, so files stay small whatever the number of units.
FILE_ROWS = 250_000


def scratch(spark) -> str:
    """A new folder under the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/transfer-{uuid.uuid4().hex}"


RESULT_CHECK = """
SELECT 'unit' || CAST(unit_no AS VARCHAR) AS unit_id, CAST(unit_no AS VARCHAR) AS "index", url, CASE state WHEN 'pending' THEN 'skipped' ELSE state END AS status, CASE WHEN state <> 'pending' THEN site_name END AS site,
 CASE WHEN state <> 'pending' THEN CASE WHEN state = 'completed' THEN 'true' ELSE 'false' END END AS validated, CASE WHEN state <> 'pending' AND unit_no % 5 <> 0 THEN expected_cents END AS price_cents,
 CASE WHEN state <> 'pending' THEN 'EUR' END AS currency, CASE WHEN state <> 'pending' THEN 'http' END AS replay_mode FROM units"""


@query("exported_results", with_views(["units"], RESULT_CHECK))
def exported_results(spark, sf_dir):
    """Units as result lines, junk lines between them, read tolerantly, flattened and exported to CSV."""
    u = view(spark, sf_dir, "units")
    done = F.col("state") != "pending"
    price = F.when(F.col("unit_no") % 5 != 0, F.col("expected_cents") / 100)
    rows = u.select(
        F.concat(F.lit("unit"), F.col("unit_no").cast("string")).alias("unit_id"), F.col("unit_no").alias("index"), "url", F.when(done, F.col("state")).otherwise("skipped").alias("status"),
        F.when(~done, "already_completed").alias("reason"), F.when(done, F.col("site_name")).alias("site"), F.when(done, F.col("state") == "completed").alias("validated"),
        F.when(done, price).alias("price"), F.when(done, "EUR").alias("currency"), F.lit(None).cast("string").alias("artifact_dir"),
        F.struct(F.lit("http").alias("replay_mode"), F.lit(9.99).alias("price"), F.lit("none").alias("fallback_mode")).alias("summary"),
    )
    base = scratch(spark)
    junk = u.filter("unit_no % 50 = 0").select(F.element_at(F.array(F.lit(""), F.lit("not json"), F.lit("[1,2]"), F.lit('{"broken"')), (F.col("unit_no") / 50 % 4 + 1).cast("int")).alias("value"))
    wr.write_lines(wr.result_lines(rows).unionByName(junk), f"{base}/jsonl")
    wr.export_csv(rs.flatten_results(rs.read_results(spark, f"{base}/jsonl")), f"{base}/csv")
    d = spark.read.option("header", True).csv(f"{base}/csv")
    cents = F.round(F.col("price").cast("double") * 100).cast("bigint")
    return d.select("unit_id", "index", "url", "status", "site", "validated", cents.alias("price_cents"), "currency", "replay_mode")


@query("compact_result_lines", with_views(["units"], """
SELECT status, count(*) AS lines, count(site) AS with_site, sum(n)::BIGINT AS mismatches FROM (SELECT CASE state WHEN 'pending' THEN 'skipped' ELSE state END AS status, CASE WHEN state <> 'pending' THEN site_name END AS site, CASE WHEN state = 'failed' THEN 2 ELSE 0 END AS n FROM units) GROUP BY status"""))
def compact_result_lines(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    done = F.col("state") != "pending"
    none = F.array().cast("array<string>")
    rows = u.select(
        F.col("unit_no").cast("string").alias("unit_id"), F.col("unit_no").alias("index"), "url", F.when(done, F.col("state")).otherwise("skipped").alias("status"), F.when(~done, "already_completed").alias("reason"),
        F.when(done, F.col("site_name")).alias("site"), F.when(done, F.col("state") == "completed").alias("validated"), (F.col("expected_cents") / 100).alias("price"), F.lit("EUR").alias("currency"), F.lit("http").alias("replay_mode"),
        F.lit("none").alias("fallback_mode"), F.lit(None).cast("string").alias("extraction_reason"), F.when(F.col("state") == "failed", F.array(F.lit("a"), F.lit("b"))).otherwise(none).alias("mismatches"), F.lit("x").alias("artifact_dir"),
    )
    path = scratch(spark)
    wr.write_lines(wr.result_lines(rows, "compact"), path)
    d = rs.flatten_results(rs.read_results(spark, path), ["status", "site", "mismatches"])
    n = F.coalesce(F.size(F.from_json("mismatches", "array<string>")), F.lit(0))
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("lines"), F.count("site").alias("with_site"), F.sum(n).alias("mismatches"))


@query("csv_manifest_units", with_views(["units"], """
SELECT CASE WHEN unit_no % 9 = 0 THEN 'https://default.example.com/' ELSE url END AS url, product_type, expected_cents / 100 AS expected_price, 0.01 AS expected_price_tolerance, 'EUR' AS expected_currency, quantity, format, CASE WHEN unit_no % 2 = 0 THEN 'json' END AS finish, unit_no FROM units"""))
def csv_manifest_units(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    path = scratch(spark)
    u.select(
        F.when(F.col("unit_no") % 9 != 0, F.col("url")).alias("url"), F.col("product_type").alias("Type"), (F.col("expected_cents") / 100).alias("Net price"), F.col("quantity").alias("Auflage"), F.col("format").alias("option.format"),
        F.when(F.col("unit_no") % 2 == 0, F.lit('{"finish":"json","format":"overridden"}')).alias("options_json"), F.col("unit_no").alias("No"),
    ).write.option("header", True).option("sep", ";").option("escape", '"').option("maxRecordsPerFile", FILE_ROWS).csv(path)
    d = mf.read_csv_manifest(spark, path, default_url="https://default.example.com/")
    o = F.col("options")
    return d.select("url", "product_type", "expected_price", "expected_price_tolerance", "expected_currency", o["Auflage"].alias("quantity"), o["format"].alias("format"), o["finish"].alias("finish"), o["No"].cast("bigint").alias("unit_no"))


@query("mixed_csv_manifests", with_views(["units"], """
SELECT url, product_type, 'Straße ' || site_name AS site_name, expected_cents / 100 AS expected_price, quantity, CASE WHEN unit_no % 3 = 1 THEN 'größer' END AS note FROM units"""))
def mixed_csv_manifests(spark, sf_dir):
    """One folder of manifests in two encodings and with three delimiters and headers."""
    u = view(spark, sf_dir, "units")
    path = scratch(spark)
    site, price = F.concat(F.lit("Straße "), F.col("site_name")), F.col("expected_cents") / 100
    kinds = [
        (0, ";", "UTF-8", [F.col("url").alias("URL"), F.col("product_type").alias("Type"), site.alias("Site-Name"), price.alias("Net price"), F.col("quantity").alias("option.menge")]),
        (1, "\t", "ISO-8859-1", [F.lit("größer").alias("note"), site.alias("site_name"), F.col("quantity").alias("menge"), F.col("url"), F.col("product_type"), price.alias("expected_price")]),
        (2, "|", "ISO-8859-1", [F.col("url"), site.alias("site_name"), F.col("product_type"), price.alias("expected_price"), F.col("quantity").alias("menge")]),
    ]
    for n, sep, encoding, columns in kinds:
        u.filter(F.col("unit_no") % 3 == n).select(*columns).write.option("header", True).option("sep", sep).option("encoding", encoding).option("maxRecordsPerFile", FILE_ROWS).csv(f"{path}/{n}")
    d = mf.read_csv_manifest(spark, f"{path}/*")
    return d.select("url", "product_type", "site_name", "expected_price", d.options["menge"].alias("quantity"), d.options["note"].alias("note"))


@query("json_manifest_units", with_views(["units"], """
SELECT url, product_type, expected_cents / 100 AS expected_price, count(*) AS n, max(quantity) AS quantity, 'int' AS quantity_type FROM units GROUP BY ALL"""))
def json_manifest_units(spark, sf_dir):
    u = view(spark, sf_dir, "units")
    path = scratch(spark)
    u.select(F.to_json(F.struct("url", "site_name", "product_type", (F.col("expected_cents") / 100).alias("expected_price"), F.create_map(F.lit("quantity"), F.col("quantity")).alias("options"))).alias("value")).write.text(path)
    d = mf.read_json_lines_manifest(spark, path)
    o = mf.unit_options(d, ["url", "product_type", "expected_price"])
    return o.groupBy("url", "product_type", "expected_price").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("quantity"), F.max("value_type").alias("quantity_type"))


@query("resource_pool_order", """
SELECT 'http://p' || CAST(s_nationkey AS VARCHAR) || ':80' AS resource, count(*) AS n FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1""")
def resource_pool_order(spark, sf_dir):
    from quotelens.plans.evidence import table

    s = table(spark, sf_dir, "supplier")
    path = scratch(spark)
    line = F.when(F.col("s_suppkey") % 8 == 0, F.lit("# off")).when(F.col("s_suppkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" http://p"), F.col("s_nationkey").cast("string"), F.lit(":80 ")))
    s.select(line.alias("value")).write.text(path)
    pool = mf.read_resource_pool(spark, path)
    n = s.filter("s_suppkey % 4 <> 0").groupBy(F.concat(F.lit("http://p"), F.col("s_nationkey").cast("string"), F.lit(":80")).alias("resource")).agg(F.count(F.lit(1)).alias("n"))
    return pool.select("resource").join(n, "resource")


@query("value_map_files", with_views(["value_map"], """
SELECT site, canonical_key, count(*) AS entries, count(DISTINCT property_id) AS properties FROM value_map GROUP BY ALL"""))
def value_map_files(spark, sf_dir):
    """Value maps written as one document per site, read back with diagnostics.

    A document is one site's map by definition; its options are collected per (site, property).
    """
    vm = view(spark, sf_dir, "value_map")
    opts = vm.groupBy("site", "property_id", "canonical_key").agg(F.collect_list(F.struct(F.col("backend_id").alias("backendId"), "label", "confidence")).alias("options"))
    docs = opts.groupBy("site").agg(F.collect_list(F.struct(F.col("property_id").alias("propertyId"), F.col("canonical_key").alias("canonicalKey"), "options")).alias("properties"))
    doc = docs.select("site", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), "site", "properties")).alias("value"))
    base = scratch(spark)
    doc.write.partitionBy("site").text(base)
    # partition folders stand for file names here
    raw = spark.read.text(base, wholetext=True, pathGlobFilter="*.txt")
    named = raw.select("site", F.try_parse_json("value").alias("v"))
    return _entries(spark, named).groupBy("site", "canonical_key").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("property_id").alias("properties"))


def _entries(spark, named):
    p = named.withColumn("p", F.try_variant_get("v", "$.properties", "variant")).lateralJoin(spark.tvf.variant_explode(F.col("p").outer()))
    props = p.select("site", F.try_variant_get("value", "$.propertyId", "string").alias("property_id"), F.try_variant_get("value", "$.canonicalKey", "string").alias("canonical_key"), F.try_variant_get("value", "$.options", "variant").alias("o"))
    return props.lateralJoin(spark.tvf.variant_explode(F.col("o").outer())).select("site", "property_id", "canonical_key", F.try_variant_get("value", "$.label", "string").alias("label"))


@query("checkpoint_states", with_views(["units"], "SELECT state, count(*) AS units FROM units WHERE state <> 'pending' GROUP BY state"))
def checkpoint_states(spark, sf_dir):
    """State log written in two appends, the newest row per unit read back."""
    u = view(spark, sf_dir, "units").select("unit_no", "state")
    path = scratch(spark)
    wr.append_log(u.withColumn("state", F.lit("failed")).withColumn("seq", F.lit(1)), path)
    wr.append_log(u.withColumn("seq", F.lit(2)), path)
    log = spark.read.parquet(path)
    return latest_rows(log, "unit_no", ["seq"]).filter("state <> 'pending'").groupBy("state").agg(F.count(F.lit(1)).alias("units"))


@query("artifact_partitions", with_views(["traces"], """
SELECT 'site-' || CAST(run_id % 7 AS VARCHAR) AS site_slug, count(*) AS rows, count(DISTINCT run_id) AS units FROM traces GROUP BY 1"""))
def artifact_partitions(spark, sf_dir):
    t = view(spark, sf_dir, "traces").select("run_id", "url", "status")
    path = scratch(spark)
    wr.write_artifacts(t.repartition(F.col("run_id") % 7), path, F.concat(F.lit("Site "), (F.col("run_id") % 7).cast("string")), "run_id")
    return spark.read.parquet(path).groupBy("site_slug").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("unit_id").alias("units"))


@query("matrix_file_pairs", with_views(["units"], """
SELECT DISTINCT 'U' || CAST(run_id AS VARCHAR) AS uid, CAST(quantity AS INTEGER) AS quantity FROM units WHERE state = 'completed'"""))
def matrix_file_pairs(spark, sf_dir):
    u = view(spark, sf_dir, "units").filter("state = 'completed'")
    path = scratch(spark)
    rows = u.select(F.concat(F.lit("U"), F.col("run_id").cast("string")).alias("UID"), F.col("quantity").alias("Auflage"), (F.col("expected_cents") / 100).alias("net"), "format", slug(F.col("product_type")).alias("orientation"))
    wr.write_matrix(rows, path, ["orientation", "format"])
    return rs.read_done_pairs(spark, path)


