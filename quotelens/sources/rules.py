"""Readers of declared rules: value maps and JSON adapters, with diagnostics instead of failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("file"), "value")
    return d.withColumn("v", F.try_parse_json("value"))


def _kind(path: str):
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get("v", path, "variant")), r"^[A-Z]+", 0)


def read_value_maps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries, diagnostics) of ``<site>.json`` files. Broken files are reported, never fatal."""
    d = _documents(spark, folder)
    version = F.try_variant_get("v", "$.schemaVersion", "int")
    error = (
        F.when(F.col("v").isNull(), "json_parse_failed").when(_kind("$") != "OBJECT", "schema_root_not_object").when(~version.eqNullSafe(F.lit(1)), "unsupported_schema_version")
    )
    d = d.withColumn("load_error", error)
    diagnostics = d.select(F.col("file").alias("site"), "load_error")
    ok = d.filter("load_error is null").select(F.lower("file").alias("site"), F.try_variant_get("v", "$.properties", "variant").alias("p")).filter("p is not null")
    text = lambda c, n: F.coalesce(F.try_variant_get(c, f"$.{n}", "string"), F.lit(""))
    props = ok.lateralJoin(spark.tvf.variant_explode(F.col("p").outer())).select(
        "site", F.col("pos").alias("property_ord"), text("value", "propertyId").alias("property_id"), F.lower(F.trim(text("value", "canonicalKey"))).alias("canonical_key"),
        text("value", "sourceLabel").alias("source_label"), F.from_json(F.to_json(F.try_variant_get("value", "$.productScope", "variant")), "array<string>").alias("scope"),
        text("value", "note").alias("note"), F.try_variant_get("value", "$.options", "variant").alias("o"),
    ).filter("o is not null")
    rows = props.lateralJoin(spark.tvf.variant_explode(F.col("o").outer())).select(
        "site", "property_ord", "property_id", "canonical_key", "source_label", F.coalesce("scope", F.array(F.lit("*"))).alias("product_scope"), "note",
        F.col("pos").alias("option_ord"), text("value", "backendId").alias("backend_id"), text("value", "label").alias("label"), F.lower(F.trim(text("value", "confidence"))).alias("confidence"),
    )
    return rows, diagnostics


def read_adapters(spark: SparkSession, folder: str, enabled_flags: list[str] | None = None) -> DataFrame:
    """Adapter records in file order with kind (loaded / skipped / invalid), reason and issue list.

    ``enabled_flags``: names of the switches that are on, for records with ``enabled_when_env``.
    """
    text = lambda n: F.nullif(F.trim(F.try_variant_get("v", f"$.{n}", "string")), F.lit(""))
    d = _documents(spark, folder)
    obj = lambda n: _kind(f"$.{n}") == "OBJECT"
    shape = [
        F.when(_kind("$") != "OBJECT", "root must be a JSON object"), F.when(text("id").isNull(), "missing required field: id"),
        *[F.when(~F.coalesce(obj(n), F.lit(False)), f"missing or invalid required object: {n}") for n in ("match", "endpoint", "request_template", "response_extract")],
        F.when(F.coalesce(~_kind("$.inject").isin("ARRAY", ""), F.lit(False)), "inject must be an array when present"),
    ]
    domains = F.filter(F.coalesce(F.from_json(F.to_json(F.try_variant_get("v", "$.match.domains", "variant")), "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    method = F.upper(text("endpoint.method"))
    content = [
        F.when((F.size(domains) == 0) & text("match.url_regex").isNull(), "match requires at least one of: domains or url_regex"),
        F.when(text("endpoint.url").isNull(), "endpoint.url must be a non-empty string"),
        F.when(~F.coalesce(method.isin("GET", "POST"), F.lit(False)), "endpoint.method must be GET or POST"),
        F.when(text("response_extract.price_path").isNull(), "response_extract.price_path must be a non-empty string"),
    ]
    rules = F.from_json(
        F.to_json(F.try_variant_get("v", "$.inject", "variant")),
        "array<struct<input_key:string,path:string,cast:string,value_map:map<string,string>,require_mapped:boolean>>",
    )
    rule_issues = F.transform(
        F.coalesce(rules, F.array().cast("array<struct<input_key:string,path:string,cast:string,value_map:map<string,string>,require_mapped:boolean>>")),
        lambda r, i: F.filter(
            F.array(
                F.when(F.coalesce(F.trim(r["input_key"]), F.lit("")) == "", F.concat(F.lit("inject["), i.cast("string"), F.lit("].input_key must be non-empty"))),
                F.when(F.coalesce(F.trim(r["path"]), F.lit("")) == "", F.concat(F.lit("inject["), i.cast("string"), F.lit("].path must be non-empty"))),
                F.when(~F.lower(F.trim(F.coalesce(r["cast"], F.lit("")))).isin("", "int", "float", "str"), F.concat(F.lit("inject["), i.cast("string"), F.lit("].cast must be one of int|float|str"))),
            ), lambda x: x.isNotNull(),
        ),
    )
    shape_issues = F.filter(F.array(*shape), lambda x: x.isNotNull())
    all_content = F.concat(F.filter(F.array(*content), lambda x: x.isNotNull()), F.flatten(rule_issues))
    d = d.withColumn("_shape", shape_issues).withColumn("issues", F.when(F.col("v").isNull(), F.array(F.lit("invalid_json"))).when(F.size("_shape") > 0, F.col("_shape")).otherwise(all_content))
    flag = text("enabled_when_env")
    off_flag = flag.isNotNull() & ~F.coalesce(flag.isin(enabled_flags or ["-"]), F.lit(False))
    kind = (
        F.when(F.col("v").isNull() | (F.size("issues") > 0), "invalid").when(~F.coalesce(F.try_variant_get("v", "$.enabled", "boolean"), F.lit(True)), "skipped").when(off_flag, "skipped").otherwise("loaded")
    )
    reason = F.when(F.col("v").isNull(), "invalid_json").when(F.size("issues") > 0, "invalid_schema").when(~F.coalesce(F.try_variant_get("v", "$.enabled", "boolean"), F.lit(True)), "disabled_adapter").when(off_flag, "disabled_by_env")
    return d.select(
        "file", text("id").alias("adapter_id"), kind.alias("kind"), reason.alias("reason"), F.array_join("issues", "; ").alias("issues"), domains.alias("domains"),
        F.coalesce(text("match.url_regex"), F.lit("")).alias("url_regex"), text("endpoint.url").alias("endpoint_url"), F.coalesce(method, F.lit("POST")).alias("endpoint_method"),
        F.to_json(F.try_variant_get("v", "$.request_template", "variant")).alias("request_template"), text("response_extract.price_path").alias("price_path"), rules.alias("rules"),
    )


def adapter_rules(adapters: DataFrame) -> DataFrame:
    """Exploded inject rules of the loaded adapters."""
    d = adapters.filter("kind = 'loaded' and rules is not null").select("adapter_id", F.posexplode("rules").alias("rule_no", "r"))
    return d.select(
        "adapter_id", "rule_no", F.trim("r.input_key").alias("input_key"), F.trim("r.path").alias("path"), F.coalesce("r.cast", F.lit("")).alias("cast_to"),
        F.col("r.value_map").alias("value_map"), F.coalesce("r.require_mapped", F.lit(False)).alias("require_mapped"),
    )


def adapter_diagnostics(adapters: DataFrame) -> DataFrame:
    return adapters.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("records"))
