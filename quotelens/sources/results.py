"""Result and state readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.functions.jsonwalk import get

# Exported columns in order; those after "status" fall back to the nested summary.
COLUMNS = ["unit_id", "index", "url", "status", "site", "validated", "price", "currency", "replay_mode", "fallback_mode", "extraction_reason", "artifact_dir"]
FROM_SUMMARY = COLUMNS[4:]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as VARIANT; blank, broken and non-object lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"))
    return lines.filter(F.col("line").startswith("{")).select("line", F.try_parse_json("line").alias("v")).filter("v is not null")


def flatten_results(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Flat text columns. A summary value fills a column only where its key is absent; a present null stays null.

    Nested values stay JSON text.
    """
    columns = columns or COLUMNS
    keys = F.json_object_keys("line")

    def value(name: str):
        own = get(F.col("v"), f"$.{name}")
        if name not in FROM_SUMMARY:
            return own.alias(name)
        return F.when(F.array_contains(keys, name), own).otherwise(get(F.col("v"), f"$.summary.{name}")).alias(name)

    return rows.select(*[value(c) for c in columns])


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Unit state of a JSON checkpoint: unit_id, state, updated_at, reason. Completed outranks failed and skipped."""
    doc = spark.read.text(path, wholetext=True)
    parts = []
    for rank, state in enumerate(("completed", "failed", "skipped")):
        entries = F.from_json(F.get_json_object("value", f"$.{state}"), "map<string,struct<updated_at:string,reason:string>>")
        parts.append(doc.select(F.explode(entries).alias("unit_id", "e")).select("unit_id", F.lit(state).alias("state"), F.lit(rank).alias("rank"), "e.updated_at", "e.reason"))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = rows.groupBy("unit_id").agg(F.min_by(F.struct("state", "updated_at", "reason"), "rank").alias("r"))
    return best.select("unit_id", "r.state", "r.updated_at", "r.reason")


def read_done_pairs(spark: SparkSession, pattern: str) -> DataFrame:
    """Distinct (uid, quantity) of ``;``-separated priced files."""
    d = spark.read.option("header", True).option("sep", ";").csv(pattern)
    return d.select(F.trim("UID").alias("uid"), F.trim("Auflage").try_cast("int").alias("quantity")).filter("uid <> '' and quantity is not null").distinct()


def read_run_artifacts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One artifact of all run folders ``root/<site>/<run>/<name>``: site, run_id and the document as VARIANT."""
    d = spark.read.text(f"{root}/*/*/{name}", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    return d.select(
        F.regexp_extract("p", r"/([^/]+)/[^/]+/[^/]+$", 1).alias("site"), F.regexp_extract("p", r"/([^/]+)/[^/]+$", 1).alias("run_id"), F.try_parse_json("value").alias("v")
    )


def artifact_traces(docs: DataFrame) -> DataFrame:
    """Trace rows of ``network_traces.json`` documents."""
    spark = docs.sparkSession
    d = docs.filter("v is not null").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    text = lambda n: F.try_variant_get("value", f"$.{n}", "string")
    return d.select(
        "site", "run_id", F.col("pos").alias("trace_idx"), F.coalesce(text("url"), F.lit("")).alias("url"), F.upper(F.coalesce(text("method"), F.lit("GET"))).alias("method"),
        F.coalesce(text("resource_type"), F.lit("")).alias("resource_type"), F.coalesce(F.try_variant_get("value", "$.status", "int"), F.lit(0)).alias("status"),
        F.coalesce(text("request_content_type"), F.lit("")).alias("request_content_type"), F.coalesce(text("response_content_type"), F.lit("")).alias("response_content_type"),
        F.coalesce(text("post_data"), text("post_data_preview"), F.lit("")).alias("post_data"), F.coalesce(text("response_body_preview"), F.lit("")).alias("response_body_preview"),
        F.from_json(F.to_json(F.try_variant_get("value", "$.request_headers", "variant")), "map<string,string>").alias("request_headers"),
        F.from_json(F.to_json(F.try_variant_get("value", "$.response_headers", "variant")), "map<string,string>").alias("response_headers"),
    )


# Snapshot fields by kind, each with its default.
SNAPSHOT_TEXT = ["site_name", "product_url"]
SNAPSHOT_LISTS = [
    "network_traces", "option_groups", "option_catalog", "option_dependencies", "observed_requests", "token_indicators", "price_summary_lines",
    "dom_price_candidates", "dom_price_candidates_before", "dom_price_candidates_after", "selected_configuration_rows",
]
SNAPSHOT_MAPS = ["cookies", "headers", "quantity_signal", "dependency_probe", "selected_configuration", "request_templates", "option_application", "option_prevalidation", "recon_cache"]
SNAPSHOT_FLAGS = ["requires_session", "anti_bot_suspected"]


def normalize_snapshots(docs: DataFrame) -> DataFrame:
    """Snapshot documents with defaults for missing fields; unknown fields stay in ``extra``."""
    v = F.col("v")
    json_of = lambda n: F.to_json(F.try_variant_get(v, f"$.{n}", "variant"))
    known = SNAPSHOT_TEXT + SNAPSHOT_LISTS + SNAPSHOT_MAPS + SNAPSHOT_FLAGS
    every = F.from_json(F.to_json(v), "map<string,string>")
    return docs.select(
        *[c for c in docs.columns if c != "v"],
        *[F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")).alias(n) for n in SNAPSHOT_TEXT],
        *[F.coalesce(json_of(n), F.lit("[]")).alias(n) for n in SNAPSHOT_LISTS], *[F.coalesce(json_of(n), F.lit("{}")).alias(n) for n in SNAPSHOT_MAPS],
        *[F.coalesce(F.try_variant_get(v, f"$.{n}", "boolean"), F.lit(False)).alias(n) for n in SNAPSHOT_FLAGS],
        F.map_filter(every, lambda k, _x: ~k.isin(known)).alias("extra"),
    )
