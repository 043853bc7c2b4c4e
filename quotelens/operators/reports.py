"""Evidence reports per run: request-template hints, pricing evidence, rewrite gate, adapter records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelens.functions.jsonwalk import get, parse, walk
from quotelens.functions.text import contains_any
from quotelens.functions.urls import form_keys
from quotelens.operators.resolve import canonical_key
from quotelens.operators.skew import best_row, top_k

# Markers of secrets in text.
SENSITIVE = ["set-cookie", "cookie:", "authorization:", "bearer ", "x-csrf-token", "csrf_antiforge", "user_identifier_token"]
CORE_KEYS = ["quantity", "format", "material", "pages"]


def is_sensitive(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), SENSITIVE)


def endpoint_traces(ranked: DataFrame, traces: DataFrame, limit: int | None = None) -> DataFrame:
    """The endpoints of each run (for a report the first ``limit``) with their first captured trace of the same method."""
    t = traces.withColumn("method", F.upper(F.trim("method"))).filter("method <> '' and url <> ''")
    keep = ["trace_idx", "resource_type", "request_content_type", "response_content_type", "post_data", "response_body_preview", "request_headers"]
    first = best_row(t, ["run_id", "method", "url"], [F.col("trace_idx")], [c for c in keep if c in t.columns], smallest=True)
    shown = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return shown.select("run_id", "rank", "url", "method", "role", "score", "confidence").join(first, ["run_id", "method", "url"])


def body_kind(body: Column) -> Column:
    is_json = F.substring(F.trim(body), 1, 1).isin("{", "[") & F.try_parse_json(F.trim(body)).isNotNull()
    return F.when(is_json, "json").when(F.contains(body, F.lit("=")) & F.contains(body, F.lit("&")), "form").otherwise("raw")


def json_paths(df: DataFrame, body: str, keep: list[str]) -> DataFrame:
    """Every object path of a JSON body, containers and all items of arrays included."""
    leaves = walk(df.withColumn("_body_v", parse(F.col(body))), "_body_v", keep).filter("path <> ''")
    parts = F.split(F.regexp_replace("path", r"(?<=.)\[", ".["), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.replace(F.array_join(F.slice(parts, 1, n), "."), F.lit(".["), F.lit("[")))
    return leaves.select(*keep, "path", "ord", F.posexplode(prefixes).alias("_i", "_p")).groupBy(*keep, F.col("_p").alias("json_path")).agg(
        F.min(F.struct("ord", "_i")).alias("path_order")
    )


def template_mutations(endpoints: DataFrame) -> DataFrame:
    """All places of a captured body where a requested option could be written, numbered in their order.

    JSON: paths that name an option family and named property rows; forms: keys that do.
    """
    keys = ["run_id", "rank", "url"]
    d = endpoints.withColumn("body_kind", body_kind(F.coalesce("post_data", F.lit(""))))
    js = d.filter("body_kind = 'json'")
    by_path = json_paths(js, "post_data", keys).withColumn("option_key", canonical_key(F.col("json_path"))).filter("option_key is not null").select(
        *keys, "option_key", F.col("json_path").alias("path"), F.lit("path_token_match").alias("reason"), F.lit(0).alias("_tier"), F.col("path_order.ord").alias("_ord")
    )
    spark = endpoints.sparkSession
    props = js.withColumn("_v", get(parse(F.col("post_data")), "$.properties", "variant")).filter("_v is not null")
    rows = props.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).select(*keys, "pos", F.trim(F.try_variant_get("value", "$.name", "string")).alias("_n"))
    named = rows.withColumn("option_key", canonical_key(F.col("_n"))).filter("option_key is not null")
    named = best_row(named, [*keys, "option_key"], [F.col("pos")], ["_n", "pos"], smallest=True).select(
        *keys, "option_key", F.concat(F.lit("properties[name="), F.col("_n"), F.lit("].id")).alias("path"), F.lit("properties_name_id_pattern").alias("reason"),
        F.lit(1).alias("_tier"), F.array(F.col("pos")).alias("_ord"),
    )
    fk = d.filter("body_kind = 'form'").select(*keys, F.posexplode(form_keys(F.col("post_data"))).alias("_p", "path"))
    by_key = fk.withColumn("option_key", canonical_key(F.col("path"))).filter("option_key is not null").select(
        *keys, "option_key", "path", F.lit("form_key_match").alias("reason"), F.lit(0).alias("_tier"), F.array(F.col("_p")).alias("_ord")
    )
    pool = by_path.unionByName(named).unionByName(by_key)
    order = W.partitionBy(*keys).orderBy(F.asc("_tier"), F.asc("_ord"), F.asc("path"))
    return pool.withColumn("mutation_no", F.row_number().over(order)).drop("_tier", "_ord")


def rewrite_gate(runs: DataFrame, hints: DataFrame, mutations: DataFrame) -> DataFrame:
    """Whether the hints suffice to rewrite a request for the selected endpoint, and what is missing.

    ``runs``: run_id, selected_endpoint. ``hints``: run_id, rank, url. ``mutations``: run_id, rank, url, option_key.
    """
    per = mutations.groupBy("run_id", "rank", "url").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("option_key").isin(CORE_KEYS)).alias("_core"))
    h = hints.select("run_id", "rank", "url").join(per, ["run_id", "rank", "url"], "left")
    d = runs.select("run_id", "selected_endpoint").join(h, "run_id", "left")
    mine = F.col("url") == F.col("selected_endpoint")
    pick = F.min_by(F.struct("url", F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_core", F.lit(False)).alias("core")), F.struct((~F.coalesce(mine, F.lit(False))).cast("int"), "rank"))
    g = d.groupBy("run_id", "selected_endpoint").agg(F.count("url").alias("_hints"), F.max(F.coalesce(mine, F.lit(False))).alias("matched_selected_endpoint"), pick.alias("_h"))
    n, core = F.coalesce(F.col("_h.n"), F.lit(0)), F.coalesce(F.col("_h.core"), F.lit(False))
    wanted = F.coalesce("selected_endpoint", F.lit("")) != ""
    reasons = F.filter(
        F.array(
            F.when(F.col("_hints") == 0, "missing_trace_template_hints"), F.when(wanted & ~F.col("matched_selected_endpoint"), "selected_endpoint_trace_hint_missing"),
            F.when(n == 0, "missing_candidate_mutations"), F.when((n > 0) & ~core, "missing_core_option_mutations"),
        ), lambda r: r.isNotNull(),
    )
    return g.withColumn("reasons", F.array_join(reasons, ",")).withColumn("sufficient", F.col("reasons") == "").select(
        "run_id", "matched_selected_endpoint", F.col("_h.url").alias("hint_url"), "sufficient", "reasons"
    )


def response_signals(preview: Column) -> dict[str, Column]:
    text = F.coalesce(preview, F.lit(""))
    return {
        "has_preview": text != "", "contains_ws_ajax": F.contains(text, F.lit("WS-Ajax")), "contains_csrf": F.contains(text, F.lit("csrf_antiforge")),
        "pr_prices": F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"prPrice='([0-9]+(?:\.[0-9]+)?)'"), 1), 1, 5), ","),
    }


def pricing_evidence(traces: DataFrame, limit: int = 4) -> DataFrame:
    """JSON responses with price markers, best first."""
    d = traces.filter(F.contains(F.lower("response_content_type"), F.lit("json")))
    for name, expr in response_signals(F.col("response_body_preview")).items():
        d = d.withColumn(name, expr)
    d = d.filter("contains_ws_ajax or pr_prices <> ''")
    order = [F.desc(F.col("pr_prices") != ""), F.desc("contains_ws_ajax"), F.desc("status"), F.asc("trace_idx")]
    return top_k(d, ["run_id"], order, limit, "evidence_no").withColumn("post_keys", F.array_join(form_keys(F.col("post_data")), ","))


def recipe_endpoint(ranked: DataFrame, preferred: DataFrame) -> DataFrame:
    """Preferred endpoint where it is among the ranked ones, else the first."""
    p = preferred.select("run_id", F.col("url").alias("_want"), F.upper(F.coalesce("method", F.lit(""))).alias("_m"))
    d = ranked.join(p, "run_id", "left")
    hit = F.coalesce((F.col("url") == F.col("_want")) & ((F.col("_m") == "") | (F.col("method") == F.col("_m"))), F.lit(False))
    d = d.withColumn("source", F.when(hit, "preferred_endpoint").otherwise("top_endpoint_fallback"))
    return best_row(d, ["run_id"], [(~hit).cast("int"), F.col("rank")], ["url", "method", "source", "score", "confidence"], smallest=True)


def price_paths(cands: DataFrame, keys: list[str]) -> DataFrame:
    """JSON path of the best plain JSON candidate."""
    d = cands.filter(F.col("source").startswith("json:")).withColumn("price_path", F.substring("source", 6, 1_000_000))
    return best_row(d, keys, [F.col("score"), F.col("price_path")], ["price_path", "score"])


def inject_rules(mutations: DataFrame, value_maps: DataFrame, named_properties: DataFrame) -> DataFrame:
    """First usable path per run and option key, with the option's value map.

    ``named_properties``: run_id, name, property_pos resolves ``properties[name=...]``. ``value_maps``: run_id,
    option_key, value_map.
    """
    name = F.lower(F.nullif(F.regexp_extract("path", r"^properties\[name=([^\]]+)\]\.", 1), F.lit("")))
    d = mutations.withColumn("_n", name)
    known = named_properties.select("run_id", F.lower(F.trim("name")).alias("_n"), "property_pos").groupBy("run_id", "_n").agg(F.min("property_pos").alias("_pos"))
    d = d.join(known, ["run_id", "_n"], "left")
    direct = F.when(F.col("_n").isNull(), F.col("path"))
    indexed = F.when(F.col("_pos").isNotNull(), F.concat(F.lit("properties["), F.col("_pos").cast("string"), F.lit("]."), F.regexp_replace("path", r"^properties\[name=[^\]]+\]\.", "")))
    d = d.withColumn("_path", F.coalesce(direct, indexed)).filter("_path is not null")
    first = best_row(d, ["run_id", "option_key"], [F.col("rank"), F.col("mutation_no")], ["_path"], smallest=True)
    return first.join(value_maps, ["run_id", "option_key"], "left").select(
        "run_id", F.col("option_key").alias("input_key"), F.col("_path").alias("path"), F.lit("str").alias("cast_to"), F.lit(True).alias("require_mapped"), "value_map"
    )


def url_pattern(url: Column) -> Column:
    """Regex that accepts a product page with and without www and with any tail."""
    from quotelens.functions.urls import netloc, path

    esc = lambda c: F.regexp_replace(c, r"([.\\+*?\[^\]$(){}=!<>|:\-#&~])", r"\\$1")
    host = F.regexp_replace(netloc(url), r"^www\.", "")
    return F.concat(F.lit(r"https?://(www\.)?"), esc(host), esc(path(url)), F.lit(r"(?:[/?#].*)?$"))


def adapter_records(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """Adapter record per run: host, page pattern, endpoint, price path, rule count; records with secrets are rejected.

    ``runs``: run_id, product_url, endpoint_url, method, template, price_path.
    """
    from quotelens.functions.urls import site_name

    n = rules.groupBy("run_id").agg(F.count(F.lit(1)).alias("rule_count"))
    d = runs.join(n, "run_id", "left").fillna(0, ["rule_count"])
    secret = is_sensitive(F.concat_ws(" ", "template", "endpoint_url", "product_url"))
    issue = F.when(secret, "sensitive_text").when(F.coalesce("price_path", F.lit("")) == "", "missing_price_path").when(F.coalesce("endpoint_url", F.lit("")) == "", "missing_endpoint")
    return d.select("run_id", site_name(F.col("product_url")).alias("domain"), url_pattern(F.col("product_url")).alias("url_regex"), "endpoint_url", "method", "price_path", "rule_count", issue.alias("rejected_because"))


def onboarding_steps(runs: DataFrame) -> DataFrame:
    """Next steps per run from what its evidence lacks.

    ``runs``: run_id, requires_session, has_token, has_templates, catalog_groups, hint_count.
    """
    steps = F.filter(
        F.array(
            F.when(F.col("requires_session"), "confirm_session_headers"), F.when(F.col("has_token"), "forward_tokens"), F.lit("pick_pricing_endpoint"),
            F.when(~F.col("has_templates"), "capture_request_templates"), F.when(F.col("catalog_groups") <= 0, "extract_option_catalog"), F.lit("add_site_rules"),
            F.when(F.col("hint_count") > 0, "use_candidate_mutations"), F.lit("add_regression_fixture"),
        ), lambda s: s.isNotNull(),
    )
    return runs.withColumn("next_steps", F.array_join(steps, ","))


def first_text(*columns: str) -> Column:
    """First non-blank of several columns, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def build_targets(units: DataFrame, snapshots: DataFrame, settings: dict[str, str]) -> DataFrame:
    """Target rows: spec, else snapshot, else defaults; run settings are copied in."""
    from quotelens.functions.urls import cache_key

    s = snapshots.withColumn("_key", cache_key(F.col("url"))).select("_key", F.col("site_name").alias("_site"), F.col("snapshot_id"))
    d = units.withColumn("_key", cache_key(F.col("url"))).join(s, "_key", "left")
    d = d.withColumn("site_name", F.coalesce(first_text("site_name", "_site"), F.lit("unknown-site"))).withColumn(
        "expected_price_tolerance", F.coalesce("expected_price_tolerance", F.lit(0.01))
    ).withColumn("expected_currency", F.coalesce(first_text("expected_currency"), F.lit("EUR")))
    return d.withColumns({k: F.lit(v) for k, v in settings.items()}).drop("_key", "_site")
