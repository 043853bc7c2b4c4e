"""Endpoint ranking: roles, scores, request families, relations between endpoints (traces -> endpoint rankings)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.jsonwalk import key_set
from quotelens.functions.text import MARK, contains_any, count_words, has_word, hits_in, joined_words, words_found
from quotelens.functions.urls import prefix_key, url_tokens
from quotelens.operators.skew import best_row, top_k, with_ordinal
from quotelens.session import written


def _points(condition: Column, points: int) -> Column:
    return F.when(condition, F.lit(points)).otherwise(F.lit(0))


def with_evidence(traces: DataFrame) -> DataFrame:
    """Lower-case texts, JSON key sets and URL tokens that all rules share; computed once per trace."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return (
        traces.filter(F.coalesce("url", F.lit("")) != "")
        .withColumn("_u", F.lower(text("url")))
        .withColumn("_prev", F.lower(text("response_body_preview")))
        .withColumn("_rtype", F.lower(text("response_content_type")))
        .withColumn("_method", F.upper(F.coalesce("method", F.lit("GET"))))
        .withColumn("_res", F.lower(text("resource_type")))
        .withColumn("_status", F.coalesce("status", F.lit(0)))
        .withColumn("_pk", key_set(text("post_data")))
        .withColumn("_rk", key_set(text("response_body_preview")))
        .withColumn("_ut", url_tokens(F.col("url")))
        .withColumn("_pw", joined_words(F.col("_pk")))
        .withColumn("_rw", joined_words(F.col("_rk")))
        .withColumn("_uw", joined_words(F.col("_ut")))
        .withColumn("_words", joined_words(F.array_distinct(F.concat("_ut", "_pk", "_rk"))))
        .withColumn("_bare_price", F.contains(F.col("_u"), F.lit("premium-filecheck-price")) & F.col("_prev").rlike(vocab.BARE_PRICE_BODY))
    )


def role_scores(rules: list[tuple[str, int, str, list[str]]] | None = None) -> dict[str, Column]:
    """Sum of the matching rules per role, over a frame from ``with_evidence``."""
    has_payload = F.col("_pw") != MARK + MARK
    where = {
        "url": lambda t: contains_any(F.col("_u"), t),
        "payload": lambda t: has_word(F.col("_pw"), t),
        "response": lambda t: has_payload & has_word(F.col("_rw"), t),
        "preview": lambda t: has_payload & contains_any(F.col("_prev"), t),
    }
    terms: dict[str, list[Column]] = {r: [] for r in vocab.ROLES}
    for role, points, place, tokens in rules or vocab.ROLE_RULES:
        terms[role].append(_points(where[place](tokens), points))
    for role in ("pricing", "schema"):
        terms[role].append(_points(F.col("_method") == "POST", 1))
    terms["pricing"].append(_points(has_payload & F.col("_bare_price"), -5))
    terms["noise"].append(_points(has_payload & F.col("_bare_price"), 3))
    json_reply = F.contains(F.col("_rtype"), F.lit("json"))
    failed = (F.col("_status") != 0) & ~F.col("_status").between(200, 299)
    for role in vocab.ROLES:
        if role != "noise":
            terms[role] += [_points(json_reply, 1), _points(failed, -1)]
    return {role: reduce(add, cols) for role, cols in terms.items()}


def classify_role(d: DataFrame) -> DataFrame:
    """Adds ``role`` and ``role_confidence``; the first role in the fixed order wins a tie."""
    scores = role_scores()
    ranked = F.array_max(
        F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, (r, s) in enumerate(scores.items())])
    )
    d = d.withColumn("_top", ranked)
    known = F.col("_top.s") > 0
    return d.withColumn("role", F.when(known, F.col("_top.r")).otherwise("unknown")).withColumn(
        "role_confidence", F.when(known, F.least(F.lit(1.0), F.col("_top.s") / 8.0)).otherwise(F.lit(0.2))
    ).drop("_top")


def endpoint_score() -> Column:
    """Replay value of a trace, from its role and transport evidence."""
    weight = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1]), list(vocab.ROLE_WEIGHT.items())[1:],
                    F.when(F.col("role") == "pricing", vocab.ROLE_WEIGHT["pricing"])).otherwise(0)
    u, prev, st = F.col("_u"), F.col("_prev"), F.col("_status")
    terms = [
        weight,
        F.floor(F.col("role_confidence") * 8).cast("int"),
        _points(F.col("_method") == "POST", 4),
        _points(F.col("_res").isin("xhr", "fetch"), 4),
        _points(F.contains(F.col("_rtype"), F.lit("json")), 3),
        F.when(st.between(200, 299), 2).when(st >= 400, -3).otherwise(0),
        _points(contains_any(u, ["pricing", "price", "quote", "calculate", "config", "product-configuration"]), 6),
        _points(contains_any(u, ["productdetails", "price-matrix", "pricescale", "/repo"]), 10),
        _points(contains_any(u, ["premium-filecheck-price"]), -22),
        _points(contains_any(u, ["file-check/select-boxes"]), -10),
        _points(contains_any(u, vocab.SCORE_PENALTY_URL), -10),
        _points(contains_any(u, ["api.", "/api/"]), 3),
        _points(contains_any(prev, ['"price"', '"total"', '"amount"', '"gross"']), 3),
        _points(contains_any(prev, ["final_prices", "total_gross", "total_gross_value"]), 14),
        _points(contains_any(prev, ["price_matrix", "pricescale", "quantity_heading"]), 12),
        _points(F.col("_bare_price"), -10),
    ]
    return reduce(add, terms)


def classify_family(d: DataFrame) -> DataFrame:
    """Adds ``request_family`` from URL tokens, JSON keys and body markers."""
    hits = {f: count_words(F.col("_words"), t) * 2 for f, t in vocab.FAMILY_TOKENS.items()}
    hits["pricing_pipeline"] += _points(contains_any(F.col("_prev"), ["final_prices", "total_gross", "total_net"]), 3)
    hits["quantity_pipeline"] += _points(contains_any(F.col("_prev"), ["price_matrix", "pricescale", "quantity"]), 2)
    best = F.array_max(
        F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(f).alias("f")) for i, (f, s) in enumerate(hits.items())])
    )
    d = d.withColumn("_best", best).withColumn("infra_hits", F.sort_array(words_found(F.col("_uw"), vocab.INFRASTRUCTURE)))
    family = (
        F.when((F.size("infra_hits") > 0) & (F.col("_best.s") < 4), "infrastructure")
        .when(F.col("_best.s") <= 0, "unknown")
        .otherwise(F.col("_best.f"))
    )
    return d.withColumn("request_family", family).withColumn("family_score", F.col("_best.s")).drop("_best")


def explanation_columns(d: DataFrame) -> DataFrame:
    """Penalties, payload signals and the signature used to relate endpoints."""
    has = lambda joined, words: has_word(F.col(joined), words)
    prev = F.col("_prev")
    d = (
        d.withColumn("noise_hits", F.slice(hits_in(F.col("_u"), vocab.URL_NOISE), 1, 8))
        .withColumn("has_post_data", F.coalesce("post_data", F.lit("")) != "")
        .withColumn("payload_key_count", F.size("_pk"))
        .withColumn("response_key_count", F.size("_rk"))
        .withColumn("payload_has_price", has("_pw", vocab.PAYLOAD_PRICE_KEYS))
        .withColumn("response_has_price", has("_rw", vocab.PAYLOAD_PRICE_KEYS) | contains_any(prev, vocab.PAYLOAD_PRICE_KEYS))
        .withColumn("payload_has_quantity", has("_pw", vocab.PAYLOAD_QUANTITY_KEYS))
        .withColumn("response_has_quantity", has("_rw", vocab.PAYLOAD_QUANTITY_KEYS) | contains_any(prev, vocab.PAYLOAD_QUANTITY_KEYS))
        .withColumn("response_is_json", F.contains(F.col("_rtype"), F.lit("json")))
        .withColumn("url_prefix", prefix_key(F.col("url")))
    )
    found = []
    for group, words in vocab.SEMANTIC.items():
        exact = words_found(F.col("_words"), words)
        hit = F.when(F.size(exact) > 0, exact).otherwise(hits_in(prev, words))
        d = d.withColumn(f"_sem_{group}", hit)
        found.append(f"_sem_{group}")
    for group in vocab.SEMANTIC:
        d = d.withColumn(f"{group}_semantic", F.size(f"_sem_{group}") > 0)
    return d.withColumn("semantic_tokens", F.array_distinct(F.concat(*found))).drop(*found)


def score_traces(traces: DataFrame) -> DataFrame:
    """Role, score, family and explanation per trace: one pass, no shuffle."""
    d = classify_role(with_evidence(traces)).withColumn("score", endpoint_score())
    return explanation_columns(classify_family(d))


RANK_COLUMNS = [
    "method", "status", "resource_type", "role", "confidence", "score", "request_family", "family_score", "noise_hits",
    "payload_has_price", "response_has_price", "payload_has_quantity", "response_has_quantity", "response_is_json",
    "payload_key_count", "response_key_count",
]
SIGNATURE_SETS = ["semantic_tokens", "payload_keys", "response_keys"]
SIGNATURE_FLAGS = ["pricing_semantic", "quantity_semantic", "config_semantic", "validation_semantic"]


# what rankings and signatures read of a scored trace
EVIDENCE_COLUMNS = [
    "run_id", "url", "trace_idx", "_method", "role_confidence", "url_prefix", "infra_hits", "_pk", "_rk", "semantic_tokens",
    *SIGNATURE_FLAGS, *[c for c in RANK_COLUMNS if c not in ("method", "confidence")],
]


def scored_once(scored: DataFrame) -> DataFrame:
    """The evidence of the scored traces without their bodies, written once for queries that rank and relate them."""
    return written(scored.select(*EVIDENCE_COLUMNS))


def _rank_order() -> list[Column]:
    return [F.desc("score"), F.desc("confidence"), F.asc("trace_idx")]


def best_endpoints(scored: DataFrame) -> DataFrame:
    """Best trace per (run, url)."""
    rows = scored.withColumn("confidence", F.round("role_confidence", 3)).withColumn("method", F.col("_method"))
    return best_row(rows, ["run_id", "url"], [F.col("score"), -F.col("trace_idx")], [*RANK_COLUMNS, "trace_idx", "url_prefix"])


def ordered_endpoints(scored: DataFrame) -> DataFrame:
    """Endpoints per run whose ``rank`` is the key that orders them, smallest first. Selections compare it; nothing is sorted or numbered."""
    key = F.struct((-F.col("score")).cast("long").alias("s"), (-F.col("confidence")).cast("double").alias("c"), F.col("trace_idx").cast("long").alias("t"))
    return best_endpoints(scored).withColumn("rank", key)


def rank_endpoints(scored: DataFrame, limit: int | None = None) -> DataFrame:
    """Endpoints per run by score and confidence, numbered for reports: all of them, or the first ``limit``."""
    best = best_endpoints(scored)
    if limit:
        return top_k(best, ["run_id"], _rank_order(), limit, "rank")
    # the numbering reads it twice, its callers more often: without this every trace would be scored each time
    best = written(best)
    falling = best.withColumn("_s", -F.col("score")).withColumn("_c", -F.col("confidence"))
    return with_ordinal(falling, ["run_id"], ["_s", "_c", "trace_idx"], F.col("_s"), "rank").drop("_s", "_c")


def signatures(scored: DataFrame) -> DataFrame:
    """Signature per (run, url) merged over its traces: set union, flag OR, first known family.

    The sets are vocabulary hits and JSON keys; they are exploded and deduplicated before collection, so a url with
    very many traces costs no more than its distinct keys.
    """
    flags = scored.groupBy("run_id", "url").agg(
        *[F.max(f).alias(f) for f in SIGNATURE_FLAGS],
        F.max(F.size("infra_hits") > 0).alias("is_infra"),
        F.first("url_prefix").alias("url_prefix"),
        F.min_by(
            "request_family", F.struct((F.col("request_family") == "unknown").cast("int"), "trace_idx")
        ).alias("request_family"),
    )
    tagged = F.concat(
        F.transform("semantic_tokens", lambda t: F.struct(F.lit("semantic_tokens").alias("k"), t.alias("t"))),
        F.transform("_pk", lambda t: F.struct(F.lit("payload_keys").alias("k"), t.alias("t"))),
        F.transform("_rk", lambda t: F.struct(F.lit("response_keys").alias("k"), t.alias("t"))),
    )
    words = scored.select("run_id", "url", F.explode(tagged).alias("w")).select("run_id", "url", "w.k", "w.t").distinct()
    sets = words.groupBy("run_id", "url").agg(
        *[F.collect_set(F.when(F.col("k") == s, F.col("t"))).alias(s) for s in SIGNATURE_SETS]
    )
    none = F.array().cast("array<string>")
    out = flags.join(sets, ["run_id", "url"], "left")
    for s in SIGNATURE_SETS:
        out = out.withColumn(s, F.coalesce(s, none))
    return out


def relation_score(a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """Affinity of two signatures in [0, 1] and its reasons."""
    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def shared(name: str) -> Column:
        return F.size(F.array_intersect(col(a, name), col(b, name)))

    def both(name: str) -> Column:
        return col(a, name) & col(b, name)

    same_family = (col(a, "request_family") == col(b, "request_family")) & (col(a, "request_family") != "unknown")
    parts: list[tuple[Column, Column, Column]] = [
        ((col(a, "url_prefix") != "") & (col(a, "url_prefix") == col(b, "url_prefix")), F.lit(0.25), F.lit("shared_url_prefix")),
        (same_family, F.when(col(a, "request_family") == "infrastructure", 0.12).otherwise(0.18), F.lit("shared_request_family")),
    ]
    for name, label, cap, base in (
        ("semantic_tokens", "shared_semantic_tokens", 0.30, 0.08),
        ("payload_keys", "shared_payload_keys", 0.25, 0.05),
        ("response_keys", "shared_response_keys", 0.25, 0.05),
    ):
        n = shared(name)
        parts.append((n >= 2, F.least(F.lit(cap), F.lit(base) + n * 0.02), F.concat(F.lit(label + ":"), n.cast("string"))))
    for name, points in (("pricing", 0.10), ("quantity", 0.10), ("config", 0.08), ("validation", 0.06)):
        parts.append((both(f"{name}_semantic"), F.lit(points), F.lit(f"{name}_semantics")))
    total = reduce(add, [F.when(c, v).otherwise(F.lit(0.0)) for c, v, _ in parts])
    reasons = F.filter(F.array(*[F.when(c, r) for c, _, r in parts]), lambda r: r.isNotNull())
    return F.least(F.lit(1.0), total), reasons


def related_endpoints(ranked: DataFrame, signature: DataFrame, limit: int = 4, floor: float = 0.35) -> DataFrame:
    """Most related other endpoints per ranked endpoint.

    The report compares the ranked endpoints of one run with each other. Both sides carry the run as equi key and
    hold at most the ranking's row limit per run.
    """
    members = ranked.select("run_id", "url", "rank").join(signature, ["run_id", "url"])
    a, b = members.alias("a"), members.alias("b")
    pair = a.join(b, (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.url") != F.col("b.url")))
    score, reasons = relation_score()
    pair = pair.select(
        F.col("a.run_id").alias("run_id"), F.col("a.url").alias("url"), F.col("b.url").alias("related_url"),
        F.col("b.rank").alias("related_rank"), F.round(score, 6).alias("relation"), reasons.alias("reasons"),
    ).filter(F.col("relation") >= floor)
    return top_k(pair, ["run_id", "url"], [F.desc("relation"), F.asc("related_rank")], limit, "relation_no")


def family_summary(ranked: DataFrame, signature: DataFrame, tokens: int = 8) -> DataFrame:
    """Per run and family: members, leading semantic tokens, pricing / quantity / infrastructure shares."""
    m = ranked.select("run_id", "url", "rank", "request_family").join(signature.drop("request_family", "url_prefix"), ["run_id", "url"])
    keys = ["run_id", "request_family"]
    shares = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"),
        F.round(F.avg(F.col("pricing_semantic").cast("int")), 3).alias("pricing_relevance"),
        F.round(F.avg(F.col("quantity_semantic").cast("int")), 3).alias("quantity_relevance"),
        F.round(F.avg(F.col("is_infra").cast("int")), 3).alias("infrastructure_likelihood"),
    )
    counted = m.select(*keys, F.explode("semantic_tokens").alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))
    lead = top_k(counted, keys, [F.desc("n"), F.asc("token")], tokens, "token_no")
    listed = lead.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_no", "token"))), lambda t: t["token"]), ",").alias("dominant_signals")
    )
    return shares.join(listed, keys, "left")


def endpoint_candidates(scored: DataFrame, limit: int = 30) -> DataFrame:
    """Positive, non-noise endpoints per run."""
    usable = best_endpoints(scored).filter((F.col("score") > 0) & (F.col("role") != "noise"))
    return top_k(usable, ["run_id"], _rank_order(), limit, "candidate_no").select("run_id", "url", "candidate_no")


def discovery_rollup(scored: DataFrame) -> DataFrame:
    """Flags and signal sums per run, with partial aggregation only."""
    u = F.col("_u")
    has = lambda words: has_word(F.col("_pw"), words)
    payload = (
        F.col("has_post_data").cast("int") + has(vocab.PAYLOAD_PROPERTY_KEYS).cast("int")
        + has(vocab.PAYLOAD_PRODUCT_KEYS).cast("int") + has(["quantity", "qty", "auflage", "pricescale"]).cast("int")
    )
    response = (
        F.col("response_is_json").cast("int") + F.col("_status").between(200, 299).cast("int")
        + F.col("role").isin("pricing", "schema", "validation", "quantity_matrix").cast("int")
    )
    agg = scored.groupBy("run_id").agg(
        F.max(contains_any(u, vocab.API_LIKE)).alias("has_api_calls"),
        F.max(F.contains(u, F.lit("cookie"))).alias("_cookie"),
        F.max(F.col("_status").isin(vocab.BLOCK_STATUS)).alias("anti_bot_suspected"),
        F.max(F.contains(u, F.lit("csrf")) | F.contains(F.col("_prev"), F.lit("csrf"))).alias("has_token"),
        F.sum(payload).alias("payload_signal_score"),
        F.sum(response).alias("response_signal_score"),
        F.max(F.col("role") == "quantity_matrix").alias("_matrix"),
        F.max(has(["quantity", "qty", "auflage", "pricescale"])).alias("_qty"),
        F.max(F.col("role").isin("pricing", "quantity_matrix")).alias("has_pricing_role"),
        F.max(F.col("role") == "schema").alias("has_schema_role"),
        F.max(F.col("role") == "validation").alias("has_validation_role"),
        F.max((F.col("resource_type") == "document") & u.rlike("config|product|shop|/p/|druck|broschu|print")).alias("has_script_heavy_ui"),
    )
    hint = F.when(F.col("_matrix"), "tiered_matrix").when(F.col("_qty"), "explicit_quantity").otherwise("unknown")
    d = agg.withColumn("requires_session", F.col("has_api_calls") | F.col("_cookie")).withColumn("quantity_behavior_hint", hint)
    blockers = F.filter(
        F.array(
            F.when(F.col("requires_session"), "session_required"), F.when(F.col("has_token"), "token_management"),
            F.when(F.col("has_script_heavy_ui"), "stateful_configurator"), F.when(F.col("anti_bot_suspected"), "anti_bot_or_waf"),
        ), lambda b: b.isNotNull(),
    )
    return d.withColumn("blockers", F.array_join(blockers, ",")).drop("_matrix", "_qty", "_cookie")


def feasibility(rollup: DataFrame) -> DataFrame:
    """Ordered decision table: complexity and strategy per run."""
    c = F.col
    strong = (c("payload_signal_score") >= 3) & (c("response_signal_score") >= 3)
    opt = lambda name: c(name) if name in rollup.columns else F.lit(0)
    controls = (opt("has_manual_quantity_input").cast("int") + opt("has_preset_quantities").cast("int")) > 0
    rows: list[tuple[Column, str, Column]] = [
        (~c("has_api_calls") & ~c("has_script_heavy_ui"), "low", F.lit("static_html")),
        (c("has_api_calls") & c("has_pricing_role") & ~c("requires_session") & strong, "medium", F.lit("direct_http")),
        (c("requires_session") & c("has_api_calls") & c("has_pricing_role"), "high",
         F.when(c("has_schema_role") | c("has_validation_role"), "hybrid").otherwise("browser_automation")),
        (c("has_api_calls"), "high", F.when(c("requires_session"), "hybrid").otherwise("direct_http")),
        ((opt("option_group_count") > 3) & controls, "high", F.lit("browser_automation")),
        (opt("dependency_edge_count") > 0, "high", F.lit("browser_automation")),
        (opt("active_dependency_edge_count") > 0, "high", F.lit("browser_automation")),
        ((c("payload_signal_score") > 0) | (c("response_signal_score") > 0), "high", F.lit("browser_automation")),
        (c("has_script_heavy_ui"), "high", F.lit("browser_automation")),
    ]
    level = reduce(lambda acc, r: acc.when(r[0], r[1]), rows[1:], F.when(rows[0][0], rows[0][1])).otherwise("high")
    plan = reduce(lambda acc, r: acc.when(r[0], r[2]), rows[1:], F.when(rows[0][0], rows[0][2])).otherwise("browser_automation")
    step = reduce(lambda acc, r: acc.when(r[1][0], r[0] + 1), list(enumerate(rows))[1:], F.when(rows[0][0], 1)).otherwise(10)
    return rollup.withColumn("complexity", level).withColumn("strategy", plan).withColumn("decision_row", step).withColumn(
        "feasible", F.col("decision_row") < 10
    )


def plan_endpoints(feasible: DataFrame, ranked: DataFrame, remembered: DataFrame | None = None) -> DataFrame:
    """Endpoint per run: a remembered success of the site, else the best ranked, else none."""
    first = best_row(ranked.filter("score > 0"), ["run_id"], [F.col("rank")], ["url"], smallest=True).withColumnRenamed("url", "_ranked")
    d = feasible.join(first, "run_id", "left")
    if remembered is not None:
        d = d.join(remembered.select("run_id", F.col("endpoint").alias("_known")), "run_id", "left")
    else:
        d = d.withColumn("_known", F.lit(None).cast("string"))
    note = F.when(F.col("_known").isNotNull(), "remembered").when(F.col("_ranked").isNotNull(), "ranked").otherwise("none")
    conf = F.when(F.col("_known").isNotNull(), 0.85).when(F.col("_ranked").isNotNull(), 0.75).otherwise(0.65)
    return d.select("run_id", "strategy", F.coalesce("_known", "_ranked").alias("endpoint"), conf.alias("plan_confidence"), note.alias("plan_source"))


def remembered_endpoints(runs: DataFrame, last: int = 10) -> DataFrame:
    """Newest usable endpoint among the last successful ones of each site.

    ``runs``: site_name, run_no, endpoint, strategy, success.
    """
    from quotelens.functions.urls import is_unusable_endpoint

    recent = top_k(runs.filter("success"), ["site_name"], [F.desc("run_no")], last, "_rn")
    usable = recent.filter(~is_unusable_endpoint(F.col("endpoint")))
    return best_row(usable, ["site_name"], [F.col("run_no")], ["endpoint", "strategy", "run_no"])


def replay_candidates(ranked: DataFrame, planned: DataFrame, targets: DataFrame, traces: DataFrame) -> DataFrame:
    """Ordered replay list per run: plan, ranked (to 6), rescued families (to 6), product page, documents (to 8)."""
    rows = [
        planned.select("run_id", F.col("endpoint").alias("url"), F.lit(0).alias("tier"), F.lit(0).cast("bigint").alias("ord"), F.lit("plan_endpoint").alias("source")),
        ranked.filter("score > 0").select("run_id", "url", F.lit(1).alias("tier"), F.col("rank").cast("bigint").alias("ord"),
                                          F.concat(F.lit("ranked_endpoint_"), (F.col("rank") - 1).cast("string")).alias("source")),
        ranked.filter((F.col("score") <= 0) & F.col("request_family").isin(vocab.RESCUED_FAMILIES)).select(
            "run_id", "url", F.lit(2).alias("tier"), F.col("rank").cast("bigint").alias("ord"),
            F.concat(F.lit("family_rescued_"), F.col("request_family"), F.lit("_"), (F.col("rank") - 1).cast("string")).alias("source")),
        targets.select("run_id", "url", F.lit(3).alias("tier"), F.lit(0).cast("bigint").alias("ord"), F.lit("target_product_url").alias("source")),
        traces.filter((F.lower("resource_type") == "document") & F.col("status").between(200, 399)).select(
            "run_id", "url", F.lit(4).alias("tier"), F.col("trace_idx").cast("bigint").alias("ord"), F.lit("document_trace").alias("source")),
    ]
    pool = reduce(lambda a, b: a.unionByName(b), rows).filter(F.coalesce(F.trim("url"), F.lit("")) != "")

    def distinct_urls(d: DataFrame) -> DataFrame:
        return best_row(d, ["run_id", "url"], [F.col("tier"), F.col("ord")], ["tier", "ord", "source"], smallest=True)

    # plan, ranked and rescued endpoints fill up to six places; the product page and documents up to eight
    order = [F.asc("tier"), F.asc("ord")]
    early = top_k(distinct_urls(pool.filter("tier <= 2")), ["run_id"], order, 6, "_rn").drop("_rn")
    late = distinct_urls(pool.filter("tier >= 3")).join(early.select("run_id", "url"), ["run_id", "url"], "left_anti")
    return top_k(early.unionByName(late), ["run_id"], order, 8, "place").select("run_id", "place", "url", "source")
