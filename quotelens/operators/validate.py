"""Accepted against requested configuration: checks, reasons, summaries, next plan."""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.jsonwalk import leaves_of, parse
from quotelens.functions.text import option_matches
from quotelens.operators.prices import price_delta

NAME_KEYS = ["name", "property", "propertyname", "key", "label"]  # fixed values, in order of preference
VALUE_KEYS = ["value", "id", "selected", "selectedid", "selectedvalue"]  # fixed values, in order of preference


_OBJECT = re.compile(r"\.?[^.\[\]]+$")
FACTS = "array<struct<option_key:string,accepted_value:string,kind:string,_at:array<int>>>"


def facts_of(text: str, only: frozenset[str] | None = None) -> list[tuple[str, str | None, str, list[int]]]:
    """Name, value, kind and position of the facts of valid JSON text: pairs, property ids, then plain keys."""
    direct, objects = [], {}
    for leaf in leaves_of(text):
        path = leaf["path"]
        if not path or path.endswith("]"):
            continue
        key, value, at = leaf["leaf_key"], leaf["value"], leaf["ord"]
        low = key.lower()
        if only is None or low in only:
            direct.append((key, value, "key", at))
        # an object inside a list, or inside one of the configuration lists, is a row of facts
        at_object = _OBJECT.sub("", path)
        if at_object.endswith("]"):
            o = objects.setdefault(at_object, {"at": at})
            o["at"] = max(o["at"], at)
            for what, ranked in (("name", NAME_KEYS), ("value", VALUE_KEYS)):
                if low in ranked and ranked.index(low) <= o.get(what, (len(ranked),))[0]:
                    o[what] = (ranked.index(low), value)
            for word in ("propertyid", "value"):
                if low == word and value is not None:
                    o["=" + word] = max(o.get("=" + word, value), value)
    out = []
    for o in objects.values():
        name, value = o.get("name", (0, None))[1], o.get("value", (0, None))[1]
        if name is not None and value is not None:
            out.append((name, value, "pair", o["at"]))
        if "=propertyid" in o and "=value" in o:
            out.append(("propertyId:" + o["=propertyid"], o["=value"], "property", o["at"]))
    return [f for f in out if only is None or f[0].lower() in only] + direct


def accepted_options(responses: DataFrame, keys: list[str], body: str, only: list[str] | None = None) -> DataFrame:
    """Name / value facts of a JSON response: objects with a name and a value, property ids, and plain keys.

    Output: keys, option_key, accepted_value, kind (pair / property / key). The last occurrence wins. ``only``: the option
    keys that the caller asks for, in lower case. A body is scanned once, and its facts leave the scan as one array.
    """
    asked = None if only is None else frozenset(only)

    def scan(texts):
        ends, names, values, kinds, at_ends, at = [0], [], [], [], [0], []
        for t in texts.to_pylist():
            for name, value, kind, place in facts_of(t, asked) if t is not None else ():
                names.append(name)
                values.append(value)
                kinds.append(kind)
                at.extend(place)
                at_ends.append(len(at))
            ends.append(len(names))
        places = pa.ListArray.from_arrays(pa.array(at_ends, pa.int32()), pa.array(at, pa.int32()))
        each = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(kinds, pa.string()), places], ["option_key", "accepted_value", "kind", "_at"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    bodies = responses.withColumn("_body_v", parse(F.col(body))).filter(F.col("_body_v").isNotNull())
    # outer, see walk
    facts = bodies.select(*keys, F.arrow_udf(scan, FACTS)(F.to_json("_body_v")).alias("_facts")).select(*keys, F.inline_outer("_facts")).filter("option_key is not null")
    facts = facts.withColumn("option_key", F.when(F.col("kind") == "key", F.lower("option_key")).otherwise(F.col("option_key")))
    last = facts.groupBy(*keys, "option_key").agg(F.max_by(F.struct("accepted_value", "kind"), F.col("_at")).alias("b"))
    return last.select(*keys, "option_key", "b.accepted_value", "b.kind")


def compare_options(requested: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Requested options with the accepted value (requested where the response is silent) and the verdict.

    ``requested``: keys, key, value. Matching of keys ignores case.
    """
    acc = accepted.withColumn("_k", F.lower("option_key")).groupBy(*keys, "_k").agg(F.max("accepted_value").alias("_acc"))
    d = requested.withColumn("_k", F.lower("key")).join(acc, [*keys, "_k"], "left")
    d = d.withColumn("accepted_value", F.coalesce("_acc", "value")).withColumn("matches", option_matches(F.col("key"), F.col("value"), F.col("accepted_value")))
    note = F.format_string("config_normalized key=%s requested=%s accepted=%s", "key", "value", "accepted_value")
    return d.withColumn("mismatch", F.when(~F.col("matches"), note)).drop("_k", "_acc")


def validate_runs(units: DataFrame, compared: DataFrame, keys: list[str]) -> DataFrame:
    """Mismatches in check order and the first reason per unit; a price mismatch overrides the reason.

    ``units``: keys, success, price, expected_price, tolerance, request_only, replay_mode, fallback_mode,
    synthesis_issues (count), synthesis_keys, unmatched_required (count), unmatched_keys. Missing columns count as off.
    """
    def col(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in units.columns else F.lit(default)

    per = compared.filter("mismatch is not null").groupBy(*keys).agg(
        F.array_sort(F.collect_list("mismatch")).alias("_config"),
        F.max_by("mismatch", F.when(F.lower("key") == "quantity", F.lit(1))).alias("_qty"),
        F.max_by("value", F.when(F.lower("key") == "quantity", F.lit(1))).alias("_qr"),
        F.max_by("accepted_value", F.when(F.lower("key") == "quantity", F.lit(1))).alias("_qa"),
    )
    d = units.join(per, keys, "left")
    price, expected = F.col("price"), F.col("expected_price")
    tol = F.greatest(F.lit(0.0), F.coalesce(F.nullif(col("tolerance", 0.01), F.lit(0.0)), F.lit(0.01)))
    no_price = ~col("success", False) | price.isNull()
    only = col("request_only", False)
    mode, fallback = F.lower(col("replay_mode", "none")), F.lower(col("fallback_mode", "none"))
    wrong_mode = only & ~mode.isin("http", "adapter")
    used_fallback = only & ~fallback.isin("none", "")
    synth = only & (col("synthesis_issues", 0) > 0)
    absent = expected.isNotNull() & price.isNull()
    off = expected.isNotNull() & price.isNotNull() & (F.abs(expected - price) > tol)
    config = F.coalesce("_config", F.array().cast("array<string>"))
    unmatched = col("unmatched_required", 0) > 0
    checks = [
        F.when(no_price, F.lit("price_not_extracted")),
        F.when(wrong_mode, F.concat(F.lit("request_only_replay_mismatch expected=http_or_adapter actual="), mode)),
        F.when(used_fallback, F.concat(F.lit("request_only_fallback_used fallback="), fallback)),
        F.when(synth, F.format_string("request_only_option_synthesis_failed count=%d keys=%s", col("synthesis_issues", 0), col("synthesis_keys", "unknown"))),
        F.when(absent, F.concat(F.lit("price_mismatch expected="), expected.cast("string"), F.lit(" actual=None tolerance="), tol.cast("string"))),
        F.when(off, F.concat(F.lit("price_mismatch expected="), expected.cast("string"), F.lit(" actual="), price.cast("string"), F.lit(" tolerance="), tol.cast("string"))),
        F.when(F.col("_qty").isNotNull(), F.format_string("quantity_normalized requested=%s accepted=%s", "_qr", "_qa")),
    ]
    tail = F.when(unmatched, F.format_string("required_options_unmatched count=%d keys=%s", col("unmatched_required", 0), col("unmatched_keys", "unknown")))
    mism = F.concat(F.filter(F.array(*checks), lambda m: m.isNotNull()), config, F.filter(F.array(tail), lambda m: m.isNotNull()))
    reason = (
        F.when(off, "payload_or_normalization_mismatch")
        .when(no_price & wrong_mode, "request_only_http_replay_failed").when(no_price, "price_not_extracted")
        .when(wrong_mode | used_fallback, "request_only_violation").when(synth, "request_only_option_synthesis_failed")
        .when(F.size(config) > 0, "server_normalized_configuration").when(unmatched, "required_options_unmatched")
    )
    return d.withColumn("mismatches", mism).withColumn("failure_reason", reason).withColumn("is_valid", F.size("mismatches") == 0).drop("_config", "_qty", "_qr", "_qa")


def next_plan(validated: DataFrame) -> DataFrame:
    """Plan after a failed validation, from the reason."""
    r, s, c = F.col("failure_reason"), F.col("strategy"), F.col("plan_confidence")
    price, config = r == "payload_or_normalization_mismatch", r == "server_normalized_configuration"
    return validated.filter("not is_valid").withColumn(
        "next_strategy", F.when(price, "hybrid").when(config, s).otherwise("browser_automation")
    ).withColumn(
        "next_confidence", F.round(F.when(price, F.least(c + 0.1, F.lit(0.95))).when(config, F.least(c + 0.05, F.lit(0.95))).otherwise(0.4), 4)
    ).withColumn("next_note", F.when(price, "strict_validation").when(config, "dependent_options_added").otherwise("unknown_failure"))


def synthesis_issue_summary(issues: DataFrame, keys: list[str], shown: int = 10) -> DataFrame:
    """Number of issues and the first distinct option keys."""
    from quotelens.operators.skew import top_k

    n = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("issue_count"))
    names = issues.select(*keys, F.trim("issue_key").alias("k")).filter("k <> ''").distinct()
    head = top_k(names, keys, [F.asc("k")], shown, "_rn").groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("issue_keys"))
    return n.join(head, keys, "left").fillna("unknown", ["issue_keys"])


def summarize(validated: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """Run summary with the site's reference price and the delta to it."""
    d = validated.join(references, keys, "left")
    delta, near = price_delta(F.col("price"), F.col("reference_price"), F.coalesce("tolerance", F.lit(0.01)))
    return d.withColumn("site_price_delta", delta).withColumn("site_price_within_tolerance", near).withColumn(
        "reference_kind", F.coalesce("reference_kind", F.lit("none"))
    ).withColumn("final_status", F.when(F.col("is_valid"), "completed").otherwise("failed"))


def prevalidation_failures(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Failed summary rows for units with unmatched options, in place of a run."""
    note = F.format_string("required_options_unmatched key=%s requested=%s reason=%s", "key", "value", "match_status")
    bad = outcomes.filter("not valid").select(*keys, note.alias("_m")).distinct()
    per = bad.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("_m")), "; ").alias("mismatches"), F.count(F.lit(1)).alias("option_unmatched_count"))
    return per.select(
        *keys, F.lit("failed").alias("final_status"), F.lit(False).alias("validated"), F.lit("prevalidation_failed").alias("strategy"),
        F.lit("prevalidation_failed").alias("extraction_reason"), F.lit(0).alias("attempts"), "option_unmatched_count", "mismatches",
    )


def refresh_reason(summaries: DataFrame, attempts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Why a reused snapshot should be captured again; null when it stays.

    ``summaries``: keys, cache_hit, request_only, prevalidation_available, prevalidation_valid, replay_reason,
    extraction_reason, price_missing.
    """
    html = F.contains(F.lower("content_type"), F.lit("html")) & (F.col("reason") != "success")
    why = F.when(F.col("reason").isin("no_matching_trace", "request_error"), F.col("reason")).when(html, "html_response_without_price")
    first = attempts.withColumn("_w", why).groupBy(*keys).agg(F.min_by("_w", F.when(F.col("_w").isNotNull(), F.col(order))).alias("_attempt"))
    d = summaries.join(first, keys, "left")
    cand = F.coalesce(
        F.when(~F.col("request_only") & F.col("prevalidation_available") & ~F.col("prevalidation_valid"), "catalog_prevalidation_failed"),
        F.when(F.col("replay_reason").isin("missing_endpoint_candidates", "all_http_candidates_failed"), F.col("replay_reason")),
        F.col("_attempt"),
        F.when(F.col("extraction_reason").isin("price_not_extracted", "request_only_http_replay_failed", "prevalidation_failed"), F.col("extraction_reason")),
        F.when(F.col("price_missing"), "price_not_extracted"),
    )
    return d.withColumn("refresh_reason", F.when(F.col("cache_hit"), cand)).drop("_attempt")


def check_rollup(checks: DataFrame, keys: list[str], worst: list[str], verdicts: dict[str, str]) -> DataFrame:
    """Counts and worst status over check rows. ``worst`` lists the statuses from worst to best."""
    rank = reduce(lambda c, x: c.when(F.col("status") == x[1], x[0]), list(enumerate(worst))[1:], F.when(F.col("status") == worst[0], 0))
    d = checks.withColumn("_r", rank)
    agg = d.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in worst], F.min("_r").alias("_r"))
    lists = []
    for s in worst[:-1]:
        names = d.filter(F.col("status") == s).select(*keys, "check_name").distinct()
        lists.append(names.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("check_name")), ",").alias(f"{s}_checks")))
    for extra in lists:
        agg = agg.join(extra, keys, "left")
    state = F.element_at(F.array(*[F.lit(s) for s in worst]), F.col("_r") + 1)
    verdict = reduce(lambda c, kv: c.when(F.col("worst_status") == kv[0], kv[1]), list(verdicts.items())[1:], F.when(F.col("worst_status") == list(verdicts)[0], list(verdicts.values())[0]))
    return agg.withColumn("worst_status", state).withColumn("verdict", verdict).drop("_r")
