"""Capture policies applied to stored traces: which bodies are kept, how long, which headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headers worth keeping.
REQUEST_HEADERS = [
    "content-type", "accept", "portal", "portalcode", "portal-code", "x-csrf-token", "authorization", "x-requested-with",
]
RESPONSE_HEADERS = ["content-type", "set-cookie", "cache-control", "etag"]


def preview_policy(traces: DataFrame, body: str, cap: int = 16_000) -> DataFrame:
    """Whether the body of a trace is captured, its length, and whether a capture of ``cap`` characters cuts it.

    The flags describe the capture; analysis reads the stored text whole.
    """
    kept = (
        F.lower("resource_type").isin("xhr", "fetch") | F.contains(F.lower(F.coalesce("response_content_type", F.lit(""))), F.lit("json"))
        | F.contains(F.lower("url"), F.lit("/api"))
    )
    size = F.length(F.coalesce(F.col(body), F.lit("")))
    return traces.withColumn("captured", kept).withColumn("body_len", size).withColumn("truncated", F.when(kept, size > cap))


def allowed_headers(headers: Column, names: list[str]) -> Column:
    return F.map_filter(headers, lambda k, _v: F.lower(k).isin(names))


def session_flags(traces: DataFrame, keys: list[str]) -> DataFrame:
    """Session, token and bot-protection signs per run."""
    req = F.transform_keys("request_headers", lambda k, _v: F.lower(k))
    res = F.transform_keys("response_headers", lambda k, _v: F.lower(k))
    text = F.lower(F.concat_ws(" ", "url", "post_data", "response_body_preview"))
    shield = F.map_contains_key(res, "cf-ray") | F.map_contains_key(res, "x-akamai-transformed") | F.map_contains_key(res, "x-sucuri-id")
    return traces.groupBy(*keys).agg(
        F.max(F.map_contains_key(res, "set-cookie") | F.map_contains_key(req, "cookie")).alias("requires_session"),
        F.max(F.contains(text, F.lit("csrf"))).alias("has_csrf"),
        F.max(F.coalesce(F.contains(F.lower(F.element_at(req, "authorization")), F.lit("bearer")), F.lit(False))).alias("has_bearer"),
        F.max(shield | F.col("status").isin(403, 429) | F.contains(text, F.lit("captcha"))).alias("anti_bot_suspected"),
    )


def configurator_requests(requests: DataFrame, keys: list[str], url: str, words: list[str] | None = None) -> DataFrame:
    """Number of observed API requests that look like a configurator's."""
    words = words or ["itemmaster", "shopping-cart", "calculation", "product"]
    u = F.lower(F.col(url))
    api = F.contains(u, F.lit("/api/")) | F.contains(u, F.lit("://api."))
    return requests.groupBy(*keys).agg(F.count_if(api & u.rlike("|".join(words))).alias("configurator_requests"))


def new_requests(observed: DataFrame, keys: list[str], url: str, order: str, baseline: Column, limit: int = 80) -> DataFrame:
    """Distinct URLs seen after the baseline position, in order of first sight."""
    from quotelens.operators.skew import top_k

    first = observed.filter(F.col(order) > baseline).groupBy(*keys, url).agg(F.min(order).alias("first_seen"))
    return top_k(first, keys, [F.asc("first_seen")], limit, "place")
