"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.text import contains_any, hits_in, url_unquote


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)


def site_name(url: Column) -> Column:
    """Host without port and leading www."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r":\d+$", ""), r"^www\.", "")


def path_tokens(url: Column) -> Column:
    """Lower path segments reduced to letters and digits; blank ones dropped."""
    raw = F.split(url_unquote(path(F.lower(F.trim(url)))), "/")
    return F.filter(F.transform(raw, lambda s: F.regexp_replace(s, r"[^a-z0-9]+", "")), lambda s: s != "")


def normalized_path(url: Column) -> Column:
    tokens = path_tokens(url)
    return F.when(F.size(tokens) > 0, F.concat(F.lit("/"), F.array_join(tokens, "/"))).otherwise(F.lit(""))


def normalized_endpoint(url: Column) -> Column:
    """scheme://host/path with the normalised path and without query."""
    host, sch = netloc(url), scheme(url)
    base = F.when(host != "", F.concat(sch, F.lit("://"), host)).otherwise(F.lit(""))
    return F.concat(base, normalized_path(url))


def url_tokens(url: Column) -> Column:
    """Distinct letter/digit runs plus the compound hints that occur in the URL."""
    low = F.lower(F.coalesce(url, F.lit("")))
    plain = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)
    return F.array_union(plain, hits_in(low, vocab.URL_COMPOUND_HINTS))


def prefix_key(url: Column, segments: int = 2) -> Column:
    """host/first path segments."""
    parts = F.slice(F.filter(F.split(path(url), "/"), lambda s: s != ""), 1, segments)
    return F.concat_ws("/", netloc(url), F.nullif(F.array_join(parts, "/"), F.lit("")))


def cache_key(url: Column) -> Column:
    """host without www + path without trailing slash."""
    host = F.regexp_replace(netloc(F.trim(url)), r"^www\.", "")
    trimmed = F.regexp_replace(path(F.trim(url)), r"/+$", "")
    return F.concat(host, F.when(trimmed == "", F.lit("/")).otherwise(trimmed))


def is_api_like(url: Column) -> Column:
    return contains_any(F.lower(url), vocab.API_LIKE)


def is_price_noise(url: Column) -> Column:
    return contains_any(F.lower(url), vocab.PRICE_NOISE_URL)


def is_unusable_endpoint(url: Column) -> Column:
    return contains_any(F.lower(url), vocab.UNUSABLE_ENDPOINT)


def redact_proxy(url: Column) -> Column:
    """Credentials off; what has no host becomes a marker."""
    value = F.trim(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(netloc(value), r"^[^@]*@", "")
    return F.when(value == "", F.lit(None)).when(host == "", F.lit("<configured>")).otherwise(
        F.concat(scheme(value), F.lit("://"), host)
    )


def form_pairs(body: Column) -> Column:
    """k=v&... as an ordered array of (key, value); '+' is a space, blanks are kept."""
    def pair(item: Column) -> Column:
        key = F.try_url_decode(F.substring_index(item, "=", 1))
        value = F.when(F.contains(item, F.lit("=")), F.try_url_decode(F.regexp_replace(item, r"^[^=]*=", ""))).otherwise("")
        return F.struct(F.coalesce(key, F.lit("")).alias("key"), F.coalesce(value, F.lit("")).alias("value"))

    return F.transform(F.filter(F.split(F.coalesce(body, F.lit("")), "&"), lambda i: i != ""), pair)


def form_keys(body: Column) -> Column:
    """Distinct form keys in their order."""
    return F.array_distinct(F.filter(F.transform(form_pairs(body), lambda p: p["key"]), lambda k: k != ""))


def encode_pairs(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )


def replace_pair(pairs: Column, key: Column, value: Column) -> Column:
    """Set every pair of that key; append one when the key is missing. Order and repeats stay."""
    changed = F.transform(
        pairs,
        lambda p: F.struct(p["key"].alias("key"), F.when(p["key"] == key, value).otherwise(p["value"]).alias("value")),
    )
    missing = ~F.exists(pairs, lambda p: p["key"] == key)
    extra = F.array(F.struct(key.alias("key"), value.alias("value")))
    return F.when(missing, F.concat(changed, extra)).otherwise(changed)
