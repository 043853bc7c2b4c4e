"""Learned rules, replay templates, snapshots and drift: append logs and their folded views.

Folds avoid ordered windows over hot keys: the last value of a key and the last row with another value come from two
aggregations, and the hit count is the number of rows after that point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.text import fingerprint, value_equals
from quotelens.functions.urls import cache_key
from quotelens.operators.skew import best_row, top_k


def fold_runs(log: DataFrame, keys: list[str], seq: str, value: str, flags: list[str] | None = None) -> DataFrame:
    """Current value per key and how often it was confirmed since it last changed; flags are OR-ed over all rows."""
    flags = flags or []
    per = log.groupBy(*keys, value).agg(F.max(seq).alias("_last"), *[F.max(f).alias(f) for f in flags])
    now = per.groupBy(*keys).agg(F.max_by(value, "_last").alias("_now"), F.max("_last").alias("last_seq"), *[F.max(f).alias(f) for f in flags])
    other = per.join(now.select(*keys, "_now"), keys).filter(F.col(value) != F.col("_now")).groupBy(*keys).agg(F.max("_last").alias("_changed"))
    bounds = now.join(other, keys, "left")
    hits = log.select(*keys, seq).join(bounds.select(*keys, "_changed"), keys).filter(F.col("_changed").isNull() | (F.col(seq) > F.col("_changed")))
    count = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hit_count"))
    return bounds.join(count, keys).select(*keys, F.col("_now").alias(value), "hit_count", "last_seq", *flags)


def normalization_mappings(requested: DataFrame, accepted: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Requested values the server replaced; trusted when the option was matched on the page.

    ``requested`` / ``accepted``: keys, key, value. ``matched``: keys, key.
    """
    acc = accepted.select(*keys, "key", F.col("value").alias("accepted_value"))
    hit = matched.select(*keys, F.lower(F.trim("key")).alias("_k")).distinct().withColumn("trusted", F.lit(True))
    d = requested.join(acc, [*keys, "key"]).filter(~value_equals(F.col("value"), F.col("accepted_value")))
    d = d.withColumn("_k", F.lower(F.trim("key"))).join(hit, [*keys, "_k"], "left")
    return d.select(
        *keys, F.col("key").alias("option_key"), F.lower(F.trim("value")).alias("requested_norm"), F.trim("accepted_value").alias("accepted_value"),
        F.coalesce("trusted", F.lit(False)).alias("trusted"),
    ).filter("requested_norm <> '' and accepted_value <> ''")


def promotions(folded: DataFrame, candidates: DataFrame, evidence: DataFrame, min_hits: int = 3) -> DataFrame:
    """Untrusted rules to trust: enough hits, the same accepted value again, and strong API price evidence.

    ``candidates``: run_id, site, option_key, requested_norm, accepted_value, trusted. ``evidence``: runs with it.
    """
    fresh = candidates.filter("not trusted").join(evidence.select("run_id").distinct(), "run_id", "left_semi")
    asked = fresh.select("site", "option_key", "requested_norm", F.trim("accepted_value").alias("accepted_value")).distinct()
    ready = folded.filter(~F.col("trusted") & (F.col("hit_count") >= min_hits))
    return asked.join(ready.select("site", "option_key", "requested_norm", "accepted_value", "hit_count"), ["site", "option_key", "requested_norm", "accepted_value"])


def strong_price_evidence(runs: DataFrame) -> Column:
    """Replayed API response that names both gross and net totals."""
    return (
        F.lower("replay").isin("http", "captured_trace") & F.contains(F.lower("endpoint"), F.lit("/api/"))
        & F.array_contains("named_keys", "total_gross_value") & F.array_contains("named_keys", "total_net_value")
    )


def templates_to_store(runs: DataFrame) -> DataFrame:
    """Runs whose request template is worth keeping: valid, successful, no guessed price."""
    ok = F.col("is_valid") & F.col("success") & (F.coalesce("fallback", F.lit("none")) != "heuristic")
    return runs.filter(ok & (F.coalesce(F.trim("template_kind"), F.lit("")) != "") & (F.coalesce(F.trim("endpoint"), F.lit("")) != ""))


def site_rows(folded: DataFrame, site: str, limit: int | None = None) -> DataFrame:
    """Per site by hit count, newest first on ties."""
    order = [F.desc("hit_count"), F.desc("last_seq")]
    if limit:
        return top_k(folded, [site], order, limit, "place")
    from pyspark.sql import Window

    return folded.withColumn("place", F.row_number().over(Window.partitionBy(site).orderBy(*order)))


# ---- snapshots and drift ------------------------------------------------------------------------------------------------------

def fresh_snapshots(log: DataFrame, url: str, captured_us: str, as_of_us: Column, ttl_days: int = 7) -> DataFrame:
    """Newest snapshot per page key that has not expired at ``as_of``."""
    ttl = max(int(ttl_days or 7), 1) * 86_400_000_000
    d = log.withColumn("cache_key", cache_key(F.col(url))).withColumn("expires_us", F.col(captured_us) + F.lit(ttl))
    rest = [c for c in d.columns if c != "cache_key"]
    latest = best_row(d, ["cache_key"], [F.col(captured_us), F.col(url)], rest)
    return latest.filter(F.col("expires_us") >= as_of_us)


def set_fingerprint(items: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Count and order-free fingerprint of the distinct items per key.

    Items are hashed and combined by sums of hash words, so nothing is sorted or collected in one task.
    """
    once = items.select(*keys, F.trim(F.col(item)).alias("_i")).filter("_i <> ''").distinct()
    h = F.sha1("_i")
    words = [F.conv(F.substring(h, 1 + 10 * i, 10), 16, 10).cast("decimal(20,0)") for i in range(4)]
    agg = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    return agg.select(*keys, "n", fingerprint(F.concat_ws(":", F.col("n").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)])).alias("fingerprint"))


def drift(previous: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Changed signature fields between two snapshots of a key; a key on one side only changes every field."""
    p = previous.select(*keys, F.struct(*fields).alias("_p"))
    c = current.select(*keys, F.struct(*fields).alias("_c"))
    d = p.join(c, keys, "full_outer")
    changed = F.filter(
        F.array(*[F.when(~F.col(f"_p.{f}").eqNullSafe(F.col(f"_c.{f}")), F.lit(f)) for f in sorted(fields)]), lambda x: x.isNotNull()
    )
    d = d.withColumn("_x", changed)
    return d.select(*keys, F.array_join("_x", ",").alias("changed_fields"), F.when(F.size("_x") > 0, "material_change").otherwise("no_material_change").alias("verdict"))


def default_verdict(hit: Column, refreshed: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), "cache_reused").when(F.coalesce(refreshed, F.lit(False)), "fresh_recon").otherwise("not_available")
