"""Stage gates, breaker, quarantine and pacing over recorded attempts (batch forms of the live monitors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.operators.skew import Running, rolling, running, with_ordinal


def is_blocked(status: Column) -> Column:
    return F.coalesce(status.isin(vocab.BLOCK_STATUS), F.lit(False))


def is_server_error(status: Column, reason: Column | None = None) -> Column:
    hit = F.coalesce(status.between(500, 599), F.lit(False))
    return hit if reason is None else hit | F.coalesce(F.contains(reason, F.lit("request_error")), F.lit(False))


def unit_events(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Per unit: blocked / server error if any of its attempts was."""
    return attempts.groupBy(*keys).agg(
        F.max(is_blocked(F.col("status")).cast("int")).alias("blocked"),
        F.max(is_server_error(F.col("status"), F.col("reason")).cast("int")).alias("server_error"),
    )


def gate_metrics(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Gate metrics and verdict per stage.

    ``rows``: stage, status, success, blocked, server_error. ``policies``: name and the four limits.
    """
    ran = F.lower(F.trim("status")).isin("completed", "failed")
    agg = rows.groupBy("stage").agg(
        F.count_if(ran).alias("total"),
        F.count_if(F.lower(F.trim("status")) == "skipped").alias("skipped"),
        F.count_if(ran & F.col("success")).alias("successes"),
        F.count_if(ran & F.col("blocked")).alias("blocked"),
        F.count_if(ran & F.col("server_error")).alias("server_errors"),
    )
    # one row per stage on both sides: Spark broadcasts the smaller one on its own statistics
    d = policies.withColumnRenamed("name", "stage").join(agg, "stage", "left").fillna(
        0, ["total", "skipped", "successes", "blocked", "server_errors"]
    )
    rate = {
        n: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(F.lit(0.0))
        for n, c in (("success_rate", "successes"), ("block_rate", "blocked"), ("server_error_rate", "server_errors"))
    }
    for name, expr in rate.items():
        d = d.withColumn(f"_{name}", expr)
    reason = (
        F.when(F.col("total") <= 0, F.lit("stage_no_executed_units"))
        .when(
            F.col("total") < F.col("min_units"),
            F.format_string("stage_gate_min_units total=%d required=%d", "total", "min_units"),
        )
        .when(
            F.col("_success_rate") < F.col("min_success_rate"),
            F.format_string("stage_gate_success_rate rate=%.3f required=%.3f", "_success_rate", "min_success_rate"),
        )
        .when(
            F.col("_block_rate") > F.col("max_block_rate"),
            F.format_string("stage_gate_block_rate rate=%.3f limit=%.3f", "_block_rate", "max_block_rate"),
        )
        .when(
            F.col("_server_error_rate") > F.col("max_server_error_rate"),
            F.format_string(
                "stage_gate_server_error_rate rate=%.3f limit=%.3f", "_server_error_rate", "max_server_error_rate"
            ),
        )
    )
    d = d.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())
    return d.select(
        "stage", "total", "skipped", "successes", "blocked", "server_errors",
        *[F.round(f"_{n}", 4).alias(n) for n in rate],
        "passed", "reason", *[c for c in ("stage_order",) if c in policies.columns],
    )


def stage_report(metrics: DataFrame) -> DataFrame:
    """Promotion order: a stage counts only while all earlier ones passed.

    One row per stage, so the ordered window is tiny. A stage with only skipped units is already processed and
    does not stop the rollout.
    """
    w = W.partitionBy(F.lit(0)).orderBy("stage_order").rowsBetween(W.unboundedPreceding, -1)
    replayed = (F.col("total") == 0) & (F.col("skipped") > 0)
    empty = (F.col("total") == 0) & (F.col("skipped") == 0)
    ok = F.col("passed") | replayed | empty
    d = metrics.withColumn("_ok", ok).withColumn("_open", F.coalesce(F.min("_ok").over(w), F.lit(True)))
    status = (
        F.when(~F.col("_open"), "not_reached")
        .when(replayed | empty, "skipped")
        .when(F.col("passed"), "completed")
        .otherwise("failed")
    )
    why = (
        F.when(~F.col("_open"), F.lit("earlier_stage_failed"))
        .when(replayed, F.lit("already_processed"))
        .when(empty, F.lit("no_eligible_units"))
        .when(~F.col("passed"), F.col("reason"))
    )
    return d.select("stage_order", "stage", status.alias("stage_status"), why.alias("stage_reason"), "total", "skipped")


def http_runtime(policies: DataFrame, base: dict[str, int]) -> DataFrame:
    """Stage-safe transport settings: floors for delays, ceiling for retries."""
    def floor(col: str, key: str) -> Column:
        return F.greatest(F.lit(max(int(base.get(key, 0)), 0)), F.col(col)).cast("int")

    min_delay = F.ceil(1000.0 / F.greatest("max_rps", F.lit(0.1)))
    return policies.select(
        "name",
        F.greatest(F.lit(max(int(base.get("min_delay_ms", 0)), 0)), min_delay).cast("int").alias("min_delay_ms"),
        floor("jitter_ms", "jitter_ms").alias("jitter_ms"),
        F.least(F.lit(max(int(base.get("max_retries", 0)), 0)), F.col("http_max_retries")).cast("int").alias("max_retries"),
        floor("http_backoff_base_ms", "backoff_base_ms").alias("backoff_base_ms"),
        floor("http_backoff_max_ms", "backoff_max_ms").alias("backoff_max_ms"),
        F.greatest(F.lit(1), F.least("workers", "max_inflight")).cast("int").alias("pool_size"),
    )


def retry_schedule(attempts: DataFrame, base_ms: int, cap_ms: int, retry_no: Column) -> DataFrame:
    """Retryable flag and backoff before the next try."""
    delay = F.lit(float(base_ms)) * F.pow(F.lit(2.0), F.greatest(retry_no, F.lit(0)))
    delay = F.least(delay, F.lit(float(cap_ms))) if cap_ms > 0 else delay
    return attempts.withColumn("retryable", F.col("status").isin(vocab.RETRYABLE_STATUS)).withColumn(
        "backoff_ms", F.when(F.col("retryable"), delay if base_ms > 0 else F.lit(0.0))
    )


def breaker_trips(
    attempts: DataFrame, key: str, order: list[str], bucket: Column, window: int = 40, min_events: int = 10,
    block_rate: float = 0.20, server_rate: float = 0.30, block: int | None = None,
) -> DataFrame:
    """First trip per key over the last ``window`` events; block rate is checked before server errors."""
    d = with_ordinal(attempts, [key], order, bucket, "_ord")
    d = d.withColumn("_b", is_blocked(F.col("status")).cast("int")).withColumn(
        "_s", is_server_error(F.col("status"), F.col("reason")).cast("int")
    )
    d = rolling(d, [key], "_ord", window, {"_n": F.count(F.lit(1)), "_nb": F.sum("_b"), "_ns": F.sum("_s")}, block)
    br, sr = F.col("_nb") / F.col("_n"), F.col("_ns") / F.col("_n")
    enough = F.col("_n") >= max(1, min_events)
    kind = F.when(enough & (br >= block_rate), "block_rate").when(enough & (sr >= server_rate), "server_error_rate")
    rate = F.when(F.col("_kind") == "block_rate", br).otherwise(sr)
    limit = F.when(F.col("_kind") == "block_rate", F.lit(block_rate)).otherwise(F.lit(server_rate))
    text = F.format_string("circuit_open_%s rate=%.3f threshold=%.3f window=%d", "_kind", rate, limit, "_n")
    d = d.withColumn("_kind", kind)
    trip = F.when(F.col("_kind").isNotNull(), F.col("_ord"))
    return d.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.min(trip).alias("trip_event_no"),
        F.min_by(F.when(F.col("_kind").isNotNull(), text), trip).alias("open_reason"),
    )


def quarantine_audit(
    attempts: DataFrame, key: str, order: list[str], bucket: Column, failed: Column, threshold: int = 3
) -> DataFrame:
    """Failure streaks per resource: position in the streak and the attempts at which quarantine starts.

    The counter goes back to zero when quarantine starts, so a streak trips at every multiple of the threshold.
    """
    d = attempts.withColumn("_fail", failed.cast("int"))
    d = with_ordinal(d, [key], order, bucket, "_ord")
    last_ok = F.when(F.col("_fail") == 0, F.col("_ord"))
    d = running(d, [key], order, bucket, [Running("_ok", "max", last_ok)])
    streak = F.when(F.col("_fail") == 1, F.col("_ord") - F.coalesce("_ok", F.lit(0))).otherwise(F.lit(0))
    d = d.withColumn("failure_streak", streak.cast("bigint"))
    trip = (F.col("failure_streak") > 0) & (F.col("failure_streak") % max(threshold, 1) == 0)
    return d.withColumn("quarantine_starts", trip).drop("_fail", "_ord", "_ok")


def pacing_gaps(attempts: DataFrame, key: str, ts_us: str, order: list[str], bucket: Column, min_delay_us: int) -> DataFrame:
    """Gap to the previous request of the same host, and how long the client should have waited more."""
    prev = Running("prev_us", "max", F.col(ts_us), include_current=False)
    d = running(attempts, [key], order, bucket, [prev])
    gap = F.greatest(F.col(ts_us) - F.col("prev_us"), F.lit(0))
    return d.withColumn("gap_us", gap).withColumn(
        "wait_us", F.when(F.col("prev_us").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(min_delay_us) - F.col("gap_us"), F.lit(0)))
    )


def rate_compliance(attempts: DataFrame, key: str, ts_us: str, max_rps: float, window_seconds: int = 1) -> DataFrame:
    """Tumbling request counts against the allowed rate."""
    slot = F.floor(F.col(ts_us) / (window_seconds * 1_000_000)).cast("bigint")
    counts = attempts.groupBy(key, slot.alias("slot")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.withColumn("over_limit", F.col("requests") > F.lit(max_rps * window_seconds))


def progress(results: DataFrame, total_units: int | Column, ts_us: str) -> DataFrame:
    """Throughput and remaining time from recorded results."""
    agg = results.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("unit_status") == "completed").alias("completed"),
        F.count_if(F.col("unit_status") == "failed").alias("failed"),
        F.count_if(F.col("unit_status") == "skipped").alias("skipped"),
        ((F.max(ts_us) - F.min(ts_us)) / 1e6).alias("_elapsed"),
    )
    total = F.lit(total_units) if isinstance(total_units, int) else total_units
    speed = F.when(F.col("_elapsed") > 0, F.col("processed") / F.col("_elapsed")).otherwise(F.lit(0.0))
    left = F.greatest(total - F.col("processed"), F.lit(0))
    return agg.select(
        "processed", "completed", "failed", "skipped",
        F.round("_elapsed", 3).alias("elapsed_seconds"),
        F.round(speed, 4).alias("throughput_units_per_second"),
        F.when(speed > 0, F.round(left / speed, 1)).alias("eta_seconds"),
    )


def status_counts(state: DataFrame, status: str = "state") -> DataFrame:
    known = ("completed", "failed", "skipped")
    per = [F.count_if(F.col(status) == s).alias(s) for s in known]
    return state.agg(*per).withColumn("total", F.col("completed") + F.col("failed") + F.col("skipped"))


def worker_progress(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count_if(F.col("unit_status") == "completed").alias("ok"),
        F.count_if(F.col("unit_status") == "failed").alias("fail"),
    )


def attempt_summary(attempts: DataFrame, key: str, order: str, shown: int = 8) -> DataFrame:
    """Attempt log per unit: count, the first attempts, the winning endpoint, the last reason.

    The shown attempts are cut to ``shown`` rows per unit before they are collected.
    """
    w = W.partitionBy(key).orderBy(order)
    head = attempts.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= shown)
    listed = head.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "status"))), lambda s: s["status"].cast("string")), ",").alias("first_statuses")
    )
    ok = F.col("status").between(200, 299)
    agg = attempts.groupBy(key).agg(
        F.count(F.lit(1)).alias("attempt_count"),
        F.min(F.when(ok, F.col(order))).alias("selected_attempt"),
        F.max_by("reason", order).alias("last_reason"),
        F.when(F.max(ok.cast("int")) == 1, "replayed").otherwise("exhausted").alias("decision"),
    )
    return agg.join(listed, key, "left")
