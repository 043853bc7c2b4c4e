"""Structured Streaming monitors: breaker, quarantine, pacing, rates, progress, state upserts, duplicate suppression.

Breaker, quarantine and pacing depend on the order of a key's rows. They are folds over ``ordered.in_time_order``, which
holds rows in state until the watermark has passed them, so results do not depend on how rows fall into micro-batches.
What a fold keeps is small: the last N flags of a job, a failure counter of a resource, the last request of a host.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.session import checkpoint_root
from quotelens.streaming.ordered import in_time_order


#: State of ordered monitors lives in RocksDB, whose lists are read and written row by row.
STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, folder: str, file_glob: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """File stream of parquet events (files or folders that fit the glob) with ``ts`` as a zoned timestamp, ready for watermarks."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a pattern of the path, not a filter of file names, so that a match may be a file or a folder of files
    d = reader.parquet(f"{folder}/{{{file_glob}}}")
    return d.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in d.columns else d


def breaker_stream(attempts: DataFrame, key: str, window: int = 40, min_events: int = 10, block_rate: float = 0.20, server_rate: float = 0.30, delay: str = "1 hour") -> DataFrame:
    """First trip per job over its last ``window`` events; block rate is checked before server errors.

    ``attempts``: key, ts, attempt_id, status, reason.
    """

    def fold(state, row):
        seen, flags, tripped = state or (0, "", False)
        if tripped:
            return state, []
        blocked = row.status in (403, 429)
        server = 500 <= (row.status or 0) <= 599 or "request_error" in (row.reason or "")
        seen, flags = seen + 1, (flags + str(int(blocked) + 2 * int(server)))[-window:]
        n = len(flags)
        b, s = sum(f in "13" for f in flags) / n, sum(f in "23" for f in flags) / n
        hit = ("block_rate", b, block_rate) if b >= block_rate else ("server_error_rate", s, server_rate) if s >= server_rate else None
        if n < max(1, min_events) or not hit:
            return (seen, flags, False), []
        return (seen, flags, True), [(seen, f"circuit_open_{hit[0]} rate={hit[1]:.3f} threshold={hit[2]:.3f} window={n}")]

    rows = attempts.select(F.col(key).alias("key"), "ts", "attempt_id", "status", "reason")
    return in_time_order(rows, "seen long, flags string, tripped boolean", "trip_event_no long, open_reason string", fold, delay=delay)


def quarantine_stream(attempts: DataFrame, key: str, threshold: int = 3, cooldown_us: int = 300_000_000, delay: str = "1 hour") -> DataFrame:
    """Quarantines of each resource: key, attempt_id, from_us, until_us, to_us, ended.

    Consecutive failures start one, which lasts until the cooldown is over (``cooldown``, told by a timer), a success clears
    it (``success``) or further failures start it anew (``extended``). ``attempts``: key, ts, attempt_id, failed.
    """

    def ended(state, now):
        """What is over by now: the cooldown's end, if the resource is in quarantine."""
        streak, start_id, start, until = state
        if start is not None and until <= now:
            return (streak, None, None, None), [(start_id, start, until, until, "cooldown")]
        return state, []

    def fold(state, row):
        state, out = ended(state or (0, None, None, None), row.ts_us)
        streak, start_id, start, until = state
        if not row.failed:
            return (0, None, None, None), out + ([(start_id, start, until, row.ts_us, "success")] if start is not None else [])
        streak += 1
        if streak < max(threshold, 1):
            return (streak, start_id, start, until), out
        if start is not None:
            out = [*out, (start_id, start, until, row.ts_us, "extended")]
        return (0, row.attempt_id, row.ts_us, row.ts_us + cooldown_us), out

    rows = attempts.select(F.col(key).alias("key"), "ts", "attempt_id", "failed")
    state, out = "streak long, start_id long, start_us long, until_us long", "attempt_id long, from_us long, until_us long, to_us long, ended string"
    return in_time_order(rows, state, out, fold, ended, wake=lambda state: state[3], delay=delay)


def pacing_stream(attempts: DataFrame, key: str, min_delay_us: int, delay: str = "1 hour") -> DataFrame:
    """Requests that came too early after the previous one of the same host.

    ``attempts``: key, ts, attempt_id.
    """

    def fold(state, row):
        early = state is not None and row.ts_us - state[0] < min_delay_us
        return (row.ts_us,), [(row.attempt_id, min_delay_us - (row.ts_us - state[0]))] if early else []

    rows = attempts.select(F.col(key).alias("key"), "ts", "attempt_id")
    return in_time_order(rows, "last_us long", "attempt_id long, wait_us long", fold, delay=delay)


def snapshot_stream(snapshots: DataFrame, key: str, ttl_days: int = 7, delay: str = "1 hour") -> DataFrame:
    """How long each page snapshot was the one to use: key, attempt_id, from_us, expires_us, to_us, ended.

    The newest snapshot of a page replaces the one before (``replaced``); a timer drops it from the state when its time to
    live is over (``expired``), so the state holds fresh snapshots alone. ``snapshots``: key, ts, attempt_id (the snapshot).
    """
    ttl = max(int(ttl_days or 7), 1) * 86_400_000_000

    def expired(state, now):
        if state[2] < now:
            return None, [(*state, state[2], "expired")]
        return state, []

    def fold(state, row):
        state, out = expired(state, row.ts_us) if state else (None, [])
        if state:
            out = [*out, (*state, row.ts_us, "replaced")]
        return (row.attempt_id, row.ts_us, row.ts_us + ttl), out

    rows = snapshots.select(F.col(key).alias("key"), "ts", "attempt_id")
    state, out = "attempt_id long, from_us long, expires_us long", "attempt_id long, from_us long, expires_us long, to_us long, ended string"
    return in_time_order(rows, state, out, fold, expired, wake=lambda state: state[2], delay=delay)


def gate_rates(attempts: DataFrame, keys: list[str], window: str = "1 day", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Block and server-error rates per event-time window."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = attempts.withWatermark("ts", watermark).groupBy(span.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(403, 429)).alias("blocked"), F.count_if(F.col("status").between(500, 599)).alias("server_errors")
    )
    return agg.select(
        F.unix_micros("w.start").alias("window_us"), *keys, "total", "blocked", "server_errors",
        F.round(F.col("blocked") / F.col("total"), 4).alias("block_rate"), F.round(F.col("server_errors") / F.col("total"), 4).alias("server_error_rate"),
    )


def rate_windows(attempts: DataFrame, key: str, max_rps: float, seconds: int = 1, watermark: str = "1 hour") -> DataFrame:
    """Tumbling request counts per host against the allowed rate."""
    agg = attempts.withWatermark("ts", watermark).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return agg.select(F.unix_micros("w.start").alias("window_us"), key, "requests", (F.col("requests") > max_rps * seconds).alias("over_limit"))


def request_bursts(attempts: DataFrame, key: str, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """Bursts of a host's requests, cut where it pauses longer than the gap."""
    agg = attempts.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("requests"))
    return agg.select(F.unix_micros("w.start").alias("burst_us"), key, "requests")


def live_progress(results: DataFrame, status: str = "unit_status") -> DataFrame:
    return results.groupBy(status).agg(F.count(F.lit(1)).alias("units"))


def suppress_repeats(results: DataFrame, unit: str, watermark: str = "60 days") -> DataFrame:
    """First result of each unit inside the watermark."""
    return results.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([unit])


# ---- sinks --------------------------------------------------------------------------------------------------------------------------

def run_append(stream: DataFrame) -> DataFrame:
    """Drain the stream into a parquet folder under the shared checkpoint root and read it back."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_ordered(monitor: Callable[[DataFrame], DataFrame], events: DataFrame) -> DataFrame:
    """Drain an ordered monitor over events (key columns, ts, ...) whose source has an end.

    The rows behind the last watermark would wait for later ones for ever. So a second source, empty at first, closes the
    stream: once the events are drained, a row a century ahead moves the watermark past all of them.
    """
    spark = events.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], events.schema).write.parquet(f"{base}/close")
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        stream = monitor(events.unionByName(spark.readStream.schema(events.schema).parquet(f"{base}/close")))
        for closing in (False, True):
            if closing:
                end = F.timestamp_micros(F.lit(4_102_444_800_000_000))
                blank = [(end if f.name == "ts" else F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema.fields]
                spark.range(1).select(*blank).write.mode("append").parquet(f"{base}/close")
            q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """Drain an aggregation; each batch replaces the table of its own id, so a replayed batch changes nothing."""
    spark = stream.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id:012d}")

    q = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.parquet(f"{base}/out/*")
    last = done.agg(F.max("batch_id").alias("m"))
    return done.join(last, F.col("batch_id") == F.col("m"), "left_semi").drop("batch_id")


def _numbered(spark: SparkSession, table_path: str, kind: str) -> list[int]:
    """Numbers of the complete folders ``kind=000000000000`` of a table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{table_path}/{kind}=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in (found or []))


class StateTable:
    """Newest event of every (unit, status), upserted batch by batch.

    A batch is a folder of its own, named by its id, so that a replay overwrites what it wrote. Every ``every`` batches the
    last snapshot and the batches since are summed up to a new snapshot, in ``buckets`` files by unit; a reader takes the
    last complete snapshot and the batches after it, never the history. Older folders go one compaction later.
    """

    def __init__(self, path: str, unit: str = "unit_id", seq: str = "seq", status: str = "status", every: int = 20, buckets: int = 16):
        self.path, self.unit, self.seq, self.status, self.every, self.buckets = path, unit, seq, status, every, buckets

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}={number:012d}"

    def save(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(self._folder("batch", batch_id))
        if (batch_id + 1) % self.every == 0:
            self.compact(batch.sparkSession, batch_id)

    def _parts(self, spark: SparkSession, up_to: int | None = None) -> tuple[int, list[str]]:
        inside = lambda n: up_to is None or n <= up_to
        last = max((n for n in _numbered(spark, self.path, "snapshot") if up_to is None or n < up_to), default=-1)
        batches = [self._folder("batch", n) for n in _numbered(spark, self.path, "batch") if n > last and inside(n)]
        return last, ([self._folder("snapshot", last)] if last >= 0 else []) + batches

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        before, parts = self._parts(spark, batch_id)
        events = spark.read.option("recursiveFileLookup", True).parquet(*parts).select(self.unit, self.seq, self.status)
        newest = events.groupBy(self.unit, self.status).agg(F.max(self.seq).alias(self.seq)).select(self.unit, self.seq, self.status)
        newest.repartition(self.buckets, self.unit).sortWithinPartitions(self.unit).write.mode("overwrite").parquet(self._folder("snapshot", batch_id))
        # readers may still be on the snapshot before; what that one replaced can go
        old = [("snapshot", n) for n in _numbered(spark, self.path, "snapshot") if n < before] + [("batch", n) for n in _numbered(spark, self.path, "batch") if n <= before]
        for kind, n in old:
            p = spark._jvm.org.apache.hadoop.fs.Path(self._folder(kind, n))
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, spark: SparkSession) -> DataFrame:
        """Events from which ``planning.fold_state`` gets every unit's state."""
        parts = self._parts(spark)[1]
        return spark.read.option("recursiveFileLookup", True).parquet(*parts).select(self.unit, self.seq, self.status)

    def upsert(self, results: DataFrame, checkpoint: str):
        return results.writeStream.foreachBatch(self.save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_state_table(results: DataFrame, every: int = 20) -> DataFrame:
    spark = results.sparkSession
    base = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    table = StateTable(f"{base}/state", every=every)
    table.upsert(results, f"{base}/cp").awaitTermination()
    return table.read(spark)
