"""Ordered stream monitors: the same rows whether events come in one batch or shuffled over ten, equal to plain loops."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quotelens.streaming import monitors as mo

SCHEMA = "key string, ts timestamp, attempt_id long, status int, reason string, failed boolean"
COOLDOWN = 300_000_000
FAR = 4_000_000_000_000_000


@pytest.fixture(scope="module")
def events():
    rng, at, out = random.Random(4), 1_700_000_000_000_000, []
    for i in range(260):
        at += rng.choice([0, 1_000, 1_500, 20_000_000, 60_000_000, 200_000_000])
        status = rng.choice([200, 200, 429, 503, 503])
        out.append((rng.choice("abc"), at, i, status, rng.choice(["", None, "request_error x"]) if status == 200 else "", status != 200))
    return out


def folder(spark, tmp_path, batches):
    """One file a batch; the last one moves the watermark past all events."""
    for i, rows in enumerate([*batches, [("end", FAR, 10_000, 200, "", False)]]):
        d = spark.createDataFrame([(k, t, *r) for k, t, *r in rows], SCHEMA.replace("ts timestamp", "ts_us long"))
        d.select("key", F.timestamp_micros("ts_us").alias("ts"), "attempt_id", "status", "reason", "failed").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def drained(spark, path, out, monitor, watermark):
    events = mo.read_events(spark, path, "*.parquet", spark.read.parquet(path).schema, files_per_trigger=1)
    spark.conf.set(mo.STORE, mo.ROCKSDB)
    try:
        stream = monitor(events, watermark)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(f"{out}/rows").filter("key <> 'end'").collect())
    finally:
        spark.conf.unset(mo.STORE)


def by_key(events):
    out = defaultdict(list)
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        out[e[0]].append(e)
    return out


def plain_trips(events):
    out = []
    for key, rows in by_key(events).items():
        for n in range(1, len(rows) + 1):
            last = rows[max(0, n - 12) : n]
            b, s = (sum(f(r) for r in last) / len(last) for f in (lambda r: r[3] == 429, lambda r: r[3] == 503 or "request_error" in (r[4] or "")))
            hit = ("block_rate", b, 0.3) if b >= 0.3 else ("server_error_rate", s, 0.6) if s >= 0.6 else None
            if len(last) >= 5 and hit:
                out.append((key, n, f"circuit_open_{hit[0]} rate={hit[1]:.3f} threshold={hit[2]:.3f} window={len(last)}"))
                break
    return sorted(out)


def plain_quarantines(events):
    out = []
    for key, rows in by_key(events).items():
        streak, active = 0, None
        for _, at, i, _, _, failed in [*rows, (key, FAR, None, 200, "", False)]:
            if active and active[2] <= at:
                out.append((key, *active, active[2], "cooldown"))
                active = None
            streak = streak + 1 if failed else 0
            if active and not failed:
                out.append((key, *active, at, "success"))
                active = None
            if streak == 3:
                if active:
                    out.append((key, *active, at, "extended"))
                streak, active = 0, (i, at, at + COOLDOWN)
    return sorted(out)


def plain_early(events):
    return sorted((k, b[2], 30_000_000 - (b[1] - a[1])) for k, rows in by_key(events).items() for a, b in zip(rows, rows[1:]) if b[1] - a[1] < 30_000_000)  # noqa: B905


MONITORS = {
    "breaker": (lambda e, w: mo.breaker_stream(e, "key", 12, 5, 0.3, 0.6, delay=w), plain_trips),
    "quarantine": (lambda e, w: mo.quarantine_stream(e, "key", 3, COOLDOWN, delay=w), plain_quarantines),
    "pacing": (lambda e, w: mo.pacing_stream(e, "key", 30_000_000, delay=w), plain_early),
}


@pytest.mark.parametrize("name", MONITORS)
def test_batches_do_not_matter(spark, tmp_path, events, name):
    monitor, plain = MONITORS[name]
    shuffled = events[:]
    random.Random(9).shuffle(shuffled)
    one = folder(spark, tmp_path / "one", [shuffled])
    ten = folder(spark, tmp_path / "ten", [shuffled[i::10] for i in range(10)])
    want = plain(events)
    assert want
    assert drained(spark, one, tmp_path / "out1", monitor, "1 day") == want
    assert drained(spark, ten, tmp_path / "out10", monitor, "1 day") == want


def test_a_table_may_be_a_folder(spark, tmp_path, events):
    folder(spark, tmp_path, [events])
    for glob in ("events", "eve*s"):
        stream = mo.read_events(spark, str(tmp_path), glob, spark.read.parquet(str(tmp_path / "events")).schema)
        assert mo.run_append(stream).count() == len(events) + 1


def test_rows_are_filed_by_stretch():
    """No value in the state holds rows of more than one stretch of event time."""
    from quotelens.streaming import ordered

    held = ordered.InTimeOrder({"attempt_id": "bigint", "ts_us": "bigint"}, "n long", ["attempt_id"], lambda s, r: (s, []), None, None)
    state = defaultdict(dict)

    class Map:
        def __init__(self, name):
            self.of = state[name]

        def containsKey(self, k):  # noqa: N802
            return k in self.of

        def getValue(self, k):  # noqa: N802
            return self.of[k]

        def updateValue(self, k, v):  # noqa: N802
            self.of[k] = v

    import pandas as pd

    held.waiting, held.parts = Map("waiting"), Map("parts")
    hour, rng = 3_600_000_000, random.Random(5)
    chunks = [pd.DataFrame({"attempt_id": range(i, i + 50), "ts_us": [rng.randrange(20 * hour) for _ in range(50)]}) for i in range(0, 200, 50)]
    for chunk in chunks:
        held._file([chunk])
    got = [r for k, v in state["waiting"].items() for r in v[0] if r[1] // hour == k[0]]
    assert sorted(got) == sorted((r.attempt_id, r.ts_us) for c in chunks for r in c.itertuples())
    assert {s: n for (s,), (n,) in state["parts"].items()} == {s: sum(k[0] == s for k in state["waiting"]) for s, _ in state["waiting"]}


def plain_snapshots(events):
    out, ttl = [], 86_400_000_000
    for key, rows in by_key(events).items():
        for (_, at, i, *_), after in zip(rows, [*rows[1:], None], strict=True):
            end = at + ttl
            replaced = after is not None and after[1] <= end
            out.append((key, i, at, end, after[1] if replaced else end, "replaced" if replaced else "expired"))
    return sorted(out)


def test_snapshots_expire(spark, tmp_path):
    rng, at, events = random.Random(2), 1_700_000_000_000_000, []
    for i in range(60):
        at += rng.choice([3_600_000_000, 40_000_000_000, 86_400_000_000])
        events.append((rng.choice("ab"), at, i, 200, "", False))
    shuffled = events[:]
    random.Random(3).shuffle(shuffled)
    path = folder(spark, tmp_path, [shuffled[i::3] for i in range(3)])
    got = drained(spark, path, tmp_path / "out", lambda e, w: mo.snapshot_stream(e, "key", 1, delay=w), "100 days")
    assert got == plain_snapshots(events) and {r[-1] for r in got} == {"replaced", "expired"}


def test_state_table_compacts_and_replays(spark, tmp_path):
    from quotelens.operators.planning import fold_state

    rng = random.Random(8)
    rows = [(f"u{rng.randrange(30)}", i, rng.choice(["completed", "failed", "skipped"])) for i in range(400)]
    table = mo.StateTable(str(tmp_path / "state"), every=3, buckets=4)
    batches = [spark.createDataFrame(rows[i::11], "unit_id string, seq long, status string") for i in range(11)]
    want = {tuple(r) for r in fold_state(spark.createDataFrame(rows, "unit_id string, seq long, status string")).collect()}
    for n, batch in enumerate(batches):
        table.save(batch, n)
        if n in (4, 5):
            table.save(batch, n)  # a replay
    last, parts = table._parts(spark)
    assert last == 8 and len(parts) == 3
    assert {tuple(r) for r in fold_state(table.read(spark)).collect()} == want
    assert table.read(spark).count() <= 30 * 3 + 2 * 37  # the snapshot and two batches
