"""Exact, near, substring and suffix dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quotelens.llm import exact_dedup, simhash, substring_dedup, suffix_dedup, windows
from quotelens.llm.components import components
from tests.llm.conftest import ROWS


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# exact


def exact_groups(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups["".join(words_of(t))].append((d, t or ""))
    return groups


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.xxhash64(c).bitwiseAND(3), lambda c: F.lit(7).cast("long")], ids=["xxhash64", "two bits", "one key"])
@pytest.mark.parametrize("size", [8192, 2])
def test_exact_duplicates(plain, key, size):
    got = exact_dedup.exact_duplicates(plain, key, size, size).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for bare, members in exact_groups(ROWS).items():
        rows = by[hashlib.sha256(bare.encode()).hexdigest()]
        assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in members)
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0]))
        assert {(r.keep_id, r.group_size) for r in rows} == {(best[0], len(members))}
        assert [(r.doc_id, r.n_chars) for r in rows if r.kept] == [(best[0], len(best[1]))]


def test_exact_duplicates_of_nothing(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_directory_splits_overfull_buckets_only(spark):
    keys = spark.range(4000).select((F.xxhash64("id").bitwiseAND((1 << 60) - 1)).alias("key"), F.lit(1).alias("n"))
    directory = exact_dedup.Directory(keys, 50)
    assert all(k <= 50 for k, _ in directory.buckets.values()) and sum(k for k, _ in directory.buckets.values()) == 4000
    placed = keys.withColumn("probe", directory.probes(F.col("key"))).select("key", "probe.*").join(directory.table(spark, 100), ["depth", "prefix"])
    assert placed.count() == 4000 and placed.select("bucket").distinct().count() <= len(directory.buckets)
    deep = spark.range(200).select(F.col("id").alias("key"), F.lit(1).alias("n"))  # differ in the last bits alone
    assert max(d for d, _ in exact_dedup.Directory(deep, 60).buckets) > 50


# near


def plain_fingerprint(text):
    words = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(items, linked):
    """Smallest index reachable, by plain search."""
    parent = list(range(len(items)))
    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_near_duplicates(plain, empty):
    fps = [plain_fingerprint(t) for _, t in ROWS]
    parent = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {p: min((ROWS[i][0] for i in range(len(ROWS)) if parent[i] == p), key=lambda d: (d is None, d)) for p in set(parent)}
    want = Counter((d, fps[i], least[parent[i]]) for i, (d, _) in enumerate(ROWS))
    for group in (16384, 2):
        got = simhash.near_duplicates(plain, group=group).collect()
        assert Counter((r.doc_id, r.fp0 % (1 << 64), r.component_id) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert [r.component_id for r in simhash.near_duplicates(plain.where("doc_id = 5")).collect()] == [5]


@pytest.mark.parametrize("near", [4, 14])
def test_links_lose_nothing(spark, near):
    rng = np.random.default_rng(near)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 2 + near // 2), replace=False)) for _ in range(240)], np.uint64)
    fps = np.unique(np.concatenate([base, rng.choice(base, 240) ^ flips, rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    parent = grouped(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= near)
    want = {}
    for i, f in enumerate(fps.view(np.int64).tolist()):
        want.setdefault(parent[i], set()).add(f)
    distinct = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp0 long")
    n, both = simhash.bit_counts(distinct)
    for group in (16384, 5):
        edges = simhash.links(distinct, simhash.plan(n, both, near), near, near, 1, group)
        found = defaultdict(set)
        for r in components(edges).collect():
            found[r.component].add(r.node)
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_plan_covers_the_distance():
    rng = np.random.default_rng(3)
    b = rng.integers(0, 2, (500, 64))
    b[:, 1] = b[:, 0]  # two bits that go together
    both = (b.T @ b).astype(float)
    assert any({0, 1} <= set(g) for g in simhash.grouped_bits(500, both, 5))
    for n in (1e3, 1e7, 1e10):
        for distance in (1, 4, 14):
            scheme = simhash.plan(int(n), both / 500 * n, distance)
            # both sides vary t bits, so a partition catches 2t; the rest of the distance must be caught elsewhere
            assert sum(2 * t + 1 for _, t in scheme) >= distance + 1
            bits = [x for g, _ in scheme for x in g]
            assert len(bits) == len(set(bits))


def test_wide_fingerprints_tell_texts_apart():
    a = " ".join(f"w{i}" for i in range(400))
    edited = a.replace("w200 ", "changed ").replace("w300 ", "other ")
    other = " ".join(f"v{i}" for i in range(400))
    one, two, three = (simhash.fingerprint(t, 5, 4) for t in (a, edited, other))
    assert np.bitwise_count(one ^ two).sum() <= 46 < np.bitwise_count(one ^ three).sum()


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1 << 40), (5, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 1 << 40: 7} | {100 + i: 100 for i in range(41)} | {1000 + i: 1000 for i in range(51)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# windows


def plain_words(rows, size):
    first = {}
    key = lambda d: (d is None, d or 0)
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, key(d)), key(d))
    out = Counter()
    for d, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < key(d):
                gone[i : i + size] = [True] * size
        out[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    return out


def plain_bytes(rows, size):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    return out


SMALL = ROWS[:17] + [(20 + i, "shared " * (i % 3) + f"lead{i} " + " ".join(f"p{j}" for j in range(i, i + 30)) + f" mid{i % 5} " + " ".join(f"q{j}" for j in range(40 - i))) for i in range(14)]


@pytest.mark.parametrize("size", [5, 50])
def test_repeated_words(spark, size):
    got = substring_dedup.drop_repeated_words(spark.createDataFrame(SMALL, "doc_id long, text string"), size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.left) for r in got) == plain_words(SMALL, size)


@pytest.mark.parametrize("size", [7, 60])
def test_repeated_bytes(spark, size):
    got = suffix_dedup.drop_repeated_bytes(spark.createDataFrame(SMALL, "doc_id long, text string"), size).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.left)) for r in got) == plain_bytes(SMALL, size)


def test_production_lengths_on_all_rows(docs, empty):
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.left) for r in substring_dedup.drop_repeated_words(docs).collect()) == plain_words(ROWS, 50)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.left)) for r in suffix_dedup.drop_repeated_bytes(docs).collect()) == plain_bytes(ROWS, 400)
    assert substring_dedup.drop_repeated_words(empty).count() == suffix_dedup.drop_repeated_bytes(empty).count() == 0
    short = {r.doc_id: r.left for r in substring_dedup.drop_repeated_words(docs.where("doc_id in (9, 10)"), output="changed").collect()}
    assert short == {9: None, 10: "start here and end there"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=90), st.integers(3, 12))
def test_marks_depend_on_the_window_alone(values, size):
    units = windows.mixed(np.array(values) + 1)
    first, last, at, _ = windows.marked(units, size)
    assert first[0] == 0 and last[-1] == len(units) - size and (first[1:] == last[:-1] + 1).all()
    seen = {}
    for a, b, m in zip(first.tolist(), last.tolist(), at.tolist(), strict=True):
        for s in range(a, b + 1):
            assert s <= m <= s + size - size // 2
            assert seen.setdefault(tuple(values[s : s + size]), m - s) == m - s


def test_long_texts_are_read_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(windows, "STRETCH", 16)
    text = " ".join(f"s{i}" for i in range(120))
    rows = [(1, text), (2, "lead " + text + " tail"), (3, " ".join(f"s{i}" for i in range(33, 90)))]
    index = [windows.entries(substring_dedup.word_values(t.encode().split())[b : b + 16 + 9], 10) for _, t in rows for b in range(0, len(t.split()) - 9, 16)]
    assert all(len(e[0]) for e in index)
    got = substring_dedup.drop_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.left) for r in got) == plain_words(rows, 10)
    assert isinstance(pa.array(index[0][0]), pa.Int64Array)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("earlier", [True, False])
def test_repeats_are_not_broadcast(spark, earlier):
    """Spark's estimate of copies made by explode is that of the rows before it: even small tables are merged."""
    rows = [(d, d, core, whole, 0, 3) for d, (core, whole) in enumerate([(1, 1), (1, 1), (1, 2), (2, 5), (2, 5), (3, 9)])]
    found, _ = windows._repeated(spark.createDataFrame(rows, "doc_id long, text_hash int, core long, whole long, first int, last int"), earlier)
    assert "SortMergeJoin" in plan_of(found) and "Broadcast" not in plan_of(found)
    got = {r.doc_id: [(x.sure, x.open) for x in r.runs] for r in found.collect()}
    # of cores with several classes the first document of each goes on; core 2 has one class
    want = {0: (not earlier, True), 1: (True, False), 2: (False, True), 3: (not earlier, False), 4: (True, False)}
    assert got == {d: [w] for d, w in want.items() if any(w)}
