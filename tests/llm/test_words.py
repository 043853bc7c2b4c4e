"""Spelling variants, line dedup and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quotelens.llm import line_dedup, search, spelling
from tests.llm.conftest import ROWS

# --- spelling variants -------------------------------------------------------------------------------------------------


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain_words(rows, min_chars=5, min_count=3):
    counts = Counter()
    for d, t in rows:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_chars and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    met = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    best = {w: min(x, key=lambda y: (-words[y], y)) for w, x in met.items() if x}
    form = {w: b if words[b] >= 2 * words[w] else None for w, b in best.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(met[w]), words[f] if f else None))
    return out


def noisy_rows():
    rng = random.Random(7)
    letters = "abcdeé÷ü"
    base = ["hello", "helllo", "aaaaa", "aaaaaa", "banana", "bananas", "éééééé", "running", "runing", "zzzzzzzzz"]
    base += ["".join(rng.choices(letters, k=rng.randint(4, 8))) for _ in range(60)]
    words = list(base)
    for w in base:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c]))
    weights = [rng.choice([1, 1, 2, 5, 30]) for _ in words]
    return [(i, rng.choice([" ", "\n", "-", "1", "中"]).join(rng.choices(words, weights, k=400)).title()) for i in range(25)]


@pytest.mark.parametrize("rows", [ROWS, noisy_rows()], ids=["edge", "noisy"])
def test_variants(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n long, word string")
    got = {tuple(r) for r in spelling.variants(docs).collect()}
    want = plain_variants(plain_words(rows))
    assert got == want
    if rows is not ROWS:
        assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])


def test_chains_long_words_and_slips(spark):
    counts = {"abcdefghij": 3, "abcdefghix": 7, "abcdefghxx": 15, "abcdefgxxx": 31, "abcdefxxxx": 64, "q" * 300: 3, "q" * 301: 9, "q" * 299 + "z": 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.n_near, r.near) for r in spelling.neighbours(words).collect()}
    want = plain_variants(counts)
    assert {w: v[0] for w, v in got.items()} == {r[0]: r[4] for r in want if r[4]}
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, up string")
    assert {r.root for r in spelling.roots(links).collect()} == {"w37"}
    slip = next(f"wörd{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(676) if zlib.crc32(f"5:wörd{chr(97 + i // 26)}{chr(97 + i % 26)}".encode()) % 97 == 0)
    assert [len(b) for _, b in spelling.slipped(5, [slip.encode("latin-1")])] == [len(slip) - 1]


def test_variants_of_nothing(spark, empty):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect() == []


# --- line dedup --------------------------------------------------------------------------------------------------------


def plain_lines(rows, min_chars=1, min_docs=10, keep_first=False):
    key = lambda line: lowered(line.strip(" \t\n\x0b\x0c\r"))
    split = [(d, (t or "").split("\n")) for d, t in rows]
    many = Counter(k for _, lines in split for k in {key(x) for x in lines})
    many = {k for k, n in many.items() if n >= min_docs and len(k) >= min_chars}
    first = {}
    for d, lines in sorted(split, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5("\n".join(x[1]).encode()).hexdigest())):
        for i, x in enumerate(lines):
            first.setdefault(key(x), (d, "\n".join(lines), i))
    out = Counter()
    for d, lines in split:
        gone = [key(x) in many and not (keep_first and first[key(x)] == (d, "\n".join(lines), i)) for i, x in enumerate(lines)]
        out[d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g).encode()] += 1
    return out


def line_rows():
    rng = random.Random(3)
    pool = [f" Line {i} of the pool\t" for i in range(40)] + ["", "  ", "\x0b", "ÀÉ line", "àé LINE", "x", " x", "é"]
    return ROWS + [(i % 70, "\n".join(rng.choice([str.upper, str.lower, str.strip, str])(x) for x in rng.choices(pool, k=rng.randint(1, 12)))) for i in range(90)] + [(500, "\n" * 50), (501, "same\n" * 3000), (None, "only\nnull"), (None, "only\nnull")]


@pytest.mark.parametrize("min_chars,min_docs,keep_first", [(1, 10, False), (2, 3, True), (1, 2, True), (7, 2, False)])
@pytest.mark.parametrize("segment_keys,filter_bytes", [(line_dedup.SEGMENT_KEYS, line_dedup.FILTER_BYTES), (16, 1 << 16), (16, 8)], ids=["one", "segments", "full"])
def test_lines(spark, min_chars, min_docs, keep_first, segment_keys, filter_bytes):
    rows = line_rows()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, digest string, n_lines long").repartition(5)
    got = line_dedup.drop_lines(docs, min_chars, min_docs, keep_first, segment_keys=segment_keys, filter_bytes=filter_bytes).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, bytes(r.left)) for r in got) == plain_lines(rows, min_chars, min_docs, keep_first)


def test_filter_lets_few_single_lines_through(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('own ', id, '\\nshared ', id % 500) as text")
    data = docs.selectExpr("doc_id", "md5(text) as digest", "cast(text as binary) as data")
    plan = line_dedup.Plan(8000, 1 << 10, 1 << 20)
    filters = {r.segment: bytes(r.bits) for r in line_dedup.twice_filter(line_dedup.key_hashes(data, plan, 1), plan).collect()}
    assert len(filters) == 8
    found = line_dedup.suspected(data, plan, 1, filters)
    assert 4000 <= found.count() < 4100


def test_lines_of_nothing(spark, empty):
    assert line_dedup.drop_lines(empty).collect() == []


# --- ranked search -----------------------------------------------------------------------------------------------------


def plain_terms(text):
    return [lowered(t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(rows, items, top=20):
    docs = [(d, Counter(plain_terms(t))) for d, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, c in docs:
            n, score = sum(c.values()), 0
            for t, k in Counter(plain_terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += k * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * n * n_docs) // total)))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scores)[:top], 1):
            out[item, rank, None if none else d, -s] += 1
    return out


def search_rows():
    rng = random.Random(11)
    words = [f"t{i}" for i in range(300)] + ["中文", "naïve", "ÄÖ", "A1b2"]
    weights = [1 / (1 + i) for i in range(len(words))]
    rows = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weights, k=rng.choice([0, 3, 40, 200])))) for i in range(1500)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (9000, "t1 " * 700 + "t299"), (9001, None)] + [(10000 + i, "copy of one text t250") for i in range(60)]
    items = [(1, "T1 t2 t3 t250 t250"), (2, "t299 copy"), (3, None), (4, ""), (4, "naïve 中文 äö a1b2"), (5, "nowhere"), (6, " ".join(words[:80])), (7, "t1"), (1, "T1 t2 t3 t250 t250"), (None, "t40 t41 t42 t43 t260")]
    return rows, items


def searched(spark, rows, items, shard_docs, block_terms, shuffle=3):
    docs = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, term binary, shard long").repartition(shuffle)
    asked = spark.createDataFrame([(q, i, t) for q, (i, t) in enumerate(items)], "query long, item_id long, text string")
    whole = search.totals(docs)
    found = search.search(search.build_index(docs, whole, shard_docs), whole, asked, block_terms=block_terms)
    return Counter(tuple(r) for r in found.join(asked, "query").select("item_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("shard_docs,block_terms", [(search.SHARD_DOCS, search.QUERY_TERMS), (300, 40), (1, 1000)])
def test_search(spark, shard_docs, block_terms):
    rows, items = search_rows()
    rows = rows if shard_docs > 1 else rows[:120] + rows[-60:]
    assert searched(spark, rows, items, shard_docs, block_terms) == plain_search(rows, items)


def test_search_of_edge_rows(spark):
    items = [(1, "quick brown fox"), (2, "alpha3 beta4 don't stop"), (3, "é"), (4, "w5x5 the the"), (None, "negative")]
    assert searched(spark, ROWS, items, 4, 1000) == plain_search(ROWS, items)


def test_search_of_nothing(spark, empty):
    asked = spark.createDataFrame([(0, "a"), (1, None)], "query long, text string")
    whole = search.totals(empty)
    assert whole == search.Totals(0, 0)
    assert search.search(search.build_index(empty, whole), whole, asked).collect() == []
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    whole = search.totals(some)
    assert search.search(search.build_index(some, whole), whole, asked.limit(0)).collect() == []


def test_blocks_are_rejected_before_they_are_opened():
    """A rare term fills the heap; most of the common list's blocks are then never decompressed, and nothing is missed."""
    n, rng = 20_000, np.random.default_rng(5)
    words, lengths = [], []
    for d in range(n):
        own = [b"common"] * int(rng.integers(1, 3)) + [b"fill"] * int(rng.integers(5, 40)) + [b"rare"] * (d < 200)
        words += own
        lengths.append(len(own))
    whole, lengths = search.Totals(n, len(words)), np.array(lengths)
    batches = list(search.shard_rows(0, list(range(n)), words, lengths, whole))
    lists = {r["term"]: search.Postings(*(np.array(r[c]) for c in ("blocks", "maxima", "ends")), np.frombuffer(r["postings"], np.uint8), n // search.BLOCK + 1) for b in batches[1:] for r in b.to_pylist()}
    heap = search.Heap(20)
    search.search_shard([(b"common", 10), (b"rare", 5000)], lists, np.arange(n), np.zeros(n, bool), lengths, whole, heap)
    assert len(lists[b"common"].open) < 4 and len(lists[b"common"].bounds) == n // search.BLOCK + 1
    tf = defaultdict(Counter)
    for d, own in enumerate(np.split(np.array(words, object), np.cumsum(lengths)[:-1])):
        tf[d] = Counter(own.tolist())
    score = lambda d: sum(w * int(whole.impacts(np.array([tf[d][t]]), lengths[d : d + 1])[0]) for t, w in ((b"common", 10), (b"rare", 5000)))
    assert list(zip((-heap.scores).tolist(), heap.ids.tolist(), strict=True)) == sorted((-score(d), d) for d in range(n))[:20]


def test_varbytes():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 40, 5], np.int64)
    coded, sizes = search.varbytes(values)
    assert (search.unvaried(coded) == values).all() and sizes.sum() == len(coded)


# --- registered queries ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("query,sql", [(line_dedup.line_dedup, line_dedup.CHECK), (search.ranked_search, search.CHECK)], ids=["op12", "op13"])
def test_check_sql(spark, tmp_path, query, sql):
    rows, items = search_rows()
    con = duckdb.connect()
    for name, data, schema in (("documents", [r for r in rows[:400] + ROWS if r[0] is not None], "doc_id long, text string"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    assert Counter(tuple(r) for r in query(spark, str(tmp_path)).select(*names).collect()) == Counter(cursor.fetchall())
