"""The registered queries over a table of files, against the plain versions of the other tests or their check SQL."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest

from quotelens.llm import catalog, exact_dedup, host_reputation
from tests.llm.conftest import ROWS
from tests.llm.test_dedup import grouped, plain_bytes, plain_fingerprint, plain_words
from tests.llm.test_pages import PAGE, TEXTS
from tests.llm.test_pipeline import plain_measures
from tests.llm.test_tokens import BYTES, WORDS, as_bytes, ids

PAGES = [(i, f"http://h{i % 3}.a.{'com' if i % 2 else 'org'}/x/{i}", PAGE.format(body=f"<article><p>{t}</p></article>")) for i, t in enumerate([*TEXTS, "One more, and last."])] + [(90, None, None), (91, "x://n.net/de/8", "")]
LABELS = [(0, 1, 0), (1, 0, 1), (2, None, 0), (3, 1, 0), (3, 1, 1), (None, 1, 0)]


@pytest.fixture(scope="module")
def sf_dir(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def sha(data):
    return hashlib.sha256(data).hexdigest()


def rows(spark, sf_dir, name):
    return Counter(tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect())


def test_packing(spark, sf_dir):
    got = catalog.QUERIES["op1_best_fit_packing"](spark, sf_dir).collect()
    want = Counter()
    for d, t in ROWS:
        x = ids(WORDS, t) + [1]
        want.update((d, i, a, len(x[a : a + 4096]), zlib.crc32(as_bytes(x[a : a + 4096]))) for i, a in enumerate(range(0, len(x), 4096)))
    assert Counter(tuple(r)[:5] for r in got) == want
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(used.values()) // 4096) + 1


def test_round_trip(spark, sf_dir):
    want = Counter((d, len(ids(BYTES, t)), sha(as_bytes(ids(BYTES, t))), sha((t or "").encode())) for d, t in ROWS)
    assert rows(spark, sf_dir, "op2_bpe_round_trip") == want


def test_main_text(spark, sf_dir):
    want = Counter((p, u, t, len(t)) for (p, u, _), t in zip(PAGES, [*TEXTS, "One more, and last.", "", ""], strict=True))
    plain = {t: t.replace("&amp;", "&").replace("<b>", "").replace("</b>", "") for _, _, t, _ in want}
    assert rows(spark, sf_dir, "op3_tag_path_text") == Counter((p, u, plain[t], len(plain[t])) for p, u, t, _ in want)


def test_token_files(spark, sf_dir):
    got = catalog.QUERIES["op4_token_files"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(ids(BYTES, t)) + 1, zlib.crc32(as_bytes(ids(BYTES, t) + [2]))) for d, t in ROWS)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("name,sql", [("op5_host_reputation", host_reputation.CHECK), ("op9_exact_dedup", exact_dedup.CHECK)])
def test_check_sql(spark, sf_dir, name, sql):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'" + (" where doc_id is not null" if t == "documents" else ""))
    got = catalog.QUERIES[name](spark, sf_dir)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = Counter(cursor.fetchall())
    if name == "op9_exact_dedup":  # equal rows but for which of them stays are compared as such; rows without id are in test_dedup
        keep = Counter(tuple(r) for r in got.where("doc_id is not null").select(*names).collect())
        nulls = {sha(b"".join((t or "").encode().split())) for d, t in ROWS if d is None}
        assert Counter(k for k in keep.elements() if k[names.index("text_sha256")] not in nulls) == Counter(k for k in want.elements() if k[names.index("text_sha256")] not in nulls)
    else:
        assert Counter(tuple(r) for r in got.select(*names).collect()) == want


def test_quality(spark, sf_dir):
    got = catalog.QUERIES["op6_repetition_coverage"](spark, sf_dir).collect()
    want = Counter((d, *plain_measures(t)[0][:5], *plain_measures(t)[1:]) for d, t in ROWS)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want


def test_windows(spark, sf_dir):
    want = Counter({(d, n, r, sha(left.encode())): c for (d, n, r, left), c in plain_words(ROWS, 50).items()})
    assert rows(spark, sf_dir, "op7_substring_dedup") == want
    want = Counter({(d, n, r, s, sha(left)): c for (d, n, r, s, left), c in plain_bytes(ROWS, 400).items()})
    assert rows(spark, sf_dir, "op10_suffix_array_dedup") == want


def test_simhash(spark, sf_dir):
    fps = [plain_fingerprint(t) for _, t in ROWS]
    parent = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {p: min((ROWS[i][0] for i in range(len(ROWS)) if parent[i] == p), key=lambda d: (d is None, d or 0)) for p in set(parent)}
    assert rows(spark, sf_dir, "op8_simhash_near_dedup") == Counter((d, format(fps[i], "016x"), least[parent[i]]) for i, (d, _) in enumerate(ROWS))
