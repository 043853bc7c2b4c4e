"""Encoders, packing and token files against the tokenizers library and plain loops."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quotelens.llm import bpe, packing, token_files
from quotelens.llm.tokens import Decoder, ForcedCuts, WhiteSpace, encoder
from tests.llm.conftest import ROWS

BYTES, WORDS = Tokenizer.from_file(bpe.VOCABULARY), Tokenizer.from_file(packing.VOCABULARY)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def as_bytes(values):
    return np.array(values, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab 's\n\t'(.,1é́ 　 中<|>"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_encoders_equal_the_library(text):
    assert encoder(bpe.VOCABULARY, ForcedCuts).encode(text) == as_bytes(ids(BYTES, text))
    assert encoder(packing.VOCABULARY, WhiteSpace).encode(text) == as_bytes(ids(WORDS, text))
    coded = ids(BYTES, text)
    assert Decoder(bpe.VOCABULARY).decode(coded) == BYTES.decode(coded, skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    from quotelens.llm import tokens

    monkeypatch.setattr(tokens, "MEMORY", 5)
    small = tokens.Encoder(bpe.VOCABULARY, ForcedCuts)
    for _, text in ROWS:
        assert small.encode(text) == as_bytes(ids(BYTES, text))


def test_broken_bytes_decode_as_in_the_library():
    part = ids(BYTES, "中文😀")
    for cut in (part[:-1], part[1:], [*part[:1], *part[:1]]):
        assert Decoder(bpe.VOCABULARY).decode(cut) == BYTES.decode(cut, skip_special_tokens=False)


def test_round_trip_rows(plain, docs, empty):
    got = bpe.decode_texts(bpe.encode_texts(docs)).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded, r.source) for r in got) == Counter((d, as_bytes(ids(BYTES, t)), t or "", "x") for d, t in ROWS)
    assert bpe.decode_texts(bpe.encode_texts(empty)).count() == 0


def test_pieces_and_sequences(docs, empty):
    coded = [(d, ids(WORDS, t) + [1]) for d, t in ROWS]
    want = Counter((d, i, at, as_bytes(x[at : at + 256])) for d, x in coded for i, at in enumerate(range(0, len(x), 256)))
    parts = packing.pieces(docs, capacity=256).cache()
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in parts.collect()) == want
    packed = packing.pack(parts, capacity=256, shard=20)
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in rows) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and 4 * r.length == len(r.ids) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packing.pack(parts, capacity=256)).collect()}
    assert sum(map(len, joined.values())) == sum(len(k[3]) * n for k, n in want.items())
    assert packing.packed_documents(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_local_search_keeps_everything_and_never_adds_sequences(values):
    lengths = np.array(values, dtype=np.int64)
    first = packing.best_fit(lengths, 100)
    bins = packing.LocalSearch(lengths, [list(b) for b in first], 100).run(500)
    assert sorted(i for b in bins for i in b) == list(range(len(values)))
    assert all(lengths[b].sum() <= 100 for b in bins) and len(bins) <= len(first)


def test_local_search_empties_sequences():
    # best-fit decreasing needs three here; two exchanges bring it to two
    lengths = np.array([6, 5, 4, 3, 2])
    start = [[0], [1, 3], [2, 4]]
    assert len(packing.LocalSearch(lengths, start, 10).run(50)) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-(1 << 63), (1 << 63) - 1), max_size=60))
def test_elias_fano(values):
    values.sort()
    coded = token_files.EliasFano.of(np.array(values, dtype=np.int64))
    back, end = token_files.EliasFano.read(memoryview(coded.to_bytes()), 0)
    assert end == len(coded.to_bytes())
    assert back.values().tolist() == values
    assert [back.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        back.select(len(values))


def test_elias_fano_is_small_and_selects_in_long_sequences():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 5000))
    coded = token_files.EliasFano.of(values)
    assert len(coded.to_bytes()) < 5000 * 13 / 8 + 100
    assert [coded.select(i) for i in range(0, 5000, 37)] == values[::37].tolist()


def test_token_files(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_DOCS", 4)
    token_files.write_token_files(docs, f"file://{tmp_path}/a")
    rows = sorted(token_files.read_token_files(spark, f"file://{tmp_path}/a").collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == Counter((d, as_bytes(ids(BYTES, t) + [2])) for d, t in ROWS)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert (r.start, 4 * r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    token_files.write_token_files(empty, f"file://{tmp_path}/b")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/b").count() == 0
