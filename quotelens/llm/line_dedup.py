"""Line dedup through two Bloom filters: hashes seen once, and hashes seen twice.

1. Tasks send the hashes of their documents' distinct line keys, summed up over a block of documents (8 bytes a key), to
   the segment of the filter that owns their hash range. A segment's owner files each hash in ``once``; what is in there
   already goes into ``twice``. Segments hold a fixed number of keys, so there are more of them the more lines there are.
2. Only the ``twice`` filter leaves the owners. It holds repeated keys alone and is never larger than FILTER_BYTES, which
   bounds what is broadcast. A fuller filter lets more lines through to the next step, never fewer: results do not change.
3. Lines that hit it are suspected repeats. Only they are shuffled: 128-bit hashes of their keys are counted by document,
   which confirms the repeats exactly, and the first occurrence is chosen in the same aggregation.
4. Each document gets the numbers of its confirmed lines, and its text is put together from the others.

Null text is one empty line. Keys under min_chars (an empty line's, too) are never looked at. Each row of the input is a document, whatever
its doc_id; rows that are alike in doc_id and text lose the same lines. Ties for the first occurrence go to the smallest
doc_id (null last), then text digest, then line. An empty table gives no rows; further columns are left aside. Lines and
texts are read whole whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from quotelens.llm.tables import documents, kept, release
from quotelens.operators.skew import salted_join

MIN_CHARS, MIN_DOCS = 1, 10
#: Keys that a segment is made for, bits of its once-filter a key, and bits that a key sets.
SEGMENT_KEYS, BITS, PROBES = 1 << 18, 16, 4
#: Hashes that a task sums up before it sends them; largest size of all segments of the twice-filter together.
BLOCK_KEYS, FILTER_BYTES = 1 << 18, 1 << 26

OWNER = ["doc_id", "digest"]


def line_keys(data: bytes) -> list[bytes]:
    """Keys of all lines: stripped of ASCII white space, A-Z lower-cased (other bytes stay as they are)."""
    return list(map(bytes.strip, data.lower().split(b"\n")))


def long_enough(key: bytes, min_chars: int) -> bool:
    """In code points, of which a key has no more than bytes."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each hash (the high bits choose the segment, so these come from a product of all)."""
    spread = hashes * np.uint64(0x9E3779B97F4A7C15)
    step = (spread >> np.uint64(32)) | np.uint64(1)
    first = (spread ^ (spread >> np.uint64(29))) & np.uint64(0xFFFFFFFF)
    return ((first[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def hit(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows of at have all their bits set."""
    return ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def fill(filled: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filled, at.ravel() >> 3, np.left_shift(np.uint8(1), (at.ravel() & 7).astype(np.uint8)))


class Plan:
    """Segments by the high bits of the hash. once: bits of a segment's first filter; twice: of its second one."""

    def __init__(self, keys: int, segment_keys: int, filter_bytes: int):
        self.depth = max(0, (max(keys, 1) - 1) // segment_keys).bit_length()
        self.once = 1 << (BITS * segment_keys - 1).bit_length()
        self.twice = max(64, min(self.once // 2, 1 << (8 * filter_bytes >> self.depth).bit_length() >> 1))

    def segment(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.depth)).astype(np.int64) if self.depth else np.zeros(len(hashes), np.int64)


def key_hashes(texts: DataFrame, plan: Plan, min_chars: int) -> DataFrame:
    """segment, hashes, again (a byte a hash: found in two documents of the block) for blocks of documents."""

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(np.concatenate(held), return_counts=True)
        segments = plan.segment(hashes)
        cuts = np.flatnonzero(np.diff(segments)) + 1
        for s, h, c in zip(segments[np.concatenate([[0], cuts])].tolist(), np.split(hashes, cuts), np.split(counts > 1, cuts), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())], names=["segment", "hashes", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for data in batch.column("data"):
                keys = [k for k in set(line_keys(data.as_py())) if long_enough(k, min_chars)]
                if keys:
                    held.append(np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    n += len(keys)
                if n >= BLOCK_KEYS:
                    yield from sent(held)
                    held, n = [], 0
        if held:
            yield from sent(held)

    return texts.select("data").mapInArrow(run, "segment long, hashes binary, again binary")


def twice_filter(blocks: DataFrame, plan: Plan) -> DataFrame:
    """segment, bits: the filter of hashes that came twice, one row for each segment that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, once, twice = None, None, None

        def done() -> Iterator[pa.RecordBatch]:
            if own is not None and twice.any():
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([twice.tobytes()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for segment, hashes, again in zip(batch.column("segment").to_pylist(), batch.column("hashes"), batch.column("again"), strict=True):
                if segment != own:
                    yield from done()
                    own, once, twice = segment, np.zeros(plan.once // 8, np.uint8), np.zeros(plan.twice // 8, np.uint8)
                found = np.frombuffer(hashes.as_py(), np.uint64)
                at = places(found, plan.once)
                repeated = hit(once, at) | np.frombuffer(again.as_py(), bool)
                fill(once, at)
                fill(twice, places(found[repeated], plan.twice))
        yield from done()

    return blocks.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, "segment long, bits binary")


def suspected(texts: DataFrame, plan: Plan, min_chars: int, filters: dict[int, bytes]) -> DataFrame:
    """doc_id, digest, high, low (128-bit hash of a key) and lines of every key of texts that hits the filter."""
    shared = texts.sparkSession.sparkContext.broadcast(filters)
    none = np.zeros(plan.twice // 8, np.uint8).tobytes()

    def hits(hashes: np.ndarray) -> np.ndarray:
        out, segments, at = np.zeros(len(hashes), bool), plan.segment(hashes), places(hashes, plan.twice)
        for s in np.unique(segments).tolist():
            out[own] = hit(np.frombuffer(shared.value.get(s, none), np.uint8), at[own := segments == s])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, high, low, lines = [], [], [], []
            for i, data in enumerate(batch.column("data")):
                where: dict[bytes, list[int]] = {}
                for number, key in enumerate(line_keys(data.as_py())):
                    where.setdefault(key, []).append(number)
                keys = [k for k in where if long_enough(k, min_chars)]
                if not keys:
                    continue
                for k in np.flatnonzero(hits(np.fromiter(map(xxh3_64_intdigest, keys), np.uint64, len(keys)))).tolist():
                    whole = xxh3_128_intdigest(keys[k])
                    owners.append(i)
                    high.append(whole >> 64)
                    low.append(whole & 0xFFFFFFFFFFFFFFFF)
                    lines.append(where[keys[k]])
            taken = batch.select(OWNER).take(pa.array(owners, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (high, low)), pa.array(lines, pa.list_(pa.int32()))], names=[*OWNER, "high", "low", "lines"])

    return texts.select(*OWNER, "data").mapInArrow(run, "doc_id long, digest string, high long, low long, lines array<int>")


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, keep_first: bool = False, digest: bool = False, segment_keys: int = SEGMENT_KEYS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, n_lines, n_dropped, left (the text that is left, as bytes; with digest its SHA-256 in hex) of every row of docs (doc_id, text).

    Lines go whose key is in at least min_docs (two or more) documents; with keep_first the first line with the key stays.
    """
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.md5(text.cast("binary")).alias("digest"), text.cast("binary").alias("data"))
    lines = docs.agg(F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"))) + 1).alias("n")).first().n or 0
    plan = Plan(lines, segment_keys, filter_bytes)
    pieces = kept(twice_filter(key_hashes(texts, plan, min_chars), plan))
    # at most filter_bytes in all, whatever the input
    filters = {r.segment: bytes(r.bits) for r in pieces.toLocalIterator()}
    release(pieces)
    found = kept(suspected(texts, plan, min_chars, filters))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", F.col("lines")[0].alias("line"))
    confirmed = kept(found.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("first")).where(F.col("n") >= min_docs).select("high", "low", "first"))
    own = salted_join(found, confirmed, ["high", "low"], F.xxhash64(*OWNER))
    gone = F.when(place == F.col("first"), F.slice("lines", 2, F.size("lines"))).otherwise(F.col("lines")) if keep_first else F.col("lines")
    gone = kept(own.groupBy(*OWNER).agg(F.array_distinct(F.flatten(F.collect_set(gone))).alias("gone")))
    same = texts.doc_id.eqNullSafe(gone.doc_id) & (texts.digest == gone.digest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, numbers in zip(batch.column("data"), batch.column("gone"), strict=True):
                data, dropped = data.as_py(), numbers.as_py() or []
                parts = data.split(b"\n")
                if dropped:
                    lost = set(dropped)
                    data = b"\n".join([p for i, p in enumerate(parts) if i not in lost])
                out.append((len(parts), len(dropped), hashlib.sha256(data).hexdigest() if digest else data))
            n, lost, left = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.string() if digest else pa.binary())], names=["doc_id", "n_lines", "n_dropped", "left"])

    joined = texts.join(gone, same, "left").select(texts.doc_id, "data", "gone")
    return joined.mapInArrow(cut, f"doc_id long, n_lines long, n_dropped long, left {'string' if digest else 'binary'}")


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(documents(spark, sf_dir), digest=True).withColumnRenamed("left", "kept_sha256")


CHECK = r"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), numbered as (
  select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs
), keyed as (
  select r, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from numbered
), many as (
  select k from keyed where k <> '' group by k having count(distinct r) >= 10
), judged as (
  select keyed.*, many.k is not null as gone from keyed left join many using (k)
), told as (
  select r, count(*) as n_lines, count(*) filter (gone) as n_dropped, coalesce(string_agg(line, chr(10) order by i) filter (not gone), '') as left_text from judged group by r
)
select doc_id, n_lines, n_dropped, sha256(left_text) as kept_sha256 from docs join told using (r)
"""
