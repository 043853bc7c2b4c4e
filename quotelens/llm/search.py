"""Ranked lexical search by Block-Max MaxScore over an index in shards of documents.

Index. A task cuts its documents into shards and writes, for each shard, a row with the documents' ids and lengths and a
row for each term: document frequency, the blocks in which it stands (a block is ``BLOCK`` neighbouring documents), the
largest impact in each of them, and the postings of each block, compressed. The impact of a posting is what its term's
weight is multiplied by in the score; it needs only the number of terms of all documents, which one pass sums up first.

Search. Queries are read in blocks of bounded size. Only rows of their terms are sent to the tasks that own the shards. A
task keeps a heap of the best documents of each query across its shards, whose last score is the query's threshold:

1. Lists are ordered by their largest possible contribution. Those that together stay under the threshold are not
   essential: a document that stands in these alone cannot enter the heap.
2. Block by block, the essential lists yield candidates with partial scores. A candidate whose score and the block maxima
   of the other lists do not reach the threshold is rejected before any of those lists' postings are decompressed.
3. The other lists follow, the largest first, with the same test after each of them.

The heaps of all tasks are merged by query. Bounds are whole numbers and a document goes only if it is strictly under the
threshold, so the result equals that of scoring every document.

Null and empty texts have no term: no document ranks for such a query, and such documents rank for none. Repeated rows of
either table count as rows of their own: an item that stands there twice gets its ranks twice. Equal scores go by doc_id,
null last. Empty tables give no rows; further columns are left aside. Whole texts of any length are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quotelens.llm.tables import documents, kept

TOP = 20
#: Documents of a block (their places fit a byte) and of a shard; bytes of text after which a shard ends.
BLOCK, SHARD_DOCS, SHARD_BYTES = 256, 8192, 1 << 24
#: Terms of all queries of a block; bounds what is sent to every task.
QUERY_TERMS = 200_000

#: UTF-8 bytes: ASCII letters lower-cased, digits and all bytes beyond ASCII as they are, all else a space.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERM_BYTES).split()


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and all documents' terms."""

    docs: int
    terms: int

    def impacts(self, tf: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        m = 75 + 25 * lengths * self.docs // max(self.terms, 1)
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def totals(docs: DataFrame) -> Totals:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = terms = 0
        for batch in batches:
            for text in batch.column("text"):
                n = len(terms_of(text.as_py()))
                found, terms = found + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64()), pa.array([terms], pa.int64())], names=["docs", "terms"])

    row = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return Totals(row.docs or 0, row.terms or 0)


INDEX = pa.schema(
    [("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("blocks", pa.list_(pa.int32())), ("maxima", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)
INDEX_DDL = "shard long, term binary, df long, blocks array<int>, maxima array<long>, ends array<int>, postings binary, doc_ids array<long>, lengths array<long>"


def varbytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each value): seven bits a byte, the lowest first, the high bit set where more follow."""
    sizes = np.ones(len(values), np.int64)
    for shift in range(7, 63, 7):
        more = values >> shift > 0
        if not more.any():
            break
        sizes += more
    out, at, left = np.zeros(int(sizes.sum()), np.uint8), np.cumsum(sizes) - sizes, values.copy()
    for place in range(int(sizes.max(initial=0))):
        own = sizes > place
        out[at[own] + place] = (left[own] & 127) | np.where(sizes[own] > place + 1, 128, 0)
        left >>= 7
    return out, sizes


def unvaried(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


def ragged(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Lists of values that begin at starts."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(values)]]).astype(np.int32)), pa.array(values, kind))


def numbering() -> defaultdict[bytes, int]:
    """Numbers words in the order in which they are first looked up."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def numbered(words: list[bytes], numbers: defaultdict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))


def shard_rows(shard: int, doc_ids: list, words: list[bytes], lengths: np.ndarray, all_docs: Totals) -> Iterator[pa.RecordBatch]:
    numbers = numbering()
    yield from index_rows(shard, doc_ids, numbered(words, numbers), numbers, lengths, all_docs)


def index_rows(shard: int, doc_ids: list, ids: np.ndarray, numbers: dict[bytes, int], lengths: np.ndarray, all_docs: Totals) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard: that of its documents, then its terms in order. ids: numbers of all documents' terms in a row."""
    none = [pa.nulls(1, f.type) for f in INDEX][1:7]
    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *none, pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int64()))], schema=INDEX)
    if not len(ids):
        return
    vocabulary = sorted(numbers)
    rank = np.empty(len(numbers), np.int64)
    rank[np.fromiter(map(numbers.__getitem__, vocabulary), np.int64, len(vocabulary))] = np.arange(len(vocabulary))
    n = len(doc_ids)
    pairs, tf = np.unique(rank[ids] * n + np.repeat(np.arange(n), lengths), return_counts=True)
    term, doc = np.divmod(pairs, n)
    impacts = all_docs.impacts(tf.astype(np.int64), lengths[doc])

    cell = term * (n // BLOCK + 1) + doc // BLOCK  # a term's postings in a block
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    held = np.diff(np.concatenate([first, [len(cell)]]))
    coded, sizes = varbytes(tf.astype(np.int64))
    coded_end = np.cumsum(sizes)
    coded_first = coded_end[first] - sizes[first]
    coded_bytes = np.add.reduceat(sizes, first)
    cell_bytes = 1 + held + coded_bytes
    cell_first = np.cumsum(cell_bytes) - cell_bytes
    # a block: the number of its postings less one, their places, their coded frequencies
    payload = np.empty(int(cell_bytes.sum()), np.uint8)
    payload[cell_first] = held - 1
    payload[np.repeat(cell_first + 1 - first, held) + np.arange(len(cell))] = doc % BLOCK
    payload[np.repeat(cell_first + 1 + held - coded_first, coded_bytes) + np.arange(len(coded))] = coded

    term_first = np.flatnonzero(np.concatenate([[True], term[first][1:] != term[first][:-1]]))
    byte_first = cell_first[term_first]
    ends = cell_first + cell_bytes - np.repeat(byte_first, np.diff(np.concatenate([term_first, [len(first)]])))
    k = len(vocabulary)
    offsets = pa.array(np.concatenate([byte_first, [len(payload)]]).astype(np.int32))
    columns = [
        pa.array(np.full(k, shard)), pa.array(vocabulary, pa.binary()), pa.array(np.bincount(term, minlength=k)),
        ragged((doc[first] // BLOCK).astype(np.int32), term_first, pa.int32()), ragged(np.maximum.reduceat(impacts, first), term_first, pa.int64()), ragged(ends.astype(np.int32), term_first, pa.int32()),
        pa.BinaryArray.from_buffers(pa.binary(), k, [None, offsets.buffers()[1], pa.py_buffer(payload.tobytes())]), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int64())),
    ]
    whole = pa.RecordBatch.from_arrays(columns, schema=INDEX)
    for at in range(0, k, 20_000):
        yield whole.slice(at, 20_000)


def build_index(docs: DataFrame, all_docs: Totals, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs (doc_id, text), kept in the shared folder; see INDEX_DDL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 31
        doc_ids, ids, numbers, size = [], [], numbering(), 0

        def done() -> Iterator[pa.RecordBatch]:
            yield from index_rows(shard, doc_ids, np.concatenate(ids), numbers, np.array([len(x) for x in ids], np.int64), all_docs)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = terms_of(text.as_py())
                doc_ids.append(doc_id)
                ids.append(numbered(own, numbers))
                size += sum(map(len, own))
                if len(doc_ids) == shard_docs or size >= shard_bytes:
                    yield from done()
                    shard, doc_ids, ids, numbers, size = shard + 1, [], [], numbering(), 0
        if doc_ids:
            yield from done()

    return kept(docs.select("doc_id", "text").mapInArrow(run, INDEX_DDL))


class Postings:
    """One term's list in one shard; blocks are decompressed when they are asked for."""

    def __init__(self, blocks: np.ndarray, maxima: np.ndarray, ends: np.ndarray, data: np.ndarray, all_blocks: int):
        self.maxima = np.zeros(all_blocks, np.int64)
        self.maxima[blocks] = maxima
        self.most = int(maxima.max())
        self.bounds = {int(b): (int(a), int(e)) for b, a, e in zip(blocks, np.concatenate([[0], ends[:-1]]), ends, strict=True)}
        self.data = data
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int, lengths: np.ndarray, all_docs: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block and their impacts; remembered while the shard is searched."""
        if b not in self.open:
            start, end = self.bounds[b]
            middle = start + 2 + int(self.data[start])
            at = self.data[start + 1 : middle].astype(np.int64)
            self.open[b] = at, all_docs.impacts(unvaried(self.data[middle:end]), lengths[b * BLOCK + at])
        return self.open[b]


class Heap:
    """The best documents of a query so far."""

    def __init__(self, top: int):
        self.top, self.scores, self.ids, self.none, self.least = top, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        best = np.lexsort((ids, none, -scores))[: self.top]
        self.scores, self.ids, self.none = scores[best], ids[best], none[best]
        if len(best) == self.top:
            self.least = int(self.scores[-1])


def search_shard(query: list[tuple[bytes, int]], lists: dict[bytes, Postings], doc_ids: np.ndarray, none: np.ndarray, lengths: np.ndarray, all_docs: Totals, heap: Heap) -> None:
    """Offers the heap every document of the shard that can enter it."""
    own = [(w, lists[t]) for t, w in query if t in lists]
    if not own:
        return
    own.sort(key=lambda x: x[0] * x[1].most)
    reach = np.cumsum([w * p.most for w, p in own])
    bounds = np.array([w * p.maxima for w, p in own])
    in_block = bounds.sum(axis=0)
    for b in np.flatnonzero(in_block >= heap.least).tolist():
        if in_block[b] < heap.least:
            continue
        essential = int(np.searchsorted(reach, heap.least))  # lists before it stay under the threshold together
        scores = np.zeros(min(BLOCK, len(lengths) - b * BLOCK), np.int64)
        for i in range(essential, len(own)):
            if bounds[i, b]:
                at, impacts = own[i][1].block(b, lengths, all_docs)
                scores[at] += own[i][0] * impacts
        rest = int(bounds[:essential, b].sum())
        left = np.flatnonzero(scores)
        left = left[scores[left] + rest >= heap.least]
        for i in range(essential - 1, -1, -1):
            if not len(left):
                break
            if bounds[i, b]:
                rest -= int(bounds[i, b])
                at, impacts = own[i][1].block(b, lengths, all_docs)
                scores[at] += own[i][0] * impacts
                left = left[scores[left] + rest >= heap.least]
        if len(left):
            heap.offer(scores[left], doc_ids[left + b * BLOCK], none[left + b * BLOCK])


FOUND = "query long, doc_id long, score long"


def best_of_tasks(rows: DataFrame, queries: dict[int, list[tuple[bytes, int]]], all_docs: Totals, top: int) -> DataFrame:
    """query, doc_id, score: the heaps of all tasks. rows: index rows of the queries' terms and of all shards' documents."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {q: Heap(top) for q in shared.value}
        shard, lists, docs = None, {}, None

        def search() -> None:
            if lists:
                for q, query in shared.value.items():
                    search_shard(query, lists, *docs, all_docs, heaps[q])

        for batch in batches:
            for i, own in enumerate(batch.column("shard").to_pylist()):
                if own != shard:
                    search()
                    shard, lists, docs = own, {}, None
                row = lambda name, i=i, batch=batch: batch.column(name)[i]
                if not row("term").is_valid:
                    ids = row("doc_ids").values
                    docs = ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), row("lengths").values.to_numpy()
                else:
                    blocks, maxima, ends = (row(c).values.to_numpy() for c in ("blocks", "maxima", "ends"))
                    lists[row("term").as_py()] = Postings(blocks, maxima, ends, np.frombuffer(row("postings").as_py(), np.uint8), len(docs[0]) // BLOCK + 1)
        search()
        for q, h in heaps.items():
            if len(h.ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h.ids), q)), pa.array(h.ids, mask=h.none), pa.array(h.scores)], names=["query", "doc_id", "score"])

    # the row of a shard's documents has no term and so comes first
    return rows.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first()).mapInArrow(run, FOUND)


def query_terms(queries: DataFrame) -> DataFrame:
    """query, term, tf of queries (query, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, text in zip(batch.column("query").to_pylist(), batch.column("text"), strict=True):
                terms, counts = np.unique(np.array(terms_of(text.as_py()), object), return_counts=True) if text.as_py() else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(terms), pa.int64()), pa.array(list(terms), pa.binary()), pa.array(counts, pa.int64())], names=["query", "term", "tf"])

    return queries.select("query", "text").mapInArrow(run, "query long, term binary, tf long")


def search(index: DataFrame, all_docs: Totals, queries: DataFrame, top: int = TOP, block_terms: int = QUERY_TERMS) -> DataFrame:
    """query, rank, doc_id, score of the queries (query, text), whose numbers are unique."""
    spark = index.sparkSession
    terms = kept(query_terms(queries))
    blocks = max(1, -(-terms.count() // block_terms))
    found = None
    for b in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        wanted = F.broadcast(own.select("term").distinct())  # at most block_terms, or one query's terms
        counted = {bytes(r.term): r.df for r in index.join(wanted, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        package: dict[int, list[tuple[bytes, int]]] = {}
        for r in own.collect():
            if bytes(r.term) in counted and (w := all_docs.weight(counted[bytes(r.term)])) > 0:
                package.setdefault(r.query, []).append((bytes(r.term), w * r.tf))
        if not package:
            continue
        rows = index.join(wanted, "term", "left_semi").unionByName(index.where("term is null"))
        part = best_of_tasks(rows, package, all_docs, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = kept(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id"), F.col("text").cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()))
    docs = documents(spark, sf_dir)
    all_docs = totals(docs)
    ranked = search(build_index(docs, all_docs), all_docs, items)
    return ranked.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


CHECK = r"""
with words as (
  select r, doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from (select row_number() over () as r, doc_id, text from documents)
), counted as (
  select r, doc_id, t, count(*) as tf from words group by all
), sizes as (
  select r, sum(tf)::bigint as n from counted group by r
), whole as (
  select count(*) as d, sum(n)::bigint as l from sizes
), weights as (
  select t, floor(1000 * ln((2 * d + 2)::double / (2 * count(*) + 1)))::bigint as w from counted, whole group by t, d
), asked as (
  select q, item_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from (select row_number() over () as q, item_id, text from benchmark)
), queries as (
  select q, item_id, t, count(*) as qtf from asked group by all
), scored as (
  select q, item_id, doc_id, r, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * d) // l))))::bigint as score
  from queries join weights using (t) join counted using (t) join sizes using (r), whole group by all
)
select item_id, row_number() over w as rank, doc_id, score from scored where score > 0
window w as (partition by q order by score desc, doc_id) qualify row_number() over w <= 20
"""
