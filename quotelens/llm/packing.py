"""Best-fit packing by swap-based local search.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt at random to shards of a bounded number of rows;
each shard is packed best-fit and then improved: pieces move between underfull sequences, or are exchanged one for one or
two for one, as long as the sum of squared fills rises, until sequences run empty. Sequences that are still open are dealt
anew to fewer shards, until one shard is left or a round closes and empties few of them. Only the rows of open sequences move on.

Null text is an empty document of one token (the end id). Repeated rows and ids are pieces of their own, null ids pass
through, ties of length are broken by position in the shard, an empty table gives no rows. Nothing is dropped.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents, kept
from quotelens.llm.tokens import WhiteSpace, encoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
END = 1
#: Pieces of a shard, on average.
SHARD = 2000
#: A sequence filled to this share is closed; fuller ones gain nothing from another round.
CLOSED = 0.99
#: Another round is worth its while if it leaves at most this share of the open sequences.
GAIN = 0.9
#: Exchanges tried in a shard for each of its pieces.
STEPS = 4


def pieces(docs: DataFrame, path: str = VOCABULARY, end: int = END, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids (little-endian unsigned 32-bit integers) of every piece of every document."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, step = encoder(path, WhiteSpace), end.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = known.encode(text.as_py()) + last
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t) for _, t in fields], names=[n for n, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that has room."""
    bins, room = [], []  # room: (free, bin), ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        k = bisect_left(room, (n, -1))
        free, b = room.pop(k) if k < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
        if free > n:
            insort(room, (free - n, b))
    return bins


class LocalSearch:
    """Empties underfull sequences, least filled first, while the others have room for all of it. Every step moves fill from a sequence to one at least as full, so the sum of squares rises."""

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.lengths, self.bins, self.capacity = lengths, bins, capacity
        self.fill = np.array([int(lengths[b].sum()) for b in bins], dtype=np.int64)

    def run(self, steps: int) -> list[list[int]]:
        tried: set[int] = set()
        while steps > 0:
            source = min((b for b in np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist() if b not in tried), key=lambda b: self.fill[b], default=None)
            if source is None or self.room() < self.fill[source]:
                break  # the others can't take all of it, nor all of any fuller one
            while self.bins[source] and steps > 0 and self.step(source):
                steps -= 1
            tried.add(source)
        return [b for b in self.bins if b]

    def room(self) -> int:
        """Free places of all sequences but the least filled."""
        used = self.fill[self.fill > 0]
        return int(self.capacity * (len(used) - 1) - (used.sum() - used.min())) if len(used) else 0

    def step(self, source: int) -> bool:
        others = np.flatnonzero((self.fill >= self.fill[source]) & (self.fill < self.capacity))
        others = others[others != source]
        if not len(others):
            return False
        room = self.capacity - self.fill
        own = sorted(self.bins[source], key=lambda i: -self.lengths[i])
        free = room[others]
        for x in own:  # move
            fits = np.flatnonzero(free >= self.lengths[x])
            if len(fits):
                return self.exchange(source, [x], int(others[fits[np.argmin(free[fits])]]), [])
        theirs = np.array([i for b in others for i in self.bins[b]])
        at = np.repeat(others, [len(self.bins[b]) for b in others])
        sizes, free = self.lengths[theirs], room[at]
        pairs = [(a, b) for k, a in enumerate(own) for b in own[k + 1 :]][: 4 * len(own)]
        for out in [[x] for x in own] + [list(p) for p in pairs]:  # one for one, two for one
            gain = int(self.lengths[out].sum()) - sizes
            good = np.flatnonzero((gain > 0) & (gain <= free))
            if len(good):
                k = good[np.argmin((free - gain)[good])]
                return self.exchange(source, out, int(at[k]), [int(theirs[k])])
        for b in others.tolist():  # one for two
            items = np.array(self.bins[b])
            if len(items) < 2:
                continue
            i, j = np.triu_indices(len(items), 1)
            sums = self.lengths[items[i]] + self.lengths[items[j]]
            for x in own:
                gain = int(self.lengths[x]) - sums
                good = np.flatnonzero((gain > 0) & (gain <= room[b]))
                if len(good):
                    k = good[np.argmax(gain[good])]
                    return self.exchange(source, [x], b, [int(items[i[k]]), int(items[j[k]])])
        return False

    def exchange(self, a: int, out: list[int], b: int, back: list[int]) -> bool:
        gain = int(self.lengths[out].sum()) - int(self.lengths[back].sum() if back else 0)
        self.bins[a] = [i for i in self.bins[a] if i not in out] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + out
        self.fill[a] -= gain
        self.fill[b] += gain
        return True


def _shard_packer(turn: int, capacity: int, columns: list[str]):
    def packed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_numpy()
        sequence, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        for k, members in enumerate(LocalSearch(lengths, best_fit(lengths, capacity), capacity).run(STEPS * len(lengths))):
            ends = np.cumsum(lengths[members])
            sequence[members], offset[members], fill[members] = k, ends - lengths[members], ends[-1]
        # the turn, the shard and the place in it: a shard's rows are bounded, so the parts never meet
        sequence += (turn << 31) + key[0].as_py() << 24
        return pa.table([*(rows.column(c) for c in columns), pa.array(sequence), pa.array(offset), pa.array(fill)], names=[*columns, "sequence_id", "offset", "fill"])

    return packed


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Adds sequence_id, offset and fill to rows that have a length of 1 to capacity. Rows need no key."""
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset", "fill", "_shard")]
    left = rows.select(columns)
    schema = f"{left._jdf.schema().toDDL()}, sequence_id LONG, offset LONG, fill LONG"
    done, n, before, turn = [], left.count(), None, 0
    while True:
        shards = max(1, -(-n // shard))

        dealt = left.withColumn("_shard", F.floor(F.rand(turn) * shards).cast("long"))
        out = kept(dealt.groupBy("_shard").applyInArrow(_shard_packer(turn, capacity, columns), schema))
        still = out.where(F.col("fill") < int(CLOSED * capacity))
        n, bins = still.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if shards == 1 or n == 0 or (before is not None and bins > GAIN * before):
            done.append(out)
            break
        done.append(out.where(F.col("fill") >= int(CLOSED * capacity)))
        left, before, turn = still.select(columns), bins, turn + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the ids of each sequence in order; a group is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))


def packed_documents(docs: DataFrame) -> DataFrame:
    rows = kept(pieces(docs, with_ids=False))
    return pack(rows).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
