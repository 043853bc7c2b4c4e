"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints: bit by bit the majority of the hashes of a text's word shingles, one or several words of 64 bits. Search,
over distinct fingerprints by their first word:

1. Bits that go together are grouped into partitions, by their correlation over all fingerprints.
2. Each partition i gets a threshold t_i, -1 meaning that it is not looked at, with sum(t_i + 1) = distance + 1: two
   fingerprints within the distance must differ in at most t_i bits of some partition. A dynamic program picks the t_i with
   the least expected work, for each number of partitions, from how often fingerprints meet in each partition.
3. Every fingerprint is filed under its bits of a partition and under all variants within half of t_i, so that any two
   within t_i meet. Those that meet under a key are verified by counting all differing bits.
4. Within a group a search from neighbour to neighbour yields a spanning forest of the links, never all pairs. A key with
   more fingerprints than ``GROUP`` is opened in blocks, each pair of blocks on its own, so that no task holds more. The
   forests' edges are joined to components.

Null text and texts without words have the fingerprint zero, linked like any other; texts with fewer words than a shingle
are one shingle. Copies are one fingerprint with its smallest doc_id; a null doc_id counts as largest. Repeated rows give
repeated results, an empty table none; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quotelens.llm.components import components
from quotelens.llm.tables import documents, kept
from quotelens.llm.windows import mixed
from quotelens.operators.skew import salted_join

BITS, SHINGLE, SEED, DISTANCE = 64, 4, 42, 4
#: Fingerprints that one task compares at a time.
GROUP = 16384
#: Cost of filing a key, in comparisons of a pair: some 2 microseconds for making, shuffling and sorting its row of 20 to 50 bytes.
KEY_COST = 2000.0
LOWERED = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 with the seed of every word shingle of the text, repeats included."""
    parts = (text or "").encode().translate(LOWERED).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(w) + 1 for w in parts])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[min(shingle, len(parts)) - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(stops))  # noqa: B905


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1, once: bool = False) -> np.ndarray:
    """The words of the fingerprint; the first from XXH64 with the seed, the others from mixtures of that hash. With once, repeated shingles count once."""
    hashes = shingle_hashes(text, shingle)
    return fingerprint_of(np.unique(hashes) if once else hashes, words)


def fingerprint_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """The words of the fingerprint of shingle hashes."""
    out = np.zeros(words, np.uint64)
    for k in range(words if len(hashes) else 0):
        own = hashes if not k else mixed(hashes + np.uint64(k))
        set_bits = np.zeros(BITS, np.int64)
        for at in range(0, len(own), 8192):
            set_bits += bits_of(own[at : at + 8192]).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * set_bits > len(own), bitorder="little").view("<u8")[0]
    return out


def node_of(fps: np.ndarray) -> np.ndarray:
    """One long for each row of words: the only word itself, or a hash of all."""
    out = fps[:, 0].copy()
    for k in range(1, fps.shape[1]):
        out = mixed(out + np.uint64(k)) ^ fps[:, k]
    return out.view(np.int64)


def columns_of(words: int) -> list[str]:
    return [f"fp{k}" for k in range(words)]


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1, once: bool = False) -> DataFrame:
    """doc_id, text_hash (to tell rows with the same id apart), node and the fingerprint's words fp0 ... (signed longs) of every row of docs (doc_id, text)."""
    names = columns_of(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, words, once) for t in batch.column("text")], np.uint64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(node_of(fps)), *(pa.array(fps[:, k].copy().view(np.int64)) for k in range(words))], names=["doc_id", "text_hash", "node", *names])

    tagged = docs.select("doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return tagged.mapInArrow(run, "doc_id long, text_hash int, node long, " + ", ".join(f"{c} long" for c in names))


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both bits i and j: a 64 x 64 table, summed up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            b = bits_of(batch.column("fp0").to_numpy()).astype(np.float32)
            n, both = n + len(b), both + b.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    cells = distinct.select("fp0").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS + 1)
    for cell, n in cells:
        out[cell] = n
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal size; each is begun by the free bit with most correlation left and takes the bits that go with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    together = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(together, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (together[b, free].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in free if b not in group), key=lambda b: (together[b, group].sum(), -b)))
        out.append(sorted(group))
        free = [b for b in free if b not in group]
    return out


def meetings(n: int, both: np.ndarray, bits: list[int], t: int) -> float:
    """Expected pairs of fingerprints that differ in at most t of these bits, if bits are independent with the observed shares."""
    p = np.diag(both)[bits] / max(n, 1)
    differ = 2 * p * (1 - p)
    chance = np.zeros(t + 1)
    chance[0] = 1.0
    for d in differ:
        chance[1:] = chance[1:] * (1 - d) + chance[:-1] * d
        chance[0] *= 1 - d
    return float(chance.sum()) * n * n / 2


def plan(n: int, both: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """The cheapest partitions with the number of bits to vary in each; those without a share are left out."""
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, distance + 2):
        groups = grouped_bits(n, both, parts)
        # handing out t + 1 units lets both sides vary ceil(t / 2) bits
        price = [[0.0, *(KEY_COST * n * sum(comb(len(g), k) for k in range(-(-t // 2) + 1)) + meetings(n, both, g, 2 * -(-t // 2)) for t in range(min(distance, 8) + 1))] for g in groups]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in price:  # table: cheapest way to hand out so many units
            after: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, chosen) in table.items():
                for units, more in enumerate(row[: distance + 2 - used]):
                    if used + units not in after or cost + more < after[used + units][0]:
                        after[used + units] = (cost + more, [*chosen, units - 1])
            table = after
        if distance + 1 not in table:
            continue
        cost, chosen = table[distance + 1]
        if best is None or cost < best[0]:
            best = cost, [(g, -(-t // 2)) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    return best[1]


@lru_cache(maxsize=64)
def variants(bits: tuple[int, ...], t: int) -> np.ndarray:
    """Masks that flip at most t of the bits."""
    masks = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
    return np.array(masks, np.uint64)


def forest(fps: np.ndarray, near: int, distance: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect exactly what links connect: from each fingerprint to neighbours not met before."""
    left, edges = np.arange(len(fps)), []
    first, rest = fps[:, 0].copy(), fps[:, 1:]
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            close = np.flatnonzero(np.bitwise_count(first[left] ^ first[x]) <= near)
            if len(close) and rest.shape[1]:
                at = left[close]
                close = close[np.bitwise_count(first[at] ^ first[x]).astype(int) + np.bitwise_count(rest[at] ^ rest[x]).sum(axis=1, dtype=int) <= distance]
            if len(close):
                met = left[close]
                edges += [(x, y) for y in met]
                front += list(met)
                left = np.delete(left, close)
    return edges


def filed(fps: DataFrame, scheme: list[tuple[list[int], int]], words: int) -> DataFrame:
    """Each fingerprint under its key in every partition and under all variants of it."""
    tables = [(np.uint64(sum(1 << int(b) for b in bits)), variants(tuple(bits), t)) for bits, t in scheme]
    names = columns_of(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                own = part.column("fp0").to_numpy().view(np.uint64)
                for i, (mask, flips) in enumerate(tables):
                    keys = ((own & mask)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                    rows = pa.array(np.repeat(np.arange(len(own)), len(flips)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), *(part.column(c).take(rows) for c in names)], names=["part", "key", *names])

    return fps.select(*names).mapInArrow(run, "part int, key long, " + ", ".join(f"{c} long" for c in names))


def large_keys(distinct: DataFrame, scheme: list[tuple[list[int], int]], group: int) -> DataFrame:
    """part, key, n of the keys under which more than group fingerprints are filed.

    Counted from the fingerprints' own keys, which are few where a partition has few bits; variants are made of their counts.
    """
    tables = [(np.uint64(sum(1 << int(b) for b in bits)), variants(tuple(bits), t)) for bits, t in scheme]
    shape, names = "part int, key long, n long", ["part", "key", "n"]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp0").to_numpy().view(np.uint64)
            for i, (mask, _) in enumerate(tables):
                keys, n = np.unique(fps & mask, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=names)

    def varied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, keys, n = (batch.column(c).to_numpy() for c in names)
            for i in np.unique(parts).tolist():
                mine, flips = parts == i, tables[i][1]
                more = (keys[mine].view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(more), i, np.int32)), pa.array(more), pa.array(np.repeat(n[mine], len(flips)))], names=names)

    summed = lambda d: d.groupBy("part", "key").agg(F.sum("n").alias("n"))
    counted = summed(distinct.select("fp0").mapInArrow(own, shape))
    return summed(counted.select(*names).mapInArrow(varied, shape)).where(F.col("n") > group)


def forests(rows: DataFrame, by: list[str], near: int, distance: int, words: int) -> DataFrame:
    """a, b: nodes of the edges that connect, within each group of rows, what links connect. A row alone in its group costs next to nothing."""
    names = columns_of(words)

    def edges_of(batch: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        fps = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)
        nodes, out = node_of(fps), []
        pairs = starts[ends - starts == 2]
        differ = np.bitwise_count(fps[pairs] ^ fps[pairs + 1]).astype(np.int64)
        linked = pairs[(differ[:, 0] <= near) & (differ.sum(axis=1) <= distance) & (nodes[pairs] != nodes[pairs + 1])]
        out.append(np.stack([linked, linked + 1], axis=1))
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            own = a + np.unique(nodes[a:b], return_index=True)[1]
            out.append(own[np.array(forest(fps[own], near, distance), np.int64).reshape(-1, 2)])
        edges = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(nodes[edges[:, 0]]), pa.array(nodes[edges[:, 1]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the group that is not complete yet

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            whole = pa.concat_batches(held)
            changes = np.zeros(whole.num_rows - 1, bool)
            for c in by:
                values = whole.column(c).to_numpy()
                changes |= values[1:] != values[:-1]
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
            ends = np.append(starts[1:], whole.num_rows)
            done = len(starts) if last else len(starts) - 1
            held[:] = [] if last else [whole.slice(int(starts[-1]))]
            if done:
                yield edges_of(whole, starts[:done], ends[:done])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                yield from cut(False)
        if held:
            yield from cut(True)

    return rows.select(*by, *names).repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, scheme: list[tuple[list[int], int]], near: int, distance: int, words: int, group: int) -> DataFrame:
    """a, b: nodes of edges that connect all fingerprints within the distances of each other, directly or through others."""
    return met_under(filed(distinct, scheme, words), large_keys(distinct, scheme, group), near, distance, words, group)


def met_under(keys: DataFrame, crowded: DataFrame, near: int, distance: int, words: int, group: int) -> DataFrame:
    """a, b: nodes of edges that connect what links connect under each key (part, key, fp0 ...); crowded: part, key, n of keys with more than group rows."""
    names = columns_of(words)
    large = kept(crowded.select("part", "key", F.ceil(2 * F.col("n") / group).cast("int").alias("blocks")))
    if not large.take(1):
        return forests(keys, ["part", "key"], near, distance, words)
    small = forests(keys.join(large, ["part", "key"], "left_anti"), ["part", "key"], near, distance, words)
    own = F.pmod(F.xxhash64(*names), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocks = keys.join(large, ["part", "key"]).withColumn("own", own).withColumn("other", other)
    blocks = blocks.select("part", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), *names)
    return small.unionByName(forests(blocks, ["part", "key", "x", "y"], near, distance, words))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, near: int = DISTANCE, words: int = 1, distance: int | None = None, group: int = GROUP, once: bool = False) -> DataFrame:
    """doc_id, text_hash, node, fp0, component (its smallest node), component_id (smallest doc_id reachable) of every row of docs (doc_id, text).

    Documents link where the first words of their fingerprints differ in at most near bits and all words in at most
    distance bits (near, if not given). With once, a shingle counts once however often a text has it.
    """
    own = kept(fingerprints(docs, shingle, words, once))
    distinct = kept(own.groupBy("node", *columns_of(words)).agg(F.min("doc_id").alias("first_id")))
    n, both = bit_counts(distinct)
    own = own.select("doc_id", "text_hash", "node", "fp0")
    if n < 2:
        return own.join(distinct.select("node", "first_id"), "node").select("doc_id", "text_hash", "node", "fp0", F.col("node").alias("component"), F.col("first_id").alias("component_id"))
    edges = kept(links(distinct, plan(n, both, near), near, near if distance is None else distance, words, group))
    member = kept(components(edges))
    ids = distinct.select("node", "first_id")
    first = member.join(ids, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = salted_join(ids.join(member, "node", "left"), first, ["component"], F.hash("node"), how="left")
    known = kept(named.select("node", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")))
    return own.join(known, "node")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")
