"""Repeated windows of fixed length, found without an index entry for every position.

Units are bytes or words; a window is ``size`` units. All grams of size / 2 units are hashed, and the gram with the smallest
hash inside a window (the leftmost, if several are alike) is its mark. Equal windows have equal marks at the same place,
and neighbouring windows mostly share theirs, so a text needs one entry for each run of windows with the same mark, and no
repeated window can be missed. Each step looks only at what the step before found repeated:

1. ``core``: the marked gram. Where it stands once, no window of the run repeats.
2. ``whole``: everything that the run's windows cover. Runs that agree in it agree in all their windows; of such a class
   only one run goes on.
3. The same for stretches of ``BLOCK`` windows of the runs whose core is shared by different classes: ``core`` is now what
   all windows of a stretch cover, ``whole`` what any of them covers.
4. Single windows of the stretches that are still open, as the pair of their halves' hashes.

All groups are summed up before they are shuffled (a count, a smallest id, a smallest and a largest class); a group's
members are never brought together, and members learn the result through a join that Spark can split, merged and never
broadcast: Spark's estimates leave out what explode and inline make of a row, and Parquet's compression.
Hashes are polynomials over mixed 64-bit units; classes are told apart by core and whole, windows by both
halves, 128 bits each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotelens.llm.tables import kept, release
from quotelens.operators.skew import salted_join

#: Windows that are hashed at a time; longer texts are read in stretches that overlap by a window.
STRETCH = 1 << 18
#: Windows of a stretch in the third step.
BLOCK = 16
#: Fixed odd multipliers.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIXES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
PLACE = np.uint64((1 << 31) - 1)

_powers: dict[tuple[int, int], np.ndarray] = {}


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * MIXES[0]
    x = (x ^ (x >> np.uint64(29))) * MIXES[1]
    return x ^ (x >> np.uint64(32))


def powers(half: int, sign: int, n: int) -> np.ndarray:
    """The first n powers of a factor or of its inverse; kept, as long as a stretch."""
    known = _powers.get((half, sign))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 12), pow(FACTORS[half], sign, 1 << 64), dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        _powers[half, sign] = known
    return known[:n]


class Hashes:
    """Hash of any stretch of units: differences of prefix sums of unit * factor^place, divided by the power at its start."""

    def __init__(self, units: np.ndarray, half: int = 0):
        n = len(units)
        self.inverse = powers(half, -1, n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(units * powers(half, 1, n), out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n]


def marked(units: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Hashes]:
    """(first window, last window, place of the mark) of each run of windows with the same mark, and the hashes."""
    one = Hashes(units)
    best = (mixed(one.grams(size // 2)) & ~PLACE) | np.arange(len(units) - size // 2 + 1, dtype=np.uint64)
    width, reach = size - size // 2 + 1, 1
    while reach < width:  # smallest of twice as many neighbours each time
        step = min(reach, width - reach)
        best = np.minimum(best[:-step], best[step:])
        reach += step
    at = (best & PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.concatenate([first[1:] - 1, [len(at) - 1]]), at[first], one


def entries(units: np.ndarray, size: int) -> list[np.ndarray]:
    """core, whole, first window and last window of every run of a stretch."""
    first, last, at, one = marked(units, size)
    whole = mixed(one.of(first, last + size)) + mixed(Hashes(units, 1).of(first, last + size) + (last - first).astype(np.uint64))
    return [mixed(one.of(at, at + size // 2)).view(np.int64), whole.view(np.int64), first.astype(np.int32), last.astype(np.int32)]


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) for all values of the ranges that begin at starts and have counts values."""
    of = np.repeat(np.arange(len(starts)), counts)
    return of, np.arange(len(of)) + (starts - np.cumsum(counts) + counts)[of]


def marks(one: Hashes, first: np.ndarray, size: int) -> np.ndarray:
    """The mark of each window: the gram of size / 2 units with the smallest hash, the leftmost if several are alike."""
    half = size // 2
    width = size - half + 1
    of, at = spread(first, np.full(len(first), width))
    best = (mixed(one.of(at, at + half)) & ~PLACE) | (at - first[of]).astype(np.uint64)
    return first + (np.minimum.reduceat(best, np.arange(0, len(at), width)) & PLACE).astype(np.int64)


def singles(units: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> list[np.ndarray]:
    """Every window of the runs: hashes of its first and second half, and its place twice."""
    middle = size // 2
    _, at = spread(first, last - first + 1)
    return [mixed(Hashes(units).of(at, at + middle)).view(np.int64), mixed(Hashes(units, 1).of(at + middle, at + size)).view(np.int64), at, at]


def stretches(units: np.ndarray, first: np.ndarray, last: np.ndarray, size: int) -> list[np.ndarray]:
    """core, whole, first and last window of every stretch of the runs, cut at places relative to each run's mark."""
    one, two, width = Hashes(units), Hashes(units, 1), min(BLOCK, size // 2)
    mark = marks(one, first, size)
    low = (mark - last) // width
    of, number = spread(low, (mark - first) // width - low + 1)
    mark, first, last = mark[of], first[of], last[of]
    tag, high = mixed(number + 1), mark - width * number  # high: first unit of the uncut stretch's last window
    a, b = np.maximum(high - width + 1, first), np.minimum(high, last)
    # what the windows of the uncut stretch have in common; it lies in every window of the cut one
    core = mixed(one.of(high, high - width + 1 + size) + tag)
    whole = mixed(one.of(a, b + size) + mixed((mark - a) * (1 << 20) + (b - a))) + mixed(two.of(a, b + size) + tag)
    return [core.view(np.int64), whole.view(np.int64), a, b]


def opened(parts: Sequence, first: np.ndarray, last: np.ndarray, size: int, items_of: Callable, values_of: Callable) -> list[np.ndarray]:
    """The items of a document's open runs, all runs of a stretch at a time."""
    out, base = [], first // STRETCH * STRETCH  # a run lies in the stretch in which it was found
    for start in np.unique(base).tolist():
        own = base == start
        found = items_of(values_of(parts[start : start + STRETCH + size - 1]), first[own] - start, last[own] - start, size)
        out.append([*found[:2], *((c + start).astype(np.int32) for c in found[2:])])
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def covered(n: int, size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n units are inside a window that starts in one of the runs."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, first, 1)
    np.subtract.at(edges, last + size, 1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, size: int, earlier: bool, split_text: Callable[[str], Sequence], values_of: Callable[[Sequence], np.ndarray], finish: Callable[[Sequence, np.ndarray], tuple], result: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, text_hash and the columns that finish returns.

    earlier: a window repeats if it also starts in a document with a smaller doc_id; otherwise if it starts anywhere else.
    split_text: units of a text. values_of: their 64-bit values. finish: gets the units and which of them are covered.
    """
    tagged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.hash("text"))
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, tag in zip(batch.column("doc_id"), batch.column("text"), batch.column("text_hash"), strict=True):
                values = values_of(split_text(text.as_py()))
                for base in range(0, len(values) - size + 1, STRETCH):
                    columns = entries(values[base : base + STRETCH + size - 1], size)
                    n = len(columns[0])
                    places = [pa.array(c + np.int32(base)) for c in columns[2:]]
                    yield pa.RecordBatch.from_arrays([pa.repeat(doc_id, n), pa.repeat(tag, n), pa.array(columns[0]), pa.array(columns[1]), *places], names=[*OWNER, "core", "whole", "first", "last"])

    runs = kept(tagged.mapInArrow(_gathered(index), "doc_id long, text_hash int, core long, whole long, first int, last int"))
    start = tagged.withColumns({c: F.lit(None).cast("array<int>") for c in ("sure_first", "sure_last")})
    first, spent = _repeated(runs, earlier)
    passed = kept(_with_runs(start, first).mapInArrow(_next_items(stretches, size, split_text, values_of, finish, result), _shape(result)))
    release(runs, *spent)
    second, more = _repeated(passed.select(*OWNER, F.inline("items")), earlier)
    again = kept(_with_runs(passed.where("text is not null"), second).mapInArrow(_next_items(singles, size, split_text, values_of, finish, result), _shape(result)))
    release(*more)
    third, _ = _repeated(again.select(*OWNER, F.inline("items")), earlier)
    last = _with_runs(again.where("text is not null"), third).mapInArrow(_next_items(None, size, split_text, values_of, finish, result), _shape(result))
    names = [*OWNER, *(n for n, _, _ in result)]
    return passed.where("text is null").select(names).unionByName(again.where("text is null").select(names)).unionByName(last.select(names))


OWNER = ["doc_id", "text_hash"]
ITEM = pa.struct([("core", pa.int64()), ("whole", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])


def _repeated(items: DataFrame, earlier: bool) -> tuple[DataFrame, list[DataFrame]]:
    """For each document its items (first and last window) that surely repeat, and those that must be opened; the tables that this reads."""
    cores = kept(items.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    shared = kept(items.join(cores.hint("merge"), "core"))
    release(cores)
    classes = kept(shared.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_first")))
    split = classes.groupBy("core").agg((F.count("*") > 1).alias("split")).where("split")
    member = shared.join(salted_join(classes, split, ["core"], F.hash("whole"), how="left").hint("merge"), ["core", "whole"])
    sure = F.coalesce(F.col("doc_id") > F.col("class_first"), F.col("class_first").isNotNull()) if earlier else F.col("n") > 1
    # of a class that shares its core with others, the document with the smallest id goes on
    goes_on = F.col("split").isNotNull() & F.col("doc_id").eqNullSafe(F.col("class_first"))
    found = member.select(*OWNER, "first", "last", sure.alias("sure"), goes_on.alias("open")).where("sure or open")
    return found.groupBy(*OWNER).agg(F.collect_list(F.struct("first", "last", "sure", "open")).alias("runs")), [shared, classes]


def _with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    same = [docs[c].eqNullSafe(runs[c]) for c in OWNER]
    return docs.join(runs, same[0] & same[1], "left").select(*(docs[c] for c in (*OWNER, "text", "sure_first", "sure_last")), "runs")


def _shape(result: list[tuple[str, pa.DataType, str]]) -> str:
    return "doc_id long, text_hash int, text string, sure_first array<int>, sure_last array<int>, items array<struct<core: long, whole: long, first: int, last: int>>, " + ", ".join(f"{n} {t}" for n, _, t in result)


def _next_items(items_of: Callable[[np.ndarray, np.ndarray, np.ndarray, int], list[np.ndarray]] | None, size: int, split_text, values_of, finish, result):
    """Documents without open runs get their result; the others go on with their text, what is sure, and the items of their open runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, texts, sure_runs, items = [], [], [], []
            for text, a, b, held in zip(*(batch.column(c) for c in ("text", "sure_first", "sure_last", "runs")), strict=True):
                parts = split_text(text.as_py())
                sure_a, sure_b = (np.array(x.as_py() or [], np.int64) for x in (a, b))
                out = None
                if held.is_valid:
                    first, last, sure, opens = (held.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                    sure_a, sure_b = np.concatenate([sure_a, first[sure]]), np.concatenate([sure_b, last[sure]])
                    if items_of and opens.any():
                        out = opened(parts, first[opens].astype(np.int64), last[opens].astype(np.int64), size, items_of, values_of)
                items.append(out)
                texts.append(text.as_py() if out else None)
                sure_runs.append([sure_a, sure_b] if out else None)
                done.append((None,) * len(result) if out else finish(parts, covered(len(parts), size, sure_a, sure_b)))
            columns = [pa.array(c, t) for c, (_, t, _) in zip(zip(*done, strict=True), result, strict=True)]
            some = [i for i in items if i]
            fields = [pa.array(np.concatenate(c)) for c in zip(*some, strict=True)] if some else [pa.array([], f.type) for f in ITEM]
            offsets = np.cumsum([0, *(len(i[0]) if i else 0 for i in items)]).astype(np.int32)
            nested = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(ITEM)))
            lists = [pa.array([r[i].tolist() if r else None for r in sure_runs], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(texts, pa.string()), *lists, nested, *columns], names=[*OWNER, "text", "sure_first", "sure_last", "items", *(n for n, _, _ in result)])

    return run


def _gathered(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], least: int = 20_000):
    """Joins small batches, each of which costs a round trip to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in rows(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= least:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return run
