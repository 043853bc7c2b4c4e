"""Skew-safe building blocks: running values, rolling frames and joins that never put a hot key into one task.

A plain window over a key sorts all rows of that key in one task. Here rows are cut into buckets along the order
(for example hours), windows run inside (key, bucket), and what earlier buckets contribute is a small table of
bucket totals. Results equal those of the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max or min of ``expr`` over the rows so far."""

    name: str
    kind: str
    expr: Column
    include_current: bool = True


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, carry: Column, inner: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(inner, F.lit(0))
    pick = F.greatest if kind == "max" else F.least
    return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(pick(carry, inner))


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, values: list[Running]) -> DataFrame:
    """Add running values per key, in the given order. ``bucket`` must not decrease along the order.

    max / min need an orderable scalar expression.
    """
    d = df.withColumn("_bkt", bucket)
    for v in values:
        d = d.withColumn(f"_x_{v.name}", v.expr)
    totals = d.groupBy(*keys, "_bkt").agg(*[_AGG[v.kind](f"_x_{v.name}").alias(f"_t_{v.name}") for v in values])
    before = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "_bkt", *[_AGG[v.kind](f"_t_{v.name}").over(before).alias(f"_c_{v.name}") for v in values])
    inside = W.partitionBy(*keys, "_bkt").orderBy(*order)
    joined = d.join(carry, [*keys, "_bkt"])
    for v in values:
        frame = inside.rowsBetween(W.unboundedPreceding, 0 if v.include_current else -1)
        joined = joined.withColumn(
            v.name, _combine(v.kind, F.col(f"_c_{v.name}"), _AGG[v.kind](f"_x_{v.name}").over(frame))
        )
    drop = ["_bkt"] + [f"_{p}_{v.name}" for v in values for p in "xc"]
    return joined.drop(*drop)


def with_ordinal(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "ordinal") -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, order, bucket, [Running(name, "sum", F.lit(1))])


def rolling(
    df: DataFrame, keys: list[str], ordinal: str, length: int, values: dict[str, Column], block: int | None = None
) -> DataFrame:
    """Aggregates over the last ``length`` rows of the key, the current one included.

    Rows are cut into blocks by ordinal. The last ``length - 1`` rows of a block also go to the next block, so each
    frame is complete inside its block.
    """
    size = max(block or 0, 4 * length, 4096)
    pos = F.col(ordinal) - 1
    own = F.floor(pos / size)
    tail = (pos % size) >= size - (length - 1)
    blocks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    frame = W.partitionBy(*keys, "_blk").orderBy(ordinal).rowsBetween(-(length - 1), 0)
    for name, agg in values.items():
        spread = spread.withColumn(name, agg.over(frame))
    return spread.filter("_own = _blk").drop("_own", "_blk")


def salted_join(
    large: DataFrame, bounded: DataFrame, keys: list[str], salt: Column, salts: int = 16, how: str = "inner", merge: bool = True
) -> DataFrame:
    """Equi-join in which the bounded side (few rows per key) is copied to each salt of the large side.

    The copies are merged, not broadcast: Spark's estimate of them is that of the rows before explode. Without merge it may
    broadcast them, which is for sides that are small whatever the input.
    """
    left = large.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    right = bounded.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right.hint("merge") if merge else right, [*keys, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark prunes to k rows per key before the shuffle (window group limit)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def best_row(df: DataFrame, keys: list[str], by: list[Column], keep: list[str], smallest: bool = False) -> DataFrame:
    """One row per key by an ordering struct; partial aggregation before the shuffle."""
    pick = F.min_by if smallest else F.max_by
    packed = F.struct(*[F.col(c) for c in keep])
    out = df.groupBy(*keys).agg(pick(packed, F.struct(*[b.alias(f"o{i}") for i, b in enumerate(by)])).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in keep])
