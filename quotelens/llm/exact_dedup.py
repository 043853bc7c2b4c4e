"""Exact dedup through an extendible-hash index on shared files, with DataFrame functions only.

1. One pass over the texts writes an entry per row: hash key, id, code points, digest. No text is written.
2. The directory starts with one bucket and doubles: a bucket with too many distinct keys is split by the next bit of the
   key. A bucket that is large because one key repeats cannot be split that way; its rows go to several pages instead.
3. The entries are dealt to the bucket files; owner tasks count keys by bucket and find those with more than one row.
4. The texts of those rows alone are compared byte by byte: equal (key, text) pairs are summed up before they are
   shuffled, so a hot group of copies becomes one row a task. Keys that hold several different texts are chained: their
   rows are matched by text, all others by key.

Null text counts as empty; empty texts are equal to each other. Among equal texts the row with the most code points
stays, then the smallest doc_id (null ids last), then one row of those that are alike in both. Each row of the input
gives one row; an empty table gives none; further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents, kept, shared_folder

#: Distinct keys of a bucket and rows of a page.
BUCKET_KEYS, PAGE_ROWS = 8192, 8192
#: Bits by which the histogram of keys grows, and buckets whose directory is small enough to broadcast (about 24 bytes each).
HISTOGRAM_BITS, BROADCAST_BUCKETS = 12, 50_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def entries(docs: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    bare = normalised(F.col("text"))
    return docs.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), key(bare).alias("key"), F.sha2(bare.cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))


def prefix(key: Column, bits: int) -> Column:
    """The first bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


class Directory:
    """Buckets as (local depth, prefix) with distinct keys and rows. Its size follows the number of buckets, not the data."""

    def __init__(self, keys: DataFrame, bucket_keys: int):
        """keys: key and n, one row a key."""
        self.buckets: dict[tuple[int, int], tuple[int, int]] = {}
        known, parents = 0, None
        while True:
            depth = min(64, known + HISTOGRAM_BITS)
            part = keys if parents is None else keys.where(prefix(F.col("key"), known).isin(parents))
            counts = {(depth, r.slot): (r.keys, r.rows) for r in part.groupBy(prefix(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("keys"), F.sum("n").alias("rows")).collect()}
            for d in range(depth - 1, known - 1, -1):
                for (_, slot), (k, n) in [x for x in counts.items() if x[0][0] == d + 1]:
                    before = counts.get((d, slot >> 1), (0, 0))
                    counts[d, slot >> 1] = (before[0] + k, before[1] + n)
            overfull = self._split(counts, bucket_keys, [(known, p) for p in (parents or [0])], depth)
            if not overfull or depth == 64:
                break
            known, parents = depth, overfull
    def _split(self, counts: dict, bucket_keys: int, todo: list[tuple[int, int]], depth: int) -> list[int]:
        """Halves overfull buckets down to depth; the prefixes of those that are still overfull there."""
        overfull = []
        while todo:
            d, slot = todo.pop()
            keys, rows = counts.get((d, slot), (0, 0))
            if keys <= bucket_keys or d == 64:
                self.buckets[d, slot] = (keys, rows)
            elif d == depth:
                overfull.append(slot)
            else:
                todo += [(d + 1, 2 * slot), (d + 1, 2 * slot + 1)]
        return overfull

    def table(self, spark: SparkSession, page_rows: int) -> DataFrame:
        """depth, prefix, bucket, pages."""
        rows = [(d, p, number, max(1, -(-n // page_rows))) for number, ((d, p), (_, n)) in enumerate(sorted(self.buckets.items()))]
        df = spark.createDataFrame(rows, "depth int, prefix long, bucket int, pages int")
        return F.broadcast(df) if len(rows) <= BROADCAST_BUCKETS else df

    def probes(self, key: Column) -> Column:
        """The prefixes under which a key may be filed, one for each local depth; exactly one of them is in the table."""
        depths = sorted({d for d, _ in self.buckets}) or [0]
        return F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), prefix(key, d).alias("prefix")) for d in depths)))


def build_index(docs: DataFrame, key: Callable[[Column], Column], bucket_keys: int, page_rows: int) -> DataFrame:
    """Entries in bucket files, with bucket, page and pages."""
    spark, flat = docs.sparkSession, kept(entries(docs, key))
    directory = Directory(flat.groupBy("key").agg(F.count("*").alias("n")), bucket_keys)
    folder = f"{shared_folder(spark)}/index"
    placed = flat.withColumn("probe", directory.probes(F.col("key"))).select("*", "probe.*").join(directory.table(spark, page_rows), ["depth", "prefix"]).drop("probe", "depth", "prefix")
    placed = placed.withColumn("page", F.pmod(F.xxhash64("row"), F.col("pages")).cast("int"))
    placed.repartition("bucket", "page").write.partitionBy("bucket").parquet(folder)
    return spark.read.schema(placed.schema).option("basePath", folder).parquet(folder)


def exact_duplicates(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64, bucket_keys: int = BUCKET_KEYS, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, n_chars."""
    index = build_index(docs, key, bucket_keys, page_rows)
    best = F.struct("n_chars", F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    owned = index.groupBy("bucket", "key").agg(F.max(best).alias("best"), F.count("*").alias("group_size"), F.max("pages").alias("pages"))
    repeated = kept(owned.where("group_size > 1").select("key", "best", "group_size", "pages"))

    bare = docs.select("doc_id", "text", normalised(F.col("text")).alias("bare")).withColumn("key", key(F.col("bare")))
    compared = bare.join(repeated.select("key"), "key", "left_semi").groupBy("key", "bare").count()
    chained = kept(compared.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"))
    collisions = bool(chained.take(1))

    alone = repeated.join(chained, "key", "left_anti") if collisions else repeated
    groups = alone.withColumn("page", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).drop("pages")
    rows = index.join(chained, "key", "left_anti") if collisions else index
    out = [rows.join(groups, ["key", "page"], "left")]
    if collisions:
        found = kept(bare.join(chained, "key", "left_semi").select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "key", "bare", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row")))
        out.append(found.join(found.groupBy("key", "bare").agg(F.max(best).alias("best"), F.count("*").alias("group_size")), ["key", "bare"]))
    shaped = [
        x.select(
            "doc_id",
            F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.bitwise_not("best.id")).alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            F.coalesce(F.col("row") == F.bitwise_not("best.row"), F.lit(True)).alias("kept"),
            "text_sha256",
            "n_chars",
        )
        for x in out
    ]
    return shaped[0] if len(shaped) == 1 else shaped[0].unionByName(shaped[1])


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


CHECK = r"""
with bare as (
  select doc_id, length(coalesce(text, '')) as n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as bare from documents
), ranked as (
  select doc_id, bare, first_value(doc_id) over w as keep_id, row_number() over w = 1 as kept, count(*) over (partition by bare) as group_size
  from bare window w as (partition by bare order by n_chars desc, doc_id)
)
select doc_id, keep_id, group_size, kept, sha256(bare) as text_sha256 from ranked
"""
