"""Token files: one concatenated id array per file with Elias-Fano coded document boundaries and ids.

Documents are dealt by ranges of doc_id and sorted, so file after file holds them in ascending order. A file is a row of
blocks, each followed by the line ``TRAILER``; Spark's own writer puts the bytes where every executor can read them. A
block holds a header, its ids in as few bytes as the vocabulary needs, and two Elias-Fano sequences: the end of each
document in the id array, and the doc_ids. Block headers count ids from the start of their file; the ids of the files
before it are added up from the headers when reading.

Null text is an empty document (the end id alone). Null doc_ids stand first, as Spark sorts them. Repeated doc_ids stand
beside each other, ordered by a hash of their text; each row keeps its own boundaries. An empty table gives no documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents, shared_folder
from quotelens.llm.tokens import ForcedCuts, encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END = 2
#: Ids and documents after which a block ends.
BLOCK_IDS, BLOCK_DOCS = 1 << 20, 1 << 14
TRAILER = "\nEFT1END\n"
HEADER = struct.Struct("<4sBIIQQ")  # magic, bytes of an id, documents, documents without doc_id, ids, ids before it in the file
SEQUENCE = struct.Struct("<qQIBQ")  # first value, span, count, low bits, bytes of the high part


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(span / count) bits a value: low bits as they are, high parts in unary.

    ``select`` finds one value through counts of set bits before each 512-bit stretch, ``values`` all of them.
    """

    def __init__(self, first: int, span: int, count: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.first, self.span, self.count, self.low_bits, self.low, self.high = first, span, count, low_bits, low, high
        self._before = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        if not len(values):
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8))
        first = int(values[0])
        rest = values.astype(np.uint64) - np.uint64(first & 0xFFFFFFFFFFFFFFFF)
        span, n = int(rest[-1]), len(rest)
        low_bits = max(0, (span // n).bit_length() - 1) if span > n else 0
        bits = np.zeros(n + (span >> low_bits) + 1, dtype=np.uint8)
        bits[(rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        low = ((rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(first, span, n, low_bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(bits, bitorder="little"))

    def to_bytes(self) -> bytes:
        return SEQUENCE.pack(self.first, self.span, self.count, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        first, span, n, low_bits, size = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        middle, end = at + -(-n * low_bits // 8), at + -(-n * low_bits // 8) + size
        return cls(first, span, n, low_bits, np.frombuffer(data[at:middle], np.uint8), np.frombuffer(data[middle:end], np.uint8)), end

    def _lows(self, i: int, j: int) -> np.ndarray:
        a, b = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(j - i, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def _value(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        rest = (high.astype(np.uint64) << np.uint64(self.low_bits)) | low
        return (rest + np.uint64(self.first & 0xFFFFFFFFFFFFFFFF)).astype(np.int64)

    def values(self) -> np.ndarray:
        if not self.count:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        return self._value(places - np.arange(self.count), self._lows(0, self.count))

    def select(self, i: int) -> int:
        """Value number i, without reading the others."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        if self._before is None:
            ones = np.bitwise_count(np.pad(self.high, (0, -len(self.high) % 64))).reshape(-1, 64).sum(axis=1)
            self._before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        k = int(np.searchsorted(self._before, i, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.high[64 * k : 64 * k + 64], bitorder="little"))
        place = 512 * k + int(inside[i - int(self._before[k])])
        return int(self._value(np.array([place - i]), self._lows(i, i + 1))[0])


def block(doc_ids: list[int | None], ids: list[bytes], before: int, width: int) -> bytes:
    """One block: doc_ids ascending, those without first; ids as unsigned 32-bit integers."""
    ends = np.cumsum([len(x) // 4 for x in ids])
    known = [d for d in doc_ids if d is not None]
    data = np.frombuffer(b"".join(ids), dtype="<u4").astype("<u2" if width == 2 else "<u4").tobytes()
    return HEADER.pack(b"EFT1", width, len(doc_ids), len(doc_ids) - len(known), int(ends[-1]), before) + EliasFano.of(ends).to_bytes() + EliasFano.of(np.array(known, np.int64)).to_bytes() + data


def blocks(content: bytes) -> Iterator[tuple[list[int | None], int, EliasFano, np.ndarray]]:
    """doc_ids, ids before the block in its file, document ends and the id array of each block."""
    view, at = memoryview(content), 0
    while at < len(view):
        magic, width, n, nulls, total, before = HEADER.unpack_from(view, at)
        if magic != b"EFT1":
            raise ValueError("not a token file")
        ends, at = EliasFano.read(view, at + HEADER.size)
        known, at = EliasFano.read(view, at)
        yield [None] * nulls + known.values().tolist(), before, ends, np.frombuffer(view[at : at + width * total], dtype=f"<u{width}")
        at += width * total + len(TRAILER)


def write_token_files(docs: DataFrame, folder: str, path: str = VOCABULARY, end: int = END) -> None:
    """Encodes every text and writes token files in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = encoder(path, ForcedCuts), end.to_bytes(4, "little")
        width = 2 if max(known.library.get_vocab_size(), end + 1) <= 1 << 16 else 4
        doc_ids, ids, held, before = [], [], 0, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block(doc_ids, ids, before, width)], pa.binary())], names=["block"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                doc_ids.append(doc_id)
                ids.append(known.encode(text.as_py()) + last)
                held += len(ids[-1]) // 4
                if held >= BLOCK_IDS or len(ids) >= BLOCK_DOCS:
                    yield made()
                    before += held
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield made()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, "block binary").select(F.col("block").cast("string").alias("value")).write.option("lineSep", TRAILER).text(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, the ids (unsigned 32-bit) of each document."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("file"), "content").where(F.length("content") > 0)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [sum(len(b[3]) for b in blocks(c.as_buffer())) for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(sums, pa.int64())], names=["file", "n"])

    fields = [("file", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                for doc_ids, before, ends, ids in blocks(content.as_buffer()):
                    stops = ends.values()
                    starts = np.concatenate([[0], stops[:-1]])
                    parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                    out = [[file] * len(parts), doc_ids, starts + before, stops - starts, [zlib.crc32(p) for p in parts], *[parts] * with_ids]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    # one row a file, so the running sum in one task is as long as the list of files
    sums = files.mapInArrow(totals, "file long, n long").groupBy("file").agg(F.sum("n").alias("n")).selectExpr("file", "sum(n) over (order by file) - n as base")
    out = files.mapInArrow(rows, "file long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    return out.join(sums, "file").withColumn("start", F.col("start") + F.col("base")).drop("file", "base")


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens"
    write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")
