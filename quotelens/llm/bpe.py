"""Byte-level BPE over whole texts: forced-boundary splitting, independent encoding, concatenation; and the way back.

Null text counts as empty and yields no ids. Rows are independent: repeated rows and repeated ids give repeated results,
an empty table gives an empty one, and further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents
from quotelens.llm.tokens import ForcedCuts, decoder, encoder

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, path: str = VOCABULARY, text: str = "text", to: str = "ids") -> DataFrame:
    """Adds the ids of each text as little-endian unsigned 32-bit integers (binary)."""
    schema = f"{docs.select([c for c in docs.columns if c != to])._jdf.schema().toDDL()}, `{to}` BINARY"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path, ForcedCuts)
        for batch in batches:
            ids = pa.array([known.encode(t.as_py()) for t in batch.column(text)], pa.binary())
            yield _with(batch, to, ids)

    return docs.mapInArrow(run, schema)


def decode_texts(docs: DataFrame, path: str = VOCABULARY, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; null ids give empty text."""
    schema = f"{docs.select([c for c in docs.columns if c != to])._jdf.schema().toDDL()}, `{to}` STRING"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = decoder(path)
        for batch in batches:
            texts = [known.decode(memoryview(x.as_buffer()).cast("I") if x.is_valid and x.as_buffer().size else ()) for x in batch.column(ids)]
            yield _with(batch, to, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, schema)


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(documents(spark, sf_dir)).drop("text")
    return decode_texts(coded).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
