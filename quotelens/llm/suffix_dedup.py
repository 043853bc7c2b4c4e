"""Suffix-array dedup by depth-limited radix sort.

Suffixes of the texts' bytes are ordered only as far as the threshold, in passes from the most significant digit on: the
marked half window, the stretch around it, at last both halves of the single window. A pass is a grouping by the next
digit inside the groups of the pass before; groups of one leave. What is left after the last digit are exactly the windows
that start more than once. ``windows`` explains the digits and why no window is missed.

Null text counts as empty; texts under the threshold lose nothing. Repeated rows and repeated ids are documents of their
own: copies lose each other's windows. An empty table gives no rows; further columns are left aside.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents
from quotelens.llm.windows import mixed, remove_repeats

WINDOW = 400
BYTE_VALUES = mixed(np.arange(1, 257))


def byte_values(data: bytes) -> np.ndarray:
    return BYTE_VALUES[np.frombuffer(data, np.uint8)]


def cut_bytes(data: bytes, gone: np.ndarray, digest: bool) -> tuple[int, int, int, bytes]:
    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1))
    left = data if not runs else np.frombuffer(data, np.uint8)[~gone].tobytes()
    return len(data), int(gone.sum()), runs, hashlib.sha256(left).digest() if digest else left


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_removed, n_spans, left (the remaining bytes, or with digest their SHA-256) of every row of docs."""
    shape = [("n_bytes", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("n_spans", pa.int64(), "long"), ("left", pa.binary(), "binary")]
    return remove_repeats(docs, window, False, str.encode, byte_values, partial(cut_bytes, digest=digest), shape)


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(documents(spark, sf_dir), digest=True).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("left")).alias("kept_sha256"))
