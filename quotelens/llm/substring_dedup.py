"""Substring dedup by level-wise doubling over word windows.

Windows of half the length come first; those that repeat are alone extended to twice that length, and what repeats there is
removed from all documents but the first. The half windows are looked at where they mark a run of full windows, see
``windows``. Lengths beyond the threshold need no level of their own: their words are covered by windows of the threshold.

Null text has no words; texts under the threshold lose nothing. A null doc_id counts as larger than any other. Repeated
rows keep the same words; equal ids do not remove from each other. An empty table gives no rows; further columns are left
aside.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents
from quotelens.llm.windows import remove_repeats

WINDOW = 50
#: Words whose hashes one worker remembers.
MEMORY = 150_000
_known: dict[bytes, int] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def word_values(words: list[bytes]) -> np.ndarray:
    if len(_known) > MEMORY:
        _known.clear()
    for w in set(words):
        if w not in _known:
            _known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def cut_words(words: list[bytes], gone: np.ndarray, output: str) -> tuple[int, int, str | None]:
    removed = int(gone.sum())
    if not removed and output == "changed":
        return len(words), 0, None
    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
    return len(words), removed, hashlib.sha256(left).hexdigest() if output == "digest" else left.decode()


def drop_repeated_words(docs: DataFrame, window: int = WINDOW, output: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, left (the remaining words, joined by one space) of every row of docs.

    output: "text"; "changed" leaves null the text of rows that lose nothing; "digest" gives the text's SHA-256 instead.
    """
    shape = [("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("left", pa.string(), "string")]
    return remove_repeats(docs, window, True, words_of, word_values, partial(cut_words, output=output), shape)


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_words(documents(spark, sf_dir), output="digest").select("doc_id", "n_words", "n_removed", F.col("left").alias("kept_sha256"))
