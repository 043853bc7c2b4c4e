"""Quality rules by repetition coverage: characters inside duplicated n-grams and lines, from rolling hashes in numpy.

Each text's words become numbers, the hashes of longer n-grams follow from those of shorter ones, and a sort finds the
windows that repeat an earlier one. A text is rejected where repeats cover too large a share of its characters.

Null text has no words and fails the base rule, as any text under 50 words does. Rows are independent: repeated rows give
repeated results and an empty table gives none. Whole texts are read whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quotelens.llm.tables import documents

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Largest share of word characters inside n-grams that repeat an earlier one, by n; wide enough that one repeated sentence in a short text passes.
MAX_NGRAM_SHARE = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of lines, and of characters in lines, that repeat an earlier line.
MAX_LINE_SHARE, MAX_LINE_CHAR_SHARE = 0.30, 0.30

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_chars_{n}" for n in MAX_NGRAM_SHARE), "dup_line_chars"]
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def repeats(keys: np.ndarray, first: bool) -> np.ndarray:
    """Where a key equals an earlier one, or with first any other one."""
    out = np.zeros(len(keys), dtype=bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        same = ordered[1:] == ordered[:-1]
        out[order[1:]] = same
        if first:
            out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places are inside a window of n that begins where starts is set."""
    edges = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    np.subtract.at(edges, at + n, 1)
    return np.cumsum(edges[:-1]) > 0


def exact_triples(ids: np.ndarray) -> np.ndarray:
    """A number for each window of three words, equal exactly where the windows are."""
    span = int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * span + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * span + ids[2:]


def measure(text: str | None) -> tuple[list[int], bool, bool]:
    """The measures in the order of MEASURES, whether the base rule fails, and whether the text is kept."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0, *[0] * len(MAX_NGRAM_SHARE), 0], True, False
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    raw = np.frombuffer(data, np.uint8)
    letter = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    points = np.concatenate([[0], np.cumsum(letter & ((raw & 0xC0) != 0x80))])
    sizes = points[edges[1::2]] - points[edges[::2]]
    total = int(points[-1])

    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    again = [x for x in lines if x in seen or seen.add(x)]
    line_chars = sum(len(x.decode()) for x in again)
    repeat_words = int(covered(repeats(exact_triples(ids), True), 3, n).sum()) if n > 3 else 0

    shares, hashes = {}, (ids.astype(np.uint64) + np.uint64(1)) * FACTOR
    hashes ^= hashes >> np.uint64(29)
    rolling = hashes
    for size in range(2, max(MAX_NGRAM_SHARE) + 1):
        if n < size:
            break
        rolling = rolling[:-1] * MIX + hashes[size - 1 :]
        if size in MAX_NGRAM_SHARE and n > size:
            again_at = repeats(rolling, False)
            shares[size] = int(sizes[covered(again_at, size, n)].sum()) if again_at.any() else 0
            if not again_at.any():
                break  # a longer window repeats only where its shorter beginning does
    dup_chars = [shares.get(k, 0) for k in MAX_NGRAM_SHARE]
    base_failed = n < MIN_WORDS or 100 * repeat_words > MAX_REPEAT_PERCENT * n
    rejected = any(d > limit * total for d, limit in zip(dup_chars, MAX_NGRAM_SHARE.values(), strict=True)) or len(again) > MAX_LINE_SHARE * len(lines) or line_chars > MAX_LINE_CHAR_SHARE * len(text)
    return [n, total, sum(map(text.count, SYMBOLS)), len(again), repeat_words, *dup_chars, line_chars], base_failed, not (base_failed or rejected)


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures, base_failed and kept to every row; columns of these names are replaced."""
    added = [*MEASURES, "base_failed", "kept"]
    rest = docs.select([c for c in docs.columns if c not in added])
    schema = ", ".join([rest._jdf.schema().toDDL(), *(f"{m} LONG" for m in MEASURES), "base_failed BOOLEAN", "kept BOOLEAN"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t.as_py()) for t in batch.column(text)]
            columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(MEASURES))]
            columns += [pa.array([f[i] for f in found], pa.bool_()) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return rest.mapInArrow(run, schema)


def repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("text")
