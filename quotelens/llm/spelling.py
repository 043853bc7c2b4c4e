"""Spelling variant grouping by permuterm rotations.

1. Word counts: runs of letters, lower-cased, are summed up per task and then by word; only the counts are shuffled.
2. A word marked by a terminator is turned to all its rotations. A rotation without its last character skips that character
   of the word, so every word that differs by a replacement there has the same one; and a word that lacks the character
   has it as a whole rotation. Rotations are therefore filed under the prefix that skips a character (``longer``) and as a
   whole (``whole``). Spark sorts them by that prefix; each range of equal prefixes is scanned once.
3. Such a range holds one whole rotation and one longer one for each letter of the alphabet at most. Every member gets the
   number of its neighbours in the range and the best of them; no pairs are written. A replacement is met in one range
   only. An indel inside a run of equal letters would be met once for each of them, so only the first one counts.
4. A form has at least FACTOR times the occurrences, so chains of forms end; roots follow by pointer doubling.

Null text has no words. A null doc_id is written as nothing when slips are chosen. Repeated rows count as often as they
stand there; ties go to the smallest word in code-point order; an empty table gives no rows; further columns are left aside.
Words of any length are read whole; prefixes of more than ``LONGEST`` characters are compared by their MD5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.llm.tables import documents, kept
from quotelens.operators.skew import salted_join

MIN_CHARS, MIN_COUNT, FACTOR, SLIP = 5, 3, 2, 97
#: Distinct words that a task sums up before it hands them on.
MEMORY = 200_000
#: Characters up to which a prefix is filed as it is.
LONGEST = 64

#: Latin-1 codes: letters as lower-cased ASCII or U+00C0 to U+00FF, all else a space.
LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0xC0 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """The letter runs of a text in Latin-1, one byte a code point; what Latin-1 lacks ends a run."""
    return (text or "").encode("latin-1", "replace").translate(LETTERS).split()


def slipped(doc_id: int | None, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word, word without one of its characters) for those of the distinct words that lose one in this document."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    sent = words if all(map(bytes.isascii, words)) else [w if w.isascii() else w.decode("latin-1").encode() for w in words]
    codes = np.fromiter(map(zlib.crc32, sent, repeat(start)), np.uint32, len(words))
    for i in np.flatnonzero(codes % SLIP == 0).tolist():
        at = int(codes[i]) % len(words[i])
        yield words[i], words[i][:at] + words[i][at + 1 :]


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: words of at least min_chars code points with at least min_count occurrences in docs (doc_id, text)."""

    def flushed(total: Counter) -> pa.RecordBatch:
        rows = [(w.decode("latin-1"), n) for w, n in total.items() if n and len(w) >= min_chars]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = runs(text.as_py())
                total.update(own)
                counts = Counter(own)
                for word, rest in slipped(doc_id, list(counts)):
                    total[word] -= counts[word]
                    total[rest] += counts[word]
                if len(total) > MEMORY:
                    yield flushed(total)
                    total = Counter()
        yield flushed(total)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


WHOLE, LONGER, FIRST = 0, 1, 2


def _filed(prefix: Column) -> Column:
    return F.when(F.char_length(prefix) <= LONGEST, prefix).otherwise(F.md5(prefix))


def rotations(words: DataFrame) -> DataFrame:
    """prefix, kind, n, word: each rotation of the words (word, n) as a whole, and without its last character where that is a letter.

    kind FIRST: the character that is skipped differs from the one before it in the word.
    """
    size, doubled = F.char_length("word"), F.concat("word", F.lit("$"), "word")

    def whole(i: Column) -> Column:
        return F.struct(_filed(F.substr(doubled, i + 1, size + 1)).alias("prefix"), F.lit(WHOLE).alias("kind"))

    def skipping(i: Column) -> Column:
        first = (i == 0) | (F.substr("word", i + 1, F.lit(1)) != F.substr("word", i, F.lit(1)))
        return F.struct(_filed(F.substr(doubled, i + 2, size)).alias("prefix"), F.when(first, FIRST).otherwise(LONGER).alias("kind"))

    turned = F.concat(F.transform(F.sequence(F.lit(0), size), whole), F.transform(F.sequence(F.lit(0), size - 1), skipping))
    return words.select("word", "n", F.explode(turned).alias("turn")).select("turn.*", "n", "word")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, near_n, near of the words (word, n) that have a near word: how many they have, and the one of largest n."""
    member = F.struct((-F.col("n")).alias("less"), "word", "kind")
    ranges = rotations(words).groupBy("prefix").agg(F.sort_array(F.collect_list(member)).alias("met")).where(F.size("met") > 1)

    def where(test: Callable[[Column], Column]) -> Column:
        return F.filter("met", test)

    parts = ranges.select(where(lambda m: m.kind != WHOLE).alias("longer"), where(lambda m: m.kind == FIRST).alias("firsts"), F.get(where(lambda m: m.kind == WHOLE), F.lit(0)).alias("whole"))
    named = lambda m: F.struct(m.less.alias("less"), m.word.alias("word"))
    longer, firsts, whole = F.col("longer"), F.col("firsts"), F.col("whole")

    def of_longer(m: Column) -> Column:
        indel = (m.kind == FIRST) & whole.isNotNull()
        other = F.when(m.word == F.get(longer, F.lit(0)).word, F.get(longer, F.lit(1))).otherwise(F.get(longer, F.lit(0)))
        best = F.least(F.when(other.isNotNull(), named(other)), F.when(indel, named(whole)))
        return F.struct(m.word.alias("word"), (F.size(longer) - 1 + indel.cast("int")).alias("n_near"), best.alias("best"))

    own = F.struct(whole.word.alias("word"), F.size(firsts).alias("n_near"), named(F.get(firsts, F.lit(0))).alias("best"))
    shares = F.concat(F.transform(longer, of_longer), F.when(whole.isNotNull() & (F.size(firsts) > 0), F.array(own)).otherwise(F.array()))
    told = parts.select(F.inline(shares)).where("n_near > 0")
    return told.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.word").alias("near"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of every word of links (word, up): what is reached in the end. Every round follows twice as many links."""
    links = kept(links)
    while True:
        above = links.select(F.col("word").alias("up"), F.col("up").alias("next"))
        moved = kept(salted_join(links, above, ["up"], F.hash("word"), how="left"))
        links = moved.select("word", F.coalesce("next", "up").alias("up"))
        if not moved.where("next is not null").take(1):
            return links.withColumnRenamed("up", "root")


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text)."""
    words = kept(word_counts(docs, min_chars, min_count))
    form = F.col("near_n") >= factor * F.col("n")
    found = words.join(neighbours(words), "word", "left")
    found = kept(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")))
    ends = roots(found.where("form is not null").select("word", F.col("form").alias("up")))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))
