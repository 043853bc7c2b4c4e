"""Similarity joins of short texts inside a scope, through an inverted index instead of all pairs.

A text that stands inside another one, or shares a word with it, also shares an index entry with it:

* ``handle``: one character triple of the shorter text (or the text itself if it has fewer than three characters) stands
  among the ``probes`` of the longer one, which are all its triples, pairs and characters. The handle is the text's triple
  of smallest hash, so equal texts have equal handles and common beginnings do not make them alike.
* words that both have.

Pairs that meet in an entry are candidates; the caller scores them. What meets nowhere has score 0. Entries are joined by
(scope, entry) in a sorted merge, and an entry that stands in very many texts is spread over salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _slices(text: Column, size: int) -> Column:
    n = F.char_length(text)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.substr(text, i, F.lit(size)))


def handle(text: Column) -> Column:
    """The entry under which a text is looked for inside longer ones; null for an empty text."""
    triples = F.transform(_slices(text, GRAM), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
    return F.when(F.char_length(text) >= GRAM, F.array_min(triples).g).otherwise(F.nullif(text, F.lit("")))


def probes(text: Column) -> Column:
    """All entries under which a text may contain a handle."""
    return F.array_distinct(F.concat(*[_slices(text, n) for n in range(1, GRAM + 1)]))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def _entries(df: DataFrame, scope: list[str], ids: list[str], ways: list[tuple[list[Column], object, bool]], salts: int) -> DataFrame:
    """One row per entry of a way: a copied side has each entry under all salts, the other one under the salt of its ids."""
    every, own = F.array(*[F.lit(i) for i in range(salts)]), F.array(F.pmod(F.xxhash64(*ids), F.lit(salts)).cast("int"))
    parts = []
    for way, (texts, of, copied) in enumerate(ways):
        each = F.array_distinct(F.flatten(F.array(*[F.coalesce(of(t), F.array().cast("array<string>")) for t in texts])))
        parts.append(F.struct(F.lit(way).alias("_way"), (every if copied else own).alias("_salts"), each.alias("_each")))
    found = df.select(*scope, *ids, F.explode(F.array(*parts)).alias("_part")).select(*scope, *ids, "_part._way", "_part._salts", F.explode("_part._each").alias("_entry"))
    return found.select(*scope, *ids, "_way", "_entry", F.explode("_salts").alias("_salt"))


def candidates(
    left: DataFrame, right: DataFrame, scope: list[str], left_ids: list[str], right_ids: list[str], left_texts: list[str], right_texts: list[str],
    inside: bool = True, around: bool = True, shared: bool = True, salts: int = 8,
) -> DataFrame:
    """scope, left_ids, right_ids of all pairs of one scope in which some left and some right text fit, each pair once.

    inside: the left text, without spaces, is part of the right one; around: the reverse; shared: they have a word in
    common. The ids must name a row of their side inside the scope and have names of their own.
    """
    tight = lambda names: [F.replace(F.col(c), F.lit(" "), F.lit("")) for c in names]
    plain = lambda names: [F.col(c) for c in names]
    one = lambda t: F.filter(F.array(handle(t)), lambda x: x.isNotNull())
    # only the side with fewer entries a text is copied to the salts
    of_left, of_right = [], []
    if inside:
        of_left.append((tight(left_texts), one, True))
        of_right.append((tight(right_texts), probes, False))
    if around:
        of_left.append((tight(left_texts), probes, False))
        of_right.append((tight(right_texts), one, True))
    if shared:
        of_left.append((plain(left_texts), words, False))
        of_right.append((plain(right_texts), words, True))
    # all ways in one join, so that the plan of a side stands in the result once; it is never broadcast, as Spark's
    # estimates of the sides leave out the entries that explode makes of a text
    a, b = _entries(left, scope, left_ids, of_left, salts), _entries(right, scope, right_ids, of_right, salts)
    met = a.join(b.hint("merge"), [*scope, "_way", "_entry", "_salt"])
    return met.select(*scope, *left_ids, *right_ids).distinct()
