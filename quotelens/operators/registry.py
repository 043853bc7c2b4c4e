"""Site rules: which of them support a unit, and the request candidates that they build for it.

A rule supports a unit if one of its tokens stands in the site name or url; that is decided by expressions. What a rule
builds from a unit needs Python, so the units of a rule meet it in a table function that is partitioned by rule (and salts,
as one site may own a third of all units) and yields any number of candidates a unit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quotelens.functions.text import contains_any

#: One candidate: method, url, body (or None).
Candidate = tuple[str, str, str | None]


@dataclass(frozen=True)
class SiteRule:
    """``build`` gets the unit as a Row and yields its candidates in order."""

    name: str
    tokens: tuple[str, ...]
    build: Callable[[Any], Iterator[Candidate]]


def supported(units: DataFrame, rules: list[SiteRule], site: str = "site_name", url: str = "url") -> DataFrame:
    """Units with rule_no and rule of every rule that supports them."""
    text = F.concat_ws("\n", F.lower(site), F.lower(url))
    fits = F.filter(F.array(*[F.when(contains_any(text, list(r.tokens)), F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("rule"))) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    return units.withColumn("_fit", F.explode(fits)).select(*units.columns, "_fit.rule_no", "_fit.rule")


def site_candidates(units: DataFrame, rules: list[SiteRule], key: str, site: str = "site_name", url: str = "url", salts: int = 16) -> DataFrame:
    """key, rule_no, rule, candidate_no, method, url, body: rules in registry order, each with its candidates in order."""
    build = [r.build for r in rules]
    kind = units.schema[key].dataType.simpleString()

    class Candidates:
        def eval(self, row: Row) -> Iterator[tuple]:
            for n, (method, target, body) in enumerate(build[row["rule_no"]](row)):
                yield row[key], row["rule_no"], row["rule"], n, method, target, body

    table = F.udtf(Candidates, returnType=f"`{key}` {kind}, rule_no int, rule string, candidate_no int, method string, url string, body string")
    spread = supported(units, rules, site, url).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    return table(spread.asTable().partitionBy("rule_no", "_salt"))
