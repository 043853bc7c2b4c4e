"""URL filter by empirical-Bayes host reputation.

Explicit rules come first. Every other url is judged by its host: the labelled outcomes of a host's pages are shrunk
towards its registered domain, the domain's towards its suffix, the suffix's towards all pages. How strongly a level
shrinks is estimated from the spread between its members (beta-binomial moments). A host is allowed where the lower bound
of its posterior share of good pages reaches the threshold; hosts without labels are judged by their domain's prior.

Null urls and urls without ``://`` have an empty host and path, form a host of their own and are judged like any other.
Labels count once for each labelled row that belongs to a page; null outcomes count as not labelled. Pages may repeat.
Empty tables give no rows; without any label every prior is one half with the strength ``MIN_STRENGTH``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Bounds of a prior's strength in pages, standard deviations below the mean, least share of good pages.
MIN_STRENGTH, MAX_STRENGTH, Z, THRESHOLD = 1.0, 1000.0, 1.645, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level labels under which countries register domains.
REGISTRIES = ["ac", "co", "com", "edu", "gov", "net", "org"]
LEVELS = ["suffix", "domain", "host"]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(text.contains("://"), F.expr(f"substring(`{url}`, locate('://', `{url}`) + 3)")).otherwise("")
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def first_rule(rules: list[tuple[str, str, str]], value: str) -> Column:
    """The longest fitting rule's text (value "rule") or verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path if value == "rule" else verdict)).otherwise(out)
    return out


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds suffix and domain (suffix and the label before it) of each host; a port or user name is no part of them."""
    labels = F.split(F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", ""), r"\.")
    last, second = F.element_at(labels, -1), F.when(F.size(labels) > 2, F.element_at(labels, -2))
    country = (F.length(last) == 2) & second.isin(REGISTRIES)
    suffix = F.when(country, F.concat_ws(".", second, last)).otherwise(last)
    domain = F.when(F.size(labels) == 1, last).otherwise(F.concat_ws(".", F.when(country, F.element_at(labels, -3)).otherwise(F.element_at(labels, -2)), suffix))
    return hosts.withColumns({"suffix": suffix, "domain": domain})


def strength(units: DataFrame) -> float:
    """Pages that a prior is worth, from the spread of the units' shares around their parents' (n, k, parent mean m)."""
    v = F.col("m") * (1 - F.col("m"))
    s = units.where("n > 0").agg(
        F.sum(F.col("n") * (F.col("k") / F.col("n") - F.col("m")) ** 2).alias("spread"), F.sum(v).alias("each"), F.sum(v * F.col("n")).alias("pages")
    ).first()
    extra = (s.pages or 0.0) - (s.each or 0.0)
    rho = ((s.spread or 0.0) - (s.each or 0.0)) / extra if extra > 0 else 1.0
    return MAX_STRENGTH if rho <= 0 else min(MAX_STRENGTH, max(MIN_STRENGTH, (1 - rho) / rho))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """host, n, good_share, bound for every host of hosts (host); outcomes has host, n and k (good pages), a row a host."""
    counts = with_levels(hosts.select("host").distinct().join(outcomes, "host", "left").na.fill(0, ["n", "k"]))
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    parent, means = None, F.lit((total.k or 0) / total.n if total.n else 0.5)
    for level in LEVELS:
        above = [] if parent is None else [parent]
        units = counts.groupBy(*above, level).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) if level != "host" else counts
        units = units.withColumn("m", means) if parent is None else units.join(means, parent)
        tau = F.lit(strength(units))
        shrunk = units.withColumns({"a": F.col("k") + tau * F.col("m"), "b": F.col("n") - F.col("k") + tau * (1 - F.col("m"))})
        means, parent = shrunk.select(level, (F.col("a") / (F.col("a") + F.col("b"))).alias("m")), level
    size = F.col("a") + F.col("b")
    share = F.col("a") / size
    return shrunk.select("host", "n", share.alias("good_share"), (share - z * F.sqrt(share * (1 - share) / (size + 1))).alias("bound"))


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, good_share, bound of every page; labelled has host and good (boolean), a row an outcome."""
    parts = with_parts(pages.select("page_id", "url"))
    outcomes = labelled.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    known = reputation(parts.select("host").distinct(), outcomes).select("host", "good_share", "bound")
    verdict = F.coalesce(first_rule(rules, "verdict"), F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
    return parts.join(known, "host", "left").select("page_id", "host", "path", first_rule(rules, "rule").alias("rule"), verdict.alias("verdict"), "good_share", "bound")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and good of each labelled page: the number in the second part of its path is the labelled document. Good: fair quality and not toxic."""
    number = F.regexp_extract("path", r"^/[^/]*/([0-9]{1,18})", 1)
    made_of = with_parts(pages.select("url")).select("host", F.when(number != "", number).cast("long").alias("doc_id"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return made_of.join(labels.select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good")), "doc_id").select("host", "good")


def host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge_urls(pages, labelled_pages(pages, labels)).select("page_id", "host", "path", "rule", "verdict")


def _check() -> str:
    fits = [f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then '%s'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule = " ".join(f % (h + p) for f, (h, p, _) in zip(fits, sorted(RULES, key=lambda r: -len(r[0] + r[1])), strict=True))
    verdict = " ".join(f % v for f, (_, _, v) in zip(fits, sorted(RULES, key=lambda r: -len(r[0] + r[1])), strict=True))

    def tau(units: str) -> str:
        return f"""(select case when rho <= 0 then {MAX_STRENGTH} else least({MAX_STRENGTH}, greatest({MIN_STRENGTH}, (1 - rho) / rho)) end from (
          select case when coalesce(sum(m * (1 - m) * n) - sum(m * (1 - m)), 0) > 0
            then (sum(n * (k / n - m) ** 2) - sum(m * (1 - m))) / (sum(m * (1 - m) * n) - sum(m * (1 - m))) else 1 end as rho from {units} where n > 0))"""

    registries = ", ".join(f"'{r}'" for r in REGISTRIES)
    return rf"""
with rest as (
  select page_id, case when contains(coalesce(url, ''), '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest
), good as (
  select host, (quality = 1 and toxic = 0) as good from (select host, try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') as bigint) as doc_id from parts) join labels using (doc_id)
), outcomes as (
  select host, count(*) as n, sum(good::int) as k from good where good is not null group by host
), hosts as (
  select host, coalesce(n, 0)::double as n, coalesce(k, 0)::double as k, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as l
  from (select distinct host from parts) left join outcomes using (host)
), country as (
  select *, coalesce(length(l[-1]) = 2 and len(l) > 2 and l[-2] in ({registries}), false) as c from hosts
), levels as (
  select host, n, k, case when c then l[-2] || '.' || l[-1] else l[-1] end as suffix,
    case when len(l) = 1 then l[-1] when c then l[-3] || '.' || l[-2] || '.' || l[-1] else l[-2] || '.' || l[-1] end as domain from country
), suffixes as (
  select suffix, sum(n) as n, sum(k) as k, (select case when sum(n) > 0 then sum(k) / sum(n) else 0.5 end from levels) as m from levels group by suffix
), suffix_means as (
  select suffix, (k + t * m) / (n + t) as m from suffixes, (select {tau("suffixes")} as t)
), domains as (
  select domain, n, k, m from (select suffix, domain, sum(n) as n, sum(k) as k from levels group by all) join suffix_means using (suffix)
), domain_means as (
  select domain, (k + t * m) / (n + t) as m from domains, (select {tau("domains")} as t)
), units as (
  select host, n, k, m from levels join domain_means using (domain)
), shrunk as (
  select host, (k + t * m) / (n + t) as share, n + t as size from units, (select {tau("units")} as t)
), bounds as (
  select host, share - {Z} * sqrt(share * (1 - share) / (size + 1)) as bound from shrunk
)
select page_id, host, path, case {rule} end as rule, coalesce(case {verdict} end, case when bound >= {THRESHOLD} then 'allow' else 'block' end) as verdict
from parts left join bounds using (host)
"""


CHECK = _check()
