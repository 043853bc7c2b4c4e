"""Price mining: candidates from JSON, text, named fields, summary lines and selected options; selection per unit.

A candidate is (value, score, source) under the caller's key columns. Bodies and lines are read whole.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.jsonwalk import get, leaves, parse, walk
from quotelens.functions.money import coerce_price, parse_price, parse_prices, price_numbers, vat_percent
from quotelens.functions.text import contains_any
from quotelens.operators.skew import best_row, salted_join, top_k
from quotelens.session import written

CANDIDATE = "struct<value:double,score:int,source:string>"


def _candidate(value: Column, score: Column, source: Column) -> Column:
    return F.struct(value.alias("value"), score.cast("int").alias("score"), source.alias("source"))


def _in_range(value: Column) -> Column:
    return (value > 0) & (value <= vocab.PRICE_MAX)


# ---- weights and groups -------------------------------------------------------------------------------------------------

def key_weight(key: Column) -> Column:
    """Largest weight among the price words in a JSON key."""
    low = F.lower(key)
    return F.greatest(F.lit(0), *[F.when(F.contains(low, F.lit(t)), F.lit(w)).otherwise(0) for t, w in vocab.PRICE_KEY_WEIGHT])


def path_bonus(source: Column) -> Column:
    low = F.lower(source)
    level = (
        F.when(contains_any(low, vocab.PATH_BONUS_VALUE), 40)
        .when(contains_any(low, vocab.PATH_BONUS_TOTAL), 24)
        .when(contains_any(low, vocab.PATH_MALUS_PART), -12)
        .otherwise(0)
    )
    return level - F.when(contains_any(low, vocab.PATH_MALUS_EXTRA), 10).otherwise(0)


def candidate_group(source: Column) -> Column:
    low = F.lower(source)
    return (
        F.when(contains_any(low, vocab.GROUP_SHIPPING), "shipping")
        .when(low.startswith("derived_vat:") | contains_any(low, vocab.GROUP_TOTAL), "top_level_total")
        .when(contains_any(low, vocab.GROUP_COMPONENT), "component")
        .otherwise("other")
    )


def group_priority(group: Column) -> Column:
    pairs = list(vocab.GROUP_PRIORITY.items())
    return reduce(lambda c, kv: c.when(group == kv[0], kv[1]), pairs[1:], F.when(group == pairs[0][0], pairs[0][1])).otherwise(0)


#: Sources whose weight one worker remembers.
MEMORY = 50_000
_weights: dict[str | None, tuple[int, str, int]] = {}


def _weight_of(low: str | None) -> tuple[int, str, int]:
    found = _weights.get(low)
    if found is None:
        text = low or ""
        has = lambda tokens: any(t in text for t in tokens)
        bonus = 40 if has(vocab.PATH_BONUS_VALUE) else 24 if has(vocab.PATH_BONUS_TOTAL) else -12 if has(vocab.PATH_MALUS_PART) else 0
        bonus -= 10 if has(vocab.PATH_MALUS_EXTRA) else 0
        total = text.startswith("derived_vat:") or has(vocab.GROUP_TOTAL)
        group = "shipping" if has(vocab.GROUP_SHIPPING) else "top_level_total" if total else "component" if has(vocab.GROUP_COMPONENT) else "other"
        if len(_weights) >= MEMORY:
            _weights.clear()
        found = _weights[low] = bonus, group, vocab.GROUP_PRIORITY.get(group, 0)
    return found


def source_weights(source: Column) -> Column:
    """path_bonus, candidate_group and group_priority of a source as one struct (bonus, grp, prio). Candidates are many and their
    sources few: each distinct one of a batch is looked at once."""

    def weigh(low: pa.Array) -> pa.Array:
        coded = low.dictionary_encode(null_encoding="encode")
        bonus, group, prio = zip(*map(_weight_of, coded.dictionary.to_pylist()), strict=True) if len(low) else ([], [], [])
        fields = [pa.array(bonus, pa.int32()), pa.array(group, pa.string()), pa.array(prio, pa.int32())]
        return pa.StructArray.from_arrays([f.take(coded.indices) for f in fields], names=["bonus", "grp", "prio"])

    weigh.__annotations__ = {"low": pa.Array, "return": pa.Array}
    return F.arrow_udf(weigh, "struct<bonus:int,grp:string,prio:int>")(F.lower(source))


# ---- candidates from text -----------------------------------------------------------------------------------------------

def keyword_candidates(text: Column, prefix: Column, extra: Column | None = None) -> Column:
    """Array of candidates near price words or a currency sign. A group's patterns run only where a word of it occurs."""
    bonus = F.lit(0) if extra is None else extra
    low = F.lower(text)
    none = F.array().cast("array<string>")

    def rows(numbers: Column, score: int, suffix: str) -> Column:
        return F.transform(parse_prices(numbers), lambda v: _candidate(v, F.lit(score) + bonus, F.concat(prefix, F.lit(f":{suffix}"))))

    parts = []
    for (words, score), gate in zip(vocab.PRICE_KEYWORD_GROUPS, vocab.PRICE_KEYWORD_GATES, strict=True):
        present = reduce(lambda a, b: a | b, [F.contains(low, F.lit(g)) for g in gate])
        ahead = F.regexp_extract_all(low, F.lit(f"(?s)({words}).{{0,60}}?({vocab.PRICE_NUMBER})"), 2)
        behind = F.regexp_extract_all(low, F.lit(f"(?s)({vocab.PRICE_NUMBER}).{{0,40}}?({words})"), 1)
        parts.append(rows(F.when(present, ahead).otherwise(none), score, "kw_forward"))
        parts.append(rows(F.when(present, behind).otherwise(none), max(1, score - 1), "kw_reverse"))
    currency = f"(?:€|eur)\\s*(?:{vocab.PRICE_NUMBER})|(?:{vocab.PRICE_NUMBER})\\s*(?:€|eur)"
    hits = F.when(F.contains(low, F.lit("€")) | F.contains(low, F.lit("eur")), F.regexp_extract_all(low, F.lit(currency), 0)).otherwise(none)
    parts.append(rows(F.transform(hits, lambda h: F.regexp_extract(h, vocab.PRICE_NUMBER, 0)), 7, "currency"))
    return F.concat(*parts)


def text_candidate_array(text: Column, prefix: Column) -> Column:
    """Keyword candidates of a text; one without any amount is skipped before the patterns run."""
    return F.when(text.rlike(r"\d[,.]\d\d"), keyword_candidates(text, prefix)).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def text_candidates(df: DataFrame, keep: list[str], text: str, prefix: Column) -> DataFrame:
    return df.select(*keep, F.inline(text_candidate_array(F.col(text), prefix)))


def named_prices(text: Column) -> Column:
    """Named totals of a body: ARRAY<STRUCT<key, value>>, numeric fields first, then text fields."""
    rows = []
    for key in vocab.NAMED_NUMERIC:
        raw = F.regexp_extract(text, rf'(?i)"{key}"\s*:\s*(-?\d+(?:\.\d+)?)', 1)
        value = F.nullif(raw, F.lit("")).try_cast("double")
        rows.append(F.struct(F.lit(key).alias("key"), F.when(_in_range(value), F.round(value, 2)).alias("value")))
    for key in vocab.NAMED_TEXT:
        raw = F.regexp_extract(text, rf'(?i)"{key}"\s*:\s*"([^"]+)"', 1)
        rows.append(F.struct(F.lit(key).alias("key"), F.round(parse_price(F.nullif(raw, F.lit(""))), 2).alias("value")))
    return F.filter(F.array(*rows), lambda r: r["value"].isNotNull())


def named_candidate_array(text: Column) -> Column:
    rows = F.transform(named_prices(text), lambda n: _candidate(n["value"], F.lit(20) + path_bonus(n["key"]), F.concat(F.lit("named:"), n["key"])))
    return F.when(F.lower(text).rlike('"(total|product|shipping)_'), rows).otherwise(F.array().cast(f"array<{CANDIDATE}>"))


def named_candidates(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    return df.select(*keep, F.inline(named_candidate_array(F.col(text))))


# ---- candidates from JSON -----------------------------------------------------------------------------------------------

def json_candidate_array(found: Column) -> Column:
    """Candidates of a body's leaves: numbers and texts under price-like keys, plus prices inside text leaves."""
    none = F.array().cast(f"array<{CANDIDATE}>")
    # one pattern leaves out nearly all leaves before any weight is worked out
    telling = "|".join(re.escape(t.lower()) for t, _ in vocab.PRICE_KEY_WEIGHT)
    weighted = F.transform(
        F.filter(found, lambda x: ~x["path"].endswith("]") & (F.lower(x["leaf_key"]).rlike(telling) | F.contains(x["value"], F.lit("<")))),
        lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value"), x["number"].alias("number"), x["kind"].alias("kind"), key_weight(x["leaf_key"]).alias("w")),
    )
    kept = F.filter(weighted, lambda x: (x["w"] > 0) | F.contains(x["value"], F.lit("<")))
    # a path's bonus and a text's price are bound here, so that each is worked out once
    valued = F.transform(
        kept,
        lambda x: F.struct(
            x["path"].alias("path"), x["w"].alias("w"), path_bonus(x["path"]).alias("bonus"), F.when(x["kind"] == "text", x["value"]).alias("text"),
            F.when(x["kind"] == "number", x["number"]).when((x["kind"] == "bool") & (x["value"] == "true"), F.lit(1.0)).alias("number"),
            F.when((x["kind"] == "text") & (x["w"] > 0), parse_price(x["value"])).alias("parsed"),
        ),
    )

    def of_leaf(x: Column) -> Column:
        from_number = F.when((x["w"] > 0) & (x["number"] >= 0), F.array(_candidate(x["number"], x["w"] + x["bonus"], F.concat(F.lit("json:"), x["path"]))))
        from_text = F.when(x["parsed"].isNotNull(), F.array(_candidate(x["parsed"], x["w"] + x["bonus"], F.concat(F.lit("json_str:"), x["path"]))))
        text = x["text"]
        mined = F.when(
            text.rlike(r"\d[,.]\d\d") & ((F.contains(text, F.lit("<")) & F.contains(text, F.lit(">"))) | (x["w"] > 0)),
            keyword_candidates(text, F.concat(F.lit("json_html:"), x["path"]), F.greatest(F.lit(0), x["w"] - 2)),
        )
        return F.concat(*[F.coalesce(a, none) for a in (from_number, from_text, mined)])

    return F.filter(F.flatten(F.transform(valued, of_leaf)), lambda c: _in_range(c["value"]))


def json_candidates(df: DataFrame, keep: list[str], body: str) -> DataFrame:
    d = df.select(*keep, leaves(parse(F.col(body))).alias("_leaves"))
    return d.select(*keep, F.inline(json_candidate_array(F.col("_leaves"))))


def plain_number_prices(df: DataFrame, keep: list[str], body: str) -> DataFrame:
    """Non-negative numbers under price-like keys, unscored."""
    leaves = walk(df.withColumn("_body_v", parse(F.col(body))), "_body_v", keep)
    hit = contains_any(F.lower("leaf_key"), vocab.PRICE_KEYS_PLAIN) & ~F.col("path").endswith("]")
    return leaves.filter((F.col("kind") == "number") & (F.col("number") >= 0) & hit).select(*keep, "path", F.col("number").alias("value"))


def matrix_rows(df: DataFrame, keep: list[str], body: str) -> DataFrame:
    """quantity / price rows of list-valued top-level fields of a JSON body."""
    spark = df.sparkSession
    d = df.withColumn("_v", parse(F.col(body))).filter("_v is not null")
    top = d.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).filter("key is not null").select(
        *keep, F.col("key").alias("field"), F.col("value").alias("_items")
    ).filter(F.schema_of_variant("_items").startswith("ARRAY"))
    item = top.lateralJoin(spark.tvf.variant_explode(F.col("_items").outer())).select(
        *keep, "field", F.col("pos").alias("row_no"), F.col("value").alias("_row")
    ).filter(F.schema_of_variant("_row").startswith("OBJECT"))
    cell = item.lateralJoin(spark.tvf.variant_explode(F.col("_row").outer())).select(
        *keep, "field", "row_no", F.col("pos").alias("_p"), F.lower("key").alias("_k"), F.try_variant_get("value", "$", "string").alias("_c")
    )
    qty, price = F.col("_k").isin("quantity", "qty"), F.contains("_k", F.lit("price"))
    return cell.groupBy(*keep, "field", "row_no").agg(
        F.min_by("_c", F.when(qty, F.col("_p"))).alias("quantity"), F.min_by("_c", F.when(price, F.col("_p"))).alias("price")
    ).filter("quantity is not null and price is not null")


def adapter_price(df: DataFrame, body: str, price_path: str, currency_path: str | None = None, currency: str | None = None) -> DataFrame:
    """Price by declared path; such a result outranks mined candidates (score 1000)."""
    v = parse(F.col(body))
    code = F.lit(currency) if currency else (get(v, currency_path) if currency_path else F.lit(""))
    d = df.withColumn("price", F.round(coerce_price(get(v, price_path)), 2)).withColumn("currency", F.coalesce(F.trim(code), F.lit("")))
    return d.filter("price is not null").withColumn("score", F.lit(1000)).withColumn("source", F.lit("adapter"))


# ---- candidates from page text -----------------------------------------------------------------------------------------

def line_context(lines: DataFrame, keys: list[str], ordinal: str, text: str, block: int = 4096) -> DataFrame:
    """Each line with its neighbours, as ``context``. A unit is cut into blocks of positions; a block's first and last
    line go to the block beside it, too, so a long unit is never sorted in one task."""
    at = F.pmod(F.col(ordinal) - 1, F.lit(block))
    own = F.floor((F.col(ordinal) - 1) / block)
    blocks = F.when(at == 0, F.array(own - 1, own)).when(at == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    w = _window([*keys, "_blk"], [F.asc(ordinal)])
    beside = lambda step, d: F.when(step(ordinal).over(w) == F.col(ordinal) + d, step(text).over(w))
    spread = lines.withColumn("_own", own).withColumn("_blk", F.explode(blocks))
    d = spread.withColumn("context", F.concat_ws(" ", beside(F.lag, -1), F.col(text), beside(F.lead, 1)))
    rest = [c for c in lines.columns if c not in (*keys, ordinal, text)]
    return d.filter((F.col("_own") == F.col("_blk")) & F.col(text).isNotNull()).select(*keys, ordinal, text, "context", *rest)


def summary_line_candidates(lines: DataFrame, keys: list[str], ordinal: str, text: str) -> DataFrame:
    """Prices of summary lines, scored by the words around them."""
    d = line_context(lines, keys, ordinal, text).filter(F.trim(F.col(text)) != "")
    low, own = F.lower("context"), F.lower(F.col(text))
    around = F.when(contains_any(own, ["€", "eur"]), price_numbers(F.col("context"))).otherwise(F.array().cast("array<double>"))
    # the one-element array binds the line's own numbers
    numbers = F.flatten(F.transform(F.array(price_numbers(F.trim(F.col(text)))), lambda mine: F.when(F.size(mine) > 0, mine).otherwise(around)))
    score = (
        F.lit(10) + F.when(contains_any(low, ["inkl", "mwst", "vat", "versand", "shipping", "brutto", "gross"]), 2).otherwise(0)
        + F.when(contains_any(low, ["netto", "net"]), 1).otherwise(0)
        - F.when(contains_any(low, ["stueck", "stück", "single", "unit"]), 3).otherwise(0)
    )
    values = F.array_distinct(F.transform(numbers, lambda v: F.round(v, 2)))
    return d.select(
        *keys, F.explode(values).alias("value"), score.alias("score"),
        F.concat(F.lit("price_summary:line:"), F.col(ordinal).cast("string")).alias("source"),
    )


def selected_option_candidates(rows: DataFrame, keys: list[str], hint: str, text: str) -> DataFrame:
    """Prices that stand in selected option texts."""
    low = F.lower(F.col(text))
    d = rows.filter(contains_any(low, ["€", "eur", "preis", "price", "brutto", "gross", "netto", "net"]))
    score = (
        F.lit(12) + F.when(contains_any(low, ["gesamt", "total", "endpreis", "brutto", "gross"]), 6).otherwise(0)
        - F.when(contains_any(low, ["stueck", "stück", "unit", "single"]), 4).otherwise(0)
    )
    values = F.array_distinct(F.transform(price_numbers(F.col(text)), lambda v: F.round(v, 2)))
    out = d.select(*keys, F.explode(values).alias("value"), score.alias("score"), F.concat(F.lit("selected_config:"), F.col(hint)).alias("source"))
    return out.groupBy(*keys, "source", "value").agg(F.max("score").alias("score")).select(*keys, "value", "score", "source")


def vat_rates(lines: DataFrame, keys: list[str], ordinal: str, text: str) -> DataFrame:
    """First tax rate named on the lines of each unit."""
    pct = vat_percent(F.col(text))
    return lines.withColumn("_p", pct).filter("_p is not null").groupBy(*keys).agg(F.min_by("_p", ordinal).alias("vat_percent"))


def derived_gross_candidates(cands: DataFrame, rates: DataFrame, keys: list[str], seeds: int = 6, near: float = 0.6) -> DataFrame:
    """Net seeds from selected options times the tax rate; only seeds near the largest one."""
    pool = cands.filter((F.col("value") > 0) & F.col("source").startswith("selected_config:"))
    once = best_row(pool, [*keys, "value"], [F.col("score"), F.col("source")], ["score", "source"])
    biggest = once.groupBy(*keys).agg(F.max("value").alias("_max"))
    lead = top_k(once, keys, [F.desc("score"), F.desc("value")], seeds, "_rn")
    d = lead.join(biggest, keys).join(rates, keys)
    rate = F.lit(1).cast("decimal(4,0)") + F.col("vat_percent").cast("decimal(6,2)") * F.lit(0.01).cast("decimal(3,2)")
    gross = F.round(F.col("value").cast("decimal(18,2)") * rate, 2).cast("double")
    d = d.filter(F.col("value") >= F.col("_max") * near).withColumn("_g", gross).filter(F.abs(F.col("_g") - F.col("value")) >= 0.01)
    return d.select(
        *keys, F.col("_g").alias("value"), F.greatest(F.lit(1), F.col("score") - 2).alias("score"),
        F.concat(F.format_string("derived_vat:%.2f%%:", "vat_percent"), F.col("source")).alias("source"),
    )


# ---- views and selection -------------------------------------------------------------------------------------------------

def combine(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def compact(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Best score per (value, source)."""
    d = cands.withColumn("value", F.round("value", 2))
    return d.groupBy(*keys, "value", "source").agg(F.max("score").alias("score"))


def candidate_view(cands: DataFrame, keys: list[str], limit: int = 120, raw_limit: int = 300) -> DataFrame:
    """Report view: per unit the leading candidates, with caps per group."""
    order = [F.desc("score"), F.desc("value"), F.asc("source")]
    raw = top_k(compact(cands, keys), keys, order, raw_limit, "_raw").withColumn("grp", candidate_group(F.col("source")))
    ranked = raw.withColumn("_g", F.row_number().over(_window([*keys, "grp"], order)))
    cap = reduce(lambda c, kv: c.when(F.col("grp") == kv[0], kv[1]), vocab.GROUP_REPORT_CAP.items(), F.when(F.lit(False), 0))
    return top_k(ranked.filter(F.col("_g") <= cap), keys, order, limit, "place").drop("_g", "_raw")


def _window(keys, order):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(*order)


def group_counts(cands: DataFrame, keys: list[str]) -> DataFrame:
    d = compact(cands, keys).withColumn("grp", candidate_group(F.col("source")))
    return d.groupBy(*keys).agg(*[F.count_if(F.col("grp") == g).alias(f"n_{g}") for g in vocab.GROUP_PRIORITY])


def select_best(cands: DataFrame, keys: list[str], expected: str | None = None) -> DataFrame:
    """One candidate per unit.

    Per value the best total score (score + path + group); then score, group priority, and nearness to the expected
    price where one is known, else the larger value. Partial aggregation only.
    """
    d = cands.filter(_in_range(F.col("value"))).withColumn("value", F.round("value", 2)).withColumn("_w", source_weights(F.col("source")))
    d = d.withColumn("total", F.col("score") + F.col("_w.bonus") + F.col("_w.prio")).withColumn("grp", F.col("_w.grp"))
    carry = [expected] if expected else []
    # the group follows from the source, so it does not change the order
    per_value = d.groupBy(*keys, "value", *carry).agg(F.max(F.struct("total", "source", "grp")).alias("b")).select(*keys, "value", *carry, "b.total", "b.source", "b.grp")
    near = F.col("value") if not expected else F.when(F.col(expected).isNull(), F.col("value")).otherwise(-F.abs(F.col("value") - F.col(expected)))
    order = F.struct(F.col("total"), group_priority(F.col("grp")).alias("p"), near.alias("n"), F.col("value"))
    out = per_value.groupBy(*keys).agg(F.max_by(F.struct("value", "total", "source", "grp"), order).alias("b"))
    return out.select(*keys, F.col("b.value").alias("price"), F.col("b.total").alias("score"), F.col("b.source").alias("price_source"), F.col("b.grp").alias("price_group"))


def trace_price_candidates(traces: DataFrame, keep: list[str]) -> DataFrame:
    """All candidates of each trace body. The body is parsed and walked once, and its candidates are unnested once.

    JSON: its leaves; where they give no price, keyword text of the whole body. Other bodies: keyword text if a price word
    stands in them. Both: named totals.
    """
    body = F.col("response_body_preview")
    t = traces.filter(F.trim(F.coalesce(body, F.lit(""))) != "").select(*keep, body, "response_content_type", leaves(parse(body)).alias("_leaves"))
    t = t.withColumn("_json", json_candidate_array(F.col("_leaves")))
    is_json, priced = F.col("_leaves").isNotNull(), contains_any(F.lower(body), vocab.PRICE_TEXT_TOKENS)
    prefix = F.when(is_json, "captured_trace_json_text").when(F.contains(F.lower("response_content_type"), F.lit("html")), "captured_trace_html").otherwise("captured_trace_text")
    none = F.array().cast(f"array<{CANDIDATE}>")
    text = F.when(priced & (F.coalesce(F.size("_json"), F.lit(0)) <= 0), text_candidate_array(body, prefix)).otherwise(none)
    named = F.when(is_json | priced, named_candidate_array(body)).otherwise(none)
    return t.select(*keep, F.inline(F.concat(F.coalesce("_json", none), text, named)))


def bootstrap_allowed(url: Column) -> Column:
    """Whether candidates of the page itself may stand in for an endpoint's own."""
    low = F.lower(url)
    return ~F.contains(low, F.lit("/api/")) & ~F.contains(low, F.lit("://api."))


def priced_endpoints(traces: DataFrame, ranked: DataFrame) -> DataFrame:
    """run_id, rank, url, endpoint_score and the last trace of the urls to read, in order: the endpoints with a score,
    or where a run has none of these all its urls as they were captured. Noise is left out afterwards."""
    from quotelens.functions.urls import is_price_noise

    # a rank is a number, or the key of ordered_endpoints; urls without one come in the order of their capture
    place = lambda s, c, t: F.struct(s.cast("long").alias("s"), c.cast("double").alias("c"), t.cast("long").alias("t"))
    rank = F.col("rank") if ranked.schema["rank"].dataType.typeName() == "struct" else place(F.col("rank"), F.lit(0), F.lit(0))
    scored = ranked.filter(F.col("score") > 0).select("run_id", rank.alias("rank"), "url", F.col("score").cast("int").alias("endpoint_score"))
    last = best_row(traces, ["run_id", "url"], [F.col("trace_idx")], ["trace_idx", "response_body_preview", "response_content_type"])
    score = ranked.groupBy("run_id", "url").agg(F.max("score").cast("int").alias("endpoint_score"))
    bare = traces.join(scored.select("run_id").distinct(), "run_id", "left_anti").groupBy("run_id", "url").agg(place(F.lit(0), F.lit(0), F.min("trace_idx")).alias("rank"))
    urls = scored.unionByName(bare.join(score, ["run_id", "url"], "left").select("run_id", "rank", "url", "endpoint_score"))
    return urls.filter(~is_price_noise(F.col("url"))).join(last, ["run_id", "url"])


def prices_from_traces(traces: DataFrame, ranked: DataFrame, expected: DataFrame | None = None, page: DataFrame | None = None) -> DataFrame:
    """Price per run: of the urls in order, the first whose last trace yields a price.

    ``page``: run_id, value, score, source of what the page itself shows (selected options, summary lines, VAT). They
    join the candidates of urls outside the API; the first such url that can be read has a price then, so they are joined to it alone.
    """
    t = priced_endpoints(traces, ranked)
    if page is not None:  # candidates and the page's url read it
        t = written(t)
    keys = ["run_id", "rank", "url", "endpoint_score"]
    cands = trace_price_candidates(t, keys)
    if page is not None:
        body = F.trim(F.coalesce("response_body_preview", F.lit("")))
        readable = (body != "") & (parse(body).isNotNull() | contains_any(F.lower(body), vocab.PRICE_TEXT_TOKENS))
        first = best_row(t.filter(readable & bootstrap_allowed(F.col("url"))), ["run_id"], [F.col("rank")], ["rank", "url", "endpoint_score"], smallest=True)
        cands = cands.unionByName(salted_join(page, first, ["run_id"], F.xxhash64("value", "source")).select(*keys, "value", "score", "source"))
    if expected is not None:
        cands = cands.join(expected.select("run_id", "expected_price"), "run_id", "left")
    best = select_best(cands, keys, "expected_price" if expected is not None else None)
    return best_row(best, ["run_id"], [F.col("rank")], ["url", "endpoint_score", "price", "score", "price_source", "price_group"], smallest=True)


def prices_from_dom(dom: DataFrame, others: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """DOM prices by stage (after, before, any) with the page's other candidates; the first stage with prices decides.

    ``dom``: keys, stage (0 after, 1 before, 2 any), value. ``others``: keys, value, score, source. ``expected``: keys, expected_price.
    """
    positive = dom.filter("value > 0")
    least = positive.groupBy(*keys).agg(F.min(F.struct("stage", F.col("value").alias("lowest"))).alias("_f"))
    first = written(least.select(*keys, "_f.stage", "_f.lowest"))
    label = F.element_at(F.array(F.lit("browser_dom_post_interaction"), F.lit("browser_dom_pre_interaction"), F.lit("browser_dom")), F.col("stage") + 1)
    staged = positive.join(first.select(*keys, "stage").hint("merge"), [*keys, "stage"]).select(*keys, "value", F.lit(1).alias("score"), F.concat(F.lit("dom:"), label).alias("source"))
    # candidates of pages without DOM prices go where the first stages are joined
    pool = combine(staged, others.select(*keys, "value", "score", "source"))
    best = select_best(pool, keys) if expected is None else select_best(pool.join(expected, keys, "left"), keys, "expected_price")
    return first.select(*keys, label.alias("replay"), "lowest").join(best, keys, "left").withColumn("price", F.coalesce("price", "lowest"))


def extraction_tier(http: DataFrame, trace: DataFrame, dom: DataFrame, units: DataFrame, request_only: Column | None = None) -> DataFrame:
    """http, then captured trace, then DOM; ``request_only`` units accept only the first tier."""
    def tier(d: DataFrame, n: int, label: str) -> DataFrame:
        return d.select("run_id", F.lit(n).alias("tier"), F.lit(label).alias("replay_mode"), "price")

    pool = combine(tier(http, 0, "http"), tier(trace, 1, "captured_trace"), tier(dom, 2, "browser_dom"))
    best = best_row(pool.filter("price is not null"), ["run_id"], [F.col("tier")], ["tier", "replay_mode", "price"], smallest=True)
    d = units.join(best, "run_id", "left")
    only = F.lit(False) if request_only is None else request_only
    barred = only & (F.coalesce("tier", F.lit(9)) > 0)
    return d.select(
        *units.columns, F.when(~barred, F.col("price")).alias("price"),
        F.when(barred | F.col("replay_mode").isNull(), "none").otherwise(F.col("replay_mode")).alias("replay_mode"),
        F.when(barred, "request_only_http_replay_failed").when(F.col("price").isNull(), "no_replay_price_extracted").alias("extraction_reason"),
    )


def site_reference(cands: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """Reference price of the site: first top-level total of the report order, else a named total.

    ``named``: keys, key, value.
    """
    c = compact(cands, keys).withColumn("grp", candidate_group(F.col("source"))).filter("grp = 'top_level_total'")
    top = best_row(c, keys, [F.col("score"), F.col("value"), F.col("source")], ["value", "source"])
    rank = F.array_position(F.array(*[F.lit(k) for k in vocab.SITE_REFERENCE_NAMED]), F.col("key"))
    nm = best_row(named.withColumn("_o", rank).filter("_o > 0"), keys, [F.col("_o")], ["value", "key"], smallest=True)
    a = top.select(*keys, F.col("value").alias("_tv"), F.col("source").alias("_ts"))
    b = nm.select(*keys, F.col("value").alias("_nv"), F.col("key").alias("_nk"))
    d = a.join(b, keys, "full_outer")
    return d.select(
        *keys, F.coalesce("_tv", F.round("_nv", 2)).alias("reference_price"),
        F.coalesce("_ts", F.concat(F.lit("named:"), F.col("_nk"))).alias("reference_source"),
        F.when(F.col("_tv").isNotNull(), "grouped_top_level_total").otherwise("named_total").alias("reference_kind"),
    )


def price_delta(price: Column, reference: Column, tolerance: Column) -> tuple[Column, Column]:
    delta = F.round(price - reference, 2)
    return delta, F.abs(delta) <= F.greatest(F.lit(0.0), tolerance)


# ---- prices of rendered pages --------------------------------------------------------------------------------------------

def page_lines(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Visible text lines of a page with their position: scripts and styles off, block tags as line ends."""
    from quotelens.functions.text import unescape_html

    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", " ")
    body = F.regexp_replace(body, r"(?i)</?(p|div|li|ul|ol|h[1-6]|br|tr|td|table|section|article|nav|footer|header)\b[^>]*>", "\n")
    body = unescape_html(F.regexp_replace(body, r"<[^>]+>", ""))
    rows = pages.select(*keep, F.posexplode(F.split(body, r"\n+")).alias("_p", "_l"))
    return rows.select(*keep, F.col("_p").alias("line_no"), F.trim(F.regexp_replace("_l", r"\s+", " ")).alias("line")).filter("line <> ''")


def page_price_lines(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Lines that name a price or currency, whatever their length."""
    return page_lines(pages, keep, html).filter(F.lower("line").rlike("€|eur|price|preis"))
