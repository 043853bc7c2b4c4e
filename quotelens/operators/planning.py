"""Which units to run: ids, resume, stage selection, state folding (jobs over manifests and unit state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.text import option_value_type
from quotelens.operators.skew import with_ordinal


def _ascii_json(text: Column) -> Column:
    """JSON string literal in ASCII."""
    low = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        low = F.replace(low, F.lit(raw), F.lit(esc))

    def unit(cp: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(cp)), 4, "0"))

    def char(c: Column) -> Column:
        cp = F.ascii(c)
        high = F.floor((cp - 0x10000) / 0x400) + 0xD800
        low_s = (cp - 0x10000) % 0x400 + 0xDC00
        return F.when(cp < 128, c).when(cp < 0x10000, unit(cp)).otherwise(F.concat(unit(high), unit(low_s)))

    wide = F.array_join(F.transform(F.split(low, ""), char), "")
    return F.concat(F.lit('"'), F.when(low.rlike(r"[^\x00-\x7f]"), wide).otherwise(low), F.lit('"'))


def _json_number(value: Column) -> Column:
    plain = F.regexp_replace(value.cast("decimal(30,8)").cast("string"), r"(\.\d*?[1-9])0+$|\.0+$", "$1")
    plain = F.when(F.contains(plain, F.lit(".")), plain).otherwise(F.concat(plain, F.lit(".0")))
    return F.when(value.isNull(), F.lit("null")).when(F.abs(value) >= 1e7, plain).otherwise(value.cast("string"))


def unit_id(
    url: Column, site: Column, product: Column, currency: Column, price: Column, options: Column, typed: bool = False
) -> Column:
    """``unit_`` + sha1 of the canonical spec: sorted keys, compact, ASCII.

    ``options`` is a MAP of texts. With ``typed`` the values are written by their type (numbers and booleans bare).
    """
    entries = F.array_sort(F.map_entries(F.coalesce(options, F.create_map().cast("map<string,string>"))))

    def entry(e: Column) -> Column:
        value = _ascii_json(e["value"])
        if typed:
            kind = option_value_type(e["value"])
            bare = F.when(kind == "null", F.lit("null")).otherwise(F.lower(F.trim(e["value"])))
            value = F.when(kind == "str", value).otherwise(bare)
        return F.concat(_ascii_json(e["key"]), F.lit(":"), value)

    body = F.concat(
        F.lit('{"expected_currency":'), _ascii_json(F.trim(F.coalesce(currency, F.lit("EUR")))),
        F.lit(',"expected_price":'), _json_number(price),
        F.lit(',"options":{'), F.array_join(F.transform(entries, entry), ","),
        F.lit('},"product_type":'), _ascii_json(F.trim(F.coalesce(product, F.lit("unknown")))),
        F.lit(',"site_name":'), _ascii_json(F.trim(F.coalesce(site, F.lit("")))),
        F.lit(',"url":'), _ascii_json(F.trim(F.coalesce(url, F.lit("")))), F.lit("}"),
    )
    return F.concat(F.lit("unit_"), F.sha1(body))


def fold_state(events: DataFrame, unit: str = "unit_id", seq: str = "seq", status: str = "status") -> DataFrame:
    """Current state per unit from an event log.

    Completion clears failure and skip; a failure clears a skip but leaves an older completion in place.
    """
    last = {s: F.max(F.when(F.col(status) == s, F.col(seq))) for s in ("completed", "failed", "skipped")}
    d = events.groupBy(unit).agg(*[expr.alias(f"_{s}") for s, expr in last.items()])
    done = F.col("_completed").isNotNull()
    failed = F.col("_failed").isNotNull() & (~done | (F.col("_failed") > F.col("_completed")))
    blocker = F.greatest(F.coalesce("_completed", F.lit(-1)), F.coalesce("_failed", F.lit(-1)))
    skipped = F.col("_skipped").isNotNull() & (F.col("_skipped") > blocker)
    status_now = F.when(done, "completed").when(failed, "failed").when(skipped, "skipped").otherwise("pending")
    return d.select(
        unit,
        done.alias("is_completed"),
        failed.alias("is_failed"),
        skipped.alias("is_skipped"),
        status_now.alias("state"),
        F.greatest("_completed", "_failed", "_skipped").alias("updated"),
    )


def latest_rows(log: DataFrame, unit: str, order: list[str]) -> DataFrame:
    """Upsert view of an append log: the newest row per unit."""
    rest = [c for c in log.columns if c != unit]
    packed = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return log.groupBy(unit).agg(packed).select(unit, *[F.col("_r")[c].alias(c) for c in rest])


def resume_decisions(
    units: DataFrame, state: DataFrame, unit: str = "unit_id", retry_failed: bool = False, skip_is_terminal: bool = False
) -> DataFrame:
    """Each unit with ``should_process`` and the reason when it is left out."""
    reason = F.when(F.col("_state") == "completed", "already_completed")
    if not retry_failed:
        reason = reason.when(F.col("_state") == "failed", "already_failed")
    if skip_is_terminal:
        reason = reason.when(F.col("_state") == "skipped", "already_skipped")
    known = state.select(unit, F.col("state").alias("_state"))
    joined = units.join(known, unit, "left").withColumn("skip_reason", reason)
    return joined.withColumn("should_process", F.col("skip_reason").isNull()).drop("_state")


def pending_units(units: DataFrame, state: DataFrame, unit: str = "unit_id", retry_failed: bool = False) -> DataFrame:
    """Anti-join form: only the units to run."""
    terminal = ["completed"] if retry_failed else ["completed", "failed"]
    return units.join(state.filter(F.col("state").isin(terminal)).select(unit), unit, "left_anti")


def select_stage_units(units: DataFrame, consumed: DataFrame, budget: int, order: list[str], unit: str = "unit_id") -> DataFrame:
    """First ``budget`` units in manifest order that no earlier stage has taken."""
    fresh = units.join(consumed.select(unit).distinct(), unit, "left_anti")
    return fresh.orderBy(*order).limit(max(1, budget))


def repeat_first_unit(units: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """The first unit ``budget`` times, numbered from 1."""
    first = units.orderBy(*order).limit(1)
    return first.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.lit(max(1, budget)))))


def stage_unit_id(unit: Column, stage: Column, repeat_no: Column | None = None) -> Column:
    return F.concat_ws("::", unit, stage, *( [repeat_no.cast("string")] if repeat_no is not None else []))


def combine_manifests(primary: DataFrame, generated: DataFrame) -> DataFrame:
    return primary.unionByName(generated, allowMissingColumns=True)


def skip_pairs(done: DataFrame, failed: DataFrame | None, keys: list[str]) -> DataFrame:
    """Pairs to leave out: done, plus failed where those are not to be retried."""
    pairs = done.select(*keys)
    if failed is not None:
        pairs = pairs.union(failed.select(*keys))
    return pairs.distinct()


def expand_quantities(units: DataFrame, quantities: list[int], name: str = "quantity") -> DataFrame:
    """Every unit with every quantity of the fixed list; a generator, not a join."""
    return units.withColumn(name, F.explode(F.array(*[F.lit(q) for q in quantities])))


def round_robin(units: DataFrame, keys: list[str], order: list[str], bucket: Column, chunks: int) -> DataFrame:
    """Chunk number per unit: position inside its variant modulo the number of chunks."""
    return with_ordinal(units, keys, order, bucket, "_pos").withColumn(
        "chunk_no", F.pmod(F.col("_pos") - 1, F.lit(chunks)).cast("int")
    ).drop("_pos")


def is_successful(final_status: Column, validated: Column, feasible: Column) -> Column:
    """An explicit final status decides; else validated and feasible (true unless told otherwise)."""
    explicit = F.nullif(F.lower(F.trim(final_status)), F.lit(""))
    return F.when(explicit.isNotNull(), explicit == "completed").otherwise(
        F.coalesce(validated, F.lit(False)) & F.coalesce(feasible, F.lit(True))
    )


def merge_options(*sources: Column) -> Column:
    """Option maps merged by precedence; earlier arguments win."""
    sources = tuple(F.coalesce(s, F.create_map().cast("map<string,string>")) for s in sources)
    out = sources[-1]
    for stronger in reversed(sources[:-1]):
        out = F.map_concat(_without_keys(out, stronger), stronger)
    return out


def _without_keys(options: Column, other: Column) -> Column:
    return F.map_filter(options, lambda k, _v: ~F.map_contains_key(other, k))


def split_option_pair(text: Column) -> Column:
    """``key=value`` split at the first '='."""
    key = F.trim(F.substring_index(text, "=", 1))
    value = F.regexp_replace(text, r"^[^=]*=", "")
    return F.when(F.contains(text, F.lit("=")) & (key != ""), F.struct(key.alias("key"), F.trim(value).alias("value")))
