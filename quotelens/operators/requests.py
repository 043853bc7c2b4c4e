"""Request tables: template choice, injected bodies, rewritten forms and queries, with an audit of every change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.text import bound, decode_template
from quotelens.functions.urls import encode_pairs, form_pairs, netloc, path, replace_pair, scheme
from quotelens.operators.skew import best_row, salted_join

# ---- templates ---------------------------------------------------------------------------------------------------------------


def pick_templates(traces: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """Best template trace per unit and rule; the later trace wins a tie, unless the rule says ``first``.

    ``rules``: rule, url_part, body_part, url_points, body_points, post_points, min_score, take (first / last).
    A handful of rule rows; Spark's own size estimate decides on a broadcast.
    """
    url, body = F.lower("url"), F.lower(F.coalesce("post_data", F.lit("")))
    hit = F.contains(url, F.col("url_part"))
    score = (
        F.when(hit, F.col("url_points")).otherwise(0)
        + F.when((F.col("body_part") != "") & F.contains(body, F.col("body_part")), F.col("body_points")).otherwise(0)
        + F.when(F.upper("method") == "POST", F.col("post_points")).otherwise(0)
    )
    d = traces.join(rules, hit).withColumn("template_score", score).filter(F.col("template_score") >= F.col("min_score"))
    place = F.when(F.col("take") == "first", -F.col("trace_idx")).otherwise(F.col("trace_idx"))
    return best_row(d, [*keys, "rule"], [F.col("template_score"), place], ["trace_idx", "url", "post_data", "template_score"])


def last_values(traces: DataFrame, keys: list[str], value: Column, order: str) -> DataFrame:
    """Newest non-null value per unit."""
    d = traces.withColumn("_v", value)
    return d.groupBy(*keys).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("last_value"))


def first_header(traces: DataFrame, keys: list[str], header: str, order: str, default: str) -> DataFrame:
    """First non-empty header value per unit, else the default."""
    value = F.nullif(F.trim(F.element_at(F.transform_keys("request_headers", lambda k, _v: F.lower(k)), header)), F.lit(""))
    d = traces.withColumn("_v", value)
    found = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(order)))
    return d.groupBy(*keys).agg(F.coalesce(found, F.lit(default)).alias("header_value"))


def trace_by_url(endpoints: DataFrame, traces: DataFrame, keys: list[str], first: bool = True) -> DataFrame:
    """Trace of each endpoint by URL: the first or the last captured one."""
    keep = [c for c in traces.columns if c not in (*keys, "url")]
    one = best_row(traces, [*keys, "url"], [F.col("trace_idx")], keep, smallest=first)
    return endpoints.join(one, [*keys, "url"], "left")


# ---- JSON bodies --------------------------------------------------------------------------------------------------------------

_PATH_OK = r"^\s*\$?\.?(?:\s*[^.\[\]\s][^.\[\]]*)(?:\.+[^.\[\]]*[^.\[\]\s][^.\[\]]*|\[\s*\d+\s*\])*\s*$"


def _set_paths(template, paths, values) -> Column:
    """Small helper: a JSON template with JSON values placed at paths, in order.

    Everything the tasks need is nested here, so it travels with the query and needs no installed package.
    """
    import json
    import re

    import pandas as pd

    step = re.compile(r"\[\s*(\d+)\s*\]|([^.\[\]]+)")

    def placed(node, steps, value):
        # missing or wrong containers on the way are built new
        if not steps:
            return value
        head, rest = steps[0], steps[1:]
        if isinstance(head, int):
            items = list(node) if isinstance(node, list) else []
            blank = None if not rest else ([] if isinstance(rest[0], int) else {})
            items += [blank] * (head + 1 - len(items))
            items[head] = placed(items[head], rest, value)
            return items
        fields = dict(node) if isinstance(node, dict) else {}
        fields[head] = placed(fields.get(head), rest, value)
        return fields

    def bodies(template, paths, values):
        out = []
        for body, where, what in zip(template, paths, values, strict=True):
            node = json.loads(body) if body else {}
            for p, v in zip(where if where is not None else [], what if what is not None else [], strict=True):
                steps = [int(i) if i else name.strip() for i, name in step.findall(p.strip().removeprefix("$"))]
                node = placed(node, steps, json.loads(v))
            out.append(json.dumps(node, separators=(",", ":"), ensure_ascii=False))
        return pd.Series(out, dtype="object")

    bodies.__annotations__ = {"template": pd.Series, "paths": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(bodies, "string")(template, paths, values)


def set_json(template: Column, values: dict[str, Column]) -> Column:
    """Template body with JSON-encoded values at the given paths."""
    return _set_paths(template, F.array(*[F.lit(p) for p in values]), F.array(*values.values()))


def json_text(value: Column) -> Column:
    """Text as a JSON string literal."""
    quoted = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(quoted, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def injection_audit(inputs: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (unit, rule) whose input is present: applied value or the reason it was skipped.

    ``inputs``: keys, adapter_id, input_key, raw_value. ``rules``: adapter_id, rule_no, input_key, path, cast_to,
    value_map (MAP or null), require_mapped. Rules are declared, a few per adapter, and go to every task: all units of an
    adapter have the same few keys, so a shuffle by them would put a share of all inputs into one task.
    """
    d = inputs.join(F.broadcast(rules.filter("input_key <> '' and path <> ''")), ["adapter_id", "input_key"])
    m, raw = F.col("value_map"), F.col("raw_value")
    mapped = F.coalesce(F.element_at(m, raw), F.element_at(m, F.trim(raw)), F.element_at(m, F.lower(F.trim(raw))))
    d = d.withColumn("_mapped", mapped)
    value = F.coalesce("_mapped", "raw_value")
    cast_to = F.lower(F.trim(F.coalesce("cast_to", F.lit(""))))
    as_int = F.when(F.trim(value).rlike(r"^[-+]?\d+$"), F.trim(value).try_cast("bigint").cast("string"))
    as_num = F.trim(value).try_cast("double").cast("string")
    cast_value = F.when(cast_to == "int", as_int).when(cast_to == "float", as_num).otherwise(json_text(value))
    d = d.withColumn("value_json", cast_value)
    status = (
        F.when(F.coalesce("require_mapped", F.lit(False)) & F.col("_mapped").isNull(), "value_not_in_map")
        .when(F.col("value_json").isNull(), "cast_failed").when(~F.col("path").rlike(_PATH_OK), "path_unreachable").otherwise("applied")
    )
    return d.withColumn("status", status).select(*keys, "adapter_id", "rule_no", "input_key", "path", "raw_value", "status", F.when(F.col("status") == "applied", F.col("value_json")).alias("value_json"))


def injected_bodies(units: DataFrame, audit: DataFrame, keys: list[str]) -> DataFrame:
    """Request body per unit: the adapter's template with the applied values in rule order."""
    per = audit.filter("status = 'applied'").groupBy(*keys, "adapter_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_no", "path", "value_json"))).alias("_a")
    )
    d = units.join(per, [*keys, "adapter_id"], "left").withColumn("_a", F.coalesce("_a", F.array().cast("array<struct<rule_no:int,path:string,value_json:string>>")))
    body = _set_paths("request_template", F.transform("_a", lambda a: a["path"]), F.transform("_a", lambda a: a["value_json"]))
    return d.withColumn("body_text", body).withColumn("injected", F.size("_a")).drop("_a")


def unsupported_inputs(inputs: DataFrame, rules: DataFrame) -> DataFrame:
    """Requested inputs no rule of the adapter reads."""
    return inputs.filter("trim(input_key) <> ''").join(rules.select("adapter_id", F.trim("input_key").alias("input_key")).distinct(), ["adapter_id", "input_key"], "left_anti")


def join_url(base: Column, target: Column) -> Column:
    """Absolute URL of a link on a page."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    return (
        F.when(F.contains(target, F.lit("://")), target).when(target.startswith("//"), F.concat(scheme(base), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target)).otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), target))
    )


def adapter_requests(bodies: DataFrame) -> DataFrame:
    """Request rows of declared adapters: absolute URL, method, body for POST, content type where none is given."""
    post = F.upper(F.coalesce("endpoint_method", F.lit("POST"))) == "POST"
    return bodies.withColumn("url", join_url(F.col("target_url"), F.col("endpoint_url"))).withColumn(
        "method", F.when(post, "POST").otherwise("GET")
    ).withColumn("body_text", F.when(post, F.col("body_text"))).withColumn("content_type", F.when(post, "application/json")).withColumn(
        "source", F.concat(F.lit("json_adapter:"), F.col("adapter_id"))
    )


# ---- adapters ------------------------------------------------------------------------------------------------------------------

def required_literal(pattern: str | None) -> str | None:
    """Longest run of ASCII characters that every match of the pattern contains, in lower case; null where none is certain.

    Only characters outside groups, classes and alternatives count, and none that a quantifier may drop.
    """
    import re

    pattern = pattern or ""
    if re.search(r"\\[^dDwWsSbBAzZGhHvVR\W_]|\(\?[a-zA-Z-]*x", pattern):  # escapes whose characters do not stand for themselves; free spacing
        return None
    best, run, i, depth = "", "", 0, 0
    while i < len(pattern):
        part = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\{\d*,?\d*\}|.", re.S).match(pattern, i).group()
        i += len(part)
        if part == "|" and not depth:
            return None
        depth += (part == "(") - (part == ")")
        if depth or part == ")":
            own = ""
        elif part[0] in "?*" or (part[0] == "{" and not re.match(r"\{0*[1-9]", part)):
            best, run, own = max(best, run[:-1], key=len), "", ""
        else:
            plain = part[1:] if part[0] == "\\" else part
            own = plain if len(plain) == 1 and plain.isascii() and not (part[0] == "\\" and plain.isalnum()) and (part[0] == "\\" or part not in ".^$+[]{}()") else ""
        run, best = (run + own, best) if own else ("", max(best, run, key=len))
    best = max(best, run, key=len).lower()
    return best or None


GRAM = 3


def _grams(text: Column) -> Column:
    """Distinct character triples."""
    n = F.char_length(text)
    spots = F.when(n >= GRAM, F.sequence(F.lit(1), n - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substr(text, i, F.lit(GRAM))))


def open_adapter_hits(urls: DataFrame, adapters: DataFrame) -> DataFrame:
    """url, adapter_no, adapter_id for every adapter (adapter_no, adapter_id, url_regex) whose pattern finds something in a url.

    Every adapter is filed under one character triple of the literal that its pattern requires, the one that the fewest
    urls have; a url probes with its own triples, and the pattern runs on what meets. Of patterns without condition only
    the first counts. Patterns without a literal of three characters can be filed nowhere: each of them is tried on
    every url, on both sides of an equality that salts spread.
    """
    none = F.coalesce("url_regex", F.lit("")) == ""
    always = adapters.filter(none).agg(F.min(F.struct("adapter_no", "adapter_id")).alias("_a")).filter("_a is not null").select("_a.*")
    literal = F.udf(required_literal, "string")(F.col("url_regex"))
    filed = adapters.filter(~none).withColumn("_lit", literal)
    named = ["adapter_no", "adapter_id", "url_regex", "_lit", "_all"]
    grams = filed.filter(F.char_length("_lit") >= GRAM).withColumn("_own", _grams(F.col("_lit"))).withColumn("_all", F.size("_own")).select(*named, F.explode("_own").alias("_gram"))
    probes = urls.select("url", F.explode(_grams(F.lower("url"))).alias("_gram")).join(grams.select("_gram").distinct(), "_gram", "left_semi")
    counted = grams.join(probes.groupBy("_gram").agg(F.count(F.lit(1)).alias("_urls")), "_gram")
    # a triple that no url has rules its adapter out
    rare = counted.distinct().groupBy(*named).agg(F.min_by("_gram", F.struct("_urls", "_gram")).alias("_gram"), F.count(F.lit(1)).alias("_some")).filter("_some = _all").drop("_some", "_all")
    met = salted_join(probes, rare, ["_gram"], F.xxhash64("url"), merge=False).filter(F.contains(F.lower("url"), F.col("_lit")) & F.rlike(F.col("url"), F.col("url_regex")))
    loose = filed.filter(F.coalesce(F.char_length("_lit"), F.lit(0)) < GRAM).select("adapter_no", "adapter_id", "url_regex").withColumn("_all", F.lit(True))
    tried = salted_join(urls.select("url").withColumn("_all", F.lit(True)), loose, ["_all"], F.xxhash64("url"), merge=False).filter(F.rlike(F.col("url"), F.col("url_regex")))
    first = salted_join(urls.select("url").withColumn("_all", F.lit(True)), always.withColumn("_all", F.lit(True)), ["_all"], F.xxhash64("url"), merge=False)
    return reduce(DataFrame.unionByName, (x.select("url", "adapter_no", "adapter_id") for x in (met, tried, first)))


def match_adapters(targets: DataFrame, adapters: DataFrame, keys: list[str]) -> DataFrame:
    """First adapter per target by host and URL pattern, or why none fits.

    ``targets``: keys, url. ``adapters``: adapter_no, adapter_id, domains (ARRAY), url_regex. Adapters are matched by
    host equality; those without domains through an index of the literals in their patterns. Equal urls are matched once.
    """
    d = targets.withColumn("_host", F.regexp_replace(F.regexp_replace(netloc(F.trim("url")), r":\d+$", ""), r"^www\.", ""))
    a = adapters.withColumn("_domains", F.filter(F.transform(F.coalesce("domains", F.array().cast("array<string>")), lambda x: F.regexp_replace(F.lower(F.trim(x)), r"^www\.", "")), lambda x: x != ""))
    hosted = a.filter(F.size("_domains") > 0).select("adapter_no", "adapter_id", "url_regex", F.explode("_domains").alias("_host")).distinct()
    urls = d.filter("_host <> ''").groupBy("url", "_host").agg(F.count(F.lit(1)).alias("_uses"))
    own = salted_join(urls, hosted, ["_host"], F.xxhash64("url"), merge=False)
    fits = (F.coalesce("url_regex", F.lit("")) == "") | F.rlike(F.col("url"), F.col("url_regex"))
    by_host = own.groupBy("url").agg(F.min(F.when(fits, F.struct("adapter_no", "adapter_id"))).alias("_h"), F.lit(True).alias("_tried"))
    opened = a.filter(F.size("_domains") == 0).select("adapter_no", "adapter_id", "url_regex")
    by_pattern = open_adapter_hits(urls.select("url"), opened).groupBy("url").agg(F.min(F.struct("adapter_no", "adapter_id")).alias("_p"))
    out = d.join(by_host, "url", "left").join(by_pattern, "url", "left")
    loaded = adapters.agg(F.count(F.lit(1))).scalar()
    anyhost = a.agg(F.count_if(F.size("_domains") == 0)).scalar()
    out = out.withColumn("_m", F.least("_h", "_p"))
    reason = (
        F.when(F.coalesce(F.trim("url"), F.lit("")) == "", "missing_target_url").when(F.col("_host") == "", "missing_target_host")
        .when(loaded == 0, "no_adapters_loaded").when(F.col("_m").isNotNull(), "matched")
        .when(F.col("_tried").isNull() & (anyhost == 0), "host_mismatch").otherwise("url_regex_mismatch")
    )
    return out.select(*keys, F.col("_host").alias("target_host"), F.col("_m.adapter_id").alias("adapter_id"), reason.alias("match_reason"))


# ---- known request shapes ---------------------------------------------------------------------------------------------------------

def price_scale_id(preview: Column, quantity: Column) -> Column:
    """Id of the price scale of a quantity in a (possibly cut) response text."""
    q = F.regexp_replace(quantity, r"\D", "")
    before = F.regexp_substr(preview, F.concat(F.lit(r'"id"\s*:\s*\d+\s*,\s*"wert"\s*:\s*'), q, F.lit(r"\b")))
    after = F.regexp_substr(preview, F.concat(F.lit(r'"wert"\s*:\s*'), q, F.lit(r'\b[^}]{0,200}?"id"\s*:\s*\d+')))
    return F.nullif(F.regexp_extract(F.coalesce(before, after), r'"id"\s*:\s*(\d+)', 1), F.lit(""))


def quantity_scale_requests(units: DataFrame) -> DataFrame:
    """One or two candidate bodies per unit: by price scale where its id is known, and with a typed quantity.

    ``units``: template_body, preview, quantity and the caller's keys.
    """
    d = units.filter(F.trim("quantity").rlike(r"^\d+$") & (F.trim("quantity").cast("bigint") > 0)).withColumn("quantity", F.trim("quantity"))
    d = d.withColumn("price_scale_id", price_scale_id(F.col("preview"), F.col("quantity")))
    kinds = F.when(F.col("price_scale_id").isNotNull(), F.array(F.lit("price_scale"), F.lit("quantity_manual"))).otherwise(F.array(F.lit("quantity_manual")))
    d = d.select("*", F.posexplode(kinds).alias("candidate_no", "kind"))
    manual = F.col("kind") == "quantity_manual"
    flags = F.when(manual, "true").otherwise("false")
    base = {"isIndividualQuantity": flags, "quantity": json_text(F.col("quantity"))}
    where = F.when(manual, F.array(*[F.lit(k) for k in base])).otherwise(F.array(*[F.lit(k) for k in base], F.lit("priceScaleId")))
    what = F.when(manual, F.array(*base.values())).otherwise(F.array(*base.values(), json_text(F.coalesce("price_scale_id", F.lit("")))))
    return d.withColumn("body_text", _set_paths("template_body", where, what))


# Query parameter -> option keys that feed it, in order.
QUERY_ALIASES = {
    "AMOUNT": ["AMOUNT", "QUANTITY", "AUFLAGE", "MENGE"],
    "CONTENT_SIZE": ["CONTENT_SIZE", "FORMAT", "SIZE", "END_FORMAT", "DIN"],
    "PAGES": ["PAGES", "SEITEN", "SEITIG", "UMFANG"],
    "CONTENT_PAPER": ["CONTENT_PAPER", "PAPIER", "MATERIAL", "PAPER"],
    "COVER_PAPER": ["COVER_PAPER", "COVER", "UMSCHLAG", "COVER_MATERIAL"],
    "CONTENT_COLOR": ["CONTENT_COLOR", "FARBE", "PRINT", "DRUCK"],
    "COVER_COLOR": ["COVER_COLOR", "COVER_PRINT", "UMSCHLAG_FARBE"],
    "AUSRICHTUNG": ["AUSRICHTUNG", "ORIENTATION"],
}


def query_requests(units: DataFrame, url: str, options: str, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """GET requests from a template URL: changed parameters by alias, the query sorted by name.

    Units without any change are left out.
    """
    opts = F.transform_keys(options, lambda k, _v: F.replace(F.upper(F.trim(k)), F.lit(" "), F.lit("_")))
    d = units.withColumn("_o", opts).withColumn("_pairs", form_pairs(F.regexp_extract(F.col(url), r"\?([^#]*)", 1)))
    rows = []
    for param, names in (aliases or QUERY_ALIASES).items():
        value = F.coalesce(*[F.nullif(F.trim(F.element_at("_o", n)), F.lit("")) for n in names])
        last = F.try_element_at(F.transform(F.filter("_pairs", _key_is(param)), lambda p: p["value"]), F.lit(-1))
        rows.append(F.when(value.isNotNull() & ~value.eqNullSafe(last), F.struct(F.lit(param).alias("key"), value.alias("value"))))
    d = d.withColumn("_new", F.filter(F.array(*rows), lambda r: r.isNotNull())).filter(F.size("_new") > 0)
    kept = F.filter("_pairs", lambda p: ~F.exists("_new", lambda n: n["key"] == p["key"]))
    # of repeated keys the last value stays
    kept = F.filter(F.transform(kept, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))),
                    lambda p: ~F.exists(F.transform(kept, lambda q, j: F.struct(q["key"].alias("key"), j.alias("j"))), lambda q: (q["key"] == p["key"]) & (q["j"] > p["i"])))
    merged = F.array_sort(F.concat(F.transform(kept, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))), F.col("_new")))
    base = F.regexp_replace(F.col(url), r"[?#].*$", "")
    d = d.withColumn("request_url", F.concat(base, F.lit("?"), encode_pairs(merged)))
    return d.withColumn("params_updated", F.array_join(F.transform("_new", lambda n: n["key"]), ",")).drop("_o", "_pairs", "_new")


def _key_is(name: str):
    return lambda p: p["key"] == name


def updated_setlink(link: Column, group_code: Column, option_code: Column) -> Column:
    """Configuration link with the dependency token of one group replaced or added."""
    decoded = decode_template(link)
    pairs = form_pairs(F.regexp_extract(decoded, r"\?([^#]*)", 1))
    token = F.concat(F.lit("<"), group_code, F.lit("><"), option_code, F.lit(">"))
    mine = lambda p: p["value"].startswith(F.concat(F.lit("<"), group_code, F.lit(">")))
    changed = F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), F.when(mine(p), token).otherwise(p["value"]).alias("value")))
    name = F.when(F.exists(pairs, lambda p: p["key"] == "depvar_index_setparent"), F.lit("depvar_index_setparent")).otherwise(F.lit("depvar_index_set"))
    added = F.concat(pairs, F.array(F.struct(name.alias("key"), token.alias("value"))))
    out = F.when(F.exists(pairs, mine), changed).otherwise(added)
    base = F.regexp_replace(decoded, r"[?#].*$", "")
    return F.when(decoded == "", F.lit("")).otherwise(F.concat(base, F.lit("?"), encode_pairs(out)))


def interpolated_quantity(pairs: Column, field: Column, typed: Column) -> Column:
    """Form pairs with a free quantity: the tile field becomes 'Interpolation', the typed value goes to the first
    ``input_qty_1`` after it, or to a new one right behind it. Forms without the tile field stay as they are."""
    def placed(pairs: Column, spot: Column) -> Column:
        at, target = spot["at"], spot["target"]
        edited = F.transform(
            pairs,
            lambda p, i: F.struct(
                p["key"].alias("key"),
                F.when(i + 1 == at, F.lit("Interpolation")).when(i + 1 == target, typed).otherwise(p["value"]).alias("value"),
            ),
        )
        typed_pair = F.array(F.struct(F.lit("input_qty_1").alias("key"), typed.alias("value")))
        inserted = lambda e: F.concat(F.slice(e, 1, F.greatest(at, F.lit(1)).cast("int")), typed_pair, F.slice(e, (at + 1).cast("int"), F.greatest(F.size(e), F.lit(1))))
        return F.when(at == 0, pairs).when(target > 0, edited).otherwise(bound(edited, inserted))

    def spot(keys: Column, at: Column) -> Column:
        after = F.array_position(F.slice(keys, at + 1, F.greatest(F.size(keys), F.lit(1))), "input_qty_1")
        return bound(after, lambda n: F.struct(at.alias("at"), F.when(n > 0, at + n).otherwise(F.lit(0)).alias("target")))

    # each step is bound: the form is read once, and its places are not looked up again for every pair
    place = lambda keys: bound(F.array_position(keys, field), lambda at: spot(keys, at))
    return bound(pairs, lambda own: bound(bound(F.transform(own, lambda p: p["key"]), place), lambda at: placed(own, at)))


def form_requests(units: DataFrame) -> DataFrame:
    """Form bodies with one option written.

    ``units``: post_data, field_name, field_value, group_code, option_code, code_unknown, is_selected, and quantity_mode
    (tile / interpolation / null). Adds body_text, changed flags and the skip reason.
    """
    c = F.col
    blocked = c("code_unknown") & ~c("is_selected") & c("quantity_mode").isNull()
    d = units.withColumn("_p", form_pairs(c("post_data"))).withColumn("_blocked", blocked)
    plain = replace_pair(c("_p"), c("field_name"), c("field_value"))
    free = interpolated_quantity(c("_p"), c("field_name"), c("field_value"))
    new = F.when(c("_blocked") | (F.coalesce("field_name", F.lit("")) == ""), c("_p")).when(c("quantity_mode") == "interpolation", free).otherwise(plain)
    d = d.withColumn("_n", new)
    link_key = F.coalesce(F.get(F.filter("_p", lambda p: F.lower(p["key"]) == "setlink"), F.lit(0))["key"], F.lit("SetLink"))
    link = F.get(F.filter("_p", lambda p: F.lower(p["key"]) == "setlink"), F.lit(0))["value"]
    usable = link.isNotNull() & (F.coalesce("option_code", F.lit("")) != "") & ~c("_blocked")
    d = d.withColumn("_lk", link_key).withColumn("new_setlink", F.when(usable, updated_setlink(link, c("group_code"), c("option_code"))))
    d = d.withColumn("_n2", F.when(c("new_setlink").isNotNull(), replace_pair(c("_n"), c("_lk"), c("new_setlink"))).otherwise(c("_n")))
    form_changed = ~c("_blocked") & (F.coalesce("field_name", F.lit("")) != "")
    reason = F.when(c("_blocked"), "option_code_unknown_for_value").when(~form_changed & c("new_setlink").isNull(), "catalog_row_missing_form_metadata")
    return d.withColumn("body_text", encode_pairs(c("_n2"))).withColumn("form_changed", form_changed).withColumn("skip_reason", reason).drop("_p", "_n", "_n2", "_lk", "_blocked")


def property_id_body(properties: Column, desired: Column) -> tuple[Column, Column]:
    """Property list with ids replaced by name, and the changed names. ``desired``: MAP name -> id."""
    new = F.transform(
        properties, lambda p: F.struct(p["name"].alias("name"), F.coalesce(F.element_at(desired, p["name"]), p["id"]).alias("id"))
    )
    changed = F.filter(properties, lambda p: F.coalesce(F.element_at(desired, p["name"]) != F.coalesce(p["id"], F.lit("")), F.lit(False)))
    return new, F.array_join(F.transform(changed, lambda p: p["name"]), ",")


def property_configuration(base: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Property list per unit: captured values with the strongest override per property.

    ``base``: keys, property_no, value_no. ``overrides``: keys, property_no, value_no, source_rank.
    """
    best = best_row(overrides, [*keys, "property_no"], [F.col("source_rank")], ["value_no", "source_rank"], smallest=True).withColumnRenamed("value_no", "_new")
    d = base.join(best, [*keys, "property_no"], "full_outer").withColumn("_v", F.coalesce("_new", "value_no"))
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("value_no"))
    return d.groupBy(*keys).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct(F.col("property_no").alias("id"), F.col("_v").alias("value"))))).alias("property_configuration"),
        F.count_if(changed).alias("properties_changed"),
    )


# Brochure property numbers (content, cover) and key spellings.
BROCHURE_PROPERTIES = {"material": (8, 36), "farbigkeit": (7, 37), "seitenanzahl": (10, 38)}
BROCHURE_SPELLINGS = {"seiten": "seitenanzahl", "seitenzahl": "seitenanzahl", "farbe": "farbigkeit", "farben": "farbigkeit"}


def brochure_property(key: Column, is_brochure: Column) -> Column:
    """Property number of a brochure option key; the cover prefix selects the cover property."""
    low = F.lower(F.trim(key))
    cover = low.startswith("umschlag_")
    base = F.regexp_replace(F.regexp_replace(low, "^umschlag_", ""), "^_+|_+$", "")
    for raw, name in BROCHURE_SPELLINGS.items():
        base = F.when(base == raw, name).otherwise(base)
    out = F.lit(None).cast("int")
    for name, (content, cover_no) in BROCHURE_PROPERTIES.items():
        out = F.when(base == name, F.when(cover, cover_no).otherwise(content)).otherwise(out)
    return F.when(is_brochure, out)
