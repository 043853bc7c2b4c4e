"""Option catalogs: grouping, form fields, page controls and backend ids (pages, traces, option groups -> catalog)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.jsonwalk import get, parse
from quotelens.functions.text import compact_key, decode_template, group_label, squeeze, unescape_embedded, unquote_fully
from quotelens.functions.urls import form_pairs
from quotelens.operators.skew import best_row, top_k
from quotelens.session import written

NUMERIC = r"^\d+(?:[.,]\d+)?$"


def plain_key(value: Column) -> Column:
    return F.lower(squeeze(value))


# ---- grouping ------------------------------------------------------------------------------------------------------------

def cluster_of(label: Column) -> Column:
    """First matching cluster as 'name' or 'name (context)', null when none fits."""
    named = [(n if not ctx else f"{n} ({ctx})", rx) for n, ctx, rx in vocab.CLUSTER_PATTERNS]
    return reduce(lambda c, p: c.when(label.rlike(p[1]), p[0]), named[1:], F.when(label.rlike(named[0][1]), named[0][0]))


def regroup_singletons(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Catalog group per summary group: singletons of one cluster are merged when at least two of them exist.

    ``groups``: keys, group_ord, group_label, option_count.
    """
    single = (F.col("option_count") == 1) & (F.trim("group_label") != "")
    d = groups.withColumn("_cluster", F.when(single, cluster_of(F.col("group_label"))))
    sizes = d.filter("_cluster is not null").groupBy(*keys, "_cluster").agg(F.count(F.lit(1)).alias("_n"), F.min("group_ord").alias("_first"))
    d = d.join(sizes, [*keys, "_cluster"], "left")
    merged = F.coalesce(F.col("_n") >= 2, F.lit(False))
    label = F.coalesce(F.nullif(F.trim("group_label"), F.lit("")), F.lit("unknown"))
    return d.withColumn("catalog_group", F.when(merged, F.col("_cluster")).otherwise(label)).withColumn(
        "synthesized", merged
    ).withColumn("catalog_ord", F.when(merged, F.col("_first")).otherwise(F.col("group_ord"))).drop("_cluster", "_n", "_first")


def option_groups(options: DataFrame, keys: list[str], ordinal: str, samples: int = 8, shown: int = 30) -> DataFrame:
    """Groups by readable label: control types, distinct values, first samples, selected count, truncation flag."""
    d = options.withColumn("_v", squeeze(F.col("visible_label"))).filter("_v <> ''")
    group = [*keys, "group_label"]
    firsts = d.groupBy(*group, "_v").agg(F.min(ordinal).alias("_o"))
    sample = top_k(firsts, group, [F.asc("_o")], samples, "_rn").groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda s: s["_v"]), "|").alias("sample_values")
    )
    kinds = d.groupBy(*group).agg(
        F.array_join(F.array_sort(F.collect_set("control_type")), ",").alias("control_types"),
        F.count_if("selected").alias("selected_count"),
    )
    counts = firsts.groupBy(*group).agg(F.count(F.lit(1)).alias("option_count"))
    return counts.join(kinds, group).join(sample, group).withColumn("truncated", F.col("option_count") > shown)


def dependency_edges(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct signals per (source, target); their number is the strength."""
    once = signals.select(*keys, "source", "target", "signal").distinct()
    return once.groupBy(*keys, "source", "target").agg(
        F.count(F.lit(1)).alias("strength"), F.array_join(F.array_sort(F.collect_set("signal")), ",").alias("signals")
    )


def probe_effects(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose number of options or of enabled options changed between two recorded states."""
    def totals(d: DataFrame, side: str) -> DataFrame:
        return d.groupBy(*keys, "group_label").agg(
            F.count(F.lit(1)).alias(f"{side}_total"), F.count_if("enabled").alias(f"{side}_enabled")
        )

    cols = ["before_total", "before_enabled", "after_total", "after_enabled"]
    d = totals(before, "before").join(totals(after, "after"), [*keys, "group_label"], "full_outer").fillna(0, cols)
    return d.withColumn(
        "changed", (F.col("before_total") != F.col("after_total")) | (F.col("before_enabled") != F.col("after_enabled"))
    )


def quantity_tiles(options: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Quantity presets of a form field: presets in order, largest, code of the free-quantity tile.

    ``options``: keys, field name, visible_value, varindex.
    """
    value = F.trim("visible_value")
    number = F.when(value.rlike(NUMERIC), F.replace(value, F.lit(","), F.lit(".")).cast("double"))
    free = (F.lower(value) == "interpolation") & (F.coalesce("varindex", F.lit("")) != "")
    d = options.withColumn("_n", number).withColumn("_free", F.when(free, F.col(ordinal)))
    tiles = d.filter("_n is not null").groupBy(*keys, "_n").agg(F.min_by("varindex", ordinal).alias("_code"))
    listed = tiles.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_code"))), lambda t: F.regexp_replace(t["_n"].cast("string"), r"\.0$", "")), ",").alias("tile_presets"),
        F.max("_n").alias("max_tile_preset"),
    )
    extra = d.groupBy(*keys).agg(F.min_by("varindex", "_free").alias("interpolation_code"))
    return extra.join(listed, keys, "left").withColumn("supports_interpolation", F.col("interpolation_code").isNotNull())


def quantity_mode(controls: DataFrame, keys: list[str]) -> DataFrame:
    """Manual inputs and preset numbers of quantity controls: mixed, manual_only, preset_only or unknown."""
    preset = F.nullif(F.regexp_extract("visible_value", r"\b(\d{2,6})\b", 1), F.lit("")).cast("int")
    agg = controls.groupBy(*keys).agg(
        F.max(F.col("control_type").isin("number", "text")).alias("has_manual_input"),
        F.count_distinct(F.when(~F.col("control_type").isin("number", "text"), preset)).alias("preset_count"),
    )
    many = F.col("preset_count") > 0
    return agg.withColumn(
        "mode",
        F.when(F.col("has_manual_input") & many, "mixed").when(F.col("has_manual_input"), "manual_only").when(many, "preset_only").otherwise("unknown"),
    )


# ---- markup --------------------------------------------------------------------------------------------------------------

def attr(tag: Column, name: str) -> Column:
    """Attribute of a tag text; attribute order does not matter."""
    return F.regexp_extract(tag, rf'(?i)[\s"\']{name}\s*=\s*"([^"]*)"', 1)


def has_flag(tag: Column, name: str) -> Column:
    return tag.rlike(rf"(?i)\s{name}(?=[\s=/>]|$)")


def tags(df: DataFrame, keep: list[str], html: Column, names: str = "input|option|button|select|a|textarea") -> DataFrame:
    """Opening tags in document order."""
    found = F.regexp_extract_all(unescape_embedded(html), F.lit(rf"(?is)<(?:{names})\b[^>]*>"), 0)
    return df.select(*keep, F.posexplode(found).alias("tag_no", "tag"))


def page_controls(df: DataFrame, keep: list[str], html: Column) -> DataFrame:
    """Control records of a page: kind, name, value, state, backend hints. Labels come from the tag's own attributes."""
    t = tags(df, keep, html)
    tag = F.col("tag")
    kind = F.lower(F.regexp_extract(tag, r"^<(\w+)", 1))
    label = F.coalesce(*[F.nullif(F.trim(attr(tag, a)), F.lit("")) for a in ("aria-label", "title", "value", "href")], F.lit(""))
    hints = [attr(tag, f"data-{h}").alias(h) for h in ("varindex", "prnumber", "pimvarnodekey", "productvariant", "option-id", "property-id")]
    return t.select(
        *keep, "tag_no", kind.alias("control_tag"), F.coalesce(F.nullif(F.lower(attr(tag, "type")), F.lit("")), kind).alias("control_type"),
        attr(tag, "name").alias("name"), attr(tag, "value").alias("value"), attr(tag, "href").alias("href"),
        label.alias("visible_label"), group_label(attr(tag, "name")).alias("group_label"),
        (has_flag(tag, "checked") | has_flag(tag, "selected")).alias("selected"), (~has_flag(tag, "disabled")).alias("enabled"),
        *hints,
    ).withColumnsRenamed({"option-id": "option_id", "property-id": "property_id"})


def option_inputs(df: DataFrame, keep: list[str], html: Column) -> DataFrame:
    """Option variants from ``<input name="input_var_...">`` tags, also inside JSON-escaped markup."""
    c = page_controls(df, keep, html).filter("control_tag = 'input' and name like 'input\\_var\\_%' and value <> ''")
    return c.select(*keep, "tag_no", F.col("name").alias("field_name"), F.col("value").alias("visible_value"), "varindex", "prnumber", "pimvarnodekey", "productvariant")


def distinct_variants(variants: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First variant per (field, normalised value)."""
    rest = [c for c in variants.columns if c not in keys and c != "field_name"]
    d = variants.withColumn("_k", plain_key(F.col("visible_value")))
    return best_row(d, [*keys, "field_name", "_k"], order, rest, smallest=True).drop("_k")


def hidden_inputs(controls: DataFrame) -> DataFrame:
    return controls.filter("control_type = 'hidden'")


def template_facts(df: DataFrame, keep: list[str], html: Column) -> DataFrame:
    """Form and link facts of a page for request templates."""
    link = F.regexp_extract(html, r'(?i)setlink["\']?\s*[:=]\s*["\']([^"\']+)["\']', 1)
    return df.select(
        *keep,
        F.regexp_count(html, F.lit(r"(?i)<form\b")).alias("form_count"),
        F.regexp_count(html, F.lit(r'(?i)<input\b[^>]*type="hidden"')).alias("hidden_input_count"),
        F.regexp_count(html, F.lit(r"(?i)<script\b")).alias("script_count"),
        F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*href=")).alias("link_count"),
        F.regexp_count(html, F.lit(r"(?i)depvar_index_set")).alias("depvar_hints"),
        decode_template(link).alias("current_setlink"),
    )


def form_payload(controls: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered form pairs a browser would send: unchecked radios and checkboxes and disabled inputs are left out."""
    toggle = F.col("control_type").isin("radio", "checkbox")
    sent = controls.filter((F.col("control_tag") == "input") & (F.col("name") != "") & F.col("enabled") & (~toggle | F.col("selected")))
    return sent.select(*keys, "tag_no", F.col("name").alias("key"), F.col("value"))


def selected_configuration(controls: DataFrame, keys: list[str]) -> DataFrame:
    """Selected labels per group (several are kept)."""
    d = controls.filter("selected and group_label <> ''").select(*keys, "group_label", F.col("visible_label").alias("v")).distinct()
    return d.groupBy(*keys, "group_label").agg(F.array_join(F.array_sort(F.collect_set("v")), " | ").alias("selected_values"))


# ---- form fields ----------------------------------------------------------------------------------------------------------

def form_fields(posts: DataFrame, keep: list[str], body: str = "post_data") -> DataFrame:
    """``input_var_<product>_<group>_<position>`` fields with the dependency codes of the encoded link.

    Position 1 belongs to the parent parameter, position N to parameter N-1.
    """
    d = posts.withColumn("_pairs", form_pairs(F.col(body)))
    link = F.filter("_pairs", lambda p: (F.lower(p["key"]) == "setlink") & (p["value"] != ""))
    query = F.regexp_extract(unquote_fully(F.get(link, F.lit(0))["value"]), r"\?([^#]*)", 1)
    d = d.withColumn("_dep", form_pairs(query))
    rows = d.select(*keep, "_dep", F.posexplode("_pairs").alias("field_no", "_p")).select(*keep, "_dep", "field_no", "_p.key", "_p.value")
    rx = r"^input_var_([A-Za-z0-9]+)_(\d+)_(\d+)$"
    rows = rows.filter(F.col("key").rlike(rx)).select(
        *keep, "field_no", "_dep", F.col("key").alias("field_name"), F.regexp_extract("key", rx, 1).alias("prod_code"),
        F.regexp_extract("key", rx, 2).cast("int").alias("group_index"), F.regexp_extract("key", rx, 3).cast("int").alias("position_index"),
        F.col("value").alias("current_visible_value"),
    )
    param = F.when(F.col("position_index") == 1, F.lit("depvar_index_setparent")).otherwise(
        F.concat(F.lit("depvar_index_set_"), (F.col("position_index") - 1).cast("string"))
    )
    rows = rows.withColumn("_param", param)
    token = F.get(F.filter("_dep", lambda p: p["key"] == F.col("_param")), F.lit(0))["value"]
    pair = r"<([^<>]+)><([^<>]+)>"
    rows = rows.withColumn("depvar_group_code", F.coalesce(F.regexp_extract(token, pair, 1), F.lit(""))).withColumn(
        "depvar_option_code", F.coalesce(F.regexp_extract(token, pair, 2), F.lit(""))
    )
    return rows.withColumn("depvar_param_name", F.when(F.col("depvar_group_code") != "", F.col("_param")).otherwise("")).drop("_param", "_dep")


def with_group_order(options: DataFrame, keys: list[str], label: str) -> DataFrame:
    """options with group_ord, the place of their group's label among the labels of the keys. Only distinct labels are sorted, not all options."""
    named = [F.col(c).alias(f"_{c}") for c in (*keys, label)]
    places = options.select(*named).distinct().withColumn("group_ord", F.row_number().over(Window.partitionBy(*[f"_{c}" for c in keys]).orderBy(f"_{label}")))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, label)])
    # merged, as Spark takes the size of the options from their packed files and may broadcast them
    return options.join(places.hint("merge"), same).drop(*[f"_{c}" for c in (*keys, label)])


def newest_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order (unique within the keys), by keys. The orders alone are grouped, then looked for: grouping
    the rows would sort all their texts. Looked for by order first, so that a hot key is no task of its own."""
    newest = written(rows.groupBy(*keys).agg(F.max(order).alias(order)))
    return rows.join(newest, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(newest[c]) for c in keys], rows[order] == newest[order]), "left_semi")


def enrich_with_form_fields(options: DataFrame, fields: DataFrame, variants: DataFrame, snapshot: str) -> DataFrame:
    """Field name, code and selection per catalog option.

    A group belongs to the field whose current value equals one of its option labels (first option, then value before
    label before source label); else to the first variant field with such a label. ``options``: snapshot, group_ord,
    option_ord, visible_value, visible_label, source_label.
    """
    # joins are merged: Spark takes the size of the options from their packed files and would broadcast them
    labels = F.array(*[F.struct(F.lit(i).alias("p"), plain_key(F.col(c)).alias("k")) for i, c in enumerate(("visible_value", "visible_label", "source_label"))])
    cand = options.select(snapshot, "group_ord", "option_ord", F.explode(labels).alias("l")).select(
        snapshot, "group_ord", "option_ord", F.col("l.p").alias("_pri"), F.col("l.k").alias("_k")
    ).filter("_k <> ''")
    current = best_row(
        fields.withColumn("_k", plain_key(F.col("current_visible_value"))).filter("_k <> ''"), [snapshot, "_k"], [F.col("field_no")],
        ["field_name", "depvar_option_code", "depvar_group_code", "depvar_param_name"], smallest=True,
    )
    once = best_row(variants.withColumn("_k", plain_key(F.col("visible_value"))), [snapshot, "field_name", "_k"], [F.col("tag_no")], ["varindex", "tag_no"], smallest=True)
    by_current = best_row(cand.join(current.hint("merge"), [snapshot, "_k"]), [snapshot, "group_ord"], [F.col("option_ord"), F.col("_pri")],
                          ["field_name", "_k", "depvar_option_code"], smallest=True)
    by_current = by_current.select(snapshot, "group_ord", F.col("field_name").alias("_f1"), F.col("_k").alias("_cur"), F.col("depvar_option_code").alias("_dep"))
    by_variant = best_row(cand.join(once.hint("merge"), [snapshot, "_k"]), [snapshot, "group_ord"], [F.col("option_ord"), F.col("_pri"), F.col("tag_no")], ["field_name"], smallest=True)
    by_variant = by_variant.select(snapshot, "group_ord", F.col("field_name").alias("_f2"))
    group_field = options.select(snapshot, "group_ord").distinct().join(by_current.hint("merge"), [snapshot, "group_ord"], "left").join(by_variant.hint("merge"), [snapshot, "group_ord"], "left")
    group_field = group_field.withColumn("field_name", F.coalesce("_f1", "_f2")).drop("_f1", "_f2")
    keyed = cand.join(group_field.filter("field_name is not null").hint("merge"), [snapshot, "group_ord"])
    coded = keyed.join(once.select(snapshot, "field_name", "_k", "varindex").hint("merge"), [snapshot, "field_name", "_k"], "left")
    per_option = coded.groupBy(snapshot, "group_ord", "option_ord").agg(
        F.first("field_name").alias("field_name"),
        F.min_by("varindex", F.when(F.col("varindex").isNotNull(), F.col("_pri"))).alias("_code"),
        F.max(F.coalesce(F.col("_k") == F.col("_cur"), F.lit(False))).alias("_is_current"), F.max("_dep").alias("_dep"),
    )
    code = F.coalesce(F.nullif("_code", F.lit("")), F.when(F.col("_is_current"), F.nullif("_dep", F.lit(""))))
    per_option = per_option.select(
        snapshot, "group_ord", "option_ord", "field_name", code.alias("option_code"), F.col("_is_current").alias("enriched_selected"),
        code.isNull().alias("option_code_unknown"),
    )
    return options.join(per_option.hint("merge"), [snapshot, "group_ord", "option_ord"], "left")


# ---- backend ids -----------------------------------------------------------------------------------------------------------

def harvest_detail_options(traces: DataFrame, keep: list[str], body: str = "response_body_preview") -> DataFrame:
    """One-option groups from product-detail responses: each entry is the selected option of its box."""
    spark = traces.sparkSession
    d = traces.withColumn("_v", get(parse(F.col(body)), "$.prop_details", "variant")).filter("_v is not null")
    rows = d.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
    text = lambda name: F.nullif(F.trim(F.try_variant_get("value", f"$.{name}", "string")), F.lit(""))
    shown, plain, pid = text("prop_translated"), text("prop_name"), text("prop_id")
    return rows.select(
        *keep, F.col("pos").alias("group_ord"), F.coalesce(text("box_name_title"), text("box_name")).alias("group_label"), text("box_name").alias("name"),
        F.coalesce(shown, plain, pid).alias("visible_label"), F.coalesce(plain, shown, pid).alias("visible_value"), pid.alias("property_id"),
    ).filter("property_id is not null and name is not null")


def catalog_union(harvested: DataFrame, captured: DataFrame) -> DataFrame:
    """Harvested rows come before captured ones."""
    a = harvested.withColumn("source_rank", F.lit(0))
    return a.unionByName(captured.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)


def label_value_map(options: DataFrame, keys: list[str], ordinal: str, hints: list[str]) -> DataFrame:
    """Label -> first preferred backend hint; the first option of a label wins."""
    value = F.coalesce(*[F.nullif(F.trim(F.col(h).cast("string")), F.lit("")) for h in hints])
    d = options.select(*keys, ordinal, F.trim("visible_label").alias("label"), value.alias("backend_value")).filter("label <> '' and backend_value is not null")
    return best_row(d, [*keys, "label"], [F.col(ordinal)], ["backend_value"], smallest=True)


def zip_dropdown(df: DataFrame, keys: list[str], labels: str, ids: str) -> DataFrame:
    """Label -> id pairs of a dropdown, only where both lists have the same length; the first label wins."""
    d = df.filter((F.size(labels) == F.size(ids)) & (F.size(labels) > 0))
    rows = d.select(*keys, F.posexplode(F.arrays_zip(F.col(labels).alias("l"), F.col(ids).alias("i"))).alias("_p", "_z"))
    rows = rows.select(*keys, "_p", compact_key(F.col("_z")["l"]).alias("label_key"), F.col("_z")["i"].cast("bigint").alias("value_id"))
    return best_row(rows.filter("label_key <> '' and value_id > 0"), [*keys, "label_key"], [F.col("_p")], ["value_id"], smallest=True)


def property_number(key: Column) -> Column:
    """N of ``property_N`` keys."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(key)), r"^property[_\s-]?(\d+)$", 1), F.lit("")).cast("int")


def sideload_ids(rows: DataFrame, prop: str, value: str) -> DataFrame:
    """Numeric positive (property, backend value) pairs."""
    d = rows.withColumn("property_no", F.trim(F.col(prop)).try_cast("int")).withColumn("value_no", F.trim(F.col(value)).try_cast("int"))
    return d.filter("property_no > 0 and value_no > 0")


def tier_slice(tiers: DataFrame, keys: list[str], tier: str, requested: DataFrame, want: str, following: int = 3) -> DataFrame:
    """Requested tier and the next ones. Later tiers are picked by top-k, so no tier list is collected whole."""
    t = tiers.select(*keys, tier).distinct()
    hit = requested.select(*keys, want).distinct().join(t.withColumnRenamed(tier, "_t"), keys)
    exact = hit.filter(F.col("_t") == F.col(want)).select(*keys, want)
    later = hit.filter(F.col("_t") >= F.col(want)).join(exact, [*keys, want], "left_semi")
    firsts = top_k(later, [*keys, want], [F.asc("_t")], following + 1, "_rn")
    return firsts.groupBy(*keys, want).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda x: x.cast("string")), ",").alias("print_runs")
    )
