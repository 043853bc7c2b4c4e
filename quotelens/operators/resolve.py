"""Requested options against catalogs and value maps.

Requests are reduced to distinct (scope, key, value) before they meet a catalog, so a scope that owns a third of all
units is scored once per distinct request; the outcome is joined back by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.text import (
    compact_key, label_key, loose_key, match_parts, match_score_normalised, match_score_parts, match_text, token_set, value_equals,
)
from quotelens.operators.skew import best_row, top_k
from quotelens.operators.textindex import candidates
from quotelens.session import cut_lineage

# Key families of request paths, in order.
CANONICAL_KEYS = {
    "quantity": ["quantity", "qty", "auflage", "menge", "stueck", "stuck", "print_runs", "printruns"],
    "format": ["format", "size", "groesse", "grosse", "dimension"],
    "material": ["material", "papier", "paper"],
    "pages": ["pages", "seiten", "seite"],
    "color": ["color", "colour", "farben", "farbe", "farbig", "farbigkeit"],
    "binding": ["binding", "bindung", "verarbeitung"],
    "finishing": ["finishing", "finish", "veredelung"],
    "orientation": ["orientation", "ausrichtung", "aspect_ratio", "aspectratio"],
}


def canonical_key(token: Column) -> Column:
    """First key family with an alias inside the token."""
    low = F.lower(F.trim(token))
    conds = [(fam, reduce(lambda a, b: a | b, [F.contains(low, F.lit(a)) for a in al])) for fam, al in CANONICAL_KEYS.items()]
    return reduce(lambda c, x: c.when(x[1], x[0]), conds[1:], F.when(conds[0][1], conds[0][0]))


def key_aliases(key: Column, groups: dict[str, list[str]] | None = None) -> Column:
    """The key itself and every alias of each family it belongs to, normalised for matching."""
    none = F.array().cast("array<string>")

    def expand(norm: Column) -> Column:
        parts = [F.array(norm)]
        for fam, words in (groups or vocab.KEY_ALIASES).items():
            member = reduce(lambda a, b: a | b, [F.contains(norm, F.lit(w)) for w in words]) | (norm == fam)
            plain = sorted({w.replace("_", " ") for w in [fam, *words]})
            parts.append(F.when(member, F.array(*[F.lit(w) for w in plain])).otherwise(none))
        return F.filter(F.array_distinct(F.concat(*parts)), lambda a: a != "")

    # the one-element array binds the normalised key, so the large expression appears once
    return F.flatten(F.transform(F.array(match_text(key)), expand))


def value_variants(value: Column) -> Column:
    """Requested value with its synonyms: alias lists, DIN prefix on and off."""
    loose = loose_key(value)
    compact = F.replace(loose, F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")
    parts = [F.array(loose)]
    for canon, words in vocab.VALUE_ALIASES.items():
        parts.append(F.when(compact == canon, F.array(*[loose_key(F.lit(w)) for w in words])).otherwise(none))
    parts.append(F.when(loose.startswith("din "), F.array(F.regexp_replace(loose, "^din ", ""))).otherwise(none))
    parts.append(F.when(loose.rlike(r"^[ab]\d$"), F.array(F.concat(F.lit("din "), loose))).otherwise(none))
    return F.filter(F.array_distinct(F.concat(*parts)), lambda v: v != "")


# ---- catalog matching ------------------------------------------------------------------------------------------------------

def match_catalog(requests: DataFrame, options: DataFrame, scope: str, texts: list[str] | None = None, threshold: int = 12) -> DataFrame:
    """Best group, then best option of that group, per distinct (scope, key, value).

    ``requests``: scope, key, value. ``options``: scope, group_ord, group_label, option_ord, visible_label and the
    further text columns named in ``texts``. Columns out: status catalog_option / value_not_in_catalog /
    no_matching_group, group_label, matched_label, scores.
    """
    texts = texts or ["visible_label", "visible_value"]
    # requests and options are used several times below: reduced and written once, or their plans would stand in this one as
    # often, and the driver keeps every replanned copy
    want = cut_lineage(requests.select(scope, "key", "value").distinct())
    # counted, so that the optimizer keeps this reduction before the alias expansion
    used_keys = want.groupBy(scope, "key").agg(F.count(F.lit(1)).alias("_uses")).filter("_uses > 0")
    cols = [f"_t{i}" for i in range(len(texts))]
    opt = options.select(scope, "group_ord", "group_label", "option_ord", "visible_label", *[match_text(F.col(t)).alias(c) for t, c in zip(texts, cols, strict=True)])
    # labels repeat inside a group: score each distinct text combination once
    lab = opt.groupBy(scope, "group_ord", *cols).agg(F.min_by(F.struct("option_ord", "visible_label"), "option_ord").alias("_o"), F.min("group_label").alias("group_label"))
    lab = cut_lineage(lab.select(scope, "group_ord", *cols, "_o.option_ord", "_o.visible_label", "group_label"))
    values = want.select(scope, "value").distinct().withColumn("_n", match_text(F.col("value"))).filter("_n <> ''")
    near = candidates(values, lab, [scope], ["value"], ["group_ord", "option_ord"], ["_n"], cols)
    pair = near.join(values.select(scope, "value", match_parts(F.col("_n")).alias("_want")), [scope, "value"]).join(
        lab.select(scope, "group_ord", "option_ord", *[match_parts(F.col(c)).alias(c) for c in cols]), [scope, "group_ord", "option_ord"]
    )
    score = F.greatest(F.lit(0), *[match_score_parts(F.col(c), F.col("_want")) for c in cols])
    ranked = F.struct(score.cast("int").alias("s"), (-F.col("option_ord")).alias("o"))
    best = pair.withColumn("_p", ranked).filter("_p.s > 0 and _p.o is not null").groupBy(scope, "value", "group_ord").agg(F.max("_p").alias("_p"))
    best = best.withColumn("_vs", F.col("_p.s")).withColumn("option_ord", -F.col("_p.o"))
    # the scored pairs are a plan of their own, so that later steps are not replanned together with them
    best = cut_lineage(best.join(lab.select(scope, "group_ord", "option_ord", "visible_label").distinct(), [scope, "group_ord", "option_ord"], "left").drop("_p"))
    groups = lab.groupBy(scope, "group_ord").agg(F.min("group_label").alias("group_label")).withColumn("_g", match_parts(match_text(F.col("group_label"))))
    alias = used_keys.select(scope, "key", F.explode(key_aliases(F.col("key"))).alias("_a")).withColumn("_a", match_parts(F.col("_a")))
    by_key = cut_lineage(alias.join(groups, scope).groupBy(scope, "key", "group_ord", "group_label").agg(F.max(match_score_parts(F.col("_g"), F.col("_a"))).alias("_as")))
    gs = want.select(scope, "key", "value").join(by_key, [scope, "key"])
    d = gs.join(best, [scope, "value", "group_ord"], "left").withColumn("_vs", F.coalesce("_vs", F.lit(0)))
    base = F.when(F.col("_as") > 0, F.col("_as") + 6).otherwise(0)
    total = F.when((base == 0) & (F.col("_vs") >= 20), 8).when((base > 0) & (F.col("_vs") > 0), base + F.least(F.lit(10), F.floor(F.col("_vs") / 3))).otherwise(base)
    top = best_row(
        d.withColumn("group_score", total.cast("int")).filter("group_score > 0"), [scope, "key", "value"], [F.col("group_score"), -F.col("group_ord")],
        ["group_score", "group_ord", "group_label", "_vs", "option_ord", "visible_label"],
    )
    out = want.select(scope, "key", "value").join(top, [scope, "key", "value"], "left")
    hit = F.col("_vs") >= threshold
    status = F.when(F.col("group_score").isNull(), "no_matching_group").when(hit, "catalog_option").otherwise("value_not_in_catalog")
    return out.select(
        scope, "key", "value", status.alias("match_status"), "group_ord", "group_label", "group_score",
        F.when(hit, F.col("visible_label")).alias("matched_label"), F.when(hit, F.col("option_ord")).alias("option_ord"), F.col("_vs").alias("option_score"),
    )


def suggestions(unmatched: DataFrame, options: DataFrame, scope: str, limit: int = 3) -> DataFrame:
    """Closest labels of the matched group for values that are not in it."""
    # used three times below: written once, or the plan of the matches would stand in this one as often
    want = cut_lineage(unmatched.filter("match_status = 'value_not_in_catalog'").select(scope, "key", "value", "group_ord"))
    labels = cut_lineage(options.select(scope, "group_ord", F.trim("visible_label").alias("label")).filter("label <> ''").distinct())
    asked = want.select(scope, "group_ord", "value").distinct().withColumn("_n", match_text(F.col("value")))
    near = candidates(asked, labels.withColumn("_l", match_text(F.col("label"))), [scope, "group_ord"], ["value"], ["label"], ["_n"], ["_l"])
    # places that no similar label takes go to the last labels of the group
    rest = asked.drop("_n").join(top_k(labels, [scope, "group_ord"], [F.desc("label")], limit, "_rn").drop("_rn"), [scope, "group_ord"])
    scored = near.unionByName(rest).distinct().withColumn("_s", match_score_normalised(match_text(F.col("label")), match_text(F.col("value"))))
    pair = want.join(scored, [scope, "group_ord", "value"])
    best = top_k(pair, [scope, "key", "value"], [F.desc("_s"), F.desc("label")], limit, "_rn")
    return best.groupBy(scope, "key", "value").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "label"))), lambda s: s["label"]), "|").alias("suggestions")
    )


def quantity_outcome(value: Column, manual: Column, presets: Column, control_name: Column, control_property: Column) -> Column:
    """Match kind of a requested quantity."""
    listed = F.exists(F.coalesce(presets, F.array().cast("array<string>")), lambda p: match_text(p) == match_text(value))
    known = control_name.isNotNull() & ((control_name == "quantity") | (F.coalesce(control_property, F.lit("")) != ""))
    return (
        F.when(F.coalesce(manual, F.lit(False)), "quantity_manual").when(listed, "quantity_preset")
        .when(F.coalesce(known, F.lit(False)), "catalog_only").otherwise("quantity_not_in_catalog")
    )


# ---- value maps ------------------------------------------------------------------------------------------------------------

def resolve_values(requests: DataFrame, value_map: DataFrame, sites: DataFrame, ui_only: bool = False) -> DataFrame:
    """Outcome per distinct (site, canonical_key, value).

    ``value_map``: site, property_id, canonical_key, source_label, backend_id, label, confidence. ``sites``: site of
    every loaded map. Status: resolved, ambiguous, key_collision, no_match, no_property, no_map.
    """
    keys = ["site", "canonical_key", "value"]
    # requests and texts are used several times below: reduced and written once, see match_catalog
    want = cut_lineage(requests.select(*keys).distinct())
    vm = value_map.withColumn("canonical_key", F.lower(F.trim("canonical_key")))
    accepted = vocab.CONFIDENCE_OPT_IN if ui_only else vocab.CONFIDENCE_DEFAULT
    usable = vm.filter(F.lower(F.trim("confidence")).isin(accepted)).withColumn("_cap", label_key(F.col("label"))).filter("_cap <> ''")
    req = want.withColumn("_req", label_key(F.col("value"))).filter("_req <> ''")
    # labels repeat, so a text meets the requests once for each of its properties
    first = F.min_by(F.struct("backend_id", "label", "confidence"), "label").alias("_first")
    texts = cut_lineage(usable.groupBy("site", "canonical_key", "_cap", "property_id").agg(F.count(F.lit(1)).alias("_rows"), first))
    near = candidates(
        req.select("site", "canonical_key", "_req").distinct(), texts.select("site", "canonical_key", "_cap").distinct(), ["site", "canonical_key"],
        ["_req"], ["_cap"], ["_req"], ["_cap"], around=False, shared=False,
    ).filter(F.contains("_cap", F.col("_req")))
    hits = req.join(near, ["site", "canonical_key", "_req"]).join(texts, ["site", "canonical_key", "_cap"])
    order = F.struct("property_id", "_first.label")
    found = hits.groupBy(*keys).agg(
        F.sum("_rows").alias("match_count"), F.count_distinct("property_id").alias("property_count"), F.min("property_id").alias("property_id"),
        F.min_by("_first", order).alias("_first"),
    ).select(*keys, "match_count", "property_count", "property_id", "_first.backend_id", F.col("_first.label").alias("matched_label"), "_first.confidence")
    props = vm.select("site", "canonical_key").distinct().withColumn("_has", F.lit(True))
    loaded = sites.select("site").distinct().withColumn("_map", F.lit(True))
    d = want.join(found, keys, "left").join(props, ["site", "canonical_key"], "left").join(loaded, "site", "left")
    status = (
        F.when(F.col("_map").isNull(), "no_map").when(F.col("_has").isNull(), "no_property").when(F.col("match_count").isNull(), "no_match")
        .when(F.col("property_count") > 1, "key_collision").when(F.col("match_count") > 1, "ambiguous").otherwise("resolved")
    )
    d = d.withColumn("status", status)
    only = lambda c: F.when(F.col("status") == "resolved", F.col(c)).alias(c)
    return d.select(*keys, "status", F.coalesce("match_count", F.lit(0)).alias("match_count"), only("property_id"), only("backend_id"), only("matched_label"), only("confidence"))


def augment(matches: DataFrame, resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Attach value-map ids; a resolved request without catalog match is promoted to ``sideload_only``."""
    r = resolved.filter("status = 'resolved'").select(*keys, "property_id", "backend_id", F.col("matched_label").alias("_label"))
    d = matches.join(r, keys, "left")
    missed = F.col("match_status") != "catalog_option"
    promoted = missed & F.col("backend_id").isNotNull()
    return d.withColumn("match_type", F.when(promoted, "sideload_only").otherwise(F.col("match_status"))).withColumn(
        "matched_label", F.when(promoted, F.col("_label")).otherwise(F.col("matched_label"))
    ).withColumn("valid", ~missed | promoted).drop("_label")


def prevalidation_summary(rows: DataFrame, keys: list[str], order: list[Column], shown: int = 12) -> DataFrame:
    """Counts and the first matched / unmatched requests per unit."""
    agg = rows.groupBy(*keys).agg(
        F.count_if("valid").alias("matched_count"), F.count_if(~F.col("valid")).alias("unmatched_count"), F.min("valid").alias("valid"),
    )
    head = top_k(rows.filter("not valid"), keys, order, shown, "_rn")
    errors = head.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.concat_ws("=", "key", "value").alias("e")))), lambda e: e["e"]), ";").alias("unmatched")
    )
    return agg.join(errors, keys, "left")


def describe_value_map(value_map: DataFrame) -> DataFrame:
    keys = value_map.select("site", F.trim("canonical_key").alias("k")).filter("k <> ''").distinct()
    names = keys.groupBy("site").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("canonical_keys"))
    return value_map.groupBy("site").agg(F.count_distinct("property_id").alias("property_count")).join(names, "site", "left")


def apply_learned_rules(options: DataFrame, rules: DataFrame) -> DataFrame:
    """Requested value replaced by the learned accepted value where they differ.

    ``options``: site, key, value. ``rules``: site, option_key, requested_norm, accepted_value. One rule per key.
    """
    r = rules.select("site", F.lower("option_key").alias("_k"), F.col("requested_norm").alias("_v"), F.col("accepted_value").alias("_acc"))
    d = options.withColumn("_k", F.lower("key")).withColumn("_v", F.lower(F.trim("value"))).join(r, ["site", "_k", "_v"], "left")
    use = F.col("_acc").isNotNull() & ~value_equals(F.col("value"), F.col("_acc"))
    return d.withColumn("effective_value", F.when(use, F.col("_acc")).otherwise(F.col("value"))).withColumn("rule_applied", use).drop("_k", "_v", "_acc")


# ---- backend value ids -------------------------------------------------------------------------------------------------------

def match_value_ids(requests: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Value id per distinct request by tiers: exact, then unique number, then unique part (3+ characters).

    ``values``: keys, value_id, label.
    """
    want = requests.select(*keys, "value").distinct().withColumn("_n", loose_key(F.col("value"))).withColumn("_c", F.replace("_n", F.lit(" "), F.lit("")))
    lab = values.withColumn("_ln", loose_key(F.col("label"))).withColumn("_lc", F.replace("_ln", F.lit(" "), F.lit("")))
    # labels repeat, so a text meets the requests once, with the number of its values and the smallest of them
    lab = lab.select(*keys, "value_id", "_ln", "_lc").distinct().groupBy(*keys, "_ln", "_lc").agg(F.count("value_id").alias("_ids"), F.count(F.lit(1)).alias("_rows"), F.min("value_id").alias("_id"))
    near = candidates(want.select(*keys, "_n").distinct(), lab.select(*keys, "_ln"), keys, ["_n"], ["_ln"], ["_n"], ["_ln"], around=False, shared=False)
    pair = want.join(near.join(lab, [*keys, "_ln"]), [*keys, "_n"], "left")
    exact = F.col("_lc") == F.col("_c")
    numeric = F.col("_n").rlike(r"^\d+$") & F.contains(F.concat(F.lit(" "), "_ln", F.lit(" ")), F.concat(F.lit(" "), "_n", F.lit(" ")))
    part = (F.length("_c") >= 3) & F.contains("_lc", F.col("_c"))
    tiers = {"exact": exact, "numeric": numeric, "contains": part}
    aggs = []
    for name, cond in tiers.items():
        aggs += [F.coalesce(F.sum(F.when(cond, F.col("_rows"))), F.lit(0)).alias(f"_n_{name}"), F.min(F.when(cond, F.col("_id"))).alias(f"_id_{name}")]
    d = pair.groupBy(*keys, "value", "_n").agg(*aggs).join(lab.groupBy(*keys).agg(F.sum("_ids").alias("_all")), keys, "left").withColumn("_all", F.coalesce("_all", F.lit(0)))
    kind = F.when(F.col("_all") == 0, "no_value_options").when(F.col("_n") == "", "empty_value")
    vid = F.when(F.lit(False), F.lit(None).cast("bigint"))
    for name in tiers:
        kind = kind.when(F.col(f"_n_{name}") == 1, name).when(F.col(f"_n_{name}") > 1, f"ambiguous_{name}")
    kind = kind.otherwise("no_match")
    d = d.withColumn("match_kind", kind)
    vid = F.when(F.col("match_kind") == "exact", F.col("_id_exact")).when(F.col("match_kind") == "numeric", F.col("_id_numeric")).when(F.col("match_kind") == "contains", F.col("_id_contains"))
    return d.select(*keys, "value", "match_kind", vid.alias("value_id"))


def pick_dropdown(requests: DataFrame, dropdowns: DataFrame, scope: str, floor: int = 18) -> DataFrame:
    """Dropdown whose trigger label fits the option key best; ``floor`` is at least 1."""
    want = requests.select(scope, "key").distinct().withColumn("_k", loose_key(F.col("key"))).filter("_k <> ''")
    dd = dropdowns.withColumn("_t", loose_key(F.col("trigger"))).filter("_t <> ''")
    kc, tc = F.replace("_k", F.lit(" "), F.lit("")), F.replace("_t", F.lit(" "), F.lit(""))
    overlap = F.size(F.array_intersect(token_set(F.col("_t")), token_set(F.col("_k"))))
    score = (
        F.when((F.col("_t") == F.col("_k")) | (tc == kc), 40).otherwise(0) + F.when(F.contains(tc, kc), 24).otherwise(0)
        + F.when(F.contains(kc, tc), 12).otherwise(0) + F.least(F.lit(18), overlap * 6)
    )
    near = candidates(want.select(scope, "_k").distinct(), dd.select(scope, "_t").distinct(), [scope], ["_k"], ["_t"], ["_k"], ["_t"])
    pair = want.join(near, [scope, "_k"]).join(dd, [scope, "_t"]).withColumn("dropdown_score", score)
    return best_row(pair, [scope, "key"], [F.col("dropdown_score"), -F.col("dropdown_no")], ["dropdown_no", "trigger", "dropdown_score"]).filter(F.col("dropdown_score") >= floor)


def assign_dropdowns(dropdowns: DataFrame, properties: DataFrame, scope: str, floor: int = 30) -> DataFrame:
    """Greedy one-to-one assignment by similar option counts: highest score first, then the later dropdown, then the later property.

    The score of an edge follows from the two counts, so no edge is ever made. A page's controls (two numbers each) meet
    in one task; there, score by score, the dropdowns take the last free property among the counts that give that score.
    """
    d = dropdowns.filter("option_count >= 2").select(scope, F.lit(True).alias("_d"), F.col("dropdown_no").cast("bigint").alias("_no"), F.col("option_count").cast("bigint").alias("_n"))
    p = properties.filter("value_count > 0 and not is_range").select(scope, F.lit(False).alias("_d"), F.col("property_no").cast("bigint").alias("_no"), F.col("value_count").cast("bigint").alias("_n"))
    # pages that lack one kind have nothing to assign
    controls = d.join(p.select(scope).distinct(), scope, "left_semi").unionByName(p.join(d.select(scope).distinct(), scope, "left_semi"))
    kind = controls.schema[scope].dataType.simpleString()

    def assigned(page):
        import pyarrow as pa

        name, rows = page.column(0)[0], page.select([1, 2, 3]).to_pylist()
        free: dict[int, list[int]] = {}
        left = sorted(((r["_no"], r["_n"]) for r in rows if r["_d"]), reverse=True)
        for no, n in sorted((r["_no"], r["_n"]) for r in rows if not r["_d"]):
            free.setdefault(n, []).append(no)
        by_score: dict[int, dict[int, list[int]]] = {}
        for options in {n for _, n in left}:
            for values in free:
                diff = abs(values - options)
                score = 70 - min(50, 3 * diff) + 45 * (diff == 0) + 6 * (3 <= options <= 40)
                if score >= floor:
                    by_score.setdefault(score, {}).setdefault(options, []).append(values)
        out = []
        for score in sorted(by_score, reverse=True):
            still = []
            for no, options in left:
                fits = [v for v in by_score[score].get(options, ()) if free[v]]
                if fits:
                    out.append((no, free[max(fits, key=lambda v: free[v][-1])].pop(), score))
                else:
                    still.append((no, options))
            left = still
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.repeat(name, len(out)), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True))], names=[scope, "dropdown_no", "property_no", "assign_score"])

    return controls.groupBy(scope).applyInArrow(assigned, f"`{scope}` {kind}, dropdown_no bigint, property_no bigint, assign_score int")


def first_by_rank(sources: DataFrame, keys: list[str], rank: str, keep: list[str]) -> DataFrame:
    """Precedence merge: per key the row of the strongest source."""
    return best_row(sources, keys, [F.col(rank)], keep, smallest=True)


# ---- links and controls ---------------------------------------------------------------------------------------------------------

def best_variant_links(links: DataFrame, wanted: DataFrame, scope: str, floor: int = 20) -> DataFrame:
    """Best format-variant link per requested value.

    ``links``: scope, link_no, href, family_hits (product words in the link). A link needs a family hit, and a likeness to
    the value, as ``floor`` is more than the 16 points that family hits give.
    """
    l = links.filter("family_hits > 0").withColumn("_t", loose_key(F.col("href"))).withColumn("_c", F.replace("_t", F.lit(" "), F.lit("")))
    w = wanted.select(scope, "value").distinct().withColumn("_w", loose_key(F.col("value"))).withColumn("_wc", F.replace("_w", F.lit(" "), F.lit(""))).filter("_wc <> ''")
    overlap = F.size(F.array_intersect(token_set(F.col("_t")), token_set(F.col("_w"))))
    score = (
        F.least(F.lit(16), F.col("family_hits") * 4) + F.when(F.contains("_c", F.col("_wc")), 18).otherwise(0)
        + F.when(F.contains("_t", F.col("_w")), 8).otherwise(0) + F.least(F.lit(8), overlap * 2)
    )
    near = candidates(w.select(scope, "_w").distinct(), l.select(scope, "_t").distinct(), [scope], ["_w"], ["_t"], ["_w"], ["_t"], around=False)
    pair = w.join(near, [scope, "_w"]).join(l, [scope, "_t"]).withColumn("link_score", score.cast("int")).filter(F.col("link_score") >= floor)
    return best_row(pair, [scope, "value"], [F.col("link_score"), -F.col("link_no")], ["href", "link_score"])


def option_link_score(link_text: Column, value: Column, alias_hit: Column, setlink_hit: Column, same_family: Column) -> Column:
    """Fit of an on-page option link for a requested value."""
    t, w = loose_key(link_text), loose_key(value)
    overlap = F.size(F.array_intersect(token_set(t), token_set(w)))
    text = F.when(t == w, 16).when(F.contains(t, w) & (w != ""), 9).when(compact_key(link_text) == compact_key(value), 6).otherwise(overlap)
    return text + F.when(alias_hit, 4).otherwise(0) + F.when(setlink_hit, 3).otherwise(0) + F.when(same_family, 12).otherwise(-12)


def rank_controls(requests: DataFrame, controls: DataFrame, scope: str, limit: int = 10) -> DataFrame:
    """Page controls for requested options: strict pass (key hit or score 12+), then relaxed; first ``limit`` per request."""
    want = requests.select(scope, "key", "value").distinct().withColumn("_w", match_text(F.col("value"))).withColumn("_k", match_text(F.col("key")))
    c = controls.select(scope, "control_no", match_text(F.col("visible_label")).alias("_l"), match_text(F.col("group_label")).alias("_g"))
    lab = c.groupBy(scope, "_l", "_g").agg(F.min("control_no").alias("control_no"))
    overlap = F.size(F.array_intersect(token_set(F.col("_l")), token_set(F.col("_w"))))
    score = (
        F.when(F.col("_l") == F.col("_w"), 18).when((F.col("_w") != "") & F.contains("_l", F.col("_w")), 10)
        .when((F.col("_l") != "") & F.contains("_w", F.col("_l")), 8).otherwise(F.least(F.lit(6), overlap * 2))
    )
    hit = (F.col("_g") != "") & F.contains("_g", F.col("_k"))
    by_value = candidates(want.select(scope, "_w").distinct(), lab.select(scope, "_l").distinct(), [scope], ["_w"], ["_l"], ["_w"], ["_l"])
    by_key = candidates(want.select(scope, "_k").distinct(), lab.select(scope, "_g").distinct(), [scope], ["_k"], ["_g"], ["_k"], ["_g"], around=False, shared=False)
    # an empty key stands in every group label
    unnamed = want.filter("_k = ''").select(scope, "_k").distinct().join(lab.filter("_g <> ''").select(scope, "_g").distinct(), scope)
    ids = ["key", "value", "_w", "_k"]
    met = want.join(by_value, [scope, "_w"]).join(lab, [scope, "_l"]).select(scope, *ids, "_l", "_g", "control_no").unionByName(
        want.join(by_key.unionByName(unnamed), [scope, "_k"]).join(lab, [scope, "_g"]).select(scope, *ids, "_l", "_g", "control_no")
    ).distinct()
    pair = met.withColumn("control_score", (score + F.when(hit, 5).otherwise(0)).cast("int")).filter("control_score > 0")
    pair = pair.withColumn("pass_no", F.when(hit | (F.col("control_score") >= 12), 1).otherwise(2))
    return top_k(pair, [scope, "key", "value"], [F.asc("pass_no"), F.desc("control_score"), F.asc("control_no")], limit, "place").select(
        scope, "key", "value", "place", "control_no", "control_score", "pass_no"
    )
