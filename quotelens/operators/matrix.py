"""Audit of bulk price-matrix responses: net and gross totals, accepted option and quantity, next link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.jsonwalk import get, parse
from quotelens.functions.money import parse_price
from quotelens.functions.urls import replace_pair

# Response fields that carry the page parts.
PARTS = {
    "total": "WS-Ajax-productConfigTotalPriceAjax", "extra": "WS-Ajax-additionalOptionAjax", "essential": "WS-Ajax-essentialsAdditionalOptionsAjax",
    "config": "WS-Ajax-productConfigContentAjax3", "init": "WS-Ajax-initLogicAjax",
}
COVER_FIELD = r'\bname="(input_var_ZBR[0-9A-Z]+_1_2)"'


def response_parts(df: DataFrame, body: str) -> DataFrame:
    d = df.withColumn("_v", parse(F.col(body)))
    for name, field in PARTS.items():
        d = d.withColumn(f"part_{name}", F.coalesce(get(F.col("_v"), f"$['{field}']"), F.lit("")))
    return d.drop("_v")


def net_text(total: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(total, r"netto</span><span[^>]*>\s*&euro;\s*([^<]+)<", 1)), F.lit(""))


def gross_text(total: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(total, r'productConfigTotalPriceBruttoPrice"[^>]*>\s*&euro;\s*([^<]+)<', 1)), F.lit(""))


def next_link(init: Column) -> Column:
    raw = F.regexp_extract(init, r"productPageObj\.(?:currentLink|setLink)='([^']+)'", 1)
    return F.nullif(F.replace(raw, F.lit("&amp;"), F.lit("&")), F.lit(""))


def _input_tags(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"<input[^>]*>"), 0)


def checked_value(html: Column, field: Column) -> Column:
    """Value of the checked input of a field."""
    mine = F.filter(_input_tags(html), lambda t: F.contains(t, F.concat(F.lit('name="'), field, F.lit('"'))) & t.rlike(r"\bchecked\b"))
    return F.nullif(F.regexp_extract(F.get(mine, F.lit(0)), r'\bvalue="([^"]*)"', 1), F.lit(""))


def offers_value(html: Column, field: Column, value: Column) -> Column:
    tag_has = lambda t: F.contains(t, F.concat(F.lit('name="'), field, F.lit('"'))) & (F.regexp_extract(t, r'\bvalue="([^"]*)"', 1) == value)
    return F.exists(_input_tags(html), tag_has)


def audit(responses: DataFrame, body: str, prod: str, quantity: str, cover: str, typed_from: int = 20_000) -> DataFrame:
    """Totals and mismatches per response row.

    From ``typed_from`` pieces the quantity is typed and must come back in the number input. A missing total, a
    different cover and a different typed quantity are mismatches.
    """
    d = response_parts(responses, body)
    field = F.coalesce(F.nullif(F.regexp_extract("part_extra", COVER_FIELD, 1), F.lit("")), F.nullif(F.regexp_extract("part_essential", COVER_FIELD, 1), F.lit("")))
    d = d.withColumn("cover_field", field)
    in_extra, in_essential = checked_value(F.col("part_extra"), F.col("cover_field")), checked_value(F.col("part_essential"), F.col("cover_field"))
    # checked in both places is ambiguous
    got = F.when(in_extra.isNotNull() & in_essential.isNotNull(), F.lit(None)).otherwise(F.coalesce(in_extra, in_essential))
    marker = F.concat(F.lit('name="input_var_'), F.col(prod), F.lit('_3_1"[^>]*checked[^>]*value="Interpolation"'))
    typed = F.regexp_extract("part_config", r'<input[^>]*\btype="number"[^>]*\bname="input_qty_1"[^>]*\bvalue="(\d+)"', 1).try_cast("bigint")
    d = (
        d.withColumn("net", parse_price(net_text(F.col("part_total")))).withColumn("gross", parse_price(gross_text(F.col("part_total"))))
        .withColumn("next_setlink", next_link(F.col("part_init"))).withColumn("accepted_cover", got)
        .withColumn("interpolation_checked", F.coalesce(F.rlike(F.col("part_config"), marker), F.lit(False))).withColumn("typed_quantity", typed)
    )
    big = F.col(quantity).cast("bigint") >= typed_from
    issues = F.filter(
        F.array(
            F.when(F.col("net").isNull() | F.col("gross").isNull(), "price_missing"),
            F.when(F.col("cover_field").isNotNull() & ~F.col("accepted_cover").eqNullSafe(F.col(cover)), "cover_mismatch"),
            F.when(big & ~(F.col("interpolation_checked") & F.col("typed_quantity").eqNullSafe(F.col(quantity).cast("bigint"))), "quantity_mismatch"),
            F.when(F.col("next_setlink").isNull(), "next_link_missing"),
        ), lambda x: x.isNotNull(),
    )
    return d.withColumn("issues", F.array_join(issues, ",")).drop(*[f"part_{p}" for p in PARTS])


def set_cover(pairs: Column, field: Column, value: Column) -> Column:
    """Form pairs with stale cover fields dropped and the active one set."""
    return replace_pair(F.filter(pairs, lambda p: ~p["key"].rlike(r"^input_var_ZBR[0-9A-Z]+_1_2$")), field, value)


def failed_pairs(failures: DataFrame, uid: str, error: str) -> DataFrame:
    """(UID, quantity) of recorded failures, the quantity read from the error text."""
    qty = F.nullif(F.regexp_extract(error, r"qty=(\d+)", 1), F.lit(""))
    return failures.select(F.trim(F.col(uid)).alias("uid"), qty.cast("int").alias("quantity")).filter("uid <> '' and quantity is not null").distinct()


def repair_text(value: Column) -> Column:
    """Square-metre signs broken by a wrong encoding."""
    return F.replace(F.replace(value, F.lit("mÂ²"), F.lit("m²")), F.lit("m�"), F.lit("m²"))
