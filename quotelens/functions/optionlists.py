"""Option lists and configuration facts in response texts, also in texts that were cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelens.functions.jsonwalk import get, parse

# Keys whose objects describe the configuration, later ones win.
CONFIGURATION_KEYS = ["propGroupsTranslatedWithPropsTranslated", "propGroupsWithPropsTranslated", "propsTranslated", "propGroupWithPropertyName"]


def embedded_object(text: Column, key: str) -> Column:
    """MAP of the first flat object under a key, wherever it stands in the text; null if there is none or it does not parse."""
    inside = F.regexp_extract(text, rf'(?s)"\Q{key}\E"\s*:\s*\{{(.*?)\}}', 1)
    found = text.rlike(rf'(?s)"\Q{key}\E"\s*:\s*\{{(.*?)\}}')
    blob = F.concat(F.lit("{"), inside, F.lit("}"))
    return F.when(found & F.try_parse_json(blob).isNotNull(), F.from_json(blob, "map<string,string>"))


def preview_configuration(text: Column) -> Column:
    """MAP of all configuration objects in a text, empty values and nulls left out; of a field that stands in several, the last key's value."""
    none = F.array().cast("array<struct<key:string,value:string>>")
    parts = [F.coalesce(F.map_entries(embedded_object(text, k)), none) for k in CONFIGURATION_KEYS]
    pairs = F.filter(F.transform(F.concat(*parts), lambda e: F.struct(e["key"].alias("key"), F.trim(e["value"]).alias("value"))), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    last = F.aggregate(
        pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _v: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))
    )
    return last


def closed_part(text: Column, opening: str, closing: str) -> Column:
    """The text up to the bracket that closes its first one; null where the text was cut before that.

    The text is split behind each bracket, and the depth is folded over these pieces: one pass, no nesting limit.
    """
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\Q{opening}{closing}\E]*[\Q{opening}{closing}\E]"), 0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        depth = a["depth"] + F.when(piece.endswith(opening), 1).otherwise(-1)
        going = F.struct(depth.alias("depth"), (a["size"] + F.char_length(piece)).alias("size"), (depth <= 0).alias("done"))
        return F.when(a["done"], a).otherwise(going)

    end = F.aggregate(pieces, start, step)
    return F.when(end["done"], F.substr(text, F.lit(1), end["size"]))


def property_options(text: Column) -> Column:
    """ARRAY<STRUCT<property_id, is_range, value_ids>> of ``propertyOptions`` in a JSON body; rows without a positive id are left out."""
    options = F.try_variant_get(parse(text), "$.propertyOptions", "array<variant>")
    ids = lambda rows: F.filter(F.transform(rows, lambda r: F.try_variant_get(r, "$.id", "bigint")), lambda v: v > 0)
    rows = F.transform(
        options,
        lambda o: F.struct(
            F.try_variant_get(o, "$.id", "bigint").alias("property_id"), F.coalesce(F.try_variant_get(o, "$.isRange", "boolean"), F.lit(False)).alias("is_range"),
            F.coalesce(ids(F.try_variant_get(o, "$.propertyValueOptions", "array<variant>")), F.array().cast("array<bigint>")).alias("value_ids"),
        ),
    )
    return F.coalesce(F.filter(rows, lambda o: o["property_id"] > 0), F.array().cast("array<struct<property_id:bigint,is_range:boolean,value_ids:array<bigint>>>"))


def quantity_value_options(text: Column, property_id: Column, window: int = 120_000) -> Column:
    """Sorted distinct value ids of one property.

    From the JSON where the body is whole. Of a cut body, from the list that follows the property's id within ``window``
    characters (the distance within which a list still belongs to the id), if that list is closed.
    """
    mine = F.get(F.filter(property_options(text), lambda o: o["property_id"] == property_id), F.lit(0))
    whole = F.try_variant_get(parse(text), "$.propertyOptions", "array<variant>").isNotNull() & mine.isNotNull()
    anchor = F.instr(F.lower(text), F.concat(F.lit('"id":'), property_id.cast("string")))
    near = F.substr(text, anchor, F.lit(window))
    behind = F.regexp_extract(near, r'(?is)"propertyvalueoptions".*?(\[.*)', 1)
    ids = F.transform(F.regexp_extract_all(closed_part(behind, "[", "]"), F.lit(r'"id"\s*:\s*(\d+)'), 1), lambda v: v.try_cast("bigint"))
    scanned = F.when((anchor > 0) & (behind != ""), ids)
    found = F.when(whole, mine["value_ids"]).otherwise(F.coalesce(scanned, F.array().cast("array<bigint>")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v > 0)))


def print_runs(allowed: Column, quantity: Column) -> Column:
    """The requested quantity and the next three allowed ones; null if it is not allowed."""
    at = F.array_position(allowed, quantity)
    return F.when(at > 0, F.slice(allowed, F.greatest(at, F.lit(1)).cast("int"), F.lit(4)))
