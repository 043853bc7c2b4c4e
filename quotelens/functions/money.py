"""Money text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quotelens.functions import vocab


def _separators_resolved(cleaned: Column, thousands_dots: bool) -> Column:
    has_comma, has_dot = F.contains(cleaned, F.lit(",")), F.contains(cleaned, F.lit("."))
    comma_last = F.instr(F.reverse(cleaned), ",") < F.instr(F.reverse(cleaned), ".")
    no_dots = F.replace(cleaned, F.lit("."), F.lit(""))
    german = F.replace(no_dots, F.lit(","), F.lit("."))
    english = F.replace(cleaned, F.lit(","), F.lit(""))
    out = F.when(has_comma & has_dot & ~comma_last, english).when(has_comma, german)
    if thousands_dots:
        out = out.when(F.size(F.split(cleaned, r"\.")) > 2, no_dots)
    return out.otherwise(cleaned)


def _plain_number(text: Column) -> Column:
    return F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$"), text.try_cast("double"))


def parse_prices(texts: Column) -> Column:
    """The valid prices among money texts, German or English. Several dots are thousands marks; (0, 1e6] is valid.

    Each step is one pass over the array that binds its element: written into one another, the steps would be evaluated
    anew for every mention of the text, some fifty times a number.
    """
    cleaned = F.transform(texts, lambda t: F.replace(F.trim(t), F.lit(" "), F.lit("")))
    plain = F.transform(cleaned, lambda c: _separators_resolved(c, thousands_dots=True))
    return F.filter(F.transform(plain, _plain_number), lambda v: (v > 0) & (v <= vocab.PRICE_MAX))


def parse_price(text: Column) -> Column:
    """German or English money text to double; null outside (0, 1e6]. Several dots are thousands marks."""
    return F.get(parse_prices(F.array(text)), F.lit(0))


def coerce_price(text: Column) -> Column:
    """Adapter variant: no range rule, no thousands rule."""
    cleaned = F.replace(F.trim(text), F.lit(" "), F.lit(""))
    return _plain_number(_separators_resolved(cleaned, thousands_dots=False))


def price_numbers(text: Column) -> Column:
    """All money-like numbers of a text that are valid prices."""
    return parse_prices(F.regexp_extract_all(text, F.lit(vocab.PRICE_NUMBER_GUARDED), 0))


def first_price(text: Column) -> Column:
    """First number of the text as a price, no-break spaces treated as spaces."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\u00a0"), F.lit(" "))
    token = F.regexp_replace(F.regexp_extract(plain, vocab.PRICE_NUMBER, 0), r"\s+", "")
    return parse_price(F.nullif(token, F.lit("")))


def vat_percent(line: Column) -> Column:
    """Tax rate named on a line, 0 < rate <= 35, else null."""
    low = F.lower(line)
    token = F.nullif(F.regexp_extract(low, r"(\d{1,2}(?:[\.,]\d{1,2})?)\s*%", 1), F.lit(""))
    rate = F.filter(parse_prices(F.array(token)), lambda r: r <= 35)
    return F.when(low.rlike("mwst|vat|inkl|tax"), F.get(rate, F.lit(0)))


def round2(value: Column) -> Column:
    return F.round(value, 2)


def format_cents(cents: Column, decimal: str = ".") -> Column:
    """Integer cents as plain money text."""
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit(decimal), F.lpad((cents % 100).cast("string"), 2, "0")
    )
