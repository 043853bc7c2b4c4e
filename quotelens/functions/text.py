"""Text normalisation and similarity, as Column -> Column expressions (no Python UDFs)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


MARK = "\u0001"  # separates the words of a joined word list


def contains_any(text: Column, tokens: list[str]) -> Column:
    """True when any token is a substring. Null text counts as no hit.

    Long lists go through ``exists`` over a literal array: a substring search is much cheaper than a regex
    alternation, and the generated methods stay small enough for the JIT.
    """
    if len(tokens) <= 2:
        return F.coalesce(reduce(lambda a, b: a | b, [text.contains(t) for t in tokens]), F.lit(False))
    # the one-element array binds the text, so a computed text is evaluated once and not per token
    hit = F.exists(F.array(text), lambda x: F.exists(string_array(tokens), lambda t: F.contains(x, t)))
    return F.coalesce(hit, F.lit(False))


def hits_in(text: Column, tokens: list[str]) -> Column:
    """The tokens that are substrings of the text."""
    return F.filter(string_array(tokens), lambda t: F.contains(text, t))


def joined_words(words: Column) -> Column:
    """Array of words as one text in which each word stands between marks."""
    return F.concat(F.lit(MARK), F.array_join(words, MARK), F.lit(MARK))


def _marked(words: list[str]) -> list[str]:
    return [f"{MARK}{w}{MARK}" for w in words]


def has_word(joined: Column, words: list[str]) -> Column:
    return contains_any(joined, _marked(words))


def count_words(joined: Column, words: list[str]) -> Column:
    """How many of the words stand in a joined list."""
    return F.size(hits_in(joined, _marked(words)))


def words_found(joined: Column, words: list[str]) -> Column:
    return F.transform(hits_in(joined, _marked(words)), lambda w: F.replace(w, F.lit(MARK), F.lit("")))


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _decomposition_table() -> tuple[str, str]:
    """One-to-one part of NFKD followed by the ASCII filter, over the Latin blocks.

    The table follows from the Unicode database: letters whose decomposition keeps exactly one ASCII character.
    """
    src, dst = [], []
    for cp in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2070, 0x20A0), *range(0xFF01, 0xFF5F)]:
        ch = chr(cp)
        kept = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(kept) == 1 and kept not in "'":
            src.append(ch)
            dst.append(kept)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _decomposition_table()


def fold_ascii(text: Column) -> Column:
    """NFKD + drop of what is not ASCII. Letters without an ASCII base (such as ß) vanish."""
    multi = F.replace(F.replace(text, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return F.regexp_replace(F.translate(multi, _ACCENTED, _PLAIN), r"[^\x00-\x7f]+", "")


def match_text(value: Column) -> Column:
    """Label key for matching: lower, fold to ASCII, '&' spelt out, other signs to single spaces."""
    text = fold_ascii(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))))
    text = F.replace(text, F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def catalog_text(value: Column) -> Column:
    """Catalog variant of the key: no accent folding, the broken square sign repaired first."""
    text = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    text = F.replace(F.replace(text, F.lit("Â²"), F.lit("2")), F.lit("â²"), F.lit("2"))
    return F.trim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once; an expression that is written out several times is computed as often, inside
    a lambda even for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def token_set(normalised: Column) -> Column:
    """Distinct tokens of an already normalised text."""
    return F.array_distinct(F.filter(F.split(normalised, " "), lambda t: t != ""))


def match_parts(normalised: Column) -> Column:
    """What a comparison needs of a normalised text, computed once per text: plain, without spaces, marked words."""
    return F.struct(
        normalised.alias("n"), F.replace(normalised, F.lit(" "), F.lit("")).alias("c"), joined_words(token_set(normalised)).alias("j"),
        F.transform(token_set(normalised), lambda t: F.concat(F.lit(MARK), t, F.lit(MARK))).alias("w"),
    )


def match_score_parts(cand: Column, want: Column) -> Column:
    """Similarity of two texts given by ``match_parts``: 30 equal, 20 contained, 24/16 without spaces, else shared words."""
    shared = F.size(F.filter(want["w"], lambda t: F.contains(cand["j"], t)))
    return (
        F.when((F.coalesce(cand["n"], F.lit("")) == "") | (F.coalesce(want["n"], F.lit("")) == ""), F.lit(0))
        .when(cand["n"] == want["n"], F.lit(30))
        .when(F.contains(want["n"], cand["n"]) | F.contains(cand["n"], want["n"]), F.lit(20))
        .when(cand["c"] == want["c"], F.lit(24))
        .when(F.contains(want["c"], cand["c"]) | F.contains(cand["c"], want["c"]), F.lit(16))
        .otherwise(F.least(F.lit(14), shared * 4))
    )


def match_score_normalised(cand: Column, want: Column) -> Column:
    return match_score_parts(match_parts(cand), match_parts(want))


def match_score(candidate: Column, desired: Column) -> Column:
    return match_score_normalised(match_text(candidate), match_text(desired))


def squeeze(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s+", " "))


def compatibility_text(text: Column) -> Column:
    """NFKD over lower-case Latin text: signs to their digits, accented letters to letter + mark."""
    out = F.translate(text, "\u00a0²³¹", " 231")
    for cp in [*range(0xE0, 0x180)]:
        decomposed = unicodedata.normalize("NFKD", chr(cp))
        if len(decomposed) == 2 and chr(cp).islower() and cp < 0x100:
            out = F.replace(out, F.lit(chr(cp)), F.lit(decomposed))
    return out


def label_key(value: Column) -> Column:
    """Value-map label key: compatibility forms resolved, squeezed, lower."""
    return squeeze(compatibility_text(F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))))


def label_matches(requested: Column, captured: Column) -> Column:
    """Requested label equals the captured one or is part of it (not the reverse)."""
    req, cap = label_key(requested), label_key(captured)
    return (req != "") & (cap != "") & F.contains(cap, req)


def loose_key(value: Column) -> Column:
    """Comparison key for backend labels: accents folded, known unit spellings unified, letters and digits kept."""
    text = F.lower(unescape_html(F.trim(F.coalesce(value.cast("string"), F.lit("")))))
    text = F.regexp_replace(F.translate(text, _ACCENTED, _PLAIN), r"\p{Mn}+", "")
    text = F.regexp_replace(text, r"\bfsc\s*r\b", "fsc")
    text = F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("gsm"), F.lit(" g m2 "))
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def compact_key(value: Column) -> Column:
    return F.replace(loose_key(value), F.lit(" "), F.lit(""))


# Entity name -> character.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#34;": '"', "&#39;": "'", "&apos;": "'",
    "&euro;": "€", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&Auml;": "Ä", "&Ouml;": "Ö", "&Uuml;": "Ü",
    "&szlig;": "ß", "&sup2;": "²", "&reg;": "®", "&middot;": "·", "&copy;": "©", "&amp;": "&",
}


def unescape_html(text: Column) -> Column:
    """Named and numeric entities that occur in captured markup."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), text)


def unescape_embedded(text: Column) -> Column:
    """Markup that sits inside a JSON string: undo the textual escapes."""
    # Escape -> character.
    escapes = {
        '\\"': '"', "\\/": "/", "\\u003c": "<", "\\u003C": "<", "\\u003e": ">", "\\u003E": ">", "\\u0026": "&",
        "&amp;": "&",
    }
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), escapes.items(), text)


def url_unquote(text: Column) -> Column:
    """Percent-decoding that keeps '+' and leaves undecodable text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def unquote_fully(text: Column, passes: int = 3) -> Column:
    out = F.coalesce(text, F.lit(""))
    for _ in range(passes):
        out = url_unquote(out)
    return out


def decode_template(text: Column) -> Column:
    return unquote_fully(unescape_html(F.trim(F.coalesce(text, F.lit("")))))


def value_equals(left: Column, right: Column) -> Column:
    """Equal, or equal after trim and lower. A null equals only a null."""
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(
        F.lower(F.trim(left)) == F.lower(F.trim(right))
    )


def first_int(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"\d+", 0), F.lit("")).try_cast("bigint")


def quantity_matches(requested: Column, accepted: Column) -> Column:
    return F.coalesce(first_int(requested) == first_int(accepted), F.lit(False))


def format_matches(requested: Column, accepted: Column) -> Column:
    req, acc = F.upper(F.trim(requested)), F.upper(F.trim(accepted))
    return F.coalesce(req.rlike(r"^A\d+$") & F.contains(acc, req), F.lit(False))


def option_matches(key: Column, requested: Column, accepted: Column) -> Column:
    """Equality, with the semantic rule of quantities (first number) and formats (code contained)."""
    k = F.lower(F.trim(key))
    return (
        value_equals(requested, accepted)
        | ((k == "quantity") & quantity_matches(requested, accepted))
        | ((k == "format") & format_matches(requested, accepted))
    )


def slug(value: Column, fallback: str = "unknown") -> Column:
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"[^a-z0-9._-]+", "-")
    text = F.regexp_replace(F.regexp_replace(text, r"-+", "-"), r"^[-._]+|[-._]+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def option_value_type(raw: Column) -> Column:
    """bool / null / int / float / str of a textual option value."""
    v = F.trim(raw)
    return (
        F.when(F.lower(v).isin("true", "false"), "bool")
        .when(F.lower(v).isin("null", "none"), "null")
        .when(v.rlike(r"^[-+]?\d+$"), "int")
        .when(v.rlike(r"^[-+]?(\d+\.\d*|\d*\.\d+)([eE][-+]?\d+)?$"), "float")
        .otherwise("str")
    )


def option_number(raw: Column) -> Column:
    return F.when(option_value_type(raw).isin("int", "float"), F.trim(raw).try_cast("double"))


def fingerprint(text: Column, length: int = 12) -> Column:
    return F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, length)


def group_label(raw: Column) -> Column:
    """Readable control-group label: technical affixes off, internal ids blank."""
    text = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)_essential$", "")
    text = F.regexp_replace(text, r"(?i)^input_?var_", "")
    text = F.trim(F.regexp_replace(text, r"[_\-\s]+", " "))
    internal = text.rlike(r"^(?:[A-Z]{3,}\d{2,}|Z?[A-Z]{2,}\d{2,}[A-Z0-9_]*)$")
    return F.when(internal, F.lit("")).otherwise(text)
