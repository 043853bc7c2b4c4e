"""Walk of nested JSON: one scan of each body, one plan whatever the depth.

A body is parsed once into a VARIANT, whose text has no white space and each key once. A scanner reads that text token by
token with a stack of open containers (no recursion) and returns all leaves as one array, which Spark unnests.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\[\]{},:"\s]+', re.S)
_LEAF = pa.struct([("path", pa.string()), ("leaf_key", pa.string()), ("value", pa.string()), ("number", pa.float64()), ("kind", pa.string()), ("ord", pa.list_(pa.int32()))])
LEAVES = "array<struct<path:string,leaf_key:string,value:string,number:double,kind:string,ord:array<int>>>"


def parse(body: Column) -> Column:
    """VARIANT of the text, null where it is not JSON."""
    return F.try_parse_json(F.nullif(F.trim(body), F.lit("")))


def get(variant: Column, path: str, dtype: str = "string") -> Column:
    """``$.a.b[0]`` lookup."""
    return F.try_variant_get(variant, path if path.startswith("$") else "$." + path, dtype)


def nesting(variant: Column) -> Column:
    """How deep containers stand inside each other; null for null."""
    brackets = F.regexp_replace(F.to_json(variant), r'"(?:[^"\\\\]|\\\\.)*+"|[^\[\]{}]++', "")
    step = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct(
            (a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )
    return step["most"]


def _unquoted(token: str) -> str:
    return json.loads(token) if "\\" in token else token[1:-1]


def leaves_of(text: str, array_items: int | None = None) -> list[dict]:
    """The leaves of valid JSON text in their order; items of an array from array_items on are passed over."""
    out, stack = [], []  # of open containers: [path, leaf key, positions, is an array, position, skipped]
    path, key, places, skipped = "", "", [], False

    def leaf(value: str | None, kind: str, number: float | None = None) -> None:
        if not skipped:
            out.append({"path": path, "leaf_key": key, "value": value, "number": number, "kind": kind, "ord": places})

    tokens = _TOKEN.findall(text)
    at, n = 0, len(tokens)
    while at < n:
        token = tokens[at]
        at += 1
        if token == "]" or token == "}":
            stack.pop()
            continue
        if token == ",":
            stack[-1][4] += 1
            continue
        if stack:  # what follows is an item of the innermost container
            above, above_key, above_places, is_array, place, above_skipped = stack[-1]
            if is_array:
                path, key = f"{above}[{place}]", above_key
            else:
                key = _unquoted(token)
                path = f"{above}.{key}" if above else key
                token = tokens[at + 1]
                at += 2
            places = [*above_places, place]
            skipped = above_skipped or (is_array and array_items is not None and place >= array_items)
        if token == "[" or token == "{":
            if tokens[at] in "]}":
                leaf(token + tokens[at], "empty")
                at += 1
            else:
                stack.append([path, key, places, token == "[", 0, skipped])
        elif token[0] == '"':
            leaf(_unquoted(token), "text")
        elif token == "null":
            leaf(None, "null")
        elif token in ("true", "false"):
            leaf(token, "bool")
        else:
            leaf(token, "number", float(token))
    return out


def leaves(variant: Column, array_items: int | None = None) -> Column:
    """All leaves of a VARIANT as one array; see ``walk``."""

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else leaves_of(t, array_items) for t in texts.to_pylist()], pa.list_(_LEAF))

    scan.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(scan, LEAVES)(F.to_json(variant))


def walk(df: DataFrame, variant_col: str, keep: list[str], array_items: int | None = None) -> DataFrame:
    """All leaves of the VARIANT column.

    Output: the ``keep`` columns and
      path      dotted path, ``a.l[0].total``
      leaf_key  innermost object key on the path
      value     leaf as text
      number    leaf as double where it is a JSON number, else null
      kind      number / text / bool / null / empty (an empty container)
      ord       positions along the path, sortable as an array
    ``array_items`` keeps only the first items of every array (path listings).
    """
    body = df.filter(F.col(variant_col).isNotNull()).select(*keep, leaves(F.col(variant_col), array_items).alias("_leaves"))
    # outer: for an inner one Spark asks first whether the array has items, and scans the body another time for that
    return body.select(*keep, F.inline_outer("_leaves")).filter("path is not null")


def object_keys(df: DataFrame, body_col: str, keep: list[str]) -> DataFrame:
    """Distinct lower-case object keys of a JSON text, at any depth: one row per (keep, key)."""
    leaves = walk(df.withColumn("_body_v", parse(F.col(body_col))), "_body_v", keep)
    parts = F.filter(F.split(F.regexp_replace("path", r"\[\d+\]", ""), r"\."), lambda k: k != "")
    return leaves.select(*keep, F.explode(parts).alias("_k")).select(*keep, F.lower("_k").alias("json_key")).distinct()


def key_set(body: Column) -> Column:
    """Distinct lower-case object keys of a JSON text as an array, without a shuffle and without lambdas.

    A key is a quoted string before a colon; the second alternative consumes string values so that their content is
    never taken for a key. Text that does not parse has no keys.
    """
    text = F.trim(body)
    looks_json = F.substring(text, 1, 1).isin("{", "[")
    valid = looks_json & F.try_parse_json(text).isNotNull()
    plain = F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\.", "_")).otherwise(text)
    names = F.regexp_extract_all(F.lower(plain), F.lit(r'"([^"]*)"\s*:|"[^"]*"'), 1)
    return F.when(valid, F.array_except(names, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
