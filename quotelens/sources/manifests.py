"""Manifest readers: JSON and CSV target lists to unit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotelens.functions.jsonwalk import get
from quotelens.functions.text import option_value_type

# CSV columns that are not options.
RESERVED = [
    "url", "site_name", "product_type", "type", "expected_currency", "expected_price", "expected_price_tolerance", "options", "options_json", "uid", "id",
    "row_id", "net_price", "gross_price", "price", "currency",
]


def read_json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``[...]`` or ``{"targets": [...]}``; an entry without URL stops the query."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = F.coalesce(get(F.col("v"), "$.targets", "variant"), F.col("v"))
    rows = doc.withColumn("v", items).lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(F.col("pos").alias("unit_ord"), F.col("value").alias("t"))
    return _json_rows(rows)


def read_json_lines_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One target object per line, for manifests of any size."""
    rows = spark.read.text(path).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("unit_ord"), F.parse_json("value").alias("t"))
    return _json_rows(rows)


def _json_rows(rows: DataFrame) -> DataFrame:
    text = lambda n: F.nullif(F.trim(get(F.col("t"), f"$.{n}")), F.lit(""))
    options = F.from_json(F.to_json(get(F.col("t"), "$.options", "variant")), "map<string,string>")
    url = F.coalesce(text("url"), F.raise_error(F.lit("manifest entry without url")).cast("string"))
    return rows.select(
        "unit_ord", url.alias("url"), text("site_name").alias("site_name"), F.coalesce(text("product_type"), F.lit("unknown")).alias("product_type"),
        get(F.col("t"), "$.expected_price", "double").alias("expected_price"), F.coalesce(get(F.col("t"), "$.expected_price_tolerance", "double"), F.lit(0.01)).alias("expected_price_tolerance"),
        F.coalesce(text("expected_currency"), F.lit("EUR")).alias("expected_currency"), F.coalesce(options, F.create_map().cast("map<string,string>")).alias("options"),
    )


def _csv_encoding(content) -> str:
    """Encoding of a file: UTF-8, else the Windows code page, else Latin-1; tried piece by piece."""
    import codecs

    for encoding in ("utf-8-sig", "cp1252"):
        decoder = codecs.getincrementaldecoder(encoding)()
        try:
            for at in range(0, len(content), 1 << 20):
                decoder.decode(bytes(content[at : at + (1 << 20)]))
            decoder.decode(b"", final=True)
            return encoding
        except UnicodeDecodeError:
            continue
    return "latin-1"


def _delimiter(head: str) -> str:
    """What the file's first characters are split by."""
    import csv

    try:
        return csv.Sniffer().sniff(head, delimiters=",;\t|").delimiter
    except csv.Error:
        return ";" if head.count(";") > head.count(",") else ","


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """file, row_no (from 2, as in the file without blank rows) and cells (MAP header -> text) of every CSV file under a path.

    Each file is read by itself, with its own encoding, delimiter and header. Of equal headers the last one counts. A task
    holds the bytes of a file, and decodes and parses them piece by piece.
    """

    def records(batches):
        import csv
        import io

        import pyarrow as pa

        kind = pa.map_(pa.string(), pa.string())

        def batch_of(file, start, rows):
            return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(start, start + len(rows)), pa.int64()), pa.array(rows, kind)], names=["file", "row_no", "cells"])

        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = content.as_buffer()
                encoding = _csv_encoding(memoryview(raw))
                opened = lambda raw=raw, encoding=encoding: io.TextIOWrapper(pa.BufferReader(raw), encoding=encoding, newline="")
                reader = csv.reader(opened(), delimiter=_delimiter(opened().read(4096)))
                names = [n.strip() for n in next((r for r in reader if r), [])]
                start, rows = 2, []
                for cells in reader:
                    if cells:
                        rows.append(list(dict(zip(names, cells)).items()))  # noqa: B905
                    if len(rows) == 10_000:
                        yield batch_of(file, start, rows)
                        start, rows = start + len(rows), []
                if rows:
                    yield batch_of(file, start, rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(records, "file string, row_no long, cells map<string,string>")


def read_csv_manifest(
    spark: SparkSession, path: str, default_url: str | None = None, default_site: str | None = None, default_product: str | None = None
) -> DataFrame:
    """CSV rows to units, file by file. ``option.X`` and all other non-reserved columns become options, over ``options_json``."""
    entries = F.map_entries("cells")
    plain_key = lambda k: F.regexp_replace(F.replace(F.lower(F.trim(k)), F.lit("-"), F.lit("_")), r"\s+", "_")
    keyed = F.transform(entries, lambda e: F.struct(e["key"].alias("name"), plain_key(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    d = csv_records(spark, path).select("file", "row_no", keyed.alias("_cells"))

    def named_as(key: str):
        return lambda c: c["key"] == key

    def text(*keys: str) -> Column:
        # the last of several columns with the same key
        cells = [F.try_element_at(F.filter("_cells", named_as(k)), F.lit(-1))["value"] for k in keys]
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in cells])

    def option_name(c: Column) -> Column:
        return F.when(c["name"].startswith("option."), F.trim(F.substring(c["name"], 8, 1 << 30))).when(c["key"].isin(RESERVED), "").otherwise(c["name"])

    named = F.filter(F.transform("_cells", lambda c: F.struct(option_name(c).alias("key"), c["value"].alias("value"))), lambda o: (o["key"] != "") & (F.coalesce(o["value"], F.lit("")) != ""))
    # "option.X" and "X" may both be there: the later column counts
    own = F.map_from_entries(F.filter(named, lambda o, i: ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda later: later["key"] == o["key"])))
    given = text("options_json", "options")
    parsed = F.from_json(given, "map<string,string>", {"mode": "FAILFAST"})
    empty = F.create_map().cast("map<string,string>")
    d = d.withColumn("_own", own)
    base = F.map_filter(F.coalesce(parsed, empty), lambda k, _v: ~F.map_contains_key("_own", k))
    tol = text("expected_price_tolerance")
    bad_tol = F.raise_error(F.concat(F.lit("invalid expected_price_tolerance: "), tol)).cast("double")
    no_url = F.raise_error(F.concat(F.lit("CSV row "), F.col("row_no").cast("string"), F.lit(" without url: "), F.col("file"))).cast("string")
    return d.select(
        F.coalesce(text("url"), F.lit(default_url), no_url).alias("url"), F.coalesce(text("site_name"), F.lit(default_site)).alias("site_name"),
        F.coalesce(text("product_type", "type"), F.lit(default_product), F.lit("unknown")).alias("product_type"),
        text("expected_price", "net_price").try_cast("double").alias("expected_price"),
        F.when(tol.isNull(), 0.01).otherwise(F.coalesce(tol.try_cast("double"), bad_tol)).alias("expected_price_tolerance"),
        F.coalesce(text("expected_currency"), F.lit("EUR")).alias("expected_currency"), F.map_concat(base, "_own").alias("options"), "file", "row_no",
    )


def unit_options(units: DataFrame, keys: list[str]) -> DataFrame:
    """Exploded options with the type of each value."""
    d = units.select(*keys, F.explode("options").alias("key", "value"))
    return d.withColumn("value_type", option_value_type(F.col("value")))


def read_resource_pool(spark: SparkSession, path: str | None, extra: str | None = None) -> DataFrame:
    """Lines of a pool file without blanks and comments, plus one direct entry; first occurrence decides the order."""
    parts = []
    if path:
        # byte order inside the file is the line order; ids grow along the splits
        parts.append(spark.read.text(path).select(F.trim("value").alias("resource"), F.monotonically_increasing_id().alias("pos")))
    if extra and extra.strip():
        parts.append(spark.createDataFrame([(extra.strip(), 2**62)], "resource string, pos long"))
    d = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return d.filter("resource <> '' and not resource like '#%'").groupBy("resource").agg(F.min("pos").alias("pos"))
