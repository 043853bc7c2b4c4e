"""Writers: results, artifacts, state logs, matrix files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions.text import slug


def export_csv(flat: DataFrame, path: str) -> None:
    """Flat results with a header, one file per task."""
    flat.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def result_lines(units: DataFrame, mode: str = "full") -> DataFrame:
    """JSON lines of finished units.

    ``units``: unit_id, index, url, status, reason, site, validated, price, currency, replay_mode, fallback_mode,
    extraction_reason, mismatches, artifact_dir, and for the full form ``summary`` (a struct). Rows with a null
    ``validated`` carry no summary (skipped units).
    """
    base = ["unit_id", "index", "url", "status", "reason"]
    compact = ["site", "validated", "price", "currency", "replay_mode", "fallback_mode", "extraction_reason", "mismatches", "artifact_dir"]
    full = ["site", "validated", "price", "currency", "artifact_dir", "summary"]
    more = compact if mode == "compact" else full
    short, long = F.to_json(F.struct(*base)), F.to_json(F.struct(*base, *more), {"ignoreNullFields": "false"})
    # an absent reason is left out of the line; other nulls of a finished unit are written
    tidy = F.regexp_replace(long, r'"reason":null,', "")
    return units.select(F.when(F.col("validated").isNull(), short).otherwise(tidy).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_artifacts(rows: DataFrame, path: str, site: Column, unit: str) -> None:
    """One table per artifact, partitioned by site slug."""
    rows.withColumn("site_slug", slug(site)).withColumnRenamed(unit, "unit_id").write.mode("overwrite").partitionBy("site_slug").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only state / knowledge log; ``latest_rows`` and ``fold_runs`` give the current view."""
    rows.write.mode("append").parquet(path)


def write_matrix(rows: DataFrame, path: str, by: list[str]) -> None:
    """``;``-separated price files per variant."""
    rows.write.mode("overwrite").option("header", True).option("sep", ";").partitionBy(*by).csv(path)
