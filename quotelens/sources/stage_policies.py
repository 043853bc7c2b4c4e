"""Stage policies: the five built-in stages and JSON policy files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "stage_order int, name string, unit_budget int, repeat_same_unit boolean, requires_proxy boolean, workers int, "
    "max_inflight int, max_rps double, jitter_ms int, http_max_retries int, http_backoff_base_ms int, "
    "http_backoff_max_ms int, min_units int, min_success_rate double, max_block_rate double, "
    "max_server_error_rate double"
)

# Order, stage, budget, repeat, proxy, workers, inflight, rps, jitter, retries, backoff base / max,
# min units, success >=, block <=, server errors <=
DEFAULTS = [
    (0, "single_config", 3, True, False, 1, 2, 0.75, 150, 1, 500, 5000, 1, 1.0, 0.0, 0.20),
    (1, "probe", 20, False, False, 1, 2, 0.75, 150, 1, 500, 5000, 10, 0.95, 0.02, 0.10),
    (2, "pilot", 50, False, False, 2, 3, 1.0, 200, 1, 600, 6000, 10, 0.95, 0.02, 0.10),
    (3, "staging", 1000, False, False, 2, 4, 2.0, 250, 1, 700, 7000, 20, 0.93, 0.02, 0.10),
    (4, "production", 5000, False, True, 2, 5, 3.0, 300, 1, 800, 8000, 20, 0.93, 0.02, 0.10),
]


def default_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULTS, SCHEMA)


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """``{"stages": [...]}`` with missing or odd values replaced and every limit clamped to its range.

    Values are read as text first, so a wrong type falls back to the default instead of failing the file.
    """
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    item = raw.lateralJoin(spark.tvf.variant_explode(F.try_variant_get("v", "$.stages", "variant").outer())).select(
        F.col("pos").cast("int").alias("stage_order"), F.col("value").alias("s")
    )

    def text(path: str):
        return F.try_variant_get("s", path, "string")

    def whole(path: str, default: int, low: int):
        return F.greatest(F.coalesce(text(path).try_cast("double").cast("int"), F.lit(default)), F.lit(low))

    def real(path: str, default: float, low: float, high: float | None = None):
        value = F.greatest(F.coalesce(text(path).try_cast("double"), F.lit(default)), F.lit(low))
        return value if high is None else F.least(value, F.lit(high))

    def flag(path: str):
        return F.coalesce(text(path).try_cast("boolean"), F.lit(False))

    name = F.nullif(F.lower(F.trim(text("$.name"))), F.lit(""))
    return item.select(
        "stage_order",
        F.coalesce(name, F.raise_error(F.lit("stage policy item requires non-empty name")).cast("string")).alias("name"),
        whole("$.unit_budget", 1, 1).alias("unit_budget"),
        flag("$.repeat_same_unit").alias("repeat_same_unit"),
        flag("$.requires_proxy").alias("requires_proxy"),
        whole("$.envelope.workers", 1, 1).alias("workers"),
        whole("$.envelope.max_inflight", 2, 1).alias("max_inflight"),
        real("$.envelope.max_rps", 0.75, 0.1).alias("max_rps"),
        whole("$.envelope.jitter_ms", 150, 0).alias("jitter_ms"),
        whole("$.envelope.http_max_retries", 1, 0).alias("http_max_retries"),
        whole("$.envelope.http_backoff_base_ms", 500, 0).alias("http_backoff_base_ms"),
        whole("$.envelope.http_backoff_max_ms", 5000, 0).alias("http_backoff_max_ms"),
        whole("$.gate.min_units", 1, 1).alias("min_units"),
        real("$.gate.min_success_rate", 0.95, 0.0, 1.0).alias("min_success_rate"),
        real("$.gate.max_block_rate", 0.05, 0.0, 1.0).alias("max_block_rate"),
        real("$.gate.max_server_error_rate", 0.20, 0.0, 1.0).alias("max_server_error_rate"),
    )
