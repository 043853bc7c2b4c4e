"""Best captured trace per endpoint.

Traces of a run are reduced to distinct scoring profiles before they meet its endpoints: traces that share URL shape and
transport evidence score the same, and the earliest of them wins. So a run that owns a third of all traces is compared
by its distinct profiles, and the endpoint side is a short ranked list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotelens.functions import vocab
from quotelens.functions.text import MARK, contains_any, has_word, joined_words
from quotelens.functions.urls import normalized_endpoint, normalized_path, path_tokens
from quotelens.operators.skew import best_row, salted_join

SEMANTIC_PQ = sorted({*vocab.SEMANTIC["pricing"], *vocab.SEMANTIC["quantity"]})
SEMANTIC_C = vocab.SEMANTIC["config"]


def mentions_any(tokens: list[str]) -> Column:
    """Any token in the texts of a trace."""
    text = F.lower(F.concat_ws(MARK, "url", "post_data", "response_body_preview", "response_content_type", "request_content_type"))
    return contains_any(text, tokens)


def trace_profiles(traces: DataFrame) -> DataFrame:
    """Distinct (run, URL shape, transport evidence) with the earliest trace of each."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    words = joined_words(path_tokens(F.col("url")))
    d = traces.filter(F.trim(F.coalesce("url", F.lit(""))) != "").select(
        "run_id", "trace_idx", normalized_endpoint(F.col("url")).alias("t_endpoint"), normalized_path(F.col("url")).alias("t_path"),
        F.upper(F.coalesce("method", F.lit("GET"))).alias("t_method"), low("resource_type").isin("xhr", "fetch").alias("t_xhr"),
        F.coalesce("status", F.lit(0)).alias("t_status"), F.contains(low("response_content_type"), F.lit("json")).alias("t_rjson"),
        F.contains(low("request_content_type"), F.lit("json")).alias("t_qjson"), (F.coalesce("post_data", F.lit("")) != "").alias("t_body"),
        (F.trim(F.coalesce("response_body_preview", F.lit(""))) != "").alias("t_preview"), (mentions_any(SEMANTIC_PQ) | has_word(words, SEMANTIC_PQ)).alias("t_pq"), (mentions_any(SEMANTIC_C) | has_word(words, SEMANTIC_C)).alias("t_c"),
    )
    keys = [c for c in d.columns if c != "trace_idx"]
    return d.groupBy(*keys).agg(F.min("trace_idx").alias("trace_idx"))


def match_traces(endpoints: DataFrame, traces: DataFrame) -> DataFrame:
    """Best trace per (run, endpoint) with strategy and confidence.

    Order of the winner: confidence, semantic bonus, body, POST, xhr, low status, early capture.
    """
    e = endpoints.select("run_id", "endpoint").distinct().filter(F.trim(F.coalesce("endpoint", F.lit(""))) != "").select(
        "run_id", "endpoint", normalized_endpoint(F.col("endpoint")).alias("e_endpoint"), normalized_path(F.col("endpoint")).alias("e_path"), path_tokens(F.col("endpoint")).alias("e_tokens")
    )
    e_words = joined_words(F.col("e_tokens"))
    e = e.withColumn("e_pq", has_word(e_words, SEMANTIC_PQ)).withColumn("e_c", has_word(e_words, SEMANTIC_C)).withColumn("e_last", F.substring_index("e_path", "/", -1))
    p = trace_profiles(traces).withColumn("t_last", F.substring_index("t_path", "/", -1))
    d = salted_join(p, e, ["run_id"], F.hash("t_path", "t_status"), salts=4)
    t_tokens = F.filter(F.split("t_path", "/"), lambda s: s != "")
    eb, tb = F.col("e_last"), F.col("t_last")
    both = (F.col("e_path") != "") & (F.col("t_path") != "")
    prefix = both & (F.col("t_path").startswith(F.col("e_path")) | F.col("e_path").startswith(F.col("t_path")))
    inside = (eb != "") & (tb != "") & (F.contains(eb, tb) | F.contains(tb, eb))
    shared = F.size(F.array_intersect("e_tokens", t_tokens))
    union = F.greatest(F.size(F.array_union("e_tokens", t_tokens)), F.lit(1))
    strategy = (
        F.when((F.col("e_endpoint") != "") & (F.col("e_endpoint") == F.col("t_endpoint")), "normalized_exact")
        .when((F.col("e_path") != "") & (F.col("e_path") == F.col("t_path")), "normalized_path_exact").when(prefix, "path_prefix")
        .when(inside, "path_containment").when(shared > 0, "semantic_overlap")
    )
    d = d.withColumn("match_strategy", strategy).filter("match_strategy is not null")
    base = (
        F.when(F.col("match_strategy") == "normalized_exact", 1.0).when(F.col("match_strategy") == "normalized_path_exact", 0.95)
        .when(F.col("match_strategy") == "path_prefix", 0.84).when(F.col("match_strategy") == "path_containment", 0.78)
        .otherwise(F.least(F.lit(0.72), 0.42 + shared / union))
    )
    one = F.lit(1.0)
    steps = [
        lambda c: F.when(F.col("t_method") == "POST", F.least(one, c + 0.08)).when(F.col("t_method") == "GET", F.least(one, c + 0.02)).otherwise(c),
        lambda c: F.when(F.col("t_xhr"), F.least(one, c + 0.07)).otherwise(c),
        lambda c: F.when(F.col("t_status").between(200, 299), F.least(one, c + 0.05)).when(F.col("t_status") >= 400, F.greatest(F.lit(0.0), c - 0.12)).otherwise(c),
        lambda c: F.when(F.col("t_rjson"), F.least(one, c + 0.06)).otherwise(c), lambda c: F.when(F.col("t_qjson"), F.least(one, c + 0.03)).otherwise(c),
        lambda c: F.when(F.col("t_body"), F.least(one, c + 0.05)).otherwise(c), lambda c: F.when(F.col("t_preview"), F.least(one, c + 0.02)).otherwise(c),
    ]
    d = d.withColumn("_c", base)
    for step in steps:
        d = d.withColumn("_c", step(F.col("_c")))
    flag = lambda name, points: F.when(F.col(name), points).otherwise(0)
    bonus = (
        F.when(F.col("t_pq") | F.col("e_pq"), 2).otherwise(0) + F.when(F.col("t_c") | F.col("e_c"), 1).otherwise(0)
        + F.when(F.col("t_method") == "POST", 3).otherwise(0) + flag("t_xhr", 2) + flag("t_rjson", 2) + flag("t_qjson", 1)
        + F.when(F.col("t_status").between(200, 299), 1).otherwise(0) + flag("t_body", 2)
    )
    d = d.withColumn("match_confidence", F.round("_c", 6)).withColumn("semantic_bonus", bonus).filter("match_confidence > 0")
    order = [F.col("match_confidence"), F.col("semantic_bonus"), F.col("t_body").cast("int"), (F.col("t_method") == "POST").cast("int"), F.col("t_xhr").cast("int"), -F.col("t_status"), -F.col("trace_idx")]
    return best_row(d, ["run_id", "endpoint"], order, ["trace_idx", "match_strategy", "match_confidence", "semantic_bonus"])


def match_diagnostics(endpoints: DataFrame, traces: DataFrame) -> DataFrame:
    """Match result per endpoint, with the reason where there is none."""
    n = traces.filter(F.trim(F.coalesce("url", F.lit(""))) != "").groupBy("run_id").agg(F.count(F.lit(1)).alias("candidate_trace_count"))
    d = endpoints.join(match_traces(endpoints, traces), ["run_id", "endpoint"], "left").join(n, "run_id", "left").fillna(0, ["candidate_trace_count"])
    missing = F.trim(F.coalesce("endpoint", F.lit(""))) == ""
    return d.withColumn("mismatch_reason", F.when(missing, "missing_endpoint").when(F.col("trace_idx").isNull(), "no_semantic_overlap"))
