"""Evidence tables derived from the driver tables.

Each view is one SELECT in the part of SQL that Spark and other engines share, so a query and its check start from
the same rows. ``EPOCH_US(x)`` stands for microseconds since 1970 and is the only engine-specific word.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

CENTS = "CAST(round({x} * 100) AS BIGINT)"


def money(cents: str, mark: str = ".") -> str:
    return (
        f"(CAST(CAST(floor(({cents}) / 100) AS BIGINT) AS STRING) || '{mark}' || "
        f"lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"
    )


def grouped_money(cents: str) -> str:
    """1.234,56 text."""
    whole = f"CAST(floor(({cents}) / 100) AS BIGINT)"
    return (
        f"(CASE WHEN {whole} >= 1000 THEN CAST(CAST(floor({whole} / 1000) AS BIGINT) AS STRING) || '.' || "
        f"lpad(CAST({whole} % 1000 AS STRING), 3, '0') ELSE CAST({whole} AS STRING) END || ',' || "
        f"lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"
    )


_OC = CENTS.format(x="o_totalprice")

VIEWS: dict[str, str] = {
    # request attempts: one host and one stage per event
    "attempts": """
        SELECT event_id AS attempt_id, EPOCH_US(ts) AS ts_us,
               'host' || CAST(user_id % 10 AS STRING) AS host,
               'proxy' || CAST(user_id % 6 AS STRING) AS resource,
               CASE event_id % 5 WHEN 0 THEN 'single_config' WHEN 1 THEN 'probe' WHEN 2 THEN 'pilot'
                    WHEN 3 THEN 'staging' ELSE 'production' END AS stage,
               'unit' || CAST(user_id AS STRING) AS unit_id,
               CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 ELSE 200 END AS status,
               CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'skipped'
                    ELSE 'completed' END AS unit_status,
               CASE WHEN event_type = 'error' THEN 'request_error' WHEN event_type = 'view' THEN ''
                    ELSE 'success' END AS reason,
               CASE WHEN event_type = 'purchase' THEN 'text/html' ELSE 'application/json' END AS content_type,
               value
        FROM events""",
    # units of a manifest with their requested options
    "units": f"""
        SELECT o_orderkey AS unit_no,
               'https://www.shop' || CAST(o_custkey % 7 AS STRING) || '.example.com/p/item-' ||
                   CAST(o_orderkey AS STRING) || '/' AS url,
               'shop' || CAST(o_custkey % 7 AS STRING) || '.example.com' AS site_name,
               CASE o_orderkey % 3 WHEN 0 THEN 'brochure' WHEN 1 THEN 'flyer' ELSE 'unknown' END AS product_type,
               'EUR' AS expected_currency,
               {_OC} AS expected_cents,
               CAST(25 * (1 + o_orderkey % 12) AS STRING) AS quantity,
               CASE o_custkey % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'A5' ELSE 'DL' END AS format,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'pending' END AS state,
               o_custkey AS run_id, EPOCH_US(o_orderdate) AS updated_us, o_orderpriority AS priority
        FROM orders""",
    # captured traces: a run is a customer, its orders are the traces
    "traces": f"""
        SELECT o_custkey AS run_id, o_orderkey AS trace_idx,
               CASE o_orderkey % 10
                    WHEN 0 THEN 'https://api.shop' || CAST(o_custkey % 7 AS STRING) || '.example.com/api/v1/price-matrix/' || CAST(o_orderkey % 30 AS STRING)
                    WHEN 1 THEN 'https://www.shop.example.com/API/Product//get-product-prices?id=' || CAST(o_orderkey % 50 AS STRING)
                    WHEN 2 THEN 'https://www.shop.example.com/repo/options/values'
                    WHEN 3 THEN 'https://cdn.example.com/gtm/analytics.js'
                    WHEN 4 THEN 'https://www.shop.example.com/checkout/shipping/delivery-time'
                    WHEN 5 THEN 'https://www.shop.example.com/configurator/summary/selected-details'
                    WHEN 6 THEN 'https://www.shop.example.com/premium-filecheck-price'
                    WHEN 7 THEN 'https://www.shop.example.com/p/item-' || CAST(o_custkey AS STRING)
                    WHEN 8 THEN 'https://www.shop.example.com/i18n/translations/countries'
                    ELSE 'https://www.shop.example.com/graphql/productdetails' END AS url,
               CASE WHEN o_orderkey % 10 IN (0, 1, 5, 9) THEN 'POST' ELSE 'GET' END AS method,
               CASE WHEN o_orderkey % 10 = 7 THEN 'document' WHEN o_orderkey % 10 = 3 THEN 'script'
                    WHEN o_orderkey % 2 = 0 THEN 'xhr' ELSE 'fetch' END AS resource_type,
               CASE WHEN o_orderstatus = 'P' THEN 503 WHEN o_orderpriority = '1-URGENT' THEN 404 ELSE 200 END AS status,
               CASE WHEN o_orderkey % 10 IN (0, 1, 9) THEN 'application/json' ELSE '' END AS request_content_type,
               CASE WHEN o_orderkey % 10 IN (0, 1, 2, 4, 5, 9) THEN 'application/json; charset=utf-8'
                    WHEN o_orderkey % 10 = 3 THEN 'text/javascript' ELSE 'text/html' END AS response_content_type,
               CASE o_orderkey % 10
                    WHEN 0 THEN '{{"quantity":' || CAST(25 * (1 + o_orderkey % 12) AS STRING) || ',"pricescale":[1,2],"delivery":{{"country":"DE"}}}}'
                    WHEN 1 THEN '{{"properties":[{{"id":44,"value":' || CAST(25 * (1 + o_orderkey % 12) AS STRING) || '}},{{"id":17,"value":"A5"}}],"uid":"u1"}}'
                    WHEN 5 THEN 'sku=4&quantity=' || CAST(25 * (1 + o_orderkey % 12) AS STRING) || '&format=A5'
                    WHEN 9 THEN '{{"configuration":{{"name":"x","value":1}},"type":"q"}}'
                    ELSE '' END AS post_data,
               CASE o_orderkey % 10
                    WHEN 0 THEN '{{"price_matrix":[{{"quantity":25,"price":' || {money(_OC)} || '}},{{"quantity":50,"price":' || {money(f"2 * {_OC}")} || '}}],"currency":"EUR"}}'
                    WHEN 1 THEN '{{"final_prices":{{"total_gross_value":' || {money(_OC)} || ',"total_net_value":' || {money(f"CAST(floor({_OC} * 0.8) AS BIGINT)")} || ',"total_gross":"' || {grouped_money(_OC)} || ' EUR"}},"shipping":{{"price":"4,90"}}}}'
                    WHEN 2 THEN '{{"properties":[{{"propertyid":1,"value":"rot"}},{{"propertyid":2,"value":"A5"}}]}}'
                    WHEN 4 THEN '{{"delivery":{{"days":3,"amount":' || {money(f"{_OC} % 2000 + 1")} || '}}}}'
                    WHEN 5 THEN '{{"configuration":[{{"name":"quantity","value":"' || CAST(25 * (1 + o_orderkey % 12) AS STRING) || ' Stueck"}},{{"name":"format","value":"148 x 210 mm DIN A5"}}],"amount":' || {money(_OC)} || '}}'
                    WHEN 6 THEN '"' || {money(f"{_OC} % 5000 + 100", ",")} || ' EUR"'
                    WHEN 7 THEN '<div class="price">Gesamtpreis: ' || {grouped_money(_OC)} || ' EUR inkl. MwSt</div>'
                    WHEN 9 THEN '{{"product":{{"details":{{"price":' || {money(_OC)} || ',"unit":' || {money(f"{_OC} % 900 + 10")} || '}},"label":"brutto ' || {money(_OC, ",")} || ' EUR"}}}}'
                    ELSE '' END AS response_body_preview
        FROM orders""",
    # summary text lines with money in German and English form
    "price_lines": f"""
        SELECT l_orderkey AS run_id, l_linenumber AS line_no, l_partkey AS part_no, l_suppkey AS supp_no,
               CASE l_returnflag
                    WHEN 'A' THEN 'Gesamtpreis brutto ' || {grouped_money(CENTS.format(x="l_extendedprice"))} || ' EUR inkl. ' ||
                         CAST(CAST(round(l_tax * 100) AS BIGINT) AS STRING) || '% MwSt'
                    WHEN 'N' THEN 'total net ' || {money(CENTS.format(x="l_extendedprice"))} || ' (unit ' ||
                         {money(f"CAST(floor({CENTS.format(x='l_extendedprice')} / 10) AS BIGINT)", ",")} || ')'
                    ELSE 'Versand ' || {money(CENTS.format(x="l_quantity"), ",")} || ' €, Menge ' ||
                         CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS line,
               {CENTS.format(x="l_extendedprice")} AS cents, l_returnflag AS flag, EPOCH_US(l_shipdate) AS ship_us
        FROM lineitem""",
    # option catalog: a part is an option, its brand the group
    "catalog_options": """
        SELECT p_brand AS snapshot_id, p_type AS group_label, p_partkey AS option_no, p_name AS visible_label,
               CAST(p_size AS STRING) AS visible_value, p_partkey % 4 = 0 AS selected,
               CASE p_partkey % 3 WHEN 0 THEN 'radio' WHEN 1 THEN 'select' ELSE 'checkbox' END AS control_type,
               p_size AS size_no, p_retailprice AS price
        FROM part""",
    # requested options: several values per snapshot
    "requests": """
        SELECT o_orderkey AS unit_no, 'Brand#' || CAST(1 + o_custkey % 25 AS STRING) AS snapshot_id,
               'shop' || CAST(o_custkey % 7 AS STRING) AS site,
               CASE o_orderkey % 4 WHEN 0 THEN 'size' WHEN 1 THEN 'material' WHEN 2 THEN 'umschlag' ELSE 'promo pages' END AS key,
               CASE o_orderkey % 9 WHEN 0 THEN 'Small Ring' WHEN 1 THEN 'red-widget' WHEN 2 THEN 'blue' WHEN 3 THEN 'OLD  gear'
                    WHEN 4 THEN 'anvil' WHEN 5 THEN CAST(1 + o_orderkey % 50 AS STRING) WHEN 6 THEN 'gear hot'
                    WHEN 7 THEN 'rod' ELSE 'unobtainium' END AS value
        FROM orders""",
    # option markup, plain and inside JSON text
    "option_html": """
        SELECT p_partkey AS part_no, p_brand AS snapshot_id,
               CASE WHEN p_partkey % 2 = 0
                 THEN '<form><input type="radio" class="x" data-varindex="V' || CAST(p_partkey AS STRING) || '" name="input_var_ZB_1_' || CAST(1 + p_partkey % 3 AS STRING) || '" value="' || p_name || '"' || CASE WHEN p_partkey % 5 = 0 THEN ' checked' ELSE '' END || '><input type="hidden" name="sid" value="s' || CAST(p_size AS STRING) || '"></form>'
                 ELSE chr(92) || 'u003cinput value=' || chr(92) || '"' || p_name || chr(92) || '" name=' || chr(92) || '"input_var_ZB_1_' || CAST(1 + p_partkey % 3 AS STRING) || chr(92) || '" data-varindex=' || chr(92) || '"V' || CAST(p_partkey AS STRING) || chr(92) || '"' || chr(92) || 'u003e' END AS html
        FROM part""",
    # sideloaded value map entries
    "value_map": """
        SELECT 'shop' || CAST(p_partkey % 6 AS STRING) AS site, 'p' || CAST(p_size % 3 AS STRING) AS property_id,
               CASE p_partkey % 3 WHEN 0 THEN 'material' WHEN 1 THEN 'format' ELSE 'binding' END AS canonical_key,
               p_type AS source_label, CAST(p_partkey AS STRING) AS backend_id,
               p_name || ' ' || lower(p_type) || ' ' || CAST(p_size AS STRING) AS label,
               CASE p_partkey % 5 WHEN 0 THEN 'ui_only' WHEN 1 THEN 'partial' ELSE 'confirmed' END AS confidence
        FROM part""",
    # value-map requests
    "map_requests": """
        SELECT o_orderkey AS unit_no, 'shop' || CAST(o_custkey % 7 AS STRING) AS site,
               CASE o_orderkey % 4 WHEN 0 THEN 'material' WHEN 1 THEN 'format' WHEN 2 THEN 'binding' ELSE 'finishing' END AS canonical_key,
               CASE o_orderkey % 5 WHEN 0 THEN 'Small  Ring' WHEN 1 THEN 'red widget promo ' || CAST(o_orderkey % 50 AS STRING) WHEN 2 THEN 'gear'
                    WHEN 3 THEN 'blue anvil large ' || CAST(1 + o_orderkey % 50 AS STRING) ELSE 'none such' END AS value
        FROM orders""",
    # responses with option lists: whole, without their last bracket, and cut inside the second list
    "option_bodies": """
        SELECT p_partkey AS part_no, p_size AS size_no, p_name AS paper, CASE p_partkey % 3
            WHEN 0 THEN '{"propertyOptions":[{"id":7,"isRange":false,"propertyValueOptions":[{"id":' || CAST(p_size AS STRING) || '},{"id":' || CAST(p_size + 1 AS STRING) || '}]},{"id":44,"isRange":true,"propertyValueOptions":[{"id":' || CAST(50 * p_size AS STRING) || '},{"id":' || CAST(25 * p_size AS STRING) || '},{"id":' || CAST(50 * p_size AS STRING) || '}]}],"propsTranslated":{"Format":" A' || CAST(p_size % 8 AS STRING) || '","Papier":"' || p_name || '","Leer":""}}'
            WHEN 1 THEN '{"propertyOptions":[{"id":7,"isRange":false,"propertyValueOptions":[{"id":' || CAST(p_size AS STRING) || '},{"id":' || CAST(p_size + 1 AS STRING) || '}]},{"id":44,"isRange":true,"propertyValueOptions":[{"id":' || CAST(50 * p_size AS STRING) || '},{"id":' || CAST(25 * p_size AS STRING) || '},{"id":' || CAST(50 * p_size AS STRING) || '}]}],"propsTranslated":{"Format":" A' || CAST(p_size % 8 AS STRING) || '","Papier":"' || p_name || '","Leer":""}'
            ELSE '{"propertyOptions":[{"id":7,"isRange":false,"propertyValueOptions":[{"id":' || CAST(p_size AS STRING) || '},{"id":' || CAST(p_size + 1 AS STRING) || '}]},{"id":44,"isRange":true,"propertyValueOptions":[{"id":' || CAST(50 * p_size AS STRING) || '},{"i' END AS body
        FROM part""",
    # captured configurator posts with the encoded dependency link
    "form_posts": """
        SELECT o_orderkey AS post_no, 'Brand#' || CAST(1 + o_custkey % 25 AS STRING) AS snapshot_id,
               'sku=4&input_var_ZB_1_1=' || CAST(25 * (1 + o_orderkey % 12) AS STRING) || '&input_var_ZB_1_2=red+widget&input_var_ZB_1_3=&note=a%20b&SetLink=https%253A%252F%252Fs.example.com%252Fc%253Fdepvar_index_setparent%253D%253CAG'
                 || CAST(o_orderkey % 9 AS STRING) || '%253E%253CA' || CAST(o_orderkey % 90 AS STRING) || '%253E%2526depvar_index_set_1%253D%253CAG7%253E%253CA8%253E%2526x%253D1' AS post_data
        FROM orders""",
}


def spark_sql_text(sql: str) -> str:
    return re.sub(r"EPOCH_US\((\w+)\)", r"unix_micros(CAST(\1 AS TIMESTAMP))", sql)


def duck_sql_text(sql: str) -> str:
    return re.sub(r"EPOCH_US\((\w+)\)", r"epoch_us(\1)", sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view as a DataFrame: every view is ``SELECT expressions FROM one table``."""
    select, source = re.fullmatch(r"\s*SELECT\s+(.*)\s+FROM\s+(\w+)\s*", spark_sql_text(VIEWS[name]), re.S).groups()
    return spread(table(spark, sf_dir, source)).selectExpr(*_split_columns(select))


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that arrives in fewer partitions than there are cores; large tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 64) else df


def _split_columns(select: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(select):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "," and not quoted and depth == 0:
            out.append(select[start:i].strip())
            start = i + 1
    return [*out, select[start:].strip()]


def with_views(names: list[str], body: str) -> str:
    """Check SQL: the body over the derived views."""
    ctes = ", ".join(f"{n} AS ({duck_sql_text(VIEWS[n])})" for n in names)
    return f"WITH {ctes} {body}" if not body.lstrip().upper().startswith("WITH ") else (
        f"WITH {ctes}, " + body.lstrip()[5:]
    )
