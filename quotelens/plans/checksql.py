"""Pieces of check SQL that several queries share."""

from __future__ import annotations

from quotelens.functions import vocab


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def list_of(words) -> str:
    return "[" + ", ".join(quoted(w) for w in words) + "]"


def any_of(col: str, tokens) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(t)})" for t in tokens) + ")"


def any_key(col: str, words) -> str:
    return f"list_has_any({col}, {list_of(words)})"


def json_keys(body: str) -> str:
    """Distinct lower-case keys by a walk of the JSON tree."""
    return (
        f"coalesce((SELECT list(DISTINCT lower(j.\"key\")) FROM json_tree(CASE WHEN json_valid({body}) THEN {body} ELSE '{{}}' END) j "
        r"WHERE j.key IS NOT NULL AND NOT regexp_matches(j.fullkey, '\[[0-9]+\]$')), [])"
    )


def url_token_list(url: str) -> str:
    low = f"lower({url})"
    hints = f"list_filter({list_of(vocab.URL_COMPOUND_HINTS)}, lambda h: contains({low}, h))"
    return f"list_distinct(list_concat(list_filter(regexp_split_to_array({low}, '[^a-z0-9]+'), lambda t: t <> ''), {hints}))"


def evidence_cte() -> str:
    return f"""ev AS (
  SELECT *, lower(url) AS u, lower(response_body_preview) AS prev, lower(response_content_type) AS rtype,
    {json_keys('post_data')} AS pk, {json_keys('response_body_preview')} AS rk, {url_token_list('url')} AS ut
  FROM traces),
e2 AS (SELECT *, contains(u, 'premium-filecheck-price') AND regexp_matches(prev, '^\\s*"?[0-9]+[.,][0-9][0-9]\\s*(€|eur)?\\s*"?\\s*$') AS bare FROM ev)"""


def role_cte() -> str:
    terms = {r: [] for r in vocab.ROLES}
    for role, pts, place, toks in vocab.ROLE_RULES:
        cond = {
            "url": any_of("u", toks), "payload": any_key("pk", toks),
            "response": f"len(pk) > 0 AND {any_key('rk', toks)}", "preview": f"len(pk) > 0 AND {any_of('prev', toks)}",
        }[place]
        terms[role].append(f"CASE WHEN {cond} THEN {pts} ELSE 0 END")
    for role in ("pricing", "schema"):
        terms[role].append("CASE WHEN method = 'POST' THEN 1 ELSE 0 END")
    terms["pricing"].append("CASE WHEN len(pk) > 0 AND bare THEN -5 ELSE 0 END")
    terms["noise"].append("CASE WHEN len(pk) > 0 AND bare THEN 3 ELSE 0 END")
    for role in vocab.ROLES:
        if role != "noise":
            terms[role].append("CASE WHEN contains(rtype, 'json') THEN 1 ELSE 0 END")
            terms[role].append("CASE WHEN status <> 0 AND NOT status BETWEEN 200 AND 299 THEN -1 ELSE 0 END")
    cols = ", ".join(f"{' + '.join(t)} AS s_{r}" for r, t in terms.items())
    best = "greatest(" + ", ".join(f"s_{r}" for r in vocab.ROLES) + ")"
    pick = "CASE " + " ".join(f"WHEN s_{r} = top THEN {quoted(r)}" for r in vocab.ROLES) + " END"
    weight = "CASE role " + " ".join(f"WHEN {quoted(r)} THEN {w}" for r, w in vocab.ROLE_WEIGHT.items()) + " END"

    def pts(cond, n):
        return f"CASE WHEN {cond} THEN {n} ELSE 0 END"

    score = " + ".join([
        weight, "CAST(floor(conf * 8) AS INTEGER)", pts("method = 'POST'", 4), pts("resource_type IN ('xhr','fetch')", 4),
        pts("contains(rtype,'json')", 3), "CASE WHEN status BETWEEN 200 AND 299 THEN 2 WHEN status >= 400 THEN -3 ELSE 0 END",
        pts(any_of("u", ["pricing", "price", "quote", "calculate", "config", "product-configuration"]), 6),
        pts(any_of("u", ["productdetails", "price-matrix", "pricescale", "/repo"]), 10),
        pts(any_of("u", ["premium-filecheck-price"]), -22), pts(any_of("u", ["file-check/select-boxes"]), -10),
        pts(any_of("u", vocab.SCORE_PENALTY_URL), -10), pts(any_of("u", ["api.", "/api/"]), 3),
        pts(any_of("prev", ['"price"', '"total"', '"amount"', '"gross"']), 3),
        pts(any_of("prev", ["final_prices", "total_gross", "total_gross_value"]), 14),
        pts(any_of("prev", ["price_matrix", "pricescale", "quantity_heading"]), 12), pts("bare", -10),
    ])
    return f"""rs AS (SELECT *, {cols} FROM e2), rt AS (SELECT *, {best} AS top FROM rs),
rr AS (SELECT *, CASE WHEN top > 0 THEN {pick} ELSE 'unknown' END AS role, CASE WHEN top > 0 THEN least(1.0, top / 8.0) ELSE 0.2 END AS conf FROM rt),
sc AS (SELECT *, {score} AS score FROM rr)"""


def family_cte() -> str:
    hits = {f: f"2 * len(list_intersect(tk, {list_of(t)}))" for f, t in vocab.FAMILY_TOKENS.items()}
    hits["pricing_pipeline"] += f" + CASE WHEN {any_of('prev', ['final_prices', 'total_gross', 'total_net'])} THEN 3 ELSE 0 END"
    hits["quantity_pipeline"] += f" + CASE WHEN {any_of('prev', ['price_matrix', 'pricescale', 'quantity'])} THEN 2 ELSE 0 END"
    cols = ", ".join(f"{h} AS f_{i}" for i, h in enumerate(hits.values()))
    best = "greatest(" + ", ".join(f"f_{i}" for i in range(len(hits))) + ")"
    pick = "CASE " + " ".join(f"WHEN f_{i} = fb THEN {quoted(f)}" for i, f in enumerate(hits)) + " END"
    sem = ", ".join(
        f"CASE WHEN len(list_intersect(tk, {list_of(w)})) > 0 THEN list_intersect(tk, {list_of(w)}) ELSE list_filter({list_of(w)}, lambda t: contains(prev, t)) END AS sem_{g}"
        for g, w in vocab.SEMANTIC.items()
    )
    return f"""tk AS (SELECT *, list_distinct(list_concat(ut, pk, rk)) AS tk, list_intersect(ut, {list_of(vocab.INFRASTRUCTURE)}) AS infra FROM sc),
fh AS (SELECT *, {cols}, {sem} FROM tk), fb AS (SELECT *, {best} AS fb FROM fh),
fam AS (SELECT *, CASE WHEN len(infra) > 0 AND fb < 4 THEN 'infrastructure' WHEN fb <= 0 THEN 'unknown' ELSE {pick} END AS request_family FROM fb)"""


def scored_cte() -> str:
    return ",\n".join([evidence_cte(), role_cte(), family_cte()])


RANKED_CTE = """bst AS (SELECT *, row_number() OVER (PARTITION BY run_id, url ORDER BY score DESC, trace_idx) AS un FROM fam),
rk0 AS (SELECT *, round(conf, 3) AS confidence, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, round(conf, 3) DESC, trace_idx) AS rank FROM bst WHERE un = 1),
ranked AS (SELECT * FROM rk0)"""
