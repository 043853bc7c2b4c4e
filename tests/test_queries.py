"""Every check SQL against its query at the smallest scale, plus plan rules."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quotelens.plans import load_all  # noqa: E402
from quotelens.plans.evidence import TABLES  # noqa: E402
from tools.check import compare  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, CHECKS = load_all()
#: Covered by small fixtures in test_facts.py.
WITHOUT_SQL = {"enriched_catalog_fields", "dropdown_assignment", "form_rewrite_requests", "inferred_inject_rules"}


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert name in CHECKS or name in WITHOUT_SQL
    text, _, ok, df = compare(spark, con, SF, name, QUERIES[name], CHECKS.get(name))
    assert ok, text
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
