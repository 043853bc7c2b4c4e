"""Registered check SQL."""

import __spark_entry__ as entry


def test_checks_are_sql_of_registered_queries():
    checks = entry.oracle_sql()
    assert [name for name, sql in checks.items() if not isinstance(sql, str)] == []
    assert set(checks) <= set(entry.queries())
