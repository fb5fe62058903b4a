from __future__ import annotations

from pointlake.llm import catalog


def test_sql_is_text_and_belongs_to_queries():
    assert all(isinstance(v, str) for v in catalog.oracle_sql().values()) and set(catalog.oracle_sql()) <= set(catalog.queries())
    assert all(name[0] == "p" and name[1].isdigit() for name in catalog.queries())
