from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import CASES  # noqa: E402


def key(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(CASES))
def test_case_gives_its_rows(spark, name):
    f, sql = CASES[name]
    df = f(spark, "")
    columns = sorted(df.columns)
    wanted = duckdb.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql})")
    assert key(df.select(*columns).collect()) == key(wanted.fetchall())


def test_cases_are_no_registered_queries():
    """What reads no table is a test and not a query; a query of the same name runs over the tables."""
    from graphwright.queries import QUERIES

    assert all(QUERIES.get(name) is not f for name, (f, _) in CASES.items())
