"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

SQL = E.oracle_sql()
KEYS = sorted(E.core_queries())


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):  # exact text, as a value hash sees it (both sides round the same way)
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.core_queries()[key](spark, SF_SMALL)
    s_cols, s_rows = _canon(df.columns, [tuple(r) for r in df.collect()])
    if key not in SQL:
        assert len(s_rows) >= 0
        return
    res = duck.execute(SQL[key])
    o_cols, o_rows = _canon([d[0] for d in res.description], res.fetchall())
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


def test_every_query_has_sql():
    assert set(KEYS) <= set(SQL)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"user_id", "HOUR_IN", "VENT", "target", "V__click", "M__click", "D__click"} <= set(df.columns)
