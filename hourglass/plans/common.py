"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


ROUND_LIMIT = 1e12  # beyond this magnitude values are returned unrounded (no BIGINT overflow)


def portable_round(c: Column, digits: int = DIGITS) -> Column:
    """floor(x * 10^d + 0.5) / 10^d -- plain IEEE steps any SQL engine repeats bit for bit.

    ``round`` differs between engines on decimal ties (HALF_UP on the shortest
    decimal text vs rounding the binary product) and on the sign of zero;
    this form does not.  NaN, infinities and |x| >= 1e12 pass through.
    """
    scale = float(10 ** digits)
    return F.when(F.abs(c) < F.lit(ROUND_LIMIT), F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(c)


def _round_expr(c: Column, dt: T.DataType, digits: int) -> Column | None:
    if isinstance(dt, T.DoubleType):
        return portable_round(c, digits)
    if isinstance(dt, T.ArrayType):
        inner = dt.elementType
        if isinstance(inner, (T.DoubleType, T.ArrayType)):
            return F.transform(c, lambda x: _round_expr(x, inner, digits))
    return None


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round DOUBLE columns (and arrays of them) to ``digits`` places so results compare across engines.

    Floating sums depend on evaluation order; rounding the published value is
    the comparison contract with the SQL oracle, not part of the operators.
    """
    cols = []
    for f in df.schema.fields:
        r = _round_expr(F.col(f"`{f.name}`"), f.dataType, digits)
        cols.append(r.alias(f.name) if r is not None else F.col(f"`{f.name}`"))
    return df.select(*cols)
