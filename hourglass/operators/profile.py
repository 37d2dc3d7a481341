"""Table profiling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _stack(row: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Unpivot a one-row aggregate ``{name}__{field}`` into one row per column."""
    parts = []
    for n in names:
        parts.append(f"'{n}'")
        parts.extend(f"`{n}__{f}`" for f in fields)
    cols = ", ".join(["column_name", *fields])
    return row.selectExpr(f"stack({len(names)}, {', '.join(parts)}) as ({cols})")


def profile(df: DataFrame, approx: bool = False, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, row count, null count, distinct count.

    Exact counts group (column, value) once; ``approx=True`` is one aggregate with HyperLogLog++ instead.
    """
    cols = list(cols or df.columns)
    dtypes = dict(df.dtypes)
    if approx:
        aggs = []
        for c in cols:
            aggs.append(F.count(F.lit(1)).alias(f"{c}__rows"))
            aggs.append(F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__nulls"))
            aggs.append(F.approx_count_distinct(f"`{c}`").cast("long").alias(f"{c}__distinct"))
        out = _stack(df.agg(*aggs), cols, ["rows", "nulls", "distinct"])
    else:
        out = _exact_counts(df, cols, dtypes)
    dt = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(dtypes[c]))])
    return out.select("column_name", F.element_at(dt, F.col("column_name")).alias("dtype"),
                      "rows", "nulls", "distinct")


def _exact_counts(df: DataFrame, cols: Sequence[str], dtypes: dict[str, str]) -> DataFrame:
    """(column_name, rows, nulls, distinct) from one count per (column, value).

    A value stands in the slot of its type, so columns of all types share one unpivot and one
    grouping; equal values meet map-side before the shuffle.  The second level counts the groups of
    a column, again map-side first: no task holds the values of a column.
    """
    kinds = list(dict.fromkeys(dtypes[c] for c in cols))
    slots = [f"v{i}" for i in range(len(kinds))]

    def cell(c: str) -> Column:
        return F.struct(F.lit(c).alias("column_name"), *[
            (F.col(f"`{c}`") if dtypes[c] == kind else F.lit(None).cast(kind)).alias(slot) for kind, slot in zip(kinds, slots)])

    cells = df.select(F.explode(F.array(*map(cell, cols))).alias("__c")).select("__c.*")
    values = cells.groupBy("column_name", *slots).agg(F.count(F.lit(1)).alias("n"))
    null = reduce(Column.__and__, [F.col(s).isNull() for s in slots])
    counts = values.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(~null).alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")  # an empty table has its rows, too
    zero = F.lit(0).cast("long")
    return names.join(counts, ["column_name"], "left").select(
        "column_name", *[F.coalesce(c, zero).alias(c) for c in ("rows", "nulls", "distinct")])


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation), max per numeric column.

    The columns are unpivoted into (column_name, x) once; moments are one
    grouped aggregate and the quartiles one distributed exact-quantile scan
    over all columns together, so no task holds a whole column.
    """
    from hourglass.operators.quantiles import exact_quantiles

    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    long = df.select(F.explode(pairs).alias("__p")).select("__p.column_name", "__p.x")
    moments = long.groupBy("column_name").agg(
        F.count("x").cast("double").alias("count"), F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["p25", "p50", "p75"], groups=["column_name"])
    return moments.join(q, ["column_name"], "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def array_stats(df: DataFrame, col: str) -> DataFrame:
    """Shape, min, max, mean, population std and NaN count of a numeric array column.

    Shape is (rows, max length); statistics run over all elements after an
    ``explode`` inside one aggregate (partial aggregation, no shuffle of the
    elements).  NaN elements are counted and excluded from the moments.
    """
    e = df.select(F.size(col).alias("__len"), F.explode_outer(col).alias("__x"))
    x = F.col("__x").cast("double")
    ok = F.when(~F.isnan(x), x)
    agg = e.agg(
        F.max("__len").alias("max_len"),
        F.min(ok).alias("min"), F.max(ok).alias("max"), F.avg(ok).alias("mean"),
        F.stddev_pop(ok).alias("std"), F.count(ok).alias("n_values"),
        F.sum(F.isnan(x).cast("long")).alias("n_nan"))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.crossJoin(agg)


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows by ``order`` (O2) -- planned as TakeOrderedAndProject."""
    return df.orderBy(*order).limit(n)
