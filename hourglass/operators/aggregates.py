"""Aggregations.

Everything is a ``groupBy`` with partial (map-side) aggregation, so hot keys
are combined inside each task before the shuffle.  Global results (a class
table, a one-row summary) are small by construction: their size is the number
of classes or one row, never the number of input rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# --------------------------------------------------------------------------- A1
def hourly_stats(events: DataFrame, keys: Sequence[str], value: str,
                 mean: str = "MEAN", count: str = "COUNT", std: str = "STDDEV") -> DataFrame:
    """Mean / count / sample std per key group (A1); std of one value is NULL."""
    return events.groupBy(*keys).agg(
        F.avg(value).alias(mean),
        F.count(value).alias(count),
        F.stddev_samp(value).alias(std),
    )


# --------------------------------------------------------------------------- A2
def regroup_mean(df: DataFrame, keys: Sequence[str], value: str = "MEAN", out: str | None = None) -> DataFrame:
    """Mean of the per-group means after keys were renamed/normalized (A2)."""
    return df.groupBy(*keys).agg(F.avg(value).alias(out or value))


# --------------------------------------------------------------------------- A3
def pivot_fixed(df: DataFrame, keys: Sequence[str], name: str, value: str,
                names: Sequence[str], agg: str = "avg") -> DataFrame:
    """Long -> wide with a fixed name list (A3).

    One conditional aggregate per listed name, ``agg(value if name == n)``, in
    a single ``groupBy``: one partially aggregated shuffle, no job to discover
    the distinct names, and a column for every listed name whether or not it
    occurs (P15).
    """
    fn = getattr(F, agg)
    n = F.col(name)
    return df.groupBy(*keys).agg(*[fn(F.when(n == F.lit(v), F.col(value))).alias(v) for v in names])


# --------------------------------------------------------------------------- A4
def collect_codes(df: DataFrame, key: str, code: str, out: str = "CODES") -> DataFrame:
    """Sorted distinct non-null code list per key (A4)."""
    return (df.filter(F.col(code).isNotNull())
            .groupBy(key).agg(F.sort_array(F.collect_set(F.col(code).cast("string"))).alias(out)))


# --------------------------------------------------------------------------- A6
def distinct_by(df: DataFrame, keys: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Distinct rows, or one deterministic row per ``keys`` chosen by ``order``."""
    if not keys:
        return df.distinct()
    if not order:
        return df.select(*keys).distinct()
    from hourglass.operators.timeline import first_per_key
    return first_per_key(df, keys, order)


# --------------------------------------------------------------------------- A7
def build_vocab(df: DataFrame, codes_col: str, code: str = "code") -> DataFrame:
    """Code frequency vocabulary with a dense index.

    Order is count descending, then code ascending (trap T12 made
    deterministic).  The dense index is a distributed prefix count over the
    vocabulary (one row per distinct code) in that order, so a vocabulary of
    any size is never ranked inside a single task.
    """
    return build_vocab_long(df.select(F.explode(F.col(codes_col)).alias(code)), code)


def build_vocab_long(rows: DataFrame, code: str = "code") -> DataFrame:
    """:func:`build_vocab` of long rows, one per occurrence of a code."""
    from hourglass.operators.scan import prefix_sums

    counts = (rows.filter(F.col(code).isNotNull())
              .groupBy(code).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("__one", F.lit(1).cast("bigint")))
    ranked = prefix_sums(counts, [], [F.desc("n"), F.asc(code)], ["__one"], suffix="_rank", inclusive=False)
    return ranked.select(F.col("__one_rank").cast("bigint").alias("idx"), code, "n")


# --------------------------------------------------------------------------- A8
def seq_extent(df: DataFrame, key: str, hour: str) -> DataFrame:
    """Max hour per entity (A8); ``count()`` of this table is the distinct entity count."""
    return df.groupBy(key).agg(F.max(hour).alias("max_hour"))


# --------------------------------------------------------------------------- A9
def fit_zscore(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per-column mean and sample std in one global aggregate -> one row."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"{c}__mean"))
        aggs.append(F.stddev_samp(c).alias(f"{c}__std"))
    return df.agg(*aggs)


# --------------------------------------------------------------------------- A10
def candidate_summary(df: DataFrame, col: str) -> DataFrame:
    """Candidate-set size summary: n, mean, p50, p90, max (A10).

    Sizes count entries >= 0 (padding excluded).  Percentiles use linear
    interpolation, the NumPy default.
    """
    from hourglass.operators.quantiles import exact_quantiles

    size = F.size(F.filter(F.col(col), lambda x: x >= 0))
    s = df.select(size.alias("__size"))
    basic = s.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("__size").alias("cand_size_mean"),
        F.max("__size").cast("bigint").alias("cand_size_max"),
    )
    q = exact_quantiles(s, "__size", [0.5, 0.9], ["cand_size_p50", "cand_size_p90"])
    return basic.crossJoin(q).select("samples", "cand_size_mean", "cand_size_p50", "cand_size_p90",
                                     "cand_size_max")


# --------------------------------------------------------------------------- A11 / O3
def class_inclusion(df: DataFrame, col: str, n_classes: int | DataFrame,
                    spark: SparkSession | None = None) -> DataFrame:
    """Rows that include each class (distinct within a row) and inclusion ratio.

    One row per class in ``0 .. n_classes-1`` (or per ``class_idx`` of a class
    table, e.g. the vocabulary's ``idx``); absent classes count 0.
    """
    spark = spark or df.sparkSession
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    inc = (df.select(F.explode(F.array_distinct(F.filter(F.col(col), lambda x: x >= 0))).alias("class_idx"))
           .groupBy("class_idx").agg(F.count(F.lit(1)).alias("n_rows")))
    if isinstance(n_classes, DataFrame):
        classes = n_classes.select(F.col(n_classes.columns[0]).cast("bigint").alias("class_idx"))
    else:
        classes = spark.range(n_classes).select(F.col("id").alias("class_idx"))
    return (classes.join(inc, ["class_idx"], "left")
            .crossJoin(F.broadcast(total))
            .select("class_idx", F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
                    (F.coalesce("n_rows", F.lit(0)) / F.col("__total")).alias("ratio")))


def top_classes(inclusion: DataFrame, k: int = 5) -> DataFrame:
    """Top-k classes by inclusion count, ties to the lower index (O3)."""
    return inclusion.orderBy(F.desc("n_rows"), F.asc("class_idx")).limit(k)


# --------------------------------------------------------------------------- A15
def class_counts(df: DataFrame, y: str, classes: Sequence[int] | DataFrame,
                 spark: SparkSession | None = None) -> DataFrame:
    """Count per class over a fixed class list; absent classes count 0."""
    spark = spark or df.sparkSession
    if not isinstance(classes, DataFrame):
        classes = spark.createDataFrame([(int(c),) for c in classes], "class_idx bigint")
    counts = df.groupBy(F.col(y).cast("bigint").alias("class_idx")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(counts, ["class_idx"], "left").select(
        "class_idx", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


# --------------------------------------------------------------------------- A12
def power_class_weights(counts: DataFrame, power: float = 1.0, clip: float = 10.0,
                        n: str = "n") -> DataFrame:
    """1 / max(count,1)^power, normalized to mean 1, clipped to [0, clip].

    ``counts`` has one row per class; the mean is a one-row aggregate.
    """
    w = counts.withColumn("__raw", F.lit(1.0) / F.pow(
        F.when(F.col(n) <= 0, F.lit(1.0)).otherwise(F.col(n).cast("double")), F.lit(float(power))))
    mean = w.agg(F.avg("__raw").alias("__mean"))
    out = F.col("__raw") / F.col("__mean")
    if clip and clip > 0:
        out = F.least(F.greatest(out, F.lit(0.0)), F.lit(float(clip)))
    return w.crossJoin(F.broadcast(mean)).select(*counts.columns, out.alias("weight"))


# --------------------------------------------------------------------------- A13
def balanced_class_weights(df: DataFrame, y: str, classes: Sequence[int], cap: float = 50.0,
                           ignore: int = -100) -> DataFrame:
    """n / (k * n_c) over present classes; absent classes weigh 1; clamp at ``cap``."""
    valid = df.filter(F.col(y).isNotNull() & (F.col(y) != F.lit(ignore)))
    counts = valid.groupBy(F.col(y).cast("bigint").alias("class_idx")).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("__n"), F.count(F.lit(1)).alias("__k"))
    spark = df.sparkSession
    cls = spark.createDataFrame([(int(c),) for c in classes], "class_idx bigint")
    w = F.col("__n") / (F.col("__k") * F.col("n_c"))
    return (cls.join(counts, ["class_idx"], "left").crossJoin(F.broadcast(tot))
            .select("class_idx", F.least(F.coalesce(w, F.lit(1.0)), F.lit(float(cap))).alias("weight")))


# --------------------------------------------------------------------------- A14
def effective_number_weights(counts: DataFrame, beta: float = 0.999, n: str = "n") -> DataFrame:
    """(1 - beta) / (1 - beta^n + 1e-6) with zero counts as 1, normalized to sum k."""
    cnt = F.when(F.col(n) == 0, F.lit(1)).otherwise(F.col(n)).cast("double")
    w = counts.withColumn("__raw", F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), cnt) + F.lit(1e-6)))
    tot = w.agg(F.sum("__raw").alias("__sum"), F.count(F.lit(1)).alias("__k"))
    return w.crossJoin(F.broadcast(tot)).select(
        *counts.columns, (F.col("__raw") / F.col("__sum") * F.col("__k")).alias("weight"))


# --------------------------------------------------------------------------- A16
def vocab_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Category cardinality per column as max + 1, in one aggregate."""
    row = df.agg(*[(F.max(c) + 1).cast("bigint").alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, cardinality)")

