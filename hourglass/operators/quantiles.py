"""Exact quantiles by selection.

Sorting all values to read three of them is a shuffle of everything.  Here every wanted quantile has a
bracket of values that surely holds it; a pass over the data counts the values below and inside each
bracket and sketches the inside, and the bracket closes in on the sketch's estimate.  A pass is an
aggregate, combined map-side, whose state is a sketch per quantile.  When no bracket holds more
than LIMIT values, those are counted by value and the one at the wanted rank is read off.

The sketch only proposes.  A bracket is taken over only if the counts prove that it holds its ranks, so
the result is exact whatever the sketch's error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.session import cut_lineage

#: Values of a bracket that one task sorts.
LIMIT = 1_000_000
#: Steps of the sketch that are read, and its accuracy; a bracket shrinks to about 5 / STEPS of itself.
STEPS, ACCURACY = 1_000, 10_000


def _inside(t: Column, v: Column) -> tuple[Column, Column]:
    """Whether a value lies below a bracket and inside it; a bound that is null does not bound."""
    below = F.coalesce(v < t["a"], F.lit(False))
    return below, ~below & ~F.coalesce(v > t["b"], F.lit(False))


def _tested(values: DataFrame, groups: Sequence[str], targets: DataFrame) -> DataFrame:
    """Every value once for each quantile of its group."""
    per = targets.groupBy(*[F.col(g).alias(f"{g}_") for g in groups]).agg(F.collect_list(F.struct("i", "a", "b")).alias("__t"))
    if groups:  # a row per group: groups are few
        cond = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"{g}_")) for g in groups])
        joined = values.join(F.broadcast(per), cond)
    else:
        joined = values.crossJoin(F.broadcast(per))
    return joined.select(*groups, "v", F.explode("__t").alias("t"))


def _measured(values: DataFrame, groups: Sequence[str], targets: DataFrame) -> DataFrame:
    """(groups, i, below, inside, sketch) of every bracket, in one pass."""
    tested = _tested(values, groups, targets)
    below, inside = _inside(F.col("t"), F.col("v"))
    grid = [k / STEPS for k in range(STEPS + 1)]
    return tested.groupBy(*groups, F.col("t.i").alias("i")).agg(
        F.count_if(below).alias("below"), F.count_if(inside).alias("inside"),
        F.percentile_approx(F.when(inside, F.col("v")), grid, ACCURACY).alias("sketch"))


def _closed_in(state: DataFrame, limit: int) -> DataFrame:
    """Brackets of a few steps around the wanted rank's place in the sketch, where a bracket is to shrink."""
    step = F.floor((F.col("lo") - F.col("below")) / F.col("inside") * STEPS).cast("int")
    low, high = F.get("sketch", step - 2), F.get("sketch", step + 3)  # null beyond either end
    wide = (F.col("inside") > limit) & ~F.col("fixed")
    return state.withColumns({"a": F.when(wide, F.coalesce(low, F.col("a"))).otherwise(F.col("a")),
                              "b": F.when(wide, F.coalesce(high, F.col("b"))).otherwise(F.col("b"))})


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], names: Sequence[str] | None = None,
                    groups: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy's default), without sorting or range-shuffling the values.

    One row per group (one row without groups, of nulls for no values), one column per probability.  Nulls do
    not count; NaN is the largest value.  The column is written once, narrow, and read again per pass:
    a pass for up to ``limit`` values, and one more for about every 200-fold of that.  Groups should be few (one per
    column being described, say): a row per group is broadcast.
    """
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    keys = [f"__g{k}" for k in range(len(groups))]
    values = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(col).cast("double").alias("v"))
    values = cut_lineage(values.filter(F.col("v").isNotNull()), name="values")
    every = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else values.agg(F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)]))
    at = F.col("p") * (F.col("n") - 1)
    nothing = F.lit(None).cast("double")
    targets = (every.filter("n > 0").select(*keys, "n", wanted.alias("w")).select(*keys, "n", "w.i", "w.p")
               .select(*keys, "i", F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("part"),
                       nothing.alias("a"), nothing.alias("b"), F.lit(False).alias("fixed")))
    targets = cut_lineage(targets, name="targets")

    def measured(brackets: DataFrame) -> DataFrame:
        found = _measured(values, keys, brackets).select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("i").alias("of"),
                                                         *[F.col(c).alias(f"new_{c}") for c in ("below", "inside", "sketch")])
        cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("i") == F.col("of"))
        return brackets.join(found, cond).drop("of", *[f"{k}_" for k in keys])

    state = measured(targets)
    state = cut_lineage(state.withColumnsRenamed({f"new_{c}": c for c in ("below", "inside", "sketch")}), name="brackets")
    while state.filter((F.col("inside") > limit) & ~F.col("fixed")).head(1):
        tried = cut_lineage(_closed_in(state.withColumns({"old_a": F.col("a"), "old_b": F.col("b")}), limit), name="targets")
        tried = measured(tried)
        holds = (F.col("new_below") <= F.col("lo")) & (F.col("hi") < F.col("new_below") + F.col("new_inside"))
        taken = {c: F.when(holds, F.col(new)).otherwise(F.col(old)) for c, new, old in (
            ("a", "a", "old_a"), ("b", "b", "old_b"), *((c, f"new_{c}", c) for c in ("below", "inside", "sketch")))}
        # a proposal that fails, or does not shrink (equal values), is the last one
        taken["fixed"] = F.col("fixed") | ~holds | (F.col("new_inside") >= F.col("inside"))
        state = cut_lineage(tried.select(*[taken.get(c, F.col(c)).alias(c) for c in state.columns]), name="brackets")
    t = state
    tested = _tested(values, keys, t).filter(_inside(F.col("t"), F.col("v"))[1])
    counts = tested.groupBy(*keys, F.col("t.i").alias("i"), "v").agg(F.count(F.lit(1)).alias("c"))
    run = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("end", run)
    told = t.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("i").alias("of"), "lo", "hi", "part", "below")
    cond = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.col("i") == F.col("of"))
    start, end = F.col("below") + F.col("end") - F.col("c"), F.col("below") + F.col("end")
    picked = ranked.join(F.broadcast(told), cond).groupBy(*keys, "i").agg(
        F.max(F.when((start <= F.col("lo")) & (F.col("lo") < end), F.col("v"))).alias("low"),
        F.max(F.when((start <= F.col("hi")) & (F.col("hi") < end), F.col("v"))).alias("high"), F.max("part").alias("part"))
    value = F.col("low") + F.col("part") * (F.col("high") - F.col("low"))
    out = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, value)).alias(n) for i, n in enumerate(names)])
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], *names)
