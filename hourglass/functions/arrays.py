"""Array-column functions (higher-order lambdas, no Python UDFs)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hourglass.functions.hashing import hash_u32


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_candidates(c, k: int, pad: int = -1) -> Column:
    """Truncate a list to ``k`` entries and right-pad with ``pad``."""
    a = F.coalesce(_c(c), F.array().cast("array<bigint>"))
    return F.slice(F.concat(a.cast("array<bigint>"), F.array_repeat(F.lit(pad).cast("bigint"), k)), 1, k)


def multi_hot(c, n: int) -> Column:
    """Multi-hot ``array<tinyint>`` of length ``n`` from an index list."""
    a = F.coalesce(_c(c), F.array().cast("array<bigint>"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.array_contains(a, i).cast("tinyint"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression that a lambda refers to is evaluated again for every element;
    the variable of an outer one-element ``transform`` is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def topk_idx(c, k: int) -> Column:
    """Indexes of the ``k`` largest entries, ties to the lower index."""
    a = _c(c)
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("neg"), i.alias("idx")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: s["idx"])


def argmax(c) -> Column:
    """Index of the largest entry, ties to the lower index; empty/null -> null."""
    a = _c(c)
    return (F.nullif(F.array_position(a, F.array_max(a)), F.lit(0)) - 1).cast("int")


def last_valid(c, ignore: int = -100) -> Column:
    """Last element not equal to ``ignore``; null when there is none."""
    return F.try_element_at(F.filter(_c(c), lambda x: x != F.lit(ignore)), F.lit(-1))


def draw_candidate(c, row_id, seed: int = 0, none_value: int = 0) -> Column:
    """Uniform draw of one candidate per row by a seeded hash; none -> ``none_value`` (I4)."""
    valid = F.filter(_c(c), lambda x: x >= 0)
    n = F.size(valid)
    pick = F.pmod(hash_u32(row_id, seed), F.greatest(n, F.lit(1)).cast("bigint")) + 1
    return F.when(n > 0, F.try_element_at(valid, pick.cast("int"))).otherwise(F.lit(none_value).cast("bigint"))
