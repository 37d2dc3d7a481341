"""Hourly grid and per-entity window operators.

Windows partition by entity and order by hour.  An entity's grid has a row per
elapsed hour, so a window partition is bounded by the length of its stay
however many raw events it has; ``ffill_pieces`` and ``channels_pieces`` bound it
for entities without end as well (sensors, hosts) (``max_hours`` truncates the grid only where a
caller asks for it); the heavy reduction (events -> hourly
statistics) happens before, in a partially aggregated ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourglass.operators.pieces import PIECE_ROWS, last_observed


# --------------------------------------------------------------------------- G1
def hourly_grid(stays: DataFrame, hours_col: str = "STAY_HOURS", max_hours: int | None = None,
                hour_col: str = "HOUR_IN", keep: Sequence[str] | None = None) -> DataFrame:
    """Dense rows ``0 .. hours - 1`` per stay, at most ``max_hours`` if it is given (G1).

    A stay with null or non-positive hours yields no rows (trap T7: Spark's
    ``sequence(0, -1)`` would count down, and ``least(NULL, L)`` is L).
    """
    keep = list(keep) if keep is not None else [c for c in stays.columns if c != hours_col]
    n = F.col(hours_col) if max_hours is None else F.least(F.col(hours_col), F.lit(max_hours))
    seq = F.when(F.col(hours_col).isNotNull() & (n > 0), F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint")))
    return stays.select(*keep, F.explode(seq).alias(hour_col))


def _w(by: Sequence[str] | str, order: Sequence[str] | str):
    by = [by] if isinstance(by, str) else list(by)
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*by).orderBy(*order)


# --------------------------------------------------------------------------- W1
def ffill(df: DataFrame, cols: Sequence[str], by, order, suffix: str = "") -> DataFrame:
    """Forward fill per entity without limit."""
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(F.col(c), ignorenulls=True).over(w).alias(c + suffix) for c in cols}
    if suffix:
        return df.select("*", *filled.values())
    return df.select(*[filled.get(c, F.col(c)) for c in df.columns])


def ffill_pieces(df: DataFrame, cols: Sequence[str], by, order: str, suffix: str = "",
                 piece_rows: int = PIECE_ROWS) -> DataFrame:
    """:func:`ffill` for keys of any length: a key above ``piece_rows`` rows is filled piece by piece.

    Same rows and columns.  ``order`` is one column, unique within a key.
    """
    by_l = [by] if isinstance(by, str) else list(by)
    out = last_observed(df, {f"__last_{c}": F.col(c) for c in cols}, by_l, order, piece_rows)
    filled = {c: F.col(f"__last_{c}").alias(c + suffix) for c in cols}
    if suffix:
        return out.select(*df.columns, *filled.values())
    return out.select(*[filled.get(c, F.col(c)) for c in df.columns])


# --------------------------------------------------------------------------- W2
def ffill_limit(df: DataFrame, col: str, n: int, by, order, carry_across: bool = False,
                out: str | None = None, default=None) -> DataFrame:
    """Forward fill with at most ``n`` consecutive filled rows.

    Per entity by default.  ``carry_across=True`` reproduces the reference's
    un-partitioned fill, where a value may leak up to ``n`` rows into the next
    entity in (entity, order) sort order; it is computed from a per-entity
    window, a one-row-per-entity summary (row count, last observed row), a
    distributed prefix sum over that summary and an equi-join -- never with a
    single-partition window over all rows.
    """
    out = out or col
    by_l = [by] if isinstance(by, str) else list(by)
    if not carry_across:
        w = _w(by_l, order).rowsBetween(-n, 0)
        filled = F.last(F.col(col), ignorenulls=True).over(w)
    else:
        filled = _carry_across_fill(df, col, n, by_l, order)
        df = filled
        filled = F.col("__filled")
    if default is not None:
        filled = F.coalesce(filled, F.lit(default))
    res = df.withColumn(out, filled.cast(df.schema[col].dataType))
    return res.drop("__filled", "__pos", "__base", "__prev_last_pos", "__prev_last_val", "__rn",
                    "__lastpos_in", "__lastval_in")


def _carry_across_fill(df: DataFrame, col: str, n: int, by: list[str], order) -> DataFrame:
    """Global forward fill with limit across entity boundaries, entity-parallel.

    Rows are numbered globally as ``base(entity) + rn``, where ``base`` is the
    exclusive prefix sum of row counts over the one-row-per-entity table,
    computed with a distributed scan (:func:`hourglass.operators.scan.prefix_sums`).
    Within an entity the last observed row comes from the entity window; rows
    before the entity's first observation take the last observation of the
    nearest previous entity that has one, found by an equi-join on the running
    count of observed entities.
    """
    from hourglass.operators.scan import prefix_sums

    order_l = [order] if isinstance(order, str) else list(order)
    w_in = Window.partitionBy(*by).orderBy(*order_l)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    observed = F.col(col).isNotNull()
    rows = (df.withColumn("__rn", F.row_number().over(w_in))
            .withColumn("__lastpos_in", F.max(F.when(observed, F.col("__rn"))).over(w_run))
            .withColumn("__lastval_in", F.last(F.col(col), ignorenulls=True).over(w_run)))
    per = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__cnt"),
        F.max(F.when(observed, F.col("__rn"))).alias("__obs_pos"),
        F.max_by(F.col(col), F.when(observed, F.col("__rn"))).alias("__obs_val"))
    per = per.withColumn("__has", F.col("__obs_pos").isNotNull().cast("long"))
    per = prefix_sums(per, [], by, ["__cnt", "__has"], suffix="_before", inclusive=False)
    per = per.withColumn("__base", F.col("__cnt_before"))
    last_obs = per.filter(F.col("__has") == 1).select(
        (F.col("__has_before") + 1).alias("__prev_rank"),
        (F.col("__base") + F.col("__obs_pos")).alias("__prev_last_pos"),
        F.col("__obs_val").alias("__prev_last_val"))
    per = (per.withColumn("__prev_rank", F.col("__has_before"))
           .join(last_obs, ["__prev_rank"], "left")
           .select(*by, "__base", "__prev_last_pos", "__prev_last_val"))
    j = rows.join(per, by, "left").withColumn("__pos", F.col("__base") + F.col("__rn"))
    own = F.col("__lastpos_in").isNotNull()
    last_pos = F.when(own, F.col("__base") + F.col("__lastpos_in")).otherwise(F.col("__prev_last_pos"))
    last_val = F.when(own, F.col("__lastval_in")).otherwise(F.col("__prev_last_val"))
    return j.withColumn("__filled", F.when(observed, F.col(col))
                        .when(F.col("__pos") - last_pos <= F.lit(n), last_val))


# --------------------------------------------------------------------------- W3 / P23
def channels(df: DataFrame, features: Sequence[str], by, order: str, seq_len: int | None = None,
             value_prefix: str = "V__", mask_prefix: str = "M__", delta_prefix: str = "D__",
             keep: Sequence[str] | None = None, time_channel: bool = True,
             extra: Sequence[Column] = ()) -> DataFrame:
    """Value / mask / delta channels per feature on one window spec.

    * ``V__f`` = forward-filled finite value (NaN/Inf treated as missing),
    * ``M__f`` = 1 when observed in this row,
    * ``D__f`` = hours since the last observation, or the hour itself before
      the first one (trap T8).
    All expressions share one ``Window`` so the plan has one exchange and one
    sort.  With ``seq_len`` a ``V__time`` channel h/L is added (P23).
    ``extra`` columns (e.g. :func:`transition_label` over the same entity and
    order) are evaluated in the same pass.
    """
    w = _w(by, order).rowsBetween(Window.unboundedPreceding, 0)
    h = F.col(order)
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in features]
    cols = [F.col(c) for c in keep]
    for f in features:
        x = F.col(f)
        finite = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
        observed = finite.isNotNull()
        cols.append(F.last(finite, ignorenulls=True).over(w).alias(value_prefix + f))
        cols.append(observed.cast("tinyint").alias(mask_prefix + f))
        last_h = F.last(F.when(observed, h), ignorenulls=True).over(w)
        cols.append((h - F.coalesce(last_h, F.lit(0))).cast("int").alias(delta_prefix + f))
    if time_channel and seq_len:
        cols.append((h.cast("double") / F.lit(float(seq_len))).alias(value_prefix + "time"))
    return df.select(*cols, *extra)


def channels_pieces(df: DataFrame, features: Sequence[str], by, order: str, seq_len: int | None = None,
                    value_prefix: str = "V__", mask_prefix: str = "M__", delta_prefix: str = "D__",
                    keep: Sequence[str] | None = None, time_channel: bool = True,
                    piece_rows: int = PIECE_ROWS) -> DataFrame:
    """:func:`channels` for keys of any length: a key above ``piece_rows`` rows is scanned piece by piece.

    Same rows and columns, without ``extra``: those are window expressions of the caller's.
    """
    by_l = [by] if isinstance(by, str) else list(by)
    h = F.col(order)
    finite = {f: F.when(~F.isnan(F.col(f)) & (F.abs(F.col(f)) < F.lit(float("inf"))), F.col(f)) for f in features}
    marks = {f"__last_{f}": F.when(x.isNotNull(), F.struct(x.alias("value"), h.alias("hour"))) for f, x in finite.items()}
    seen = last_observed(df, marks, by_l, order, piece_rows)
    keep = list(keep) if keep is not None else [c for c in df.columns if c not in features]
    cols = [F.col(c) for c in keep]
    for f in features:
        last = F.col(f"__last_{f}")
        cols += [last["value"].alias(value_prefix + f), finite[f].isNotNull().cast("tinyint").alias(mask_prefix + f),
                 (h - F.coalesce(last["hour"], F.lit(0))).cast("int").alias(delta_prefix + f)]
    if time_channel and seq_len:
        cols.append((h.cast("double") / F.lit(float(seq_len))).alias(value_prefix + "time"))
    return seen.select(*cols)


# --------------------------------------------------------------------------- W4
# Transition classes of the reference.
ONSET, WEAN, STAY_ON, STAY_OFF = 0, 1, 2, 3


def transition_label(state: str, gap: int = 6, n: int = 4, by="ICUSTAY_ID", order: str = "HOUR_IN") -> Column:
    """Look-ahead state label as a column expression (W4), see :func:`transition_labels`."""
    w = _w(by, order)
    steps = [F.lead(F.col(state), gap + i).over(w) for i in range(n)]
    valid = None
    all_on = None
    all_off = None
    for s in steps:
        valid = s.isNotNull() if valid is None else valid & s.isNotNull()
        all_on = (s == 1) if all_on is None else all_on & (s == 1)
        all_off = (s == 0) if all_off is None else all_off & (s == 0)
    onset = F.lit(False)
    wean = F.lit(False)
    for a, b in zip(steps[:-1], steps[1:]):
        onset = onset | ((a == 0) & (b == 1))
        wean = wean | ((a == 1) & (b == 0))
    return (F.when(valid & onset, F.lit(ONSET))
            .when(valid & wean, F.lit(WEAN))
            .when(valid & all_on, F.lit(STAY_ON))
            .when(valid & all_off, F.lit(STAY_OFF))).cast("bigint")


def transition_labels(df: DataFrame, state: str, gap: int = 6, n: int = 4, by="ICUSTAY_ID",
                      order: str = "HOUR_IN", out: str = "target_vent", keep_null: bool = False) -> DataFrame:
    """Look-ahead state label over rows t+gap .. t+gap+n-1.

    onset (0/1 step) > wean (1/0 step) > stay on (all 1) > stay off (all 0);
    null (dropped unless ``keep_null``) unless every step exists and is
    non-null.  Steps are rows, as on the dense grid.
    """
    by_l = [by] if isinstance(by, str) else list(by)
    res = df.select(*by_l, F.col(order), transition_label(state, gap, n, by, order).alias(out))
    return res if keep_null else res.filter(F.col(out).isNotNull())


# --------------------------------------------------------------------------- W5 / A5 / J13
def first_per_key(df: DataFrame, key, order: Sequence[str]) -> DataFrame:
    """First row per key by ascending ``order`` columns.

    Written as ``min(struct(order..., row...))`` per key rather than a
    ``row_number`` window: the aggregate combines map-side, so a key holding a
    large share of the rows is reduced in every task before the shuffle
    instead of being sorted inside one task.  The caller makes ``order`` a
    total order (e.g. time, then id) so the result is deterministic.
    """
    key_l = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in key_l]
    packed = F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)],
                      *[F.col(c).alias(c) for c in rest])
    agg = df.groupBy(*key_l).agg(F.min(packed).alias("__first"))
    return agg.select(*key_l, *[F.col("__first")[c].alias(c) for c in rest])
