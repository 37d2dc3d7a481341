"""Composed timeline ETL: events -> hourly stats -> grid -> state flag -> channels -> labels.

This is the flagship plan (the reference's stage 1 re-expressed as one lazy
DataFrame chain).  Each step is a library operator; the only materialized
boundary is the caller's sink.

Shuffle plan: the hourly aggregate shuffles on (entity, hour, name) after a
map-side partial aggregate; the grid, the flag, the channel windows and the
label windows all partition by the entity, so Spark reuses one hash
partitioning of the grid for the windows (checked with ``explain``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.functions.columns import clip_to_range, convert_units, outlier_mask, stay_hours, with_hour_offset
from hourglass.operators.aggregates import hourly_stats, pivot_fixed
from hourglass.operators.joins import attach_wide, flag_hours, join_in_interval, label_events, lookup_ranges
from hourglass.operators.timeline import (channels, ffill_limit, hourly_grid, transition_label,
                                          transition_labels)
from hourglass.session import cut_lineage


def clean_events(events: DataFrame, items: DataFrame, ranges: DataFrame, item_key: str,
                 value: str = "VALUENUM", unit: str = "VALUEUOM", family: str = "LEVEL1",
                 name: str = "LEVEL2", dedupe_ranges: bool = False) -> DataFrame:
    """Measurement cleaning in the reference's order.

    Events join the item dimension (unmapped items drop), units convert by
    the family name, range rows attach by lower-cased name (duplicates fan
    out unless ``dedupe_ranges``), out-of-range values drop and the rest
    clip to the valid range.
    """
    labeled = label_events(events, items, key=item_key)
    converted = labeled.withColumn(value, convert_units(value, unit, family))
    ranged = lookup_ranges(converted, ranges, name, range_key=name, dedupe=dedupe_ranges)
    kept = ranged.filter(outlier_mask(value, "OUT_LOW", "OUT_HIGH"))
    return kept.withColumn(value, clip_to_range(value, "VAL_LOW", "VAL_HIGH")).drop(
        "OUT_LOW", "VAL_LOW", "VAL_HIGH", "OUT_HIGH")


def measurements(events: DataFrame, stays: DataFrame, key: str, ts: str, name: str, value: str,
                 lo: str = "intime", hi: str = "outtime", lookback_hours: int = 0) -> DataFrame:
    """Events inside their stay, with the hour offset from the stay anchor, hourly stats."""
    ev = events.select(key, ts, name, value)
    inside = join_in_interval(ev, stays, key, ts, lo, hi, lookback_hours=lookback_hours, stay_cols=[key, lo, hi])
    hourly = with_hour_offset(inside, ts, lo, out="HOURS_IN", min_hour=0)
    return hourly_stats(hourly, [key, "HOURS_IN", name], value)


def wide_features(hourly: DataFrame, key: str, name: str, features: Sequence[str]) -> DataFrame:
    """Long hourly means to one column per feature."""
    return (pivot_fixed(hourly, [key, "HOURS_IN"], name, "MEAN", features)
            .withColumnRenamed("HOURS_IN", "HOUR_IN"))


def wide_with_flag(hourly: DataFrame, key: str, name: str, features: Sequence[str],
                   state_names: Sequence[str], flag: str = "__flag") -> DataFrame:
    """Pivot (A3) and state-event flag (J6) in one aggregate per (entity, hour).

    Same conditional aggregates Spark's ``pivot`` plans, plus one more for
    the flag, so the grid needs a single join for both.
    """
    n = F.col(name)
    aggs = [F.avg(F.when(n == F.lit(f), F.col("MEAN"))).alias(f) for f in features]
    aggs.append(F.max(F.when(n.isin(*state_names), F.lit(1))).cast("tinyint").alias(flag))
    return (hourly.groupBy(key, "HOURS_IN").agg(*aggs)
            .withColumnRenamed("HOURS_IN", "HOUR_IN"))


def state_flag(grid: DataFrame, hourly: DataFrame, key: str, name: str, state_names: Sequence[str],
               fill_limit: int = 6, carry_across: bool = False, out: str = "VENT") -> DataFrame:
    """Flag hours with a state event, forward fill up to ``fill_limit`` hours, rest 0."""
    ev = hourly.filter(F.col(name).isin(*state_names)).select(key, "HOURS_IN")
    flagged = flag_hours(grid, ev, [key, "HOUR_IN"], [key, "HOURS_IN"], flag="__flag")
    filled = ffill_limit(flagged, "__flag", fill_limit, key, "HOUR_IN", carry_across=carry_across,
                         out=out, default=0)
    return filled.drop("__flag")


#: Grid hours of a task; their channels and sequences then fit into its memory.
TASK_HOURS = 1 << 16
#: Tasks are not made smaller than this many allow.
MAX_TASKS = 20_000


def tasks_of(stays: DataFrame, hours_col: str = "STAY_HOURS", max_hours: int | None = None) -> int | None:
    """How many tasks the grid of ``stays`` is worth; None if the session's shuffle partitions are enough."""
    hours = F.col(hours_col) if max_hours is None else F.least(F.col(hours_col), F.lit(max_hours))
    total = stays.agg(F.sum(F.when(hours > 0, hours))).first()[0] or 0
    n = min(-(-int(total) // TASK_HOURS), MAX_TASKS)
    return n if n > int(stays.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    """``df`` dealt by key into that many tasks, which adaptive execution does not merge; as it is without a number.

    Grid rows shrink to a few bytes each in a shuffle, so tasks merged by the bytes they read would hold
    many million rows and spill in every sort and aggregate that follows.
    """
    return df if tasks is None else df.repartition(tasks, *by)


#: Hours that the time channel's unit stands for where no sequence length is given.
TIME_SCALE_HOURS = 720


def build_timeline(events: DataFrame, stays: DataFrame, key: str, ts: str, name: str, value: str,
                   features: Sequence[str], state_names: Sequence[str], grid_hours: int | None = None,
                   seq_len: int | None = None, fill_limit: int = 6, gap: int = 6, window: int = 4,
                   label_col: str = "target", materialize: bool = True) -> dict[str, DataFrame]:
    """All stage-1 tables for one entity timeline.

    Returns ``stays``, ``hourly`` (A1), ``wide`` (A3), ``grid`` (G1),
    ``flagged`` (W2), ``channels`` (W3, with the state flag), ``labels`` (W4)
    and ``dataset`` (channels plus the label, computed in the same window
    pass -- no self-join).

    With ``materialize`` the stays and the hourly statistics are checkpointed
    into the shared checkpoint folder: both feed several branches (grid,
    offsets, pivot, flags), and without a materialized copy every branch would
    rescan the raw events.  The raw events are then read exactly twice (stay
    bounds, then the hourly aggregate), and the checkpoint survives executor
    loss.  A grid of more hours than the session's partitions take at ease is
    dealt into tasks of ``TASK_HOURS``, for the join and then by entity; windows
    and sequences by entity follow in the same tasks.
    """
    if "STAY_HOURS" not in stays.columns:
        stays = stays.withColumn("STAY_HOURS", stay_hours("intime", "outtime"))  # P3
    if materialize:
        stays = cut_lineage(stays)
    hourly = measurements(events, stays, key, ts, name, value)
    if materialize:
        hourly = cut_lineage(hourly)
    tasks = tasks_of(stays, "STAY_HOURS", grid_hours) if materialize else None
    wide = wide_features(hourly, key, name, features)
    grid = hourly_grid(stays, "STAY_HOURS", grid_hours, keep=[key, "intime"])
    flagged = state_flag(grid, hourly, key, name, state_names, fill_limit)
    feats = list(features)
    labels = transition_labels(flagged, "VENT", gap, window, key, "HOUR_IN", out=label_col)
    # One join of the grid to (features + flag), then two window passes on the
    # same entity partitioning: fill the flag, then channels and labels.
    features_flag = wide_with_flag(dealt(hourly, tasks, key, "HOURS_IN"), key, name, feats, state_names)
    joined = dealt(attach_wide(dealt(grid, tasks, key, "HOUR_IN"), features_flag, [key, "HOUR_IN"]), tasks, key)
    joined = ffill_limit(joined, "__flag", fill_limit, key, "HOUR_IN", out="VENT", default=0).drop("__flag")
    chans = channels(joined, feats, key, "HOUR_IN", seq_len=seq_len or grid_hours or TIME_SCALE_HOURS)
    ds = channels(joined, feats, key, "HOUR_IN", seq_len=seq_len or grid_hours or TIME_SCALE_HOURS,
                  extra=[transition_label("VENT", gap, window, key, "HOUR_IN").alias(label_col)])
    return {"stays": stays, "hourly": hourly, "wide": wide, "grid": grid, "flagged": flagged,
            "channels": chans, "labels": labels, "dataset": ds}


def dataset(tables: dict[str, DataFrame], key: str, label_col: str = "target") -> DataFrame:
    """Channels with the transition label per (entity, hour) (J11), one window pass."""
    return tables["dataset"]
