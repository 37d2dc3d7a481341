"""Joins (J1-J13).

Every join here is an equi-join, some with a residual range predicate that
Catalyst folds into the join condition.  Small dimension tables are broadcast
only behind a bound on their planned bytes; everything else is left to the
planner (sort-merge with AQE skew splitting, or AQE's runtime broadcast when
the shuffled side turns out small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side whose planned size is above this is never hinted for broadcast.
BROADCAST_MAX_BYTES = 32 << 20
# Levels of time buckets, each twice as wide as the one before (the widest of 1 h buckets: 119 years).
_BUCKET_LEVELS = 21


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Hint a broadcast of ``df`` only if the planner's own size estimate is at most ``max_bytes``.

    The estimate comes from file sizes and local rows, runs no job and does not
    depend on the answer; above it the planner shuffles both sides and AQE splits
    skewed keys.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= max_bytes else df


# --------------------------------------------------------------------------- J1
def build_cohort(stays: DataFrame, admissions: DataFrame, persons: DataFrame,
                 stay_keys: Sequence[str] = ("SUBJECT_ID", "HADM_ID"),
                 person_key: str = "SUBJECT_ID") -> DataFrame:
    """Stay join admission join person, inner."""
    adm = admissions.drop(*[c for c in admissions.columns if c in stays.columns and c not in stay_keys])
    out = stays.join(adm, list(stay_keys), "inner")
    per = persons.drop(*[c for c in persons.columns if c in out.columns and c != person_key])
    return out.join(per, [person_key], "inner")


# --------------------------------------------------------------------------- J2
def label_events(events: DataFrame, items: DataFrame, key: str = "ITEMID",
                 max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Events inner-joined to the item dimension; unmapped items drop."""
    return events.join(broadcast_if_small(items, max_bytes), [key], "inner")


# --------------------------------------------------------------------------- J3 / J4
def join_in_interval(events: DataFrame, stays: DataFrame, key: str, ts: str,
                     lo: str, hi: str, lookback_hours: int = 0,
                     stay_cols: Sequence[str] | None = None,
                     broadcast_max_bytes: int | None = BROADCAST_MAX_BYTES,
                     bucket_hours: int | None = None) -> DataFrame:
    """Events joined to stays on ``key`` with ``lo - lookback <= ts <= hi``.

    One join whose condition carries the range; a key that owns many stays
    (admission with several stays) fans out to each of them.  The stay table
    has one row per stay, so when it is within ``broadcast_max_bytes`` it is
    broadcast and the raw events are never shuffled; beyond that the planner
    shuffles both sides and AQE splits a hot key's partition of the event
    side.

    ``bucket_hours`` is for keys that own very many stays: the join key becomes
    (key, bucket), so an event meets only the stays of its own bucket instead
    of every stay of its key.  A stay goes into the buckets of its own level,
    ``bucket_hours`` doubled until the stay fits into one bucket's width, and
    so into two of them at most however long it is; an event has a bucket in
    every level that occurs.  The stays are never broadcast, as the planner
    does not see their copies.  The range condition still decides; results are
    identical.
    """
    keep = list(stay_cols) if stay_cols is not None else [c for c in stays.columns]
    cols = list(dict.fromkeys([key, lo, hi, *keep]))
    s = stays.select(*[F.col(c).alias(f"__s_{c}") if c == key else F.col(c) for c in cols])
    lower = F.col(lo) if not lookback_hours else F.timestamp_add("HOUR", F.lit(-lookback_hours), F.col(lo))
    cond = (F.col(key) == F.col(f"__s_{key}")) & (F.col(ts) >= lower) & (F.col(ts) <= F.col(hi))
    dup = [c for c in s.columns if c in events.columns and c != key]
    ev = events.drop(*dup)
    if bucket_hours:
        epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        narrow = int(bucket_hours * 3_600_000_000)
        steps = [narrow << i for i in range(_BUCKET_LEVELS) if i == 0 or narrow << i < 1 << 62]
        widths = F.array(*[F.lit(w).cast("bigint") for w in steps])

        def bucket(c, level):
            return F.floor(F.timestamp_diff("MICROSECOND", epoch, c) / F.get(widths, level)).cast("bigint")

        s = s.filter(lower <= F.col(hi))
        length = F.timestamp_diff("MICROSECOND", lower, F.col(hi))
        s = s.withColumn("__level", F.least(F.size(F.filter(widths, lambda w: w < length)), F.lit(len(steps) - 1)))
        used = s.select(F.col("__level").alias("__ev_level")).distinct()
        first, last = bucket(lower, F.col("__level")), bucket(F.col(hi), F.col("__level"))
        s = s.withColumn("__bucket", F.explode(F.sequence(first, last)))
        ev = ev.crossJoin(F.broadcast(used)).withColumn("__ev_bucket", bucket(F.col(ts), F.col("__ev_level")))
        cond = cond & (F.col("__ev_bucket") == F.col("__bucket")) & (F.col("__ev_level") == F.col("__level"))
        s = s.hint("merge")
    elif broadcast_max_bytes:
        s = broadcast_if_small(s, broadcast_max_bytes)
    out = ev.join(s, cond, "inner").drop(f"__s_{key}")
    return out.drop("__bucket", "__ev_bucket", "__level", "__ev_level") if bucket_hours else out


def join_in_interval_spread(events: DataFrame, stays: DataFrame, key: str, ts: str, lo: str, hi: str,
                            lookback_hours: int = 0, stay_cols: Sequence[str] | None = None,
                            piece_rows: int | None = None) -> DataFrame:
    """:func:`join_in_interval` that finds hot keys itself and spreads them over time.

    A key with more than ``piece_rows`` events and stays is cut at points drawn from its own event
    times and stay begins (:mod:`hourglass.operators.pieces`).  An event lies in one piece, a stay is
    repeated in every piece it overlaps, and the join goes by (key, piece): a hot key's events spread over
    tasks and meet only the stays of their piece.  A stay's copies but the first and the last span a whole
    piece of events, so they are fewer than the result's rows.  Tasks are dealt by the pairs they compare
    (``deal_pairs``), not by their bytes.  The range condition still decides; rows and columns are those of
    ``join_in_interval``.
    """
    from hourglass.operators.pieces import PIECE_ROWS, SAMPLES, deal_pairs, key_cuts, with_pieces
    from hourglass.session import cut_lineage

    keep = list(stay_cols) if stay_cols is not None else list(stays.columns)
    cols = list(dict.fromkeys([key, lo, hi, *keep]))
    lower = F.col(lo) if not lookback_hours else F.timestamp_add("HOUR", F.lit(-lookback_hours), F.col(lo))
    s = stays.select(*cols).withColumn("__lower", lower).filter(F.col("__lower") <= F.col(hi))
    ev = events.drop(*[c for c in cols if c in events.columns and c != key])
    at = cut_lineage(ev.select(key, F.col(ts).alias("__at")), name="times")
    rows_of = piece_rows or PIECE_ROWS
    cuts = key_cuts(at.unionByName(s.select(key, F.col("__lower").alias("__at"))), [key], "__at", rows_of)

    def stays_of(rows):
        rows = with_pieces(rows, [key], cuts, {"__from": F.col("__lower"), "__to": F.col(hi)})
        rows = rows.withColumn("__s_piece", F.explode(F.sequence("__from", "__to"))).drop("__from", "__to", "__hot")
        return rows.withColumnRenamed(key, "__s_key")

    def drawn(rows):
        return rows.filter(F.rand(1) < share)

    share = min(1.0, SAMPLES / rows_of)
    ev = with_pieces(ev, [key], cuts, {"__piece": F.col(ts)}).drop("__hot")
    ev, s, met = deal_pairs(ev, stays_of(s), {key: "__s_key", "__piece": "__s_piece"},
                            with_pieces(drawn(at), [key], cuts, {"__piece": F.col("__at")}), stays_of(drawn(s)), share)
    out = ev.join(s, met & (F.col(ts) >= F.col("__lower")) & (F.col(ts) <= F.col(hi)), "inner")
    return out.drop("__s_key", "__s_piece", "__piece", "__lower", "__deal", "__to_deal")


# --------------------------------------------------------------------------- J5
def lookup_ranges(events: DataFrame, ranges: DataFrame, name_col: str, range_key: str = "LEVEL2",
                  max_bytes: int = BROADCAST_MAX_BYTES, dedupe: bool = False) -> DataFrame:
    """Left lookup of range rows on the lower-cased name; duplicates fan out (J5, trap T2).

    ``dedupe=True`` keeps one range row per name -- the one with the most
    non-null bounds (ties: smallest bounds) -- so events are not repeated.
    """
    r = ranges.withColumn("__range_key", F.lower(F.col(range_key))).drop(range_key)
    if dedupe:
        from hourglass.operators.timeline import first_per_key
        vals = [c for c in r.columns if c != "__range_key"]
        nulls = sum((F.col(c).isNull().cast("int") for c in vals), F.lit(0))
        r = first_per_key(r.withColumn("__nulls", nulls), "__range_key", ["__nulls", *vals]).drop("__nulls")
    r = broadcast_if_small(r, max_bytes)
    return (events.withColumn("__name_key", F.lower(F.col(name_col)))
            .join(r, F.col("__name_key") == F.col("__range_key"), "left")
            .drop("__name_key", "__range_key"))


# --------------------------------------------------------------------------- J6
def flag_hours(grid: DataFrame, events: DataFrame, grid_keys: Sequence[str],
               event_keys: Sequence[str], flag: str = "FLAG") -> DataFrame:
    """Left join the grid to the distinct event keys; 1 where an event exists else NULL.

    The NULLs are left for :func:`hourglass.operators.timeline.ffill_limit`.
    """
    ev = (events.select(*[F.col(e).alias(g) for g, e in zip(grid_keys, event_keys)])
          .distinct().withColumn(flag, F.lit(1).cast("tinyint")))
    return grid.join(ev, list(grid_keys), "left")


# --------------------------------------------------------------------------- J7 / J8
def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Restrict ``df`` to keys present in ``keys``."""
    return df.join(keys.select(*on), list(on), "left_semi")


def restrict_split(df: DataFrame, splits: DataFrame, key: str, split: str,
                   split_col: str = "split") -> DataFrame:
    """Rows of ``df`` whose entity is in the given split; no collected id list."""
    members = splits.filter(F.col(split_col) == F.lit(split)).select(key)
    return df.join(members, [key], "left_semi")


# --------------------------------------------------------------------------- J9
def attach_wide(grid: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid left join wide measurements on (entity, hour)."""
    return grid.join(wide, list(keys), "left")


# --------------------------------------------------------------------------- J10
def attach_static(features: DataFrame, statics: DataFrame, key: str) -> DataFrame:
    """Left join one per-key static table (codes, one-hots, anchor) to the features.

    The reference joins five small tables; here they are one table built per
    key, so a single join suffices.
    """
    return features.join(statics, [key], "left")


# --------------------------------------------------------------------------- J11
def attach_labels(features: DataFrame, candidates: DataFrame | None, transitions: DataFrame | None,
                  stay_key: str, hour_key: str) -> DataFrame:
    """Left join candidate sets by stay and transition labels by (stay, hour)."""
    out = features
    if candidates is not None:
        out = out.join(candidates, [stay_key], "left")
    if transitions is not None:
        out = out.join(transitions, [stay_key, hour_key], "left")
    return out


# --------------------------------------------------------------------------- J12
def align_vectors(target: DataFrame, vectors: DataFrame, key: str, vec_col: str, dim: int,
                  out_col: str = "X_icd") -> DataFrame:
    """Attach a vector per target row by id; unmatched rows get the zero vector.

    Adds ``matched`` (1/0) so the match count is a plain ``sum`` downstream.
    A vector of the wrong length fails the job with an error.
    """
    vec = F.col(vec_col).cast("array<float>")
    checked = F.when(F.size(vec) == F.lit(dim), vec).otherwise(
        F.raise_error(F.lit(f"vector length differs from {dim}")))
    v = vectors.select(F.col(key), checked.alias("__vec"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (target.join(v, [key], "left")
            .withColumn("matched", F.col("__vec").isNotNull().cast("int"))
            .withColumn(out_col, F.coalesce(F.col("__vec"), zero))
            .drop("__vec"))


# --------------------------------------------------------------------------- J13 / trap T6
def keep_first_stay(df: DataFrame, firsts: DataFrame, stay_key: str, cols: Sequence[str],
                    restrict_rows: bool = False) -> DataFrame:
    """Restrict measurements to each subject's first stay (J13, trap T6).

    ``firsts`` holds the first stay ids (e.g. from ``first_per_key``).  By
    default rows of later stays stay in the table with ``cols`` nulled, as the
    reference does; ``restrict_rows=True`` drops those rows instead.
    """
    f = firsts.select(F.col(stay_key)).distinct()
    if restrict_rows:
        return df.join(f, [stay_key], "left_semi")
    flagged = df.join(f.withColumn("__first", F.lit(True)), [stay_key], "left")
    keep = F.coalesce(F.col("__first"), F.lit(False))
    return flagged.select(*[F.when(keep, F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])
