"""Code encoding and fixed-length sequences.

Sequences are built per entity from at most ``seq_len`` hourly rows, so the
per-entity ``collect_list`` is bounded by the sequence length, never by the
raw event volume.  For timelines too long for a row the same sequences come in
blocks (``sequence_blocks``, ``read_range``): a row is bounded by the block, or by the range
that is read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.functions.arrays import bound
from hourglass.operators.joins import broadcast_if_small
from hourglass.session import cut_lineage


# --------------------------------------------------------------------------- G2
def encode_codes(df: DataFrame, key: str, codes_col: str, vocab: DataFrame,
                 out: str = "candidates", code: str = "code", idx: str = "idx") -> DataFrame:
    """Map each row's code list to vocabulary indexes, in list order, unknown codes dropped.

    One plan for every vocabulary size: the rows are written once with a row
    id, ``posexplode`` -> join the vocabulary -> ordered ``collect_list`` per
    row id, joined back.  A row keeps its own list whether or not ``key``
    repeats; a code that the vocabulary lists twice has its smallest index.
    Rows with a null/empty list (or only unknown codes) get an empty list.
    """
    v = (vocab.filter(F.col(code).isNotNull()).groupBy(F.col(code).alias("__code"))
         .agg(F.min(F.col(idx).cast("bigint")).alias("__idx")))
    rows = cut_lineage(df.drop(out).withColumn("__row", F.monotonically_increasing_id()), name="codes")
    hits = (rows.select("__row", F.posexplode(codes_col).alias("__pos", "__code"))
            .join(v, ["__code"], "inner").groupBy("__row")
            .agg(F.sort_array(F.collect_list(F.struct("__pos", "__idx"))).alias("__pairs")))
    enc = hits.select("__row", F.transform("__pairs", lambda s: s["__idx"]).alias(out))
    return (rows.join(enc, ["__row"], "left").drop("__row")
            .withColumn(out, F.coalesce(F.col(out).cast("array<bigint>"), F.array().cast("array<bigint>"))))


def encode_long(rows: DataFrame, key: str, code: str, vocab: DataFrame, out: str = "candidates",
                codes_out: str = "CODES", idx: str = "idx") -> DataFrame:
    """(key, codes_out, out) from long (key, code) rows: A4 and G2 in one grouping.

    The sorted distinct non-null codes of a key, as ``collect_codes`` gives them, and the vocabulary indexes of
    those that are known, in the same order.  Codes meet the vocabulary while they are rows, so they are
    shuffled once, by key; a code that the vocabulary lists twice has its smallest index.  A key without a
    code has no row.  The vocabulary's column is called ``code`` as in ``build_vocab``.
    """
    v = (vocab.filter(F.col("code").isNotNull()).groupBy(F.col("code").alias("__v_code"))
         .agg(F.min(F.col(idx).cast("bigint")).alias("__idx")))
    coded = rows.filter(F.col(code).isNotNull()).select(key, F.col(code).cast("string").alias("__code"))
    pairs = (coded.join(broadcast_if_small(v), F.col("__code") == F.col("__v_code"), "left")
             .groupBy(key).agg(F.sort_array(F.collect_set(F.struct("__code", "__idx"))).alias("__pairs")))
    known = F.filter("__pairs", lambda x: x["__idx"].isNotNull())
    return pairs.select(key, F.transform("__pairs", lambda x: x["__code"]).alias(codes_out),
                        F.transform(known, lambda x: x["__idx"]).alias(out))


# --------------------------------------------------------------------------- G4 / G5
def _dense(found: Column, end: Column, pad: Column) -> Column:
    """Values at positions 0 up to ``end`` (exclusive) from (at, s) structs sorted by position, ``pad`` between them.

    Every value brings the padding before it, so the work is that of the result's length.
    """
    def led(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(found, i - 1)["at"], F.lit(-1))
        return F.concat(F.array_repeat(pad, x["at"] - before - 1), F.array(x["s"]))

    first = F.coalesce(F.get(found, F.lit(0))["at"], F.lit(0))
    final = F.coalesce(F.get(found, F.size(found) - 1)["at"], F.lit(-1))
    gapless = final - first + 1 == F.size(found)
    filled = F.when(gapless, F.concat(F.array_repeat(pad, first), found["s"])).otherwise(F.flatten(F.transform(found, led)))
    return F.concat(filled, F.array_repeat(pad, end - final - 1))


def _whole(df: DataFrame, hour: str) -> Column:
    """The hour as a number to group by: an integer column as it is, so that its order and partitions serve."""
    return F.col(hour) if df.schema[hour].dataType.typeName() in ("long", "integer", "short", "byte") else F.col(hour).cast("bigint")


def build_sequences(df: DataFrame, key: str, hour: str, channels: Sequence[str], seq_len: int = 120,
                    label: str | None = None, label_pad: int = -100, value_pad: float = 0.0,
                    as_of: str | None = None, out: str = "X_num", entities: DataFrame | None = None) -> DataFrame:
    """Right-aligned fixed-length sequences per entity (G4), channel-major.

    Hours outside ``[0, seq_len)`` are dropped; with ``mh`` the largest kept
    hour, hour ``h`` lands at position ``h + seq_len - 1 - mh``; positions to
    the left are padding (``value_pad`` for channels, ``label_pad`` for the
    label).  Channel values that are NaN/Inf/NULL become 0.  ``out`` is
    ``array<array<float>>`` of shape (len(channels), seq_len) in the given
    channel order (value, mask, delta blocks stacked by the caller's order);
    ``y`` is ``array<bigint>`` of length ``seq_len``.  ``as_of`` (a column with
    an hour per entity) truncates the input at that hour (trap T13).  Every
    key of ``entities`` gets a row, all padding if it has no kept hour.  Of
    rows that repeat an (entity, hour) the largest by channel values stays.
    """
    rows = df.filter((F.col(hour) >= 0) & (F.col(hour) < seq_len))
    if as_of is not None:
        rows = rows.filter(F.col(hour) <= F.col(as_of))
    fields = []
    for i, c in enumerate(channels):
        x = F.col(c).cast("double")
        clean = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
        fields.append(F.coalesce(clean, F.lit(value_pad)).cast("float").alias(f"c{i}"))
    y_pad = F.lit(label_pad).cast("bigint")
    if label is not None:
        fields.append(F.coalesce(F.col(label).cast("bigint"), y_pad).alias("y"))
    # of repeated hours the largest row stays, whatever order the rows arrive in
    hours = rows.groupBy(key, _whole(df, hour).alias("__h")).agg(F.max(F.struct(*fields)).alias("__s"))
    hours = hours.withColumn("__h", F.col("__h").cast("int"))
    pad = F.struct(*[F.lit(value_pad).cast("float").alias(f"c{i}") for i in range(len(channels))],
                   *([y_pad.alias("y")] if label is not None else []))
    # positions count from the right, so the last hour's is seq_len - 1
    g = hours.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__h", "__s"))).alias("__l"))
    shift = F.lit(seq_len - 1) - F.element_at("__l", -1)["__h"]
    placed = bound(F.struct(F.col("__l").alias("l"), shift.alias("by")), lambda g: F.transform(
        g["l"], lambda x: F.struct((x["__h"] + g["by"]).alias("at"), x["__s"].alias("s"))))
    g = g.select(key, bound(placed, lambda found: _dense(found, F.lit(seq_len), pad)).alias("__at"))
    if entities is not None:
        # merged: the planner counts a sequence as one value and would broadcast them all
        g = entities.select(key).distinct().join(g.hint("merge"), [key], "left").withColumn(
            "__at", F.coalesce("__at", F.array_repeat(pad, seq_len)))
    cols = [F.col(key), F.array(*[F.col("__at").getField(f"c{i}") for i in range(len(channels))]).alias(out)]
    if label is not None:
        cols.append(F.col("__at").getField("y").alias("y"))
    return g.select(*cols)


#: Positions of a block.
BLOCK = 1024


def sequence_blocks(df: DataFrame, key: str, hour: str, channels: Sequence[str], seq_len: int,
                    block: int = BLOCK, label: str | None = None, label_pad: int = -100, value_pad: float = 0.0,
                    as_of: str | None = None, out: str = "X_num", extents: DataFrame | None = None) -> DataFrame:
    """The sequences of :func:`build_sequences` in blocks of ``block`` positions.

    A row ``(key, block, start, X_num[, y])`` holds the positions ``start`` up to ``start + block`` (the last
    block ends at ``seq_len``), channel-major.  Positions, padding, cleaning, ``as_of`` and repeated hours are
    as in ``build_sequences``; a block that is all padding has no row, and a key without a kept hour has none.
    The rows of a key are grouped by block, so neither a row nor a task grows with the length of a timeline.
    ``extents`` (``seq_extent`` of the kept rows: key, max_hour) saves writing the hours to find each key's last.
    """
    rows = df.filter((F.col(hour) >= 0) & (F.col(hour) < seq_len))
    if as_of is not None:
        rows = rows.filter(F.col(hour) <= F.col(as_of))
    fields = []
    for i, c in enumerate(channels):
        x = F.col(c).cast("double")
        clean = F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)
        fields.append(F.coalesce(clean, F.lit(value_pad)).cast("float").alias(f"c{i}"))
    y_pad = F.lit(label_pad).cast("bigint")
    if label is not None:
        fields.append(F.coalesce(F.col(label).cast("bigint"), y_pad).alias("y"))
    hours = rows.groupBy(F.col(key).alias("__key"), _whole(df, hour).alias("__h")).agg(F.max(F.struct(*fields)).alias("__s"))
    if extents is None:
        hours = cut_lineage(hours, name="hours")
        last = hours.groupBy(F.col("__key").alias("__of")).agg(F.max("__h").alias("__mh"))
    else:
        last = extents.select(F.col(key).alias("__of"), F.col("max_hour").cast("bigint").alias("__mh"))
    place = F.col("__h") + F.lit(seq_len - 1) - F.col("__mh")
    placed = (hours.join(broadcast_if_small(cut_lineage(last, name="extents")), F.col("__key").eqNullSafe(F.col("__of")))
              .select("__key", F.floor(place / block).cast("int").alias("block"),
                      F.pmod(place, F.lit(block)).cast("int").alias("__at"), "__s"))
    grouped = placed.groupBy("__key", "block").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__at").alias("at"), F.col("__s").alias("s")))).alias("__l"))
    pad = F.struct(*[F.lit(value_pad).cast("float").alias(f"c{i}") for i in range(len(channels))],
                   *([y_pad.alias("y")] if label is not None else []))
    start = F.col("block").cast("bigint") * block
    width = F.least(F.lit(block).cast("bigint"), F.lit(seq_len) - start).cast("int")
    at = bound(F.col("__l"), lambda found: _dense(found, width, pad))
    filled = grouped.select("__key", "block", start.alias("start"), at.alias("__at"))
    cols = [F.array(*[F.col("__at").getField(f"c{i}") for i in range(len(channels))]).alias(out)]
    if label is not None:
        cols.append(F.col("__at").getField("y").alias("y"))
    return filled.select(F.col("__key").alias(key), "block", "start", *cols)


def read_range(blocks: DataFrame, key: str, lo: int, hi: int, n_channels: int, seq_len: int, block: int = BLOCK,
               entities: DataFrame | None = None, label: bool = False, label_pad: int = -100, value_pad: float = 0.0,
               out: str = "X_num") -> DataFrame:
    """Positions ``lo`` up to ``hi`` (exclusive) of every sequence that is stored in blocks.

    One row per key: ``out`` is channel-major with ``hi - lo`` positions and equals that slice of the whole
    sequence, padding where no block is stored; ``y`` likewise with ``label``.  Only blocks that meet the range are
    read (the filter on ``block`` reaches the scan); a row holds no more than the range.  Every key of
    ``entities`` has a row; without ``entities`` the keys with a block in the range have one.
    """
    if not 0 <= lo < hi <= seq_len:
        raise ValueError(f"the range {lo}..{hi} does not lie in 0..{seq_len}")
    first, last = lo // block, (hi - 1) // block
    names = [out, *(["y"] if label else [])]
    part = blocks.filter(F.col("block").between(first, last)).select(F.col(key).alias("__key"), "block", *names)
    found = part.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("block", F.struct(*names)))).alias("__m"))
    if entities is not None:
        keys = entities.select(F.col(key).alias("__of")).distinct()
        found = keys.join(found, F.col("__of").eqNullSafe(F.col("__key")), "left").drop("__key").withColumnRenamed("__of", "__key")

    def width(b: Column) -> Column:
        return F.least(F.lit(block), F.lit(seq_len) - b * block)

    def line(m: Column, of, empty: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(first), F.lit(last)),
                            lambda b: F.coalesce(of(F.try_element_at(m, b)), F.array_repeat(empty, width(b))))
        return F.slice(F.flatten(parts), lo - first * block + 1, hi - lo)

    pad, y_pad = F.lit(value_pad).cast("float"), F.lit(label_pad).cast("bigint")
    held = F.coalesce(F.col("__m"), F.map_from_arrays(F.array().cast("array<int>"),
                                                      F.array().cast(found.schema["__m"].dataType.simpleString()
                                                                     .replace("map<int,", "array<", 1))))
    x = bound(held, lambda m: F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)),
                                          lambda c: line(m, lambda s: F.get(s[out], c), pad)))
    cols = [F.col("__key").alias(key), x.alias(out)]
    if label:
        cols.append(bound(held, lambda m: line(m, lambda s: s["y"], y_pad)).alias("y"))
    return found.select(*cols)


def explode_sequences(seq: DataFrame, key: str, col: str = "X_num") -> DataFrame:
    """Long form ``(key, channel, pos, value)`` of a channel-major sequence column."""
    ch = seq.select(key, F.posexplode(col).alias("channel", "__series"))
    return ch.select(key, "channel", F.posexplode("__series").alias("pos", "value"))


# --------------------------------------------------------------------------- G6
def static_vector(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str],
                  out: str = "X_cat") -> DataFrame:
    """First row per entity's categorical columns as ``array<int>``, null -> 0."""
    from hourglass.operators.timeline import first_per_key
    first = first_per_key(df.select(key, *order, *cols), key, order)
    return first.select(key, F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cols]).alias(out))


# --------------------------------------------------------------------------- G7
def require_candidates(df: DataFrame, col: str) -> DataFrame:
    """Drop rows with no valid candidate, unless no row has any (then keep all).

    The "any row has one" test is a one-row aggregate joined back.
    """
    has = F.size(F.filter(F.coalesce(F.col(col), F.array().cast("array<bigint>")), lambda x: x >= 0)) > 0
    flag = df.agg(F.max(has.cast("int")).alias("__any"))
    return (df.crossJoin(F.broadcast(flag))
            .filter(has | (F.coalesce(F.col("__any"), F.lit(0)) == 0))
            .drop("__any"))
