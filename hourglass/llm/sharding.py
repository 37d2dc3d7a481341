"""Sharding by sampled splitters, under the law that shard sizes are near equal (``bytes``).

Records are ordered by the key (hash of the text, id, row number), so equal texts lie together.
A bounded sample is drawn by size (a record's chance follows its bytes), its quantiles split the
key range into several ranges per shard, and the records' exact bytes are summed by range.  A
range above ``OVERFULL`` times the mean is subdivided by a sample of its own, until none is.
Within a range, records are then put in order, and with the bytes of the ranges before it each
record knows its place in the whole: shard k takes the records whose middle byte lies in the k-th
equal part of all bytes, so the boundaries between shards fall inside ranges where they must.

Only (id, hash, size, crc) are moved; a range is a bounded share of all records however many
copies one text has, because the id and the row number are parts of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourglass.llm.common import stored

SHARDS = 24
HEADER = 8
#: Ranges: RANGE_BYTES of records each, at least RANGES_PER_SHARD by shard, at most MAX_RANGES.
RANGE_BYTES = 64 << 20
RANGES_PER_SHARD = 8
MAX_RANGES = 4_096
#: Sampled keys for each range wanted (so the driver holds at most MAX_RANGES * SAMPLES keys).
SAMPLES = 16
OVERFULL = 2.0
ROUNDS = 4
SEED = 17
LAW = "bytes"

_KEY = np.dtype([("h", np.int64), ("id", np.int64), ("row", np.int64)])


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` keys, sorted: without replacement, the chance of a row following its size."""
    u = (F.shiftrightunsigned(F.xxhash64("h", "sort_id", "row", F.lit(SEED)), 11) + 1) / F.lit(float(1 << 53))
    got = (rows.select("h", "sort_id", "row", (-F.log(u) / F.col("size")).alias("rank"))
           .orderBy("rank", "h", "sort_id", "row").limit(n).collect())
    return np.sort(np.array([(r["h"], r["sort_id"], r["row"]) for r in got], _KEY))


def _quantiles(sample: np.ndarray, parts: int) -> np.ndarray:
    if not len(sample) or parts < 2:
        return np.empty(0, _KEY)
    return np.unique(sample[[len(sample) * i // parts for i in range(1, parts)]])


def _with_range(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` with ``range``: the number of splitters at or below the key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, i, r = (b.column(n).to_numpy() for n in ("h", "sort_id", "row"))
            at = np.searchsorted(splitters["h"], h, "left")
            tied = np.flatnonzero(at < np.searchsorted(splitters["h"], h, "right"))
            if len(tied):  # a splitter has the same hash: compare whole keys
                keys = np.empty(len(tied), _KEY)
                keys["h"], keys["id"], keys["row"] = h[tied], i[tied], r[tied]
                at[tied] = np.searchsorted(splitters, keys, "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], [*b.schema.names, "range"])
    return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", range bigint")


def _ranges(rows: DataFrame, total: int, shards: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """``rows`` with their range, and (bytes, rows) by range; overfull ranges are subdivided."""
    wanted = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES)))
    mean = max(1, total / wanted)
    splitters = _quantiles(_sample(rows, wanted * SAMPLES), wanted)
    for last in (*[False] * ROUNDS, True):
        ranged = _with_range(rows, splitters)
        sizes = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}  # one row per range
        full = {k: n for k, (b, n) in sizes.items() if b > OVERFULL * mean and n > 1}
        room = 2 * MAX_RANGES - len(splitters)
        if last or not full or room <= 0:
            return ranged, sizes
        more = []
        for k in sorted(full, key=lambda k: -sizes[k][0])[:64]:
            parts = min(room, -(-int(sizes[k][0]) // int(mean)))
            got = _quantiles(_sample(ranged.where(F.col("range") == k), parts * SAMPLES), parts)
            more.append(got)
            room -= len(got)
        grown = np.unique(np.concatenate([splitters, *more]))
        if len(grown) == len(splitters):
            return ranged, sizes
        splitters = grown
    raise AssertionError("unreachable")


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``size`` is the UTF-8 length of the text plus HEADER; shards differ in bytes by about one
    record; ``slot`` counts the records of a shard from 0 without gaps in key order;
    ``grown_shard`` is null under this law.  A null text has no bytes and the CRC of the empty text; a
    null id sorts first and is kept; repeated rows take a slot each; an empty table gives an empty
    result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("sort_id"),
        F.xxhash64(text).alias("h"), (F.octet_length(text) + HEADER).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    ranged, sizes = _ranges(rows, total, shards)
    before, bytes_before, rows_before = [], 0, 0
    for k in sorted(sizes):
        before.append((k, bytes_before, rows_before))
        bytes_before += sizes[k][0]
        rows_before += sizes[k][1]
    starts = docs.sparkSession.createDataFrame(before, "range bigint, b0 bigint, n0 bigint")  # at most 2 * MAX_RANGES rows
    order = Window.partitionBy("range").orderBy("h", "sort_id", "row")
    placed = (ranged.withColumn("n", F.row_number().over(order).cast("long"))
              .withColumn("b", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .join(F.broadcast(starts), "range")
              .withColumn("place", F.col("n0") + F.col("n") - 1)
              # twice the middle byte, so that everything stays whole numbers
              .withColumn("middle", (2 * (F.col("b0") + F.col("b")) - F.col("size")).cast("decimal(30,0)")))
    shard = F.floor(F.col("middle") * F.lit(shards) / F.lit(2 * max(total, 1)).cast("decimal(30,0)")).cast("int")
    placed = stored(placed.select("id", "size", "text_crc32", F.least(shard, F.lit(shards - 1)).alias("shard"), "place", "row"),
                    "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return (placed.join(F.broadcast(first), "shard")
            .select(F.col("id").alias(id_col), "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                    (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents, with their columns, shard and slot, one folder per shard in slot order.

    Rows are matched with their places by id and text; the k-th of repeated rows takes the k-th place.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    same = Window.partitionBy("__id", "__crc")
    place = (assign_shards(docs, shards, id_col, text_col)
             .select(F.col(id_col).alias("__id"), F.col("text_crc32").alias("__crc"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
             .withColumn("__k", F.row_number().over(same.orderBy("__shard", "__slot"))))
    told = (docs.withColumns({"__id": F.col(id_col).cast("long"), "__crc": crc})
            .withColumn("__k", F.row_number().over(same.orderBy(F.xxhash64(*docs.columns)))))
    on = [told["__id"].eqNullSafe(place["__id"]), told["__crc"] == place["__crc"], told["__k"] == place["__k"]]
    out = told.join(place, on).select(*[told[c] for c in docs.columns], "__shard", "__slot")
    (out.repartition(shards, "__shard").sortWithinPartitions("__shard", "__slot")
     .withColumnsRenamed({"__shard": "shard_number", "__slot": "slot_number"})
     .write.mode("errorifexists").partitionBy("shard_number").parquet(path))
