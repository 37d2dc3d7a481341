"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most four bits agree in at least four of their eight
bytes.  The index therefore files every distinct fingerprint under positional bytes and a pair
is a candidate if its tally of shared positional bytes reaches that guaranteed minimum; the
bit distance of a candidate is then counted.

Postings under one byte each would put N/256 fingerprints into a list.  They are filed under
*three* positional bytes at a time instead: the eight positions fall into parts of 3, 3 and 2,
and the 20 triples "inside one part" or "two of a part and one of the next" meet every set of
four positions, so every pair with four common bytes still shares a list and a list holds
N / 2^24 unrelated fingerprints.

Equal fingerprints are one class from the start, and only links between classes that join two
groups are passed on (a spanning forest of each list), so no output grows with the square of a
list.  A list above ``BLOCK`` members is split into blocks, and each pair of blocks is its own
group of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches, stored
from hourglass.llm.components import components
from hourglass.operators.joins import broadcast_if_small

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Members of a list that one task compares with each other; a longer list is split.
BLOCK = 4_096

_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = tuple(sorted({tuple(sorted(t)) for part in _PARTS for t in combinations(part, 3)} | {
    tuple(sorted((*two, one))) for i, part in enumerate(_PARTS)
    for two in combinations(part, 2) for one in _PARTS[(i + 1) % 3]}))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text; 0 if it has no word.

    ``bytes.lower`` and ``bytes.split`` touch A-Z and the six ASCII white-space bytes only.
    """
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first = (ends - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    last = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(first), 65_536):
        h = np.array([digest(flat[s:e], SEED) for s, e in zip(first[i:i + 65_536], last[i:i + 65_536])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of every row's whole text (null text: 0)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = dict(docs.select(F.col(id_col).alias("id")).dtypes)["id"]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(
        run, f"id {kind}, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _postings(fps: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under the number and the bytes of each position triple."""
    fp = F.col("fp")
    keys = [F.lit(i).cast("long") * (1 << 24) + _byte(fp, a) * 65_536 + _byte(fp, b) * 256 + _byte(fp, c)
            for i, (a, b, c) in enumerate(TRIPLES)]
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def forest(fps: np.ndarray, max_bits: int, shared_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one list, found breadth first.

    Each reached fingerprint is compared with those not reached yet: the shared positional
    bytes are tallied, pairs below the minimum dropped, and the bit distance of the rest counted.
    """
    left, src, dst = fps, [], []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            one = front.pop()
            diff = left ^ one
            tally = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = tally >= shared_bytes
            near[near] = np.bitwise_count(diff[near]) <= max_bits
            if near.any():
                got = left[near]
                src.append(np.full(len(got), one))
                dst.append(got)
                front.extend(got)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate(src or [none]), np.concatenate(dst or [none])


def _edges_of(lists: list[np.ndarray], max_bits: int) -> pa.RecordBatch:
    found = [forest(x, max_bits, 8 - max_bits) for x in lists]
    a, b = (np.concatenate([f[i] for f in found] or [np.empty(0, np.uint64)]).view(np.int64) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _within_lists(max_bits: int):
    """Links within each row's list of fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy().view(np.uint64)
            at = batch.column(0).offsets.to_numpy() - batch.column(0).offsets[0].as_py()
            two = np.diff(at) == 2  # the common case, all at once
            a, b = flat[at[:-1][two]], flat[at[:-1][two] + 1]
            diff = a ^ b
            ok = ((diff.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= 8 - max_bits) & (np.bitwise_count(diff) <= max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], ["a", "b"])
            yield _edges_of([flat[at[i]:at[i + 1]] for i in np.flatnonzero(~two)], max_bits)
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fps``, enough to connect every group.

    Every pair of at most ``max_bits`` (0 to 4) differing bits is connected by the returned
    links, and each returned link is such a pair.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees four shared bytes only up to 4 differing bits")
    bounded_batches(fps.sparkSession)
    lists = _postings(fps)
    # counted map-side; only lists above a block are known by name, at most their share of the postings
    hot = stored(lists.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-hot")
    small = lists.join(broadcast_if_small(hot), "key", "left_anti")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1),
                         lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    large = (lists.join(broadcast_if_small(hot), "key")
             .select("key", "fp", F.explode(others).alias("g"))
             .select(F.xxhash64("key", "g.i", "g.j").alias("key"), "fp"))

    def linked(rows: DataFrame) -> DataFrame:  # a list, or a pair of its blocks, has about two blocks at most
        grouped = rows.groupBy("key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        return grouped.select("fps").mapInArrow(_within_lists(max_bits), "a bigint, b bigint")

    return linked(small).union(linked(large)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` the smallest id reachable
    over links of at most ``max_bits`` differing bits, the row's own included.  Null and
    wordless texts have fingerprint zero and link like any other.  A null id keeps its row but
    names no component (null only if the whole component has no id).  Repeated ids keep one row
    each; an empty table gives an empty result; other columns are not read.
    """
    fps = stored(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-classes")
    comp = components(links(classes.select("fp"), max_bits))
    member = (classes.join(comp, classes.fp == comp.node, "left")
              .select(classes.fp, "first_id", F.coalesce("component", classes.fp).alias("component")))
    lowest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(member.join(lowest, "component").select("fp", "component_id"), "simhash-named")
    return (fps.join(named, "fp")
            .select(F.col("id").alias(id_col),
                    F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents whose id is the smallest of their component, with their columns.

    Rows without an id, which no component can name, are kept.  Rows that repeat a kept id are
    one document: the row with the smallest hash over all columns stays.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle, max_bits)
    first = stored(groups.where(F.col(id_col) == F.col("component_id")).groupBy(id_col)
                   .agg(F.count("*").alias("__rows")), "simhash-first")
    found = docs.join(first.hint("merge"), id_col)  # as many ids as documents: never broadcast
    once = found.where("__rows = 1").select(docs.columns)
    again = found.where("__rows > 1").withColumn("__hash", F.xxhash64(*docs.columns))
    pick = again.groupBy(id_col).agg(F.min("__hash").alias("__hash"))
    again = again.join(pick, [id_col, "__hash"]).select(docs.columns).distinct()
    return once.union(again).union(docs.where(F.col(id_col).isNull()))
