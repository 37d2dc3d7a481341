"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A table applies ``n_hashes`` pseudo-random rotations (three rounds of random signs and a fast
Walsh-Hadamard transform) to the zero-padded vector; each rotation's hash is the signed axis
with the largest absolute coordinate.  A vector lies in its own bucket and in ``probes`` further
buckets, those whose axis is next best, and a pair is a candidate if they meet in a bucket that
is the own one of either.  Candidates are verified by cosine in double precision.

The number of hashes grows with the logarithm of the number of vectors, so that a bucket holds
about ``BUCKET`` unrelated vectors at any size, and the number of tables follows from the chance
``P_AXIS`` that one hash agrees at the linking cosine.

Equal vectors are one class.  A pair found in several tables is counted in the first one only:
every task can tell from the two vectors whether they met before.  So a task returns counts by
vector and a spanning forest of its links, never the pairs.  A bucket above ``BLOCK`` members
is split into blocks, and each pair of blocks is its own group of work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches, stored
from hourglass.llm.components import components

THRESHOLD = 0.95
BUCKET = 8
BLOCK = 2_048
#: Buckets up to this size are compared many at a time.
SMALL = 64
PROBES = 1
P_AXIS = 0.75
MISS = 0.01


class Hasher:
    """Bucket numbers of row vectors in ``tables`` tables of ``hashes`` rotations each."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        rng = np.random.default_rng(seed)
        self.signs = rng.choice((-1.0, 1.0), (tables, hashes, 3, self.width))

    def _rotate(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = x * s
            h = 1
            while h < self.width:
                x = x.reshape(len(x), -1, 2, h)
                x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(len(x), self.width)
                h *= 2
        return x

    def codes(self, x: np.ndarray, table: int) -> np.ndarray:
        """(rows, 1 + probes): the own bucket first, then those of the next best axes."""
        padded = np.zeros((len(x), self.width))
        padded[:, :self.dim] = x
        best, loss, swap = [], [], []
        for k in range(self.hashes):
            y = self._rotate(padded, self.signs[table, k])
            a = np.abs(y)
            top = np.argpartition(-a, 1, axis=1)[:, :2]
            rows = np.arange(len(y))
            flip = a[rows, top[:, 0]] < a[rows, top[:, 1]]
            top[flip] = top[flip][:, ::-1]
            code = 2 * top + (y[rows[:, None], top] < 0)
            size = a[rows[:, None], top]
            best.append(code[:, 0])
            swap.append(code[:, 1])
            loss.append((size[:, 0] - size[:, 1]) / np.maximum(size[:, 0], 1e-300))
        base = 2 * self.width
        own = np.zeros(len(x), np.int64)
        for c in best:
            own = own * base + c
        out = [own]
        order = np.argsort(np.stack(loss, 1), axis=1, kind="stable")
        place = np.array([base ** (self.hashes - 1 - k) for k in range(self.hashes)], np.int64)
        step = (np.stack(swap, 1) - np.stack(best, 1)) * place
        for p in range(min(self.probes, self.hashes)):
            out.append(own + step[np.arange(len(x)), order[:, p]])
        return np.stack(out, 1)


def plan_tables(n: int, dim: int) -> tuple[int, int]:
    """(tables, hashes) for ``n`` vectors: buckets of about BUCKET, a miss chance of MISS."""
    base = 2 << max(1, (dim - 1).bit_length())
    hashes = max(1, min(math.ceil(math.log(max(n, 2) / BUCKET) / math.log(base)), int(62 // math.log2(base))))
    return max(2, math.ceil(math.log(MISS) / math.log(1 - P_AXIS ** hashes))), hashes


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucket_entries(dim: int, tables: int, hashes: int, probes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim, tables, hashes, probes, seed)
        for b in batches:
            if not len(b):
                continue
            x = _unit(_matrix(b.column(1)))
            for t in range(tables):
                codes = hasher.codes(x, t)
                for p in range(codes.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(codes[:, p]),
                         pa.array(np.full(len(x), p == 0))], ["cid", "table", "code", "own"])
    return run


def _met_before(x: np.ndarray, r: np.ndarray, c: np.ndarray, own: np.ndarray, table: np.ndarray,
                hasher: Hasher) -> np.ndarray:
    """Whether the vectors of each pair (r, c) met earlier: in a table before this one, or in
    this one if each probes the other's own bucket and this bucket has the larger number."""
    met = np.zeros(len(r), bool)
    if not len(r):
        return met
    left, right = own[r], own[c]
    used, where = np.unique(np.concatenate((r, c)), return_inverse=True)
    r, c = where[:len(r)], where[len(r):]
    for t in range(int(table.max()) + 1):
        k = hasher.codes(x[used], t)
        a, b = (k[c] == k[r, :1]).any(1), (k[r] == k[c, :1]).any(1)
        met |= (t < table) & (a | b)
        met |= (t == table) & a & b & ((left & ~right & (k[r, 0] > k[c, 0])) | (right & ~left & (k[c, 0] > k[r, 0])))
    return met


def _small_buckets(tbl: pa.Table, hasher: Hasher, threshold: float) -> list:
    """Many whole buckets of up to SMALL rows: links by comparing rows at each distance."""
    key, rep, copies = (tbl[n].to_numpy() for n in ("key", "cid", "copies"))
    own, table = tbl["own"].to_numpy(), tbl["table"].to_numpy()
    side, whole = tbl["side"].to_numpy(), tbl["i"].to_numpy() == tbl["j"].to_numpy()
    x = _unit(_matrix(tbl["v"].combine_chunks()))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in range(1, len(key)):
        r = np.flatnonzero(key[:-d] == key[d:])
        if not len(r):
            break
        r = r[(own[r] | own[r + d]) & (whole[r] | (side[r] != side[r + d]))]
        r = r[np.einsum("ij,ij->i", x[r], x[r + d]) >= threshold]
        left.append(r)
        right.append(r + d)
    r, c = np.concatenate(left), np.concatenate(right)
    fresh = ~_met_before(x, r, c, own, table[r], hasher)
    r, c = r[fresh], c[fresh]
    count = np.zeros(len(key), np.int64)
    np.add.at(count, r, copies[c])
    np.add.at(count, c, copies[r])
    root: dict = {}

    def find(v):
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    joined = []
    for u, v in zip(rep[r].tolist(), rep[c].tolist()):
        fu, fv = find(u), find(v)
        if fu != fv:
            root[fu] = fv
            joined.append((u, v, -1))
    some = np.flatnonzero(count)
    out = [(rep[some], np.zeros(len(some), np.int64), count[some])]
    if joined:
        out.append(tuple(np.array(z) for z in zip(*joined)))
    return out


def _large_bucket(tbl: pa.Table, hasher: Hasher, threshold: float) -> list:
    """One bucket, or one pair of its blocks: links by blocks of rows against all of them."""
    t, i, j = (tbl[n][0].as_py() for n in ("table", "i", "j"))
    rep, copies, side = (tbl[n].to_numpy() for n in ("cid", "copies", "side"))
    own = tbl["own"].to_numpy()
    x = _unit(_matrix(tbl["v"].combine_chunks()))
    *codes, here = [hasher.codes(x, k) for k in range(t + 1)]
    n = len(rep)
    count, label = np.zeros(n, np.int64), np.arange(n)
    src, dst = [], []
    for at in range(0, n, 256):
        rows = slice(at, min(at + 256, n))
        ok = x[rows] @ x.T >= threshold
        ok[np.arange(ok.shape[0]), np.arange(rows.start, rows.stop)] = False
        if i != j:  # pairs within one block belong to the group of that block with itself
            ok &= side[rows][:, None] != side[None, :]
        ok &= own[rows][:, None] | own[None, :]
        for k in codes:
            for p in range(k.shape[1]):
                ok &= (k[rows, :1] != k[None, :, p]) & (k[rows, p:p + 1] != k[None, :, 0])
        r, c = np.nonzero(ok & (own[rows][:, None] != own[None, :]))  # they may meet in two buckets of this table
        k, m = here[rows][r], here[c]
        twice = (m == k[:, :1]).any(1) & (k == m[:, :1]).any(1)
        later = twice & np.where(own[rows][r], k[:, 0] > m[:, 0], m[:, 0] > k[:, 0])
        ok[r[later], c[later]] = False
        count[rows] = ok @ copies
        for a in np.flatnonzero(ok.any(1)):  # a link is passed on only if it joins two groups
            near = np.flatnonzero(ok[a])
            other, first = np.unique(label[near], return_index=True)
            fresh = other != label[rows.start + a]
            if fresh.any():
                src.append(np.full(fresh.sum(), rep[rows.start + a]))
                dst.append(rep[near[first[fresh]]])
                label[np.isin(label, other[fresh])] = label[rows.start + a]
    some = np.flatnonzero(count)
    out = [(rep[some], np.zeros(len(some), np.int64), count[some])]
    if src:
        a, b = np.concatenate(src), np.concatenate(dst)
        out.append((a, b, np.full(len(a), -1)))
    return out


def _verify(dim: int, tables: int, hashes: int, probes: int, seed: int, threshold: float):
    """Verified links of rows sorted by key: counts by vector (n >= 0) and a spanning forest (-1).

    Holds one bucket (at most two blocks) or a few thousand rows of small ones at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim, tables, hashes, probes, seed)

        def out(found: list):
            for a, b, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in (a, b, n)], ["a", "b", "n"])

        def work(tbl: pa.Table):
            key = tbl["key"].to_numpy()
            cuts = np.array([0, *(np.flatnonzero(np.diff(key)) + 1), len(key)])
            sizes = np.diff(cuts)
            few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            if few.any():
                yield from out(_small_buckets(tbl.filter(pa.array(few)), hasher, threshold))
            for k in np.flatnonzero(sizes > SMALL):
                yield from out(_large_bucket(tbl.slice(int(cuts[k]), int(sizes[k])), hasher, threshold))

        held, n = [], 0
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("key").to_numpy()
            at = np.flatnonzero(np.diff(key)) + 1
            if n and key[0] != held[-1].column("key")[-1].as_py():
                at = np.concatenate(([0], at))
            if len(at) and n + int(at[-1]) >= 2_000:  # all but the last bucket is complete
                cut = int(at[-1])
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held))
                held, batch, n = [], batch.slice(cut), 0
            held.append(batch)
            n += len(batch)
        if held:
            yield from work(pa.Table.from_batches(held))
    return run


def valid(v: Column) -> Column:
    """True for a non-empty, non-zero vector without null, NaN or infinite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _links_of_dim(classes: DataFrame, dim: int, n: int, threshold: float, probes: int, block: int, seed: int) -> DataFrame:
    tables, hashes = plan_tables(n, dim)
    plan = (dim, tables, hashes, probes, seed)
    cols = ["key", "cid", "v", "copies", "table", "own", "side", "i", "j"]
    none = F.lit(0)
    entries = stored(classes.select("cid", "v").mapInArrow(
        _bucket_entries(*plan), "cid bigint, table int, code bigint, own boolean"), "vector-buckets")
    # buckets are counted without their members, map-side first; only members of buckets with company get their vectors
    sizes = entries.groupBy("table", "code").agg(F.count("*").alias("n")).where("n > 1")
    entries = stored(entries.join(sizes, ["table", "code"]), "vector-candidates")

    def with_vectors(rows: DataFrame) -> DataFrame:
        return rows.join(classes.select("cid", "v", "copies"), "cid").select(cols)

    small = (entries.where(F.col("n") <= block)
             .withColumns({"key": F.xxhash64("table", "code"), "side": none, "i": none, "j": none})
             .transform(with_vectors).repartition("key").sortWithinPartitions("key")
             .mapInArrow(_verify(*plan, threshold), "a bigint, b bigint, n bigint"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1),
                        lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    hot = (entries.where(F.col("n") > block)
           .select("*", mine.alias("side"), F.explode(pairs).alias("g"))
           .withColumns({"key": F.xxhash64("table", "code", "g.i", "g.j"), "i": F.col("g.i"), "j": F.col("g.j")})
           .transform(with_vectors).repartition("key").sortWithinPartitions("key")
           .mapInArrow(_verify(*plan, threshold), "a bigint, b bigint, n bigint"))
    return small.union(hot)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = THRESHOLD, probes: int = PROBES, block: int = BLOCK,
                    seed: int = 7) -> DataFrame:
    """(id_col, n_links, component_id, kept) of every row.

    ``n_links`` counts the other rows whose cosine with this one was found to be at least
    ``threshold`` (never one below it); ``component_id`` is the smallest id reachable by links,
    ``kept`` whether that is the row itself.  Null, empty and zero vectors, those with a null or
    non-finite component and rows without an id link with nothing (a null id gives a null
    component and ``kept`` true).  Vectors of different lengths never link.  Rows that repeat an
    id are separate vectors; an empty table gives an empty result; other columns are not read.
    """
    bounded_batches(vectors.sparkSession)
    v = F.col(vec_col)
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    rows = stored(vectors.select(
        F.col(id_col).alias("id"),
        F.when(valid(v) & F.col(id_col).isNotNull(), F.transform(v, lambda x: x + F.lit(0).cast(kind))).alias("v")), "vectors")
    classes = stored(rows.where("v IS NOT NULL").groupBy("v")
                     .agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
                     .withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    dims = classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()  # one row per vector length
    found = None
    for d in dims:
        part = _links_of_dim(classes.where(F.size("v") == d.d), d.d, d["count"], threshold, probes, block, seed)
        found = part if found is None else found.union(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    found = stored(found, "vector-links")
    counts = found.where("n >= 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    comp = components(found.where("n < 0").select("a", "b")).withColumnRenamed("node", "cid")
    member = classes.join(counts, "cid", "left").join(comp, "cid", "left").select(
        "v", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "cid").alias("component"))
    lowest = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stored(member.join(lowest, "component").select("v", "n_links", "component_id"), "vector-named")
    linked = rows.where("v IS NOT NULL").join(named, "v").select("id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

