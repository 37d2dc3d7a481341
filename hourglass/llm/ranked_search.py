"""Ranked lexical search by the Best Position Algorithm.

Every query text is ranked against all documents by a BM25-like sum of integer impacts, one impact for every term that
query and document share.  Three passes:

1. every document is cut into terms once and kept as (id, length, query terms that it holds, their counts) in a table
   of the shared folder; only terms of the queries are kept;
2. document count, total length and document frequencies are aggregated from that table;
3. every task deals its documents into blocks and runs the Best Position Algorithm for each query in each block.

An impact list holds the documents of a block with one term, highest impact first.  A round reads the next positions of
each of a query's lists; every document met for the first time is looked up directly in all the other lists, which
gives its whole score and its position in each of them.  The best position of a list is the last one before which all
have been seen, by either way; no unseen document scores above the sum of the impacts at the best positions.  A query
is done with a block when this sum is *strictly* below its k-th best score (an equal score may still win by its id) or
its lists are read.  The k best of a query go with the task from block to block, so later blocks stop early, most before
their first read.  Positions last read would give a higher sum, since looked-up documents often stand next in line.

Blocks bound the memory whatever the number of documents, and a term that every document holds has a list in every
block instead of one for all.  The k best of all tasks are merged per query in two steps.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches, stored

#: Bytes of query text that are ranked in one pass over the documents (a longer query has a pass of its own).
QUERY_BYTES = 512 << 10
#: Cells of the tables for direct access (distinct query terms times documents of a block), 12 bytes each.
CELLS = 4 << 20
#: Positions that the first round reads in each list; every further round reads twice as many.
FIRST_READ = 8
#: Parts of a query's candidates in the first step of the merge.
MERGE_PARTS = 64

_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")  # bytes of UTF-8 after lower-casing A-Z


def terms(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return _TERMS.findall(text.lower())  # bytes.lower changes A-Z only


class Queries:
    """Queries of one pass: their terms numbered, and (terms, repeats) of each query, one behind the other."""

    def __init__(self, texts: list[bytes | None]):
        counted = [Counter(terms(t or b"")) for t in texts]
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        self.offsets = np.cumsum([0, *map(len, counted)])
        self.terms = np.array([self.numbers[t] for c in counted for t in c], np.int64)
        self.repeats = np.array([n for c in counted for n in c.values()], np.int64)


def _postings(queries: Queries):
    """(id, length, terms, counts) of documents: the query terms that each holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = queries.numbers
        wanted = numbers.keys()
        for b in batches:
            length, held, counts, offsets = [], [], [], [0]
            for text in b.column(1).cast(pa.binary()):
                found = terms(text.as_py() or b"")
                tally = Counter(found)
                here = sorted((numbers[t], tally[t]) for t in tally.keys() & wanted)
                length.append(len(found))
                held += [t for t, _ in here]
                counts += [n for _, n in here]
                offsets.append(len(held))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(length, pa.int64()), pa.ListArray.from_arrays(at, pa.array(held, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))], ["id", "length", "terms", "counts"])
    return run


class Block:
    """Impact lists of some documents, and tables for direct access to a document's impact and position in a list."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, all_terms: int):
        here, row = np.unique(term, return_inverse=True)
        order = np.lexsort((doc, -impact, row))
        self.doc, self.impact, row = doc[order], impact[order], row[order]
        self.size = np.bincount(row, minlength=len(here))
        self.start = np.cumsum(self.size) - self.size
        self.row = np.full(all_terms, -1)  # of a term; -1 where no document has it
        self.row[here] = np.arange(len(here))
        self.highest = np.zeros(all_terms, np.int64)
        self.highest[here] = self.impact[self.start]
        self.value = np.zeros((len(here), size), np.int64)
        self.value[row, self.doc] = self.impact
        self.position = np.full((len(here), size), -1, np.int32)
        self.position[row, self.doc] = np.arange(len(row)) - self.start[row]
        self.reads = 0  # positions read in order

    def search(self, of: np.ndarray, repeats: np.ndarray, kth, offer) -> None:
        """Offer documents and scores until none unseen can reach the k-th best score.

        ``kth()`` is that score, or None while fewer than k documents are known.
        """
        rows = self.row[of]
        repeats, rows = repeats[rows >= 0], rows[rows >= 0]
        if not len(rows):
            return
        start, size = self.start[rows], self.size[rows]
        best = np.zeros(len(rows), np.int64)  # positions of each list that are seen without a gap
        seen = np.zeros((len(rows), int(size.max()) + 1), bool)
        met = np.zeros(self.value.shape[1], bool)
        read = FIRST_READ
        while (best < size).any():
            bound = (repeats * np.where(best < size, self.impact[start + np.maximum(best, 1) - 1], 0)).sum()
            least = kth()
            if least is not None and bound < least:
                return
            ends = np.minimum(best + read, size)
            self.reads += int((ends - best).sum())
            met_now = np.zeros_like(met)
            for a, b in zip((start + best).tolist(), (start + ends).tolist()):
                met_now[self.doc[a:b]] = True
            new = np.flatnonzero(met_now & ~met)
            met |= met_now
            if len(new):
                there = np.ix_(rows, new)
                at = self.position[there]
                held, which = np.nonzero(at >= 0)
                seen[held, at[held, which]] = True
                offer(new, repeats @ self.value[there])
            best = seen.argmin(axis=1)
            read *= 2


def _search(queries: Queries, weights: np.ndarray, n_docs: int, total: int, k: int, cells: int):
    """(query, id, score): the k best documents of this task for each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, kind = len(queries.offsets) - 1, None
        best: list[list[tuple]] = [[] for _ in range(count)]
        full = np.full(count, -1)  # the k-th best score; -1 while there are fewer
        block_size = max(1, cells // max(1, len(weights)))
        spans = list(zip(queries.offsets[:-1].tolist(), queries.offsets[1:].tolist()))
        for b in batches:
            kind = b.column(0).type
            for at in range(0, len(b), block_size):
                part = b.slice(at, block_size)
                ids, held = part.column(0), part.column(2)
                doc = np.repeat(np.arange(len(part)), np.diff(held.offsets.to_numpy()))
                if not len(doc):
                    continue
                term, tf = held.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                norm = np.array([25 + 75 * n * n_docs // total for n in part.column(1).to_pylist()], np.int64)
                impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[doc]))
                block = Block(len(part), doc, term, impact, len(weights))
                bounds = np.append(0, np.cumsum(queries.repeats * block.highest[queries.terms]))[queries.offsets]
                bounds = bounds[1:] - bounds[:-1]
                for i in np.flatnonzero((bounds > 0) & (bounds >= full)).tolist():
                    def offer(docs: np.ndarray, scores: np.ndarray, i=i) -> None:
                        good = np.flatnonzero((scores > 0) & (scores >= full[i]))
                        if len(good) > k:  # all that tie with the k-th best of them
                            good = good[scores[good] >= np.partition(scores[good], -k)[-k]]
                        named = ids.take(pa.array(docs[good])).to_pylist()
                        best[i] = sorted([*best[i], *zip((-scores[good]).tolist(), [x is not None for x in named], named)],
                                         key=_order)[:k]
                        if len(best[i]) == k:
                            full[i] = -best[i][-1][0]

                    a, z = spans[i]
                    block.search(queries.terms[a:z], queries.repeats[a:z],
                                 lambda i=i: int(full[i]) if full[i] >= 0 else None, offer)
        rows = [(i, x, -score) for i, found in enumerate(best) for score, _, x in found]
        for at in range(0, len(rows), 10_000):
            query, ids, scores = zip(*rows[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, kind), pa.array(scores, pa.int64())],
                                             ["query", "id", "score"])
    return run


def _order(found: tuple):
    """Highest score first, then null ids, then ids upwards."""
    score, there, name = found
    return (score, there, name) if there else (score, there)


def _best(found: DataFrame, k: int) -> DataFrame:
    """``found`` with its rank within every query, the k best of each."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_first()]
    part = F.pmod(F.xxhash64("id"), F.lit(MERGE_PARTS))
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", part).orderBy(*order))).where(
        F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(
        F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", cells: int = CELLS,
         query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` highest-scoring documents of every item, equal scores by ascending id.

    With N documents that have a term, L terms in all, n in the document and df documents that hold a term, the term's
    weight is floor(1000 ln((2N + 2) / (2 df + 1))), and it adds weight * (10**9 tf div (1000 tf + 8 m)) for each of its
    places in the item, where m = 25 + (75 n N) div L.  Documents without score are no result, so an item may have fewer
    than ``k`` rows or none.

    A null or empty text has no terms, on either side, and a document without terms is not counted.  Every row is a
    document and every row of ``items`` an item of its own: equal documents tie, a repeated item has its rows again.  A
    null id is kept and stands before others of its score.  Empty tables give an empty result.  Other columns are not
    read, whatever their names.  ``docs`` are read once for every ``query_bytes`` of item text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_col)))
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    volume = asked.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    passes = -(-volume // query_bytes)
    results = [spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score bigint")]
    for number in range(passes):
        # one pass's items: bounded by query_bytes, whatever the number of documents
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == number).orderBy("item", "text").collect()
        queries = Queries([r["text"].encode() if r["text"] else None for r in part])
        if not queries.numbers:
            continue
        postings = stored(told.mapInArrow(_postings(queries), f"id {kind}, length bigint, terms array<int>, counts array<bigint>"),
                          "postings")
        sums = postings.agg(F.count_if(F.col("length") > 0), F.sum("length")).first()
        held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row per query term
        if not held:
            continue
        frequency = np.zeros(len(queries.numbers), np.int64)
        frequency[[r["term"] for r in held]] = [r["count"] for r in held]
        weights = np.array([math.floor(1000 * math.log((2 * sums[0] + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
        found = postings.mapInArrow(_search(queries, weights, sums[0], sums[1], k, cells), f"query int, id {kind}, score bigint")
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(part)], f"query int, item {item_kind}")
        results.append(_best(found, k).join(F.broadcast(names), "query").select("item", "rank", "id", "score"))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
