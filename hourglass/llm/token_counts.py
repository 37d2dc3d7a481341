"""Edit-aware token counts over segment trees of pre-tokens.

A document's text is cut into pre-tokens (the tokenizer's own split), and up to ``LEAF`` of them in
a row form a leaf of a segment tree whose nodes hold the characters and tokens of their subtree.
The tree is kept with the document.  An edit finds its leaves by descending the character sums,
encodes anew only those leaves, one character of context before and as many following leaves as
it takes for the pre-token boundaries to meet the old ones, and updates the sums on the way to
the root.

Why that suffices: a pre-token is matched from its first character on and looks at most one
character past its end, so pre-tokens that end two or more characters before the edit stay; and
once a new boundary falls on an old one behind the edit, all later ones do.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourglass.llm.common import bounded_batches

LEAF = 64
#: A leaf that grows beyond so many pre-tokens is dealt out anew with the whole tree.
MAX_LEAF = 16 * LEAF
CACHE_PIECES = 400_000
EDIT = "struct<start:bigint,length:bigint,insert:string>"


class Counter:
    """Tokens of pre-tokens, each encoded once per cache."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def tokens(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            if len(piece) <= 64:
                self.known[piece] = n
        return n


_counters: dict[tuple[str, str], Counter] = {}  # of this worker


def counter(ranks_path: str, pattern: str) -> Counter:
    key = (ranks_path, pattern)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


class Tree:
    """Segment tree over leaves: ``chars`` and ``tokens`` in heap order, ``pieces`` by leaf."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray, pieces: np.ndarray):
        self.width = 1 << max(0, (max(1, len(chars)) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width:self.width + len(chars), 0] = chars
        self.sums[self.width:self.width + len(chars), 1] = tokens
        self.pieces = np.zeros(self.width, np.int64)
        self.pieces[:len(pieces)] = pieces
        w = self.width
        while w > 1:
            self.sums[w // 2:w] = self.sums[w:2 * w].reshape(-1, 2, 2).sum(1)
            w //= 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` and the characters before it (the last leaf beyond the end)."""
        k, before = 1, 0
        while k < self.width:
            k *= 2
            left = int(self.sums[k, 0])
            if at - before >= left and (self.sums[k + 1, 0] or at - before > left):
                before += left
                k += 1
        return k - self.width, before

    def set(self, leaf: int, chars: int, tokens: int, pieces: int) -> None:
        self.pieces[leaf] = pieces
        k = leaf + self.width
        change = np.array((chars, tokens)) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2

    def to_bytes(self) -> bytes:
        leaves = np.column_stack((self.sums[self.width:], self.pieces))
        last = int(np.flatnonzero(leaves.any(1)).max(initial=-1)) + 1
        return leaves[:last].astype("<i8").tobytes()

    @staticmethod
    def from_bytes(raw: bytes) -> Tree:
        leaves = np.frombuffer(raw, "<i8").reshape(-1, 3)
        return Tree(leaves[:, 0], leaves[:, 1], leaves[:, 2])


def build(text: str, count: Counter) -> Tree:
    pieces = count.split.findall(text)
    tokens = np.fromiter(map(count.tokens, pieces), np.int64, len(pieces))
    chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
    cuts = np.arange(0, len(pieces), LEAF)
    if not len(cuts):
        return Tree(np.empty(0), np.empty(0), np.empty(0))
    return Tree(np.add.reduceat(chars, cuts), np.add.reduceat(tokens, cuts), np.diff(np.append(cuts, len(pieces))))


class Edited:
    """A document under edits: its tree and the text by leaf."""

    def __init__(self, text: str, tree: Tree, count: Counter):
        self.tree, self.count = tree, count
        ends = np.cumsum(tree.sums[tree.width:, 0]).tolist()
        if (ends[-1] if ends else 0) != len(text):
            raise ValueError("the tree does not belong to the text")
        self.leaves = [text[a:b] for a, b in zip([0, *ends], ends)]
        self.encoded = 0  # characters encoded anew

    def text(self) -> str:
        return "".join(self.leaves)

    def apply(self, start: int, length: int, insert: str) -> None:
        """Replace ``length`` characters from ``start`` on; both are cut off at the end of the text."""
        tree, n = self.tree, self.tree.chars
        start = min(max(start, 0), n)
        end = min(start + max(length, 0), n)
        first, before = tree.find(max(start - 2, 0))
        last, before_last = tree.find(max(end - 1, start - 1, 0))
        old = "".join(self.leaves[first:last + 1])
        new = old[:start - before] + insert + old[end - before:]
        edit_end = start - before + len(insert)  # old boundaries at or behind it may be met again
        stops = [len(new)]  # ends of the leaves taken so far, in the new text
        while True:
            after = last + 1
            while after < tree.width and not self.leaves[after]:
                after += 1
            tail = self.leaves[after] if after < tree.width else ""
            pieces, at, met = [], 0, not tail
            for m in self.count.split.finditer(new + tail):
                if m.start() >= len(new):
                    break
                pieces.append(m.group())
                at = m.end()
            met = met or (at == len(new) and len(tail) > 1 and len(new) >= edit_end)
            if met:
                break
            new, last = new + tail, after
        if len(pieces) > MAX_LEAF:
            self.leaves[first] = new
            for k in range(first + 1, last + 1):
                self.leaves[k] = ""
            text = self.text()
            self.tree = build(text, self.count)
            self.encoded += len(text)
            ends = np.cumsum(self.tree.sums[self.tree.width:, 0]).tolist()
            self.leaves = [text[a:b] for a, b in zip([0, *ends], ends)]
            return
        self.encoded += len(new)
        self.leaves[first] = new
        tree.set(first, len(new), sum(map(self.count.tokens, pieces)), len(pieces))
        for k in range(first + 1, last + 1):
            self.leaves[k] = ""
            tree.set(k, 0, 0, 0)


def count_tokens(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``token_tree`` (leaves as little-endian long triples:
    characters, tokens, pre-tokens).  A null or empty text has no tokens and an empty tree."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_tokens", "token_tree")]
    docs = docs.select(kept)
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks_path, pattern)
        for b in batches:
            trees = [build(t.as_py() or "", count) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([t.tokens for t in trees], pa.int64()), pa.array([t.to_bytes() for t in trees], pa.binary())],
                [*b.schema.names, "n_tokens", "token_tree"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_tokens", T.LongType()),
                                              T.StructField("token_tree", T.BinaryType())]))


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with its edits (id_col, seq, start, length, insert) as an array in order of seq.

    A document and its edits are one unit of work, like its text.  Edits of unknown ids are ignored.
    """
    listed = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(
        F.struct("seq", "start", "length", "insert"))).alias("e"))
    return docs.join(listed, id_col, "left").withColumn("edits", F.transform(
        "e", lambda x: F.struct(x.start.cast("bigint").alias("start"), x.length.cast("bigint").alias("length"), x.insert.alias("insert")))).drop("e")


def apply_edits(counted: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                edits_col: str = "edits") -> DataFrame:
    """(id_col, text_col, n_tokens, token_tree, n_edits, encoded_chars) after the edits of each row.

    ``counted`` comes from ``count_tokens`` and has an array of {start, length, insert} in code
    points of the text as the edits before left it.  Positions and lengths are cut off at the ends
    of the text, nulls count as 0 and as the empty insert, a null array or edit changes nothing.
    A null text is empty.  ``encoded_chars`` counts the characters that were encoded anew.
    """
    bounded_batches(counted.sparkSession)
    told = counted.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                          "token_tree", F.col(edits_col).alias("e"))
    kind = dict(told.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks_path, pattern)
        for b in batches:
            out = []
            for text, tree, edits in zip(b.column("t"), b.column("token_tree"), b.column("e").to_pylist()):
                doc = Edited(text.as_py(), Tree.from_bytes(tree.as_py()), count)
                edits = [e for e in edits or [] if e is not None]
                for e in edits:
                    doc.apply(e["start"] or 0, e["length"] or 0, e["insert"] or "")
                out.append((doc.text(), doc.tree.tokens, doc.tree.to_bytes(), len(edits), doc.encoded))
            cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64()))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column("id"), *cols],
                                                 ["id", "text", "n_tokens", "token_tree", "n_edits", "encoded_chars"])

    done = told.mapInArrow(run, f"id {kind}, text string, n_tokens bigint, token_tree binary, n_edits bigint, encoded_chars bigint")
    return done.withColumnsRenamed({"id": id_col, "text": text_col})
