"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the tokenizer's pattern, and every match is encoded on its own: one that is a token as it stands is
that token, every other starts as single bytes whose neighbours are merged, always the pair of lowest rank and of
these the leftmost, until no two neighbours form a token.

The symbols are a doubly linked list over byte positions.  A queue holds one bucket per merge rank, with the positions
of the pairs that have this rank, and a bitmap of the buckets that hold any; a word of a higher level has a bit for
every word of the level below that is not zero, so the lowest rank is found by one find-first-set per level.  A merge
files its two new neighbour pairs and leaves the old ones where they are: an entry whose position no longer has a pair
of that rank is skipped when it comes up.  A bucket is taken whole and gone through from the left; should a merge open a
pair of the same or a lower rank, the rest goes back and the queue is asked again.  No merge walks over the list, however
long a match is.

Matches do not touch each other, so the matches that a batch of texts brings new are laid behind each other, an end
symbol between them, and merged by one queue, CHUNK_BYTES at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches

#: Bytes of new matches that share one queue; a longer match has a queue of its own.
CHUNK_BYTES = 1 << 20
#: Characters of text that are cut into matches at a time; a longer text stands alone.
TEXT_CHARS = 2 << 20
#: Pairs of one rank from which on they are merged in one go instead of one after the other; the result is the same.
ALL_AT_ONCE = 24
#: Matches whose ids a worker keeps at hand, and the longest of them; all others are encoded whenever they come.
CACHE_MATCHES, CACHE_LENGTH = 400_000, 64
#: Bits of a bitmap word, as a shift.
_SHIFT = 6
_LOW = (1 << _SHIFT) - 1


class RankQueue:
    """Positions by rank, with the lowest rank that holds any."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.levels: list[list[int]] = []
        while ranks > 1 or not self.levels:
            ranks = (ranks + _LOW) >> _SHIFT
            self.levels.append([0] * ranks)

    def push(self, rank: int, positions: Iterable[int]) -> None:
        if not self.buckets[rank]:
            at = rank
            for level in self.levels:
                word, bit = at >> _SHIFT, 1 << (at & _LOW)
                had = level[word]
                level[word] = had | bit
                if had:
                    break
                at = word
        self.buckets[rank] += positions

    def lowest(self) -> int:
        """The lowest rank that holds a position, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return -1
            at = at << _SHIFT | (word & -word).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """All positions of a rank, in order; its bucket is empty then."""
        positions, self.buckets[rank] = self.buckets[rank], []
        at = rank
        for level in self.levels:
            word = at >> _SHIFT
            level[word] &= ~(1 << (at & _LOW))
            if level[word]:
                break
            at = word
        positions.sort()
        return positions


class Line:
    """The linked list of symbols of some matches.

    A symbol stands where its first byte does; ``rank`` is that of the pair it begins, -1 for none.
    """

    def __init__(self, vocab: Vocabulary, code: np.ndarray):
        self.vocab, n = vocab, len(code)
        self.symbol = vocab.single[code]  # -1 where one has been merged into the symbol before it
        self.rank = np.append(vocab.double[code[:-1], code[1:]], -1)
        self.after, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.file(self.rank, np.arange(n))

    def file(self, rank: np.ndarray, position: np.ndarray) -> None:
        """Queue pairs, those without a rank left out."""
        order = np.argsort(rank, kind="stable")
        order = order[np.searchsorted(rank, 0, sorter=order):]
        rank, position = rank[order], position[order].tolist()
        cuts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
        for r, a, z in zip(rank[cuts].tolist(), cuts, [*cuts[1:], len(position)]):
            self.vocab.queue.push(r, position[a:z])

    def merge_each(self, r: int, positions: list[int]) -> None:
        """Merge the pairs of lowest rank from the left, until one of the same or a lower rank opens."""
        symbol, rank, after, before = map(memoryview, (self.symbol, self.rank, self.after, self.before))
        shift, pair, push = self.vocab.shift, self.vocab.pairs.get, self.vocab.queue.push
        for at, i in enumerate(positions):
            if rank[i] != r:
                continue  # stale
            j = after[i]
            k = after[j]
            after[i] = k
            before[k] = i
            symbol[i], symbol[j], rank[j] = r, -1, -1
            rank[i] = right = pair(r << shift | symbol[k], -1)
            if right >= 0:
                push(right, (i,))
            h = before[i]
            left = pair(symbol[h] << shift | r, -1)
            if left != rank[h]:
                rank[h] = left
                if left >= 0:
                    push(left, (h,))
            if 0 <= right <= r or 0 <= left <= r:
                push(r, positions[at + 1:])
                return

    def merge_all(self, r: int, positions: list[int]) -> bool:
        """The same for many pairs in one go; False, with nothing done, if one of them opens a pair that goes first."""
        symbol, rank, after, before, ranks_of = self.symbol, self.rank, self.after, self.before, self.vocab.ranks_of
        i = np.array(positions)
        i = i[(rank[i] == r) & (np.diff(i, prepend=-1) != 0)]
        if not len(i):
            return True
        j = after[i]
        overlaps = np.append(False, j[:-1] == i[1:])  # of pairs that share symbols every other one is merged
        if overlaps.any():
            nth = np.arange(len(i))
            keep = (nth - np.maximum.accumulate(np.where(overlaps, 0, nth))) % 2 == 0
            i, j = i[keep], j[keep]
        k, h, new = after[j], before[i], np.full(len(i), r)
        left = np.where(np.append(False, h[1:] == j[:-1]), r, symbol[h])
        opened = np.append(ranks_of(new, symbol[k]), ranks_of(left, new))
        if ((opened >= 0) & (opened <= r)).any():
            return False
        symbol[i], symbol[j], rank[j] = r, -1, -1
        after[i], before[k] = k, i
        rank[i] = right = ranks_of(new, symbol[k])
        h = before[i]
        left = ranks_of(symbol[h], new)
        other = left != rank[h]
        rank[h] = left
        self.file(np.append(right, left[other]), np.append(i, h[other]))
        return True


class Vocabulary:
    """Token bytes by rank, and the encoder."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        if min(ranks.values()) < 0 or len(set(ranks.values())) < len(ranks):
            raise ValueError("ranks must be distinct and not negative")
        self.ranks = ranks
        self.split = regex.compile(pattern)
        self.end = max(ranks.values()) + 1  # a symbol behind every match; no token begins or ends with it
        self.shift = self.end.bit_length()
        self.queue = RankQueue(self.end)
        self.pairs = {ranks[t[:i]] << self.shift | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t))
                      if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(self.pairs), np.int64)
        self.pair_ranks = np.array([self.pairs[x] for x in self.pair_keys.tolist()], np.int64)
        self.single = np.array([*(ranks[bytes([b])] for b in range(256)), self.end])
        self.double = np.full((257, 257), -1)  # rank of two bytes; 256 stands for the end
        for t, r in ranks.items():
            if len(t) == 2:
                self.double[t[0], t[1]] = r
        self.known: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols, -1 for none."""
        key = left << self.shift | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1) if len(self.pair_keys) else np.full(len(key), -1)

    def merged(self, matches: list[bytes]) -> list[bytes]:
        """The ids of every match as 32-bit numbers, by one rank queue over all of them."""
        data = np.frombuffer(b"".join(matches), np.uint8)
        lengths = np.array([len(m) for m in matches])
        code = np.full(len(data) + len(matches) + 1, 256)  # an end behind every match and before the first
        code[np.arange(1, len(data) + 1) + np.repeat(np.arange(len(matches)), lengths)] = data
        line = Line(self, code)
        queue = self.queue
        while (r := queue.lowest()) >= 0:
            positions = queue.take(r)
            if len(positions) < ALL_AT_ONCE or not line.merge_all(r, positions):
                line.merge_each(r, positions)
        ids = line.symbol[line.symbol >= 0][1:]
        ends = np.flatnonzero(ids == self.end)
        raw = ids.astype("<i4").tobytes()
        return [raw[4 * a:4 * z] for a, z in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist())]

    def learn(self, matches: Iterable[str]) -> dict[str, bytes]:
        """The ids of matches, looked up or merged."""
        found, new, size = {}, {}, 0

        def merge() -> None:
            found.update(zip(new, self.merged(list(new.values()))))

        for match in matches:
            raw = match.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found[match] = whole.to_bytes(4, "little")
                continue
            new[match] = raw
            size += len(raw)
            if size >= CHUNK_BYTES:
                merge()
                new, size = {}, 0
        if new:
            merge()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as 32-bit numbers."""
        matches = [self.split.findall(t) for t in texts]
        here = set().union(*matches)
        found = self.learn(here.difference(self.known))
        if len(self.known) + len(found) > CACHE_MATCHES:
            self.known = {m: self.known[m] for m in here.difference(found)}
        self.known |= found
        ids = [b"".join(map(self.known.__getitem__, m)) for m in matches]
        for m in [m for m in found if len(m) > CACHE_LENGTH]:
            del self.known[m]
        return ids


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks from a file of lines with a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Decoder:
    """Token bytes by id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {i: t for t, i in ranks.items()}

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id that is no token raises a KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


_loaded: dict[tuple, Vocabulary | Decoder] = {}  # of this worker


def _once(kind: type, path: str, *more: str):
    key = (kind, path, *more)
    if key not in _loaded:
        _loaded[key] = kind(load_ranks(path), *more)
    return _loaded[key]


def _groups(texts: pa.Array) -> Iterator[list[str]]:
    """Texts in turn, up to TEXT_CHARS together; null as empty."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= TEXT_CHARS:
            yield some
            some, size = [], 0
    if some:
        yield some


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids) of every row: the token ids of the whole text as ``array<int>``, special tokens not told apart.

    ``path`` names a file of base64 tokens and ranks, ``pattern`` the expression that cuts a text.  A null or empty
    text has no ids (an empty list); repeated rows are encoded each; a null id is kept; an empty table gives an empty
    result; other columns are not read, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _once(Vocabulary, path, pattern)
        for b in batches:
            ids = [x for some in _groups(b.column(1)) for x in vocab.encode(some)]
            offsets = pa.array(np.append(0, np.cumsum([len(x) // 4 for x in ids])), pa.int32())
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], ["id", "ids"])

    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return told.mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, ids, decoded) of every row: the ids and the bytes that they stand for.

    Bytes, not text, since a row of ids may end inside a character.  No ids, null or an empty list, decode to no bytes; a null
    among the ids or an id without a token fails the query; rows, ids and other columns as in :func:`encode`.
    """
    bounded_batches(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _once(Decoder, path)
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_pylist()
            flat = iter(b.column(1).flatten().to_numpy(zero_copy_only=False).tolist())
            back = [decoder.decode(islice(flat, n)) for n in lengths]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(back, pa.binary())], ["id", "ids", "decoded"])

    told = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return told.mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").select(
        F.col("id").alias(id_col), "ids", "decoded")
