"""Sum-of-squares online packing of tokenized documents into fixed windows.

Documents arrive in scan order; each one's ids are followed by one separator id.  Whole windows
are cut off first; the remainder, an item of fewer ids than a window, goes into the partially
filled window whose level keeps the sum of the squared level counts smallest (a fresh window has
level 0 and is not counted).  The counts of the open windows by level are kept in a level array.
Sequences may cut documents freely, so the windows still open when a stream ends are topped up
from the emptiest ones: at most one window per stream stays partly filled.

A stream is one partition of the scan: nothing is shuffled, a retried task sees the same rows in
the same order and numbers its sequences from the partition's own range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches

CAPACITY = 2048
SEPARATOR = 1
#: Open windows that a stream holds at most; beyond it they are topped up as at the end.
MAX_OPEN = 4_096
#: Entries of a worker's word cache.
CACHE_WORDS = 400_000

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")


class WordTokenizer:
    """Ids of the lower-casing word BPE, as little-endian unsigned 32-bit bytes.

    Its tokens never span ASCII white space, so a text's ids are those of its words in turn and
    a word is encoded once per cache.  A word of characters below U+0250 is already in normal
    form C and lower-cased character by character; its pieces go straight to the library's BPE
    model.  Any other word takes the library's whole ``encode``, and so does a text with the string of
    a special token, which that plain call takes for the token.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        with open(path) as f:
            told = json.load(f)
        self.pieces = regex.compile(told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        # a token that is told apart after normalization is found in lower case
        self.marks = [t["content"] for t in told["added_tokens"] if not t["normalized"]]
        self.folded = [t["content"].lower() for t in told["added_tokens"] if t["normalized"]]
        # the byte-level alphabet: printable bytes stand for themselves, the rest follow from U+0100
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(spare) for b in range(256)}
        self.words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _run(self, piece: str) -> bytes:
        got = self.runs.get(piece)
        if got is None:
            mapped = piece.encode().decode("latin-1").translate(self.alphabet)
            got = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
            if len(self.runs) >= CACHE_WORDS:
                self.runs.clear()
            self.runs[piece] = got
        return got

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if max(text) < "ɐ" and "İ" not in text and len(text) < 1_000:
            text = text.lower()
            out = self._run(text) if text.isalpha() else b"".join([self._run(p) for p in self.pieces(text)])
        else:
            out = np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= CACHE_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = out
        return out

    def _special(self, text: str) -> bool:
        return any(m in text for m in self.marks) or bool(self.folded) and any(m in text.lower() for m in self.folded)

    def encode(self, text: str) -> bytes:
        if self._special(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in text.encode().split()])


_tokenizers: dict[str, WordTokenizer] = {}  # of this worker


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Level array and open windows of one stream.  Ids are bytes, four to an id."""

    def __init__(self, capacity: int = CAPACITY, first_sequence: int = 0, max_open: int = MAX_OPEN):
        self.capacity, self.max_open = capacity, max_open
        self.counts = np.zeros(capacity + 1, np.int64)  # open windows by level; capacity stays 0
        self.open: list[list] = [[] for _ in range(capacity)]  # windows by level: lists of pieces
        self.n_open = 0
        self.next = first_sequence

    def _close(self, pieces: list) -> list:
        out, at = [], 0
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids) // 4, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def _level(self, size: int) -> int:
        """The open level, or 0 for a fresh window, that minimises the sum of squares."""
        n = self.counts
        h = np.flatnonzero(n[1:self.capacity - size + 1]) + 1
        if not len(h):
            return 0
        then = h + size
        change = np.where(then < self.capacity, 2 * (n[then] - n[h] + 1), 1 - 2 * n[h])
        best = len(h) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest window
        return int(h[best]) if change[best] <= 2 * n[size] + 1 else 0

    def add(self, doc, ids: bytes) -> list:
        """The rows of all sequences that this document completes."""
        total, width, out = len(ids) // 4, self.capacity * 4, []
        full = len(ids) // width * width
        for at in range(0, full, width):
            out += self._close([(doc, at // 4, ids[at:at + width], total)])
        rest = ids[full:]
        if rest:
            size = len(rest) // 4
            h = self._level(size)
            window = self.open[h].pop() if h else []
            if h:
                self.counts[h] -= 1
                self.n_open -= 1
            window.append((doc, full // 4, rest, total))
            if h + size == self.capacity:
                out += self._close(window)
            else:
                self.open[h + size].append(window)
                self.counts[h + size] += 1
                self.n_open += 1
                if self.n_open > self.max_open:
                    out += self.top_up()
        return out

    def top_up(self, last: bool = False) -> list:
        """Fill the fullest open windows with the contents of the emptiest, cutting pieces."""
        windows = [(h, w) for h in range(self.capacity - 1, 0, -1) for w in self.open[h]]
        out, lo, hi = [], 0, len(windows) - 1
        while lo <= hi:
            h, window = windows[lo]
            lo += 1
            while h < self.capacity and lo <= hi:
                level, donor = windows[hi]
                doc, start, ids, total = donor.pop()
                take = min(len(ids) // 4, self.capacity - h)
                window.append((doc, start, ids[:take * 4], total))
                if take * 4 < len(ids):
                    donor.append((doc, start + take, ids[take * 4:], total))
                h, level = h + take, level - take
                windows[hi] = (level, donor)
                if not donor:
                    hi -= 1
            if h == self.capacity or last:
                out += self._close(window)
            else:
                windows = [(h, window)]
                break
        else:
            windows = []
        self.counts[:] = 0
        self.open = [[] for _ in range(self.capacity)]
        for h, window in windows:
            self.open[h].append(window)
            self.counts[h] += 1
        self.n_open = len(windows)
        return out


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit.  A null or wordless text is the separator alone,
    so every row of ``docs`` has at least one piece; repeated rows are packed as often as they
    occur; a null id is kept; an empty table gives an empty result; other columns are not read.
    ``docs`` must be a table (or its projection) whose partitions are the same when read again.
    """
    bounded_batches(docs.sparkSession)
    tail = np.array([separator], "<u4").tobytes()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(),
                                       pa.int64(), pa.int64()])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        packer = Packer(capacity, TaskContext.get().partitionId() << 32)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)], schema=kinds)

        rows: list = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += packer.add(doc, encode(text.as_py() or "") + tail)
                if len(rows) >= 2_000:
                    yield batch_of(rows)
                    rows = []
        rows += packer.top_up(last=True)
        if rows:
            yield batch_of(rows)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
