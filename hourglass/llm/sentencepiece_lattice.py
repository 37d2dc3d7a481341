"""SentencePiece encoding and decoding as a relational lattice.

A text is written with the space mark and cut between two characters that stand side by side in
no piece, which no edge can span (every word boundary is such a cut).  Distinct segments are encoded:

1. a segment is exploded into its ends, each with the longest substring there that ends a piece (the pieces
   at an end all are suffixes of it, so nothing is lost);
2. the substrings are equi-joined to the table of endings of pieces (a bounded table, broadcast) without the pieces
   whose own parts score strictly more, as no best path holds one;
3. the ends, each with the edges of its ending, are grouped by segment, whose rows still stand together;
4. a higher-order ``aggregate`` folds the ends into the best score of every position (Viterbi)
   and a second one walks back from the last.

A single character that is no piece is an edge of its own with the unknown score; it is written
as byte pieces.  Ties go to the edge that starts first, as in the library's unigram decoder.
A text's best path is its segments' paths in turn.

Segments that many documents share are encoded once for the whole table: a bounded sample of rows
names them, at most MAX_COMMON, and the tasks get their paths.  They spare work and decide
nothing; every other segment is encoded beside its documents.  There nothing is shuffled: the segments that a
batch of documents brings new stand before it in the same partition, explode and broadcast join keep the order of rows
(the grouping checks it).  An end is one number there, as writing a row for Python takes longer than finding it.
Documents travel TOLD in a row, as the numbers of their segments, from which the last step puts their paths together.
A run ends at MAX_SEGMENTS distinct segments, which bounds the numbering.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.llm.common import bind, bounded_batches, stored

MARK = "▁"
#: Distinct segments beside the common ones whose paths one run of documents keeps at hand; a batch above it ends the run.
MAX_SEGMENTS = 40_000
#: Segments that are encoded once for the table, at most, and the rows (about) that name them.
MAX_COMMON, SAMPLE_ROWS = 250_000, 30_000
#: Characters of a text, or segment numbers of a document, that are looked at together.
CUT_CHARS = 1 << 20
#: Largest table of character pairs; more are searched for.
PAIR_CELLS = 1 << 24
#: Rows and bytes of an Arrow batch; most rows are ends of a few bytes, and a task has three workers.
EDGE_ROWS, EDGE_BYTES = 20_000, 1 << 20
#: Documents in a row; the JVM holds small rows more easily.
TOLD = 32
#: Runs are numbered modulo RUNS: neighbours must differ, no more.
RUNS = 4_096
#: Bits of ends and lengths, of an ending's row and of a piece's.  A place holds run, end and start (at a segment's first
#: end: its length), a code a place and the row of the ending, or -1 - c for unknown code point c; documents have -1 - run.
_END, _ROW, _PIECE = 9, 32, 22
#: Largest piece table, which is broadcast.
MAX_PIECES = 1_000_000
#: Longer segments are folded by ``viterbi`` where their document is; the edges of a segment are one group.
#: Their ids stand among the segment numbers of a document as -1 - id.
MAX_WORD = 256
UNKNOWN_PENALTY = 10.0
_SEGMENTS = "docs binary, word string, places array<bigint>"
#: The tree of endings is looked up in a table of 2 ** _SLOTS places; a character has _CHAR bits.
_ODD, _SLOTS, _CHAR = 0xD6E8FEB86659FD93, 20, 21

_WORDS = regex.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall


class Pieces:
    """A piece table: normal pieces with id and score, and the ids of the byte pieces."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int]):
        if len(pieces) > MAX_PIECES:
            raise ValueError("the piece table is too large to broadcast")
        if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces):
            raise ValueError("a piece crosses a word boundary")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.useful = self._useful()
        #: strings that end a piece, by length, and their rows
        self.endings = {x: k for k, x in enumerate(sorted({p[i:] for p in self.useful for i in range(len(p))}, key=len))}
        self.ids = np.array([number for number, _ in self.useful.values()] or [0], np.int32)
        self.joined = frozenset(p[i:i + 2] for p in self.useful for i in range(len(p) - 1))

    def _useful(self) -> dict[str, tuple[int, float]]:
        """The pieces but those whose own parts score more, by more than rounding, so that no best path holds them."""
        useful = {}
        for piece in sorted(self.pieces, key=len):
            number, score = self.pieces[piece]
            best = [0.0]
            for e in range(1, len(piece) + 1):
                best.append(max((best[s] + (useful[piece[s:e]][1] if piece[s:e] in useful else self.unknown)
                                 for s in range(e) if piece[s:e] in useful or (e - s == 1 and len(piece) > 1)),
                                default=-np.inf))
            if best[-1] <= score + 1e-6 * (1 + abs(score)):
                useful[piece] = number, score
        return useful

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        return Pieces({sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if i not in special},
                      [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])

    def viterbi(self, word: str) -> list[int]:
        """The best path by the definition, for one word."""
        best = [(0.0, -1, -1)] + [None] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - self.longest), e):
                piece = self.pieces.get(word[s:e])
                if piece is None and e - s > 1:
                    continue
                score = best[s][0] + (piece[1] if piece else self.unknown)
                if best[e] is None or score > best[e][0]:
                    best[e] = (score, s, piece[0] if piece else -1)
        out, e = [], len(word)
        while e:
            _, s, i = best[e]
            out.append([i] if i >= 0 else [self.byte_ids[b] for b in word[s:e].encode()])
            e = s
        return [i for part in reversed(out) for i in part]

    def borders(self):
        """A function from a marked text to, for every character, whether a segment starts there, and its bytes in UTF-8."""
        pairs = np.array([list(map(ord, p)) for p in self.joined], np.int64).reshape(-1, 2)
        sides = [np.unique(side) for side in pairs.T]
        width = len(sides[1]) + 1
        before, after = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int32)
        before[sides[0]] = np.arange(1, len(sides[0]) + 1) * width
        after[sides[1]] = np.arange(1, len(sides[1]) + 1)
        codes = np.unique(before[pairs[:, 0]] + after[pairs[:, 1]])
        cells = (len(sides[0]) + 1) * width
        cell = np.isin(np.arange(cells), codes) if cells <= PAIR_CELLS else None

        def borders(marked: str) -> tuple[np.ndarray, np.ndarray]:
            first, size = np.ones(len(marked), bool), np.ones(len(marked), np.uint8)
            for at in range(0, len(marked), CUT_CHARS):
                points = np.frombuffer(marked[at:at + CUT_CHARS + 1].encode("utf-32-le"), "<u4")
                code = before.take(points[:-1], mode="clip") + after.take(points[1:], mode="clip")
                joined = cell.take(code, mode="clip") if cell is not None else np.isin(code, codes)
                first[at + 1:at + 1 + len(joined)] = ~joined
                for most in (0x7F, 0x7FF, 0xFFFF):
                    size[at:at + CUT_CHARS] += points[:CUT_CHARS] > most
            return first, size
        return borders

    def cutter(self):
        """A function from a text to its segments, in turn; they make up the marked text."""
        borders = self.borders()

        def cut(text: str | None) -> list[str]:
            if not text:
                return []
            marked = _marked(text)
            cuts = np.flatnonzero(borders(marked)[0]).tolist()
            return [marked[a:b] for a, b in zip(cuts, cuts[1:] + [len(marked)])]
        return cut

    def batch_cutter(self):
        """A function from texts to the segments of all, as a dictionary array, and how many stand before each text and at the end."""
        borders = self.borders()

        def cut(texts: list[str | None]) -> tuple[pa.DictionaryArray, np.ndarray]:
            marked = [_marked(text) if text else "" for text in texts]
            begins = np.append(0, np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked))))
            whole = "".join(marked)
            first, size = borders(whole)
            first[begins[begins < len(whole)]] = True
            cuts = np.flatnonzero(first)
            sizes = np.add.reduceat(size, cuts, dtype=np.int64) if len(cuts) else cuts
            segments = pa.Array.from_buffers(pa.large_string(), len(cuts), [
                None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(whole.encode())])
            return segments.dictionary_encode(), np.searchsorted(cuts, begins)
        return cut

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths, scores and rows of the pieces at every ending, longest first, and where an ending's begin; an unknown one is last."""
        row = {p: k for k, p in enumerate(self.useful)}
        held = [[(len(x) - i, self.useful[x[i:]][1], row[x[i:]]) if x[i:] in row else (1, self.unknown, -1 - ord(x[i:]))
                 for i in range(len(x)) if x[i:] in row or i == len(x) - 1] for x in self.endings] + [[(1, self.unknown, -1)]]
        length, score, piece = zip(*(edge for edges in held for edge in edges))
        return (np.array(length, np.int64), np.array(score, np.float64), np.array(piece, np.int64),
                np.append(0, np.cumsum(list(map(len, held)))))

    def starter(self):
        """A function from segments to, for every end in turn, the start of the longest substring there that ends a piece, or of its character."""
        keys = np.array([(self.endings[x[1:]] + 1 if len(x) > 1 else 0) << _CHAR | ord(x[0]) for x in self.endings], np.uint64)

        def place(keys: np.ndarray) -> np.ndarray:
            return (keys * np.uint64(_ODD)) >> np.uint64(64 - _SLOTS)

        rows = np.argsort(place(keys), kind="stable")
        begins = np.searchsorted(place(keys)[rows], np.arange((1 << _SLOTS) + 1, dtype=np.uint64)).astype(np.int32)
        most = int(np.diff(begins).max())
        known = np.append(keys[rows], np.full(most, -1, np.int64).astype(np.uint64))
        rows = np.append(rows, np.full(most, -1))

        def longer(state: np.ndarray, points: np.ndarray) -> np.ndarray:
            """Rows of the endings that begin with a character and go on with another ending (its row + 1, 0 for none), or -1."""
            key = (state << _CHAR | points).astype(np.uint64)
            at, out = begins[place(key)], np.full(len(key), -1)
            for k in range(most):
                out = np.where(known[at + k] == key, rows[at + k], out)
            return out

        def starts(segments: list[str]) -> pa.Array:
            lengths = np.fromiter(map(len, segments), np.int64, len(segments))
            offsets = np.append(0, np.cumsum(lengths))
            points = np.frombuffer("".join(segments).encode("utf-32-le"), "<u4").astype(np.int64)
            last = np.arange(len(points)) - np.repeat(offsets[:-1], lengths)
            first, at, state = last.copy(), np.arange(len(points)), longer(np.zeros(len(points), np.int64), points)
            for k in range(1, self.longest):
                inside = (state >= 0) & (last[at] >= k)
                at = at[inside]
                state = longer(state[inside] + 1, points[at - k])
                first[at[state >= 0]] -= 1
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(first, pa.int32()))
        return starts

    def decoder(self):
        """A function from ids to text."""
        spelled = {i: p.encode() for p, (i, _) in self.pieces.items()}
        spelled.update({i: bytes([b]) for b, i in enumerate(self.byte_ids)})
        known = np.full(max(spelled, default=0) + 1, None, object)
        for i, part in spelled.items():
            known[i] = part

        def decode(ids) -> str:
            parts = known.take(np.asarray(ids, np.intp)).tolist()
            text = b"".join(parts).decode("utf-8", "replace").replace(MARK, " ")
            return text[1:] if text.startswith(" ") else text
        return decode


def _marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


def words_of(text: str) -> list[str]:
    """The words of a text, which no piece leaves; the definition that results are held against."""
    return _WORDS(_marked(text)) if text else []


def _counted(pieces: Pieces):
    """(word, docs): the documents of a batch that hold a segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = pieces.cutter()
        for b in batches:
            docs = Counter()
            for text in b.column(0):
                docs.update({w for w in cut(text.as_py()) if len(w) <= MAX_WORD})
            yield pa.RecordBatch.from_arrays([pa.array(docs.keys(), pa.string()), pa.array(docs.values(), pa.int64())],
                                             ["word", "docs"])
    return run


def _lonely(pieces: Pieces):
    """Segments as the lattice takes them, a batch of them instead of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = pieces.starter()
        for b in batches:
            if len(b):
                yield _ends(0, b.column(0), starts)
                yield _told(0, [b.column(0)], ["id"])
    return run


def _ends(run: int, words: pa.Array, starts) -> pa.RecordBatch:
    """(docs, word, places) rows of segments: the places of the longest substrings that end a piece, by end."""
    first = starts(words.to_pylist())
    offsets, first = first.offsets, first.values.to_numpy().astype(np.int64)
    at, size = offsets.to_numpy()[:-1], np.diff(offsets.to_numpy())
    first[at] = size
    end = np.arange(1, len(first) + 1) - np.repeat(at, size)
    places = pa.ListArray.from_arrays(offsets, pa.array((((run << _END) + end) << _END) + first))
    return pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.binary()), words, places], ["docs", "word", "places"])


def _told(run: int, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """The (docs, word, places) row of some documents."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(columns, names)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.string()),
                                       pa.array([[-1 - run]], pa.list_(pa.int64()))], ["docs", "word", "places"])


def _segments(pieces: Pieces, common: bytes):
    """(docs, word, places) rows: the segments that a batch brings new, then its documents.

    Common segments have the numbers of their rows in ``common``, a run's own the numbers after them in turn.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, starts = pieces.batch_cutter(), pieces.starter()
        number = {w: k for k, w in enumerate(pa.ipc.open_stream(common).read_all()["id"].to_pylist())}
        own, now, shared = [], 0, len(number)

        def numbers(texts: list[str | None]) -> pa.Array:
            segments, bounds = cut(texts)
            words = segments.dictionary.to_numpy(zero_copy_only=False).tolist()
            found, at, long = list(map(number.get, words)), -1, {}
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                if len(words[at]) <= MAX_WORD:
                    found[at] = number[words[at]] = shared + len(own)
                    own.append(words[at])
                else:
                    found[at] = 0
                    long[at] = np.array([-1 - i for i in pieces.viterbi(words[at])], np.int32)
            found = np.array(found, np.int32)
            of = segments.indices.to_numpy()
            out = found[of]
            if long:
                size = np.ones(len(found), np.int64)
                size[list(long)] = list(map(len, long.values()))
                size = size[of]
                begins = np.append(0, np.cumsum(size))
                out, bounds = np.repeat(out, size), begins[bounds]
                for at in np.flatnonzero(np.isin(of, list(long))).tolist():
                    out[begins[at]:begins[at + 1]] = long[of[at]]
            return pa.Array.from_buffers(pa.binary(), len(texts), [
                None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(out.astype("<i4"))])

        for b in batches:
            if len(own) >= MAX_SEGMENTS:
                for w in own:
                    del number[w]
                own, now = [], (now + 1) % RUNS
            before = len(own)
            docs = numbers(b.column(1).to_pylist())
            for at in range(before, len(own), 10_000):
                yield _ends(now, pa.array(own[at:at + 10_000], pa.string()), starts)
            for at in range(0, len(b), TOLD):
                yield _told(now, [b.column(0).slice(at, TOLD), docs.slice(at, TOLD)], ["id", "numbers"])
    return run


def _group_ends(pieces: Pieces):
    """One row per segment with its edges by end, from the codes of its ends in turn; documents pass.

    Every segment must have its ends 1, 2, ... up to its length in turn, so rows that were torn apart or left out do
    not go unnoticed.
    """
    lengths, scores, rows_of, begins = pieces.edges()

    def ends_of(code: np.ndarray) -> np.ndarray:
        return np.where(code < 0, 0, (code >> _ROW + _END) & (1 << _END) - 1)

    def rows(code: np.ndarray, docs: pa.Array) -> pa.RecordBatch:
        doc, e = code < 0, ends_of(code)
        start = e <= 1
        cuts = np.flatnonzero(start)
        size = np.where(doc, 0, (code >> _ROW) & (1 << _END) - 1)[cuts]
        if (np.diff(e, prepend=0)[~start] != 1).any() or (e[np.append(cuts[1:], len(e)) - 1] != size).any():
            raise RuntimeError("the ends of a segment are torn apart")
        ending, e = (code[~doc] & (1 << _ROW) - 1) - (1 << _ROW - 1), e[~doc]
        unknown = ending < 0
        row = np.where(unknown, len(begins) - 2, ending)
        held = begins[row + 1] - begins[row]
        upto = np.append(0, np.cumsum(held))
        at = np.arange(upto[-1]) + np.repeat(begins[row] - upto[:-1], held)
        piece, begin = rows_of[at], np.repeat(e, held) - lengths[at]
        piece[upto[:-1][unknown]] = ending[unknown]
        # the larger link starts earlier
        edges = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(scores[at]), pa.array(
            (-begin << _PIECE) + piece + (1 << _PIECE - 1), pa.int32())], ["s", "score", "link"])
        ends = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), edges)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), ends)
        runs = pa.array(np.where(doc[cuts], -1 - code[cuts], code[cuts] >> _ROW + 2 * _END))
        return pa.RecordBatch.from_arrays([runs, docs.take(pa.array(cuts)), lists], ["run", "docs", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            code, docs = batch.column(0).to_numpy(), batch.column(1)
            if held is not None:
                code, docs = np.append(held[0], code), pa.concat_arrays([held[1], docs])
            first = np.flatnonzero(ends_of(code) <= 1)
            if not len(first) or first[0]:
                raise RuntimeError("the ends of a segment are torn apart")
            if first[-1]:
                yield rows(code[:first[-1]], docs.slice(0, first[-1]))
            held = code[first[-1]:], docs.slice(first[-1])
        if held is not None:
            yield rows(*held)
    return run


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _endings(spark: SparkSession, pieces: Pieces) -> DataFrame:
    return spark.createDataFrame(list(pieces.endings.items()), "ending string, row long")


def _lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(run, docs, path): the rows of pieces of segments in the table of pieces; -1 - c stands for unknown code point c."""
    bits = (1 << _END) - 1
    e, s, place = F.col("e"), F.col("s"), F.col("place")
    subs = (words.select("docs", "word", F.explode("places").alias("place"))
            .withColumn("e", F.shiftright(place, _END).bitwiseAND(bits).cast("int"))
            .withColumn("s", F.when(e == 1, 0).otherwise(place.bitwiseAND(bits).cast("int")))
            .withColumn("ending", F.substring(F.col("word"), s + 1, e - s)))
    ends = (subs.join(F.broadcast(_endings(words.sparkSession, pieces)), "ending", "left")
            .where("row IS NOT NULL OR e - s = 1 OR place < 0")
            .select(F.when(place < 0, place).otherwise(
                F.shiftleft(place, _ROW) + F.coalesce("row", -1 - F.ascii("ending")) + (1 << _ROW - 1)).alias("code"), "docs"))
    lattice = ends.mapInArrow(_group_ends(pieces), "run bigint, docs binary, "
                                                   "ends array<array<struct<s:int,score:double,link:int>>>")

    def forward(best, end):
        # the best score, then the earliest start
        reached = F.transform(end, lambda x: F.struct((F.get(best, x.s).score + x.score).alias("score"), x.link.alias("link")))
        return F.array_append(best, F.array_max(reached))

    best = F.aggregate("ends", F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("link"))), forward)

    def walk(b):
        def back(state, _):
            link = F.get(b, state.at).link
            return F.when(state.at > 0, F.struct((-F.shiftright(link, _PIECE)).alias("at"), F.array_append(
                state.path, link.bitwiseAND((1 << _PIECE) - 1) - (1 << _PIECE - 1)).alias("path"))).otherwise(state)
        return F.reverse(F.aggregate(F.sequence(F.lit(1), F.size(b)), F.struct(
            (F.size(b) - 1).alias("at"), F.array().cast("array<int>").alias("path")), back).path)

    return lattice.select("run", "docs", bind(best, walk).alias("path"))


def _common(told: DataFrame, pieces: Pieces) -> bytes:
    """An Arrow stream of (id, path): the segments that most of the sampled documents hold."""
    rows = told.count()
    some = told if rows <= SAMPLE_ROWS else told.sample(SAMPLE_ROWS / rows, seed=1)
    counted = stored(some.select("text").mapInArrow(_counted(pieces), "word string, docs bigint")
                     .groupBy("word").agg(F.sum("docs").alias("docs")).where("docs > 1"), "piece-segments")
    # the most frequent ones: tallies of counts, at most one row for every count up to SAMPLE_ROWS
    held, least = 0, 2
    for docs, n in sorted(((r.docs, r.n) for r in counted.groupBy("docs").agg(F.count("*").alias("n")).collect()), reverse=True):
        held += n
        if held > MAX_COMMON:
            least = docs + 1
            break
    words = counted.where(F.col("docs") >= least).select("word").mapInArrow(_lonely(pieces), _SEGMENTS)
    done = _lattice(words, pieces).toArrow()
    told = _flat(done["docs"])
    names = [pa.ipc.open_stream(batch).read_all()["id"] for batch in told.drop_null().to_pylist()]
    paths = pa.table([pa.array([w for name in names for w in name.to_pylist()], pa.string()),
                      done["path"].filter(told.is_null())], ["id", "path"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, paths.schema) as out:
        out.write_table(paths)
    return sink.getvalue().to_pybytes()


def _assemble(pieces: Pieces, common: bytes):
    """(id, ids, decoded) of the documents, from their numbers and the paths of the segments before them."""
    def spelled(paths: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of paths, unknown characters as byte pieces."""
        offsets, ids = paths.offsets.to_numpy(), paths.flatten().to_numpy()
        offsets, lengths = offsets - offsets[0], np.diff(offsets).astype(np.int64)
        unknown, ids = np.flatnonzero(ids < 0), np.where(ids < 0, ids, pieces.ids.take(ids, mode="clip"))
        if len(unknown):
            parts = [[pieces.byte_ids[x] for x in chr(-1 - i).encode()] for i in ids[unknown].tolist()]
            more = np.array([len(p) - 1 for p in parts])
            np.add.at(lengths, np.searchsorted(offsets, unknown, "right") - 1, more)
            ids = np.insert(ids, np.repeat(unknown + 1, more), [x for p in parts for x in p[1:]])
            ids[unknown + np.cumsum(more) - more] = [p[0] for p in parts]
        return lengths, ids

    def joined(numbers: np.ndarray, begins: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The paths of ``numbers`` in turn."""
        segment = numbers >= 0
        size = np.ones(len(numbers), np.int64)
        size[segment] = lengths[numbers[segment]]
        ends = np.cumsum(size)
        out = np.empty(ends[-1] if len(ends) else 0, np.int64)
        out[ends[~segment] - 1] = -1 - numbers[~segment]
        keep, from_ = size[segment], begins[numbers[segment]]
        inner = np.arange(keep.sum()) - np.repeat(np.cumsum(keep) - keep, keep)
        out[np.repeat(segment, size)] = ids[np.repeat(from_, keep) + inner]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = pieces.decoder()
        shared = spelled(_flat(pa.ipc.open_stream(common).read_all()["path"]))
        now, (lengths, ids) = None, shared
        for b in batches:
            runs, doc = b.column(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            doc_ids, all_ids, back = [], [], []
            turns = np.flatnonzero((np.diff(runs) != 0) | (np.diff(doc) != 0)) + 1
            for i, j in zip([0, *turns.tolist()], [*turns.tolist(), len(b)]):
                if i == j:
                    continue
                if runs[i] != now:
                    now, (lengths, ids) = runs[i], shared
                if not doc[i]:
                    new = spelled(b.column(2).slice(i, j - i))
                    lengths, ids = np.append(lengths, new[0]), np.append(ids, new[1])
                    continue
                begins = np.cumsum(lengths) - lengths
                for k in range(i, j):
                    told = pa.ipc.open_stream(b.column(1)[k].as_buffer()).read_all()
                    doc_ids += told["id"].chunks
                    for held in told["numbers"]:
                        numbers = np.frombuffer(held.as_buffer(), "<i4")
                        parts = [joined(numbers[at:at + CUT_CHARS], begins, lengths, ids) for at in range(0, len(numbers), CUT_CHARS)]
                        path = np.concatenate(parts) if parts else np.empty(0, np.int64)
                        all_ids.append(path.astype("<u4").tobytes())
                        back.append(decode(path))
            if doc_ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(doc_ids), pa.array(all_ids, pa.binary()),
                                                  pa.array(back, pa.string())], ["id", "ids", "decoded"])
    return run


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) of every row: the piece ids of the whole text and their decoding.

    ``ids`` are little-endian unsigned 32-bit.  A null or empty text has no ids and decodes to the empty text; other
    texts decode to themselves (a literal space mark decodes to a space); repeated rows are encoded
    each; a null id is kept; an empty table gives an empty result; other columns are not read.  The rows are
    read twice more at most (their number, a sample), while the result is being made.
    """
    bounded_batches(docs.sparkSession, EDGE_ROWS, EDGE_BYTES)
    kind = docs.schema[id_col].dataType.simpleString()
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common = _common(told, pieces)
    words = told.mapInArrow(_segments(pieces, common), _SEGMENTS)
    out = _lattice(words, pieces).mapInArrow(_assemble(pieces, common), f"id {kind}, ids binary, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")
