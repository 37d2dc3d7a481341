"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, filters of several widths slide over a window of fixed length, each filter
keeps its maximum over the window (rectified), and a softmax layer maps the maxima to languages.
A document is cut into consecutive windows (the last one ends at its last byte); its score for a
language is the mean probability over all windows of its whole text.

The network is fitted on the driver from a bounded sample of labelled rows: about ``FIT_DOCS``
documents of every language (fewer where FIT_TOTAL in all would be passed), chosen by a hash, and up to
``FIT_WINDOWS`` hashed places of each.  Prediction runs in Arrow batches; embedding and filter
weights are folded into lookup tables by byte pair, so a position costs a few table rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches

WINDOW = 256
WIDTHS = (2, 3, 4, 5)
FILTERS = 16
EMBED = 8
FIT_DOCS = 400
#: Documents of the sample in all; beyond FIT_TOTAL / FIT_DOCS languages each has a smaller share, one at least.
FIT_TOTAL = 12_800
FIT_WINDOWS = 6
EPOCHS = 8
UNKNOWN = "und"
#: Score below which ``keep_identified`` rejects a document.
MIN_SCORE = 0.4

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text)))


def windows(raw: bytes) -> np.ndarray:
    """(n, WINDOW) bytes covering the text, ASCII lower-cased; a short text is padded with zeros."""
    b = np.frombuffer(raw.lower(), np.uint8)
    if len(b) <= WINDOW:
        out = np.zeros((1, WINDOW), np.uint8)
        out[0, :len(b)] = b
        return out
    full = len(b) // WINDOW
    out = b[:full * WINDOW].reshape(full, WINDOW)
    return out if full * WINDOW == len(b) else np.concatenate((out, b[None, -WINDOW:]))


class ByteCNN:
    """Embedding, filters and output layer; ``langs`` names the outputs."""

    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)}
        self.p["e"][0] = 0
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.p["c"] = np.zeros(len(langs), np.float32)
        self.rng = rng

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 3e-3) -> None:
        """Adam on the cross-entropy; rows are weighted so that every language counts the same."""
        weight = 1 / np.bincount(y, minlength=len(self.langs))[y].astype(np.float32)
        weight *= len(y) / weight.sum()
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at:at + batch]
                grad = self._gradient(x[rows], y[rows], weight[rows])
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        n, p = len(x), self.p
        emb = p["e"][x].reshape(n, -1)
        pooled, at = [], []
        for w in WIDTHS:
            view = np.lib.stride_tricks.sliding_window_view(emb, w * EMBED, axis=1)[:, ::EMBED]
            z = (view.reshape(-1, w * EMBED) @ p[f"w{w}"]).reshape(n, -1, FILTERS)
            at.append(z.argmax(1))
            pooled.append(np.take_along_axis(z, at[-1][:, None], 1)[:, 0] + p[f"b{w}"])
        m = np.concatenate(pooled, 1)
        h = np.maximum(m, 0)
        logits = h @ p["o"] + p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d = prob
        d[np.arange(n), y] -= 1
        d *= weight[:, None] / n
        grad = {"o": h.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
        dm = (d @ p["o"].T) * (m > 0)
        for i, w in enumerate(WIDTHS):
            g = dm[:, i * FILTERS:(i + 1) * FILTERS]  # only the winning position of a filter learns
            place = at[i][:, :, None] + np.arange(w)
            chars = x[np.arange(n)[:, None, None], place]
            grad[f"w{w}"] = np.einsum("nf,nfwe->wef", g, p["e"][chars]).reshape(w * EMBED, FILTERS)
            grad[f"b{w}"] = g.sum(0)
            back = np.einsum("nf,wef->nfwe", g, p[f"w{w}"].reshape(w, EMBED, FILTERS))
            np.add.at(grad["e"], chars.ravel(), back.reshape(-1, EMBED))
        grad["e"][0] = 0
        return grad

    def pooled_slow(self, x: np.ndarray) -> np.ndarray:
        """The filters' maxima by the definition (for tests)."""
        emb = self.p["e"][x]
        return np.stack([max(float((emb[i, s:s + w].ravel() @ self.p[f"w{w}"])[f] + self.p[f"b{w}"][f])
                             for s in range(x.shape[1] - w + 1))
                         for i in range(len(x)) for w in WIDTHS for f in range(FILTERS)]).reshape(len(x), -1)

    def predictor(self):
        """A function from (n, WINDOW) bytes to (n, languages) probabilities, by table lookups."""
        p, tables = self.p, []
        for w in WIDTHS:
            one = [p["e"] @ p[f"w{w}"][j * EMBED:(j + 1) * EMBED] for j in range(w)]
            one[0] = one[0] + p[f"b{w}"]
            two = [(j, (one[j][:, None] + one[j + 1][None]).reshape(65_536, FILTERS)) for j in range(0, w - 1, 2)]
            tables.append((w, two, one[-1] if w % 2 else None))

        def predict(x: np.ndarray) -> np.ndarray:
            out = []
            for at in range(0, len(x), 128):
                b = x[at:at + 128]
                pair = (b[:, :-1].astype(np.intp) << 8) | b[:, 1:]
                best = []
                for w, two, last in tables:
                    n = WINDOW - w + 1
                    z = None
                    for j, t in two:
                        got = t.take(pair[:, j:j + n], axis=0)
                        z = got if z is None else np.add(z, got, out=z)
                    if last is not None:
                        z += last.take(b[:, w - 1:w - 1 + n], axis=0)
                    best.append(z.max(1))
                logits = np.maximum(np.concatenate(best, 1), 0) @ p["o"] + p["c"]
                prob = np.exp(logits - logits.max(1, keepdims=True))
                out.append(prob / prob.sum(1, keepdims=True))
            return np.concatenate(out)
        return predict


def _learnable(docs: DataFrame, id_col: str):
    return (F.crc32(F.col(id_col).cast("string")) % 3) != 1


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        fit_docs: int = FIT_DOCS) -> ByteCNN:
    """A network from a bounded sample of the labelled rows with crc32(id) mod 3 other than 1.

    The sample has at most fit_docs documents a language and FIT_TOTAL in all (or one of each
    language), FIT_WINDOWS windows of each, taken by hash from the whole text.  Every language is learned.  Rows without id, language or letters are not learned from.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & _learnable(docs, id_col)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    sizes = known.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return ByteCNN([UNKNOWN])
    fit_docs = max(1, min(fit_docs, FIT_TOTAL // len(sizes)))
    langs = sorted(r["lang"] for r in sizes)
    most = 1 << 30
    share = F.create_map(*[F.lit(v) for r in sizes for v in (
        r["lang"], int(most * min(1.0, 1.5 * fit_docs / r["count"])))])
    n = F.length("t")
    cut = F.transform(F.sequence(F.lit(0), F.lit(FIT_WINDOWS - 1)), lambda k: F.substring(
        F.col("t"), 1 + F.pmod(F.xxhash64("id", k), F.greatest(n - WINDOW, F.lit(1))).cast("int"), F.lit(WINDOW)))
    draw = F.xxhash64("id", "t")
    rows = (known.where(F.pmod(draw, F.lit(most)) < F.coalesce(share[F.col("lang")], F.lit(0)))
            .select("lang", draw.alias("draw"), F.slice(cut, 1, F.least(F.lit(FIT_WINDOWS), F.ceil(n / WINDOW).cast("int"))).alias("cut"))
            .orderBy("draw", "lang").limit(2 * fit_docs * len(langs)).collect())
    code = {name: i for i, name in enumerate(langs)}
    taken = dict.fromkeys(langs, 0)
    x, y = [], []
    for r in rows:
        if taken[r["lang"]] < fit_docs:
            taken[r["lang"]] += 1
            for text in r["cut"]:
                x.append(windows(text.encode()[:WINDOW])[0])
                y.append(code[r["lang"]])
    net = ByteCNN(langs)
    if x:
        net.fit(np.stack(x), np.array(y))
    return net


def identify(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, lang_pred, score) of every row; reads the id (for ``held_out``) and the text.

    A null text, or one without a letter, is ``und`` with score 0; ties go to the language that
    sorts first; repeated rows are predicted alike; a null id is not held out; an empty table
    gives an empty result; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = net.predictor()
        for b in batches:
            langs, scores = [], []
            for text in b.column(1):
                text = text.as_py()
                if text is None or not has_letter(text):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                x = windows(text.encode())
                total = sum(predict(x[at:at + 4_096]).sum(0, dtype=np.float64) for at in range(0, len(x), 4_096)) / len(x)
                best = int(total.argmax())
                langs.append(net.langs[best])
                scores.append(float(min(total[best], 1.0)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                             ["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(
        run, f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(~_learnable(out, "id"), F.lit(False)).alias("held_out"),
                      "lang_pred", "score")


def keep_identified(docs: DataFrame, net: ByteCNN, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows, with their columns, whose language is found with a score of at least ``min_score``."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = net.predictor()
        for b in batches:
            keep = []
            for text in b.column(at):
                text = text.as_py()
                ok = text is not None and has_letter(text)
                if ok:
                    x = windows(text.encode())
                    ok = max(sum(predict(x[i:i + 4_096]).sum(0, dtype=np.float64)
                                 for i in range(0, len(x), 4_096)) / len(x)) >= min_score
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
