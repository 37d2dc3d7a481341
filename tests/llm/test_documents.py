"""Operators on documents against brute force on small fixtures with edge rows."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from hourglass.llm import (components, language_id, packing, quality_rules, sentencepiece_lattice, sharding,
                           simhash_dedup, token_counts)
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, key string, id long, chunk int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    (1, "the cat sat on the mat and the cat sat on the mat again today"),
    (2, "the cat sat on the mat and the cat sat on the mat again today"),  # a copy
    (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "日本語 ½ ﬁ́ İstanbul Σας <|endoftext|> a  b\n\n\nc"),
    (8, "same line here\nsame line here\nsame line here\n\n#*$%&|<>!!"), (None, "a row without an id and some words"),
    (9, "word " * 6000), (10, "x" * 30_000), (6, "one"), (11, "A!A!" * 40 + "\x0b\x1c\x85\xa0z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 1 else "en", None, "k", 0, 1) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_op1_trees_and_edits(spark, docs, empty):
    how = (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    count = token_counts.counter(*how)
    edits = spark.createDataFrame([(1, 0, 4, 3, "dog"), (1, 1, 0, 0, "  "), (7, 0, 2, 9, None), (4, 0, 50, 3, "new text"),
                                   (10, 0, 15_000, 1, " y"), (9, 0, 100, 29_000, ""), (99, 0, 1, 1, "z")],
                                  "doc_id long, seq int, start long, length long, insert string")
    counted = token_counts.count_tokens(token_counts.attach_edits(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), edits), *how)
    for r in counted.select("text", "n_tokens").collect():
        assert r.n_tokens == len(count.encoding.encode_ordinary(r.text or ""))
    want = dict(EDGE)
    for i, _, s, n, ins in sorted(rows_of(edits), key=lambda e: (e[0], e[1])):
        if i in want:
            t = want[i] or ""
            want[i] = t[:s] + (ins or "") + t[s + n:]
    after = {r.doc_id: r for r in token_counts.apply_edits(counted, *how).collect()}
    for i, r in after.items():
        assert r.text == (want[i] or "") and r.n_tokens == len(count.encoding.encode_ordinary(r.text))
        assert token_counts.Tree.from_bytes(r.token_tree).tokens == r.n_tokens
    assert after[9].encoded_chars < 31_000 and after[2].encoded_chars == 0
    assert token_counts.count_tokens(empty, *how).count() == 0


def test_op1_random_edits():
    count = token_counts.counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    letters = "ab c  \n'sreé1!|\t 日"
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 50, 900])))
        doc = token_counts.Edited(text, token_counts.build(text, count), count)
        for _ in range(4):
            s, n, ins = rng.randrange(len(text) + 3), rng.choice([0, 1, 2, 200]), "".join(rng.choices(letters, k=rng.choice([0, 1, 30])))
            doc.apply(s, n, ins)
            text = text[:s] + ins + text[s + n:]
            assert doc.text() == text and doc.tree.tokens == len(count.encoding.encode_ordinary(text))


def quality_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_op2_counts_and_edges(spark, docs, labels, empty):
    got = rows_of(quality_rules.assess(docs, labels))
    want = sorted(((i, *quality_counts(t)) for i, t in EDGE), key=str)
    assert sorted((r[:6] for r in got), key=str) == want
    for r in got:
        assert r[6] == (r[1] < 10 or 100 * r[5] > 20 * r[1]) and r[7] == (not r[6])  # too few labels for any cutoff
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r[7] for r in got)
    assert quality_rules.assess(empty, labels).count() == 0
    assert quality_rules.assess(docs, labels.limit(0)).count() == len(EDGE)


def test_op2_cutoffs_hold_their_bound(spark):
    from math import exp, lgamma, log
    rng = np.random.default_rng(3)
    n, risk = 3000, quality_rules.ALPHA / len(quality_rules.RULES)
    good = rng.random(n) < 0.8
    level = np.where(good, np.where(rng.random(n) < 0.004, 6, 1), rng.integers(0, 15, n))
    scored = spark.createDataFrame([(i, "en", int(v), 0, 0, 0, 0) for i, v in enumerate(level)],
                                   "id long, lang string, " + ", ".join(f"{r} int" for r in quality_rules.RULES))
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "id long, quality int")
    cut = quality_rules.learn_cutoffs(scored, labels).first()
    tests, m = len(quality_rules.RULES) * quality_rules.GRID, int(good.sum())
    best = None
    for c in range(quality_rules.GRID):
        k, bad = int((good & (level > c)).sum()), int((~good & (level > c)).sum())
        cdf = sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + i * log(risk) + (m - i) * log(1 - risk)) for i in range(k + 1))
        if cdf <= quality_rules.DELTA / tests and bad > k and (best is None or (bad - k, c) > best):
            best = (bad - k, c)
    assert best is not None and cut["__cut_symbols"] == best[1] and cut["__cut_capitals"] is None


def test_op2_every_language_is_a_stratum(spark):
    """A hundred languages, one of them with enough labels, and documents without a language."""
    rng = np.random.default_rng(5)
    rows = [(i, "big" if i < 3000 else None if i < 3050 else f"l{i % 100}", int(rng.integers(0, 15)) if i % 5 == 0 else 1,
             0, 0, 0, 0) for i in range(4000)]
    scored = spark.createDataFrame(rows, "id long, lang string, " + ", ".join(f"{r} int" for r in quality_rules.RULES))
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(4000)], "id long, quality int")
    cuts = quality_rules.learn_cutoffs(scored, labels).collect()
    assert [(c["stratum"], c["__cut_symbols"]) for c in cuts] == [("big", 1)]  # the others have too few for the bound


def test_op2_bound_against_the_sum(spark):
    """The tail against its terms added up, and with ten billion labels in a short while."""
    from math import exp, lgamma, log
    cases = [(n, k, p) for n in (1, 7, 60, 900, 40_000) for p in (0.01, 0.3) for k in {0, 1, int(n * p / 2), int(n * p) - 1}
             if 0 <= k < n * p]
    for n, k, p in cases:
        got = spark.range(1).select(quality_rules._log_binomial_cdf(F.lit(n), F.lit(k), p)).first()[0]
        terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log(1 - p) for i in range(k + 1)]
        assert abs(got - max(terms) - log(sum(exp(t - max(terms)) for t in terms))) < 1e-8
    far = spark.range(1).select(quality_rules._log_binomial_cdf(F.lit(10**10), F.lit(10**8 - 40_000), 0.01)).first()[0]
    assert -12.0 < far < -10.0  # 4.02 standard deviations below: log(2.9e-5) = -10.4


def test_op2_stage_with_clashing_names_and_edges(spark, docs, labels, empty):
    odd = docs.withColumns({"row": F.lit(1), "q": F.lit("q"), "stratum": F.lit("x"), "__kept": F.lit(False)})
    kept = quality_rules.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.select(docs.columns).collect())) == sorted(map(str, quality_rules.keep_good(docs, labels).collect()))
    assert quality_rules.keep_good(empty, labels).count() == 0
    text = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_count" not in text and "split" not in text  # no text is counted again


def test_op3_lookup_tables_equal_the_convolution():
    net = language_id.ByteCNN(["a", "b", "c"])
    x = np.concatenate([language_id.windows(t) for t in (b"Hello there", "Éx y ".encode() * 90)])
    h = np.maximum(net.pooled_slow(x), 0) @ net.p["o"] + net.p["c"]
    want = np.exp(h) / np.exp(h).sum(1, keepdims=True)
    assert np.allclose(net.predictor()(x), want, atol=1e-4)
    assert len(language_id.windows(b"a" * 600)) == 3 and len(language_id.windows(b"")) == 1


def test_op3_accuracy_and_edges(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(table)
    got = table.select("doc_id", "lang").join(language_id.identify(table, net), "doc_id").toPandas()
    held = got[got.held_out]
    assert 200 < len(held) < 500 and (held.lang == held.lang_pred).mean() > 0.95
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    edge = rows_of(language_id.identify(docs, net))
    assert len(edge) == len(EDGE)
    assert sorted(str(r[0]) for r in edge if r[2] == "und") == ["3", "4", "5"]
    assert all(0 <= r[3] <= 1 for r in edge)
    assert language_id.keep_identified(docs, net).columns == docs.columns
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0


def test_op3_learns_every_language(spark):
    rng = random.Random(6)
    names = [f"x{k:02d}" for k in range(100)]
    rows = [(i, f"{names[i % 100]} " * 30 + rng.choice("abc"), names[i % 100]) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(table, fit_docs=2)
    assert net.langs == names
    assert {r["lang_pred"] for r in language_id.identify(table.limit(50), net).collect()} <= set(names)


def test_op4_bytes_law(spark, docs, empty, real):
    for df, shards in ((docs, 3), (real, 24)):
        text = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
        got = sharding.assign_shards(df, shards).toPandas()
        assert len(got) == df.count() and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
        assert {(None if np.isnan(i) else int(i), c, s) for i, c, s in zip(got.doc_id, got.text_crc32, got["size"])} == {
            (i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in text}
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        per = got.groupby("shard")["size"].sum()
        assert per.max() <= got["size"].sum() / shards + got["size"].max()
    assert sharding.assign_shards(empty).count() == 0


def test_op4_overfull_ranges_and_written_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLES", 1)
    monkeypatch.setattr(sharding, "OVERFULL", 1.1)
    same = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "copy").otherwise(
        F.repeat(F.lit("y"), F.col("id").cast("int"))).alias("text"), F.lit(7).alias("size"))
    got = sharding.assign_shards(same, 6).toPandas()
    assert got.groupby("shard")["size"].sum().max() <= got["size"].sum() / 6 + got["size"].max()
    sharding.write_shards(same, f"{tmp_path}/s", 6)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == 600 and set(same.columns) <= set(back.columns)
    assert back.groupBy("shard_number", "slot_number").count().where("count > 1").count() == 0


def simhash(text, n=4):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_op6_against_brute_force(spark, docs, empty, real):
    for df in (docs, real):
        rows = [(r.doc_id, simhash(r.text)) for r in df.select("doc_id", "text").collect()]
        group = grouped(len(rows), lambda i, j: (rows[i][1] ^ rows[j][1]).bit_count() <= 4)
        first = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
        want = sorted(((i, f"{f:016x}", first[g]) for (i, f), g in zip(rows, group)), key=str)
        assert sorted(rows_of(simhash_dedup.near_duplicates(df)), key=str) == want
        kept = simhash_dedup.keep_first(df)
        assert kept.columns == df.columns
        assert sorted((str(r.doc_id) for r in kept.collect())) == sorted({str(i) for i, _, c in want if i is None or i == c})
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_op6_index_covers_every_pair_within_four_bits(spark):
    assert len(simhash_dedup.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash_dedup.TRIPLES) for four in itertools.combinations(range(8), 4))
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(6)} | set(base))
    fps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in near], "fp long")
    group = grouped(len(near), lambda i, j: (near[i] ^ near[j]).bit_count() <= 4)
    for block in (4_096, 3):  # a small block splits the lists
        found = components.components(simhash_dedup.links(fps, block=block))
        label = {r.node % (1 << 64): r.component for r in found.collect()}
        mine = [label.get(f, f) for f in near]
        assert len(set(zip(mine, group))) == len(set(mine)) == len(set(group))


def test_components(spark):
    path = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 202), (201, 202)]
    got = dict(rows_of(components.components(spark.createDataFrame(path, "a long, b long"))))
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 200: 200, 201: 200, 202: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_batches_are_bounded_by_rows_and_bytes(spark):
    from hourglass.llm.common import bounded_batches
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k in keys:
            spark.conf.unset(k)
        bounded_batches(spark, 300, 1 << 20)
        assert [int(spark.conf.get(k).removesuffix("b")) for k in keys] == [300, 1 << 20]
        bounded_batches(spark)
        assert [int(spark.conf.get(k).removesuffix("b")) for k in keys] == [300, 1 << 20]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_op7_paths_and_round_trip(spark, docs, empty):
    pieces = sentencepiece_lattice.Pieces.load(P.path("piece_bpe_32k.model"))
    got = {(r.doc_id, r.decoded): np.frombuffer(r.ids, "<u4").tolist() for r in sentencepiece_lattice.encode(docs, pieces).collect()}
    assert set(got) == {(i, t or "") for i, t in EDGE}
    for (_, text), ids in got.items():
        assert ids == [i for w in sentencepiece_lattice.words_of(text) for i in pieces.viterbi(w)]
    small = sentencepiece_lattice.Pieces({"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -2.5), "▁": (3, -1.0), "▁a": (4, -2.0)}, list(range(10, 266)))
    word = "▁aba"
    paths = [(sum(small.pieces.get(p, (0, small.unknown))[1] for p in cut), cut) for cut in
             ([word[i:j] for i, j in zip((0, *c), (*c, len(word)))] for k in range(4) for c in itertools.combinations(range(1, 4), k))
             if all(p in small.pieces for p in cut)]
    ids = small.viterbi(word)
    assert sum(next(s for i, s in small.pieces.values() if i == x) for x in ids) == max(s for s, _ in paths)
    assert sentencepiece_lattice.encode(empty, pieces).count() == 0


@pytest.mark.parametrize("rows, most", [(40_000, 300_000), (3, 5), (40_000, 0)])
def test_op7_common_and_own_segments(spark, monkeypatch, rows, most):
    """Ids are the same whatever is encoded once for the table; long segments, unknown characters and many runs included."""
    lattice = sentencepiece_lattice
    monkeypatch.setattr(lattice, "SAMPLE_ROWS", rows)
    monkeypatch.setattr(lattice, "MAX_COMMON", most)
    pieces = lattice.Pieces.load(P.path("piece_bpe_32k.model"))
    texts = ["the cat sat", "the cat sat on the mat", "the cat", None, "", " ", "a" * 700 + "\U0001F600\U0001F600é",
             "\u4e2d\u6587 the \U0001F600 cat", "x" * 300 + " cat " + "ab" * 200, "\n\nthe\tcat  \n", "the cat sat"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts * 3)], "doc_id long, text string, path string").coalesce(2)
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in lattice.encode(docs, pieces).collect()}
    assert len(got) == 3 * len(texts)
    for i, text in enumerate(texts * 3):
        assert got[i] == ([n for w in lattice.words_of(text) for n in pieces.viterbi(w)], text or "")


def test_op7_pruning_loses_nothing():
    """Beaten pieces are in no best path, and every piece lies behind the first start of its end."""
    lattice = sentencepiece_lattice
    table = {"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -2.5), "ba": (3, -2.0), "aba": (4, -0.5), "c": (5, -1.0), "abc": (6, -9.0)}
    pieces = lattice.Pieces(table, list(range(10, 266)))
    assert set(pieces.useful) == {"a", "b", "ba", "aba", "c"}
    without = lattice.Pieces(pieces.useful, list(range(10, 266)))
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abcd", repeat=n)]
    without.unknown = pieces.unknown
    assert [pieces.viterbi(w) for w in words] == [without.viterbi(w) for w in words]
    for w, starts in zip(words, pieces.starter()(words).to_pylist()):
        assert len(starts) == len(w)
        assert all(starts[e - 1] <= s for e in range(1, len(w) + 1) for s in range(e) if w[s:e] in pieces.useful)
    cut = pieces.cutter()
    for text in ("", None, "abacabac", "\U0001F600 ab\nba  c"):
        parts = cut(text)
        assert "".join(parts) == (lattice.MARK + text.replace(" ", lattice.MARK) if text else "")


def test_op7_an_end_is_one_row_with_all_its_edges(monkeypatch):
    """The ending at an end names every piece there, also where the tree's places clash; lost or torn ends are told."""
    lattice = sentencepiece_lattice
    monkeypatch.setattr(lattice, "_SLOTS", 1)
    table = {"a": (7, -1.0), "b": (1, -1.0), "ab": (2, -1.5), "ba": (3, -2.0), "aba": (4, -0.5), "\U0001F600b": (5, -1.0)}
    pieces = lattice.Pieces(table, list(range(10, 266)))
    words = ["".join(w) for n in range(1, 5) for w in itertools.product("abc\U0001F600", repeat=n)]
    length, score, row, begins = pieces.edges()
    names = list(pieces.useful)
    for w, starts in zip(words, pieces.starter()(words).to_pylist()):
        for e, s in enumerate(starts, 1):
            assert s == min([i for i in range(e) if w[i:e] in pieces.endings], default=e - 1)
            known = [(n, p, x) for n, p, x in zip(length, score, row)][slice(*begins[pieces.endings[w[s:e]]:][:2])] if w[s:e] in pieces.endings else []
            assert [(n, p, names[x]) for n, p, x in known if x >= 0] == [
                (e - i, pieces.useful[w[i:e]][1], w[i:e]) for i in range(e) if w[i:e] in pieces.useful]
            assert all((n, p, chr(-1 - x)) == (1, pieces.unknown, w[e - 1]) for n, p, x in known if x < 0)
    batch = lattice._ends(3, pa.array(["ab", "ba"]), pieces.starter())
    codes = [(p << lattice._ROW) + pieces.endings[x] + (1 << lattice._ROW - 1)
             for p, x in zip(batch.column(2).flatten().to_pylist(), ["a", "ab", "b", "ba"])]

    def grouped(codes):
        parts = [pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.nulls(len(part), pa.binary())], ["code", "docs"])
                 for part in (codes[:1], codes[1:])]
        return [r for b in lattice._group_ends(pieces)(iter(parts)) for r in b.to_pylist()]
    got = grouped(codes)
    assert [r["run"] for r in got] == [3, 3]
    assert [[[x["s"] for x in end] for end in r["ends"]] for r in got] == [[[0], [0, 1]], [[0], [0, 1]]]
    for torn in (codes[1:], codes[:1] + codes[2:], codes[:3], codes[::-1]):
        with pytest.raises(RuntimeError, match="torn"):
            grouped(torn)


@pytest.mark.parametrize("chars", [1, 7, 1 << 20])
def test_op7_batches_are_cut_like_their_texts(monkeypatch, chars):
    """The segments of a batch, numbered through Arrow's dictionary, are those of its texts one by one."""
    lattice = sentencepiece_lattice
    monkeypatch.setattr(lattice, "CUT_CHARS", chars)
    pieces = lattice.Pieces({"a": (0, -1.0), "b": (1, -1.0), "ba": (2, -1.5), "aba": (3, -0.5)}, list(range(10, 266)))
    texts = [None, "", "abacabac", "\U0001F600 ab\nba  c", "\u4e2d\u6587 \xe9ab", " ", "ab", "aba" * 20, None]
    cut, batch_cut = pieces.cutter(), pieces.batch_cutter()
    for batch in (texts, texts[::-1], [None, ""], []):
        segments, bounds = batch_cut(batch)
        held = segments.to_pylist()
        assert [held[i:j] for i, j in zip(bounds, bounds[1:])] == [cut(text) for text in batch]
        assert len(bounds) == len(batch) + 1 and (not batch or bounds[-1] == len(held))


def test_op10_pieces(spark, docs, empty, real):
    from tokenizers import Tokenizer
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for text in ("a<|endoftext|>b", "A <|ENDOFTEXT|> b", " <|startoftext|>  x\n<|endoftext|", "<|endoftext|><|endoftext|>", "| endoftext"):
        assert np.frombuffer(packing.tokenizer(path).encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    for df, capacity in ((docs, 64), (real, 2048)):
        texts = sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)
        got = packing.pack(df, path, capacity=capacity).toPandas()
        want = Counter()
        for i, t in texts:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            want[str(i)] += len(ids)
            mine = sorted({(s, bytes(x)) for d, s, x in zip(got.doc_id, got.start, got.ids) if str(i) == str(None if np.isnan(d) else int(d))})
            copies = sum(1 for j, _ in texts if j == i)
            if copies == 1:
                assert np.frombuffer(b"".join(x for _, x in mine), "<u4").tolist() == ids
        assert got.length.sum() == sum(want.values()) and (got.length > 0).all()
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= capacity
        assert (got.groupby("sequence_id").length.sum() < capacity).sum() <= df.rdd.getNumPartitions()
    assert packing.pack(empty, path).count() == 0


def test_op10_level_choice_is_the_minimum():
    rng = random.Random(4)
    packer = packing.Packer(20, max_open=10 ** 9)
    for k in range(400):
        n, before = rng.randint(1, 19), packer.counts.copy()
        costs = {}
        for h in [0, *np.flatnonzero(before[1:20 - n + 1]) + 1]:
            c = before.copy()
            c[h] -= h > 0
            c[h + n] += h + n < 20
            costs[int(h)] = int((c ** 2).sum())
        packer.add(k, b"\0\0\0\0" * n)
        assert int((packer.counts ** 2).sum()) == min(costs.values())


def test_op6_no_window_over_a_list(spark):
    fps = spark.range(50).select((F.col("id") * 3).alias("fp"))
    text = simhash_dedup.links(fps)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text
