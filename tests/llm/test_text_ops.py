"""Fill-in-middle, ranked search and byte-level BPE against their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from hourglass.llm import byte_bpe, fill_in_middle, ranked_search
from hourglass.llm.queries import QUERIES
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, id long, at string, n int, ids string, score int, rank int, query int"
EDGE = [
    (1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""),
    (5, " \n\t \r\n"), (6, "a"), (7, "日本語 ½ ﬁ́ İstanbul Σας <|endoftext|> a  b\n\n\nc 🙂🙂"), (8, "x <P> y"), (9, "<S>"),
    (10, "<M"), (11, "<S <P <"), (None, "no id on this mat"), (12, "<<<>>> P> S> M>"), (13, "THE Cat, the CAT; É é"),
    (14, "x" * 20_000), (15, "mat. " * 8_000), (16, "\x00\x00 cat\x00mat"),
]
FIM_PATTERN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
HOW = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 0, "z", 1, "i", 2, 3, 4) for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- fill in middle
def fim(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    units = FIM_PATTERN.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    if h4 % 100 < 20:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def key(row):
    return tuple((x is not None, x) for x in row)


def test_fim_matches_definition_and_restores(docs):
    out = fill_in_middle.transform(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in rows), key=key) == sorted((fim(i, t) for i, t in EDGE), key=key)
    assert sorted(r["back"] for r in rows) == sorted(t or "" for _, t in EDGE)


def test_fim_many_ids_take_all_forms_and_seams_make_no_marks(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["<", ">", "P", "S", "M", "ab", " ", "é"]) for _ in range(rng.randrange(14)))) for i in range(1500)]
    out = fill_in_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((fim(*r) for r in rows), key=key)
    assert {r["doc_id"]: r["back"] for r in got} == dict(rows)


def test_fim_runs_give_the_same_units():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "é", "\n", "1"]) for _ in range(rng.randrange(60)))
        one, two = rng.randrange(1 << 32), rng.randrange(1 << 32)
        whole = fill_in_middle.cuts(text, one, two)
        units = FIM_PATTERN.findall(text)
        a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
        assert whole == (len(units), len("".join(units[:a])), len("".join(units[:b])))
        for size in (1, 2, 7):
            assert fill_in_middle.cuts(text, one, two, size) == whole


def test_fim_very_long_text():
    text = "ab. " * 700_000  # 2.8 million characters, several runs
    n, first, second = fill_in_middle.cuts(text, 1_500_000, 2_000_000)
    assert (n, first, second) == (2_100_000, 4 * 500_000, 4 * 666_666 + 3)
    assert fill_in_middle.cuts("x" * 3_000_000, 1, 0) == (1, 0, 3_000_000)


def test_fim_empty_table_and_one_python_pass(docs, empty):
    assert fill_in_middle.transform(empty).collect() == []
    out = fill_in_middle.transform(docs).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form")))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1


# ---------------------------------------------------------------- byte-level BPE
def lowest_rank_first(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the leftmost pair of lowest rank until there is none."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1]:found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


def test_rank_queue_gives_the_lowest_rank_in_order():
    rng = random.Random(1)
    for ranks in (1, 2, 64, 65, 5_000, 300_000):
        queue, held = byte_bpe.RankQueue(ranks), {}
        for _ in range(400):
            if held and rng.random() < 0.3:
                r = queue.lowest()
                assert r == min(held)
                assert queue.take(r) == sorted(held.pop(r))
            else:
                r, some = rng.choice([0, ranks - 1, rng.randrange(ranks)]), [rng.randrange(1000) for _ in range(rng.randrange(1, 4))]
                queue.push(r, some)
                held.setdefault(r, []).extend(some)
        while held:
            r = queue.lowest()
            assert r == min(held) and queue.take(r) == sorted(held.pop(r))
        assert queue.lowest() == -1 and not any(map(any, queue.levels))


@pytest.mark.parametrize("at_once", [1, 3, 10**9])
def test_bpe_order_of_merges_with_any_ranks(monkeypatch, at_once):
    """Vocabularies whose ranks follow no training order, where a merge may open a pair of lower rank."""
    monkeypatch.setattr(byte_bpe, "ALL_AT_ONCE", at_once)
    rng = random.Random(2)
    refused = []
    plain = byte_bpe.Line.merge_all

    def watched(self, r, positions):
        done = plain(self, r, positions)
        refused.append(not done)
        return done

    monkeypatch.setattr(byte_bpe.Line, "merge_all", watched)
    for _ in range(60):
        long = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 25))}
        order = rng.sample(range(300), 300)
        ranks = {t: order[i] for i, t in enumerate([bytes([b]) for b in range(256)] + sorted(long))}
        vocab = byte_bpe.Vocabulary(ranks, r"[^ ]+| ")
        words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
        got = [np.frombuffer(x, "<i4").tolist() for x in vocab.merged([w.encode() for w in words])]
        assert got == [lowest_rank_first(w.encode(), ranks) for w in words]
        assert vocab.queue.lowest() == -1
    assert at_once == 10**9 or (any(refused) and not all(refused))


def test_bpe_without_merges_or_matches():
    vocab = byte_bpe.Vocabulary({bytes([b]): 255 - b for b in range(256)}, r"[^ ]+")
    assert [list(np.frombuffer(x, "<i4")) for x in vocab.encode(["ab", "", "  ", "a b"])] == [[158, 157], [], [], [158, 157]]
    assert vocab.encode([]) == []


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.load_ranks(HOW[0])
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_agrees_with_the_library(spark, docs, empty, library):
    out = byte_bpe.decode(byte_bpe.encode(docs, *HOW), HOW[0])
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r["doc_id"] or -1, r["ids"], bytes(r["decoded"])) for r in out.collect()))
    assert got == sorted((i or -1, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in EDGE)
    assert byte_bpe.decode(byte_bpe.encode(empty, *HOW), HOW[0]).collect() == []
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r["doc_id"]: r for r in QUERIES["op13_byte_bpe"](spark, SF_SMALL).collect()}
    texts = {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode_ordinary(text)
        assert rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_very_long_match_and_random_strings(library):
    vocab = byte_bpe.Vocabulary(byte_bpe.load_ranks(HOW[0]), HOW[1])
    rng = random.Random(4)
    def encode(text):
        return np.frombuffer(vocab.encode([text])[0], "<i4")

    long = "".join(rng.choice("etaoinshrdluéß語") for _ in range(300_000))
    assert encode(long).tolist() == library.encode_ordinary(long)
    assert encode("a" * 50_001).tolist() == library.encode_ordinary("a" * 50_001)
    for _ in range(500):
        text = "".join(rng.choice(["a", "the", " ", "\n", "é", "1", "'s", "!", "日", "🙂", "\t", "ing", "X"]) for _ in range(rng.randrange(80)))
        ids = encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert byte_bpe.Decoder(vocab.ranks).decode(ids.tolist()) == text.encode()


def test_bpe_forgets_without_changing_ids(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_MATCHES", 3)
    monkeypatch.setattr(byte_bpe, "CHUNK_BYTES", 8)
    monkeypatch.setattr(byte_bpe, "CACHE_LENGTH", 9)
    vocab = byte_bpe.Vocabulary(byte_bpe.load_ranks(HOW[0]), HOW[1])
    texts = ["unfamiliarity breeds contemptuousness, " * 5 + "zzyzx quuxly", "breeds zzyzx, antidisestablishment", "quuxly", "zzyzx"]
    for some in (texts, texts[::-1], texts[1:2], texts):
        assert [np.frombuffer(x, "<i4").tolist() for x in vocab.encode(some)] == [library.encode_ordinary(t) for t in some]
    assert len(vocab.known) <= 12 and max(map(len, vocab.known)) <= 9


def test_bpe_refuses_a_broken_vocabulary(spark):
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({b"a": 0}, ".")
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary({bytes([b]): 0 for b in range(256)}, ".")
    with pytest.raises(Exception, match="KeyError"):
        byte_bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id long, ids array<int>"), HOW[0]).collect()


# ---------------------------------------------------------------- ranked search
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    lower = {c: c + 32 for c in range(65, 91)}
    return TERMS.findall((text or "").translate(lower))


def ranked(docs, items, k):
    """Score of every document for every item by the definition."""
    counted = [(i, words(t)) for i, t in docs]
    counted = [(i, w) for i, w in counted if w]
    n_docs, total = len(counted), sum(len(w) for _, w in counted)
    out = []
    for item, text in items:
        scored = []
        for i, w in counted:
            m, score = 25 + 75 * len(w) * n_docs // total, 0
            for t in words(text):
                tf = w.count(t)
                if tf:
                    df = sum(t in x for _, x in counted)
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, i is not None, i))
        scored.sort(key=lambda x: x if x[1] else x[:2])
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=key)


ITEMS = [(1, "the cat and the mat"), (2, "CAT cat é"), (3, None), (4, ""), (5, "nothing like it"), (5, "mat mat mat"),
         (6, "the cat and the mat"), (6, "the cat and the mat"), (None, "sat id"), (7, "... !"), (8, "Σας 日本語 " + "x" * 20_000)]


def test_search_matches_definition(spark, docs, empty):
    items = spark.createDataFrame([(i, t, 0, 1) for i, t in ITEMS], "item_id long, text string, doc_id int, query int")
    for k, cells, size in ((10, 4 << 20, 1 << 20), (1, 50, 1 << 20), (3, 1, 60)):
        out = ranked_search.rank(docs, items, k, cells=cells, query_bytes=size)
        assert out.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in out.collect()), key=key) == ranked(EDGE, ITEMS, k)
    assert ranked_search.rank(empty, items).collect() == []
    assert ranked_search.rank(docs, items.limit(0)).collect() == []
    assert ranked_search.rank(docs, items.where("item_id IN (3, 4, 7)")).collect() == []


def test_search_random_with_many_ties(spark):
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.expovariate(0.15))}" for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 8, 30])))) for i in rng.sample(range(10_000), 400)]
    items = [(j, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12])))) for j in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    expected = ranked(rows, items, 5)
    for cells in (4 << 20, 700):
        out = ranked_search.rank(frame, asked, 5, cells=cells).collect()
        assert sorted((tuple(r) for r in out), key=key) == expected
    text_ids = ranked_search.rank(frame.withColumn("doc_id", F.format_string("d%05d", "doc_id")), asked, 5).collect()
    assert sorted(((i, r, int(d[1:]), s) for i, r, d, s in text_ids), key=key) == expected


def lists(rng, size, n_terms):
    doc, term, impact = [], [], []
    for t in range(n_terms):
        for d in sorted(rng.sample(range(size), rng.randrange(1, size))):
            doc.append(d)
            term.append(t)
            impact.append(rng.randrange(1, 40))
    return np.array(doc), np.array(term), np.array(impact, np.int64)


def test_best_positions_stop_early_and_strictly():
    """The stop keeps every document of the k best, ties included, and reads fewer positions than the lists have."""
    rng = random.Random(11)
    early = 0
    for _ in range(200):
        size, n_terms, k = rng.randrange(2, 150), rng.randrange(1, 6), rng.randrange(1, 6)
        doc, term, impact = lists(rng, size, n_terms)
        block = ranked_search.Block(size, doc, term, impact, n_terms + 1)
        wanted = np.array(rng.sample(range(n_terms + 1), rng.randrange(1, n_terms + 1)))
        repeats = np.array([rng.randrange(1, 3) for _ in wanted])
        whole = np.zeros(size, np.int64)
        for t, r in zip(wanted, repeats):
            np.add.at(whole, doc[term == t], r * impact[term == t])
        offered: dict[int, int] = {}

        def offer(docs, scores):
            for d, s in zip(docs.tolist(), scores.tolist()):
                assert d not in offered
                offered[d] = s

        def kth():
            return sorted(offered.values())[-k] if len(offered) >= k else None

        block.search(wanted, repeats, kth, offer)
        assert all(whole[d] == s for d, s in offered.items())
        best = sorted(((-s, d) for d, s in enumerate(whole.tolist()) if s), key=lambda x: x)[:k]
        assert sorted((-s, d) for d, s in offered.items() if s)[:k] == best
        early += block.reads < sum(block.size[block.row[t]] for t in wanted if block.row[t] >= 0)
    assert early > 60


def test_search_skips_a_block_that_cannot_matter():
    block = ranked_search.Block(3, np.array([0, 1, 2]), np.array([0, 0, 0]), np.array([5, 4, 3]), 1)
    block.search(np.array([0]), np.array([1]), lambda: 6, lambda *_: pytest.fail("read for nothing"))
    assert block.reads == 0
    met = []
    block.search(np.array([0]), np.array([1]), lambda: 5, lambda docs, _: met.extend(docs.tolist()))
    assert met[0] == 0  # an equal score may still win by its id


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_ranked_search"])
def test_query_equals_its_sql(spark, duck, name):
    from hourglass.llm.queries import ORACLE
    df = QUERIES[name](spark, SF_SMALL)
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=key) == sorted(found.fetchall(), key=key)
