"""Operators on pages and vectors, the queries and the pipeline."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourglass.llm import embedding_dedup, html_wrapper, warc_zip
from tests.conftest import SF_SMALL
from tests.llm.test_documents import grouped

PAGE = "page_id long, url string, html string, host string, id long, text string"


def test_op5_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 24))
    x = [b + rng.normal(0, s, 24) for b in base for s in (0, 0.02, 0.05, 0.1, 0.25)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, x[0].tolist()), (501, x[0].tolist()), (502, (x[0] * 3).tolist())]
    odd = [(600, None), (601, []), (602, [0.0] * 24), (603, [float("nan")] + [1.0] * 23), (604, [None] + [1.0] * 23),
           (605, [float("inf")] * 24), (606, [1.0, 0.0]), (607, [1.0, 0.01])]
    df = spark.createDataFrame([(i, v, "n", 5) for i, v in rows + odd], "vec_id long, embedding array<double>, n string, key int")
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ok = m @ m.T >= 0.95
    for block in (embedding_dedup.BLOCK, 4):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block=block).collect()}
        links = np.array([got[i].n_links for i, _ in rows])
        want = ok.sum(1) - 1
        assert (links <= want).all() and links.sum() >= 0.95 * want.sum()
        if (links == want).all():
            group = grouped(len(rows), lambda i, j: ok[i, j])
            for (i, _), g in zip(rows, group):
                assert got[i].component_id == min(rows[k][0] for k in range(len(rows)) if group[k] == g)
        assert all(got[i].n_links == 0 and got[i].kept for i in (600, 601, 602, 603, 604, 605))
        assert got[607].component_id == 606 and not got[607].kept and got[606].n_links == 1
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op5_large_buckets_count_each_pair_once(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    x = centre + rng.normal(0, 0.04, (400, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    for block in (2_048, 90):
        got = embedding_dedup.near_duplicates(df, block=block).toPandas().sort_values("vec_id")
        assert (got.n_links.values <= want).all() and got.n_links.sum() >= 0.9 * want.sum()
        assert (got.component_id == 0).all()


def test_op8_round_trip_and_edges(spark):
    rows = [(5, "http://a.example/x", "<p>é</p>"), (3, "http://a.example/y", "<p>é</p>"), (4, None, None), (9, "u\r\n", ""),
            (7, "http://b.example", "z" * 300_000), (3, "http://a.example/y", "<p>é</p>"), (None, "http://c", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "h", 1, "t") for r in rows], PAGE)
    back = warc_zip.round_trip(pages).collect()
    key = lambda i, h: (str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode())
    assert sorted((str(r.id), r.payload_bytes, r.payload_digest) for r in back) == sorted(key(i, h) for i, _, h in rows)
    roles = {(str(r.id), r.record_type, r.refers_to) for r in back}
    assert roles == {("5", "revisit", 3), ("3", "response", None), ("4", "response", None), ("9", "revisit", 4),
                     ("7", "response", None), ("None", "response", None)}
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_op8_one_id_with_two_payloads(spark):
    rows = [(1, "shared"), (2, "shared"), (2, "only here"), (2, "shared"), (3, "third"), (4, "third"), (4, "shared")]
    pages = spark.createDataFrame([(i, f"http://a.example/{i}", h, "h", 1, "t") for i, h in rows], PAGE)
    name = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    back = sorted((r.id, r.payload_digest, r.refers_to or 0, (r.payload or b"").decode()) for r in warc_zip.round_trip(pages).collect())
    want = {(1, "shared"): 0, (2, "shared"): 1, (2, "only here"): 0, (3, "third"): 0, (4, "third"): 3, (4, "shared"): 1}
    assert back == sorted((i, name(h), want[i, h], "" if want[i, h] else h) for i, h in rows)


class Bytes:
    def __init__(self, raw):
        self.raw = raw

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        return self.raw[at:at + n]


@pytest.mark.parametrize("limit", [warc_zip._FULL, 10])  # 10: every size and offset goes through ZIP64 fields
def test_op8_zip_is_read_by_others_and_by_ranges(limit):
    out = io.BytesIO()
    w = warc_zip.ZipWriter(out, limit)
    record = gzip.compress(warc_zip.record(1, "u", b"body", warc_zip.digest(b"body"), None), mtime=0)
    w.begin(warc_zip.DATA)
    w.write(record)
    w.end()
    w.begin(warc_zip.INDEX)
    w.write(b"a\nb\n")
    w.end()
    w.close()
    raw = out.getvalue()
    r = warc_zip.ZipRangeReader(Bytes(raw))
    assert r.read(warc_zip.DATA, 2, 5) == record[2:7] and list(r.lines(warc_zip.INDEX)) == ["a", "b"]
    assert warc_zip.parse_record(gzip.decompress(r.read(warc_zip.DATA, 0, len(record))))[1] == b"body"
    with pytest.raises(ValueError):
        r.read(warc_zip.DATA, 0, len(record) + 1)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.read(warc_zip.INDEX) == b"a\nb\n"
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.writestr("x", b"12345")
    assert warc_zip.ZipRangeReader(Bytes(other.getvalue())).read("x", 1, 3) == b"234"
    with pytest.raises(ValueError):
        warc_zip.ZipRangeReader(Bytes(raw[:-5]))


def test_op9_whole_table_against_the_article(spark):
    got = html_wrapper.extract(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).toPandas()
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").toPandas().merge(got, on="page_id")
    assert len(pages) == len(got)
    for page, text, n in zip(pages.html, pages.text, pages.n_chars):
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", page, re.S).group(1))
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[a-z/][^>]*>", " ", re.sub("</?b>", "", x)))).strip() for x in parts]
        assert text == "\n\n".join(x for x in parts if x) and n == len(text)


def test_op9_wrapper_drops_constants_and_furniture(spark):
    def page(k):
        return (f"<html><head><title>t{k}</title></head><body><header>Site</header><div class='intro'>Welcome to the site</div>"
                f"<div class='story'><h2>Head {k}</h2><p>Text &amp;<b> more</b> <i>{k}.</i><p>Second\n  part {k}<br>end</div>"
                f"<div class='legal'><p>All rights reserved</p></div><aside>side {k}</aside><div class='comments'>c{k}</div></body></html>")
    rows = [(k, "http://h.example/%d" % k, page(k), None, 0, "x") for k in range(6)]
    rows += [(10, "http://h.example/9", None, None, 0, None), (11, None, "<p>alone</p>", None, 0, None), (12, "junk", "a < b <i>c</i> <", None, 0, None),
             (13, "http://one.example/", "<ul><li><a href=x>link only</a></li></ul><p>" + "long " * 5000 + "</p><script>x</script><div", None, 0, None)]
    df = spark.createDataFrame(rows, PAGE)
    got = {r.page_id: r.text for r in html_wrapper.extract(df).collect()}
    for k in range(6):
        assert got[k] == f"Head {k}\n\nText & more {k}.\n\nSecond part {k} end", got[k]
    assert got[10] == "" and got[11] == "alone" and got[12] == "a < b c <" and got[13] == ("long " * 5000).strip()
    assert html_wrapper.extract(df.limit(0)).count() == 0


def _story(k, more=""):
    return (f"<html><body><div class='intro'>Welcome</div><div class='story'><h2>Head {k}</h2><p>Text {k}</p></div>{more}"
            f"<div class='legal'><p>All rights reserved</p></div></body></html>")


def _texts(spark, pages):
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p, None, 0, None) for k, p in enumerate(pages)], PAGE)
    return [r.text for r in sorted(html_wrapper.extract(df).collect(), key=lambda r: r.page_id)]


def test_op9_wrapper_counts_all_distinct_pages(spark):
    # groups of copies, also such that only a script, a comment or an aside tells apart
    copies = [_story(k) for k in range(12) for _ in range(9)]
    copies += [_story(k, f"<script>track({n})</script><!-- {n} --><aside>{n}</aside>") for k in range(12) for n in range(9)]
    assert _texts(spark, copies) == [f"Head {k}\n\nText {k}" for k in range(12) for _ in range(9)] * 2
    same = [f"<body><!-- {n} --><script>{n}</script><div>One page</div></body>" for n in range(9)]
    assert _texts(spark, same) == ["One page"] * 9
    # a block that most but not all pages have, and a second template, rarer than any eight pages of the host would show
    some = [_story(k, "<hr>" * (k % 3)) for k in range(60)]
    some += [f"<html><body><div class='list'>Latest</div><div class='entry'>Entry {k}</div></body></html>" for k in range(4)]
    assert _texts(spark, some) == [f"Head {k}\n\nText {k}" for k in range(60)] + [f"Entry {k}" for k in range(4)]


def test_op9_templates_and_odd_pages_of_one_host(spark):
    # optional boxes in all combinations: no two stories have the same containers
    boxes = ["".join(f"<div class='box{b}'>Box {b} of {k}</div>" for b in range(3) if k >> b & 1) for k in range(8)]
    pages = [_story(k, more) for k, more in enumerate(boxes)]
    want = ["\n\n".join([f"Head {k}", f"Text {k}", *(f"Box {b} of {k}" for b in range(3) if k >> b & 1)]) for k in range(8)]
    # a second template, a rarer third with the containers of the first one's site, an error and an empty page
    pages += [f"<html><body><div class='top'>Latest</div><section class='list'><div class='entry'>Entry {k}</div></section></body></html>" for k in range(8)]
    want += [f"Entry {k}" for k in range(8)]
    pages += [_story(k).replace("story", "product").replace("Welcome", "Shop") for k in range(3)]
    want += [f"Head {k}\n\nText {k}" for k in range(3)]
    pages += ["<html><body><div class='error'>Not found</div><div class='legal'><p>All rights reserved</p></div></body></html>", "<html></html>"]
    want += ["Not found", ""]
    assert _texts(spark, pages) == want


def test_op9_template_on_short_and_very_long_pages(spark):
    def page(k, n):
        text = "".join(f"<p>Paragraph {i} of {k}</p>" for i in range(n))
        return (f"<html><body><div><div>Welcome</div></div>{text}"
                f"<div class='closing'><div class='legal'>All rights reserved</div><div class='date'>Day {k}</div></div></body></html>")
    sizes = [250, 2, 1_400, 260, 3_000, 300, 240, 270, 255, 1]
    want = ["\n\n".join([f"Paragraph {i} of {k}" for i in range(n)] + [f"Day {k}"]) for k, n in enumerate(sizes)]
    assert _texts(spark, [page(k, n) for k, n in enumerate(sizes)]) == want


def test_op9_tree_matching_is_the_same_at_every_size():
    rng = np.random.default_rng(3)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.integers(0, 3))] if depth else []
        tag = "abcdefgh"[rng.integers(8)]
        return [tag, "", hash((tag, *(k[2] for k in kids))), kids]

    def size(a):
        return 1 + sum(map(size, a[3]))

    def weight(a, b):
        return 0 if a[0] != b[0] else 2 * size(a) if a[2] == b[2] else 1 + aligned(a[3], b[3])

    def aligned(xs, ys):  # the definition, by the whole table
        best = [0] * (len(ys) + 1)
        for x in xs:
            row = [0]
            for j, y in enumerate(ys):
                row.append(max(row[j], best[j + 1], best[j] + weight(x, y)))
            best = row
        return best[-1]

    for m, n in [(0, 3), (1, 1), (7, 12), (40, 30), (220, 260)]:
        xs, ys = [tree(2) for _ in range(m)], [tree(2) for _ in range(n)]
        total, pairs = html_wrapper._align(xs, ys)
        assert total == aligned(xs, ys) == sum(weight(xs[i], ys[j]) for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))


def test_op9_linked_headings_and_paragraphs_stay():
    page = ("<body><h1><a href=/1>A headline</a></h1><p>See <a href=/2>a long reference</a>, <a href=/3>and another</a>.</p>"
            "<div><a href=/4>One link</a></div><ul><li><a href=/5>Menu</a></li><li><p><a href=/6>entry</a></p></li></ul>"
            "<div><a href=/7>Home</a> | <a href=/8>News</a></div><ul><li>An item with <a href=/9>a link</a></li></ul></body>")
    assert html_wrapper.main_text(page).split("\n\n") == [
        "A headline", "See a long reference, and another.", "One link", "An item with a link"]


def test_op9_simple_tree_matching():
    leaf = lambda t, h: [t, "", h, []]
    a = ["div", "", 1, [leaf("p", 11), leaf("ul", 12), leaf("p", 13)]]
    b = ["div", "", 2, [leaf("p", 11), leaf("p", 14)]]
    weight, pairs = html_wrapper._align(a[3], b[3])
    assert pairs == [(0, 0), (2, 1)] and weight == 3
    common = html_wrapper._common(a, b)
    assert common[2] is None and [x[2] for x in common[3]] == [11, None]


def test_queries_are_registered_and_pipeline_runs(spark):
    import __spark_entry__ as E
    import corpus_pipeline
    names = [k for k in E.queries() if re.match(r"op\d+_", k)]
    assert sorted(int(re.match(r"op(\d+)_", k).group(1)) for k in names) == list(range(1, 14))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF_SMALL)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    out = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert set(out.doc_id) == ids and 0 < len(ids) < docs.count()
    full = out.groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert (full.n == full.want).all()
    assert E.queries()["pipeline"] is corpus_pipeline.run


def test_quality_query_equals_its_sql(spark):
    import duckdb

    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    want = con.execute(E.oracle_sql()["op2_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    got = E.queries()["op2_quality_rules"](spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c
