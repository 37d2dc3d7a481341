"""Main text of web pages by wrapper induction.

Pages of one host are mostly made by one template or a few.  All distinct pages of a host are
read: every block that may belong to a template is counted by its path of elements and classes
and its content.  Pages with the same containers have one shape, and shapes whose
trees of containers agree by simple tree matching are of one make, so an optional box makes no new
template and an error or login page takes nothing from the others.  A block that at least
``MIN_REFERENCES`` distinct pages and over half of the distinct pages of a shape or make have is a
constant, and the host's wrapper is the set of the constants of all its shapes and makes.  Constants are dropped from every
page of the host and the rest, the slots, give the text, without the elements that are never part
of an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments of
readers), by element, role or class.  If the slots hold an article or main element, only it counts.

A make of fewer than ``MIN_REFERENCES`` distinct pages has no constants of its own.  Pages that read
the same without scripts, comments and furniture count as one.  Only whole blocks can be constants,
not words within one; inside an article only containers, never paragraphs, headings, lists or
tables, can be constants, so a sentence that many articles share stays.

Counts travel as hashes, not as texts, added up before they are shuffled; pages meet their wrapper
in an equi-join on the host, whose skewed side AQE splits; the pages' html travels compressed.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourglass.llm.common import bounded_batches, stored

#: Distinct pages that a constant needs.
MIN_REFERENCES = 3
#: Shapes are of one make if the matched part of their trees is at least this share of both.
AGREEMENT = 2 / 3
#: Deeper elements are kept as children of the element at this depth.
MAX_DEPTH = 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)/?>", re.S)
_CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<]*\Z")
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul".split())
_ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}}
_SCOPE = frozenset("html body table td th ul ol dl div section article main nav aside header footer form blockquote button".split())
#: Elements, roles and words of class or id that are never part of an article.
DROP_TAGS = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas object embed button select "
    "textarea input label dialog menu title audio video".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription sidebar widget "
    "menu nav navbar navigation navigator breadcrumb breadcrumbs footer masthead comment comments commentlist disqus "
    "reply replies respond related recommended share sharing social login signin signup search toolbar pagination pager "
    "skip copyright".split())
_PAGE_HEADER = frozenset(("header",))
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tbody tr td th blockquote pre figure figcaption #".split())


_LISTS = frozenset("ul ol dl dir menu".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption".split())
_KEPT = frozenset(("article", "main", "body"))


class Node:
    """An element, or a text ("#") with its decoded text."""

    __slots__ = ("tag", "key", "kids", "text", "drop", "sig")

    def __init__(self, tag: str, key: str = "", text: str = "", drop: bool = False):
        self.tag, self.key, self.text, self.drop = tag, key, text, drop
        self.kids: list[Node] = []
        self.sig = None


def _element(tag: str, attributes: str) -> Node:
    key, drop = "", tag in DROP_TAGS
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "class" or name == "id":
                if name == "class":
                    key = value
                words = _WORD.findall(value)
                drop = drop or (tag not in ("body", "html", "main", "article") or "comment" in words) and not DROP_WORDS.isdisjoint(words)
            elif name == "role":
                drop = drop or value in DROP_ROLES
                key += "/" + value
            elif name == "style":
                drop = drop or "display:none" in value.replace(" ", "")
            else:
                drop = drop or name == "hidden" or value == "true"
    return Node(tag, key, drop=drop)


def parse(page: str) -> Node:
    """The tree of a page; unclosed and misplaced tags are mended as browsers do for common cases."""
    root = Node("html")
    stack, at, n = [root], 0, len(page)

    def text(s: str) -> None:
        if s and not s.isspace():
            stack[-1].kids.append(Node("#", text=html_lib.unescape(s) if "&" in s else s))
        elif s and stack[-1].kids:
            stack[-1].kids.append(Node("#", text=" "))

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(_CUT_TAG.sub("", page[at:]))
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        closes = _SIBLINGS.get(tag)
        if closes:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    del stack[i:]
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[i].tag in _SCOPE and stack[i].tag not in ("td", "th"):
                    break
        if tag == "body" and len(stack) > 1 and stack[1].tag == "head":
            del stack[1:]
        node = _element(tag, m.group(3))
        stack[-1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            node.kids.append(Node("#", text=page[at:end.start() if end else n]))
            if end is None:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        if len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def _shown(node: Node) -> list[Node]:
    """Children without the white space between them, which only matters to the text."""
    return [k for k in node.kids if k.tag != "#" or not k.text.isspace()]


def sign(node: Node) -> int:
    """Hash of a subtree's elements and texts, without what is dropped; set on every node that is not."""
    if node.tag == "#":
        node.sig = zlib.crc32(_WHITE.sub(" ", node.text).strip().encode("utf-8", "replace"))
    else:
        node.sig = zlib.crc32(f"{node.tag} {node.key} {[sign(k) for k in _shown(node) if not k.drop]}".encode())
    return node.sig


# Trees below are lists [tag, key, hash, children]; the hash is None where content varies.

def _weight(a: list, b: list, known: dict) -> int:
    """Simple tree matching: the number of pairs in a largest order-preserving top-down matching; pairs
    of equal content count twice."""
    if a[0] != b[0] or a[1] != b[1]:
        return 0
    if a[2] is not None and a[2] == b[2]:
        return 2 * _size(a)
    if not a[3] or not b[3]:
        return 1
    return 1 + _align(a[3], b[3], known)[0]


def _align(xs: list, ys: list, known: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Best order-preserving matching of two lists of trees, whatever their length: its weight and pairs.

    Only children with the same element and class are compared, so memory and time go with the number of
    such pairs; children of a shape's tree all differ in these.  ``known`` keeps the matchings of lists
    further down, by identity, so the lists must live as long as it does.
    """
    known = {} if known is None else known
    name = id(xs), id(ys)
    if name in known:
        return known[name]
    where: dict = {}
    for j, y in enumerate(ys):
        where.setdefault((y[0], y[1]), []).append(j)
    cells: list[tuple] = [(0, -1, -1, 0)]  # weight of the best chain that ends here, its pair, the cell before
    top = [0] * (len(ys) + 1)  # Fenwick tree of the best cells by the end of their ranges of j
    for i, x in enumerate(xs):
        for j in reversed(where.get((x[0], x[1]), ())):  # from the right, so no chain takes x twice
            best, k = 0, j
            while k:
                if cells[top[k]][0] > cells[best][0]:
                    best = top[k]
                k &= k - 1
            cells.append((cells[best][0] + _weight(x, ys[j], known), i, j, best))
            k = j + 1
            while k <= len(ys):
                if cells[-1][0] > cells[top[k]][0]:
                    top[k] = len(cells) - 1
                k += k & -k
    at = max(range(len(cells)), key=lambda c: cells[c][0])
    total, pairs = cells[at][0], []
    while at:
        pairs.append(cells[at][1:3])
        at = cells[at][3]
    known[name] = total, pairs[::-1]
    return known[name]


def makes(shapes: list[tuple[int, list]]) -> list[list[int]]:
    """Groups of (pages, tree) by their indexes: every tree on its own, and the makes of more than one
    tree, the trees with most pages first; a tree joins the make whose first tree it agrees with most."""
    found: list[list[int]] = []
    for i in sorted(range(len(shapes)), key=lambda i: (-shapes[i][0], shapes[i][1][2])):
        tree = shapes[i][1]
        best, make = 0.0, None
        for group in found:
            first = shapes[group[0]][1]
            agreed = 2 * _size(_common(first, tree)) / (_size(first) + _size(tree)) if first[:2] == tree[:2] else 0.0
            if agreed > best:
                best, make = agreed, group
        if best >= AGREEMENT:
            make.append(i)
        else:
            found.append([i])
    return [[i] for i in range(len(shapes))] + [m for m in found if len(m) > 1]


def _size(tree: list) -> int:
    return 1 + sum(map(_size, tree[3]))


def _common(a: list, b: list, known: dict | None = None) -> list:
    """What two aligned nodes share; children that only one of them has are left out."""
    known = {} if known is None else known
    if a[2] is not None and a[2] == b[2]:
        return a
    return [a[0], a[1], None, [_common(a[3][i], b[3][j], known) for i, j in _align(a[3], b[3], known)[1]]]


def _template_blocks(node: Node, path: int = 0, inside: bool = False) -> Iterator[tuple[Node, int]]:
    """Blocks of a signed page that may be constants, each with a hash of its path and content; a block
    that is dropped is not descended into."""
    inside = inside or node.tag in ("article", "main")
    for k in node.kids:
        if k.tag == "#" or k.drop:
            continue
        at = zlib.crc32(f"{path} {k.tag} {k.key}".encode())
        if k.tag in BLOCK and k.tag not in VOID and k.tag not in _KEPT and not (inside and k.tag in _TEXTUAL):
            yield k, (at << 32 | k.sig) - (1 << 63)
            if k.drop:
                continue
        yield from _template_blocks(k, at, inside)


def _containers(node: Node, found: dict) -> dict:
    """The containers of a page outside its article: {(tag, class): containers within}."""
    for k in node.kids:
        if k.tag == "#" or k.drop:
            continue
        within = found.setdefault((k.tag, k.key), {}) if k.tag in BLOCK and k.tag not in _TEXTUAL else found
        if k.tag not in ("article", "main"):
            _containers(k, within)
    return found


def pack_shape(tag: str, key: str, found: dict) -> list:
    """Containers as a tree [tag, class, hash, children]; the order on the page does not matter."""
    kids = [pack_shape(*name, found[name]) for name in sorted(found)]
    return [tag, key, zlib.crc32(f"{tag} {key} {[k[2] for k in kids]}".encode()), kids]


def read_page(page: str) -> tuple[bytes, list, list[int]]:
    """Digest of what a page reads without scripts, comments and furniture, its shape, and the
    hashes of the blocks that may be constants."""
    root = parse(page)
    sign(root)
    told = hashlib.blake2b(digest_size=16)
    todo = [root]
    while todo:
        x = todo.pop()
        kids = [k for k in _shown(x) if not k.drop]
        told.update(f"<{x.tag} {x.key} {len(kids)}>{_WHITE.sub(' ', x.text).strip()}".encode("utf-8", "replace"))
        todo.extend(reversed(kids))
    shape = pack_shape(root.tag, root.key, _containers(root, {}))
    return told.digest(), shape, sorted({h for _, h in _template_blocks(root)})


def mark_constants(root: Node, constants: set[int]) -> None:
    """Drop the blocks of a signed page that are constants of its host's wrapper."""
    for node, h in _template_blocks(root):
        if h in constants:
            node.drop = True


def _find(node: Node, tags: tuple, roles: tuple = ()) -> list[Node]:
    """Outermost elements with one of the tags or roles that are not dropped."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.drop or x.tag == "#":
            continue
        if x.tag in tags or any(x.key.endswith("/" + r) for r in roles):
            out.append(x)
        else:
            todo.extend(reversed(x.kids))
    return out


def blocks(nodes: list[Node], in_article: bool) -> list[str]:
    """Texts of the blocks in page order; outside an article, list items that are mostly links and runs of links
    are menus, but never a heading, a paragraph or a single link."""
    out: list[str] = []
    parts: list[str] = []
    linked = links = 0

    def flush(tag: str = "", listed: bool = False):
        nonlocal linked, links
        if parts:
            s = _WHITE.sub(" ", "".join(parts)).strip()
            menu = 2 * linked > len(s) and (listed or links > 1 and tag not in _PROSE)
            if s and (in_article or not menu):
                out.append(s)
            parts.clear()
        linked = links = 0

    def walk(node: Node, link: bool, tag: str = "", listed: bool = False) -> None:
        nonlocal linked, links
        if node.tag == "#":
            parts.append(node.text)
            linked += len(node.text) if link else 0
            return
        if node.drop or (node.tag in _PAGE_HEADER and not in_article):
            return
        if node.tag == "br":
            parts.append(" ")
            return
        block = node.tag in BLOCK
        links += node.tag == "a"
        if block:
            flush(tag, listed)
            tag, listed = node.tag, listed or node.tag in _LISTS
        for k in node.kids:
            walk(k, link or node.tag == "a", tag, listed)
        if block:
            flush(tag, listed)

    for x in nodes:
        flush()
        walk(x, False)
        flush()
    return out


def main_text(page: str, wrapper: set[int] | None = None) -> str:
    """The article of one page, its blocks joined by an empty line."""
    root = parse(page)
    if wrapper:
        sign(root)
        mark_constants(root, wrapper)
    articles = _find(root, ("article",)) or _find(root, ("main",), ("main", "article"))
    return "\n\n".join(blocks(articles or [root], bool(articles)))


def host_of(url):
    """Lower-case host of a URL column; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the hashes of a host's constants, from all its distinct pages; one row for every host.

    Copies are merged before anything is counted, and counts are added up before the shuffle, so a
    hot host sends one row per task and block.
    """
    bounded_batches(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [read_page(page.as_py()) for page in b.column("page")]
            yield pa.RecordBatch.from_arrays([
                b.column("host"), pa.array([t[0] for t in told], pa.binary()),
                pa.array([t[1][2] for t in told], pa.int64()), pa.array([json.dumps(t[1], separators=(",", ":")) for t in told], pa.string()),
                pa.array([t[2] for t in told], pa.list_(pa.int64()))], ["host", "page", "shape", "tree", "blocks"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for host, shapes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for k, of in enumerate(makes([(x["n"], json.loads(x["tree"])) for x in shapes])):
                    pages = sum(shapes[i]["n"] for i in of)
                    out += [(host, shapes[i]["shape"], k, pages) for i in of]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
                (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["host", "shape", "make", "pages"])

    told = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    told = (told.where("host IS NOT NULL").mapInArrow(read, "host string, page binary, shape bigint, tree string, blocks array<bigint>")
            .dropDuplicates(["host", "page"]))
    # a null block, the one row that tells a shape's tree, counts the pages themselves
    told = told.withColumn("block", F.explode(F.concat(F.array(F.lit(None).cast("long")), "blocks")))
    counts = stored(told.withColumn("tree", F.when(F.col("block").isNull(), F.col("tree")))
                    .groupBy("host", "shape", "tree", "block").agg(F.count("*").alias("n")), "wrapper-counts")
    sizes = counts.where("block IS NULL")
    made = (sizes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("shape", "n", "tree"))).alias("shapes"))
            .mapInArrow(group, "host string, shape bigint, make bigint, pages bigint"))
    constants = (counts.where("block IS NOT NULL").join(made, ["host", "shape"])
                 .groupBy("host", "make", "pages", "block").agg(F.sum("n").alias("n"))
                 .where((F.col("n") >= MIN_REFERENCES) & (2 * F.col("n") > F.col("pages"))))
    found = constants.select("host", "block").union(sizes.select("host", F.lit(None).cast("long")))
    # AQE splits a hot host's pages only if a shuffle of its own leads from here to the join with them, so
    # the (lower-case) host is told as a new column
    return found.groupBy("host").agg(F.array_sort(F.collect_set("block")).alias("wrapper")).withColumn("host", F.lower("host"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text, n_chars) of every row.

    Null html is an empty text; a page without a host in its url is read without a wrapper;
    repeated rows give the same text each and count as one page; an empty table gives an
    empty result; other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    wrappers = induce_wrappers(pages, url_col, html_col)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = pa.array([zlib.compress(x.as_py().encode("utf-8", "replace"), 1) for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], z], ["id", "url", "host", "z"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}
        for b in batches:
            out = []
            for host, z, w in zip(b.column("host").to_pylist(), b.column("z"), b.column("wrapper")):
                if w.is_valid and host not in known:
                    if len(known) >= 1_000:
                        known.clear()
                    known[host] = set(w.as_py())
                out.append(main_text(zlib.decompress(z.as_py()).decode(), known[host] if w.is_valid else None))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])

    told = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    told = told.mapInArrow(squeeze, f"id {kind}, url string, host string, z binary")
    # pages without a host would all meet in one partition of the join
    found = (told.where("host IS NOT NULL").join(wrappers, "host", "left").select("id", "url", "host", "z", "wrapper")
             .union(told.where("host IS NULL").select("id", "url", "host", "z", F.lit(None).cast("array<bigint>").alias("wrapper"))))
    done = found.mapInArrow(texts, f"id {kind}, url string, text string")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
