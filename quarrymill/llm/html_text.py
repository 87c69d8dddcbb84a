"""Main text of web pages: flat text blocks, judged by a decision tree over words and link densities.

A page is cut into flat blocks at block-level tags, in one linear pass that forgives unclosed and truncated markup. What
holds other people's words or controls whatever it reads like (forms, dialogs, asides, sidebars, notices, reader comments;
by tag, role, or a name in class or id) is no block of the page's text, no more than a script is. A block has its number of
words and its link density (share of words inside links), and the same of its two neighbours. Marks of the markup (whether
the block lies in a menu, header, footer or advert, in the page's article, or in a page that marks one) are known, too.

The tree is trained on a small labelled table: the examples below, and the blocks of at most about ``SAMPLE_PAGES``
pages that mark their article, labelled by that mark and entered three times, with their marks, without the article's, and
stripped of all. It is grown by words and link densities alone; a leaf (``LEAST_ROWS`` and ``LEAST_SHARE`` of the table at
least) whose rows agree decides by itself, and only in leaves that stay mixed are marks asked. The kept blocks are joined in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import drawn, map_batches, slices, table

RAW = frozenset(("script", "style", "noscript", "template", "iframe", "textarea", "svg", "title", "object", "math"))
TO_THE_END = frozenset(("script", "style", "textarea", "title"))  # without an end tag they hold the rest of the page
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul video audio canvas".split())
CONTAINER = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header html label main menu nav ol section select table td th tr ul".split())
#: Names of elements, roles, and names in class or id; fixed values. The first of each pair hold no block of the page's text, the
#: second are marks. Parts of compound names count too, but for those in WHOLE.
CUT_TAGS, MARK_TAGS = frozenset("aside form dialog button select label fieldset".split()), frozenset("nav footer menu".split())
CUT_ROLES, MARK_ROLES = frozenset("complementary search dialog alertdialog alert form".split()), frozenset("navigation banner contentinfo menu menubar toolbar".split())
CUT_NAMES = frozenset("sidebar aside notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments respond replies disqus widget related recommended".split())
MARK_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer banner share sharing social toolbar masthead".split())
CUT_WHOLE, MARK_WHOLE = frozenset("side reply alert search rail".split()), frozenset("header top legal copyright".split())
NO_NAMES = frozenset(("html", "body", "main"))

_QUOTE = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")

FEATURES = ("words", "words_before", "words_after", "links", "links_before", "links_after", "other", "in_article", "has_article")
TEXT_FEATURES = 6  # the first ones; the others are marks
#: Example pages, a block a word: what it is (a: article, n: menu, h: header, d: advert, f: footer), its words, and behind a
#: slash those in links.
EXAMPLES = """
n1/1 n1/1 n2/2 n1/1 d12 a7 a60/2 a45 a8 a90/5 f10/3
n2/2 n1/1 n1/1 a9 a30 a120 a55/3 a14 a70 f12 f3/3
h3 h8 n1/1 n1/1 n1/1 a5 a80 a1 a40 a25 f20/6
n1/1 n3/3 n2/2 a11 a35/1 a150 a6/6 a5/5 a7/7 f8
n1/1 n1/1 d8 a6 a200 a90 f9/2
h2/2 n1/1 n1/1 n1/1 a4 a22 a18 a28 a16 f60
a8 a50 a75 a2 a33 f7/1
n1/1 n2/2 n1/1 d26 a8 a65 a40/2 d35 a85 a19 f11/1
n4/4 n5/5 a10 a38/38 a44 a52/6 a3 f30/9
h12 n1/1 a3 a1 a5 a2 a90 a4 f4/4
n1/1 n1/1 n1/1 n1/1 n1/1 d5 a6 a130 a7 a95 a5 a110 f14
d10 a9 a20 a26 a30 a24 a21 f6/6
n1/1 n2/2 a60 a70/4 a55 f5
n1/1 n1/1 d15 a12 a5 a9 a7 a40 a14 f9
a9
a30
a250
a4 a9
a12 a3
a2 a6 a60
a5 a70
a60 a80 a4
n1/1
n2/1
h1
h2
f4
f9/4
h1 f3
n2/2 d20 a3 f4
d60 a5 a7 a80 a100 f3
d45 a2
a1 d50
n2/2 n2/2 a6 a120 a85 f80
""".strip()
OTHER_KINDS = "nhdf"
SAMPLE_PAGES, BLOCKS_A_PAGE = 1000, 100
TEXT_DEPTH, MARK_DEPTH = 12, 3
LEAST_ROWS, LEAST_SHARE = 20, 0.01  # a leaf of the text step holds so many rows and this share of the table at least


def neighbourhood(words: list[int], links: list[int]) -> list[tuple]:
    """The text features of each block of a page, in order."""
    density = [0.0, *(x / w for w, x in zip(words, links)), 0.0]
    padded = [0, *words, 0]
    return [(padded[i], padded[i - 1], padded[i + 1], density[i], density[i - 1], density[i + 1]) for i in range(1, len(padded) - 1)]


def entries(rows: list[tuple], marks: list[tuple], kept: list[int]) -> list[tuple]:
    """Rows of the labelled table: with marks, without the article's mark, and stripped of all."""
    out = []
    for row, (other, inside, has), y in zip(rows, marks, kept):
        out += [(*row, other, inside, has, y), (*row, other, 0, 0, y), (*row, 0, 0, 0, y)]
    return out


def examples() -> list[tuple]:
    """The labelled table of ``EXAMPLES``."""
    out = []
    for page in EXAMPLES.split("\n"):
        blocks_ = [(x[0], *map(int, (x[1:] + "/0").split("/")[:2])) for x in page.split()]
        kept = [int(kind == "a") for kind, _, _ in blocks_]
        rows = neighbourhood([w for _, w, _ in blocks_], [x for _, _, x in blocks_])
        # adverts may lie in the article, too
        out += entries(rows, [(int(kind in OTHER_KINDS), int(kind in "ad"), 1) for kind, _, _ in blocks_], kept)
    return out


def grow(rows: np.ndarray, features: range, depth: int, least_rows: int = 1, leaf=None):
    """A tree by Gini impurity: (feature, threshold, left, right), or what ``leaf`` makes of a leaf's rows (their majority's label, ties are kept).

    Ties between splits go to the first feature and the lowest threshold.
    """
    n, ones = len(rows), int(rows[:, -1].sum())
    best = None
    if depth and 0 < ones < n and n >= 2 * least_rows:
        for f in features:
            order = np.argsort(rows[:, f], kind="stable")
            v, y = rows[order, f], rows[order, -1].cumsum()
            left = np.arange(1, n)
            cuts = np.flatnonzero((v[1:] > v[:-1]) & (left >= least_rows) & (n - left >= least_rows))
            if len(cuts):
                m, x = left[cuts], y[cuts]
                impurity = 2 * x * (m - x) / m + 2 * (ones - x) * (n - m - ones + x) / (n - m)
                k = int(np.argmin(np.round(impurity, 9)))
                if best is None or impurity[k] < best[0] - 1e-9:
                    best = float(impurity[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)
    if best is None or 2 * ones * (n - ones) / n - best[0] < 1e-9:
        return leaf(rows) if leaf else int(2 * ones >= n)
    _, f, cut = best
    side = rows[:, f] <= cut
    return f, cut, *(grow(rows[x], features, depth - 1, least_rows, leaf) for x in (side, ~side))


def grow_tree(table_: list[tuple]):
    """The tree of a labelled table: by words and link densities, then by marks in the leaves that stay mixed."""
    rows, text, marks = np.array(table_, dtype=float), range(TEXT_FEATURES), range(TEXT_FEATURES, len(FEATURES))
    return grow(rows, text, TEXT_DEPTH, max(LEAST_ROWS, int(LEAST_SHARE * len(rows))), lambda left: grow(left, marks, MARK_DEPTH))


@lru_cache(maxsize=1)
def default_tree():
    return grow_tree(examples())


def decide(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


CUT, MARK = 2, 1


def serves_other(name: str, attrs: str, in_article: int) -> int:
    """Whether an element, by its tag, role, class and id, holds no text of the page (``CUT``), is marked as other than the article (``MARK``), or neither (0)."""
    found = CUT if name in CUT_TAGS else MARK if name in MARK_TAGS or (name == "header" and not in_article) else 0
    if found == CUT or "=" not in attrs or name in NO_NAMES:
        return found
    for m in _ATTR.finditer(attrs):
        value = (m[2] or m[3] or m[4] or "").strip()
        if m[1].lower() == "role":
            role = value.lower()
            found = max(found, CUT if role in CUT_ROLES else MARK if role in MARK_ROLES else 0)
            continue
        for one in value.split():
            parts = {p.lower() for p in _SPLIT.split(one)}
            if one.lower() in CUT_WHOLE or parts & CUT_NAMES:
                return CUT
            if one.lower() in MARK_WHOLE or parts & MARK_NAMES:
                found = MARK
    return found


def tag_end(page: str, at: int) -> int:
    """The index behind the tag that starts at ``at``, quoted signs skipped; -1 if the page ends first."""
    pos = at
    while m := _QUOTE.search(page, pos):
        if m.group() == ">":
            return m.end()
        before = page[at : m.start()].rstrip()[-1:]
        close = page.find(m.group(), m.end()) if before == "=" else m.start()
        if close < 0:  # an unclosed quote is an ordinary sign
            close = m.start()
        pos = close + 1
    return -1


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, words in links, marked as other, in the article) of the page's flat text blocks, in order."""
    out: list[tuple[str, int, int, int, int]] = []
    bits: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool]] = []
    open_: Counter = Counter()
    cut = other = article = link = 0
    at, n = 0, len(page)
    endless: set[str] = set()  # names without an end tag in what is left of the page

    def flush() -> None:
        nonlocal link
        if bits:
            words = "".join(bits).split()
            if words and not cut:
                out.append((" ".join(words), len(words), min(len(words), len("".join(linked).split())), int(other > 0), int(article > 0)))
            bits.clear()
            linked.clear()
        link = 0

    def text(raw: str) -> None:
        if raw:
            bits.append(decoded := html.unescape(raw) if "&" in raw else raw)
            if link:
                linked.append(decoded + " ")

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        if not (nxt.isalpha() or nxt in ("/", "!", "?")) or not nxt:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if nxt in "!?":
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(page, lt + 1 + closing)
        end = tag_end(page, m.end() if m else lt + 1)
        if end < 0:
            break
        at = end
        if not m:
            continue
        name = m.group().lower()
        if name in RAW and not closing:
            bits.append(" ")
            if page[end - 2] == "/" and name not in TO_THE_END:
                continue
            stop = None if name in endless else re.compile(f"</{name}", re.I).search(page, end)
            if stop:
                at = max(end, page.find(">", stop.start()) + 1 or n)
            else:
                endless.add(name)
                at = n if name in TO_THE_END else end
            continue
        if name == "br":
            bits.append(" ")
        elif name == "a":
            link = 0 if closing else 1
        if name not in BLOCK:
            continue
        flush()
        if name not in CONTAINER:
            continue
        if not closing:
            attrs = page[m.end() : end - 1]
            if attrs.endswith("/"):
                continue
            serves = serves_other(name, attrs, article)
            is_article = name in ("article", "main") or 'role="main"' in attrs
            stack.append((name, serves, is_article))
            open_[name] += 1
            cut, other, article = cut + (serves == CUT), other + (serves == MARK), article + is_article
        elif open_[name]:
            while True:
                was, serves, is_article = stack.pop()
                open_[was] -= 1
                cut, other, article = cut - (serves == CUT), other - (serves == MARK), article - is_article
                if was == name:
                    break
    flush()
    return out


def page_rows(found: list[tuple[str, int, int, int, int]]) -> list[tuple]:
    """The features of a page's blocks."""
    has = int(any(b[4] for b in found))
    return [(*row, b[3], b[4], has) for row, b in zip(neighbourhood([b[1] for b in found], [b[2] for b in found]), found)]


def main_text(page: str | None, tree=None) -> tuple[str, int]:
    """(main text, number of blocks); empty for a null or empty page."""
    found = blocks(page or "")
    tree = tree or default_tree()
    return " ".join(b[0] for b, row in zip(found, page_rows(found)) if decide(tree, row)), len(found)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES):
    """The tree, from the examples and the blocks of about ``sample_pages`` pages (at most twice as many), at most ``BLOCKS_A_PAGE`` of each, evenly drawn.

    Pages that mark no article teach nothing, nor do null and empty ones, and an empty table leaves the examples. Pages are
    drawn by a hash of id and page, so ids that repeat or are null neither empty nor flood the sample.
    """
    names = [*FEATURES, "kept"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page in batch.column(0).to_pylist():
                own = page_rows(blocks(page or ""))
                if own and own[0][-1]:
                    own = own[:: -(-len(own) // BLOCKS_A_PAGE)]
                    rows += entries([r[:TEXT_FEATURES] for r in own], [r[TEXT_FEATURES:] for r in own], [int(r[-2] and not r[-3]) for r in own])
            yield pa.RecordBatch.from_arrays([pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(len(names))], names=names)

    sample = drawn(pages.select("page_id", F.col("html").cast("string").alias("html")), ["page_id", "html"], sample_pages).select("html")
    rows = map_batches(sample, label, ", ".join(f"{x} double" for x in names)).collect()  # bounded by both parameters
    return grow_tree([*examples(), *sorted(map(tuple, rows))])


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every row of ``pages``.

    Null and empty pages have an empty text; nulls in page_id and url stay. Rows that repeat are read alike, pages of
    any length are read whole, an empty table gives no rows, other columns are not read.
    """
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())])
    grown = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                texts, counts = zip(*(main_text(p, grown) for p in part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(counts, pa.int64())], schema=arrow)

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, "page_id long, url string, text string, n_chars long, n_blocks long")


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
