"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags.  Each block has its word count and link
density and those of its neighbours; as these alone can't tell a short paragraph from an
advert of equal length, it also has what the markup says: whether it stands in the
article or main element, whether the page has one, whether an element that goes around
articles holds it, and whether it is a heading.  A tree trained on the blocks of the
labelled pages below keeps or drops it; nothing overrides the tree.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import arrow_map

BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is no text of the page.
SILENT = "script style template noscript svg math iframe object canvas textarea title head xmp noembed noframes audio video datalist".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
AROUND = set("nav footer aside form button select option menu dialog label fieldset".split())
#: Elements that hold the article, by how closely.
INSIDE = {"main": 1, "article": 2}
#: Words of a class, id or role that mark what stands around an article, wherever they are in a name.
MARKS = set("advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter pager pagination paywall popup recommended related share sharing sidebar sponsor sponsored subscribe subscription toolbar widget".split())
#: Words that mark it only as the last word of a name: tag-list, but not tag-politics.
LAST_MARKS = MARKS | set("ad ads alert banner complementary contentinfo dialog header legal login notice promo promos replies reply respond search signup skip social tag tags".split())
#: Last words of a name that say nothing.
PLAIN = set("area bar block box container content group inner item items links list outer panel row section slot unit wrap wrapper".split())
#: First words of a name that say what its element has, not what it is.
HAS = set("has have hide is js no not with without".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What a tag has after its name: a quote after an equals sign holds what it encloses, > too; if it is never closed it is a character like others.
ATTRIBUTES = r"(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in SILENT}
SPACE = re.compile(r"\s+")

_T = lambda n: " ".join(["word"] * n)
_A = lambda n: f"<a href='#'>{_T(n)}</a>"
_NAV = "<nav><ul>" + "".join(f"<li>{_A(n)}</li>" for n in (1, 2, 1)) + "</ul></nav>"
_MENU = "<ul>" + "".join(f"<li>{_A(n)}</li>" for n in (1, 2, 1, 3)) + "</ul>"
_P = lambda *lengths: "".join(f"<p>{_T(n)}</p>" for n in lengths)
#: Lengths of which each follows each.
_ANY = (1, 1, 3, 1, 12, 1, 40, 1, 150, 3, 3, 12, 3, 40, 3, 150, 12, 12, 40, 12, 150, 40, 40, 150, 150, 1)
#: Labelled pages: markup, and of each of its blocks in order whether it is of the main text.  Fixed values.
LABELLED = [
    (f"{_NAV}<div>{_T(12)}</div><article><h1>{_T(9)}</h1>{_P(60, 1, 4, 150, 3)}</article><footer>{_T(9)}</footer>", "0000 111111 0"),
    (f"{_NAV}<div>{_T(30)}</div><article><h2>{_T(3)}</h2>{_P(2, 20, 7)}{_MENU}{_P(40)}</article><div>{_T(80)}</div><div>{_A(3)}</div>", "0000 1111 1111 1 00"),
    (f"<header><h1>{_T(2)}</h1></header><article><header><h1>{_T(6)}</h1><p>{_T(3)}</p></header>{_P(90, 5)}<aside>{_T(25)}</aside>{_P(1)}<div class='comments'>{_P(40, 60)}</div></article>", "0 10 11 0 1 00"),
    (f"<article>{_P(200)}<footer>{_A(1)}</footer></article><footer>{_A(1)}{_T(8)}</footer>", "1 00"),
    (f"<article>{_P(45, 30)}</article><nav>{_A(1)}</nav>", "11 0"),
    (f"<article><p>{_A(12)}</p>{_P(3)}<p>{_A(2)} {_T(40)}</p></article><p>{_T(70)}</p><ul><li>{_A(6)}</li></ul>", "111 00"),
    (f"<main>{_NAV}<h1>{_T(7)}</h1><article>{_P(80, 2)}</article><h2>{_T(2)}</h2>{_P(25)}</main>{_P(9)}", "000 1 11 00 0"),
    (f"{_MENU}<main><h1>{_T(5)}</h1>{_P(2, 100, 30)}{_MENU}</main><div>{_T(40)}</div><h2>{_T(2)}</h2>", "0000 1 111 1111 00"),
    (f"<div>{_T(10)}</div><main>{_P(8, 1, 60)}<form>{_T(5)}</form></main><h3>{_T(2)}</h3>{_MENU}", "0 111 0 00000"),
    (f"{_MENU}<h1>{_T(8)}</h1>{_P(90, 25, 60, 11, 40)}<div>{_A(1)} {_A(1)}</div>", "0000 1 11111 0"),
    (f"<div>{_A(2)}</div><h1>{_T(4)}</h1>{_P(30, 45, 18)}{_MENU}<p>{_T(3)}</p>", "0 1 111 0000 0"),
    (f"<h1>{_T(6)}</h1>{_P(50)}<p>{_T(20)} {_A(3)} {_T(20)}</p>{_P(6, 70)}<h2>{_T(3)}</h2>{_P(35, 120)}<div>{_A(5)} {_A(4)}</div>", "1 1 1 11 1 11 0"),
    (f"<div class='sidebar'>{_P(60, 30)}</div><div class='cookie-notice'>{_T(25)}</div>{_P(70, 15, 80)}<div class='comments'>{_P(50, 90)}</div><footer>{_T(20)}</footer>", "00 0 111 00 0"),
    (f"{_NAV}<div>{_T(8)} {_A(6)}</div>{_P(120, 22)}<div>{_T(2)} {_A(9)}</div>", "000 0 11 0"),
    (f"<div>{_P(*_ANY)}</div><article>{_P(*_ANY)}{_MENU}{_P(2)}{_MENU}{_P(55)}{_MENU}</article>{_P(*_ANY)}", "0" * 26 + "1" * 40 + "0" * 26),
    (f"{_P(*_ANY)}<main>{_P(*_ANY)}{_MENU}{_P(2)}{_MENU}{_P(55)}{_MENU}</main>{_P(*_ANY)}", "0" * 26 + "1" * 40 + "0" * 26),
    (f"<article>{_MENU}<div class='share'>{_P(3, 40, 1)}</div>{_P(1)}<aside>{_P(1, 150)}</aside>{_P(2)}</article>", "1111 000 1 00 1"),
    (f"{_NAV}<div><h1>{_T(2)}</h1>{_P(16, 32)}</div><div>{_T(2)}</div>", "000 1 11 0"),
    (f"<div>{_T(1)}</div><div><h1>{_T(1)}</h1>{_P(40, 2, 60, 3, 25)}<h2>{_T(1)}</h2>{_P(30)}</div><p>{_T(3)} {_A(2)}</p>", "0 1 11111 1 1 0"),
    (f"{_MENU}<div><h2>{_T(1)}</h2>{_P(14)}<h2>{_T(3)}</h2>{_P(18, 75)}</div><div>{_A(1)} {_A(2)}</div><div>{_T(2)}</div>", "0000 1 1 1 11 0 0"),
    (f"{_P(20)}", "1"),
    (f"{_P(1)}", "1"),
    (f"{_P(4)}", "1"),
    (f"{_P(9)}", "1"),
    (f"<p>{_T(60)}</p><p>{_T(50)}</p>", "11"),
    (f"{_MENU}<div>{_A(5)}</div>", "0000 0"),
    (f"<form>{_T(2)}</form><div><h1>{_T(5)}</h1>{_P(14, 55, 9, 80)}</div><aside>{_P(30)}</aside>", "0 1 1111 0"),
    (f"<div>{_T(30)} {_A(27)}</div><div>{_A(2)}</div>{_P(65, 33)}", "0 0 11"),
]


def features(found: list[tuple]) -> list[tuple]:
    """Of each block: words, link density, those of the block before and of the block after, the
    highest place of the page (2 an article, 1 main, 0 neither), how far below it the block stands,
    whether an element around articles holds it, and heading (2 the first level, 1 others)."""
    top = max((b[3] for b in found if not b[4]), default=0)
    none = (None, 0, 0.0)
    sides = zip([none, *found], [*found[1:], none], strict=False)
    return [(w, d, before[1], before[2], after[1], after[2], top, top - inside, int(around), heading) for (_, w, d, inside, around, heading), (before, after) in zip(found, sides, strict=False)]


@cache
def labelled() -> np.ndarray:
    """The training table: features of each labelled block, and whether it is kept."""
    rows = []
    for page, kept in LABELLED:
        found, flags = features(blocks(page)), kept.replace(" ", "")
        assert len(found) == len(flags), (page, len(found))
        rows += [(*f, int(k)) for f, k in zip(found, flags, strict=True)]
    return np.array(rows, float)


@cache
def tree(depth: int = 7, without: tuple[int, ...] = ()):
    """CART by Gini impurity on the labelled blocks: (feature, cut, below, above) or a verdict.

    without names features by number that it may not use.
    """

    def grow(d: np.ndarray, left: int):
        y = d[:, -1]
        if left == 0 or y.min() == y.max():
            return bool(y.mean() >= 0.5)
        best = None
        for f in range(d.shape[1] - 1):
            v = np.unique(d[:, f])
            for cut in () if f in without else (v[1:] + v[:-1]) / 2:
                low = d[:, f] <= cut
                p, q = y[low].mean(), y[~low].mean()
                gini = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
                if best is None or gini < best[0] - 1e-12:
                    best = (gini, f, float(cut), low)
        if best is None:
            return bool(y.mean() >= 0.5)
        _, f, cut, low = best
        return (f, cut, grow(d[low], left - 1), grow(d[~low], left - 1))

    return grow(labelled(), depth)


def verdict(row: tuple, node=None) -> bool:
    node = tree() if node is None else node
    while not isinstance(node, bool):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def _marks(name: str) -> set[str]:
    """Words of a name that mark what stands around an article."""
    words = [w.lower() for w in NAME.findall(name)]
    if not words or words[0] in HAS:
        return set()
    while len(words) > 1 and words[-1] in PLAIN:
        words.pop()
    return (MARKS & set(words)) | (LAST_MARKS & set(words[-1:]))


@lru_cache(1 << 14)
def _named(value: str) -> frozenset[str]:
    return frozenset().union(*map(_marks, value.split()))


def _kind(tag: str, attrs: str) -> str:
    """'around', 'header' or '' of an element by its tag and attributes."""
    if tag in AROUND:
        return "around"
    kind = "header" if tag == "header" else ""
    low = attrs.lower()
    if "class" in low or "id" in low or "role" in low or "hidden" in low:
        for name, *values in ATTR.findall(attrs):
            name, value = name.lower(), next((v for v in values if v), "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return "around"
            if name in ("class", "id", "role") and tag not in ("html", "body") and tag not in INSIDE:
                found = _named(value)
                if found == {"header"}:
                    kind = "header"
                elif found:
                    return "around"
    return kind


def blocks(page: str) -> list[tuple[str, int, float, int, bool, int]]:
    """(text, words, link density, place, around, heading) of each block with text.

    An element around articles that holds the page's first heading of the first level,
    article or main, and at least half of its words, is a wrapper of the page and counts
    as nothing.  In an article, of a header only headings count.
    """
    out, parts, linked = [], [], 0
    stack: list[tuple] = []
    standing: Counter = Counter()  # open elements by tag
    # of each element around articles: the one around it (-1: none), and the words in it alone;
    # held is the innermost one, mark that of a paragraph
    above: list[int] = []
    holds: list[int] = []
    inside, held, header, mark = 0, -1, False, -1
    wraps: set[int] = set()  # those that hold the page's first article, main or first heading
    seen: set[str] = set()
    links, heading, at, n, total_words = 0, 0, 0, len(page), 0

    def close():
        nonlocal linked, mark, total_words
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                words = text.count(" ") + 1
                total = sum(map(len, parts)) or 1
                around = held if mark < 0 else mark
                total_words += words
                if around >= 0:
                    holds[around] += words
                out.append((text, words, min(1.0, linked / total), inside, around, header and not heading, heading))
            parts.clear()
        linked, mark = 0, -1

    def new() -> int:
        above.append(held)
        holds.append(0)
        return len(holds) - 1

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        if tag in BLOCK:
            close()
        elif tag == "br":
            parts.append(" ")
        if m[1]:
            if tag in ("p", "br") or not standing[tag]:
                if tag == "a":
                    links = 0
                continue
            while stack:
                t, inside, held, header = stack.pop()
                standing[t] -= 1
                if t == "a":
                    links = 0
                if t[0] == "h" and t[1:].isdigit():
                    heading = 0
                if t == tag:
                    break
            continue
        if tag in VOID or tag == "p" and not m[3].strip():
            continue
        if tag in _END:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math", "iframe", "object"):
                end = _END[tag].search(page, at)
                if tag == "head":
                    # an unclosed head ends where the body begins
                    body = re.compile(r"<body\b", re.I).search(page, at)
                    stop = min((x for x in ((end.end() if end else None), (body.start() if body else None)) if x is not None), default=None)
                    at = at if stop is None else stop
                else:
                    at = end.end() if end else n
            continue
        kind = _kind(tag, m[3])
        if tag == "p":  # a paragraph ends at the next block and is on no stack
            if kind:
                mark = new()
            continue
        if tag == "a":
            links = 1
        if tag[0] == "h" and tag[1:].isdigit():
            heading = 2 if tag == "h1" else 1
        stack.append((tag, inside, held, header))
        standing[tag] += 1
        if kind == "around" or kind == "header" and not inside:
            held = new()
        elif kind == "header":
            header = True
        if tag in INSIDE or tag == "h1":
            if tag not in seen:
                seen.add(tag)
                i = held
                while i >= 0:
                    wraps.add(i)
                    i = above[i]
            if tag in INSIDE:
                inside, header = max(inside, INSIDE[tag]), False
    close()
    for i in range(len(holds) - 1, -1, -1):  # an element comes after the one around it
        if above[i] >= 0:
            holds[above[i]] += holds[i]
    free: list[bool] = []  # whether an element and all around it are wrappers
    for i, up in enumerate(above):
        free.append(i in wraps and 2 * holds[i] >= total_words and (up < 0 or free[up]))
    return [(t, w, d, place, aside or around >= 0 and not free[around], h) for t, w, d, place, around, aside, h in out]


def main_text(page: str | None) -> str:
    """Text of the blocks that the tree keeps, one to a line."""
    found = blocks(page or "")
    return "\n".join(b[0] for b, row in zip(found, features(found), strict=True) if verdict(row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page.  Null or empty html gives an empty text.

    Unclosed and stray tags are read as browsers do; pages without blocks give an empty
    text; repeated rows are extracted one by one and further columns are ignored.
    """

    def run(batch):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": [len(t) for t in texts]}

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"), run, "page_id long, url string, text string, n_chars long")
