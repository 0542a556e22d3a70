"""Main text of web pages by line-block distribution.

Markup is stripped so that each block of a page is a line; places that hold no reading text (menus, forms,
adverts and the like) become runs of empty lines.  The text lengths of sliding windows of lines form the
page's distribution; where it surges from zero a body starts, where it dives to zero it ends, and the
lines between are kept if the peak between them is high enough.  Marks are evidence in it: where a page marks its
article, a line in there weighs its whole length and a threshold more, and a line outside nothing.
"""

from __future__ import annotations

import re
from functools import partial
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare_python

#: Lines in a window, and the window length that makes a body (or the page's highest, if lower).
WINDOW, SURGE = 3, 86

# ---- FIXED VALUES: element and attribute names of HTML pages ----
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
tfoot th thead tr ul""".split())
RAW = "script|style|textarea|title"
EMBEDDED = "noscript|template|svg|select|iframe|object|canvas|audio|video"
NAMED = frozenset("div section ul ol dl table figure details center td li".split())
SKIP = frozenset("nav aside footer form button menu dialog fieldset".split())
CONTAINERS = frozenset("body center div section table td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SIDE_NAMES = re.compile(r"""(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alert|popup|modal
|overlay|sidebar|sidenav|widgets?|nav|navbar|navigation|menus?|breadcrumbs?|footer|foot|masthead|topbar|toolbar|comments?|commentlist
|disqus|respond|replies|share|sharing|newsletter|subscribe|subscription|signup|login|pagination|pager
)(?:$|[\s_-])""", re.X | re.I)
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:social|related|recommend\w*)(?:$|[\s_-])", re.I)
# ---- end of fixed values ----

_IN_TAG = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
#: What holds no text; only raw text runs to the page's end when its end tag is missing.
_NOT_TEXT = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b{_IN_TAG}>.*?(?:</\1\s*>|\Z)|<({EMBEDDED})\b{_IN_TAG}>.*?</\2\s*>|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")        # one whole attribute after the other


def _aside(name: str, attrs: str, in_article: bool) -> bool | None:
    """Whether an element holds no reading text; None: if it is made of links.

    Names of classes and ids count on containers alone: headings, paragraphs and inline elements are named after
    what they say.
    """
    if name in SKIP or name == "header" and not in_article:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    doubt = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in SIDE_ROLES:
            return True
        if key in ("class", "id") and name in NAMED and (SIDE_NAMES.search(value) or not in_article and re.search(r"(?:^|[\s_-])header(?:$|[\s_-])", value)):
            return True
        doubt = doubt or key in ("class", "id") and name in NAMED and bool(DOUBTFUL_NAMES.search(value))
    return None if doubt else False


def _nest(open_: list[tuple[str, int]], end: str, name: str, number: int) -> None:
    """Keeps the list of open containers, names and numbers, at a tag of a block."""
    if name in ("td", "th", "tr") and any(n == "table" for n, _ in open_):     # cells need no end tag
        while open_[-1][0] != "table":
            open_.pop()
    if not end and name in CONTAINERS:
        open_.append((name, number))
    elif end and any(n == name for n, _ in open_):
        while open_.pop()[0] != name:
            pass


def _settle(out: list, start: int, gap: list, in_article: bool) -> None:
    """Drops the lines of a doubtful container if more of their text stands in links than outside."""
    whole, own = sum(len(r[0]) for r in out[start:]), sum(r[1] for r in out[start:])
    if 2 * own < whole:
        out[start:] = [] if in_article else gap


def lines(html: str) -> list[tuple[str, int, bool, frozenset[int]]]:
    """The page's lines: text, length outside links, whether it stands in an article element, its parents.

    A paragraph's parent is the container around it; text right in a container is either a piece of that
    one or, if the container is a paragraph itself, of the one around.
    """
    html = _NOT_TEXT.sub(" ", html)
    out: list[tuple[str, int, bool, frozenset[int]]] = []
    text: list[str] = []
    state = {"own": 0, "article": 0, "link": 0}
    open_, leaf = [("", -1)], False
    gap = [("", 0, False, frozenset())] * WINDOW

    def flush() -> None:
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((line, state["own"], state["article"] > 0, frozenset(n for _, n in open_[-1 if leaf else -2:])))
        state["own"] = 0

    skip, depth, at = "", 0, 0
    doubts: list[list] = []                       # open doubtful containers: name, depth of that name, first line
    for m in _TAG.finditer(html):
        end, name, attrs = m.group(1), m.group(2).lower(), m.group(3)
        if not skip and m.start() > at:
            part = html[at:m.start()]
            text.append(part)
            state["own"] += 0 if state["link"] else len(part.strip())
        at = m.end()
        own_end = False
        if skip:
            if name == skip:
                depth += -1 if end else not attrs.endswith("/")
                if skip in ("p", "li") and not end:         # a new one ends the one before
                    skip = ""
            elif skip == "p" and name in BLOCKS:
                skip = ""
            if depth == 0:
                skip, own_end = "", True
            if skip or name in SKIP and end:
                continue
        aside = not end and name not in VOID and _aside(name, attrs, state["article"] > 0)
        for d in doubts:
            d[1] += (name == d[0] and not own_end) * (-1 if end else 1)
        while doubts and doubts[-1][1] == 0:
            flush()
            _settle(out, doubts.pop()[2], gap, state["article"] > 0)
        if aside is None:
            flush()
            doubts.append([name, 1, len(out)])
        if aside:
            flush()
            for d in doubts:
                d[1] -= name == d[0]
            if not state["article"] and (name in SKIP or name == "header"):   # an advert amid the text doesn't end it
                out.extend(gap)
            skip, depth = name, 1
        elif name in ("article", "main"):
            flush()
            if not state["article"]:
                out.extend(gap)
            state["article"] = max(0, state["article"] + (-1 if end else 1))
            if not state["article"]:
                out.extend(gap)
        elif name in BLOCKS:
            flush()
            if not own_end:
                _nest(open_, end, name, m.start())
                leaf = not end and name not in CONTAINERS
        elif name == "br":
            text.append(" ")
        elif name == "a":
            state["link"] = 0 if end else 1
    if not skip:
        text.append(html[at:])
        state["own"] += 0 if state["link"] else len(html[at:].strip())
    flush()
    while doubts:
        _settle(out, doubts.pop()[2], gap, state["article"] > 0)
    return out


def weights(rows: list[tuple[str, int, bool, frozenset[int]]]) -> tuple[list[int], bool]:
    """What each line adds to the distribution, and whether the page marks its article.

    That is its length outside links.  In a page that marks its article (by any text there outside links, or by any at all
    in a page of links alone) it is the whole length and a threshold more for a line in there, and nothing for others.
    """
    marked = any(inside and n for _, n, inside, _ in rows) or not any(n for _, n, _, _ in rows)
    if marked:
        return [len(t) + SURGE if inside and t else 0 for t, _, inside, _ in rows], True
    return [n for _, n, _, _ in rows], False


def bodies(size: list[int]) -> list[tuple[int, int, int]]:
    """Surge and dive point and peak of every run of windows that aren't empty."""
    block = [sum(size[i:i + WINDOW]) for i in range(len(size))]
    out, i = [], 0
    while i < len(block):
        dive = i
        while dive < len(block) and block[dive]:
            dive += 1
        if dive > i:
            out.append((i, dive, max(block[i:dive])))
        i = dive + 1
    return out


def main_text(html: str | None) -> str:
    """The lines between surge and dive points, joined by a blank line.

    A run of lines that stays below the threshold goes on with a body before it, as far as its lines share a parent
    with the lines kept there.
    """
    rows = lines(html or "")
    size, marked = weights(rows)
    found = bodies(size)
    need = min(SURGE, max((peak for _, _, peak in found), default=0))
    kept, parents = [], frozenset()
    for surge, dive, peak in found:
        run = [r for r in rows[surge:dive] if r[0] and (r[2] or not marked)]
        if peak < need:
            run = [r for r in run if r[3] & parents]
        if run:
            kept += [r[0] for r in run]
            parents = frozenset().union(*(r[3] for r in run))
    return "\n\n".join(kept)


def _extract_batches(batches, column: int):
    for b in batches:
        texts = pa.array([main_text(h) for h in b.column(column).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(column)), texts],
                                         names=[*b.schema.names[:column], "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the main text and its code points.

    A null or empty page has the empty text, as has one without reading text.  Text before the first tag
    and after the last counts as a line.  Repeated rows each give a row; other columns are not read.
    """
    prepare_python(pages.sparkSession)
    return (pages.select("page_id", "url", "html")
            .mapInArrow(partial(_extract_batches, column=2),
                        f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
            .withColumn("n_chars", F.char_length("text").cast("long")))
