"""Main text of web pages from flat text blocks and a decision tree.

The tags of a page cut its text into flat blocks. A block is described by its number of words and its link density, by
those of the blocks before and after it, and by what surrounds it: an element or role that stands for boilerplate (1) or
only a class or id that does (0.5), an element that stands for the article, a heading. A name stands for boilerplate if
all its words do, but for words of layout ("comment-list" does, "has-sidebar" and "comments-open" don't); the header of an
article is no boilerplate, and neither is a named element that holds a page's first h1 and most of its words. The names
around an article's element do not count in it, unless the page holds another one that stands apart from such names
(teasers, comments). A short page without an article's element is judged as if its text stood in one, and links in a row
under an article's heading as if they were text. A decision tree, grown by Gini impurity on the small labelled table and
the labelled pages below, says which blocks are main text.

Decoded character references, white space inside a block as one space, trimmed, blocks joined by a blank line; blocks
that the tree keeps are returned whole, whatever their length.

A page is read in time linear in its length, however broken: every search for what ends a construct either moves the
reader on or is remembered.

Cases: a null or empty html, or one without text, gives the empty text. Broken markup is read as far as it goes: an end
tag without start is ignored, an element without end lasts to the end of the one around it, a lone < is text. Scripts,
styles and the like are passed over as raw text; buttons, videos and the like are passed over if they end before an
article, a heading or another block begins, else only their tags are. A head, closed or not, holds nothing but such elements.
Repeated rows give a row each, null ids stay null, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, map_rows

# Elements of HTML and the words that name boilerplate.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style noscript noframes template title svg math iframe object audio video canvas select textarea button datalist".split())
BOILER_TAGS = set("nav footer aside form menu dialog".split())
ARTICLE_TAGS = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
BOILER_NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget related recommended recommendations footer header masthead topbar toolbar cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist reply replies respond discussion disqus pagination pager tags copyright legal disclaimer hidden".split())

#: Words of a name that tell of layout, and may stand beside words that name boilerplate.
NEUTRAL_WORDS = set("area articles bar block bottom box button buttons center col column container content fixed group holder inline inner item items left link links list main menu module outer page panel post posts primary right row secondary section site small sticky stories story text title top unit wrap wrapper zone".split())
ARTICLE_WORDS = set("article entry post story content".split())

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>")
_START = re.compile(r"</?[A-Za-z]")
#: Elements whose text is no markup: they last to their own literal end tag.
RAW = set("script style textarea title iframe noframes".split())
_BLOCK_START = re.compile(r"<(?:article|main|section|p|div|h[1-6]|ul|ol|table|header|nav|footer|body)(?=[\s/>])", re.I)
_ARTICLE_START = re.compile(r"<(?:article|main|h1)(?=[\s/>])", re.I)
#: Elements that hold phrases only; others of SKIP may hold blocks of their own.
PHRASES = set("button select datalist".split())
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("boiler", "article", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")
# The labelled table: the features in order, then 1 for main text.
LABELLED = np.array([
    # paragraphs of an article, long and short, with and without links
    (0, 1, 0, 60, .00, 40, .0, 55, .0, 1), (0, 1, 0, 25, .05, 60, .0, 30, .0, 1), (0, 1, 0, 3, .00, 50, .0, 44, .0, 1),
    (0, 1, 0, 1, .00, 12, .0, 0, .0, 1), (0, 1, 0, 90, .10, 7, .0, 0, .0, 1), (0, 1, 0, 12, .30, 30, .0, 25, .0, 1),
    (0, 1, 0, 2, .00, 0, .0, 3, .0, 1), (0, 1, 0, 8, .00, 2, 1., 1, .0, 1), (0, 1, 0, 40, .00, 1, 1., 10, .3, 1),
    (0, 1, 0, 6, .00, 6, .0, 6, .0, 1), (0, 1, 0, 15, .55, 45, .0, 38, .0, 1), (0, 1, 0, 2, .00, 2, .0, 9, .0, 1),
    # headings of an article
    (0, 1, 1, 7, .00, 9, .0, 50, .0, 1), (0, 1, 1, 2, .00, 40, .0, 30, .0, 1), (0, 1, 1, 12, 1., 0, .0, 60, .0, 1),
    (0, 1, 1, 4, .00, 1, 1., 2, .0, 1),
    # link lists inside an article's element
    (0, 1, 0, 3, 1., 60, .0, 4, 1., 0), (0, 1, 0, 4, 1., 3, 1., 5, 1., 0), (0, 1, 0, 2, 1., 4, 1., 0, .0, 0),
    (0, 1, 0, 6, .95, 5, 1., 3, 1., 0), (0, 1, 0, 1, 1., 0, .0, 1, 1., 0),
    # boilerplate by element or name, long and short, inside the article's element or not
    (1, 0, 0, 1, 1., 1, 1., 1, 1., 0), (1, 0, 0, 9, .00, 2, 1., 12, .0, 0), (1, 0, 0, 14, .00, 60, .0, 0, .0, 0),
    (1, 0, 0, 80, .00, 30, .0, 40, .0, 0), (1, 1, 0, 30, .00, 45, .0, 20, .0, 0), (1, 1, 0, 4, .00, 45, .0, 45, .0, 0),
    (1, 0, 1, 2, .00, 0, .0, 3, 1., 0), (1, 1, 1, 3, .00, 70, .0, 25, .0, 0), (1, 0, 0, 120, .10, 1, .0, 1, .0, 0),
    (1, 0, 0, 5, .50, 90, .0, 0, .0, 0), (1, 1, 0, 65, .02, 30, .0, 2, .0, 0), (1, 0, 1, 6, 1., 2, 1., 2, 1., 0),
    # boilerplate between a long text and links, text before links
    (1, 0, 0, 10, .00, 90, .0, 3, 1., 0), (1, 0, 0, 4, 1., 120, .0, 2, 1., 0), (1, 1, 0, 20, .00, 80, .0, 5, 1., 0),
    (1, 0, 0, 40, .10, 100, .0, 8, .9, 0), (1, 1, 0, 3, .00, 150, .0, 4, .8, 0), (1, 0, 0, 100, .00, 2, 1., 6, 1., 0),
    (1, 1, 1, 4, .00, 85, .0, 3, 1., 0), (1, 0, 0, 30, .00, 20, .0, 30, .0, 0), (1, 1, 0, 50, .00, 8, .0, 60, .0, 0),
    (1, 1, 0, 7, .00, 15, .0, 9, .0, 0), (1, 0, 0, 70, .05, 65, .0, 75, .0, 0), (1, 1, 0, 25, .30, 5, .0, 4, .0, 0),
    (0, 1, 0, 30, .00, 60, .0, 2, 1., 1), (0, 1, 0, 8, .00, 10, .0, 6, 1., 1), (0, 0, 0, 40, .00, 20, .0, 3, 1., 1),
    (0, 1, 0, 5, .00, 3, 1., 3, 1., 1), (0, 1, 1, 5, .00, 3, 1., 3, 1., 1), (0, 1, 0, 20, .20, 30, .0, 4, 1., 1),
    # pages without an article's element: long texts and what stands between them
    (0, 0, 0, 60, .00, 40, .0, 50, .0, 1), (0, 0, 0, 35, .05, 6, .0, 80, .0, 1), (0, 0, 0, 22, .00, 90, .0, 3, 1., 1),
    (0, 0, 0, 150, .10, 2, 1., 5, .0, 1), (0, 0, 0, 9, .00, 50, .0, 45, .0, 1), (0, 0, 0, 3, .00, 70, .0, 60, .0, 1),
    (0, 0, 0, 14, .00, 30, .0, 25, .0, 1), (0, 0, 0, 18, .10, 40, .0, 0, .0, 1), (0, 0, 0, 26, .00, 0, .0, 0, .0, 1),
    (0, 0, 0, 2, .00, 55, .0, 40, .0, 1), (0, 0, 0, 1, .00, 30, .0, 35, .0, 1), (0, 0, 0, 2, .00, 45, .0, 70, .0, 1),
    # links alone before a text
    (0, 1, 0, 3, 1., 20, .0, 60, .0, 0), (0, 0, 0, 5, 1., 3, 1., 50, .0, 0), (0, 0, 0, 2, 1., 0, .0, 80, .0, 0),
    # their headings
    (0, 0, 1, 6, .00, 1, 1., 45, .0, 1), (0, 0, 1, 9, .00, 0, .0, 60, .0, 1), (0, 0, 1, 3, .00, 50, .0, 40, .0, 1),
    (0, 0, 1, 2, .00, 3, 1., 3, 1., 0), (0, 0, 1, 2, 1., 4, 1., 2, 1., 0), (0, 0, 1, 3, .00, 30, .0, 2, 1., 0),
    # short texts apart, link lists and lines of mixed links
    (0, 0, 0, 2, .00, 1, 1., 1, 1., 0), (0, 0, 0, 4, .00, 3, 1., 2, .0, 0), (0, 0, 0, 6, .00, 0, .0, 2, 1., 0),
    (0, 0, 0, 3, 1., 3, 1., 3, 1., 0), (0, 0, 0, 1, 1., 40, .0, 1, 1., 0), (0, 0, 0, 12, 1., 12, 1., 10, 1., 0),
    (0, 0, 0, 30, .80, 5, 1., 4, 1., 0), (0, 0, 0, 16, .70, 50, .0, 3, .5, 0), (0, 0, 0, 8, .40, 60, .0, 2, .0, 0),
    (0, 0, 0, 5, .00, 2, .0, 2, .0, 0), (0, 0, 0, 45, .60, 20, .9, 10, .9, 0), (0, 0, 0, 7, .00, 4, .5, 0, .0, 0),
])
# Blocks that only a name calls boilerplate: they are as those of an element, but long texts of an article with few links.
LABELLED = np.concatenate([
    LABELLED,
    np.where(np.arange(10) == 0, .5, LABELLED[LABELLED[:, 0] == 1]),
    np.array([
        (.5, 1, 0, 150, .00, 60, .0, 80, .0, 1), (.5, 1, 0, 200, .05, 4, 1., 5, 1., 1), (.5, 1, 0, 300, .10, 0, .0, 0, .0, 1),
        (.5, 1, 0, 170, .00, 90, .0, 2, 1., 1), (.5, 1, 0, 160, .02, 2, .0, 150, .0, 1), (.5, 1, 0, 160, .80, 30, .0, 40, .0, 0),
        (.5, 1, 0, 250, .60, 5, 1., 4, 1., 0), (.5, 1, 0, 200, .90, 60, .0, 0, .0, 0), (.5, 0, 0, 200, .00, 60, .0, 60, .0, 0),
        (1, 1, 0, 150, .00, 60, .0, 80, .0, 0), (1, 1, 0, 200, .05, 4, 1., 5, 1., 0), (1, 1, 0, 300, .10, 0, .0, 0, .0, 0),
        (1, 1, 0, 170, .00, 90, .0, 2, 1., 0), (1, 1, 0, 160, .02, 2, .0, 150, .0, 0), (1, 0, 0, 200, .00, 60, .0, 60, .0, 0),
    ]),
])


# Whole pages, labelled by block: +n stands for n words of main text, -n for n words of others.
_NAV = "<nav><ul><li><a>-1</a></li><li><a>-1</a></li><li><a>-2</a></li></ul></nav>"
_FOOT = "<footer>-4 <a>-1</a></footer>"
LABELLED_PAGES = [
    # articles of few and short blocks, after a menu or none
    f"{_NAV}<article><h1>+1</h1><p>+40</p></article>{_FOOT}", f"{_NAV}<article><h1>+2</h1><p>+3</p></article>{_FOOT}",
    f"{_NAV}<main><h1>+3</h1><p>+12</p><p>+1</p></main>{_FOOT}", f"{_NAV}<article><p>+2</p><p>+2</p></article>",
    "<article><h1>+1</h1><p>+1</p></article>", f"{_NAV}<article><h1>+3</h1><h2>+1</h2><p>+90</p></article>{_FOOT}",
    f"{_NAV}<article><p>+1</p></article>{_FOOT}", f"<main>{_NAV}<h1>+2</h1><p>+25</p></main>{_FOOT}",
    # links within text, lists of links under a heading, links alone
    f"{_NAV}<article><h1>+2</h1><p>+50</p><h2>+1</h2><ul><li><a>+3</a></li><li><a>+1</a></li></ul></article>{_FOOT}",
    f"{_NAV}<article><h1>+4</h1><p>+20 <a>+9</a></p><p><a>+3</a> +8</p></article>{_FOOT}",
    f"{_NAV}<article><h1>+4</h1><p>+70</p><ul><li><a>-4</a></li><li><a>-5</a></li></ul></article>{_FOOT}",
    f"{_NAV}<article><h1>+4</h1><p>+70</p><a>-2</a></article>{_FOOT}",
    # lists and quotes of an article, boilerplate inside it
    f"{_NAV}<article><h1>+1</h1><ul><li>+1</li><li>+2</li></ul><p>+30</p><aside>-25</aside><p>+2</p></article>{_FOOT}",
    f"{_NAV}<article><h1>+2</h1><p>+45</p><form>-3</form><div class=share><a>-1</a></div></article>{_FOOT}",
    # no element of an article's
    f"{_NAV}<div><h1>+1</h1><p>+3</p></div>{_FOOT}", f"{_NAV}<div><p>+7</p></div>{_FOOT}", f"{_NAV}<p>+1</p><p>+2</p>{_FOOT}",
    f"{_NAV}<div><h1>+2</h1><p>+60</p><h2>+1</h2><p>+80</p></div>{_FOOT}",
    f"{_NAV}<div class=ad>-9</div><div><h1>+1</h1><p>+15</p></div><div class=related-stories><p>-30</p></div>{_FOOT}",
]
_COUNT = re.compile(r"([+-])(\d+)")
_MARK = "\u2060"
#: A page without an element of an article's is short if it has fewer words outside of links and boilerplate.
SHORT_WORDS = 60


def labelled() -> np.ndarray:
    """The labelled table and the blocks of the labelled pages: features, then 1 for main text."""
    rows = []
    for page in LABELLED_PAGES:
        said = lambda m: (_MARK if m[1] == "+" else "") + "word " * int(m[2])
        found = blocks(_COUNT.sub(said, page))
        rows += [(*f, _MARK in b[0]) for f, b in zip(features(found), found, strict=True)]
    return np.concatenate([LABELLED, np.array(rows, float)])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
    """A binary decision tree: a label, or (feature, threshold, tree up to it, tree above it)."""
    if depth == 0 or len(y) <= least or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            a, b = y[low].mean(), y[~low].mean()
            impurity = low.sum() * a * (1 - a) + (~low).sum() * b * (1 - b)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, f, cut, low = best
    return f, float(cut), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, row) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if row[f] <= cut else high
    return tree


def _named(value: str, in_article: bool) -> bool:
    """Whether a class or id stands for boilerplate."""
    for name in value.split():
        words = {w.lower() for w in _NAME_WORD.findall(name)}
        if "header" in words and (in_article or words & ARTICLE_WORDS):
            continue
        if words & BOILER_NAMES and words <= BOILER_NAMES | NEUTRAL_WORDS:
            return True
    return False


def _boiler(tag: str, attributes: str, in_article: bool) -> float:
    """1 by element, role or being hidden, 0.5 by name only, 0 otherwise."""
    if tag in BOILER_TAGS or (tag == "header" and not in_article):
        return 1.0
    if not attributes.strip():
        return 0.0
    found = 0.0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return 1.0
        if name == "role" and value.lower() in BOILER_ROLES:
            return 1.0
        if name in ("class", "id") and tag not in ("body", "html", *ARTICLE_TAGS) and _named(value, in_article):
            found = 0.5
    return found


class Reader:
    """A page and the places of what ends its constructs, each looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.held: dict[str, tuple[int, int]] = {}
        self.quotes = True  # whether tags are still read with their quotes

    def next(self, pattern: re.Pattern, pos: int) -> tuple[int, int]:
        """(start, end) of the first match from pos on, at the page's end if there is none."""
        at = self.held.get(pattern.pattern)
        if at is None or at[0] < pos:
            m = pattern.search(self.page, pos)
            at = self.held[pattern.pattern] = m.span() if m else (len(self.page) + 1,) * 2
        return at

    def tag(self, pos: int):
        """The tag that starts at pos, or None."""
        if not _START.match(self.page, pos):
            return None
        if self.quotes:
            if m := _TAG.match(self.page, pos):
                return m
            self.quotes = False  # it ran to the page's end: quotes don't pair any more
        if self.next(_GREATER, pos)[0] > len(self.page):
            return None
        return _PLAIN_TAG.match(self.page, pos)

    def over(self, tag: str, pos: int) -> int:
        """Where to go on after the start of an element whose text does not count."""
        start, end = self.next(_END[tag], pos)
        if start > len(self.page):
            return len(self.page) if tag in ("script", "style") else pos
        if tag in RAW:
            return end
        stop = _BLOCK_START if tag in PHRASES else _ARTICLE_START
        return end if self.next(stop, pos)[0] > start else pos


_GREATER = re.compile(">")
_COMMENT_END = re.compile(r"-->")
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>?", re.I) for t in SKIP | RAW}


def blocks(page: str) -> list[tuple[str, float, bool, bool, int]]:
    """(text, boiler, article, heading, characters in links) of each flat block that has text."""
    out: list[tuple[str, float, bool, bool, int, bool, int]] = []
    # element, boilerplate in it, whether an article's, whether in an outermost article below boilerplate's name, the
    # number of the outermost element whose name alone stands for boilerplate (0: none)
    stack: list[tuple[str, float, bool, bool, int]] = []
    open_: dict[str, int] = {}
    block_at: list[int] = []  # places of block elements on the stack
    top_level = ("", 0.0, False, False, 0)
    names = 0
    text: list[str] = []
    linked = links = 0
    heading = False
    first_h1 = None

    def flush() -> None:
        nonlocal linked, first_h1
        if text:
            flat = " ".join(html.unescape("".join(text)).split())
            if flat:
                _, boiler, article, below, named = stack[-1] if stack else top_level
                out.append((flat, boiler, article, heading, linked, below, named))
                if first_h1 is None and any(x[0] == "h1" for x in stack[-4:]):
                    first_h1 = named
            text.clear()
        linked = 0

    def cut(at: int) -> None:
        for x in stack[at:]:
            open_[x[0]] -= 1
        del stack[at:]
        while block_at and block_at[-1] >= at:
            block_at.pop()

    reader, pos, n = Reader(page), 0, len(page)
    while pos < n:
        at = page.find("<", pos)
        if at != pos:
            at = n if at < 0 else at
            text.append(page[pos:at])
            linked += (at - pos) if links else 0
            pos = at
            continue
        if page.startswith("<!--", pos):
            pos = min(n, reader.next(_COMMENT_END, pos + 2)[1])
            continue
        if page.startswith(("<!", "<?"), pos):
            pos = min(n, reader.next(_GREATER, pos)[1])
            continue
        m = reader.tag(pos)
        if m is None:
            text.append("&lt;")
            linked += 1 if links else 0
            pos += 1
            continue
        pos = m.end()
        closing, tag = bool(m[1]), m[2].lower()
        if tag in RAW or tag in SKIP:
            if not closing and not m[3].rstrip().endswith("/"):
                pos = reader.over(tag, pos)
            continue
        if tag == "head":
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        if tag in VOID:
            continue
        if closing:
            if open_.get(tag, 0):
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                around = stack[at - 1][1] if at else 0.0
                if tag not in BLOCK and any(x[1] != around for x in stack[at:]):
                    flush()
                cut(at)
        else:
            if tag in BLOCK and block_at:  # a block ends an open paragraph
                last = stack[block_at[-1]][0]
                if last == "p" or last in HEADINGS or (last == tag and tag in ("li", "dt", "dd", "td", "th", "tr")):
                    cut(block_at[-1])
            _, boiler, article, below, group = stack[-1] if stack else top_level
            named = _boiler(tag, m[3], article)
            if named > boiler and tag not in BLOCK:
                flush()
            if tag in ARTICLE_TAGS and not article and boiler == 0.5:
                boiler, below = 0.0, True
            if named == 0.5 and not group:
                names += 1
                group = names
            if tag in BLOCK:
                block_at.append(len(stack))
            open_[tag] = open_.get(tag, 0) + 1
            stack.append((tag, max(boiler, named), article or tag in ARTICLE_TAGS, below, group))
        heading = any(x[0] in HEADINGS for x in stack[-4:])
    flush()
    apart = any(article and boiler == 0 and not below for _, boiler, article, _, _, below, _ in out)
    if first_h1 and 2 * sum(len(x[0]) for x in out if x[6] == first_h1) > sum(len(x[0]) for x in out):
        # the page's own wrapper: what its name alone says does not count
        out = [(t, 0.0 if group == first_h1 and boiler == 0.5 else boiler, *rest, below, group) for t, boiler, *rest, below, group in out]
    return [(t, max(boiler, 0.5) if below and apart else boiler, *rest) for t, boiler, *rest, below, _ in out]


def features(found: list) -> list[tuple]:
    """FEATURES of each block. Of a short page without an element of an article's, what stands between its first h1 (else its
    first text) and its last text counts as an article's. Links in a row under a heading of an article count as text: a
    list of sources, not a menu."""
    shape = [(len(t.split()), min(1.0, k / len(t))) for t, _, _, _, k in found]
    plain = [i for i, (b, (_, links)) in enumerate(zip(found, shape, strict=True)) if b[1] == 0 and links < 0.5]
    article = [b[2] for b in found]
    if not any(b[2] and b[1] == 0 for b in found) and plain and sum(shape[i][0] for i in plain) < SHORT_WORDS:
        first = next((i for i in plain if found[i][3]), plain[0])
        article = [b[1] == 0 and first <= i <= plain[-1] for i, b in enumerate(found)]
    listed = False
    for i, (text, boiler, _, heading, _) in enumerate(found):
        if heading:
            listed = bool(article[i]) and boiler == 0 and not {w.lower() for w in _NAME_WORD.findall(text)} & BOILER_NAMES
        elif boiler or shape[i][1] < 0.95:
            listed = False
        elif listed:
            shape[i] = (shape[i][0], 0.0)
    none = (0, 0.0)
    ahead, behind = [none, *shape][: len(shape)], [*shape[1:], none][: len(shape)]
    return [(b[1], art, b[3], *own, *x, *y) for b, art, own, x, y in zip(found, article, shape, ahead, behind, strict=True)]


@functools.cache
def tree_of_pages():
    """The tree of all labelled blocks, grown once a process."""
    table = labelled()
    return grow(table[:, :-1], table[:, -1], depth=12)


def extract(page: str, tree) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for f, b in zip(features(found), found, strict=True) if decide(tree, f))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""

    def make():
        tree = tree_of_pages()
        return lambda rows: [(i, url, t, len(t)) for i, url, h in rows for t in (extract(h, tree),)]

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), as_text(F.col("html")).alias("html"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
