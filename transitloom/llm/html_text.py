"""Main text of web pages: paragraphs give points to the elements around them, and the best container is kept with its like."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import bounded_batches

#: Elements that stand on lines of their own. (Fixed values.)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)

#: Elements without content. (Fixed values.)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements that never hold the article's text. (Fixed values.)
NEVER = frozenset("applet aside audio button canvas datalist embed footer form head iframe map math menu meter nav noembed noframes noscript object option progress script select style svg template textarea title video".split())

#: Words in a class, id or role that tell what is around an article. (Fixed values.)
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline comment comments commentlist complementary contentinfo cookie cookies consent "
    "disqus dialog footer footnav gdpr hidden login masthead menu menubar modal nav navbar navigation navigator newsletter notice notices notification pager pagination paywall popup "
    "promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)

#: Words that tell an article's own parts, and what they add to a container's points. (Fixed values.)
INSIDE = frozenset("article articlebody body content entry hentry main post story text".split())
HINT = 25.0

#: Elements whose text counts as a paragraph, and the points of those that are likely containers or not. (Fixed values.)
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body".split())
BASE = {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "li": -3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "dd": -3.0, "address": -3.0, "th": -5.0}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Ancestors that a paragraph gives points to; the nearest gets all, the next half, then a third of its distance's share.
LEVELS = 5

#: Elements within elements at most; deeper ones become children of the last, so no text is lost.
DEPTH = 512

#: A sibling stays with this share of the best container's points.
LIKE = 0.2

#: An element of the name left ends where one of the names right begins. (Fixed values.)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSES = {name: [left for left, right in CLOSED_BY.items() if name in right] for name in {x for right in CLOSED_BY.values() for x in right}}
SCOPES = frozenset("ul ol dl table select".split())

_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_UNREAD = re.compile(r"<!--(?:.*?-->|.*\Z)|<(script|style)\b(?:[^>]*/>|[^>]*>.*?(?:</\1\s*>|\Z))", re.S | re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _names(attributes: dict[str, str | None]) -> set[str]:
    found = " ".join(attributes.get(k) or "" for k in ("class", "id", "role"))
    return {w.lower() for w in _WORDS.findall(found)}


class Page(HTMLParser):
    """A page's elements and blocks of text; what is around the article by its name or element is left out while reading.

    Open paragraphs, list items and cells end where the standard says so, end tags without a
    beginning are passed over, and a page may end anywhere.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.hint = ["html"], [-1], [0.0]
        self.open = [0]  # elements from the outermost to where the page is now
        self.count = Counter(html=1)
        self.outside = 0  # open elements that are around the article
        self.out_of: set[int] = set()
        self.links = 0
        self.blocks: list[list] = []  # element, pieces of text, characters inside links
        self.fresh = True

    def _around(self, tag: str, attributes: dict[str, str | None]) -> bool:
        if tag in NEVER:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        if tag == "header":  # of an article its headings stay, see handle_data
            return not (self.count["article"] or self.count["main"])
        if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true" or _UNSEEN.search(attributes.get("style") or ""):
            return True
        names = _names(attributes) if attributes else set()
        return bool(names & AROUND) or ("header" in names and not names & INSIDE and tag not in HEADINGS)

    def _close_to(self, at: int) -> None:
        """Closes open elements from the place ``at`` on."""
        for node in self.open[at:]:
            tag = self.tag[node]
            self.count[tag] -= 1
            self.links -= tag == "a"
            self.fresh |= tag in BLOCKS
            if node in self.out_of:
                self.outside -= 1
        del self.open[at:]

    def _close(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Closes the innermost open element of the name, unless one of ``within`` stands before it."""
        if self.count[tag] > 0:
            for at in range(len(self.open) - 1, 0, -1):
                found = self.tag[self.open[at]]
                if found == tag:
                    return self._close_to(at)
                if found in within:
                    return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close("p")
            self.fresh = True
        for other in CLOSES.get(tag, ()):
            self._close(other, SCOPES)
        if tag in HEADINGS and self.tag[self.open[-1]] in HEADINGS:
            self._close_to(len(self.open) - 1)
        if tag == "br" or tag == "wbr":
            self.handle_data(" " if tag == "br" else "")
        if tag in VOID or tag in ("html", "body") and self.count[tag]:
            return
        attributes = dict(attrs)
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        names = _names(attributes) if attributes else set()
        self.hint.append(BASE.get(tag, 0.0) + HINT * bool(names & INSIDE))
        if len(self.open) < DEPTH:
            self.open.append(node)
            self.count[tag] += 1
            self.links += tag == "a"
            if self._around(tag, attributes):
                self.out_of.add(node)
                self.outside += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.fresh = True
        if tag == "br":
            return self.handle_data(" ")
        if tag != "html":
            self._close(tag)
        return None

    def handle_data(self, data: str) -> None:
        if self.outside or not data:
            return
        if self.count["header"] and not any(self.count[h] for h in HEADINGS):
            return
        if self.fresh or not self.blocks:
            if data.isspace():
                return
            node = next(x for x in reversed(self.open) if self.tag[x] in BLOCKS)
            self.blocks.append([node, [], 0])
            self.fresh = False
        block = self.blocks[-1]
        block[1].append(data)
        if self.links:
            block[2] += len(data)


def read_page(html: str) -> tuple[Page, list[tuple[int, str, int]]]:
    """The page's elements and its blocks (element, text in one line, characters inside links), without empty ones."""
    page = Page()
    page.feed(_UNREAD.sub("", html))
    page.close()
    blocks = [(node, " ".join("".join(pieces).split()), linked) for node, pieces, linked in page.blocks]
    return page, [b for b in blocks if b[1]]


def points(page: Page, blocks: list[tuple[int, str, int]]) -> dict[int, float]:
    """Points of the elements around paragraphs, less the share of their text that is links."""
    score: dict[int, float] = {}
    size, linked = Counter(), Counter()
    for node, text, links in blocks:
        give = 1 + text.count(",") + min(len(text) / 100, 3)
        paragraph = page.tag[node] in PARAGRAPHS
        # text that stands in a container itself counts for it
        above = node if page.tag[node] in ("div", "section", "article", "main", "body", "td", "th") else page.parent[node]
        for level in range(LEVELS):
            if above < 0:
                break
            if paragraph:
                score[above] = score.get(above, page.hint[above]) + give / (1 if level == 0 else 2 if level == 1 else 3 * level)
            above = page.parent[above]
        while node >= 0:
            size[node] += len(text)
            linked[node] += min(links, len(text))
            node = page.parent[node]
    return {node: s * (1 - linked[node] / size[node]) for node, s in score.items()}


def siblings(page: Page, best: int) -> set[int]:
    """The other children of an element's parent; of a cell all cells of its table."""

    def home(node: int) -> int:
        while page.tag[node] in ("td", "th", "tr", "tbody", "thead", "tfoot"):
            node = page.parent[node]
        return node

    if page.tag[best] in ("td", "th"):
        return {k for k, tag in enumerate(page.tag) if k != best and tag in ("td", "th") and home(k) == home(best)}
    return {k for k, above in enumerate(page.parent) if k != best and above == page.parent[best]}


def kept_elements(page: Page, blocks: list[tuple[int, str, int]]) -> set[int]:
    """The container of the most points, or the article around it, and its siblings that are like it."""
    score = points(page, blocks)
    if not score:  # no paragraph: headings and the like of an article, where there is one
        return {k for k, tag in enumerate(page.tag) if tag in ("article", "main")} or {0}
    best = max(score, key=lambda k: (score[k], -k))
    around, article = best, None
    while around >= 0:
        if page.tag[around] == "article" or page.tag[around] == "main" and article is None:
            article = around
        around = page.parent[around]
    best = best if article is None else article
    least = LIKE * score.get(best, 0.0)
    keep, own = {best}, Counter()
    beside = siblings(page, best)
    for node, text, links in blocks:
        while node > 0 and node not in beside:
            node = page.parent[node]
        if node > 0 and node != best:
            own[node] += len(text) - min(links, len(text))
            own[-node] += len(text)
    for node in [k for k in own if k > 0]:
        text, dense = own[-node], 1 - own[node] / own[-node]
        heading = page.tag[node] in HEADINGS and node < best and dense < 0.3
        paragraph = page.tag[node] in ("p", "pre", "blockquote") and (dense < 0.25 if text > 80 else dense == 0)
        if score.get(node, 0.0) >= least and dense < 0.5 or heading or paragraph:
            keep.add(node)
    return keep


def main_text(html: str | None) -> str:
    """The blocks of the article, in page order, joined by an empty line."""
    if not html:
        return ""
    page, blocks = read_page(html)
    if not blocks:
        return ""
    keep = kept_elements(page, blocks)
    inside = [k in keep for k in range(len(page.tag))]
    for k in range(1, len(inside)):  # parents come before their children
        inside[k] |= inside[page.parent[k]]
    return "\n\n".join(text for node, text, _ in blocks if inside[node])


@F.pandas_udf(StringType())
def main_text_column(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extract_pages(pages: DataFrame, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The main text of each page: the columns ``keep`` (page_id and url), text, n_chars in code points.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
    go by their element, class, id or role; of what is left the best container by points
    stays, with the siblings that are like it. Character references are decoded, white space
    in a block is one space, and a line break is white space. A null or empty page, or one
    without an article, has an empty text. Broken markup is read as far as it goes, and whole
    pages are read. Repeated rows give repeated rows; an empty table gives none.
    """
    bounded_batches(pages.sparkSession)
    kept = [F.col(f"`{c}`") for c in (keep or ["page_id", "url"])]
    done = pages.select(*kept, main_text_column(F.col(html_col).cast("string")).alias("text"))
    return done.withColumn("n_chars", F.length("text").cast("long"))
