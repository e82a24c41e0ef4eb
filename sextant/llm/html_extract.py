"""HTML extraction: parser events to lines, text-to-tag ratios smoothed and clustered, content regions selected."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sextant.llm.common import map_batches

#: Elements that end one line and begin another.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that by their meaning hold no text of an article: of a form these are its controls.
BOILERPLATE = frozenset("aside button canvas datalist dialog footer head iframe label legend menu nav noscript object script search select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or an id that speak against a region, if all its other words are about layout.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies reply respond share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
LAYOUT = frozenset(
    "area articles bar block body bottom box button buttons center col column container content fixed global group holder icons inline inner item items js left link links list main media message module outer overlay page panel post posts region right row section site slot stories sticky strip tab text top unit wrap wrapper".split()
)
#: Elements within a line, whose class says nothing about regions.
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that can be a region.
CONTAINERS = frozenset("article blockquote body center dir div dl html main ol section table td ul".split())
#: Elements that one of the same group closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: What a mark, and an article or main around it, does to a line's ratio; and that it stands outside of these, on a page that
#: has one.
AGAINST, FOR, OUTSIDE = 0.02, 4.0, 0.05
#: How many times as high the ratios of contents are as those of the rest, at least.
CONTRAST = 3.0
#: Characters that the parser is given at once.
CHUNK = 1 << 16
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CUT = re.compile(r"<[A-Za-z/!?][^<>]*\Z")

def marked(value: str, but: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether one of the names in a class or an id is made of marks (other than `but`) and words of layout alone:
    comment-list is, related-work isn't."""
    for name in value.split():
        found = {w.lower() for w in _WORD.findall(name)}
        if found & MARKS - but and found <= MARKS | LAYOUT:
            return True
    return False


class Element:
    """An open element, with all that it passes on to those inside it, so that a line costs the same at any depth."""

    __slots__ = ("article", "box", "depth", "form", "heading", "in_header", "link", "main", "out", "parent", "region", "tag")

    def __init__(self, tag: str, parent: Element | None, out: bool, against: bool) -> None:
        self.tag, self.parent, self.out = tag, parent, out or (parent is not None and parent.out)
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or (parent is not None and parent.link)
        self.heading = tag in HEADINGS or (parent is not None and parent.heading)
        self.in_header = tag == "header" or (parent is not None and parent.in_header)
        #: The outermost article, main and form, the innermost container, the outermost element with a mark.
        self.article = (parent and parent.article) or (self if tag == "article" else None)
        self.main = (parent and parent.main) or (self if tag == "main" else None)
        self.form = (parent and parent.form) or (self if tag == "form" else None)
        self.box = self if tag in CONTAINERS or not parent else parent.box
        self.region = (parent and parent.region) or (self if against else None)


@dataclass(slots=True)
class Line:
    text: str
    #: Tags since the last line, characters inside links, links.
    tags: int
    linked: int
    links: int
    at: Element


class Lines(HTMLParser):
    """Parser events to lines of text: one for each block that may hold text of an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open = [Element("", None, False, False)]
        self.counts: Counter[str] = Counter()
        self.tags = self.linked = self.links = 0
        self.words: list[str] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            at = self.open[-1]
            # of an article's own header only the headings are part of it
            if not at.out and (at.heading or not at.in_header):
                self.lines.append(Line(text, self.tags, min(self.linked, len(text)), self.links, at))
            self.tags = 0
        self.words, self.linked, self.links = [], 0, 0

    def judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element that begins here can hold no text of an article; whether its class speaks against it."""
        top = self.open[-1]
        inside = bool(top.article or top.main)
        if tag in BOILERPLATE or (tag == "header" and not inside):
            return True, False
        if tag in ("html", "body", "main") or (tag == "article" and not top.article):
            return False, False
        against = False
        for name, value in attrs:
            value = value or ""
            if name in ("class", "id") and tag not in INLINE and tag not in HEADINGS and tag != "header":
                against |= marked(value, {"header", "masthead"} if inside else frozenset())
            if (name == "role" and value.strip().lower() in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
                return True, False
        return False, against

    def close_to(self, depth: int) -> None:
        for x in self.open[depth:]:
            self.counts[x.tag] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        elif tag == "br":
            self.words.append(" ")
        elif tag == "a":
            self.links += 1
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, 0, -1) if tag in CLOSES else ():
            if self.open[k].tag in CLOSES[tag]:
                self.close_to(k)
                break
            if self.open[k].tag in BLOCKS:
                break
        if tag in ("article", "main") and (self.open[-1].out or self.open[-1].region):
            # an article never begins inside an element that was left open before it
            k = next(k for k, x in enumerate(self.open) if x.out or x.region)
            if self.open[k].tag not in ("dialog", "noscript", "template") and not self.open[k].article:
                self.close_to(k)
        self.open.append(Element(tag, self.open[-1], *self.judged(tag, attrs)))
        self.counts[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "script", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if self.counts[tag] > 0:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self.close_to(k)
                    break
                if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                    break

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if not top.out:
            self.words.append(data)
            if top.link:
                self.linked += len(data)


def lines_of(html: str) -> list[Line]:
    parser = Lines()
    html = _CUT.sub("", html)
    for k in range(0, len(html), CHUNK):
        parser.feed(html[k : k + CHUNK])
    parser.close()
    parser.end_line()
    return parser.lines


def smoothed(values: np.ndarray, sigma: float = 1.0, radius: int = 2) -> np.ndarray:
    """Values under a Gaussian kernel of 2 * radius + 1 lines; at the ends the kernel is cut and scaled anew."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(values, kernel), np.convolve(np.ones(len(values)), kernel)
    return full[0][radius : radius + len(values)] / full[1][radius : radius + len(values)]


def threshold(values: np.ndarray) -> float:
    """Where two clusters of values part: the means of those above and below it are equally far (k-means in one dimension,
    over logarithms). Below all values, if the clusters' means are less than CONTRAST times apart: then there is one."""
    logs = np.log1p(values)
    low, high = float(logs.min()), float(logs.max())
    for _ in range(50):
        above, below = logs[logs > (low + high) / 2], logs[logs <= (low + high) / 2]
        if not len(above) or not len(below):
            break
        fresh = float(below.mean()), float(above.mean())
        if fresh == (low, high):
            break
        low, high = fresh
    return float(np.expm1((low + high) / 2)) if high - low >= np.log(CONTRAST) else -1.0


def without_forms(lines: list[Line]) -> list[Line]:
    """Lines outside of forms, and all inside of a form that holds the page: an article or main, or half of its text."""
    sizes: Counter[Element | None] = Counter()
    for x in lines:
        sizes[x.at.form] += len(x.text)
    whole = {x.at.form for x in lines if (r := x.at.article or x.at.main) and x.at.form and x.at.form.depth < r.depth}
    whole |= {f for f, n in sizes.items() if f and 2 * n >= sum(sizes.values())}
    return [x for x in lines if not x.at.form or x.at.form in whole]


def root(at: Element) -> Element:
    """The region that a line is selected with: main, or its article, or else its outermost element with a mark, or container."""
    return at.main or at.article or at.region or at.box


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside of links for each tag; less in a region with a mark, more in an article or main, less outside of
    these where there is one. Lines are smoothed within their region with a mark, article, main or else container, so an
    advert gains nothing from its place."""
    named = any(x.at.article or x.at.main for x in lines)

    def factor(at: Element) -> float:
        inside = bool(at.article or at.main)
        return (AGAINST if at.region else FOR if inside else 1.0) * (OUTSIDE if named and not inside else 1.0)

    raw = np.array([(len(x.text) - x.linked) / max(1, x.tags) * factor(x.at) for x in lines])
    flows: dict[Element, list[int]] = {}
    for k, x in enumerate(lines):
        flows.setdefault(x.at.region or x.at.article or x.at.main or x.at.box, []).append(k)
    out = np.zeros(len(lines))
    for at in flows.values():
        out[at] = smoothed(raw[at])
    return out


def extract(html: str, cut: Callable[[np.ndarray], float] = threshold) -> list[str]:
    """The lines of a page's main text. cut: where the clusters of ratios part.

    Lines in the upper cluster select the regions. A region whose class speaks against it goes unless one of its lines is
    in the upper cluster. Main, or an article where no main is, stays if one of its lines is, and stays whole but for such
    regions; so does any other region beside them. On a page without main and articles a line stays if its container
    holds one of the upper cluster, at any depth, or if it stands between two of these; so do headings that lead to the
    first. Containers there that hold two links or more, and little else, go, unless they stand between lines of the
    upper cluster that are directly in the container around them.
    """
    lines = without_forms(lines_of(html))
    if not lines:
        return []
    ratio = ratios(lines)
    upper = ratio > cut(ratio)
    strong = {x.at.region for x, up in zip(lines, upper, strict=True) if up}
    some = [k for k, x in enumerate(lines) if not x.at.region or x.at.region in strong]
    chosen = [k for k in some if upper[k]] or some
    if any(x.at.article or x.at.main for x in lines):
        roots = {root(lines[k].at) for k in chosen}
        return [lines[k].text for k in some if root(lines[k].at) in roots]
    sums: dict[Element, np.ndarray] = {}
    for k in some:
        x = lines[k]
        sums[x.at.box] = sums.get(x.at.box, 0) + np.array([len(x.text), x.linked, x.links])
    menus = {box for box, (n, linked, links) in sums.items() if links > 1 and 2 * linked > n}
    chosen = [k for k in chosen if lines[k].at.box not in menus]
    around = _around(lines, chosen)
    direct: dict[Element, list[int]] = {}
    for k in chosen:
        direct.setdefault(lines[k].at.box, []).append(k)
    ends: dict[Element, list[int]] = {}
    for k in some:
        ends.setdefault(lines[k].at.box, []).append(k)
    for menu in list(menus):
        x = menu.parent and menu.parent.box
        while x and x not in around:
            x = x.parent and x.parent.box
        if x and (at := direct.get(x)) and at[0] < ends[menu][0] and at[-1] > ends[menu][-1]:
            menus.discard(menu)
    some = [k for k in some if lines[k].at.box not in menus]
    chosen = chosen or some
    around = _around(lines, chosen)
    before = [k for k in some if k < chosen[0]] if chosen else []
    lead = len(before)
    while lead and lines[before[lead - 1]].at.heading:
        lead -= 1
    first = before[lead] if lead < len(before) else chosen[0] if chosen else 0
    return [lines[k].text for k in some if first <= k <= chosen[-1] or lines[k].at.box in around]


def _around(lines: list[Line], chosen: list[int]) -> set[Element]:
    """The containers of some lines, and all that these are in."""
    found: set[Element] = set()
    for k in chosen:
        x = lines[k].at.box
        while x and x not in found:
            found.add(x)
            x = x.parent and x.parent.box
    return found


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (string), n_chars (long, code points) for every row of pages (page_id, url, html; others ignored).

    text is the article without menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and
    reader comments: its blocks in page order, joined by \\n, with character references decoded and white space inside
    a block made one space and trimmed. A null or empty page, or one without an article's text, has the empty text.
    Of a form that holds the page only the controls go.
    Unclosed elements and cut-off markup do no harm. Pages are independent: nothing is shuffled, repeated rows stay,
    and other columns of any name are ignored. A page goes through the parser in chunks, in time that grows with its
    length; what is held is its lines. See extract for how regions are selected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = ["\n".join(extract(h)) if (h := x.as_py()) else "" for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
