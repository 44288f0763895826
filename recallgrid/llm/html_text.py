"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams a page's events. Block tags end lines; a line's text-to-tag ratio is its
characters over the tags met since the line before (one at least). The ratios are smoothed by a Gaussian, and
two clusters, one held at zero, set the threshold between page furniture and content. Lines are grouped in
regions: an article or main element is one region, and outside of these each section, list, table or division
is. A region whose text-weighted smoothed ratio reaches the threshold is content and keeps all of its lines,
short ones too. That an element is an article, by tag or by the words of class and id, only groups its lines: such
a region is chosen by its ratio like any other, and no other region is dropped for it.
Menus, headers of the page, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
known by element, role or a whole name in class or id (all of its words are of furniture or neutral, so "share-price" names
none), and are never content, though their lines count in the statistics.

Defined results: null, empty and text-free pages give the empty text; unclosed and stray tags don't lose an
article; character references are decoded; white space within a line becomes one space and lines are joined by
one line feed; pages are read whole; other input columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("article main section div table ul ol dl form fieldset body aside nav header footer td blockquote".split())
FURNITURE = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav aside footer form button select textarea datalist dialog menu".split()
)
LANDMARK_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar toolbar comment comments commentlist disqus respond replies reply discussion cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination "
    "pager paging skip search toc".split()
)
#: Words that may stand beside a furniture word in one name, as in "sidebar-left"; with any other word ("share-price") the name says nothing.
NEUTRAL_WORDS = frozenset(
    "area article articles bar block body bottom box btn button buttons col column container entry footer form global group head header holder icon icons inner item items "
    "left link links list main outer page panel post posts primary read reader right row secondary section site slot social story text title top unit user wrap wrapper zone".split()
)
TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+").findall
CONTENT = frozenset(("article", "main"))
CONTENT_WORDS = frozenset("article post entry story".split())
BODY_WORDS = frozenset("content single full hentry".split())


def named_words(value: str) -> list[frozenset[str]]:
    """The words of each name in a class or id attribute."""
    return [frozenset(w.lower() for w in TOKEN(name)) for name in value.split()]


def names_furniture(value: str) -> bool:
    """Whether a name in a class or id attribute is one of page furniture as a whole."""
    return any(words & FURNITURE_WORDS and words <= FURNITURE_WORDS | NEUTRAL_WORDS for words in named_words(value))


LISTS = frozenset("ul ol dl table blockquote".split())


class Lines(HTMLParser):
    """Collects (text, tags, region, furniture) of each line. wrapper: the number of a form that is no furniture, as the page stands in it."""

    def __init__(self, wrapper: int | None = None):
        super().__init__(convert_charrefs=True)
        self.wrapper = wrapper
        self.forms: list[int] = []  # code points of each form
        self.prose = False  # whether a paragraph has ended in this region
        self.attached: dict[int, int] = {}  # lists and tables that follow a paragraph, to its region
        self.within: list | None = None  # the list or table of that kind that is open: tag, depth, region
        self.linked: dict[int, int] = {}  # code points inside links, by region
        self.links = 0
        self.lines: list[tuple[str, int, int, bool]] = []
        self.texts: list[str] = []
        self.tags = 0
        self.region = 0
        self.regions = 0
        self.open: list[list] = []  # elements that hold the article, each with the depth of its own tag
        self.skip: str | None = None  # the element that began the furniture we are in
        self.depth = 0
        self.comments = False

    def end_line(self) -> None:
        if self.texts:
            text = " ".join("".join(self.texts).split())
            self.texts = []
            if text:
                self.lines.append((text, self.tags, self.region, self.skip is not None))
                if self.skip == "form" and self.forms:
                    self.forms[-1] += len(text)
                self.tags = 0

    def new_region(self) -> None:
        self.regions += 1
        self.region = self.regions
        self.prose = False
        if self.within is not None:
            self.attached[self.region] = self.within[2]

    def is_furniture(self, tag: str, attrs) -> bool:
        if tag in FURNITURE:
            return True
        if tag == "header":
            return not self.open
        if tag in CONTENT and not attrs:
            return False
        if tag == "body" or tag == "html":
            return False
        for name, value in attrs:
            if not value:
                if name == "hidden":
                    return True
                continue
            if name == "role":
                if value.lower() in LANDMARK_ROLES:
                    return True
            elif name == "class" or name == "id":
                if names_furniture(value) and not (tag in CONTENT and "comment" not in value.lower()):
                    return True
            elif name == "style":
                if "display:none" in value.replace(" ", "").lower():
                    return True
            elif name == "aria-hidden" and value.lower() == "true":
                return True
        return False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if self.skip is not None:
            if tag == self.skip:
                self.depth += 1
            elif tag in CONTENT and not self.comments and not self.is_furniture(tag, attrs):
                self.skip = None  # furniture that was never closed
            if self.skip is not None:
                return
        if tag in VOID:
            return
        if tag == "form":
            self.forms.append(0)
            if len(self.forms) - 1 == self.wrapper:
                return
        if tag == "a":
            self.links += 1
        if self.is_furniture(tag, attrs):
            self.end_line()
            self.skip, self.depth = tag, 1
            self.comments = any(v and re.search("comment|repl|respond|discuss", v, re.I) for n, v in attrs if n in ("class", "id"))
            return
        if tag in CONTENT or tag in ("div", "section", "td") and any(n in ("class", "id") and v and any(words & CONTENT_WORDS and words <= CONTENT_WORDS | NEUTRAL_WORDS | BODY_WORDS for words in named_words(v)) for n, v in attrs):
            self.open.append([tag, 1])
            self.new_region()
        elif self.open and tag == self.open[-1][0]:
            self.open[-1][1] += 1
        elif tag in SECTIONS and not self.open:
            if self.within is None:
                self.within = [tag, 1, self.region] if self.prose and tag in LISTS else None
            elif tag == self.within[0]:
                self.within[1] += 1
            self.new_region()

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if self.skip is not None:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.end_line()
                    self.skip = None
            elif tag in ("body", "html"):
                self.end_line()
                self.skip = None
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag == "p":
            self.prose = True
        elif self.within is not None and tag == self.within[0]:
            self.within[1] -= 1
            if not self.within[1]:  # what follows goes on where the list broke in
                self.region, self.prose, self.within = self.within[2], True, None
                return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None) if self.open else None
        if at is not None and (at == len(self.open) - 1 or tag in CONTENT):
            self.open[at][1] -= 1
            if not self.open[at][1]:
                del self.open[at:]
                self.new_region()
        elif tag in SECTIONS and not self.open:
            self.new_region()

    def handle_data(self, data):
        if self.skip is None or self.skip not in ("script", "style", "head", "title"):
            self.texts.append(data)
            if self.links and self.skip is None:
                self.linked[self.region] = self.linked.get(self.region, 0) + len(data)


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing with a kernel of radius ceil(2 sigma), normed at the ends."""
    r = math.ceil(2 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    out = []
    n = len(values)
    for i in range(n):
        lo, hi = max(0, i - r), min(n, i + r + 1)
        ks = kernel[lo - i + r : hi - i + r]
        out.append(sum(k * v for k, v in zip(ks, values[lo:hi], strict=True)) / sum(ks))
    return out


def threshold(values: list[float]) -> float:
    """Half the upper of two clusters' means, the lower mean held at zero; iterated until it stands."""
    upper = max(values)
    for _ in range(50):
        part = [v for v in values if v >= upper / 2]
        mean = sum(part) / len(part)
        if abs(mean - upper) < 1e-9:
            break
        upper = mean
    return upper / 2


def parsed(html: str, wrapper: int | None = None) -> Lines:
    parser = Lines(wrapper)
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The text of a page's content. Where one form holds several times what is found outside of it, the page stands in that form,
    which then is no furniture."""
    if not html:
        return ""
    page = parsed(html)
    text = content_of(page, sigma)
    if page.forms and max(page.forms) > 4 * len(text):
        text = content_of(parsed(html, page.forms.index(max(page.forms))), sigma)
    return text


def content_of(page: Lines, sigma: float = 1.0) -> str:
    lines = page.lines
    if not lines or all(skip for *_, skip in lines):
        return ""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _, _ in lines], sigma)
    cut = threshold(ratios)
    chars: dict[int, float] = {}
    mass: dict[int, float] = {}
    for (text, _, region, skip), ratio in zip(lines, ratios, strict=True):
        if not skip:
            chars[region] = chars.get(region, 0) + len(text)
            mass[region] = mass.get(region, 0) + len(text) * ratio
    best = max(mass[r] / chars[r] for r in chars)
    chosen = {r for r in chars if mass[r] / chars[r] >= min(cut, best)}
    # A list or table between chosen paragraphs is content as they are, unless it is one of links.
    for region in sorted(chars):
        if page.attached.get(region) in chosen and page.linked.get(region, 0) * 2 < chars[region]:
            chosen.add(region)
    return "\n".join(text for text, _, region, skip in lines if not skip and region in chosen)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    import pyarrow as pa

    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts = [main_text(v.as_py()) for v in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"]
                )

    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
