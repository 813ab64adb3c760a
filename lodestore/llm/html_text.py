"""HTML extraction: streamed parser events, text-to-tag ratios per line, smoothing and threshold clustering.

The standard library's parser is fed a page in pieces and its events are turned
into lines: a line is the text of one block, with the number of tags and of link
characters in it and the region it lies in.  Regions that elements or their
class, id and role names mark as something other than the article (menus,
headers, footers, sidebars, notices, adverts, forms, comments, hidden parts)
give no lines, and neither do scripts, styles and markup.  A form and a part that
only its name marks are judged when the page has been read: their lines stay if
the article or main regions in them hold most of all regions' text, or, where
there are none, if they hold most of the page's text.

The text-to-tag ratio of each line (text outside links by tags) is smoothed with
a Gaussian kernel over neighbouring lines.  Lines above the threshold (the
ratios' standard deviation, or a share of their mean when they hardly differ)
form clusters.  The content is the lowest container of nearly all the clusters'
text (of that in article and main regions, if they hold most of it), or the
innermost such region around it; all lines of that container are the text, so
short paragraphs between long ones stay.  Where the container lies in no article
or main region, article elements in it that hold less than half of its text are
others' (readers' comments, teasers) and go.

Defined cases: a null or empty page and a page without such lines give the empty
string; unclosed and truncated markup is closed at the end; repeated rows are
extracted one by one; null ids and addresses stay null; an empty table gives an
empty one; other columns are left out.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import _shared

#: Elements that never hold the article's text.
SKIPPED = frozenset(
    "script style noscript template head nav footer aside button select option textarea input label fieldset legend datalist iframe object "
    "embed applet svg canvas map audio video menu dialog noframes frameset title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the second kind ends where one of the first begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"html", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}
#: Names of classes, ids and roles that mark a part as something else.
OTHER = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|side-?bar|aside|"
    r"widgets?|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|"
    r"sign-?up|login|comments?|commentlist|disqus|respond|replies|reader-?comments?|pagination|pager|search|toolbar|skip-?link|hidden|"
    r"sr-only|visually-hidden|legal|copyright|contentinfo|complementary|navigation|dialog|form)(?:$|[-_\s\d])",
    re.I,
)
KEPT_NAMES = re.compile(r"(?:^|[-_\s])(?:article|main|content|post|entry|story|body)(?:$|[-_\s\d])", re.I)
#: Names that only tell what a wrapper has beside it.
FLAGS = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S+", re.I)
#: Headers inside an article or main region are its own.
HEADERS = re.compile(r"(?<![^-_\s])header(?![^-_\s\d])", re.I)
#: Article elements of such names, or in parts of such names, are not the page's article.
BESIDE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|teaser|comments?|reply|replies)(?:$|[-_\s\d])", re.I)
#: The share of the clusters' text that their container holds at least.
NEARLY = 0.95
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
PIECE = 1 << 16
SIGMA, REACH = 1.0, 3


class Line:
    __slots__ = ("text", "tags", "linked", "path")

    def __init__(self, text: str, tags: int, linked: int, path: tuple[int, ...]):
        self.text, self.tags, self.linked, self.path = text, tags, linked, path


class Events(HTMLParser):
    """Turns parser events into lines, keeping the open elements and nothing else of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, int, bool]] = []  # name, number, skipped
        self.number = self.tags = self.links = self.linked = 0
        self.skipping = 0
        self.regions: set[int] = set()  # numbers of article and main elements
        self.articles: set[int] = set()  # of article elements only
        self.beside: set[int] = set()  # of elements whose articles are not the page's
        self.marked: set[int] = set()  # numbers of elements that their names mark
        self.parts: list[str] = []

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.linked, tuple(n for _, n, _ in self.stack)))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _pop(self, index: int) -> None:
        for name, _, skipped in reversed(self.stack[index:]):
            if name in BLOCK:
                self.flush()
            if name == "a":
                self.links -= 1
            self.skipping -= skipped
            self.stack.pop()

    def _close_implied(self, tag: str) -> None:
        if tag in CLOSES_P:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._pop(i)
                    break
                if self.stack[i][0] in BLOCK:
                    break
        ends = ENDS.get(tag)
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self._pop(i)
                    break
                if self.stack[i][0] in ("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"):
                    break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._close_implied(tag)
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        found = {k: v or "" for k, v in attrs}
        self.number += 1
        skipped = (tag in SKIPPED and tag != "header") or self._hidden(tag, found)
        names = FLAGS.sub("", " ".join(found[k] for k in ("class", "id", "role") if k in found))
        if not skipped and (tag == "form" or self._named(tag, names)):
            self.marked.add(self.number)
        if tag == "article" or found.get("role") == "article":
            self.articles.add(self.number)
        if tag == "article" or tag == "main" or found.get("role") in ("article", "main") or found.get("itemprop") == "articleBody":
            if not BESIDE.search(names) and not any(n in self.beside for _, n, _ in self.stack):
                self.regions.add(self.number)
        elif tag not in ("html", "body") and names and BESIDE.search(names):
            self.beside.add(self.number)
        self.stack.append((tag, self.number, skipped))
        self.skipping += skipped
        if tag == "a":
            self.links += 1

    def _inside(self) -> bool:
        return any(n in self.regions for _, n, _ in self.stack)

    def _hidden(self, tag: str, found: dict[str, str]) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        if tag == "header":  # the page's, unless it is the article's own
            return not self._inside()
        return "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))

    def _named(self, tag: str, names: str) -> bool:
        if tag in ("html", "body", "article", "main", "header") or not names or not OTHER.search(names) or KEPT_NAMES.fullmatch(names):
            return False
        return not self._inside() or bool(OTHER.search(HEADERS.sub("", names)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self._pop(i)
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def parse(html: str) -> Events:
    events = Events()
    for i in range(0, len(html), PIECE):
        events.feed(html[i : i + PIECE])
    events.close()
    events._pop(0)
    events.flush()
    return events


def smoothed(ratios: list[float]) -> list[float]:
    kernel = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-REACH, REACH + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in enumerate(kernel, start=i - REACH):
            if 0 <= k < len(ratios):
                total += w * ratios[k]
                weight += w
        out.append(total / weight)
    return out


def content(lines: list[Line]) -> list[bool]:
    """Whether each line lies in a cluster of high ratios."""
    ratios = [max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    threshold = min(deviation, mean / 2)
    return [x >= threshold and x > 0 for x in smooth]


def _own(line: Line) -> int:
    """Characters outside links."""
    return len(line.text) - line.linked


def unmarked(events: Events) -> list[Line]:
    """The lines without those of marked elements, where these don't hold most of the text."""
    if not events.marked:
        return events.lines
    page = regions = 0
    held: dict[int, int] = {}  # marked element -> its text
    around: dict[int, int] = {}  # marked element -> text of the regions in it
    for line in events.lines:
        n = _own(line)
        page += n
        last = max((i for i, x in enumerate(line.path) if x in events.regions), default=-1)
        regions += n if last >= 0 else 0
        for i, x in enumerate(line.path):
            if x in events.marked:
                held[x] = held.get(x, 0) + n
                around[x] = around.get(x, 0) + (n if i < last else 0)
    kept = {x for x in held if (2 * around[x] > regions if regions else 2 * held[x] > page)}
    dropped = events.marked - kept
    return [x for x in events.lines if dropped.isdisjoint(x.path)]


def _without_others(lines: list[Line], articles: set[int], container: int) -> list[Line]:
    """The container's lines without those of article elements below it, if these hold less than half of the text."""
    own = [x for x in lines if not any(n > container and n in articles for n in x.path)]
    return own if 2 * sum(map(_own, own)) > sum(map(_own, lines)) else lines


def extract(html: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    if not html:
        return ""
    events = parse(html)
    lines = unmarked(events)
    if not lines:
        return ""
    high = [x for x, is_high in zip(lines, content(lines), strict=True) if is_high]
    total = sum(map(_own, high))
    within = [x for x in high if not events.regions.isdisjoint(x.path)]
    in_regions = 2 * sum(map(_own, within)) > total
    clusters = within if in_regions else high
    weight: dict[int, int] = {}
    for line in clusters:
        for n in line.path:
            weight[n] = weight.get(n, 0) + _own(line)
    least = NEARLY * sum(map(_own, clusters))
    # numbers grow inwards
    best = max((n for n, w in weight.items() if w >= least > 0), default=None)
    if best is None:
        return "\n".join(x.text for x in high)
    path = next(x.path for x in clusters if best in x.path)
    around = [n for n in path[: path.index(best) + 1] if n in events.regions]
    if around:
        best = around[-1]
    inside = [x for x in lines if best in x.path and (around or not in_regions or not events.regions.isdisjoint(x.path))]
    if not around:
        inside = _without_others(inside, events.articles, best)
    if len(inside) == 1 and len(lines) > 1 and not around:  # the holder is one block: its parent's blocks are the text
        inside = high
    return "\n".join(x.text for x in inside)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(_shared.released(run), f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_shared.table(spark, sf_dir, "pages"))
