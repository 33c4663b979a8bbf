"""The main text of web pages, from the events of the standard library's streaming parser.

Events become lines (blocks of text between block-level tags) and a light tree of block-level elements. A line's ratio is its text per
tag, links not counted; lines of menus, headers, footers, sidebars, notices, adverts, forms, comments and hidden elements
have ratio 0. The ratios are smoothed by a Gaussian along the page, and lines at or above the standard deviation of the smoothed
ratios are content. The region is the article or main element that holds most of the content, or, on pages without one, the
smallest element that holds nearly all of it. All lines of the region that are not boilerplate are returned, short ones too; on pages
without an article or main element a line must also be content, stand in the same container as one that is, lie between such lines and be no
list of links, or be a heading before them.

White space is what str.split() takes for it; br is white space inside a block. Headings in the header of an article are kept, the rest of
such a header is not. Tags that HTML lets one leave out are added. A page is one row and is parsed whole; pages are independent, so the job is a
narrow map and a lost executor repeats its pages.

Defined cases: null and empty html and pages of nothing but boilerplate give an empty text, text without any tag is a block, null ids and urls and
repeated rows pass through, other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that begin and end blocks.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no text of a page.
UNSEEN = frozenset("script style noscript template iframe svg math object canvas audio video select button textarea datalist title map".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Boilerplate by element, by role, and by words of a class or id.
AWAY_TAGS = frozenset("nav footer aside menu dialog".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
AWAY_WORDS = frozenset(
    "nav navbar topnav subnav sidenav menu menubar mainmenu submenu masthead topbar bottombar colophon aside side rail sidenote widget widgets ad ads adbox adslot adsense adsbygoogle promo "
    "promos promoted promotion banner banners consent gdpr privacy notice notices announcement announcements alert alerts popup modal overlay signup login search share sharing social related recommended "
    "recommendations trending popular teaser teasers pagination pager toolbar skip copyright disclaimer".split()
)
#: Beginnings of such words.
AWAY_STEMS = ("advert", "breadcrumb", "cookie", "footer", "navig", "newsletter", "sidebar", "sponsor", "subscri")
#: Words of a class or id that mark what readers have written.
COMMENT_WORDS = frozenset("comment comments commentlist commenters disqus guestbook reactions respond responses reply replies discussion".split())
_ARTICLE_WORDS = frozenset("article post entry content story page".split())
_UNLESS = frozenset("with has no without".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("html body div section center td article main form fieldset table tbody tr".split())
#: What a start tag ends, and the elements beyond which it ends nothing.
_ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th tbody thead tfoot", "table"), "tfoot": ("tr td th tbody thead tfoot", "table"), "option": ("option", "select")}
_ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in _ENDS.items()}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

_KEEP, _WEAK, _STRONG, _HEAD = 0, 1, 2, 3
_KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)
_KERNEL /= _KERNEL.sum()


def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """What an element's tag and attributes say: _STRONG stays away with all it holds, _WEAK with all but an article, _HEAD keeps headings only inside an article."""
    if tag in UNSEEN:
        return _STRONG
    mark = _WEAK if tag in AWAY_TAGS else _HEAD if tag == "header" else _KEEP
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
            return _STRONG
        if name == "role" and (value or "").lower() in AWAY_ROLES:
            mark = mark or _WEAK
        elif name in ("class", "id", "aria-label") and value and tag not in ("html", "body", "main"):
            for one in value.split():
                words = {w.lower() for w in _WORDS.findall(one)}
                if words & _UNLESS:
                    continue
                if words & COMMENT_WORDS:
                    return _STRONG
                if words & AWAY_WORDS or any(w.startswith(AWAY_STEMS) for w in words):
                    mark = _WEAK if mark in (_KEEP, _HEAD) else mark
                elif "header" in words and mark == _KEEP:
                    mark = _HEAD if words & _ARTICLE_WORDS else _WEAK
    return mark


class _Page(HTMLParser):
    """Lines (element, text, tags, characters in links) and elements (tag, name: the tag or, by its role, main; parent, mark) of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.names, self.parents, self.marks = [""], [""], [-1], [_KEEP]
        self.stack: list[int] = [0]
        self.lines: list[tuple[int, str, int, int]] = []
        self.pieces: list[str] = []
        self.n_tags = self.linked = self.links = self.muted = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """<![...]> is a comment up to the next bracket, whatever it says."""
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                self.lines.append((self.stack[-1], text, self.n_tags, self.linked))
                self.n_tags = self.linked = 0

    def _pop(self, to: int) -> None:
        for node in self.stack[to:]:
            self.muted -= self.tags[node] in UNSEEN
        del self.stack[to:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.n_tags += 1
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br" and self.pieces:
                self.pieces.append(" ")
            return
        block = tag in BLOCKS
        if tag == "a":
            self.links = 1  # links do not nest
        mark = _marked(tag, attrs) if block or attrs or tag in UNSEEN else _KEEP
        if not block and not mark:
            return
        if block:
            self.flush()
            self.links = self.links if tag not in ("p", "li", "td", "tr", "h1", "h2", "article", "section") else 0
            if self.tags[self.stack[-1]] == "p":
                self._pop(len(self.stack) - 1)
            if tag in _ENDS:
                ended, limit = _ENDS[tag]
                for i in range(len(self.stack) - 1, 0, -1):
                    if (open_ := self.tags[self.stack[i]]) in limit:
                        break
                    if open_ in ended:
                        self._pop(i)
        self.tags.append(tag)
        self.names.append("main" if block and ("role", "main") in attrs else tag)
        self.parents.append(self.stack[-1])
        self.marks.append(mark)
        self.stack.append(len(self.tags) - 1)
        self.muted += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in UNSEEN:  # a slash ends foreign elements only; text after others is inside them
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.n_tags += 1
        if tag == "a":
            self.links = 0
        if tag in BLOCKS:
            self.flush()
        elif tag == "br" and self.pieces:
            self.pieces.append(" ")
        for i in range(len(self.stack) - 1, 0, -1):
            open_ = self.tags[self.stack[i]]
            if open_ == tag:
                return self._pop(i)
            if tag not in BLOCKS and open_ in BLOCKS:
                return None  # an inline end tag ends nothing outside its block
        return None

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        node = self.stack[-1]
        if self.marks[node] and self.tags[node] not in BLOCKS:
            return  # an inline element that is away
        self.pieces.append(data)
        if self.links:
            self.linked += len(data)


def _fates(page: _Page) -> list[int]:
    """For each element whether lines in it are kept: _KEEP, _WEAK or _STRONG (away), _HEAD (headings only)."""
    count = len(page.tags)
    paragraphs, bodies = [0] * count, [False] * count
    for node, _, _, _ in page.lines:
        paragraphs[node] += page.tags[node] == "p"
    for i in range(count - 1, 0, -1):
        paragraphs[page.parents[i]] += paragraphs[i]
        bodies[page.parents[i]] |= bodies[i] or page.names[i] in ("article", "main", "h1")
    fates, inside = [_KEEP] * count, [False] * count
    for i in range(1, count):
        tag, above, mark = page.names[i], fates[page.parents[i]], page.marks[i]
        inside[i] = inside[page.parents[i]] or tag in ("article", "main")
        if page.tags[i] == "form" and mark == _KEEP and not (bodies[i] or paragraphs[i] >= 3):
            mark = _STRONG
        if mark == _HEAD and not inside[i] and tag == "header":
            mark = _WEAK
        if above == _HEAD and tag in _HEADINGS and mark == _KEEP:
            fates[i] = _KEEP
        elif above == _WEAK and tag in ("article", "main") and mark == _KEEP:
            fates[i] = _KEEP
        elif _STRONG in (above, mark):
            fates[i] = _STRONG
        elif _WEAK in (above, mark):
            fates[i] = _WEAK
        else:
            fates[i] = mark or above
    return fates


def _region(page: _Page, fates: list[int], weight: list[int]) -> tuple[int, bool]:
    """The element whose lines are the main text, and whether it is an article or main element. weight: characters of content in each element."""
    named = [i for i, tag in enumerate(page.names) if tag in ("article", "main") and fates[i] == _KEEP and weight[i]]
    if named:
        best = max(named, key=lambda i: (weight[i], -i))
        for i in named:  # parents come before children
            up = i
            while up > best:
                up = page.parents[up]
            if up == best and weight[i] >= 0.7 * weight[best]:
                best = i
        return best, True
    region, children = 0, [[] for _ in page.tags]
    for i in range(1, len(page.tags)):
        children[page.parents[i]].append(i)
    while inner := [i for i in children[region] if page.tags[i] in _CONTAINERS and weight[i] >= 0.8 * weight[0] > 0]:
        region = inner[0]
    return region, False


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    fates = _fates(page)
    kept = [fates[node] == _KEEP for node, _, _, _ in page.lines]
    ratio = np.array([(len(text) - min(linked, len(text))) / max(1, tags) if keep else 0.0 for (_, text, tags, linked), keep in zip(page.lines, kept, strict=True)])
    smooth = np.convolve(ratio, _KERNEL, mode="full")[2 : 2 + len(ratio)]
    content = (smooth >= smooth.std()) & (ratio > 0)
    if not content.any():
        content = np.array(kept)
    if not content.any():
        return ""
    weight = [0] * len(page.tags)
    for (node, text, _, _), good in zip(page.lines, content.tolist(), strict=True):
        weight[node] += len(text) * good
    for i in range(len(weight) - 1, 0, -1):
        weight[page.parents[i]] += weight[i]
    region, named = _region(page, fates, weight)
    within, box = [False] * len(page.tags), list(range(len(page.tags)))
    within[region] = True
    for i in range(1, len(page.tags)):
        within[i] = i == region or within[page.parents[i]]
        box[i] = i if page.tags[i] in _CONTAINERS else box[page.parents[i]]
    inside = [i for i, (line, keep) in enumerate(zip(page.lines, kept, strict=True)) if keep and within[line[0]]]
    if not named:
        good = {box[line[0]] for line, c in zip(page.lines, content.tolist(), strict=True) if c}
        first, last = min(i for i in inside if content[i]), max(i for i in inside if content[i])
        inside = [i for i in inside if box[page.lines[i][0]] in good or page.tags[page.lines[i][0]] in _HEADINGS and i < first or first < i < last and 2 * page.lines[i][3] < len(page.lines[i][1])]
    return "\n\n".join(page.lines[i][1] for i in inside)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            texts = [main_text(x.as_py()) for x in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return pages.select("page_id", pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(_extracted, schema)
