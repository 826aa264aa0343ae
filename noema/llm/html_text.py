"""Main text of web pages from parser events and text-to-tag ratios (operator 9).

The standard library's streaming parser turns a page into lines: a block-level element begins a new line, inline
markup does not. Each line has its text, the number of tags met in it and the element it stands in; elements are a
table of parent links, so memory grows with the page and not with its depth. The ratio of text to tags per line,
smoothed over the neighbouring lines by a Gaussian, is high in running text and low in menus and link lists; two-means
clustering of the logarithms of the smoothed ratios sets the page's own threshold (Weninger, Hsu, Han 2010). Lines above
it are running text. They choose the regions: every article with running text; where no article has any, the main
elements with some; else the smallest element that holds four fifths of it. Inside the region running text is kept, and
with it short lines (headings, brief paragraphs, lists) whose section has some, or whose article has. A section in which
no line is running text, such as an unmarked list of links, is left out.

Lines inside navigation, footers, asides, forms, scripts, styles and elements whose class, id or role names nothing but
a notice, an advert, a sidebar, comments or the like never count; of a header only headings inside an article do.

A null, empty or textless page gives an empty text, as does a page whose lines are all boilerplate. Very long and very
deep pages are parsed in one pass in time proportional to their length. Repeated rows give repeated results; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog search fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTIONS = frozenset("html body main article section div td th center details blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = frozenset("li tr td th dd dt option".split())
ITEM_PARENTS = frozenset("ul ol menu table dl select".split())
# Words in a class, id or role that mark boilerplate, and those that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted sidebar cookie cookies consent notice notices "
    "popup modal newsletter subscribe signup comment comments discussion disqus respond replies nav navbar navigation menu breadcrumb "
    "breadcrumbs footer header masthead share sharing social related recommended widget pagination pager toolbar complementary contentinfo alert".split()
)
BESIDE = frozenset(
    "list box block area section container wrapper wrap inner outer item items posts post links articles bar row column col top bottom left right "
    "main primary secondary site page global reader readers user users google form title thread unit slot skip side link buttons".split()
)
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Settings:
    #: Standard deviation of the smoothing, in lines.
    sigma: float = 1.0
    rounds: int = 20
    #: Share of the running text that the region of a page without articles holds.
    region: float = 0.8


def marked(names: str) -> bool:
    """Whether some name consists of words that mark boilerplate and such as may stand beside them: related-posts and
    site-header do, related-work and post-header-image don't, nor does post-header, which heads an article."""
    for name in names.lower().split():
        words = _WORD.findall(name)
        found = [w for w in words if w in MARKS]
        if found and all(w in MARKS or w in BESIDE for w in words) and not ({"post", "posts"} & set(words) and found == ["header"]):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines [text parts, tags, element] and elements (name, parent, boilerplate)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.names, self.parents, self.out = [""], [0], [False]  # element 0 is the page
        self.open: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where elements of a name are in the open chain
        self.lines: list[list] = []
        self.fresh = True
        self.silent = False

    def _line(self) -> list:
        if self.fresh or not self.lines:
            self.lines.append([[], 0, self.open[-1] if self.open else 0])
            self.fresh = False
        return self.lines[-1]

    def _cut(self, at: int) -> None:
        """Close the open elements from place at on."""
        while len(self.open) > at:
            self.places[self.names[self.open.pop()]].pop()
        self.silent = bool(self.open) and self.names[self.open[-1]] in SILENT

    def _close(self, tag: str, within: frozenset) -> None:
        """Close the innermost open element of a name, unless one of within stands between."""
        places = self.places.get(tag)
        if places and all((p := self.places.get(name)) is None or not p or p[-1] <= places[-1] for name in within):
            self._cut(places[-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSED_BY_BLOCK and self.places.get("p"):
            self._close("p", CLOSED_BY_BLOCK - {"p"})
        if tag in ITEMS:
            self._close(tag, ITEM_PARENTS)
        if tag in BLOCKS:
            self.fresh = True
        if tag in VOID:
            self._line()[1] += 1
            self.fresh = self.fresh or tag in BLOCKS
            return
        above = self.open[-1] if self.open else 0
        out = self.out[above]
        if tag not in ("html", "body"):
            names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
            hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs)
            header = tag == "header" and not self.places.get("article")
            out = out or hidden or header or tag in SILENT or tag in BOILERPLATE or bool(names and marked(names))
        self.names.append(tag)
        self.parents.append(above)
        self.out.append(out)
        self.places[tag].append(len(self.open))
        self.open.append(len(self.names) - 1)
        self.silent = tag in SILENT
        self._line()[1] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if self.lines:
            self.lines[-1][1] += 1
        if tag in BLOCKS:
            self.fresh = True
        self._close(tag, frozenset() if tag in BLOCKS else CLOSED_BY_BLOCK)

    def handle_data(self, data: str) -> None:
        if not self.silent and (not data.isspace() or self.lines and not self.fresh and self.lines[-1][0]):
            self._line()[0].append(data)


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma**2))
    padded = np.pad(ratios, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray, rounds: int) -> float:
    """The border between two means of the values; below all of them if they don't differ."""
    low, high = float(values.min()), float(values.max())
    for _ in range(rounds):
        border = (low + high) / 2
        below, above = values[values < border], values[values >= border]
        if not len(below) or not len(above):
            break
        new = float(below.mean()), float(above.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high > low else low


def running_text(sizes: np.ndarray, tags: np.ndarray, settings: Settings) -> np.ndarray:
    """Which lines are running text: those of the upper cluster of smoothed text-to-tag ratios."""
    values = np.log1p(smoothed(sizes / np.maximum(tags, 1), settings.sigma))
    return values >= threshold(values, settings.rounds)


def _outermost(names: list[str], parents: list[int], wanted: str) -> list[int]:
    """For each element the outermost one of a name that it lies in or is; 0: none."""
    found = [0] * len(names)
    for e in range(1, len(names)):
        found[e] = found[parents[e]] or (e if names[e] == wanted else 0)
    return found


def main_text(html: str, settings: Settings = Settings()) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    names, parents = page.names, page.parents
    header, section = [0] * len(names), [0] * len(names)  # the nearest header, and the nearest section
    for e in range(1, len(names)):
        header[e] = e if names[e] == "header" else header[parents[e]] if names[e] not in HEADINGS else 0
        section[e] = e if names[e] in SECTIONS else section[parents[e]]
    lines = [(" ".join("".join(parts).split()), tags, e) for parts, tags, e in page.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    sizes, tags = np.array([len(x[0]) for x in lines]), np.array([x[1] for x in lines])
    at = np.array([x[2] for x in lines])
    allowed = ~np.array(page.out)[at] & (np.array(header)[at] == 0)
    if not allowed.any():
        return ""
    running = running_text(sizes, tags, settings) & allowed
    if not running.any():  # all that stands out is boilerplate: the other lines are compared among themselves
        running[allowed] = running_text(sizes[allowed], tags[allowed], settings)
    article = np.array(_outermost(names, parents, "article"))
    main = np.array(_outermost(names, parents, "main"))
    inside = np.zeros(len(names), dtype=bool)
    whole = np.zeros(len(names), dtype=bool)  # elements all of whose lines are kept
    for named, entire in ((article, True), (main, False)):
        chosen = np.unique(named[at[running]])
        chosen = chosen[chosen > 0]
        if len(chosen):
            inside = np.isin(named, chosen)
            whole = inside if entire else whole
            break
    else:
        votes = np.bincount(at[running], weights=sizes[running], minlength=len(names))
        for e in range(len(names) - 1, 0, -1):
            votes[parents[e]] += votes[e]
        region = int(np.flatnonzero(votes >= settings.region * votes[0])[-1])  # the last is the innermost
        inside[region] = True
        for e in range(region + 1, len(names)):
            inside[e] = inside[parents[e]]
        inside[0] |= region == 0
    own = np.array(section)[at]
    lively = np.isin(own, own[running & inside[at]])
    keep = allowed & inside[at] & (running | lively | whole[at])
    return " ".join(x[0] for x, kept in zip(lines, keep) if kept)


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py() or "", settings) for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
