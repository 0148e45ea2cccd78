"""op4: the main text of web pages.

The standard library's parser streams a page's events; nothing is built but a list of lines, a line being the text between two borders
of block elements, with the number of tags in it. A line's ratio of text to tags is 0 where names mark it as something else than the
article (menus, headers and footers of the page, sidebars, forms, notices, adverts, reader comments: by element or by class, id or role).
The ratios are smoothed by a Gaussian along the page, and lines with a ratio whose smoothed one is at or above one standard deviation
of the smoothed ratios cluster as content. The clusters' lines of some weight, with a quarter of the mean ratio, select the region: the
article elements that hold any of them, if half of their characters are in these, else the main elements alike, else the lowest element
that the parents of all lie in, there without the outer parts that have tags inside their lines and hold none of them. The text is the
region's lines, short ones too, but for marked ones that are no content.

A name marks if all words of one of its tokens are in MARKS or PLAIN and one is in MARKS, so that "no-comments" marks nothing. Marks
count neither for html, body, main and article nor for an element that one of them lies in; those of headers, not inside an article; and
if no paragraph or heading is left on the page, not for the marked element with most text, unless it is one of comments.

Character references are decoded, white space inside a line becomes one space and lines are joined by a line feed. Markup may be broken
or end early. A null, empty or textless page gives an empty text, an empty table no rows, and a very long page is read whole. Equal pages
each have their row. Columns other than page_id, url and html are left out, whatever their names; page_id and url may be null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stitchwork.llm import common

#: Elements without an end tag; elements that begin a new block; elements and marks of what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
    tfoot th thead title tr ul""".split())
HIDDEN = frozenset("""button canvas head iframe input noscript object script select style svg template textarea title""".split())
ASIDE = frozenset("aside dialog footer form header menu nav".split())
HEADERS = frozenset("header masthead".split())
COMMENTS = frozenset("comment comments disqus reply replies".split())
MARKS = COMMENTS | HEADERS | frozenset("""ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs consent cookie
    cookies copyright footer gdpr menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion
    recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split())
PLAIN = frozenset("""area articles bar block body bottom box btn buttons column container content form global group holder icons inner
    item items left link links list main message outer page panel post posts primary right section side site slot stories thread top
    unit wrap wrapper""".split())
CLOSED_BY = {"p": BLOCKS - {"body", "html", "head"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ROOTS = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KNOWN = MARKS | PLAIN
SIGMA, RADIUS = 1.0, 2
#: Content lines tell the region that have this share of all content lines' mean ratio at least.
CORE = 0.25
_WORDS = re.compile(r"[a-z0-9]+")


class Lines(HTMLParser):
    """found(): (text, tags, path of element numbers, marked) of each line; kinds: the name of each element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, tuple[int, ...]]], int, tuple[int, ...]]] = []
        self.kinds: list[str] = []
        self.stack: list[tuple[str, int]] = []
        self.hidden = 0  # how deep the stack was when what is never text began, plus 1
        self.marks: list[tuple[int, int]] = []  # open elements with a mark: how deep the stack was with them, their numbers
        self.within: tuple[int, ...] = ()  # these numbers
        self.cleared: set[int] = set()  # elements whose mark does not count
        self.named: set[int] = set()  # elements whose mark may count no more at the end: by class, id or role, and not of comments
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 0

    def end_line(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, tuple(n for name, n in self.stack if name in BLOCKS)))
        self.parts, self.tags = [], 0

    def found(self) -> list[tuple[str, int, tuple[int, ...], bool]]:
        """The lines, known at the end of the page. One with marked parts and others is the others."""
        self.end_line()
        lines = self._sorted()
        prose = any(not marked and path and (self.kinds[path[-1]] == "p" or self.kinds[path[-1]] in HEADINGS) for _, _, path, marked in lines)
        if not prose and (sizes := self._marked_sizes()):
            self.cleared.add(max(sizes, key=lambda n: (sizes[n], -n)))
            lines = self._sorted()
        return lines

    def _sorted(self) -> list[tuple[str, int, tuple[int, ...], bool]]:
        out = []
        for parts, tags, path in self.lines:
            clear = " ".join("".join(t for t, marks in parts if self.cleared.issuperset(marks)).split())
            text = clear or " ".join("".join(t for t, _ in parts).split())
            if text:
                out.append((text, tags, path, not clear))
        return out

    def _marked_sizes(self) -> dict[int, int]:
        """Characters in each element whose mark may be cleared, if all marks around it may be, too."""
        sizes: dict[int, int] = {}
        for parts, _, _ in self.lines:
            for text, marks in parts:
                own = [n for n in marks if n not in self.cleared]
                if own and self.named.issuperset(own):
                    sizes[own[0]] = sizes.get(own[0], 0) + len(text.strip())
        return {n: size for n, size in sizes.items() if size}

    def pop(self, depth: int) -> None:
        if any(name in BLOCKS for name, _ in self.stack[depth:]):
            self.end_line()
        del self.stack[depth:]
        if self.hidden and depth < self.hidden:
            self.hidden = 0
        while self.marks and self.marks[-1][0] > depth:
            self.marks.pop()
            self.within = self.within[:-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.stack and tag in CLOSED_BY.get(self.stack[-1][0], ()):
            self.pop(len(self.stack) - 1)
        if tag in BLOCKS:  # a block ends an open paragraph, through inline elements left open in it
            for depth in range(len(self.stack) - 1, -1, -1):
                name = self.stack[depth][0]
                if name == "p":
                    self.pop(depth)
                if name in BLOCKS:
                    break
            self.end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append((" ", ()))
            return
        number = len(self.kinds)
        self.kinds.append(tag)
        self.stack.append((tag, number))
        if self.hidden:
            return
        if tag in HIDDEN:
            self.hidden = len(self.stack)
        elif tag in ROOTS:
            self.cleared.update(self.within)
        elif tag == "h1":  # a form around the whole page
            self.cleared.update(n for n in self.within if self.kinds[n] == "form")
        if tag in ROOTS or self.hidden:
            return
        marks = {tag} & ASIDE | self.words_of(attrs)
        if any(name in ("article", "main") for name, _ in self.stack):
            marks -= HEADERS
        if marks:
            self.marks.append((len(self.stack), number))
            self.within += (number,)
            if tag not in ASIDE and marks.isdisjoint(COMMENTS):
                self.named.add(number)

    def words_of(self, attrs: list[tuple[str, str | None]]) -> set[str]:
        """The words of MARKS that an element's names mark it with."""
        out: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                for token in v.split():
                    words = set(_WORDS.findall(token.lower()))
                    if words <= KNOWN:
                        out |= words & MARKS
        return out

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] == tag:
                self.pop(depth)
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append((data, self.within))


def content(ratios: np.ndarray) -> np.ndarray:
    """Which lines cluster as content."""
    kernel = np.exp(-(np.arange(-RADIUS, RADIUS + 1) ** 2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(ratios, RADIUS, mode="edge"), kernel / kernel.sum(), mode="valid")
    return (smooth >= min(smooth.std(), smooth.max())) & (ratios > 0)


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.found()
    if not lines:
        return ""
    ratios = np.array([0 if marked else len(text) / max(1, tags) for text, tags, _, marked in lines])
    chosen = content(ratios)
    if not chosen.any():
        return ""
    # short lines beside long ones are of their cluster, but say nothing about the region
    kept = np.flatnonzero(chosen & (ratios >= CORE * ratios[chosen].mean())).tolist()
    paths = [path for _, _, path, _ in lines]
    sizes = [len(text) for text, _, _, _ in lines]
    inside = np.ones(len(lines), bool)
    for kind in ("article", "main"):
        within = {i: [e for e in paths[i] if parser.kinds[e] == kind] for i in kept}
        if 2 * sum(sizes[i] for i in kept if within[i]) >= sum(sizes[i] for i in kept):
            regions = {e for elements in within.values() for e in elements}
            inside = np.array([not regions.isdisjoint(path) for path in paths])
            break
    else:
        # a line's own block says nothing about the region: its parent does
        region = list(paths[kept[0]][:-1])
        for i in kept[1:]:
            same = next((k for k, (a, b) in enumerate(zip(region, paths[i][:-1])) if a != b), min(len(region), len(paths[i]) - 1))
            del region[max(same, 0) :]
        depth = len(region)
        # parts of the region are the elements just below it; outer ones with tags inside their lines and without content go
        parts = [path[depth] if len(path) > depth else None for path in paths]
        tagged = {part for part, (_, tags, _, _) in zip(parts, lines, strict=True) if tags > 2} - {parts[i] for i in kept} - {None}
        for i, path in enumerate(paths):
            inside[i] = list(path[:depth]) == region and (kept[0] <= i <= kept[-1] or parts[i] not in tagged)
    return "\n".join(text for (text, _, _, marked), here, yes in zip(lines, inside.tolist(), chosen.tolist(), strict=True) if here and (yes or not marked))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    named = common.renamed(pages, {"page_id": "page_id", "url": "url", "html": "html"})
    kinds = dict(named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return common.map_arrow(named, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
