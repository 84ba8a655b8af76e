"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold, content region."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusflow.llm.tables import annotate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CONTAINERS = frozenset("html body main article section div center table tbody td".split())
# Elements whose text is never part of the article.
SKIPPED = frozenset(
    "head title script style noscript template iframe object svg canvas audio video select option button textarea label form "
    "nav aside footer menu dialog".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words in a class or id that say what an element is; the second list tells wrappers around the article from such elements.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion promoted banner sidebar "
    "rail aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations comment comments disqus respond reply replies discussion widget widgets pagination pager skip".split()
)
WRAPPERS = frozenset("content article main post entry story page container wrapper layout body".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "caption", "tbody", "tfoot", "thead", "tr", "legend", "summary"}
HEADINGS_AND_PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
# Elements that page builders put boilerplate into; inside an article, others must be named nothing else.
PARTS = frozenset("div section ul ol table td center ins figure header details fieldset".split())
SMOOTHING = 1.0


def is_boilerplate(tag: str, attrs: dict[str, str | None], inside_article: bool) -> bool:
    if tag in SKIPPED or (tag == "header" and not inside_article):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or (attrs.get("role") or "").strip().lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or "", re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    words = {w.lower() for w in _WORDS.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
    if inside_article and tag not in PARTS:  # a paragraph about search is no search form
        return bool(words) and words <= NAMED
    if words & WRAPPERS and not words & {"comment", "comments", "related", "footer", "sidebar", "nav", "menu"}:
        return False
    return bool(words & NAMED) or ("header" in words and not inside_article)


class Lines(HTMLParser):
    """Text lines of a page, with the tags before each, the container that each stands in and whether it is boilerplate."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents, self.kinds = [-1], ["root"]  # containers
        # tag, boilerplate, container, in an article, block, in a link
        self.open: list[tuple[str, bool, int, bool, str, bool]] = [("root", False, 0, False, "root", False)]
        self.lines: list[tuple[str, int, int, bool, float, str]] = []  # text, tags, container, boilerplate, share of link text, block
        self.parts: list[str] = []
        self.tags = self.links = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, bad, container, _, block, _ = self.open[-1]
            self.lines.append((text, self.tags, container, bad, min(1.0, self.links / len(text)), block))
            self.tags = 0
        self.parts, self.links = [], 0

    def close_to(self, depth: int) -> None:
        if any(tag in BLOCKS or bad != self.open[depth - 1][1] for tag, bad, *_ in self.open[depth:]):
            self.flush()
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in ENDS_PARAGRAPH or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self.close_implied(tag)
        _, bad, container, in_article, block, in_link = self.open[-1]
        own_bad = bad or is_boilerplate(tag, dict(attrs), in_article)
        if tag in BLOCKS or own_bad != bad:
            self.flush()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in CONTAINERS:
            self.parents.append(container)
            self.kinds.append(tag)
            container = len(self.kinds) - 1
        self.open.append((tag, own_bad, container, in_article or tag in ("article", "main"), tag if tag in BLOCKS else block, in_link or tag == "a"))

    def close_implied(self, tag: str) -> None:
        """Ends that HTML leaves out: of a paragraph before a block, of an item or cell before the next."""
        ends, stops = {
            "li": (("li",), ("ul", "ol", "menu")),
            "dt": (("dt", "dd"), ("dl",)),
            "dd": (("dt", "dd"), ("dl",)),
            "tr": (("tr",), ("table",)),
            "td": (("td", "th"), ("tr", "table")),
            "th": (("td", "th"), ("tr", "table")),
            "option": (("option",), ("select",)),
        }.get(tag, (("p",), ("table", "td", "button", "object")))
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.open[depth][0]
            if name in ends or (name == "p" and tag in ENDS_PARAGRAPH):
                self.close_to(depth)
                return
            if name in stops or (name in BLOCKS and name != "p"):
                return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                self.close_to(depth)
                return
            if self.open[depth][0] in CONTAINERS and tag not in CONTAINERS and tag not in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.open[-1][5]:
            self.links += len(data.strip())


def smoothed(ratios: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def content_region(parents: list[int], kinds: list[str], mass: np.ndarray) -> tuple[int, bool]:
    """The container that holds the content, and whether by its name: an article or main with most of it, else the innermost with all."""
    total = mass.copy()
    for node in range(len(parents) - 1, 0, -1):  # children come after their parents
        total[parents[node]] += total[node]
    for kind in ("article", "main"):
        named = [n for n, k in enumerate(kinds) if k == kind and total[n] > total[0] / 2]
        if named:
            return named[0], True  # the outermost
    whole = np.flatnonzero(total == total[0])  # sums of lengths, so exact; these lie within each other
    return int(whole[-1]), False


def main_blocks(html: str) -> list[str]:
    """Blocks of the main text in page order.

    Lines are runs of text between block tags.  Their text-to-tag ratios are smoothed; lines above one standard deviation,
    by their own ratio too, are content, and the container around them all is the region; headings and paragraphs next to it in the containers around
    it belong to it.  Of the region everything is kept but boilerplate elements and, where no article
    element says what the article is, lists of links at its ends.
    """
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    good = [(text, container, links, block) for text, _, container, bad, links, block in page.lines if not bad]
    if not good:
        return []
    raw = np.array([len(text) / max(1, tags) for text, tags, *_ in page.lines], float)
    ratios = smoothed(raw)
    least = min(ratios.std(), ratios.mean())
    # smoothing takes out lines that stand alone; it must not take in the neighbours of the article
    content = ((ratios >= least) & (raw >= least))[[not bad for _, _, _, bad, *_ in page.lines]]
    mass = np.zeros(len(page.parents))
    for (text, container, links, _), counts in zip(good, content, strict=True):
        if counts and links < 0.5:
            mass[container] += len(text)
    if not mass.any():
        for text, container, *_ in good:
            mass[container] += len(text)
    region, named = content_region(page.parents, page.kinds, mass)
    inside = [False] * len(page.parents)
    for node, parent in enumerate(page.parents):
        inside[node] = node == region or (parent >= 0 and inside[parent])
    within = [inside[container] for _, container, _, _ in good]
    if not named and any(within):
        around, node = set(), page.parents[region]
        while node >= 0:
            around.add(node)
            node = page.parents[node]
        first, last = within.index(True), len(within) - 1 - within[::-1].index(True)
        for near in (range(first - 1, -1, -1), range(last + 1, len(good))):
            for i in near:
                _, container, links, block = good[i]
                if container not in around or block not in HEADINGS_AND_PARAGRAPHS or links >= 0.5:
                    break
                within[i] = True
    kept = [(text, links, counts) for (text, _, links, _), x, counts in zip(good, within, content, strict=True) if x]
    if named:
        return [text for text, *_ in kept]
    # without an article element, lists of links before and behind the content lines are menus
    link_only = [links >= 0.9 for _, links, _ in kept]
    menu = [x and ((i > 0 and link_only[i - 1]) or (i + 1 < len(kept) and link_only[i + 1])) for i, x in enumerate(link_only)]
    solid = [i for i, (_, links, counts) in enumerate(kept) if counts and links < 0.5] or [0, len(kept) - 1]
    return [text for i, ((text, *_), drop) in enumerate(zip(kept, menu, strict=True)) if not drop or solid[0] < i < solid[-1]]


def extracted(pages: DataFrame) -> DataFrame:
    """Rows of ``pages`` as :func:`annotate` gives them, with main_text: the blocks of the article joined by blank lines.

    From the whole ``html``; null and empty pages and pages without text give an empty text.  Character references are
    decoded, white space inside a block becomes one space.  Broken markup is read as far as it can be.
    """

    def extract(column: pa.Array) -> list[pa.Array]:
        return [pa.array(["\n\n".join(main_blocks(html or "")) for html in column.to_pylist()], pa.string())]

    return annotate(pages, "html", extract, {"main_text": T.StringType()})
