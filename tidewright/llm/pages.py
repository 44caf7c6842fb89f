"""Main text of web pages: flat text blocks, classified by a decision tree over each block and its neighbours."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import with_columns

#: elements that begin and end a block of text
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text is never shown as part of an article
_SILENT = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video select option datalist "
    "button textarea label".split()
)
_BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: words in an element's class, id or role that mark what is not part of an article
_HINTS = frozenset(
    "ad ads advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar sidenav complementary footer contentinfo copyright legal cookie cookies "
    "consent gdpr notice notification alert alertdialog popup modal overlay newsletter subscribe subscription signup "
    "login search comment comments commentlist respond reply replies disqus related recommended share sharing social "
    "widget toolbar pagination pager skip".split()
)
_OUTSIDE_HINTS = frozenset(("header", "masthead", "topbar", "banner"))
_WORDS = re.compile(r"[a-z]+")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "hinted", "place", "heading",
)

#: The labelled table the tree is trained on: FEATURES of a block, and 1 where it is part of the main text. ``place``
#: is 1 inside an article or main element, -1 outside one on a page that has one, 0 on a page without.
LABELLED: tuple[tuple[float, ...], ...] = (
    # inside an article: text of any length
    (220, 0.00, 40, 0.00, 35, 0.00, 0, 1, 0, 1),
    (80, 0.05, 1, 0.00, 150, 0.00, 0, 1, 0, 1),
    (35, 0.10, 9, 0.00, 60, 0.02, 0, 1, 0, 1),
    (12, 0.00, 0, 0.00, 90, 0.00, 0, 1, 1, 1),
    (6, 0.00, 5, 1.00, 110, 0.00, 0, 1, 1, 1),
    (3, 0.00, 70, 0.00, 2, 0.00, 0, 1, 0, 1),
    (1, 0.00, 2, 0.00, 1, 0.00, 0, 1, 0, 1),
    (1, 0.00, 80, 0.00, 7, 0.00, 0, 1, 0, 1),
    (5, 0.40, 60, 0.05, 45, 0.00, 0, 1, 0, 1),
    (9, 0.00, 3, 0.00, 8, 0.20, 0, 1, 0, 1),
    (25, 0.50, 30, 0.00, 20, 0.00, 0, 1, 0, 1),
    (4, 1.00, 50, 0.00, 60, 0.00, 0, 1, 0, 1),
    (2, 0.00, 40, 0.00, 0, 0.00, 0, 1, 0, 1),
    (2, 0.00, 12, 0.00, 5, 0.00, 0, 1, 0, 1),
    (4, 0.00, 1, 0.00, 9, 0.00, 0, 1, 0, 1),
    (8, 0.00, 0, 0.00, 3, 0.00, 0, 1, 1, 1),
    (7, 0.00, 25, 0.00, 1, 0.00, 0, 1, 0, 1),
    (15, 0.00, 6, 0.00, 2, 0.00, 0, 1, 0, 1),
    (33, 0.00, 90, 0.00, 9, 0.30, 0, 1, 0, 1),
    (19, 0.10, 2, 1.00, 14, 0.00, 0, 1, 0, 1),
    (64, 0.00, 4, 1.00, 3, 1.00, 0, 1, 0, 1),
    (6, 0.30, 8, 0.00, 11, 0.50, 0, 1, 0, 1),
    (140, 0.02, 10, 0.00, 6, 0.00, 0, 1, 0, 1),
    (3, 0.00, 5, 1.00, 4, 0.00, 0, 1, 1, 1),
    (11, 0.00, 17, 0.00, 18, 0.00, 0, 1, 0, 1),
    (1, 0.00, 1, 0.00, 0, 0.00, 0, 1, 0, 1),
    # inside an article, but a list of links or marked as something else
    (3, 1.00, 4, 1.00, 3, 1.00, 0, 1, 0, 0),
    (6, 1.00, 5, 1.00, 7, 1.00, 0, 1, 0, 0),
    (2, 1.00, 90, 0.00, 3, 1.00, 0, 1, 0, 0),
    (5, 1.00, 3, 1.00, 9, 0.00, 0, 1, 0, 0),
    (40, 0.00, 60, 0.00, 30, 0.00, 1, 1, 0, 0),
    (90, 0.00, 5, 0.00, 70, 0.00, 1, 1, 0, 0),
    (7, 0.00, 80, 0.00, 40, 0.00, 1, 1, 0, 0),
    (2, 0.00, 35, 0.00, 60, 0.00, 1, 1, 1, 0),
    (30, 0.00, 5, 0.00, 3, 0.00, 1, 1, 0, 0),
    (4, 0.00, 3, 0.00, 0, 0.00, 1, 1, 0, 0),
    (14, 0.10, 40, 0.00, 6, 0.00, 1, 1, 0, 0),
    (2, 0.00, 2, 0.00, 1, 0.00, 1, 1, 0, 0),
    (60, 0.00, 110, 0.00, 12, 0.00, 1, 1, 0, 0),
    (18, 0.00, 9, 0.00, 200, 0.00, 1, 1, 0, 0),
    # outside the article of a page that has one
    (1, 1.00, 1, 1.00, 1, 1.00, 1, -1, 0, 0),
    (8, 0.00, 1, 1.00, 10, 0.00, 1, -1, 0, 0),
    (12, 0.00, 60, 0.00, 0, 0.00, 1, -1, 0, 0),
    (9, 0.00, 50, 0.00, 0, 0.00, 0, -1, 0, 0),
    (30, 0.00, 4, 1.00, 12, 0.00, 0, -1, 0, 0),
    (60, 0.10, 70, 0.00, 9, 0.50, 0, -1, 0, 0),
    (4, 0.00, 2, 1.00, 90, 0.00, 0, -1, 1, 0),
    (150, 0.00, 20, 0.00, 5, 1.00, 0, -1, 0, 0),
    (70, 0.00, 90, 0.00, 4, 0.00, 0, -1, 0, 0),
    (20, 0.00, 35, 0.00, 15, 0.00, 0, -1, 0, 0),
    (3, 0.00, 60, 0.00, 80, 0.00, 0, -1, 0, 0),
    (11, 0.00, 4, 0.00, 5, 0.00, 0, -1, 1, 0),
    (2, 0.00, 28, 0.00, 0, 0.00, 1, -1, 0, 0),
    (40, 0.00, 2, 0.00, 50, 0.00, 1, -1, 0, 0),
    (1, 0.00, 3, 0.00, 2, 0.00, 0, -1, 0, 0),
    (6, 0.30, 2, 1.00, 1, 1.00, 0, -1, 0, 0),
    (16, 0.00, 12, 0.00, 30, 0.00, 0, -1, 0, 0),
    (33, 0.00, 18, 0.00, 22, 0.00, 0, -1, 0, 0),
    # pages without an article element
    (180, 0.00, 60, 0.00, 90, 0.00, 0, 0, 0, 1),
    (45, 0.05, 3, 1.00, 80, 0.00, 0, 0, 0, 1),
    (30, 0.00, 55, 0.00, 4, 0.00, 0, 0, 0, 1),
    (20, 0.20, 25, 0.00, 40, 0.10, 0, 0, 0, 1),
    (17, 0.00, 2, 0.00, 30, 0.00, 0, 0, 0, 1),
    (4, 0.00, 70, 0.00, 60, 0.00, 0, 0, 0, 1),
    (2, 0.00, 30, 0.00, 25, 0.00, 0, 0, 0, 1),
    (7, 0.00, 5, 1.00, 65, 0.00, 0, 0, 1, 1),
    (9, 0.00, 1, 0.00, 40, 0.00, 0, 0, 1, 1),
    (3, 0.00, 80, 0.00, 35, 0.00, 0, 0, 1, 1),
    (8, 0.00, 45, 0.00, 22, 0.00, 0, 0, 0, 1),
    (5, 0.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0),
    (2, 1.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0),
    (1, 1.00, 1, 1.00, 60, 0.00, 0, 0, 0, 0),
    (6, 0.80, 70, 0.00, 5, 0.90, 0, 0, 0, 0),
    (25, 0.90, 30, 0.80, 28, 0.90, 0, 0, 0, 0),
    (10, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0, 0),
    (7, 0.30, 9, 0.50, 0, 0.00, 0, 0, 0, 0),
    (5, 0.00, 4, 0.00, 6, 0.00, 0, 0, 0, 0),
    (3, 0.00, 3, 1.00, 2, 0.00, 0, 0, 1, 0),
    (9, 0.00, 3, 1.00, 7, 0.00, 0, 0, 0, 0),
    (50, 0.00, 4, 1.00, 60, 0.00, 1, 0, 0, 0),
    (120, 0.00, 80, 0.00, 40, 0.00, 1, 0, 0, 0),
    (8, 0.00, 60, 0.00, 70, 0.00, 1, 0, 0, 0),
    (30, 0.00, 50, 0.00, 6, 0.00, 1, 0, 0, 0),
    (22, 0.00, 3, 0.00, 4, 0.00, 1, 0, 0, 0),
    (6, 0.00, 30, 0.00, 0, 0.00, 1, 0, 0, 0),
    (90, 0.00, 40, 0.00, 10, 0.00, 1, 0, 0, 0),
    (55, 0.00, 70, 0.00, 12, 0.50, 0, 0, 0, 1),
    (130, 0.00, 4, 0.00, 3, 0.00, 0, 0, 0, 1),
)


def train_tree(labelled: Sequence[Sequence[float]], max_depth: int = 8) -> tuple | int:
    """A decision tree by Gini impurity: nested ``(feature, threshold, at most, above)``, leaves 0 or 1.

    Ties take the first feature and the lowest threshold; a leaf with as many of both labels is 0.
    """

    def grow(rows: np.ndarray, depth: int) -> tuple | int:
        labels = rows[:, -1]
        majority = int(labels.mean() > 0.5)
        if depth == 0 or labels.min() == labels.max():
            return majority
        best = None
        for feature in range(rows.shape[1] - 1):
            values = np.unique(rows[:, feature])
            for threshold in (values[1:] + values[:-1]) / 2:
                low = rows[:, feature] <= threshold
                impurity = sum(s.sum() * labels[s].mean() * (1 - labels[s].mean()) for s in (low, ~low))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, feature, float(threshold), low)
        if best is None:
            return majority
        _, feature, threshold, low = best
        return (feature, threshold, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))

    return grow(np.asarray(labelled, float), max_depth)


def classify(tree: tuple | int, features: Sequence[float]) -> int:
    while not isinstance(tree, int):
        feature, threshold, low, high = tree
        tree = low if features[feature] <= threshold else high
    return tree


class _Blocks(HTMLParser):
    """Collects ``[text, words, linked words, hinted, in an article, heading]`` of each block, in page order.

    Elements left open end with what holds them. An article inside unclosed boilerplate starts afresh, so one
    missing end tag does not cost the text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, bool, bool, bool]] = []
        self._open: list[tuple[str, bool, bool, bool, bool, bool]] = []  # tag and the state outside it
        self._open_tags: Counter[str] = Counter()
        self._hinted = self._article = self._silent = self._link = self._heading = False
        self._parts: list[str] = []
        self._linked: list[str] = []

    def flush(self) -> None:
        words = "".join(self._parts).split()
        if words:
            linked = len("".join(self._linked).split())
            self.blocks.append((" ".join(words), len(words), linked, self._hinted, self._article, self._heading))
        self._parts, self._linked = [], []

    def _state(self) -> tuple[bool, bool, bool, bool, bool]:
        return self._hinted, self._article, self._silent, self._link, self._heading

    def _close(self, depth: int) -> None:
        _, self._hinted, self._article, self._silent, self._link, self._heading = self._open[depth]
        for tag, *_ in self._open[depth:]:
            self._open_tags[tag] -= 1
        del self._open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.flush()
            if self._open and self._open[-1][0] == "p":  # a block ends an open paragraph
                self._close(len(self._open) - 1)
        elif tag == "br":
            self._parts.append(" ")
            self._linked.append(" ")
        if tag in _VOID:
            return
        self._open.append((tag, *self._state()))
        self._open_tags[tag] += 1
        marks: set[str] = set()
        hidden = False
        for name, value in attrs:
            if name in ("class", "id", "role", "itemprop"):
                marks.update(_WORDS.findall((value or "").lower()))
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                hidden = True
        hinted = tag in _BOILERPLATE or bool(marks & _HINTS)
        if tag in ("article", "main") or "main" in marks and tag in ("div", "section"):
            if hinted and tag != "main":
                self._hinted = True
            elif not self._article:
                self._article, self._hinted, self._silent, self._link = True, False, False, False
        elif tag not in ("html", "body"):
            if not self._article:
                hinted = hinted or tag == "header" or bool(marks & _OUTSIDE_HINTS)
            self._hinted = self._hinted or hinted
        self._silent = self._silent or hidden or tag in _SILENT
        self._link = self._link or tag == "a"
        self._heading = self._heading or tag in _HEADINGS

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # outside SVG and MathML a slash does not end an element; those are silent anyway
        if tag not in _VOID and tag not in _BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.flush()
        if not self._open_tags[tag]:  # without a search: a broken page may have many of these below many open ones
            return
        for depth in range(len(self._open) - 1, -1, -1):
            if self._open[depth][0] == tag:
                self._close(depth)
                return

    def handle_data(self, data: str) -> None:
        if not self._silent:
            self._parts.append(data)
            if self._link:
                self._linked.append(data)
            else:
                self._linked.append(" ")


def main_text(html: str, tree: tuple | int) -> str:
    """The text of the blocks the tree takes for main text, joined by line ends."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    page_has = any(b[4] for b in blocks)
    sizes = [(0, 0.0), *((b[1], b[2] / b[1]) for b in blocks), (0, 0.0)]
    kept = []
    for k, (text, _, _, hinted, inside, heading) in enumerate(blocks):
        place = 1 if inside else -1 if page_has else 0
        if classify(tree, (*sizes[k + 1], *sizes[k], *sizes[k + 2], hinted, place, heading)):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, *, html_col: str = "html", labelled: Sequence[Sequence[float]] = LABELLED) -> DataFrame:
    """Every row of ``pages`` without ``html_col``, with its main ``text`` and ``n_chars`` (code points of it).

    A page is cut into flat blocks of text at block-level elements; scripts, styles, forms' controls and hidden
    elements have none. Each block is described by its word count and link density, those of the blocks before and
    after it, whether element names or class, id and role words mark it as boilerplate, where it stands and whether
    it is a heading; the tree fitted to ``labelled`` (rows of FEATURES and the label) decides. References are
    decoded, white space inside a block becomes one space, and blocks keep page order.

    Pages are independent: one pass in the scan's tasks and no shuffle. NULL or empty html gives an empty text; broken html
    gives the blocks that are there. A column named ``text`` or ``n_chars`` is replaced.
    """
    tree = train_tree(labelled)

    @F.pandas_udf("string")
    def text_of(html):  # noqa: ANN001, ANN202
        return html.map(lambda h: main_text(h or "", tree))

    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html_col]).alias("row"),
        text_of(F.col(f"`{html_col}`")).alias("text"),
    )
    return with_columns("row", rows, text=F.col("text"), n_chars=F.length("text").cast("bigint"))
