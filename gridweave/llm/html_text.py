"""Main text of web pages by sum-product message passing over the DOM.

A page's block elements form a tree of binary variables, content or not. Each node has a potential from its own
features (a logistic model over tag group, kinds of class names, text and link lengths, place), each parent-child edge
one from how often labels follow each other down the tree. One upward and one downward pass give every node's exact
marginal; blocks whose node is content with a probability of 1/2 or more make up the text.

Labelled pages are a bounded sample of those that mark their article themselves: nodes in the only article or main
element are content, unless a tag for furniture (nav, aside, form and the like) encloses them there. Names take no part
in the labels; they are features, held to weak priors however well they fit the sample, since a site's names say little of
another's: text, links, tags and the mark outweigh them. Only names that none but readers' comments have are firm. A
word for furniture counts where it ends a name, or only words for parts follow (`related-posts`, not `related-work`).
Each sampled page is learnt from twice, as it is and as if it had no mark. Templates and elements that are hidden by
attribute or style are never shown and hold no text. Weights that the sample says nothing about stay at their prior.

Defined cases: bytes that aren't UTF-8 count as U+FFFD; null and empty pages have no text; text outside any element and unclosed or misnested tags are read as
browsers roughly do; a comment, tag or script that never ends reaches to the end of the page; pages of any depth and any
number of unmatched tags take time in proportion to their length; without labelled pages a fixed prior of the same form
is used; rows that repeat each get their row; columns other than page_id, url and html are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, valid_text

#: Bounds of the sample of labelled pages: pages, bytes of a page, and nodes of a page, taken at even steps.
SAMPLE, SAMPLE_BYTES, SAMPLE_NODES = 1_500, 1 << 18, 200
#: Share of the nodes that counts as seen for every pair of labels, so that no edge is certain.
UNSEEN = 0.02
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|(?:^|\s)style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Element groups of HTML.
GROUPS = {
    "article": "article main", "division": "div section center details summary", "paragraph": "p blockquote pre figure figcaption address",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol li dl dt dd", "table": "table caption thead tbody tfoot tr td th",
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside dialog", "form": "form fieldset legend label button select option textarea input",
    "page": "html head title body noscript iframe object template",
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
PLAIN = frozenset("title textarea".split())
FURNITURE = frozenset("nav menu header footer aside dialog form button select textarea noscript iframe title head".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Words in class names, ids and roles.
_WORDS = r"(?:^|[\s_-])(?:{})(?=$|[\s_-])"
_PARTS = r"bar|box|boxes|area|wrap|wrapper|container|inner|outer|block|section|panel|list|item|items|link|links|left|right|top|bottom|header|body|title|text|form|slot|unit|widget|posts?|articles?|stories|content|main|col|column|row|group|toggle|button|icon|\d+"
#: A word that names furniture counts where it ends a name or only words for parts follow it: `related-posts`, not `related-work`.
BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|side-?bar\w*|footer|masthead|top-?bar|cookies?|consent|notices?|popup|modal|related|recommend\w*"
    r"|newsletter|subscribe|comments?|commentlist|replies|respond|responses|feedback|discussion|disqus|pagination|pager|toolbar|complementary|contentinfo)"
    rf"(?:[_-]+(?:{_PARTS}))*(?=$|\s)", re.I)  # fmt: skip
#: Names that only readers' comments have.
READER_NAME = re.compile(
    r"(?:^|[\s_-])(?:comments|commentlist|replies|respond|responses|disqus|(?:users?|readers?|visitors?|customers?|guests?)[_-]+(?:feedback|discussions?|opinions?|reviews?))"
    rf"(?:[_-]+(?:{_PARTS}))*(?=$|\s)", re.I)  # fmt: skip
DOUBTFUL_NAME = re.compile(_WORDS.format(r"share|sharing|social|login|search|widget|tags|meta|byline|author|info|teaser|box|links?|list"), re.I)
HEAD_NAME = re.compile(r"(?:^|[\s_-])header(?=$|[\s_-])", re.I)
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text|prose)(?=$|[\s_-])", re.I)

_GROUP = {tag: name for name, tags in GROUPS.items() for tag in tags.split()}
_KINDS = [*GROUPS, "other"]
_WHOLE = frozenset("html body article main".split())  # names here tell of the layout, not of the element
_BLOCKS = frozenset(_GROUP)
FEATURES = [*_KINDS, "good name", "bad name", "doubtful name", "under furniture tag", "under bad name", "under reader name", "in the mark", "beside the mark", "notice", "link share", "links around", "own length", "subtree length", "sentence", "depth", "place", "one"]
#: What a name may say: weights of names are held to their prior this firmly, as a share of the nodes seen.
NAME_FEATURES, HELD = ("good name", "bad name", "doubtful name", "under bad name", "under reader name"), 0.02
LEGAL = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)


class Page:
    """Block elements in page order: tag, parent, names; and the text blocks as (node, text)."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.names = ["#page"], [-1], [""]
        self.own, self.links = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._open: list[tuple[str, int]] = [("#page", 0)]
        self._at: dict[str, list[int]] = {}  # by tag, where it stands in the stack of open elements
        self._block_at: list[int] = []  # where block elements stand
        self._text: list[str] = []
        self._in_link = 0
        self._hidden: list[int] = []  # where hidden elements stand in the stack
        self._read(html)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text.clear()
        if text:
            node = self._open[-1][1]
            self.own[node] += len(text)
            self.blocks.append((node, text))

    def _add(self, raw: str, decode: bool = True) -> None:
        if self._hidden:
            return
        text = entities.unescape(raw) if decode and "&" in raw else raw
        self._text.append(text)
        if self._in_link:
            self.links[self._open[-1][1]] += len(text.strip())

    def _close(self, at: int) -> None:
        """Close what is open from there on."""
        if any(node != self._open[at - 1][1] for _, node in self._open[at:]):
            self._flush()
        for tag, _ in reversed(self._open[at:]):
            self._in_link -= tag == "a"
            self._at[tag].pop()
            if tag in _BLOCKS:
                self._block_at.pop()
        del self._open[at:]
        while self._hidden and self._hidden[-1] >= at:
            self._hidden.pop()

    def _push(self, tag: str, node: int) -> None:
        self._at.setdefault(tag, []).append(len(self._open))
        if tag in _BLOCKS:
            self._block_at.append(len(self._open))
        self._open.append((tag, node))

    def _last(self, tag: str) -> int:
        held = self._at.get(tag)
        return held[-1] if held else 0

    def _find(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> int:
        """Place of the innermost open element of `tags`, 0 if there is none or an element of `stop` is further in."""
        found = max(map(self._last, tags))
        barrier = (self._block_at[-1] if self._block_at else 0) if stop is _BLOCKS else max(map(self._last, stop), default=0)
        return found if found >= barrier else 0

    def _start(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "hr":  # a rule parts two blocks
                self._flush()
            self._text.append(" " if tag == "br" else "")
            return
        names = " ".join(a or b or c for _, a, b, c in NAMES.findall(rest)) if "=" in rest else ""
        block = tag in _BLOCKS or bad_name(tag, names) or bool(rest and HIDDEN.search(rest))
        if block:
            if tag in _BLOCKS and (at := self._find(frozenset({"p"}), frozenset({"td", "th", "table", "button", "object"}))):
                self._close(at)
            if tag in CLOSES and (at := self._find(CLOSES[tag], frozenset({"ul", "ol", "dl", "table", "select"}))):
                self._close(at)
            self._flush()
            self.tags.append(tag)
            self.parents.append(self._open[-1][1])
            self.names.append(names)
            self.own.append(0)
            self.links.append(0)
            self._push(tag, len(self.tags) - 1)
        else:
            self._push(tag, self._open[-1][1])
        self._in_link += tag == "a"
        if tag == "template" or (rest and HIDDEN.search(rest)):
            self._hidden.append(len(self._open) - 1)

    def _read(self, html: str) -> None:
        at = 0
        while found := TOKEN.search(html, at):
            if found.start() > at:
                self._add(html[at : found.start()])
            at = found.end()
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag:
                if html.startswith("<![CDATA[", found.start()):
                    self._add(html[found.start() + 9 : at].removesuffix("]]>"), decode=False)
                continue
            if found["close"] or found["close2"]:
                stop = frozenset() if tag in _BLOCKS else _BLOCKS
                if where := self._find(frozenset({tag}), stop):
                    self._close(where)
                continue
            rest = found["rest"] or found["rest2"] or ""
            if tag in RAW or tag in PLAIN:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)|\Z", re.I).search(html, at)
                if tag in PLAIN:
                    self._start(tag, rest)
                    self._add(html[at : end.start()])
                    self._close(len(self._open) - 1)
                at = end.end()
                continue
            self._start(tag, rest)
            if rest.endswith("/") and tag not in _GROUP and self._open[-1][0] == tag:
                self._close(len(self._open) - 1)
        if at < len(html):
            self._add(html[at:])
        self._flush()


def bad_name(tag: str, names: str) -> bool:
    if not names or tag in _WHOLE:
        return False
    return bool(BAD_NAME.search(names)) or bool(HEAD_NAME.search(names) and not GOOD_NAME.search(names))


def under(page: Page) -> tuple[list[bool], list[bool], list[bool]]:
    """Nodes that are, or lie in, an element that is furniture by its tag, by its name, and readers' comments by its name.

    A header within the article is part of it, and what encloses the only article or main element, or a form that holds
    most of the page's text, is no furniture.
    """
    n = len(page.tags)
    marks = [i for i, tag in enumerate(page.tags) if tag in ("article", "main")]
    around, at = set(), marks[0] if len(marks) == 1 else -1
    while at > 0:
        at = page.parents[at]
        around.add(at)
    text = list(page.own)
    for i in range(n - 1, 0, -1):
        text[page.parents[i]] += text[i]
    by_tag, by_name, readers, within = ([False] * n for _ in range(4))
    for i in range(1, n):
        tag, p = page.tags[i], page.parents[i]
        within[i] = within[p] or tag in ("article", "main")
        whole = i in around or (tag == "form" and 2 * text[i] > text[0])
        by_tag[i] = by_tag[p] or (tag in FURNITURE and not whole and not (tag == "header" and within[i]))
        by_name[i] = by_name[p] or (not whole and bad_name(tag, page.names[i]))
        readers[i] = readers[p] or (not whole and tag not in _WHOLE and bool(page.names[i] and READER_NAME.search(page.names[i])))
    return by_tag, by_name, readers


def features(page: Page) -> np.ndarray:
    """One row of features per node."""
    n = len(page.tags)
    text, links, depth, last = list(page.own), list(page.links), [0] * n, [""] * n
    for i in range(n - 1, 0, -1):
        text[page.parents[i]] += text[i]
        links[page.parents[i]] += links[i]
    for i in range(1, n):
        depth[i] = depth[page.parents[i]] + 1
    for node, block in page.blocks:
        last[node] = block[-1]
    rows = np.zeros((n, len(FEATURES)))
    for i in range(n):
        rows[i, _KINDS.index(_GROUP.get(page.tags[i], "other"))] = 1
    base = len(_KINDS)
    rows[:, base] = [bool(x and GOOD_NAME.search(x)) for x in page.names]
    rows[:, base + 1] = [bad_name(t, x) for t, x in zip(page.tags, page.names, strict=True)]
    rows[:, base + 2] = [bool(x and t not in _WHOLE and DOUBTFUL_NAME.search(x)) for t, x in zip(page.tags, page.names, strict=True)]
    rows[:, base + 3], rows[:, base + 4], rows[:, base + 5] = under(page)
    share = np.array(links) / np.maximum(text, 1)
    rows[:, base + 6], rows[:, base + 7] = marked(page)
    rows[[node for node, block in page.blocks if LEGAL.search(block)], base + 8] = 1
    rows[:, base + 9] = share
    rows[:, base + 10] = share[[max(p, 0) for p in page.parents]] * (np.array(page.parents) > 0)
    rows[:, base + 11] = np.log1p(page.own) / 10
    rows[:, base + 12] = np.log1p(text) / 10
    rows[:, base + 13] = [x in ".!?…\"" and x != "" for x in last]
    rows[:, base + 14] = np.minimum(np.array(depth), 30) / 10
    rows[:, base + 15] = np.arange(n) / n
    rows[:, base + 16] = 1
    return rows


def marked(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in the only article or main element, and those beside it; none where a page has no such mark or several."""
    marks = [i for i, tag in enumerate(page.tags) if tag in ("article", "main")]
    inside, around = np.zeros(len(page.tags)), np.zeros(len(page.tags), bool)
    if len(marks) != 1:
        return inside, inside.copy()
    at = marks[0]
    while at >= 0:
        around[at] = True
        at = page.parents[at]
    for i in range(marks[0], len(page.tags)):
        inside[i] = i == marks[0] or inside[page.parents[i]]
    return inside, np.where(around, 0, 1 - inside)


def unmarked(x: np.ndarray) -> np.ndarray:
    """Rows of features as they would be had the page not marked its article."""
    out = x.copy()
    out[:, [FEATURES.index("in the mark"), FEATURES.index("beside the mark")]] = 0
    out[:, FEATURES.index("division")] += out[:, FEATURES.index("article")]
    out[:, FEATURES.index("article")] = 0
    return out


def marked_labels(page: Page) -> list[int] | None:
    """Labels of a page that marks its article itself, else None."""
    marks = [i for i, tag in enumerate(page.tags) if tag in ("article", "main")]
    if len(marks) != 1:
        return None
    inside, by_tag = [0] * len(page.tags), under(page)[0]
    for i in range(1, len(page.tags)):
        inside[i] = int((i == marks[0] or inside[page.parents[i]] == 1) and not by_tag[i])
    return inside


def fit(pages: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the node potential and the 2 x 2 edge potentials P(child | parent).

    At most SAMPLE_NODES nodes of `sample` pages of at most SAMPLE_BYTES bytes, least hash of the id first, are gathered:
    a bounded number of small rows.
    """
    chosen = checkpoint(pages.filter(F.lower("html").rlike("<(article|main)[\\s>]") & (F.octet_length("html") <= SAMPLE_BYTES)).select("page_id", F.xxhash64("page_id").alias("h")).orderBy("h", "page_id").limit(sample))
    picked = pages.select("page_id", valid_text("html")).join(F.broadcast(chosen.select("page_id").distinct()), "page_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for page_id, html in zip(batch["page_id"], batch["html"], strict=True):
                page = Page(html or "")
                labels = marked_labels(page)
                if labels is not None:
                    at = np.unique(np.linspace(0, len(labels) - 1, min(len(labels), SAMPLE_NODES)).astype("i8"))
                    above = [0, *(labels[p] for p in page.parents[1:])]
                    picked_bytes = [bytes(np.array(x, "u1")[at]) for x in (labels, above)]
                    yield pd.DataFrame({"page_id": [page_id], "x": [features(page)[at].tobytes()], "y": picked_bytes[:1], "above": picked_bytes[1:]})

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = sorted(picked.mapInPandas(run, f"page_id {kind}, x binary, y binary, above binary").collect(), key=lambda r: (r["page_id"], r["x"]))
    if not rows:
        return prior()
    x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, len(FEATURES)) for r in rows])
    y = np.concatenate([np.frombuffer(r["y"], "u1") for r in rows]).astype("f8")
    above = np.concatenate([np.frombuffer(r["above"], "u1") for r in rows])
    return learn(x, y, above)


def learn(x: np.ndarray, y: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model from rows of features, labels and parents' labels.

    Every page is seen twice, as it is and as if it didn't mark its article, so that text, links and tags are learnt for
    pages without a mark. Names are held to weak priors, since the sample's own names, however well they tell its
    furniture, say little of other sites'.
    """
    edges = np.array([[((above == a) & (y == b)).sum() + UNSEEN * len(y) + 1.0 for b in (0, 1)] for a in (0, 1)])
    x, y = np.concatenate([x, unmarked(x)]), np.concatenate([y, y])
    start, _ = prior()
    w = start.copy()
    firm = np.array([max(5.0, HELD * len(y)) if f in NAME_FEATURES else 5.0 for f in FEATURES])
    for _ in range(25):  # Newton steps; the prior weights hold what the sample doesn't show
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + firm * (w - start)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(firm)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, edges / edges.sum(axis=1, keepdims=True)


def prior() -> tuple[np.ndarray, np.ndarray]:
    """Weights before any page is seen."""
    known = {
        "article": 3.0, "paragraph": 2.0, "heading": 1.0, "nav": -4.0, "header": -4.0, "footer": -4.0, "aside": -4.0, "form": -4.0, "page": -2.0,
        "good name": 1.0, "bad name": -1.0, "doubtful name": -0.5, "under furniture tag": -4.0, "under bad name": -1.5, "under reader name": -9.0, "in the mark": 2.0, "beside the mark": -6.0,
        "notice": -3.0, "link share": -3.0, "links around": -2.0, "own length": 1.0, "sentence": 1.0,
    }
    return np.array([known.get(f, 0.0) for f in FEATURES]), np.array([[0.9, 0.1], [0.1, 0.9]])


def marginals(parents: list[int], odds: list[float], edges: np.ndarray) -> list[float]:
    """P(content) of each node by sum-product; parents come before their children, the root first."""
    (e00, e01), (e10, e11) = edges.tolist()
    n = len(parents)
    one = [1 / (1 + math.exp(-min(max(o, -30.0), 30.0))) for o in odds]
    up0, up1 = [1 - p for p in one], one
    to0, to1 = [1.0] * n, [1.0] * n  # messages to the parent
    for i in range(n - 1, 0, -1):
        a, b = e00 * up0[i] + e01 * up1[i], e10 * up0[i] + e11 * up1[i]
        total = a + b
        to0[i], to1[i] = a / total, b / total
        p = parents[i]
        u0, u1 = up0[p] * to0[i], up1[p] * to1[i]
        total = u0 + u1
        up0[p], up1[p] = u0 / total, u1 / total
    belief = [up1[0]] * n
    for i in range(1, n):
        p = parents[i]
        c0, c1 = (1 - belief[p]) / to0[i], belief[p] / to1[i]  # the parent without this child
        d0, d1 = c0 * e00 + c1 * e10, c0 * e01 + c1 * e11
        b0, b1 = up0[i] * d0, up1[i] * d1
        belief[i] = b1 / (b0 + b1)
    return belief


def main_text(html: str | None, weights: np.ndarray, edges: np.ndarray) -> str:
    page = Page(html or "")
    content = marginals(page.parents, (features(page) @ weights).tolist(), edges)
    return "\n".join(text for node, text in page.blocks if content[node] >= 0.5)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: page_id, url, text."""
    model = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), *model.value) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", valid_text("html")).mapInArrow(run, f"{kinds}, text string")
