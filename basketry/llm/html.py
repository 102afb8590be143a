"""Main text of web pages by tag-path ratios.

A page's text falls into blocks.  Each block has a tag path, the labels
(tag, class, id) from the root to it.  Blocks of one path are of one kind, so
a path is judged as a whole:

1. per path: characters outside links, punctuation marks, and the number of
   blocks; their quotients are the path's text ratio and punctuation ratio;
2. along the page both are smoothed over the neighbouring blocks, which
   count more the more of the path they share;
3. the two are fused: each in units of its mean over the page, added, times
   the share of the characters outside links;
4. a path is content if the mean fused score of its blocks reaches the
   threshold, ``LAMBDA`` standard deviations of the page's scores.

Content paths then show the content node: from the root down, the child that
holds nearly all of their characters.  All blocks below that node are the
main text, headings and short paragraphs too, except in parts that are
marked as something else (``ASIDE_TAGS``, ``ASIDE_NAMES``); those never score.
A name or a form may also mark a wrapper of the whole page ('has-sidebar',
'no-comments', a page in one form); ``lift_wrappers`` tells these.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import quoted

# Fixed values of HTML and of the pages' authors.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
#: What an implied end never crosses.
SCOPE = set("html body article section main aside nav header footer form div table ul ol dl blockquote td th".split())
ASIDE_TAGS = set("head title nav aside footer button select textarea script style noscript template iframe object svg canvas audio video dialog menu".split())
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notification alert popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar widget footer masthead topbar toolbar pagination pager "
    "comment comments disqus replies share sharing social newsletter subscribe signup login related recommended recirculation skip".split()
)
MAIN_TAGS = {"article", "main"}
#: Asides that end, whatever is left unclosed, where the body or ``main`` begins.
OUTER_ASIDES = {"head", "header", "nav", "aside", "footer", "menu"}
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

#: Elements whose content is text, up to their end tag if there is one.
RAW_TAGS = {"title", "textarea", "iframe", "noembed", "noframes", "xmp"}
COMMENT_END = re.compile(r"--(?:!|\s*)>")

#: Standard deviations of the fused scores that make a content path.
LAMBDA = 0.5
#: Neighbours on each side that smooth a block's ratios, and their weights.
WEIGHTS = (0.6, 0.3)
#: The share of the content that a node must hold to be gone down into.
HOLDS = 0.75
#: The share of the page's text outside links above which a marked part is a
#: wrapper, if its name only mentions an aside or it holds an article, and if
#: its name begins with one.
WRAPS, WRAPS_NAMED = 0.5, 0.9
#: Characters of unmarked text in main or article that show where the content is.
PARAGRAPH = 80


class Node:
    __slots__ = ("tag", "parent", "path", "hard", "mark", "within", "lifted", "depth", "main")

    def __init__(self, tag: str, parent: Node | None, path: int, hard: str, mark: int, main: bool):
        #: hard: the tag (or 'hidden') that makes it aside, or ''; mark: as of ``_mark``;
        #: within: the nearest marked node, itself included.
        self.tag, self.parent, self.path, self.hard, self.mark, self.main = tag, parent, path, hard, mark, main
        self.within = self if mark else parent.within if parent else None
        self.lifted = False
        self.depth = parent.depth + 1 if parent else 0

    @property
    def outer(self) -> Node | None:
        """The nearest marked node above."""
        return self.parent.within if self.parent else None


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked


@lru_cache(maxsize=100_000)
def _mark(label: str) -> int:
    """2 if a class or id begins with an aside's name, 1 if one holds it further on, else 0."""
    mark = 0
    for name in label.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        if words and words[0] in ASIDE_NAMES:
            return 2
        if any(w in ASIDE_NAMES for w in words):
            mark = 1
    return mark


class Page(HTMLParser):
    """Blocks of a page, by a tree that mends what HTML lets one leave out."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        self.root = self.at = Node("", None, -1, "", 0, False)
        self.marks: list[Node] = []
        self.mains: list[Node] = []
        self.articles: list[Node] = []
        self.open: dict[str, int] = {}
        self.words: list[str] = []
        self.linked = 0
        self.endless: set[str] = set()

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            if text:
                self.blocks.append(Block(self.block_node(), text, min(self.linked, len(text))))
            self.words, self.linked = [], 0

    def block_node(self) -> Node:
        node = self.at
        while node.tag in INLINE and node.parent is not None:
            node = node.parent
        return node

    def pop(self) -> None:
        self.open[self.at.tag] -= 1
        self.at = self.at.parent or self.root

    def close(self) -> None:
        super().close()
        self.flush()

    def parse_comment(self, i: int, report: int = 1) -> int:
        """The end of the comment that begins at ``i``, which the parser asks
        for only where a comment can begin; without an end it takes the rest."""
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Outside foreign elements HTML knows no marked sections: what looks
        like one is a comment up to the next '>', or to the end."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        tag = self.at.tag
        if end > 0 and tag in RAW_TAGS and tag == self.lasttag and tag not in self.endless:
            if re.compile(rf"</\s*{tag}\s*>", re.I).search(self.rawdata, end):
                self.set_cdata_mode(tag)
            else:
                self.endless.add(tag)
        return end

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P and self.open.get("p"):
            self.close_implied({"p"})
        elif tag in SAME_CLOSES:
            self.close_implied(SAME_CLOSES[tag])
        named = dict(attrs)
        label = " ".join(filter(None, (named.get("class"), named.get("id"))))
        inside = self.at.main
        hard = self.at.hard
        if tag in ("body", "main") and hard in OUTER_ASIDES:
            hard = ""
        if not hard:
            hard = "hidden" if "hidden" in named else tag if tag in ASIDE_TAGS or (tag == "header" and not inside) else ""
        named_aside = _mark(label) if label else 0
        mark = 0 if hard or tag in ("html", "body", *MAIN_TAGS) else max(named_aside, int(tag == "form"))
        path = self.paths.setdefault((self.at.path, f"{tag} {label}"), len(self.paths))
        self.at = Node(tag, self.at, path, hard, mark, inside or tag in MAIN_TAGS)
        if mark:
            self.marks.append(self.at)
        elif tag == "main" and not hard:
            self.mains.append(self.at)
        elif tag == "article" and not hard and not named_aside:
            self.articles.append(self.at)
        self.open[tag] = self.open.get(tag, 0) + 1

    def close_implied(self, tags: set[str]) -> None:
        """End open elements of ``tags`` up to the next scope."""
        node = self.at
        last = None
        while node.parent is not None and (node.tag not in SCOPE or node.tag in tags):
            if node.tag in tags:
                last = node
            node = node.parent
        while last is not None:
            done = self.at is last
            self.pop()
            if done:
                break

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML knows no empty elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if not self.open.get(tag):
            return  # ends nothing
        if tag in INLINE:
            node = self.at
            while node.tag != tag and node.tag in INLINE:
                node = node.parent
            if node.tag != tag:
                return  # a formatting element does not end a block
        while self.at.tag != tag:
            self.pop()
        self.pop()

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())


def lift_wrappers(page: Page) -> list[Block]:
    """The blocks that are not aside.  A marked node is no aside if it holds
    ``main``.  As long as main and articles show no unmarked paragraph, nor
    is the outermost one that holds most of the page's text outside links."""
    blocks = [b for b in page.blocks if not b.node.hard]
    held = dict.fromkeys(page.marks, 0)
    shown: dict[Node | None, int] = {}
    for b in blocks:
        size, m = len(b.text) - b.linked, b.node.within
        if m is not None:
            held[m] += size
        if b.node.main and b.node.tag not in HEADINGS:
            shown[m] = shown.get(m, 0) + size
    total = sum(len(b.text) - b.linked for b in blocks)
    with_article = {a.within for a in page.articles}
    inner: dict[Node | None, list[Node]] = {}
    for m in reversed(page.marks):  # inner ones begin after outer ones
        if m.outer is not None:
            held[m.outer] += held[m]
            if m in with_article:
                with_article.add(m.outer)
        inner.setdefault(m.outer, []).append(m)
    for m in (n.within for n in page.mains):
        while m is not None and not m.lifted:
            m.lifted, m = True, m.outer
    front = [m for m in page.marks if not m.lifted and (m.outer is None or m.outer.lifted)]
    seen = sum(n for m, n in shown.items() if m is None or m.lifted)
    while front and seen < PARAGRAPH:
        m = max(front, key=lambda n: held[n])
        if held[m] <= total * (WRAPS_NAMED if m.mark == 2 and m not in with_article else WRAPS):
            break
        m.lifted = True
        seen += shown.get(m, 0)
        front = inner.get(m, [])  # no other holds so much
    # What is lifted has only lifted ones above it.
    return [b for b in blocks if b.node.within is None or b.node.within.lifted]


def punctuation(text: str) -> int:
    return sum(text.count(c) for c in ".,;:!?…，。、；：！？")


def _smoothed(blocks: list[Block], ratio: dict[int, float], shares: list[list[float]]) -> list[float]:
    out = []
    for i, b in enumerate(blocks):
        total, weight = ratio[b.node.path], 1.0
        for k, w in enumerate(shares[i]):
            step = k // 2 + 1
            j = i + step if k % 2 else i - step
            if w and 0 <= j < len(blocks):
                total, weight = total + w * ratio[blocks[j].node.path], weight + w
        out.append(total / weight)
    return out


def _alike(a: Node, b: Node) -> float:
    """How much of the path two blocks share, from their nearest nodes."""
    if a.path == b.path:
        return 1.0
    up, other = (a.parent or a), (b.parent or b)
    return 0.5 if up.path == other.path or up.path == b.path or other.path == a.path else 0.1


def content_paths(blocks: list[Block]) -> set[int]:
    """The tag paths of content, of blocks that are not marked as aside."""
    if not blocks:
        return set()
    chars: dict[int, int] = {}
    marks: dict[int, int] = {}
    count: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in blocks:
        p = b.node.path
        chars[p] = chars.get(p, 0) + len(b.text)
        marks[p] = marks.get(p, 0) + punctuation(b.text)
        count[p] = count.get(p, 0) + 1
        linked[p] = linked.get(p, 0) + b.linked
    text = {p: (chars[p] - linked[p]) / n for p, n in count.items()}
    punct = {p: marks[p] / n for p, n in count.items()}
    shares = [
        [w * _alike(b.node, blocks[j].node) if 0 <= (j := i + side * step) < len(blocks) else 0.0 for step, w in enumerate(WEIGHTS, 1) for side in (-1, 1)]
        for i, b in enumerate(blocks)
    ]
    t, p = _smoothed(blocks, text, shares), _smoothed(blocks, punct, shares)
    mean_t, mean_p = sum(t) / len(t) or 1.0, sum(p) / len(p) or 1.0
    fused = [(x / mean_t + y / mean_p) * (1 - linked[b.node.path] / chars[b.node.path]) for b, x, y in zip(blocks, t, p)]
    mean = sum(fused) / len(fused)
    least = LAMBDA * math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    by_path: dict[int, list[float]] = {}
    for b, f in zip(blocks, fused):
        by_path.setdefault(b.node.path, []).append(f)
    return {k for k, fs in by_path.items() if (m := sum(fs) / len(fs)) > 0 and m >= least}


def content_node(blocks: list[Block], paths: set[int]) -> Node | None:
    """The lowest node that holds nearly all characters of content paths."""
    held: dict[Node, int] = {}
    children: dict[Node, set[Node]] = {}
    total = 0
    per_node: dict[Node, int] = {}
    for b in blocks:
        if b.node.path in paths:
            per_node[b.node] = per_node.get(b.node, 0) + len(b.text) - b.linked
    order = sorted(per_node, key=lambda n: n.depth, reverse=True)
    # Sums go up level by level, so each node is passed once.
    levels: dict[int, dict[Node, int]] = {}
    for n in order:
        levels.setdefault(n.depth, {})[n] = per_node[n]
        total += per_node[n]
    for depth in range(max(levels, default=0), 0, -1):
        for n, size in levels.get(depth, {}).items():
            held[n] = size
            up = n.parent
            children.setdefault(up, set()).add(n)
            above = levels.setdefault(depth - 1, {})
            above[up] = above.get(up, 0) + size
    if not total:
        return None
    node = next(iter(levels[0]))
    best = node
    while kids := children.get(node):
        node = max(kids, key=lambda n: held[n])  # over three quarters: no other can be larger
        if held[node] < HOLDS * total:
            break
        if node.tag not in ("p", "li", "td", "th", "dd", "dt", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", *INLINE):
            best = node
        if node.tag == "article":
            break
    while best.parent is not None and best.main and not best.tag == "article":
        up = best.parent  # a wrapper inside the article is not the article
        if not up.main:
            break
        best = up
    return best


def main_text(html: str | None) -> str:
    """The main text of a page: blocks in page order, one space between
    words and blocks.  Empty for a null or empty page and one without content."""
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.close()
    blocks = lift_wrappers(page)
    node = content_node(blocks, content_paths(blocks))
    if node is None:
        return ""
    inside: dict[Node, bool] = {node: True}

    def below(n: Node) -> bool:
        trail = []
        while n not in inside and n.parent is not None:
            trail.append(n)
            n = n.parent
        found = inside.get(n, False)
        inside.update(dict.fromkeys(trail, found))
        return found

    return " ".join(b.text for b in blocks if below(b.node))


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).  Every page is
    read whole and alone; repeated rows give repeated results, null ids and
    urls stay null.  Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    rows = df.select(quoted(page_id).alias("page_id"), quoted(url).cast("string").alias("url"), quoted(html).cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
