"""Main text of web pages by scoring the tree.

Text blocks give points for their length and commas to their containers, half as much to each one further up. A
container's points are discounted by the share of its text that stands in links; the container with most points is
kept, with those siblings that score well themselves or hold prose. Parts that are never the article (menus, headers,
footers, sidebars, notices, adverts, forms, reader comments, code) are left out by their tag, role or name, unless they
hold what else is the page's article; a name then counts against its container.

Trees are built and scored in time that is linear in the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import small_batches

SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is never the article's: no text for readers, and controls of forms.
DROPPED_TAGS = frozenset("script style noscript template svg head title button select option textarea input iframe embed".split())
#: Elements that are left out like those with a dropped name: each may also wrap a whole page.
NAMED_TAGS = frozenset("form fieldset nav footer aside dialog menu map object applet canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Words of class and id names, between other letters, that mark such parts.
DROPPED_NAMES = re.compile(
    r"(?<![a-z])(header|topbar|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|foot|masthead|banner|ads?|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promoted|cookies?|consent|gdpr|"
    r"notice|popup|pop-up|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|recommendations|comments?|commentlist|disqus|replies|respond|pagination|pager|toolbar|widget|skip|hidden)(?![a-z])"
)
#: Words of names that say what a part lacks, or has beside it, and sections of papers: they mark nothing.
NO_NAMES = re.compile(r"(?<![a-z])(?:(?:has|no|with|without)[-_]\S*|related[-_](?:works?|research|literature|studies|methods)(?![a-z]))")
#: Dropped names that parts of an article may have too, and those of readers' comments and consent.
SOFT_NAMES = frozenset("notice recommendations share sharing social widget foot skip".split())
ASIDE_NAMES = frozenset("comment comments commentlist disqus replies respond cookie cookies consent gdpr".split())
#: A new one of these ends an open p, and a new one of those an open one of the second set, as HTML has it ...
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: ... unless one of these stands between.
P_SCOPE = ("button", "td", "th", "table", "div", "article", "section", "li", "blockquote")
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
#: Containers that usually are, or are not, an article start with these points.
FIRST_POINTS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "address": -3.0, "header": -10.0, "body": -5.0, "html": -10.0}
SPACES = re.compile(r"\s+")
COMMENT_END = re.compile("--!?>")
#: Blocks of fewer characters give no points; a p of more may stand beside the best container.
BLOCK_CHARS, PROSE_CHARS = 25, 80
#: What a container loses for a name that elsewhere would have it dropped.
NAME_POINTS = 10.0
#: Blocks and containers with a lower share of their text in links are prose.
FEW_LINKS = 0.25


class Node:
    """An element. block: it, or the nearest element around it that is no inline one."""

    __slots__ = ("tag", "parent", "block", "dropped", "by_name", "names", "children", "points", "scored", "chars", "link_chars", "article", "kept")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, names: frozenset = frozenset()):
        self.tag, self.parent, self.dropped, self.by_name, self.names = tag, parent, dropped or bool(names), bool(names), names
        self.block: Node = parent.block if parent is not None and tag in INLINE else self
        self.children: list = []  # nodes, and strings of text
        self.points, self.scored, self.chars, self.link_chars = 0.0, False, 0, 0
        self.article = self.kept = False


class TreeBuilder(HTMLParser):
    """A tree of the page; elements that are left open end where HTML ends them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.named: list[Node] = []  # in page order
        self._open: list[Node] = [self.root]
        self._places: dict[str, list[int]] = {"html": [0]}  # where open elements of each tag stand in _open
        self._blocks: list[int] = [0]  # and those that are not inline

    # Markup that is cut off at the page's end is left out, and declarations that HTML does not know are comments.

    def parse_comment(self, i: int, report: int = 1) -> int:
        found = COMMENT_END.search(self.rawdata, i + 2)
        return found.end() if found else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._or_end(self.rawdata.find(">", i) + 1 or -1)

    parse_pi = parse_html_declaration

    def parse_starttag(self, i: int) -> int:
        return self._or_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._or_end(super().parse_endtag(i))

    def _or_end(self, end: int) -> int:
        return len(self.rawdata) if end < 0 else end

    def _last(self, tags: tuple[str, ...]) -> int:
        """Where the innermost open element with one of these tags stands; -1 if there is none."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=-1)

    def _close_from(self, place: int) -> None:
        """Close the open elements from this place on."""
        while len(self._open) > place:
            node = self._open.pop()
            self._places[node.tag].pop()
            if node.tag not in INLINE:
                self._blocks.pop()
        self.at = self._open[-1]

    def _close_to(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        place = self._last(names)
        if place > max(0, self._last(scope)):
            self._close_from(place)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html" or tag == "body" and self.at.tag == "body":
            return
        if tag in CLOSES_P:
            self._close_to(("p",), P_SCOPE)
        if tag in ENDS:
            self._close_to(ENDS[tag], SCOPES[tag])
        if tag == "br" or tag == "hr":
            self.at.children.append(Node(tag, self.at))
            return
        if tag in VOID:
            return
        dropped = self._is_dropped(tag, attrs) and not (tag == "button" and self._places.get("p"))
        names = frozenset() if dropped else self._dropped_names(tag, attrs)
        node = Node(tag, self.at, dropped, names)
        if names:
            self.named.append(node)
        if tag in ("article", "main"):  # what holds the article is no side matter, whatever its name
            up: Node | None = self.at
            while up is not None and not up.article:
                up.article = True
                up.dropped &= not up.by_name
                up = up.parent
        self.at.children.append(node)
        self.at = node
        self._places.setdefault(tag, []).append(len(self._open))
        if tag not in INLINE:
            self._blocks.append(len(self._open))
        self._open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        place = self._last((tag,))
        if place > 0 and (tag not in INLINE or place > self._blocks[-1]):  # a stray end of an inline element ends no block
            self._close_from(place)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    @staticmethod
    def _is_dropped(tag: str, attrs: list) -> bool:
        if tag in DROPPED_TAGS:
            return True
        for name, value in attrs:
            value = (value or "").lower()
            if name == "role" and value in DROPPED_ROLES and not (value == "form" and tag == "form") or name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    @staticmethod
    def _dropped_names(tag: str, attrs: list) -> frozenset[str]:
        if tag in ("article", "main", "body"):
            return frozenset()
        values = (NO_NAMES.sub(" ", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()) for name, value in attrs if name in ("class", "id") and value)
        return frozenset(m[1] for value in values for m in DROPPED_NAMES.finditer(value)) | ({tag} & NAMED_TAGS)


def tree(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    named = [n for n in builder.named if n.dropped]
    if named:
        _spare(builder.root, named)
    return builder.root


class Block:
    """A text block: its element, its text with single spaces, how much of it stands in links."""

    __slots__ = ("node", "text", "links")

    def __init__(self, node: Node, text: str, links: int):
        self.node, self.text, self.links = node, text, links

    @property
    def prose(self) -> bool:
        return self.links < FEW_LINKS * len(self.text)


def _spare(root: Node, named: list[Node]) -> None:
    """Don't drop those parts for their names that hold the article, or are a passage of it.

    One holds the article if it has most of the page's prose with few links and no article or main stands elsewhere;
    comments and consent only if there is no other prose. Its name then counts against it. Softly named prose is a
    passage when it is a paragraph or stands in an article.
    """
    wanted = set(named)
    for n in named:
        n.dropped = False
    # of each named part, counted with what is in it: characters, those in links, those of prose, those of prose that is no aside
    tally: dict[Node, list[int]] = {n: [0, 0, 0, 0] for n in named}
    # what stands around a node: the nearest named part, whether an article does, whether an aside does
    around: dict[Node, tuple[Node | None, bool, bool]] = {}
    total, every, told = 0, 0, False
    for item, ends in _walk(root):
        if isinstance(item, Node) and not ends:
            near, article, aside = around[item.parent] if item.parent is not None and item.parent in around else (None, False, False)
            own = item if item in wanted else near
            around[item] = (own, article or item.tag in ("article", "main"), aside or item in wanted and bool(item.names & ASIDE_NAMES))
    for b in blocks(root):
        near, article, aside = around[b.node]
        prose = len(b.text) if len(b.text) >= BLOCK_CHARS and b.prose else 0
        if near is not None:
            tally[near] = [x + y for x, y in zip(tally[near], (len(b.text), b.links, prose, 0 if aside else prose), strict=True)]
        told |= bool(prose) and article and near is None
        total += 0 if aside else prose
        every += prose
    for n in reversed(named):  # inner parts come after outer ones in page order
        outer = around[n.parent][0] if n.parent in around else None
        if outer is not None:
            tally[outer] = [x + y for x, y in zip(tally[outer], tally[n], strict=True)]
    for n in named:
        chars, links, others, prose = tally[n]
        in_article = n in around and around[n][1]
        passage = n.names <= SOFT_NAMES and chars and links < FEW_LINKS * chars and (n.tag == "p" or others > PROSE_CHARS and in_article)
        if n.names & ASIDE_NAMES:
            holds = not total and 2 * others > every
        else:
            holds = not told and 2 * prose > total
        n.dropped = not (passage or holds)
        n.points -= NAME_POINTS * (holds and not passage)


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Nodes and strings in page order, without dropped parts; nodes come again, with True, when they end."""
    stack: list = [(root, False)]
    while stack:
        item, ends = stack.pop()
        if isinstance(item, Node) and not ends:
            if item.dropped:
                continue
            yield item, False
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children))
        else:
            yield item, ends


def blocks(root: Node) -> list[Block]:
    """The text blocks in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked, links, owner = 0, 0, root

    def end() -> None:
        nonlocal parts, linked
        text = SPACES.sub(" ", "".join(parts)).strip()
        if text:
            out.append(Block(owner, text, min(linked, len(text))))
        parts, linked = [], 0

    for item, ends in _walk(root):
        if isinstance(item, str):
            parts.append(item)
            linked += len(item.strip()) if links else 0
        elif item.tag in INLINE:
            links += (item.tag == "a") * (-1 if ends else 1)
        else:
            end()
            if item.tag not in ("br", "hr"):
                owner = item if not ends else (item.parent or root).block
    end()
    return out


def score(root: Node, found: list[Block]) -> list[Node]:
    """Sum text and points from the leaves up; gives the containers that hold blocks, in page order of their first block's end."""
    direct: dict[Node, float] = {}
    for b in found:
        b.node.chars += len(b.text)
        b.node.link_chars += b.links
        container = b.node if b.node.tag in FIRST_POINTS else b.node.parent or b.node
        container.scored = True
        if len(b.text) >= BLOCK_CHARS:
            direct[container] = direct.get(container, 0.0) + 1.0 + b.text.count(",") + b.text.count("،") + b.text.count("、") + min(len(b.text) / 100.0, 3.0)
    out = []
    for item, ends in _walk(root):
        if not isinstance(item, Node) or not ends:
            continue
        given = direct.get(item, 0.0)  # of its own blocks and, halved at each step, of those further down
        if item.scored:
            item.points += FIRST_POINTS.get(item.tag, 0.0)
        item.points += given
        up = item.parent
        if up is not None:
            up.chars += item.chars
            up.link_chars += item.link_chars
            up.scored |= item.scored
            if given:
                direct[up] = direct.get(up, 0.0) + given / 2
        if item.scored and item.chars and item.tag != "header":
            out.append(item)
    return out


def density(node: Node) -> float:
    return node.link_chars / node.chars if node.chars else 0.0


def value(node: Node) -> float:
    return node.points * (1.0 - density(node))


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by single spaces; empty if there are none."""
    root = tree(html)
    found = blocks(root)
    candidates = score(root, found)
    if not candidates:
        return ""
    best = max(candidates, key=value)
    best.kept = True
    around = best.parent
    if around is not None:
        least = 0.2 * value(best)
        beside = [s for s in around.children if isinstance(s, Node) and not s.dropped and s is not best]
        if best.tag in ("article", "main"):  # other articles beside one that says it is one
            for s in beside:
                s.kept = s.tag == best.tag and value(s) >= least
        else:
            for s in beside:
                scores = s.scored and s.tag in FIRST_POINTS and value(s) >= max(10.0, least)
                told = s.tag in ("p", "h1", "h2", "h3") and s.chars and density(s) < FEW_LINKS and (s.chars > PROSE_CHARS or s.tag != "p")
                s.kept = s.tag != "header" and bool(scores or told)
    side: dict[Node, Node | None] = {}  # the child of `around` that a node stands in
    inside: set[Node] = set()
    for item, ends in _walk(root):
        if isinstance(item, Node) and not ends:
            side[item] = item if item.parent is around else side.get(item.parent) if item.parent is not None else None
            if item.kept or item.parent in inside:
                inside.add(item)
    within = [b.node in inside for b in found]
    if True not in within:
        return ""
    first, last = within.index(True), len(within) - 1 - within[::-1].index(True)
    out = []
    for i, b in enumerate(found):
        if not within[i] and first < i < last:  # between kept parts only what has many links goes
            own = side[b.node]
            within[i] = (b.prose and b.node is around) if own is None else density(own) < FEW_LINKS and own.tag != "header"
        if within[i]:
            out.append(b.text)
    return " ".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty html, or one without an article, gives an empty text. White space inside a block becomes one
    space, blocks are joined by one space, and nothing of the article is cut. Elements that are left open are read to
    the page's end; a tag or comment that is cut off there is left out. Repeated rows give repeated rows; other
    columns are not read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
