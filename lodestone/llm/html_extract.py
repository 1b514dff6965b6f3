"""Main text of web pages by tree scoring.

A page becomes a flat tree.  Menus, forms, adverts and the like go by tag,
role and the words of class and id; such words do not count on what is around
the article.  Each paragraph gives points for its
length and commas to its ancestors, less with distance; a container's points
are discounted by its link density; the best one and its fitting siblings are
kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructType

from lodestone.llm._arrow import map_arrow

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

#: Elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes svg select".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
GONE = frozenset("head nav header footer aside form menu dialog button input label fieldset legend canvas audio video applet embed annotation annotation-xml".split())
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: An opening tag that ends open elements of the second set, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id that name what is not the article.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer foot gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promotion recommended related replies respond rss share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar tooltip widget widgets".split()
)
#: Words that only say what kind of box an element is: within an article a name goes that has unlikely words and such ones, no others.
BOXES = frozenset("area bar block body bottom box btn button buttons card center col column container content float form group holder icons inline inner item items large left link links list mid middle module outer panel placeholder right row section slot small space strip text title top unit wrap wrapper zone".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
KEEPS = frozenset("html body article main".split())
KEEPS_HEADER = frozenset("article main".split())
#: Elements within which an opening block does not end a paragraph outside of them.
P_STAYS = {"article", "section", "div", "td", "th", "table", "li", "body", "button", "blockquote"}
#: Elements of formulas that may be written closed in themselves.
MATHML = frozenset("mi mn mo ms mspace mtext mglyph none mprescripts".split())
#: Open elements that an end tag does not look past: of what is no block by any block, of paragraphs, items and cells by these.
WALLS, WALLED = frozenset("article body table".split()), frozenset("p li td tr".split())
#: Levels that a paragraph's points reach; the share of the best score, and the length without links, by which a sibling is kept.
LEVELS, SIBLING_SHARE, SIBLING_LENGTH = 5, 0.2, 80
#: How many times the points of the text outside an element must hold that class or id names as unlikely, to stay without an article or main in it.
UNLIKELY_WEIGHT = 4


def _unlikely(tag: str, raw: str, within: bool = False) -> tuple[bool, bool]:
    """Whether an element is hidden or has a role besides the article, and whether its class or id is unlikely.

    ``within`` an article one name must consist of unlikely words and words
    for boxes: "ad-slot" does, "share-price" and "notice-board-history" do not.
    """
    if not raw or raw.isspace():
        return False, False
    named = False
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name = name.lower()
        value = a or b or c
        if name in ("class", "id"):
            for one in value.split() if within else [value]:
                words = [w.lower() for w in _WORD.findall(one)]
                named = named or any(w in UNLIKELY for w in words) and (not within or all(w in UNLIKELY or w in BOXES for w in words))
        elif name == "role" and value.lower() in ROLES or name == "hidden" and tag not in KEEPS or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named
    return False, named


class Open:
    """The stack of open elements, with the places of each name in it, so that no look-up walks down the stack."""

    def __init__(self, page: Page):
        self.page, self.nodes = page, [0]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of block elements
        self.articles = 0

    def push(self, node: int) -> None:
        name = self.page.tag[node]
        self.places.setdefault(name, []).append(len(self.nodes))
        if name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.articles += name in KEEPS_HEADER
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Closes all from ``place`` on."""
        while len(self.nodes) > place:
            name = self.page.tag[self.nodes.pop()]
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()
            self.articles -= name in KEEPS_HEADER

    def last(self, names) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((held[-1] for n in names if (held := self.places.get(n))), default=0)

    def close(self, name: str) -> None:
        """An end tag."""
        place = self.last((name,))
        if not place or name not in BLOCK and self.blocks and self.blocks[-1] > place or name in WALLED and self.last(WALLS) > place:
            return
        self.cut(place)

    def imply(self, ends: set[str], until: set[str]) -> None:
        """An opening tag that ends open elements; a row ends with its cell."""
        while (place := self.last(ends)) and place > self.last(until - ends):
            name = self.page.tag[self.nodes[place]]
            self.cut(place)
            if name not in ("td", "th", "tr") or len(ends) == 1:
                return


class Page:
    """Nodes in page order with their parents, and text pieces with their node and block number."""

    def __init__(self, source: str):
        self.tag, self.parent, self.gone, self.named = ["html"], [-1], [False], [False]
        self.pieces: list[tuple[int, int, str]] = []
        stack, block, at, n = Open(self), 0, 0, len(source)
        low = None
        while at < n:
            lt = source.find("<", at)
            m = _TOKEN.match(source, lt) if lt >= 0 else None
            while lt >= 0 and m is None:  # a bare <
                lt = source.find("<", lt + 1)
                m = _TOKEN.match(source, lt) if lt >= 0 else None
            end = lt if lt >= 0 else n
            if end > at:
                self.pieces.append((stack.nodes[-1], block, source[at:end]))
            if m is None:
                break
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name = name.lower()
            closing, raw = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
            if closing:
                if name in BLOCK:
                    block += 1
                stack.close(name)
                continue
            if name in ("html", "body") and len(stack.nodes) == 1:
                self.tag[0] = name if name == "body" else self.tag[0]
                continue
            if name in ENDS_P:
                stack.imply({"p"}, P_STAYS - {name})
            if (rule := IMPLIED.get(name)) is not None:
                stack.imply(*rule)
            if name in BLOCK:
                block += 1
            if name == "br":
                self.pieces.append((stack.nodes[-1], block, " "))
            parent = stack.nodes[-1]
            hidden, named = _unlikely(name, raw, bool(stack.articles))
            spoken = name in ("button", "label") and stack.places.get("p")  # a word of a sentence
            gone = self.gone[parent] or name in RAW or name in GONE and not (name == "header" and stack.articles or spoken) or hidden
            self.tag.append(name)
            self.parent.append(parent)
            self.gone.append(gone)
            self.named.append(named)
            if name in RAW:
                if not raw.endswith("/"):
                    low = low if low is not None else source.lower()
                    close = low.find(f"</{name}", at)
                    at = n if close < 0 else (source.find(">", close) + 1 or n)
            elif name not in VOID and not (raw.endswith("/") and name in MATHML):
                stack.push(len(self.tag) - 1)


def _without_unlikely(page: Page, link: list[bool]) -> list[bool]:
    """Which nodes go, with those of unlikely class or id but for what holds the article."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    unlikely = [page.named[i] and tag[i] not in KEEPS for i in range(n)]
    if not any(unlikely):
        return page.gone
    near = [0] * n
    points = [0.0] * n  # of each node without the unlikely ones in it
    for i in range(1, n):
        near[i] = i if unlikely[i] else near[parent[i]]
    for node, _, raw in page.pieces:
        if not page.gone[node] and not link[node]:
            text = raw.strip()
            points[node] += len(text) / 100 + text.count(",") + text.count("，") + text.count("、")
    for i in range(n - 1, 0, -1):
        if not unlikely[i]:
            points[parent[i]] += points[i]
    has_text = [False] * n
    for node, _, raw in page.pieces:
        if not page.gone[node] and raw.strip():
            has_text[node] = True
    for i in range(n - 1, 0, -1):
        if not unlikely[i] and has_text[i]:
            has_text[parent[i]] = True
    article = max((i for i in range(1, n) if tag[i] in ("article", "main") and not page.named[i] and not page.gone[i]), key=lambda i: (points[i], has_text[i]), default=0)
    holder = 0
    if near[article] and points[article] > points[0]:
        holder = near[article]
    elif not article or near[article] or not has_text[article]:  # a marked article that says anything never gives way
        best = max((i for i in range(1, n) if unlikely[i]), key=points.__getitem__)
        holder = best if points[best] > UNLIKELY_WEIGHT * points[0] else 0
    while holder:
        unlikely[holder] = False
        holder = near[parent[holder]]
    gone = list(page.gone)
    for i in range(1, n):
        gone[i] = gone[i] or gone[parent[i]] or unlikely[i]
    return gone


def extract(source: str | None) -> str:
    """The article's blocks, joined by empty lines; empty if there are none."""
    if not source:
        return ""
    page = Page(source)
    tag, parent = page.tag, page.parent
    n = len(tag)
    owner, link = [0] * n, [False] * n
    for i in range(1, n):
        owner[i] = i if tag[i] in BLOCK else owner[parent[i]]
        link[i] = tag[i] == "a" or link[parent[i]]
    gone = _without_unlikely(page, link)
    blocks: list[list] = []  # owner, node pieces
    last = None
    for node, block, raw in page.pieces:
        if gone[node]:
            continue
        if last != (block, owner[node]):
            blocks.append([owner[node], [], 0])
            last = (block, owner[node])
        blocks[-1][1].append(html.unescape(raw) if "&" in raw else raw)
        if link[node]:
            blocks[-1][2] += len(raw.strip())
    found = [(own, " ".join("".join(parts).split()), linked) for own, parts, linked in blocks]
    found = [(own, text, linked) for own, text, linked in found if text]
    if not found:
        return ""
    length, linked_length, score = [0] * n, [0] * n, [0.0] * n
    for own, text, linked in found:
        length[own] += len(text)
        linked_length[own] += min(linked, len(text))
        if linked * 2 > len(text):
            continue
        points = 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
        at, level = own if tag[own] not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dd", "dt", "pre", "blockquote", "td") else parent[own], 1
        while at >= 0 and level <= LEVELS:
            score[at] += points / level
            at, level = parent[at], level + 1
    for i in range(n - 1, 0, -1):
        length[parent[i]] += length[i]
        linked_length[parent[i]] += linked_length[i]
    final = [s * (1 - linked_length[i] / length[i]) * (1.5 if tag[i] in ("article", "main") else 1) if s and length[i] else 0.0 for i, s in enumerate(score)]
    articles = [i for i in range(1, n) if tag[i] == "article" and not gone[i] and length[i]]
    best = max(articles or range(n), key=lambda i: (final[i], length[i] if articles else 0))
    if not final[best] and not articles:
        best = 0
    kept = {best}
    if best:
        for i in range(1, n):
            if parent[i] == parent[best] and i != best and not gone[i] and length[i]:
                density = linked_length[i] / length[i]
                if final[i] >= max(10, SIBLING_SHARE * final[best]) and (not articles or tag[i] == "article") or tag[i] == "p" and length[i] > SIBLING_LENGTH and density < 0.25 or tag[i] in ("h1", "h2") and density < 0.5:
                    kept.add(i)
    inside, dense, marked = [False] * n, [False] * n, [False] * n
    mark = "article" if any(tag[i] == "article" and length[i] for i in range(n)) else "main"
    for i in range(n):
        up = parent[i]
        inside[i] = i in kept or up >= 0 and inside[up]
        marked[i] = tag[i] == mark or up >= 0 and marked[up]  # lists of links within the article are its own
        dense[i] = up >= 0 and dense[up] or i not in kept and not marked[i] and tag[i] in ("ul", "ol", "div", "section", "table", "dl") and length[i] > 0 and linked_length[i] > 0.5 * length[i]
    shown = [inside[own] and not dense[own] for own, _, _ in found]
    if articles and (first := next((k for k, yes in enumerate(shown) if yes), 0)) and not any(yes and tag[own] == "h1" for yes, (own, _, _) in zip(shown, found, strict=True)):
        # The article's title may stand before it, in a box of its own.
        title = next((k for k in range(first - 1, -1, -1) if tag[found[k][0]] == "h1"), None)
        if title is not None and found[title][2] * 2 <= len(found[title][1]):
            shown[title] = True
    return "\n\n".join(text for yes, (_, text, _) in zip(shown, found, strict=True) if yes)


def main_text(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with ``into``: the main text of each page.

    Null, empty and textless pages give an empty text; pages are read whole,
    also broken off ones; repeated rows give equal texts; a column called
    ``into`` is replaced.
    """
    base = pages.drop(into)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                texts = [extract(x) for x in rows.column(names.index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*names, into])

    return map_arrow(base, run, StructType([*base.schema.fields]).add(into, StringType()))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars, its code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                texts = [extract(x) for x in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    base = pages.select("page_id", "url", "html")
    return map_arrow(base, run, StructType([base.schema["page_id"], base.schema["url"]]).add("text", StringType()).add("n_chars", LongType()))
