"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text at block elements.  A small linear classifier on a block's ancestors,
links and length gives what it costs to call the block content or boilerplate: the capacities of its
edges to the two terminals.  Edges between neighbouring blocks, weighted by how close they are in the
document tree, make it costly to label neighbours differently.  The minimum cut, found by maximum flow,
is the cheapest labelling; the blocks on the content side are the main text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content HTML itself reads raw: up to the end tag of the same name, or the end of the page.
RAW = frozenset("script style noscript iframe textarea title".split())
#: Parsed elements whose content is never text of the page either, if they are closed.
UNSHOWN = frozenset("template svg math object select canvas audio video".split())
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The rest of a tag up to its end.  As HTML reads it, a quote opens a value only behind ``=``; one that is
#: never closed is a character like others.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)*+>")
HIDES = re.compile(rf"<(?:{'|'.join(sorted(UNSHOWN))})(?=[\s/>])", re.I)
#: Of those, the ones with rules of their own: a tag may close itself, and a start tag of ``BREAKOUT`` ends them but inside ``POINTS``.
FOREIGN = frozenset(["svg", "math"])
POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var article aside footer header main nav section".split()
)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+)))?+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the value; any but these ends options.
OPTIONS = frozenset(["option", "optgroup"])
ENDS = {"option": {"option"}, "optgroup": {"option", "optgroup"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Evidence for boilerplate (negative) and for content (positive), by element and by words of class, id and role.
ELEMENT = {
    "nav": -6.0, "footer": -6.0, "aside": -6.0, "form": -6.0, "menu": -6.0, "button": -6.0, "dialog": -6.0, "fieldset": -4.0, "label": -2.0, "option": -6.0,
    "header": -5.0, "address": -1.0, "head": -8.0, "article": 4.0, "main": 3.0, "blockquote": 0.5, "pre": 0.5, "h1": 1.0, "p": 0.5,
}
NAMED = {
    -5.0: "ad ads adbox advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs header masthead topbar footer sidebar aside widget cookie cookies consent gdpr notice notification alert popup modal "
    "overlay comment comments commentlist discussion disqus respond reply replies share sharing social newsletter subscribe signup "
    "login search searchbox form related recommended pagination pager toolbar copyright legal disclaimer contentinfo complementary",
    2.5: "article content entry post story body main maincontent",
}
NAME_WEIGHT = {name: weight for weight, names in NAMED.items() for name in names.split()}
#: Names of boilerplate that are topics as well: inside an article they say less than the others.
TOPICS = frozenset(
    "alert consent copyright disclaimer discussion form legal notice promotion recommended related replies reply respond search share "
    "sharing social".split()
)
TOPIC, OTHER_ID, TOPIC_ID = -3.0, -4.0, -1.5
#: Share of the evidence around an element, that of an article at most, that stands against its name inside an article.
AGAINST = 0.4
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words beside which a name of boilerplate describes the layout; and elements that are never boilerplate by name.
LAYOUT = frozenset("has with no without free less off layout wrapper container page".split())
WHOLE = frozenset("html body main".split())
STRONG = -4.0


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    evidence: float
    linked: float
    heading: bool


def name_evidence(attributes: str, inside: str = "") -> tuple[float, bool]:
    """The strongest word of class, id and role, boilerplate first; and whether the element is hidden.

    ``inside`` is the element's own name if it is within an article: there a topic is weaker than other
    names, an id is weaker than a class, and neither the names of a heading nor the id of a section count.
    """
    found, hidden, gone = 0.0, False, False
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        gone = gone or name == "hidden" or (name == "style" and bool(NOT_SHOWN.search("".join(values))))
        if name in ("class", "id", "role", "itemprop"):
            if inside and (inside in HEADINGS or (inside == "section" and name == "id")):
                continue
            words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(values)).lower())
            layout = not LAYOUT.isdisjoint(words)  # says what the page has, not what the element is
            for part in words:
                weight = NAME_WEIGHT.get(part, 0.0)
                if weight < 0 and layout:
                    continue
                if weight < 0 and inside:
                    topic = part in TOPICS
                    weight = (TOPIC_ID if topic else OTHER_ID) if name == "id" else TOPIC if topic else weight
                if (weight < 0 and weight < found) or (weight > 0 and found >= 0 and weight > found):
                    found = weight
        elif name == "aria-hidden" and "".join(values).lower() == "true":
            found, hidden = min(found, -5.0), True
    return min(found, -6.0) if gone else found, hidden or gone


class Tag(NamedTuple):
    """A piece of markup: a tag, or without a name a comment or declaration.  ``raw`` elements end with their content."""

    start: int
    end: int
    name: str = ""
    closes: bool = False
    rest: str = ""
    raw: bool = False
    opened: int = 0


class Reader:
    """The page's markup from left to right, in time linear in its length.

    A ``<`` before anything but a letter, ``/``, ``!`` or ``?`` is text.  A tag whose quotes leave it without
    an end shows that quotes cannot be trusted from there on: then it, and all behind it, end at the next ``>``.
    """

    def __init__(self, page: str):
        self.page, self.loose = page, False
        self.ends: dict[str, re.Pattern] = {}

    def _until(self, mark: str, at: int) -> int:
        found = self.page.find(mark, at)
        return len(self.page) if found < 0 else found + len(mark)

    def next(self, at: int) -> Tag | None:
        page = self.page
        while (start := page.find("<", at)) >= 0:
            named = NAME.match(page, start)
            if named is None:
                if page.startswith("<!--", start):
                    # an empty comment may be written in short
                    end = start + 5 if page.startswith("<!-->", start) else start + 6 if page.startswith("<!--->", start) else self._until("-->", start + 4)
                    return Tag(start, end)
                if page[start + 1 : start + 2] in ("!", "?", "/") and start + 1 < len(page):
                    return Tag(start, self._until(">", start))
                at = start + 1
                continue
            closes, name = page[start + 1] == "/", named[1].lower()
            rest = None if self.loose else REST.match(page, named.end())
            if rest is None:
                self.loose = True
            end = self._until(">", named.end()) if rest is None else rest.end()
            text = page[named.end() : end - 1]
            if closes or name not in RAW:
                return Tag(start, end, name, closes, text)
            if name not in self.ends:
                self.ends[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
            last = self.ends[name].search(page, end)
            return Tag(start, last.end() if last else len(page), name, False, text, True, end)
        return None


def markup_of(page: str) -> Iterator[tuple[int, int, Tag | None]]:
    """(start, end, tag) of the page's markup in order; None for what is left out whole.

    A closed element of ``UNSHOWN`` is left out whole.  One without an end tag of its own, before that of
    an element around it, hides nothing: only its tag is markup.
    """
    reader, at = Reader(page), 0
    if not HIDES.search(page):
        while found := reader.next(at):
            at = found.end
            yield found.start, at, None if found.raw else found
        return
    tokens: list[tuple[int, int, Tag | None]] = []
    until: dict[int, tuple[int, int]] = {}  # by the token that opens an element left out: its end, the token behind it
    stack: list[tuple[str, int, bool]] = []  # open elements: name, token, whether the inside is foreign
    opened: Counter[str] = Counter()
    while found := reader.next(at):
        at, here, foreign = found.end, len(tokens), bool(stack) and stack[-1][2]
        if found.raw and foreign and found.rest.endswith("/"):
            at = found.opened
        tokens.append((found.start, at, None if found.raw else found))
        if found.raw or not found.name:
            continue
        name = found.name
        if found.closes:
            while opened[name]:
                own, start, _ = stack.pop()
                opened[own] -= 1
                if own == name:
                    if name in UNSHOWN:
                        until[start] = at, here + 1
                    break
                if own in FOREIGN:
                    until[start] = found.start, here
            continue
        if foreign and name in BREAKOUT:
            while stack and stack[-1][2]:
                own, start, _ = stack.pop()
                opened[own] -= 1
                until[start] = found.start, here
            foreign = False
        if (foreign or name in FOREIGN) and found.rest.endswith("/"):
            continue
        if name in UNSHOWN or (name in POINTS if foreign else name in BLOCKS and name not in VOID and name != "p"):
            stack.append((name, here, name in FOREIGN))
            opened[name] += 1
    i = 0
    while i < len(tokens):
        if i in until:
            end, behind = until[i]
            yield tokens[i][0], end, None
            i = behind
        else:
            yield tokens[i]
            i += 1


class Forms:
    """Which forms of a page hold the page rather than fields: those with an article, or with most of the paragraphs."""

    MARKS = re.compile(r"<(article|main|p|/form)(?=[\s/>])", re.I)

    def __init__(self, page: str):
        found = [(m.start(), m[1].lower()) for m in self.MARKS.finditer(page)] if "<form" in page.lower() else []
        self.whole, self.paragraphs, self.ends = (
            [at for at, name in found if name in names] for names in (("article", "main"), ("p",), ("/form",)))

    def wide(self, start: int) -> bool:
        at = bisect(self.ends, start)
        end = self.ends[at] if at < len(self.ends) else float("inf")
        inside = [bisect(places, end) - bisect(places, start) for places in (self.whole, self.paragraphs)]
        return inside[0] > 0 or (inside[1] > 2 and 2 * inside[1] > len(self.paragraphs))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order: text with references decoded and white space as one space, never empty."""
    blocks: list[Block] = []
    # open elements: name, number, evidence of the element and all around it, whether inside an article
    # (1) and there inside an element with a name of boilerplate (2)
    stack: list[tuple[str, int, float, int]] = [("", 0, 0.0, 0)]
    parts: list[str] = []
    links, link_at, number = 0, 0, 0
    inside: list[str] = []

    def flush() -> None:
        nonlocal parts, inside, link_at
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = sum(len(html.unescape(p).split()) for p in inside)
            blocks.append(Block(text, tuple(n for _, n, *_ in stack), stack[-1][2], min(1.0, words / max(1, len(text.split()))), stack[-1][0] in HEADINGS))
        parts, inside = [], []

    at, forms = 0, Forms(page)
    for start, end, found in markup_of(page):
        if start > at:
            parts.append(page[at:start])
            if links:
                inside.append(page[at:start])
        at = end
        if found is None:
            parts.append(" ")
            continue
        if not found.name:
            continue
        name = found.name
        if name == "a":
            links = 0 if found.closes else 1
        elif name in ("br", "img", "input", "wbr"):
            parts.append(" " if name != "wbr" else "")
        elif name in BLOCKS:
            flush()
            links = 0
            if found.closes:
                if any(name == n for n, *_ in stack[1:]):
                    while stack[-1][0] != name:
                        stack.pop()
                    stack.pop()
            else:
                ends = ENDS.get(name, {"p"}) | (OPTIONS if name not in OPTIONS else set())
                while stack[-1][0] in ends:
                    stack.pop()
                if name not in VOID:
                    number += 1
                    around, within = stack[-1][2:]
                    own, hidden = name_evidence(found.rest, name if within else "") if found.rest.strip() else (0.0, False)
                    own = max(own, 0.0) if name in WHOLE else own
                    kind = 0.0 if name == "form" and forms.wide(start) else ELEMENT.get(name, 0.0)
                    # a header within an article holds the article's own title
                    if name == "header" and around > 0 and not hidden:
                        own = kind = 0.0
                    named = bool(within) and own < 0 and kind > STRONG and not hidden
                    if named:
                        # weighed against the article; what is within does not outweigh it by names
                        total = min(around, own + AGAINST * min(max(around, 0.0), ELEMENT["article"]))
                    else:
                        own = min(own, kind) if min(own, kind) < 0 else own + kind
                        own = min(own, 0.5) if within == 2 else own
                        # what is boilerplate stays so inside
                        total = min(own, around) if own <= STRONG or around <= STRONG else max(-8.0, min(6.0, around + own))
                    stack.append((name, number, total, 2 if named or within == 2 else int(within or name in ARTICLE)))
    parts.append(page[at:])
    flush()
    return blocks


def costs(block: Block) -> tuple[float, float]:
    """(content, boilerplate): what it costs to leave the block's two possible labels."""
    words = len(block.text.split())
    score = block.evidence + min(1.5, words / 20) - 4.0 * block.linked
    if block.text[-1:] in ".!?;:\"'”’»)":
        score += 0.5
    if words < 4 and not block.heading:
        score -= 0.5
    return max(score, 0.0), max(-score, 0.0)


def closeness(a: Block, b: Block) -> float:
    """Weight of the edge between neighbours: up to 1 for children of one element, less the farther apart."""
    shared = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x != y:
            break
        shared += 1
    steps = len(a.path) + len(b.path) - 2 * shared
    return 1.0 / (1 + max(0, steps - 2))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of a minimum cut (Dinic's algorithm; ties go to the sink side)."""
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(u: int, v: int, forth: float, back: float) -> None:
        heads[u].append(len(to))
        to.append(v)
        room.append(forth)
        heads[v].append(len(to))
        to.append(u)
        room.append(back)

    for i in range(n):
        if source[i] > 0:
            add(s, i, source[i], 0.0)
        if sink[i] > 0:
            add(i, t, sink[i], 0.0)
    for u, v, w in edges:
        if w > 0:
            add(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in heads[u]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        pointer = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while pointer[u] < len(heads[u]):
                e = heads[u][pointer[u]]
                if room[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                pointer[u] += 1
            if pointer[u] < len(heads[u]):
                path.append(heads[u][pointer[u]])
                u = to[path[-1]]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


def main_text(page: str | None, adjacency: float = 0.6, proximity: float = 0.6) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    terminal = [costs(b) for b in blocks]
    edges = [(i, i + 1, adjacency * closeness(blocks[i], blocks[i + 1])) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):  # the block before among the children of the same element
        parent = block.path[-2] if len(block.path) > 1 else 0
        if parent in last:
            edges.append((last[parent], i, proximity))
        last[parent] = i
    content = minimum_cut([c for c, _ in terminal], [b for _, b in terminal], edges)
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Every column of ``pages`` but html, and text string, n_chars long.

    A null or empty page, and one without content, has an empty text.  Unclosed elements end where HTML
    ends them; pages of any length are read whole.  Repeated rows are kept; columns text and n_chars of
    ``pages`` are replaced; an empty table gives an empty table.
    """

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: main_text(page), na_action=None)

    rest = [f"`{c}`" for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.select(*rest, text_of(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
