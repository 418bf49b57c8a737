"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into text blocks: maximal runs of text that no block-level tag interrupts, with
the place of each in the element tree. A classifier gives each block two costs, of dropping it and
of keeping it, from the elements around it (:class:`Region`), its words, its links and its
punctuation. They become the capacities to the two terminals. Smoothness edges join each block to
its neighbour (weaker the farther apart they are in the tree) and to the previous blocks of the
same parent and of the same section. The minimum cut (:func:`aerocal.llm.mincut.keep_side`)
separates content from boilerplate; of equally good cuts the one that keeps most is taken.

Element handling follows browsers as far as text needs it: tags that close others, void
elements, raw text of scripts and styles, unclosed tags and quotes, comments. Pages are read whole and
each on its own, in one pass that is linear in the page's length, so nothing is shuffled.

Defined cases: null html is empty; a page without content has the empty text. Null, repeated
page_ids and repeated rows each give their row. White space is what ``str.split`` takes for it, no-break
spaces included. Only the three named columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from aerocal.llm.common import named, strings
from aerocal.llm.mincut import keep_side

VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Their content is raw text up to their own end tag.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements without running text.
MUTE = frozenset("button canvas datalist map noscript object optgroup option select svg template audio video".split())
CLOSE_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul".split()
)
BLOCK = CLOSE_P | frozenset("body caption head html label legend tbody td tfoot th thead tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tag: the open elements it ends, looked for up to the named barriers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: An end tag does not reach through these.
BARRIERS = frozenset("html table td th caption template object".split())

BOILER_TAGS = frozenset("nav aside footer dialog menu search".split())
BOILER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split()
)
#: Words of class names and ids that mark boilerplate.
BOILER_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert aside banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies copyright dialog disqus footer gdpr login masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination popup promo promotion promotions recommendations "
    "recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toc toolbar topbar widget widgets".split()
)
#: A class name with one of these words states a layout, not what an element is.
LAYOUT_WORDS = frozenset("closed disabled enabled has layout no open with without".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Short blocks with one of these are rarely content.
STOCK = re.compile(
    r"©|\(c\) \d{4}|all rights reserved|cookies?\b|newsletter|privacy policy|terms of (?:use|service)|sign up|log ?in\b",
    re.IGNORECASE,
)
SENTENCE_ENDS = tuple(".!?…。！？。:;\"”»)")
#: Costs, all in the same units. ``edge`` is divided by one more than the steps between two blocks in the tree.
COST = {
    "keep": 12, "beside_article": 30, "boiler": 90, "form": 40, "links": 30, "stock": 20,
    "article": 50, "content": 25, "word": 1, "most_words": 40, "sentence": 8, "h1": 30, "heading": 6,
    "edge": 36, "same_parent": 6, "same_section": 3, "across": 3,
}

_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_COMMENT_END = re.compile(r"--!?>")
_UNQUOTED = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass(frozen=True)
class Region:
    """What the elements around a block say: none, content, article, form, boiler or mute."""

    kind: str
    section: int


@dataclass
class Block:
    """A run of text: its words, share of linked characters, element, and steps from the block before."""

    text: str
    linked: float
    tag: str
    region: Region
    parent: int
    steps: int


class _Reader:
    """One pass over a page: a stack of open elements and the text since the last block border."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.blocks: list[Block] = []
        self.has_article = False
        #: name, number, region, whether a link is open
        self.stack: list[tuple[str, int, Region, bool]] = [("html", 0, Region("none", 0), False)]
        self.made = 1
        self.open: dict[str, int] = {"html": 1}
        self.pieces: list[str] = []
        self.linked: list[str] = []
        self.low = 1
        self.last_depth = 1
        #: quotes that do not occur any more
        self.gone: set[str] = set()

    def read(self) -> _Reader:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            left = html.find("<", at)
            if left < 0:
                left = n
            if left > at:
                self.text(html[at:left])
            if left == n:
                break
            simple = _SIMPLE.match(html, left)
            if simple:
                at = simple.end()
                name = simple[2].lower()
                if simple[1]:
                    self.end(name)
                else:
                    at = self.start(name, {}, at)
                continue
            after = html[left + 1 : left + 2]
            if html.startswith("<!--", left):
                if html.startswith((">", "->"), left + 4):
                    at = html.index(">", left) + 1
                    continue
                stop = _COMMENT_END.search(html, left + 4)
                at = stop.end() if stop else n
            elif after in ("!", "?"):
                stop = html.find(">", left)
                at = n if stop < 0 else stop + 1
            elif after == "/":
                name = _NAME.match(html, left + 2)
                stop = html.find(">", left)
                if name and stop >= 0:
                    self.end(name[0].lower())
                at = n if stop < 0 else stop + 1
            elif name := _NAME.match(html, left + 1):
                given, at = self.attributes(name.end())
                at = self.start(name[0].lower(), given, at)
            else:
                self.text("<")
                at = left + 1
        self.flush()
        return self

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        html, found = self.html, {}
        while True:
            pair = _ATTRIBUTE.match(html, at)
            if not pair:
                stop = html.find(">", at)
                return found, len(html) if stop < 0 else stop + 1
            at, value = pair.end(), ""
            if pair[2]:
                quote = html[at : at + 1]
                stop = -1
                if quote in ('"', "'") and quote not in self.gone:
                    stop = html.find(quote, at + 1)
                    if stop < 0:
                        self.gone.add(quote)
                if stop >= 0:
                    value, at = html[at + 1 : stop], stop + 1
                else:
                    value = _UNQUOTED.match(html, at)[0]
                    at += len(value)
            found.setdefault(pair[1].lower(), value)

    def text(self, raw: str) -> None:
        _, _, region, link = self.stack[-1]
        if region.kind == "mute":
            return
        if "&" in raw:
            raw = unescape(raw)
        self.pieces.append(raw)
        if link:
            self.linked.append(raw)

    def flush(self) -> None:
        """End the block at hand."""
        if self.pieces and self.stack[-1][2].kind != "mute":
            words = "".join(self.pieces).split()
            if words:
                text = " ".join(words)
                linked = len(" ".join("".join(self.linked).split())) / len(text) if self.linked else 0.0
                depth = len(self.stack)
                region = self.stack[-1][2]
                while self.stack[depth - 1][0] not in BLOCK:
                    depth -= 1
                name = self.stack[depth - 1][0]
                parent = self.stack[max(0, depth - 2)][1]
                low = min(self.low, depth)
                self.blocks.append(Block(text, linked, name, region, parent, depth + self.last_depth - 2 * low))
                self.low = self.last_depth = depth
            self.pieces, self.linked = [], []

    def pop_to(self, size: int) -> None:
        while len(self.stack) > size:
            self.open[self.stack.pop()[0]] -= 1
        self.low = min(self.low, size)

    def close(self, names: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> bool:
        """Pop the innermost open element of ``names`` that no barrier hides."""
        if not any(self.open.get(x) for x in names):
            return False
        for size in range(len(self.stack) - 1, 0, -1):
            name = self.stack[size][0]
            if name in names:
                self.flush()
                self.pop_to(size)
                return True
            if name in barriers:
                return False
        return False

    def start(self, name: str, given: dict[str, str], at: int) -> int:
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(self.html, at)
            if not end:
                return len(self.html)
            stop = self.html.find(">", end.end())
            return len(self.html) if stop < 0 else stop + 1
        if name in BLOCK:
            self.flush()
        if name == "br":
            self.text(" ")
        if name in CLOSE_P:
            self.close({"p"}, BARRIERS | {"button"})
        if name in HEADINGS and self.stack[-1][0] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if name in ENDS:
            self.close(*ENDS[name])
        if name in VOID or name in ("html", "body", "head"):
            return at
        if name == "a" and self.open.get("a"):
            self.inline_end("a")
        _, _, around, link = self.stack[-1]
        region = self.region(name, given, around)
        if region.kind not in (around.kind, "mute"):
            self.flush()
        self.stack.append((name, self.made, region, link or name == "a"))
        self.open[name] = self.open.get(name, 0) + 1
        self.made += 1
        return at

    def end(self, name: str) -> None:
        if name == "br":
            self.text(" ")
        if name in VOID or name in ("html", "body", "head"):
            return
        if name in BLOCK:
            self.flush()
            self.close(HEADINGS if name in HEADINGS else {name}, BARRIERS if name not in BARRIERS else {"table", "template"})
        elif self.open.get(name):
            self.inline_end(name)

    def inline_end(self, name: str) -> None:
        """An inline end tag reaches no further than the block it stands in, and breaks no text."""
        for size in range(len(self.stack) - 1, 0, -1):
            found = self.stack[size][0]
            if found == name:
                if self.stack[-1][2].kind != self.stack[size - 1][2].kind:
                    self.flush()
                self.pop_to(size)
                return
            if found in BLOCK:
                return

    def region(self, name: str, given: dict[str, str], around: Region) -> Region:
        """The region inside an element, from the region outside and the element's own marks."""
        kind = around.kind
        if kind == "mute":
            return around
        if (
            name in MUTE or "hidden" in given or given.get("aria-hidden") == "true"
            or ("style" in given and _HIDDEN.search(given["style"].lower()))
        ):
            return Region("mute", self.made)
        role = given.get("role", "").lower()
        if name == "main" or role == "main":
            self.has_article = True
            return Region("article", self.made)
        if kind == "boiler":
            return around
        says = marks(given) if given else None
        if name in BOILER_TAGS or role in BOILER_ROLES or says == "boiler":
            return Region("boiler", self.made)
        if name == "article" or role == "article":
            self.has_article = True
            return Region("article", self.made)
        if kind != "article" and (name == "header" or says == "header"):
            return Region("none" if kind == "content" else "boiler", self.made)
        if name == "form":
            return Region("form", self.made)
        if says == "content" and kind == "none":
            return Region("content", self.made)
        return Region(kind, self.made) if name == "section" else around


def marks(given: dict[str, str]) -> str | None:
    """What class names and id say: boiler, header, content or nothing."""
    found = None
    for part in (given.get("class", "") + " " + given.get("id", "")).split():
        words = set(_WORD.findall(_CAMEL.sub("-", part).lower()))
        if words & LAYOUT_WORDS:
            continue
        if words & BOILER_WORDS:
            return "boiler"
        if "header" in words:
            found = "header"
        elif words & CONTENT_WORDS:
            found = found or "content"
    return found


def costs(block: Block, has_article: bool) -> tuple[int, int]:
    """(cost of dropping, cost of keeping) a block."""
    c, kind = COST, block.region.kind
    n = block.text.count(" ") + 1
    drop = min(c["most_words"], c["word"] * n) * (1 - block.linked)
    if block.text.endswith(SENTENCE_ENDS):
        drop += c["sentence"] * (1 - block.linked)
    if block.tag in HEADINGS:
        drop += c["h1" if block.tag == "h1" else "heading"]
    keep = c["keep"] + c["links"] * block.linked
    if n < 30 and STOCK.search(block.text):
        keep += c["stock"]
    if kind == "boiler":
        return round(drop / 2), round(keep) + c["boiler"]
    if kind == "article":
        return round(drop) + c["article"], round(keep)
    if kind == "content":
        drop += c["content"]
    if kind == "form":
        keep += c["form"]
    if has_article:
        keep += c["beside_article"]
    return round(drop), round(keep)


def smoothness(blocks: list[Block]) -> Iterator[tuple[int, int, int]]:
    """Edges (i, j, weight) between neighbours, and to the last block of the same parent and section."""
    last_parent: dict[int, int] = {}
    last_section: dict[int, int] = {}
    for i, block in enumerate(blocks):
        near = {
            last_section.get(block.region.section, -1): COST["same_section"],
            last_parent.get(block.parent, -1): COST["same_parent"],
            i - 1: COST["edge"] // (1 + block.steps),
        }
        for j, weight in near.items():
            if j >= 0:
                if blocks[j].region.kind != block.region.kind:
                    weight //= COST["across"]
                if weight:
                    yield j, i, weight
        last_parent[block.parent] = last_section[block.region.section] = i


def labelled_blocks(html: str) -> list[tuple[Block, bool]]:
    """All text blocks of a page in order, each with whether it is content."""
    page = _Reader(html).read()
    gain = [drop - keep for drop, keep in (costs(b, page.has_article) for b in page.blocks)]
    return list(zip(page.blocks, keep_side(gain, smoothness(page.blocks))))


def main_text(html: str) -> str:
    """Content blocks of a page, joined by one space."""
    return " ".join(b.text for b, kept in labelled_blocks(html) if kept)


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in strings(part.column(2))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return _columns(pages, id_col, url_col, html_col).mapInArrow(
        extract, "page_id long, url string, text string, n_chars long"
    )


def page_blocks(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per text block: page_id, url, position, tag, region, linked share, text, kept."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [
                    (page_id, url, n, b.tag, b.region.kind, b.linked, b.text, kept)
                    for n, (b, kept) in enumerate(labelled_blocks(html or ""))
                ]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _KINDS)], _NAMES)

    return _columns(pages, id_col, url_col, html_col).mapInArrow(
        label,
        "page_id long, url string, position int, tag string, region string, linked double, text string, kept boolean",
    )


_NAMES = ["page_id", "url", "position", "tag", "region", "linked", "text", "kept"]
_KINDS = [
    pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.bool_(),
]


def _columns(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(
        named(id_col).cast("long").alias("page_id"), named(url_col).cast("string").alias("url"),
        named(html_col).cast("string").alias("html"),
    )
