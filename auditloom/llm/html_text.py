"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: elements, names and words --------------------------------------------------------------------------

#: Content is not markup; it ends at the next end tag of the same name and is never shown as text of the page.
RAW = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

BLOCKS = frozenset(
    "address article aside audio blockquote body button canvas caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main math menu nav noscript object ol optgroup option p pre "
    "search section select summary svg table tbody td template tfoot th thead tr ul video".split()
)

#: Elements that make a part of a page.
BOXES = frozenset("article body center div main section td th".split())

#: Elements whose content is no main text wherever they stand.
ASIDE = frozenset(
    "aside audio button canvas datalist dialog footer form head math menu nav noscript object search select svg template "
    "video".split()
)

#: What a page's head holds; anything else ends it.
HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: An element that a start tag of the same group ends, up to the element that holds the group.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}

#: Blocks whose text may be one link without being a menu.
SENTENCES = frozenset("blockquote figcaption p pre td".split())

ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: Words of class names and ids that mark other things than main text.
OTHER = frozenset(
    "ad adbox ads adsbygoogle adslot adunit advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentbox "
    "commentform commentlist comments consent cookie cookiebanner cookiebar cookies copyright disqus dropdown footer gdpr login "
    "mainnav masthead menu menubar modal nav navbar navi navigation navlinks newsletter notice notices overlay pager pagination "
    "paginator paywall popover popup promo promoted promotion recommendations recommended related replies reply respond responses "
    "share sharing sidebar sidebars sidenav signup sitefooter siteheader skip skiplink social sponsor sponsored sponsors subnav "
    "subscribe subscription teaser toolbar topnav widget widgets".split()
)

#: The same, but only outside of an article.
OUTER = frozenset("header foot head top bottom topbar".split())

#: Names with one of these in front say what a page has, not what the element is.
HAS = frozenset("has no with without is js".split())

#: Readers' words: an article inside is a comment, not the article.
READERS = frozenset("comment commentbox commentform commentlist comments disqus replies reply respond responses".split())

STOP_WORDS = frozenset(
    # English
    "a about after all also an and are as at be been but by can for from had has have he her his if in into is it its more no not "
    "of on one or other our out she so some than that the their them then there these they this to up was we were what when which "
    "who will with would you your "
    # German
    "aber als am auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich im ist "
    "kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war werden wie wir wird zu zum zur "
    # French
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu "
    "que qui sa se ses son sont sur un une vous "
    # Spanish
    "al como con cuando del desde donde el ella ellos entre era esta este esto fue ha hay las lo los más me mi muy nos para pero "
    "por porque se si sin sobre su sus también tiene una uno y ya".split()
)

# ---- Pass 0: markup to blocks -----------------------------------------------------------------------------------------

#: A quote opens a value behind an equals sign only; an unclosed comment or tag runs to the end.
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|</(?![a-z])[^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)

ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
CAPITALS = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[^\W\d_]+")


#: Open elements that are told apart, as in browsers.
DEEPEST = 512


@dataclass
class Block:
    """Text between two block boundaries and what the rules look at."""

    text: str
    tag: str
    #: Number of the article or main element around it, 0 for none, and whether it is an article.
    section: int
    article: bool
    #: Inside an element that is no main text by its markup.
    other: bool
    #: The same from inside an article that itself stands in such an element; its number, 0 for none.
    inner: int
    inner_other: bool
    #: Number of the part of the page it stands in.
    box: int
    linked: int
    links: int
    label: str = ""


@dataclass
class Element:
    name: str
    section: int = 0
    article: bool = False
    other: bool = False
    readers: bool = False
    inner: int = 0
    inner_other: bool = False
    box: int = 0


@dataclass
class Page:
    """Blocks of one page, gathered tag by tag."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=lambda: [Element("")])
    open: dict[str, int] = field(default_factory=dict)
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    links: int = 0
    sections: int = 0
    boxes: int = 0
    in_link: bool = False
    in_head: bool = False

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            owner = next((e.name for e in reversed(self.stack) if e.name in BLOCKS), "")
            top = self.stack[-1]
            linked = len(" ".join("".join(self.linked).split()))
            self.blocks.append(Block(text, owner, top.section, top.article, top.other, top.inner, top.inner_other, top.box, linked, self.links))
        self.parts.clear()
        self.linked.clear()
        self.links = 0

    def add(self, text: str) -> None:
        top = self.stack[-1]
        # A hidden word inside a block goes by itself.
        if text and (top.name in BLOCKS or not (top.inner_other if top.inner else top.other)):
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.in_link:
                self.linked.append(text)

    def close(self, names: tuple[str, ...], holders: frozenset[str] | tuple[str, ...]) -> None:
        """Close the innermost element of these names and all inside it, unless a holder stands in between."""
        if not any(map(self.open.get, names)):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].name in names:
                for element in self.stack[at:]:
                    self.open[element.name] -= 1
                del self.stack[at:]
                self.in_link = self.in_link and self.open.get("a", 0) > 0
                return
            if self.stack[at].name in holders:
                return

    def opened(self, name: str, rest: str) -> None:
        if name == "br":
            self.add(" ")
        if name in BLOCKS:
            self.end_block()
            # A paragraph holds no blocks, a list entry no other of its list.
            self.close(("p",), BLOCKS)
            if name in ENDS:
                self.close(*ENDS[name])
        if self.in_head and name not in HEAD:
            self.close(("head",), ("body",))
            self.in_head = False
        self.in_head |= name == "head"
        if name in VOID:
            return
        if name == "a":
            self.close(("a",), BLOCKS)
            self.in_link = True
            self.links += 1
            self.linked.append(" ")
        around = self.stack[-1]
        other, readers = judged(name, rest, around.section > 0)
        made = Element(
            name, around.section, around.article, around.other or other, around.readers or readers, around.inner,
            around.inner_other or (other and around.inner > 0), around.box,
        )
        if name in BOXES:
            self.boxes += 1
            made.box = self.boxes
        if (name == "article" or name == "main") and not other and not around.readers:
            # An article in an article is a part of it; one in a sidebar or the like counts if the page has no other.
            new = not (around.section or around.inner) or (name == "article" and not around.article and not around.inner)
            if new:
                self.sections += 1
                if around.other:
                    made.inner = self.sections
                else:
                    made.section, made.article = self.sections, name == "article"
        # Deeper elements are taken for what they stand in, so that no page takes more than its length in steps.
        if len(self.stack) < DEEPEST:
            self.stack.append(made)
            self.open[name] = self.open.get(name, 0) + 1

    def closed(self, name: str) -> None:
        # An inline element does not close blocks.
        if name in BLOCKS:
            self.end_block()
            self.close((name,), ())
        else:
            self.close((name,), BLOCKS)


def judged(name: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether tag and attributes say that an element is no main text, and whether it holds readers' words."""
    other = name in ASIDE or (name == "header" and not inside)
    readers = False
    if not rest or rest == "/" or name in ("html", "body"):
        return other, readers
    for found in ATTRIBUTE.finditer(rest):
        key = found[1].lower()
        value = html.unescape(found[2] or found[3] or found[4] or "")
        if key == "hidden":
            other |= value.lower() != "until-found"
        elif key == "style":
            other |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE))
        elif key == "role":
            other |= value.strip().lower() in ROLES
        elif key in ("class", "id") and name != "main" and name in BLOCKS:
            for one in value.split():
                words = [w for w in re.split(r"[\W_\d]+", CAPITALS.sub("-", one).lower()) if w]
                if not words or words[0] in HAS:
                    continue
                ends = {words[0], words[-1]}
                hit = bool(ends & OTHER) or (not inside and bool(ends & OUTER))
                other |= hit
                readers |= hit and bool(ends & READERS)
    return other, readers


def blocks_of(page: str) -> list[Block]:
    """Blocks of text of a page in order, white space inside each made one blank."""
    seen, at, look = Page(), 0, 0
    while (start := page.find("<", look)) >= 0:
        markup = MARKUP.match(page, start)
        if markup is None:
            look = start + 1
            continue
        seen.add(page[at:start])
        at = look = markup.end()
        name = markup["name"]
        if name is None:
            continue
        name = name.lower()
        if markup["close"]:
            seen.closed(name)
        else:
            seen.opened(name, markup["rest"])
    seen.add(page[at:])
    seen.end_block()
    return seen.blocks


# ---- Pass 1 and 2: labels ---------------------------------------------------------------------------------------------

#: Share of linked characters from which a block is a list of links.
LINK_DENSITY = 0.4
#: Characters from which a block is judged by its stop words, and their least share.
LENGTH = 70
STOP_DENSITY = 0.2


def first_label(block: Block) -> str:
    """``good``, ``bad`` or ``open`` by the block alone."""
    if block.other:
        return "bad"
    density = block.linked / len(block.text)
    if density > LINK_DENSITY:
        # A linked sentence of an article is part of it, an entry of a list of links is not.
        return "open" if block.section and block.links < 2 and (block.tag in SENTENCES or block.tag in HEADINGS) else "bad"
    if block.tag in HEADINGS or len(block.text) < LENGTH:
        # A line that begins with the sign of rights stands below a page.
        return "bad" if not block.section and block.text.startswith("\N{COPYRIGHT SIGN}") else "open"
    words = WORDS.findall(block.text.lower())
    if words and sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words):
        return "good"
    return "open"


def label(blocks: list[Block]) -> None:
    """Both passes: each block by itself, then what stayed open from its nearest decided neighbours.

    If an article has text, the rest of the page is bad, else the same for a main element.  Open blocks look for
    neighbours in their own section; the nearer one counts, and of two as near the next for a heading, else the good
    one.  Without any decided neighbour a block is good: it stands in the article, or the page has nothing else.
    """
    for block in blocks:
        block.label = first_label(block)
    if not any(b.section and b.label != "bad" for b in blocks):
        # The page's only article stands in a menu, form or the like, as after an element that nobody closed.
        for block in blocks:
            if block.inner and not block.inner_other:
                block.section, block.article, block.other = block.inner, True, False
                block.label = first_label(block)
    for kind in (lambda b: b.section and b.article, lambda b: b.section):
        if any(kind(b) and b.label != "bad" for b in blocks):
            for block in blocks:
                if not kind(block):
                    block.label = "bad"
            break
    for section in {b.section for b in blocks}:
        own = [b for b in blocks if b.section == section]
        # In an article only text decides: a list of links between two paragraphs says nothing about them.
        decided = [b.label if b.label == "good" or (b.label == "bad" and not section) else None for b in own]
        good_boxes = {b.box for b in own if b.label == "good"}
        still_open = [i for i, b in enumerate(own) if b.label == "open"]
        near = _neighbours(decided, [0] * len(own))
        # Where a part of the page holds text, its blocks look no further.
        near_in_box = _neighbours(decided, [b.box for b in own])
        for i in still_open:
            own[i].label = _inherited(own[i], i, *(near_in_box if own[i].box in good_boxes else near)[i])


def _neighbours(decided: list[str | None], boxes: list[int]) -> list[tuple]:
    """Place and label of the last decided block before and the first after each block, in its own box."""
    found = []
    for way in (range(len(decided)), range(len(decided) - 1, -1, -1)):
        last: dict[int, tuple[int, str]] = {}
        side: list[tuple[int, str] | None] = [None] * len(decided)
        for i in way:
            side[i] = last.get(boxes[i])
            if decided[i]:
                last[boxes[i]] = (i, decided[i])
        found.append(side)
    return list(zip(*found))


def _inherited(block: Block, at: int, before: tuple[int, str] | None, after: tuple[int, str] | None) -> str:
    if before is None or after is None:
        nearest = before or after
        return nearest[1] if nearest else "good"
    if block.tag in HEADINGS:
        return after[1]
    if at - before[0] == after[0] - at:
        return "good" if "good" in (before[1], after[1]) else "bad"
    return before[1] if at - before[0] < after[0] - at else after[1]


def main_text(page: str) -> tuple[str, list[Block]]:
    """Main text of a page, one line per block, and all its blocks with their labels."""
    blocks = blocks_of(page)
    label(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good"), blocks


# ---- The operator -----------------------------------------------------------------------------------------------------

BLOCK = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("label", T.StringType())]))
ARROW_BLOCK = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string()), ("label", pa.string())]))


def extract_text(pages: DataFrame, html_col: str = "html", keep_blocks: bool = False) -> DataFrame:
    """``pages`` with the main text of each whole page in place of the markup.

    Added: ``text`` (blocks in page order, one line each, white space inside a block made one blank, character
    references decoded; empty if there is none), ``n_chars`` (its code points) and, with ``keep_blocks``, ``blocks``
    (array of text, tag and label ``good`` or ``bad`` of all blocks of the page).

    A first pass decides blocks by their markup (menus, headers, footers, sidebars, notices, adverts, forms, readers'
    comments), link density, length and share of stop words; short or unclear ones then take the label of their
    nearest decided neighbours.  Inside an article or main element only links and markup speak against a block, so no
    short, foreign or wordless paragraph of it is lost; if the page has such an element with text, all else goes.

    Null and empty markup: empty text.  Unclosed, misnested and cut markup is read as far as it goes.  Repeated rows
    are treated alike.  Other columns stay; one named like an added one gets replaced.  Empty table: empty result.
    Pages are worked on one by one, in time proportional to their length.
    """
    added = ("text", "n_chars") + (("blocks",) if keep_blocks else ())
    others = [c for c in pages.columns if c.lower() not in added and c != html_col]
    rows = pages.select(F.col(html_col).alias("the markup"), *others)
    fields = [*rows.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType(fields + [T.StructField("blocks", BLOCK)] * keep_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [main_text(page or "") for page in part.column(0).to_pylist()]
                columns = [
                    *part.columns[1:], pa.array([text for text, _ in found], pa.string()), pa.array([len(text) for text, _ in found], pa.int64())
                ]
                if keep_blocks:
                    columns.append(pa.array([[{"text": b.text, "tag": b.tag, "label": b.label} for b in bs] for _, bs in found], ARROW_BLOCK))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
