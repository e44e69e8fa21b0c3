"""Main text of web pages by two passes of block rules.

Pass 1 cuts a page into blocks at block-level tags and classifies each by its
length, link density and stop-word density: *good*, *bad*, *near-good* or
*short*.  Pass 2 lets undecided blocks inherit from the nearest decided
neighbours; a near-good block is kept beside a good one, a short block between
two good ones (or next to one, when no bad block is nearer on the other side).

Blocks below page furniture by tag or role (navigation, headers, footers, asides,
forms) and in comment threads are bad from the start.  Other furniture names in a class or
id (sidebar, notice, ...) are a prior: their blocks are bad unless the element so named
holds most of the page's text that the first pass does not call bad.  A mark (``<article>`` or ``<main>``) raises the prior of the blocks in it: few
stop words still make a long one near-good, and a short or near-good one needs a good
neighbour in the body no further off than a bad one.  The blocks outside are bad
where the marked body holds at least as much good text, else both passes judge them too.
Where no block holds a known stop word, length and links alone decide.

Every page is handled on its own in ``mapInArrow``: no shuffle, memory bounded
by one batch, and a lost executor costs only its tasks.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from judgefuse.llm.common import text_bytes
from judgefuse.llm.languages import LANGUAGES, STOP_WORDS

# HTML element names by their role here.
BLOCK = frozenset("""address article aside blockquote body br canvas center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
pre section summary table tbody td textarea tfoot th thead tr ul""".split())
NO_TEXT = frozenset("head title script style noscript template svg math iframe object embed applet audio video canvas "
                    "map select textarea button datalist".split())
FURNITURE = frozenset("nav footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu "
                            "menubar note".split())
FURNITURE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies disqus footer gdpr login masthead menu nav navbar navigation newsletter
notice notices notification pager pagination popup promo promos promoted related replies respond share sharing
sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets""".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

LENGTH_LOW, LENGTH_HIGH = 70, 200      # characters
STOPS_LOW, STOPS_HIGH = 0.10, 0.20     # share of stop words
LINKS_MAX = 0.3                        # share of characters inside links
MENU_RUN = 3                           # so many short linked blocks in a row are a menu, even in an article

MARKUP = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PART = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
STOPS = frozenset(w for lang in LANGUAGES for w in STOP_WORDS[lang])
LETTERS = re.compile(r"[^\W\d_]+")


# Elements that an HTML parser ends where another begins, and the elements it looks no further than.
TABLE_PARTS = ("tbody", "thead", "tfoot", "tr", "td", "th")
LIST_EDGES = ("ul", "ol", "dir", "dl", "table", "td", "th", "section", "article", "main", "aside", "nav", "footer", "header",
              "form", "fieldset", "blockquote", "figure", "details", "body")
ENDS = {"li": (("li",), LIST_EDGES), "dt": (("dt", "dd"), LIST_EDGES), "dd": (("dt", "dd"), LIST_EDGES),
        "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "td", "th"), ("table",)),
        "tbody": (TABLE_PARTS, ("table",)), "thead": (TABLE_PARTS, ("table",)), "tfoot": (TABLE_PARTS, ("table",)),
        "option": (("option",), ("select", "optgroup")), "optgroup": (("option", "optgroup"), ("select",))}
PARAGRAPH_EDGES = ("table", "td", "th", "button")
SECTIONS = ("article", "main", "nav", "footer", "aside", "form")


class Block:
    __slots__ = ("text", "linked", "bad", "inside", "heading", "item", "soft", "label", "share")

    def __init__(self, text: str, linked: int, bad: bool, inside: bool, heading: bool, item: bool, soft: int):
        self.text, self.linked, self.bad, self.inside, self.heading, self.item = text, linked, bad, inside, heading, item
        self.soft, self.label, self.share = soft, "", -1.0


FIRM, SOFT = 2, 1  # furniture whatever it holds; unless most of the page's text lies in it (``release``)


def is_furniture(tag: str, attributes: str, inside: bool) -> int:
    """``FIRM`` by tag, role or comment names, ``SOFT`` by other class names and ids, else 0."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return FIRM
    found = 0
    for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in FURNITURE_ROLES:
            return FIRM
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            words = NAME_PART.findall(value)
            if not COMMENT_WORDS.isdisjoint(words):
                return FIRM
            if tag != "article" and not FURNITURE_WORDS.isdisjoint(words):
                found = SOFT
    return found


class TagEnds:
    """Where tags end.  Every quote is looked at once however many tags are left open, so a page takes linear time."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.known: dict[int, int] = {}  # opening quote -> end of the tag it stands in, -1 if there is none
        self.searched, self.found = 0, -1

    def special(self, at: int) -> int:
        """The next of ``>"'``, or -1; a stretch without any is searched once."""
        if not self.searched <= at <= self.found:
            m = SPECIAL.search(self.page, at)
            self.searched, self.found = at, m.start() if m else len(self.page)
        return self.found if self.found < len(self.page) else -1

    def find(self, at: int) -> int:
        """The ``>`` that ends a tag whose name ends at ``at``: the first outside quotes, else the first at all, else -1."""
        page, seen, end, first = self.page, [], -1, at
        while (at := self.special(at)) >= 0:
            if page[at] == ">":
                end = at
                break
            if at in self.known:
                end = self.known[at]
                break
            seen.append(at)
            if self.last[page[at]] == at:
                break
            at = page.index(page[at], at + 1) + 1
        for quote in seen:
            self.known[quote] = end
        return end if end >= 0 else page.find(">", first) if self.last[">"] >= first else -1


class Open:
    """The open elements, with the places of those that decide on a block kept beside, so that a tag costs no walk."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool, int]] = []  # tag, furniture, article body, number
        self.places: dict[str, list[int]] = {}
        self.firm = self.headings = self.number = 0
        self.bodies: list[int] = []
        self.soft: list[int] = []
        self.around: dict[int, int] = {}  # soft furniture -> the soft furniture it lies in, 0 if none

    def place(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def push(self, tag: str, furniture: int, body: bool) -> None:
        self.number += 1
        at = len(self.stack)
        self.places.setdefault(tag, []).append(at)
        self.firm += furniture == FIRM
        self.headings += tag in HEADINGS
        if body:
            self.bodies.append(at)
        if furniture == SOFT:
            self.around[self.number] = self.innermost()
            self.soft.append(at)
        self.stack.append((tag, furniture, body, self.number))

    def innermost(self) -> int:
        return self.stack[self.soft[-1]][3] if self.soft else 0

    def cut(self, depth: int) -> None:
        """Ends the element at ``depth`` and all in it."""
        while len(self.stack) > depth:
            tag, furniture, body, _ = self.stack.pop()
            self.places[tag].pop()
            self.firm -= furniture == FIRM
            self.headings -= tag in HEADINGS
            if body:
                self.bodies.pop()
            if furniture == SOFT:
                self.soft.pop()

    def make_room(self, tag: str) -> None:
        """Ends the elements that ``tag`` ends by beginning: an open paragraph, a list item, a cell, ..."""
        if tag in BLOCK and self.place("p") > max(map(self.place, PARAGRAPH_EDGES)):
            self.cut(self.place("p"))
        ended, edges = ENDS.get(tag, ((), ()))
        edge = max(map(self.place, edges), default=-1)
        for other in ended:
            while self.place(other) > edge:
                self.cut(self.place(other))


def blocks_of(page: str) -> tuple[list[Block], dict[int, int]]:
    """Blocks in page order (references decoded, white space folded), and the nesting of soft furniture."""
    out: list[Block] = []
    parts: list[str] = []
    linked = links = soft = 0
    bad = inside = heading = item = False
    elements, ends = Open(), TagEnds(page)
    unended: set[str] = set()  # elements without text that have no end tag from here on

    def close_block() -> None:
        nonlocal linked, parts
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, linked, bad, inside, heading, item, soft))
        parts, linked = [], 0

    at = begin = 0
    n = len(page)
    while begin < n:
        m = MARKUP.search(page, at)
        upto, at = (m.start(), m.end()) if m else (n, n)
        tag = m[2].lower() if m and m[2] else ""
        if tag:
            end = ends.find(m.end())
            if end < 0:
                continue  # no tag: text
            attributes, at = page[m.end():end], end + 1
        elif m:
            end = page.find("-->", at) if m[0] == "<!--" else page.find(">", at)
            at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
        if upto > begin:
            piece = html.unescape(page[begin:upto])
            parts.append(piece)
            if links:
                linked += len(SPACE.sub(" ", piece).strip())
        begin = at
        if not tag:
            continue
        closing = bool(m[1])
        if not closing and tag in NO_TEXT and not attributes.rstrip().endswith("/"):
            # Nothing in it is text of the page: go to its end tag, or to the
            # end (raw-text elements) or on (others) where that is missing.
            end = None
            if tag not in unended:
                end = re.compile(r"</" + re.escape(tag) + r"\b[^<>]*>", re.I).search(page, at)
            if end:
                at = begin = end.end()
            elif tag in ("script", "style"):
                at = begin = n
            else:
                unended.add(tag)
            if tag in BLOCK:
                close_block()
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in BLOCK:
            close_block()
            links = 0
        if tag in VOID or (tag not in BLOCK and not (closing or attributes)):
            continue
        if closing:
            depth = elements.place(tag)
            if depth < 0 or tag in ("p", "li", "div") and max(map(elements.place, SECTIONS)) > depth:
                continue  # a stray end tag does not leave a section
            if elements.stack[depth][1] or elements.stack[depth][2]:
                close_block()
            elements.cut(depth)
        else:
            elements.make_room(tag)
            furniture = is_furniture(tag, attributes, bool(elements.bodies))
            if furniture:
                close_block()
            if not attributes.rstrip().endswith("/"):
                elements.push(tag, furniture, tag in ("article", "main") and not furniture)
        now = (elements.firm > 0, bool(elements.bodies), elements.innermost())
        if now != (bad, inside, soft):
            close_block()
        bad, inside, soft = now
        heading, item = elements.headings > 0, elements.place("li") >= 0
    close_block()
    return out, elements.around


def classify(b: Block, known: bool = True) -> str:
    """Pass 1: what the block's own figures say; ``known``: the page's stop words are."""
    if b.bad:
        return "bad"
    size = len(b.text)
    if b.linked > LINKS_MAX * size:
        return "short" if b.inside and size < LENGTH_LOW else "bad"
    if b.text[:1] == "©" or b.text[:6].lower() == "&copy;":
        return "short" if b.inside else "bad"
    if size < LENGTH_LOW or b.heading:
        return "short"
    if not known:
        return "good" if size > LENGTH_HIGH else "near"
    share = stop_share(b)
    if share >= STOPS_HIGH:
        return "good" if size > LENGTH_HIGH or b.inside else "near"
    if share >= STOPS_LOW or b.inside:
        return "near"
    return "bad"


def stop_share(b: Block) -> float:
    if b.share < 0:
        words = LETTERS.findall(b.text.lower())
        b.share = sum(w in STOPS for w in words) / max(1, len(words))
    return b.share


def release(blocks: list[Block], around: dict[int, int]) -> None:
    """Furniture by name alone is bad, unless it (and what it lies in) holds most of the page's
    text that pass 1 does not call bad, and no marked body outside it holds a good block."""
    whole = sum(len(b.text) for b in blocks if b.label != "bad")
    good, marked = dict.fromkeys((0, *around), 0), dict.fromkeys((0, *around), 0)
    for b in blocks:
        if b.label in ("good", "near"):
            good[b.soft] += len(b.text)
            marked[b.soft] += b.inside
    for k in reversed(around):  # inner furniture has the higher number
        good[around[k]] += good[k]
        marked[around[k]] += marked[k]
    released = {0: True}
    for k, outer in around.items():
        released[k] = released[outer] and 2 * good[k] > whole and marked[k] == marked[0]
    for b in blocks:
        if not released[b.soft]:
            b.bad, b.label = True, "bad"


def main_blocks(blocks: list[Block], around: dict[int, int]) -> list[Block]:
    """Pass 2: undecided blocks take the label of their nearest decided neighbours."""
    known = any(stop_share(b) >= STOPS_LOW for b in blocks if not b.bad and len(b.text) >= LENGTH_LOW)
    for b in blocks:
        b.label = classify(b, known)
    release(blocks, around)
    menu = [b.inside and b.label == "short" and b.linked > LINKS_MAX * len(b.text) for b in blocks]
    k = 0
    while k < len(blocks):
        run = k
        while run < len(blocks) and menu[run] and blocks[run].item == blocks[k].item:
            run += 1
        if run - k >= MENU_RUN:
            for b in blocks[k:run]:
                b.label = "bad"
        k = max(run, k + 1)
    body = [b for b in blocks if b.inside and not b.bad]
    own = sum(len(b.text) for b in body if b.label != "bad")
    if body and own >= sum(len(b.text) for b in blocks if not b.inside and b.label == "good"):
        blocks = body  # its edges are edges; furniture and what lies around it are no neighbours
    return inherit(blocks)


def inherit(blocks: list[Block]) -> list[Block]:
    labels = [b.label for b in blocks]
    n = len(blocks)
    before: list[tuple[str, int]] = []
    last = ("edge", -1)
    for k in range(n):
        before.append(last)
        if labels[k] in ("good", "bad"):
            last = (labels[k], k)
    after: list[tuple[str, int]] = [("edge", n)] * n
    nxt = ("edge", n)
    for k in range(n - 1, -1, -1):
        after[k] = nxt
        if labels[k] in ("good", "bad"):
            nxt = (labels[k], k)
    any_good = "good" in labels
    kept = []
    for k, b in enumerate(blocks):
        label = labels[k]
        if label in ("near", "short"):
            (l, i), (r, j) = before[k], after[k]
            near = label == "near"
            if not any_good:
                label = "good" if near or b.inside or len(b.text) >= LENGTH_LOW else "bad"
            elif l == r == "good":
                label = "good"
            elif "good" in (l, r):
                towards = (k - i) <= (j - k) if l == "good" else (j - k) <= (k - i)
                label = "good" if near or b.heading and r == "good" or (
                    towards or "edge" in (l, r) if b.inside else towards and "edge" in (l, r)) else "bad"
            else:
                label = "bad"
        if label == "good":
            kept.append(b)
    return kept


def main_text(page: str) -> str:
    return "\n".join(b.text for b in main_blocks(*blocks_of(page)))


def extract(df: DataFrame, page: str = "html", name: str = "text", size: str = "n_chars") -> DataFrame:
    """``df`` without ``page``, plus ``name`` (string) and ``size`` (code points).

    Null, empty and text-free pages give '' and 0; repeated rows are handled
    alike; a page takes time linear in its length, whatever is left open in it; existing columns called like an output are replaced.
    """
    import pyarrow as pa

    keep = [c for c in df.columns if c.lower() not in (page.lower(), name.lower(), size.lower())]
    schema = df.select(*keep).schema.add(name, "string").add(size, "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(b.decode("utf-8", "replace")) for b in text_bytes(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, name, size])

    return df.select(*keep, page).mapInArrow(run, schema)
