"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides: blocks in menus, headers, footers, sidebars,
notices, adverts, forms or comments (by tag, role, or a whole name in class or id) are boilerplate; the others are judged
by link density, length and the density of function words. Blocks that are too short or too plain to tell stay open. In
the second pass these take the label of the nearest decided neighbour, but a block dense with function words goes only from
between two that are decided against. Function words are listed for four languages. Where a page's text has too few of them to be in one of
these, and in blocks that are mostly of another script than Latin, length and link density decide alone; characters of scripts without
spaces between words count threefold. Where nothing is decided for, whatever is neither marked nor links is the text: a page
of short blocks is one. Where a page marks its main part (article, main),
only blocks within it are text; there only runs of bare links are decided against, and open blocks follow their neighbours
out only from between two of them. Names around the main part (a wrapper called `sidebar`, a form around the whole page)
don't count where without them the page has no text.

Tags are read as browsers do: a quote opens a value only after `=`; a quote that nothing closes is a plain character. Time
grows with the page's length, however deep its elements nest. Defined results: null or empty html gives an empty text,
n_chars 0; unclosed and stray tags are borne; a tag that the page ends in is dropped with what follows it; repeated rows
each get a row; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

_ATTRIBUTE = r"""[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+)?+)?+"""
TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|{_ATTRIBUTE})*+)>|<[a-zA-Z].*|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Elements by kind.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mi mn mo ms mtext mrow msup msub mfrac msqrt q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("head nav footer aside button menu dialog input option optgroup select datalist audio video canvas svg object template noscript annotation".split())
IN_HEAD = frozenset("head meta title link script style base noscript template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("p div ul ol dl table article section header footer nav aside main form h1 h2 h3 h4 h5 h6 blockquote pre hr address figure".split())
#: An element of the first kind ends an open one of its list, within the nearest of the elements that hold such lists.
FOLLOWS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDS = frozenset("ul ol menu dl table select".split())
CELLS = frozenset("table td th".split())
#: Roles, and words of class or id, that mark what is not the main text.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKED = frozenset(
    "nav navbar navigation menu menubar sidebar aside footer masthead ad ads adv advert advertisement adverts advertising banner "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay promo promotion promoted sponsor sponsored "
    "comment comments commentlist disqus replies respond share sharing social related recommended breadcrumb breadcrumbs newsletter "
    "subscribe subscription pagination pager widget widgets toolbar login signin signup search copyright disclaimer legal skip".split()
)
#: Last words of a name that mark whatever is before them, but for names that tell of a state.
LAST = frozenset("ad ads advert adverts advertisement advertisements comment comments commentlist sidebar navbar nav navigation footer masthead breadcrumb breadcrumbs newsletter sponsors".split())
STATE = frozenset("has have with without no not is show hide hides open closed enable enabled disable disabled toggle".split())
#: First words of a name that mark it together with these, which tell of a place or part.
FIRST = frozenset("ad ads adv advert adverts advertisement advertising comment comments disqus sponsor sponsored promo".split())
PARTS = frozenset("slot unit zone space frame label row iframe placeholder leaderboard rectangle skyscraper sticky mpu thread body content meta author reply count feed stream".split())
#: Words that a name may hold beside marking ones and still mean the same.
BESIDE = frozenset(
    "a the to top bottom left right inner outer main primary secondary first last site page post posts article articles entry blog story global "
    "box container wrapper wrap block section area list item items links link button buttons bar panel module form list header policy message text".split()
)
#: Frequent function words of English, French, German and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all "
    "she there would their we him been has when who will more no if out so can what up said its about than into them only some could "
    "le la les de des du un une et est en que qui dans pour par sur au aux avec ce cette il elle ne pas plus se son sa ses ou mais comme "
    "der die das den dem des ein eine einer eines und ist im zu von mit auf für sich nicht auch als an es aus bei nach wird sind oder "
    "el los las del al y un una es en que por con para su se lo no más como pero sus este esta o ha muy sin sobre también".split()
)
WORDS = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
#: Characters of scripts without spaces between words: Thai to Burmese, Khmer, kana and ideographs; and how many others one stands for.
DENSER = re.compile(r"[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
WEIGHT = 3
SHORT, LONG = 70, 200
LINKS, PLAIN, DENSE = 0.33, 0.12, 0.22
#: So many blocks of nothing but links in a row are a menu, also within an article.
MENU, ALL_LINKS = 3, 0.9
GOOD, BAD, OPEN, MAYBE, LEAN = 1, 0, 2, 3, 4


class State(NamedTuple):
    """Where a text stands. level: 2 in an article, 1 in another main part. named: within a marked name or form, which `outside` does not hold."""

    outside: bool = False
    named: bool = False
    level: int = 0
    link: bool = False
    heading: bool = False


class Block:
    __slots__ = ("parts", "linked", "state")

    def __init__(self, state: State):
        self.parts: list[str] = []
        self.linked, self.state = 0, state

    @property
    def bad(self) -> bool:
        return self.state.outside or self.state.named


def attributes(rest: str) -> dict[str, str]:
    """Of a tag, by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def marks(name: str, in_main: bool) -> bool:
    """Whether one name of class or id says that an element is no main text: all its words do, or stand beside such; its last word does; its first does, and a part of it follows."""
    listed = [w.lower() for w in PART.findall(name)]
    words = set(listed)
    known = MARKED if in_main else MARKED | {"header"}
    if words & known and words <= known | BESIDE:
        return True
    return bool(listed) and not words & STATE and (listed[-1] in LAST or (listed[0] in FIRST and words <= known | BESIDE | PARTS))


def entered(name: str, rest: str, state: State, unnamed: bool) -> State:
    """The state within an element. unnamed: no form and no name around a main part marks."""
    outside = state.outside or name in OUTSIDE or (name == "header" and not state.level)
    named = state.named or (name == "form" and not unnamed)
    level = max(state.level, {"article": 2, "main": 1}.get(name, 0))
    if "=" in rest and name not in ("html", "body"):
        found = attributes(rest)
        role = found.get("role", "").strip().lower()
        outside = outside or role in ROLES
        level = max(level, {"article": 2, "main": 1}.get(role, 0), 2 * ("articleBody" in found.get("itemprop", "").split()))
        if level == state.level or name not in ("article", "main"):
            named = named or any(marks(x, level > 0) for k in ("class", "id") for x in found.get(k, "").split())
    if unnamed and level > state.level:
        named = False
    return State(outside, named, level, state.link or name == "a", state.heading or name in HEADINGS)


class Page:
    """Cuts a page into blocks while it is read from left to right."""

    def __init__(self, unnamed: bool):
        self.unnamed = unnamed
        self.blocks: list[Block] = []
        self.fresh, self.breaks = True, 0
        self.stack: list[tuple[str, State]] = []
        self.open: list[Counter] = [Counter()]  # open elements by name, within each open table or cell

    @property
    def state(self) -> State:
        return self.stack[-1][1] if self.stack else State()

    def text(self, piece: str) -> None:
        if not piece or not (piece := unescape(piece)):
            return
        if not piece.strip():
            if self.blocks and not self.fresh:
                self.blocks[-1].parts.append(" ")
            return
        state = self.state
        if self.fresh or self.blocks[-1].bad != (state.outside or state.named):
            self.blocks.append(Block(state))
            self.fresh = False
        self.breaks = 0
        self.blocks[-1].parts.append(piece)
        if state.link:
            self.blocks[-1].linked += len(piece)

    def line_break(self) -> None:
        self.breaks += 1
        if self.breaks > 1:
            self.fresh = True
        elif self.blocks and not self.fresh:
            self.blocks[-1].parts.append(" ")

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if name in CELLS:
            self.open.pop()
        self.open[-1][name] -= 1
        return name

    def pop_to(self, names: tuple[str, ...]) -> None:
        while self.pop() not in names:
            pass

    def start(self, name: str, rest: str) -> None:
        here = self.open[-1]
        if here["head"] and name not in IN_HEAD:
            self.pop_to(("head",))
        if name in CLOSES_P and here["p"]:
            self.pop_to(("p",))
        if name == "a" and here["a"]:
            self.end("a")
        if name in FOLLOWS:
            self.follow(FOLLOWS[name])
        if name in VOID or (rest.rstrip().endswith("/") and name in ("svg", "math", "object")):
            return
        state = entered(name, rest, self.state, self.unnamed)
        if name in INLINE and state == self.state and not self.open[-1][name]:
            return  # it changes nothing, so its end needn't be known
        self.stack.append((name, state))
        self.open[-1][name] += 1
        if name in CELLS:
            self.open.append(Counter())

    def follow(self, names: tuple[str, ...]) -> None:
        for name, _ in reversed(self.stack):
            if name in names:
                self.pop_to(names)
                if name != "tr" and "tr" in names:
                    self.follow(names)
                return
            if name in HOLDS:
                return

    def end(self, name: str) -> None:
        if name in INLINE:
            for above, _ in reversed(self.stack):
                if above == name:
                    return self.pop_to((name,))
                if above not in INLINE:
                    return None
        elif name in CELLS or name in ("tr", "tbody", "thead", "tfoot"):
            if any(x[name] for x in self.open):
                self.pop_to((name,))
        elif self.open[-1][name] > 0:
            self.pop_to((name,))
        return None


def blocks_of(html: str, unnamed: bool = False) -> list[Block]:
    """The blocks of a page in order, each with its text and what surrounds it."""
    page, at = Page(unnamed), 0
    while token := TOKEN.search(html, at):
        page.text(html[at : token.start()])
        at = token.end()
        name = (token[2] or "").lower()
        if name == "br":
            page.line_break()
        elif name:
            if name not in INLINE:
                page.fresh = True
            if token[1]:
                page.end(name)
            elif name in RAW:
                page.start("title" if page.open[-1]["head"] else "script", "")
                page.pop()
                ends = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(html, at)
                at = ends.start() if ends else len(html)
            else:
                page.start(name, token[3])
    page.text(html[at:])
    return page.blocks


def length(text: str) -> int:
    """Characters, those of scripts without spaces weighed."""
    return len(text) + (WEIGHT - 1) * len(DENSER.findall(text)) if not text.isascii() else len(text)


class Judge:
    """The first pass over a page's blocks."""

    def __init__(self, blocks: list[tuple[Block, str]], top: int):
        self.top = top
        #: function words, words, and share of links of each block that could be text
        self.facts = []
        known = total = 0
        for block, text in blocks:
            if block.bad or (top and not block.state.level):
                self.facts.append(None)
                continue
            words = WORDS.findall(text.lower())
            listed = sum(w in FUNCTION_WORDS for w in words)
            linked = block.linked / max(1, sum(map(len, block.parts)))
            self.facts.append((listed, len(words), linked))
            if linked <= LINKS:
                known, total = known + listed, total + len(words)
        #: whether the page's words are those of a language with a list
        self.listed = known >= PLAIN * total

    def label(self, block: Block, text: str, facts: tuple | None) -> int:
        """GOOD, BAD, or open: MAYBE leans to good when its neighbours disagree, LEAN unless both are bad."""
        if facts is None:
            return BAD
        listed, number, linked = facts
        dense = listed / max(1, number)
        silent = not self.listed or (not text.isascii() and 2 * len(LATIN.findall(text)) < sum(map(str.isalpha, text)))
        size = length(text)
        if self.top and block.state.level == self.top:
            return GOOD if linked <= LINKS and size >= SHORT and (silent or dense >= PLAIN) else MAYBE
        if linked > LINKS:
            return BAD
        if size < SHORT:
            return MAYBE if block.state.heading else OPEN
        if silent or dense >= DENSE:
            return GOOD if size >= LONG else LEAN
        return OPEN if dense >= PLAIN else BAD


def menus(blocks: list[Block]) -> list[bool]:
    """Which blocks are in a run of MENU or more that hold nothing but links."""
    links = [b.linked > ALL_LINKS * sum(map(len, b.parts)) for b in blocks]
    out, at = [False] * len(links), 0
    while at < len(links):
        to = at
        while to < len(links) and links[to] == links[at]:
            to += 1
        if links[at] and to - at >= MENU:
            out[at:to] = [True] * (to - at)
        at = to
    return out


def second_pass(labels: list[int], default: int, marked: bool = False) -> list[int]:
    """Open blocks take the label of the nearest decided one; at equal distance, MAYBE becomes good if either is.

    LEAN, and in a marked main part MAYBE, is good but between two bad ones.
    """
    n, before, after = len(labels), [], []
    last = -1
    for i, x in enumerate(labels):
        last = i if x in (GOOD, BAD) else last
        before.append(last)
    last = n
    for i in range(n - 1, -1, -1):
        last = i if labels[i] in (GOOD, BAD) else last
        after.append(last)
    after.reverse()
    out = []
    for i, x in enumerate(labels):
        if x in (GOOD, BAD):
            out.append(x)
            continue
        low, high = before[i], after[i]
        if x == LEAN or (marked and x == MAYBE):
            out.append(max(GOOD if low < 0 else labels[low], GOOD if high == n else labels[high]))
        elif low < 0 and high == n:
            out.append(default if x == OPEN else GOOD)
        elif high == n or (low >= 0 and i - low < high - i):
            out.append(labels[low])
        elif low < 0 or high - i < i - low:
            out.append(labels[high])
        else:
            both = labels[low], labels[high]
            out.append(max(both) if x == MAYBE else min(both))
    return out


def _main_text(html: str, unnamed: bool) -> str:
    blocks = [(x, t) for x in blocks_of(html, unnamed) if (t := " ".join("".join(x.parts).split()))]
    top = max((x.state.level for x, _ in blocks if not x.bad), default=0)
    judge = Judge(blocks, top)
    labels = [judge.label(x, t, f) for (x, t), f in zip(blocks, judge.facts, strict=True)]
    if not top:
        labels = second_pass(labels, BAD)
        if GOOD not in labels:
            labels = [GOOD if f and f[2] <= LINKS else BAD for f in judge.facts]
    else:  # within the main part, only its own blocks are neighbours
        inside = [i for i, (x, _) in enumerate(blocks) if x.state.level and not x.bad]
        listed = menus([blocks[i][0] for i in inside])
        own = second_pass([BAD if m else labels[i] for i, m in zip(inside, listed, strict=True)], GOOD, True)
        if not any(own):
            own = [GOOD] * len(own)
        for i, label in zip(inside, own, strict=True):
            labels[i] = label
    return "\n".join(t for (_, t), label in zip(blocks, labels, strict=True) if label == GOOD)


def main_text(html: str) -> str:
    return _main_text(html, False) or _main_text(html, True)


def extracted(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x or "") for x in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
