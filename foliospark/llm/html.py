"""Main text of web pages by the distribution of text over line blocks.

The markup is stripped into lines, one per block element. A line weighs the
characters it shows outside links; what stands in menus, headers, footers,
sidebars, notices, adverts, forms and comments weighs nothing and is never shown.
Where a page part begins or ends, lines of no weight are put in. The weights are
summed over a sliding window: a surge from nothing begins a run of text, a dive
to nothing ends it. If the page marks its article, the runs inside are its text.
Else the text goes from the first surge to the last dive of the main part: from the
heaviest run outwards, a run belongs to it if it stands in the same element as a
run that does, directly in the element that holds them all, or comes near the
weight of the one before it that did so. Lists of links inside belong to the text.

Defined results: a null or empty page, or one that shows no text, gives the
empty text. Unclosed, wrongly nested and cut off elements are closed where
their parent is. Nothing is cut off or dropped from a run, however short a
line or long a page is. Repeated rows are taken one by one; other columns are
carried along, and a column named like the result is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups

WINDOW = 3
NEAR_SHARE = 0.25  # of the run beside it, for pages that mark no article
LINK_SHARE = 0.6  # a line that is mostly links is a menu

# Elements of HTML by what they do to the text.
RAW = frozenset(
    "script style noscript template textarea title iframe svg object canvas xmp annotation "
    "annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br "
    "math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover "
    "munder munderover mstyle mpadded mphantom menclose mmultiscripts mtable mtr mtd".split()
)
ASIDE = frozenset("nav header footer aside menu dialog fieldset".split())
FIELDS = frozenset("button select datalist audio video".split())  # stand within a line
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset("p ul ol dl blockquote pre table figure".split())
# Words in class, id, role or aria-label of page parts that are not the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsbygoogle banner "
    "breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond consent "
    "cookie cookies gdpr notice notices notification alert disclaimer popup modal overlay "
    "newsletter subscribe subscription signup login footer header masthead menu nav navbar "
    "navigation pager pagination promo promoted promotion related recommended recommendations "
    "share sharing social sidebar sponsor sponsored sponsors tags toolbar widget widgets "
    "complementary contentinfo search skip".split()
)
# Words that name the place or form of a page part, and say nothing without one of the above.
PLACE_WORDS = frozenset(
    "area bar block bottom box button buttons container content form global group holder inner "
    "item items left link links list main outer panel primary right secondary section site slot "
    "top unit wrap wrapper".split()
)
# What else the name of such a part may say, where one of these is among its words.
PART_WORDS = frozenset(
    "ad ads advert advertisement comment comments commentlist cookie cookies consent newsletter "
    "promo recommended recommendations related replies share sharing social sponsored subscribe".split()
)
OWNER_WORDS = frozenset(
    "article articles body blog count customer entry feed latest more news page policy popular post "
    "posts reader readers stories story stream text thread threads title user users you".split()
)
TALK_WORDS = frozenset("discussion discussions conversation".split())
# Parts that have articles of their own, which are not the page's.
ARTICLE_HOLDERS = frozenset(
    "comment comments commentlist disqus recommended recommendations related replies reply respond".split()
)
# As ids these may as well come from the title of a section.
TITLE_WORDS = frozenset(
    "alert banner consent cookie cookies disclaimer gdpr header login notice notices notification "
    "promotion recommendations recommended related replies reply respond search share sharing "
    "signup skip social sponsors subscription tags toolbar".split()
)
UNNAMED = CONTENT | HEADINGS | {"body", "html"}  # parts whose names tell nothing

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAMES = ("class", "id", "role", "aria-label")
NOT_DISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Line:
    """What one block element shows, and how much of it counts."""

    text: str
    weight: int
    article: bool
    linked: bool = False  # has no weight only because it is mostly links
    at: int = 0  # element it stands in


@dataclass
class Open:
    name: str
    aside: bool
    article: bool
    named: tuple[int, ...] = ()  # named parts around it and itself
    at: int = 0
    muted: bool = False  # an aside within a line
    holder: bool = False  # a part with articles of its own


@dataclass
class Stripper:
    """Turns a page into lines."""

    lines: list[Line] = field(default_factory=list)
    stack: list[Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    spared: frozenset[int] = frozenset()  # named parts that hold the page itself
    elements: list[tuple[str, int, int]] = field(default_factory=lambda: [("", 0, 0)])
    names: int = 0
    held: dict[int, int] = field(default_factory=dict)  # text of each named part
    leading: set[int] = field(default_factory=set)  # named parts with the page's title or main
    forms: set[int] = field(default_factory=set)  # parts that are forms
    muted: int = 0  # asides within the line that are open

    def named(self, name: str, attributes: dict[str, str]) -> bool:
        """Whether an element is taken for what its names say; forms are parts by themselves."""
        if name in UNNAMED or not (name == "form" or aside_name(attributes)):
            return False
        self.names += 1
        if name == "form":
            self.forms.add(self.names)
        return self.names not in self.spared

    def add(self, text: str) -> None:
        if text and not self.muted:
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def end_line(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        linked, self.linked = self.linked, 0
        self.parts.clear()
        if not text:
            return
        top = self.stack[-1] if self.stack else None
        article = bool(top and top.article)
        shown = not (top and top.aside)
        menu = shown and not article and linked > LINK_SHARE * len(text)
        if menu:
            shown = False
        for part in top.named if top else ():
            self.held[part] = self.held.get(part, 0) + len(text)
        at = top.at if top else 0
        self.lines.append(Line(text, len(text) if shown else 0, article, menu, at))

    def gap(self) -> None:
        """Lines without weight: no window reaches across a page part's end."""
        self.lines.extend([Line("", 0, False)] * WINDOW)

    def open(self, name: str, written: str) -> None:
        if name == "a":
            self.links += 1
        if name in VOID:
            if name == "br":
                self.add(" ")
            elif name == "hr" and not self.muted:
                self.end_line()
            return
        attributes = attributes_of(written) if written and not written.isspace() else {}
        top = self.stack[-1] if self.stack else Open("", False, False)
        named = self.names
        marked = bool(attributes) and hidden(attributes) or (
            (bool(attributes) or name == "form") and self.named(name, attributes)
        )
        if name in INLINE or name in FIELDS or self.muted:
            if self.muted or name in FIELDS or marked and name != "a" and not top.aside:
                muted = name in INLINE and marked or name in FIELDS
                self.stack.append(Open(name, True, top.article, top.named, top.at, muted, top.holder))
                self.muted += muted
            return
        self.end_line()
        if name == "p":  # a paragraph ends where the next block begins
            self.close("p", among=("p",))
            top = self.stack[-1] if self.stack else Open("", False, False)
        content = name in CONTENT or (
            name == "div" and any("articlebody" in v.lower() for v in attributes.values())
        )
        aside = top.aside or marked or name in ASIDE
        if name == "header" and top.article or name in HEADINGS and top.article:
            # The headings of an article belong to it, also inside its header.
            aside = any(o.aside and o.name != "header" for o in self.stack) or (
                name == "header" or marked
            )
        holder = top.holder or marked and not self.spares(top) and words_of(attributes, ARTICLE_HOLDERS)
        if words_of(attributes, TALK_WORDS) and name not in UNNAMED:
            holder = True
        if content and not marked:
            if top.holder:
                aside = True  # a comment, or another page's article
            elif not any(o.aside and (o.name in ASIDE or o.article) for o in self.stack):
                aside = False  # an advert before it was never closed
        article = top.article or (content and not aside)
        if content or aside != top.aside:
            self.gap()
        if name == "h1" or name in CONTENT and not top.holder:
            self.leading.update(top.named)
        around = (*top.named, self.names) if self.names > named else top.named
        self.elements.append((name, top.at, self.elements[top.at][2] + 1))
        self.stack.append(
            Open(name, aside, article, around, len(self.elements) - 1, False, bool(holder))
        )

    def unmute(self, at: int) -> None:
        """Close asides within a line that were opened from this place on and not closed."""
        if self.muted and any(o.muted for o in self.stack[at:]):
            first = next(k for k in range(at, len(self.stack)) if self.stack[k].muted)
            self.muted -= sum(o.muted for o in self.stack[first:])
            del self.stack[first:]

    def spares(self, top: Open) -> bool:
        return self.names in self.spared and self.names not in top.named

    def close(self, name: str, among: tuple[str, ...] = ()) -> None:
        if name == "a":
            self.links = max(0, self.links - 1)
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                self.unmute(at + 1)
                inside = self.muted > 0
                if not inside:
                    self.end_line()
                before = self.stack[at - 1] if at else Open("", False, False)
                top = self.stack[-1]
                self.muted -= sum(o.muted for o in self.stack[at:])
                del self.stack[at:]
                if not inside and (top.aside != before.aside or top.article != before.article):
                    self.gap()
                return
            if among and self.stack[at].name not in among:
                return
            if self.stack[at].name in CONTENT and name not in CONTENT | {"body", "html"}:
                return  # what is closed here was opened outside, or never


def attributes_of(written: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each; one without value has the empty one."""
    found: dict[str, str] = {}
    for match in ATTRIBUTE.finditer(written):
        found.setdefault(match[1].lower(), match[2] or match[3] or match[4] or "")
    return found


def hidden(attributes: dict[str, str]) -> bool:
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or NOT_DISPLAYED.search(attributes.get("style", "")) is not None
    )


def name_words(attributes: dict[str, str]) -> Iterator[tuple[str, list[str]]]:
    """The words of every class, and of the other names, with the attribute's name."""
    for kind in NAMES:
        value = html.unescape(attributes.get(kind, ""))
        for token in [value] if kind == "aria-label" else value.split():
            yield kind, [w.lower() for w in NAME_PARTS.findall(token)]


def words_of(attributes: dict[str, str], wanted: frozenset[str]) -> bool:
    """Whether a class is made of these words, apart from those that name a place."""
    return any(
        kind == "class" and any(w in wanted for w in words)
        for kind, words in name_words(attributes)
    )


def aside_name(attributes: dict[str, str]) -> bool:
    """Whether the attributes name a page part that is not the article.

    A class or id does if all of its words belong to such a name.
    """
    for kind, words in name_words(attributes):
        telling = ASIDE_WORDS - TITLE_WORDS if kind == "id" else ASIDE_WORDS
        allowed = ASIDE_WORDS | PLACE_WORDS
        if any(w in PART_WORDS for w in words):
            allowed = allowed | OWNER_WORDS
        if any(w in telling for w in words) and all(w in allowed for w in words):
            return True
    return False


def page_lines(page: str) -> Stripper:
    """A page as lines; parts with most of its text are not taken for asides by name."""
    found = stripped(page)
    total = sum(len(line.text) for line in found.lines)
    shows = any(line.weight for line in found.lines)
    most = {part for part, size in found.held.items() if 2 * size > total}
    spared = frozenset(
        part for part in most if part in found.leading or part in found.forms or not shows
    )
    return stripped(page, spared) if spared else found


def stripped(page: str, spared: frozenset[int] = frozenset()) -> Stripper:
    found = Stripper(spared=spared)
    at = 0
    while True:
        match = TOKEN.search(page, at)
        if match is None:
            found.add(page[at:])
            break
        found.add(page[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            if match[0].startswith("<![CDATA["):
                found.add(match[0][9:].removesuffix("]]>"))
            continue
        if match[1]:
            found.close(name)
        elif name in RAW:
            if not match[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
        else:
            found.open(name, match[3])
    found.unmute(0)
    found.end_line()
    return found


def runs(lines: list[Line]) -> list[tuple[int, int, int]]:
    """First line, end and weight of each stretch between a surge and its dive."""
    weights = np.array([line.weight for line in lines] + [0] * WINDOW, np.int64)
    total = np.append(0, np.cumsum(weights))
    block = total[WINDOW:] - total[:-WINDOW]  # from each line on
    dense = np.concatenate([[False], block > 0, [False]])
    surges = np.flatnonzero(dense[1:] & ~dense[:-1])
    dives = np.flatnonzero(~dense[1:] & dense[:-1])
    found = []
    for surge, dive in zip(surges.tolist(), dives.tolist()):
        # The first window that holds text ends on it, the last begins on it.
        held = np.flatnonzero(weights[surge : dive + WINDOW - 1]) + surge
        found.append((int(held[0]), int(held[-1]) + 1, int(block[surge:dive].max())))
    return found


def main_part(page: Stripper, stretches: list[tuple[int, int, int]]) -> list[Line]:
    """The text of a page that marks no article."""
    lines, elements = page.lines, page.elements
    weighing = [line.at for line in lines if line.weight]
    if not weighing:
        return []
    common = weighing[0]
    for at in weighing:
        while at != common:
            if elements[at][2] >= elements[common][2]:
                at = elements[at][1]
            else:
                common = elements[common][1]
    known = {common: common}

    def part(line: Line) -> int:
        """The element directly in the common one that holds a line; -1: none."""
        passed, at = [], line.at
        while at not in known:
            if elements[at][1] == common and elements[at][2] > elements[common][2]:
                known[at] = at
            elif not at or elements[at][2] <= elements[common][2]:
                known[at] = -1
            else:
                passed.append(at)
                at = elements[at][1]
        known.update(dict.fromkeys(passed, known[at]))
        return known[at]

    def is_text(of: int) -> bool:
        return of == common or of >= 0 and elements[of][0] in TEXT_BLOCKS

    parts = [{part(line) for line in lines[a:b] if line.weight} for a, b, _ in stretches]
    core = max(range(len(stretches)), key=lambda k: stretches[k][2])
    kept, first, last = set(parts[core]), core, core
    for way in (range(core - 1, -1, -1), range(core + 1, len(stretches))):
        beside = core
        for k in way:
            near = stretches[k][2] >= NEAR_SHARE * stretches[beside][2]
            if near or parts[k] & kept or any(map(is_text, parts[k])):
                kept |= parts[k]
                beside = k if near else beside
                first, last = min(first, k), max(last, k)
    begin, end = stretches[first][0], stretches[last][1]
    # Links that follow without a gap in the same part are its last lines.
    while end < len(lines) and lines[end].linked and part(lines[end]) in kept - {common, -1}:
        end += 1
    return [
        line
        for line in lines[begin:end]
        if line.weight or line.linked and (part(line) in kept or is_text(part(line)))
    ]


def main_text(page: str) -> str:
    """The article of a page, its lines joined by blank lines."""
    found = page_lines(page)
    lines = found.lines
    stretches = runs(lines)
    inside = [r for r in stretches if any(line.article and line.weight for line in lines[r[0] : r[1]])]
    if inside:
        chosen = [line for first, end, _ in inside for line in lines[first:end] if line.weight]
    else:
        chosen = main_part(found, stretches)
    return "\n\n".join(line.text for line in chosen)


def extract(
    df: DataFrame, page: str = "html", out: str = "text", kept: list[str] | None = None
) -> DataFrame:
    """Add the main text of ``page`` to the columns ``kept`` (default: all)."""
    kept = [c for c in kept or df.columns if c != out]
    rows = df.select(
        F.struct(*kept).alias("row"),
        F.coalesce(F.col(page), F.lit("")).cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in byte_groups(batches):
            texts = [main_text(d.decode("utf-8", "replace")) for d in data]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string())], ["row", "text"]
            )

    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string"
    return rows.mapInArrow(run, schema).select("row.*", F.col("text").alias(out))
