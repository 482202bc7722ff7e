"""Main text of web pages by line-block distribution.

The markup is stripped into lines: a block element or a line break ends a line; the boundary of a container (``div``
and its like) and an element that is left out are lines of length 0, and so is a line that is mostly links. Lengths are
summed over windows of ``WINDOW`` lines. The text dives where a window holds nothing, and what lies between two dives
is kept, all lines of it, if it surges: if one of its windows holds ``SURGE`` characters (the page's largest sum, where
none does). The threshold does not grow with the page, so a long paragraph costs no short one.

What an element is called is a prior, not a bound. Inside ``article`` and ``main`` any character is a surge, as long as
no stretch outside them holds more text than they do; then they are lines like all others. Outside, a stretch counts
only if it holds more than they do. Elements that can't hold article text (scripts, styles, menus, page headers, hidden
ones) are left out. An element that a class, id or role word calls an advert, a notice, a sidebar, reader comments and
so on, and a form, is left out unless its own text says otherwise: unless it holds an article, or most of the page's
text in several paragraphs. Inside an article, names of things that link (a menu, related reading) decide nothing by
themselves: such an element goes only if no less of its text is linked than not. Only the head word of a name counts
(``page-footer`` is a footer, ``related-work`` is none).

Defined cases: a null or empty page, and one without text, gives an empty text; unclosed and misnested elements end
with their parents; a tag that the page's end cuts off is no text; elements nested deeper than ``DEPTH`` become
siblings; very long pages are read whole, in time linear in their length; repeated rows stay; an empty table gives an
empty result; extra columns are ignored; a page_id that is no number is null.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, small_batches, strings

#: Parameters: lines of a window; characters of a window that are a surge; share of links that makes a line of length 0.
WINDOW = 3
SURGE = 40
LINKED = 0.5
DEPTH = 512

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)(>?))?")
STOP = re.compile(r"[>=]")
VALUE = re.compile(r"\s*+(?:([\"'])|[^\s>]*+)")
ATTRIBUTE = re.compile(r"([^\s/>=\"'][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
TELLING = re.compile(r"class|id|role|hidden|style", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")

#: Elements of HTML, by how they show.
RAW = frozenset("script style textarea title iframe noframes xmp".split())
HIDDEN = frozenset("head noscript template svg object canvas audio video select datalist optgroup option annotation annotation-xml".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("div section fieldset table body center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer button menu dialog search".split()) | HIDDEN
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Head words of a class or id that name furniture; words that say nothing of it; words before it that take it back.
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsors sponsored promo promotion promotions".split())
OTHERS = frozenset("banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager".split())
NAMES = COMMENTS | ADVERTS | OTHERS
OF_ARTICLES = COMMENTS | ADVERTS | frozenset("related recommended card teaser".split())
LINKING = frozenset("banner nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar toolbar overlay share sharing social related recommended recommendations widget widgets pagination pager".split())
VAGUE = frozenset("container wrapper wrap inner outer box block area section list item items slot unit left right top bottom content panel row col column group desktop mobile sticky primary secondary body title heading link links text label button buttons icon icons".split())
TAKEN_BACK = frozenset("has with no without not hide show".split())
LINKED_NAMES = frozenset(a + b for a in ("related", "recommended", "sponsored") for b in ("posts", "articles", "stories", "news", "reading"))
LINKING |= LINKED_NAMES
#: Elements that close an open p, ones that close their like, and ones that a block element breaks out of.
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption legend summary dd dt li body html".split()) | {"hr"}
LIKE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
BROKEN = ("head", "svg", "select", "datalist", "option", "optgroup")


def head_word(token: str) -> str:
    """What one class or id word names: its last word that says something; nothing, if it is taken back."""
    words = [w.lower() for w in PARTS.findall(token)]
    if TAKEN_BACK.intersection(words):
        return ""
    while words and words[-1] in VAGUE:
        words.pop()
    return words[0] + words[-1] if len(words) == 2 and words[0] + words[-1] in LINKED_NAMES else words[-1] if words else ""


@lru_cache(maxsize=20_000)
def told(attributes: str) -> tuple[bool, frozenset[str]]:
    """(hidden, head words of its classes, id and role) of an element's attributes."""
    hidden, words = False, set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        hidden |= key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and bool(UNSEEN.search(value))
        if key in ("class", "id"):
            words.update(map(head_word, value.split()))
        elif key == "role":
            words.update("role:" + x for x in value.lower().split() if x in ROLES)
    return hidden, frozenset(words)


def tag_end(page: str, at: int, dead: set[str]) -> int:
    """Where the tag ends whose attributes begin at ``at``, or -1. ``dead`` holds the quotes that the page has no more of."""
    while m := STOP.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at
        value = VALUE.match(page, at)
        at, quote = value.end(), value[1]
        if quote and quote not in dead:
            close = page.find(quote, at)
            if close < 0:
                dead.add(quote)
            else:
                at = close + 1
    return -1


class Region:
    """An element that may be furniture, or the page (the first one): its text, its paragraphs, and whether an article is in it."""

    def __init__(self, above: Region | None, words: frozenset[str] = frozenset(), inside: bool = False):
        self.above, self.words, self.inside = above, words, inside
        self.chars = self.prose = self.plain = self.linked = 0
        self.main = self.title = self.gone = False

    def is_furniture(self, page: Region) -> bool:
        if self.inside and self.words and self.words <= LINKING:
            return self.linked >= self.plain  # in an article such a name says nothing by itself
        if self.main and not self.words & COMMENTS:
            return False
        most = self.chars * 2 > page.chars and self.title or self.chars * 5 > page.chars * 4 and self.prose > 1 and not self.words & (COMMENTS | ADVERTS)
        return not most


class Lines:
    """The lines of a page in order: text, linked characters, whether an article or main element holds it, and its region. A gap has no text."""

    def __init__(self, page: str):
        self.rows: list[tuple[str, int, bool, Region]] = []
        self.page = Region(None)
        self.regions = [self.page]
        self.stack: list[tuple[str, bool, bool, Region]] = []  # element, and what was so before it
        self.open: Counter = Counter()
        self.hidden = self.main = False
        self.region = self.page
        self.buffer: list[str] = []
        self.links = self.linked = 0
        self.read(page)
        for r in reversed(self.regions[1:]):
            r.above.chars += r.chars
            r.above.prose += r.prose
            r.above.plain += r.plain
            r.above.linked += r.linked
            r.above.main |= r.main
            r.above.title |= r.title
        for r in self.regions[1:]:
            r.gone = r.above.gone or r.is_furniture(self.page)

    def flush(self) -> None:
        if self.buffer:
            text = SPACE.sub(" ", html.unescape("".join(self.buffer))).strip()
            self.buffer.clear()
            if text:
                self.rows.append((text, self.linked, self.main, self.region))
                self.region.linked += self.linked
                self.region.plain += max(0, len(text) - self.linked)
                if self.linked <= LINKED * len(text):
                    self.region.chars += len(text)
                    self.region.prose += len(text) >= SURGE
            self.linked = 0

    def gap(self) -> None:
        self.rows.append(("", 0, self.main, self.region))

    def close(self, k: int) -> None:
        """End the elements from place ``k`` of the stack on."""
        while len(self.stack) > k:
            name = self.stack[-1][0]
            if not self.hidden and (name in BLOCKS or self.stack[-1][3] is not self.region):
                self.flush()
                if name in CONTAINERS:
                    self.gap()
            name, self.hidden, self.main, self.region = self.stack.pop()
            self.open[name] -= 1
            self.links -= name == "a"

    def place(self, names: tuple[str, ...], scope: tuple[str, ...] = ()) -> int | None:
        """Place of the innermost open element of ``names``, none beyond one of ``scope``."""
        if any(self.open[n] for n in names):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in names:
                    return i
                if self.stack[i][0] in scope:
                    return None
        return None

    def end(self, name: str) -> None:
        k = self.place((name,))
        if k is None:
            if name in BLOCKS and not self.hidden:
                self.flush()
        elif name in BLOCKS or name in HIDDEN or not any(x[0] in BLOCKS for x in self.stack[k + 1 :]):
            self.close(k)  # an inline end tag does not close block elements around which it is misnested

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            for broken in BROKEN:
                k = self.place((broken,))
                if k is not None:
                    self.close(k)
        if name in CLOSES_P and (k := self.place(("p",), ("button", "td", "th", "caption", "object"))) is not None:
            self.close(k)
        if name in LIKE and (k := self.place(SAME.get(name, (name,)), LIKE[name])) is not None:
            self.close(k)
        if name == "a" and (k := self.place(("a",))) is not None:
            self.close(k)
        if name in VOID:
            if name in ("br", "hr") and not self.hidden:
                self.flush()
            return
        if len(self.stack) >= DEPTH:
            self.close(len(self.stack) - 1)
        if name in BLOCKS and not self.hidden:
            self.flush()
        unseen, words = told(attributes) if attributes and name not in ("html", "body") and TELLING.search(attributes) else (False, frozenset())
        self.stack.append((name, self.hidden, self.main, self.region))
        self.open[name] += 1
        self.links += name == "a"
        if self.hidden:
            return
        if unseen or name in FURNITURE or name == "header" and not self.main or any(w.startswith("role:") for w in words):
            if name in BLOCKS or name == "button":
                self.flush()
                self.gap()
            self.hidden = True
            return
        if name in CONTAINERS:
            self.gap()
        named = words & (OF_ARTICLES if name in MAIN else NAMES | LINKED_NAMES)
        if named or name == "form":
            self.flush()
            self.region = Region(self.region, named, self.main)
            self.regions.append(self.region)
        elif name in MAIN:
            self.main = self.region.main = True
        elif name == "h1":
            self.region.title = True

    def read(self, page: str) -> None:
        at, end, dead = 0, len(page), set()
        while at < end:
            lt = page.find("<", at)
            text = page[at : lt if lt >= 0 else end]
            if text and not self.hidden:
                self.buffer.append(text)
                if self.links:
                    self.linked += len(SPACE.sub(" ", text.strip()))
            if lt < 0:
                break
            m = NAME.match(page, lt + 1)
            if m is None:
                if page.startswith("<!--", lt):
                    stop = page.find("-->", lt + 2)
                    at = stop + 3 if stop >= 0 else end
                elif page.startswith(("<!", "<?", "</"), lt):
                    stop = page.find(">", lt)
                    at = stop + 1 if stop >= 0 else end
                else:
                    if not self.hidden:
                        self.buffer.append("<")
                    at = lt + 1
                continue
            name = m[2].lower()
            at = tag_end(page, m.end(), dead)
            if at < 0:
                break
            if m[1]:
                self.end(name)
                continue
            if name in RAW:
                stop = raw_end(name).search(page, at)
                if stop:
                    after = page.find(">", stop.end())
                    at = after + 1 if after >= 0 else end
                elif name in ("script", "style"):
                    at = end
                if name not in ("textarea", "title") and not self.hidden:
                    self.buffer.append(" ")
                continue
            self.start(name, page[m.end() : at - 1])
        self.close(0)
        self.flush()


def shown_lines(page: str) -> list[str]:
    """All text outside of elements that never show any, a line for each block, with single spaces.

    An element that is left out ends with its end tag, with the element around it, or, if a block element can't be in it
    (a head whose end tag is omitted), where such an element begins.
    """
    rows, buffer, at, end, dead = [], [], 0, len(page), set()
    hidden, inside = "", Counter()

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                rows.append(text)

    while at < end:
        m = OPENING.search(page, at)
        lt = m.start() if m else end
        if not hidden and lt != at:
            buffer.append(page[at:lt])
        if m is None:
            break
        if m[2] is None:
            comment = page.startswith("<!--", lt)
            if comment or page.startswith(("<!", "<?", "</"), lt):
                stop = page.find("-->", lt + 2) if comment else page.find(">", lt)
                at = stop + (3 if comment else 1) if stop >= 0 else end
            else:
                if not hidden:
                    buffer.append("<")
                at = lt + 1
            continue
        name, closes, at = m[2].lower(), m[1], m.end()
        if not m[3] and (at := tag_end(page, at, dead)) < 0:
            break
        if name in RAW and not closes:
            stop = raw_end(name).search(page, at)
            if stop:
                after = page.find(">", stop.end())
                at = after + 1 if after >= 0 else end
            elif name in ("script", "style"):
                at = end
            if not hidden:
                buffer.append(" ")
            continue
        block = name in BLOCKS
        if hidden:
            if closes:
                over = name == hidden and not inside[name] or block and not inside[name]
                inside[name] -= 1
            else:
                over = block and hidden in BROKEN
                inside[name] += 1
            if over:
                hidden = ""
            else:
                continue
        elif not closes and name in HIDDEN:
            hidden, inside = name, Counter()
            continue
        if buffer and (block or name in ("br", "hr")):
            flush()
    flush()
    return rows


@lru_cache(maxsize=16)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I | re.A)


def window_sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The text of each line and the ``window - 1`` lines after it."""
    total = np.r_[0, np.cumsum(np.r_[lengths, np.zeros(window - 1, np.int64)])]
    return total[window:] - total[:-window]


def stretches(lengths: np.ndarray, sums: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the lines between dives: no whole window in them is without text."""
    at = np.flatnonzero(lengths)
    if not len(at):
        return []
    dive = np.flatnonzero(sums == 0)  # a window without text begins here
    group = np.searchsorted(dive, at)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return list(zip(at[first].tolist(), (at[np.r_[first[1:], len(at)] - 1] + 1).tolist()))


def main_text(page: str | None) -> str:
    rows, gone = [], None
    for text, linked, main, region in Lines(page or "").rows if page else ():
        if not region.gone:
            rows.append((text, linked, main))
        elif region is not gone:
            rows.append(("", 0, main))
        gone = region if region.gone else None
    texts, inside = [r[0] for r in rows], np.array([r[2] for r in rows], bool)
    whole = np.array([len(t) for t in texts], np.int64)
    plain = np.where(np.array([r[1] for r in rows], float) > LINKED * whole, 0, whole)
    found = []
    for held, lengths in ((True, np.where(inside, whole, 0)), (False, np.where(inside, 0, plain))):
        sums = window_sums(lengths)
        found += [(s, e, held, int(sums[s:e].max()), int(lengths[s:e].sum())) for s, e in stretches(lengths, sums)]
    article = int(whole[inside].sum())
    trusted = article >= max((n for _, _, held, _, n in found if not held), default=0)
    surge = min(SURGE, max((top for *_, top, _ in found), default=0))
    keep = [(s, e, held) for s, e, held, top, n in found if (trusted if held else n > article and top >= surge) or held and top >= surge]
    lines = sorted({i for s, e, held in keep for i in range(s, e) if texts[i] and inside[i] == held})
    return " ".join(texts[i] for i in lines)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars; one pass, no shuffle."""
    small_batches(pages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(p) for p in strings(b.column(2))]
            yield batch_of(schema, b.column(0), b.column(1), texts, [len(t) for t in texts])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), page).mapInArrow(run, "page_id long, url string, text string, n_chars long")
