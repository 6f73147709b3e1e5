"""Main text of web pages by two-pass block rules.

A page is cut into blocks. Containers that the page itself declares to be something else than its article
(menus, footers, forms, adverts, reader comments, hidden elements, ...) are cut away first; what is left is
classified, inside a marked article as outside.

Pass one decides each block by link density, length and the share of stop words: link-dense blocks are out,
long blocks with stop words in, long blocks without them out, and short or doubtful ones stay undecided.
Pass two gives each undecided block the label of its nearest decided neighbour. Markup is a feature of both:
inside an ``article`` or ``main`` few stop words make a block doubtful instead of bad, and ties go to text;
in a container whose name merely contains a boilerplate word a block needs many stop words; and where the
page marks an article with text in it, what lies outside isn't its text. No block is text for its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages served: English, French, German, Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with by at be this from or an not have has he she they you we but his her its were which will one all there can if more when who would about into than them then these so no what their our your "
    "de la le et les des en un une du dans est pour que qui sur pas plus par il elle au aux ce se ne sont avec son sa ses ou mais nous vous ils leur cette comme tout été fait être "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
    "el los las y del se con para por una su al lo como más pero sus este ya o fue ha entre cuando muy sin sobre ser también me hasta hay donde han quien están desde todo nos durante uno ni contra ese eso mi".split()
)

#: Elements whose content is never text; the first group runs to the end of the page when it isn't closed.
_RAW_TO_END = frozenset("script style template noscript iframe textarea title".split())
_RAW = _RAW_TO_END | frozenset("svg math select button object audio video canvas".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z!?][^>]*(?:>|$)|(?P<text>[^<]+|<)",
    re.S,
)
_BLOCKS = frozenset(
    "html head body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article header footer nav aside "
    "main blockquote pre form fieldset figure figcaption hr address details summary menu dialog center label legend option".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dd dt td th".split())
_BOILER_TAGS = frozenset("head nav footer aside menu dialog fieldset".split())
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STATE = re.compile(r"(?:has|no|with|without)[-_]", re.I)  # says what a layout has, not what the element is
_COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Readers' voices, or a section of an article: comments outside an article, and inside one if they look like a list of posts.
_TALK = frozenset("responses discussion discussions reactions feedback thread".split())
_POSTS = frozenset("author avatar reply user username commenter comment byline vote votes permalink timestamp posted".split())
_ADS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup "
    "overlay newsletter subscribe subscription share sharing recommended copyright alert".split()
)
#: Names that a layout may bear for what it has beside the article: taken back where nothing else on the page is text.
_PLACES = frozenset(
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer modal social related widget pagination pager login signin signup "
    "toolbar contentinfo complementary search dialog form".split()
)
_HEAD_NAMES = frozenset("header banner masthead topbar".split())
#: Pieces that say nothing of what a container holds.
_GENERIC = frozenset(
    "wrap wrapper box boxes container content contents area block blocks section list lists item items group inner outer row col column bar "
    "panel slot unit zone region module site page main top bottom left right primary secondary sticky fixed js post posts article articles entry "
    "links link header head title body text form forms button buttons holder icon icons stories story message cta copy widgets count meta image "
    "banner policy toggle the my global mobile desktop small large".split()
)
_SENTENCE_ENDS = (".", "!", "?", "…", "。", "！", "？", "।", "؟", '."', ".”", ".»")
_EDGES = ".,;:!?()[]{}\"'#*$%&|<>«»-–"


@dataclass(frozen=True)
class BlockRules:
    """Thresholds of both passes.

    ``short``, ``long``: characters; ``stop_high``, ``stop_low``: shares of stop words; ``page_known``: the
    share of a page's prose that lies in blocks with stop words, below which its language isn't one of the
    four served; ``link_dense``: share of linked characters.
    """

    short: int = 70
    long: int = 200
    stop_high: float = 0.30
    stop_low: float = 0.15
    page_known: float = 0.20
    link_dense: float = 0.5


class Block(NamedTuple):
    """A block and its features. ``region``: of a marked article inside a container that bears a name of other things, else 0."""

    text: str
    linked: int = 0
    main: bool = False
    item: bool = False
    heading: bool = False
    weak: bool = False
    region: int = 0
    named: bool = False  # cut by a name that a whole layout may bear
    out: bool = False  # cut for good

    def dense(self, rules: BlockRules) -> bool:
        return self.linked > rules.link_dense * len(self.text)

    def share(self) -> float:
        """The share of stop words."""
        words = [w.strip(_EDGES).lower() for w in self.text.split()]
        return sum(w in STOP_WORDS for w in words) / len(words)


class _Open(NamedTuple):
    """An open block element, with what holds for all inside."""

    tag: str = ""
    out: bool = False
    named: bool = False
    weak: bool = False
    main: bool = False
    region: int = 0
    form: int = 0
    talk: int = 0


def _name(token: str) -> tuple[frozenset[str], bool]:
    """Boilerplate pieces of one class, id or role; whether the name is about them.

    It is if they are its head: the last piece that says something, or the first with nothing after it
    ("site-footer", "comment-list-3"). "related-work" and "social-history" are about something else.
    """
    pieces = [x.lower() for x in _PIECES.findall(token)]
    found = frozenset(pieces) & (_COMMENTS | _TALK | _ADS | _PLACES | _HEAD_NAMES)
    if not found:
        return found, False
    last = [p for p in pieces if p not in _GENERIC or p in found]
    return found, last[-1] in found


def _attributes(tag: str, attrs: str, inside: bool) -> tuple[frozenset[str], frozenset[str], bool, bool]:
    """Names the element bears, names it merely contains, whether it is hidden, whether it marks the main text.

    The id of a heading, and of a section inside an article, is an anchor: it may be named after its subject.
    """
    anchors = _TALK | _PLACES | _HEAD_NAMES if inside and tag == "section" else frozenset()
    names, partly, hidden, main = set(), set(), False, False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role") and not (key == "id" and tag in _HEADINGS):
            for token in value.split():
                if not _STATE.match(token):
                    found, about = _name(token)
                    if key == "id":
                        found -= anchors
                    (names if about else partly).update(found)
            main = main or (key == "role" and value.lower() == "main")
        elif key == "itemprop":
            main = main or value.lower() == "articlebody"
        elif key == "style":
            hidden = hidden or "display:none" in value.replace(" ", "").lower()
        elif key == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif key == "hidden":
            hidden = True
    return frozenset(names), frozenset(partly - names), hidden, main


class _Parser:
    """Cuts one page into blocks."""

    def __init__(self) -> None:
        self.found: list[tuple[Block, _Open]] = []
        self.stack: list[_Open] = []
        self.parts: list[str] = []
        self.linked, self.link = 0, False
        self.item = self.heading = False
        self.regions = self.forms = self.talks = 0
        self.wide: set[int] = set()  # forms around an article
        self.posts: set[int] = set()  # talk that looks like a list of posts

    def close_block(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                at = self.stack[-1] if self.stack else _Open()
                block = Block(text, self.linked, at.main, self.item, self.heading, at.weak, at.region, at.named, at.out)
                self.found.append((block, at))
            self.parts.clear()
        self.linked = 0

    def end(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag), None)
        if at is not None and not (tag == "p" and any(x.tag != "p" for x in self.stack[at + 1 :])):
            del self.stack[at:]

    def start(self, tag: str, attrs: str) -> None:
        stack = self.stack
        if stack and (stack[-1].tag == "p" or (stack[-1].tag, tag) in (("head", "body"), ("li", "li"))):
            stack.pop()
        if tag == "li" and stack and stack[-1].tag == "li":
            stack.pop()
        up = stack[-1] if stack else _Open()
        names, partly, hidden, marked = _attributes(tag, attrs, up.main) if attrs else (frozenset(), frozenset(), False, False)
        if tag in ("html", "body"):
            hidden, names, partly = False, frozenset(), frozenset()
        wanted = tag in ("article", "main") or marked
        new = up._replace(tag=tag)
        if wanted:
            if up.named and not up.out:  # a layout may be named after what it has beside the article
                self.regions += 1
                new = new._replace(named=False, region=self.regions)
            self.wide.add(up.form)
            new = new._replace(main=True)
        hard = hidden or tag in _BOILER_TAGS or (tag == "header" and not up.main) or not names.isdisjoint(_COMMENTS)
        if not wanted:
            hard = hard or not names.isdisjoint(_ADS)
            places = _PLACES if up.main else _PLACES | _HEAD_NAMES
            if names or partly:
                new = new._replace(named=new.named or not names.isdisjoint(places), weak=new.weak or not partly.isdisjoint(_ADS | places))
            if not new.talk and not (names | partly).isdisjoint(_TALK):
                self.talks += 1
                new = new._replace(talk=self.talks)
                if not up.main:
                    self.posts.add(self.talks)
            if tag == "form" and up.main:  # it can't be around the article
                hard = True
            elif tag == "form" and not new.form:
                self.forms += 1
                new = new._replace(form=self.forms)
        if new.talk and up.talk and (wanted or tag in ("li", "time") or self.is_post(attrs)):
            self.posts.add(new.talk)
        if tag != "hr":
            stack.append(new._replace(out=True) if hard else new)

    def is_post(self, attrs: str) -> bool:
        return any(
            m[1].lower() == "class" and not _POSTS.isdisjoint(
                x.lower() for x in _PIECES.findall(m[2] or m[3] or m[4] or "")
            ) for m in _ATTR.finditer(attrs)
        )

    def feed(self, page: str) -> list[Block]:
        at, unclosed = 0, set()
        while at < len(page) and (m := _TOKEN.match(page, at)) is not None:
            at = m.end()
            if (text := m["text"]) is not None:
                self.parts.append(text)
                if self.link:
                    self.linked += len(text.strip())
                continue
            tag = (m["tag"] or "").lower()
            if tag in _RAW and not m["end"]:
                if (tag in ("svg", "math") and m["attrs"].endswith("/")) or tag in unclosed:
                    continue
                closed = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if closed is not None:
                    at = closed.end()
                elif tag in _RAW_TO_END:
                    break
                else:
                    unclosed.add(tag)
            elif tag == "a":
                self.link = not m["end"]
            elif tag == "br":
                self.parts.append("\n")
            elif tag in _BLOCKS:
                self.close_block()
                self.link = False
                if m["end"]:
                    self.end(tag)
                else:
                    self.start(tag, m["attrs"])
                self.item = bool(self.stack) and self.stack[-1].tag in _ITEMS
                self.heading = bool(self.stack) and self.stack[-1].tag in _HEADINGS
            elif self.stack and self.stack[-1].talk and (tag == "time" or self.is_post(m["attrs"] or "")):
                self.posts.add(self.stack[-1].talk)
        self.close_block()
        return self.settled()

    def settled(self) -> list[Block]:
        """The blocks, now that it is known which forms lie around an article and which talk is comments."""
        marked = any(b.main and not b.out for b, _ in self.found)
        mass: dict[int, int] = {}
        for b, at in self.found:
            if not b.out and not b.named:
                mass[at.form] = mass.get(at.form, 0) + len(b.text) - b.linked
        whole = sum(mass.values())
        around = lambda form: form in self.wide or (not marked and 2 * mass.get(form, 0) > whole)
        cut = lambda at: (at.form > 0 and not around(at.form)) or (at.talk > 0 and at.talk in self.posts)
        return [b._replace(out=True) if cut(at) else b for b, at in self.found]


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    return _Parser().feed(page)


def _prose(b: Block, rules: BlockRules) -> bool:
    return len(b.text) >= rules.short and not b.dense(rules)


def candidates(every: Sequence[Block], rules: BlockRules) -> list[Block]:
    """The blocks to classify: without what is cut, and of a page with a marked article only that.

    Marked articles inside a container named after other things are teasers unless they are the larger part.
    Names that a layout may bear don't cut where the page has no prose otherwise. A marked article without
    prose doesn't keep prose elsewhere on the page out.
    """
    left = [b for b in every if not b.out]
    sizes: dict[int, int] = {0: 0}
    for b in left:
        if b.main and not b.named:
            sizes[b.region] = sizes.get(b.region, 0) + len(b.text)
    larger = {r for r, n in sizes.items() if r == 0 or n > sizes[0]}
    open_ = [b for b in left if not b.named and b.region in larger]
    inside = [b for b in open_ if b.main]
    if not inside and not any(_prose(b, rules) for b in open_):
        open_ = left if any(_prose(b, rules) and b.share() >= rules.stop_low for b in left) else open_
    good = lambda b: _prose(b, rules) and b.share() >= rules.stop_high
    if inside and not any(_prose(b, rules) for b in inside):
        rest = [b for b in open_ if not b.main and good(b)]
        if sum(len(b.text) for b in rest) > 3 * sum(len(b.text) for b in inside):
            return open_
    return inside or open_


def first_pass(every: Sequence[Block], rules: BlockRules = BlockRules()) -> list[bool | None]:
    """Text, not text or undecided, by link density, length and stop words.

    On a page whose prose mostly lacks the stop words of the languages served, length and links decide alone.
    """
    prose = [b for b in every if _prose(b, rules)]
    shares = {id(b): b.share() for b in prose}
    served = sum(len(b.text) for b in prose if shares[id(b)] >= rules.stop_low)
    known = 0 < served >= rules.page_known * sum(len(b.text) for b in prose)

    def label(b: Block) -> bool | None:
        if b.dense(rules):
            return False if b.item or not b.main else None
        if len(b.text) < rules.short:
            return None
        if not known:
            return True
        share = shares[id(b)]
        if share >= rules.stop_high:
            return True
        if share >= rules.stop_low:
            return True if len(b.text) >= rules.long and not b.weak else None
        return None if b.main else False

    return [label(b) for b in every]


def second_pass(every: Sequence[Block], labels: Sequence[bool | None], rules: BlockRules = BlockRules()) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbour.

    Of two at the same distance a heading takes the following one's, other blocks the one's before; in a
    marked article both, and a block long enough for prose, go with whichever is text. Where no block is
    decided, those of a marked article stay, and others if one of them ends as a sentence.
    """
    if not any(x is not None for x in labels) or (True not in labels and any(b.main for b in every)):
        whole = any(b.main for b in every) or any(x is None and b.text.endswith(_SENTENCE_ENDS) for b, x in zip(every, labels, strict=True))
        return [x is None and whole for x in labels]
    if True not in labels and any(x is None and b.text.endswith(_SENTENCE_ENDS) for b, x in zip(every, labels, strict=True)):
        return [x is None for x in labels]

    def nearest(seq: Sequence[bool | None]) -> list[tuple[int, bool | None]]:
        out, last = [], (len(seq) + 1, None)
        for x in seq:
            last = (0, x) if x is not None else (last[0] + 1, last[1])
            out.append(last)
        return out

    kept = []
    for b, x, (p, left), (n, right) in zip(every, labels, nearest(labels), reversed(nearest(labels[::-1])), strict=True):
        if x is None:
            either = bool(left) or bool(right)
            if left is None or right is None:
                x = either
            elif left == right or p != n:
                x = left if p < n else right
                x = x or (b.main and len(b.text) >= rules.short and either)
            else:
                x = either if b.main else right if b.heading else left
        kept.append(x)
    return kept


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> list[str]:
    """The blocks of main text, in page order."""
    every = candidates(blocks(page or ""), rules)
    return [b.text for b, x in zip(every, second_pass(every, first_pass(every, rules), rules), strict=True) if x]


def extract(pages: DataFrame, rules: BlockRules = BlockRules()) -> DataFrame:
    """``(page_id, url, blocks, text)`` per page, from the whole html; one narrow pass, no shuffle.

    Null html counts as empty, and a page without main text has an empty text. Other columns, whatever
    their names, are left out. Repeated rows and null ids stay; an empty table gives an empty one. A page
    is parsed whole by one task, in memory and time proportional to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py(), rules) for x in batch.column(2)]
            texts = pa.array([" ".join(x) for x in found], pa.string())
            columns = [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string())), texts]
            yield pa.record_batch(columns, names=["page_id", "url", "blocks", "text"])

    kinds = {"page_id": "long", "url": "string", "html": "string"}
    picked = pages.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()))
    return picked.mapInArrow(run, "page_id long, url string, blocks array<string>, text string")
