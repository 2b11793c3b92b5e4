"""Main text of web pages by two-pass block rules (operator 9).

A page is cut into blocks at block-level tags.  Pass one decides each block
from what it holds and where it stands: blocks in page furniture (menus,
headers, footers, asides, forms, adverts, notices, comments: by tag, role, or
names of class and id) and blocks dense in links are out; long blocks dense in
stop words are in, shorter ones probably; short blocks stay ambiguous.  A name of a
class or id counts where it ends in a word of furniture, or begins with one that
words of place follow.  It doesn't on an element that holds the article, or (but for
readers' comments) most of the text of its region.  Where a region's stop words are of
none of the languages known here, the length of a block decides.  Pass two gives
ambiguous blocks the label of their nearest decided neighbours in the same region.
Regions are the article and the main element and the rest.  That a block stands in
an article or main element is a prior for it: with few stop words it is out only
between blocks that are.  The article's text is the page's, unless the main element
has more than twice as much beside it; the rest counts on pages without either.

Defined results: a NULL or empty page, or one without main text, gives an empty
text; repeated rows get a row each; an empty table gives no rows; extra columns
are ignored.  Truncated pages count up to where they end.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

# Frequent words of the languages that pages come in.
STOP_WORDS = frozenset(
    # English
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their "
    "they this to was we were which will with you "
    # French
    "au aux avec ce ces dans de des du elle en est et il ils la le les leur ne nous ou par pas plus pour qui que se son "
    "sur un une vous "
    # German
    "als an auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nach nicht sich sie "
    "sind und von wie wir zu zum "
    # Spanish
    "al como con del el ella en es esta este fue ha la las lo los más no o para pero por que se si sin su sus un una y ya".split())

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset(
    "article aside body center details dialog div dl figure footer form header html main menu nav ol section table td "
    "ul fieldset span a".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE_TAGS = frozenset("aside button dialog footer form menu nav fieldset".split())
FURNITURE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
# Words of class or id: always furniture, readers' comments, and furniture unless in the article.
FURNITURE = frozenset(
    "ad ads adv advert advertisement adverts advertising adslot aside banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies disclaimer discussion disqus dropdown footer gdpr hidden login menu modal nav navbar "
    "navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended related replies "
    "reply respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split())
FURNITURE_OUTSIDE = frozenset("alert bar copyright header legal links masthead meta search skip tags top".split())

COMMENTS = frozenset("comment commentlist comments discussion disqus replies reply respond".split())
# Words that tell the place or shape of furniture, and those that tell of a state.
PLACES = frozenset(
    "area articles author bar block body bottom box btn button buttons cell column container content copyright desktop "
    "entry form global group heading holder icon icons image inner item items label left link links list main meta "
    "mobile module outer panel position posts primary region right row secondary section site slot sticky stories text "
    "thread title toggle top unit view wrap wrapper zone".split())
STATES = frozenset("allow can enable has hide is js no not show with without".split())

_RAW = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|audio|video"
_MARKUP = re.compile(
    rf"""<!--.*?(?:-->|\Z)
    |<(?P<raw>{_RAW})\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<title\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</title\s*>|(?=</head\b|<body\b)|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attr>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |</?[a-z][^<>]*(?:>|\Z)
    |<[!?][^>]*(?:>|\Z)""", re.S | re.I | re.X)
_ATTR = re.compile(r"""(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG = 70, 200
LINKS_MOST = 0.3
STOPS_LOW, STOPS_HIGH = 0.12, 0.2
GOOD, NEAR, AMBIGUOUS, BAD = "good", "near", "ambiguous", "bad"


@dataclass
class Block:
    text: str
    link_chars: int
    furniture: bool
    region: str  # "article", "main" or "page"
    label: str = ""

    @cached_property
    def stops(self) -> tuple[int, int]:
        """How many stop words, of how many words."""
        w = _WORD.findall(self.text.lower())
        return sum(x in STOP_WORDS for x in w), len(w)


@dataclass
class _Element:
    """An element that is, or may be, furniture, or an article."""

    above: int
    tag: str
    sure: bool  # furniture by tag, role or style
    named: bool  # by names of class or id
    readers: bool  # of which comments
    depth: int  # elements above that are furniture by such words
    chars: int = 0


def _names(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id names furniture of these words."""
    for token in value.split():
        parts = [p.lower() for p in _PART.findall(token)]
        if parts and parts[0] not in STATES and (parts[-1] in words or (parts[0] in words and all(
                len(p) == 1 or p in PLACES or p in words for p in parts[1:]))):
            return True
    return False


def _furniture(tag: str, attr: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is furniture, by tag, role or style, by names of class
    or id, and by such of comments."""
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True, False, False
    if not attr or tag in ("html", "body", "main"):
        return False, False, False
    named = readers = False
    for name, value in _ATTR.findall(attr):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            named |= _names(value, FURNITURE) or (not in_article and tag != "article" and _names(value, FURNITURE_OUTSIDE))
            readers |= _names(value, COMMENTS)
        elif name == "role" and value.lower() in FURNITURE_ROLES:
            return True, named, readers
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, named, readers
        elif (name == "hidden" and attr) or (name == "aria-hidden" and value.lower() == "true"):
            return True, named, readers
    return False, named, readers


def _out(found: list[Block], held: list[int], elements: list[_Element]) -> None:
    """Which blocks are furniture: ``held`` has the innermost element of each."""
    for b, k in zip(found, held):
        elements[k].chars += len(b.text)
    for e in elements[:0:-1]:
        if not e.sure:
            elements[e.above].chars += e.chars
    sure, region, exempt, out = [False], [0], set(), [False]
    for k, e in enumerate(elements[1:], 1):
        sure.append(e.sure or sure[e.above])
        region.append(k if e.tag in ("article", "main") else region[e.above])
    mains = [k for k, e in enumerate(elements) if e.tag in ("article", "main") and e.chars and not sure[k]]
    for k, e in enumerate(elements):
        if (region[k] or not mains) and not e.readers and 2 * e.chars > elements[region[k]].chars:
            exempt.add(k)
    for tag in ("article", "main"):  # the one least inside such furniture, then with most text
        of_tag = [k for k in mains if elements[k].tag == tag]
        k = min(of_tag, key=lambda k: (elements[k].depth, -elements[k].chars), default=0)
        while k:
            exempt.add(k)
            k = elements[k].above
    for k, e in enumerate(elements[1:], 1):
        out.append(out[e.above] or e.sure or (e.named and k not in exempt))
    for b, k in zip(found, held):
        b.furniture = out[k]


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    names: list[str] = []
    elements, held = [_Element(0, "", False, False, False, 0)], []
    state: list[tuple[int, str]] = [(0, "page")]  # innermost of the elements, region
    parts: list[str] = []
    links = anchors = breaks = 0

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, links, False, state[-1][1]))
                held.append(state[-1][0])
        parts, links = [], 0

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if not piece.isspace():
                breaks = 0
                if anchors:
                    links += len(piece.strip())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            breaks += 1
            if breaks > 1:
                close()
            continue
        block = tag in BLOCK_TAGS
        if block:
            close()
            anchors = 0
        if m["end"]:
            if tag == "a":
                anchors = 0
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if state[k + 1] != state[-1] or state[k] != state[-1]:
                    close()
                del names[k:]
                del state[k + 1:]
        elif tag not in VOID:
            inside, region = state[-1]
            if tag in ("article", "main"):  # an element left open before ends here
                while names and names[-1] in ("nav", "header", "footer", "aside", "ul", "li") and tag == "article":
                    names.pop()
                    state.pop()
                inside, region = state[-1]
            bad, above = inside, elements[inside]
            if not above.sure:
                sure, named, readers = _furniture(tag, m["attr"], region == "article")
                if sure or named or tag in ("article", "main"):
                    bad = len(elements)
                    elements.append(_Element(inside, tag, sure, named, readers, above.depth + above.named))
            if tag == "article" or (tag == "main" and region == "page"):
                region = tag
            if tag == "a":
                anchors = 1
            if tag in CONTAINERS or bad != inside:
                if (bad, region) != state[-1]:
                    close()
                if tag != "p":
                    names.append(tag)
                    state.append((bad, region))
    if at < len(page):
        parts.append(page[at:])
    close()
    _out(out, held, elements)
    return out


def language_known(found: list[Block]) -> bool:
    """Whether the longer blocks hold the stop words of a language known here."""
    counts = [b.stops for b in found
              if not b.furniture and len(b.text) >= SHORT and b.link_chars <= LINKS_MOST * len(b.text)]
    return sum(s for s, _ in counts) >= STOPS_LOW * sum(n for _, n in counts)


def decide(b: Block, known: bool = True) -> str:
    """Pass one."""
    if b.furniture or b.link_chars > LINKS_MOST * len(b.text):
        return BAD
    if "©" in b.text and b.region != "article" and len(b.text) < LONG:
        return BAD
    inside = b.region != "page"
    if len(b.text) < SHORT:
        return BAD if b.link_chars and not inside else AMBIGUOUS
    if not known:
        return GOOD if inside or len(b.text) > LONG else NEAR
    stops, words = b.stops
    density = stops / max(1, words)
    if density >= (STOPS_LOW if inside else STOPS_HIGH):
        return GOOD if inside or len(b.text) > LONG else NEAR
    return NEAR if inside or density >= STOPS_LOW else BAD


def _nearest(found: list[Block], undecided: str) -> None:
    """Blocks labelled ``undecided`` take the label of the nearest decided ones."""
    decided = [i for i, b in enumerate(found) if b.label in (GOOD, BAD) and not b.furniture]
    labels, k = [b.label for b in found], 0
    for i, b in enumerate(found):
        while k < len(decided) and decided[k] < i:
            k += 1
        if b.label != undecided:
            continue
        around = decided[max(0, k - 1):k + 1] if k and decided[k - 1:k] else decided[k:k + 1]
        near = [(abs(i - d), found[d].label) for d in around]
        if not near:
            labels[i] = GOOD if b.region != "page" or undecided == NEAR else BAD
        elif undecided == NEAR:  # out only between two that are out
            labels[i] = BAD if [x for _, x in near] == [BAD, BAD] else GOOD
        else:  # of two as near the one that is in
            least = min(d for d, _ in near)
            labels[i] = GOOD if (least, GOOD) in near else BAD
    for b, label in zip(found, labels):
        b.label = label


def settle(found: list[Block]) -> None:
    """Pass two: probable blocks first, then the short ones."""
    _nearest(found, NEAR)
    _nearest(found, AMBIGUOUS)


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by an empty line."""
    found = blocks(page or "")

    def kept(region: str) -> list[str]:
        part = [b for b in found if b.region == region]
        known = language_known(part)
        for b in part:
            b.label = decide(b, known)
        settle(part)
        return [b.text for b in part if b.label == GOOD]

    article, main = kept("article"), kept("main")
    best = main if sum(map(len, main)) > 2 * sum(map(len, article)) else article
    return "\n\n".join(best or kept("page"))


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text) of every row."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pulsewatch.llm import html as H
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = [H.main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())],
                                                 names=["page_id", "url", "text"])

    picked = pages.select(pages[page_id].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"),
                          pages[html].cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id bigint, url string, text string")
