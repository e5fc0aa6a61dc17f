"""Main text of HTML pages by two-pass block rules (operator 4).

A page is cut into blocks at block-level tags. The first pass decides what a
block's stop-word density, length, link density and enclosing elements tell:
navigation, page headers and footers, asides and forms are boilerplate; a long
block with many stop words and few links is text. A class or id is evidence only:
within an article an element named like a layout part (``LAYOUT``) is boilerplate
if no block of it is text by its words, or if most of the article's text is outside
such elements (headings stay ambiguous; a head part with text stays), and elements
named as adverts, menus or comments are boilerplate unless the page has no text
outside them; then the one of most text counts as if it had no name. Blocks that are short, or have few stop words, stay ambiguous. In the
second pass these take the label of the nearest decided block of the same
container (``article`` or ``main`` if the page has one). A container without
any decided block is text if it is an article, else boilerplate. Where a page has
no article and no text by its stop words (a language without listed ones, or short
paragraphs), its long blocks of few links under no boilerplate name are text, or if
there is none such, those that end as sentences do (``by_shape``). If an article
has decided text, and the articles hold most of the page's, blocks outside them
are boilerplate.

Scripts, styles, comments and markup are dropped, character references are
decoded, white space within a block (``br`` too) becomes one space, blocks are
joined by an empty line in page order. Unclosed tags end where HTML ends them.

Null and empty html, and pages without text, have an empty text. Pages of any
length are read whole in time linear in their length; null and repeated
page_ids are rows like others. Work is local to a row. Extra columns are not
read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factsift.llm import common

LONG_CHARS = 70           # a block of at least this length can be decided by its words
STOP_SHARE = 0.20         # stop words among the words of a text block
LINK_SHARE = 0.40         # linked characters of a boilerplate block

# ---- fixed values: HTML element kinds, boilerplate names, stop words ---------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template textarea select svg math object iframe canvas title head audio video".split())
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section "
             "summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = set("nav footer aside form menu dialog button fieldset".split())
CONTENT = {"article", "main"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
LISTS = set("ul ol menu dl table".split())
NAMES = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
            "consent cookie cookies disclaimer disqus footer header login masthead menu modal nav navbar navigation "
            "newsletter notice notices overlay pagination pager popup promo promoted related reply replies respond "
            "share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split())
# names that elements of an article's own text have, too
HEAD = {"header", "masthead"}
LAYOUT = HEAD | set("banner widget widgets related notice notices social overlay modal disclaimer discussion discussions".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
STOP_WORDS = frozenset((
    "a an and are as at be been but by can do for from had has have he her his i if in is it its more not of on or our she so "
    "such that the their them then there these they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für "
    "hat ich ihr im in ist ja kein mit nach nicht noch nur oder sein sich sie sind über um und uns von vor war was wenn wie "
    "wir wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi ne nos nous "
    "ou où par pas pour qu que qui sa se ses son sont sur ta te tu un une vos vous y "
    "al como con cuando de del desde donde el ella en entre era es esa ese eso esta este esto ha hay la las lo los más me mi "
    "muy no nos o para pero por porque que se ser si sin sobre son su sus también tan te todo un una uno y ya").split())

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*>?",
                 re.DOTALL)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f\u0964\u061f\u06d4][\"'\u2019\u201d\u00bb\u300d)]*$")
WORDS = re.compile(r"[^\W\d_]+")


class Name:
    """An element of a boilerplate name, linked to the next such one around it;
    ``weak``: all its names are of LAYOUT, ``head``: of HEAD."""

    def __init__(self, number: int, kind: str, around: "Name | None"):
        self.number, self.weak, self.head = number, kind != "named", kind == "head"
        self.any_weak = self.weak or around is not None and around.any_weak
        self.outer = around.strong if around else None           # the nearest around it that is not weak
        self.strong = self.outer if self.weak else self
        self.depth = self.outer.depth + 1 if self.outer else 0


@dataclass
class Block:
    text: str
    linked: int
    boilerplate: bool
    container: int            # number of the article it is in; 0: none
    named: Name | None = None     # the innermost enclosing element of a boilerplate name
    layout: Name | None = None    # the enclosing LAYOUT element of its article
    heading: bool = False
    label: str = field(default="")


@dataclass
class Element:
    tag: str
    boilerplate: bool
    container: int
    linked: bool
    named: Name | None = None
    layout: Name | None = None
    heading: bool = False


def names_boilerplate(tag: str, attributes: str) -> str:
    """What class, id or role call an element: ``boilerplate`` (hidden, or by its
    role), ``named``, ``layout`` or ``head``; else empty."""
    if tag in ("html", "body", "main", "article") or "=" not in attributes and "hidden" not in attributes.lower():
        return ""
    found = set()
    for m in ATTRIBUTE.finditer(attributes):
        name = m.group(1).lower()
        value = (m.group(2) or m.group(3) or m.group(4) or "").lower()
        if name == "hidden" or name == "role" and value in ROLES:
            return "boilerplate"
        if name in ("class", "id"):
            found.update(p for p in re.split(r"[\s_-]+", value) if p in NAMES or p in LAYOUT)
    return "" if not found else "head" if found <= HEAD else "layout" if found <= LAYOUT else "named"


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    stack: list[Element] = [Element("", False, 0, False)]
    opened: Counter = Counter()
    parts: list[str] = []
    linked = n_articles = n_named = 0
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            e = stack[-1]
            out.append(Block(text, linked, e.boilerplate, e.container, e.named, e.layout, e.heading))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if stack[-1].linked:
            linked += len("".join(text.split()))

    def close(tag: str) -> None:
        while True:
            e = stack.pop()
            opened[e.tag] -= 1
            if e.tag == tag:
                return

    while at < size:
        lt = html.find("<", at)
        m = TAG.match(html, lt) if lt >= 0 else None
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        if m is None:                      # a lone "<" is text
            add("<")
            at = lt + 1
            continue
        at = m.end()
        tag = (m.group(2) or m.group(5) or "").lower()
        if not tag:
            if m.group().startswith("<![CDATA["):
                add(m.group()[9:].removesuffix("]]>"))
            continue
        if m.group(1) or m.group(4):       # an end tag
            if tag in BLOCKS:
                flush()
            if opened[tag]:
                close(tag)
            continue
        attributes = m.group(3) or ""
        if tag in HIDDEN:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
                if end is None and tag in ("head", "title", "object", "audio", "video", "noscript", "template"):
                    continue
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if opened["p"]:
                close("p")
            ended = ENDED_BY.get(tag)
            if ended:
                # within the innermost list or table only
                for k in range(len(stack) - 1, max(0, len(stack) - 40), -1):
                    if stack[k].tag in LISTS:
                        break
                    if stack[k].tag in ended:
                        close(stack[k].tag)
                        break
        if tag in VOID:
            continue
        top = stack[-1]
        name = names_boilerplate(tag, attributes)
        boilerplate = top.boilerplate or tag in BOILERPLATE or tag == "header" and not top.container or name == "boilerplate"
        named, layout = top.named, top.layout
        if name in ("named", "layout", "head"):
            n_named += 1
            if name != "named" and top.container:
                # a header of an article is one of its own, with a class or without
                layout = layout if tag == "header" else Name(n_named, name, layout)
            else:
                named = Name(n_named, name, named)
        container = top.container
        if tag in CONTENT and not boilerplate and not container:
            n_articles += 1
            container = n_articles
        if boilerplate != top.boilerplate or named is not top.named or layout is not top.layout:
            flush()
        stack.append(Element(tag, boilerplate, container, top.linked or tag == "a", named, layout, top.heading or tag in HEADINGS))
        opened[tag] += 1
    flush()
    return out


def first_pass(block: Block) -> str:
    """``text``, ``boilerplate`` or ``ambiguous``."""
    if block.boilerplate:
        return "boilerplate"
    n = len(block.text)
    if block.linked > LINK_SHARE * n:
        return "ambiguous" if block.container else "boilerplate"
    if n < LONG_CHARS:
        return "boilerplate" if not block.container and "©" in block.text else "ambiguous"
    found = WORDS.findall(block.text.lower())
    if found and sum(w in STOP_WORDS for w in found) >= STOP_SHARE * len(found):
        return "text"
    return "ambiguous"


def by_shape(found: list[Block]) -> None:
    """On pages without an article or words that decide, blocks become text by length, or as sentences."""
    if any(b.label == "text" or b.container and not b.boilerplate for b in found):
        return
    free = [b for b in found if b.label == "ambiguous" and not b.named and not b.heading]
    # a character of a script without spaces counts as three
    long = [b for b in free if len(b.text) + 2 * len(UNSPACED.findall(b.text)) >= LONG_CHARS]
    for b in long or [b for b in free if SENTENCE_END.search(b.text)]:
        b.label = "text"


def free_names(texts: list[Block]) -> set[Name]:
    """The elements let off so that some text is in none: from the outermost, that
    with most text first. Every element is weighed and opened once."""
    held: Counter = Counter()
    for b in texts:
        held[b.named.strong] += len(b.text)
    direct, names = set(held), set()
    for x in direct:
        while x is not None and x not in names:
            names.add(x)
            x = x.outer
    inside: dict[Name | None, list[Name]] = {x: [] for x in (None, *names)}
    for x in sorted(names, key=lambda x: (-x.depth, x.number)):
        inside[x.outer].append(x)
        held[x.outer] += held[x]
    free, heap = set(), [(-held[x], x.number, x) for x in inside[None]]
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)[2]
        free.add(x)
        if x in direct:
            break
        for y in inside[x]:
            heapq.heappush(heap, (-held[y], y.number, y))
    return free


def weigh_names(found: list[Block]) -> None:
    """Blocks of elements with boilerplate names become boilerplate, or are let off.

    Where all text is in such elements, LAYOUT names count no longer, then the
    elements of most text (``free_names``). Within an article, a head element stays
    if it has a block of text; other LAYOUT elements (notices, widgets, discussions)
    go if most of the article's text is outside them."""
    texts = [b for b in found if b.label == "text"]
    free: set[Name] = set()
    weak_counts = True
    if texts and all(b.named for b in texts):
        weak_counts = not any(b.named.any_weak for b in texts)
        if all(b.named.strong for b in texts):
            free = free_names(texts)

    def bad(x: Name | None) -> bool:
        return x is not None and (weak_counts and x.any_weak or x.strong is not None and x.strong not in free)

    of_article: Counter = Counter()
    outside: Counter = Counter()
    own = set()
    for b in texts:
        if not bad(b.named):
            of_article[b.container] += len(b.text)
            if b.layout is None or b.layout.head:
                outside[b.container] += len(b.text)
            own.add(b.layout)
    for b in found:
        if bad(b.named) or b.layout and not b.heading and (
                b.label == "ambiguous" and b.layout not in own
                or not b.layout.head and 2 * outside[b.container] > of_article[b.container]):
            b.boilerplate, b.label = True, "boilerplate"


def second_pass(found: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided one in their container."""
    by: dict[int, list[Block]] = {}
    for b in found:
        b.label = first_pass(b)
    by_shape(found)
    weigh_names(found)
    decided = Counter()
    for b in found:
        if b.label == "text":
            decided[b.container > 0] += len(b.text)
        if not b.boilerplate:
            by.setdefault(b.container, []).append(b)
    for container, members in by.items():
        inside = container > 0
        n = len(members)
        before, after = [n + 1] * n, [n + 1] * n
        for k in range(n):
            before[k] = 0 if members[k].label != "ambiguous" else (before[k - 1] + 1 if k else n + 1)
        for k in reversed(range(n)):
            after[k] = 0 if members[k].label != "ambiguous" else (after[k + 1] + 1 if k + 1 < n else n + 1)
        labels = [b.label for b in members]
        for k, b in enumerate(members):
            if b.label != "ambiguous":
                continue
            if min(before[k], after[k]) > n:
                b.label = "text" if inside else "boilerplate"
            elif before[k] == after[k]:
                near = {labels[k - before[k]], labels[k + after[k]]}
                b.label = near.pop() if len(near) == 1 else ("text" if inside else "boilerplate")
            else:
                b.label = labels[k - before[k]] if before[k] < after[k] else labels[k + after[k]]
    if any(b.container and b.label == "text" for b in found) and decided[True] >= decided[False]:
        for b in found:
            if not b.container:
                b.label = "boilerplate"


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    second_pass(found)
    return "\n\n".join(b.text for b in found if b.label == "text")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row."""
    common.prepare(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every page's main text."""
    return extract(common.table(spark, sf_dir, "pages"))
