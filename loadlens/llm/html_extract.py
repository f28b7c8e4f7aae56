"""Main-text extraction from HTML by two-pass block rules."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from loadlens.llm.common import table

# Frequent function words of the languages served.
STOP_WORDS = frozenset(
    "a about an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their there they this to was were what when which will with you "
    "al como con de del el en es esta la las lo los mas no o para pero por que se su sus un una y ya "
    "au aux avec ce ces dans des du elle est et il ils je le les leur mais ne nous ou par pas plus pour qui sa sont sur une vous "
    "als am auch auf aus bei das dem den der die ein eine einen er für hat ich im ist mit nach nicht noch sich sie sind so um und von wie wir zu zum zur über".split()
)
# Elements and words of class, id or role that mark a part of the page.
RAW = frozenset("script style textarea template noscript iframe object svg math canvas select title xmp noembed noframes audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BAD_TAGS = frozenset("nav header footer aside menu dialog button fieldset legend label head datalist".split())
MAIN_TAGS = frozenset("article main".split())
#: Never main text, whatever they hold: adverts, notices, reader comments.
BARRED_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall "
    "comment comments commentlist respond reply replies discussion discussions disqus teaser teasers adsbygoogle doubleclick taboola outbrain".split()
)
#: Usually not main text, unless the page has no other.
SIDE_WORDS = frozenset(
    "sidebar sidebars rail aside widget widgets nav navbar navigation navigate menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar "
    "header masthead footer foot bottombar copyright legal disclaimer share sharing social related recommended recommendations trending newsletter subscribe subscription signup login search skip complementary contentinfo".split()
)
#: Words beside the one that says what a part is, as in "site-footer" or "sidebar-left".
NEUTRAL_WORDS = frozenset("site page global top bottom left right first last wrapper wrap container box block section area inner outer list item items bar panel links buttons posts articles content primary secondary".split())
MAIN_WORDS = frozenset("article main post entry story".split())

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:--!?>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LETTERS = re.compile(r"[^\W\d_]+")
LATIN = re.compile(r"[A-Za-z\u00C0-\u024F]+")
#: Scripts without spaces: a character says about as much as three Latin ones.
DENSE = re.compile(r"[\u0E00-\u0EFF\u3040-\u30FF\u3400-\u9FFF\uAC00-\uD7AF]")

#: Characters under which a block is short, and from which it is long.
SHORT, LONG = 70, 200
#: Stop-word shares under and from which a block is decided, and the share of linked characters above which it is a list of links.
STOP_LOW, STOP_HIGH, LINKED = 0.08, 0.2, 0.5

BAD, GOOD, OPEN = -1, 1, 0
#: Regions of a page.
BARRED, SIDE, PLAIN, MAIN = -2, -1, 0, 1
DOUBTFUL = 2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dd dt td th".split())


class _Block:
    __slots__ = ("doubts", "heading", "item", "linked", "links", "pieces", "region")

    def __init__(self, region: int, tag: str = "", doubts: tuple[int, ...] = ()):
        self.pieces: list[str] = []
        self.linked = self.links = 0
        self.region, self.heading, self.item, self.doubts = region, tag in HEADINGS, tag in ITEMS, doubts


@lru_cache(maxsize=1 << 14)
def _kind(token: str) -> int:
    """What a class, id or role says: a whole name counts, so all its words but neutral ones must be of the kind. A barred word beside others makes it doubtful."""
    words = [w for w in map(str.lower, PARTS.findall(token)) if w not in NEUTRAL_WORDS]
    barred = any(w in BARRED_WORDS for w in words)
    if words and all(w in BARRED_WORDS or w in SIDE_WORDS for w in words):
        return BARRED if barred else SIDE
    if barred:
        return DOUBTFUL
    return MAIN if words and all(w in MAIN_WORDS for w in words) else PLAIN


def _region(tag: str, attrs: str, above: int, inside: bool) -> tuple[int, bool, bool]:
    """Region of an element's content, whether it lies in the article, and whether the element is doubtful: a form, or with a barred word in a name of several."""
    if above == BARRED:
        return BARRED, inside, False
    if tag in BAD_TAGS and not (tag == "header" and inside):
        return BARRED, inside, False
    kinds: set[int] = set()
    if attrs and not attrs.isspace():
        for name, *values in ATTRIBUTE.findall(attrs):
            name, value = name.lower(), "".join(values)
            if name in ("class", "id", "role"):
                kinds.update(map(_kind, value.split()))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return BARRED, inside, False
    doubtful = tag == "form"
    if tag not in ("html", "body") and tag not in HEADINGS:
        if BARRED in kinds:
            return BARRED, inside, False
        doubtful = doubtful or DOUBTFUL in kinds
        if SIDE in kinds and not (MAIN in kinds and inside):
            return min(above, SIDE), inside, doubtful
    if tag in MAIN_TAGS or (MAIN in kinds and tag in ("div", "section")):
        return (MAIN, True, doubtful) if above != SIDE else (SIDE, inside, doubtful)
    return above, inside, doubtful


def blocks(html: str) -> list[_Block]:
    """The page's text blocks in order, each with its region (in the article, in boilerplate, or neither), the doubtful elements around it and linked characters."""
    out: list[_Block] = []
    stack: list[tuple[str, int, bool, tuple[int, ...]]] = [("", PLAIN, False, ())]
    now = _Block(PLAIN)
    link, at, size, doubts = False, 0, len(html), 0

    def text(piece: str) -> None:
        if stack[-1][1] < PLAIN <= now.region or len(stack[-1][3]) > len(now.doubts):  # an inline part of a block, such as an advert
            return
        now.pieces.append(piece)
        if link:
            now.linked += len(piece)

    def close() -> None:
        nonlocal now
        if now.pieces:
            out.append(now)
        now = _Block(stack[-1][1], "", stack[-1][3])

    while at < size:
        m = TOKEN.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, ends = tag.lower(), m["close"]
        if tag == "br":
            text(" ")
            continue
        block = tag not in INLINE
        if block:
            close()
            link = False
        if ends:
            if tag == "a":
                link = False
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if not block and stack[i][0] not in INLINE:
                    break
        elif tag in RAW:
            if not m["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else size
            continue
        elif tag not in VOID:
            if block:  # an open paragraph or item ends where the next block begins
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p" or (tag == "li" and stack[i][0] == "li"):
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif tag == "a":
                link = True
                now.links += 1
            _, above, inside, around = stack[-1]
            region, within, doubtful = _region(tag, m["attrs"], above, inside)
            if doubtful:
                doubts += 1
                around = (*around, doubts)
            if block or doubtful or (region, within) != (above, inside):
                stack.append((tag, region, within, around))
        if block:
            now = _Block(stack[-1][1], stack[-1][0], stack[-1][3])
    close()
    return out


def _decided(block: _Block, text: str) -> int:
    """First pass: what a block is by link density, length and stop-word density; OPEN if they do not decide it.

    The region only shifts what is asked: in the article a link of its own or a block without stop words stays open.
    """
    size, main = len(text), block.region == MAIN
    other = False
    if not text.isascii():
        size += 2 * len(DENSE.findall(text))
        letters = sum(map(len, LETTERS.findall(text)))
        other = 2 * sum(map(len, LATIN.findall(text))) < letters  # a script that the stop words do not speak of
    if block.linked > LINKED * max(1, sum(map(len, block.pieces))):
        return BAD if not main or block.item or block.links > 1 else OPEN
    if size < SHORT:
        return OPEN
    if other:
        return GOOD
    words = [w.lower() for w in LETTERS.findall(text)]
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOP_HIGH:
        return GOOD
    if stops < STOP_LOW:
        return OPEN if main else BAD if size < LONG else GOOD
    return GOOD if size >= LONG or main else OPEN


def _nearest(labels: list[int], order: Iterable[int]) -> list[tuple[int, int] | None]:
    """For each block, in ``order``, the last decided one before it: its place and label."""
    found: list[tuple[int, int] | None] = [None] * len(labels)
    last = None
    for i in order:
        found[i] = last
        if labels[i] != OPEN:
            last = (i, labels[i])
    return found


def _inherited(i: int, before: tuple[int, int] | None, after: tuple[int, int] | None, main: bool, heading: bool) -> int:
    """Second pass: an open block takes the label of the nearest decided neighbour, on a tie of main text.

    A heading belongs to what follows it. In the article an open block is main text unless decided lists of links enclose it.
    """
    sides = [x for x in (after, before) if x]
    if not sides:
        return GOOD
    if main:
        enclosed = all(label == BAD for _, label in sides) and (len(sides) == 2 or not heading)
        return BAD if enclosed else GOOD
    if heading and after and after[1] == GOOD:
        return GOOD
    return min(sides, key=lambda x: (abs(x[0] - i), -x[1]))[1]


def _undoubted(found: list[tuple[_Block, str]], labels: list[int]) -> list[bool]:
    """Whether each block lies in no doubtful element, save in one that holds most of the page's running text while no running text of an article lies outside it."""
    total, inside, articles, article = 0, {}, {}, 0
    for (b, t), label in zip(found, labels, strict=True):
        if label != GOOD and b.doubts:
            inside.setdefault(b.doubts[-1], 0)
        if label == GOOD:
            total += len(t)
            article += len(t) if b.region == MAIN else 0
            for d in b.doubts:
                inside[d] = inside.get(d, 0) + len(t)
                articles[d] = articles.get(d, 0) + (len(t) if b.region == MAIN else 0)
    kept = {d for d, n in inside.items() if 2 * n > total and article == articles.get(d, 0)}
    return [all(d in kept for d in b.doubts) for b, _ in found]


def extract(html: str | None) -> str:
    """The main text of a page: its article's blocks, each on one line.

    Blocks are labelled by density and neighbours. Parts whose names say that they are beside the main text drop out, unless no
    other part holds any. Where a named article holds most of the running text, only its blocks are main text; a named
    article that does not (a card, say) is read like the rest. Forms and parts with a barred word among the words of their name drop out unless they hold
    most of the running text. Blocks in scripts that the stop words do not cover are decided by length and links alone. Null and empty pages give an empty text, equal pages equal texts. Markup may
    be broken or cut off anywhere: open elements end with the page. Very long pages are read in one pass, a block at a time.
    """
    found = [(b, text) for b in blocks(html or "") if b.region != BARRED and (text := " ".join(unescape("".join(b.pieces)).split()))]
    labels = [_decided(b, text) for b, text in found]
    if any(b.doubts for b, _ in found):
        clear = _undoubted(found, labels)
        found, labels = [x for x, c in zip(found, clear, strict=True) if c], [x for x, c in zip(labels, clear, strict=True) if c]
    if GOOD not in labels:  # words say nothing here: what is no list of links and not short is running text
        labels = [GOOD if label == BAD and len(t) >= SHORT and 2 * b.linked <= sum(map(len, b.pieces)) else label for (b, t), label in zip(found, labels, strict=True)]
    running = lambda keep: sum(len(t) for (b, t), label in zip(found, labels, strict=True) if label == GOOD and keep(b.region))
    sides = any(b.region == SIDE for b, _ in found) and not running(lambda r: r >= PLAIN) and running(lambda r: r == SIDE) > 0
    named = running(lambda r: r == MAIN)
    total = running(lambda r: r >= PLAIN)
    if any(b.region == MAIN for b, _ in found) and (2 * named >= total):
        wanted = {MAIN}
    else:
        wanted = {MAIN, PLAIN}
    if sides and not any(b.region == MAIN for b, _ in found):
        wanted = {MAIN, PLAIN, SIDE}
    kept = [(b, t, label) for (b, t), label in zip(found, labels, strict=True) if b.region in wanted]
    labels = [label for *_, label in kept]
    before, after = _nearest(labels, range(len(kept))), _nearest(labels, range(len(kept) - 1, -1, -1))
    return "\n".join(t for i, (b, t, label) in enumerate(kept) if (label if label != OPEN else _inherited(i, before[i], after[i], b.region == MAIN, b.heading)) == GOOD)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([extract(h.as_py()) for h in batch.column("html")], pa.string())], [*batch.schema.names[:-1], "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every row of ``pages``: one pass without a shuffle.

    Null html counts as empty; repeated rows are extracted each; null ids and urls are carried; extra columns are
    ignored; an empty table gives an empty result.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string")


def op3_html(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages")).selectExpr("page_id", "url", "text", "cast(length(text) as long) AS n_chars")
