"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each block by itself: link
density, length, density of stop words and the regions it stands in (menus, forms, comments, ...).
Short or middling blocks stay undecided; in the second pass they take the label of the nearest
decided neighbours. Good blocks, in page order, are the text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages handled by default (a parameter of the operator).
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this to was were which with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas plus pour qu que qui sa se son sur un une "
    "aber als am auf aus bei das dem den der des die ein eine einer es für im ist mit nicht noch oder sich sie sind und von war wie wird zu zum "
    "al como con del el es esta este ha los las lo más no para pero por se si sin su sus y".split()
)
# Tags that begin and end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video".split()
)
# Tags without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Regions that never hold main text.
BAD_REGIONS = frozenset("aside button dialog fieldset footer form head iframe menu nav option search select template textarea".split())
# Words in class, id or role that mark such regions.
BAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup print promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toc toolbar tracking widget widgets".split()
)
# Words that say nothing of what such a name's element holds.
NEUTRAL_NAMES = frozenset("area bar bars block blocks body bottom box button buttons center col column container content count dropdown entry footer group header heading icon icons inner input item items label left link links list main message module outer panel post posts primary right row secondary section site slot small text title top unit wrap wrapper".split())
MAIN_REGIONS = frozenset(["article", "main"])
# Names in class, id, role or itemprop of the region with the main text.
MAIN_NAMES = frozenset("article articlebody article-body article-content content-body entry-content main main-content maincontent post-body post-content story-body".split())
CLOSES_P = BLOCK_TAGS - frozenset(["html", "body", "head"])
# Tags whose start ends open elements without an end tag, and the elements that this doesn't reach beyond.
CELLS, ITEMS = ("td", "th"), ("dt", "dd")
IN_TABLE, IN_LIST = ("table", "template"), tuple(sorted(BLOCK_TAGS - frozenset(["address", "div", "p", *ITEMS])))
IMPLIED = {t: (CELLS, IN_TABLE) for t in CELLS} | {"tr": (("tr", *CELLS, "caption"), IN_TABLE)} | {t: (("thead", "tbody", "tfoot", "tr", *CELLS, "caption"), IN_TABLE) for t in ("thead", "tbody", "tfoot")} | {t: (ITEMS, IN_LIST) for t in ITEMS}

LINK_DENSITY, STOPS_LOW, STOPS_HIGH, SHORT, LONG = 0.33, 0.12, 0.28, 70, 200

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:(script|style|noscript|xmp|noembed)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|(svg|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<!/)>.*?(?:</\2\s*>|\Z))"  # only these may close themselves
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
NAME_PARTS = re.compile(r"[^\s]+")
PIECES = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
WIDE = re.compile("[\u0e00-\u0eff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass(slots=True)
class Block:
    text: str
    link_chars: int
    region: int  # 0: none, 1: main text, -1: never main text
    heading: bool


def _bad_name(name: str) -> bool:
    """Whether a class or id names a region without main text: its last word does (site-footer), or its first
    one with nothing to the contrary after it (share-buttons, but not share-price-news)."""
    parts = [p.lower() for p in PIECES.split(name) if p]
    if not parts:
        return False
    plain = [p.rstrip("0123456789") for p in parts]
    if plain[-1] in BAD_NAMES:
        return True
    at = next((k for k, p in enumerate(plain) if p in BAD_NAMES), None)
    return at is not None and all(not p or len(p) == 1 or p in NEUTRAL_NAMES or p in BAD_NAMES for p in plain)


def _region(tag: str, attributes: str, inside_main: bool) -> int:
    if tag in BAD_REGIONS or (tag == "header" and not inside_main):
        return -1
    if not attributes:
        return 1 if tag in MAIN_REGIONS else 0
    found = 1 if tag in MAIN_REGIONS else 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2].strip("\"'")
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
            for whole in NAME_PARTS.findall(value):
                if whole.lower() in MAIN_NAMES:
                    found = 1
                elif tag not in ("body", "html") and not (found == 1 and tag in MAIN_REGIONS) and _bad_name(whole):
                    return -1
        elif name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true":
            return -1
    if re.search(r"(?:^|\s)hidden(?:\s|/|$|=\s*[\"']{2})", re.sub(ATTRIBUTE, "", attributes)):
        return -1
    return found


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """Blocks with text, in page order, and whether some region holds the main text."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}  # where the stack has each tag
    text: list[str] = []
    link = linked = 0
    breaks = 0
    bad = main = 0
    has_main = False

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                heading = any(t[0] in "hH" and len(t) == 2 and t[1].isdigit() for t, _ in stack[-3:])
                out.append(Block(body, min(linked, len(body)), -1 if bad else (1 if main else 0), heading))
            text.clear()
        linked = 0

    def cut(to: int) -> None:
        nonlocal bad, main
        while len(stack) > to:
            t, r = stack.pop()
            places[t].pop()
            bad, main = bad - (r == -1), main - (r == 1)

    def top(tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := places.get(t))), default=-1)

    for m in TOKEN.finditer(page):
        tag = m[4] or m[7]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                text.append(piece)
                if link:
                    linked += len(piece.strip())
                if breaks and not piece.isspace():
                    breaks = 0
            continue
        tag, close, attributes = tag.lower(), m[3] or m[6], m[5] if m[4] else m[8]
        if tag == "br":
            breaks += 1
            text.append(" ")
            if breaks == 2:
                flush()
            continue
        if tag == "a":
            link = 0 if close else 1
            continue
        if tag not in BLOCK_TAGS:
            continue
        breaks = 0
        flush()
        link = 0
        if close:
            if places.get(tag):
                cut(places[tag][-1])
        elif tag not in VOID_TAGS:
            if tag in IMPLIED:
                ends, stops = IMPLIED[tag]
                bound = top(stops)
                open_ = [at[-1] for t in ends if (at := places.get(t)) and at[-1] > bound]
                if open_:
                    cut(min(open_))
            if stack and stack[-1][0] == "p" and tag in CLOSES_P or stack and tag == stack[-1][0] and tag in ("li", "option"):
                cut(len(stack) - 1)
            r = _region(tag, attributes, bool(main)) if not attributes.endswith("/") or tag == "p" else 0
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, r))
            bad, main = bad + (r == -1), main + (r == 1)
            has_main = has_main or r == 1 and not bad
    flush()
    return out, has_main


def foreign(blocks: list[Block], stops: frozenset[str]) -> bool:
    """Whether the page's own text is in a language without stop words here, so that their density says nothing."""
    words = [w.lower() for b in blocks if b.region >= 0 for w in LETTERS.findall(b.text)]
    return sum(map(len, words)) >= SHORT and sum(w in stops for w in words) < 0.02 * len(words)


def label(block: Block, has_main: bool, stops: frozenset[str], unknown: bool = False) -> int:
    """1 good, -1 bad, 0 undecided: the block by itself; in an unknown language by length alone."""
    n = len(block.text)
    if block.region == -1 or has_main and block.region == 0:
        return -1
    if block.link_chars > LINK_DENSITY * n:
        return -1
    if block.region == 0 and n < LONG and "\N{COPYRIGHT SIGN}" in block.text:
        return -1
    if unknown:  # a character of a script without blanks stands for about three
        n += 2 * len(WIDE.findall(block.text))
        return 0 if block.heading or n < SHORT else 1 if n >= LONG or block.region == 1 else 0
    if block.heading or n < SHORT:
        return 0
    words = [w.lower() for w in LETTERS.findall(block.text)]
    density = sum(w in stops for w in words) / max(1, len(words))
    if density >= STOPS_HIGH:
        return 1 if n >= LONG else 0
    if density >= STOPS_LOW:
        return 1 if block.region == 1 else 0
    return 1 if block.region == 1 and n >= LONG else 0 if block.region == 1 else -1


def extract(page: str | None, stops: frozenset[str] = STOP_WORDS) -> str:
    """Main text of a page: blocks joined by an empty line; empty if there is none.

    An undecided block takes the label of the nearest decided blocks; at equal distance it is good if
    either is and it is a heading or stands in the main region, else only if both are. Without a main
    region, the page's ends count as decided and not good. With nothing decided, blocks of a main region are good, and elsewhere those with a fair share of stop words.
    """
    if not page:
        return ""
    blocks, has_main = blocks_of(page)
    unknown = foreign(blocks, stops)
    first = [label(b, has_main, stops, unknown) for b in blocks]
    decided = [k for k, v in enumerate(first) if v]
    # Inside a main region the region's own blocks decide; menus around it don't.
    own = [k for k in decided if blocks[k].region == 1] if has_main else decided
    out, after, p = [], iter(own), -1
    nxt = next(after, None)
    for k, b in enumerate(blocks):
        while nxt is not None and nxt < k:
            p, nxt = nxt, next(after, None)
        v = first[k]
        if v == 0:
            before = first[p] if p >= 0 else 0
            following = first[nxt] if nxt is not None else 0
            if not has_main and own:  # beyond either end of a page there is no main text
                before, following = before or -1, following or -1
            if not before and not following:
                words = [w.lower() for w in LETTERS.findall(b.text)]
                v = 1 if b.region == 1 or sum(w in stops for w in words) >= STOPS_HIGH * max(1, len(words)) and len(b.text) >= SHORT else -1
            elif not before or not following:
                v = before or following
            else:
                near, far = k - p, (len(blocks) if nxt is None else nxt) - k
                either = b.heading and following == 1 or b.region == 1
                v = max(before, following) if either and near == far else min(before, following) if near == far else before if near < far else following
        if v == 1:
            out.append(b.text)
    return "\n\n".join(out)


def main_text(pages: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url"), stops: frozenset[str] = STOP_WORDS) -> DataFrame:
    """One row per row of pages: the `keep` columns, text, n_chars (code points).

    Null and empty pages, and pages without main text, have an empty text. Nothing is cut, however long
    a page is; unclosed and stray tags are tolerated; text without any markup counts as one block.
    Repeated rows stay; an empty table gives no rows.
    """
    rows = pages.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(page).alias("page"))
    out = [f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))]

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(p, stops) for p in b.column("page").to_pylist()]
            yield pa.record_batch([*[b.column(f"k{i}") for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[f"k{i}" for i in range(len(keep))], "text", "n_chars"])

    found = rows.mapInArrow(turn, ", ".join([*out, "text string", "n_chars long"]))
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "text", "n_chars")
