"""Operator 5: main text of HTML pages by two-pass block rules.

A scanner cuts a page into blocks: runs of text between block-level tags, with their link
characters and their place in the page, in time linear in the page. Elements that are no article by their kind (menus, page
headers and footers, sidebars, dialogs, scripts, hidden parts; by element or ARIA role) are left out, and inside <article> or <main> a
block needs less evidence of its own. Names are only hints: a class or id whose words all speak of adverts, notices,
comments and the like (ad, cookie-notice, comment-list; not no-sidebar or share-price), and a form, mark what they hold, unless an article or main begins inside. Marked
blocks go if the page has article text elsewhere (inside an article: in it), or if the rules don't take them for article
text themselves; else the name is wrong, and the rules alone decide.

Pass 1 decides the other blocks by link density, length and the share of stop words: many links say no, a long
block with the stop words of running text says yes, a very long one without links too. All others, mostly short, stay open.
Pass 2 gives open blocks the label of the nearest decided neighbours: of both if they agree, else of the nearer
one (at equal distance: no, but inside an article yes); a heading takes the label of what follows it. Blocks that markup decides don't vote, and inside an
article only its own blocks do. Where no neighbour is decided, open blocks without links are kept.

Defined cases: null and empty pages give an empty text; unclosed elements, links too, end with their parent; only <a> with
href links; unclosed comments and scripts at the end of the page; a lone "<" is text; two <br> part blocks, one
is white space; a table row is one block. White space is what str.split() takes for it.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .common import ship, text_column

#: Fixed word lists: frequent function words of the four languages served.
STOP_WORDS = frozenset(
    """a an and are as at be by for from had has have he her his i in is it its not of on or that the their they this to was were which will with you
    der die das und in zu den ist von nicht mit es ein eine auf für im dem des sich auch als an er so dass kann sind oder wie wir bei nach aus um am
    le la les de des du un une et est en que qui dans pour pas sur au aux par plus ce il elle ne se son sa ou avec mais nous vous
    el los las y del al con se su por para no una es lo como más pero sus este esta ha o si sobre entre cuando muy sin""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page; their content is skipped unread.
RAW_TAGS = "script|style|noscript|template|textarea|select|svg|math|iframe|object|canvas|audio|video|title|noembed|noframes"
OUT_TAGS = frozenset("nav footer aside dialog menu button head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar status note".split())
#: Words of a class or id that name no part of an article.
OUT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement adsense sponsor sponsored promo promos promotion banner nav navbar navigation menu breadcrumb
    breadcrumbs sidebar side rail footer foot masthead topbar cookie cookies consent gdpr notice notices alert alerts warning newsletter subscribe
    subscription share sharing social related recommended recommendations teaser comment comments commentlist reply replies respond disqus discussion popup
    modal overlay login signin signup register search widget widgets toolbar pagination pager tagcloud skip copyright disclaimer paywall outbrain taboola""".split()
)
#: Words that say nothing beside those.
SHAPE_WORDS = frozenset("area bar block box button buttons card column container content form group holder info inner item items left link links list message outer panel right row section slot text top bottom unit wrap wrapper".split())

TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <(?P<raw>{RAW_TAGS})\b(?:[^>"']|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)> | <(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    article: bool
    heading: bool = False
    marked: int = 0
    label: bool | None = None


@dataclass
class Open:
    """An open element, with what holds for the text in it."""

    tag: str
    out: bool  # left out by its kind
    marked: int  # the outermost element around whose name speaks against it; 0: none
    article: bool
    nested: int  # block elements around, with itself
    menus: int  # open menus and page headers
    links: bool  # an <a href> that goes on


NO_ELEMENT = Open("", False, 0, False, 0, 0, False)


def hints(tag: str, attrs: str) -> tuple[bool, bool]:
    """(left out by its kind, marked by a name) of a start tag."""
    if tag in OUT_TAGS:
        return True, False
    marked = tag == "form"
    if not attrs or tag in ("html", "body", "main", "article"):
        return False, marked
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, marked
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, marked
        if name in ("class", "id"):
            marked = marked or any(speaks_against(token) for token in value.split())
    return False, marked


def speaks_against(token: str) -> bool:
    """Some word of a class token names no part of an article, and no word says anything else."""
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    return any(w in OUT_WORDS for w in words) and all(w in OUT_WORDS or w in SHAPE_WORDS for w in words)


def blocks(page: str) -> list[Block]:
    found: list[Block] = []
    stack: list[Open] = []
    places: dict[str, list[int]] = defaultdict(list)  # where each tag is open
    text: list[str] = []
    linked = links = breaks = marks = 0

    def end_block() -> None:
        nonlocal linked, breaks
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            here = stack[-1] if stack else NO_ELEMENT
            heading = any(len(s.tag) == 2 and s.tag[0] == "h" and s.tag[1] in "123456" for s in stack[-2:])
            found.append(Block(joined, min(linked, len(joined)), here.out, here.article, heading, here.marked))
        linked = breaks = 0

    def take(piece: str) -> None:
        nonlocal linked, breaks
        piece = html.unescape(piece) if "&" in piece else piece
        if piece.strip():
            breaks = 0
            if links:
                linked += len(" ".join(piece.split()))
        text.append(piece)

    def shut(place: int) -> None:
        nonlocal links
        while len(stack) > place:
            gone = stack.pop()
            places[gone.tag].pop()
            links -= gone.links

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            text.append(" ")
            breaks += 1
            if breaks == 2:
                end_block()
            continue
        if tag in ("td", "th"):
            text.append(" ")
        if tag in BLOCK_TAGS:
            end_block()
        if closing:
            if places[tag]:
                place = places[tag][-1]
                if tag not in BLOCK_TAGS and stack[-1].nested > (stack[place - 1].nested if place else 0):
                    links -= stack[place].links  # an inline end tag ends no block element, but its link
                    stack[place].links = False
                    continue
                if (stack[place].out or stack[place].marked) and tag not in BLOCK_TAGS:
                    end_block()
                shut(place)
            continue
        if tag in VOID_TAGS or attrs.endswith("/"):
            continue
        if tag in ("p", "li", "tr", "dt", "dd", "option") and places[tag] and places[tag][-1] >= len(stack) - 3:
            if not any(s.tag in ("ul", "ol", "table", "div", "section", "article", "dl") for s in stack[places[tag][-1] :]):
                shut(places[tag][-1])
        if tag == "a" and places["a"] and stack[places["a"][-1]].nested == stack[-1].nested:
            shut(places["a"][-1])  # links don't nest
        if tag in ("article", "main"):  # a menu or page header that was never closed does not hold the article
            while stack and stack[-1].out and stack[-1].menus:
                shut(len(stack) - 1)
        here = stack[-1] if stack else NO_ELEMENT
        out, marked = hints(tag, attrs)
        out = out or tag == "header" and not here.article
        if (out or marked) and tag not in BLOCK_TAGS:
            end_block()
        article = tag in ("article", "main") and not (out or here.out)
        linking = tag == "a" and any(name.lower() == "href" for name, *_ in ATTRIBUTE.findall(attrs))
        links += linking
        marks += marked
        mark = 0 if article else here.marked or marks * marked
        places[tag].append(len(stack))
        stack.append(Open(tag, out or here.out, mark, here.article or article, here.nested + (tag in BLOCK_TAGS), here.menus + (tag in ("nav", "header", "head")), linking))
    if at < len(page):
        take(page[at:])
    end_block()
    return found


#: Pass 1, inside an article and elsewhere: link density from which a block is none of it; (length, share of stop words) from
#: which a block is; length from which one without links is.
INSIDE = (0.6, ((80, 0.2), (250, 0.12)), 600)
ELSEWHERE = (0.33, ((200, 0.3), (400, 0.15)), 300)


def decided(block: Block) -> bool | None:
    """Pass 1: True for text of the article, False for other text, None if the block tells too little. Marks are weighed later."""
    if block.out:
        return False
    n = len(block.text)
    density = block.linked / n
    dense, wordy, long = INSIDE if block.article else ELSEWHERE
    if density > dense and n < 400 or density > 0.8 or not block.article and 0 < block.linked and n < 70:
        return False
    tokens = [t.strip(".,;:!?()[]\"'*#$%&|").lower() for t in block.text.split()]
    stops = sum(t in STOP_WORDS for t in tokens) / len(tokens)
    if any(n >= length and stops >= share for length, share in wordy):
        return density <= dense
    return True if n > long and density < 0.05 else None


def weigh_marks(found: list[Block]) -> None:
    """Marked blocks go; but of a marked element that holds all that the rules take for article text, the name was wrong."""
    plain = [b for b in found if not b.out and not b.marked]
    inside, anywhere = any(b.label and b.article for b in plain), any(b.label or b.article for b in plain)
    wrong = {b.marked for b in found if b.label and not b.out and not (inside if b.article else anywhere)}
    for b in found:
        if b.marked and not b.out:
            if b.marked in wrong:
                b.marked = 0
            else:
                b.label, b.out = False, True


def nearest(found: list[Block], speaks) -> list[tuple[int | None, int | None]]:
    """For each block the nearest decided ones before and after it, among those that speak."""
    out: list[list[int | None]] = [[None, None] for _ in found]
    for side, order in ((0, range(len(found))), (1, range(len(found) - 1, -1, -1))):
        last = None
        for i in order:
            out[i][side] = last
            if found[i].label is not None and speaks(found[i]):
                last = i
    return [(a, b) for a, b in out]


def settle(found: list[Block]) -> None:
    """Pass 2: open blocks inherit."""
    everywhere, within = nearest(found, lambda b: not b.out), nearest(found, lambda b: b.article and not b.out)
    labels = [b.label for b in found]
    for i, b in enumerate(found):
        if b.label is not None:
            continue
        left, right = (within if b.article else everywhere)[i]
        if b.heading and right is not None:  # a heading belongs to what follows
            b.label = labels[right]
        elif left is not None and right is not None:
            nearer = left if i - left < right - i else right
            tied = labels[left] or labels[right] if b.article else labels[left] and labels[right]
            b.label = tied if i - left == right - i else labels[nearer]
        elif left is not None or right is not None:
            b.label = labels[right if left is None else left]
        else:
            b.label = not b.linked


def extract(page: str | None) -> str:
    """The main text: kept blocks in page order, joined by newlines."""
    if not page:
        return ""
    found = blocks(page)
    for b in found:
        b.label = decided(b)
    weigh_marks(found)
    settle(found)
    return "\n".join(b.text for b in found if b.label)


def main_text(page: Column) -> Column:
    """Main text of a column of pages, as an Arrow UDF."""

    @F.arrow_udf("string")
    def html_text(column: pa.Array) -> pa.Array:
        return pa.array([extract(p) for p in text_column(column).to_pylist()], pa.string())

    return html_text(page)


ship(__name__)
