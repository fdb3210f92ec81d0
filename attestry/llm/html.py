"""HTML extraction by two-pass block rules.

Markup first cuts away whole regions that are not text of the article (menus, footers, adverts, forms, comments; where the
page has an article or main element, all outside it). Every block that is left goes through the rules. Pass 1 labels it from its
link density, its length and its stop-word density. Pass 2 gives blocks that are too short to tell, or neither full nor free of
stop words, the label of their nearest decided neighbours. Inside an article element the rules start from a kinder prior: its
borders count as text, and a block without links goes only where no neighbour is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import text_of

# Common function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its
    just may me more most my no not of on one only or other our out over she so some than that the their them then there these they
    this those to under up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für hat hatte ich
    ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou où par pas plus pour
    que qui sa se ses son sont sur tout un une vous
    al como con cuando del el ella en era es esta este esto fue ha hay la las lo los más mi muy no nos o para pero por que se ser si sin
    sobre su sus también todo un una y ya yo
    """.split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is never text of the page.
RAW = frozenset("script style noscript template iframe textarea select svg object head title video audio canvas noframes xmp".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog".split())
#: Their text counts as link text: alone in a block they are controls, inside a sentence they are words of it.
CONTROLS = frozenset("button label option".split())
# Names of regions that are not text, and words that only place or shape what they stand beside.
NOISE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav
    navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply respond search share sharing sidebar signup social sponsor
    sponsored subscribe subscription tags toolbar widget widgets complementary contentinfo alert""".split()
)
PLACE_WORDS = frozenset(
    """area bar block body bottom box button buttons col column container content footer form group head icons inner item items left link links list main mobile module outer page
    panel post posts primary right row secondary section site slot sticky sub top unit wrap wrapper""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LINK_DENSITY, STOP_LOW, STOP_HIGH, SHORT, LONG = 0.33, 0.15, 0.30, 70, 200

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_STRIP = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_PARTS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("content", "heading", "links", "noise", "parts", "solid")

    def __init__(self, noise: bool, content: bool, heading: bool):
        self.parts: list[str] = []
        self.links = self.solid = 0
        self.noise, self.content, self.heading = noise, content, heading

    @property
    def density(self) -> float:
        """The share of its characters, without white space, that are link text."""
        return self.links / self.solid if self.solid else 0.0


def _names_noise(value: str) -> bool:
    """Whether a whole name of a class, id or role list says noise: all of its words are noise or place, one at least noise."""
    for name in value.lower().split():
        words = _PARTS.findall(name)
        if any(w in NOISE_WORDS for w in words) and all(w in NOISE_WORDS or w in PLACE_WORDS for w in words):
            return True
    return False


def _noisy(tag: str, rest: str, inside: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    for name, a, b, c in _ATTR.findall(rest) if rest else ():
        value = a or b or c
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main") and _names_noise(value):
            return True
    return False


def blocks_of(page: str) -> list[tuple[str, Block]]:
    """(text, block) of the blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, noise, content, heading
    state = (False, False, False)
    current, links, control, at, n = None, False, False, 0, len(page)
    open_tags: Counter[str] = Counter()

    def leave() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def refresh():
        nonlocal state, current, control
        control = False  # one left open ends with its block
        state = stack[-1][1:] if stack else (False, False, False)
        current = None

    def text(piece: str):
        nonlocal current
        if not piece or (current is None and piece.isspace()):
            return
        if current is None:
            current = Block(*state)
            out.append(current)
        piece = html.unescape(piece) if "&" in piece else piece
        current.parts.append(piece)
        solid = len("".join(piece.split()))
        current.solid += solid
        if links or control:
            current.links += solid

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, closes, rest = tag.lower(), bool(m["close"] or m["close2"]), m["rest"] or m["rest2"] or ""
        if tag in RAW and not closes:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = n
        elif tag == "br":
            if current is not None:
                current.parts.append(" ")
        elif tag == "a":
            links = not closes and "href" in rest.lower()
        elif tag in CONTROLS:
            control = not closes
        elif tag in BLOCKS or (not closes and tag not in VOID and "class" in rest and _noisy(tag, rest, state[1])):
            if tag == "hr":
                current = None
            elif closes:
                if open_tags[tag]:
                    while leave() != tag:
                        pass
                refresh()
            else:
                while stack and stack[-1][0] in ("p", *HEADINGS) and tag in BLOCKS or (stack and stack[-1][0] == tag and tag in ("li", "td", "th", "dd", "dt", "tr")):
                    leave()
                noise, content, _ = stack[-1][1:] if stack else (False, False, False)
                inner = content or tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", rest))
                stack.append((tag, noise or _noisy(tag, rest, content), inner, tag in HEADINGS))
                open_tags[tag] += 1
                refresh()
        elif closes and open_tags[tag]:
            while leave() != tag:
                pass
            refresh()
    return [(t, b) for b in out if (t := " ".join("".join(b.parts).split()))]


def stop_density(text: str) -> float:
    words = [w for w in (_STRIP.sub("", w) for w in text.lower().split()) if w]
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _first_pass(text: str, block: Block) -> bool | None:
    """True for text, False for not text, None where length and densities do not tell."""
    if block.density > LINK_DENSITY:
        return None if block.content and block.density <= 0.8 else False
    if text.startswith("©") and not block.content:
        return False
    if len(text) < SHORT:
        return None
    stops = stop_density(text)
    if stops >= STOP_HIGH or (stops >= STOP_LOW and len(text) >= LONG):
        return True
    return None if stops >= STOP_LOW or block.content or not block.links else False


def labels_of(blocks: list[tuple[str, Block]]) -> list[bool]:
    """True for the blocks that are main text."""
    article = any(b.content and not b.noise for _, b in blocks)
    cut = [b.noise or (article and not b.content) for _, b in blocks]
    first = [False if gone else _first_pass(*block) for gone, block in zip(cut, blocks, strict=True)]
    if not any(first) and (unsure := [i for i, x in enumerate(first) if x is None]):
        if len(unsure) == len(first):
            return [True] * len(first)  # nothing speaks against any block
        first[max(unsure, key=lambda i: len(blocks[i][0]))] = True  # a page of short blocks only: its longest one leads
    # The nearest decided neighbours of each block; what is cut away is a border, which is text's inside an article.
    edge = article
    before: list[tuple[bool, int]] = []
    last = (edge, -1)
    for i, x in enumerate(first):
        before.append(last)
        last = last if x is None else (edge if cut[i] else x, i)
    out, nxt = [False] * len(first), (edge, len(first))
    for i in range(len(first) - 1, -1, -1):
        block = blocks[i][1]
        if first[i] is not None:
            out[i], nxt = first[i], (edge if cut[i] else first[i], i)
        elif before[i][0] == nxt[0]:
            out[i] = nxt[0]
        elif block.content and block.density <= LINK_DENSITY:
            out[i] = True
        elif block.heading:
            out[i] = nxt[0]
        else:
            back, ahead = i - before[i][1], nxt[1] - i
            out[i] = before[i][0] if back < ahead else nxt[0] if ahead < back else True
    return out


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    return "\n".join(t for (t, _), keep in zip(blocks, labels_of(blocks), strict=True) if keep)


def extract_main_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the page's main text. Null and empty pages, and pages with no main block, give the empty text.

    A column that already has the output's name is replaced; all others are kept.
    """

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return df.withColumn(out_col, run(text_of(html_col)))
