"""Main text of web pages by block rules in two passes."""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoteloom.llm.base import map_batches
from quoteloom.llm.quality import STOP_WORDS

#: Blocks of at least LONG characters and STOPS_HIGH of stop words are content, those of at most SHORT ambiguous.
SHORT, LONG, STOPS_LOW, STOPS_HIGH, LINKS_HIGH = 70, 200, 0.08, 0.15, 0.3

BLOCK = frozenset((
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot "
    "th thead title tr ul").split())
#: Elements whose content is never text, up to their end tag.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas select title".split())
#: Elements whose blocks are never the article's, and words of a class, id or role that say the same.
OUTSIDE = frozenset("head nav footer aside form button menu dialog label fieldset".split())
OUTSIDE_WORDS = frozenset((
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice gdpr popup modal overlay newsletter subscribe "
    "subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead comment comments discussion disqus respond replies reply "
    "related recommended share sharing social widget toolbar pagination pager copyright contentinfo complementary search").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INSIDE = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one of the same kind.
_SELF_ENDING = frozenset("p li dt dd tr td th option".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_STOPS = frozenset(STOP_WORDS)


def _outside(name: str, attributes: str) -> bool:
    if name in OUTSIDE:
        return True
    if "=" not in attributes or name in ("html", "body", *INSIDE):
        return False
    return any(OUTSIDE_WORDS & {w.lower() for w in _PART.findall(m[0] or m[1] or m[2])} for m in _NAMED.findall(attributes))


def blocks(page: str) -> list[dict]:
    """Blocks of text in page order: text, characters in links, heading, inside an article, outside of it by markup.

    Markup is read forgivingly: tags may stay open, a page may end anywhere, and a character reference may lack its semicolon.
    """
    out: list[dict] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open block elements and whether each is outside
    links = linked = heading = inside = outside = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append({"text": text, "linked": linked, "heading": heading > 0, "inside": inside > 0, "outside": outside > 0})
            parts.clear()
        linked = 0

    def close(i: int) -> None:
        nonlocal heading, inside, outside
        while len(stack) > i:
            name, is_out = stack.pop()
            heading -= name in HEADINGS
            inside -= name in INSIDE
            outside -= is_out

    while at < n:
        tag = _TAG.search(page, at)
        upto = tag.start() if tag else n
        if upto > at:
            text = html.unescape(page[at:upto])
            parts.append(text)
            if links:
                linked += len(text.strip())
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue  # comments, declarations
        ends, attributes = bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        if name in RAW:
            flush() if name in BLOCK else None
            if not ends:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)" + ("|<body(?=[\\s/>])" if name == "title" else ""), re.I).search(page, at)
                at = n if not stop else stop.start() if stop[0].lower().startswith("<body") else stop.end()
        elif name == "a":
            links = 0 if ends else 1
        elif name == "br":
            parts.append(" ")
        elif ends:
            if name in BLOCK or any(x == name for x, _ in stack):
                flush()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close(i)
                        break
                links = 0
        elif name in BLOCK or name in ("button", "label"):
            flush()
            if name == "body":
                close(0)
            links = 0 if name in ("nav", "article", "footer", "p", "div", "section") else links
            if name in _SELF_ENDING and stack and stack[-1][0] == name:
                close(len(stack) - 1)
            if name not in VOID and not attributes.rstrip().endswith("/"):
                # a header within an article holds its title, the page's own does not
                is_out = _outside(name, attributes) or (name == "header" and not inside)
                stack.append((name, is_out))
                heading += name in HEADINGS
                inside += name in INSIDE
                outside += is_out
        elif name not in VOID and _outside(name, attributes):
            flush()
            stack.append((name, True))
            outside += 1
    flush()
    return out


def first_pass(b: dict) -> str:
    """good, bad, short (ambiguous) or near (ambiguous, but of some length) by density of links and stop words and by length."""
    text = b["text"]
    words = [w.lower() for w in _WORD.findall(text)]
    stops = sum(w in _STOPS for w in words) / max(1, len(words))
    if b["outside"]:
        return "bad"
    if b["linked"] > LINKS_HIGH * len(text):
        return "bad"
    if len(text) < SHORT:
        return "short"
    if stops >= STOPS_HIGH:
        return "good" if len(text) >= LONG else "near"
    return "near" if stops >= STOPS_LOW else "short" if b["inside"] else "bad"


def classified(found: list[dict]) -> list[bool]:
    """Second pass: ambiguous blocks take the label of the nearest decided neighbours. Both sides must agree on a block of few
    characters unless it stands in the article's element, whose ambiguous blocks are content, or heads content that follows."""
    first = [first_pass(b) for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    last = None
    for i in range(n):
        before[i] = last
        last = first[i] if first[i] in ("good", "bad") else last
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = first[i] if first[i] in ("good", "bad") else last
    out = []
    for b, f, x, y in zip(found, first, before, after, strict=True):
        if f in ("good", "bad"):
            out.append(f == "good")
        elif b["inside"]:
            out.append(True)
        elif b["heading"]:
            out.append(y == "good")
        elif f == "near":
            out.append(x != "bad" or y != "bad")
        else:
            out.append(x == "good" and y == "good")
    # where the page names its article, text beside it is none of it
    if any(b["inside"] for b in found):
        out = [keep and b["inside"] for b, keep in zip(found, out, strict=True)]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b["text"] for b, keep in zip(found, classified(found), strict=True) if keep)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``text`` of every row: the article's blocks in page order, one line each.

    One pass without a shuffle over whole pages. A null or empty page gives an empty text; repeated rows give repeated rows;
    other columns are not read; an empty table gives an empty one.
    """

    def run(ids, urls, pages_):
        return ids, urls, [main_text(p) for p in pages_]

    kind = pages.schema[id_col].dataType.simpleString()
    return map_batches(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, f"id {kind}, url string, text string")
