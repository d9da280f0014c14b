"""Operator 10, the main text of HTML pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block alone: blocks in navigation, headers of
the page, footers, asides, forms, notices, adverts and comments are bad by their container. Containers that are so by name
only, and forms, are no reason where they hold most of the page's text without links and every article of it (a layout that
is named for something else, a form round the whole page), but for comments; inside a paragraph, names of spans play no
part. The other blocks are decided by link density, length and the density of stop words, and what these leave open is near good or short. The second pass lets open
blocks inherit from the nearest decided neighbours: short ones from the nearer, near-good ones from the better, headings
from what follows. Inside <article> or <main> neighbours outside don't count, and a block is only bad by its own container
or links; a paragraph there that is one link and a sentence stays. Good blocks beside an article count if they hold half as much
as it does. The lists of stop words are of English, German, French and Spanish; where the page's running text has hardly any of
their words, it is in another language, and length, links and the ends of sentences decide instead; characters of scripts
without spaces between words count more.

Defined cases: null html is empty; a page without text, or without main text, gives the empty string; unclosed tags,
comments and scripts run to the end of their container or of the page; character references are decoded once, unknown ones
stay; <br> is white space, two in a row end a block; texts of any length are read whole; repeated rows give repeated
results; null page_id and url are carried along; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean

_TAG = re.compile(r"<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SPACE, _WORD = re.compile(r"\s+"), re.compile(r"[^\W\d_]+")

#: Content that is never text, up to its closing tag.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "title", "head", "select", "canvas", "audio", "video"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul button".split())
_HOLDERS = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "dt", "dd", "td", "th", "tr", "option"} | {"span", "label"}
_BAD_TAGS = {"nav", "footer", "aside", "menu", "button"}
#: Tags that a page may have round its text.
_SOFT_TAGS = {"form", "fieldset", "dialog"}
_BAD_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
_BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|widget\w*|footer\w*|masthead|topbar|toolbar"
    r"|cookie\w*|consent|gdpr|notice\w*|notification\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|search\w*|comment\w*|disqus\w*|respond|replies|reply"
    r"|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|copyright|legal|disclaimer|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_COMMENT_NAMES = re.compile(r"(?:^|[\s_-])(?:comment\w*|disqus\w*|respond|replies|reply)(?:$|[\s_-])", re.I)
#: Names that say what a page has, lacks or is, not what the container holds.
_LAYOUT_NAME = re.compile(r"(?:has|no|not|with|without|hide|show)[-_]|.*[-_](?:page|site|layout|template|theme|enabled)$", re.I)
_GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|post|post-?(?:body|content|text)|entry\w*|story\w*|main|maincontent|content)(?:$|[\s_-])", re.I)
_HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|site-?header|page-?header)(?:$|[\s_-])", re.I)

#: Frequent words of English, German, French and Spanish. Fixed values.
STOP_WORDS = frozenset(
    "the of and to in is that it was for on are as with be by at this from or an not have has had but they you he she we his her their its which were been will would can could there what who when if more about into than then them these some no so out up one all do does did"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde"
    " de la le et les des en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec ou aux cette mais comme son sa elle ses était être fait on nous vous leur deux"
    " el los las por con para del se una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso".split()
)
#: Link density from which a block is bad; lengths that are short, and long enough to decide; stop-word densities.
LINKS, ARTICLE_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 0.6, 70, 200, 0.10, 0.20
#: The share of listed words under which running text is in another language; what a character of a script without spaces counts for.
KNOWN, WIDE = 0.15, 2.5
#: Good text outside all articles, as a multiple of that inside, from which it belongs to the page's.
BESIDE = 0.5
_SENTENCE = re.compile(r"[.!?…。！？؟।]['\"»”’)\]]*(?:\s|$)|[。！？।]")
#: The share of a page's text from which a container isn't bad by its name.
MOST = 0.5
#: Blocks of running text: a span within is part of it.
_TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "figcaption", "caption", "pre", "summary", "address"}


class _Block:
    __slots__ = ("text", "linked", "tag", "bad", "area", "within", "mark")

    def __init__(self, text: str, linked: int, tag: str, bad: bool, area: int, within: int):
        self.text, self.linked, self.tag, self.bad, self.area, self.within, self.mark = text, linked, tag, bad, area, within, ""


class _Named:
    """A container that is bad by its name, or a form: the one around it, and whether it holds comments."""

    __slots__ = ("outer", "comments", "size", "areas", "bad")

    def __init__(self, outer: int, comments: bool):
        self.outer, self.comments, self.size, self.areas, self.bad = outer, comments, 0, 0, True


def bad_name(names: str) -> bool:
    """Whether a class or an id tells of something beside the main text."""
    return any(_BAD_NAMES.search(n) and not _LAYOUT_NAME.match(n) for n in names.split())


def _judge(found: list[_Block], named: list[_Named]) -> None:
    """Mark the blocks in containers that are bad by name, unless these hold most of the text and all articles."""
    for b in found:
        if not b.bad:
            named[b.within].size += len(b.text) - min(b.linked, len(b.text))
            named[b.within].areas += b.area > 0
    for n in reversed(named[1:]):  # outer ones have smaller numbers
        named[n.outer].size += n.size
        named[n.outer].areas += n.areas
    whole = named[0]
    whole.bad = False
    for n in named[1:]:
        most = n.size >= MOST * whole.size and n.areas == whole.areas and not n.comments
        n.bad = named[n.outer].bad or not most
    for b in found:
        b.bad = b.bad or named[b.within].bad


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order. `area` numbers the <article>, <main> or like container, 0 outside any."""
    found: list[_Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, bad, area, innermost named container
    named = [_Named(0, False)]
    parts: list[str] = []
    linked = in_link = areas = 0
    tag, breaks = "body", 0
    open_: dict[str, int] = {}  # open holders by name, so that an end without one costs nothing

    def flush() -> None:
        nonlocal linked, breaks
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                _, bad, area, within = stack[-1] if stack else ("", False, 0, 0)
                found.append(_Block(text, linked, tag, bad, area, within))
        parts.clear()
        linked = breaks = 0

    def say(raw: str) -> None:
        nonlocal linked, breaks
        text = html_lib.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if not text.isspace():
            breaks = 0
            if in_link:
                linked += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            if at < end:
                say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in _RAW and not closing:
            if name in ("title", "head") or not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{name}\s*>" + (r"|<body\b" if name == "head" else ""), re.I).search(page, at)
                if name == "head":
                    at = (close.start() if close and close[0][1] != "/" else close.end()) if close else at
                else:
                    at = close.end() if close else end
            if name in _BLOCK:
                flush()
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if name in _BLOCK:
            flush()
            in_link = 0 if name in _HOLDERS else in_link
            tag = "body" if closing else name
        if name in _HOLDERS and name not in _VOID:
            if closing:
                if not open_.get(name):
                    continue
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                if name not in _BLOCK and (stack[k][1] or stack[k][3]) and tag not in _TEXT_TAGS:
                    flush()  # the end of a bad inline holder ends its text
                for own, *_ in stack[k:]:
                    open_[own] -= 1
                del stack[k:]
            else:
                _, bad, area, within = stack[-1] if stack else ("", False, 0, 0)
                raw = m[3]
                attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if "=" in raw else {}
                names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
                role, new_area = attributes.get("role"), area
                by_name = bool(names) and bad_name(names)
                if name in ("article", "main") or attributes.get("itemprop") == "articleBody" or role in ("main", "article") or (names and not area and name in ("div", "section") and _GOOD_NAMES.search(names) and not by_name):
                    if not area or name == "article":
                        areas += 1
                        new_area = areas
                if name not in ("html", "body", "article", "main"):
                    own = name in _BAD_TAGS or (name == "header" and not area) or role in _BAD_ROLES or bool(names and not area and _HEADER_NAMES.search(names))
                    own = own or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I)) or bool(re.search(r"(?:^|\s)hidden(?:$|\s|=)", raw))
                    soft = name in _SOFT_TAGS or attributes.get("aria-hidden") == "true" or (by_name and (name in _BLOCK or tag not in _TEXT_TAGS))
                    if (own or soft) and not bad and name not in _BLOCK:
                        flush()
                    bad = bad or own
                    if soft:
                        named.append(_Named(within, bool(_COMMENT_NAMES.search(names))))
                        within = len(named) - 1
                elif name == "article" and names and re.search(r"comment|reply|related|promo|teaser", names, re.I):
                    bad = True
                stack.append((name, bad, new_area, within))
                open_[name] = open_.get(name, 0) + 1
    flush()
    _judge(found, named)
    return found


def _known(found: list[_Block]) -> bool:
    """Whether the page's running text, long blocks with few links, is in a language of the list: some of its words are in it."""
    words = [w for b in found if not b.bad and len(b.text) >= SHORT and b.linked <= LINKS * len(b.text) for w in _WORD.findall(b.text.lower())]
    return not words or sum(w in STOP_WORDS for w in words) >= KNOWN * len(words)


def _first_pass(b: _Block, known: bool) -> str:
    """good, bad, near or short. In a language without a list, length and links alone decide."""
    n = len(b.text)
    sentence = b.area and b.tag == "p" and _SENTENCE.search(b.text)  # a paragraph of an article that is one link
    if b.bad or (b.linked / n > (ARTICLE_LINKS if b.area else LINKS) and not sentence):
        return "bad"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if not known:
        stops = STOP_HIGH if _SENTENCE.search(b.text) else STOP_LOW
        n = n if n > LONG else int(n * WIDE) if words and _wide(b.text) else n
    if b.area:
        return "good" if n > LONG or (n >= SHORT and stops >= STOP_LOW) else "short"
    if "©" in b.text or not words:
        return "bad" if n < LONG else "short"
    if n < SHORT:
        return "bad" if b.linked else "short"
    if stops >= STOP_HIGH:
        return "good" if n > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def _wide(text: str) -> bool:
    """Whether the text is mostly in a script without spaces between words, whose characters say more than letters do."""
    return sum(c >= "\u2e80" for c in text) > len(text) / 2


def main_text(page: str | None) -> str:
    """The blocks of the main text, joined by line ends."""
    if not page:
        return ""
    found = blocks(page)
    known = _known(found)
    for b in found:
        b.mark = _first_pass(b, known)
    if not any(b.mark == "good" for b in found):  # near is as good as it gets here
        for b in found:
            b.mark = "good" if b.mark == "near" and len(b.text) > LONG else b.mark
    n = len(found)
    before: list[int] = [-1] * n  # index of the nearest decided block on either side, in the same area
    after: list[int] = [-1] * n
    for order, kept in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[int, int] = {}
        for i in order:
            kept[i] = last.get(found[i].area, -1)
            if found[i].mark in ("good", "bad"):
                last[found[i].area] = i
    whole = {b.area for b in found if b.mark == "good"} if any(b.area and b.mark == "good" for b in found) else None
    size = {inside: sum(len(b.text) for b in found if b.mark in ("good", "near") and bool(b.area) == inside) for inside in (True, False)}
    beside = 0 < BESIDE * size[True] <= size[False]
    out = []
    for i, b in enumerate(found):
        mark = b.mark
        if mark not in ("good", "bad"):
            sides = [(abs(i - j), found[j].mark) for j in (before[i], after[i]) if j >= 0]
            if b.area:  # only containers of their own make blocks in an article bad, so the links beside one don't decide
                mark = "good"
            elif not sides:
                mark = "good"
            elif b.tag[0] == "h" and b.tag[1:].isdigit() and after[i] >= 0:
                mark = found[after[i]].mark
            elif mark == "near":
                mark = "good" if beside or any(s == "good" for _, s in sides) else "bad"
            else:
                mark = min(sides, key=lambda s: (s[0], s[1] != "good"))[1]
        if mark == "good" and (b.area or not whole or beside):
            out.append(b.text)  # where an article holds good blocks, what lies outside isn't its text, unless it is most of the page's
    return "\n".join(out)


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and its code points of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return lean(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
