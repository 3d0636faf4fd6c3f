"""Main text of web pages by two-pass block rules.

One scan cuts a page into blocks (runs of text between block-level tags). Pass one classifies each block by where it
stands (containers that are never main text), its length, its density of link text and of stop words: good, bad, short
or near-good. Pass two lets the undecided blocks inherit the label of the nearest decided neighbours in page order.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import pieces, release

#: Content of these elements is not text of the page.
_OPAQUE = "script|style|noscript|template|svg|iframe|object|canvas|math|head|title|textarea|select|audio|video"
#: Elements that never hold main text.
_NEVER = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "label", "fieldset"}
_MAIN = {"article", "main"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "input", "meta", "link"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Class, id and role names of elements that are not the main text: alone, and (compound) before or behind a hyphen.
_CUES = set(
    "ad ads advert advertisement adbox adsense banner sponsor sponsored promo cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets footer foot masthead topbar toolbar share sharing social follow related recommended recommendations "
    "pagination pager tags tagcloud copyright legal disclaimer skip search form complementary contentinfo dialog alertdialog".split()
)
_COMPOUND = set("ad ads advert banner sponsor promo cookie cookies consent popup modal newsletter subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer share social related".split())
_COMMENTS = set("comment comments commentlist respond replies reply disqus discussion".split())
_PARTS = re.compile("[-_]+")
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(?P<opaque>{_OPAQUE})(?=[\s/>])[^>]*>.*?(?:</(?P=opaque)\s*>|$)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.I | re.S,
)
_ATTRS = re.compile(r"(?<![\w-])(?:class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
#: Frequent words of some languages, for the density of stop words.
STOP_WORDS = frozenset(
    "the of and to in that is was for with as on by it be are from this or an at not have he his they but "
    "der die und das den mit von nicht ist ein eine sich auf für im dem zu des es er sie auch als an werden "
    "le la les des et une un dans est pour sur du que qui en par au ne pas plus ce il elle avec de "
    "el los las y del por con una para su se lo como más al no "
    "il di che non per della sono con gli i da in o os do da em um uma não para het een van dat op te zijn".split()
)
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH = 0.20, 0.30
#: With fewer stop words than this in all its longer blocks, a page is in a language that the list does not know.
STOP_KNOWN = 0.08
LINK_MOST = 0.33


#: What an element is: nothing special, never main text, so by its name alone (a cue), a header, reader comments.
_PLAIN, _HARD, _CUE, _HEADER, _TALK = range(5)


def _kind_of(value: str) -> int:
    """What the names in a class, id or role say of an element."""
    kind = _PLAIN
    for name in value.lower().split():
        parts = _PARTS.split(name.strip("-_"))
        ends = {parts[0], parts[-1]} if parts[0] not in ("no", "has", "with", "without", "is") else {parts[0]}
        if name in _COMMENTS or len(parts) > 1 and ends & _COMMENTS:
            return _TALK
        if name in _CUES or len(parts) > 1 and ends & _COMPOUND:
            kind = _CUE
        elif name == "header" or len(parts) > 1 and parts[-1] == "header":
            kind = kind or _HEADER
    return kind


class _Block:
    """Text, letters of it in links, whether it can never be main text, the elements with a cue around it, whether it
    stands in the article, whether it is a heading."""

    __slots__ = ("bad", "cues", "heading", "label", "links", "main", "text")

    def __init__(self, text, links, bad, cues, main, heading):
        self.text, self.links, self.bad, self.cues, self.main, self.heading, self.label = text, links, bad, cues, main, heading, ""


def blocks(page: str) -> list[_Block]:
    """The blocks of a page in order, with references decoded and white space made one space. Unclosed and crossed tags
    are repaired: an end tag closes everything opened inside its element, one without a start is passed over."""
    out: list[_Block] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, kind, whether it holds the article, its place in the page
    bad, cues, main, links, heading, last_break = False, (), False, 0, False, False
    parts: list[str] = []
    linked: list[str] = []

    def flush():
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(_Block(text, len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()), bad, cues, main, heading))
            parts, linked = [], []

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked.append(piece)
            if last_break and piece.strip():
                last_break = False
        at = m.end()
        name = m["name"]
        if not name:
            if m["opaque"]:
                parts.append(" ")
            continue
        name = name.lower()
        if name == "br":
            if last_break:
                flush()
            last_break = True
            parts.append(" ")
            continue
        last_break = False
        if name not in _INLINE:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            else:
                if name == "a":
                    links = 0
                continue
        elif name in _VOID:
            continue
        else:
            attrs, kind, inside = m["attrs"], _HEADER if name == "header" else _HARD if name in _NEVER else _PLAIN, name in _MAIN
            if attrs and len(attrs) > 5:
                if _HIDDEN.search(attrs):
                    kind = _HARD
                for a in _ATTRS.finditer(attrs):
                    value = a[1] or a[2] or a[3] or ""
                    if a[0][:4].lower() == "role" and value.lower() == "main":
                        inside = True
                    elif value and kind != _HARD and name not in _MAIN and name not in ("html", "body"):
                        kind = max(kind, _kind_of(value))
                    elif a[0][:8].lower() == "itemprop" and value.lower() == "articlebody":
                        inside = True
            if name in ("p", "li", "td", "th", "tr", "option", "dt", "dd"):  # closed by the next of their kind
                for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
                    if stack[i][0] not in _INLINE:
                        break
            if attrs.endswith("/") and name not in ("a", "p", "div", "span"):
                continue
            stack.append((name, kind, inside, at))
        first = next((i for i, s in enumerate(stack) if s[2]), len(stack))
        main = first < len(stack)  # a header inside an article is the article's own
        bad = any(s[1] in (_HARD, _TALK) or s[1] == _HEADER and i < first for i, s in enumerate(stack))
        cues = tuple(s[3] for s in stack if s[1] == _CUE)
        links = sum(s[0] == "a" for s in stack)
        heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-4:])
    if at < len(page):
        parts.append(page[at:])
        if links:
            linked.append(page[at:])
    flush()
    return out


def _excuse(found: list[_Block]) -> None:
    """Blocks within an element with a cue are bad, unless that one element holds most of what would be left without
    cues: a name does not outweigh the bulk of a page. Containers by tag and reader comments are never excused."""
    left = [b for b in found if not b.bad and b.links <= LINK_MOST * len(b.text)]
    left = [b for b in left if b.main] or left
    held: dict[int, int] = {}
    for b in left:
        for cue in b.cues:
            held[cue] = held.get(cue, 0) + len(b.text)
    most = sum(len(b.text) for b in left) / 2
    for b in found:
        b.bad = b.bad or any(held.get(cue, 0) <= most for cue in b.cues)


def classify(found: list[_Block]) -> None:
    """Pass one labels by position and density; pass two by neighbours. Length counts letters of wide scripts twice."""
    _excuse(found)
    size = {id(b): len(b.text) + sum(c > "\u2e7f" for c in b.text) for b in found}
    stops = {}
    for b in found:
        if not b.bad and not b.main and size[id(b)] >= LENGTH_LOW:
            words = _WORD.findall(b.text.lower())
            stops[id(b)] = sum(w in STOP_WORDS for w in words), max(1, len(words))
    known = sum(s for s, _ in stops.values()) >= STOP_KNOWN * sum(n for _, n in stops.values())
    for b in found:
        n = size[id(b)]
        density = b.links / len(b.text)
        if b.bad or density > LINK_MOST and not b.main or density > 0.9 and n < LENGTH_HIGH and not b.heading:
            b.label = "bad"
        elif b.main:
            b.label = "good"
        elif n < LENGTH_LOW:
            b.label = "bad" if b.text[:1] == "©" else "short"
        elif not known:
            b.label = "good" if n > LENGTH_HIGH else "near"
        else:
            stop = stops[id(b)][0] / stops[id(b)][1]
            b.label = "good" if stop >= STOP_HIGH and n > LENGTH_HIGH else "near" if stop >= STOP_LOW else "short" if stop >= STOP_LOW / 2 else "bad"
    decided = [b.label if b.label in ("good", "bad") else "" for b in found]
    if not any(d == "good" for d in decided):  # nothing is long enough to be sure of: the best of the rest counts
        decided = ["good" if b.label == "near" else d for b, d in zip(found, decided, strict=True)]
        if not any(d == "good" for d in decided):
            decided = ["good" if b.label == "short" and not b.links else d for b, d in zip(found, decided, strict=True)]
    before, after, last = [], [], ""
    for d in decided:
        last = d or last
        before.append(last)
    last = ""
    for d in reversed(decided):
        last = d or last
        after.append(last)
    after.reverse()
    for b, d, x, y in zip(found, decided, before, after, strict=True):
        if d:
            b.label = d
        elif b.heading:
            b.label = y or "bad"  # a heading goes with what follows
        elif b.label == "near":
            b.label = "good" if "good" in (x, y) else "bad"
        else:
            b.label = "good" if x == y == "good" else "bad"


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(re.sub("</?$", "", page))  # a tag that is cut off before its name
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` of every row with text (main text, blocks joined by one newline) and n_chars (code points).

    A page with an article or main element: its blocks outside of containers, cues and link lists. Other pages: by
    length, link density and stop-word density (a page with hardly any stop word is in a language without a list, and
    judged by the other two), then by neighbours. Character references are decoded, white space
    inside a block becomes one space. Null or empty html, and pages without main text: the empty string. Pages cut off
    anywhere are read to their end; whole pages are read, however long. Repeated rows: each its own result. Columns of
    the input named text or n_chars are left out unless the caller renames them. Runs in one scan without shuffle.
    """
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep) + ", text string, n_chars long"
    names = [*keep, "text", "n_chars"]

    def extract(batches):
        for batch in pieces(batches, len(keep)):
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=names)
        release()

    return pages.select(*keep, F.col(html_column)).mapInArrow(extract, schema)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
