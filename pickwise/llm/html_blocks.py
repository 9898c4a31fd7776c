"""HTML to leaf blocks: text between block-level boundaries, with the path of open elements above it.

A small reader of tags, not a browser: raw-text elements (scripts, styles, titles, templates and text areas) give no
text, drawings and formulas are read like other elements and stand inside their line, a new paragraph or list item
closes an open one, end tags without a start are passed over, everything open at the end is closed. Character references
are decoded and white space inside a block becomes one space.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements whose content is no markup up to their end tag (of a template, none that is shown).
RAW = frozenset("script style title template textarea".split())
#: A quote opens a value only after "="; each part is taken whole, with no way back.
ATTRIBUTES = r"(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>=]|=)*+"
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][\w:-]*)({ATTRIBUTES})>|<[!?/][^>]*>", re.S)
END = {name: re.compile(rf"</{name}(?![\w:-])[^>]*>", re.I) for name in RAW}
NESTED = re.compile(rf"<(/?)template(?![\w:-]){ATTRIBUTES}>", re.S | re.I)
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Foreign elements stand inside a line, and so does all inside them but a drawing's own texts.
FOREIGN = frozenset(("svg", "math"))
DRAWN = frozenset(("text", "foreignobject", "desc", "title"))
#: Ordinary elements that close an open foreign one, as browsers have it.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset(("br", "hr"))
#: Opening one of these closes an open element of the named kinds.
CLOSES = {k: ("p",) for k in "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()} | {
    "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
#: An open element is not looked for beyond these.
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "p": ("div", "article", "section", "td", "li", "body", "blockquote")}
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*.?true", re.I)
LETTERS = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, ...], ...]  # of each open element, its tag and the words of its class, id and role
    linked: int  # characters inside links


def element(tag: str, attributes: str) -> tuple[str, ...]:
    if not attributes.strip():
        return (tag,)
    words = [w for m in NAMES.finditer(attributes) for w in LETTERS.findall((m[1] or m[2] or m[3] or "").lower())]
    if HIDDEN.search(attributes):
        words.append("hidden")
    return (tag, *words)


def after(page: str, at: int, tag: str) -> int:
    """Where the content of a raw element ends that starts at `at`; templates stand inside templates."""
    if tag != "template":
        m = END[tag].search(page, at)
        return m.end() if m else len(page)
    depth = 1
    for m in NESTED.finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(page)


def blocks(page: str | None) -> list[Block]:
    """The page's non-empty leaf blocks in order; null or empty pages have none."""
    out: list[Block] = []
    stack: list[tuple[str, ...]] = []
    text: list[str] = []
    linked = in_link = at = 0
    foreign = ""  # svg or math while inside one, outside its foreignObject
    path: tuple[tuple[str, ...], ...] = ()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, path, min(linked, len(joined))))
            text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal path, linked
        if piece:
            if not text:
                if not piece.strip():
                    return
                path = tuple(stack)
            text.append(piece)
            if in_link:
                linked += len(piece)

    def leave(keep: int) -> None:
        nonlocal in_link, foreign
        del stack[keep:]
        in_link = any(e[0] == "a" for e in stack)
        foreign = next((e[0] for e in reversed(stack) if e[0] in FOREIGN or e[0] == "foreignobject"), "")
        if foreign == "foreignobject":
            foreign = ""

    page = page or ""
    last = page.rfind(">")  # behind it no tag ends: looking for one from every "<" would take forever
    while at <= last and (m := TAG.search(page, at)):
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if foreign and tag in BREAKOUT:
            leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == foreign))
        inline = tag in INLINE or tag in FOREIGN or (foreign != "" and tag not in DRAWN)
        if tag in RAW and not m[1]:
            if tag in ("title", "template") and not foreign:
                flush()
            if not (foreign and m[3].endswith("/")):
                at = after(page, at, tag)
            continue
        if tag in BREAKS:
            if tag == "hr":
                flush()
            elif text:
                text.append(" ")
            continue
        if m[1]:
            if not inline:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    leave(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE and stack[i][0] not in FOREIGN:
                    break
            continue
        if not inline:
            flush()
            for kind in CLOSES.get(tag, ()):
                fence = FENCE.get(kind, ())
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == kind:
                        leave(i)
                        break
                    if stack[i][0] in fence:
                        break
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(element(tag, m[3]))
            in_link = in_link or tag == "a"
            if tag in FOREIGN or tag == "foreignobject":
                foreign = tag if tag in FOREIGN else ""
    rest, comment, _ = page[at:].partition("<!--")
    add(rest if at > last else page[at:])
    flush()
    return out
