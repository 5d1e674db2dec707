"""News feeds: RSS and Atom as one structure."""

from __future__ import annotations

import re
from html import unescape

# What an XML text knows by name.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_PART = re.compile(r"<!\[CDATA\[(.*?)(?:\]\]>|$)|<!--.*?(?:-->|$)|<\?.*?(?:\?>|$)|<![^>]*>|<(/?)([^\s/>]+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*?)(/?)>|([^<]+|<)", re.S)
_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+)|#(\d+)|(\w+));")


def decoded(text: str) -> str:
    """Character references as XML has them; others stay."""

    def one(m: re.Match) -> str:
        return unescape(m[0]) if m[1] or m[2] else _NAMED.get(m[3], m[0])

    return _REFERENCE.sub(one, text)


def parse(source: str) -> dict | None:
    """type, title, link, description and items (title, link) of a feed; None if it is none.

    A field is the text of the first element of its name in document order, whether of the feed or of an item; an item's the
    first within it. Elements' names count as they are written. Nothing is closed but by its end tag.
    """
    texts: list[str] = []  # pieces of text in document order
    elements: list[list] = []  # name, first piece, end of pieces, element number after its last one
    stack: list[int] = []
    for m in _PART.finditer(source):
        if m[1] is not None or m[6]:
            texts.append(m[1] if m[1] is not None else decoded(m[6]))
        elif m[3] and not m[2]:
            elements.append([m[3], len(texts), len(texts), len(elements) + 1])
            if not m[5]:
                stack.append(len(elements) - 1)
        elif m[3] and m[3] in (elements[i][0] for i in stack):
            while True:
                i = stack.pop()
                elements[i][2:] = [len(texts), len(elements)]
                if elements[i][0] == m[3]:
                    break
    for i in stack:
        elements[i][2:] = [len(texts), len(elements)]

    def first(name: str, low: int = 0, high: int | None = None) -> str:
        found = next((e for e in elements[low:high] if e[0] == name), None)
        return "".join(texts[found[1] : found[2]]).strip() if found else ""

    names = {e[0] for e in elements}
    kind, entry, about = ("rss", "item", "description") if "rss" in names else ("atom", "entry", "subtitle") if "feed" in names else (None, "", "")
    if kind is None:
        return None
    items = [{"title": first("title", i + 1, e[3]), "link": first("link", i + 1, e[3])} for i, e in enumerate(elements) if e[0] == entry]
    return {"type": kind, "title": first("title"), "link": first("link"), "description": first(about), "items": items}
