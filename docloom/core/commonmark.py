"""Markdown to HTML: blocks by a stack of open containers, inlines by delimiter runs. Nothing recurses, so depth is bounded by memory alone."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import quote

# Fixed values, by the public CommonMark specification.
_HTML_BLOCK = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|meta|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
_ATTR = r"""(?:\s+[a-zA-Z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
_OPEN_TAG, _CLOSE_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTR}*\s*/?>", r"</[A-Za-z][A-Za-z0-9-]*\s*>"
_HTML_STARTS = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)), (re.compile("<!--"), re.compile("-->")), (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile("<![A-Za-z]"), re.compile(">")), (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")), (re.compile(rf"</?(?:{_HTML_BLOCK})(?:\s|/?>|$)", re.I), None), (re.compile(rf"(?:{_OPEN_TAG}|{_CLOSE_TAG})\s*$"), None),
]
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]|[^\w\s\x00-\x7f]|[\u00d7\u00f7]")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})$")
_ITEM = re.compile(r"([*+-])(?=[ \t]|$)|(\d{1,9})([.)])(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_ROW_LINE = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);")
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
_AUTOMAIL = re.compile(r"<([\w.!#$%&'*+/=?^`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>", re.A)
_INLINE_HTML = re.compile(rf"{_OPEN_TAG}|{_CLOSE_TAG}|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>")
_BARE = re.compile(r"(?:https?://|ftp://|www\.)(?:[A-Za-z0-9_-]+\.?)+[^\s<]*", re.I)
_MAIL = re.compile(r"[A-Za-z0-9._+-]+@[a-zA-Z0-9_-]+(?:\.[a-zA-Z0-9_-]*[a-zA-Z0-9])+(?![-_])")


class Token:
    """A block or an inline: its kind, what it holds, its children."""

    __slots__ = ("kind", "children", "text", "info", "parent", "open", "blank")

    def __init__(self, kind: str, parent: Token | None = None, text: str = "", **info):
        self.kind, self.children, self.text, self.info, self.parent, self.open, self.blank = kind, [], text, info, parent, True, False
        if parent is not None:
            parent.children.append(self)


def indent_of(s: str, column: int = 0) -> int:
    n = 0
    for c in s:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - (column + n) % 4
        else:
            break
    return n


def dedented(s: str, column: int, n: int) -> tuple[str, int]:
    """s without n columns of white space, and the column reached; a tab that is cut leaves spaces."""
    i = 0
    while n > 0 and i < len(s) and s[i] in " \t":
        width = 1 if s[i] == " " else 4 - column % 4
        if width > n:
            return " " * (width - n) + s[i + 1 :], column + n
        n, column, i = n - width, column + width, i + 1
    return s[i:], column


def split_cells(row: str, count: int | None = None) -> list[str]:
    """The cells of a table's row, cut at pipes before which stands an even number of backslashes; as many as `count` if given."""
    row = row.strip().removeprefix("|")
    cells, start, slashes = [], 0, 0
    for i, c in enumerate(row):
        if c == "|" and slashes % 2 == 0:
            cells.append(row[start:i])
            start = i + 1
        slashes = slashes + 1 if c == "\\" else 0
    if row[start:].strip() or not cells:
        cells.append(row[start:])
    cells = [c.strip().replace("\\|", "|") for c in cells]
    return cells if count is None else (cells + [""] * count)[:count]


class Blocks:
    """Reads lines into a tree of blocks, and gathers reference definitions."""

    def __init__(self, gfm: bool = True):
        self.gfm, self.root, self.references = gfm, Token("root"), {}
        self.tip = self.root

    def read(self, source: str) -> Token:
        source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd")
        lines = source.split("\n")
        if lines and not lines[-1]:
            lines.pop()
        for line in lines:
            self.line(line)
        self.close_until(None)
        return self.root

    def close_until(self, keep: Token | None) -> None:
        while self.tip is not None and self.tip is not keep:
            self.finish(self.tip)
            self.tip = self.tip.parent

    def finish(self, block: Token) -> None:
        block.open = False
        if block.kind == "paragraph":
            block.text = self.definitions(block.text)
            if not block.text.strip() and block.parent:
                block.parent.children.remove(block)
        elif block.kind == "code" and not block.info.get("fence"):
            block.text = re.sub(r"\n[ \t\n]*$", "", "\n" + block.text)[1:] + "\n"
        elif block.kind == "list":
            block.info["loose"] = self.is_loose(block)

    @staticmethod
    def is_loose(block: Token) -> bool:
        def ends_blank(t: Token) -> bool:
            while True:
                if t.blank:
                    return True
                if t.kind not in ("list", "item") or not t.children:
                    return False
                t = t.children[-1]

        for item in block.children:
            if item is not block.children[-1] and ends_blank(item):
                return True
            if any(ends_blank(c) for c in item.children[:-1]):
                return True
        return False

    def definitions(self, text: str) -> str:
        while text.startswith("["):
            found = _reference(text)
            if not found:
                break
            label, href, title, end = found
            self.references.setdefault(normal_label(label), (href, title))
            text = text[end:]
        return text

    def add(self, kind: str, text: str = "", **info) -> Token:
        while self.tip.kind not in ("root", "blockquote", "item", "list") or self.tip.kind == "list" and kind != "item":
            self.finish(self.tip)
            self.tip = self.tip.parent
        self.tip = Token(kind, self.tip, text, **info)
        return self.tip

    def line(self, line: str) -> None:
        rest, column, block = line, 0, self.root
        path = []
        t = self.tip
        while t is not self.root:
            path.append(t)
            t = t.parent
        last = self.root
        for block in reversed(path):
            pad = indent_of(rest, column)
            blank = not rest.strip()
            if block.kind == "blockquote":
                if pad > 3 or not rest.lstrip(" \t").startswith(">"):
                    break
                rest, column = dedented(rest, column, pad)
                rest, column = rest[1:], column + 1
                if rest[:1] in (" ", "\t"):
                    rest, column = dedented(rest, column, 1)
            elif block.kind == "item":
                if blank:
                    if not block.children:
                        break
                    rest = ""
                elif pad >= block.info["offset"]:
                    rest, column = dedented(rest, column, block.info["offset"])
                else:
                    break
            elif block.kind == "code":
                if fence := block.info.get("fence"):
                    if pad <= 3 and re.fullmatch(re.escape(fence[0]) + "{%d,}[ \\t]*" % len(fence), rest.strip()):
                        self.close_until(block.parent)
                        return
                    rest, column = dedented(rest, column, min(pad, block.info["pad"]))
                elif pad >= 4:
                    rest, column = dedented(rest, column, 4)
                elif blank:
                    rest = ""
                else:
                    break
            elif block.kind == "html":
                if block.info["end"] is None and blank:
                    break
            elif block.kind in ("paragraph", "table"):
                if blank:
                    break
            elif block.kind in ("heading", "hr"):
                break
            last = block
        matched = last
        if matched.kind in ("code", "html") and matched is self.tip:
            self.leaf(matched, rest)
            return
        container = matched if matched.kind in ("root", "blockquote", "item", "list") else matched.parent
        started = False
        paragraph = self.tip if self.tip.kind == "paragraph" else None
        while True:  # new blocks
            pad = indent_of(rest, column)
            body = rest.lstrip(" \t")
            if not body:
                break
            own = matched is paragraph and paragraph is not None  # a paragraph that goes on here
            if pad >= 4:
                if paragraph is None or started:
                    self.close_until(container)
                    rest, column = dedented(rest, column, 4)
                    self.add("code", rest + "\n")
                    return
                break
            if body[0] == ">":
                self.close_until(container)
                rest, column = dedented(rest, column, pad)
                rest, column = rest[1:], column + 1
                if rest[:1] in (" ", "\t"):
                    rest, column = dedented(rest, column, 1)
                container, started, paragraph = self.add("blockquote"), True, None
                continue
            if m := _HEADING.match(body):
                self.close_until(container)
                text = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", body[m.end() :].strip()) if body[m.end() :].strip().strip("#") else ""
                self.add("heading", text.strip(), depth=len(m[1]))
                return
            if m := _FENCE.match(body):
                fence, lang = (m[1], m[2]) if m[1] else (m[3], m[4])
                self.close_until(container)
                self.add("code", "", fence=fence, pad=pad, lang=lang.strip())
                return
            html = next((k for k, (start, _) in enumerate(_HTML_STARTS) if start.match(body)), None) if body[0] == "<" else None
            if html is not None and not (html == 6 and own):
                self.close_until(container)
                block = self.add("html", "", end=_HTML_STARTS[html][1])
                self.leaf(block, rest)
                return
            if own and (m := _SETEXT.match(body)):
                paragraph.text = self.definitions(paragraph.text)
                if paragraph.text.strip():
                    paragraph.kind, paragraph.info = "heading", {"depth": 1 if m[1][0] == "=" else 2}
                    paragraph.text = paragraph.text.strip()
                    return
            if _BREAK.match(body):
                self.close_until(container)
                self.add("hr")
                return
            if self.gfm and own and _ROW_LINE.match(body) and ("|" in body or ":" in body):
                before, _, last_line = paragraph.text.rpartition("\n")  # text may stand before the head
                head, marks = split_cells(last_line), split_cells(body)
                if len(head) == len(marks) and ("|" in last_line or len(head) == 1):
                    align = ["center" if c[0] == c[-1] == ":" and len(c) > 1 else "left" if c[0] == ":" else "right" if c[-1] == ":" else None for c in marks]
                    if before.strip():
                        paragraph.text = before
                        self.close_until(container)
                        paragraph = self.add("table")
                    paragraph.kind, paragraph.info, paragraph.text = "table", {"align": align, "head": head, "rows": []}, ""
                    return
            m = _ITEM.match(body)
            if m and not (own and (not body[m.end() :].strip() or m[2] and m[2] != "1")):
                kind = m[1] or m[3]
                self.close_until(container)
                if not (container.kind == "list" and container.info["mark"] == kind):
                    if container.kind == "list":
                        self.close_until(container.parent)
                        container = container.parent
                    container = self.add("list", mark=kind, ordered=bool(m[2]), start=int(m[2]) if m[2] else None, loose=False)
                rest, column = dedented(rest, column, pad)
                rest, column = rest[m.end() :], column + m.end()
                gap = indent_of(rest, column)
                gap = gap if 1 <= gap <= 4 and rest.strip() else 1
                rest, column = dedented(rest, column, gap)
                container, started, paragraph, matched = self.add("item", offset=pad + m.end() + gap), True, None, None
                continue
            break
        if not rest.strip():
            self.close_until(container if not (self.tip.kind == "table" and matched is self.tip) else container)
            t = self.tip
            if t.children:
                t.children[-1].blank = True
            if t.kind != "blockquote" and not (t.kind == "item" and not t.children):
                t.blank = True
            while t is not None:
                if t.kind == "item" and t is not self.tip:
                    t.blank = False
                t = t.parent
            return
        for t in path:
            t.blank = t.blank and t not in (matched, container)
        if self.tip.kind == "paragraph" and not started:
            if matched is not self.tip and self.tip.open or matched is self.tip:  # also a lazy line
                self.tip.text += "\n" + rest.strip(" \t") if not rest.endswith("  ") else "\n" + rest.lstrip(" \t")
                return
        if self.tip.kind == "table" and matched is self.tip and not started:
            self.tip.info["rows"].append(split_cells(rest, len(self.tip.info["align"])))
            return
        self.close_until(container)
        if container.kind == "list":
            self.close_until(container.parent)
        self.add("paragraph", rest.lstrip(" \t"))

    def leaf(self, block: Token, rest: str) -> None:
        block.text += rest + "\n"
        if block.kind == "html" and block.info["end"] is not None and block.info["end"].search(rest):
            self.close_until(block.parent)


def normal_label(label: str) -> str:
    return " ".join(label.split()).casefold()


_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){1,999})\]", re.S)
_TITLE = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|\((?:[^()\\]|\\.)*\)', re.S)


def _destination(text: str, at: int) -> tuple[str, int] | None:
    if text.startswith("<", at):
        m = re.compile(r"<((?:[^<>\n\\]|\\.)*)>").match(text, at)
        return (m[1], m.end()) if m else None
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and _PUNCTUATION.match(text[i + 1]):
            i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c.isspace() or ord(c) < 32:
            break
        i += 1
    return (text[at:i], i) if not depth else None


def _reference(text: str) -> tuple[str, str, str | None, int] | None:
    """A reference definition at the start of text: label, address, title, where it ends."""
    m = _LABEL.match(text)
    if not m or not m[1].strip() or not text.startswith(":", m.end()):
        return None
    at = re.compile(r"[ \t]*\n?[ \t]*").match(text, m.end() + 1).end()
    if at >= len(text) or text[at] == "\n":
        return None
    found = _destination(text, at)
    if not found or not found[0] and text[at] != "<":
        return None
    href, at = found
    line_end = re.compile(r"[ \t]*(?:\n|$)")
    gap = re.compile(r"[ \t]*\n?[ \t]*").match(text, at)
    if gap.end() > at and (t := _TITLE.match(text, gap.end())) and "\n\n" not in t[0] and (e := line_end.match(text, t.end())):
        return m[1], unescaped(href), unescaped(t[0][1:-1]), e.end()
    e = line_end.match(text, at)
    return (m[1], unescaped(href), None, e.end()) if e else None


def unescaped(text: str) -> str:
    """Backslash escapes and character references resolved."""
    return re.sub(r"\\([!-/:-@\[-`{-~])|(&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w+);)", lambda m: m[1] or unescape(m[2]), text)


class Inlines:
    """Inline tokens of one text, as a flat list of (kind, text, info) in which opening and closing marks stand in pairs."""

    def __init__(self, references: dict, gfm: bool = True, breaks: bool = False):
        self.references, self.gfm, self.breaks = references, gfm, breaks

    def read(self, text: str) -> list[list]:
        out: list[list] = []  # [kind, text, info]
        runs: list[dict] = []  # delimiter runs, by their place in out
        brackets: list[dict] = []
        at, n = 0, len(text)
        special = re.compile(r"[\\`*_\[\]!<&\n~]|(?<![A-Za-z0-9])(?:https?://|ftp://|www\.)|[A-Za-z0-9._+-]+@" if self.gfm else r"[\\`*_\[\]!<&\n]", re.I)

        def plain(s: str) -> None:
            if s:
                if out and out[-1][0] == "text" and not any(r["at"] == len(out) - 1 for r in runs[-1:]) and not any(b["at"] == len(out) - 1 for b in brackets[-1:]):
                    out[-1][1] += s
                else:
                    out.append(["text", s, None])

        no_tick: set[int] = set()
        anchors = 0  # open anchors of inline HTML
        while at < n:
            m = special.search(text, at)
            if not m:
                plain(text[at:])
                break
            plain(text[at : m.start()])
            at = m.start()
            c = text[at]
            if len(m[0]) > 1:
                inside_link = anchors > 0
                if m[0].endswith("@"):
                    got = _MAIL.match(text, at)
                    if got and not inside_link:
                        out.append(["link", "", {"href": "mailto:" + got[0], "title": None, "bare": True}])
                        out += [["text", got[0], None], ["/link", "", None]]
                        at = got.end()
                    else:
                        plain(m[0])
                        at = m.end()
                    continue
                got = _BARE.match(text, at)
                address = got[0] if got else ""
                if "]" in address and any(b["active"] for b in brackets):
                    address = address[: address.index("]")]
                address = _trimmed(address)
                if address and not inside_link:
                    href = address if not address.lower().startswith("www.") else "http://" + address
                    out.append(["link", "", {"href": href, "title": None, "bare": True}])
                    out += [["text", address, None], ["/link", "", None]]
                    at += len(address)
                else:
                    plain(m[0])
                    at = m.end()
                continue
            if c == "\\":
                if text.startswith("\n", at + 1):
                    out.append(["br", "", None])
                    at = at + 2 + len(text[at + 2 :]) - len(text[at + 2 :].lstrip(" "))
                elif at + 1 < n and re.match(r"[!-/:-@\[-`{-~]", text[at + 1]):
                    out.append(["escape", text[at + 1], None])
                    at += 2
                else:
                    plain("\\")
                    at += 1
            elif c == "`":
                run = re.compile("`+").match(text, at)[0]
                end = at + len(run)
                while len(run) not in no_tick and (t := re.compile("`+").search(text, end)):
                    if len(t[0]) == len(run):
                        body = text[at + len(run) : t.start()].replace("\n", " ")
                        if body.strip(" ") and body[0] == body[-1] == " ":
                            body = body[1:-1]
                        out.append(["codespan", body, None])
                        at = t.end()
                        break
                    end = t.end()
                else:
                    no_tick.add(len(run))
                    plain(run)
                    at += len(run)
            elif c in "*_~":
                run = re.compile(re.escape(c) + "+").match(text, at)[0]
                before, after = text[at - 1] if at else " ", text[at + len(run)] if at + len(run) < n else " "
                space_b, space_a = before.isspace(), after.isspace()
                punct_b, punct_a = (bool(_PUNCTUATION.match(x)) and not (x == "~" != c and self.gfm) for x in (before, after))
                left = not space_a and (not punct_a or space_b or punct_b)
                right = not space_b and (not punct_b or space_a or punct_a)
                if c == "_":
                    opens, closes = left and (not right or punct_b), right and (not left or punct_a)
                else:
                    opens, closes = left, right
                out.append(["text", run, None])
                if c != "~" or len(run) <= 2:
                    runs.append({"at": len(out) - 1, "char": c, "n": len(run), "first": len(run), "opens": opens, "closes": closes, "tags": [], "ends": []})
                at += len(run)
            elif c == "!" and text.startswith("[", at + 1) or c == "[":
                image = c == "!"
                out.append(["text", "![" if image else "[", None])
                brackets.append({"at": len(out) - 1, "image": image, "active": True, "after": at + 1 + image, "runs": len(runs)})
                at += 1 + image
            elif c == "]":
                at = self._close(text, at, out, runs, brackets, plain)
            elif c == "<":
                if got := _AUTOLINK.match(text, at):
                    out.append(["link", "", {"href": got[1], "title": None}])
                    out += [["text", got[1], None], ["/link", "", None]]
                    at = got.end()
                elif got := _AUTOMAIL.match(text, at):
                    out.append(["link", "", {"href": "mailto:" + got[1], "title": None}])
                    out += [["text", got[1], None], ["/link", "", None]]
                    at = got.end()
                elif got := _INLINE_HTML.match(text, at):
                    out.append(["html", got[0], None])
                    at = got.end()
                    anchors += bool(re.match(r"<a[\s>]", got[0], re.I)) - (got[0].lower().startswith("</a") and anchors > 0)
                else:
                    plain("<")
                    at += 1
            elif c == "&":
                got = _ENTITY.match(text, at)
                if got and (got[0][1] == "#" or unescape(got[0]) != got[0]):
                    out.append(["entity", got[0], None])
                    at = got.end()
                else:
                    plain("&")
                    at += 1
            elif c == "\n":
                if out and out[-1][0] == "text":
                    stripped = out[-1][1].rstrip(" ")
                    hard = len(out[-1][1]) - len(stripped) >= 2
                    out[-1][1] = stripped
                else:
                    hard = False
                if hard or self.breaks:
                    out.append(["br", "", None])
                else:
                    plain("\n")
                at += 1
                while at < n and text[at] == " ":
                    at += 1
            else:
                plain(c)
                at += 1
        self._emphasis(out, runs)
        return self._spread(out, runs)

    def _close(self, text, at, out, runs, brackets, plain) -> int:
        """At a closing bracket: a link or image if an address or a known label follows."""
        if not brackets:
            plain("]")
            return at + 1
        opener = brackets.pop()
        if not opener["active"]:
            plain("]")
            return at + 1
        found = None
        if text.startswith("(", at + 1):
            i = re.compile(r"\s*").match(text, at + 2).end()
            got = _destination(text, i)
            if got:
                href, i = got
                gap = re.compile(r"\s*").match(text, i)
                title = _TITLE.match(text, gap.end()) if gap[0] else None
                j = re.compile(r"\s*").match(text, title.end()).end() if title else gap.end()
                if text.startswith(")", j):
                    found = unescaped(href), unescaped(title[0][1:-1]) if title else None, j + 1
        if not found:
            label, end = text[opener["after"] : at], at + 1
            m = _LABEL.match(text, at + 1)
            if m and m[1].strip():
                label, end = m[1], m.end()
            elif text.startswith("[]", at + 1):
                end = at + 3
            if (held := self.references.get(normal_label(label))) and (m or not re.search(r"(?<!\\)[\[\]]", label.replace("\\\\", ""))):
                found = *held, end
        if not found:
            plain("]")
            return at + 1
        href, title, end = found
        inner = runs[opener["runs"] :]
        self._emphasis(out, inner)
        if opener["image"]:
            body = self._spread(out[opener["at"] + 1 :], [{**r, "at": r["at"] - opener["at"] - 1} for r in inner])
            del out[opener["at"] :]
            out.append(["image", plain_text(body), {"href": href, "title": title}])
            del runs[opener["runs"] :]
        else:
            for i in range(opener["at"] + 1, len(out) - 2):  # bare addresses within a link are text
                if out[i][0] == "link" and out[i][2].get("bare"):
                    out[i], out[i + 2] = ["text", "", None], ["text", "", None]
            out[opener["at"]] = ["link", "", {"href": href, "title": title}]
            out.append(["/link", "", None])
            for r in inner:
                r["opens"] = r["closes"] = False
            for b in brackets:
                b["active"] = b["active"] and b["image"]
        return end

    @staticmethod
    def _emphasis(out: list, runs: list[dict]) -> None:
        """Pairs delimiter runs, the nearest first; marks go to the runs they were taken from."""
        open_: list[dict] = []
        for run in runs:
            if run["closes"]:
                while run["n"]:
                    k = len(open_) - 1
                    while k >= 0:
                        o = open_[k]
                        if o["char"] == run["char"] and o["n"]:
                            if run["char"] == "~":
                                if o["first"] == run["first"]:
                                    break
                            elif not ((o["closes"] or run["opens"]) and (o["first"] + run["first"]) % 3 == 0 and (o["first"] % 3 or run["first"] % 3)):
                                break
                        k -= 1
                    if k < 0:
                        break
                    o = open_[k]
                    del open_[k + 1 :]
                    size = o["n"] if run["char"] == "~" else 2 if o["n"] > 1 and run["n"] > 1 else 1
                    kind = "del" if run["char"] == "~" else ("em", "strong")[size - 1]
                    o["tags"].append(kind)
                    run["ends"].append("/" + kind)
                    o["n"] -= size
                    run["n"] -= size
                    if not o["n"]:
                        open_.pop()
            if run["opens"] and run["n"]:
                open_.append(run)

    @staticmethod
    def _spread(out: list, runs: list[dict]) -> list:
        """The list with the runs' marks written out."""
        by = {r["at"]: r for r in runs}
        done = []
        for i, item in enumerate(out):
            r = by.get(i)
            if r is None:
                done.append(item)
                continue
            done += [[k, "", None] for k in r["ends"]]
            if r["n"]:
                done.append(["text", r["char"] * r["n"], None])
            done += [[k, "", None] for k in reversed(r["tags"])]
        return done


def _trimmed(address: str) -> str:
    """A bare address without the punctuation that ends the sentence around it."""
    while address:
        if address[-1] in "?!.,:*_~'\"":
            address = address[:-1]
        elif address[-1] == ")" and address.count(")") > address.count("("):
            address = address[:-1]
        elif m := re.search(r"&[A-Za-z0-9]+;$", address):
            address = address[: m.start()]
        else:
            break
    return address


def plain_text(inlines: list) -> str:
    """Inline tokens without their marks."""
    return "".join(x[1] if x[0] != "br" else "\n" for x in inlines if x[0] not in ("html",))


def escaped(text: str, encode: bool = True) -> str:
    """&, <, >, and quotes as references. Without encode, references that stand in the text already stay."""
    text = text.replace("&", "&amp;") if encode else re.sub(r"&(?!(?:#\d{1,7}|#[Xx][a-fA-F0-9]{1,6}|\w+);)", "&amp;", text)
    return text.replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#39;")


def clean_url(href: str) -> str:
    """The address with what may not stand in one percent-encoded; a percent sign stays."""
    return quote(href, safe="!#$&'()*+,/:;=?@-._~%", errors="replace")


class Renderer:
    """HTML of tokens; a subclass may write any of them differently."""

    def code(self, text: str, lang: str) -> str:
        name = lang.split()[0] if lang.split() else ""
        body = escaped(text)
        return f'<pre><code class="language-{escaped(unescaped(name))}">{body}</code></pre>\n' if name else f"<pre><code>{body}</code></pre>\n"

    def heading(self, inner: str, depth: int) -> str:
        return f"<h{depth}>{inner}</h{depth}>\n"

    def hr(self) -> str:
        return "<hr>\n"

    def html(self, text: str) -> str:
        return text

    def paragraph(self, inner: str) -> str:
        return f"<p>{inner}</p>\n"

    def blockquote(self, inner: str) -> str:
        return f"<blockquote>\n{inner}</blockquote>\n"

    def list(self, inner: str, ordered: bool, start: int | None) -> str:
        name = "ol" if ordered else "ul"
        first = f' start="{start}"' if ordered and start != 1 else ""
        return f"<{name}{first}>\n{inner}</{name}>\n"

    def item(self, inner: str) -> str:
        return f"<li>{inner}</li>\n"

    def checkbox(self, checked: bool) -> str:
        return f'<input {'checked="" ' if checked else ""}disabled="" type="checkbox">'

    def table(self, head: str, body: str) -> str:
        return f"<table>\n<thead>\n{head}</thead>\n{f'<tbody>{chr(10)}{body}</tbody>{chr(10)}' if body else ''}</table>\n"

    def row(self, inner: str) -> str:
        return f"<tr>\n{inner}</tr>\n"

    def cell(self, inner: str, head: bool, align: str | None) -> str:
        name = "th" if head else "td"
        return f"<{name}{f' align={chr(34)}{align}{chr(34)}' if align else ''}>{inner}</{name}>\n"

    def mark(self, kind: str, opens: bool) -> str:
        return f"<{'' if opens else '/'}{kind}>"

    def link(self, href: str, title: str | None) -> str:
        return f'<a href="{escaped(clean_url(href), False)}"' + (f' title="{escaped(title)}"' if title else "") + ">"

    def image(self, href: str, title: str | None, text: str) -> str:
        return f'<img src="{escaped(clean_url(href), False)}" alt="{escaped(text, False)}"' + (f' title="{escaped(title)}"' if title else "") + ">"

    def codespan(self, text: str) -> str:
        return f"<code>{escaped(text)}</code>"

    def br(self) -> str:
        return "<br>"

    def text(self, text: str) -> str:
        return escaped(text)


class TextRenderer(Renderer):
    """The text of inline tokens alone."""

    def mark(self, kind: str, opens: bool) -> str:
        return ""

    def link(self, href, title) -> str:
        return ""

    def image(self, href, title, text) -> str:
        return text

    def codespan(self, text: str) -> str:
        return text

    def html(self, text: str) -> str:
        return text


def inline_html(inlines: list, renderer: Renderer) -> str:
    out = []
    for kind, text, info in inlines:
        if kind in ("text", "escape"):
            out.append(renderer.text(text))
        elif kind in ("entity", "html"):
            out.append(renderer.html(text))
        elif kind == "codespan":
            out.append(renderer.codespan(text))
        elif kind == "br":
            out.append(renderer.br())
        elif kind == "link":
            out.append(renderer.link(info["href"], info["title"]))
        elif kind == "/link":
            out.append(renderer.mark("a", False) if not isinstance(renderer, TextRenderer) else "")
        elif kind == "image":
            out.append(renderer.image(info["href"], info["title"], text))
        else:
            out.append(renderer.mark(kind.lstrip("/"), kind[0] != "/"))
    return "".join(out)


def lexed(source: str, gfm: bool = True) -> tuple[Token, dict]:
    """The tree of blocks and the reference definitions."""
    blocks = Blocks(gfm)
    return blocks.read(source), blocks.references


def to_html(source: str, gfm: bool = True, breaks: bool = False, renderer: Renderer | None = None) -> str:
    """Markdown as HTML. gfm: tables, strike-through, task lists and bare addresses; breaks: a line's end is a break."""
    renderer = renderer or Renderer()
    root, references = lexed(source, gfm)
    inlines = Inlines(references, gfm, breaks)
    inner = lambda text: inline_html(inlines.read(text), renderer)
    done: dict[int, list[str]] = {id(root): []}
    # children before their parents: blocks in reverse document order, each written in front of what follows it
    order, wait = [], [root]
    while wait:
        t = wait.pop()
        order.append(t)
        wait.extend(reversed(t.children))
    for t in reversed(order):
        below = "".join(reversed(done.pop(id(t), [])))
        if t is root:
            return below
        tight = t.parent.kind == "item" and not t.parent.parent.info["loose"]
        if t.kind == "paragraph":
            text = t.text.strip()
            box = ""
            if gfm and t.parent.kind == "item" and t is t.parent.children[0] and (m := re.match(r"\[([ xX])\][ \t\n]+(?=\S)", text)):
                box, text = renderer.checkbox(m[1] != " ") + " ", text[m.end() :]
            if tight:
                html = box + inner(text)
            else:
                html = renderer.paragraph(box + inner(text))
        elif t.kind == "heading":
            html = renderer.heading(inner(t.text), t.info["depth"])
        elif t.kind == "code":
            html = renderer.code(t.text, t.info.get("lang", ""))
        elif t.kind == "html":
            html = renderer.html(t.text)
        elif t.kind == "hr":
            html = renderer.hr()
        elif t.kind == "blockquote":
            html = renderer.blockquote(below)
        elif t.kind == "list":
            html = renderer.list(below, t.info["ordered"], t.info["start"])
        elif t.kind == "item":
            html = renderer.item(below)
        else:
            cells = lambda row, head, t=t: "".join(renderer.cell(inner(c), head, a) for c, a in zip(row, t.info["align"], strict=True))
            html = renderer.table(renderer.row(cells(t.info["head"], True)), "".join(renderer.row(cells(r, False)) for r in t.info["rows"]))
        done.setdefault(id(t.parent), []).append(html)
    return ""


def inline_to_html(source: str, gfm: bool = True, breaks: bool = False) -> str:
    return inline_html(Inlines({}, gfm, breaks).read(source), Renderer())


def to_text(source: str, gfm: bool = True) -> str:
    """The text of Markdown's inlines, a line for each block that has some."""
    root, references = lexed(source, gfm)
    inlines, out, wait = Inlines(references, gfm), [], [root]
    while wait:
        t = wait.pop()
        own = [t.text] if t.kind in ("paragraph", "heading") else [c for row in [t.info["head"], *t.info["rows"]] for c in row] if t.kind == "table" else []
        out += [inline_html(inlines.read(x.strip()), TextRenderer()) for x in own]
        if t.kind == "code":
            out.append(t.text.rstrip("\n"))
        wait.extend(reversed(t.children))
    return "\n".join(out)


def token_rows(source: str, gfm: bool = True) -> list[dict]:
    """Blocks and inlines in document order as rows: token_id (from 1), parent_id (0: none), kind, depth, text."""
    root, references = lexed(source, gfm)
    inlines, rows, wait = Inlines(references, gfm), [], [(t, 0, 1) for t in reversed(root.children)]
    while wait:
        t, parent, depth = wait.pop()
        rows.append({"token_id": len(rows) + 1, "parent_id": parent, "kind": t.kind, "depth": depth, "text": t.text})
        own = len(rows)
        if t.kind in ("paragraph", "heading"):
            open_ = [own]
            for kind, text, info in inlines.read(t.text.strip()):
                if kind[0] == "/":
                    open_.pop()
                    continue
                rows.append({"token_id": len(rows) + 1, "parent_id": open_[-1], "kind": kind, "depth": depth + len(open_), "text": info["href"] if info and kind == "link" else text})
                if kind in ("em", "strong", "del", "link"):
                    open_.append(len(rows))
        wait.extend((c, own, depth + 1) for c in reversed(t.children))
    return rows
