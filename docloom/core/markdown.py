"""Markdown of markup, from the leaves of its tree up."""

from __future__ import annotations

import re

from collections.abc import Callable, Mapping

from docloom.core.html import BLOCKS, VOID, Node, parse, serialize, walk

# What is escaped in running text, in this order; ^ is the start of a text node.
ESCAPES = [
    (r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"),
    (r"\[", r"\\["), (r"\]", r"\\]"), (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "),
]
DEFAULTS = {"heading_style": "setext", "hr": "* * *", "bullet": "*", "code_block_style": "indented", "fence": "```", "em": "_", "strong": "**", "strike": "~", "link_style": "inlined", "link_reference_style": "full"}
#: Blank elements that say something nevertheless.
SPEAKING = frozenset("a table thead tbody tfoot th td iframe script audio video".split())


def escaped(text: str) -> str:
    for pattern, into in ESCAPES:
        text = re.sub(pattern, into, text)
    return text


def _ancestors(node: Node):
    while (node := node.parent) is not None:
        yield node


def _collapse(order: list[Node], inside: set[int]) -> None:
    """White space as browsers show it: runs are one space, none at the edges of blocks. inside: nodes in pre."""
    last: Node | None = None  # the text that ends the line so far
    space = True
    for step, node in _edges(order):
        if node.kind == "text" and step == "in":
            if id(node) in inside:
                last, space = None, False
                continue
            data = re.sub(r"[ \t\r\n\f]+", " ", node.data)
            node.data = data[1:] if space and data.startswith(" ") else data
            if node.data:
                last, space = node, node.data.endswith(" ")
        elif node.kind == "tag" and (node.name in BLOCKS or node.name == "br"):
            if last is not None and last.data.endswith(" "):
                last.data = last.data[:-1]
            last, space = None, True
        elif node.kind == "tag" and node.name in VOID and step == "in":
            last, space = None, False
    if last is not None and last.data.endswith(" "):
        last.data = last.data[:-1]


def _edges(order: list[Node]):
    """Every node as it begins, and elements again as they end."""
    if not order:
        return
    root = order[0].parent
    wait: list[tuple[str, Node]] = [("in", c) for c in reversed(root.children)]
    while wait:
        step, node = wait.pop()
        yield step, node
        if step == "in" and node.kind == "tag":
            wait.append(("out", node))
            wait.extend(("in", c) for c in reversed(node.children))


def _joined(parts: list[str]) -> str:
    """Parts one after another, with no more than two line ends between them."""
    out: list[str] = []
    ends = 0
    for part in parts:
        core = part.strip("\n")
        lead = len(part) - len(part.lstrip("\n"))
        if not core:
            ends = min(2, max(ends, lead))
            continue
        out.append("\n" * min(2, max(ends, lead)))
        out.append(core)
        ends = len(part) - len(part.rstrip("\n"))
    return "".join(out) + "\n" * min(2, ends)


def _code(text: str) -> str:
    text = re.sub(r"\r?\n|\r", " ", text)
    pad = " " if re.match(r"`|.*`$|^ .*[^ ].* $", text) else ""
    mark, runs = "`", set(re.findall("`+", text))
    while mark in runs:
        mark += "`"
    return f"{mark}{pad}{text}{pad}{mark}"


def _raw(node: Node) -> str:
    return "".join(n.data for n in walk(node) if n.kind == "text")


def _titled(address: str, title: str) -> str:
    title = re.sub(r"\s*\n\s*", "\n", title)
    return address + (f' "{title}"' if title else "")


def _table(node: Node, done: dict[int, str]) -> str | None:
    """A table whose first row is a heading row; others have no Markdown."""
    rows = [n for n in walk(node) if n.name == "tr"]
    cells = [[c for c in r.children if c.name in ("td", "th")] for r in rows]
    if not rows or not cells[0] or not (rows[0].parent.name == "thead" or all(c.name == "th" for c in cells[0])):
        return None
    lines = ["| " + " | ".join(re.sub(r"\s*\n\s*", " ", done[id(c)].strip()).replace("|", "\\|") for c in own) + " |" for own in cells if own]
    kinds = {"left": ":--", "right": "--:", "center": ":-:"}
    lines.insert(1, "| " + " | ".join(kinds.get(c.attrs.get("align", "").lower(), "---") for c in cells[0]) + " |")
    return "\n".join(lines)


def _outer(node: Node) -> str:
    """Markup of the node itself."""
    top = Node("root")
    top.children = [node]
    return serialize(top)


def to_markdown(html: str, remove: tuple[str, ...] = (), gfm: bool = False, keep: tuple[str, ...] = (), rules: Mapping[str, Callable[[str, dict[str, str]], str]] | None = None, **options: str) -> str:
    """Markdown of the markup; elements named in remove go with their content, those named in keep that have no Markdown stay as markup.

    gfm: struck text, check boxes, highlighted code and tables too. rules: for an element's name, what its content
    and attributes become, before all other rules. link_style: inlined, or referenced, with the addresses at the
    end under numbers (link_reference_style full) or the links' texts (collapsed, shortcut).
    """
    o = DEFAULTS | options
    rules = rules or {}
    root = parse(html)
    order = list(walk(root))
    links = [n for n in order if n.name == "a" and n.attrs.get("href")] if o["link_style"] == "referenced" and "a" not in rules else []
    number = {id(n): i for i, n in enumerate(links, 1)}
    references: dict[int, str] = {}
    outer = {id(n): _outer(n) for n in order if n.name in keep}
    inside: set[int] = set()
    for node in order:
        if node.name == "pre" or id(node.parent) in inside:
            inside.add(id(node))
    code = {id(n) for n in order if n.name == "code"}
    for node in order:
        if id(node.parent) in code:
            code.add(id(node))
    _collapse(order, inside)
    done: dict[int, str] = {}
    for node in reversed(order):
        if node.kind == "text":
            done[id(node)] = node.data if id(node) in code or id(node) in inside and any(a.name == "pre" and any(c.name == "code" for c in a.children) for a in _ancestors(node)) else escaped(node.data)
            continue
        if node.kind != "tag" or node.name in remove:
            done[id(node)] = ""
            continue
        content = _joined([done[id(c)] for c in node.children])
        name, block = node.name, node.name in BLOCKS
        pre = name == "pre" and len(node.children) > 0 and node.children[0].name == "code"
        before = after = ""
        if not block and not pre and name not in VOID and id(node) not in inside:  # spaces at the edges of inline elements stand outside
            core = content.strip(" ")
            if core != content:
                lead = content[: len(content) - len(content.lstrip(" "))]
                before, after = (lead, content[len(lead) + len(core) :]) if core else (content, "")
                content = core
        if not content.strip() and name not in VOID and name not in SPEAKING and not pre and not any(c.name in VOID or c.name in SPEAKING for c in walk(node)):
            done[id(node)] = "\n\n" if block else before + after
            continue
        if name in rules:
            own = rules[name](content, dict(node.attrs))
        elif id(node) in number:
            own, references[id(node)] = _reference(node, content, number[id(node)], o["link_reference_style"])
        else:
            own = _rule(node, content, o, gfm, done, pre, block, outer.get(id(node)))
        done[id(node)] = before + own + after
    parts = [done[id(c)] for c in root.children]
    if references:
        parts.append("\n\n" + "\n".join(references[id(n)] for n in links if id(n) in references) + "\n\n")
    return _joined(parts).lstrip("\t\r\n").rstrip()


def _link(node: Node) -> str:
    address = node.attrs["href"].replace("(", "\\(").replace(")", "\\)")
    return _titled(address, node.attrs.get("title", "").replace('"', '\\"'))


def _reference(node: Node, content: str, number: int, style: str) -> tuple[str, str]:
    """A link by reference, and the line that says where it leads."""
    name = str(number) if style == "full" else content
    return {"full": f"[{content}][{name}]", "collapsed": f"[{content}][]", "shortcut": f"[{content}]"}[style], f"[{name}]: {_link(node)}"


def _rule(node: Node, content: str, o: dict[str, str], gfm: bool, done: dict[int, str], pre: bool, block: bool, outer: str | None = None) -> str:
    name = node.name
    if re.fullmatch("h[1-6]", name):
        level = int(name[1])
        if o["heading_style"] == "setext" and level < 3:
            return f"\n\n{content}\n{('=' if level == 1 else '-') * len(content)}\n\n"
        return f"\n\n{'#' * level} {content}\n\n"
    if name == "br":
        return "  \n"
    if name == "hr":
        return f"\n\n{o['hr']}\n\n"
    if name == "blockquote":
        return "\n\n" + re.sub("(?m)^", "> ", content.strip("\n")) + "\n\n"
    if name in ("ul", "ol"):
        up = node.parent
        elements = [c for c in up.children if c.kind == "tag"]
        return "\n" + content if up.name == "li" and elements[-1] is node else f"\n\n{content}\n\n"
    if name == "li":
        up, mark = node.parent, o["bullet"] + "   "
        items = [c for c in up.children if c.kind == "tag"]
        if up.name == "ol":
            start = up.attrs.get("start", "")
            mark = f"{(int(start) if re.fullmatch(r'-?[0-9]{1,9}', start) else 1) + items.index(node)}.  "
        body = re.sub(r"\n+$", "\n", content.lstrip("\n")).replace("\n", "\n" + " " * len(mark))
        body = body.rstrip(" ")
        return mark + body + ("\n" if items[-1] is not node and not body.endswith("\n") else "")
    if pre:
        text = _raw(node.children[0])
        if o["code_block_style"] == "indented":
            return "\n\n    " + text.replace("\n", "\n    ") + "\n\n"
        fence = o["fence"]
        for run in re.findall(f"(?m)^{re.escape(fence[0])}{{3,}}", text):
            fence = max(fence, run + fence[0], key=len)
        language = re.search(r"language-(\S+)", node.children[0].attrs.get("class", ""))
        body = text[:-1] if text.endswith("\n") else text
        return f"\n\n{fence}{language[1] if language else ''}\n{body}\n{fence}\n\n"
    if name == "a" and node.attrs.get("href"):
        return f"[{content}]({_link(node)})"
    if name in ("em", "i"):
        return o["em"] + content + o["em"] if content.strip() else ""
    if name in ("strong", "b"):
        return o["strong"] + content + o["strong"] if content.strip() else ""
    if name == "code":
        return _code(_raw(node)) if content.strip() else ""
    if name == "img":
        return f"![{node.attrs.get('alt', '')}]({_titled(node.attrs['src'], node.attrs.get('title', ''))})" if node.attrs.get("src") else ""
    if gfm and name in ("del", "s", "strike"):
        return o["strike"] + content + o["strike"]
    if gfm and name == "input" and node.attrs.get("type", "").lower() == "checkbox" and node.parent.name == "li":
        return "[x] " if "checked" in node.attrs else "[ ] "
    if gfm and name == "table" and (table := _table(node, done)) is not None:
        return f"\n\n{table}\n\n"
    if gfm and name == "div" and node.children and node.children[0].name == "pre" and (language := re.search("highlight-(?:text|source)-([a-z0-9]+)", node.attrs.get("class", ""))):
        return f"\n\n{o['fence']}{language[1]}\n{_raw(node.children[0])}\n{o['fence']}\n\n"
    if outer is not None and name != "p":
        return f"\n\n{outer}\n\n" if block else outer
    return f"\n\n{content}\n\n" if block else content
