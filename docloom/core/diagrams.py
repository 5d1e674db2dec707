"""Diagrams written as text: flowcharts, sequences, pies and timelines become flat elements. Nothing here recurses."""

from __future__ import annotations

import json
import re

# Fixed values, by the public diagram language: node brackets, arrows of messages with their numbers, block words.
SHAPES = [
    ("(((", ")))", "doublecircle"), ("((", "))", "circle"), ("([", "])", "stadium"), ("[[", "]]", "subroutine"), ("[(", ")]", "cylinder"), ("{{", "}}", "hexagon"),
    ("[/", "\\]", "trapezoid"), ("[\\", "/]", "inv_trapezoid"), ("[/", "/]", "lean_right"), ("[\\", "\\]", "lean_left"), ("{", "}", "diamond"), ("[", "]", "square"), ("(", ")", "round"), (">", "]", "odd"),
]
ARROWS = {"<<-->>": 34, "<<->>": 33, "-->>": 1, "->>": 0, "--x": 4, "-x": 3, "--)": 25, "-)": 24, "-->": 6, "->": 5}
BLOCKS = {"loop": (10, 11), "alt": (12, 14), "opt": (15, 16), "par": (19, 21), "rect": (22, 23), "critical": (27, 29), "break": (30, 31), "par_over": (32, 21)}
SECTIONS = {"else": ("alt", 13), "and": ("par", 20), "option": ("critical", 28)}
NOTE, ACTIVE, INACTIVE, NUMBERED = 2, 17, 18, 26
TYPES = {"sequenceDiagram": "sequence", "pie": "pie", "timeline": "timeline", "flowchart": "flowchart", "graph": "flowchart"}

_ID = re.compile(r"\w+(?:[.-](?=\w)\w+)*")
_LINK = re.compile(r"([<xo])?(--+[->xo]|==+[=>xo]|-?\.+-[>xo]?|~~~+)(?:\|([^|]*)\|)?")
_OPENING = re.compile(r"([<xo])?(?:--|==|-\.)\s")


class Diagram:
    """What was read so far: elements, and what is said of the diagram as a whole."""

    def __init__(self, kind: str):
        self.kind, self.said, self.elements = kind, {}, []

    def add(self, kind: str, name: str | None = None, text: str | None = None, **more) -> dict:
        row = dict.fromkeys(("name", "text", "source", "target", "style", "value", "parent")) | {"kind": kind, "name": name, "text": text} | more
        self.elements.append(row)
        return row

    def about(self, line: str) -> bool:
        """Whether the line says something of the whole diagram: a title, or what readers are told of it."""
        found = re.match(r"(acctitle|accdescr)\s*:\s*(.*)|title\s+(.*)", line, re.I | re.S)
        if found:
            key = {"acctitle": "acc_title", "accdescr": "acc_description"}[found[1].lower()] if found[1] else "title"
            self.said[key] = (found[2] if found[1] else found[3]).strip()
        return found is not None


def _lines(text: str) -> list[str]:
    """Lines without those of comments; a description in braces becomes one line."""
    lines = [line.strip() for line in re.sub(r"\r\n?", "\n", text).split("\n")]
    out: list[str] = []
    told: list[str] | None = None
    for line in lines:
        opened = re.match(r"accdescr\s*\{", line, re.I) if told is None else None
        if opened:
            told, line = [], line[opened.end() :]
        if told is not None:
            told.append(line.partition("}")[0])
            if "}" in line:
                out.append("accDescr: " + "\n".join(told).strip())
                told = None
        elif line and not line.startswith(("%%", "#")):
            out.append(line)
    if told is not None:
        out.append("accDescr: " + "\n".join(told).strip())
    return out


def kind_of(text: str) -> str | None:
    """The type by the first line that says something; null if it isn't known."""
    first = next(iter(_lines(text)), "")
    return TYPES.get(first.split(None, 1)[0]) if first else None


# -- flowcharts ------------------------------------------------------------------


def _node(line: str, at: int) -> tuple[str, str | None, str | None, int] | None:
    """The node that begins at a place: name, label, shape and where it ends. A label in quotes may hold brackets."""
    found = _ID.match(line, at)
    if not found:
        return None
    at, best = found.end(), None
    for begin, end, shape in SHAPES:
        if not line.startswith(begin, at) or (best and len(begin) < best[3]):
            continue
        start = at + len(begin)
        quoted = re.compile(r'\s*"([^"]*)"\s*' + re.escape(end)).match(line, start)
        stop = quoted.end() - len(end) if quoted else line.find(end, start)
        if stop >= 0 and (best is None or stop + len(end) < best[2]):
            best = (quoted[1] if quoted else line[start:stop].strip().strip('"'), shape, stop + len(end), len(begin))
    return (found[0], best[0], best[1], best[2]) if best else (found[0], None, None, at)


def _stroke(body: str, tail: str | None) -> tuple[str, int]:
    """An arrow's style, its stroke and its head, and its length."""
    head = body[-1] if body[-1] in "xo>" else ""
    stroke = "dotted" if "." in body else {"=": "thick", "~": "invisible"}.get(body[0], "normal")
    end = {"x": "arrow_cross", "o": "arrow_circle", ">": "arrow_point", "<": "arrow_point"}
    named = "arrow_cross" if "x" in (head, tail) else end.get(head or tail or "", "arrow_open") if "o" not in (head, tail) else "arrow_circle"
    length = body.count(".") if stroke == "dotted" else sum(c in "-=" for c in body.removesuffix(head) if c) - 1
    return f"{stroke} {'double_' if head and tail else ''}{named}", max(length, 1)


def _chain(d: Diagram, nodes: dict[str, dict], line: str, parent: str | None) -> list[str]:
    """The nodes and edges of one statement; what follows a part that can't be read is left out."""
    named, at = [], 0
    before: list[str] = []
    link: tuple[str, int, str] | None = None
    while True:
        group: list[str] = []
        while node := _node(line, at):
            name, label, shape, at = node
            row = nodes.get(name) or nodes.setdefault(name, d.add("node", name, name, style="round"))
            row["text"], row["style"] = row["text"] if label is None else label, shape or row["style"]
            row["parent"] = row["parent"] or parent
            group.append(name)
            more = re.compile(r"\s*&\s*").match(line, at)
            if not more:
                break
            at = more.end()
        named += group
        if link:
            for v in before:
                for w in group:
                    d.add("edge", None, link[2], source=v, target=w, style=link[0], value=float(link[1]))
        at += len(line[at:]) - len(line[at:].lstrip())
        if not group or at >= len(line):
            return named
        whole, text = _LINK.match(line, at), ""
        tail = None
        if whole is None:  # -- label -->
            opening = _OPENING.match(line, at)
            whole = _LINK.search(line, opening.end()) if opening else None
            if whole is None:
                return named
            text, tail = line[opening.end() : whole.start()], opening[1]
        else:
            text = whole[3] or ""
        link = (*_stroke(whole[2], tail or whole[1]), text.strip().strip('"'))
        before, at = group, whole.end()
        at += len(line[at:]) - len(line[at:].lstrip())


def _flowchart(d: Diagram, lines: list[str]) -> None:
    header = re.fullmatch(r"(?:graph|flowchart)(?:\s+(TB|TD|BT|RL|LR))?\s*:?\s*;?", lines[0], re.I)
    if not header:
        raise ValueError(f"bad header: {lines[0]}")
    d.said["direction"] = (header[1] or "TB").upper()
    nodes: dict[str, dict] = {}
    open_: list[tuple[str, dict, list[str]]] = []
    n = 0
    for line in (part.strip() for line in lines[1:] for part in line.partition("%%")[0].split(";")):
        word = line.split(None, 1)[0].lower() if line else ""
        if not line or word in ("style", "classdef", "class", "linkstyle", "click") or d.about(line):
            continue
        if word == "direction" and " " in line:
            if open_:
                open_[-1][1]["style"] = line.split(None, 1)[1].upper()
            else:
                d.said["direction"] = line.split(None, 1)[1].upper()
        elif word == "subgraph":
            rest = line[len(word) :].strip()
            found = re.fullmatch(r"([\w.\-]+)?\s*(?:\[(.*)\])?", rest)
            name, title = (found[1], (found[2] or found[1] or "").strip('"')) if found else (None, rest.strip('"'))
            name = name or f"subGraph{n}"
            n += 1
            open_.append((name, d.add("group", name, title or name, parent=open_[-1][0] if open_ else None), []))
        elif word == "end" and line.lower() == "end":
            if open_:
                open_.pop()
        else:
            _chain(d, nodes, line, open_[-1][0] if open_ else None)


# -- sequences -------------------------------------------------------------------


class _Sequence:
    def __init__(self, d: Diagram):
        self.d, self.actors, self.active = d, {}, {}
        self.open_: list[tuple[str, str]] = []  # word and name of open blocks
        self.created = self.destroyed = self.box = None
        self.blocks = 0

    def inside(self) -> str | None:
        return next((name for word, name in reversed(self.open_) if word != "box"), None)

    def actor(self, name: str, text: str | None = None, style: str | None = None, created: bool = False) -> None:
        held = self.actors.get(name)
        if held is None:
            self.actors[name] = self.d.add("actor", name, text or name, style=style or "participant", parent=self.box, value=1.0 if created else None)
        elif text is not None or created:
            if created:
                raise ValueError(f"a participant with the name {name} was there before")
            held["text"], held["style"] = text, style or held["style"]

    def declared(self, spec: str, created: bool = False) -> None:
        word = spec.split(None, 1)[0].lower() if spec else ""
        if word in ("participant", "actor"):
            spec = spec[len(word) :].strip()
        found = re.fullmatch(r"(.*?)\s+as\s+(.+)", spec, re.I)
        self.actor((found[1] if found else spec).strip(), found[2].strip() if found else None, "actor" if word == "actor" else "participant", created)
        if created:
            self.created = (found[1] if found else spec).strip()

    def activated(self, name: str, on: bool) -> None:
        count = self.active.get(name, 0) + (1 if on else -1)
        if count < 0:
            raise ValueError(f"an inactive participant can't be made inactive: {name}")
        self.active[name] = count
        self.d.add("activation" if on else "deactivation", name, parent=self.inside(), value=float(ACTIVE if on else INACTIVE))

    def note(self, body: str) -> None:
        where, _, text = body.partition(":")
        found = re.fullmatch(r"(left of|right of|over)\s+(.+)", where.strip(), re.I)
        if not found:
            raise ValueError(f"bad note: {body}")
        names = [x.strip() for x in found[2].split(",")] if found[1].lower() == "over" else [found[2].strip()]
        for name in names:
            self.actor(name)
        self.d.add("note", None, unwrapped(text), source=names[0], target=names[1] if len(names) > 1 else names[0], style=found[1].lower(), value=float(NOTE), parent=self.inside())

    def message(self, line: str) -> None:
        ends, _, text = line.partition(":")
        arrow = next((a for a in ARROWS if a in ends), None)
        if arrow is None:
            raise ValueError(f"not a message: {line}")
        source, _, target = (x.strip() for x in ends.partition(arrow))
        sign = target[:1] if target[:1] in ("+", "-") else ""
        target = target.removeprefix(sign).strip()
        self.actor(source)
        self.actor(target)
        if self.created and target != self.created:
            raise ValueError(f"no message creates {self.created}")
        if not self.created and self.destroyed and self.destroyed not in (source, target):
            raise ValueError(f"no message destroys {self.destroyed}")
        if self.created:
            self.created = None
        else:
            self.destroyed = None
        self.d.add("message", None, unwrapped(text), source=source, target=target, style=arrow, value=float(ARROWS[arrow]), parent=self.inside())
        if sign:
            self.activated(target if sign == "+" else source, sign == "+")

    def linked(self, word: str, rest: str) -> None:
        """Links and properties of an actor; malformed ones are left out."""
        name, _, said = (x.strip() for x in rest.partition(":"))
        if name not in self.actors:
            raise ValueError(f"no participant {name}")
        if word == "link":
            label, at, address = said.partition("@")
            pairs = {label.strip(): address.strip()} if at else {}
        else:
            try:
                pairs = json.loads(said)
            except ValueError:
                pairs = None
        for key, value in pairs.items() if isinstance(pairs, dict) else ():
            self.d.add("property" if word == "properties" else "link", key, value if isinstance(value, str) else json.dumps(value), parent=name)

    def block(self, word: str, rest: str) -> None:
        self.blocks += 1
        name = f"{word}{self.blocks}"
        if word == "box":
            if self.box:
                raise ValueError("a box in a box")
            colour = re.match(r"(?:rgba?|hsla?)\s*\([^)]*\)|#?\w+", rest)
            is_colour = bool(colour) and (colour[0][:3] in ("rgb", "hsl") and "(" in colour[0] or colour[0].startswith("#") or colour[0].isalpha())
            title = rest[colour.end() :].strip() if is_colour else rest
            self.d.add("box", name, unwrapped(title) or None, style=colour[0] if is_colour else "transparent")
            self.box = name
        else:
            self.d.add("block", name, unwrapped(rest), style=word, value=float(BLOCKS[word][0]), parent=self.inside())
        self.open_.append((word, name))

    def closed(self) -> None:
        if not self.open_:
            raise ValueError("end without a block")
        word, name = self.open_.pop()
        if word == "box":
            self.box = None
        else:
            self.d.add("block_end", name, style=word, value=float(BLOCKS[word][1]), parent=self.inside())

    def numbered(self, words: list[str]) -> None:
        off = words[:1] == ["off"]
        steps = [] if off else [float(x) for x in words[:2]]
        self.d.add("numbering", None, "off" if off else " ".join(f"{x:g}" for x in [*steps, *([1.0] if len(steps) == 1 else [])]) or None, value=float(NUMBERED))

    def line(self, line: str) -> None:
        word = re.split(r"[\s:]", line, maxsplit=1)[0].lower()
        rest = line[len(word) :].strip()
        if line.lower().startswith("title:"):
            self.d.said["title"] = rest[1:].strip()
        elif self.d.about(line):
            return
        elif word in ("participant", "actor"):
            self.declared(line)
        elif word == "create":
            self.declared(rest, created=True)
        elif word == "destroy":
            self.destroyed = rest
            self.d.add("destruction", rest, parent=self.inside())
        elif word in ("activate", "deactivate"):
            self.activated(rest, word == "activate")
        elif word == "autonumber":
            self.numbered(rest.lower().split())
        elif word == "note":
            self.note(rest)
        elif word in ("link", "links", "properties"):
            self.linked(word, rest)
        elif word in BLOCKS or word == "box":
            self.block(word, rest)
        elif word == "end":
            self.closed()
        elif word in SECTIONS and self.open_ and self.open_[-1][0].split("_")[0] == SECTIONS[word][0]:
            self.d.add("section", self.open_[-1][1], unwrapped(rest), style=word, value=float(SECTIONS[word][1]), parent=self.open_[-1][1])
        else:
            self.message(line)


def unwrapped(text: str) -> str:
    """A message without the mark that says whether it is wrapped."""
    return re.sub(r"^:?(?:no)?wrap:", "", text.strip()).strip()


def _sequence(d: Diagram, lines: list[str]) -> None:
    sequence = _Sequence(d)
    for line in (part.strip() for line in lines for part in line.split(";")):
        if line and line.lower() != "sequencediagram" and not line.startswith(("%%", "#")):
            sequence.line(line)
    if sequence.open_:
        raise ValueError(f"no end of {sequence.open_[-1][0]}")


# -- pies and timelines ------------------------------------------------------------


def _pie(d: Diagram, lines: list[str]) -> None:
    header = re.fullmatch(r"pie(?:\s+(showData))?(?:\s+title\s+(.+))?", lines[0], re.I)
    if not header:
        raise ValueError(f"bad header: {lines[0]}")
    if header[2]:
        d.said["title"] = header[2].strip()
    if header[1]:
        d.add("show_data")
    seen = set()
    for line in lines[1:]:
        if d.about(line):
            continue
        found = re.fullmatch(r'"((?:[^"\\]|\\.)*)"\s*:\s*([0-9]+(?:\.[0-9]+)?)', line)
        if not found or found[1] in ("__proto__", "constructor", "prototype"):
            raise ValueError(f"bad slice: {line}")
        label = found[1].replace('\\"', '"')
        if label not in seen:
            seen.add(label)
            d.add("slice", label, value=float(found[2]))


def _timeline(d: Diagram, lines: list[str]) -> None:
    if lines[0].split(None, 1)[0].lower() != "timeline":
        raise ValueError(f"bad header: {lines[0]}")
    section, task, n = None, None, 0
    for line in lines[1:]:
        if d.about(line):
            continue
        if line.lower().startswith("section "):
            section = line[8:].strip()
            d.add("section", section, section)
            continue
        period, *events = (x.strip() for x in re.split(r"\s*:(?:\s+|$)", line))
        if period:
            task = str(n)
            n += 1
            d.add("task", task, period, parent=section)
        for event in events:
            if event and task is not None:
                d.add("event", None, event, parent=task)


_READERS = {"flowchart": _flowchart, "sequence": _sequence, "pie": _pie, "timeline": _timeline}


def parse(text: str) -> dict:
    """A diagram: type, title, acc_title, acc_description, direction, error and elements in the order they first appear.

    Elements have kind, name, text, source, target, style, value and parent. Flowcharts: node (style: shape), edge
    (style: stroke and head, value: length), group. Sequences: actor, message (style: arrow), note, activation,
    deactivation, destruction, numbering, block, section, block_end, box, link, property; value is the number of
    the line's type, of created actors 1. Pies: slice, show_data; a label's first value counts. Timelines:
    section, task (named by its number), event. A text that is no diagram, or a malformed one, has an error and no
    elements.
    """
    kind = kind_of(text)
    d = Diagram(kind or "")
    error = None
    try:
        if kind is None:
            raise ValueError("no diagram")
        _READERS[kind](d, _lines(text))
    except ValueError as e:
        d.elements, error = [], str(e)
    return {"type": kind, **{k: d.said.get(k) for k in ("title", "acc_title", "acc_description", "direction")}, "error": error, "elements": [{"place": i, **row} for i, row in enumerate(d.elements)]}
