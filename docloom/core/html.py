"""A forgiving markup parser and what is read off its tree. Nothing here recurses, so depth is bounded by memory alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import escape
from html import unescape as _unescape
from html.entities import html5

# Fixed values, by the public HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol output p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between.
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
_SCOPE = frozenset("button td th table caption object".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


class Node:
    __slots__ = ("kind", "name", "attrs", "data", "children", "parent")

    def __init__(self, kind: str, name: str = "", attrs: dict[str, str] | None = None, data: str = "", parent: Node | None = None):
        self.kind, self.name, self.attrs, self.data, self.parent = kind, name, attrs or {}, data, parent
        self.children: list[Node] = []
        if parent is not None:
            parent.children.append(self)


_ENDED = re.compile(r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|([A-Za-z][A-Za-z0-9]*));")


def unescape_ended(text: str) -> str:
    """Decodes the references that end with a semicolon alone; `&amp` without one stays."""
    return _ENDED.sub(lambda m: _unescape(m[0]) if m[1] is None or f"{m[1]};" in html5 else m[0], text)


def parse(html: str, ended: bool = False) -> Node:
    """The root of the tree: nodes of kind root, tag, text, comment and directive. Duplicate attributes keep the first.

    ended: references without their semicolon stay as they are, which the HTML standard decodes too where they are names of old.
    """
    unescape = unescape_ended if ended else _unescape
    root = Node("root")
    open_ = [root]

    def text(data: str) -> None:
        if data:
            held = open_[-1].children
            if held and held[-1].kind == "text":
                held[-1].data += data
            else:
                Node("text", data=data, parent=open_[-1])

    def end(names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> bool:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].name in names:
                del open_[i:]
                return True
            if open_[i].name in walls:
                return False
        return False

    at, low = 0, html.lower()
    if len(low) != len(html):  # some characters change length
        low = re.sub("[A-Z]", lambda m: m[0].lower(), html)
    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text(unescape(html[at:]))
            break
        text(unescape(html[at:lt]))
        if html.startswith("<!--", lt):
            stop = html.find("-->", lt + 4)
            Node("comment", data=html[lt + 4 : stop if stop >= 0 else len(html)], parent=open_[-1])
            at = stop + 3 if stop >= 0 else len(html)
            continue
        if html.startswith(("<!", "<?"), lt) or (html.startswith("</", lt) and not html[lt + 2 : lt + 3].isalpha()):
            stop = html.find(">", lt)
            stop = stop if stop >= 0 else len(html)
            kind = "directive" if low.startswith(("<!doctype", "<?"), lt) else "comment"
            Node(kind, data=html[lt + (1 if kind == "directive" else 2) : stop], parent=open_[-1])
            at = stop + 1
            continue
        found = _TAG.match(html, lt)
        if not found:
            text("<")
            at = lt + 1
            continue
        at, name = found.end(), found[2].lower()
        if found[1]:
            if name == "br":
                Node("tag", "br", parent=open_[-1])
            elif not end({name}, set()) and name == "p":
                Node("tag", "p", parent=open_[-1])
            continue
        if name in _CLOSES_P:
            end({"p"}, _SCOPE)
        if name in _ENDS:
            gone, walls = _ENDS[name]
            while end(gone, walls):
                pass
        attrs: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(found[3]):
            value = a[2] or ""
            attrs.setdefault(a[1].lower(), unescape(value[1:-1] if value[:1] in ('"', "'") and len(value) > 1 else value))
        node = Node("tag", name, attrs, parent=open_[-1])
        if name in RAW or name in RCDATA:
            stop = low.find(f"</{name}", at)
            stop = stop if stop >= 0 else len(html)
            if stop > at:
                Node("text", data=html[at:stop] if name in RAW else unescape(html[at:stop]), parent=node)
            at = html.find(">", stop) + 1 or len(html)
        elif name not in VOID:
            open_.append(node)
    return root


def walk(root: Node) -> Iterator[Node]:
    """All nodes below root in document order."""
    wait = root.children[::-1]
    while wait:
        node = wait.pop()
        yield node
        wait.extend(reversed(node.children))


def node_rows(html: str, ended: bool = False) -> list[dict]:
    """One row for each node in document order; top-level nodes have depth 1 and parent 0; last_id is the last node below it, or its own. ended: as in parse()."""
    root = parse(html, ended)
    number, depth, place, out = {id(root): 0}, {id(root): 0}, {}, []
    for i, node in enumerate(walk(root), 1):
        key, up = id(node), id(node.parent)
        number[key], depth[key] = i, depth[up] + 1
        place[up] = place.get(up, -1) + 1
        out.append({"node_id": i, "parent_id": number[up], "last_id": i, "depth": depth[key], "pos": place[up], "kind": node.kind, "name": node.name, "attrs": list(node.attrs.items()), "data": node.data})
    for row in reversed(out):
        if row["parent_id"]:
            up = out[row["parent_id"] - 1]
            up["last_id"] = max(up["last_id"], row["last_id"])
    return out


def node_counts(html: str, ended: bool = False) -> dict:
    """How many nodes there are of each kind, and the first title's text, empty without one. ended: as in parse()."""
    out: dict = {"n_nodes": 0, "n_tag": 0, "n_text": 0, "n_comment": 0, "n_directive": 0, "title": None}
    for node in walk(parse(html, ended)):
        out["n_nodes"] += 1
        out[f"n_{node.kind}"] += 1
        if node.name == "title" and out["title"] is None:
            out["title"] = "".join(x.data for x in node.children)
    return out | {"title": out["title"] or ""}


def inner_text(node: Node, skip: frozenset[str] = frozenset({"script", "style"})) -> str:
    out, wait = [], [node]
    while wait:
        now = wait.pop()
        if now.kind == "text":
            out.append(now.data)
        elif now.name not in skip:
            wait.extend(reversed(now.children))
    return "".join(out)


def serialize(root: Node) -> str:
    """Markup of what is below root."""
    out: list[str] = []
    wait: list[Node | str] = list(reversed(root.children))
    while wait:
        node = wait.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.kind == "text":
            raw = node.parent is not None and node.parent.name in RAW
            out.append(node.data if raw else escape(node.data, quote=False))
        elif node.kind == "comment":
            out.append(f"<!--{node.data}-->")
        elif node.kind == "directive":
            out.append(f"<{node.data}>")
        else:
            out.append("<" + "".join([node.name, *(f' {k}="{escape(v)}"' for k, v in node.attrs.items())]) + ">")
            if node.name not in VOID:
                wait.append(f"</{node.name}>")
                wait.extend(reversed(node.children))
    return "".join(out)


# What sanitising leaves, and whose content goes with a forbidden element.
SAFE_TAGS = frozenset(
    "a abbr address article aside b bdi bdo blockquote br caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q s samp section small span strike strong sub summary sup table tbody td tfoot th thead time tr tt u ul var wbr".split()
)
SAFE_ATTRIBUTES = frozenset("abbr align alt border cellpadding cellspacing cite class colspan color datetime dir headers height href id lang name open rel reversed role rowspan scope span src start summary tabindex title type valign value width".split())
GONE_WITH_CONTENT = RAW | frozenset("audio embed frameset head math noscript object plaintext select svg template title textarea video".split())
SAFE_ADDRESS = re.compile(r"(?:(?:(?:f|ht)tps?|mailto|tel|callto|sms|cid|xmpp|matrix):|[^a-z]|[a-z+.\-]+(?:[^a-z+.\-:]|$))", re.I)
DATA_ADDRESS_TAGS = frozenset("audio image img source track video".split())
#: Attributes that never hold an address.
PLAIN_ATTRIBUTES = frozenset("alt class for id label name pattern placeholder role style summary title value xmlns".split())
#: Names by which an element would stand in for a property of its document or form.
CLOBBERING = frozenset(
    "attributes body childNodes children className cookie constructor createElement createTextNode currentScript defaultView document documentElement domain elements firstChild forms getElementById getElementsByTagName head hasAttributes hasChildNodes id images implementation innerHTML insertBefore lastChild length links location method nextSibling nodeName nodeType nodeValue parentNode previousSibling querySelector querySelectorAll remove removeAttribute removeChild scripts setAttribute shadowRoot submit textContent title write".split()
)
_BLANKS = re.compile(r"[\x00-\x20\xa0\u1680\u180e\u2000-\u2029\u205f\u3000]")
_SCRIPT = re.compile(r"(?:\w+script|data):", re.I)
_MARKUP = re.compile(r"--!?>|\]>|</(?:style|script|title|xmp|textarea|noscript|iframe|noembed|noframes)", re.I)
_CUSTOM = re.compile(r"[a-z][.\w]*(?:-[.\w]+)+", re.I)
_TEMPLATES = [re.compile(x, re.S) for x in (r"\{\{.*|^.*\}\}", r"<%.*|^.*%>", r"\$\{.*")]
_CANDIDATE = re.compile(r"\s*([^\s,]\S*[^\s,]|[^\s,])([^,]*)(?:,|$)")


def without_templates(text: str) -> str:
    """Template expressions ({{ }}, <% %>, ${ }) become a space, with all that follows an open one or precedes a closed one."""
    for pattern in _TEMPLATES:
        text = pattern.sub(" ", text)
    return text


def _allows(rule: str | re.Pattern | Callable | None, *what: str) -> bool:
    """Whether a rule, a pattern over the first word or a function of all, allows it."""
    return rule is not None and bool(rule(*what) if callable(rule) else re.search(rule, what[0]))


@dataclass(frozen=True)
class Policy:
    """What sanitising leaves. Names are in lower case.

    tags, attributes: what is allowed; add_* widens that (a set, or a function of the name, for attributes of name and
    element), forbid_* overrules both. Attributes named on... and srcdoc never stay. gone_with_content: forbidden elements whose content goes
    too. plain_attributes hold no address; others' values must match `address`, or be data: of elements in
    data_tags, or have any other scheme than scripts' with unknown_schemes. custom_tags, custom_attributes: a
    pattern or function for elements with a hyphen. clobbering: ids and names of document properties stay;
    prefix: ids and names get one. templates: template expressions go. markup_in_values: values that close a
    raw element or a comment stay. self_closing_values: values with /> stay. on_element(name, attributes) and
    on_attribute(element, name, value) are asked last: False drops, a string replaces a value.
    """

    tags: frozenset[str] = SAFE_TAGS
    attributes: frozenset[str] = SAFE_ATTRIBUTES
    add_tags: frozenset[str] | tuple | Callable[[str], bool] = frozenset()
    add_attributes: frozenset[str] | tuple | Callable[[str, str], bool] = frozenset()
    forbid_tags: frozenset[str] | tuple = frozenset()
    forbid_attributes: frozenset[str] | tuple = frozenset()
    keep_content: bool = True
    gone_with_content: frozenset[str] | tuple = GONE_WITH_CONTENT
    add_gone_with_content: frozenset[str] | tuple = frozenset()
    data_attributes: bool = True
    aria_attributes: bool = True
    plain_attributes: frozenset[str] | tuple = PLAIN_ATTRIBUTES
    address: str | re.Pattern = SAFE_ADDRESS
    data_tags: frozenset[str] | tuple = DATA_ADDRESS_TAGS
    unknown_schemes: bool = False
    custom_tags: str | re.Pattern | Callable[[str], bool] | None = None
    custom_attributes: str | re.Pattern | Callable[[str, str], bool] | None = None
    clobbering: bool = False
    prefix: str = ""
    templates: bool = False
    markup_in_values: bool = False
    self_closing_values: bool = True
    on_element: Callable[[str, dict[str, str]], bool | None] | None = None
    on_attribute: Callable[[str, str, str], str | bool | None] | None = None

    def allows_tag(self, name: str) -> bool:
        if name in self.forbid_tags or name in ("script", "noscript", "plaintext"):
            return False
        if name in self.tags or (self.add_tags(name) if callable(self.add_tags) else name in self.add_tags):
            return True
        return _CUSTOM.fullmatch(name) is not None and _allows(self.custom_tags, name)

    def _named(self, tag: str, name: str) -> bool:
        if name.startswith("data-"):
            return self.data_attributes and not self.templates and re.fullmatch(r"data-[\w.\u00b7-\uffff-]+", name) is not None
        if name.startswith("aria-"):
            return self.aria_attributes and re.fullmatch(r"aria-[\w-]+", name) is not None
        if name in self.attributes or (self.add_attributes(name, tag) if callable(self.add_attributes) else name in self.add_attributes):
            return True
        return _CUSTOM.fullmatch(tag) is not None and _allows(self.custom_attributes, name, tag)

    def allows_attribute(self, tag: str, name: str, value: str) -> bool:
        """Whether an attribute of that element may have that value."""
        if name in self.forbid_attributes or name.startswith("on") or name in ("srcdoc", "patchsrc") or (name == "for" and tag not in ("label", "output")):
            return False
        if not self._named(tag, name) or (name == "attributename" and value.strip().lower() == "href"):
            return False
        if not self.clobbering and not self.prefix and name in ("id", "name") and value in CLOBBERING:
            return False
        if (not self.markup_in_values and _MARKUP.search(value)) or (not self.self_closing_values and re.search(r"/\s*>", value)):
            return False
        if name == "srcset":
            return bool(self.srcset(value))
        return name in self.plain_attributes or not value or self.allows_address(tag, name, value)

    def allows_address(self, tag: str, name: str, value: str) -> bool:
        bare = _BLANKS.sub("", value)
        if re.match(self.address, bare):
            return True
        if name in ("src", "href", "xlink:href", "srcset") and bare.lower().startswith("data:") and tag in self.data_tags:
            return True
        return self.unknown_schemes and not _SCRIPT.match(bare)

    def srcset(self, value: str) -> str:
        """The candidates whose addresses are allowed."""
        return ", ".join((m[1] + m[2]).strip() for m in _CANDIDATE.finditer(value) if self.allows_address("img", "srcset", m[1]))

    def value(self, name: str, value: str) -> str:
        """What an allowed value becomes."""
        value = without_templates(value) if self.templates else value
        if self.prefix and name in ("id", "name") and not value.startswith(self.prefix):
            value = self.prefix + value
        return self.srcset(value) if name == "srcset" else value

    def kept(self, tag: str, attrs: dict[str, str], removed: list[tuple[str, str]] | None = None) -> dict[str, str]:
        out = {}
        for name, value in attrs.items():
            said = self.on_attribute(tag, name, value) if self.on_attribute is not None else None
            value = said if isinstance(said, str) else value
            if said is not False and self.allows_attribute(tag, name, value):
                out[name] = self.value(name, value)
            elif removed is not None:
                removed.append((tag, name))
        return out


def sanitize(html: str, *arguments, policy: Policy | None = None, removed: list[tuple[str, str]] | None = None, **options) -> str:
    """Markup with allowed elements, attributes and addresses alone; options are those of Policy. A forbidden element's content stays unless it can hold code or keep_content is off. removed takes what went: (element, attribute or nothing)."""
    policy = policy or Policy(*arguments, **options)
    gone = {*policy.gone_with_content, *policy.add_gone_with_content}
    root, clean = parse(html), Node("root")
    wait = [(child, clean) for child in reversed(root.children)]
    while wait:
        node, into = wait.pop()
        if node.kind == "text":
            Node("text", data=without_templates(node.data) if policy.templates else node.data, parent=into)
        elif node.kind == "tag":
            code = node.name in RAW and any("<" in child.data for child in node.children)  # a raw element could hide markup
            if policy.allows_tag(node.name) and not code and (policy.on_element is None or policy.on_element(node.name, dict(node.attrs)) is not False):
                into = Node("tag", node.name, policy.kept(node.name, node.attrs, removed), parent=into)
            else:
                if removed is not None:
                    removed.append((node.name, ""))
                if code or node.name in gone or not policy.keep_content:
                    continue
            wait.extend((child, into) for child in reversed(node.children))
    return serialize(clean)
