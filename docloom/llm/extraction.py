"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names as the HTML standard groups them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html option caption tbody td tfoot th thead tr title legend".split())
#: Elements whose start ends an open one of these kinds, looked for up to the nearest of the listed containers.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
}
SCOPES = frozenset("article aside body div footer header html main nav section table td th blockquote form ul ol dl".split())

#: Elements that are never part of an article's text.
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object embed svg math canvas audio video select button input textarea dialog menu search noembed noframes xmp title datalist map".split())
#: Of these, what a page never shows as text.
UNSHOWN = frozenset("head script style noscript template iframe object embed svg math canvas audio video select button input textarea noembed noframes xmp title datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Names of what stands beside an article, as class and id values give them.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox banner promo promotion promoted sponsor sponsored sponsorship breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert warning disclaimer footer footnav masthead topbar navbar nav navigation menu menus submenu sidebar sidenav sidemenu aside widget widgets related recommended recommendations share sharing social follow newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager taglist toc outbrain taboola copyright search searchbox".split()
)
#: Parts of such names that say where or how large something is, and not what.
VAGUE = frozenset("left right top bottom inner outer upper lower box boxes list lists item items area block blocks section wrap wrapper container content holder group row col column link links bar slot unit panel primary secondary main form text body main1 icon icons button buttons site page".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def beside_name(value: str) -> bool:
    """Does a class or id value name something beside the article? The last part of a name that says what it is decides."""
    for name in value.split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        if name.lower() in BESIDE or next((w for w in reversed(parts) if w not in VAGUE), "") in BESIDE:
            return True
    return False


_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKUP = re.compile(r"<(?:!--|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$))*+)(?P<close>>?)|(?P<bogus>[!?/])[^>]*>?)")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")


class Page:
    """The elements of a page as parallel lists in document order, and its runs of text."""

    def __init__(self, source: str):
        self.parent, self.tag, self.beside, self.inside = [-1], ["#root"], [False], [False]
        self.named: list[bool] = [False]  # what a class or id places beside the article
        self.text: list[tuple[int, str]] = []  # (element, decoded text); None marks a block's edge
        self.edges: list[int] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        tag = self.tag
        while at < n:
            m = _MARKUP.search(source, at)
            if m is None:
                self._write(stack[-1], source[at:])
                break
            if m.start() > at:
                self._write(stack[-1], source[at : m.start()])
            at = m.end()
            name = m["name"]
            if name is None:
                if m["bogus"] is None:  # a comment
                    if source.startswith((">", "->"), at):
                        at = source.index(">", at) + 1
                    else:
                        end = re.compile(r"--!?>").search(source, at)
                        at = end.end() if end else n
                continue
            if not m["close"]:  # cut off within a tag
                break
            name = name.lower()
            if m["end"]:
                self._end(stack, name)
                continue
            self._make_room(stack, name)
            attributes = m["rest"]
            i = len(tag)
            tag.append(name)
            self.parent.append(stack[-1])
            self.inside.append(self.inside[stack[-1]] or name in ("article", "main"))
            beside, named = self._is_beside(name, attributes, self.inside[stack[-1]])
            self.beside.append(beside)
            self.named.append(named)
            if name in BLOCK:
                self.edges.append(len(self.text))
            if name == "br":
                self.text.append((i, " "))
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = end.start() if end else n
                if end:
                    closing = source.find(">", at)
                    at = closing + 1 if closing >= 0 else n
            elif name not in VOID and not (attributes.endswith("/") and name in ("svg", "math")):
                stack.append(i)

    def _write(self, element: int, text: str) -> None:
        self.text.append((element, html.unescape(text) if "&" in text else text))

    def _make_room(self, stack: list[int], name: str) -> None:
        """Ends the elements that the start of this one implies to end."""
        tag = self.tag
        if name in SIBLINGS:
            ended, limits = SIBLINGS[name]
            found = None
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] in ended:
                    found = k
                elif tag[stack[k]] in limits:
                    break
            if found is not None:
                self._cut(stack, found)
        if name in ENDS_P or name in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if tag[stack[k]] == "p":
                    self._cut(stack, k)
                    break
                if tag[stack[k]] in SCOPES:
                    break

    def _end(self, stack: list[int], name: str) -> None:
        if name == "br":
            self.text.append((stack[-1], " "))
            return
        tag = self.tag
        bounded = name not in SCOPES
        for k in range(len(stack) - 1, 0, -1):
            if tag[stack[k]] == name or name[0] == "h" and len(name) == 2 and name[1:].isdigit() and tag[stack[k]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self._cut(stack, k)
                return
            if bounded and tag[stack[k]] in SCOPES:
                return

    def _cut(self, stack: list[int], k: int) -> None:
        if any(self.tag[i] in BLOCK for i in stack[k:]):
            self.edges.append(len(self.text))
        del stack[k:]

    def _is_beside(self, name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
        """Does the element stand beside the article by its kind or role; does it by its class or id."""
        if name in DROPPED or name == "header" and not inside:
            return True, False
        if not attributes or name in ("html", "body", "article", "main"):
            return False, False
        beside = named = False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "class" or key == "id" and name not in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "b", "i", "em", "strong", "span", "a"):
                named = named or beside_name(value)
            elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                beside = True
        return beside, named


class Densities:
    """Counts of a page's elements (characters, tags, both within links) and their composite text densities."""

    def __init__(self, page: Page):
        n, parent, tag = len(page.tag), page.parent, page.tag
        self.page, self.n = page, n
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
        self.low = [False] * n  # elements beside the article, and all in them: their density is lowered to nothing
        for i in range(1, n):
            self.low[i] = page.beside[i] or self.low[parent[i]]
        own, own_link = [0] * n, [0] * n
        for i, text in page.text:
            size = len(" ".join(text.split()))
            own[i] += size
            if in_link[i]:
                own_link[i] += size
        self._own = own, own_link
        self.body = next((i for i in range(n) if tag[i] == "body"), 0)
        self._count()
        if not self.chars[self.body]:
            self.body = 0
        # a name on what holds half of the text, and the article if there is one (or stands in it), is no such name
        most, holds = self.chars[self.body], [False] * n
        for i in range(n - 1, 0, -1):
            holds[i] = holds[i] or tag[i] in ("article", "main")
            holds[parent[i]] = holds[parent[i]] or holds[i]
        for i in range(1, n):
            wrong = 2 * self.chars[i] >= most and (holds[i] or not holds[0] or page.inside[i])
            self.low[i] = self.low[i] or self.low[parent[i]] or page.named[i] and not wrong
        self._count()
        self.share = self.link_chars[self.body] / max(1, self.chars[self.body])

    def _count(self) -> None:
        n, parent, tag = self.n, self.page.parent, self.page.tag
        self.chars, self.tags, self.link_chars, self.link_tags = ([0 if low else x for x, low in zip(self._own[0], self.low, strict=True)], [0] * n, [0 if low else x for x, low in zip(self._own[1], self.low, strict=True)], [0] * n)
        for i in range(n - 1, 0, -1):
            if not self.low[i]:
                p = parent[i]
                self.chars[p] += self.chars[i]
                self.tags[p] += self.tags[i] + 1
                self.link_chars[p] += self.link_chars[i]
                self.link_tags[p] += self.link_tags[i] + (tag[i] == "a")

    def of(self, i: int) -> float:
        return density(self.chars[i], self.tags[i], self.link_chars[i], self.link_tags[i], self.share)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, weighted by how few of the characters and tags are links'. share: of the body's characters those in links."""
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars * link_chars / max(1, chars - link_chars) + chars * share + math.e)
    return chars / t * max(0.0, math.log(max(1.0, chars * t / (lc * lt)))) / base


#: The core grows to the article around it if that is at least so dense, in parts of the core's density.
AROUND = 0.005


def main_text(source: str | None) -> str:
    """The article's blocks, one per line.

    Each element has a composite text density (see density()). It is lowered to nothing for elements that stand
    beside an article by their kind or role (menus, headers, footers, asides, forms, scripts, hidden ones), or by
    a class or id that names such a thing (an advert, a notice, comments), unless they hold half of the body's text
    or more and no article stands elsewhere. The element whose children's densities have the largest sum is the core, and the least density on the
    path from it to the body is the threshold. The core grows to the article or main element around it if that is
    dense enough (AROUND); where there is none, to everything beside the path whose density reaches the threshold
    and whose text isn't mostly links, and to headings before the core. Of all this, lowered elements stay only if
    their density reaches the threshold.
    """
    if not source:
        return ""
    page = Page(source)
    held = Densities(page)
    n, parent, tag, low, body, chars, link_chars = held.n, page.parent, page.tag, held.low, held.body, held.chars, held.link_chars
    dense = [0.0 if low[i] else held.of(i) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[parent[i]] += dense[i]
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = not low[i] and inside[parent[i]]
    core = max((i for i in range(n) if inside[i]), key=lambda i: (sums[i], dense[i], -i))
    path = [core]
    while path[-1] != body:
        path.append(parent[path[-1]])
    threshold = min(dense[i] for i in path)
    least = AROUND * dense[core]
    around = next((i for kind in ("article", "main") for i in reversed(path) if tag[i] == kind and dense[i] >= least > 0), None)
    kept = [False] * n
    if around is not None:
        kept[around] = True
    else:
        kept[core] = True
        on_path = set(path)
        for i in range(body + 1, n):
            if inside[i] and parent[i] in on_path and i not in on_path and chars[i] > 2 * link_chars[i]:
                kept[i] = dense[i] >= threshold > 0 or i < core and tag[i] in ("h1", "h2", "h3", "h4", "h5", "h6")
        own = {i for i in path if i != body}
    for i in range(1, n):
        kept[i] = (kept[i] or kept[parent[i]]) and not (low[i] and (tag[i] in UNSHOWN or dense[i] < threshold))
    direct = own if around is None else set()
    blocks, now, edge = [], [], 0
    for k, (i, text) in enumerate(page.text):
        while edge < len(page.edges) and page.edges[edge] <= k:
            edge += 1
            if now:
                blocks.append("".join(now))
                now = []
        if kept[i] or i in direct and not low[i] or i == body and core == body:
            now.append(text)
    blocks.append("".join(now))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page page_id, url, text (empty if there is none), n_chars. No shuffle; the whole html of every page is read.

    Null and empty html give an empty text; html of any length is read whole, a page at a time. Null ids or urls
    and repeated rows are rows like others; other columns aren't read; an empty table gives an empty result.
    Of elements with equal sums the denser, then the first one counts.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
