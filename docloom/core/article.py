"""The article of a page: scored paragraphs, their best ancestor, its neighbours, cleaned.

The page's tree is laid out in arrays in document order: an element's subtree is a range, its text a range of pieces. What
is taken out is marked and its pieces are emptied, what is unwrapped loses its name; nothing is moved and nothing recurses.
"""

from __future__ import annotations

import json
import re
from html import unescape
from urllib.parse import urljoin

from docloom.core import html as H

# The word lists, element lists and numbers of the public readability algorithm.
UNLIKELY = re.compile("-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I)
MAYBE = re.compile("and|article|body|column|content|main|mathjax|shadow", re.I)
POSITIVE = re.compile("article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile("-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
BYLINE = re.compile("byline|author|dateline|writtenby|p-author", re.I)
SHARE = re.compile(r"(\b|_)(share|sharedaddy)(\b|_)", re.I)
VIDEO = re.compile(r"//(www\.)?((dailymotion|youtube|youtube-nocookie|player\.vimeo|v\.qq|bilibili|live\.bilibili)\.com|(archive|upload\.wikimedia)\.org|player\.twitch\.tv)", re.I)
AD_WORDS = re.compile("^(ad(vertising|vertisement)?|pub(licité)?|werb(ung)?|广告|Реклама|Anuncio)$", re.I)
LOADING = re.compile(r"^((loading|正在加载|Загрузка|chargement|cargando)(…|\.\.\.)?)$", re.I)
COMMAS = re.compile("[,،﹐︐︑⹁⸴⸲，]")
ARTICLE_TYPES = re.compile("^Article|AdvertiserContentArticle|NewsArticle|AnalysisNewsArticle|AskPublicNewsArticle|BackgroundNewsArticle|OpinionNewsArticle|ReportageNewsArticle|ReviewNewsArticle|Report|SatiricalArticle|ScholarlyArticle|MedicalScholarlyArticle|SocialMediaPosting|BlogPosting|LiveBlogPosting|DiscussionForumPosting|TechArticle|APIReference$")
ROLES = frozenset("menu menubar complementary navigation alert alertdialog dialog".split())
SCORED = frozenset("section h2 h3 h4 h5 h6 p td pre".split())
INSIDE_DIV = frozenset("blockquote dl div img ol p pre table ul".split())
BREAKS = frozenset("article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
PHRASING = frozenset("abbr audio b bdo br button cite code data datalist dfn em embed i img input kbd label mark math meter noscript object output progress q ruby samp script select small span strong sub sup textarea time var wbr".split())
PRESENTATION = frozenset("align background bgcolor border cellpadding cellspacing frame hspace rules style valign vspace".split())
SIZED = frozenset("table th td hr pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MEDIA = frozenset("img embed object iframe video audio source".split())
BASE_SCORE = {"div": 5} | dict.fromkeys(("pre", "td", "blockquote"), 3) | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys([*HEADINGS, "th"], -5)
META = {
    "title": "dc:title dc.title dcterm:title dcterm.title og:title twitter:title title", "byline": "dc:creator dc.creator dcterm:creator dcterm.creator author article:author",
    "excerpt": "dc:description dc.description dcterm:description dcterm.description description sailthru.description og:description twitter:description", "image": "og:image twitter:image twitter:image:src",
    "site_name": "og:site_name application-name", "published_time": "article:published_time date datepublished pubdate sailthru.date", "modified_time": "article:modified_time datemodified",
}
_SEPARATOR = r"[|\-–—\\/>»]"


def spaced(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return re.sub(r"\s{2,}", " ", text).strip()


def clean_title(title: str) -> str:
    """A page's title without the site's name around a separator."""
    whole = title = spaced(title)
    if re.search(rf"\s{_SEPARATOR}\s", title):
        title = " | ".join(re.split(rf"\s{_SEPARATOR}\s", title)[:-1]).strip()
        if len(title.split()) < 3:
            title = re.sub(rf"^[^{_SEPARATOR[1:-1]}]*{_SEPARATOR}", "", whole).strip()
    elif ": " in title and len((rest := title.split(": ", 1)[1]).split()) >= 3:
        title = rest.strip()
    return spaced(title or whole)


def clean_byline(text: str) -> str:
    text = re.sub(r"^(by|from|written by)\s+", "", spaced(text), flags=re.I)
    return re.sub(r"\s*[|\-–—]\s*$", "", text).strip()


def similarity(left: str, right: str) -> float:
    """Of the characters of right's words, the share that stand in words of left."""
    a, b = (re.findall(r"\w+", x.lower()) for x in (left, right))
    return 1 - len(" ".join(w for w in b if w not in set(a))) / len(" ".join(b)) if a and b else 0.0


def table_size(rows: list[tuple[str, list[str]]]) -> tuple[int, int]:
    """Rows and columns of a table given as (rowspan, colspans of the cells) for each row."""
    span = lambda x: int(x) if x.isdigit() else 1
    return sum(span(r) for r, _ in rows), max((sum(map(span, cells)) for _, cells in rows), default=0)


def _paragraphs(root: H.Node) -> None:
    """Text after two breaks, and loose text beside blocks in a div, becomes paragraphs of its own."""
    for parent in [n for n in H.walk(root) if n.kind == "tag"]:
        children, out, i = parent.children, [], 0
        phrase = lambda n: n.kind == "text" or n.kind == "tag" and (n.name in PHRASING or n.name in ("a", "del", "ins") and all(c.kind != "tag" or c.name in PHRASING for c in n.children))
        blank = lambda n: n.kind == "text" and not n.data.strip()
        breaks = [n.name == "br" for n in children]
        if sum(breaks) > 1 and parent.name != "pre":
            while i < len(children):
                j, seen = i, 0
                while j < len(children) and (children[j].name == "br" or seen and blank(children[j])):
                    seen += children[j].name == "br"
                    j += 1
                if seen < 2:
                    out.append(children[i])
                    i += 1
                    continue
                p = H.Node("tag", "p")
                while j < len(children) and phrase(children[j]) and not (children[j].name == "br" and j + 1 < len(children) and children[j + 1].name == "br"):
                    p.children.append(children[j])
                    j += 1
                while p.children and blank(p.children[-1]):
                    p.children.pop()
                if p.children:
                    out.append(p)
                i = j
            children = out
        if parent.name == "div" and any(n.kind == "tag" and not phrase(n) for n in children):
            out, run = [], []
            for n in [*children, None]:
                if n is not None and phrase(n):
                    run.append(n)
                    continue
                if any(not blank(x) and x.name != "br" for x in run):
                    p = H.Node("tag", "p")
                    p.children = run
                    out.append(p)
                run = []
                if n is not None:
                    out.append(n)
            children = out
        parent.children = children
        for n in children:
            n.parent = parent
            for c in n.children:
                c.parent = n


class Layout:
    """The elements of a tree in document order, as arrays."""

    def __init__(self, root: H.Node):
        self.name, self.up, self.attrs, self.first, self.last, self.end = [], [], [], [], [], []
        self.pieces: list[str] = []  # texts, and a line's end at each edge of a block
        self.texts: list[H.Node | None] = []
        wait: list[tuple[H.Node, int] | int] = [(root, -1)]
        while wait:
            item = wait.pop()
            if isinstance(item, int):
                self._edge(item)
                self.last[item], self.end[item] = len(self.name), len(self.pieces)
                continue
            node, up = item
            if node.kind == "text":
                self.pieces.append(node.data)
                self.texts.append(node)
            elif node.kind in ("tag", "root"):
                i = len(self.name)
                for held, x in ((self.name, node.name), (self.up, up), (self.attrs, dict(node.attrs)), (self.first, len(self.pieces)), (self.last, 0), (self.end, 0)):
                    held.append(x)
                self._edge(i)
                wait.append(i)
                wait.extend((c, i) for c in reversed(node.children))
        self.alive = [True] * len(self.name)
        self.score: dict[int, float] = {}
        self.data_table: set[int] = set()

    def _edge(self, i: int) -> None:
        if self.name[i] in BREAKS:
            self.pieces.append("\n")
            self.texts.append(None)

    def text(self, i: int, joined: bool = True) -> str:
        own = "".join(self.pieces[self.first[i] : self.end[i]]).strip()
        return spaced(own) if joined else own

    def below(self, i: int, *names: str) -> list[int]:
        return [k for k in range(i + 1, self.last[i]) if self.alive[k] and (self.name[k] in names if names else self.name[k])]

    def parent(self, i: int) -> int:
        """The element around, unwrapped ones left out; -1 at the top."""
        i = self.up[i]
        while i >= 0 and not self.name[i]:
            i = self.up[i]
        return i

    def ancestors(self, i: int) -> list[int]:
        out = []
        while (i := self.parent(i)) >= 0:
            out.append(i)
        return out

    def children(self, i: int) -> list[int]:
        out, k = [], i + 1
        while k < self.last[i]:
            if self.alive[k] and self.name[k]:
                out.append(k)
            k = self.last[k] if self.name[k] or not self.alive[k] else k + 1
        return out

    def drop(self, i: int) -> None:
        for k in range(i, self.last[i]):
            self.alive[k] = False
        for k in range(self.first[i], self.end[i]):
            self.pieces[k] = ""

    def named(self, i: int) -> str:
        return f"{self.attrs[i].get('class', '')} {self.attrs[i].get('id', '')}"

    def links(self, i: int) -> float:
        """The share of text in links; those within the page count less."""
        size = len(self.text(i))
        return sum(len(self.text(a)) * (0.3 if self.attrs[a].get("href", "").startswith("#") else 1.0) for a in self.below(i, "a")) / size if size else 0.0

    def share(self, i: int, names: frozenset[str] | set[str]) -> float:
        size = len(self.text(i))
        return sum(len(self.text(k)) for k in self.below(i, *names)) / size if size else 0.0

    def visible(self, i: int) -> bool:
        a = self.attrs[i]
        style = a.get("style", "").replace(" ", "").lower()
        return not ("display:none" in style or "visibility:hidden" in style or "hidden" in a or a.get("aria-hidden") == "true" and "fallback-image" not in a.get("class", ""))

    def markup(self, tops: list[int]) -> str:
        """The elements as markup, without classes (but for `page`)."""
        out: list[str] = []
        for top in tops:
            ends: list[tuple[int, str, int]] = []
            k, at = top, self.first[top]
            while True:
                stop = self.first[k] if k < self.last[top] else self.end[top]
                while ends and (k >= ends[-1][0]):
                    last, name, end = ends.pop()
                    at = self._texts(out, at, end)
                    if name and name not in H.VOID:
                        out.append(f"</{name}>")
                at = self._texts(out, at, stop)
                if k >= self.last[top]:
                    break
                if not self.alive[k]:
                    at, k = self.end[k], self.last[k]
                    continue
                if self.name[k]:
                    out.append("<" + " ".join([self.name[k], *(f'{a}="{H.escape(v)}"' for a, v in self.attrs[k].items())]) + ">")
                ends.append((self.last[k], self.name[k], self.end[k]))
                k += 1
        return "".join(out)

    def _texts(self, out: list[str], at: int, stop: int) -> int:
        out += [H.escape(self.pieces[j], quote=False) for j in range(at, stop) if self.texts[j] is not None]
        return max(at, stop)


class Reader:
    """One attempt at a page: strip what is unlikely, weigh classes, clean by conditions, as far as the flags say."""

    def __init__(self, source: str, title: str, byline: str | None, flags: tuple[bool, bool, bool], top: int, modifier: float):
        root = H.parse(source)
        for n in [n for n in H.walk(root) if n.name in ("script", "style", "noscript") or n.kind in ("comment", "directive")]:
            n.parent.children = [c for c in n.parent.children if c is not n]
        _paragraphs(root)
        self.page, self.title, self.byline = Layout(root), title, None
        self.known_byline, (self.strip, self.weigh, self.clean), self.top, self.modifier = byline, flags, top, modifier
        self.direction = None

    def weight(self, i: int) -> int:
        if not self.weigh:
            return 0
        return sum(25 * (bool(POSITIVE.search(v)) - bool(NEGATIVE.search(v))) for v in (self.page.attrs[i].get("class", ""), self.page.attrs[i].get("id", "")))

    def is_title(self, i: int) -> bool:
        return self.page.name[i] in ("h1", "h2") and bool(self.title) and similarity(self.page.text(i), self.title) > 0.75

    def prune(self) -> list[int]:
        """Takes out hidden, unlikely and empty elements; gives those to score."""
        p, scored, title_due = self.page, [], True
        body = next((i for i, n in enumerate(p.name) if n == "body"), 0)
        i = body
        while i < p.last[body]:
            if not p.alive[i] or not p.name[i]:
                i += 1
                continue
            a, name, match = p.attrs[i], p.name[i], p.named(i)
            gone = not p.visible(i) or a.get("aria-modal") == "true" and a.get("role") == "dialog"
            if not gone and not self.byline and not self.known_byline and (BYLINE.search(match) or a.get("rel") == "author" or "author" in a.get("itemprop", "")) and 0 < len(p.text(i)) < 100:
                named = next((k for k in p.below(i) if "name" in p.attrs[k].get("itemprop", "")), i)
                self.byline, gone = clean_byline(p.text(named)), True
            if not gone and title_due and self.is_title(i):
                title_due, gone = False, True
            if not gone and self.strip and name not in ("body", "a"):
                around = {p.name[k] for k in p.ancestors(i)[:3]}
                unlikely = UNLIKELY.search(match) and not MAYBE.search(match) and not around & {"table", "code"}
                gone = bool(unlikely) or a.get("role", "").lower() in ROLES
            if not gone and name in ("div", "section", "header", *HEADINGS):
                gone = not p.text(i) and all(p.name[k] in ("br", "hr") for k in p.children(i))
            if gone and i != body:
                p.drop(i)
                i = p.last[i]
                continue
            if name in SCORED:
                scored.append(i)
            if name == "div":
                own = p.children(i)
                loose = any(p.texts[k] is not None and p.pieces[k].strip() for k in range(p.first[i], p.end[i]) if not own or k < p.first[own[0]] or k >= p.end[own[0]])
                if len(own) == 1 and p.name[own[0]] == "p" and not loose and p.links(i) < 0.25:
                    p.attrs[own[0]] = {**p.attrs[own[0]], **p.attrs[i]}
                    p.name[i] = ""
                elif not any(p.alive[k] and p.name[k] in INSIDE_DIV for k in range(i + 1, p.last[i])):
                    p.name[i] = "p"
                    scored.append(i)
            i += 1
        return scored

    def candidates(self, scored: list[int]) -> list[int]:
        p = self.page
        for i in scored:
            if not p.alive[i] or len(text := p.text(i)) < 25:
                continue
            points = 1 + text.count(",") + min(len(text) // 100, 3)
            for level, k in enumerate(p.ancestors(i)[:5]):
                if k not in p.score:
                    p.score[k] = BASE_SCORE.get(p.name[k], 0) + self.weight(k)
                p.score[k] += points / (1, 2, 6, 9, 12)[level]
        order = list(p.score)
        for k in order:
            p.score[k] *= 1 - p.links(k)
        return sorted(order, key=lambda k: -p.score[k])[: self.top]

    def pick(self, best: list[int]) -> list[int]:
        """The best candidate, raised to a better ancestor, and those of its siblings that belong to it."""
        p = self.page
        body = next((i for i, n in enumerate(p.name) if n == "body"), 0)
        if not best or p.name[best[0]] in ("body", "html", ""):
            return p.children(body) or [body]
        top = best[0]
        near = [set(p.ancestors(k)) for k in best[1:] if p.score[k] / (p.score[top] or 1) >= 0.75]
        inner = lambda k: k >= 0 and p.name[k] not in ("body", "html", "")
        if len(near) >= 3:
            top = next((k for k in p.ancestors(top) if inner(k) and sum(k in s for s in near) >= 3), top)
        last, k = p.score.setdefault(top, BASE_SCORE.get(p.name[top], 0) + self.weight(top)), p.parent(top)
        least = last / 3
        while inner(k):
            if k in p.score:
                if p.score[k] < least:
                    break
                if p.score[k] > last:
                    top = k
                    break
                last = p.score[k]
            k = p.parent(k)
        while inner(k := p.parent(top)) and len(p.children(k)) == 1:
            top = k
        score = p.score.setdefault(top, BASE_SCORE.get(p.name[top], 0) + self.weight(top))
        up = p.parent(top)
        self.direction = next((d for k in [up, top, *p.ancestors(up)] if k >= 0 and (d := p.attrs[k].get("dir"))), None) if up >= 0 else None
        taken, own = [], p.attrs[top].get("class")
        for k in p.children(up) if up >= 0 else [top]:
            bonus = 0.2 * score if own and p.attrs[k].get("class") == own else 0
            fits = k == top or k in p.score and p.score[k] + bonus >= max(10, 0.2 * score) or k not in p.score and bonus >= max(10, 0.2 * score)
            if not fits and p.name[k] == "p":
                text, links = p.text(k), p.links(k)
                fits = len(text) > 80 and links < 0.25 or len(text) <= 80 and links == 0 and bool(re.search(r"\.(\s|$)", text))
            if fits:
                taken.append(k)
        return taken

    def mark_tables(self, inside: list[int]) -> None:
        p = self.page
        for t in (k for k in inside if p.name[k] == "table"):
            a, below = p.attrs[t], p.below(t)
            names = {p.name[k] for k in below}
            if a.get("role", "").lower() == "presentation" or a.get("datatable") == "0":
                continue
            caption = next((k for k in below if p.name[k] == "caption"), None)
            if a.get("summary") or caption is not None and p.end[caption] > p.first[caption] or names & {"col", "colgroup", "tfoot", "thead", "th"}:
                self.page.data_table.add(t)
            elif "table" not in names:
                rows, columns = table_size([(p.attrs[r].get("rowspan", ""), [p.attrs[c].get("colspan", "") for c in p.below(r, "td")]) for r in below if p.name[r] == "tr"])
                if 1 not in (rows, columns) and (rows >= 10 or columns > 4 or rows * columns > 10):
                    p.data_table.add(t)

    def allowed_embed(self, i: int) -> bool:
        return any(VIDEO.search(v) for k in (i, *(self.page.below(i) if self.page.name[i] == "object" else ())) for v in self.page.attrs[k].values())

    def is_fishy(self, i: int, tag: str) -> bool:
        """Does a form, table, list or division hold too little of its own?"""
        p = self.page
        around, text = p.ancestors(i), p.text(i)
        if i in p.data_table or any(k in p.data_table or p.name[k] == "code" for k in around) or any(k in p.data_table for k in p.below(i, "table")):
            return False
        is_list = tag in ("ul", "ol") or bool(text) and sum(len(p.text(k)) for k in p.below(i, "ul", "ol")) / len(text) > 0.9
        weight = self.weight(i)
        if weight + p.score.get(i, 0) < 0:
            return True
        if COMMAS.search(text) and text.count(",") >= 10:
            return False
        n = {x: len(p.below(i, x)) for x in ("p", "img", "li", "input")}
        embeds = sum(not self.allowed_embed(k) for k in p.below(i, "object", "embed", "iframe"))
        links, figure = p.links(i), any(p.name[k] == "figure" for k in around[:3])
        fishy = (
            AD_WORDS.search(text) or LOADING.search(text) or not figure and n["img"] > 1 and n["p"] / n["img"] < 0.5
            or not is_list and n["li"] - 100 > n["p"] or n["input"] > n["p"] // 3
            or not is_list and not figure and p.share(i, HEADINGS) < 0.9 and len(text) < 25 and (n["img"] == 0 or n["img"] > 2) and links > 0
            or not is_list and weight < 25 and links > 0.2 + self.modifier or weight >= 25 and links > 0.5 + self.modifier
            or embeds > 1 or embeds == 1 and len(text) < 75 or n["img"] == 0 and p.share(i, {"span", "li", "td", *INSIDE_DIV}) == 0
        )
        if fishy and is_list and all(len(p.children(k)) <= 1 for k in p.children(i)) and n["img"] == n["li"]:
            return False  # a gallery
        return bool(fishy)

    def cleaned(self, tops: list[int]) -> list[int]:
        p = self.page
        inside = lambda *names: [k for t in tops for k in ([t] if p.alive[t] and p.name[t] and (not names or p.name[t] in names) else []) + p.below(t, *names)]
        for k in inside():
            p.attrs[k] = {a: v for a, v in p.attrs[k].items() if a not in PRESENTATION and not (a in ("width", "height") and p.name[k] in SIZED)}
        self.mark_tables(inside())
        for k in inside("img", "picture", "figure"):
            self.load_image(k)
        self.conditionally(inside, "form", "fieldset")
        for k in inside("object", "embed", "footer", "link", "aside", "iframe", "input", "textarea", "select", "button"):
            if p.name[k] not in ("object", "embed", "iframe") or not self.allowed_embed(k):
                p.drop(k)
        for k in inside():
            if p.alive[k] and SHARE.search(p.named(k)) and len(p.text(k)) < 500:
                p.drop(k)
        for k in inside(*HEADINGS):
            if self.is_title(k) or self.weight(k) < 0 or p.links(k) > 0.33 or len(p.text(k)) < 5 and p.name[k] not in ("h1", "h2"):
                p.drop(k)
        self.conditionally(inside, "table", "ul", "div")
        for k in inside("h1"):
            p.name[k] = "h2"
        for k in inside("p"):
            if not p.text(k) and not p.below(k, "img", "embed", "object", "iframe"):
                p.drop(k)
        for t in inside("table"):  # a table of one cell is no table
            k = t
            for name in ("tbody", "tr", "td"):
                own = p.children(k)
                if len(own) == 1 and p.name[own[0]] == name:
                    k = own[0]
                elif name != "tbody":
                    break
            else:
                wide = all(p.name[c] in PHRASING | {"a"} for c in p.children(k))
                p.name[k] = "p" if wide else "div"
                for x in range(t, k):
                    p.name[x] = ""
        for name in ("p", "div", "section"):
            for k in reversed(inside(name)):
                if p.alive[k] and not p.text(k) and not p.below(k, *MEDIA):
                    p.drop(k)
        for k in reversed(inside("div", "section")):
            own = p.children(k)
            if len(own) == 1 and p.name[own[0]] in ("div", "section", "article", "p") and p.text(k) == p.text(own[0]):
                p.name[k] = ""
        return [t for t in tops if p.alive[t]]

    def conditionally(self, inside, *tags: str) -> None:
        if self.clean:
            for tag in tags:
                for k in reversed(inside(tag)):
                    if self.page.alive[k] and self.is_fishy(k, tag):
                        self.page.drop(k)

    def load_image(self, k: int) -> None:
        """Addresses that wait in other attributes until the image is scrolled to."""
        a, picture = self.page.attrs[k], r"\.(jpg|jpeg|png|webp)"
        small = re.match(r"data:\s*([^\s;,]+)\s*;\s*base64\s*,", a.get("src", ""), re.I)
        if small and small[1].lower() != "image/svg+xml" and len(a["src"]) - small.end() < 133 and any(x != "src" and re.search(picture, v, re.I) for x, v in a.items()):
            del a["src"]
        if (a.get("src") or a.get("srcset", "null") != "null") and "lazy" not in a.get("class", "").lower():
            return
        for x, v in list(a.items()):
            if x not in ("src", "srcset", "alt"):
                if re.search(picture + r"\s+\d", v, re.I):
                    a["srcset"] = v
                elif re.match(rf"\s*\S+{picture}\S*\s*$", v, re.I):
                    a["src"] = v


def absolute(page: Layout, tops: list[int], base: str, own: str) -> None:
    """Addresses resolved to the page's; links to scripts become plain text, classes go."""
    to = lambda x: x if base == own and x.startswith("#") else urljoin(base, x)
    for k in (k for t in tops for k in range(t, page.last[t]) if page.alive[k]):
        a = page.attrs[k]
        if page.name[k] == "a" and "href" in a:
            if a["href"].lower().startswith("javascript:"):
                page.name[k] = ""
            elif a["href"]:
                a["href"] = to(a["href"])
        if page.name[k] in ("img", "picture", "figure", "video", "audio", "source"):
            for x in ("src", "poster"):
                if a.get(x):
                    a[x] = to(a[x])
            if a.get("srcset"):
                a["srcset"] = ", ".join(to(m[1]) + (m[2] or "") for m in re.finditer(r"(\S+?)(\s+[\d.]+[xw])?\s*(?:,\s|,$|$)", a["srcset"]))
        kept = [c for c in a.pop("class", "").split() if c == "page"]
        if kept:
            a["class"] = " ".join(kept)


def linked_data(blocks: list[str], title: str) -> dict:
    """What a schema.org article in one of the JSON blocks says of itself."""
    for block in blocks:
        try:
            wait = [json.loads(re.sub(r"^\s*<!\[CDATA\[|\]\]>\s*$", "", block))]
        except ValueError:
            continue
        while wait:
            item = wait.pop(0)
            if isinstance(item, list):
                wait[:0] = item
                continue
            if not isinstance(item, dict):
                continue
            context = item.get("@context")
            graph = item.get("@graph")
            wait[:0] = [{"@context": context, **x} for x in graph if isinstance(x, dict)] if isinstance(graph, list) else []
            context = context.get("@vocab") if isinstance(context, dict) else context
            kinds = item.get("@type") or []
            kinds = [kinds] if isinstance(kinds, str) else kinds
            if not (isinstance(context, str) and re.match(r"https?://schema\.org/?$", context)) or not any(ARTICLE_TYPES.search(str(k).rstrip("/").rsplit("/", 1)[-1]) for k in kinds):
                continue
            name, headline = (x if isinstance(x, str) else None for x in (item.get("name"), item.get("headline")))
            if name and headline and name != headline:
                best = headline if similarity(headline, title) > 0.75 >= similarity(name, title) else name
            else:
                best = (name or headline or "").strip() or None
            people = item.get("author")
            people = [x for x in (people if isinstance(people, list) else [people]) if x]
            image = item.get("image")
            image = image[0] if isinstance(image, list) and image else image
            publisher = item.get("publisher")
            return {
                "title": best, "byline": ", ".join(str(x.get("name", "") if isinstance(x, dict) else x).strip() for x in people) or None, "excerpt": item.get("description"),
                "site_name": publisher.get("name") if isinstance(publisher, dict) else None, "published_time": item.get("datePublished"), "modified_time": item.get("dateModified"),
                "image": image.get("url") if isinstance(image, dict) else image,
            }
    return {}


def parse(source: str, url: str | None = None, char_threshold: int = 500, top_candidates: int = 5, json_ld: bool = True, link_density_modifier: float = 0.0) -> dict | None:
    """The article with what the page says of it, or None if it has no text.

    Up to four attempts, each with one rule less (unlikely elements, class weights, conditional cleaning), until the
    text has char_threshold characters; else the longest of them.
    """
    root = H.parse(source)
    tags = [n for n in H.walk(root) if n.kind == "tag"]
    named = lambda name: [n for n in tags if n.name == name]
    inner = lambda n: spaced(H.inner_text(n, frozenset()))
    titles, h1 = named("title"), named("h1")
    title = clean_title((inner(titles[0]) if titles else "") or (inner(h1[0]) if h1 else ""))
    if len(title.split()) <= 4 and len(h1) == 1 and inner(h1[0]):
        title = inner(h1[0])
    bases = [n.attrs["href"] for n in named("base") if n.attrs.get("href")]
    own = url or ""
    base = urljoin(own, bases[0]) if bases else own
    meta, links = {}, {}
    for n in named("meta"):
        key = (n.attrs.get("property") or n.attrs.get("name") or n.attrs.get("itemprop") or "").lower()
        if key and n.attrs.get("content"):
            meta[key] = n.attrs["content"]
    for n in named("link"):
        if n.attrs.get("rel") and n.attrs.get("href"):
            links[" ".join(n.attrs["rel"].lower().split())] = n.attrs["href"]
    data = linked_data([H.inner_text(n, frozenset()) for n in named("script") if n.attrs.get("type", "").lower() == "application/ld+json"], title) if json_ld else {}
    said = {field: data.get(field) or next((meta[k] for k in keys.split() if meta.get(k)), None) for field, keys in META.items()}
    said = {k: unescape(v) if isinstance(v, str) else None for k, v in said.items()}
    title = clean_title(said["title"]) if said["title"] else title
    byline = clean_byline(said["byline"]) if said["byline"] else None
    best: tuple[int, Reader, list[int]] | None = None
    for flags in ((True, True, True), (False, True, True), (False, False, True), (False, False, False)):
        reader = Reader(source, title, byline, flags, top_candidates, link_density_modifier)
        tops = reader.cleaned(reader.pick(reader.candidates(reader.prune())))
        size = len("\n".join(t for k in tops if (t := reader.page.text(k, False))))
        if best is None or size > best[0]:
            best = size, reader, tops
        if size >= char_threshold:
            best = size, reader, tops
            break
    _, reader, tops = best
    page = reader.page
    text = "\n".join(t for k in tops if (t := page.text(k, False)))
    if not text:
        return None
    absolute(page, tops, base, own)
    html = named("html")
    excerpt = spaced(said["excerpt"]) if said["excerpt"] else next((page.text(k) for t in tops for k in [t, *page.below(t)] if page.name[k] == "p"), None)
    top_attrs = html[0].attrs if html else {}
    canonical = links.get("canonical")
    return {
        "title": title, "byline": byline or reader.byline, "uri": urljoin(base, canonical) if canonical else url, "dir": reader.direction or top_attrs.get("dir") or None, "lang": top_attrs.get("lang") or None,
        "content": f'<div id="readability-page-1" class="page">{page.markup(tops)}</div>', "text_content": text, "length": len(text), "excerpt": excerpt, "site_name": said["site_name"],
        "image": urljoin(base, said["image"]) if said["image"] else None, "published_time": said["published_time"], "modified_time": said["modified_time"],
    }
