"""Markup and nested query strings as columns: Arrow batches into the kernels of docloom.core, one string at a time.

Null gives null. Options are plain arguments resolved while the plan is built.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.core import article as R
from docloom.core import commonmark as K
from docloom.core import feed as E
from docloom.core import html as H
from docloom.core import markdown as M
from docloom.core import nested as N

NODE = "struct<node_id:int,parent_id:int,last_id:int,depth:int,pos:int,kind:string,name:string,attrs:map<string,string>,data:string>"
_NODE = pa.struct([(n, pa.int32()) for n in ("node_id", "parent_id", "last_id", "depth", "pos")] + [("kind", pa.string()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("data", pa.string())])


#: Characters of strings that a kernel turns into results at once.
SLICE = 1 << 22


def _slices(column: pa.Array):
    """Parts of a column of about SLICE characters, so that neither strings nor results of a whole batch are held at once."""
    start = held = 0
    for i, x in enumerate(pc.utf8_length(column.fill_null("")).to_pylist()):
        held += x
        if held >= SLICE:
            yield column.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(column):
        yield column.slice(start)


def _mapped(f: Callable, value: Column | str, kind: T.DataType | str = "string", arrow: pa.DataType | None = None) -> Column:
    held = arrow or pa.string()

    @F.arrow_udf(kind)
    def run(column: pa.Array) -> pa.Array:
        parts = [pa.array((None if x is None else f(x) for x in part.to_pylist()), held) for part in _slices(column)]
        return pa.concat_arrays(parts) if parts else pa.array([], held)

    return run(F.col(value) if isinstance(value, str) else value)


def nodes(html: Column | str) -> Column:
    """All nodes in document order, an array of NODE; numbers begin with 1, the parent of top-level nodes is 0."""
    return _mapped(H.node_rows, html, f"array<{NODE}>", pa.list_(_NODE))


def _rows(table: DataFrame, value: str, keep: tuple[str, ...], f: Callable, kind: str, arrow: pa.DataType) -> DataFrame:
    """One row for each struct that f gives of a string, beside the columns to keep; a string's rows are made when they are asked for."""
    rows = table.select(*[F.col(k) for k in keep], F.col(value).cast("string").alias("_value"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.column(len(keep))[i].as_py()
                got = f(x) if x is not None else []
                for at in range(0, len(got), 4096):
                    part = pa.array(got[at : at + 4096], arrow)
                    own = [batch.column(k).take(pa.array([i] * len(part))) for k in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*own, *part.flatten()], [*keep, *(field.name for field in arrow)])

    schema = T.StructType([*(rows.schema[k] for k in keep), *T._parse_datatype_string(kind).fields])
    return rows.mapInArrow(run, schema)


def node_table(pages: DataFrame, html: str, *keep: str, ended: bool = False) -> DataFrame:
    """One row for each node of each page, beside the columns to keep. Pages without nodes have no rows; no shuffle. ended: references without a semicolon stay."""
    return _rows(pages, html, keep, lambda x: H.node_rows(x, ended), NODE, _NODE)


COUNTS = "struct<n_nodes:bigint,n_tag:bigint,n_text:bigint,n_comment:bigint,n_directive:bigint,title:string>"
_COUNTS = pa.struct([*((n, pa.int64()) for n in ("n_nodes", "n_tag", "n_text", "n_comment", "n_directive")), ("title", pa.string())])


def node_counts(html: Column | str, ended: bool = False) -> Column:
    """How many nodes of each kind a page has, and its first title's text, as a COUNTS struct. ended: references without a semicolon stay."""
    return _mapped(lambda x: H.node_counts(x, ended), html, COUNTS, _COUNTS)


TOKEN = "struct<token_id:int,parent_id:int,kind:string,depth:int,text:string>"
_TOKEN = pa.struct([("token_id", pa.int32()), ("parent_id", pa.int32()), ("kind", pa.string()), ("depth", pa.int32()), ("text", pa.string())])


def markdown_tokens(table: DataFrame, markdown: str, *keep: str, gfm: bool = True) -> DataFrame:
    """One row for each block and inline of Markdown texts, beside the columns to keep."""
    return _rows(table, markdown, keep, lambda x: K.token_rows(x, gfm), TOKEN, _TOKEN)


def html_of_markdown(markdown: Column | str, gfm: bool = True, breaks: bool = False) -> Column:
    return _mapped(lambda x: K.to_html(x, gfm, breaks), markdown)


def html_of_inline_markdown(markdown: Column | str, gfm: bool = True, breaks: bool = False) -> Column:
    return _mapped(lambda x: K.inline_to_html(x, gfm, breaks), markdown)


def text_of_markdown(markdown: Column | str, gfm: bool = True) -> Column:
    return _mapped(lambda x: K.to_text(x, gfm), markdown)


def escaped(text: Column | str, encode: bool = True) -> Column:
    """&, <, > and quotes as references; without encode, references that stand in the text stay. Native."""
    c = F.col(text) if isinstance(text, str) else text
    c = F.replace(c, F.lit("&"), F.lit("&amp;")) if encode else F.regexp_replace(c, r"&(?!(#\d{1,7}|#[Xx][a-fA-F0-9]{1,6}|\w+);)", "&amp;")
    for mark, reference in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(reference))
    return c


FEED = "struct<type:string,title:string,link:string,description:string,items:array<struct<title:string,link:string>>>"
_FEED = pa.struct([*((n, pa.string()) for n in ("type", "title", "link", "description")), ("items", pa.list_(pa.struct([("title", pa.string()), ("link", pa.string())])))])


def feed(xml: Column | str) -> Column:
    """An RSS or Atom feed as a FEED struct; null for other texts."""
    return _mapped(E.parse, xml, FEED, _FEED)


ARTICLE = "struct<title:string,byline:string,uri:string,dir:string,lang:string,content:string,text_content:string,length:int,excerpt:string,site_name:string,image:string,published_time:string,modified_time:string>"
_ARTICLE = pa.struct([(x.split(":")[0], pa.int32() if x.endswith(":int") else pa.string()) for x in ARTICLE[7:-1].split(",")])


def article(html: Column | str, url: Column | str | None = None, **options) -> Column:
    """The article of a page, an ARTICLE struct; null where there is none. url: the page's address, to which relative ones are resolved."""
    if url is None:
        return _mapped(lambda x: R.parse(x, **options), html, ARTICLE, _ARTICLE)

    @F.arrow_udf(ARTICLE)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        out, at = [], 0
        for part in _slices(pages):
            own = urls.slice(at, len(part)).to_pylist()
            at += len(part)
            out.append(pa.array((None if x is None else R.parse(x, u, **options) for x, u in zip(part.to_pylist(), own, strict=True)), _ARTICLE))
        return pa.concat_arrays(out) if out else pa.array([], _ARTICLE)

    return run(*(F.col(x) if isinstance(x, str) else x for x in (html, url)))


def text(html: Column | str) -> Column:
    """The text of the markup, without that of scripts and styles."""
    return _mapped(lambda x: H.inner_text(H.parse(x)), html)


def normalized(html: Column | str) -> Column:
    """The markup as its tree is written out: elements closed, attributes quoted."""
    return _mapped(lambda x: H.serialize(H.parse(x)), html)


def sanitized(html: Column | str, **options) -> Column:
    """The markup with allowed elements, attributes and addresses alone; options are those of docloom.core.html.Policy."""
    policy = H.Policy(**options)
    return _mapped(lambda x: H.sanitize(x, policy=policy), html)


SANITIZED = "struct<html:string,removed:array<struct<element:string,attribute:string>>>"
_SANITIZED = pa.struct([("html", pa.string()), ("removed", pa.list_(pa.struct([("element", pa.string()), ("attribute", pa.string())])))])


def sanitized_with_removed(html: Column | str, **options) -> Column:
    """The sanitised markup and what went, in document order; a removed element has no attribute."""
    policy = H.Policy(**options)

    def one(x: str) -> dict:
        removed: list[tuple[str, str]] = []
        return {"html": H.sanitize(x, policy=policy, removed=removed), "removed": [{"element": e, "attribute": a or None} for e, a in removed]}

    return _mapped(one, html, SANITIZED, _SANITIZED)


def attribute_allowed(element: Column | str, attribute: Column | str, value: Column | str, **options) -> Column:
    """Whether sanitising leaves an attribute with that value; null if one of the three is null."""
    policy = H.Policy(**options)

    @F.arrow_udf("boolean")
    def run(elements: pa.Array, attributes: pa.Array, values: pa.Array) -> pa.Array:
        rows = zip(elements.to_pylist(), attributes.to_pylist(), values.to_pylist(), strict=True)
        return pa.array((None if None in row else policy.allows_attribute(row[0].lower(), row[1].lower(), row[2]) for row in rows), pa.bool_())

    return run(*(F.col(x) if isinstance(x, str) else x for x in (element, attribute, value)))


def markdown(html: Column | str, **options) -> Column:
    return _mapped(lambda x: M.to_markdown(x, **options), html)


def query_json(query: Column | str, **options) -> Column:
    """The nested value of a query string, as JSON; null beyond a strict limit or depth."""

    def one(x: str) -> str | None:
        try:
            return N.parse_json(x, **options)
        except ValueError:
            return None

    return _mapped(one, query)


def query_of_json(value: Column | str, **options) -> Column:
    """The query string of a JSON object or array; null if the JSON is something else, malformed or too deep."""

    def one(x: str) -> str | None:
        try:
            held = json.loads(x)
            return N.stringify(held, **options) if isinstance(held, (dict, list)) else None
        except ValueError:
            return None

    return _mapped(one, value)
