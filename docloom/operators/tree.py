"""Trees of markup as node rows: questions and walks as columns, joins and windows.

A table of nodes has the columns of docloom.functions.html.NODE and, beside them, key columns that name the page. Nodes
are numbered in document order, so the nodes below one are those from node_id + 1 to last_id of the same page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENTS = ("tag", "script", "style")


def is_tag() -> Column:
    return F.col("kind") == "tag"


def is_text() -> Column:
    return F.col("kind") == "text"


def is_comment() -> Column:
    return F.col("kind") == "comment"


def is_directive() -> Column:
    return F.col("kind") == "directive"


def name() -> Column:
    return F.col("name")


def attribute(key: str) -> Column:
    """An attribute's value; null without it."""
    return F.try_element_at("attrs", F.lit(key))


def has_attribute(key: str) -> Column:
    return F.map_contains_key("attrs", key)


def has_class(token: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute("class"), r"[ \t\n\f\r]+"), token), F.lit(False))


def tested(tag_name: str | None = None, tag_type: str | None = None, tag_contains: str | None = None, **attributes: str) -> Column:
    """The predicate of an option map: a node passes if any of the given options holds."""
    tests = []
    if tag_name is not None:
        tests.append(is_tag() if tag_name == "*" else is_tag() & (F.col("name") == tag_name))
    if tag_type is not None:
        tests.append(F.col("kind") == tag_type)
    if tag_contains is not None:
        tests.append(is_text() & (F.col("data") == tag_contains))
    tests += [is_tag() & (F.coalesce(attribute(k), F.lit("\0")) == v) for k, v in attributes.items()]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def select(nodes: DataFrame, test: Column, *keys: str, recurse: bool = True, limit: int | None = None) -> DataFrame:
    """The nodes of each page that pass, the first `limit` in document order; without recurse, of the top level alone."""
    found = nodes.filter(test if recurse else test & (F.col("depth") == 1))
    if limit is None:
        return found
    own = Window.partitionBy(*keys).orderBy("node_id")
    return found.withColumn("_rank", F.row_number().over(own)).filter(F.col("_rank") <= limit).drop("_rank")


def first(nodes: DataFrame, test: Column, *keys: str, recurse: bool = True) -> DataFrame:
    """The first element of each page that passes; pre-aggregated, so that no page is collected."""
    found = select(nodes, is_tag() & test, *keys, recurse=recurse)
    row = F.struct("node_id", *[c for c in nodes.columns if c not in (*keys, "node_id")])
    return found.groupBy(*keys).agg(F.min_by(row, "node_id").alias("_first")).select(*keys, "_first.*")


def exists(nodes: DataFrame, test: Column, *keys: str) -> DataFrame:
    """Per page, does any element pass?"""
    return nodes.groupBy(*keys).agg(F.coalesce(F.bool_or(is_tag() & test), F.lit(False)).alias("exists"))


def by_id(nodes: DataFrame, id_: str, *keys: str) -> DataFrame:
    return first(nodes, F.coalesce(attribute("id") == id_, F.lit(False)), *keys)


def by_tag_name(nodes: DataFrame, tag: str, *keys: str, recurse: bool = True, limit: int | None = None) -> DataFrame:
    return select(nodes, tested(tag_name=tag), *keys, recurse=recurse, limit=limit)


def by_class_name(nodes: DataFrame, token: str, *keys: str, recurse: bool = True, limit: int | None = None) -> DataFrame:
    return select(nodes, is_tag() & has_class(token), *keys, recurse=recurse, limit=limit)


def by_kind(nodes: DataFrame, kind: str, *keys: str, recurse: bool = True, limit: int | None = None) -> DataFrame:
    return select(nodes, F.col("kind") == kind, *keys, recurse=recurse, limit=limit)


def _own(nodes: DataFrame, keys: tuple[str, ...], prefix: str) -> DataFrame:
    return nodes.select(*[F.col(k).alias(f"{prefix}{k}") for k in keys], *[F.col(c).alias(f"{prefix}{c}") for c in nodes.columns if c not in keys])


def _same_page(keys: tuple[str, ...], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def children(nodes: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """The children of the nodes `of`, in order of their place (pos)."""
    parents = of.select(*keys, F.col("node_id").alias("parent_id")).distinct()
    return nodes.join(parents, [*keys, "parent_id"], "left_semi")


def parents(nodes: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """The parents of the nodes `of`; top-level nodes have none."""
    ids = of.select(*keys, F.col("parent_id").alias("node_id")).distinct()
    return nodes.join(ids, [*keys, "node_id"], "left_semi")


def siblings(nodes: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """The nodes that share a parent with one of `of`, which is among them."""
    ids = of.select(*keys, "parent_id").distinct()
    return nodes.join(ids, [*keys, "parent_id"], "left_semi")


def element_siblings(nodes: DataFrame, *keys: str) -> DataFrame:
    """Elements with next_id and previous_id, the elements beside them; null at the ends."""
    own = Window.partitionBy(*keys, "parent_id").orderBy("pos")
    return nodes.filter(is_tag()).withColumns({"next_id": F.lead("node_id").over(own), "previous_id": F.lag("node_id").over(own)})


def subtrees(nodes: DataFrame, of: DataFrame, *keys: str, own: bool = True) -> DataFrame:
    """For each of the nodes `of` (as root_id), the nodes below it, and itself if own."""
    roots = of.select(*keys, F.col("node_id").alias("root_id"), F.col("last_id").alias("_end"))
    low = F.col("node_id") >= F.col("root_id") if own else F.col("node_id") > F.col("root_id")
    return nodes.join(roots, list(keys)).filter(low & (F.col("node_id") <= F.col("_end"))).drop("_end")


def text_content(nodes: DataFrame, of: DataFrame, *keys: str, skip: tuple[str, ...] = (), breaks: bool = False) -> DataFrame:
    """Per node of `of` (root_id) the text of its subtree in document order: text_content.

    skip: elements whose text doesn't count ("script", "style": inner text). breaks: a br counts as a line's end.
    """
    below = subtrees(nodes, of, *keys)
    part = F.when(is_text(), F.col("data"))
    if breaks:
        part = part.when(F.col("name") == "br", F.lit("\n"))
    if skip:
        up = nodes.filter(F.col("name").isin(*skip)).select(*keys, F.col("node_id").alias("parent_id"))
        below = below.join(up, [*keys, "parent_id"], "left_anti")
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("node_id", part.alias("part")))))
    return below.groupBy(*keys, "root_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("text_content"))


def without(nodes: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """The nodes without the subtrees of `gone`. Numbers stay as they are."""
    ids = subtrees(nodes, gone, *keys).select(*keys, "node_id").distinct()
    return nodes.join(ids, [*keys, "node_id"], "left_anti")


def counted(nodes: DataFrame, *keys: str) -> DataFrame:
    """Per page: how many nodes there are of each kind, and the first title's text."""
    title = F.min_by("node_id", "node_id").alias("title_id")
    counts = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("tag", "text", "comment", "directive")])
    titles = nodes.filter(is_tag() & (F.col("name") == "title")).groupBy(*keys).agg(title)
    own = nodes.filter(is_text()).select(*keys, F.col("parent_id").alias("title_id"), F.col("data").alias("title"))
    return counts.join(titles.join(own, [*keys, "title_id"]).drop("title_id"), list(keys), "left")
