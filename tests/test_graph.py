from pyspark.sql import functions as F

from docloom.catalogue import _checkpoints
from docloom.operators.graph import Graph, parse_edge_list


def graph(spark, edges, nodes=()):
    names = {(g, x) for g, *e in edges for x in e} | set(nodes)
    n = spark.createDataFrame([(*x, None) for x in sorted(names)], "graph_id int, v string, parent string")
    return Graph(n, spark.createDataFrame([(*e, None) for e in edges], "graph_id int, v string, w string, name string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_questions(spark):
    g = graph(spark, [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (2, "x", "y")], [(2, "z")])
    assert rows(g.sources()) == [(1, "a"), (2, "x"), (2, "z")]
    assert rows(g.sinks()) == [(1, "c"), (2, "y"), (2, "z")]
    assert rows(g.counts()) == [(1, 3, 3), (2, 3, 1)]
    assert rows(g.leaves(directed=False)) == [(2, "z")]
    assert len(rows(g.node_edges().select("node", "v", "w"))) == 8


def test_edits(spark):
    g = graph(spark, [(1, "a", "b"), (1, "b", "c")])
    more = g.set_paths(spark.createDataFrame([(1, ["c", "d", "a"])], "graph_id int, path array<string>"))
    assert rows(more.edges.select("v", "w")) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]
    assert rows(more.nodes.select("v")) == [("a",), ("b",), ("c",), ("d",)]
    less = more.remove_nodes(spark.createDataFrame([(1, "b")], "graph_id int, v string"))
    assert rows(less.edges.select("v", "w")) == [("c", "d"), ("d", "a")]
    assert rows(more.filter_nodes("v in ('a', 'b')").edges.select("v", "w")) == [("a", "b")]


def test_components_and_ranks(spark):
    _checkpoints(spark)
    g = graph(spark, [(1, "e", "d"), (1, "d", "c"), (1, "b", "c"), (1, "e", "c"), (2, "x", "y"), (2, "y", "x")], [(2, "z")])
    assert rows(g.components()) == [(1, "b", "b"), (1, "c", "b"), (1, "d", "b"), (1, "e", "b"), (2, "x", "x"), (2, "y", "x"), (2, "z", "z")]
    assert rows(g.longest_path_ranks()) == [(1, "b", -1), (1, "c", 0), (1, "d", -1), (1, "e", -2), (2, "z", 0)]


def test_normalized_and_crossings(spark):
    g = graph(spark, [(1, "a", "y"), (1, "b", "x")])
    order = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 0, 1), (1, "x", 1, 0), (1, "y", 1, 1)], "graph_id int, v string, layer int, pos int")
    assert rows(g.crossings(order)) == [(1, 1)]
    ranks = order.select("graph_id", "v", (F.col("layer") * 2).alias("rank"))
    assert len(rows(g.normalized(ranks))) == 6


def test_edge_list(spark):
    got = rows(parse_edge_list(spark.createDataFrame([(1, "a -> b #x y\n// no\nb -- c\nc d\n\nbad")], "graph_id int, text string")))
    assert got == [(1, 0, "a", "b", "x y"), (1, 2, "b", "c", ""), (1, 3, "c", "d", "")]
