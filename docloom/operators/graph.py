"""Directed multigraphs as two tables: nodes (graph_id, v, parent) and edges (graph_id, v, w, name, weight).

Columns named otherwise ride along. All operators are joins and aggregations keyed by graph_id and node, so a table
of many graphs is one job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.core import graphs

KEY = ["graph_id", "v"]


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # -- edits ---------------------------------------------------------------

    def set_nodes(self, rows: DataFrame) -> Graph:
        """Adds nodes; those with the same key replace the present ones."""
        kept = self.nodes.join(rows.select(*KEY), KEY, "left_anti")
        return replace(self, nodes=kept.unionByName(rows.dropDuplicates(KEY), allowMissingColumns=True))

    def set_edges(self, rows: DataFrame) -> Graph:
        """Adds edges (key: v, w, name) and endpoints that are missing; the same key replaces."""
        on = [self.edges[c].eqNullSafe(rows[c]) for c in ("graph_id", "v", "w", "name")]
        kept = self.edges.join(rows, on, "left_anti")
        edges = kept.unionByName(rows.dropDuplicates(["graph_id", "v", "w", "name"]), allowMissingColumns=True)
        ends = rows.select(*KEY).unionByName(rows.select("graph_id", F.col("w").alias("v"))).distinct()
        new = ends.join(self.nodes.select(*KEY), KEY, "left_anti")
        return Graph(self.nodes.unionByName(new, allowMissingColumns=True), edges)

    def set_paths(self, paths: DataFrame) -> Graph:
        """Adds the edges between neighbours of each path (graph_id, path: array of nodes)."""
        steps = paths.select("graph_id", F.explode(F.arrays_zip(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("v"), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("w"))).alias("e"))
        rows = steps.select("graph_id", "e.v", "e.w").distinct().withColumn("name", F.lit(None).cast("string"))
        return self.set_edges(rows)

    def remove_nodes(self, rows: DataFrame) -> Graph:
        gone = rows.select(*KEY).distinct()
        edges = self.edges.join(gone, KEY, "left_anti").join(gone.withColumnRenamed("v", "w"), ["graph_id", "w"], "left_anti").select(*self.edges.columns)
        nodes = self.nodes.join(gone, KEY, "left_anti").select(*self.nodes.columns)
        if "parent" in nodes.columns:  # children of a removed node come to stand at the top
            top = gone.select("graph_id", F.col("v").alias("_gone"))
            nodes = nodes.join(top, (nodes["graph_id"] == top["graph_id"]) & (nodes["parent"] == top["_gone"]), "left").select(*[(F.when(F.col("_gone").isNull(), F.col("parent")).alias("parent") if c == "parent" else nodes[c]) for c in nodes.columns])
        return Graph(nodes, edges)

    def remove_edges(self, rows: DataFrame) -> Graph:
        on = [self.edges[c].eqNullSafe(rows[c]) for c in ("graph_id", "v", "w", "name")]
        return replace(self, edges=self.edges.join(rows, on, "left_anti"))

    def filter_nodes(self, condition) -> Graph:
        """The induced subgraph; a kept node's parent is its nearest kept ancestor, null without one.

        Each round replaces parents that are gone by their own parents; rounds are checkpoints, as many as the longest chain of
        removed ancestors.
        """
        kept = self.nodes.filter(condition)
        keys = kept.select(*KEY)
        edges = self.edges.join(keys, KEY, "left_semi").join(keys.withColumnRenamed("v", "w"), ["graph_id", "w"], "left_semi").select(*self.edges.columns)
        if "parent" not in self.nodes.columns:
            return Graph(kept, edges)
        above = self.nodes.select("graph_id", F.col("v").alias("up"), F.col("parent").alias("next")).join(keys.select("graph_id", F.col("v").alias("up"), F.lit(True).alias("stays")), ["graph_id", "up"], "left")
        above = above.withColumn("stays", F.coalesce("stays", F.lit(False))).checkpoint()
        found = kept.select(*KEY, F.col("parent").alias("up")).filter("up is not null").checkpoint()
        done = None
        while not found.isEmpty():
            step = found.join(above, ["graph_id", "up"], "left").checkpoint()
            ended = step.filter("stays").select(*KEY, F.col("up").alias("_parent"))
            done = ended if done is None else done.unionByName(ended)
            found = step.filter("not stays and next is not null").select(*KEY, F.col("next").alias("up"))
        if done is None:
            done = keys.limit(0).withColumn("_parent", F.lit(None).cast(self.nodes.schema["parent"].dataType))
        nodes = kept.join(done, KEY, "left").select(*[F.col("_parent").alias("parent") if c == "parent" else F.col(c) for c in self.nodes.columns])
        return Graph(nodes, edges)

    def set_parents(self, rows: DataFrame) -> Graph:
        """Puts nodes (graph_id, v) below others (parent; null: at the top). Raises ValueError if a node would stand below itself."""
        new = rows.select(*KEY, F.col("parent").alias("_parent"), F.lit(True).alias("_set"))
        nodes = self.nodes.join(new, KEY, "left").select(*[F.when(F.col("_set"), F.col("_parent")).otherwise(F.col("parent")).alias("parent") if c == "parent" else F.col(c) for c in self.nodes.columns]).checkpoint()
        ahead = nodes.filter("parent is not null").select(*KEY, "parent").checkpoint()
        while not ahead.isEmpty():  # each node's pointer jumps to where its parent's points; what comes back to itself is on a cycle
            if not ahead.filter("v = parent").isEmpty():
                raise ValueError("a node can't stand below itself")
            jump = ahead.select("graph_id", F.col("v").alias("parent"), F.col("parent").alias("next"))
            ahead = ahead.join(jump, ["graph_id", "parent"]).select(*KEY, F.col("next").alias("parent")).checkpoint()
        return replace(self, nodes=nodes)

    # -- questions -------------------------------------------------------------

    def counts(self) -> DataFrame:
        """(graph_id, node_count, edge_count); graphs without nodes have no row."""
        n = self.nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count"))
        m = self.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
        return n.join(m, "graph_id", "left").select("graph_id", "node_count", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"))

    def sources(self) -> DataFrame:
        return self.nodes.select(*KEY).join(self.edges.select("graph_id", F.col("w").alias("v")), KEY, "left_anti")

    def sinks(self) -> DataFrame:
        return self.nodes.select(*KEY).join(self.edges.select(*KEY), KEY, "left_anti")

    def successors(self) -> DataFrame:
        return self.edges.select("graph_id", "v", F.col("w").alias("successor")).distinct()

    def predecessors(self) -> DataFrame:
        return self.edges.select("graph_id", F.col("w").alias("v"), F.col("v").alias("predecessor")).distinct()

    def neighbors(self) -> DataFrame:
        return self.successors().toDF("graph_id", "v", "neighbor").unionByName(self.predecessors().toDF("graph_id", "v", "neighbor")).distinct()

    def leaves(self, directed: bool = True) -> DataFrame:
        return self.sinks() if directed else self.nodes.select(*KEY).join(self.neighbors(), KEY, "left_anti")

    def in_edges(self) -> DataFrame:
        return self.edges.select(F.col("w").alias("node"), *self.edges.columns)

    def out_edges(self) -> DataFrame:
        return self.edges.select(F.col("v").alias("node"), *self.edges.columns)

    def node_edges(self) -> DataFrame:
        """Each edge under both of its ends (a self edge once)."""
        return self.out_edges().unionByName(self.in_edges().filter("v <> w"))

    def children(self) -> DataFrame:
        return self.nodes.select("graph_id", F.col("parent").alias("v"), F.col("v").alias("child"))

    def degrees(self) -> DataFrame:
        out = self.edges.groupBy(*KEY).agg(F.count(F.lit(1)).alias("out_degree"))
        into = self.edges.groupBy("graph_id", F.col("w").alias("v")).agg(F.count(F.lit(1)).alias("in_degree"))
        return self.nodes.select(*KEY).join(out, KEY, "left").join(into, KEY, "left").select(*KEY, F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))

    def components(self) -> DataFrame:
        """(graph_id, v, component): the least node that is connected, whichever way edges point.

        Labels shrink by joins with the neighbours and by following labels; each round is a checkpoint.
        """
        both = self.neighbors().filter("v <> neighbor").checkpoint()
        labels = self.nodes.select(*KEY).distinct().withColumn("component", F.col("v")).checkpoint()
        while True:
            near = both.join(labels.select("graph_id", F.col("v").alias("neighbor"), "component"), ["graph_id", "neighbor"]).groupBy(*KEY).agg(F.min("component").alias("near"))
            step = labels.join(near, KEY, "left").select(*KEY, F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("component"))
            jump = labels.select("graph_id", F.col("v").alias("component"), F.col("component").alias("next"))
            step = step.join(jump, ["graph_id", "component"]).select(*KEY, "was", F.least("component", "next").alias("component")).checkpoint()
            labels = step.select(*KEY, "component")
            if step.filter("was <> component").isEmpty():
                return labels

    def longest_path_ranks(self) -> DataFrame:
        """(graph_id, v, rank) of acyclic graphs: sinks have rank 0, others the least rank that leaves each edge its minlen (1 without that column).

        Each round settles the nodes whose successors are settled. Nodes on or before a cycle get no rank.
        """
        minlen = F.col("minlen") if "minlen" in self.edges.columns else F.lit(1)
        edges = self.edges.select("graph_id", "v", "w", minlen.cast("long").alias("minlen")).checkpoint()
        settled = self.sinks().withColumn("rank", F.lit(0).cast("long")).checkpoint()
        while True:
            ahead = settled.select("graph_id", F.col("v").alias("w"), "rank")
            open_ = edges.join(settled, KEY, "left_anti").join(ahead, ["graph_id", "w"], "left")
            ready = open_.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("k"), F.min(F.col("rank") - F.col("minlen")).alias("rank")).filter("n = k").select(*KEY, "rank").checkpoint()
            if ready.isEmpty():
                return settled
            settled = settled.unionByName(ready).checkpoint()

    def crossings(self, order: DataFrame) -> DataFrame:
        """Weighted crossings between layers: order has (graph_id, v, layer, pos), pos from 0; edges run from layer r to r + 1.

        Two edges cross if their upper ends stand one way and their lower ends the other. The lower places of a pair first
        differ in some binary digit; for each digit, edges that agree in all higher ones are sorted by their upper places and
        meet in a running sum. So an edge is copied once for each digit, and no pairs are made.
        """
        weight = F.col("weight") if "weight" in self.edges.columns else F.lit(1)
        a = order.select("graph_id", "v", F.col("layer"), F.col("pos").cast("long").alias("pv"))
        b = order.select("graph_id", F.col("v").alias("w"), F.col("pos").cast("long").alias("pw"))
        placed = self.edges.select("graph_id", "v", "w", weight.alias("weight")).join(a, KEY).join(b, ["graph_id", "w"]).select("graph_id", "layer", "pv", "pw", "weight")
        digits = placed.agg(F.length(F.bin(F.coalesce(F.max("pw"), F.lit(0)))).alias("n")).first()["n"]
        each = placed.withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(digits - 1)))).select("*", F.expr("shiftright(pw, digit) & 1").alias("bit"), F.expr("shiftright(pw, digit + 1)").alias("high"))
        before = Window.partitionBy("graph_id", "layer", "digit", "high").orderBy("pv").rangeBetween(Window.unboundedPreceding, -1)
        seen = each.withColumn("seen", F.sum(F.when(F.col("bit") == 1, F.col("weight"))).over(before))
        return seen.filter("bit = 0").groupBy("graph_id").agg(F.coalesce(F.sum(F.col("weight") * F.col("seen")), F.lit(0)).alias("crossings"))

    # -- walks of single graphs, each in one task ------------------------------------

    def _each(self, f, schema: str) -> DataFrame:
        """f(graph's key, nodes, edges as (v, w, weight)) for each graph, nodes and edges in order; its rows."""
        weight = F.col("weight").cast("double") if "weight" in self.edges.columns else F.lit(1.0)
        nodes = self.nodes.select(*KEY).toDF(*KEY)
        edges = self.edges.select("graph_id", "v", "w", weight.alias("weight")).toDF("graph_id", "v", "w", "weight")

        def run(key, n: pa.Table, e: pa.Table) -> pa.Table:
            names = sorted(n.column("v").to_pylist())
            links = sorted(zip(e.column("v").to_pylist(), e.column("w").to_pylist(), e.column("weight").to_pylist(), strict=True))
            rows = f(key[0].as_py() if len(key) else None, names, links)
            return pa.Table.from_pylist([dict(zip(fields, r, strict=True)) for r in rows], own)

        node_type, key_type = self.nodes.schema["v"].dataType.simpleString(), self.nodes.schema["graph_id"].dataType.simpleString()
        full = schema.replace("KEY", key_type).replace("NODE", node_type)
        own = to_arrow_schema(T._parse_datatype_string(full))
        fields = own.names
        return nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInArrow(run, full)

    def walked(self, roots: dict | None = None, after: bool = False) -> DataFrame:
        """(graph_id, place, v): nodes depth first from the roots of each graph (all its nodes without any), each before what is behind it, or after it."""
        held = roots or {}

        def f(key, nodes, edges):
            order = graphs.walked(graphs.neighbours(nodes, edges), held.get(key, nodes), after)
            return [(key, i, v) for i, v in enumerate(order)]

        return self._each(f, "graph_id KEY, place int, v NODE")

    def topological_order(self) -> DataFrame:
        """(graph_id, place, v, cyclic): every node behind its predecessors; of a graph with a cycle one row, cyclic."""

        def f(key, nodes, edges):
            order = graphs.sorted_topologically(nodes, edges)
            return [(key, i, v, False) for i, v in enumerate(order)] if order is not None else [(key, None, None, True)]

        return self._each(f, "graph_id KEY, place int, v NODE, cyclic boolean")

    def feedback_edges(self, greedy: bool = False) -> DataFrame:
        """(graph_id, v, w): edges whose reversal leaves no cycle, by a depth-first walk or greedily by weight."""

        def f(key, nodes, edges):
            cut = (graphs.greedy_cut if greedy else graphs.back_edges)(nodes, edges)
            return [(key, edges[i][0], edges[i][1]) for i in sorted(cut)]

        return self._each(f, "graph_id KEY, v NODE, w NODE")

    def acyclic(self, greedy: bool = False) -> Graph:
        """The graph with its feedback edges turned round (column reversed); self edges go."""
        gone = self.feedback_edges(greedy).distinct().withColumn("_turned", F.lit(True))
        edges = self.edges.filter("v <> w").join(gone, ["graph_id", "v", "w"], "left").withColumn("reversed", F.coalesce("_turned", F.lit(False)))
        turn = F.col("reversed")
        rest = [F.col(c) for c in self.edges.columns if c not in ("graph_id", "v", "w")]
        return replace(self, edges=edges.select("graph_id", F.when(turn, F.col("w")).otherwise(F.col("v")).alias("v"), F.when(turn, F.col("v")).otherwise(F.col("w")).alias("w"), *rest, "reversed"))

    def tight_tree(self) -> DataFrame:
        """(graph_id, v, rank): ranks of an acyclic graph by which the edges of length 1 span each of its components; least rank 0."""

        def f(key, nodes, edges):
            rank = graphs.layers(nodes, edges)
            if rank is None:
                return []
            rank, _ = graphs.tight_tree(nodes, edges, rank)
            least = min(rank.values(), default=0)
            return [(key, v, r - least) for v, r in rank.items()]

        return self._each(f, "graph_id KEY, v NODE, rank int")

    def layer_order(self) -> DataFrame:
        """(graph_id, v, layer, pos): layers by the tight tree's ranks, places by barycentre sweeps."""

        def f(key, nodes, edges):
            rank = graphs.layers(nodes, edges)
            if rank is None:
                return []
            rank, _ = graphs.tight_tree(nodes, edges, rank)
            least = min(rank.values(), default=0)
            rank = {v: r - least for v, r in rank.items()}
            place = graphs.ordered_layers(rank, edges)
            return [(key, v, rank[v], place[v]) for v in nodes]

        return self._each(f, "graph_id KEY, v NODE, layer int, pos int")

    def normalized(self, ranks: DataFrame) -> DataFrame:
        """Long edges as chains of one rank a step: (graph_id, v, w, step, rank) with step 0 at the first node."""
        at = ranks.select("graph_id", "v", "rank")
        placed = self.edges.select("graph_id", "v", "w").join(at, KEY).join(at.toDF("graph_id", "w", "end"), ["graph_id", "w"])
        return placed.select("graph_id", "v", "w", F.explode(F.sequence(F.lit(0), (F.col("end") - F.col("rank")).cast("int"))).alias("step"), "rank").withColumn("rank", F.col("rank") + F.col("step"))


def parse_edge_list(texts: DataFrame, id_col: str = "graph_id", text_col: str = "text") -> DataFrame:
    """Edges of line-wise lists: `a -> b`, `a -- b` or `a b`, then perhaps `#label`; // begins a comment. (graph_id, line, v, w, label)"""
    lines = texts.select(F.col(id_col).alias("graph_id"), F.posexplode(F.split(text_col, r"\r?\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", r"//.*$", ""))
    shape = r"^(\S+?)\s*(?:->|--|\s)\s*([^\s#]+)\s*(?:#\s*(.*))?$"
    return lines.select("graph_id", "line", bare.alias("bare")).filter(F.col("bare").rlike(shape)).select("graph_id", "line", *[F.regexp_extract("bare", shape, i).alias(n) for i, n in ((1, "v"), (2, "w"), (3, "label"))])


def ranked_neighbors(edges: DataFrame) -> DataFrame:
    """Successors of each node in order, numbered from 0."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("graph_id", "v").orderBy("w")) - 1)
