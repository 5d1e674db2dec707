"""Layered drawings of graphs: cycles cut, ranks, long edges split, order, coordinates."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.graph import Graph


def layout(graph: Graph, width: float = 50.0, height: float = 50.0, greedy: bool = False) -> DataFrame:
    """(graph_id, v, layer, pos, x, y): every node's place, layers downwards, nodes side by side and each layer centred.

    Steps: edges that close a cycle are turned round; ranks by a tight tree; edges over several ranks become chains of
    dummy nodes, which take part in ordering; places by barycentre sweeps; coordinates by width and height. Dummies aren't
    returned. A graph without edges is one layer.
    """
    flat = replace(graph.acyclic(greedy), nodes=graph.nodes.select("graph_id", F.col("v").cast("string").alias("v")))
    flat = replace(flat, edges=flat.edges.select("graph_id", F.col("v").cast("string").alias("v"), F.col("w").cast("string").alias("w"), F.lit(None).cast("string").alias("name")).distinct())
    ranks = flat.tight_tree().checkpoint()
    steps = flat.normalized(ranks)
    last = Window.partitionBy("graph_id", "v", "w")
    end = F.max("step").over(last)
    own = F.when(F.col("step") == 0, F.col("v")).when(F.col("step") == F.col("end"), F.col("w")).otherwise(F.concat_ws("\0", "v", "w", "step"))
    chain = steps.withColumn("end", end).withColumn("node", own)
    following = F.lead("node").over(last.orderBy("step"))
    edges = chain.withColumn("next", following).filter("next is not null").select("graph_id", F.col("node").alias("v"), F.col("next").alias("w"), F.lit(None).cast("string").alias("name")).distinct()
    nodes = flat.nodes.select("graph_id", "v").unionByName(chain.filter("step > 0 and step < end").select("graph_id", F.col("node").alias("v"))).distinct()
    order = Graph(nodes, edges).layer_order()
    row = Window.partitionBy("graph_id", "layer")
    placed = order.withColumns({"x": (F.col("pos") - (F.max("pos").over(row)) / 2.0) * width, "y": F.col("layer") * height})
    return placed.join(flat.nodes.select("graph_id", "v"), ["graph_id", "v"], "left_semi").select("graph_id", "v", "layer", "pos", "x", "y")
