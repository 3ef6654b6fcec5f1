"""Strongly connected components of a directed graph, as joins and groupings of its edges.

Nodes that nothing enters or nothing leaves are in no cycle and are trimmed first.  What is
left is coloured: every node takes the smallest node that reaches it.  A component lies
within one colour, so edges between colours go; the node a colour is named after and all
nodes of the colour that lead back to it are one component, and they leave the graph.  Each
step looks only at nodes the step before has changed, and writes its state to the shared
folder, so nothing of the graph is on the driver and a lost executor costs no earlier step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repolytics.storage import Rounds


def _some(df: DataFrame) -> bool:
    return bool(df.limit(1).count())


def _trimmed(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """Edges between nodes that both are entered and left; the others cannot lie on a cycle."""
    before = edges.count()
    while True:
        entered, left = edges.select("dst").distinct(), edges.select("src").distinct()
        kept = edges.join(entered.withColumnRenamed("dst", "src"), "src", "left_semi").join(left.withColumnRenamed("src", "dst"), "dst", "left_semi")
        edges = rounds.put(kept.select("src", "dst"), "edges")
        after = edges.count()
        if after in (before, 0):
            return edges
        before = after


def _coloured(edges: DataFrame, rounds: Rounds) -> DataFrame:
    """node, colour: the smallest node from which each can be reached, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = rounds.put(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("fresh")), "colours")
    while _some(state.filter("fresh")):
        told = edges.join(state.filter("fresh").select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
        lower = F.coalesce(F.col("told") < F.col("colour"), F.lit(False))
        state = rounds.put(state.join(told, "node", "left").select("node", F.when(lower, F.col("told")).otherwise(F.col("colour")).alias("colour"), lower.alias("fresh")), "colours")
    return state.select("node", "colour")


def _leading_back(edges: DataFrame, colours: DataFrame, rounds: Rounds) -> DataFrame:
    """node, colour of the nodes that lead back to the node their colour is named after."""
    ends = edges.select(F.col("src").alias("from"), F.col("dst").alias("node"))
    state = rounds.put(colours.filter("node = colour").withColumn("fresh", F.lit(True)), "back")
    while _some(state.filter("fresh")):
        step = ends.join(state.filter("fresh").select("node", "colour"), "node").select(F.col("from").alias("node"), "colour").distinct()
        new = step.join(state.select("node"), "node", "left_anti").withColumn("fresh", F.lit(True))
        state = rounds.put(state.withColumn("fresh", F.lit(False)).unionByName(new), "back")
    return state.select("node", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component of every node that lies on a cycle of the edges (src, dst).

    component is the smallest node of the component.  A node with an edge to itself is one,
    alone if need be.  Repeated edges count once; edges without an end are left out; an
    empty graph gives an empty result.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark, "components")
    every = rounds.put(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "all")
    own = every.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    rest = rounds.put(every.filter("src <> dst"), "edges")
    found = rounds.put(own.limit(0), "found")
    while _some(rest := _trimmed(rest, rounds)):
        colours = _coloured(rest, rounds)
        a, b = (colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour")) for end in ("src", "dst"))
        inner = rounds.put(rest.join(a, "src").join(b, "dst").filter("src_colour = dst_colour").select("src", "dst"), "inner")
        members = _leading_back(inner, colours, rounds)
        alone = members.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("colour")
        several = members.join(alone, "colour", "left_semi").select("node", F.col("colour").alias("component"))
        found = rounds.put(found.unionByName(several), "found")
        gone = members.select("node")
        rest = rounds.put(inner.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
    alone = own.join(found.select("node"), "node", "left_anti")
    return rounds.done(found.unionByName(alone))
