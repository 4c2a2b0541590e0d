"""Graphs as edge relations: degrees, reachability and strongly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rounds import Rounds


def reachable(edges: DataFrame, starts: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """node, level: the starts (node; level 0) and all that edges (a, b) lead to from them, with the fewest steps. Only new nodes are followed.

    Edges are computed once and kept.  Of new nodes only those that edges begin at are met
    with them: where these are few, no round moves the edges.
    """
    rounds = rounds or Rounds(edges.sparkSession, "reach")
    edges = rounds.keep(edges.select("a", "b"))
    begins = rounds.keep(edges.select("a").distinct())
    seen = new = rounds.keep(starts.select("node").distinct().withColumn("level", F.lit(0)))
    level = 0
    while not (front := rounds.keep(begins.join(new.select(F.col("node").alias("a")), "a", "left_semi"))).isEmpty():
        level += 1
        came = edges.join(front, "a", "left_semi").select(F.col("b").alias("node")).distinct()
        new = rounds.keep(came.join(seen, "node", "left_anti").select("node", F.lit(level).alias("level")))
        seen = seen.union(new)
    return seen


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the strongly connected component of each node, named by a node of it.

    Nodes without a way in or without a way out are components of their own and go first
    (trimming).  Then every node takes the largest name that reaches it, its colour; in
    each colour all that reaches the node of that name, going backwards, is one
    component.  Components go, and what is left is trimmed and coloured anew, so several
    components are found in each round.  The driver holds counts only.
    """
    rounds = Rounds(edges.sparkSession, "components")
    left = rounds.keep(nodes.select("node").distinct())
    links = edges.where("a <> b").select("a", "b").distinct()
    links = rounds.keep(links.join(left.withColumnRenamed("node", "a"), "a", "left_semi").join(left.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b"))
    done = None
    while not left.isEmpty():
        ends = links.select(F.col("a").alias("node")).distinct().intersect(links.select(F.col("b").alias("node")).distinct())
        inner = rounds.keep(left.join(ends, "node", "left_semi"))
        found = left.join(inner, "node", "left_anti").select("node", F.col("node").alias("component"))
        if inner.count() == left.count():
            colour = _coloured(inner, links, rounds)
            same = links.join(colour.toDF("a", "ca"), "a").join(colour.toDF("b", "cb"), "b").where("ca = cb")
            back = reachable(same.select(F.col("b").alias("a"), F.col("a").alias("b")), colour.where("node = colour"), rounds)
            found = colour.join(back.select("node"), "node", "left_semi").select("node", F.col("colour").alias("component"))
        found = rounds.keep(found)
        done = found if done is None else done.union(found)
        left = rounds.keep(left.join(found, "node", "left_anti"))
        links = rounds.keep(links.join(found.select(F.col("node").alias("a")), "a", "left_anti").join(found.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"))
    return left.select("node", F.col("node").alias("component")) if done is None else done


def _coloured(nodes: DataFrame, links: DataFrame, rounds: Rounds) -> DataFrame:
    """node, colour: the largest name of the nodes that reach each, itself among them. Only changed colours are handed on."""
    colour = new = rounds.keep(nodes.select("node", F.col("node").alias("colour")))
    while not new.isEmpty():
        came = links.join(new.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("came"))
        new = rounds.keep(came.join(colour, "node").where("came > colour").select("node", F.col("came").alias("colour")))
        colour = rounds.keep(colour.join(new, "node", "left_anti").union(new))
    return colour
