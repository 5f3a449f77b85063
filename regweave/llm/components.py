"""Connected components of an edge table by contraction with pointer jumping.

In each round every node points to its smallest neighbour or itself. Pointers never lead to a larger node, so they form
trees; the move table is squared (each pointer replaced by the pointer of its end) until it is stable, which takes a
number of joins logarithmic in the depth of the trees. Then the edges are renamed to the roots; edges inside one tree
vanish. A path of rising ids is one tree, so it needs one round of logarithmically many joins. Every step is cut by a
checkpoint in the shared folder; the moves of the rounds are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regweave.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for nodes with an edge. ``edges``: long columns a, b.

    Edges to itself, repeated edges and null ends are ignored; no edges give an empty result.
    """
    e = materialize(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    moves: list[DataFrame] = []
    while not e.isEmpty():
        ends = e.select(F.col("a").alias("node"), F.col("b").alias("to")).union(e.select("b", "a"))
        move = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to"))
        move = _to_roots(materialize(move))
        moves.append(move)
        renamed = e.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").drop("a")
        renamed = renamed.join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        e = renamed.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        e = materialize(e)
    if not moves:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = moves[0].withColumnRenamed("to", "component")
    for move in moves[1:]:
        step = move.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out


def _to_roots(move: DataFrame) -> DataFrame:
    """``node, to`` with every pointer led on to the end of its chain."""
    while True:
        further = move.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        end = F.coalesce("_next", "to")
        jumped = move.join(further, "to", "left").select("node", end.alias("to"), (end != F.col("to")).alias("moved"))
        jumped = materialize(jumped)
        move = jumped.select("node", "to")
        if jumped.filter("moved").isEmpty():
            return move
