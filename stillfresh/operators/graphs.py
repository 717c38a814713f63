"""Layers, reachability and cycles of graphs given as edges (src, dst), in few rounds also for long chains.

Nodes with one edge in and one out are contracted first: list ranking by pointer doubling
finds each one's chain and place in it, eight times as far with each written table. What is
left, mostly small, is walked a step at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

DOUBLINGS = 3


@dataclass
class Contracted:
    """``nodes``: node, of all that aren't in a chain; ``members``: node, chain, place (from 1); ``chains``: chain, src, dst,
    weight; ``edges``: src, dst, weight between nodes, the heaviest of each pair; ``rings``: node, of cycles that
    no other node touches."""

    nodes: DataFrame
    members: DataFrame
    chains: DataFrame
    edges: DataFrame
    rings: DataFrame


def contract(edges: DataFrame, keep: DataFrame | None = None) -> Contracted:
    """The graph without the inner nodes of its chains; those of ``keep`` (node) are no inner nodes."""
    edges = written(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(None).cast(edges.schema["src"].dataType).alias("p")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.col("src").alias("p")))
    degrees = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.max("p").alias("pred"))
    inner = (F.col("o") == 1) & (F.col("i") == 1) & (F.col("pred") != F.col("node"))
    if keep is not None:
        degrees = degrees.join(keep.select("node").distinct().withColumn("kept", F.lit(True)), "node", "left")
        inner = inner & F.col("kept").isNull()
    facts = written(degrees.select("node", "pred", inner.alias("inner")))
    unary = facts.filter("inner").select("node", "pred")
    outer = facts.filter("NOT inner").select("node")
    before = unary.select(F.col("node").alias("pred"), F.lit(True).alias("goes"))
    at = unary.join(before, "pred", "left").select("node", F.when(F.col("goes"), F.col("pred")).otherwise(F.col("node")).alias("to"), F.when(F.col("goes"), 1).otherwise(0).cast("long").alias("steps"), F.coalesce("goes", F.lit(False)).alias("open"))
    most, reach = max(1, unary.count()), 1
    while True:
        for _ in range(DOUBLINGS):
            further = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"), F.col("open").alias("goes"))
            at = at.join(further, "to").select("node", F.col("next").alias("to"), (F.col("steps") + F.when(F.col("open"), F.col("more")).otherwise(0)).alias("steps"), (F.col("open") & F.col("goes")).alias("open"))
            reach *= 2
        at = written(at)
        if reach > most or at.filter("open").isEmpty():
            break
    rings = at.filter("open").select("node")
    members = at.filter("NOT open").select("node", F.col("to").alias("chain"), (F.col("steps") + 1).alias("place"))
    heads = unary.select(F.col("node").alias("chain"), F.col("pred").alias("src"))
    tails = members.join(edges.withColumnRenamed("src", "node"), "node").join(outer.select(F.col("node").alias("dst")), "dst", "left_semi").select("chain", "dst", (F.col("place") + 1).alias("weight"))
    chains = written(tails.join(heads, "chain").select("chain", "src", "dst", "weight"))
    plain = edges.join(outer.select(F.col("node").alias("src")), "src", "left_semi").join(outer.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit(1).cast("long").alias("weight"))
    short = written(plain.unionByName(chains.select("src", "dst", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight")))
    return Contracted(outer, members, chains, short, rings)


def layers(edges: DataFrame) -> DataFrame:
    """(node, layer): the longest path to each node from nodes without inputs. A cycle, reached or not, is an error.

    Nodes of the contracted graph are settled when all edges into them are; a round is one
    written table of those that wait.
    """
    g = contract(edges)
    if not g.rings.isEmpty():
        raise ValueError("the lineage has a cycle")
    into = g.edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("missing"))
    waiting = g.nodes.join(into, "node", "left").select("node", F.coalesce("missing", F.lit(0)).alias("missing"), F.lit(0).cast("long").alias("layer"))
    waiting = written(waiting)
    done = None
    while not waiting.isEmpty():
        front = waiting.filter("missing = 0").select("node", "layer")
        if front.isEmpty():
            raise ValueError("the lineage has a cycle")
        done = front if done is None else done.unionByName(front)
        met = front.join(g.edges.withColumnRenamed("src", "node"), "node").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("layer") + F.col("weight")).alias("best"))
        left = waiting.filter("missing > 0").join(met, "node", "left")
        waiting = written(left.select("node", (F.col("missing") - F.coalesce("n", F.lit(0))).alias("missing"), F.greatest("layer", F.coalesce("best", F.lit(0))).alias("layer")))
    if done is None:
        return waiting.select("node", F.col("layer").cast("int"))
    done = written(done)
    inside = g.members.join(g.chains.select("chain", F.col("src").alias("head")), "chain").join(done.select(F.col("node").alias("head"), "layer"), "head")
    return done.select("node", F.col("layer").cast("int")).unionByName(inside.select("node", (F.col("layer") + F.col("place")).cast("int").alias("layer")))


def reached(g: Contracted, starts: DataFrame) -> DataFrame:
    """(start, node): nodes of the contracted graph that are on a path from each start (start, node), the starts among them."""
    done = front = written(starts.select("start", "node").distinct())
    while True:
        front = written(front.join(g.edges.withColumnRenamed("src", "node"), "node").select("start", F.col("dst").alias("node")).distinct().join(done, ["start", "node"], "left_anti"))
        if front.isEmpty():
            return done
        done = done.unionByName(front)


def inside(g: Contracted, pairs: DataFrame) -> DataFrame:
    """(start, node): members of the chains that leave a reached node."""
    return g.members.join(g.chains.select("chain", F.col("src").alias("head")), "chain").join(pairs.select("start", F.col("node").alias("head")), "head").select("start", "node")


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): all nodes on a path from each start, itself among them. ``starts``: node."""
    own = starts.select(F.col("node").alias("start"), "node").distinct()
    g = contract(edges, starts.select("node"))
    pairs = reached(g, own)
    return pairs.unionByName(inside(g, pairs))


def descendants(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """node: the starts (node) and all that follows them; each node once, whatever start it was reached from."""
    g = contract(edges, starts.select("node"))
    pairs = reached(g, starts.select(F.lit(0).alias("start"), "node"))
    return pairs.unionByName(inside(g, pairs)).select("node").distinct()


def on_cycles(g: Contracted) -> DataFrame:
    """node: all nodes on a cycle.

    Of the contracted graph, nodes without a way in or out are trimmed round by round; what
    remains, mostly nothing, is followed from each of its nodes.
    """
    core = written(g.edges.select("src", "dst"))
    n = core.count()
    while n:
        kept = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        core = written(kept.select("src", "dst"))
        left = core.count()
        if left == n:
            break
        n = left
    if not n:
        return g.rings
    small = Contracted(g.nodes, g.members, g.chains, core, g.rings)
    pairs = written(reached(small, core.select(F.col("src").alias("start"), F.col("src").alias("node"))))
    back = pairs.select(F.col("start").alias("dst"), F.col("node").alias("src"))  # dst reaches src
    loops = core.join(back, ["src", "dst"])
    outer = loops.select(F.col("src").alias("node")).distinct()
    chains = g.chains.join(loops, ["src", "dst"], "left_semi")
    return outer.unionByName(g.members.join(chains.select("chain"), "chain", "left_semi").select("node")).unionByName(g.rings)
