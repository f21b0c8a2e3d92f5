"""Trees as edges: roots, heights and heavy paths, all by pointers that double their reach from round to round.

A tree's edges are walked once each way in a tour that turns, at every node, from one neighbour to the next one. Ranking that
tour finds each component's root (its smallest node) and, of an edge's two ways, the one that is gone first, which leads from
parent to child. Ancestors, lengths and heights then follow in rounds whose number grows with the logarithm of a tree's depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.contours import ranked
from plumbline.operators.iterative import topmost
from plumbline.operators.rounds import materialise, release


def rooted(edges: DataFrame) -> DataFrame:
    """(node, parent, len) of every node of the forest ``edges`` (a, b, len), which holds no cycles and no edge twice; the
    smallest node of a tree is its root and has no parent."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "len").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "len"))
    both = materialise(both)
    # At v, the walk that came from u goes on to the neighbour after u.
    order = Window.partitionBy("v").orderBy("u")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.coalesce(F.lead("u").over(order), F.first("u").over(whole))
    tour = materialise(both.select("u", "v", F.col("v").alias("nu"), turn.alias("nv"), (F.lead("u").over(order).isNull()).alias("back")))
    first = ranked(tour.select("u", "v", "nu", "nv"), [], True)
    # The tour ends where it would turn to the root's first neighbour again.
    cut = first.select("u", "v", "m").join(tour, ["u", "v"])
    ends = (F.col("v") == F.col("m")) & F.col("back")
    walk = ranked(cut.select("u", "v", F.when(~ends, F.col("nu")).alias("nu"), F.when(~ends, F.col("nv")).alias("nv")), [], False)
    there = walk.select("u", "v", "r").join(walk.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("r").alias("r2")), ["u", "v"]).where("r > r2")
    child = there.select("u", "v").join(both, ["u", "v"]).select(F.col("v").alias("node"), F.col("u").alias("parent"), F.col("len").cast("double").alias("len"))
    root = first.groupBy("m").agg(F.count("*").alias("n")).select(F.col("m").alias("node"), F.lit(None).cast(dict(edges.dtypes)["a"]).alias("parent"), F.lit(0.0).alias("len"))
    made = materialise(child.unionByName(root))
    release(both, tour)
    return made


def measured(tree: DataFrame) -> DataFrame:
    """``tree`` (node, parent, len) with ``depth``, the edges to the root, and ``height``, the longest way down to a leaf."""
    state = materialise(tree.select("node", F.col("parent").alias("anc"), "len", F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.lit(0.0).alias("height")))
    while not state.where("anc is not null").isEmpty():
        up = state.where("anc is not null").groupBy(F.col("anc").alias("node")).agg(F.max(F.col("len") + F.col("height")).alias("up"))
        far = state.select(F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("len").alias("_len"), F.col("depth").alias("_depth"))
        jumped = state.join(far, "anc", "left").join(up, "node", "left")
        after = jumped.select("node", F.col("_anc").alias("anc"), (F.col("len") + F.coalesce("_len", F.lit(0.0))).alias("len"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.greatest("height", F.coalesce("up", F.lit(0.0))).alias("height"))
        after = materialise(after)
        release(state)
        state = after
    return tree.join(state.select("node", "depth", "height"), "node")


def heavy_paths(edges: DataFrame) -> DataFrame:
    """(path, seq, node): the forest as strokes that go from each node into its highest child, the smaller one of equals. A
    stroke is named by its first node of its own; before that stands its parent, so that every edge is drawn once."""
    tree = materialise(measured(rooted(edges)))
    best = tree.where("parent is not null").groupBy("parent").agg(F.min(F.struct((-F.col("height")).alias("h"), "node")).alias("b"))
    heavy = best.select(F.col("b.node").alias("node"), F.lit(True).alias("heavy"))
    top = tree.join(heavy, "node", "left").select("node", F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("node")).alias("top"))
    top = topmost(top)
    head = tree.select(F.col("node").alias("top"), F.col("depth").alias("start"), F.col("parent").alias("before"))
    on = tree.select("node", "depth").join(top, "node").join(head, "top")
    own = F.struct((F.col("depth") - F.col("start") + F.col("before").isNotNull().cast("int")).alias("seq"), F.col("node").alias("node"))
    lead = F.struct(F.lit(0).alias("seq"), F.col("before").alias("node"))
    points = F.explode(F.when((F.col("node") == F.col("top")) & F.col("before").isNotNull(), F.array(lead, own)).otherwise(F.array(own)))
    return on.select(F.col("top").alias("path"), points.alias("p")).select("path", "p.seq", "p.node")
