"""Connected components by hooking and pointer jumping over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propgraph.operators.joins import shuffled
from propgraph.plans.rounds import Rounds
from propgraph.plans.staging import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of ``edges`` (src, dst); component is the smallest id reachable.

    Each round looks at the grandparent of every neighbour, hooks the node and its parent to the
    smallest one and jumps pointers, so long chains need a logarithmic number of rounds. State is
    two narrow columns a node, written to the shared folder each round; nothing is broadcast. Hubs
    only meet joins whose sides are both shuffled, which adaptive execution splits, and sums with
    partial aggregation. Rows with a null end are ignored; self-loops give a component of one.
    """
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src is not null and dst is not null")
    both = staged(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "cc-edges")
    kept = Rounds("cc-state", forget=True)
    state = both.groupBy(F.col("src").alias("id")).agg(F.least("id", F.min("dst")).alias("f"))
    state = kept.keep(_with_grandparent(state))
    for _ in range(max_rounds):
        best = shuffled(both, state.select(F.col("id").alias("dst"), "gf"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("gf").alias("m"))
        near = shuffled(state, best, "id")
        hook = near.groupBy(F.col("f").alias("id")).agg(F.min("m").alias("h"))
        moved = shuffled(near, hook, "id", "left").select("id", F.least("f", "gf", "m", F.coalesce("h", "f")).alias("f"), F.col("gf").alias("old"))
        state = kept.keep(_with_grandparent(moved))
        if state.filter("gf <> old").isEmpty():
            return state.select("id", F.col("gf").alias("component"))
        state = state.drop("old")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def afforest(edges: DataFrame, neighbours: int = 2) -> DataFrame:
    """As :func:`connected_components`, by sampling: components of the first ``neighbours`` neighbours of each node come
    first; then the largest of them is skipped, and only edges that leave a node outside it are looked at."""
    pairs = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src is not null and dst is not null")
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = staged(both, "cc-edges")
    few = both.groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b")) if neighbours == 2 else None
    if few is not None:  # two neighbours by partial sums; a hub's edges are not gathered
        some = few.select("src", F.explode(F.array("a", "b")).alias("dst")).distinct()
    else:
        order = Window.partitionBy("src").orderBy("dst")
        some = both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= neighbours).drop("nth")
    first = staged(connected_components(some), "cc-sample")
    sizes = first.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("c")).head()
    if largest is None or largest[0] is None:
        return first
    outside = first.filter(F.col("component") != largest[0])
    rest = both.join(outside.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(first.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst").filter("a <> b")
    merged = connected_components(rest.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()).withColumnRenamed("component", "least")
    return first.join(merged.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("least", "component").alias("component"))


def _with_grandparent(state: DataFrame) -> DataFrame:
    parents = state.select(F.col("id").alias("f"), F.col("f").alias("gf"))
    return shuffled(state, parents, "f", "left").withColumn("gf", F.coalesce("gf", "f"))
