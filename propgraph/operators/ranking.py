"""Centralities by repeated products of the edges with a vector.

The edges are written once, in buckets by the end that is joined, with weights folded into one row for each
pair; a round shuffles the vector and partial sums, never the edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propgraph.operators.vectors import vxm
from propgraph.plans.rounds import Rounds
from propgraph.plans.staging import keyed, staged

#: Rounds that run in one job where no change is measured between them.
JOINED = 5


def _folded(edges: DataFrame) -> DataFrame:
    return keyed(edges.groupBy("src", "tgt").agg(F.count(F.lit(1)).cast("double").alias("m")), "src", "edges")


def _iterate(start: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """Applies ``step`` until the L1 change is below the tolerance, at most ``rounds`` times; with a
    tolerance of 0 no change is measured and no job runs between rounds but those that keep state."""
    kept = Rounds("vector", every=1 if tolerance > 0 else JOINED)
    now = start
    for _ in range(rounds):
        new = kept.keep(step(now))
        if tolerance > 0:
            moved = new.join(now.withColumnRenamed("val", "old"), "id").agg(F.sum(F.abs(F.col("val") - F.col("old")))).head()[0] or 0.0
            if moved < tolerance:
                return new
        now = new
    return now


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 10, tolerance: float = 0.0, redistribute_dangling: bool = False) -> DataFrame:
    """p' = d * sum(p / outdegree) + (1 - d) / n from 1 / n; what dangling nodes hold is lost unless redistributed."""
    folded = _folded(edges)
    n = nodes.count()
    degrees = folded.groupBy("src").agg(F.sum("m").alias("deg"))
    share = keyed(folded.join(degrees, "src").select("src", "tgt", (F.col("m") / F.col("deg")).alias("share")), "src", "edges")
    ids = keyed(nodes.select("id"), "id", "nodes")
    dangling = staged(ids.join(degrees.select(F.col("src").alias("id")), "id", "left_anti"), "nodes") if redistribute_dangling else None

    def step(p: DataFrame) -> DataFrame:
        lost = 0.0
        if dangling is not None:
            lost = (p.join(dangling, "id", "left_semi").agg(F.sum("val")).head()[0] or 0.0) / n
        came = vxm(share, p, weight="share")
        return ids.join(came, "id", "left").select("id", (damping * (F.coalesce("val", F.lit(0.0)) + lost) + (1 - damping) / n).alias("val"))

    return _iterate(ids.select("id", F.lit(1.0 / max(n, 1)).alias("val")), step, rounds, tolerance)


def katz(edges: DataFrame, nodes: DataFrame, alpha: float = 0.01, beta: float = 1.0, rounds: int = 10, tolerance: float = 0.0) -> DataFrame:
    """x' = alpha * A'x + beta from 1 / n."""
    folded, ids = _folded(edges), keyed(nodes.select("id"), "id", "nodes")
    n = ids.count()

    def step(x: DataFrame) -> DataFrame:
        return ids.join(vxm(folded, x, weight="m"), "id", "left").select("id", (alpha * F.coalesce("val", F.lit(0.0)) + beta).alias("val"))

    return _iterate(ids.select("id", F.lit(1.0 / max(n, 1)).alias("val")), step, rounds, tolerance)


def _normed(vector: DataFrame) -> DataFrame:
    """Divided by its L2 norm, one number that is fetched; the vector is written for that."""
    vector = staged(vector, "vector")
    norm = vector.agg(F.sqrt(F.sum(F.col("val") * F.col("val")))).head()[0] or 0.0
    return vector.select("id", (F.col("val") / norm if norm > 0 else F.lit(0.0)).alias("val"))


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 10, tolerance: float = 0.0) -> DataFrame:
    """x' = A'x scaled to length 1, from 1 / sqrt(n)."""
    folded, ids = _folded(edges), keyed(nodes.select("id"), "id", "nodes")
    n = ids.count()

    def step(x: DataFrame) -> DataFrame:
        came = ids.join(vxm(folded, x, weight="m"), "id", "left").select("id", F.coalesce("val", F.lit(0.0)).alias("val"))
        return _normed(came)

    return _iterate(ids.select("id", F.lit(max(n, 1) ** -0.5).alias("val")), step, rounds, tolerance)


def hits(edges: DataFrame, nodes: DataFrame, rounds: int = 10, tolerance: float = 0.0) -> DataFrame:
    """(id, hub, authority): a' = A'h and h' = A a', each scaled to length 1, from 1 / sqrt(n)."""
    folded, ids = _folded(edges), keyed(nodes.select("id"), "id", "nodes")
    turned = keyed(folded.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "m"), "src", "edges")
    first = F.lit(max(ids.count(), 1) ** -0.5)
    state, kept = ids.select("id", first.alias("hub"), first.alias("authority")), Rounds("hits")

    def filled(v: DataFrame) -> DataFrame:
        return ids.join(v, "id", "left").select("id", F.coalesce("val", F.lit(0.0)).alias("val"))

    for _ in range(rounds):
        a = _normed(filled(vxm(folded, state.select("id", F.col("hub").alias("val")), weight="m")))
        h = _normed(filled(vxm(turned, a, weight="m")))
        new = kept.keep(h.withColumnRenamed("val", "hub").join(a.withColumnRenamed("val", "authority"), "id"))
        if tolerance > 0:
            old = state.select("id", F.col("hub").alias("h0"), F.col("authority").alias("a0"))
            moved = new.join(old, "id").agg(F.sum(F.abs(F.col("hub") - F.col("h0")) + F.abs(F.col("authority") - F.col("a0")))).head()[0] or 0.0
            if moved < tolerance:
                return new
        state = new
    return state
