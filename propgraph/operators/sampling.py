"""Seeded samples of neighbours and random walks: pure functions of (seed, step, walker, edge)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.operators.maintenance import numbered
from propgraph.plans.staging import staged

#: Prime modulus and multipliers of the sampling hash; all products stay within 63 bits.
MODULUS, FACTORS = 2147483647, (48271, 69621, 39373)


def mixed(*values: Column | int) -> Column:
    """A hash in [0, 2^31 - 1) by multiplicative steps, which any SQL engine can repeat."""
    out = F.lit(12345).cast("long")
    for k, v in enumerate(values):
        v = F.lit(v) if isinstance(v, int) else v
        out = F.pmod((out + F.pmod(v.cast("long"), F.lit(MODULUS))) * FACTORS[k % 3] + 11, F.lit(MODULUS).cast("long"))
    return out


def mixed_sql(*values: str | int) -> str:
    """The SQL of :func:`mixed`, for non-negative values."""
    out = "12345::BIGINT"
    for k, v in enumerate(values):
        out = f"((({out}) + (({v})::BIGINT % {MODULUS})) * {FACTORS[k % 3]} + 11) % {MODULUS}"
    return out


def sample_neighbours(edges: DataFrame, start: DataFrame, fanouts: list[int], seed: int = 1) -> DataFrame:
    """(hop, src, tgt): for each hop at most so many distinct neighbours of each node of the layer before."""
    links = staged(edges.select("src", "tgt").distinct(), "edges")
    layer, out = start.select("id").distinct(), None
    for hop, fanout in enumerate(fanouts, 1):
        near = links.join(layer.withColumnRenamed("id", "src"), "src", "left_semi").withColumn("h", mixed(seed, hop, F.col("src"), F.col("tgt")))
        order = Window.partitionBy("src").orderBy("h", "tgt")
        rows = staged(near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= fanout).select(F.lit(hop).alias("hop"), "src", "tgt"), "sample")
        out = rows if out is None else out.unionByName(rows)
        layer = rows.select(F.col("tgt").alias("id")).distinct()
    return out


def random_walks(edges: DataFrame, start: DataFrame, length: int, restart: float = 0.15, seed: int = 1) -> DataFrame:
    """(walker, step, id): independent walkers from each start; a walker restarts at its seed with the
    given probability and stays where it is at a dead end.

    All edges are numbered once in (src, tgt) order, by range partitions, so a hub's neighbours are spread
    over tasks; a step adds its draw to the number of the node's first edge and looks that edge up.
    """
    links = staged(numbered(edges.select("src", "tgt").distinct(), ["src", "tgt"], "at").select("src", "tgt", "at"), "edges")
    degrees = staged(links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"), F.min("at").alias("first")), "degrees")
    state = staged(start.select(F.col("id").alias("walker"), F.lit(0).alias("step"), "id").distinct(), "walk")
    out = state
    for step in range(1, length + 1):
        here = state.select("walker", F.col("id").alias("src")).join(degrees, "src", "left")
        pick = here.withColumn("at", F.col("first") + F.pmod(mixed(seed, step, F.col("walker"), F.col("src")), F.col("deg")))
        moved = pick.join(links.select("at", "tgt"), "at", "left")
        coin = mixed(seed + 1, step, F.col("walker")) < int(restart * MODULUS)
        state = staged(moved.select("walker", F.lit(step).alias("step"), F.when(coin, F.col("walker")).otherwise(F.coalesce("tgt", "src")).alias("id")), "walk")
        out = out.unionByName(state)
    return out
