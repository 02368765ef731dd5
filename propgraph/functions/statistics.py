"""Topology and attribute statistics of a relation, and the sketches kept with it.

Degrees are over all nodes of the domain, those without edges counting 0; the standard deviation is
the population's; percentiles are the discrete ones. Null markers of attributes (least int, least long,
NaN) count as nulls.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propgraph.operators.walk import degree


def topology(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, unique_source_nodes, sparsity (1 - E / (N_src * N_tgt))."""
    e = edges.agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("src").alias("unique_source_nodes"))
    n = sources.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(targets.agg(F.count(F.lit(1)).alias("target_count")))
    return e.crossJoin(n).select(  # single rows
        "node_count", "edge_count", "unique_source_nodes", (1 - F.try_divide("edge_count", F.col("node_count").cast("double") * F.col("target_count"))).alias("sparsity")
    )


def degrees(edges: DataFrame, sources: DataFrame, threshold: float = 3.0) -> DataFrame:
    """One row: maximum, average, deviation and percentiles of the out-degree, and supernodes (above average + threshold * deviation)."""
    d = degree(edges, sources)
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY degree)").cast("long")
    stats = d.agg(F.max("degree").alias("max_degree"), F.avg("degree").alias("avg_degree"), F.stddev_pop("degree").alias("std_dev_degree"), disc(0.5).alias("p50"), disc(0.9).alias("p90"), disc(0.99).alias("p99"))
    high = d.crossJoin(F.broadcast(stats.select("avg_degree", "std_dev_degree"))).agg(F.count_if(F.col("degree") > F.col("avg_degree") + threshold * F.col("std_dev_degree")).alias("supernode_count"))
    return stats.crossJoin(high)


def multiplicity(edges: DataFrame) -> DataFrame:
    """One row: max and average in-degree of reached nodes, max out-degree, functional, injective, bijective, class."""
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_out"))
    into = edges.groupBy("tgt").agg(F.count(F.lit(1)).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0)).alias("max_in"), F.avg("d").alias("avg_in"))
    one, other = F.col("max_out") <= 1, F.col("max_in") <= 1
    kind = F.when(one & other, "1:1").when(one, "M:1").when(other, "1:M").otherwise("M:M")
    return out.crossJoin(into).select("max_out", "max_in", "avg_in", one.alias("is_functional"), other.alias("is_injective"), (one & other).alias("is_bijective"), kind.alias("multiplicity"))


def without_markers(column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == "int":
        return F.when(c != -(2**31), c)
    if kind == "bigint":
        return F.when(c != F.lit(-(2**63)), c)
    return F.when(~F.isnan(c), c) if kind in ("float", "double") else c


def zone_map(edges: DataFrame, attribute: str) -> DataFrame:
    """One row: minimum, maximum, null_count, distinct_count, has_nulls."""
    value = without_markers(attribute, dict(edges.dtypes)[attribute])
    out = edges.select(value.alias("v")).agg(F.min("v").alias("minimum"), F.max("v").alias("maximum"), F.count_if(F.col("v").isNull()).alias("null_count"), F.countDistinct("v").alias("distinct_count"))
    return out.withColumn("has_nulls", F.col("null_count") > 0)


def monotonicity(edges: DataFrame, attribute: str) -> DataFrame:
    """One row: whether the attribute never falls or never rises along each source's edges in (tgt, value) order.

    The order is per source, so a global sort in one task is not needed.
    """
    order = Window.partitionBy("src").orderBy("tgt", attribute)
    step = edges.select((F.col(attribute) - F.lag(attribute).over(order)).alias("step"))
    out = step.agg(F.coalesce(F.min("step") >= 0, F.lit(True)).alias("up"), F.coalesce(F.max("step") <= 0, F.lit(True)).alias("down"))
    return out.select(F.when(F.col("up"), "non_decreasing").when(F.col("down"), "non_increasing").otherwise("none").alias("monotonicity"))


def degree_sketch(edges: DataFrame, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """One row: approximate percentiles of the out-degrees of sources."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("d")).agg(F.percentile_approx("d", shares, accuracy).alias("percentiles"))


def distinct_estimate(edges: DataFrame, attribute: str, precision: int = 10) -> DataFrame:
    """One row: the HyperLogLog estimate of the distinct values."""
    return edges.agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col(attribute).cast("string"), precision)).alias("distinct_estimate"))


def exact_quantiles(values: DataFrame, shares: list[float], accuracy: int = 10_000) -> list:
    """The discrete percentiles of column ``v``, which has no nulls: of n values in order, number n - floor(n - n * share), 1 at least.

    Approximate percentiles bracket each of them, all values are counted between the brackets' ends, and only the distinct
    values of the bracket that holds a rank by these counts are sorted: about 8 / ``accuracy`` of all in a task. Ends that
    are off make brackets larger, not results wrong.
    """
    margin = 4 / accuracy
    ends = sorted({min(max(q + m, 0.0), 1.0) for q in shares for m in (-margin, margin)})
    total, low, high, cuts = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), F.percentile_approx("v", ends, accuracy)).head()
    if not total:
        return []
    ranks = [max(1, total - math.floor(total - total * q)) for q in shares]
    cuts = sorted({low, high, *cuts})
    slot = F.array_size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("v")))
    slots = {r.slot: r.n for r in values.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one a bracket
    before, at = 0, {}
    for k in sorted(slots):
        for rank in set(ranks):
            if before < rank <= before + slots[k]:
                at[rank] = (k, rank - before)
        before += slots[k]
    # a bracket (cuts[k - 1], cuts[k]] is sorted by distinct value
    wanted = sorted({k for k, _ in at.values()})
    counted = values.select(slot.alias("slot"), "v").filter(F.col("slot").isin(wanted)).groupBy("slot", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("v"))
    asked = None
    for k, n in set(at.values()):
        one = (F.col("slot") == k) & (F.col("upto") >= n) & (F.col("upto") - F.col("n") < n)
        asked = one if asked is None else asked | one
    found = {}
    for r in counted.withColumn("upto", upto).filter(asked).collect():  # one a share at most
        for rank, (k, n) in at.items():
            if r.slot == k and r.upto - r.n < n <= r.upto:
                found[rank] = r.v
    return [found[rank] for rank in ranks]


def equi_depth(edges: DataFrame, attribute: str, buckets: int = 20, accuracy: int = 10_000) -> DataFrame:
    """(bucket, low, high, n, nulls): buckets between the exact discrete percentiles, of equal numbers of values but for
    repeated ones; nulls of all. ``accuracy`` is that of the brackets in which they are looked for, not of the result."""
    value = without_markers(attribute, dict(edges.dtypes)[attribute])
    every = edges.select(value.alias("v"))
    rows, nulls = every.filter("v is not null"), every.agg(F.count_if(F.col("v").isNull()).alias("nulls"))
    cuts = exact_quantiles(rows, [i / buckets for i in range(1, buckets)], accuracy)
    at = sum([(F.col("v") > c).cast("int") for c in cuts], F.lit(0))
    return rows.groupBy(at.alias("bucket")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(nulls))  # one row


def zone_map_text(edges: DataFrame, attribute: str) -> str:
    """The zone map as a line of text: with decimals if either bound has a fraction, as whole numbers if not."""
    low, high, nulls, distinct, _ = zone_map(edges, attribute).head()
    shown = [None if v is None else f"{float(v):.6f}" if float(low) % 1 or float(high) % 1 else str(int(v)) for v in (low, high)]
    return f"{attribute}: min {shown[0]}, max {shown[1]}, nulls {nulls}, distinct {distinct}"


def sketches(graph, precision: int = 12) -> DataFrame:
    """(key, rows, estimate, sketch): a HyperLogLog sketch for the sources and for each attribute of each relation,
    under ``stats.relation.<name>.out_degree`` and ``stats.relation.<name>.attribute.<attribute>``; sketches of parts merge."""
    out = None
    for r in graph.relations.values():
        columns = [("out_degree", F.col("src"), F.countDistinct("src"))] + [(f"attribute.{c}", F.col(c), F.count(F.lit(1))) for c in r.edges.columns if c not in ("src", "tgt")]
        for name, column, rows in columns:
            one = r.edges.agg(rows.alias("rows"), F.hll_sketch_agg(column.cast("string"), precision).alias("sketch"))
            one = one.select(F.lit(f"stats.relation.{r.name}.{name}").alias("key"), "rows", F.hll_sketch_estimate("sketch").alias("estimate"), "sketch")
            out = one if out is None else out.unionByName(one)
    return out
