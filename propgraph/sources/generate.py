"""Synthetic graphs. Every random draw is a hash of (seed, row, draw), so a graph does not depend on partitions.

All but preferential attachment, which is sequential by nature, are generated where the rows are.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALIASES = {
    "graph500": "graph500", "rmat": "graph500", "kronecker": "graph500", "social": "social", "barabasi": "social", "barabasi-albert": "social", "ba": "social", "powerlaw": "social",
    "social-sbm": "sbm", "sbm": "sbm", "communities": "sbm", "clusters": "sbm", "erdos-renyi": "erdos-renyi", "erdos_renyi": "erdos-renyi", "random": "erdos-renyi", "er": "erdos-renyi",
    "grid": "grid", "mesh": "grid", "lattice": "grid", "tree": "tree", "hierarchy": "tree", "dag": "tree", "star": "star", "bipartite": "bipartite", "two-mode": "bipartite",
}
#: Nodes that preferential attachment may have, as its state is kept on the driver.
MAX_SEQUENTIAL = 5_000_000


def uniform(seed: int, *columns: Column | int) -> Column:
    """In [0, 1), from 52 bits of a hash that any SQL engine has, see :func:`uniform_sql`."""
    parts = [F.lit(str(c)) if isinstance(c, int) else c.cast("string") for c in (seed, *columns)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def uniform_sql(seed: int, *columns: str | int) -> str:
    """The SQL of :func:`uniform`."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(map(str, (seed, *columns)))})), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE)"


def below(seed: int, n: int, *columns: Column | int) -> Column:
    return F.least(F.floor(uniform(seed, *columns) * n), F.lit(n - 1)).cast("long")


def _both(edges: DataFrame, undirected: bool) -> DataFrame:
    return edges.unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))) if undirected else edges


def graph500(spark: SparkSession, scale: int = 10, edge_factor: int = 16, edges: int | None = None, a: float = 0.57, b: float = 0.19, c: float = 0.19, d: float = 0.05, undirected: bool = False, seed: int = 42) -> DataFrame:
    """R-MAT: each bit of (src, tgt) falls into a quadrant; loops are dropped."""
    if not 1 <= scale <= 36:
        raise ValueError("scale must be from 1 to 36")
    total = a + b + c + d
    a, b, c = (a / total, b / total, c / total) if total > 0 else (0.57, 0.19, 0.19)
    rows = spark.range(edges if edges is not None else (1 << scale) * edge_factor)

    def bit(acc: Column, level: Column) -> Column:
        r = uniform(seed, F.col("id"), level)
        down, right = (r >= a + b).cast("long"), (((r >= a) & (r < a + b)) | (r >= a + b + c)).cast("long")
        return F.struct((acc["u"] * 2 + down).alias("u"), (acc["v"] * 2 + right).alias("v"))

    ends = F.aggregate(F.sequence(F.lit(1), F.lit(scale)), F.struct(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")), bit)
    out = rows.select(ends.alias("e")).select(F.col("e.u").alias("src"), F.col("e.v").alias("tgt")).filter("src <> tgt")
    return _both(out, undirected)


def preferential(spark: SparkSession, nodes: int = 10_000, m: int = 8, undirected: bool = False, seed: int = 42) -> DataFrame:
    """A clique of max(m + 1, 4), then each node picks m distinct targets in proportion to their degrees."""
    first = max(m + 1, 4)
    if nodes <= first:
        raise ValueError(f"at least {first + 1} nodes are needed")
    if nodes > MAX_SEQUENTIAL:
        raise ValueError(f"preferential attachment is sequential; at most {MAX_SEQUENTIAL} nodes")
    draw = random.Random(seed)
    pairs = [(u, v) for u in range(first) for v in range(u + 1, first)]
    ends = [x for p in pairs for x in p]
    for u in range(first, nodes):
        n, chosen = len(ends), set()
        while len(chosen) < m:
            chosen.add(ends[draw.randrange(n)])
        for v in sorted(chosen):
            pairs.append((u, v))
            ends += (u, v)
    return _both(spark.createDataFrame(pairs, "src long, tgt long"), undirected)


def block_model(spark: SparkSession, nodes: int = 5000, communities: int = 10, p_intra: float = 0.02, p_inter: float = 0.0005, undirected: bool = False, self_loops: bool = False, dedupe: bool = False, seed: int = 42) -> DataFrame:
    """Each ordered pair is an edge with the probability of its communities (id modulo their number).

    Pairs are not enumerated: gaps between the edges of a source are geometric, so the work is in
    proportion to the edges. ``undirected`` adds the reverse of each edge, as a multigraph unless deduped.
    """
    gaps = []
    for inner, p in ((True, p_intra), (False, p_inter)):
        if p <= 0:
            continue
        same = F.floor((F.lit(nodes - 1) - F.col("id") % communities) / communities) + 1  # members of the source's community
        size = same if inner else F.lit(nodes) - same
        most = F.greatest(F.lit(1), F.ceil(size * p + 12 * F.sqrt(size * p) + 40)).cast("int")

        def jump(acc: Column, k: Column) -> Column:
            u = uniform(seed, int(inner), F.col("id"), k)
            step = F.lit(1) if p >= 1 else (F.floor(F.log(1 - u) / F.log(F.lit(1 - p))) + 1)
            at = acc["at"] + step.cast("long")
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        empty = F.struct(F.lit(-1).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        # the lambda is built here, while inner and p are those of this turn
        hits = F.explode(F.aggregate(F.sequence(F.lit(1), most), empty, jump, lambda acc: acc["out"]))
        rows = spark.range(nodes).select(F.col("id").alias("src"), size.cast("long").alias("size"), hits.alias("nth")).filter("nth < size")
        own = F.col("src") % communities
        if inner:
            tgt = F.col("nth") * communities + own
        else:  # number the nodes of other communities block by block
            per = communities - 1
            slot = F.col("nth") % max(per, 1)
            tgt = F.floor(F.col("nth") / max(per, 1)) * communities + slot + (slot >= own).cast("long")
        gaps.append(rows.select("src", tgt.cast("long").alias("tgt")).filter(F.col("tgt") < nodes))
    if not gaps:
        return spark.createDataFrame([], "src long, tgt long")
    out = gaps[0] if len(gaps) == 1 else gaps[0].unionByName(gaps[1])
    out = _both(out if self_loops else out.filter("src <> tgt"), undirected)
    return out.distinct() if dedupe else out


def erdos_renyi(spark: SparkSession, nodes: int = 10_000, edges: int | None = None, p: float | None = None, undirected: bool = False, self_loops: bool = False, seed: int = 42) -> DataFrame:
    """Edges with uniform ends, drawn with replacement; a loop is avoided by an offset, not by drawing again."""
    m = edges if edges is not None else int(nodes * (nodes - 1) * p) if p else 10 * nodes
    u = below(seed, nodes, F.col("id"), 1)
    if self_loops or nodes == 1:
        v = below(seed, nodes, F.col("id"), 2)
    else:
        v = (u + 1 + below(seed, nodes - 1, F.col("id"), 2)) % nodes
    return _both(spark.range(m).select(u.alias("src"), v.alias("tgt")), undirected)


def grid(spark: SparkSession, x: int = 32, y: int = 32, z: int = 1, torus: bool = False, undirected: bool = False) -> DataFrame:
    """id = (z * Y + y) * X + x, with edges to the next node of each axis; a torus wraps axes longer than 1."""
    at = spark.range(x * y * z).select("id", (F.col("id") % x).alias("i"), (F.floor(F.col("id") / x) % y).alias("j"), F.floor(F.col("id") / (x * y)).alias("k"))
    steps = []
    for name, size, stride in (("i", x, 1), ("j", y, x), ("k", z, x * y)):
        wrap = F.col("id") - (size - 1) * stride if torus and size > 1 else F.lit(None).cast("long")
        steps.append(F.when(F.col(name) < size - 1, F.col("id") + stride).otherwise(wrap))
    out = at.select(F.col("id").alias("src"), F.explode(F.array(*steps)).alias("tgt")).filter("tgt is not null")
    return _both(out.select("src", F.col("tgt").cast("long").alias("tgt")), undirected)


def tree(spark: SparkSession, branching: int = 3, depth: int = 6) -> DataFrame:
    """A complete tree: the parent of v is (v - 1) div K."""
    k = max(2, branching)
    n = sum(k**i for i in range(depth + 1))
    return spark.range(1, n).select(F.floor((F.col("id") - 1) / k).cast("long").alias("src"), F.col("id").alias("tgt"))


def star(spark: SparkSession, nodes: int = 1000) -> DataFrame:
    return spark.range(1, nodes).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("tgt"))


def bipartite(spark: SparkSession, sources: int = 5000, targets: int = 5000, edges: int | None = None, seed: int = 42) -> DataFrame:
    """Uniform pairs between two domains, with replacement."""
    return spark.range(edges if edges is not None else 10 * sources).select(below(seed, sources, F.col("id"), 1).alias("src"), below(seed, targets, F.col("id"), 2).alias("tgt"))


MAKERS = {"graph500": graph500, "social": preferential, "sbm": block_model, "erdos-renyi": erdos_renyi, "grid": grid, "tree": tree, "star": star, "bipartite": bipartite}


def generate(spark: SparkSession, profile: str, **options) -> DataFrame:
    """Edges (src, tgt) of a profile, by any of its names."""
    if profile.lower() not in ALIASES:
        raise ValueError(f"unknown profile {profile}")
    return MAKERS[ALIASES[profile.lower()]](spark, **options)


#: kinds of attributes and their accepted names
ATTRIBUTE_TYPES = {"i32": "int", "int32": "int", "int": "int", "i64": "bigint", "int64": "bigint", "long": "bigint", "timestamp": "bigint", "f32": "float", "float32": "float", "float": "float", "weight": "float", "f64": "double", "float64": "double", "double": "double"}


def with_attributes(edges: DataFrame, attributes: str, seed: int = 42) -> DataFrame:
    """Adds ``name:type,...``: int in [0, 10), bigint in 1.7e9 + [0, 1e7), float and double in [0.01, 100).

    Draws depend on the edge and its number among equal edges, not on the order of rows.
    """
    from pyspark.sql import Window

    out = edges.withColumn("_nth", F.row_number().over(Window.partitionBy("src", "tgt").orderBy(F.lit(1))))
    for k, item in enumerate(a for a in attributes.split(",") if a.strip()):
        name, _, kind = item.strip().partition(":")
        kind = ATTRIBUTE_TYPES.get(kind.strip().lower() or "f32", "float")
        u = uniform(seed + 1, F.col("src"), F.col("tgt"), F.col("_nth"), k)
        value = F.floor(u * 10) if kind == "int" else F.floor(u * 10_000_000) + 1_700_000_000 if kind == "bigint" else u * 99.99 + 0.01
        out = out.withColumn(name.strip(), value.cast(kind))
    return out.drop("_nth")
