"""Graph upkeep: validation, comparison, reordering, deltas and content digests."""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from propgraph.model import PropertyGraph
from propgraph.plans.staging import staged

#: Edges that the reverse Cuthill-McKee order, a sequential search on the driver, takes at most.
MAX_SEQUENTIAL = 5_000_000


def validate(graph: PropertyGraph) -> DataFrame:
    """(relation, check, violations): one row for each check that fails.

    Ends must be nodes of their domains and not null, node ids unique, and no two relations may join
    the same domains (a warning: they are told apart by name).
    """
    spark, parts = graph.spark, []
    for r in graph.relations.values():
        for side, domain in (("src", r.source), ("tgt", r.target)):
            nodes = graph.domains[domain].nodes.select(F.col("id").alias(side))
            lost = r.edges.filter(F.col(side).isNotNull()).join(nodes, side, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
            parts.append(lost.select(F.lit(r.name).alias("relation"), F.lit(f"{side} out of range").alias("check"), "violations"))
        nulls = r.edges.agg(F.count_if(F.col("src").isNull() | F.col("tgt").isNull()).alias("violations"))
        parts.append(nulls.select(F.lit(r.name).alias("relation"), F.lit("null end").alias("check"), "violations"))
    for d in graph.domains.values():
        twice = d.nodes.groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("violations"))
        parts.append(twice.select(F.lit(d.name).alias("relation"), F.lit("repeated node id").alias("check"), "violations"))
    pairs: dict[tuple, list[str]] = {}
    for r in graph.relations.values():
        pairs.setdefault((r.source, r.target), []).append(r.name)
    again = [(",".join(names), "warning: same domains", len(names)) for names in pairs.values() if len(names) > 1]
    parts.append(spark.createDataFrame(again, "relation string, check string, violations long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("violations > 0")


def validate_saved(spark: SparkSession, path: str) -> DataFrame:
    """(relation, check, violations) of a saved graph: what :func:`validate` finds, and for each relation the
    difference from the edge count of the catalog, attributes that are missing, and rows out of (src, tgt) order in their file."""
    about = json.loads(spark.read.text(f"{path}/catalog").head().value)
    out = validate(PropertyGraph.load(spark, path))
    for r in about["relations"]:
        edges = spark.read.parquet(f"{path}/relations/{r['name']}")
        named = lambda check, count, name=r["name"]: count.select(F.lit(name).alias("relation"), F.lit(check).alias("check"), F.col("violations").cast("long").alias("violations"))
        out = out.unionByName(named("edge count", edges.agg(F.abs(F.count(F.lit(1)) - F.lit(r["edge_count"])).alias("violations"))))
        lost = [a for a in r["attributes"] if a not in edges.columns]
        out = out.unionByName(spark.createDataFrame([(r["name"], "missing attributes", len(lost))], "relation string, check string, violations long"))
        rows = edges.select("src", "tgt", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        before = F.lag(F.struct("src", "tgt")).over(Window.partitionBy("file").orderBy("at"))
        out = out.unionByName(named("out of order", rows.select((before > F.struct("src", "tgt")).alias("bad")).agg(F.count_if("bad").alias("violations"))))
    return out.filter("violations > 0")


def diff_counts(base: PropertyGraph, target: PropertyGraph) -> DataFrame:
    """(relation, base_edges, target_edges, delta) over the relations of both."""
    a = base.describe_relations().select("relation", F.col("edge_count").alias("base_edges"))
    b = target.describe_relations().select("relation", F.col("edge_count").alias("target_edges"))
    both = a.join(b, "relation", "full_outer").na.fill(0, ["base_edges", "target_edges"])
    return both.withColumn("delta", F.col("target_edges") - F.col("base_edges"))


def diff_edges(base: DataFrame, target: DataFrame) -> DataFrame:
    """(change, row...): edges added and removed, as multisets."""
    same = [c for c in base.columns if c in target.columns]
    a, b = base.select(*same), target.select(*same)
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def merge_deltas(edges: DataFrame, adds: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """``edges`` without those whose (src, tgt) is deleted, with the added ones."""
    out = edges if deletes is None else edges.join(deletes.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti").select(*edges.columns)
    return out if adds is None else out.unionByName(adds, allowMissingColumns=True)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 0 in an order, by sorted range partitions and the sizes of those before."""
    ordered = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned("_m", 33)
    sizes = {r[0]: r[1] for r in ordered.groupBy(part.alias("p")).count().collect()}
    starts, before = [], 0
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "_p long, _start long")
    return ordered.withColumn("_p", part).join(F.broadcast(table), "_p").withColumn(name, F.col("_start") + F.expr("_m & 8589934591")).drop("_m", "_p", "_start")


def degree_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, new_id): by out-degree, largest first, ties by id."""
    counts = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    rows = nodes.select("id").join(counts, "id", "left").select("id", (-F.coalesce("deg", F.lit(0))).alias("rank"))
    return numbered(rows, ["rank", "id"], "new_id").select("id", "new_id")


def cuthill_mckee(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, new_id): reverse Cuthill-McKee over undirected neighbours, components from the lowest degree.

    A sequential search on the driver, for graphs of at most ``MAX_SEQUENTIAL`` edges; larger ones are an error.
    """
    n_edges = edges.count()
    if n_edges > MAX_SEQUENTIAL:
        raise ValueError(f"{n_edges} edges; reverse Cuthill-McKee takes at most {MAX_SEQUENTIAL}, use degree_order")
    near: dict[int, set[int]] = {r.id: set() for r in nodes.select("id").toLocalIterator()}
    for r in edges.select("src", "tgt").distinct().toLocalIterator():
        if r.src != r.tgt:
            near.setdefault(r.src, set()).add(r.tgt)
            near.setdefault(r.tgt, set()).add(r.src)
    rank = {v: (len(w), v) for v, w in near.items()}
    order, seen = [], set()
    for first in sorted(near, key=rank.get):
        if first in seen:
            continue
        seen.add(first)
        queue = deque([first])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sorted(near[v] - seen, key=rank.get):
                seen.add(w)
                queue.append(w)
    return nodes.sparkSession.createDataFrame([(v, k) for k, v in enumerate(reversed(order))], "id long, new_id long")


def relabelled(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges with new ids at both ends and their attributes."""
    rest = [c for c in edges.columns if c not in ("src", "tgt")]
    a, b = order.select(F.col("id").alias("src"), F.col("new_id").alias("_s")), order.select(F.col("id").alias("tgt"), F.col("new_id").alias("_t"))
    return edges.join(a, "src").join(b, "tgt").select(F.col("_s").alias("src"), F.col("_t").alias("tgt"), *rest)


def bandwidth(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.abs(F.col("src") - F.col("tgt"))).alias("bandwidth"))


def content_digest(df: DataFrame) -> DataFrame:
    """(rows, digest): order-free digest of all rows; the sum of the rows' hashes modulo 2^61 - 1, as hexadecimal.

    Each row's SHA-256 counts with its first 15 digits, so the digest is made by partial sums.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lower(F.hex((F.coalesce(F.sum(part), F.lit(0)) % F.lit(2**61 - 1)).cast("long"))).alias("digest"))
