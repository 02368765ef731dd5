"""Walks: from node sets and vectors along edges (src, tgt) to node sets and vectors.

Sets are (id), vectors (id, val). A walk is a semi-join of the edges with the set, so the edges are
pruned before the one shuffle that makes the result distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates by which a walk reduces what arrives at a node.
MONOIDS = {"add": F.sum, "min": F.min, "max": F.max, "mul": F.product, "or": F.max, "and": F.min}


def walk(edges: DataFrame, start: DataFrame, injective: bool = False) -> DataFrame:
    """Targets of the edges that leave ``start``; an injective relation needs no distinct."""
    out = edges.join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("tgt").alias("id"))
    return out if injective else out.distinct()


def walk_back(edges: DataFrame, start: DataFrame, unvisited: DataFrame | None = None) -> DataFrame:
    """Sources of the edges that enter ``start``, within the ``unvisited`` set if one is given."""
    out = edges.join(start.select(F.col("id").alias("tgt")), "tgt", "left_semi").select(F.col("src").alias("id")).distinct()
    return out if unvisited is None else out.join(unvisited.select("id"), "id", "left_semi")


def walk_two(edges: DataFrame, start: DataFrame) -> DataFrame:
    return walk(edges, walk(edges, start))


def walk_filtered(edges: DataFrame, start: DataFrame, allowed: DataFrame) -> DataFrame:
    """A walk to the nodes of ``allowed``; the edges are pruned on both ends before the distinct."""
    near = edges.join(allowed.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    return walk(near, start)


def walk_where(edges: DataFrame, start: DataFrame, predicate: Column | str) -> DataFrame:
    """A walk along the edges whose attributes satisfy a predicate, which reaches the scan."""
    return walk(edges.filter(predicate), start)


def walk_reduce(edges: DataFrame, vector: DataFrame, how: str = "add", weight: str | None = None) -> DataFrame:
    """What arrives at each node along the edges, reduced: values, times the edge attribute if one is named."""
    moved = edges.join(vector.select(F.col("id").alias("src"), "val"), "src")
    value = F.col("val") * F.col(weight) if weight else F.col("val")
    return moved.groupBy(F.col("tgt").alias("id")).agg(MONOIDS[how](value).alias("val"))


def scatter_gather(edges: DataFrame, vector: DataFrame, message: Column, gather: Column) -> DataFrame:
    """Message passing: ``message`` over val and the edge's columns, ``gather`` an aggregate of ``message``."""
    sent = edges.join(vector.select(F.col("id").alias("src"), "val"), "src").select(F.col("tgt").alias("id"), message.alias("message"))
    return sent.groupBy("id").agg(gather.alias("val"))


def degree(edges: DataFrame, nodes: DataFrame, side: str = "src") -> DataFrame:
    """(id, degree) of all nodes; ``side`` src counts leaving edges, tgt entering ones."""
    counts = edges.groupBy(F.col(side).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def node_filter(start: DataFrame, nodes: DataFrame, predicate: Column | str) -> DataFrame:
    """The members whose node attributes satisfy a predicate."""
    return start.select("id").join(nodes.filter(predicate).select("id"), "id", "left_semi")


def node_filter_prefix(start: DataFrame, nodes: DataFrame, prefix: str) -> DataFrame:
    """The members whose key begins with a prefix (a predicate that Parquet can push down)."""
    return node_filter(start, nodes, F.col("key").startswith(prefix))


def keys_to_ids(keys: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key) -> (key, id) of those that exist."""
    return keys.select("key").join(nodes.select("key", "id"), "key")


def ids_to_keys(start: DataFrame, nodes: DataFrame) -> DataFrame:
    return start.select("id").join(nodes.select("id", "key"), "id")


def collect_array(start: DataFrame) -> DataFrame:
    """A set as one sorted array; for sets that are results, not intermediate steps."""
    return start.agg(F.sort_array(F.collect_set("id")).alias("ids"))


def collect_map(vector: DataFrame) -> DataFrame:
    return vector.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "val")))).alias("values"))
