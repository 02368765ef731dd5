"""Vectors (id, val) and products of a relation with a vector over semirings.

A vector is sparse: ids without a row hold the semiring's identity, which :func:`fill` makes explicit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Semiring:
    plus: Callable[[Column], Column]
    times: Callable[[Column, Column], Column]
    zero: float | None


def _lesser(a: Column, b: Column) -> Column:
    return F.least(a, b)


SEMIRINGS = {
    "plus_times": Semiring(F.sum, lambda a, b: a * b, 0.0),
    "min_plus": Semiring(F.min, lambda a, b: a + b, None),
    "max_min": Semiring(F.max, _lesser, None),
    "bool": Semiring(F.max, lambda a, b: ((a != 0) & (b != 0)).cast("double"), 0.0),
    "min_min": Semiring(F.min, _lesser, None),
}
OPS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b, "mul": lambda a, b: a * b, "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b),
    "and": lambda a, b: ((a != 0) & (b != 0)).cast("double"), "or": lambda a, b: ((a != 0) | (b != 0)).cast("double"),
}
TOTALS: dict[str, Callable[[Column], Column]] = {"add": F.sum, "mul": F.product, "min": F.min, "max": F.max, "and": lambda c: F.min((c != 0).cast("double")), "or": lambda c: F.max((c != 0).cast("double"))}


def fill(vector: DataFrame, nodes: DataFrame, value: float) -> DataFrame:
    """A row for every node."""
    return nodes.select("id").join(vector, "id", "left").select("id", F.coalesce("val", F.lit(value)).alias("val"))


def product(edges: DataFrame, vector: DataFrame, semiring: str = "plus_times", weight: str | None = None, into: str = "tgt") -> DataFrame:
    """One value for each node with an edge: the values at the other end, combined with the weight
    (1, or nothing where a semiring has no use for it), summed. ``into`` tgt pulls along entering edges
    (vector times matrix), src along leaving ones (matrix times vector)."""
    ring, other = SEMIRINGS[semiring], "src" if into == "tgt" else "tgt"
    moved = edges.join(vector.select(F.col("id").alias(other), "val"), other)
    value = ring.times(F.col("val"), F.col(weight)) if weight else F.col("val")
    return moved.groupBy(F.col(into).alias("id")).agg(ring.plus(value).alias("val"))


def mxv(edges: DataFrame, vector: DataFrame, semiring: str = "plus_times", weight: str | None = None) -> DataFrame:
    return product(edges, vector, semiring, weight, "src")


def vxm(edges: DataFrame, vector: DataFrame, semiring: str = "plus_times", weight: str | None = None) -> DataFrame:
    return product(edges, vector, semiring, weight, "tgt")


def ewise_add(a: DataFrame, b: DataFrame, op: str = "add") -> DataFrame:
    """On the union of the ids; where one has no value, the other's stands."""
    both = a.select("id", F.col("val").alias("x")).join(b.select("id", F.col("val").alias("y")), "id", "full_outer")
    return both.select("id", F.coalesce(OPS[op](F.col("x"), F.col("y")), "x", "y").alias("val")) if op not in ("min", "max") else both.select("id", OPS[op](F.col("x"), F.col("y")).alias("val"))


def ewise_mult(a: DataFrame, b: DataFrame, op: str = "mul") -> DataFrame:
    """On the intersection of the ids."""
    return a.select("id", F.col("val").alias("x")).join(b.select("id", F.col("val").alias("y")), "id").select("id", OPS[op](F.col("x"), F.col("y")).alias("val"))


def reduce(vector: DataFrame, op: str = "add") -> DataFrame:
    return vector.agg(TOTALS[op](F.col("val")).alias("val"))


def scale(vector: DataFrame, by: float) -> DataFrame:
    return vector.select("id", (F.col("val") * by).alias("val"))


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """By id; null where the divisor is 0."""
    return a.select("id", F.col("val").alias("x")).join(b.select("id", F.col("val").alias("y")), "id").select("id", F.try_divide("x", "y").alias("val"))


def times_attribute(vector: DataFrame, nodes: DataFrame, attribute: str) -> DataFrame:
    return vector.join(nodes.select("id", F.col(attribute).alias("_a")), "id").select("id", (F.col("val") * F.col("_a")).alias("val"))


def concat(a: DataFrame, b: DataFrame, between: str = "") -> DataFrame:
    return a.select("id", F.col("val").cast("string").alias("x")).join(b.select("id", F.col("val").cast("string").alias("y")), "id").select("id", F.concat("x", F.lit(between), "y").alias("val"))


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.col("val").alias("x")).join(b.select("id", F.col("val").alias("y")), "id", "full_outer")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("val"))


def l2_norm(vector: DataFrame) -> DataFrame:
    return vector.agg(F.sqrt(F.coalesce(F.sum(F.col("val") * F.col("val")), F.lit(0.0))).alias("val"))


def triple(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges as matrix entries (i, j, val)."""
    return edges.select(F.col("src").alias("i"), F.col("tgt").alias("j"), (F.col(weight) if weight else F.lit(1.0)).alias("val"))


def mxm(a: DataFrame, b: DataFrame, mask: DataFrame | None = None, semiring: str = "plus_times") -> DataFrame:
    """Matrix product of (i, j, val) entries, within the entries of ``mask`` (i, j) if given."""
    ring = SEMIRINGS[semiring]
    pairs = a.select("i", F.col("j").alias("m"), F.col("val").alias("x")).join(b.select(F.col("i").alias("m"), "j", F.col("val").alias("y")), "m")
    if mask is not None:
        pairs = pairs.join(mask.select("i", "j").distinct(), ["i", "j"], "left_semi")
    return pairs.groupBy("i", "j").agg(ring.plus(ring.times(F.col("x"), F.col("y"))).alias("val"))
