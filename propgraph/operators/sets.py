"""Algebra of node sets: DataFrames with one distinct column ``id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def of(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in ids], "id long").distinct()


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").join(b.select("id"), "id", "left_semi").distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").join(b.select("id"), "id", "left_anti").distinct()


def complement(a: DataFrame, nodes: DataFrame) -> DataFrame:
    return difference(nodes, a)


def cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.countDistinct("id").alias("cardinality"))


def bitmap(a: DataFrame) -> DataFrame:
    """The compact form: (bucket, bits), one row for each 32768 ids."""
    return a.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bits that both bitmaps have; buckets of one alone vanish."""
    both = a.unionByName(b).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return both.filter("n = 2").drop("n")


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_cardinality(a: DataFrame) -> DataFrame:
    return a.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("cardinality"))


def bitmap_members(a: DataFrame) -> DataFrame:
    """The ids of a bitmap, by testing the bits of each non-zero byte."""
    byte = F.posexplode(F.sequence(F.lit(1), F.length("bits")))
    rows = a.select("bucket", "bits", byte.alias("at", "nth")).select("bucket", "at", F.conv(F.hex(F.substring("bits", F.col("nth"), F.lit(1))), 16, 10).cast("int").alias("v"))
    bits = rows.filter("v > 0").select("bucket", "at", "v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bit"))
    nth = F.col("at") * 8 + F.col("bit")  # ids from 1 on count up from bucket 1, others down from bucket 0
    ident = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + nth + 1).otherwise(F.col("bucket") * 32768 - nth)
    return bits.filter(F.expr("shiftright(v, bit) & 1") == 1).select(ident.cast("long").alias("id"))
