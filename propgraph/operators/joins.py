"""Joins that stay balanced when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds at least this share of the left rows; so there are at most 1 / share.
HEAVY_SHARE = 0.001


def shuffled(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join with both sides shuffled and sorted, however small they are.

    A broadcast is gathered and hashed on the driver; an operator of many small steps would make one for almost each of them.
    """
    return left.join(right.hint("merge"), on, how)


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key.

    ``weight`` is a column of ``right``: how many left rows have the key; ``total`` their sum. At
    most ``1 / HEAVY_SHARE`` keys can reach that share of ``total``, so the heavy part of ``right``
    has a bounded number of rows and is broadcast; the rest goes through an ordinary shuffled join
    in which no key holds more than that share. ``how`` is inner or left. Null keys match nothing.
    """
    limit = max(1, int(total * HEAVY_SHARE))
    heavy, light = right.filter(F.col(weight) >= limit), right.filter(F.col(weight) < limit)
    heavy = F.broadcast(heavy)
    hot = left.join(heavy, key, "inner")
    rest = left.join(heavy.select(key), key, "left_anti").join(light, key, how)
    return hot.unionByName(rest)


def row_hash(*columns: Column | str, seed: int = 0) -> Column:
    """A 64-bit hash of the columns and a seed, equal in every run."""
    return F.xxhash64(F.lit(seed), *columns)
