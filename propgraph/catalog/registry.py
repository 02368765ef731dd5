"""Registration of queries and the SQL of the test graphs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The derived graphs as common table expressions: e edges, n nodes, u simple undirected edges, d forward ones.
GRAPH = """e AS MATERIALIZED (SELECT a.o_orderkey AS k, a.o_custkey AS src, b.o_custkey AS tgt, a.o_totalprice AS w, a.o_orderpriority AS priority, a.o_orderstatus AS status
       FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
n AS MATERIALIZED (SELECT c_custkey AS id, c_name AS key, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer),
u AS MATERIALIZED (SELECT DISTINCT least(src, tgt) AS src, greatest(src, tgt) AS tgt FROM e WHERE src <> tgt),
d AS MATERIALIZED (SELECT DISTINCT src, tgt FROM e WHERE src < tgt),
seed AS MATERIALIZED (SELECT id FROM n WHERE nation = 3),
other AS MATERIALIZED (SELECT id FROM n WHERE segment = 'BUILDING')"""


def query(name: str, sql: str | None = None, ctes: str = "", recursive: bool = False):
    """Registers a function (spark, folder) under a name; ``sql`` may use the tables of :data:`GRAPH`."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            head = f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH}"
            ORACLES[name] = f"{head}{', ' + ctes if ctes else ''}\n{sql}"
        return function

    return register


def plain(name: str, sql: str):
    """Registers a function whose SQL stands alone."""

    def register(function):
        QUERIES[name] = function
        ORACLES[name] = sql
        return function

    return register
