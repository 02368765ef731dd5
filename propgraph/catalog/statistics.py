"""Queries of relation statistics and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from propgraph.catalog.registry import plain, query
from propgraph.functions import statistics as stats
from propgraph.sources.tables import customer_edges, customer_nodes, order_graph


#: Ranks that percentiles tell apart: exact up to so many values, in error by a share of one in so many beyond.
ACCURACY = 200_000


def supplied(s, d):
    return order_graph(s, d).edges("supplied_by")


query("stats_topology", "SELECT (SELECT count(*) FROM n) AS node_count, count(*) AS edge_count, count(DISTINCT src) AS unique_source_nodes, round(1 - count(*) / ((SELECT count(*) FROM n)::DOUBLE * (SELECT count(*) FROM n)), 8) AS sparsity FROM e")(
    lambda s, d: stats.topology(customer_edges(s, d), customer_nodes(s, d), customer_nodes(s, d)).withColumn("sparsity", F.round("sparsity", 8)))


@query("stats_degrees",
       "SELECT max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, round(stddev_pop(degree), 6) AS std_dev_degree, percentile_disc(0.5) WITHIN GROUP (ORDER BY degree)::BIGINT AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY degree)::BIGINT AS p90, percentile_disc(0.99) WITHIN GROUP (ORDER BY degree)::BIGINT AS p99, (SELECT count(*) FROM g, (SELECT avg(degree) AS a, stddev_pop(degree) AS s FROM g) WHERE degree > a + 2 * s) AS supernode_count FROM g",
       "g AS MATERIALIZED (SELECT id, count(e.src) AS degree FROM n LEFT JOIN e ON e.src = n.id GROUP BY id)")
def stats_degrees(s, d):
    out = stats.degrees(customer_edges(s, d), customer_nodes(s, d), 2.0)
    return out.withColumn("avg_degree", F.round("avg_degree", 6)).withColumn("std_dev_degree", F.round("std_dev_degree", 6))


RELATIONS = {
    "in_nation": "SELECT c_custkey AS src, c_nationkey AS tgt FROM customer", "in_region": "SELECT n_nationkey AS src, n_regionkey AS tgt FROM nation",
    "ordered_by": "SELECT o_orderkey AS src, o_custkey AS tgt FROM orders", "supplied_by": "SELECT l_partkey AS src, l_suppkey AS tgt FROM lineitem",
}


def _multiplicity_sql():
    parts = []
    for name, sql in RELATIONS.items():
        parts.append(f"""SELECT '{name}' AS relation, o AS max_out, i AS max_in, round(a, 6) AS avg_in, o <= 1 AS is_functional, i <= 1 AS is_injective, o <= 1 AND i <= 1 AS is_bijective,
CASE WHEN o <= 1 AND i <= 1 THEN '1:1' WHEN o <= 1 THEN 'M:1' WHEN i <= 1 THEN '1:M' ELSE 'M:M' END AS multiplicity
FROM (SELECT max(c) AS o FROM (SELECT count(*) AS c FROM ({sql}) GROUP BY src)), (SELECT max(c) AS i, avg(c) AS a FROM (SELECT count(*) AS c FROM ({sql}) GROUP BY tgt))""")
    return "\nUNION ALL\n".join(parts)


@plain("stats_multiplicity", _multiplicity_sql())
def stats_multiplicity(s, d):
    graph, out = order_graph(s, d), None
    for name in RELATIONS:
        row = stats.multiplicity(graph.edges(name)).withColumn("relation", F.lit(name)).withColumn("avg_in", F.round("avg_in", 6))
        out = row if out is None else out.unionByName(row)
    return out


@plain("stats_zone_map", "SELECT min(l_discount) AS minimum, max(l_discount) AS maximum, count(*) FILTER (l_discount IS NULL) AS null_count, count(DISTINCT l_discount) AS distinct_count, count(*) FILTER (l_discount IS NULL) > 0 AS has_nulls FROM lineitem")
def stats_zone_map(s, d):
    return stats.zone_map(supplied(s, d), "discount")


@plain("stats_monotonicity", "SELECT CASE WHEN min(d) >= 0 THEN 'non_decreasing' WHEN max(d) <= 0 THEN 'non_increasing' ELSE 'none' END AS monotonicity FROM (SELECT l_quantity - lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_suppkey, l_quantity) AS d FROM lineitem)")
def stats_monotonicity(s, d):
    return stats.monotonicity(supplied(s, d), "quantity")


@query("stats_degree_sketch", "SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY c)::BIGINT AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY c)::BIGINT AS p90, percentile_disc(0.99) WITHIN GROUP (ORDER BY c)::BIGINT AS p99 FROM (SELECT count(*) AS c FROM e GROUP BY src)")
def stats_degree_sketch(s, d):
    p = F.col("percentiles")
    return stats.degree_sketch(customer_edges(s, d), [0.5, 0.9, 0.99], ACCURACY).select(p[0].alias("p50"), p[1].alias("p90"), p[2].alias("p99"))


@plain("stats_hll", "SELECT TRUE AS within_tenth")
def stats_hll(s, d):
    e = supplied(s, d)
    both = stats.distinct_estimate(e, "price", 12).crossJoin(e.agg(F.countDistinct("price").alias("exact")))
    return both.select((F.abs(F.col("distinct_estimate") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within_tenth"))


CUTS = ", ".join(f"percentile_disc({i}.0 / 20) WITHIN GROUP (ORDER BY l_extendedprice) AS c{i}" for i in range(1, 20))


@plain("stats_histogram", f"SELECT bucket::INTEGER AS bucket, min(v) AS low, max(v) AS high, count(*) AS n, (SELECT count(*) FROM lineitem WHERE l_extendedprice IS NULL) AS nulls FROM (SELECT l_extendedprice AS v, {' + '.join(f'(l_extendedprice > c{i})::INTEGER' for i in range(1, 20))} AS bucket FROM lineitem, (SELECT {CUTS} FROM lineitem)) WHERE v IS NOT NULL GROUP BY bucket")
def stats_histogram(s, d):
    return stats.equi_depth(supplied(s, d), "price", accuracy=ACCURACY)


@plain("stats_sketch_keys", "SELECT 'stats.relation.supplied_by.out_degree' AS key, count(DISTINCT l_partkey) AS distinct_count, count(DISTINCT l_partkey) AS rows FROM lineitem UNION ALL " + " UNION ALL ".join(
    f"SELECT 'stats.relation.supplied_by.attribute.{a}', count(DISTINCT l_{c}), count(*) FROM lineitem" for a, c in (("discount", "discount"), ("line", "linenumber"), ("price", "extendedprice"), ("quantity", "quantity"))))
def stats_sketch_keys(s, d):
    g = order_graph(s, d)
    g.relations = {"supplied_by": g.relation("supplied_by")}
    found = stats.sketches(g)
    exact = supplied(s, d).agg(F.countDistinct("src").alias("out_degree"), *[F.countDistinct(c).alias(c) for c in ("discount", "line", "price", "quantity")])
    names = exact.select(F.explode(F.create_map(*[x for c in exact.columns for x in (F.lit(c), F.col(c))])).alias("name", "distinct_count"))
    # the estimate stands for the exact number where it is within a tenth of it
    near = found.withColumn("name", F.element_at(F.split("key", r"\."), -1)).join(names, "name").filter(F.abs(F.col("estimate") - F.col("distinct_count")) <= 0.1 * F.col("distinct_count"))
    return near.select("key", "distinct_count", "rows")
