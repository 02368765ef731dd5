"""Queries of generators, files and graph upkeep."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from propgraph.catalog.registry import plain, query
from propgraph.operators import maintenance
from propgraph.plans.staging import new_path
from propgraph.sources import files, generate
from propgraph.sources.tables import customer_edges, customer_nodes, order_graph

plain("gen_grid", "SELECT src, tgt FROM (SELECT i AS src, CASE WHEN i % 20 < 19 THEN i + 1 ELSE i - 19 END AS tgt FROM range(400) t(i) UNION ALL SELECT i, CASE WHEN i // 20 < 19 THEN i + 20 ELSE i - 380 END FROM range(400) t(i))")(
    lambda s, d: generate.grid(s, 20, 20, torus=True))
plain("gen_tree", "SELECT (i - 1) // 3 AS src, i AS tgt FROM range(1, 121) t(i)")(lambda s, d: generate.tree(s, 3, 4))
plain("gen_star", "SELECT 0::BIGINT AS src, i AS tgt FROM range(1, 100) t(i)")(lambda s, d: generate.star(s, 100))


def counts(edges):
    """What a random graph must satisfy, whatever its draws."""
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("src") == F.col("tgt")).alias("loops"), F.min(F.least("src", "tgt")).alias("least"))


def below(n, *values):
    """The SQL of :func:`propgraph.sources.generate.below` with the seed that all generators have."""
    return f"least(floor({generate.uniform_sql(42, *values)} * {n}), {n - 1})::BIGINT"


ER = f"SELECT src, (src + 1 + {below(399, 'id', 2)}) % 400 AS tgt FROM (SELECT id, {below(400, 'id', 1)} AS src FROM range(2500) t(id))"
plain("gen_er", ER)(lambda s, d: generate.erdos_renyi(s, 400, 2500))
plain("gen_ba", "SELECT 5958::BIGINT AS edges, 0::BIGINT AS loops")(lambda s, d: counts(generate.preferential(s, 500, 6, True)).select("edges", "loops"))
plain("gen_bipartite", f"SELECT {below(250, 'id', 1)} AS src, {below(350, 'id', 2)} AS tgt FROM range(1500) t(id)")(lambda s, d: generate.bipartite(s, 250, 350, 1500))
#: The quadrant of each of the ten bits of both ends: a, b, c and d take .57, .19, .19 and .05.
RMAT = f"""SELECT * FROM (SELECT sum(CASE WHEN r >= 0.57::DOUBLE + 0.19::DOUBLE THEN 1 ELSE 0 END * (1 << (10 - level)))::BIGINT AS src,
sum(CASE WHEN (r >= 0.57::DOUBLE AND r < 0.57::DOUBLE + 0.19::DOUBLE) OR r >= 0.57::DOUBLE + 0.19::DOUBLE + 0.19::DOUBLE THEN 1 ELSE 0 END * (1 << (10 - level)))::BIGINT AS tgt
FROM (SELECT id, level::INTEGER AS level, {generate.uniform_sql(42, 'id', 'level')} AS r FROM range(16384) a(id), range(1, 11) b(level)) GROUP BY id) WHERE src <> tgt"""
plain("gen_graph500", RMAT)(lambda s, d: generate.graph500(s, 10, 16))


def _sbm_sql(nodes=300, groups=5, p_in=0.05, p_out=0.001):
    """Edges of a source lie at running sums of geometric gaps among the nodes of its own group, and among the others."""
    parts = []
    for inner, p, draws in ((1, p_in, 120), (0, p_out, 60)):
        same = f"((({nodes - 1} - id % {groups}) // {groups}) + 1)"
        size = same if inner else f"({nodes} - {same})"
        gap = f"floor(ln(1 - {generate.uniform_sql(42, inner, 'id', 'k')}) / ln(1 - {p}::DOUBLE)) + 1"
        nth = f"SELECT id, id % {groups} AS own, sum({gap}) OVER (PARTITION BY id ORDER BY k)::BIGINT - 1 AS nth, {size} AS size FROM range({nodes}) a(id), range(1, {draws + 1}) b(k)"
        tgt = f"nth * {groups} + own" if inner else f"nth // {groups - 1} * {groups} + nth % {groups - 1} + (nth % {groups - 1} >= own)::BIGINT"
        parts.append(f"SELECT id AS src, {tgt} AS tgt FROM ({nth}) WHERE nth < size")
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE src <> tgt AND tgt < {nodes}"


plain("gen_sbm", _sbm_sql())(lambda s, d: generate.block_model(s, 300, 5, 0.05, 0.001))
DRAWN = ", ".join(f"{generate.uniform_sql(43, 'src', 'tgt', 'nth', k)} AS u{k}" for k in range(3))
plain("gen_attributes", f"""SELECT src, tgt, round((u0 * 99.99::DOUBLE + 0.01::DOUBLE)::FLOAT::DOUBLE, 3) AS weight, floor(u1 * 10000000)::BIGINT + 1700000000 AS timestamp, floor(u2 * 10)::INTEGER AS type
FROM (SELECT src, tgt, {DRAWN} FROM (SELECT src, tgt, row_number() OVER (PARTITION BY src, tgt) AS nth FROM ({ER.replace('400', '100').replace('399', '99').replace('2500', '500')})))""")(
    lambda s, d: generate.with_attributes(generate.erdos_renyi(s, 100, 500), "weight:f32,timestamp:i64,type:i32").withColumn("weight", F.round(F.col("weight").cast("double"), 3)))


MANIFEST = {
    "domains": [{"id": 0, "name": "customer", "key_type": "string", "file": "customer.parquet", "id_column": "c_name", "attributes": [{"name": "nation", "column": "c_nationkey", "type": "int32"}]}, {"id": 1, "name": "order", "key_type": "int64"}],
    "relations": [{"name": "ordered_by", "src_domain": 1, "tgt_domain": 1, "file": "orders.parquet", "src_column": "o_orderkey", "tgt_column": "o_custkey", "attributes": [{"name": "price", "column": "o_totalprice", "type": "float64"}]}],
}


@plain("build_manifest", "SELECT o_orderkey::VARCHAR AS src_key, o_custkey::VARCHAR AS tgt_key, o_totalprice AS price FROM orders")
def build_manifest(s, d):
    g = files.from_manifest(s, json.dumps(MANIFEST), d)
    keys = g.nodes("order")
    e = g.edges("ordered_by").join(keys.select(F.col("id").alias("src"), F.col("key").alias("src_key")), "src").join(keys.select(F.col("id").alias("tgt"), F.col("key").alias("tgt_key")), "tgt")
    return e.select("src_key", "tgt_key", "price")


@plain("dense_ids", "SELECT key, row_number() OVER (ORDER BY first) - 1 AS id FROM (SELECT c_name AS key, min(c_custkey) AS first FROM customer GROUP BY c_name)")
def dense_ids(s, d):
    return files.dense_ids(customer_nodes(s, d).select("key", F.lit(0).alias("file"), F.col("id").alias("row")))


@query("export_edges", "SELECT src, tgt FROM e")
def export_edges(s, d):
    path = new_path(s, "export")
    g = order_graph(s, d)
    g.relations = {"next_customer": g.relation("next_customer")}
    out = files.export_edges(g, path)[0]
    return s.read.csv(out, sep="\t", schema="src long, tgt long")


@query("snapshot_save_load", "SELECT k, src, tgt, w, priority, status FROM e")
def save_load(s, d):
    g = order_graph(s, d)
    g.relations = {"next_customer": g.relation("next_customer")}
    return g.saved().edges("next_customer")


@plain("inspect_domains", " UNION ALL ".join(f"SELECT '{n}' AS domain, '{k}' AS key_type, count(*) AS node_count FROM {t}" for n, t, k in (("customer", "customer", "string"), ("nation", "nation", "string"), ("region", "region", "string"), ("order", "orders", "int64"), ("part", "part", "int64"), ("supplier", "supplier", "string"))))
def inspect_domains(s, d):
    return order_graph(s, d).describe_domains()


@plain("inspect_relations", "SELECT 'ordered_by' AS relation, 'order' AS src_domain, 'customer' AS tgt_domain, count(*) AS node_count, count(*) AS edge_count, 'price' AS attributes, 1.0::DOUBLE AS avg_degree FROM orders")
def inspect_relations(s, d):
    return order_graph(s, d).describe_relations().filter("relation = 'ordered_by'")


@plain("validate_graph", "SELECT 'ordered_by' AS relation, 'tgt out of range' AS \"check\", count(*) AS violations FROM orders WHERE o_custkey % 10 = 0")
def validate_graph(s, d):
    g = order_graph(s, d)
    g.domains["customer"].nodes = g.nodes("customer").filter("id % 10 <> 0")
    g.relations = {"ordered_by": g.relation("ordered_by")}
    return maintenance.validate(g)


@query("diff_counts", "SELECT 'next_customer' AS relation, count(*) AS base_edges, count(*) FILTER (k % 5 <> 0) AS target_edges, count(*) FILTER (k % 5 <> 0) - count(*) AS delta FROM e")
def diff_counts(s, d):
    a, b = order_graph(s, d), order_graph(s, d)
    for g in (a, b):
        g.relations = {"next_customer": g.relation("next_customer")}
    b.relation("next_customer").edges = b.edges("next_customer").filter("k % 5 <> 0")
    return maintenance.diff_counts(a, b)


@query("diff_edges", "SELECT k, src, tgt, 'removed' AS change FROM e WHERE k % 5 = 0")
def diff_edges(s, d):
    e = customer_edges(s, d).select("k", "src", "tgt")
    return maintenance.diff_edges(e, e.filter("k % 5 <> 0"))


@query("merge_deltas", "SELECT src, tgt FROM e WHERE (src, tgt) NOT IN (SELECT src, tgt FROM e WHERE k % 7 = 0) UNION ALL SELECT id, id FROM seed")
def merge_deltas(s, d):
    e = customer_edges(s, d)
    loops = customer_nodes(s, d).filter("nation = 3").select(F.col("id").alias("src"), F.col("id").alias("tgt"))
    return maintenance.merge_deltas(e.select("src", "tgt"), loops, e.filter("k % 7 = 0"))


@query("degree_sort", "SELECT id, row_number() OVER (ORDER BY c DESC, id) - 1 AS new_id FROM (SELECT id, count(e.src) AS c FROM n LEFT JOIN e ON e.src = n.id GROUP BY id)")
def degree_sort(s, d):
    return maintenance.degree_order(customer_edges(s, d), customer_nodes(s, d))


@plain("rcm_bandwidth", "SELECT TRUE AS smaller, 400::BIGINT AS nodes")
def rcm(s, d):
    import math

    shuffle = (F.col("id") * 37 + 11) % 400
    order = s.range(400).select("id", shuffle.alias("new_id"))
    messy = maintenance.relabelled(generate.grid(s, 20, 20), order)
    tidy = maintenance.cuthill_mckee(messy, s.range(400))
    before, after = maintenance.bandwidth(messy).withColumnRenamed("bandwidth", "b"), maintenance.bandwidth(maintenance.relabelled(messy, tidy)).withColumnRenamed("bandwidth", "a")
    return before.crossJoin(after).crossJoin(tidy.agg(F.countDistinct("new_id").alias("nodes"))).select(((F.col("a") < F.col("b")) & (F.col("a") <= 2 * math.isqrt(400))).alias("smaller"), "nodes")


@plain("content_digest", "SELECT count(*) AS rows, TRUE AS same, FALSE AS after_change FROM orders")
def content_digest(s, d):
    n = s.read.parquet(f"{d}/orders.parquet")
    a = maintenance.content_digest(n).withColumnRenamed("digest", "a")
    b = maintenance.content_digest(n.orderBy(F.desc("o_totalprice"))).select(F.col("digest").alias("b"))
    c = maintenance.content_digest(n.withColumn("o_orderstatus", F.when(F.col("o_orderkey") == 1, F.lit("x")).otherwise(F.col("o_orderstatus")))).select(F.col("digest").alias("c"))
    return a.crossJoin(b).crossJoin(c).select("rows", (F.col("a") == F.col("b")).alias("same"), (F.col("a") == F.col("c")).alias("after_change"))
