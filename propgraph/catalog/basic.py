"""Queries of the walk, set and vector operators over the customer graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.catalog.registry import query
from propgraph.operators import sets, vectors, walk
from propgraph.sources.tables import customer_edges as edges
from propgraph.sources.tables import customer_nodes as nodes


def seed(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).filter("nation = 3").select("id")


def other(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).filter("segment = 'BUILDING'").select("id")


def balance(spark: SparkSession, folder: str) -> DataFrame:
    return nodes(spark, folder).select("id", F.col("balance").alias("val"))


def rounded(df: DataFrame, column: str = "val", digits: int = 4) -> DataFrame:
    return df.withColumn(column, F.round(column, digits) + F.lit(0.0))


# walks
query("csr_walk", "SELECT DISTINCT tgt AS id FROM e WHERE src IN (SELECT id FROM seed)")(lambda s, d: walk.walk(edges(s, d), seed(s, d)))
query("csc_walk", "SELECT DISTINCT src AS id FROM e WHERE tgt IN (SELECT id FROM seed) AND src NOT IN (SELECT id FROM seed)")(
    lambda s, d: walk.walk_back(edges(s, d), seed(s, d), sets.complement(seed(s, d), nodes(s, d))))
query("walk_2hop", "SELECT DISTINCT b.tgt AS id FROM e a JOIN e b ON b.src = a.tgt WHERE a.src = 7")(lambda s, d: walk.walk_two(edges(s, d), sets.of(s, [7])))
query("walk_filtered", "SELECT DISTINCT tgt AS id FROM e WHERE src IN (SELECT id FROM seed) AND tgt IN (SELECT id FROM other)")(
    lambda s, d: walk.walk_filtered(edges(s, d), seed(s, d), other(s, d)))
query("walk_predicate", "SELECT DISTINCT tgt AS id FROM e WHERE src IN (SELECT id FROM seed) AND w > 200000 AND status = 'F'")(
    lambda s, d: walk.walk_where(edges(s, d), seed(s, d), "w > 200000 and status = 'F'"))
query("dense_walk", "SELECT DISTINCT tgt AS id FROM e WHERE src IN (SELECT id FROM other)")(lambda s, d: walk.walk(edges(s, d), other(s, d)))
query("walk_reduce_sum", "SELECT tgt AS id, round(sum(balance), 4) AS val FROM e JOIN n ON n.id = e.src GROUP BY tgt")(
    lambda s, d: rounded(walk.walk_reduce(edges(s, d), balance(s, d))))
query("walk_reduce_min", "SELECT tgt AS id, min(balance) AS val FROM e JOIN n ON n.id = e.src GROUP BY tgt")(lambda s, d: walk.walk_reduce(edges(s, d), balance(s, d), "min"))
query("walk_reduce_max", "SELECT tgt AS id, max(balance) AS val FROM e JOIN n ON n.id = e.src GROUP BY tgt")(lambda s, d: walk.walk_reduce(edges(s, d), balance(s, d), "max"))
query("scatter_gather", "SELECT tgt AS id, round(avg(balance * w) / 1e6, 4) AS val FROM e JOIN n ON n.id = e.src WHERE w > 1000 GROUP BY tgt")(
    lambda s, d: rounded(walk.scatter_gather(edges(s, d).filter("w > 1000"), balance(s, d), F.col("val") * F.col("w"), F.avg("message") / 1e6)))
query("csr_degree", "SELECT id, count(e.src) AS degree FROM n LEFT JOIN e ON e.src = n.id GROUP BY id")(lambda s, d: walk.degree(edges(s, d), nodes(s, d)))
query("csc_degree", "SELECT id, count(e.tgt) AS degree FROM n LEFT JOIN e ON e.tgt = n.id GROUP BY id")(lambda s, d: walk.degree(edges(s, d), nodes(s, d), "tgt"))
query("node_filter", "SELECT id FROM seed WHERE id IN (SELECT id FROM n WHERE balance > 5000)")(lambda s, d: walk.node_filter(seed(s, d), nodes(s, d), "balance > 5000"))
query("node_filter_str_prefix", "SELECT id FROM n WHERE key LIKE 'Customer#00000001%'")(lambda s, d: walk.node_filter_prefix(nodes(s, d), nodes(s, d), "Customer#00000001"))
query("map_keys_to_dense", "SELECT n.key, n.id FROM n WHERE n.key IN ('Customer#000000003', 'Customer#000000011')")(
    lambda s, d: walk.keys_to_ids(s.createDataFrame([("Customer#000000003",), ("Customer#000000011",), ("nobody",)], "key string"), nodes(s, d)))
query("map_dense_to_keys", "SELECT id, key FROM n WHERE id IN (SELECT id FROM seed)")(lambda s, d: walk.ids_to_keys(seed(s, d), nodes(s, d)))
query("collect_bitset", "SELECT DISTINCT tgt AS id FROM e WHERE src = 0")(lambda s, d: walk.walk(edges(s, d), sets.of(s, [0])))
query("collect_array", "SELECT array_to_string(list_sort(list(DISTINCT tgt)), ',') AS ids FROM e WHERE src = 0")(
    lambda s, d: walk.collect_array(walk.walk(edges(s, d), sets.of(s, [0]))).select(F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids")))
query("collect_value_map", "SELECT id, val FROM (SELECT src AS id, max(w) AS val FROM e WHERE src < 20 GROUP BY src)")(
    lambda s, d: walk.collect_map(edges(s, d).filter("src < 20").groupBy(F.col("src").alias("id")).agg(F.max("w").alias("val"))).select(F.explode("values").alias("id", "val")))
query("read_edge_weight", "SELECT k, src, tgt, w FROM e WHERE src IN (SELECT id FROM seed)")(
    lambda s, d: edges(s, d).join(seed(s, d).withColumnRenamed("id", "src"), "src", "left_semi").select("k", "src", "tgt", "w"))

# sets
query("set_union", "SELECT id FROM seed UNION SELECT id FROM other")(lambda s, d: sets.union(seed(s, d), other(s, d)))
query("set_intersect", "SELECT id FROM seed INTERSECT SELECT id FROM other")(lambda s, d: sets.intersect(seed(s, d), other(s, d)))
query("set_difference", "SELECT id FROM seed EXCEPT SELECT id FROM other")(lambda s, d: sets.difference(seed(s, d), other(s, d)))
query("set_complement", "SELECT id FROM n EXCEPT SELECT id FROM other")(lambda s, d: sets.complement(other(s, d), nodes(s, d)))
query("set_cardinality", "SELECT count(*) AS cardinality FROM seed")(lambda s, d: sets.cardinality(seed(s, d)))
query("roaring_bitmap_and", "SELECT id FROM seed INTERSECT SELECT id FROM other")(lambda s, d: sets.bitmap_members(sets.bitmap_and(sets.bitmap(seed(s, d)), sets.bitmap(other(s, d)))))
query("roaring_bitmap_or", "SELECT id FROM seed UNION SELECT id FROM other")(lambda s, d: sets.bitmap_members(sets.bitmap_or(sets.bitmap(seed(s, d)), sets.bitmap(other(s, d)))))
query("roaring_bitmap_and_not", "SELECT id FROM seed EXCEPT SELECT id FROM other")(
    lambda s, d: sets.difference(sets.bitmap_members(sets.bitmap(seed(s, d))), sets.bitmap_members(sets.bitmap(other(s, d)))))
query("bitmap_cardinality", "SELECT count(*) AS cardinality FROM (SELECT id FROM seed UNION SELECT id FROM other)")(
    lambda s, d: sets.bitmap_cardinality(sets.bitmap_or(sets.bitmap(seed(s, d)), sets.bitmap(other(s, d)))))

# vectors
query("mxv_plus_times", "SELECT src AS id, round(sum(balance * w) / 1e6, 4) AS val FROM e JOIN n ON n.id = e.tgt GROUP BY src")(lambda s, d: rounded(vectors.scale(vectors.mxv(edges(s, d), balance(s, d), "plus_times", "w"), 1e-6)))
query("mxv_min_plus", "SELECT src AS id, round(min(balance + w), 4) AS val FROM e JOIN n ON n.id = e.tgt GROUP BY src")(lambda s, d: rounded(vectors.mxv(edges(s, d), balance(s, d), "min_plus", "w")))
query("mxv_max_min", "SELECT src AS id, max(least(balance, w)) AS val FROM e JOIN n ON n.id = e.tgt GROUP BY src")(lambda s, d: vectors.mxv(edges(s, d), balance(s, d), "max_min", "w"))
query("mxv_bool", "SELECT src AS id, max(CASE WHEN nation = 3 AND w <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS val FROM e JOIN n ON n.id = e.tgt GROUP BY src")(
    lambda s, d: vectors.mxv(edges(s, d), nodes(s, d).select("id", (F.col("nation") == 3).cast("double").alias("val")), "bool", "w"))
query("mxv_min_min", "SELECT src AS id, min(least(balance, w)) AS val FROM e JOIN n ON n.id = e.tgt GROUP BY src")(lambda s, d: vectors.mxv(edges(s, d), balance(s, d), "min_min", "w"))
query("vxm_plus_times", "SELECT tgt AS id, round(sum(balance * w) / 1e6, 4) AS val FROM e JOIN n ON n.id = e.src GROUP BY tgt")(lambda s, d: rounded(vectors.scale(vectors.vxm(edges(s, d), balance(s, d), "plus_times", "w"), 1e-6)))
query("sparse_matvec", "SELECT n.id, round(coalesce(sum(m.balance), 0), 4) AS val FROM n LEFT JOIN (e JOIN n m ON m.id = e.src) ON e.tgt = n.id GROUP BY n.id")(
    lambda s, d: rounded(vectors.fill(vectors.vxm(edges(s, d), balance(s, d)), nodes(s, d), 0.0)))


def _paid(s, d):
    return edges(s, d).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("val"))


def _got(s, d):
    return edges(s, d).filter("tgt % 2 = 0").groupBy(F.col("tgt").alias("id")).agg(F.sum("w").alias("val"))


PAID = "a AS (SELECT src AS id, sum(w) AS val FROM e GROUP BY src), b AS (SELECT tgt AS id, sum(w) AS val FROM e WHERE tgt % 2 = 0 GROUP BY tgt)"
query("ewise_add", "SELECT id, round(coalesce(a.val, 0) + coalesce(b.val, 0), 4) AS val FROM a FULL JOIN b USING (id)", PAID)(lambda s, d: rounded(vectors.ewise_add(_paid(s, d), _got(s, d))))
query("ewise_mult", "SELECT id, round(a.val * b.val / 1e6, 2) AS val FROM a JOIN b USING (id)", PAID)(lambda s, d: rounded(vectors.scale(vectors.ewise_mult(_paid(s, d), _got(s, d)), 1e-6), digits=2))
query("ewise_min", "SELECT id, round(least(a.val, b.val), 4) AS val FROM a FULL JOIN b USING (id)", PAID)(lambda s, d: rounded(vectors.ewise_add(_paid(s, d), _got(s, d), "min")))
query("vector_div", "SELECT id, round(a.val / b.val, 6) AS val FROM a JOIN b USING (id)", PAID)(lambda s, d: rounded(vectors.divide(_paid(s, d), _got(s, d)), digits=6))
query("l1_norm_diff", "SELECT round(sum(abs(coalesce(a.val, 0) - coalesce(b.val, 0))), 2) AS val FROM a FULL JOIN b USING (id)", PAID)(lambda s, d: rounded(vectors.l1_distance(_paid(s, d), _got(s, d)), digits=2))
query("l2_norm", "SELECT round(sqrt(sum(balance * balance)), 4) AS val FROM n")(lambda s, d: rounded(vectors.l2_norm(balance(s, d))))
query("vector_reduce_sum", "SELECT round(sum(balance), 2) AS val FROM n")(lambda s, d: rounded(vectors.reduce(balance(s, d)), digits=2))
query("reduce_max", "SELECT max(balance) AS val FROM n")(lambda s, d: vectors.reduce(balance(s, d), "max"))
query("reduce_min", "SELECT min(balance) AS val FROM n")(lambda s, d: vectors.reduce(balance(s, d), "min"))
query("float_vector_scale", "SELECT id, round(balance * 0.5, 4) AS val FROM n")(lambda s, d: rounded(vectors.scale(balance(s, d), 0.5)))
query("vector_mul_attr", "SELECT id, round(balance * nation, 4) + 0.0 AS val FROM n")(lambda s, d: rounded(vectors.times_attribute(balance(s, d), nodes(s, d), "nation")))
query("vector_str_concat", "SELECT id, key || '/' || segment AS val FROM n")(
    lambda s, d: vectors.concat(nodes(s, d).select("id", F.col("key").alias("val")), nodes(s, d).select("id", F.col("segment").alias("val")), "/"))
query("mxm_masked", "SELECT x.src AS i, y.tgt AS j, count(*)::DOUBLE AS val FROM u x JOIN u y ON y.src = x.tgt JOIN u z ON z.src = x.src AND z.tgt = y.tgt GROUP BY ALL")(
    lambda s, d: _triangle_product(s, d))


def _triangle_product(s, d):
    from propgraph.sources.tables import simple_edges

    m = vectors.triple(simple_edges(edges(s, d)))
    return vectors.mxm(m, m, m)
