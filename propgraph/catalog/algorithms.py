"""Queries of the graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from propgraph.catalog.registry import query
from propgraph.operators import ranking, sampling, sets, structure, traversal
from propgraph.operators.components import afforest, connected_components
from propgraph.sources.tables import customer_edges as edges
from propgraph.sources.tables import customer_nodes as nodes
from propgraph.sources.tables import forward_edges, simple_edges

ROUNDS = 10


def chained(first: str, step: str, rounds: int, last: str) -> tuple[str, str]:
    """CTEs p0..pn, each from the one before ({p}), and a final SELECT over {p}."""
    ctes = [f"p0 AS MATERIALIZED ({first})"] + [f"p{i} AS MATERIALIZED ({step.format(p=f'p{i - 1}', i=i)})" for i in range(1, rounds + 1)]
    return ", ".join(ctes), last.format(p=f"p{rounds}")


def simple(s, d):
    return simple_edges(edges(s, d))


def chain(name, first, step, rounds, last, before=""):
    ctes, sql = chained(first, step, rounds, last)
    return query(name, sql, f"{before + ', ' if before else ''}{ctes}")


N = "(SELECT count(*) FROM n)"
DEG = "deg AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src)"


@chain("pagerank", f"SELECT id, 1.0::DOUBLE / {N} AS v FROM n",
       f"SELECT n.id, 0.85::DOUBLE * coalesce(x.v, 0) + 0.15::DOUBLE / {N} AS v FROM n LEFT JOIN (SELECT e.tgt, sum({{p}}.v / deg.deg) AS v FROM e JOIN {{p}} ON {{p}}.id = e.src JOIN deg ON deg.src = e.src GROUP BY e.tgt) x ON x.tgt = n.id",
       ROUNDS, "SELECT id, round(v, 10) AS val FROM {p}", DEG)
def pagerank(s, d):
    return ranking.pagerank(edges(s, d), nodes(s, d), rounds=ROUNDS).select("id", F.round("val", 10).alias("val"))


@chain("katz", f"SELECT id, 1.0::DOUBLE / {N} AS v FROM n",
       "SELECT n.id, 0.01::DOUBLE * coalesce(x.v, 0) + 1.0 AS v FROM n LEFT JOIN (SELECT e.tgt, sum({p}.v) AS v FROM e JOIN {p} ON {p}.id = e.src GROUP BY e.tgt) x ON x.tgt = n.id",
       ROUNDS, "SELECT id, round(v, 8) AS val FROM {p}")
def katz(s, d):
    return ranking.katz(edges(s, d), nodes(s, d), rounds=ROUNDS).select("id", F.round("val", 8).alias("val"))


@chain("eigenvector", f"SELECT id, 1.0::DOUBLE / sqrt({N}) AS v FROM n",
       "SELECT id, v / sqrt(sum(v * v) OVER ()) AS v FROM (SELECT n.id, coalesce(x.v, 0) AS v FROM n LEFT JOIN (SELECT e.tgt, sum({p}.v) AS v FROM e JOIN {p} ON {p}.id = e.src GROUP BY e.tgt) x ON x.tgt = n.id)",
       ROUNDS, "SELECT id, round(v, 8) AS val FROM {p}")
def eigenvector(s, d):
    return ranking.eigenvector(edges(s, d), nodes(s, d), rounds=ROUNDS).select("id", F.round("val", 8).alias("val"))


def _hits_sql():
    ctes = [f"p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / sqrt({N}) AS h, 0.0::DOUBLE AS a FROM n)"]
    for i in range(1, ROUNDS + 1):
        ctes.append(f"q{i} AS MATERIALIZED (SELECT id, v / sqrt(sum(v * v) OVER ()) AS a FROM (SELECT n.id, coalesce(x.v, 0) AS v FROM n LEFT JOIN (SELECT e.tgt AS i, sum(h) AS v FROM e JOIN p{i - 1} p ON p.id = e.src GROUP BY 1) x ON x.i = n.id))")
        ctes.append(f"p{i} AS MATERIALIZED (SELECT id, a, v / sqrt(sum(v * v) OVER ()) AS h FROM (SELECT q.id, q.a, coalesce(x.v, 0) AS v FROM q{i} q LEFT JOIN (SELECT e.src AS i, sum(a) AS v FROM e JOIN q{i} q ON q.id = e.tgt GROUP BY 1) x ON x.i = q.id))")
    return ", ".join(ctes)


@query("hits", f"SELECT id, round(h, 8) AS hub, round(a, 8) AS authority FROM p{ROUNDS}", _hits_sql())
def hits(s, d):
    return ranking.hits(edges(s, d), nodes(s, d), rounds=ROUNDS).select("id", F.round("hub", 8).alias("hub"), F.round("authority", 8).alias("authority"))


@query("bfs", "SELECT n.id, coalesce(l, -1)::INTEGER AS level FROM n LEFT JOIN (SELECT id, min(l) AS l FROM r GROUP BY id) USING (id)",
       "r AS (SELECT 0::BIGINT AS id, 0 AS l UNION SELECT e.tgt, r.l + 1 FROM r JOIN e ON e.src = r.id WHERE r.l < 12)", recursive=True)
def bfs(s, d):
    return traversal.bfs(edges(s, d), nodes(s, d), sets.of(s, [0]))


@query("reachable", "SELECT id FROM r", "r AS (SELECT 0::BIGINT AS id UNION SELECT e.tgt FROM r JOIN e ON e.src = r.id)", recursive=True)
def reachable(s, d):
    return traversal.reachable(edges(s, d), sets.of(s, [0]))


SSSP = chained("SELECT 0::BIGINT AS id, 0.0::DOUBLE AS v",
               "SELECT id, min(v) AS v FROM (SELECT id, v FROM {p} UNION ALL SELECT e.tgt, {p}.v + e.w FROM {p} JOIN e ON e.src = {p}.id) GROUP BY id", 24, "SELECT id, round(v, 4) AS dist FROM {p}")


@query("sssp", SSSP[1], SSSP[0])
def sssp(s, d):
    return traversal.sssp(edges(s, d), sets.of(s, [0])).select("id", F.round("dist", 4).alias("dist"))


@query("delta_step_relax", SSSP[1], SSSP[0])
def delta_stepping(s, d):
    return traversal.delta_stepping(edges(s, d), sets.of(s, [0]), 100000.0).select("id", F.round("dist", 4).alias("dist"))


#: Labels sink along all edges, a step a round: enough for components whose nodes are at most 24 steps from their least.
WCC = chained("SELECT id, id AS c FROM n", "SELECT a.id, least(a.c, coalesce(min(b.c), a.c)) AS c FROM {p} a LEFT JOIN (SELECT src AS i, tgt AS o FROM u UNION ALL SELECT tgt, src FROM u) x ON x.i = a.id LEFT JOIN {p} b ON b.id = x.o GROUP BY a.id, a.c", 24, "SELECT id, c AS component FROM {p}")


def _components(s, d, find=connected_components):
    found = find(edges(s, d).select("src", F.col("tgt").alias("dst")))
    return nodes(s, d).select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


for name in ("wcc", "cc_hook_compress"):
    query(name, WCC[1], WCC[0])(_components)
query("cc_afforest", WCC[1], WCC[0])(lambda s, d: _components(s, d, afforest))


@query("island_detect", "SELECT id, min(c) AS component FROM r GROUP BY id",
       "x AS (SELECT src AS i, tgt AS o FROM u WHERE src IN (SELECT id FROM seed) AND tgt IN (SELECT id FROM seed)), y AS (SELECT i, o FROM x UNION ALL SELECT o, i FROM x), r AS (SELECT id, id AS c FROM seed UNION SELECT y.o, r.c FROM r JOIN y ON y.i = r.id)", recursive=True)
def islands(s, d):
    return structure.islands(edges(s, d), nodes(s, d).filter("nation = 3").select("id"))


TRI = "t AS MATERIALIZED (SELECT x.src AS x, x.tgt AS y, y.tgt AS z FROM u x JOIN u y ON y.src = x.tgt JOIN u z ON z.src = x.src AND z.tgt = y.tgt)"
query("triangles", "SELECT count(*) AS triangles FROM t", TRI)(lambda s, d: structure.triangle_count(simple(s, d)))
query("tc_sweep_batch", "SELECT x, y, z FROM t", TRI)(lambda s, d: structure.triangles(simple(s, d)))
query("edge_support", "SELECT u.src, u.tgt, count(t.x) AS support FROM u LEFT JOIN t ON (u.src = t.x AND u.tgt = t.y) OR (u.src = t.x AND u.tgt = t.z) OR (u.src = t.y AND u.tgt = t.z) GROUP BY ALL", TRI)(
    lambda s, d: structure.edge_support(simple(s, d)))
query("motif_match_3", "SELECT 'triangle' AS motif, count(*) AS n FROM t UNION ALL SELECT 'wedge', ((SELECT sum(c * (c - 1) // 2) FROM (SELECT count(*) AS c FROM (SELECT src AS i FROM u UNION ALL SELECT tgt FROM u) GROUP BY i)) - 3 * (SELECT count(*) FROM t))::BIGINT", TRI)(
    lambda s, d: structure.motifs(simple(s, d)))
query("two_paths", "SELECT count(*) AS n FROM e a JOIN e b ON b.src = a.tgt")(lambda s, d: structure.two_paths(edges(s, d)))

CORE = chained("SELECT src, tgt FROM u UNION ALL SELECT tgt, src FROM u",
               "SELECT src, tgt FROM {p} WHERE src IN (SELECT src FROM {p} GROUP BY src HAVING count(*) >= 14) AND tgt IN (SELECT src FROM {p} GROUP BY src HAVING count(*) >= 14)", 20, "SELECT DISTINCT src AS id FROM {p}")
query("k_core", CORE[1].replace("p20", "p4"), CORE[0].replace(">= 14", ">= 8"))(lambda s, d: structure.k_core(simple(s, d), 8))
query("k_core_14", CORE[1], CORE[0])(lambda s, d: structure.k_core(simple(s, d), 14))


CORES = chained("SELECT id, count(x.i) AS c FROM n LEFT JOIN (SELECT src AS i, tgt AS o FROM u UNION ALL SELECT tgt, src FROM u) x ON x.i = n.id GROUP BY id",
                "SELECT n.id, coalesce(h.c, 0) AS c FROM n LEFT JOIN (SELECT i, max(least(c, r)) AS c FROM (SELECT x.i, y.c, row_number() OVER (PARTITION BY x.i ORDER BY y.c DESC) AS r FROM (SELECT src AS i, tgt AS o FROM u UNION ALL SELECT tgt, src FROM u) x JOIN {p} y ON y.id = x.o) GROUP BY i) h ON h.i = n.id",
                40, "SELECT id, c::BIGINT AS core FROM {p}")


@query("kcore_decomposition", CORES[1], CORES[0])
def core_numbers(s, d):
    return structure.core_numbers(simple(s, d), nodes(s, d))


def _truss(k, rounds):
    tri = "SELECT a.src AS x, a.tgt AS y, b.tgt AS z FROM {p} a JOIN {p} b ON b.src = a.tgt JOIN {p} c ON c.src = a.src AND c.tgt = b.tgt"
    return chained("SELECT src, tgt FROM u", f"SELECT src, tgt FROM (WITH t AS ({tri}) SELECT x AS src, y AS tgt FROM t UNION ALL SELECT x, z FROM t UNION ALL SELECT y, z FROM t) GROUP BY src, tgt HAVING count(*) >= {k - 2}", rounds, "SELECT src, tgt FROM {p}")


for k, rounds in ((3, 3), (4, 15)):
    ctes, sql = _truss(k, rounds)
    query(f"k_truss_{k}", sql, ctes)(lambda s, d, k=k: structure.k_truss(simple(s, d), k))

SIM = """b AS MATERIALIZED (SELECT src AS a, tgt AS m FROM u UNION ALL SELECT tgt, src FROM u), g AS (SELECT a, count(*) AS c FROM b GROUP BY a),
q AS (SELECT u.src AS a, u.tgt AS b, (SELECT count(*) FROM b x JOIN b y ON x.m = y.m WHERE x.a = u.src AND y.a = u.tgt) AS shared, gx.c AS ca, gy.c AS cb FROM u JOIN g gx ON gx.a = u.src JOIN g gy ON gy.a = u.tgt)"""
query("jaccard", "SELECT a, b, shared, round(shared / (ca + cb - shared), 8) AS jaccard FROM q", SIM)(
    lambda s, d: structure.similarity(simple(s, d), simple(s, d).select(F.col("src").alias("a"), F.col("tgt").alias("b"))).select("a", "b", "shared", F.round("jaccard", 8).alias("jaccard")))
query("cosine", "SELECT a, b, shared, round(shared / (sqrt(ca) * sqrt(cb)), 8) AS cosine FROM q", SIM)(
    lambda s, d: structure.similarity(simple(s, d), simple(s, d).select(F.col("src").alias("a"), F.col("tgt").alias("b"))).select("a", "b", "shared", F.round("cosine", 8).alias("cosine")))


#: Query nodes of the path counts: a fiftieth of all, against all edges.
SOURCES = "id % 50 = 0"


def _brandes_sql(depth):
    ctes = ["de AS MATERIALIZED (SELECT DISTINCT src, tgt FROM e)", "f0 AS MATERIALIZED (SELECT id AS s, id, 0 AS l, 1.0::DOUBLE AS sg FROM n WHERE id % 50 = 0)"]
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT s, id FROM f{j}" for j in range(i))
        ctes.append(f"f{i} AS MATERIALIZED (SELECT f.s, de.tgt AS id, {i} AS l, sum(f.sg) AS sg FROM f{i - 1} f JOIN de ON de.src = f.id WHERE (f.s, de.tgt) NOT IN (SELECT s, id FROM ({seen})) GROUP BY f.s, de.tgt)")
    ctes.append(f"b{depth} AS MATERIALIZED (SELECT s, id, sg, 0.0::DOUBLE AS dl FROM f{depth})")
    for i in range(depth - 1, -1, -1):
        ctes.append(f"b{i} AS MATERIALIZED (SELECT f.s, f.id, f.sg, coalesce(sum(f.sg / w.sg * (1 + w.dl)), 0) AS dl FROM f{i} f LEFT JOIN (de JOIN b{i + 1} w ON w.id = de.tgt) ON de.src = f.id AND w.s = f.s GROUP BY ALL)")
    ctes.append("bc AS (" + " UNION ALL ".join(f"SELECT s, id, dl FROM b{i}" for i in range(depth + 1)) + ")")
    return ", ".join(ctes)


@query("betweenness", "SELECT n.id, round(coalesce(sum(dl), 0), 6) AS val FROM n LEFT JOIN bc ON bc.id = n.id AND bc.s <> bc.id GROUP BY n.id", _brandes_sql(9))
def betweenness(s, d):
    return traversal.betweenness(edges(s, d), nodes(s, d), nodes(s, d).filter(SOURCES).select("id")).select("id", F.round("val", 6).alias("val"))


@query("brandes_forward", "SELECT s, id, l AS level, sg AS sigma FROM (" + " UNION ALL ".join(f"SELECT * FROM f{i}" for i in range(10)) + ")", _brandes_sql(9))
def brandes_forward(s, d):
    return traversal.shortest_path_counts(edges(s, d), nodes(s, d).filter(SOURCES).select("id"))


def _boruvka_sql(rounds=8, jumps=12):
    """Each component picks its least edge (w, src, tgt) to another; the picks are followed to their roots by doubling."""
    ctes = ["es AS MATERIALIZED (SELECT least(src, tgt) AS src, greatest(src, tgt) AS tgt, min(w) AS w FROM e WHERE src <> tgt GROUP BY ALL)", "c0 AS MATERIALIZED (SELECT id, id AS c FROM n)"]
    for i in range(rounds):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT es.*, a.c AS ca, b.c AS cb FROM es JOIN c{i} a ON a.id = es.src JOIN c{i} b ON b.id = es.tgt WHERE a.c <> b.c)")
        ctes.append(f"b{i} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY w, src, tgt) AS r FROM (SELECT ca AS c, cb AS o, w, src, tgt FROM l{i} UNION ALL SELECT cb, ca, w, src, tgt FROM l{i})) WHERE r = 1)")
        ctes.append(f"j{i}_0 AS MATERIALIZED (SELECT x.c, CASE WHEN y.o = x.c AND x.c < x.o THEN x.c ELSE x.o END AS p FROM b{i} x JOIN b{i} y ON y.c = x.o)")
        ctes += [f"j{i}_{j} AS MATERIALIZED (SELECT x.c, y.p FROM j{i}_{j - 1} x JOIN j{i}_{j - 1} y ON y.c = x.p)" for j in range(1, jumps)]
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT id, coalesce(p, a.c) AS c FROM c{i} a LEFT JOIN j{i}_{jumps - 1} j ON j.c = a.c)")
    return ", ".join(ctes) + ", forest AS (" + " UNION ".join(f"SELECT src, tgt, w FROM b{i}" for i in range(rounds)) + ")"


@query("mst", "SELECT src, tgt, w FROM forest", _boruvka_sql())
def mst(s, d):
    return structure.spanning_forest(edges(s, d))


@query("mst_weight", "SELECT count(*) AS n_edges, round(sum(w), 2) AS weight FROM forest", _boruvka_sql())
def mst_weight(s, d):
    return structure.spanning_forest(edges(s, d)).agg(F.count(F.lit(1)).alias("n_edges"), F.round(F.sum("w"), 2).alias("weight"))


@query("toposort", "SELECT n.id, coalesce(max(l), 0)::INTEGER AS layer FROM n LEFT JOIN r ON r.id = n.id GROUP BY n.id",
       "ds AS (SELECT DISTINCT src, tgt FROM e WHERE src < tgt), r AS (SELECT id, 0 AS l FROM n UNION SELECT ds.tgt, r.l + 1 FROM r JOIN ds ON ds.src = r.id)", recursive=True)
def toposort(s, d):
    return traversal.topological_layers(forward_edges(edges(s, d)), nodes(s, d))


def _sampled(i, layer):
    return f"h{i} AS MATERIALIZED (SELECT {i} AS hop, src, tgt FROM (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY {sampling.mixed_sql(1, i, 'src', 'tgt')}, tgt) AS r FROM (SELECT DISTINCT src, tgt FROM e) WHERE src IN ({layer})) WHERE r <= {(3, 2)[i - 1]})"


@query("sample_neighbors", "SELECT * FROM h1 UNION ALL SELECT * FROM h2", _sampled(1, "SELECT id FROM seed") + ", " + _sampled(2, "SELECT tgt FROM h1"))
def sample_neighbours(s, d):
    return sampling.sample_neighbours(edges(s, d), nodes(s, d).filter("nation = 3").select("id"), [3, 2])


def _walks_sql(length):
    ctes = ["li AS MATERIALIZED (SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY tgt) - 1 AS nth, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT src, tgt FROM e))", "x0 AS MATERIALIZED (SELECT id AS walker, 0 AS step, id FROM seed)"]
    for i in range(1, length + 1):
        coin = f"{sampling.mixed_sql(2, i, 'x.walker')} < {int(0.15 * sampling.MODULUS)}"
        ctes.append(f"x{i} AS MATERIALIZED (SELECT x.walker, {i} AS step, CASE WHEN {coin} THEN x.walker ELSE coalesce(li.tgt, x.id) END AS id FROM x{i - 1} x LEFT JOIN li ON li.src = x.id AND li.nth = ({sampling.mixed_sql(1, i, 'x.walker', 'x.id')}) % li.deg)")
    return ", ".join(ctes)


@query("random_walk", " UNION ALL ".join(f"SELECT walker, step, id FROM x{i}" for i in range(6)), _walks_sql(5))
def random_walks(s, d):
    return sampling.random_walks(edges(s, d), nodes(s, d).filter("nation = 3").select("id"), 5)


@query("modularity", "SELECT round(sum(coalesce(i.c, 0) / m - (g.c / (2 * m)) ** 2), 8) AS modularity FROM g LEFT JOIN i USING (nation), (SELECT count(*)::DOUBLE AS m FROM u)",
       "l AS (SELECT a.nation AS x, b.nation AS y FROM u JOIN n a ON a.id = u.src JOIN n b ON b.id = u.tgt), g AS (SELECT nation, count(*) AS c FROM (SELECT x AS nation FROM l UNION ALL SELECT y FROM l) GROUP BY nation), i AS (SELECT x AS nation, count(*) AS c FROM l WHERE x = y GROUP BY x)")
def modularity(s, d):
    return structure.modularity(simple(s, d), nodes(s, d).select("id", F.col("nation").alias("label"))).select(F.round("modularity", 8).alias("modularity"))


def _louvain_sql(rounds=8):
    ctes = ["x AS MATERIALIZED (SELECT src AS i, tgt AS o FROM u UNION ALL SELECT tgt, src FROM u)", "dg AS MATERIALIZED (SELECT i AS id, count(*) AS deg FROM x GROUP BY i)", "p0 AS MATERIALIZED (SELECT id, id AS label FROM n)"]
    for k in range(rounds):
        stay = f"(({sampling.mixed_sql(k // 2, 'a.id')}) + {k}) % 2 = 0"
        ctes.append(f"""p{k + 1} AS MATERIALIZED (WITH t AS (SELECT label, sum(deg) AS tot FROM p{k} JOIN dg USING (id) GROUP BY label),
m AS (SELECT x.i AS id, p.label, count(*) AS cnt FROM x JOIN p{k} p ON p.id = x.o GROUP BY ALL),
g AS (SELECT m.id, m.label, round(m.cnt - dg.deg * (t.tot - CASE WHEN m.label = p.label THEN dg.deg ELSE 0 END)::DOUBLE / (SELECT count(*) FROM x)::DOUBLE, 9) AS score FROM m JOIN t USING (label) JOIN dg ON dg.id = m.id JOIN p{k} p ON p.id = m.id),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM g) WHERE r = 1)
SELECT a.id, CASE WHEN b.id IS NULL OR {stay} OR b.score <= 0 THEN a.label ELSE b.label END AS label FROM p{k} a LEFT JOIN b ON b.id = a.id)""")
    return ", ".join(ctes)


@query("louvain", "SELECT id, label FROM p8", _louvain_sql())
def louvain(s, d):
    return structure.louvain_level(simple(s, d), nodes(s, d))


@query("graph_isomorphism", "SELECT 'renamed' AS other, TRUE AS same UNION ALL SELECT 'one edge bent', FALSE")
def isomorphism(s, d):
    """The graph against itself with new names, and against itself with the end of its first edge moved to a new node."""
    e, n = simple(s, d), nodes(s, d).select("id")
    turn = lambda c: (F.lit(1_000_003) - F.col(c)).alias(c)
    renamed = structure.may_be_isomorphic((e, n), (e.select(turn("src"), turn("tgt")), n.select(turn("id"))))
    first = F.broadcast(e.agg(F.min(F.struct("src", "tgt")).alias("f")).select(F.col("f.src").alias("a"), F.col("f.tgt").alias("b")))  # one row
    bent = e.crossJoin(first).select("src", F.when((F.col("src") == F.col("a")) & (F.col("tgt") == F.col("b")), F.lit(-1)).otherwise(F.col("tgt")).alias("tgt"))
    other = structure.may_be_isomorphic((e, n), (bent, n.unionByName(s.range(1).select(F.lit(-1).cast("long").alias("id")))))
    return renamed.select(F.lit("renamed").alias("other"), "same").unionByName(other.select(F.lit("one edge bent").alias("other"), "same"))
