"""Golden results on small graphs, closed-form counts and the files a graph is built from."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from propgraph.functions import signatures, statistics
from propgraph.model import PropertyGraph
from propgraph.operators import maintenance, ranking, sampling, sets, structure, traversal, vectors, walk
from propgraph.operators.components import connected_components
from propgraph.operators.joins import lookup
from propgraph.plans import cypher, datalog, program, records, sexpr
from propgraph.sources import files, generate


def edges(spark, pairs, weight=None):
    if weight is None:
        return spark.createDataFrame(pairs, "src long, tgt long")
    return spark.createDataFrame([(a, b, float(w)) for (a, b), w in zip(pairs, weight, strict=True)], "src long, tgt long, w double")


CLIQUE = [(a, b) for a in range(4) for b in range(4) if a != b]
UP = [(a, b) for a, b in CLIQUE if a < b]


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_clique_centralities(spark):
    e, n = edges(spark, CLIQUE), spark.range(4)
    for got, want in ((ranking.pagerank(e, n, tolerance=1e-9), 0.25), (ranking.eigenvector(e, n, rounds=3), 0.5)):
        assert all(abs(v - want) < 1e-9 for _, v in values(got, "id", "val"))
    assert all(abs(h - 0.5) < 1e-9 and abs(a - 0.5) < 1e-9 for _, h, a in values(ranking.hits(e, n, rounds=2), "id", "hub", "authority"))
    assert all(v == 0 for _, v in values(traversal.betweenness(e, n, n), "id", "val"))
    assert values(traversal.bfs(e, spark.range(5), sets.of(spark, [0])), "id", "level") == [(0, 0), (1, 1), (2, 1), (3, 1), (4, -1)]


def test_clique_structure(spark):
    u = edges(spark, UP)
    assert structure.triangle_count(u).head()[0] == 4
    assert structure.k_core(u, 3).count() == 4 and structure.k_core(u, 4).count() == 0
    assert structure.k_truss(u, 4).count() == 6 and structure.k_truss(u, 5).count() == 0
    s = structure.similarity(u, spark.createDataFrame([(0, 1), (0, 9)], "a long, b long")).orderBy("b").collect()
    assert (s[0].jaccard, round(s[0].cosine, 6)) == (0.5, 0.666667) and s[1].jaccard == s[1].cosine == 0.0
    assert structure.spanning_forest(edges(spark, CLIQUE, [1] * 12)).count() == 3
    assert values(structure.core_numbers(u, spark.range(5)), "id", "core") == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 0)]
    assert {r.motif: r.n for r in structure.motifs(u).collect()} == {"triangle": 4, "wedge": 0}


def test_chain(spark):
    chain = edges(spark, [(0, 1), (1, 2), (2, 3)], [1, 2, -1])
    assert values(traversal.topological_layers(chain, spark.range(4)), "id", "layer") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert values(traversal.sssp(chain, sets.of(spark, [0])), "id", "dist") == [(0, 0.0), (1, 1.0), (2, 3.0), (3, 2.0)]
    with pytest.raises(ValueError, match="negative cycle"):
        traversal.sssp(edges(spark, [(0, 1), (1, 0)], [1, -2]), sets.of(spark, [0]))
    cycle = edges(spark, [(0, 1), (1, 2), (2, 1), (2, 3)])
    assert values(traversal.topological_layers(cycle, spark.range(4)), "id", "layer") == [(0, 0), (1, -1), (2, -1), (3, -1)]


def test_betweenness_of_a_path_and_spanning_forest_against_kruskal(spark):
    both = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2)]
    assert values(traversal.betweenness(edges(spark, both), spark.range(4), spark.range(4)), "id", "val") == [(0, 0.0), (1, 4.0), (2, 4.0), (3, 0.0)]
    pairs = [(r.src, r.tgt) for r in generate.erdos_renyi(spark, 60, 90).collect()]
    w = [(7 * a + 13 * b) % 11 for a, b in pairs]
    got = structure.spanning_forest(edges(spark, pairs, w))
    top = list(range(60))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    total = n = 0
    for cost, a, b in sorted((c, min(p), max(p)) for c, p in zip(w, pairs, strict=True)):
        if root(a) != root(b):
            top[root(a)] = root(b)
            total, n = total + cost, n + 1
    assert (got.count(), got.agg(F.sum("w")).head()[0]) == (n, total)


def test_components_of_long_chains_and_hubs(spark):
    pairs = [(k, k + 1) for k in range(700)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.component: r["count"] for r in got.groupBy("component").count().collect()} == {0: 701, 1000: 300, 5000: 1}


def test_lookup_of_heavy_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    assert lookup(left, right, "k", "n", 5000).count() == 5000
    assert lookup(left, right.filter("k <> 7 and k > 2000"), "k", "n", 5000, "left").count() == 5000


def test_generators(spark):
    e = generate.graph500(spark, 8, 16)
    assert 3000 < e.count() <= 4096 and e.filter("src = tgt or src >= 256 or tgt >= 256").isEmpty()
    assert values(generate.graph500(spark, 6, 4).repartition(7), "src", "tgt") == values(generate.graph500(spark, 6, 4), "src", "tgt")
    assert generate.grid(spark, 20, 20, torus=True, undirected=True).groupBy("src").count().agg(F.min("count"), F.max("count"), F.sum("count")).head()[:] == (4, 4, 1600)
    assert generate.grid(spark, 5, 5, 5, undirected=True).count() == 600
    assert generate.tree(spark, 3, 4).count() == 120 and generate.star(spark, 100).count() == 99
    assert generate.preferential(spark, 500, 6, True).count() == 5958
    assert generate.generate(spark, "er", nodes=400, edges=2500).filter("src <> tgt").count() == 2500
    inner = generate.block_model(spark, 300, 5, 0.05, 0.001)
    same = inner.filter("src % 5 = tgt % 5").count()
    assert inner.filter("src = tgt or src >= 300 or tgt >= 300").isEmpty() and inner.count() == inner.distinct().count()
    assert 700 < same < 1070 and 20 < inner.count() - same < 150  # 300 * 59 * .05 = 885 and 300 * 240 * .001 = 72
    assert generate.block_model(spark, 40, 4, 1.0, 1.0, self_loops=True).count() == 1600
    with pytest.raises(ValueError, match="unknown profile"):
        generate.generate(spark, "nonsense")
    typed = dict(generate.with_attributes(generate.star(spark, 10), "weight:f32,timestamp:i64,type:i32,x:f64").dtypes)
    assert [typed[c] for c in ("weight", "timestamp", "type", "x")] == ["float", "bigint", "int", "double"]


def test_manifest_text_and_duplicates(spark, tmp_path):
    (tmp_path / "members.tsv").write_text("# who\nalice eng\nbob   eng extra\n\ncharlie\tproduct\nlonely\n")
    (tmp_path / "parents.csv").write_text("src,tgt,weight\neng,admin,3\nproduct,admin,x\n")
    manifest = {
        "domains": [{"id": 0, "name": "User", "key_type": "string"}, {"id": 4, "name": "Group", "key_type": "string"}],
        "relations": [{"src_domain": 0, "tgt_domain": 4, "file": "members.tsv"}, {"name": "parent", "src_domain": 4, "tgt_domain": 4, "file": "parents.csv", "attributes": [{"name": "w", "column": "weight", "type": "i64"}]}],
    }
    g = files.from_manifest(spark, json.dumps(manifest), str(tmp_path))
    assert values(g.nodes("user"), "id", "key") == [(0, "alice"), (1, "bob"), (2, "charlie")]
    assert values(g.nodes("group"), "id", "key") == [(0, "eng"), (1, "product"), (2, "admin")]
    assert values(g.edges("members"), "src", "tgt") == [(0, 0), (1, 0), (2, 1)]
    assert values(g.edges("PARENT"), "src", "tgt", "w") == [(0, 2, 3), (1, 2, 0)]
    assert maintenance.validate(g).count() == 0
    again = g.saved()
    assert values(again.edges("parent"), "src", "tgt", "w") == values(g.edges("parent"), "src", "tgt", "w")
    with pytest.raises(ValueError, match="Duplicate relation definition"):
        files.from_manifest(spark, manifest | {"relations": manifest["relations"][:1] * 2}, str(tmp_path))
    with pytest.raises(ValueError, match="undeclared domain"):
        files.from_manifest(spark, manifest | {"relations": [{"src_domain": 0, "tgt_domain": 9, "file": "x"}]}, str(tmp_path))
    with pytest.raises(KeyError):
        g.relation("nothing")


def test_parquet_manifest_export_and_headers(spark, tmp_path):
    spark.createDataFrame([("u1", 25), ("u2", 30), ("u3", 35)], "user_id string, age int").coalesce(1).write.parquet(str(tmp_path / "users.parquet"))
    spark.createDataFrame([("u1", "u2", 10), ("u1", "u3", 20), ("u2", "u3", 30)], "src_user string, tgt_user string, weight int").coalesce(1).write.parquet(str(tmp_path / "follows.parquet"))
    g = files.from_manifest(spark, {
        "domains": [{"id": 0, "name": "User", "key_type": "string", "file": "users.parquet", "id_column": "user_id", "attributes": [{"name": "age", "column": "age"}]}],
        "relations": [{"name": "Follows", "src_domain": 0, "tgt_domain": 0, "file": "follows.parquet", "src_column": "src_user", "tgt_column": "tgt_user", "attributes": [{"name": "weight", "column": "weight"}]}],
    }, str(tmp_path))
    assert g.describe_relations().head().edge_count == 3 and values(g.nodes("User"), "key", "age") == [("u1", 25), ("u2", 30), ("u3", 35)]
    for kind, want in (("tsv", "0\t1"), ("csv", "0,1"), ("jsonl", '{"src":0,"tgt":1}')):
        path = files.export_edges(g, str(tmp_path / "out"), kind)[0]
        assert spark.read.text(path).orderBy("value").head().value == want
    e = generate.with_attributes(generate.star(spark, 5), "weight:f32")
    for kind, head in (("tsv", "src\ttgt\tweight"), ("csv", "src,tgt,weight")):
        files.write_delimited(e.coalesce(1), str(tmp_path / kind), kind)
        lines = [r.value for r in spark.read.text(str(tmp_path / kind)).collect()]
        assert head in lines and len(lines) == 5
    got = cypher.run(g, "MATCH (u:User)-[r:Follows]->(v:User) WHERE u.age > 26 RETURN v, r.weight AS w")
    assert values(got, "v", "w") == [("u3", 30)]


def test_tensor_headers(spark, tmp_path):
    head = json.dumps({"a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "__metadata__": {"x": "y"}}).encode()
    (tmp_path / "m.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 24)
    rows = files.tensor_headers(spark, str(tmp_path)).collect()
    assert [(r.name, r.dtype, list(r.shape), r.nbytes) for r in rows] == [("a", "F32", [2, 3], 24)]
    (tmp_path / "n.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + b"\0" * 24)
    g = files.tensor_domain(spark, str(tmp_path), "tensor")
    assert values(g.nodes("tensor"), "id", "key", "nbytes") == [(0, "m.safetensors/a", 24), (1, "n.safetensors/a", 24)] and not g.relations


#: Sets that a set opens are closed upwards first; a person opens what any of the sets opens that they are in.
OPENS = """
.decl opens(Who, What)
within(G, G) :- doc_viewer(G, _).
within(G, H) :- group_parent(G, H).
within(G, K) :- within(G, H), group_parent(H, K).
within(G, G) :- direct_member(_, G).
kept_out(W) :- revoked(W).
opens(W, D) :- direct_member(W, G), within(G, H), doc_viewer(H, D), !kept_out(W).
"""


def test_rebac(spark):
    two = lambda rows: spark.createDataFrame(rows, "a string, b string")
    facts = {
        "direct_member": two([("alice", "eng_team"), ("bob", "eng_team"), ("charlie", "product_team")]), "group_parent": two([("eng_team", "admin_group"), ("product_team", "admin_group")]),
        "doc_viewer": two([("admin_group", "doc_1"), ("eng_team", "doc_2")]), "revoked": spark.createDataFrame([], "a string"),
    }
    full = {("alice", "doc_1"), ("alice", "doc_2"), ("bob", "doc_1"), ("bob", "doc_2"), ("charlie", "doc_1")}
    assert {tuple(r) for r in datalog.run(spark, OPENS, facts, "opens").collect()} == full
    facts["revoked"] = spark.createDataFrame([("bob",)], "a string")
    assert {tuple(r) for r in datalog.run(spark, OPENS, facts, "opens").collect()} == {x for x in full if x[0] != "bob"}
    with pytest.raises(ValueError, match="not bound"):
        datalog.run(spark, "p(X, Y) :- direct_member(X, _).", facts, "p")
    with pytest.raises(ValueError, match="negation through recursion"):
        datalog.run(spark, "p(X) :- revoked(X), !q(X).\nq(X) :- revoked(X), !p(X).", facts, "p")
    assert {tuple(r) for r in datalog.run(spark, 'p(X) :- direct_member(X, "eng_team").\np("extra").', facts, "p").collect()} == {("alice",), ("bob",), ("extra",)}


def test_programs_and_sexpr(spark):
    g = PropertyGraph(spark).add_domain("v", spark.range(5)).add_relation("follows", "v", "v", edges(spark, [(0, 1), (1, 2), (2, 3)]))
    # who follows someone, and whom the followed follow: back and two steps on, joined
    text = '.relation "follows" = 3\nOP_CSC_WALK R7, R0, REL_3 ; back\nOP_CSR_WALK_2HOP R8, R0, REL_3\nOP_SET_UNION R63, R7, R8\nOP_HALT'
    assert values(program.Machine(g).run(text, 1), "id") == [(0,), (3,)]
    others = text.replace("OP_SET_UNION R63, R7, R8", "OP_CSR_WALK R63, R7, REL_3, INVERT")
    assert values(program.Machine(g).run(others, 1), "id") == [(0,), (2,), (3,), (4,)]
    quoted = 'OP_NODE_FILTER R63, R0, v, "id in (1, 3) ; no comment" ; but this is'
    assert program.assemble(quoted).instructions[0].args == ["R63", "R0", "v", '"id in (1, 3) ; no comment"']
    assert values(program.Machine(g).run('OP_NODE_FILTER R63, R0, v, "id in (1,3)"', [0, 1, 2, 3]), "id") == [(1,), (3,)]
    assert program.Machine(g).run('.relation "follows" = 0\nOP_SET_CARDINALITY R63, R0\nOP_JNZ R63, end\nOP_TRAP\nend: OP_HALT', [0, 1, 1]) == 2
    with pytest.raises(ValueError, match="unknown instruction"):
        program.Machine(g).run("OP_NONSENSE R1, R0", 0)
    with pytest.raises(KeyError):
        program.Machine(g).run("OP_CSR_WALK R1, R0, REL_7", 0)
    assert values(sexpr.run(g, '(csc-walk "follows")'), "id") == [(0,), (1,), (2,)]
    assert sexpr.run(g, "(define-query (q [g : graph]) (return #t))") is True


def test_vectors_sets_and_upkeep(spark):
    v = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, val double")
    e = edges(spark, [(0, 1), (1, 0), (0, 2)], [2, 3, 4])
    assert values(vectors.vxm(e, v, "plus_times", "w"), "id", "val") == [(0, 6.0), (1, 2.0), (2, 4.0)]
    assert values(vectors.mxv(e, v, "min_plus", "w"), "id", "val") == [(0, 4.0), (1, 4.0)]
    assert values(vectors.fill(v, spark.range(3), 0.0), "id", "val") == [(0, 1.0), (1, 2.0), (2, 0.0)]
    ids = [0, 1, 2, 32768, 32769, 100_000, 7]
    assert values(sets.bitmap_members(sets.bitmap(sets.of(spark, ids))), "id") == [(i,) for i in sorted(ids)]
    assert values(walk.walk_back(e, sets.of(spark, [0, 2]), sets.of(spark, [1])), "id") == [(1,)]
    assert values(maintenance.diff_edges(e, edges(spark, [(0, 1), (5, 5)], [2, 1])), "src", "tgt", "change") == [(0, 2, "removed"), (1, 0, "removed"), (5, 5, "added")]
    order = maintenance.cuthill_mckee(edges(spark, [(0, 3), (3, 0), (0, 3), (1, 2)]), spark.range(5))
    assert sorted(r.new_id for r in order.collect()) == list(range(5))
    assert sampling.sample_neighbours(generate.star(spark, 50), sets.of(spark, [0]), [7]).count() == 7
    w = sampling.random_walks(e, sets.of(spark, [0, 2]), 4)
    assert w.count() == 10 and w.filter("walker = 2 and id <> 2").isEmpty()


def test_vector_language(spark):
    from propgraph.plans.script import Script

    g = PropertyGraph(spark).add_domain("v", spark.range(4)).add_relation("r", "v", "v", edges(spark, [(0, 1), (1, 2), (0, 2)], [5, 1, 9]))
    text = """
/ shortest distances
fn far(g, start) {
    d: vector(0, INF)
    d[bitset start]: 0
    old: vector(0, 0)
    until[(sum abs(change)) == 0] {
        old: d
        d: min(d, g @[d; min+])     / relax all edges
        change: (old > d) | (d > old) ? vector(0, 1.0) : vector(0, 0)
    }
    return d
}
fn two(g) { return 1 + 2 * 3 > 6 ? "yes" : "no" }
"""
    s = Script(g, "r", text, "w")
    assert values(s.run("far", 0), "id", "val") == [(0, 0.0), (1, 5.0), (2, 6.0), (3, float("inf"))]
    assert s.run("two") == "yes"
    with pytest.raises(NameError):
        Script(g, "r", "fn f(g) { return nothing }").run("f")


def test_communities_and_isomorphism_take_every_order(spark, small, monkeypatch):
    orders = dict(spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey").collect())
    whole = {tuple(sorted((c, orders[k + 1]))) for k, c in orders.items() if k + 1 in orders and c != orders[k + 1]}
    ids = [r.c_custkey for r in spark.read.parquet(f"{small}/customer.parquet").select("c_custkey").collect()]
    near = {i: [b if a == i else a for a, b in whole if i in (a, b)] for i in ids}
    def draw(*values):
        out = 12345
        for k, v in enumerate(values):
            out = ((out + v % sampling.MODULUS) * sampling.FACTORS[k % 3] + 11) % sampling.MODULUS
        return out

    parity = {i: [draw(j, i) % 2 for j in range(4)] for i in ids}
    label = {i: i for i in ids}
    for k in range(8):
        tot, after = {}, dict(label)
        for i in ids:
            tot[label[i]] = tot.get(label[i], 0) + len(near[i])
        for i in ids:
            mine, deg = [label[j] for j in near[i]], len(near[i])
            scores = [(round(mine.count(c) - deg * (tot[c] - (deg if c == label[i] else 0)) / (2 * len(whole)), 9), -c) for c in set(mine)]
            if scores and (parity[i][k // 2] + k) % 2 and max(scores)[0] > 0:
                after[i] = -max(scores)[1]
        label = after
    from propgraph import catalog

    assert dict(values(catalog.queries()["louvain"](spark, small), "id", "label")) == label
    seen = []
    decide = structure.may_be_isomorphic
    monkeypatch.setattr(structure, "may_be_isomorphic", lambda a, b: (seen.extend((a[0], b[0])), decide(a, b))[1])
    assert values(catalog.queries()["graph_isomorphism"](spark, small), "other", "same") == [("one edge bent", False), ("renamed", True)]
    assert set(values(seen[0], "src", "tgt")) == whole and seen[1].count() == seen[3].count() == len(whole)


def test_isomorphism_beyond_three_hops_and_of_small_regular_graphs(spark):
    def graph(*walks):
        pairs = [(a, b) for w in walks for x, y in zip(w, w[1:]) for a, b in ((x, y), (y, x))]
        return edges(spark, pairs), spark.createDataFrame([(i,) for i in sorted({i for p in pairs for i in p})], "id long")

    def same(a, b):
        return structure.may_be_isomorphic(a, b).head()[0]

    path = lambda start, n: list(range(start, start + n))
    ring = lambda start, n: [*range(start, start + n), start]
    assert not same(graph(path(0, 10), path(100, 20)), graph(path(0, 14), path(100, 16)))  # refinement of three rounds sees no difference
    assert not same(graph(ring(0, 3), ring(10, 3)), graph(ring(0, 6)))  # no refinement does
    assert same(graph(ring(0, 3), ring(10, 4)), graph(ring(50, 4), ring(70, 3)))
    assert structure.refined_colours(*graph(path(0, 20))).select("colour").distinct().count() == 10
    assert not same(graph(path(0, 20), path(100, 40)), graph(path(0, 22), path(100, 38)))  # more nodes than are searched


def test_loops_that_run_out_of_rounds_raise(spark):
    chain = edges(spark, [(k, k + 1) for k in range(6)])
    with pytest.raises(RuntimeError, match="steps"):
        traversal.bfs(chain, spark.range(7), sets.of(spark, [0]), max_depth=3)
    with pytest.raises(RuntimeError, match="rounds"):
        traversal.topological_layers(chain, spark.range(7), max_rounds=3)
    with pytest.raises(RuntimeError, match="rounds"):
        structure.core_numbers(chain, spark.range(7), max_rounds=1)
    with pytest.raises(RuntimeError, match="rounds"):
        datalog.run(spark, "p(X, Y) :- e(X, Y).\np(X, Z) :- p(X, Y), e(Y, Z).", {"e": chain}, "p", max_rounds=2)
    assert traversal.bfs(chain, spark.range(7), sets.of(spark, [0]), max_depth=7).agg(F.max("level")).head()[0] == 6


def test_tiny_improvements_beside_huge_distances(spark):
    """Node 6 is reached late by a way that is shorter by less than the last digit of the sum of all distances."""
    pairs = [(0, 1), (0, 2), (0, 3), (3, 4), (4, 5), (0, 6), (5, 6), (1, 2)]
    weight = [1e17, 1e17, 0.5, 0.5, 0.5, 3.25, 1.0, 1.0]
    e = edges(spark, pairs, weight)
    want = values(traversal.sssp(e, sets.of(spark, [0])), "id", "dist")
    assert dict(want)[6] == 2.5
    for delta in (1e18, 1.0, 0.25):
        assert values(traversal.delta_stepping(e, sets.of(spark, [0]), delta), "id", "dist") == want


def _staged_rounds(spark, tag):
    import os

    from propgraph.plans.staging import shared_dir

    return {n for n in os.listdir(shared_dir(spark).removeprefix("file://")) if n.startswith(tag)}


def _odd_graph(spark):
    """A random graph with parallel edges and loops, a path of 12 and a cycle that leads nowhere else; ids far apart."""
    pairs = [(r.src * 10**12 - 5, r.tgt * 10**12 - 5) for r in generate.erdos_renyi(spark, 40, 120).collect()]
    pairs += pairs[:10] + [(pairs[0][0], pairs[0][0])] + [(k, k + 1) for k in range(1000, 1012)] + [(1, 2), (2, 1)]
    return edges(spark, pairs), spark.createDataFrame([(k,) for k in sorted({x for p in pairs for x in p} | {77})], "id long")


def test_path_counts_without_rounds_equal_those_by_rounds(spark):
    e, n = _odd_graph(spark)
    by_rounds = values(traversal.shortest_path_counts(e, n, local_edges=0), "s", "id", "level", "sigma")
    assert _staged_rounds(spark, "paths") and (77, 77, 0, 1.0) in by_rounds and (1000, 1012, 12, 1.0) in by_rounds
    before = _staged_rounds(spark, "paths")
    assert values(traversal.shortest_path_counts(e, n), "s", "id", "level", "sigma") == by_rounds
    assert _staged_rounds(spark, "paths") == before


def test_betweenness_without_rounds_equals_that_by_rounds(spark):
    e, n = _odd_graph(spark)
    by_rounds = values(traversal.betweenness(e, n, n, local_edges=0).select("id", F.round("val", 6).alias("val")), "id", "val")
    before = _staged_rounds(spark, "between") | _staged_rounds(spark, "paths")
    assert dict(by_rounds)[1006] == 6 * 6 and dict(by_rounds)[77] == 0
    assert values(traversal.betweenness(e, n, n).select("id", F.round("val", 6).alias("val")), "id", "val") == by_rounds
    assert _staged_rounds(spark, "between") | _staged_rounds(spark, "paths") == before


def test_closure_without_rounds_equals_that_by_rounds(spark):
    e, _ = _odd_graph(spark)
    one, other = e.filter("src % 2 = 0"), e.filter("src % 2 <> 0").union(edges(spark, [(3000, 3001), (None, 2)]))
    rules = "leads(X, Y) :- asked(X), one(X, Y).\nleads(X, Y) :- asked(X), other(X, Y).\nleads(X, Z) :- leads(X, Y), one(Y, Z).\nleads(A, C) :- other(B, C), leads(A, B)."
    facts = {"one": one, "other": other, "asked": e.select("src").union(edges(spark, [(3000, 0)]).select("src"))}
    key = lambda df: sorted(map(str, df.collect()))
    by_rounds = key(datalog.run(spark, rules, facts, "leads", local_edges=0))
    before = _staged_rounds(spark, "datalog")
    assert key(datalog.run(spark, rules, facts, "leads")) == by_rounds and len(by_rounds) > 64
    assert len(_staged_rounds(spark, "datalog") - before) == 1


def test_histogram_cuts_at_exact_percentiles(spark):
    """5000 values with repeats, of which percentiles of accuracy 50 are off by up to a hundred ranks."""
    import math

    v = sorted(float(k * k % 4999 // 3) for k in range(5000))
    e = spark.createDataFrame([(k, k, x) for k, x in enumerate(v)] + [(0, 0, None), (0, 0, math.nan)], "src long, tgt long, v double")
    cuts = [v[5000 - math.floor(5000 - 5000 * (i / 20)) - 1] for i in range(1, 20)]
    want = {}
    for x in v:
        low, _, n = want.get(b := sum(x > c for c in cuts), (x, x, 0))
        want[b] = (low, x, n + 1)
    for accuracy in (50, 3):
        assert {r.bucket: (r.low, r.high, r.n) for r in statistics.equi_depth(e, "v", accuracy=accuracy).collect()} == want
    assert {r.nulls for r in statistics.equi_depth(e, "v").collect()} == {2}
    assert statistics.equi_depth(e.filter("v < 0"), "v").count() == 0
    assert [r.n for r in statistics.equi_depth(e.filter("src = 7"), "v").collect()] == [1]


def test_edges_are_looked_at_some_at_a_time(spark, monkeypatch):
    from propgraph.operators import sweeps

    graph = sweeps.packed(edges(spark, [(5, 7), (5, 9), (7, 9), (9, 5), (9, 7)]))
    assert graph.ids.tolist() == [5, 7, 9] and graph.at(graph.ids[:1] + 1).tolist() == [-1]
    assert sweeps.packed(edges(spark, [(5, 7), (5, 9)]), 1) is None and sweeps.packed(edges(spark, [(5, 7), (7, None)])) is None
    for chunk in (1, 2, 3, 100):
        monkeypatch.setattr(sweeps, "CHUNK", chunk)
        level, sigma, fronts, _ = sweeps._swept(graph, graph.at(graph.ids), True)
        assert level.tolist() == [0, 1, 1, 2, 0, 1, 1, 1, 0] and sigma.tolist() == [1.0] * 9 and len(fronts) == 3


def test_all_combinations_only_when_asked(spark):
    facts = {"a": spark.range(3), "b": spark.range(4)}
    with pytest.raises(ValueError, match="share no variable"):
        datalog.run(spark, "p(X, Y) :- a(X), b(Y).", facts, "p")
    assert datalog.run(spark, "p(X, Y) :- a(X), b(Y).", facts, "p", combinations=True).count() == 12


def test_sampled_components(spark):
    from propgraph.operators.components import afforest

    pairs = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (3, 150), (1000, 1050)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    want = values(connected_components(df), "id", "component")
    assert values(afforest(df), "id", "component") == want == values(afforest(df, 3), "id", "component")
    assert afforest(df.filter("src < 0")).count() == 0


def test_rounds_leave_little_behind_and_edges_stay(spark):
    import os

    from propgraph.plans.staging import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    ring = edges(spark, [(k, (k + 1) % 20) for k in range(20)], [1] * 20)
    traversal.sssp(ring, sets.of(spark, [0])).count()
    assert len([n for n in set(os.listdir(folder)) - before if n.startswith("sssp")]) <= 2
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ranking.pagerank(ring, spark.range(20), rounds=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # an edge scan is sorted by its bucket and goes into the join without an exchange
    lines = plan.splitlines()
    for k, line in enumerate(lines):
        if "share#" in line and "FileScan" in line:
            assert not any("Exchange" in x for x in lines[max(0, k - 4) : k]), plan


def test_frames_indirection_and_probes(spark):
    g = PropertyGraph(spark).add_domain("v", spark.range(5)).add_relation("follows", "v", "v", edges(spark, [(0, 1)]))
    run = lambda text: program.Machine(g).run(text, 0)
    assert run("OP_LOAD_CONST_INT R1, 5\nOP_ENTER_FRAME\nOP_LOAD_CONST_INT R1, 9\nOP_MOV R63, R1\nOP_LEAVE_FRAME\nOP_LOAD_INDIRECT R63, R2\nOP_HALT".replace("OP_ENTER", "OP_LOAD_CONST_INT R2, 1\nOP_ENTER")) == 5
    assert run("OP_LOAD_CONST_INT R1, 5\nOP_ENTER_FRAME\nOP_LOAD_CONST_INT R1, 9\nOP_MOV R63, R1\nOP_LEAVE_FRAME\nOP_HALT") == 9
    with pytest.raises(RuntimeError, match="without"):
        run("OP_LEAVE_FRAME")
    assert [run(f"OP_{p} R63, {r}\nOP_HALT") for p, r in (("HAS_CSR", "follows"), ("HAS_CSR", "other"), ("HAS_DENSE", "follows"), ("HAS_KEY_CATALOG", "v"))] == [1, 0, 0, 0]


def test_saved_graphs_are_checked(spark, tmp_path):
    path = str(tmp_path / "g")
    g = PropertyGraph(spark).add_domain("v", spark.range(50)).add_relation("follows", "v", "v", edges(spark, [(k, (7 * k) % 50) for k in range(50)], [1] * 50))
    g.save(path)
    assert maintenance.validate_saved(spark, path).count() == 0
    edges(spark, [(5, 1), (3, 2), (9, 99)]).coalesce(1).write.mode("overwrite").parquet(f"{path}/relations/follows")
    assert values(maintenance.validate_saved(spark, path), "relation", "check", "violations") == [("follows", "edge count", 47), ("follows", "missing attributes", 1), ("follows", "out of order", 1), ("follows", "tgt out of range", 1)]


def test_command_line(spark, tmp_path, capsys):
    from propgraph.__main__ import main

    (tmp_path / "members.tsv").write_text("alice eng\nbob eng\nbob ops\n")
    (tmp_path / "m.json").write_text(json.dumps({"domains": [{"id": 0, "name": "User", "key_type": "string"}, {"id": 1, "name": "Group", "key_type": "string"}], "relations": [{"name": "in", "src_domain": 0, "tgt_domain": 1, "file": "members.tsv"}]}))
    graph = str(tmp_path / "g")
    assert main(["build", str(tmp_path / "m.json"), graph], spark) == 0
    main(["inspect", graph, "--json"], spark)
    assert {r["relation"]: r["edge_count"] for r in json.loads(capsys.readouterr().out)["relations"]} == {"in": 3}
    assert main(["validate", graph], spark) == 0 and main(["diff", graph, graph], spark) == 0
    capsys.readouterr()
    (tmp_path / "q.dl").write_text("mates(X, Y) :- in(X, G), in(Y, G).")
    main(["run", graph, str(tmp_path / "q.dl"), "--arguments", '{"goal": "mates"}'], spark)
    assert len(capsys.readouterr().out.splitlines()) == 4
    main(["compile", str(tmp_path / "q.dl")], spark)
    assert "mates" in capsys.readouterr().out
    main(["generate", "star", str(tmp_path / "star"), "--options", '{"nodes": 5}'], spark)
    assert spark.read.csv(str(tmp_path / "star"), sep="\t", header=True).count() == 4
    main(["stats", graph, "in"], spark)
    assert '"edge_count": 3' in capsys.readouterr().out
    (tmp_path / "q.unknown").write_text("")
    with pytest.raises(ValueError, match="no language"):
        main(["compile", str(tmp_path / "q.unknown")], spark)


def test_records_of_programs():
    text = """.relation "follows" = 3
    .domain "user" = 1
    OP_INIT_INPUT_NODE R1, 7
    again: OP_CSR_WALK R2, R1, follows
    OP_MXV R5, R2, REL_3, SEMIRING_MIN_PLUS
    OP_EWISE_MULT R6, R5, R5
    OP_CSC_WALK R7, R2, REL_3
    OP_CSC_WALK R8, R2, R9, REL_3
    OP_NODE_FILTER R9, R2, DOMAIN_1, "id < 3, or 9"
    OP_LOAD_INLINE_ARRAY R10, 4, 5, 6
    OP_SET_UNION R1, R1, R2, ACCUMULATE, INVERT
    OP_JNZ R2, again
    OP_COLLECT_BITSET R63, R1
    OP_HALT"""
    made = records.encode(program.assemble(text))
    assert len(made.code) == 8 * 12 and made.constants == ['"id < 3, or 9"', "4, 5, 6"]
    assert made.code[:16] == struct.pack("<BBHI", 2, 0, 1, 7) + struct.pack("<BBHI", 0x10, 0, 2, 1 | 3 << 16)
    assert made.code[16:24] == struct.pack("<BBHI", 0x41, 0, 5, 2 | 3 << 8 | 1 << 16)
    assert made.code[32:48] == struct.pack("<BBHI", 0x18, 0, 7, 2 | 63 << 16 | 3 << 24) + struct.pack("<BBHI", 0x18, 0, 8, 2 | 9 << 16 | 3 << 24)
    assert made.code[64:72] == struct.pack("<BBHI", 0x30, 6, 1, 1 | 2 << 16) and made.code[72:80] == struct.pack("<BBHi", 0x52, 0, 2, -8)
    back = records.decode(made)
    assert records.encode(back) == made and records.encode(program.assemble(program.disassemble(back))) == made
    named = program.assemble("OP_SET_UNION flags=FLAG_INVERT | ACCUMULATE, dst=R1, payload=R1 | R2").instructions[0]
    assert (named.args, named.flags) == (["R1", "R1", "R2"], {"INVERT", "ACCUMULATE"})
    assert set(records.SHAPE) == set(records.OPCODES)
    for wrong in ("OP_CSR_WALK R64, R0, REL_0", "OP_CSR_WALK R1, R0, nowhere", "OP_CSR_WALK R1, R0", "OP_NONSENSE R1", "OP_CSR_WALK R1, R0, REL_70000"):
        with pytest.raises(ValueError):
            records.encode(program.assemble(wrong))
    for code in (b"\xff" + bytes(7), bytes(7)):
        with pytest.raises(ValueError):
            records.decode(records.Records(code))


def test_signatures(spark, tmp_path):
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")  # first vector of RFC 8032
    public = signatures.public_key(secret)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signed = signatures.sign(secret, b"")
    assert signed.hex() == "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"
    assert signatures.verify(public, b"", signed) and not signatures.verify(public, b"x", signed) and not signatures.verify(public, b"", signed[:-1])
    assert not signatures.verify(public, b"", signed[:32] + (int.from_bytes(signed[32:], "little") + signatures.ORDER).to_bytes(32, "little"))
    signatures.write_keys(str(tmp_path / "key"))
    secret, public = (bytes.fromhex((tmp_path / f"key.{e}").read_text()) for e in ("priv", "pub"))
    assert (tmp_path / "key.priv").stat().st_mode & 0o77 == 0
    g = PropertyGraph(spark)
    g.add_domain("user", spark.range(4))
    g.add_relation("follows", "user", "user", edges(spark, CLIQUE))
    path = str(tmp_path / "graph")
    g.save(path)
    signatures.sign_graph(spark, path, secret)
    assert signatures.verify_graph(spark, path, public)
    edges(spark, UP).write.mode("overwrite").parquet(f"{path}/relations/follows")
    assert not signatures.verify_graph(spark, path, public)
