"""Structure of simple graphs: triangles, cores, trusses, similarity, trees, motifs, communities.

Simple edges are (src, tgt) with src < tgt, each once. Joins that enumerate two-paths orient edges
from the lower to the higher degree, so a hub never meets its own neighbours in pairs: the number of
two-paths is bounded by the number of edges to the power 1.5 and not by the square of a degree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from propgraph.operators.components import connected_components
from propgraph.operators.sampling import mixed
from propgraph.plans.rounds import Rounds
from propgraph.plans.staging import staged

#: Nodes up to which isomorphism is decided exactly, on the driver.
SMALL = 50


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "tgt").unionByName(edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))


def _oriented(edges: DataFrame) -> DataFrame:
    """(a, b): each edge from the end of lower (degree, id) to the other."""
    degrees = both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    both = edges.join(degrees.withColumnRenamed("deg", "ds"), "src").join(degrees.select(F.col("src").alias("tgt"), F.col("deg").alias("dt")), "tgt")
    forward = (F.col("ds") < F.col("dt")) | ((F.col("ds") == F.col("dt")) & (F.col("src") < F.col("tgt")))
    return both.select(F.when(forward, F.col("src")).otherwise(F.col("tgt")).alias("a"), F.when(forward, F.col("tgt")).otherwise(F.col("src")).alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z) with x < y < z, one row per triangle."""
    o = staged(_oriented(edges), "oriented")
    wedge = o.select("a", F.col("b").alias("p")).join(o.select("a", F.col("b").alias("q")), "a").filter("p < q")
    closed = wedge.join(edges.select(F.col("src").alias("p"), F.col("tgt").alias("q")), ["p", "q"])
    three = F.sort_array(F.array("a", "p", "q"))
    return closed.select(three[0].alias("x"), three[1].alias("y"), three[2].alias("z"))


def triangle_count(edges: DataFrame) -> DataFrame:
    return triangles(edges).agg(F.count(F.lit(1)).alias("triangles"))


def edge_support(edges: DataFrame) -> DataFrame:
    """(src, tgt, support): in how many triangles each edge lies."""
    t = triangles(edges)
    sides = t.select(F.explode(F.array(F.struct(F.col("x").alias("src"), F.col("y").alias("tgt")), F.struct(F.col("x").alias("src"), F.col("z").alias("tgt")), F.struct(F.col("y").alias("src"), F.col("z").alias("tgt")))).alias("e"))
    counts = sides.groupBy("e.src", "e.tgt").agg(F.count(F.lit(1)).alias("support"))
    return edges.select("src", "tgt").join(counts, ["src", "tgt"], "left").select("src", "tgt", F.coalesce("support", F.lit(0)).alias("support"))


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """(id): the largest set in which every node has at least ``k`` neighbours."""
    kept = Rounds("core", forget=True)
    now = kept.keep(both_ways(edges))
    size = now.count()
    while True:
        strong = now.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).filter(F.col("deg") >= k).select("src")
        now = kept.keep(now.join(strong, "src", "left_semi").join(strong.withColumnRenamed("src", "tgt"), "tgt", "left_semi").select("src", "tgt"))
        left = now.count()
        if left == size:
            return now.select(F.col("src").alias("id")).distinct()
        size = left


def core_numbers(edges: DataFrame, nodes: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(id, core): the largest k whose core holds the node, by repeated h-indices of the neighbours' values."""
    links = staged(both_ways(edges), "edges")
    kept = Rounds("cores", forget=True)
    state = kept.keep(links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core")))
    for _ in range(max_rounds):
        near = links.join(state.select(F.col("id").alias("tgt"), F.col("core").alias("v")), "tgt").groupBy("src", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("src").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0))
        h = near.select("src", F.least("v", upto).alias("h")).groupBy(F.col("src").alias("id")).agg(F.max("h").alias("h"))
        new = kept.keep(state.join(h, "id").select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")))
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"core numbers did not settle in {max_rounds} rounds")
    return nodes.select("id").join(state, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("long").alias("core"))


def k_truss(edges: DataFrame, k: int) -> DataFrame:
    """(src, tgt): the largest set of edges of which each lies in at least k - 2 triangles of the set."""
    kept = Rounds("truss", forget=True)
    now = kept.keep(edges.select("src", "tgt"))
    size = now.count()
    while True:
        now = kept.keep(edge_support(now).filter(F.col("support") >= k - 2).select("src", "tgt"))
        left = now.count()
        if left == size:
            return now
        size = left


def similarity(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b): shared neighbours, jaccard and cosine of the neighbour sets.

    Each pair brings the neighbours of its first end, which are looked up as edges of the second;
    nothing is enumerated beyond the asked pairs.
    """
    links = staged(both_ways(edges).distinct(), "edges")
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    pairs = pairs.select("a", "b").distinct()
    asked = pairs.join(degrees.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a", "left").join(degrees.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b", "left")
    asked = asked.select("a", "b", F.coalesce("da", F.lit(0)).alias("da"), F.coalesce("db", F.lit(0)).alias("db"))
    turned = asked.select("a", "b", F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")).alias("small"), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a")).alias("large"))
    near = turned.join(links.select(F.col("src").alias("small"), F.col("tgt").alias("m")), "small")
    shared = near.join(links.select(F.col("src").alias("large"), F.col("tgt").alias("m")), ["large", "m"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    out = asked.join(shared, ["a", "b"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    union, norm = F.col("da") + F.col("db") - F.col("shared"), F.sqrt("da") * F.sqrt("db")
    return out.select("a", "b", "shared", F.when(union > 0, F.col("shared") / union).otherwise(0.0).alias("jaccard"), F.when(norm > 0, F.col("shared") / norm).otherwise(0.0).alias("cosine"))


def motifs(edges: DataFrame) -> DataFrame:
    """(motif, n): connected three-node motifs, open wedges and triangles, without enumerating wedges."""
    degrees = both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    paths = degrees.agg(F.coalesce(F.sum(F.expr("deg * (deg - 1) div 2")), F.lit(0)).alias("paths"))
    both = paths.crossJoin(triangle_count(edges))  # one row each
    return both.select(F.explode(F.array(F.struct(F.lit("triangle").alias("motif"), F.col("triangles").alias("n")), F.struct(F.lit("wedge").alias("motif"), (F.col("paths") - 3 * F.col("triangles")).alias("n")))).alias("r")).select("r.motif", "r.n")


def two_paths(edges: DataFrame) -> DataFrame:
    """(n): directed two-paths, as the sum over middle nodes of entering times leaving edges."""
    into = edges.groupBy(F.col("tgt").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    return into.join(out, "id").agg(F.coalesce(F.sum(F.col("i") * F.col("o")), F.lit(0)).alias("n"))


def spanning_forest(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(src, tgt, w): Boruvka's minimum spanning forest; edges are ordered by (w, src, tgt), so no cycle arises."""
    simple = edges.filter("src <> tgt").groupBy(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).agg(F.min(weight).alias("w"))
    live = staged(simple.select("src", "tgt", "w", F.col("src").alias("cs"), F.col("tgt").alias("ct")), "mst")
    chosen: DataFrame | None = None
    while True:
        sides = live.select(F.col("cs").alias("c"), F.struct("w", "src", "tgt", "cs", "ct").alias("e")).unionByName(live.select(F.col("ct").alias("c"), F.struct("w", "src", "tgt", "cs", "ct").alias("e")))
        best = staged(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "mst")
        if best.isEmpty():
            break
        picked = best.select("src", "tgt", "w")
        chosen = picked if chosen is None else chosen.unionByName(picked)
        merged = connected_components(best.select(F.col("cs").alias("src"), F.col("ct").alias("dst")))
        live = live.join(merged.select(F.col("id").alias("cs"), F.col("component").alias("ns")), "cs").join(merged.select(F.col("id").alias("ct"), F.col("component").alias("nt")), "ct")
        live = staged(live.filter("ns <> nt").select("src", "tgt", "w", F.col("ns").alias("cs"), F.col("nt").alias("ct")), "mst")
    return simple.limit(0) if chosen is None else chosen


def islands(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, component): connected components of a node set, along edges with both ends in it."""
    inside = edges.join(members.select(F.col("id").alias("src")), "src", "left_semi").join(members.select(F.col("id").alias("tgt")), "tgt", "left_semi")
    found = connected_components(inside.select("src", F.col("tgt").alias("dst")))
    return members.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(modularity) of labels (id, label) over simple edges: sum over communities of inner share - (degree share)^2."""
    m = edges.agg(F.count(F.lit(1)).alias("m"))
    ends = edges.join(labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("id").alias("tgt"), F.col("label").alias("lt")), "tgt")
    inner = ends.filter("ls = lt").groupBy(F.col("ls").alias("label")).agg(F.count(F.lit(1)).alias("inner"))
    degree = ends.select(F.explode(F.array("ls", "lt")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("deg"))
    parts = degree.join(inner, "label", "left").crossJoin(F.broadcast(m))
    return parts.agg(F.sum(F.coalesce("inner", F.lit(0)) / F.col("m") - F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))


def louvain_level(edges: DataFrame, nodes: DataFrame, rounds: int = 8) -> DataFrame:
    """(id, label): one level of local moves. In each round half of the nodes, by parity of a hash,
    move to the neighbouring community with the largest gain of modularity; ties go to the least label."""
    links = staged(both_ways(edges), "edges")
    degrees = staged(links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("deg")), "degrees")
    total = float(max(1, links.count()))
    kept = Rounds("louvain", forget=True)
    state = kept.keep(nodes.select("id", F.col("id").alias("label")))
    for k in range(rounds):
        sums = state.join(degrees, "id").groupBy("label").agg(F.sum("deg").alias("tot"))
        near = links.join(state.select(F.col("id").alias("tgt"), "label"), "tgt").groupBy(F.col("src").alias("id"), "label").agg(F.count(F.lit(1)).alias("into"))
        own = state.select("id", F.col("label").alias("now"))
        gain = near.join(sums, "label").join(degrees, "id").join(own, "id")
        rest = F.col("tot") - F.when(F.col("label") == F.col("now"), F.col("deg")).otherwise(F.lit(0))
        score = F.round(F.col("into") - F.col("deg") * rest / total, 9)
        best = gain.groupBy("id").agg(F.max(F.struct(score.alias("score"), (-F.col("label")).alias("neg"))).alias("b"))
        stay = F.pmod(mixed(k // 2, F.col("id")) + k, F.lit(2)) == 0
        state = kept.keep(state.join(best, "id", "left").select("id", F.when(F.col("b").isNull() | stay | (F.col("b.score") <= 0), F.col("label")).otherwise(-F.col("b.neg")).alias("label")))
    return state


def _recoloured(links: DataFrame, state: DataFrame) -> DataFrame:
    """A round of refinement of (id, colour) along directed edges."""
    def heard(near: str, far: str, name: str) -> DataFrame:
        mixed = F.xxhash64("colour", F.lit(name)).cast("decimal(38,0)")  # an order-free sum that cannot overflow
        return links.join(state.withColumnRenamed("id", far), far).groupBy(F.col(near).alias("id")).agg(F.sum(mixed).alias(name))

    both = state.join(heard("src", "tgt", "out"), "id", "left").join(heard("tgt", "src", "into"), "id", "left")
    return both.select("id", F.xxhash64("colour", F.coalesce(F.col("out").cast("string"), F.lit("")), F.coalesce(F.col("into").cast("string"), F.lit(""))).alias("colour"))


def refined_colours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, colour): Weisfeiler-Lehman refinement of directed graphs until no colour splits; graphs with unequal colour counts are not isomorphic."""
    links = staged(edges.select("src", "tgt"), "edges")
    kept = Rounds("colours")
    state, before = kept.keep(nodes.select("id", F.lit(1).cast("long").alias("colour"))), 1
    while True:
        state = kept.keep(_recoloured(links, state))
        now = state.select("colour").distinct().count()
        if now <= before:  # fewer only without nodes
            return state
        before = now


def may_be_isomorphic(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(same): whether two directed graphs (edges, nodes) have equal counts of colours after Weisfeiler-Lehman
    refinement until no colour splits: a necessary condition. For at most ``SMALL`` nodes the answer is exact."""
    links = [staged(e.select("src", "tgt"), "edges") for e, _ in (a, b)]
    kept = Rounds("colours")
    states = [kept.keep(n.select("id", F.lit(1).cast("long").alias("colour"))) for _, n in (a, b)]
    before = [1, 1]
    while True:
        states = [kept.keep(_recoloured(e, state)) for e, state in zip(links, states, strict=True)]
        now = [state.select("colour").distinct().count() for state in states]
        if now[0] != now[1] or now <= before:
            break
        before = now
    counts = [state.groupBy("colour").agg(F.count(F.lit(1)).alias("n")) for state in states]
    odd = counts[0].select("colour", F.col("n").alias("x")).join(counts[1].select("colour", F.col("n").alias("y")), "colour", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y")))
    same = odd.agg((F.count(F.lit(1)) == 0).alias("same"))
    if max(state.limit(SMALL + 1).count() for state in states) > SMALL or not same.head()[0]:
        return same
    return same.select(F.lit(_isomorphic(*[(
        dict(state.collect()), {(r.src, r.tgt): r.n for r in e.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n")).join(state.select(F.col("id").alias("src")), "src", "left_semi").join(state.select(F.col("id").alias("tgt")), "tgt", "left_semi").collect()},
    ) for e, state in zip(links, states, strict=True)])).alias("same"))


def _isomorphic(a: tuple[dict, dict], b: tuple[dict, dict]) -> bool:
    """Whether a bijection of nodes keeps colours and edge counts, by search; both are (colour by id, count by edge)."""
    (colours, edges), (others, images) = a, b
    near = {i: {t if s == i else s for s, t in edges if i in (s, t)} for i in colours}
    order: list = []
    while len(order) < len(colours):  # next to placed nodes first, so that edges rule images out early
        order.append(max((i for i in colours if i not in order), key=lambda i: len(near[i].intersection(order))))
    placed: dict = {}

    def fits(i: int, j: int) -> bool:
        return edges.get((i, i), 0) == images.get((j, j), 0) and all(
            edges.get((i, k), 0) == images.get((j, m), 0) and edges.get((k, i), 0) == images.get((m, j), 0) for k, m in placed.items())

    def search(depth: int) -> bool:
        if depth == len(order):
            return True
        i = order[depth]
        for j, colour in others.items():
            if colour == colours[i] and j not in placed.values() and fits(i, j):
                placed[i] = j
                if search(depth + 1):
                    return True
                del placed[i]
        return False

    return len(colours) == len(others) and search(0)
