"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by membership pattern (the set of sources that a document belongs to).
Tokens flow from patterns to source quotas; the first copy of a pattern's tokens is free, the
second costs one, the third two and so on, so repetition is spread evenly. The flow network has a
node for each pattern and source, never for a document, and is solved on the driver. A pattern's
flow is turned into whole copies of all its documents and, for the remainder, one more copy of
documents in the order of a seeded hash. The order is cut with a histogram of hash buckets, so only
documents of the bucket where the quota ends are sorted; at last the document that closes the rest
of the gap best is added or given back, a few times over.

Defined cases. Null text has no words; documents without words get the whole copies and no more.
A null source is a source of its own, the last. Rows that repeat are documents of their own, but
are taken together. Texts of any length count with all their words. An empty table gives
an empty result. Columns with clashing names do no harm, as rows are carried in a struct.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propgraph.operators.joins import row_hash
from propgraph.plans.staging import staged

#: Buckets of the seeded hash in which the boundary of a quota is sought.
BUCKETS = 4096
#: Documents of a pattern that are added or given back to close the gap, at most.
CLOSING = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_shares(sizes: dict, weights: dict, total: float, max_repeat: int) -> dict:
    """Splits ``total`` by weight; shares stop at ``max_repeat`` sizes and the excess is split again."""
    targets, free, left = {}, set(sizes), float(total)
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / weight > max_repeat * sizes[s]} if weight else set()
        if not over:
            targets |= {s: left * weights[s] / weight if weight else 0.0 for s in free}
            break
        targets |= {s: float(max_repeat * sizes[s]) for s in over}
        left -= sum(max_repeat * sizes[s] for s in over)
        free -= over
    return targets


def min_cost_flow(patterns: dict, quotas: dict, max_repeat: int) -> dict:
    """Words sent from each pattern to each of its sources: {(pattern, source): words}.

    ``patterns`` maps a pattern (tuple of sources) to its words. Successive shortest paths; no edge
    has a negative cost, as words that a source gives back cost what they did; copy ``c`` of a pattern costs ``c`` per word. A path enters at a source with quota
    left, and may reroute words of patterns that other sources share.
    """
    flow: dict = {}
    sent = dict.fromkeys(patterns, 0)
    members: dict = {s: [p for p in patterns if s in p and patterns[p]] for s in quotas}
    for source, quota in quotas.items():
        need = int(quota)
        while need > 0:
            # shortest way from the source to spare words: source -> pattern -> (source that gives words back) -> ...
            best, heap, came = {("s", source): 0}, [(0, 0, ("s", source))], {}
            goal, tick = None, 0
            while heap:
                cost, _, node = heapq.heappop(heap)
                if cost > best.get(node, 1 << 60):
                    continue
                kind, key = node
                if kind == "end":
                    goal = key
                    break
                steps = []
                if kind == "s":
                    steps = [(("p", p), 0) for p in members[key]]
                else:
                    if sent[key] < max_repeat * patterns[key]:
                        steps.append((("end", key), sent[key] // patterns[key]))
                    steps += [(("s", s), 0) for s in key if flow.get((key, s), 0) > 0]
                for to, more in steps:
                    if cost + more < best.get(to, 1 << 60):
                        best[to], came[to] = cost + more, node
                        tick += 1
                        heapq.heappush(heap, (cost + more, tick, to))
            if goal is None:
                break
            path, node = [("p", goal)], came[("end", goal)]
            while node != ("s", source):
                node = came[node]
                path.append(node)
            copy = sent[goal] // patterns[goal]
            amount = min(need, (copy + 1) * patterns[goal] - sent[goal])
            for a, b in zip(path, path[1:], strict=False):  # a pattern takes words back from the source before it on the path
                if a[0] == "s":
                    amount = min(amount, flow[(b[1], a[1])])
            for a, b in zip(path, path[1:], strict=False):
                if a[0] == "p":
                    flow[(a[1], b[1])] = flow.get((a[1], b[1]), 0) + amount
                else:
                    flow[(b[1], a[1])] -= amount
            sent[goal] += amount
            need -= amount
    return {k: v for k, v in flow.items() if v}


@dataclass
class Mix:
    """``documents``: ``row`` (the input row), id, size, pattern, copies; ``sources``: a dict of size, target and flow."""

    documents: DataFrame
    sources: dict
    patterns: list


def mix(docs: DataFrame, sources: Column, weigh, max_repeat: int = 3, total_share: float = 1.0, seed: int = 17, id_column: str = "doc_id", text_column: str = "text", carry: bool = True) -> Mix:
    """Copies of each document so that each source comes near its target.

    ``sources`` is an array column: the sources of a document. ``weigh`` gives the weights of the
    list of all sources, in code point order with null last. The targets share ``total_share`` of
    all words and stop at ``max_repeat`` times a source's size. The driver gets one row for each
    pattern; a pattern is a combination of sources, so their number follows how sources are
    arranged and not how many documents there are.
    """
    spark = docs.sparkSession
    row = F.struct(*[docs[c] for c in docs.columns]) if carry else F.lit(None).cast("int")
    known = docs.select(
        row.alias("row"), docs[id_column].cast("long").alias("id"), word_count(docs[text_column]).alias("size"),
        F.to_json(F.array_sort(F.array_distinct(sources)), {"ignoreNullFields": "false"}).alias("pattern"), F.array_sort(F.array_distinct(sources)).alias("members"),
    ).withColumn("h", row_hash("id", "size", seed=seed))
    narrow = staged(known.select("id", "size", "pattern", "members", "h"), "mix")
    found = narrow.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    names = {tuple(r.members): r for r in found}
    every = sorted({s for p in names for s in p}, key=lambda s: (s is None, s or ""))
    weights = dict(zip(every, weigh(every), strict=True))
    sizes = {s: sum(r.words for p, r in names.items() if s in p) for s in every}
    targets = capped_shares(sizes, weights, total_share * sum(r.words for r in found), max_repeat)
    flow = min_cost_flow({p: r.words for p, r in names.items()}, {s: round(t) for s, t in targets.items()}, max_repeat)
    plan = []
    for p, r in names.items():
        words = sum(v for (q, _), v in flow.items() if q == p)
        full, rest = divmod(words, r.words) if r.words else (0, 0)
        plan.append((r.pattern, int(full), int(rest), r.n))
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("full", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("n", T.LongType())])
    plans = spark.createDataFrame(plan, schema)
    info = {s: {"size": sizes[s], "target": targets[s], "flow": sum(v for (_, t), v in flow.items() if t == s)} for s in every}
    return Mix(_choose(known if carry else narrow, narrow, plans), info, found)


def _choose(known: DataFrame, narrow: DataFrame, plans: DataFrame) -> DataFrame:
    """``known`` with the number of copies that the plan of its pattern gives it."""
    bucket = F.pmod(F.shiftrightunsigned("h", 40), F.lit(BUCKETS)).cast("int")
    # rows of equal hash and id are taken together
    peers = staged(narrow.filter("size > 0").groupBy("pattern", "h", "id").agg(F.sum("size").alias("size")), "mix-peers")
    hist = peers.groupBy("pattern", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    below = F.coalesce(F.sum("words").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hist = hist.withColumn("below", below).join(plans.filter("rest > 0"), "pattern")
    cut = staged(hist.filter("below <= rest and below + words > rest").select("pattern", F.col("bucket").alias("cut"), "below", "rest"), "mix-cut")
    edge = peers.withColumn("bucket", bucket).join(cut, "pattern").filter("bucket = cut")
    order = Window.partitionBy("pattern").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.col("below") + F.sum("size").over(order))
    # the last (hash, id) that still fits, and the words up to it
    last = edge.filter("upto <= rest").groupBy("pattern").agg(F.max(F.struct("h", "id")).alias("last"), F.max("upto").alias("upto"))
    none = F.expr("cast(array() AS array<struct<h:bigint,id:bigint>>)")
    state = cut.join(last, "pattern", "left").select(
        "pattern", "cut", F.col("last.h").alias("last_h"), F.col("last.id").alias("last_id"), (F.col("rest") - F.coalesce("upto", "below")).alias("gap"), none.alias("turned")
    )
    state = staged(state, "mix-cut")
    inside = _inside(bucket)
    chosen = inside != F.array_contains("turned", F.struct("h", "id"))
    for _ in range(CLOSING):
        change = F.when(chosen, -F.col("size")).otherwise(F.col("size"))
        off = F.abs(F.col("gap") - F.col("change"))
        closer = peers.join(state, "pattern").withColumn("change", change).filter(off < F.abs("gap"))
        best = closer.groupBy("pattern").agg(F.min(F.struct(off.alias("off"), "h", "id", "change")).alias("best"))
        more = F.when(F.col("best").isNull(), F.col("turned")).otherwise(F.array_append("turned", F.struct(F.col("best.h").alias("h"), F.col("best.id").alias("id"))))
        state = staged(state.join(best, "pattern", "left").select("pattern", "cut", "last_h", "last_id", (F.col("gap") - F.coalesce("best.change", F.lit(0))).alias("gap"), more.alias("turned")), "mix-cut")
    rules = staged(plans.join(state, "pattern", "left").select("pattern", "full", "cut", "last_h", "last_id", F.coalesce("turned", none).alias("turned")), "mix-rules")
    extra = ((F.col("size") > 0) & chosen).cast("long")
    return known.join(rules, "pattern", "left").withColumn("copies", F.col("full") + extra).drop("full", "cut", "last_h", "last_id", "turned")


def _inside(bucket: Column) -> Column:
    same = (F.col("h") < F.col("last_h")) | ((F.col("h") == F.col("last_h")) & (F.coalesce("id", F.lit(-1)) <= F.coalesce("last_id", F.lit(-1))))
    return F.coalesce((bucket < F.col("cut")) | ((bucket == F.col("cut")) & same), F.lit(False))


def one_two_three(names: list) -> list[int]:
    """Weights 1, 2, 3, repeating."""
    return [1 + k % 3 for k in range(len(names))]


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = mix(docs, F.array(F.col("source").cast("string")), one_two_three, carry=False)
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType())])
    info = spark.createDataFrame([(s, int(v["size"]), float(v["target"])) for s, v in done.sources.items()], schema)
    info = info.withColumn("pattern", F.to_json(F.array("source"), {"ignoreNullFields": "false"})).drop("source")
    found = done.documents.join(info, "pattern", "left")
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
