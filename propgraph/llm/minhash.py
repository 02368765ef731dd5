"""Near-duplicate detection: banded MinHash, sequential Bayesian pruning, exact verification.

Texts are lower-cased in A-Z and cut into words ``[^\\x20\\x09-\\x0D]+``; a document's set is its
distinct runs of five words, or its whole sequence if that is shorter. Documents are linked if
100 * intersection >= 75 * union, decided on full sets.

1. Documents with equal sets form classes; only one member of each goes on.
2. 40 bands of 5 minima propose candidates: a pair at the threshold shares no band with probability
   2e-5. Buckets are never expanded into pairs. First each member meets the bucket's smallest id.
3. Signature bytes are compared in batches of 25; a pair is dropped as soon as the posterior
   probability (uniform prior) that it reaches the threshold is below ``MISS``.
4. Survivors are verified on their full sets. Connected components join the links.
5. In a bucket whose members are now all in one component, nothing is left to find. In the others,
   every member outside the bucket's main component is compared by signature with every member of
   another component, in blocks of bounded size; only (member, other component) is passed on, the
   member from the smaller of the two. It is then verified on full sets against the other
   component's members, likest first and in blocks, until one is linked. So no link between
   components is lost, and no pairs are emitted but links.

Defined cases. Null and blank texts have an empty set and are linked with nothing. A row whose id is
null is linked with nothing, has no component and is kept. Rows that repeat share their class;
rows of one id with different texts count each with its own text, and links of either hold for the
id. Texts of any length have their whole sets; blocks are cut by the hashes that they hold, so only a single
text's set must fit into a task. Joins are of shuffled sides whatever their size, so the driver gathers only the heavy keys of the last. An empty table gives an empty result. Other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm.batches import each, released
from propgraph.llm.words import mix64, shingle_set
from propgraph.operators.components import connected_components
from propgraph.operators.joins import lookup, shuffled
from propgraph.plans.staging import staged

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
BATCH = 25
MISS = 1e-5
#: Members that meet in one block on either side, and hashes of full sets that a block holds, about.
BLOCK, BLOCK_HASHES = 512, 1 << 21
#: Where signatures alone meet, blocks grow beyond this many parts a side, up to so many members.
SPREAD, LARGE_BLOCK = 16, 4096
_SALT = mix64(np.arange(1, 2 * HASHES + 1, dtype=np.uint64)).astype(np.uint32)
_XOR, _MULTIPLY = _SALT[:HASHES, None], _SALT[HASHES:, None] | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``HASHES`` hash functions over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(best, ((x[None, i : i + 1024] ^ _XOR) * _MULTIPLY).min(axis=1), out=best)
    return best


def band_keys(minima: np.ndarray) -> np.ndarray:
    rows = minima.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for i in range(ROWS):
        key = mix64(key * np.uint64(0xA0761D6478BD642F) + rows[:, i])
    return key.view(np.int64)


def least_matches(percent: int = 75, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes compared, matches needed): with fewer, the posterior of reaching the threshold is below ``miss``.

    Matches of one byte are binomial with p = J + (1 - J) / 256; under a uniform prior on p the
    posterior P(p >= t | m of n) is P(Bin(n + 1, t) <= m).
    """
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                out.append((n, m))
                break
    return out


def survives(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two byte matrices stay after all batches."""
    left = np.arange(len(a))
    got = np.zeros(len(a), dtype=np.int32)
    done = 0
    for n, need in bounds:
        got[left] += (a[left, done:n] == b[left, done:n]).sum(axis=1, dtype=np.int32)
        left = left[got[left] >= need]
        done = n
        if not len(left):
            break
    return left


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), HASHES)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, sigs, bands = [], [], [], []
        for text in part.column("text").to_pylist():
            s = shingle_set(text)
            minima = signature(s) if len(s) else None
            n.append(len(s))
            digests.append(_digest(s) if len(s) else b"")
            sigs.append((minima & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
            bands.append(band_keys(minima) if len(s) else None)
        columns = [part.column("id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "sig", "bands"])

    return each(one, batches)


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in part.column("text").to_pylist()]
        columns = [part.column("id"), pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["id", "digest", "set"])

    return each(one, batches)


def _pruned(percent: int):
    bounds = least_matches(percent)

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.iloc[survives(_bytes(pdf["sig_a"]), _bytes(pdf["sig_b"]), bounds)][["a", "b"]]

    return released(prune)


def _by_block(one):
    """Applies ``one`` to the rows of each block (key, i, j), from rows sorted by block."""
    keys = ["key", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the rows of the last block, which may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf[keys].to_numpy()
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            found = []
            if held and (held[-1][keys].to_numpy()[-1] != values[0]).any():
                found.append(one(pd.concat(held)))
                held = []
            pieces = [pdf.iloc[s:e] for s, e in zip([0, *cuts], [*cuts, len(pdf)], strict=True)]
            for piece in pieces[:-1]:
                found.append(one(pd.concat([*held, piece]) if held else piece))
                held = []
            held.append(pieces[-1])
            if found := [f for f in found if f is not None]:
                yield pd.concat(found)
        if held and (out := one(pd.concat(held))) is not None:
            yield out

    return released(run)


def _crossing(percent: int):
    """(a, comp): a document, and a larger component that a signature in its block calls near."""
    bounds = least_matches(percent)

    def one(block: pd.DataFrame) -> pd.DataFrame | None:
        sig, ids, comp, n, weight = _bytes(block["sig"]), block["id"].to_numpy(), block["comp"].to_numpy(), block["n"].to_numpy(), block["weight"].to_numpy()
        probe = block["probe"].to_numpy()
        others = np.flatnonzero(~probe)
        found = set()
        for i in np.flatnonzero(probe):
            near = others[(comp[others] != comp[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            if len(near):
                for k in near[survives(np.broadcast_to(sig[i], (len(near), HASHES)), sig[near], bounds)]:
                    less = (weight[i], comp[i]) < (weight[k], comp[k])
                    found.add((ids[i], comp[k]) if less else (ids[k], comp[i]))
        return pd.DataFrame(sorted(found), columns=["a", "comp"]) if found else None

    return _by_block(one)


def _linking(percent: int):
    """(a, b): for each probe of a block the first of the block's other members, likest first, that it is linked with."""
    bounds = least_matches(percent)

    def one(block: pd.DataFrame) -> pd.DataFrame | None:
        sig, ids, n, sets = _bytes(block["sig"]), block["id"].to_numpy(), block["n"].to_numpy(), block["set"].to_list()
        probe = block["probe"].to_numpy()
        others = np.flatnonzero(~probe)
        links = []
        for i in np.flatnonzero(probe):
            near = others[100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i])]
            if not len(near):
                continue
            near = near[survives(np.broadcast_to(sig[i], (len(near), HASHES)), sig[near], bounds)]
            for k in near[np.argsort(-(sig[near] == sig[i]).sum(axis=1), kind="stable")]:
                shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * shared >= percent * (n[i] + n[k] - shared):
                    links.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
                    break
        return pd.DataFrame(links, columns=["a", "b"]) if links else None

    return _by_block(one)


def _sets(ids: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, set) of class representatives, from their texts."""
    wanted = shuffled(classes.select("id", "digest"), ids.select("id").distinct(), "id", "left_semi")
    read = shuffled(texts, wanted.select("id").distinct(), "id", "left_semi").mapInArrow(_full_sets, "id long, digest binary, set array<long>")
    return shuffled(read, wanted, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]).select("id", "set")


def _verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives that are linked, decided on their full sets."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    sets = staged(_sets(ends, texts, classes), "near-sets")
    both = shuffled(shuffled(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a"), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b").distinct()


def _blocks(others: DataFrame, probes: DataFrame, n_others: Column, n_probes: Column, columns: list[str]) -> DataFrame:
    """Rows (key, i, j, probe, id, columns) such that each probe of a key meets each other row in one
    block (i, j); ``n_others`` and ``n_probes`` say into how many parts they are cut. Sorted by block within partitions."""
    down, across = F.ceil(n_probes).cast("int"), F.ceil(n_others).cast("int")
    mine = F.pmod(F.xxhash64("id"), across.cast("long")).cast("int")
    theirs = F.pmod(F.xxhash64("id", F.lit(1)), down.cast("long")).cast("int")
    left = others.select("key", F.explode(F.sequence(F.lit(0), down - 1)).alias("i"), mine.alias("j"), F.col("_ask").alias("probe"), "id", *columns)
    right = probes.select("key", theirs.alias("i"), F.explode(F.sequence(F.lit(0), across - 1)).alias("j"), F.col("_ask").alias("probe"), "id", *columns)
    return left.unionByName(right).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _parts(members: Column) -> Column:
    """Parts of a side: small blocks while they are few, so that tasks are even; then larger ones, so
    that a member is copied ``members / LARGE_BLOCK`` times at most."""
    return F.greatest(F.least(members / BLOCK, F.lit(float(SPREAD))), members / LARGE_BLOCK)


def near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id reachable), kept."""
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    sketches = staged(texts.mapInArrow(_sketched, "id long, n long, digest binary, sig binary, bands array<long>"), "near-sketches")
    full = sketches.filter("n > 0 and id is not null")
    classes = full.groupBy("digest").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("docs"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = staged(classes, "near-classes")
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = staged(members.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-buckets")
    members = staged(shuffled(members, buckets, "key"), "near-members")
    slim = classes.select("id", "n", "sig")

    def ends(pairs: DataFrame) -> DataFrame:
        a = slim.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
        b = slim.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
        return shuffled(shuffled(pairs, a, "a"), b, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    pairs = members.filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    pairs = staged(ends(pairs).mapInPandas(_pruned(percent), "a long, b long").distinct(), "near-pairs")
    links = staged(_verified(pairs, texts, classes, percent), "near-links")
    joined = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    # buckets that still hold more than one component
    comps = shuffled(classes.select("id"), joined, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    comps = staged(shuffled(comps, comps.groupBy("comp").agg(F.count(F.lit(1)).alias("weight")), "comp"), "near-comps")
    where = shuffled(members, comps, "id").select("key", "id", "size", "comp", "weight")
    parts = where.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows"))
    mains = parts.groupBy("key").agg(F.max(F.struct("rows", "comp")).alias("m"), F.count(F.lit(1)).alias("parts"))
    mains = staged(mains.filter("parts > 1").select("key", F.col("m.comp").alias("main"), F.col("m.rows").alias("in_main")), "near-open")
    open_rows = shuffled(shuffled(where, mains, "key"), slim, "id")
    blocked = _blocks(
        open_rows.withColumn("_ask", F.lit(False)), open_rows.filter("comp <> main").withColumn("_ask", F.lit(True)),
        _parts(F.col("size")), _parts(F.col("size") - F.col("in_main")), ["comp", "weight", "n", "sig"],
    )
    near = staged(blocked.mapInPandas(_crossing(percent), "a long, comp long").distinct(), "near-components")
    sizes = slim.select(F.col("id").alias("a"), "n")
    asked = staged(shuffled(near, sizes, "a").groupBy("comp").agg(F.count(F.lit(1)).alias("asking"), F.sum("n").alias("asking_hashes")), "near-asked")
    held = shuffled(shuffled(comps, asked.select("comp"), "comp", "left_semi"), slim.select("id", "n"), "id").groupBy("comp").agg(F.sum("n").alias("hashes"))
    asked = shuffled(asked, held, "comp")
    inside = shuffled(shuffled(comps, asked, "comp"), slim, "id").withColumn("key", F.col("comp"))
    asking = shuffled(shuffled(near, asked, "comp"), comps.select("comp", "weight").distinct(), "comp").withColumnRenamed("a", "id")
    asking = shuffled(asking, slim, "id").withColumn("key", F.col("comp"))
    sets = staged(_sets(inside.select("id").unionByName(asking.select("id")), texts, classes), "near-sets")
    n_inside = F.greatest(F.col("weight") / BLOCK, F.col("hashes") / BLOCK_HASHES)
    n_asking = F.greatest(F.col("asking") / BLOCK, F.col("asking_hashes") / BLOCK_HASHES)
    blocked = _blocks(shuffled(inside, sets, "id").withColumn("_ask", F.lit(False)), shuffled(asking, sets, "id").withColumn("_ask", F.lit(True)), n_inside, n_asking, ["n", "sig", "set"])
    more = staged(blocked.mapInPandas(_linking(percent), "a long, b long").distinct(), "near-links")
    if not more.isEmpty():
        links = links.unionByName(more)
        joined = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    answer = shuffled(classes.select("digest", "docs", "id"), joined, "id", "left").select("digest", "docs", F.coalesce("component", "id").alias("component_id"))
    found = lookup(full.select("id", "n", "digest"), answer, "digest", "docs", full.count())
    alone = sketches.filter("n = 0 or id is null").select("id", "n", "digest", F.col("id").alias("component_id"), F.lit(1).alias("docs"))
    out = found.select("id", "n", "component_id").unionByName(alone.select("id", "n", "component_id"))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).withColumnRenamed("id", "doc_id")


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 75 * (nx.n + ny.n - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
