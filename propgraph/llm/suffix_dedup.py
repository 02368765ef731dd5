"""Repeated passages by sparse suffix arrays.

Of each document's suffixes only those are retained that start at minimisers: positions whose run of
``SEED`` words has the least hash among ``WINDOW`` successive ones. Each window of ``LEAST`` words
holds one minimiser, and it depends on the window's words only, so a window that two documents share
is retained at the same place in both. Suffixes whose seed one document only holds are dropped by a
count. The others are sorted by their seed and the words after it, neighbours are compared for their
longest common prefix, and matches are extended left, word by word, in the classes of suffixes that
the prefixes make. So every retained suffix learns, for each way to lay a window of ``LEAST`` words
over its seed, whether another document holds that window and whether one of smaller id does; there is
no limit to the neighbours that a suffix is compared with. A passage is the union of its windows.

All suffixes of one seed meet in one task, which is fit for seeds that occur up to ``FREQUENT`` times. Of
more frequent seeds, which a third of the corpus may hold, suffixes with equal words around the seed are
first folded into one shape, with partial sums, and shapes are sorted and compared. Only where even the
shapes of a seed number more than that are windows counted by a hash of their words. Results are the
same in all three ways.

Defined cases. Null and blank texts and texts of fewer than ``LEAST`` words repeat nothing. Words are
compared with A-Z in lower case and any white space between. Rows whose id is null are not
compared; rows of one id count as one document, so they do not repeat each other, and if their texts
differ each text has its own passages. Very long texts are cut into windows like any other. An empty
table gives an empty result. Other columns are not read.

Words beyond a seed are compared by 32 bits of their hashes, seeds by 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm.words import mix64, word_hashes
from propgraph.operators.joins import lookup
from propgraph.plans.staging import staged

#: Words of a repeated passage, of a suffix's seed, and seeds among which a minimiser is the least.
LEAST, SEED = 50, 32
WINDOW = LEAST - SEED + 1
#: Words on one side of a seed that a window can reach.
SIDE = LEAST - SEED
#: Occurrences of a seed above which its suffixes are folded, and shapes above which their windows are counted.
FREQUENT = 1024
#: Suffixes that are compared at once.
CHUNK = 100_000

_ROLL = np.uint64(0xD1342543DE82EF95)
_UNROLL = np.uint64(pow(int(_ROLL), -1, 1 << 64))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words at each position."""
    n = len(words)
    up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _ROLL, dtype=np.uint64))))
    down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, _UNROLL, dtype=np.uint64))))
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(words * up)))
    return mix64((prefix[length:] - prefix[:-length]) * down[: n - length + 1])


def minimisers(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, seeds, first and last start of the windows that each covers) of the retained suffixes."""
    if len(words) < LEAST:
        none = np.empty(0, dtype=np.int64)
        return none, np.empty(0, dtype=np.uint64), none, none
    h = run_hashes(words, SEED)
    at = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # positions never go back, so windows of one are in a row
    return at[first], h[at[first]], first, np.concatenate((first[1:], [len(at)])) - 1


def _retained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, parts, keys, spots = [], [], [], []
        for ident, part, text in zip(pdf["id"], pdf["part"], pdf["text"], strict=True):
            at, h, _, _ = minimisers(word_hashes(text)[0])
            ids.append(np.full(len(at), ident, dtype=np.int64))
            parts.append(np.full(len(at), part, dtype=np.int64))
            keys.append(h.view(np.int64))
            spots.append(at)
        if ids:
            yield pd.DataFrame({"key": np.concatenate(keys), "id": np.concatenate(ids), "part": np.concatenate(parts), "at": np.concatenate(spots).astype(np.int32)})


def _binary(matrix: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The first ``lengths`` words of each row as big-endian bytes, whose order is that of the words."""
    data = matrix.astype(">u4")[np.arange(SIDE) < lengths[:, None]].tobytes()
    offsets = np.concatenate(([0], np.cumsum(4 * lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column: pa.Array) -> np.ndarray:
    """The words of :func:`_binary`, 0 where there is none."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view(">u4")
    out = np.zeros((len(column), SIDE), dtype=np.uint32)
    out[np.arange(SIDE) < (np.diff(offsets) // 4)[:, None]] = data
    return out


_CONTEXT = "key long, id long, part long, at int, low int, high int, after binary, before binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (id, part, text, kept positions): the retained suffixes with the words around their seeds.

    A window starts ``low`` to ``high`` words before the seed; ``after`` and ``before`` (nearest
    word first) hold the words that those windows reach.
    """
    reach = np.arange(SIDE)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        key, ident, part, at, low, high, after, before = (np.concatenate(c) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(ident), pa.array(part), pa.array(at.astype(np.int32)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), _binary(after, SIDE - low), _binary(before, high)],
            names=["key", "id", "part", "at", "low", "high", "after", "before"],
        )

    for batch in batches:
        rows, size = [], 0
        for ident, part, text, kept in zip(*(batch.column(c).to_pylist() for c in ("id", "part", "text", "kept")), strict=True):
            words = word_hashes(text)[0]
            at, h, first, last = minimisers(words)
            mine = np.isin(at, kept)
            at, h, low, high = at[mine], h[mine], (at - last)[mine], (at - first)[mine]
            if not len(at):
                continue
            short = np.maximum((words >> np.uint64(32)).astype(np.uint32), 1)
            after = short[np.minimum(at[:, None] + SEED + reach, len(words) - 1)]
            before = short[np.maximum(at[:, None] - 1 - reach, 0)]
            rows.append((h.view(np.int64), np.full(len(at), ident, dtype=np.int64), np.full(len(at), part, dtype=np.int64), at, low, high, after, before))
            size += len(at)
            if size >= CHUNK:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)


def _shared(rows: pa.Table, first: str, last: str) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes sorted by (key, after): bit k of ``held`` says that another document holds the window that starts
    k words before the seed, bit k of ``cut`` that a smaller id does. A suffix stands for ids from column ``first`` to ``last``."""
    column = {c: rows.column(c).combine_chunks() for c in {"key", "low", "high", "after", "before", first, last}}
    key, low, high, small, large = (column[c].to_numpy() for c in ("key", "low", "high", first, last))
    after, before = _matrix(column["after"]), _matrix(column["before"])
    # longest common prefix of neighbours, in words after the seed; -1 where the seed differs
    differs = after[1:] != after[:-1]
    prefix = np.where(differs.any(axis=1), differs.argmax(axis=1), SIDE)
    prefix = np.concatenate(([-1], np.where(key[1:] == key[:-1], prefix, -1)))
    held, cut = np.zeros(len(key), dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    left = np.zeros(len(key), dtype=np.uint64)  # hash of the words that the match is extended by to the left
    for reach in range(SIDE + 1):
        if reach:
            left = mix64(left * _ROLL + before[:, reach - 1])
        here = np.flatnonzero((low <= reach) & (reach <= high))
        if not len(here):
            continue
        run = np.cumsum(prefix < SIDE - reach).astype(np.uint64)  # suffixes that agree in all words to the window's end
        same = mix64(left[here] ^ mix64(run[here]))
        order = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], same[order][1:] != same[order][:-1])))
        where = here[order]
        size = np.diff(np.concatenate((starts, [len(where)])))
        least, most = np.repeat(np.minimum.reduceat(small[where], starts), size), np.repeat(np.maximum.reduceat(large[where], starts), size)
        held[where] |= (least < most).astype(np.int64) << reach
        cut[where] |= (least < small[where]).astype(np.int64) << reach
    return held, cut


def _compared(batches: Iterator[pa.RecordBatch], first: str, last: str, out: list[str]) -> Iterator[pa.RecordBatch]:
    """Feeds whole seeds, some ``CHUNK`` suffixes at a time, to :func:`_shared`; the columns ``out`` with held and cut."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows:
            held, cut = _shared(rows, first, last)
            found = np.flatnonzero(held)
            rows = rows.select(out).take(found).append_column("held", pa.array(held[found])).append_column("cut", pa.array(cut[found]))
            yield from rows.to_batches()

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size < CHUNK:
            continue
        rows = pa.Table.from_batches(waiting)
        key = rows.column("key").to_numpy()
        whole = int(np.flatnonzero(key == key[-1])[0])  # the last seed may go on in the next batch
        yield from done(rows.slice(0, whole))
        waiting, size = rows.slice(whole).to_batches(), len(key) - whole
    if waiting:
        yield from done(pa.Table.from_batches(waiting))


def _compared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _compared(batches, "id", "id", ["id", "part", "at"])


def _compared_shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _compared(batches, "least", "most", ["shape"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For (shape, least, most, low, high, after, before): a row per window, with a hash of its words beyond the seed."""
    for batch in batches:
        low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
        after, before = _matrix(batch.column("after")), _matrix(batch.column("before"))
        left, right = [np.zeros(len(low), dtype=np.uint64)], [np.zeros(len(low), dtype=np.uint64)]
        for k in range(SIDE):
            left.append(mix64(left[-1] * _ROLL + before[:, k]))
            right.append(mix64(right[-1] * _UNROLL + after[:, k]))
        for reach in range(SIDE + 1):
            here = np.flatnonzero((low <= reach) & (reach <= high))
            if len(here):
                window = mix64(left[reach][here] * _UNROLL + right[SIDE - reach][here])
                rows = pa.Table.from_batches([batch]).select(["shape", "least", "most"]).take(here)
                rows = rows.append_column("reach", pa.array(np.full(len(here), reach, dtype=np.int32))).append_column("window", pa.array(window.view(np.int64)))
                yield from rows.combine_chunks().to_batches()


def _frequent(rows: DataFrame, frequent: int) -> DataFrame:
    """Marks for suffixes of frequent seeds: those with equal words around their seed are one shape, and shapes are compared."""
    shape = F.struct("key", F.xxhash64("low", "high", "after", "before").alias("around"))
    rows = staged(rows.withColumn("shape", shape), "frequent-suffixes")
    around = [F.first(c).alias(c) for c in ("low", "high", "after", "before")]
    shapes = rows.groupBy("shape").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"), *around).withColumn("key", F.col("shape.key"))
    shapes = staged(shapes, "shapes")
    wide = staged(shapes.groupBy("key").agg(F.count(F.lit(1)).alias("shapes")).filter(F.col("shapes") > frequent).select("key"), "wide-seeds")
    schema = "shape struct<key: bigint, around: bigint>, held long, cut long"
    marks = shapes.join(wide, "key", "left_anti").repartition("key").sortWithinPartitions("key", "after").mapInArrow(_compared_shapes, schema)
    if not wide.isEmpty():  # too many shapes for one task: their windows are counted instead
        kinds = "shape struct<key: bigint, around: bigint>, least long, most long, reach int, window long"
        windows = staged(shapes.join(wide, "key", "left_semi").mapInArrow(_windows, kinds).withColumn("key", F.col("shape.key")), "windows")
        repeated = windows.groupBy("key", "reach", "window").agg(F.min("least").alias("first"), F.max("most").alias("last")).filter("first <> last").drop("last")
        repeated = staged(repeated, "repeated")  # between plain reads, Spark can cut a frequent window's rows apart
        bit = F.expr("shiftleft(1L, reach)")
        found = windows.join(repeated, ["key", "reach", "window"])
        marks = marks.unionByName(found.groupBy("shape").agg(F.bit_or(bit).alias("held"), F.bit_or(F.when(F.col("first") < F.col("least"), bit).otherwise(F.lit(0))).alias("cut")))
    marks = staged(marks.join(shapes.select("shape", "least", "n"), "shape"), "shape-marks")
    found = lookup(rows.select("id", "part", "at", "shape"), marks, "shape", "n", rows.count())
    # every id of a shape but the least has that one before it
    return found.select("id", "part", "at", "held", F.when(F.col("id") > F.col("least"), F.col("held")).otherwise(F.col("cut")).alias("cut"))


def _spans(marks: np.ndarray) -> list[list[int]]:
    """The union of windows as [start, end); a mark holds a seed's position and, in bit k, whether a window starts k words before it."""
    at, bits = marks >> 32, marks & 0xFFFFFFFF
    reach = np.arange(SIDE + 1)
    start = np.unique((at[:, None] - reach)[(bits[:, None] >> reach) & 1 == 1])
    if not len(start):
        return []
    breaks = np.flatnonzero(np.diff(start) > LEAST)
    return [[int(a), int(b) + LEAST] for a, b in zip(start[np.concatenate(([0], breaks + 1))], start[np.concatenate((breaks, [-1]))], strict=True)]


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "part": pdf["part"], "spans": [_spans(m) for m in pdf["held"]], "cut": [_spans(m) for m in pdf["cut"]]})


def text_part(text: Column) -> Column:
    """Tells apart the texts of rows with one id."""
    return F.xxhash64(text)


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """(id, part, spans, cut) of texts that share passages of ``LEAST`` words or more with other documents.

    ``part`` is :func:`text_part` of the text. ``spans`` are [start, end) in words; ``cut`` leaves out
    windows of ``LEAST`` words that no smaller id holds, so of words that are cut a copy stays in a
    document of smaller id.
    """
    texts = docs.select(docs[id_column].cast("long").alias("id"), text_part(docs[text_column]).alias("part"), docs[text_column].alias("text")).filter("id is not null and text is not null")
    suffixes = staged(texts.mapInPandas(_retained, "key long, id long, part long, at int"), "suffixes")
    seeds = suffixes.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", "n")
    seeds = staged(seeds, "seeds")

    def around(some: DataFrame) -> DataFrame:
        """Texts with the positions of some seeds in them."""
        kept = suffixes.join(some.select("key"), "key").groupBy("id", "part").agg(F.collect_list("at").alias("kept"))
        return texts.join(kept, ["id", "part"]).select("id", "part", "text", "kept")

    plain = around(seeds.filter(F.col("n") <= frequent)).mapInArrow(_contexts, _CONTEXT)
    found = plain.repartition("key").sortWithinPartitions("key", "after").mapInArrow(_compared_rows, "id long, part long, at int, held long, cut long")
    hot = seeds.filter(F.col("n") > frequent)
    if not hot.isEmpty():
        found = found.unionByName(_frequent(around(hot).mapInArrow(_contexts, _CONTEXT), frequent))
    at = F.shiftleft(F.col("at").cast("long"), 32)
    found = found.select("id", "part", at.bitwiseOR(F.col("held")).alias("held"), at.bitwiseOR(F.col("cut")).alias("cut"))
    marks = found.groupBy("id", "part").agg(F.collect_list("held").alias("held"), F.collect_list("cut").alias("cut"))
    return marks.mapInPandas(_union, "id long, part long, spans array<array<int>>, cut array<array<int>>")


def without_passages(docs: DataFrame, passages: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the ``cut`` passages taken out of their texts; other texts stay as they are."""
    own = "_" * (1 + max(map(len, docs.columns)))  # a prefix that no column has
    taken = passages.select(F.col("id").alias(f"{own}id"), F.col("part").alias(f"{own}part"), F.col("cut").alias(f"{own}cut"))
    same = (docs[id_column].cast("long") == taken[f"{own}id"]) & (text_part(docs[text_column]) == taken[f"{own}part"])
    joined = docs.join(taken, same, "left")

    @F.pandas_udf("string")
    def shorten(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, cut in zip(texts, cuts, strict=True):
            if text is None or cut is None or not len(cut):
                out.append(text)
                continue
            data = text.encode("utf-8", "surrogatepass")
            _, start, end = word_hashes(text)
            at, parts = 0, []
            for a, b in cut:
                parts.append(data[at : start[a]])
                at = end[b - 1]
            out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    return joined.select(*[shorten(docs[c], F.col(f"{own}cut")).alias(c) if c == text_column else docs[c] for c in docs.columns])


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: repeated passages and what of them later copies hold, in words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = repeated_passages(docs)
    joined = docs.select(F.col("doc_id").cast("long").alias("id"), text_part(F.col("text")).alias("part")).join(found, ["id", "part"], "left")

    def words(spans: str) -> F.Column:
        return F.coalesce(F.aggregate(spans, F.lit(0), lambda acc, s: acc + s[1] - s[0]), F.lit(0)).cast("long")

    def text(spans: str) -> F.Column:
        return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s[0], s[1])), ","), F.lit(""))

    return joined.select(F.col("id").alias("doc_id"), words("spans").alias("repeated_words"), words("cut").alias("cut_words"), text("spans").alias("spans"), text("cut").alias("cut"))
