"""Packing of tokenised documents into sequences by bounded-space online best fit.

Each partition keeps ``windows`` open windows. A piece goes to the window that it fills best; when
none has room, the fullest one is emitted, its gap first filled with the head of the piece if at
least ``least_cut`` tokens fit. Documents longer than a sequence give whole sequences first.
What stays open at a partition's end is merged afterwards: the leftovers of many partitions are
dealt to a few tasks, placed the same way, largest first, and the last windows are joined by
cutting, so each of those tasks leaves one short sequence.

The first pass is written once to the shared folder, so sequences and leftovers come from one run
even if executors are lost. Memory is ``windows`` sequences and one batch of texts a task.

Defined cases. A null or empty text is a document of the end id alone. Rows that repeat are packed
each for itself; ``row`` tells them apart. Null ids are packed as null. A text of any length is
cut; its pieces are ordered by ``start``. An empty table gives no pieces. Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm.batches import rows
from propgraph.llm.tokens import chunk_ids
from propgraph.plans.staging import staged

#: Open windows at a partition's end that one merging task takes.
MERGED = 8192


class Windows:
    """A fixed number of open windows; ``emit`` takes the list of pieces of a finished one.

    A piece is (ident, row, start, ids, doc_tokens), with ids as bytes of four for each token.
    """

    def __init__(self, capacity: int, count: int, least_cut: int, emit):
        self.capacity, self.count, self.least_cut, self.emit = capacity, count, least_cut, emit
        self.open: list[tuple[int, int]] = []  # (room left, key), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def add(self, piece: tuple) -> None:
        ident, row, start, ids, total = piece
        while len(ids) // 4 >= self.capacity:  # whole sequences need no window
            self.emit([(ident, row, start, ids[: 4 * self.capacity], total)])
            ids, start = ids[4 * self.capacity :], start + self.capacity
        size = len(ids) // 4
        if not size:
            return
        at = bisect_left(self.open, (size, -1))
        if at == len(self.open) and len(self.open) >= self.count:
            room, key = self.open.pop(0)
            pieces = self.held.pop(key)
            if room >= self.least_cut:
                pieces.append((ident, row, start, ids[: 4 * room], total))
                ids, start, size = ids[4 * room :], start + room, size - room
            self.emit(pieces)
            at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, key = self.open.pop(at)
        else:
            room, key = self.capacity, self.next
            self.next += 1
            self.held[key] = []
        self.held[key].append((ident, row, start, ids, total))
        if room == size:
            self.emit(self.held.pop(key))
        else:
            insort(self.open, (room - size, key))

    def leftovers(self) -> list[list]:
        return [self.held[key] for _, key in self.open]


_SCHEMA = "id long, row long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"


_TYPES = {"id": pa.int64(), "row": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "open": pa.bool_()}


def _table(sequences: list[tuple[int, list, bool]]) -> pa.RecordBatch:
    out = []
    for number, pieces, is_open in sequences:
        offset = 0
        for ident, row, start, ids, total in pieces:
            out.append((ident, row, start, len(ids) // 4, ids, total, number, offset, is_open))
            offset += len(ids) // 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES.values(), strict=True)], list(_TYPES))


def _first_pass(tokenizer: str, end_id: int, capacity: int, windows: int, least_cut: int):
    tail = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = chunk_ids(tokenizer)
        number = TaskContext.get().partitionId() << 33
        row = number
        ready: list = []

        def emit(pieces: list) -> None:
            nonlocal number
            ready.append((number, pieces, False))
            number += 1

        state = Windows(capacity, windows, least_cut, emit)
        for ident, text in rows(batches):
            ids = tokens.of(text) + tail
            state.add((ident, row, 0, ids, len(ids) // 4))
            row += 1
            if len(ready) >= 500:
                yield _table(ready)
                ready.clear()
        for pieces in state.leftovers():
            ready.append((number, pieces, True))
            number += 1
        if ready:
            yield _table(ready)

    return run


def _merge_pass(capacity: int, windows: int, least_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = list(rows(batches))
        pieces.sort(key=lambda p: (-len(p[3]), p[1], p[2]))
        number = (1 << 62) + (TaskContext.get().partitionId() << 33)
        ready: list = []

        def emit(done: list) -> None:
            nonlocal number
            ready.append((number, done, False))
            number += 1

        state = Windows(capacity, windows, least_cut, emit)
        for piece in pieces:
            state.add(piece)
        rest = [(sum(len(p[3]) for p in w), k, w) for k, w in enumerate(state.leftovers())]
        heapq.heapify(rest)
        joined = Windows(capacity, 1, 1, emit)  # one window, and every gap is filled by cutting
        while rest:
            for piece in heapq.heappop(rest)[2]:
                joined.add(piece)
        for done in joined.leftovers():
            emit(done)
        for at in range(0, len(ready), 500):
            yield _table(ready[at : at + 500])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, windows: int = 64, least_cut: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of sequences: id, row, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    first = staged(texts.mapInArrow(_first_pass(tokenizer, end_id, capacity, windows, least_cut), _SCHEMA), "packed")
    waiting = first.filter("open").select("sequence_id").distinct().count()
    tasks = max(1, waiting // MERGED)
    left = first.filter("open")
    left = left.repartition(tasks, F.xxhash64("sequence_id")) if tasks > 1 else left.coalesce(1)
    merged = left.select("id", "row", "start", "ids", "doc_tokens").mapInArrow(_merge_pass(capacity, windows, least_cut), _SCHEMA)
    return first.filter("not open").unionByName(merged).drop("open")


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
