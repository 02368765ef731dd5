"""Parts of Arrow batches: bounded, whole and exact."""

import pyarrow as pa

from propgraph.llm import batches

BIG = (1 << 53) + 1


def test_cut_is_whole_and_bounded():
    batch = pa.RecordBatch.from_pydict({"id": list(range(1201)), "text": ["x"] * 1201})
    parts = list(batches.cut(batch))
    assert [p.num_rows for p in parts] == [500, 500, 201]
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    long = pa.array(["x" * (3 << 20)] * 5)
    assert [len(p) for p in batches.cut(long)] == [1] * 5
    assert list(batches.cut(pa.array([], pa.string()))) == []
    assert list(batches.cut(batch.slice(0, 0))) == []


def test_rows_keep_integers_beside_nulls():
    types = pa.schema([("id", pa.int64()), ("text", pa.string())])
    one = pa.RecordBatch.from_pydict({"id": [BIG, None], "text": [None, ""]}, types)
    two = pa.RecordBatch.from_pydict({"id": [2**63 - 1, BIG], "text": ["é", "a\x00b"]}, types)
    assert list(batches.rows(iter([one, one.slice(0, 0), two]))) == [(BIG, None), (None, ""), (2**63 - 1, "é"), (BIG, "a\x00b")]
    assert list(batches.rows(iter([]))) == []


def test_released_passes_everything_on():
    assert list(batches.released(lambda rows: (r + 1 for r in rows))(iter([1, 2]))) == [2, 3]
