"""Arrow batches taken a bounded number of bytes at a time, with what they held given back after a task.

Spark sends up to ten thousand rows at once. Texts are made Python strings a part at a time, so a worker holds
one batch in Arrow's form and a few megabytes of objects beside it. A worker outlives its tasks, and Arrow keeps
freed memory for itself; so at the end of a task it is returned, as the executor's next stages may need it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a part, and bytes that it holds on average, at most.
ROWS, BYTES = 500, 4 << 20


def release() -> None:
    """Returns freed Arrow memory to the system."""
    pa.default_memory_pool().release_unused()


def cut(batch: pa.RecordBatch | pa.Array) -> Iterator:
    """Slices of a batch or array, without a copy; none of an empty one."""
    n = batch.num_rows if isinstance(batch, pa.RecordBatch) else len(batch)
    step = max(1, min(ROWS, n * BYTES // max(1, batch.nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def each(one: Callable[[pa.RecordBatch], object], batches: Iterator[pa.RecordBatch]) -> Iterator:
    """``one`` of each part of the batches; no part is held while the next is read."""

    def parts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(batch)
            batch = None

    yield from map(one, parts())
    release()


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches as tuples; integers stay integers beside nulls."""
    for some in each(lambda part: list(zip(*(c.to_pylist() for c in part.columns), strict=True)), batches):
        yield from some


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for use in mapInPandas, which gives memory back at a task's end."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped
