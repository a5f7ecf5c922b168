"""Python over the rows of a column, a bounded slice of a batch at a time.

Spark hands a worker batches of up to 10,000 rows or 64 MB. As Python objects, with
their results beside them, these are many times that, so rows are turned into objects
and their results back into columns in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes and rows of a slice at most; a row of more is one by itself.
BYTES, ROWS = 1 << 20, 256


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Neighbouring rows of columns, cut in halves until they fit."""
    todo = [(0, len(columns[0]))]
    while todo:
        low, n = todo.pop()
        some = tuple(c.slice(low, n) for c in columns)
        if n > 1 and (n > ROWS or sum(c.nbytes for c in some) > BYTES):
            todo += [(low + n // 2, n - n // 2), (low, n // 2)]
        elif n:
            yield some


def by_rows(f: Callable, kind: str, result: pa.DataType, *columns: Column) -> Column:
    """`f` of each row's values; `result` is the Arrow form of the type `kind`."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in slices(batch if isinstance(batch, tuple) else (batch,)):
                yield pa.array([f(*row) for row in zip(*[c.to_pylist() for c in some])], result)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(run if len(columns) == 1 else several, kind)(*columns)
