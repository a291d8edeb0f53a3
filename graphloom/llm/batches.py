"""Slices of Arrow batches, so that memory in a Python worker follows text size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], *columns: str, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the columns' text sums to about size bytes each.

    A longer single row is a slice of its own; every row comes out once, in order.
    """
    for batch in batches:
        lengths = [sum(row) for row in zip(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in columns))]
        start, total = 0, 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(lengths):
            yield batch.slice(start)
