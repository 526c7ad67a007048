"""Helpers for Arrow batches in mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def bounded(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches in which ``column`` takes about ``max_bytes`` at most, or single rows: bounds the memory of
    vectorised kernels whatever the length of the texts."""
    for batch in batches:
        size = max(batch.column(column).nbytes, 1)
        step = max(1, batch.num_rows * max_bytes // size) if size > max_bytes else max(batch.num_rows, 1)
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
