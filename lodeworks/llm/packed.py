"""Rows that hold packed arrays: grouping by sorted keys, inside arrays and over batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, np.int64)


def rows_of(key: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(key, columns) for each distinct key, order inside kept."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    columns = [c[order] for c in columns]
    starts = [*runs(key), len(key)]
    for a, b in zip(starts, starts[1:], strict=False):
        yield int(key[a]), *(c[a:b] for c in columns)


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list]]]:
    """Rows grouped by their first column, which is sorted."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row)
    if rows:
        yield key, rows


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema.types, strict=True)], names=schema.names)


def parcels(rows: list[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """packed() by size: a batch for each `most` bytes of the binary columns; rows is emptied meanwhile."""
    rows.reverse()
    while rows:
        some, held = [], 0
        while rows and held < most:
            some.append(rows.pop())
            held += sum(len(x) for x in some[-1] if isinstance(x, bytes))
        yield packed(some, schema)


def pair_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal pairs."""
    return np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte by byte, all first bytes first: what is alike in neighbours compresses."""
    return np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T).tobytes()


def unplaned(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
