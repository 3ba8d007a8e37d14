"""Exchange of very many pairs of whole numbers by bucket, many pairs to a row.

A row of two longs takes some 14 bytes in a shuffle, and as many again for each further step. Here a task hands out the pairs of a
bucket as one row, whose numbers are kept as differences from the least, byte by byte: the first byte of all, the second of all, and
so on, no more than the largest needs. Of numbers in order the upper bytes are runs, which the shuffle compresses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

BLOCKS = T.StructType([T.StructField(n, t) for n, t in (("bucket", T.LongType()), ("low_x", T.LongType()), ("x", T.BinaryType()), ("low_y", T.LongType()), ("y", T.BinaryType()), ("n", T.LongType()))])
_ARROW = pa.schema([(f.name, pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64()) for f in BLOCKS])

#: Pairs of a bucket, about; a task sorts and hands out so many at once.
BUCKET_PAIRS, HELD_PAIRS = 400_000, 1 << 19


def buckets_for(pairs: int) -> int:
    """So many buckets that each has about BUCKET_PAIRS."""
    return min(max(32, pairs // BUCKET_PAIRS + 1), 1 << 20)


def _to_bytes(values: np.ndarray) -> tuple[int, bytes]:
    low = values.min()
    differences = values.astype(np.uint64) - low.astype(np.uint64)
    width = max(1, (int(differences.max()).bit_length() + 7) // 8)
    return int(low), differences.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_bytes(low: int, data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return (out.view("<u8").ravel().astype(np.uint64) + np.int64(low).astype(np.uint64)).view(np.int64)


def blocks(bucket: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of the pairs (x, y) of longs, which come in order of bucket."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist() if len(x) else []
    rows = [(int(bucket[a]), *_to_bytes(x[a:b]), *_to_bytes(y[a:b]), b - a) for a, b in zip(first, [*first[1:], len(x)], strict=False)]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """x and y of all pairs of rows that blocks() made."""
    columns = [table.column(name).to_pylist() for name in BLOCKS.names[1:]]
    both = [(_from_bytes(lx, x, n), _from_bytes(ly, y, n)) for lx, x, ly, y, n in zip(*columns, strict=True)]
    return tuple(np.concatenate([np.zeros(0, np.int64), *side]) for side in (zip(*both, strict=True) if both else ((), ())))


def by_range(found: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int, bits: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of pairs (x, y), x evenly spread over 0 to 2**bits - 1, by the range of x. Of equal x at most `most` are handed out at once."""
    held, n = [], 0

    def handed() -> pa.RecordBatch:
        x, y = (np.concatenate(side) for side in zip(*held, strict=True))
        order = np.argsort(x)
        x, y = x[order], y[order]
        if most is not None:
            keep = np.ones(len(x), bool)
            keep[most:] = x[most:] != x[:-most]
            x, y = x[keep], y[keep]
        return blocks(((x >> (bits - 24)) * buckets) >> 24, x, y)

    for x, y in found:
        held.append((x, y))
        n += len(x)
        if n >= HELD_PAIRS:
            yield handed()
            held, n = [], 0
    if n:
        yield handed()
