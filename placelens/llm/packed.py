"""Exchange of many small numbers as few rows: each task packs what it found per bucket into binary columns.

Spark shuffles and groups the rows by bucket; a bucket is worked on with numpy. The number of buckets follows from
the size of the table, so a bucket stays near its size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_size(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")).cast("bigint"))).first()[0] or 0


def bucket_count(total_bytes: int, bytes_per_bucket: int) -> int:
    return max(1, -(-total_bytes // bytes_per_bucket))


def pack_ids(ids: np.ndarray) -> bytes:
    """64-bit ids as their smallest and the distances from it, in as few bytes each as the largest needs."""
    if not len(ids):
        return b""
    low = ids.astype(np.int64).min()
    far = ids.astype(np.int64).astype(np.uint64) - low.astype(np.uint64)
    width = max(1, -(-int(far.max()).bit_length() // 8))
    return bytes([width]) + low.tobytes() + far.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    width, low = data[0], np.frombuffer(data, np.int64, 1, offset=1)[0]
    far = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(far), 8), np.uint8)
    out[:, :width] = far
    return (out.view(np.uint64).ravel() + low.astype(np.uint64)).astype(np.int64)


def pack(buckets: np.ndarray, columns: dict[str, np.ndarray], ids: Sequence[str] = ()) -> pa.RecordBatch | None:
    """One row per bucket: its number and each column's values as binary; ``ids`` names 64-bit id columns."""
    if not len(buckets):
        return None
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    first = np.flatnonzero(np.diff(sorted_buckets, prepend=sorted_buckets[0] - 1))
    ends = [*first[1:], len(order)]
    out = [pa.array(sorted_buckets[first], pa.int32())]
    for name, values in columns.items():
        values = values[order]
        code = pack_ids if name in ids else (lambda x: x.tobytes())
        out.append(pa.array([code(values[a:b]) for a, b in zip(first, ends)], pa.binary()))
    return pa.RecordBatch.from_arrays(out, ["bucket", *columns])


def unpack(table: pa.Table, name: str, dtype=None) -> np.ndarray:
    """All values of a packed column of a group; without ``dtype`` an id column."""
    parts = [x for x in table.column(name).to_pylist() if x]
    parts = [np.frombuffer(x, dtype) if dtype is not None else unpack_ids(x) for x in parts]
    return np.concatenate(parts) if parts else np.empty(0, np.int64 if dtype is None else dtype)


def runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys in sorted arrays."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n) if n else first
