"""Dealing packed records to buckets.

Scan tasks pack fixed-width records into one binary value for each bucket, and a grouped Arrow function reads a whole
bucket. A shuffled record costs its own bytes only. A bucket's share is the total over the number of buckets, which
callers set from a measured total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FLUSH_BYTES = 16 << 20


class Dealer:
    """Gathers records (rows of a structured array) by bucket and hands out Arrow batches (bucket int, kind int, data binary)."""

    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
    ddl = "bucket int, kind int, data binary"

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, {}, 0

    def add(self, kind: int, key: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.parts.setdefault(kind, []).append(((key % np.uint64(self.buckets)).astype(np.int32), records))
            self.size += records.nbytes
            if self.size > FLUSH_BYTES:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows: tuple[list, list, list] = ([], [], [])
        for kind, parts in self.parts.items():
            bucket, records = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(bucket, kind="stable")
            bucket, records = bucket[order], records[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for at, to in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
                rows[0].append(int(bucket[at]))
                rows[1].append(kind)
                rows[2].append(records[at:to].tobytes())
        self.parts, self.size = {}, 0
        if rows[0]:
            yield pa.record_batch([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary())], schema=self.schema)


def unpack(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    """All records of a kind in a bucket."""
    return np.frombuffer(b"".join(d for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True) if k == kind), dtype)


def runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(sorted_keys)]))
