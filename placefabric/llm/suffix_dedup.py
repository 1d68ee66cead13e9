"""Removal of byte strings that stand at several places, by merging shard Burrows-Wheeler transforms.

Texts are read over an alphabet of fixed-width byte blocks: each residue class of positions gives one string of block
symbols, so a suffix agrees on `depth` symbols exactly if it agrees on depth * width bytes. The strings that one scan task
sends are a shard. Each shard sorts its own suffixes once and keeps its transform, the symbol before each suffix. Shards
merge by refinement of their interleave: one pass over the merged order sends every shard number to the next slot of its
symbol, which sorts the merged order one symbol deeper. Suffixes whose predecessors' blocks are split get split blocks, so
the pass in which a border appears is the common prefix there, and blocks that remain after `depth` passes are the
repeated intervals. No suffixes are compared or sorted again across shards.

Anchors (see anchors) bring together the runs that can share so long a string, so a merge sees only these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placefabric.llm import anchors
from placefabric.llm.arrays import byte_table, chunks, dense, prefix_hash, sorted_places, span_hash
from placefabric.llm.exchange import runs

GROUP_BYTES = 256 << 10  # of runs that are merged in one go


class Shard:
    """Suffixes of block strings in sorted order (to `depth` symbols) with their transform. Code 0 ends a string."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = len(codes)
        rank, step = codes.astype(np.int64), 1
        ends = np.flatnonzero(codes == 0)
        rank[ends] = np.arange(len(ends))  # end marks differ, in the order of their strings
        rank[codes != 0] += len(ends)
        limit = ends[np.searchsorted(ends, np.arange(n))]  # a suffix doesn't reach beyond its end
        self.order, keys = sorted_places(rank)
        while step < depth:
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            after[np.arange(n) + step > limit] = 0
            self.order, keys = sorted_places(rank * (int(after.max()) + 1) + after)
            step *= 2
        before = np.empty(n, codes.dtype)
        before[1:], before[0] = codes[:-1], 0
        self.transform = before[self.order]
        self.ends = len(ends)


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave after `depth` passes (shard of each merged place) and for each place the common prefix with the one before."""
    sizes = [len(s.order) for s in shards]
    n, ends = sum(sizes), sum(s.ends for s in shards)
    kind = np.int16 if len(shards) < 1 << 15 else np.int64  # short integers sort in linear time
    z = np.repeat(np.arange(len(shards), dtype=kind), sizes)
    transforms = np.concatenate([s.transform for s in shards])
    block = np.zeros(n, np.int64)
    common = np.full(n, -1, np.int64)  # unknown yet: at least the passes so far
    fixed = np.repeat(np.arange(len(shards), dtype=kind), [s.ends for s in shards])
    for done in range(depth):
        symbol = np.empty(n, np.int64)
        symbol[np.argsort(z, kind="stable")] = transforms  # a shard's places take its symbols in order
        order, symbol = sorted_places(symbol)
        z, block = z[order], block[order]
        z[:ends] = fixed
        border = np.ones(n, bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])
        border[: ends + 1] = True
        common[border & (common < 0)] = done
        block = np.cumsum(border)
    common[common < 0] = depth
    return z, common


def repeated_suffixes(pieces: list[bytes], parts: np.ndarray, length: int, width: int = 100) -> list[np.ndarray]:
    """For each piece, which of its windows of `length` bytes stand at two places or more of all pieces.

    parts: the scan task of each piece, in rising order; a task's pieces are one shard.
    """
    depth = length // width
    if depth * width != length:
        raise ValueError("length must be a multiple of width")
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(sizes) - sizes
    blocks = np.maximum(sizes - width + 1, 0)  # positions at which a block stands
    owner = np.repeat(np.arange(len(pieces)), blocks)
    place = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[owner] + place
    codes = dense(span_hash(prefix_hash(byte_table()[data]), at, at + width)) + 1
    # strings: by piece and residue class, each followed by its end mark
    string = owner * width + place % width
    order, line = sorted_places(string)
    last = np.flatnonzero(np.concatenate((line[1:] != line[:-1], [True]))) if len(line) else np.zeros(0, np.int64)
    text = np.insert(codes[order], last + 1, 0)
    back = np.insert(order, last + 1, -1)  # which block position each symbol is
    found = [np.zeros(max(0, len(p) - length + 1), bool) for p in pieces]
    hit = back[twins(text, depth, np.searchsorted(parts[owner[order[last]]], np.unique(parts)), last + 1 + np.arange(len(last)))]
    hit = hit[hit >= 0]
    hit = hit[place[hit] + length <= sizes[owner[hit]]]
    flat = np.zeros(len(owner), bool)
    flat[hit] = True
    base = np.cumsum(blocks) - blocks
    for k in range(len(pieces)):
        found[k] = flat[base[k] : base[k] + len(found[k])]
    return found


def twins(text: np.ndarray, depth: int, shards: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions of coded strings whose next `depth` symbols stand at another position too.

    ends: where each string's end mark (0) stands; shards: the first string of each shard.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    starts = np.concatenate(([0], ends + 1))[np.unique(np.minimum(shards, len(ends) - 1))]
    built = [Shard(text[a:b], depth) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True)]
    z, common = merge(built, depth)
    twin = common >= depth
    twin[:-1] |= twin[1:].copy()
    position = np.empty(len(z), np.int64)
    position[np.argsort(z, kind="stable")] = np.concatenate([s.order + a for s, a in zip(built, starts.tolist(), strict=True)])
    return position[twin]


def repeated_in_large_group(pieces: list[bytes], parts: np.ndarray, at: np.ndarray, length: int, width: int = 100) -> list[np.ndarray]:
    """repeated_suffixes for many pieces under one anchor, which stands in each at `at`.

    Equal windows stand at equal distances from the anchor, so the windows of one distance are merged at a time, as
    strings of length / width symbols. Memory is one hash for each byte and a few numbers for each piece.
    """
    depth = length // width
    hashes = []
    for p in pieces:
        n = len(p) - width + 1
        i = np.arange(n)
        hashes.append(span_hash(prefix_hash(byte_table()[np.frombuffer(p, np.uint8)]), i, i + width))
    counts = np.array([len(p) - length + 1 for p in pieces], np.int64)
    found = [np.zeros(n, bool) for n in counts]
    for offset in range(int((-at).min()), int((counts - at).max())):
        own = np.flatnonzero((at + offset >= 0) & (at + offset < counts))
        if len(own) > 1:
            symbols = np.stack([hashes[k][at[k] + offset :: width][:depth] for k in own.tolist()])
            text = np.zeros((len(own), depth + 1), np.int64)
            text[:, :depth] = np.unique(symbols, return_inverse=True)[1].reshape(symbols.shape) + 1
            hit = twins(text.ravel(), depth, np.searchsorted(parts[own], np.unique(parts[own])), np.arange(len(own)) * (depth + 1) + depth)
            for k in own[hit[hit % (depth + 1) == 0] // (depth + 1)].tolist():
                found[k][at[k] + offset] = True
    return found


def _decide(length: int):
    def work(table: pa.Table) -> pa.Table:
        d = anchors.Decisions(table, True)
        order = np.argsort(d.anchor, kind="stable")
        sizes = pc.binary_length(d.symbols).to_numpy()[order]
        first, end = runs(d.anchor[order])
        upto, a = np.concatenate(([0], np.cumsum(sizes))), 0
        while a < len(first):  # whole anchors up to GROUP_BYTES, or one that is larger
            b = max(a + 1, int(np.searchsorted(upto[end], upto[first[a]] + GROUP_BYTES, "right")))
            rows = order[first[a] : end[b - 1]]
            rows = rows[np.argsort(d.part[rows], kind="stable")]
            pieces, parts = [d.symbols[k].as_py() for k in rows.tolist()], d.part[rows]
            large = b == a + 1 and upto[end[a]] - upto[first[a]] > GROUP_BYTES
            found = repeated_in_large_group(pieces, parts, d.at[rows].astype(np.int64), length) if large else repeated_suffixes(pieces, parts, length)
            d.add(rows.tolist(), found)
            a = b
        return d.table()

    return work


def _cut(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            n_bytes, n_removed, n_spans, digests = [], [], [], []
            for at, to, data, offsets in chunks(batch.column(1)):
                for row in range(at, to):
                    own = data[offsets[row - at] : offsets[row - at + 1]]
                    gone = anchors.covered(marks, row, len(own), length)
                    n_bytes.append(len(own))
                    n_removed.append(int(gone.sum()))
                    n_spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
                    digests.append(hashlib.sha256(own[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return scan


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, a row for each row.

    A byte goes when a string of `length` bytes that covers it also starts anywhere else, in the same document too;
    strings are judged on the input and don't cross documents. Null texts count as empty; repeated rows are documents of
    their own, so each removes the other. Null doc_ids stay null. Other columns are ignored.
    """
    docs = anchors.versioned(docs)
    marks = anchors.repeated_windows(docs, anchors.text_bytes(docs), False, length, True, _decide(length))
    joined = docs.join(marks, ["doc", "ver"], "left").select(F.when(F.col("doc") != anchors.NO_ID, F.col("doc")).alias("doc_id"), "text", "marks")
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
