"""The prefix tree of conversations, built as a Patricia tree over sorted sequences.

A turn is a fixed-width unit (md5 of role and text, length of the text), a conversation the concatenation of its units, so
that sorted bytes are sorted sequences and common bytes are common turns. Sequences are dealt into sorted ranges. A task
streams its range past a stack that holds one path, and makes points where sequences branch, end or stop alone; it needs
memory for one path, whatever the range holds. A point's subtree may go on in another range only if the point lies on the
first or the last path of its own: these border points are made for each depth, and merged by the hash of their prefix.
Aggregates are those of points; nodes inside an edge follow from suffix sums over the edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placefabric.llm.components import stored

UNIT = 20  # bytes: 16 of md5, 4 of the text's length
GROUP = 100  # conversations that share the first turns of one
MOST = 5  # turns that are shared, at most
BLOCK = 20  # bits of ids whose copies travel as one row
BATCH = 8192
NOTHING = hashlib.sha256(b"").hexdigest()
_COLUMNS = [
    ("kind", pa.int32()), ("pid", pa.int32()), ("no", pa.int64()), ("parent_no", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("edge", pa.list_(pa.int64())), ("key", pa.binary()), ("last", pa.int64()), ("place", pa.int64()),
]
_DDL = "kind int, pid int, no long, parent_no long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, edge array<long>, key binary, last long, place long"
INNER, BORDER = 0, 1


def shared_turns(conv_id: Column) -> Column:
    """Turns that a conversation takes from the one of its hundred: crc32 of the id's decimal text mod 6."""
    return (F.crc32(F.encode(conv_id.cast("string"), "utf-8")) % (MOST + 1)).cast("int")


def sequences(turns: DataFrame) -> DataFrame:
    """turns (conv_id long, turn long, role, text) -> conv_id, units array<string>: a conversation's units in hex, by turn.

    Null turns come first, equal ones stand by their units; null roles and texts are empty. Rows without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    unit = F.concat(F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8")), F.lpad(F.hex(F.length(text)), 2 * (UNIT - 16), "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), unit.alias("unit")).alias("at"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda a: a["unit"]).alias("units"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Puts the first turns of each hundred's first conversation before a conversation's own turns beyond as many."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    head = F.max(F.when(F.col("conv_id") == base, F.slice("units", 1, MOST))).over(Window.partitionBy(base))
    h = shared_turns(F.col("conv_id"))
    taken = F.coalesce(F.slice(head, F.lit(1), h), F.array().cast("array<string>"))
    return own.select("conv_id", F.concat(taken, F.slice("units", h + 1, F.greatest(F.size("units") - h, F.lit(0)))).alias("units"))


def _common(a: bytes, b: bytes) -> int:
    """Units at which two sequences agree from the start."""
    lo, hi = 0, min(len(a), len(b)) // UNIT
    if a[: hi * UNIT] == b[: hi * UNIT]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * UNIT : mid * UNIT] == b[lo * UNIT : mid * UNIT]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _lengths(path: bytes) -> np.ndarray:
    return np.frombuffer(path, ">u4").reshape(-1, UNIT // 4)[:, -1].astype(np.int64)


class _Point:
    __slots__ = ("border", "children", "depth", "first", "leaves", "n", "no", "place", "saved", "sha")

    def __init__(self, no: int, depth: int, border: bool = False, place: int = 0):
        self.no, self.depth, self.border, self.place = no, depth, border, place
        self.n = self.children = self.leaves = self.saved = 0
        self.first, self.sha = None, None

    def take(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


class _Range:
    """The points of one sorted range of sequences."""

    def __init__(self, pid: int):
        self.pid, self.rows, self.made, self.path, self.lengths, self.stack = pid, [], 0, None, None, []

    def point(self, depth: int, border: bool = False, place: int = 0) -> _Point:
        self.made += 1
        return _Point(self.made - 1, depth, border, place)

    def emit(self, c: _Point, parent_no: int | None, depth: int, own: bool = True, **more) -> None:
        """own: not for the inner nodes of a border edge, which have nothing but their one child."""
        row = {"pid": self.pid, "no": c.no if own else None, "parent_no": parent_no, "conv_id": c.first, "depth": depth, "n_convs": c.n, "n_children": c.children if own else 0}
        row |= {"n_leaves": c.leaves if own else 0, "saved_tokens": c.saved if own else 0, "ends_sha256": c.sha if own else None}
        self.rows.append(row | more)

    def key(self, depth: int) -> bytes:
        return hashlib.md5(self.path[: depth * UNIT]).digest()

    def close(self, c: _Point, parent: _Point | None) -> None:
        """c's subtree in this range is complete."""
        if parent is not None:
            parent.take(c.n, c.first)
        if c.border:
            self.emit(c, None, c.depth, kind=BORDER, edge=None, key=self.key(c.depth), last=int(self.lengths[c.depth - 1]) if c.depth else 0, place=c.place)
            return
        edge = (c.n - 1) * self.lengths[parent.depth : c.depth]
        c.saved += int(edge[-1])
        above = np.zeros(len(edge), np.int64)
        above[:-1] = np.cumsum(edge[-2::-1])[::-1]
        c.leaves = c.leaves if c.children else 1
        self.emit(c, parent.no, c.depth, kind=INNER, edge=above.tolist(), key=None, last=None, place=None)
        parent.children += 1
        parent.leaves += c.leaves
        parent.saved += c.saved + int(above[0])

    def add(self, path: bytes, n: int, first: int, sha: str) -> None:
        depth = len(path) // UNIT
        if self.path is None:
            self.stack = [self.point(d, True, d) for d in range(depth + 1)]
        else:
            common, stack = _common(self.path, path), self.stack
            while stack[-1].depth > common:
                c = stack.pop()
                if stack[-1].depth < common:
                    stack.append(self.point(common))
                self.close(c, stack[-1])
            if depth > common:
                stack.append(self.point(depth))
        self.path, self.lengths = path, _lengths(path)
        self.stack[-1].take(n, first)
        self.stack[-1].sha = sha

    def end(self) -> None:
        """What is left is the last path, border from the root down."""
        stack = self.stack
        while stack:
            c = stack.pop()
            above = stack[-1].depth if stack else -1
            if not c.border:
                c.border, c.place = True, self.made + c.depth
                for d in range(above + 1, c.depth):
                    self.emit(c, None, d, False, kind=BORDER, edge=None, key=self.key(d), last=int(self.lengths[d - 1]), place=self.made + d)
            self.close(c, stack[-1] if stack else None)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(_COLUMNS))


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, n, first, ids) in the order of path and block -> the points of the range. Equal paths are one sequence."""
    found = _Range(TaskContext.get().partitionId())
    path, n, first, digest = None, 0, 0, None
    for batch in batches:
        for p, m, f, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if p == path:
                n += m
                digest.update(b",")
            else:
                if path is not None:
                    found.add(path, n, first, digest.hexdigest())
                path, n, first, digest = p, m, f, hashlib.sha256()
            digest.update(ids.encode())
            if len(found.rows) >= BATCH:
                yield found.batch()
    if path is not None:
        found.add(path, n, first, digest.hexdigest())
        found.end()
    yield found.batch()


def _border_tree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Merged border points in preorder -> the same with children, leaves and savings of their whole subtrees, and the parent's conv_id."""
    rows = pd.concat(list(frames))
    depth, conv = rows["depth"].tolist(), rows["conv_id"].tolist()
    n, last = rows["n_convs"].tolist(), rows["last"].tolist()
    children, leaves, saved = rows["n_children"].tolist(), rows["n_leaves"].tolist(), rows["saved_tokens"].tolist()
    path, parents = [], []
    for k, d in enumerate(depth):
        del path[d:]
        parents.append(path[-1] if path else None)
        path.append(k)
    for k in range(len(depth) - 1, -1, -1):
        saved[k] += (n[k] - 1) * last[k]
        leaves[k] = leaves[k] if children[k] else 1
        if (p := parents[k]) is not None:
            children[p], leaves[p], saved[p] = children[p] + 1, leaves[p] + leaves[k], saved[p] + saved[k]
    rows["n_children"], rows["n_leaves"], rows["saved_tokens"] = children, leaves, saved
    rows["parent_conv_id"] = pd.array([None if p is None else conv[p] for p in parents], "Int64")
    yield rows[["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]]


def prefix_tree(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """convs (conv_id long, units array<string>) -> a row for each node of the prefix tree.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, (n_convs - 1) times the length of the node's text), ends_sha256 (ids that end there, ascending, comma-joined).
    Equal conversations share their nodes; one without turns ends at the root. Without conversations there is no node.
    Copies meet as rows of up to 2^20 ids and are hashed as they stream by. Border points, at most two paths for each
    range, are summed in one task. ranges: sorted ranges, else as many as the session's shuffles have and as their size asks.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    paths = convs.select("conv_id", F.unhex(F.array_join("units", "")).alias("path"), F.shiftright("conv_id", BLOCK).alias("block"))
    runs = paths.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), ids.alias("ids"))
    dealt = runs.repartitionByRange("path") if ranges is None else runs.repartitionByRange(ranges, "path")
    points = stored(dealt.sortWithinPartitions("path", "block").select("path", "n", "first", "ids").mapInArrow(_points, _DDL))
    inner, border = points.where(F.col("kind") == INNER), points.where(F.col("kind") == BORDER)
    merged = border.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"), F.first("last").alias("last"), F.min(F.struct("pid", "place")).alias("at"),
    )
    columns = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    top = merged.repartition(1).sortWithinPartitions("at").drop("key", "at").mapInPandas(_border_tree, columns)
    named = border.where("no is not null").select("pid", "no", "key").join(merged.select("key", "conv_id"), "key").select("pid", "no", "conv_id")
    parents = inner.select("pid", "no", "conv_id").unionByName(named).select("pid", F.col("no").alias("parent_no"), F.col("conv_id").alias("above"))
    nodes = inner.join(parents, ["pid", "parent_no"]).select("*", F.size("edge").alias("k"), F.posexplode("edge").alias("i", "more"))
    end = F.col("i") == F.col("k") - 1
    nodes = nodes.select(
        "conv_id", (F.col("depth") - F.col("k") + F.col("i") + 1).alias("depth"), F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(end, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), "n_leaves", (F.col("saved_tokens") + F.col("more")).alias("saved_tokens"), F.when(end, F.col("ends_sha256")).alias("ends_sha256"),
    )
    return nodes.unionByName(top).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the prefix tree of the rebuilt conversations; extra columns are not read."""
    return prefix_tree(rebuilt(sequences(turns)))
