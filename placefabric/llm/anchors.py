"""Routing of repeated windows: which parts of which documents can share a run of so many symbols with another place.

Every window of `length` symbols holds an anchor, its `gram`-symbol substring of least hash (the last of equals). Anchors
depend on a window's content and on one shared set alone, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a run; runs meet by anchor hash in a bucket. Where two or more meet, the runs go
on to a second exchange, which carries their symbols, and there the windows are decided.

The shared set holds grams that stand often. They count as larger than all others, so a window that holds anything
besides a common passage is anchored there and meets few others, while the windows wholly inside the passage form equal
runs. Of equal runs (by a 64-bit hash of their content) two are decided; the others follow these, from the scan task on.
So what a common passage sends to a bucket is two runs for each scan task. Copies of a whole text within a scan task
likewise follow two of them. The set only shapes the routing: the result is exact for every set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placefabric.llm.arrays import byte_table, chunks, prefix_hash, sliding_min, span_hash, word_hashes, word_spans
from placefabric.llm.components import materialise
from placefabric.llm.exchange import Dealer, runs, unpack

BUCKET_BYTES = 24 << 20  # of runs in a bucket of the first exchange
CLOSER_BYTES = 1 << 20  # of symbols in one of the second, which are worked on as integers
COMMON = 1 << 20  # most grams of the shared set, the most frequent
OFTEN = 3  # how often a gram stands in COUNTED_BYTES of texts that differ, to be counted
COUNTED_BYTES = 32 << 20
CHUNK = 256 << 10  # of texts that are hashed at a time
RUNS_BYTES = 8 << 20  # of runs among which a scan task looks for equal ones
NO_ID = (1 << 63) - 1
RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("ver", "<i8"), ("lo", "<u4"), ("n", "<u2"), ("at", "<u2"), ("more", "?")])
COPY = np.dtype([("doc", "<i8"), ("ver", "<i8"), ("like", "<i8"), ("like_ver", "<i8")])
_POS = np.uint64((1 << 30) - 1)
_TOP = np.uint64(63)
_LOW = np.uint64((1 << 22) - 1)


@dataclass(frozen=True)
class Symbols:
    """How texts are read: as bytes, or as words (a 64-bit hash each)."""

    words: bool

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(data, offsets, False) if self.words else (data, offsets)

    def hashes(self, units: np.ndarray) -> np.ndarray:
        return units if self.words else byte_table()[units]


class Common:
    """The shared set of grams, behind a bitmap of their low bits."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams)
        self.low = np.zeros(int(_LOW) + 1, bool)
        self.low[(self.grams & _LOW).astype(np.int64)] = True

    def holds(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams), bool)
        if len(self.grams):
            near = np.flatnonzero(self.low[(grams & _LOW).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.grams, grams[near]), len(self.grams) - 1)
            out[near] = self.grams[place] == grams[near]
        return out


def gram_of(length: int) -> int:
    """Symbols of an anchor: a shorter one stands in longer runs, of which less is sent twice."""
    return max(1, length // 4)


def find_runs(symbols: np.ndarray, first: np.ndarray, length: int, gram: int, common: Common | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all rows (a RUN array whose lo is relative to the row), the row of each, and a hash of each row's symbols."""
    sums = prefix_hash(symbols)
    whole = span_hash(sums, first[:-1], first[1:])
    n = len(symbols)
    if n < length:
        return np.zeros(0, RUN), np.zeros(0, np.int64), whole
    places = np.arange(n - gram + 1)
    grams = span_hash(sums, places, places + gram)
    order = ((grams >> np.uint64(1)) & ~_POS) | (_POS - places.astype(np.uint64))
    if common is not None:
        order |= common.holds(grams).astype(np.uint64) << _TOP
    least = sliding_min(order, length - gram + 1)
    edge = np.zeros(len(least) + 1, np.int32)  # windows that lie in one row
    long_ = first[1:] - first[:-1] >= length
    np.add.at(edge, first[:-1][long_], 1)
    np.add.at(edge, first[1:][long_] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    anchor = (_POS - (least[starts] & _POS)).astype(np.int64)
    a, b = runs(anchor)
    lo, count, anchor = starts[a], b - a, anchor[a]
    row = np.searchsorted(first, lo, "right") - 1
    out = np.zeros(len(lo), RUN)
    out["anchor"], out["content"] = grams[anchor], span_hash(sums, lo, lo + count - 1 + length)
    out["lo"], out["n"], out["at"] = lo - first[row], count, anchor - lo
    return out, row, whole


def _often(symbols: Symbols, length: int, gram: int):
    """(gram, n): grams under frequent anchors that stand OFTEN or more in texts that differ, COUNTED_BYTES at a time."""

    def counted(kept: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        anchors, n = np.unique(np.concatenate([k[1] for k in kept]), return_counts=True)
        anchors, found = anchors[n >= OFTEN], []
        for units, anchor, lo, size in kept if len(anchors) else ():
            own = np.isin(anchor, anchors)
            edge = np.zeros(len(units) + 1, np.int32)
            np.add.at(edge, lo[own], 1)
            np.add.at(edge, lo[own] + size[own], -1)
            units = units[np.cumsum(edge[:-1]) > 0]
            i = np.arange(max(0, len(units) - gram + 1))
            found.append(span_hash(prefix_hash(symbols.hashes(units)), i, i + gram))
        grams, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        return grams[n >= OFTEN], n[n >= OFTEN]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, seen = [], 0, set()

        def said() -> pa.RecordBatch:
            grams, n = counted(kept)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0), CHUNK):
                units, first = symbols.units(data, offsets)
                found, row, whole = find_runs(symbols.hashes(units), first, length, gram)
                new = np.zeros(len(whole), bool)
                for k in np.flatnonzero(first[1:] - first[:-1] >= length).tolist():
                    new[k] = (key := int(whole[k])) not in seen
                    seen.add(key)
                found, row = found[new[row]], row[new[row]]
                kept.append((units, found["anchor"], first[row] + found["lo"].astype(np.int64), found["n"].astype(np.int64) - 1 + length))
                size += len(data)
                if size >= COUNTED_BYTES:
                    yield said()
                    kept, size, seen = [], 0, set()
        if kept:
            yield said()

    return scan


def common_grams(docs: DataFrame, symbols: Symbols, length: int, gram: int) -> np.ndarray:
    """Up to COMMON grams of those that stand most often, for the shared set."""
    counts = materialise(docs.select("text").mapInArrow(_often(symbols, length, gram), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    steps = sorted(((r["step"], r["grams"]) for r in counts.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("grams")).collect()), reverse=True)
    least, total = None, 0
    for step, grams in steps:
        total += grams
        if total > COMMON:
            break
        least = step
    if least is None:
        return np.zeros(0, np.uint64)
    return counts.where(F.floor(F.log2("n")) >= least).select("gram").toArrow()["gram"].to_numpy().view(np.uint64)  # COMMON at most


def _two(r: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of runs sorted by anchor, content, doc: which are decided (two of each content; unless both, the second has a larger doc), and the content's number."""
    new = np.ones(len(r), bool)
    new[1:] = (r["content"][1:] != r["content"][:-1]) | (r["anchor"][1:] != r["anchor"][:-1])
    of = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    keep = new.copy()
    if both:
        second = at + 1
    else:
        second = at + np.bincount(of, r["doc"] == r["doc"][at][of], len(at)).astype(np.int64)
    size = np.bincount(of, minlength=len(at))
    second = second[second < at + size]
    keep[second] = True
    return keep, of


def _scan(symbols: Symbols, length: int, gram: int, buckets: int, both: bool, sent):
    """Kinds for the exchange: 0 runs, 1 runs that follow an equal one, 2 copies of whole texts that follow an equal one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, dealer = Common(sent.value), Dealer(buckets)
        seen: dict[tuple[int, int], list[tuple[int, int]]] = {}  # one entry for each long text of the task
        waiting: list[np.ndarray] = []

        def deal() -> Iterator[pa.RecordBatch]:
            r = np.concatenate(waiting)
            r = r[np.lexsort((r["lo"], r["ver"], r["doc"], r["content"], r["anchor"]))]
            keep, of = _two(r, both)
            more = np.zeros(int(of[-1]) + 1, bool) if len(of) else np.zeros(0, bool)
            more[of[~keep]] = True
            r["more"] = more[of]
            yield from dealer.add(0, r["anchor"][keep] >> np.uint64(16), r[keep])
            yield from dealer.add(1, r["doc"][~keep].astype(np.uint64), r[~keep])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            vers = batch.column(1).to_numpy()
            for at, to, data, offsets in chunks(batch.column(2), CHUNK):
                units, first = symbols.units(data, offsets)
                found, row, whole = find_runs(symbols.hashes(units), first, length, gram, common)
                send, copies = np.ones(to - at, bool), []
                for k in np.flatnonzero(first[1:] - first[:-1] >= length).tolist():
                    key, own = (int(whole[k]), int(first[k + 1] - first[k])), (int(ids[at + k]), int(vers[at + k]))
                    sent_ = seen.setdefault(key, [])
                    if both:
                        like = sent_[1] if len(sent_) > 1 else None
                    else:  # the smallest doc of those sent, or one that is larger than another one sent
                        least = min((x[0] for x in sent_), default=NO_ID)
                        like = next((x for x in sent_ if (x[0] > least) == (own[0] > least)), None) if sent_ and own[0] >= least else None
                    if like is None:
                        sent_.append(own)
                        del sent_[:-2]
                    else:
                        send[k] = False
                        if like != own:
                            copies.append((*own, *like))
                keep = send[row]
                found, row = found[keep], row[keep]
                found["doc"], found["ver"] = ids[at + row], vers[at + row]
                waiting.append(found)
                if sum(x.nbytes for x in waiting) > RUNS_BYTES:
                    yield from deal()
                    waiting.clear()
                if copies:
                    c = np.array(copies, COPY)
                    yield from dealer.add(2, c["doc"].astype(np.uint64), c)
        if waiting:
            yield from deal()
        yield from dealer.flush()

    return scan


MET = "kind int, doc long, ver long, lo long, n long, anchor long, content long, at int, target boolean, many boolean"


def _met(*parts: tuple) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_())
    names = [c.split()[0] for c in MET.split(", ")]
    full = [[np.broadcast_to(np.asarray(c), len(p[1])) for c in p] for p in parts]
    return pa.table({n: pa.array(np.concatenate([p[k] for p in full]).astype(t.to_pandas_dtype())) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def _meet(length: int, both: bool):
    """From a bucket of runs: kind 1, runs to be decided with their symbols; kind 2, runs that follow an equal one; kind 3, copies."""

    def work(table: pa.Table) -> pa.Table:
        r, f, c = unpack(table, 0, RUN), unpack(table, 1, RUN), unpack(table, 2, COPY)
        r = r[np.lexsort((r["lo"], r["ver"], r["doc"], r["content"], r["anchor"]))]
        keep, of = _two(r, both)
        anchor = np.cumsum(np.concatenate(([0], r["anchor"][1:] != r["anchor"][:-1]))) if len(r) else np.zeros(0, np.int64)
        many = np.zeros(int(of[-1]) + 1 if len(r) else 0, bool)
        many[of[~keep | r["more"]]] = True
        if both:
            look, target = (np.bincount(anchor) > 1)[anchor] if len(r) else np.zeros(0, bool), np.ones(len(r), bool)
        else:
            at, _ = runs(anchor)
            least, most = (np.minimum.reduceat(r["doc"], at), np.maximum.reduceat(r["doc"], at)) if len(r) else (np.zeros(0, np.int64),) * 2
            look, target = (least < most)[anchor], r["doc"] > least[anchor]
        q, later = look & keep, r[~keep]
        ask, follow, none = r[q], np.concatenate((f, later)), np.zeros(len(c), np.int64)
        return _met(
            (1, ask["doc"], ask["ver"], ask["lo"], ask["n"], ask["anchor"].view(np.int64) if len(ask) else none[:0], np.ascontiguousarray(ask["content"]).view(np.int64), ask["at"], target[q], many[of[q]]),
            (2, follow["doc"], follow["ver"], follow["lo"], follow["n"], np.ascontiguousarray(follow["anchor"]).view(np.int64), np.ascontiguousarray(follow["content"]).view(np.int64), 0, False, False),
            (3, c["doc"], c["ver"], c["like"], c["like_ver"], none, none, 0, False, False),
        )

    return work


def _fetch(symbols: Symbols, length: int):
    """(doc, ver, text, runs) -> the symbols of each run, for the second exchange. part: the task that read the text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, vers, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
            starts = asked.offsets.to_numpy()
            flat = asked.values
            lo, n, anchor, content, at_, target, many = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(7))
            for at, to, data, offsets in chunks(batch.column(2), CHUNK):
                if symbols.words:  # as text, which is shorter than hashes
                    from_, upto, first = word_spans(data, offsets)
                else:
                    from_, upto, first = np.arange(len(data)), np.arange(1, len(data) + 1), offsets
                raw, rows = data.tobytes(), []
                for k in range(at, to):
                    base = int(first[k - at])
                    for j in range(starts[k], starts[k + 1]):
                        s = base + int(lo[j])
                        own = raw[from_[s] : upto[s + int(n[j]) - 2 + length]]
                        rows.append((int(anchor[j]), int(content[j]), ids[k], vers[k], int(lo[j]), int(n[j]), int(at_[j]), bool(target[j]), bool(many[j]), part, own))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary())
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names=[c.split()[0] for c in FETCHED.split(", ")])

    return scan


FETCHED = "anchor long, content long, doc long, ver long, lo long, n long, at int, target boolean, many boolean, part int, symbols binary"
DECIDED = "kind int, anchor long, content long, doc long, ver long, later boolean, lo long, n long"


class Decisions:
    """What a bucket of fetched runs gives: kind 0, repeated windows (doc, ver, lo, n); kind 1, the same for a content that
    others follow, lo relative to the run, with its smallest doc and whether it holds for larger docs (null: for all)."""

    def __init__(self, table: pa.Table, both: bool):
        self.both, self.rows = both, []
        self.anchor, self.content, self.doc, self.ver, self.lo, self.at = (table[c].to_numpy() for c in ("anchor", "content", "doc", "ver", "lo", "at"))
        self.target, self.many = (table[c].to_numpy(zero_copy_only=False) for c in ("target", "many"))
        self.part, self.symbols = table["part"].to_numpy(), table["symbols"]

    def add(self, rows: list[int], found: list[np.ndarray]) -> None:
        """Whole anchors: which windows of each run are repeated."""
        first: dict[tuple[int, int], tuple[int, int]] = {}
        for k in rows:
            if self.many[k]:
                key, own = (int(self.anchor[k]), int(self.content[k])), (int(self.doc[k]), k)
                first[key] = min(own, first.get(key, own))
        said = set()
        for k, windows in zip(rows, found, strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([False], windows, [False])).astype(np.int8))).reshape(-1, 2).tolist()
            anchor, content, doc, ver, lo = (int(x[k]) for x in (self.anchor, self.content, self.doc, self.ver, self.lo))
            if self.target[k]:
                self.rows += [(0, 0, 0, doc, ver, None, lo + s, e - s) for s, e in edges]
            if self.many[k]:
                least, one = first[anchor, content]
                later = None if self.both else doc > least
                if (anchor, content, later) not in said and (not self.both or k == one):
                    said.add((anchor, content, later))
                    self.rows += [(1, anchor, content, least, 0, later, s, e - s) for s, e in edges]

    def table(self) -> pa.Table:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        cols = list(zip(*self.rows, strict=True)) or [()] * len(kinds)
        return pa.table({c.split()[0]: pa.array(v, t) for c, v, t in zip(DECIDED.split(", "), cols, kinds, strict=True)})


def versioned(docs: DataFrame) -> DataFrame:
    """(doc, ver, text): a null doc_id counts as the largest, a null text as empty; ver tells apart texts that share a doc_id."""
    text: Column = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("ver"), text.alias("text"))


def repeated_windows(docs: DataFrame, size: int, words: bool, length: int, both: bool, decide) -> DataFrame:
    """Marks (doc, ver, marks [(lo, n)]): windows starting at lo .. lo + n - 1 of that document are repeated.

    size: bytes of all texts, for the number of buckets. both: a window is repeated if it stands anywhere else; else only
    if it stands in a smaller doc. decide: from a bucket of fetched runs to a table of decisions.
    """
    spark = docs.sparkSession
    gram = gram_of(length)
    symbols = Symbols(words)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    expected = 2 * (size / 6 if words else size) / (length - gram) * RUN.itemsize
    buckets = max(least, int(expected) // BUCKET_BYTES)
    sent = spark.sparkContext.broadcast(common_grams(docs, symbols, length, gram))
    met = materialise(docs.mapInArrow(_scan(symbols, length, gram, buckets, both, sent), Dealer.ddl).groupBy("bucket").applyInArrow(_meet(length, both), MET))
    asked = met.where("kind = 1").groupBy("doc", "ver").agg(F.collect_list(F.struct("lo", "n", "anchor", "content", "at", "target", "many")).alias("asked"))
    look = met.where("kind = 1").agg(F.sum(F.col("n") + length)).first()[0] or 0
    pieces = max(least, look * (6 if words else 1) // CLOSER_BYTES)
    fetched = docs.join(asked, ["doc", "ver"]).select("doc", "ver", "text", "asked").mapInArrow(_fetch(symbols, length), FETCHED)
    decided = materialise(fetched.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(pieces))).groupBy("bucket").applyInArrow(decide, DECIDED))
    follow = met.where("kind = 2").select("anchor", "content", "doc", "ver", "lo").alias("f")
    said = decided.where("kind = 1").alias("s")
    on = (F.col("f.anchor") == F.col("s.anchor")) & (F.col("f.content") == F.col("s.content"))
    follow = follow.join(said, on if both else on & ((F.col("f.doc") > F.col("s.doc")) == F.col("s.later"))).select("f.doc", "f.ver", (F.col("f.lo") + F.col("s.lo")).alias("lo"), "s.n")
    marks = decided.where("kind = 0").select("doc", "ver", "lo", "n").unionByName(follow).groupBy("doc", "ver").agg(F.collect_list(F.struct("lo", "n")).alias("marks"))
    copies = met.where("kind = 3").select("doc", "ver", F.col("lo").alias("like"), F.col("n").alias("like_ver")).distinct().alias("c")
    copied = copies.join(marks.alias("m"), (F.col("c.like") == F.col("m.doc")) & (F.col("c.like_ver") == F.col("m.ver"))).select("c.doc", "c.ver", "m.marks")
    return marks.unionByName(copied).groupBy("doc", "ver").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def covered(marks: pa.Array, row: int, count: int, length: int) -> np.ndarray:
    """Which of a row's symbols its marked windows cover."""
    edge = np.zeros(count + 1, np.int32)
    if marks[row].is_valid:
        v = marks[row].values
        lo, n = v.field(0).to_numpy(zero_copy_only=False), v.field(1).to_numpy(zero_copy_only=False)
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + n - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
