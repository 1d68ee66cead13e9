"""Jaccard join of documents on word n-grams, as a grouped prefix join, and the components of its links.

Documents whose shingle sets have the same prefix and the same size form one group. An inverted index of prefix
shingles proposes pairs of groups; sizes and the number of prefix shingles that two groups share filter them, and only
then are the groups expanded to their documents and the members verified on whole sets. Prefixes follow the order
(frequency, hash), frequencies from a counting sketch of fixed size, so a shingle that very many documents share stands
last and is in almost no prefix. Frequencies only shape the order: the result is exact for every sketch.

Pairs are counted in posting lists of up to SHORT groups; a longer list is verified as a whole. A piece of work is
verified in one task that joins its members to components as it goes, so that no pair is written for members that are
already connected; lists of more than BLOCK members are cut into blocks and every pair of blocks is one piece of work. Documents with equal sets are one class from the first scan on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placefabric.llm.arrays import chunks, mix, shingle_sets, word_hashes
from placefabric.llm.components import components, materialise
from placefabric.llm.exchange import Dealer, runs, unpack

SKETCH = 1 << 20
SKETCH_BLOCK = 1 << 16
BLOCK = 4096
SHORT = 16  # groups of a posting list whose pairs are counted; longer lists are verified as a whole
PAIRS = 1 << 19  # pairs counted at a time
BUCKET_BYTES = 24 << 20

_POSTING = np.dtype([("token", "<u8"), ("group", "<u8"), ("size", "<u4")])
_MEMBER = np.dtype([("group", "<u8"), ("sig", "<u8"), ("doc", "<i8"), ("size", "<u4")])


def _signature(s: np.ndarray) -> tuple[int, int]:
    return int(s.sum(dtype=np.uint64).astype(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))


def _prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1


def _describe(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for at, to, data, offsets in chunks(batch.column(1)):
                words, first = word_hashes(data, offsets, True)
                sets = list(shingle_sets(words, first, width))
                rows += [(len(s), *_signature(s)) for s in sets]
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            n = len(rows)
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.record_batch([pa.array([0] * n, pa.int32()), batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.nulls(n, pa.binary())], schema=schema)
        parts = [(i, counts[i * SKETCH_BLOCK : (i + 1) * SKETCH_BLOCK]) for i in range(SKETCH // SKETCH_BLOCK)]
        parts = [(i, c) for i, c in parts if c.any()]
        n = len(parts)
        yield pa.record_batch([pa.array([1] * n, pa.int32()), pa.array([i for i, _ in parts], pa.int64()), *[pa.nulls(n, pa.int64())] * 3, pa.array([c.tobytes() for _, c in parts], pa.binary())], schema=schema)

    return scan


def _sum_sketch(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table["data"].to_pylist())
    return pa.table({"block": pa.array([table["doc_id"][0].as_py()], pa.int64()), "data": pa.array([total.tobytes()], pa.binary())})


def _post(width: int, num: int, den: int, buckets: int, sketch):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, dealer, seen = sketch.value, Dealer(buckets), {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, to, data, offsets in chunks(batch.column(1)):
                words, first = word_hashes(data, offsets, True)
                tokens, members = [], []
                for row, s in enumerate(shingle_sets(words, first, width), at):
                    if not len(s) or not known[row]:
                        continue
                    sig = _signature(s)
                    if seen.get(sig, 1 << 63) <= ids[row]:
                        continue  # an equal set with a smaller doc_id stands for it
                    seen[sig] = int(ids[row])
                    prefix = s[np.lexsort((s, counts[(s & np.uint64(SKETCH - 1)).astype(np.int64)]))[: _prefix_length(len(s), num, den)]]
                    group = mix(np.array([mix(prefix).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0]
                    part = np.empty(len(prefix), _POSTING)
                    part["token"], part["group"], part["size"] = prefix, group, len(s)
                    tokens.append(part)
                    members.append((group, np.uint64(sig[0] & (1 << 64) - 1) ^ mix(np.array([sig[1]], np.int64).view(np.uint64))[0], ids[row], len(s)))
                if members:
                    tokens, members = np.concatenate(tokens), np.array(members, _MEMBER)
                    yield from dealer.add(0, mix(tokens["token"]) >> np.uint64(8), tokens)
                    yield from dealer.add(1, mix(members["group"]) >> np.uint64(8), members)
        yield from dealer.flush()

    return scan


def _count_pairs(dense: np.ndarray, size: np.ndarray, at: np.ndarray, to: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups of fitting sizes in lists of up to SHORT, as left * groups + right, and in how many lists they stand.

    Pairs are counted PAIRS at a time, so memory follows the distinct pairs.
    """
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for m in np.unique(to - at).tolist():
        if m > SHORT:
            continue
        i, j = np.triu_indices(m, 1)
        starts = at[to - at == m]
        step = max(1, PAIRS // len(i))
        for k in range(0, len(starts), step):
            block = dense[starts[k : k + step, None] + np.arange(m)]
            left, right = block[:, i].ravel(), block[:, j].ravel()
            ok = np.minimum(size[left], size[right]) * den >= np.maximum(size[left], size[right]) * num
            left, right = left[ok], right[ok]
            new, n = np.unique(np.minimum(left, right) * len(size) + np.maximum(left, right), return_counts=True)
            both = np.concatenate((keys, new))
            order = np.argsort(both, kind="stable")
            first, end = runs(both[order])
            keys, counts = both[order][first], np.add.reduceat(np.concatenate((counts, n))[order], first) if len(first) else counts
    return keys, counts


def _lists(num: int, den: int):
    """From a bucket of postings: what its lists propose, and the members of its groups.

    kind 0: (list, group) of long lists, one for each set of groups; kind 1: (group, document, size); kind 2: pairs of
    groups with the number of shingles that they share in short lists.
    """

    def work(table: pa.Table) -> pa.Table:
        p = unpack(table, 0, _POSTING)
        p = np.unique(p) if len(p) else p
        near = np.zeros(len(p), bool)
        order = np.lexsort((p["size"], p["token"]))
        token, size = p["token"][order], p["size"][order].astype(np.int64)
        fits = (token[1:] == token[:-1]) & (size[:-1] * den >= size[1:] * num)
        near[order[1:][fits]] = near[order[:-1][fits]] = True
        p = p[near]
        at, to = runs(p["token"])
        lists, groups, found, shared = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
        if len(p):
            names, first, dense = np.unique(p["group"], return_index=True, return_inverse=True)
            size = p["size"][first].astype(np.int64)
            keys, shared = _count_pairs(dense, size, at, to, num, den)
            i, j = keys // len(names), keys % len(names)
            found = np.stack((names[i].view(np.int64), names[j].view(np.int64), size[i], size[j]), axis=1)
            long_ = to - at > SHORT
            if long_.any():
                sums = (np.add.reduceat(mix(p["group"]), at) ^ mix((to - at).astype(np.uint64)))[long_]
                _, one = np.unique(sums, return_index=True)
                first, n = at[long_][one], (to - at)[long_][one]
                lists = np.repeat(sums[one], n)
                groups = p["group"][np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        m = unpack(table, 1, _MEMBER)
        m = m[np.lexsort((m["doc"], m["sig"], m["group"]))]
        m = m[np.concatenate(([True], (m["sig"][1:] != m["sig"][:-1]) | (m["group"][1:] != m["group"][:-1])))] if len(m) else m
        at, to = runs(m["group"])
        several = np.repeat(to - at > 1, to - at)
        lists = np.concatenate((lists, m["group"][several]))  # a group of several classes is a list of its own
        groups = np.concatenate((groups, m["group"][several]))
        listed = np.unique(np.stack((lists, groups)), axis=1) if len(lists) else np.zeros((2, 0), np.uint64)
        k, n, q = listed.shape[1], len(m), len(found)
        column = lambda a, b, c: pa.array(np.concatenate((a, b, c)).astype(np.int64))
        none = np.zeros
        return pa.table({
            "kind": pa.array(np.repeat(np.array([0, 1, 2], np.int32), [k, n, q])),
            "list": column(listed[0].view(np.int64), none(n, np.int64), found[:, 0]),
            "grp": column(listed[1].view(np.int64), m["group"].astype(np.int64), found[:, 1]),
            "doc": column(none(k, np.int64), m["doc"], found[:, 2]),
            "size": column(none(k, np.int64), m["size"], found[:, 3]),
            "shared": column(none(k, np.int64), none(n, np.int64), shared),
        })

    return work


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links of similarity num/den or more that connect the sets just as all such links do."""
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable").tolist()
    forest, found = _Forest(len(sets)), []

    def alike(a: int, b: int) -> bool:
        x, y = len(sets[a]), len(sets[b])
        if min(x, y) * den < max(x, y) * num:
            return False
        both = np.concatenate((sets[a], sets[b]))
        both.sort()
        same = int((both[1:] == both[:-1]).sum())
        return same * den >= num * (x + y - same)

    few = len(sets) <= 6
    for k, b in enumerate(order):
        for a in order[max(0, k - (6 if few else 2)) : k]:
            if forest.root(a) != forest.root(b) and alike(a, b):
                forest.link(a, b)
                found.append((a, b))
    if few:
        return found
    # every document outside the largest component so far is compared with all, through an index of the members
    roots = np.array([forest.root(x) for x in range(len(sets))])
    largest = np.bincount(roots).argmax()
    rest = [x for x in order if roots[x] != largest]
    if rest:
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], owner[by]
        for x in rest:
            at, to = np.searchsorted(tokens, sets[x], "left"), np.searchsorted(tokens, sets[x], "right")
            n = to - at
            hits = owner[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            same = np.bincount(hits, minlength=len(sets))
            for y in np.flatnonzero(same * den >= num * (sizes + sizes[x] - same)).tolist():
                if y != x and forest.link(x, y):
                    found.append((x, y))
    return found


def _verify(width: int, num: int, den: int):
    """From a bucket of pieces of work (work, i, j, doc, text): the spanning links of each piece."""

    def work(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy() for c in ("j", "i", "work")])
        docs, order = table["doc"].to_numpy(), np.lexsort(keys)
        keys = keys[:, order]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        out: list[tuple[int, int]] = []
        for rows in np.split(order, cuts):
            if len(rows) > 1:
                sets: list[np.ndarray] = []
                for _, _, data, offsets in chunks(table["text"].take(pa.array(rows))):
                    sets += shingle_sets(*word_hashes(data, offsets, True), width)
                out += [(int(docs[rows[x]]), int(docs[rows[y]])) for x, y in spanning_links(sets, num, den)]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return work


def _same(x: np.ndarray, tokens: np.ndarray, owner: np.ndarray, m: int) -> np.ndarray:
    """How many tokens of x each of m sets holds, a million hits at a time."""
    at, to = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
    n = to - at
    parts = np.cumsum(n) // (1 << 20)
    same = np.zeros(m, np.int64)
    for lo, hi in zip(*runs(parts), strict=True):
        k = n[lo:hi]
        same += np.bincount(owner[np.repeat(at[lo:hi] - (np.cumsum(k) - k), k) + np.arange(k.sum())], minlength=m)
    return same


def _verify_all(width: int, num: int, den: int):
    """From a bucket of pieces of work (work, i, j, doc, own, n, works, text): kind 0, links (a, b) that span the piece;
    kind 1, (document, sum of n over its links). A link counts in one piece alone, that of the smallest work of both."""

    def work(table: pa.Table) -> pa.Table:
        keys = np.stack([table[c].to_numpy() for c in ("j", "i", "work")])
        order = np.lexsort(keys)
        keys = keys[:, order]
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        kinds, left, right = [], [], []
        for rows in np.split(order, cuts):
            m = len(rows)
            if m < 2:
                continue
            part = table.take(pa.array(rows))
            docs, own, n = (part[c].to_numpy() for c in ("doc", "own", "n"))
            here, i, j = (part[c][0].as_py() for c in ("work", "i", "j"))
            works, holders = [[w for w in ws if w < here] for ws in part["works"].to_pylist()], {}
            for k, ws in enumerate(works):
                for w in ws:
                    holders.setdefault(w, []).append(k)
            holders = {w: np.array(ks) for w, ks in holders.items() if len(ks) > 1}
            sets: list[np.ndarray] = []
            for _, _, data, offsets in chunks(part["text"]):
                sets += shingle_sets(*word_hashes(data, offsets, True), width)
            sizes = np.array([len(x) for x in sets], np.int64)
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
            by = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[by], owner[by]
            forest, linked = _Forest(m), np.zeros(m, np.int64)
            for x in range(m):
                same = _same(sets[x], tokens, owner, m)
                like = same * den >= num * (sizes + sizes[x] - same)
                like[: x + 1] = False
                like &= (np.minimum(own, own[x]) == i) & (np.maximum(own, own[x]) == j)
                for w in works[x]:
                    if w in holders:
                        like[holders[w]] = False
                ys = np.flatnonzero(like)
                linked[x] += n[ys].sum()
                linked[ys] += n[x]
                for y in ys.tolist():
                    if forest.link(x, y):
                        kinds.append(0)
                        left.append(int(docs[x]))
                        right.append(int(docs[y]))
            some = np.flatnonzero(linked)
            kinds += [1] * len(some)
            left += docs[some].tolist()
            right += linked[some].tolist()
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return work


def ngram_links(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """docs as in ngram_components -> a row for each row: doc_id, n_shingles, component_id, copies, n_links.

    Every pair that the index proposes is verified. n_links counts the other rows with a doc_id whose sets have a Jaccard
    similarity of num/den or more to the row's, equal sets among them; it is 0 for an empty set or a null doc_id.
    """
    return ngram_components(docs, width, num, den, every=True).select("doc_id", "n_shingles", "component_id", "copies", "n_links")


def ngram_components(docs: DataFrame, width: int = 5, num: int = 8, den: int = 10, every: bool = False) -> DataFrame:
    """docs (doc_id long, text string, ...) -> a row for each row: doc_id, n_shingles (distinct ones), component_id, copies.

    Links join documents whose shingle sets have a Jaccard similarity of num/den or more; component_id is the smallest
    doc_id that links reach. copies counts the documents with the same set. Null and wordless texts have the empty set,
    which links with nothing. Rows that share a doc_id are versions of one document and share its component. A null
    doc_id has a null component. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = materialise(docs.mapInArrow(_describe(width), "kind int, doc_id long, size long, s1 long, s2 long, data binary"))
    rows = described.where("kind = 0").select("doc_id", "size", "s1", "s2")
    words = rows.agg(F.sum("size")).first()[0] or 0
    table = np.zeros(SKETCH, np.int64)
    for block, data in described.where("kind = 1").groupBy("doc_id").applyInArrow(_sum_sketch, "block long, data binary").collect():  # SKETCH entries at most
        table[block * SKETCH_BLOCK : (block + 1) * SKETCH_BLOCK] = np.frombuffer(data, np.int64)
    sketch = spark.sparkContext.broadcast(np.minimum(table, np.iinfo(np.int32).max).astype(np.int32))  # 4 MB at every input size
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, int(words * (den - num) / den * _POSTING.itemsize) // BUCKET_BYTES)
    posted = docs.mapInArrow(_post(width, num, den, buckets, sketch), Dealer.ddl)
    proposed = materialise(posted.groupBy("bucket").applyInArrow(_lists(num, den), "kind int, list long, grp long, doc long, size long, shared long"))

    members = proposed.where("kind = 1").select("grp", "doc", "size")
    x, y = F.col("x"), F.col("y")
    need = F.ceil(num * (x + y) / (num + den)) - F.greatest(F.ceil(num * x / den), F.ceil(num * y / den)) + 1
    pairs = proposed.where("kind = 2").groupBy("list", "grp").agg(F.sum("shared").alias("shared"), F.max("doc").alias("x"), F.max("size").alias("y")).where(F.col("shared") >= need)
    stars = pairs.select("list", F.explode(F.array("list", "grp")).alias("grp"))
    listed = proposed.where("kind = 0").select("list", "grp").unionByName(stars).distinct().join(members, "grp").select("list", "doc", "size")
    counts = listed.groupBy("list").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    listed = listed.join(counts, "list").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    pieces = listed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pieces = pieces.select("doc", "size", F.struct(F.col("list").alias("work"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own").alias("piece"))
    by_doc = materialise(pieces.groupBy("doc").agg(F.collect_list("piece").alias("pieces"), F.sum("size").alias("weight")))
    bytes_ = 8 * (by_doc.agg(F.sum("weight")).first()[0] or 0)
    tasks = max(least, bytes_ // BUCKET_BYTES)
    # texts travel, not their sets: they take fewer bytes once compressed
    shipped = by_doc.join(docs, F.col("doc") == F.col("doc_id")).select("doc", "text", F.explode("pieces").alias("piece")).select("piece.*", "doc", "text")
    bucketed = F.pmod(F.xxhash64("work", "i", "j"), F.lit(tasks))
    classes = rows.where("size > 0 and doc_id is not null").groupBy("s1", "s2", "size").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"))
    if every:
        full = by_doc.join(docs, F.col("doc") == F.col("doc_id")).join(classes.select(F.col("head").alias("doc_id"), "n"), "doc_id")
        full = full.select("doc", "text", "n", F.array_distinct(F.transform("pieces", lambda p: p["work"])).alias("works"), F.explode("pieces").alias("piece")).select("piece.*", "doc", "n", "works", "text")
        found = materialise(full.withColumn("bucket", bucketed).groupBy("bucket").applyInArrow(_verify_all(width, num, den), "kind int, a long, b long"))
        links = found.where("kind = 0").select("a", "b")
        degrees = found.where("kind = 1").groupBy(F.col("a").alias("head")).agg(F.sum("b").alias("linked"))
        classes = classes.join(degrees, "head", "left").withColumn("linked", F.coalesce("linked", F.lit(0)) + F.col("n") - 1)
    else:
        links = shipped.withColumn("bucket", bucketed).groupBy("bucket").applyInArrow(_verify(width, num, den), "a long, b long")
    nodes = components(links)

    classes = classes.join(nodes, F.col("head") == F.col("node"), "left").select("s1", "s2", "size", F.coalesce("component", "head").alias("component"), "n", *["linked"] * every)
    out = rows.join(classes, ["s1", "s2", "size"], "left")
    out = out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce("n", F.lit(1)).alias("copies"), *[F.when(F.col("doc_id").isNotNull(), F.col("linked")).otherwise(0).alias("_l")] * every)
    return out.withColumn("n_links", F.coalesce("_l", F.lit(0))).drop("_l") if every else out
