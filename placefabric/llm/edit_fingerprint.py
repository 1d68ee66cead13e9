"""Document fingerprints by randomised edit embedding.

A shared random walk reads the text: at step j it stands on a character c, writes it, and moves on by r(j, c), 0 or 1, a
shared random bit. Texts within a small edit distance fall into step again after an edit, so their written strings have a
small Hamming distance. The fingerprint samples the written string at shared steps, all of the first 256 and BAND of
every later octave, as four-bit hashes in hex. Likeness weighs octaves by the steps they stand for.

All texts of a chunk walk in lockstep as arrays. A text's edited version shares its beginning, so its walk goes on from
the state in which the edit begins.

near_classes finds near copies anywhere: samples of BITS positions inside an octave are band keys, texts that share a key
are candidates, and a candidate pair counts when its edit distance is verified.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placefabric.llm.arrays import memo, mix, prefix_hash, span_hash
from placefabric.llm.components import components, materialise

FIRST = 256
BAND = 128
PERIOD = 1 << 13
CHUNK_CHARS = 6 << 20
PART_BYTES = 16 << 20
MOST_PARTS = 1 << 13  # ranges of ids; beyond that many times PART_BYTES they grow
PER_PART = 32  # sampled rows of a range, from which its border is taken
PREFIX = 64  # characters of a text that part equal ids, null among them
BITS = 10  # sampled positions of a band key
KEYS = 12  # of an octave
TOP = 7  # octaves of a text that have keys: the longest of its walk that are complete
SMALL = 12  # members of a band up to which all pairs are candidates
NEAR = 0.03  # edits for a character of the longer text
NO_ID = (1 << 63) - 1
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@memo
def bits() -> np.ndarray:
    """r(j, c) for a period of steps and 256 character classes."""
    return (mix(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(0xC0FFEE)) & np.uint64(1)).astype(np.uint8).reshape(PERIOD, 256)


@memo
def sampled(octaves: int) -> np.ndarray:
    """The sampled steps below 256 << octaves, in order."""
    out = [np.arange(FIRST)]
    for k in range(octaves):
        lo = FIRST << k
        out.append(lo + np.sort(np.argsort(mix(np.arange(lo, dtype=np.uint64) + np.uint64(k << 40)), kind="stable")[:BAND]))
    return np.concatenate(out)


def octaves_for(steps: int) -> int:
    k = 0
    while FIRST << k < steps:
        k += 1
    return k


def nibbles(classes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return (mix(classes.astype(np.uint64) + (steps.astype(np.uint64) << np.uint64(8)) + np.uint64(77)) & np.uint64(15)).astype(np.uint8)


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (mix(points.astype(np.uint64) + np.uint64(5)) & np.uint64(255)).astype(np.uint8) if len(points) else np.zeros(0, np.uint8)


STRIDE = 64  # steps between two looks at who has arrived


def walk(x: np.ndarray, start: np.ndarray, end: np.ndarray, step: np.ndarray, stop: np.ndarray, slots: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Walks all rows from x[start] to x[end], row k from step[k] on, writing into out[k, slot].

    Returns for each row the step in which it first stands on `stop`, which must not lie beyond its end. x must reach
    STRIDE entries beyond every end. A row's places of one stride are kept, so that arrivals are dated afterwards.
    """
    table = bits().ravel()
    at_stop = step.copy()
    rows = np.flatnonzero(start < end)
    pos, j, to, goal = start[rows].astype(np.int64), step[rows].astype(np.int64), end[rows], stop[rows]
    slot_of = np.full(int(slots[-1]) + 2 * STRIDE, -1, np.int32)
    slot_of[slots] = np.arange(len(slots))
    ahead = np.arange(STRIDE)[:, None]
    while len(rows):
        steps = j + ahead
        base = (steps & (PERIOD - 1)) << 8
        places = np.empty((STRIDE + 1, len(rows)), np.int64)
        for t in range(STRIDE):
            places[t] = pos
            pos = pos + table[base[t] + x[pos]]
        places[STRIDE] = pos
        slot = slot_of[np.minimum(steps, len(slot_of) - 1)]
        t, k = np.nonzero((slot >= 0) & (places[:-1] < to))
        out[rows[k], slot[t, k]] = nibbles(x[places[t, k]], steps[t, k])
        arrived = np.flatnonzero((places[0] < goal) & (pos >= goal))
        at_stop[rows[arrived]] = j[arrived] + (places[:, arrived] < goal[arrived]).sum(axis=0)
        j = j + STRIDE
        keep = pos < to
        rows, pos, j, to, goal = rows[keep], pos[keep], j[keep], to[keep], goal[keep]
    return at_stop


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(sizes)
    return np.concatenate([*texts, np.zeros(2 * STRIDE, np.uint8)]), end - sizes, end


def fingerprints(texts: list[str], edits: list[str] | None = None, kept: list[int] | None = None) -> tuple[list[str], list[str]]:
    """Fingerprints of texts, and of text[:kept] + edit for each."""
    classes = [char_classes(t) for t in texts]
    tails = [char_classes(e) for e in edits or []]
    x, start, end = _joined(classes)
    most = max([len(c) for c in classes] + [k + len(t) for k, t in zip(kept or [], tails, strict=True)], default=0)
    octaves = octaves_for(3 * most + 64 * 8)  # a walk takes two steps a character; longer ones keep their sampled steps
    slots = sampled(octaves)
    out = np.full((len(texts), len(slots)), 16, np.uint8)
    zero = np.zeros(len(texts), np.int64)
    stop = start + np.array(kept, np.int64) if kept is not None else end
    at_stop = walk(x, start, end, zero, stop, slots, out)

    def said(m: np.ndarray) -> list[str]:
        return [_HEX[r[: np.count_nonzero(r < 16)]].tobytes().decode() for r in m]  # the slots that a row reached are its first

    own = said(out)
    if edits is None:
        return own, []
    x, start, end = _joined(tails)
    edited = np.where(slots[None, :] < at_stop[:, None], out, 16).astype(np.uint8)
    walk(x, start, end, at_stop, end, slots, edited)
    return own, said(edited)


def likeness(a: str, b: str) -> float:
    """0..1: the weighted share of sampled steps on which two fingerprints agree, with chance agreement taken off."""
    n, m = max(len(a), len(b)), min(len(a), len(b))
    if not n:
        return 1.0
    weights = step_weights(n)
    same = np.frombuffer(a[:m].encode(), np.uint8) == np.frombuffer(b[:m].encode(), np.uint8)
    share = float(weights[:m][same].sum() / weights.sum())
    return max(0.0, min(1.0, (share - 1 / 16) / (15 / 16)))


@memo
def _weights(octaves: int) -> np.ndarray:
    return np.concatenate([np.ones(FIRST), *(np.full(BAND, (FIRST << k) / BAND) for k in range(octaves))])


def step_weights(n: int) -> np.ndarray:
    return _weights(max(0, -(-(n - FIRST) // BAND)))[:n]


def _emit(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = (id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, guest, doc, text) in order of part, guest, doc, text; the row after a row of its part is the next document."""
    waiting: list[tuple[int, bool, int, str]] = []

    def work(rows: list[tuple[int, bool, int, str]]) -> Iterator[pa.RecordBatch]:
        # each row with its successor in the part; guests only follow, and their successors are of no use
        texts = [r[3] for r in rows]
        follows = [k for k in range(len(rows) - 1) if not rows[k][1] and rows[k + 1][0] == rows[k][0]]
        quarter = [len(t) // 4 for t in texts]
        nexts = ["" for _ in rows]
        for k in follows:
            nexts[k] = texts[k + 1][: quarter[k]]
        own, edited = fingerprints(texts, nexts, [len(t) - q for t, q in zip(texts, quarter, strict=True)])
        out = []
        for k in follows:
            whole = texts[k][: len(texts[k]) - quarter[k]] + nexts[k]
            digest = hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((None if rows[k][2] == NO_ID else rows[k][2], len(texts[k]), digest, own[k], edited[k], likeness(own[k], edited[k]), likeness(own[k], own[k + 1])))
        for i in range(0, len(out), 2000):
            yield _emit(out[i : i + 2000], NAMES, pa.int64())

    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            waiting.append(row)
            size += len(row[3])
            if size >= CHUNK_CHARS and len(waiting) > 1:
                yield from work(waiting)
                waiting = waiting[-1:]
                size = len(waiting[0][3])
    yield from work(waiting)


def _borders(docs: DataFrame, parts: int) -> list[tuple[int, str]]:
    """Borders of about equal ranges of (doc, prefix), from a sample of about PER_PART rows for each range."""
    n = docs.count()
    share = min(1.0, parts * PER_PART / max(1, n))
    sample = docs.where(F.pmod(F.xxhash64("doc", "prefix", F.length("text"), F.lit(9)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("doc", "prefix").toArrow()
    rows = sorted(zip(sample["doc"].to_pylist(), sample["prefix"].to_pylist(), strict=True))
    return sorted(set(rows[max(1, len(rows) // parts) :: max(1, len(rows) // parts)][: parts - 1]))


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, a row for each row.

    The next document is the next in ascending doc_id, equal ids by text, null ids last, and after the last the first. A
    null text is empty; the fingerprint of an empty text is empty, and two empty ones are fully alike. Texts meet their
    successors in ranges of ids and, of equal ids, of the texts' beginnings: each range also gets the rows that open the
    next one. The borders only shape the ranges. Repeated rows follow each other; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("prefix", F.substring("text", 1, PREFIX))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES), MOST_PARTS)
    borders = _borders(docs, parts) if parts > 1 else []
    side = max(1, round(len(borders) ** 0.5))
    part = F.lit(0)
    if borders:
        nested = [[{"d": d, "s": x} for d, x in borders[k : k + side]] for k in range(0, len(borders), side)]
        lists = F.from_json(F.lit(json.dumps(nested)), "array<array<struct<d:bigint,s:string>>>")
        own = F.struct(F.col("doc").alias("d"), F.col("prefix").alias("s"))
        top = F.size(F.filter(lists, lambda x: x[0] <= own))
        inner = F.size(F.filter(F.try_element_at(lists, top), lambda x: x <= own))
        part = F.when(top > 0, (top - 1) * side + inner).otherwise(0)
    docs = docs.withColumn("part", part.cast("int"))
    firsts = sorted((r["part"], r["first"]) for r in docs.groupBy("part").agg(F.min(F.struct("doc", "prefix")).alias("first")).collect())  # one row for each part
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = spark.createDataFrame([(*f, firsts[k - 1][0]) for k, (_, f) in enumerate(firsts)], "first long, first_prefix string, guest_of int")  # MOST_PARTS at most
    rows = docs.join(F.broadcast(before), (F.col("doc") == F.col("first")) & (F.col("prefix") == F.col("first_prefix")), "left")
    placed = rows.select("doc", "text", F.explode(F.when(F.col("guest_of").isNull(), F.array(F.struct("part", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("part", F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("part"), F.lit(True).alias("guest"))))).alias("p"))
    placed = placed.select("p.part", "p.guest", "doc", "text").repartition(parts, "part").sortWithinPartitions("part", "guest", "doc", "text")
    return placed.mapInArrow(_scan, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def octave_slots(n: int) -> list[tuple[int, int, int]]:
    """(octave, first slot, end slot) of the octaves that a fingerprint of n slots fills, from 16 steps on; the longest last."""
    out = [(-k, FIRST >> k, FIRST >> (k - 1)) for k in range(4, 0, -1)] + [(k + 1, FIRST + k * BAND, FIRST + (k + 1) * BAND) for k in range(max(0, -(-(n - FIRST) // BAND)))]
    return [x for x in out if x[2] <= n]


def band_keys(fingerprint: str) -> list[int]:
    """Keys of the sampled bits of the top octaves; of a text too short for one octave, of the whole fingerprint."""
    x = np.frombuffer(fingerprint.encode(), np.uint8)
    out = []
    with np.errstate(over="ignore"):
        for octave, a, b in octave_slots(len(x))[-TOP:] or [(99, 0, len(x))]:
            order = mix(np.arange((b - a) * KEYS, dtype=np.uint64) + np.uint64((octave + 64) << 20)).reshape(KEYS, b - a).argsort(axis=1, kind="stable")[:, :BITS]
            for k, places in enumerate(order):
                values = x[a + np.sort(places)].astype(np.uint64)
                h = mix(values + (np.arange(len(values), dtype=np.uint64) << np.uint64(8))).sum(dtype=np.uint64)
                out.append(int(mix(np.array([h + np.uint64((octave + 64) * KEYS + k)], np.uint64)).view(np.int64)[0]))
    return out


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most so much: furthest-reaching diagonals after common ends, each slide found by doubling."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    m = min(len(x), len(y))
    differs = np.flatnonzero(x[:m] != y[:m])
    at = int(differs[0]) if len(differs) else m
    x, y = x[at:], y[at:]
    m = min(len(x), len(y))
    differs = np.flatnonzero(x[len(x) - m :][::-1] != y[len(y) - m :][::-1])
    end = int(differs[0]) if len(differs) else m
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(x) or not len(y):
        return max(len(x), len(y)) <= most
    if len(x) > 8 and len(y) > 8:  # an edit changes at most eight 8-grams of either text
        grams = [np.sort(mix(sum(t[i : len(t) - 7 + i].astype(np.uint64) << np.uint64(7 * i) for i in range(8)))) for t in (x, y)]
        both, n = np.unique(np.concatenate(grams), return_counts=True)
        left = np.searchsorted(grams[0], both, "right") - np.searchsorted(grams[0], both, "left")
        if int(np.abs(2 * left - n).sum()) > 16 * most:
            return False
    n, m = len(x), len(y)
    sums = [prefix_hash(mix(t.astype(np.uint64) + np.uint64(3))) for t in (x, y)]
    longest = 1 << max(0, min(n, m).bit_length() - 1)
    before = np.zeros(0, np.int64)
    for d in range(most + 1):
        k = np.arange(-d, d + 1)  # diagonals: places in x less places in y
        if d:
            p = np.concatenate(([-NO_ID // 2] * 2, before, [-NO_ID // 2] * 2))
            reach = np.maximum.reduce([p[: 2 * d + 1] + 1, p[1 : 2 * d + 2] + 1, p[2 : 2 * d + 3]])
            reach = np.minimum(reach, np.minimum(n, m + k))
        else:
            reach = np.zeros(1, np.int64)
        on = np.flatnonzero((reach >= 0) & (reach - k >= 0) & (reach < n) & (reach - k < m))
        on = on[x[reach[on]] == y[reach[on] - k[on]]]
        step = longest
        while step and len(on):  # each slides down its diagonal as far as the texts agree
            a, b = reach[on], reach[on] - k[on]
            fits = np.flatnonzero((a + step <= n) & (b + step <= m))
            a, b = a[fits], b[fits]
            same = span_hash(sums[0], a, a + step) == span_hash(sums[1], b, b + step)
            reach[on[fits[same]]] += step
            step >>= 1
        if d >= abs(n - m) and reach[d + n - m] >= n:
            return True
        before = reach
    return False


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (doc, keys)."""
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK_CHARS):
                size += len(texts[to])
                to += 1
            keys = [band_keys(f) for f in fingerprints(texts[at:to])[0]]
            yield pa.RecordBatch.from_arrays([pa.array(docs[at:to], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "keys"])
            at = to


def _near(near: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [edits_within(s, t, int(near * max(len(s), len(t)))) for s, t in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "near"])

    return verify


def near_classes(docs: DataFrame, near: float = NEAR, rounds: int = 16) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, n_links, a row for each row: classes of texts within an edit distance of `near` times the longer text.

    class_id is the smallest doc_id that verified links reach; n_links counts the verified links of a document's text to
    other texts. Equal texts are one text from the start and share class and links. Candidates share a band key. In a band
    of up to SMALL texts all pairs are verified; in a larger one all are verified against its smallest doc_id, and those
    that aren't near it go on in the parts of the band that share another key, until nothing is left. Bands find near
    copies with a high probability, not all (see the README for the measured recall). Empty texts and null ids stand alone;
    a null id has a null class. Of rows that share a doc_id each has the class of its own text. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "size": F.length("text")})
    texts = rows.where("doc is not null and size > 0").groupBy("h", "size").agg(F.min("doc").alias("head"))
    heads = rows.join(texts, ["h", "size"]).where("doc = head").select("doc", "text").dropDuplicates(["doc", "text"])
    keys = materialise(heads.mapInArrow(_keyed, "doc long, keys array<long>"))
    members = keys.select("doc", F.explode("keys").alias("key")).distinct()
    tested = None
    for number in range(rounds):
        size = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("leader")).where("n > 1")
        placed = materialise(members.join(size, "key"))
        few = placed.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("doc")).alias("d"))  # SMALL at most
        pairs = few.select(F.posexplode("d").alias("i", "a"), "d").select("a", F.explode(F.slice("d", F.col("i") + 2, F.lit(SMALL))).alias("b"))
        pairs = pairs.unionByName(placed.where((F.col("n") > SMALL) & (F.col("doc") > F.col("leader"))).select(F.col("leader").alias("a"), F.col("doc").alias("b"))).where("a < b").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        left, right = heads.select(F.col("doc").alias("a"), F.col("text").alias("x")), heads.select(F.col("doc").alias("b"), F.col("text").alias("y"))
        checked = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_near(near), "a long, b long, near boolean")
        checked = materialise(checked.groupBy("a", "b").agg(F.max("near").alias("near")))
        tested = checked if tested is None else tested.unionByName(checked)
        linked = tested.where("near").select(F.col("a").alias("leader"), F.col("b").alias("doc"))
        rest = placed.where((F.col("n") > SMALL) & (F.col("doc") > F.col("leader"))).join(linked, ["leader", "doc"], "left_anti").select("key", "doc")
        other = F.element_at("keys", F.pmod(F.col("key") + F.lit(number), F.size("keys")).cast("int") + 1)
        members = materialise(rest.join(keys, "doc").select("doc", F.xxhash64("key", other).alias("key")).distinct())
        if members.isEmpty():
            break
    links = tested.where("near").select("a", "b")
    nodes = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n_links"))
    classes = texts.join(nodes, F.col("head") == F.col("node"), "left").join(degree, "head", "left").select("h", "size", F.coalesce("component", "head").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = rows.join(classes, ["h", "size"], "left")
    class_id = F.when(F.col("doc").isNotNull(), F.coalesce("class", "doc"))
    return own.select(F.col("doc").alias("doc_id"), class_id.alias("class_id"), F.when(F.col("doc").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
