"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The number of items, their mean length and each term's document frequency are counted over all items first, so an item's
scores don't depend on how the items are cut. The test items are indexed with impacts divided by the item's score against
itself, in blocks of items and spans of blocks that keep each term's largest impact. Every passage of every document
queries the index: a span that its words cannot lift to the threshold even with their largest impacts is skipped with all
its blocks, then a block of the others with all its items; in what remains WAND moves cursors from pivot to pivot and
retrieves all items above the threshold. A retrieved pair counts as a leak when both the item's question and its answer
overlap the passage in word n-grams.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placefabric.llm.arrays import chunks, mark_table, word_hashes
from placefabric.llm.components import materialise
from placefabric.llm.exchange import runs

K1, B = 1.2, 0.75
BLOCK = 4  # items of a block
SPAN = 16  # blocks of a span
INDEX_BYTES = 8 << 20  # of items' texts in one index, which is broadcast; its arrays take about eight times that
GATHER = 1 << 21  # list entries that are summed at a time
THRESHOLD = 0.5  # of the item's score against itself
PASSAGE = 128  # words; for items over half of it twice the next power of two
NGRAM = 3
OVERLAP = 0.6  # share of the n-grams of question and answer


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: parted after the last question mark, else before the last sentence; one sentence is both."""
    at = text.rfind("?") + 1
    if not text[at:].strip() or not at:
        ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
        at = ends[-1] if ends else 0
    return (text[:at], text[at:]) if at and re.search(r"\w", text[:at]) and re.search(r"\w", text[at:]) else (text, text)


def hashed_words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        words, first = word_hashes(data, offsets, True, mark_table())
        out += [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.cumsum([0, *map(len, parts)])


def _slices(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """All places in [at, to) of each slice."""
    n = to - at
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _batches(upto: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose running totals grow by about GATHER; one entry at least."""
    a = 0
    while a < len(upto) - 1:
        b = min(len(upto) - 1, max(a + 1, int(np.searchsorted(upto, upto[a] + GATHER, "right")) - 1))
        yield a, b
        a = b


class Index:
    """Inverted index of items as flat arrays; items without words are left out.

    rows: (item_id, text) each, with two arrays more, its distinct terms and their document frequencies over all items.
    count, mean: the number of all items with words and their mean length. Without these the rows are all items.
    """

    def __init__(self, rows: list[tuple], count: int | None = None, mean: float | None = None):
        parts = [split_item(r[1]) for r in rows]
        whole, questions, answers = hashed_words([r[1] for r in rows]), hashed_words([q for q, _ in parts]), hashed_words([a for _, a in parts])
        own = [k for k, w in enumerate(whole) if len(w)]
        self.ids = np.array([rows[k][0] for k in own], np.int64)
        self.questions, self.answers = _flat([questions[k] for k in own]), _flat([answers[k] for k in own])
        self.longest = max((len(whole[k]) for k in own), default=0)
        n, mean = count or len(own), mean or sum(len(whole[k]) for k in own) / max(1, len(own))
        found = [np.unique(whole[k], return_counts=True) for k in own]
        term, f = np.concatenate([np.zeros(0, np.uint64), *(t for t, _ in found)]), np.concatenate([np.zeros(0), *(c for _, c in found)])
        sizes = np.array([len(t) for t, _ in found], np.int64)
        item, length = np.repeat(np.arange(len(own)), sizes), np.repeat(np.array([len(whole[k]) for k in own], np.float64), sizes)
        self.terms, place, standing = np.unique(term, return_inverse=True, return_counts=True)
        if count is not None:  # over all items
            for k in own:
                standing[np.searchsorted(self.terms, np.asarray(rows[k][2], np.int64).view(np.uint64))] = rows[k][3]
        df = standing[place].astype(np.float64)
        impact = np.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
        total = np.bincount(item, impact, len(own)) if len(own) else np.zeros(0)
        order = np.lexsort((item, place))
        self.item, self.impact = item[order].astype(np.int32), (impact / total[item])[order] if len(own) else impact
        self.n_blocks = -(-len(own) // BLOCK)
        self.n_spans = -(-self.n_blocks // SPAN)
        key = place[order].astype(np.int64) * max(1, self.n_blocks) + self.item // BLOCK
        at, to = runs(key)
        self.block_key, self.block_at = key[at], np.append(at, len(key))
        self.block_most = np.maximum.reduceat(self.impact, at) if len(at) else np.zeros(0)
        block, of = self.block_key % max(1, self.n_blocks), self.block_key // max(1, self.n_blocks)
        key = of * max(1, self.n_spans) + block // SPAN
        at, to = runs(key)
        self.span, self.span_most = (key[at] % max(1, self.n_spans)).astype(np.int32), np.maximum.reduceat(self.block_most, at) if len(at) else np.zeros(0)
        self.span_at = np.searchsorted(key[at] // max(1, self.n_spans), np.arange(len(self.terms) + 1))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The items of a term and its impacts."""
        a, b = self.block_at[np.searchsorted(self.block_key, [term * self.n_blocks, (term + 1) * self.n_blocks])]
        return self.item[a:b], self.impact[a:b]

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """All items that score the threshold or more for distinct terms, given by their places in `terms`."""
        return [(item, score) for _, item, score in self.retrieve(np.zeros(len(terms), np.int64), terms, threshold)]

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """(passage, item, score) of all that reach the threshold; the distinct pairs of passage and term come in order of passage."""
        first = np.searchsorted(passage, np.arange(int(passage[-1]) + 2)) if len(passage) else np.zeros(1, np.int64)
        upto = np.concatenate(([0], np.cumsum(self.span_at[term + 1] - self.span_at[term])))
        for a, b in _batches(upto[first]):
            t = term[first[a] : first[b]]
            at, to = self.span_at[t], self.span_at[t + 1]
            p, who = _slices(at, to), np.repeat(passage[first[a] : first[b]] - a, to - at)
            bound = np.bincount(who * self.n_spans + self.span[p], self.span_most[p], (b - a) * self.n_spans)
            hit = np.flatnonzero(bound >= threshold - 1e-4)  # spans that a passage may lift to the threshold
            who, span = hit // self.n_spans + a, hit % self.n_spans
            sizes = np.concatenate(([0], np.cumsum(first[who + 1] - first[who])))
            for i, j in _batches(sizes * 4):
                yield from self._blocks(first, term, who[i:j], span[i:j], threshold)

    def _blocks(self, first: np.ndarray, term: np.ndarray, who: np.ndarray, span: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        of = np.repeat(np.arange(len(who)), first[who + 1] - first[who])
        key = term[_slices(first[who], first[who + 1])] * self.n_blocks
        at = np.searchsorted(self.block_key, key + span[of] * SPAN)
        to = np.searchsorted(self.block_key, key + np.minimum((span[of] + 1) * SPAN, self.n_blocks))
        p, of = _slices(at, to), np.repeat(of, to - at)
        cell = of * SPAN + self.block_key[p] % self.n_blocks % SPAN
        passing = np.bincount(cell, self.block_most[p], len(who) * SPAN) >= threshold - 1e-4
        p, cell = p[passing[cell]], cell[passing[cell]]
        order = np.argsort(cell, kind="stable")
        p, cell = p[order], cell[order]
        for x, y in zip(*runs(cell), strict=True):
            for item, score in self._wand(p[x:y], threshold):
                yield int(who[cell[x] // SPAN]), item, score

    def _wand(self, lists: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items above the threshold in one block, whose posting lists have these numbers."""
        cursors = []  # a cursor: current item, position, postings, largest impact in the block
        for q in lists.tolist():
            a, b = self.block_at[q], self.block_at[q + 1]
            p = list(zip(self.item[a:b].tolist(), self.impact[a:b].tolist(), strict=True))
            cursors.append([p[0][0], 0, p, float(self.block_most[q])])
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += c[3]
                if bound >= threshold - 1e-4:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            if cursors[0][0] == item:
                score = sum(c[2][c[1]][1] for c in cursors[: pivot + 1])
                if score >= threshold - 1e-12:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for c in cursors[: pivot + 1]:
                i, p = c[1], c[2]
                while i < len(p) and p[i][0] < to:
                    i += 1
                c[1], c[0] = i, p[i][0] if i < len(p) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def overlap(part: np.ndarray, passage: set[tuple[int, ...]], n: int = NGRAM) -> float:
    """Share of a part's n-grams (its whole sequence if shorter) that the passage holds."""
    words = part.tolist()
    grams = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    return sum(g in passage for g in grams) / len(grams)


def leaks(index: Index, words: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, float, float, float]]]:
    """Rows (their words begin at `first`) with the (item_id, score, question overlap, answer overlap) of the best passage for each leaked item."""
    if not len(words) or not len(index.terms):
        return {}
    width = 2 << length_class(index.longest)
    step, sizes = width // 2, np.diff(first)
    each = np.where(sizes > 0, np.maximum(1, -(-(sizes - step) // step)), 0)
    row = np.repeat(np.arange(len(sizes)), each)
    start = first[row] + step * (np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each))
    end = np.minimum(start + width, first[row + 1])
    place = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[place] == words)
    a, b = np.searchsorted(known, start), np.searchsorted(known, end)
    pair = np.unique(np.repeat(np.arange(len(row)), b - a) * len(index.terms) + place[known[_slices(a, b)]])
    best: dict[int, dict[int, tuple[int, float, float, float]]] = {}
    held: tuple[int, set] = (-1, set())
    for p, number, score in index.retrieve(pair // len(index.terms), pair % len(index.terms), THRESHOLD):
        if held[0] != p:
            w = words[start[p] : end[p]].tolist()
            held = p, {tuple(w[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(w) - n + 1)}
        q, r = (overlap(flat[at[number] : at[number + 1]], held[1]) for flat, at in (index.questions, index.answers))
        own = best.setdefault(int(row[p]), {}) if q >= OVERLAP and r >= OVERLAP else None
        if own is not None and score > own.get(number, (0, -1.0))[1]:
            own[number] = (int(index.ids[number]), score, q, r)
    return {k: [found[n] for n in sorted(found)] for k, found in sorted(best.items())}


def length_class(words: int) -> int:
    """Items of up to 2^class words share an index: how wide a passage is depends on an item's own length alone."""
    return max((PASSAGE // 2 - 1).bit_length(), (max(words, 1) - 1).bit_length())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = hashed_words(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([np.unique(w).view(np.int64) for w in words], pa.list_(pa.int64()))], names=["item_id", "text", "n", "terms"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of about INDEX_BYTES of items' texts of one length class each; counts are over all items. Null texts and ids are left out; a
    repeated item counts as often as it stands."""
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("item_id is not null and text is not null")
    split = materialise(items.mapInArrow(_terms, "item_id long, text string, n long, terms array<long>").where("n > 0").withColumn("at", F.monotonically_increasing_id()))
    count, mean = split.agg(F.count(F.lit(1)), F.avg("n")).first()
    if not count:
        return
    each = split.select("at", F.explode("terms").alias("term"))
    df = each.join(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").groupBy("at").agg(F.collect_list(F.struct("term", "df")).alias("t"))
    rows, size, kind = [], 0, None
    classes = F.greatest(F.lit(length_class(1)), F.length(F.bin(F.col("n") - 1)))
    for *r, own in split.select("at", "item_id", "text", classes.alias("class")).join(df, "at").select("item_id", "text", "t.term", "t.df", "class").orderBy("class", "item_id", "text").toLocalIterator():
        if rows and own != kind:
            yield Index(rows, count, mean)
            rows, size = [], 0
        kind = own
        rows.append(tuple(r))
        size += len(r[1])
        if size >= INDEX_BYTES:
            yield Index(rows, count, mean)
            rows, size = [], 0
    if rows:
        yield Index(rows, count, mean)


def _shared(docs: DataFrame, index: Index):
    """The index in the tasks, sent to each executor once."""
    sent = docs.sparkSession.sparkContext.broadcast(vars(index))

    def get() -> Index:
        own = Index.__new__(Index)
        vars(own).update(sent.value)
        return own

    return get


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document (doc_id, text) and a test item (item_id, text) that leaked into it: doc_id, item_id, score, question_overlap, answer_overlap.

    One row for each pair, with its best passage; documents without a leak have none. Null texts hold nothing. Repeated
    rows give repeated pairs. Documents are read once for every INDEX_BYTES of items.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    docs = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], ddl)
    for index in indexes(items):

        def scan(batches: Iterator[pa.RecordBatch], get=_shared(docs, index)) -> Iterator[pa.RecordBatch]:
            own = get()
            for batch in batches:
                rows: list[int] = []
                found: list[tuple] = []
                for at, _, data, offsets in chunks(batch.column(1)):
                    words, first = word_hashes(data, offsets, True, mark_table())
                    for k, own_leaks in leaks(own, words, first).items():
                        rows += [at + k] * len(own_leaks)
                        found += own_leaks
                cols = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[1:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out = out.unionByName(docs.mapInArrow(scan, ddl))
    return out


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs into which no item leaked, with all their columns. Null and empty texts stay."""
    at = docs.columns.index("text")
    for index in indexes(items):

        def scan(batches: Iterator[pa.RecordBatch], get=_shared(docs, index)) -> Iterator[pa.RecordBatch]:
            own = get()
            for batch in batches:
                keep: list[bool] = []
                for _, _, data, offsets in chunks(batch.column(at)):
                    words, first = word_hashes(data, offsets, True, mark_table())
                    gone = leaks(own, words, first)
                    keep += [k not in gone for k in range(len(first) - 1)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
