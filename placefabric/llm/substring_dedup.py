"""Removal of passages that a smaller doc_id holds, by relative Lempel-Ziv parsing against reference blocks.

The documents' runs of windows meet their possible references by anchor (see anchors). A reference block is a suffix array
over runs of words; with the common prefixes of neighbours it gives, for each place, the longest match with any run of a
smaller doc_id. A run is factored greedily: the longest match from the current word on is a factor, a word that starts
none of `gram` words is a literal. Factors of `length` words or more are duplicate spans; a window that crosses the end of
a factor, where another reference may match further, is checked by its own longest match.
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
from placefabric.llm.arrays import chunks, dense, sorted_places, word_hashes, word_spans
from placefabric.llm.exchange import runs

BLOCK_WORDS = 1 << 16  # words of the runs in one reference block


class ReferenceBlock:
    """An indexed block of sequences, each of a document: for every place the longest match with a sequence of a smaller document."""

    def __init__(self, sequences: list[np.ndarray], docs: np.ndarray, length: int, gram: int):
        self.length, self.gram = length, gram
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1  # an end mark follows each
        n = int((sizes + 1).sum())
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.starts + sizes] = False
        text[inside] = dense(np.concatenate(sequences)) + len(sequences)
        text[~inside] = np.arange(len(sequences))  # end marks differ, so no match goes beyond one
        levels, step = [text], 1
        order = sorted_places(text)[0]
        while step <= sizes.max(initial=0):  # ranks of the next 1, 2, 4, ... words
            rank = levels[-1]
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            order, keys = sorted_places(rank * (int(after.max()) + 1) + after)
            levels.append(np.empty(n, np.int64))
            levels[-1][order] = np.cumsum(np.concatenate(([0], keys[1:] != keys[:-1])))
            step *= 2
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]
            same &= np.maximum(a, b) < n
            a[same] += 1 << k
            b[same] += 1 << k
            common[same] += 1 << k
        longest = np.empty(n, np.int64)
        longest[order] = longest_to_smaller(np.repeat(docs, sizes + 1)[order], common)
        self.longest = longest

    def factors(self, number: int, size: int) -> list[tuple[int, int]]:
        """Greedy factors (start, length) of a sequence; words outside are literals."""
        out, i, own = [], 0, self.longest[self.starts[number] : self.starts[number] + size].tolist()
        while i < size:
            if own[i] >= self.gram:
                out.append((i, own[i]))
                i += own[i]
            else:
                i += 1
        return out

    def repeated(self, number: int, size: int) -> np.ndarray:
        """Which windows of a sequence stand in a smaller document: those inside long factors, and of those across a factor's end the ones that match further."""
        found = np.zeros(max(0, size - self.length + 1), bool)
        for start, m in self.factors(number, size):
            inside = max(start, start + m - self.length + 1)
            found[start:inside] = True
            border = np.arange(inside, min(start + m, len(found)))
            found[border] = self.longest[self.starts[number] + border] >= self.length
        return found


def longest_to_smaller(owner: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For sorted suffixes with the common prefixes of neighbours, the longest common prefix of each with one of a smaller owner."""

    def one_way(owner: np.ndarray, common: np.ndarray) -> np.ndarray:
        """With the nearest one before of a smaller owner. Pointers jump over owners that aren't smaller, all at a time."""
        who = np.concatenate(([np.iinfo(np.int64).min], owner))  # place 0 is smaller than all and shares nothing
        to, shared = np.arange(-1, len(owner)), np.concatenate(([0, 0], common))[: len(who)]
        to[0], active = 0, np.arange(1, len(who))
        while len(active := active[who[to[active]] >= who[active]]):
            jump = to[active]
            shared[active] = np.minimum(shared[active], shared[jump])
            to[active] = to[jump]
        return shared[1:]

    return np.maximum(one_way(owner, common), one_way(owner[::-1], common[::-1])[::-1])


def repeated_in_smaller(sequences: list[np.ndarray], docs: np.ndarray, length: int, gram: int) -> list[np.ndarray]:
    """For each sequence, which of its windows stand in a sequence of a smaller document.

    Sequences are dealt to blocks of BLOCK_WORDS in order of their documents. A block's sequences are factored against it
    together with each block before it, so memory holds two blocks, however many there are.
    """
    order = np.argsort(docs, kind="stable")
    sizes = np.array([len(s) for s in sequences], np.int64)
    block = np.cumsum(sizes[order]) // BLOCK_WORDS
    blocks = [order[a:b] for a, b in zip(*runs(block), strict=True)]
    found = [np.zeros(max(0, len(s) - length + 1), bool) for s in sequences]
    for k, own in enumerate(blocks):
        for before in blocks[:k] or [own[:0]]:
            rows = np.concatenate((before, own))
            index = ReferenceBlock([sequences[i] for i in rows.tolist()], docs[rows], length, gram)
            for number, i in enumerate(own.tolist(), len(before)):
                found[i] |= index.repeated(number, len(sequences[i]))
    return found


def _decide(length: int):
    def work(table: pa.Table) -> pa.Table:
        d = anchors.Decisions(table, False)
        order = np.argsort(d.anchor, kind="stable")
        sizes = pc.binary_length(d.symbols).to_numpy()[order] // 6  # words, about
        first, end = runs(d.anchor[order])
        upto, a = np.concatenate(([0], np.cumsum(sizes))), 0
        while a < len(first):  # whole anchors up to BLOCK_WORDS, or one that is larger
            b = max(a + 1, int(np.searchsorted(upto[end], upto[first[a]] + BLOCK_WORDS, "right")))
            rows = order[first[a] : end[b - 1]].tolist()
            texts = [d.symbols[k].as_py() for k in rows]
            words, at = word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), False)
            d.add(rows, repeated_in_smaller(np.split(words, at[1:-1]), d.doc[rows], length, anchors.gram_of(length)))
            a = b
        return d.table()

    return work


def _cut(length: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(2)
            n_words, n_removed, digests = [], [], []
            for at, to, data, offsets in chunks(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                raw = data.tobytes()
                for row in range(at, to):
                    a, b = int(first[row - at]), int(first[row - at + 1])
                    gone = anchors.covered(marks, row, b - a, length)
                    kept = b" ".join([raw[s:e] for s, e in zip(starts[a:b][~gone].tolist(), ends[a:b][~gone].tolist(), strict=True)])
                    n_words.append(b - a)
                    n_removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return scan


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, a row for each row.

    A word goes when a window of `length` words that covers it also starts in a document of smaller doc_id; windows are
    judged on the input. A null doc_id counts as the largest, a null text as empty; rows that share a doc_id are the
    same document and don't remove each other's words. Texts shorter than a window stay whole. Other columns are ignored.
    """
    docs = anchors.versioned(docs)
    marks = anchors.repeated_windows(docs, anchors.text_bytes(docs), True, length, False, _decide(length))
    joined = docs.join(marks, ["doc", "ver"], "left").select(F.when(F.col("doc") != anchors.NO_ID, F.col("doc")).alias("doc_id"), "text", "marks")
    return joined.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept_sha256 string")
