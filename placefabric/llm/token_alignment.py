"""Alignment of two tokenizers over a corpus, through a dictionary of groups.

Places where tokens of both end cut a text into groups, and the same few groups make up most of a corpus. A task interns
the groups of a chunk of documents and writes two kinds of rows: the chunk's documents as numbers into its dictionary, and
the dictionary with frequencies. The corpus dictionary is their sum; links are expanded once for each distinct group and
multiplied by its frequency. What the links of a group add up to joins back to the chunks' dictionaries by the group, and
each chunk adds it up over its documents.

Both tokenizers cut at a single space between two characters that aren't white space: the byte-level pattern begins a word
there, and no merge of the pieces crosses it. What lies between two such spaces is tokenised once for each process that
meets it. Where a tokenizer's settings don't warrant this, whole texts are tokenised.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placefabric.llm.arrays import memo, mix
from placefabric.llm.components import stored

FOLDER = "/opt/tokenizers"
CHUNK_CHARS, CHUNK_DOCS = 4 << 20, 1 << 14
PIECE = 1 << 20  # characters of a text that are split at once
KNOWN = 150_000  # stretches of text that a process keeps tokenised, until the next chunk begins
LONG = 500  # characters up to which a stretch is encoded by rank
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: the words of byte-level BPE
DOCS, GROUPS = 0, 1
_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LONGS = pa.list_(pa.int64())
_SCHEMA = pa.schema([
    ("chunk", pa.string()), ("kind", pa.int32()), ("doc_id", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS), ("sha", pa.list_(pa.string())), ("units", _LONGS),
    ("codes", pa.binary()), ("unit_sizes", pa.binary()), ("unit_groups", pa.binary()), ("code", pa.int32()), ("grp", pa.string()), ("n", pa.int64()), ("pairs", _LONGS),
])
_DDL = (
    "chunk string, kind int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, sha array<string>, units array<long>, "
    "codes binary, unit_sizes binary, unit_groups binary, code int, grp string, n long, pairs array<long>"
)


def _bytes_of_characters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """The two tokenizers, and the groups and stretches of text that this process has met.

    a: the JSON of a byte-level BPE; b: a serialised piece model. Where a's ids stand in the order of its merges, short
    stretches are encoded by rank, with the same result.
    """

    def __init__(self, a: bytes, b: bytes, overlaps: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        self.overlaps, self.json, self.a = overlaps, a, None
        settings = json.loads(a)
        letters = _bytes_of_characters()
        vocabulary = settings["model"]["vocab"] | {t["content"]: t["id"] for t in settings.get("added_tokens", [])}
        self.a_bytes = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocabulary.items()}
        self.b = SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b)
        proto = ModelProto.FromString(b)
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p.piece) else p.piece.replace("▁", " ").encode() for p in proto.pieces]
        self.a_size = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_size = np.array([len(x) for x in self.b_bytes], np.int64)
        spec = proto.normalizer_spec
        split, model = settings.get("pre_tokenizer") or {}, settings["model"]
        plain = not settings.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and all(t["special"] for t in settings.get("added_tokens", []))
        self.cuts = (
            plain and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and proto.trainer_spec.model_type == 2
            and not proto.trainer_spec.treat_whitespace_as_suffix and not any(re.search("[^▁]▁", p.piece) for p in proto.pieces)
        )
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        own = {i: t for t, i in model["vocab"].items()}
        self.by_rank = None
        if plain and not model.get("ignore_merges") and all(own.get(256 + k) == t for k, t in enumerate(merged)) and all(len(own.get(k, "")) == 1 for k in range(256)):
            ranks = {self.a_bytes[i]: i for i in range(256 + len(merged))}
            self.by_rank = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[tuple[int, ...], str] | None] = {}
        self.numbers: dict[str, int] = {}
        self.spelled: list[str] = []
        self.pairs: list[tuple[int, ...]] = []
        self.sizes: list[tuple[int, int]] = []

    def units(self, text: str) -> Iterator[list[str]]:
        """Stretches whose tokens are the text's, a piece of the text at a time."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while len(text) - at > PIECE and (m := _SPACE.search(text, at + PIECE)):
            yield _SPACE.split(text[at : m.start()])
            at = m.end()
        yield _SPACE.split(text[at:])

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        long_ = [t for t in texts if self.by_rank is None or len(t) > LONG]
        if long_ and self.a is None:  # it takes a hundred megabytes
            from tokenizers import Tokenizer

            self.a = Tokenizer.from_str(self.json.decode())
            self.a.encode_special_tokens = True
        whole = iter(self.a.encode_batch_fast([" " + t for t in long_], add_special_tokens=False) if long_ else [])
        if self.by_rank is None:
            return [e.ids for e in whole]
        one = self.by_rank.encode_ordinary
        return [one(" " + t) if len(t) <= LONG else next(whole).ids for t in texts]

    def number(self, a: list[int], b: list[int]) -> int:
        """The number of a group; its links are expanded when it is met for the first time."""
        spelled = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        k = self.numbers.get(spelled)
        if k is None:
            k = self.numbers[spelled] = len(self.spelled)
            self.spelled.append(spelled)
            self.pairs.append(tuple(self._overlapping(a, [self.a_bytes[i] for i in a], b, [self.b_bytes[i] for i in b])) if self.overlaps else (a[-1] << 32 | b[-1],))
            self.sizes.append((len(a), len(b)))
        return k

    @staticmethod
    def _overlapping(a: list[int], x: list[bytes], b: list[int], y: list[bytes]) -> Iterator[int]:
        i, j, end_a, end_b = 0, 0, len(x[0]), len(y[0])
        while True:
            yield a[i] << 32 | b[j]
            step_a, step_b = end_a <= end_b, end_b <= end_a
            i, j = i + step_a, j + step_b
            if i == len(a) or j == len(b):
                return
            end_a, end_b = end_a + len(x[i]) * step_a, end_b + len(y[j]) * step_b

    def cut(self, texts: list[str]) -> None:
        """Tokens, groups and their numbers of texts not met before. Those whose tokens don't spell them with a space before are None."""
        by_a, by_b, spelled = self.encode_a(texts), self.b.encode(texts, num_threads=1), [b" " + t.encode() for t in texts]
        good = [b"".join(map(self.a_bytes.__getitem__, x)) == s == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, s in zip(by_a, by_b, spelled, strict=True)]
        for t, g in zip(texts, good, strict=True):
            if not g:
                self.known[t] = None
        texts, by_a, by_b = ([x for x, g in zip(xs, good, strict=True) if g] for xs in (texts, by_a, by_b))
        if not texts:
            return
        a, b = (np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in (by_a, by_b))
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        ends = np.zeros(int(end_a[-1]) + 1, bool)
        ends[end_a] = True
        ends = end_b[ends[end_b]]  # where both end
        first_a, first_b = (np.concatenate(([0], np.searchsorted(e, ends) + 1)) for e in (end_a, end_b))
        with np.errstate(over="ignore"):
            hashes = np.zeros(len(ends), np.uint64)
            for ids, first, salt in ((a, first_a, 1), (b, first_b, 2)):
                place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
                hashes += np.add.reduceat(mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(4) + np.uint64(salt)), first[:-1])
        _, one, of = np.unique(hashes, return_index=True, return_inverse=True)
        for ids, first in ((a, first_a), (b, first_b)):  # equal hashes are equal groups
            size = np.diff(first)
            place = np.arange(len(ids)) - np.repeat(first[:-1], size)
            if not (size == size[one][of]).all() or not (ids == ids[np.repeat(first[:-1][one][of], size) + place]).all():
                raise RuntimeError("two groups have one hash")
        found = np.array([self.number(a[first_a[k] : first_a[k + 1]].tolist(), b[first_b[k] : first_b[k + 1]].tolist()) for k in one.tolist()], np.int64)[of].tolist()
        upto = np.searchsorted(ends, np.cumsum([len(s) for s, g in zip(spelled, good, strict=True) if g]), "right").tolist()
        at = 0
        for t, to in zip(texts, upto, strict=True):
            groups = tuple(found[at:to])
            self.known[t] = groups, ";".join(map(self.spelled.__getitem__, groups))
            at = to

    def groups(self, texts: list[str]) -> list[tuple[tuple[int, ...], str] | None]:
        """The groups of each text, by number, and how they are spelled. Numbers hold until the next call of forget."""
        fresh, size = [], 0
        for t in texts:
            if t not in self.known:
                fresh.append(t)
                size += len(t)
            if size > PIECE:
                self.cut(fresh)
                fresh, size = [], 0
        if fresh:
            self.cut(fresh)
        return [self.known[t] for t in texts]


class _Codes(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = code = len(self)
        return code


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers as byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the values."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _chunk(name: str, rows: list[tuple[int | None, str | None]], pair: Pair) -> Iterator[pa.RecordBatch]:
    units = _Codes()
    codes = []
    for _, text in rows:
        own = array("I")
        if text and "▁" not in text:  # B would give it back as a space
            for part in pair.units(text):
                own.extend([units[u] for u in part])
        codes.append(np.frombuffer(own, np.uint32))
    if len(pair.known) > KNOWN:
        pair.forget()
    found = pair.groups(list(units))
    if None in found:  # such documents are decided by their whole texts
        bad = np.array([g is None for g in found])
        for k, (_, text) in enumerate(rows):
            if bad[codes[k]].any():
                whole = pair.groups([text])[0]
                codes[k] = np.array([] if whole is None else [len(found)], np.uint32)
                found += [] if whole is None else [whole]
        found = [g or ((), "") for g in found]
    spelled = [g[1] for g in found]
    sizes = np.array([len(g[0]) for g in found], np.int64)
    own = np.fromiter(chain.from_iterable(g[0] for g in found), np.int64, int(sizes.sum()))
    groups, flat = np.unique(own, return_inverse=True)
    of_group = np.array([(*pair.sizes[g], 1, len(pair.pairs[g])) for g in groups.tolist()], np.int64).reshape(-1, 4)
    of_unit = [_sums(of_group[flat, c], sizes) for c in range(4)]
    lengths = np.array([len(c) for c in codes], np.int64)
    every = np.concatenate([*codes, np.zeros(0, np.uint32)]).astype(np.int64)
    shas = []
    for c in codes:
        h = hashlib.sha256()
        for at in range(0, len(c), PIECE):
            h.update((";" * (at > 0) + ";".join(map(spelled.__getitem__, c[at : at + PIECE].tolist()))).encode())
        shas.append(h.hexdigest() if len(c) else "")
    times = np.bincount(every, minlength=len(found))
    freq = np.bincount(flat, weights=np.repeat(times, sizes), minlength=len(groups)).astype(np.int64)
    row = {"chunk": name, "kind": DOCS, "doc_id": [i for i, _ in rows], "sha": shas, "units": lengths.tolist(), "codes": _pack(every), "unit_sizes": _pack(sizes), "unit_groups": _pack(flat)}
    row |= {c: _sums(x[every], lengths).tolist() for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), of_unit, strict=True)}
    yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)
    used = np.flatnonzero(freq)
    names, pairs = [pair.spelled[g] for g in groups.tolist()], [pair.pairs[g] for g in groups.tolist()]
    for at in range(0, len(used), 1 << 16):
        part = used[at : at + (1 << 16)]
        made = {
            "chunk": pa.array([name] * len(part)), "kind": pa.array(np.full(len(part), GROUPS, np.int32)), "code": pa.array(part.astype(np.int32)),
            "grp": pa.array([names[k] for k in part]), "n": pa.array(freq[part]), "pairs": pa.array([pairs[k] for k in part], _LONGS),
        }
        yield pa.record_batch([made[f.name] if f.name in made else pa.nulls(len(part), f.type) for f in _SCHEMA], schema=_SCHEMA)


@memo
def _pair(a: bytes, b: bytes, overlaps: bool) -> Pair:
    return Pair(a, b, overlaps)


def encode(docs: DataFrame, a: str = f"{FOLDER}/byte_bpe_50k.json", b: str = f"{FOLDER}/piece_bpe_32k.model", overlaps: bool = False) -> DataFrame:
    """docs (doc_id long, text) -> a stored table of chunks: rows of kind DOCS and of kind GROUPS.

    The vocabulary files are read by the driver and travel with the function (about 2 MB).
    """
    with open(a, "rb") as f, open(b, "rb") as g:
        files = f.read(), g.read()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, rows, chars, made, task = _pair(*files, overlaps), [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                rows.append((i, text))
                chars += len(text or "")
                if chars >= CHUNK_CHARS or len(rows) >= CHUNK_DOCS:
                    yield from _chunk(f"{task}-{made}", rows, pair)
                    rows, chars, made = [], 0, made + 1
        if rows:
            yield from _chunk(f"{task}-{made}", rows, pair)

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, _DDL))


def group_table(encoded: DataFrame) -> DataFrame:
    """grp, n (occurrences in the corpus), pairs: a row for each distinct group."""
    return encoded.where(F.col("kind") == GROUPS).groupBy("grp").agg(F.sum("n").alias("n"), F.first("pairs").alias("pairs"))


def pair_counts(groups: DataFrame) -> DataFrame:
    """pair, a, b, count, best: each linked id pair, how many links hold it, and whether none of its B id holds more.

    The highest counts are a row for each B id, so that the vocabulary bounds what is broadcast.
    """
    counts = groups.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def _per_document(docs: pa.Table, marks: pa.Table) -> pa.Table:
    out = {c: [] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
    for k in range(docs.num_rows):  # one: a chunk
        row = {c: docs.column(c)[k] for c in docs.column_names}
        size, flat = _unpack(row["unit_sizes"].as_py()), _unpack(row["unit_groups"].as_py())
        codes, lengths = _unpack(row["codes"].as_py()), np.array(row["units"].as_py(), np.int64)
        at = marks.column("code").to_numpy()
        for c in ("n_best", "count_sum"):
            of_group = np.zeros(int(flat.max()) + 1 if len(flat) else 0, np.int64)
            of_group[at] = marks.column(c).to_numpy()
            out[c] += _sums(_sums(of_group[flat], size)[codes], lengths).tolist()
        for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links"):
            out[c] += row[c].as_py()
        out["groups_sha256"] += row["sha"].as_py()
    kinds = {c: pa.string() if c == "groups_sha256" else pa.int64() for c in out}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})


def alignment(docs: DataFrame, **files) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row for each row.

    Null and empty texts, and those that a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty
    digest. Rows that repeat, ids included, count as often as they stand; null ids stay. Other columns are not read.
    """
    encoded = encode(docs, **files)
    groups = group_table(encoded)
    pairs = pair_counts(groups)
    marks = groups.select("grp", F.explode("pairs").alias("pair")).join(pairs.select("pair", "count", "best"), "pair")
    marks = marks.groupBy("grp").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    back = encoded.where(F.col("kind") == GROUPS).select("chunk", "code", "grp").join(marks, "grp").select(F.col("chunk").alias("of"), "code", "n_best", "count_sum")
    chunks = encoded.where(F.col("kind") == DOCS).select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "units", "codes", "unit_sizes", "unit_groups")
    columns = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_per_document, columns)
