"""Language identification by compression.

One raw-content zstandard dictionary for each language comes from a bounded sample of labelled texts. A text is encoded
in pieces with every dictionary, and the language of the smallest total wins. Letters count alone,
without case. The score is five times the relative margin of the best over the second, 1 at most; a text whose margin is narrow is rejected.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS = 400  # labelled texts of a language, at most about so many, chosen by hash
SAMPLE_CHARS = 2_000  # of each, a window at a place chosen by hash
HASHES = 1 << 62
BROADCAST_ROWS = 10_000  # languages up to which their counts are broadcast
DICTIONARY_BYTES = 96 << 10
PIECE = 2_048  # code points encoded at once
LEVEL = 5
NARROW = 0.001  # relative margin under which a text is rejected
ENOUGH = 40  # letters (with spaces) under which a margin says too little to reject
_LETTER = re.compile(r"[^\W\d_]")
_OTHERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, everything but letters folded to single spaces."""
    return _OTHERS.sub(" ", text.lower())


def least_hashes(n: int) -> int:
    """How far the hashes of the sampled texts of a language go, of so many texts: never 0, however many they are."""
    return min(HASHES, max(1, (SAMPLE_DOCS * HASHES) // n))


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """(doc_id, text, lang) -> a dictionary for each language. Null texts and languages are left out.

    About SAMPLE_DOCS texts of a language, the ones of least hash, reach the driver, of each a window of SAMPLE_CHARS that
    a hash places. The languages with most texts stand first; the order decides ties. One count of each language reaches
    the driver too. Without labelled texts there is no dictionary.
    """
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", labelled["text"].cast("string").alias("text"), labelled["lang"].cast("string").alias("lang"))
    hashed = labelled.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(HASHES)))
    counts = {r["lang"]: r["n"] for r in hashed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    limits = labelled.sparkSession.createDataFrame([(lang, least_hashes(n)) for lang, n in counts.items()], "lang string, most long")
    if len(counts) <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    rows = hashed.join(limits, "lang").where("h < most").select("lang", "h", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).dropDuplicates(["lang", "h"])  # rows of one id and text count once
    by_lang = defaultdict(list)
    for r in rows.collect():
        by_lang[r["lang"]].append((r["h"], r["text"]))
    out = {}
    for lang, found in by_lang.items():
        taken, size = [], 0
        for _, text in sorted(found):
            if size >= DICTIONARY_BYTES:
                break
            taken.append(letters(text).encode())
            size += len(taken[-1])
        out[lang] = b" ".join(reversed(taken))[-DICTIONARY_BYTES:]  # what stands last is nearest
    return {lang: out[lang] for lang in sorted(out, key=lambda x: (-counts[x], x))}


def classify(text: str | None, coders: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected); `und` for null texts and texts without letters."""
    if not text or not coders or not _LETTER.search(text):
        return "und", 0.0, True
    text = letters(text)
    pieces = [text[i : i + PIECE].encode() for i in range(0, len(text), PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), k) for k, (_, c) in enumerate(coders))
    best = coders[sizes[0][1]][0]
    if len(sizes) == 1:
        return best, 1.0, False
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return best, min(1.0, margin * 5), margin < NARROW and len(text) >= ENOUGH


def coders(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=DICTIONARY_BYTES, source_size=2 * PIECE, write_content_size=False, write_dict_id=False)
    for lang, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Adds lang_pred, score and rejected to the rows of docs, whose column text it reads; null texts are `und` and rejected.

    The dictionaries are bounded (DICTIONARY_BYTES for each language) and travel with the function. Rejected: `und`, or
    a margin under NARROW in a text of ENOUGH letters. Without any learned language every text is `und`.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]
    docs = docs.select([F.col(f"`{f.name}`") for f in fields])
    at = [f.name for f in fields].index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coders(dictionaries)
        for batch in batches:
            found = [classify(t.as_py(), own) for t in batch.column(at)]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text mod 4 is 2; a null id isn't held out."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, rejected, a row for each row.

    Only rows that aren't held out are learned from.
    """
    learned = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, learned).select("doc_id", "held_out", "lang_pred", "score", "rejected")
