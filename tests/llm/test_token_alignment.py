"""Alignment of two tokenizers against a plain pass over whole texts."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from placefabric.llm import token_alignment as ta

SCHEMA = "doc_id long, text string, n_a string, chunk int"
ODD = [
    "", None, "a", " ", "  ", "two  spaces", " lead and trail ", "tab\tand\nline\n\n end", "naïve façade 東京 🙂 x🙂y", "x<|endoftext|>y </s> <s> <unk> <0x41>", "don't we'll 'sno 'd", "U+2581 ▁ here", "no break  wide \u0085 next",
    "\x1c \x1d a \x00 b", "ab " * 400, "1234567890 12 345,678.90", "word " * 3000 + "end", "zero​width ​join", "a ́b", "Ünï çödé " * 50, "﻿bom", "x" * 3000, "\r\n \r\n", "a. b! c? (d) [e] {f}", " .hidden  ..x",
]


def plain(texts, overlaps=False):
    """Digests from tokens of whole texts, places as byte offsets, links pair by pair."""
    a = Tokenizer.from_file(f"{ta.FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/piece_bpe_32k.model")
    letters = ta._bytes_of_characters()
    docs, counts = [], Counter()
    for t in texts:
        ids_a, ids_b, groups, links = [], [], [], []
        if t:
            ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            x = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
            y = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                ends = [[sum(map(len, z[: k + 1])) for k in range(len(z))] if len(z) < 3500 else __import__("itertools").accumulate(map(len, z)) for z in (x, y)]
                ends = [list(e) for e in ends]
                cuts = sorted(set(ends[0]) & set(ends[1]))
                before = 0
                for c in cuts:
                    ga = [k for k, e in enumerate(ends[0]) if before < e <= c]
                    gb = [k for k, e in enumerate(ends[1]) if before < e <= c]
                    groups.append(f"{','.join(str(ids_a[k]) for k in ga)}|{','.join(str(ids_b[k]) for k in gb)}")
                    for i in ga:
                        for j in gb:
                            meet = ends[0][i] == ends[1][j] if not overlaps else ends[0][i] - len(x[i]) < ends[1][j] and ends[1][j] - len(y[j]) < ends[0][i]
                            links += [(ids_a[i], ids_b[j])] * meet
                    before = c
            else:
                ids_a, ids_b = [], []
        docs.append((ids_a, ids_b, groups, links))
        counts.update(links)
    most = Counter()
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return [
        (len(p), len(q), len(g), len(ln), sum(counts[k] == most[k[1]] for k in ln), sum(counts[k] for k in ln), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for p, q, g, ln in docs
    ], counts


def digests(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.mark.parametrize("overlaps", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_pass(spark, sf, monkeypatch, overlaps, small):
    if small:  # many chunks, texts in pieces
        monkeypatch.setattr(ta, "CHUNK_CHARS", 3000)
        monkeypatch.setattr(ta, "CHUNK_DOCS", 7)
        monkeypatch.setattr(ta, "PIECE", 50)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 2000").orderBy("doc_id").limit(60).collect()]
    want, counts = plain(texts, overlaps)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    encoded = ta.encode(df, overlaps=overlaps)
    assert {(r.a, r.b): r["count"] for r in ta.pair_counts(ta.group_table(encoded)).collect()} == counts
    got = digests(ta.alignment(df, overlaps=overlaps))
    assert [got[k] for k in range(len(texts))] == want


def test_cuts_keep_the_tokens_of_whole_texts():
    with open(f"{ta.FOLDER}/byte_bpe_50k.json", "rb") as f, open(f"{ta.FOLDER}/piece_bpe_32k.model", "rb") as g:
        pair = ta.Pair(f.read(), g.read(), False)
    assert pair.cuts
    for t in ODD:
        if t and "▁" not in t:
            parts = [u for p in pair.units(t) for u in p]
            whole = pair.groups([t])[0]
            assert whole[0] == tuple(g for u in pair.groups(parts) for g in u[0])


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "one two"), (None, "one two"), (3, "one two"), (3, None)], "doc_id long, text string")
    rows = ta.alignment(df).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in rows) == [(-1, 2), (-1, 2), (3, 0), (3, 2)]
    assert {r.count_sum for r in rows} == {0, 6}
    assert ta.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_text_longer_than_a_chunk(spark):
    text = "many words make a long text, " * 300_000
    r = ta.alignment(spark.createDataFrame([(1, text), (2, "x" * 100_000)], "doc_id long, text string")).where("doc_id = 1").first()
    want, _ = plain(["many words make a long text, " * 30])
    assert (r.n_a - 1, r.n_b - 1) == tuple((x - 1) * 10_000 for x in want[0][:2])
