"""The prefix tree against one made of plain dictionaries, with ranges so small that most paths cross their borders."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from placefabric.llm.conversation_trie import conversation_trie, prefix_tree, rebuilt, sequences

TURNS = "conv_id long, turn long, role string, text string, n_convs string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_tree(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = set()

    def walk(p):
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        for k in kids[p]:
            a, b = walk(k)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves, saved, digest))
        return leaves, saved

    if members:
        walk(())
    return out


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        out[c] = tuple(base[:h] + turns[h:])
    return out


def random_rows(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(130), 200, 201, 305, -7, -105, 10**12 + 3, None]:
        like = r.choice([0, 0, 0, 1, 2])
        n = r.choice([0, 1, 2, 3, 5, 9, 30])
        for t in range(n):
            rows.append((c, t if t or r.random() < 0.8 else None, ["user", "assistant", None][t % 3], f"{like if t < 6 else r.choice([like, c])} é𝄞{t}" if t else ["hot", "", None][r.choice([0, 0, 0, 1, 2])], "x"))
    return [x for x in rows if x[0] is None or x[0] % 7 or x[0] > 100]


@pytest.mark.parametrize("ranges", [1, 3, 16, 60])
def test_tree_equals_plain_tree(spark, ranges):
    rows = random_rows(ranges)
    convs = rebuilt(sequences(spark.createDataFrame(rows, TURNS)))
    got = prefix_tree(convs, ranges)
    assert got.columns == COLUMNS or sorted(got.columns) == sorted(COLUMNS)
    found = [tuple(r) for r in got.select(COLUMNS).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain_tree(plain_rebuilt(rows))


def test_whole_query_over_rows_and_copies(spark):
    """Thousands of copies in several blocks of ids, a path of 3,000 turns, a null turn, repeated rows, roles alone, no turns left."""
    copies = [(c << 19, t, "user", "same", "") for c in range(400) for t in range(2)]
    long_ = [(7, t, "user", f"t{t}", "") for t in range(3000)]
    odd = [(55, None, None, None, ""), (55, 3, "user", "x" * 100_000, ""), (55, 3, "user", "x" * 100_000, ""), (56, 0, "user", "", ""), (99_901, 0, "user", "gone", "")]
    rows = copies + long_ + odd
    got = {tuple(r) for r in conversation_trie(spark.createDataFrame(rows, TURNS)).select(COLUMNS).collect()}
    assert got == plain_tree_deep(plain_rebuilt(rows))


def plain_tree_deep(seqs):
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        return plain_tree(seqs)
    finally:
        sys.setrecursionlimit(limit)


def test_empty_and_turnless(spark):
    assert not conversation_trie(spark.createDataFrame([], TURNS)).count()
    only = spark.createDataFrame([(3, [])], "conv_id long, units array<string>")
    assert [tuple(r) for r in prefix_tree(only).select(COLUMNS).collect()] == [(3, 0, None, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]


def test_texts_are_told_from_roles(spark):
    rows = [(1, 0, "a", "bc", ""), (2, 0, "ab", "c", ""), (3, 0, "1:a", "", ""), (4, 0, "", "1:a", "")]
    units = sequences(spark.createDataFrame(rows, TURNS)).select(F.explode("units").alias("u"))
    assert units.distinct().count() == 4
