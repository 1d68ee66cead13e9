"""Every link of the n-gram join, counted for each document, against all pairs."""

import random
import re

import pytest

from placefabric.llm import ngram_join
from placefabric.llm.ngram_join import ngram_links


def by_hand(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append(frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    links = lambda a, b: bool(a) and bool(b) and len(a & b) * den >= num * len(a | b)
    return {rows[k][0]: (len(s), sum(links(s, x) for m, x in enumerate(sets) if m != k and rows[m][0] is not None) if rows[k][0] is not None else 0) for k, s in enumerate(sets)}


@pytest.mark.parametrize("short,block", [(16, 4096), (3, 40)])
def test_each_link_counts_once(spark, monkeypatch, short, block):
    r = random.Random(7)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(70)]
        for k in range((90, 12, 4)[g]):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(70)] = f"z{k}_{r.randrange(9)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (502, None), (503, ""), (504, "alone"), (505, "alone"), (None, rows[3][1])]
    monkeypatch.setattr(ngram_join, "SHORT", short)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.n_links) for x in ngram_links(df, 3, 8, 10).collect()}
    assert got == by_hand(rows, 3, 8, 10) and max(n for _, n in got.values()) > 20
