"""Text normal forms and matching, as column expressions; the extent similarity is a pandas function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and their plain forms.
ACCENTED = "àáâãäåāăąçćčďđèéêëēėęěğìíîïīįıłñńňòóôõöøōőŕřśşšșťţțùúûüūůűųýÿźżž"
PLAIN = "aaaaaaaaacccddeeeeeeeegiiiiiiilnnnoooooooorrsssstttuuuuuuuuyyzzz"


def fold(x: Column) -> Column:
    """Trimmed, lower case, without accents; ligatures spelt out."""
    x = F.translate(F.lower(F.trim(x)), ACCENTED, PLAIN)
    for whole, apart in (("ß", "ss"), ("æ", "ae"), ("œ", "oe")):
        x = F.replace(x, F.lit(whole), F.lit(apart))
    return x


def norm(x: Column) -> Column:
    """The folded text, null if nothing is left."""
    return F.nullif(fold(x), F.lit(""))


def has_keyword(x: Column, keywords: list[str]) -> Column:
    """Any keyword as whole words: ' ' || x || ' ' like '% keyword %'."""
    padded = F.concat(F.lit(" "), F.coalesce(x, F.lit("")), F.lit(" "))
    out = F.lit(False)
    for k in keywords:
        out = out | padded.contains(f" {k} ")
    return out


def words_matched(hay: Column, words: list[str]) -> Column:
    """How many of the words occur anywhere."""
    out = F.lit(0)
    for w in words:
        out = out + F.coalesce(F.contains(hay, F.lit(w)).cast("int"), F.lit(0))
    return out


def keyword_bag(*parts: Column) -> Column:
    return F.concat_ws(" ", *[norm(p) for p in parts])


def trigrams(word: str) -> list[str]:
    padded = f"  {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def ordered_trigrams(text: str) -> list[str]:
    out: list[str] = []
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        out += trigrams(w)
    return out


def extent_similarity(query: str, text: str | None) -> float:
    """The largest Jaccard share of the query's trigrams with a contiguous run of the text's ordered trigrams."""
    q = set(ordered_trigrams(query))
    t = ordered_trigrams(text or "")
    if not q or not t:
        return 0.0
    best = 0.0
    hits = [i for i, g in enumerate(t) if g in q]
    for k, a in enumerate(hits):  # the best run begins and ends in a hit
        seen: set[str] = set()
        shared = 0
        last = a
        for b in hits[k:]:
            for g in t[last : b + 1]:
                if g not in seen:
                    seen.add(g)
                    shared += g in q
            last = b + 1
            best = max(best, shared / (len(q) + len(seen) - shared))
    return best


def word_similarity(query: str):
    """A column function of the extent similarity to a constant query; computed once for each distinct text of a batch."""

    @F.pandas_udf("double")
    def similarity(texts: pd.Series) -> pd.Series:
        known = {t: extent_similarity(query, t) for t in texts.dropna().unique()}
        return texts.map(known).fillna(0.0).astype(float)

    return similarity


def stable_jitter(x: Column) -> Column:
    """0 .. 0.999 from a 32-bit polynomial hash of the id's digits."""
    codes = F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    return (h % 1000) / 1000


def url_shape(x: Column) -> Column:
    """A request path with its ids, tiles and queries masked."""
    x = F.regexp_replace(x, r"\?.*$", "")
    x = F.regexp_replace(x, r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", ":uuid")
    x = F.regexp_replace(x, r"/\d+/\d+/\d+", "/:z/:x/:y")
    return F.regexp_replace(x, r"/\d+", "/:id")
