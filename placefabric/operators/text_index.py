"""Posting lists of trigrams for fuzzy search.

A run of a text's trigrams can reach a share of the query's only if the text has that share of the query's trigrams at all:
with n of them, ceil(share * n) must be in the text. So a match has one of the n - ceil(share * n) + 1 rarest, and only
their lists are read; what they name is counted whole, and the search for the best run is left with what passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placefabric.functions import text as t

FLOOR = 0.3


def needed(n: Column | int, floor: float = FLOOR) -> Column | int:
    """Trigrams of a query of n that a text must have to reach the floor."""
    if isinstance(n, int):
        return max(1, -int(-(floor * n - 1e-9) // 1))
    return F.greatest(F.lit(1), F.ceil(n * F.lit(floor) - F.lit(1e-9)).cast("int"))


def grams(x: Column) -> Column:
    """The distinct trigrams of a text's words, two blanks before and one after each. Null texts have none."""
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    each = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(each))


def may_match(x: Column, query: str, floor: float = FLOOR) -> Column:
    """Whether a text has as many of one query's trigrams as the floor needs; false for a query without any."""
    own = sorted(set(t.ordered_trigrams(query)))
    if not own:
        return F.lit(False)
    return F.size(F.array_intersect(grams(x), F.array(*[F.lit(g) for g in own]))) >= needed(len(own), floor)


def _similarities(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pd.DataFrame({"q": pdf.q, "text": pdf.text, "similarity": [t.extent_similarity(q, x) for q, x in zip(pdf.q, pdf.text, strict=True)]})


class TrigramIndex:
    """Lists by trigram of a table's distinct texts, in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.frequencies = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/frequencies")

    @classmethod
    def build(cls, texts: DataFrame, path: str) -> TrigramIndex:
        """texts (text string) -> lists sorted by trigram, so that a query's read skips the others, and their lengths. Null texts are left out."""
        rows = texts.where("text is not null").select("text").distinct().select("text", F.explode(grams(F.col("text"))).alias("gram"))
        rows.repartitionByRange("gram", "text").sortWithinPartitions("gram").write.parquet(f"{path}/postings")
        spark = texts.sparkSession
        spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/frequencies")
        return cls(spark, path)

    def candidates(self, queries: DataFrame, floor: float = FLOOR) -> DataFrame:
        """queries (q string) -> q, text: every text that has the trigrams it needs to reach the floor."""
        own = queries.where("q is not null").select("q").distinct().withColumn("own", grams(F.col("q"))).withColumn("need", needed(F.size("own"), floor))
        each = own.select("q", "need", F.size("own").alias("n"), F.explode("own").alias("gram")).join(self.frequencies.withColumnRenamed("n", "texts"), "gram", "left")
        rarest = each.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.coalesce("texts", F.lit(0)), "gram"))).where(F.col("rank") <= F.col("n") - F.col("need") + 1)
        found = rarest.where("texts is not null").select("q", "gram").join(self.postings, "gram").select("q", "text").distinct()
        shared = F.size(F.array_intersect("own", grams(F.col("text"))))
        return found.join(own, "q").where(shared >= F.col("need")).select("q", "text")

    def matches(self, queries: DataFrame, floor: float = FLOOR) -> DataFrame:
        """queries (q string) -> q, text, similarity of all texts that reach the floor: the rows of a full scan."""
        scored = self.candidates(queries, floor).mapInPandas(_similarities, "q string, text string, similarity double")
        return scored.where(F.col("similarity") >= floor)
