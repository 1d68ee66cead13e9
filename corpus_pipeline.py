"""The corpus pipeline: five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents, extra ones included. An empty table stays empty in every stage. What a
run writes stays in the shared folder, so that a lost stage can be read again; clearing it is up to the caller.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placefabric.llm.components import checkpoint_folder, materialise
from placefabric.llm.decontaminate import without_leaks
from placefabric.llm.language_id import learn, predict
from placefabric.llm.ngram_join import ngram_components
from placefabric.llm.secret_scan import redact
from placefabric.llm.source_mix import mix_sources


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language ID rejects: no letters, or a narrow margin in a text long enough to judge.

    Null and empty texts have no letters. Repeated rows are judged alike; null ids and languages don't matter.
    """
    return predict(docs, learn(docs.select("doc_id", "text", "lang"))).where(~F.col("rejected")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component of documents alike in five-word shingles (0.8 or more).

    Rows that repeat a doc_id stand for one document; the first by text stays. Rows without an id, and those without words,
    link with nothing and stay.
    """
    found = materialise(ngram_components(docs, width=5, num=8, den=10).select("doc_id", "component_id"))
    heads = found.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(heads, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
    repeated = materialise(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct(F.coalesce("text", F.lit("")), F.to_json(row))).alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item. Null and empty texts hold none; repeated rows are judged alike."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by a mark; n_chars follows. All rows stay; null texts stay null, with their n_chars."""
    return redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    Null and wordless texts have no words and aren't taken. Repeated rows and null ids are documents of their own; a null
    source is a source. Columns of these four names are replaced.
    """
    return mix_sources(docs, keep=docs.columns).where("taken > 0")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", scan_secrets),
    ("source_mix", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is a Parquet table in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
