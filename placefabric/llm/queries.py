"""The corpus queries by name, each over its whole table, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placefabric.llm import oracles
from placefabric.llm.chat_format import chat_digests, with_probe
from placefabric.llm.conversation_trie import conversation_trie
from placefabric.llm.decontaminate import find_leaks
from placefabric.llm.edit_fingerprint import near_classes, neighbour_fingerprints
from placefabric.llm.html_extract import extract
from placefabric.llm.language_id import identify
from placefabric.llm.license_scan import license_scan
from placefabric.llm.ngram_join import ngram_components, ngram_links
from placefabric.llm.secret_scan import secret_spans
from placefabric.llm.source_mix import mix_sources
from placefabric.llm.substring_dedup import substring_dedup
from placefabric.llm.suffix_dedup import suffix_dedup
from placefabric.llm.token_alignment import alignment


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_links(_table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=400)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), length=50)


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(_table(spark, sf_dir, "documents"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(with_probe(_table(spark, sf_dir, "conversations"), spark))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_ngram_jaccard_join,
        ngram_jaccard_links,
        op3_source_mix,
        op4_html_extraction,
        op5_suffix_array_dedup,
        op6_substring_dedup,
        op7_document_fingerprints,
        fingerprint_classes,
        op8_language_id,
        op9_license_scan,
        op10_secret_scan,
        op11_cross_tokenizer_alignment,
        op12_conversation_trie,
        op13_chat_formatting,
    )
}
ORACLES = {"op2_ngram_jaccard_join": oracles.OP2, "op5_suffix_array_dedup": oracles.OP5, "op6_substring_dedup": oracles.OP6, "op12_conversation_trie": oracles.OP12, "op13_chat_formatting": oracles.OP13}
