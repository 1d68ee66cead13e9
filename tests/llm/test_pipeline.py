from collections import Counter

import pytest

import corpus_pipeline
from placefabric.llm import queries


def test_stages_keep_columns_and_follow(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    benchmark = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        n = docs.count()
        assert 0 < n <= before
        if k < 4:
            assert docs.columns == columns
        before = n
    texts = [r.text for r in docs.collect()]
    assert not any(b in t for t in texts for b in benchmark)
    assert docs.where("taken <= 0 or taken > 3 * size").count() == 0


def test_stages_on_edge_cases(spark, edges, sf):
    """Nulls, blanks, repeated rows, near copies and clashing columns, each stage on what the one before kept."""
    after, docs = {}, edges
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        after[name] = docs.collect()
        if name != "source_mix":
            assert docs.columns == edges.columns
    by = {k: Counter(r.doc_id for r in v) for k, v in after.items()}
    rows = Counter(r.doc_id for r in edges.collect())
    gone = {4, 5, 6, 14, 15}  # null, empty and blank texts have no letters; one letter, one syllable again and again are near no language
    assert by["language_id"] == Counter({k: n for k, n in rows.items() if k not in gone})
    near = by["ngram_jaccard_join"]
    assert near[1] == 1 and near[13] == 1 and 2 not in near and 3 not in near and near[None] == rows[None]
    assert near[10] == 1 and 11 not in near and 17 not in near  # equal texts without case
    assert by["benchmark_decontamination"] == near and by["secret_scan"] == near
    mixed = after["source_mix"]
    assert all(r.taken > 0 and r.taken % r["size"] == 0 and r.taken <= 3 * r["size"] for r in mixed) and {"lang", "component_id"} <= set(docs.columns)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_an_empty_table(empty, spark, sf, name, stage):
    got = stage(spark, empty, sf)
    assert got.count() == 0 and (name == "source_mix" or got.columns == empty.columns)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


def test_mix_takes_columns_without_a_hash(spark):
    rows = spark.sql("select id as doc_id, concat('some words ', id) as text, 'en' as lang, 'web' as source, 12L as n_chars, map('k', id, 'j', 1L) as meta, array(map('a', 1)) as more, parse_json('{\"a\":1}') as v from range(6)")
    out = corpus_pipeline.mix(spark, rows, "")
    assert out.count() == 6 and {"meta", "more", "v", "taken"} <= set(out.columns)
