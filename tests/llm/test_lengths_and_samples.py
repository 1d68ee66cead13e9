"""Passages depend on an item's own length; no language is too large to be learned."""

import pytest

from placefabric.llm import decontaminate, language_id
from tests_text import words_of


@pytest.mark.parametrize("index_bytes", [1 << 10, 8 << 20])
def test_a_long_item_changes_nothing_for_short_ones(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", index_bytes)
    short = [(k, f"{words_of(12, 20 * k)}? {words_of(6, 20 * k + 12)}.") for k in range(59)]
    question, answer = short[7][1].split("? ")
    apart = f"{question} {words_of(900, 3000)} {answer}"
    whole = f"{words_of(300, 4000)} {short[8][1]} {words_of(300, 5000)}"
    long_item = (99, f"{words_of(3000, 9000)}? {words_of(1000, 20000)}.")
    docs = spark.createDataFrame([(1, apart), (2, whole), (3, f"{words_of(50, 6000)} {long_item[1]} {words_of(50, 7000)}")], "doc_id long, text string")
    found = []
    for items in (short, [*short, long_item]):
        rows = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        found.append({(r.doc_id, r.item_id) for r in rows})
    assert found == [{(2, 8)}, {(2, 8), (3, 99)}]


def test_classes_are_powers_of_two():
    assert [decontaminate.length_class(n) for n in (0, 1, 64, 65, 128, 129, 5000)] == [6, 6, 6, 7, 7, 8, 13]


def test_every_language_keeps_a_sample():
    for n in (1, 400, 419_430_401, 10**12, 10**18):
        share = language_id.least_hashes(n) / language_id.HASHES
        assert share > 0 and share * n == pytest.approx(min(n, language_id.SAMPLE_DOCS), rel=1e-3)


def test_rows_without_id_and_one_text_count_once(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_DOCS", 5)
    rows = [(None, "the same header of every page", "en")] * 3000 + [(k, f"eigener Text Nummer {words_of(9, k)}", "de") for k in range(40)]
    learned = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) <= {"en", "de"} and len(learned.get("en", b"")) < 100
