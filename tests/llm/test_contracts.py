"""Columns of the corpus queries, and the cases that once went wrong: ties in the mix, cut statistics, cut texts."""

import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest

from placefabric.llm import decontaminate, dom, edit_fingerprint, html_extract, language_id, queries, source_mix
from placefabric.llm.edit_fingerprint import near_classes
from placefabric.llm.decontaminate import K1, NGRAM, OVERLAP, PASSAGE, THRESHOLD, B, find_leaks, hashed_words, split_item

COLUMNS = {
    "op1_benchmark_decontamination": "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double",
    "op2_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint, copies bigint",
    "ngram_jaccard_links": "doc_id bigint, n_shingles bigint, component_id bigint, copies bigint, n_links bigint",
    "op3_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op5_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op6_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op7_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "fingerprint_classes": "doc_id bigint, class_id bigint, n_links bigint",
    "op8_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean",
    "op9_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op11_cross_tokenizer_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op12_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_chat_formatting": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op10_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert ", ".join(f"{c} {t}" for c, t in queries.QUERIES[name](spark, sf).dtypes) == COLUMNS[name]


def mixed(spark, rows, keep=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return source_mix.mix_sources(df, keep=keep).collect()


@pytest.mark.parametrize("equal", [False, True])
def test_mix_cuts_inside_null_ids_and_equal_rows(spark, equal):
    r = random.Random(1)
    rows = [(None, "same few words" if equal else " ".join("abcdefgh"[: r.randint(1, 8)] for _ in range(r.randint(1, 9))), "a") for _ in range(200)]
    rows += [(k, "one two three four five six", "b") for k in range(200)]
    for keep in (None, ["doc_id", "source"]):
        got = mixed(spark, rows, keep)
        assert len(got) == 400 and sorted(map(str, got)) == sorted(map(str, mixed(spark, rows, keep)))
        for of in ([x for x in got if x.doc_id is None], [x for x in got if x.doc_id is not None]):
            assert abs(sum(x.taken for x in of) - of[0].target) <= max(x["size"] for x in of)
            assert all(x.taken <= 3 * x["size"] for x in of)


def test_mix_in_inner_ranges_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(source_mix, "COPIES", 7)
    monkeypatch.setattr(source_mix, "BROADCAST_ROWS", 0)
    rows = [(None, "x y", None)] * 50 + [(k, "word " * (k % 7), "ab"[k % 2]) for k in range(100)]
    got = mixed(spark, rows)
    assert Counter((x.doc_id, x["size"]) for x in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    by = {}
    for x, n in Counter(got).items():
        by.setdefault((x.source_size, x.target), []).append(n * x.taken)
    assert all(abs(sum(t) - target) <= 6 for (_, target), t in by.items())


def test_leaks_are_those_of_brute_force(spark, monkeypatch):
    """BM25 over all items, n-gram overlap of question and answer, every passage of every text."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, f"{say(r.randint(3, 14))}? {say(r.randint(2, 9))}.") for k in range(150)]
    items += [(150, items[3][1]), (151, items[4][1].upper())]
    docs = []
    for k in range(120):
        words = say(r.randint(0, 500)).split()
        for _ in range(r.randint(0, 3)):
            t = r.choice(items)[1].split()
            if r.random() < 0.5:
                t[r.randrange(len(t))] = "other"
            at = r.randint(0, len(words))
            words[at:at] = t
        docs.append((k, " ".join(words)))
    split = {i: [w.tolist() for w in hashed_words([t, *split_item(t)])] for i, t in items}
    mean = sum(len(w) for w, _, _ in split.values()) / len(split)
    df = Counter(t for w, _, _ in split.values() for t in set(w))
    width = max(PASSAGE, 2 * max(len(w) for w, _, _ in split.values()))
    expected = {}
    for d, text in docs:
        w = hashed_words([text])[0].tolist()
        for a in range(0, max(1, len(w) - width // 2), width // 2) if w else ():
            own = w[a : a + width]
            grams = {tuple(own[i : i + n]) for n in range(1, NGRAM + 1) for i in range(len(own) - n + 1)}
            for i, (whole, q, ans) in split.items():
                impact = {t: math.log(1 + (len(split) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(whole) / mean)) for t, f in Counter(whole).items()}
                score = sum(x for t, x in impact.items() if t in set(own)) / sum(impact.values())
                share = [sum(g in grams for g in p) / len(p) for p in ({tuple(x[j : j + NGRAM]) for j in range(max(1, len(x) - NGRAM + 1))} for x in (q, ans))]
                if score >= THRESHOLD and min(share) >= OVERLAP:
                    expected[d, i] = max(score, expected.get((d, i), 0))
    assert len(expected) > 50
    df_docs, df_items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 700):  # one index and many: scores are the same
        monkeypatch.setattr(decontaminate, "INDEX_BYTES", size)
        got = {(x.doc_id, x.item_id): x.score for x in find_leaks(df_docs, df_items).collect()}
        assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_language_is_learned_from_any_part_of_a_text(spark):
    r = np.random.default_rng(0)
    known = {x: ["".join(r.choice(list(x), 9)) for _ in range(60)] for x in ("abcdefg", "stuvwxyz")}
    say = lambda letters, n: " ".join(r.choice(known[letters], n))
    rows = [(k, "9 " * 3000 + say("abcdefg" if k % 2 else "stuvwxyz", 1500), "one" if k % 2 else "two") for k in range(40)]
    dictionaries = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(any(c.isalpha() for c in d.decode()) for d in dictionaries.values())
    got = language_id.predict(spark.createDataFrame([(say("abcdefg", 30),), (say("stuvwxyz", 30),)], "text string"), dictionaries).collect()
    assert [x.lang_pred for x in got] == ["one", "two"]


def test_language_with_many_labels_and_with_none(spark):
    rows = [(k, f"text number {k} of its own {'xyz'[k % 3] * 9}", f"lang{k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.learn(df)) == 300
    got = language_id.identify(df.withColumn("lang", df["lang"].substr(1, 0))).collect()
    assert {x.lang_pred for x in got} == {""}
    assert {(x.lang_pred, x.score) for x in language_id.identify(spark.createDataFrame([(1, "words", None)], df.schema)).collect()} == {("und", 0.0)}


def extracted(pages):
    return ["\n".join(b) for b in html_extract.main_blocks([html_extract.Page(p) for p in pages], html_extract.model())]


def test_html_drops_controls_and_marked_inline_elements():
    story = "<p>The river rose for the third day in a row, and the town began to move its boats.</p>"
    page = f'<html><body><nav><a href=/>Home</a></nav><article><h1>High water</h1>{story}<p>A <b>bold</b> plan was made, and so on.<button>Share this</button> <span class="advert">Buy now cheap</span> Then they <span class="hl">all</span> went home.</p>{story}<label>Your mail</label></article></body></html>'
    text = extracted([page])[0]
    assert text.split("\n") == ["High water", story[3:-4], "A bold plan was made, and so on. Then they all went home.", story[3:-4]]


def test_html_keeps_a_block_whole_around_inline_nodes():
    root = dom.parse('<p>a <span class="ad">b <span>c</span> d</span> e <a href=x>f<div>g</div></a> h', frozenset({"ad"}))
    p = root.children[0]
    assert [c.tag for c in p.children if isinstance(c, dom.Node)] == ["span"] and p.children[1].flat and [c[0] for c in p.children[1].children] == ["b ", "c", " d"]
    assert [c.tag for c in root.children if isinstance(c, dom.Node)] == ["p", "div"]


def test_html_of_very_long_pages_takes_time_in_proportion():
    start = time.perf_counter()
    sizes = [len(t) for t in extracted(["<article>" + "<p>Some words of a sentence.</p>" * 100_000 + "</article>", "<h3>unclosed " * 100_000, "<tr><td>x" * 50_000, "</b></div>" * 100_000, '<p "' * 50_000, "<li>" * 100_000 + "</li>" * 100_000])]
    assert sizes[0] >= 100_000 * 20 and time.perf_counter() - start < 120


def test_html_rows_close_rows():
    root = dom.parse("<table><tr><td>a<td>b<tr><td>c</table>d")
    table = root.children[0]
    assert [[c.tag for c in row.children] for row in table.children] == [["td", "td"], ["td"]] and root.children[1][0] == "d"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, text, edits):
    t = list(text)
    for _ in range(edits):
        k = r.randrange(len(t)) if t else 0
        t[k : k + r.randint(0, 1)] = r.choice(["", "x", "q", " "])
    return "".join(t)


def test_edits_within_is_the_edit_distance():
    r = random.Random(2)
    for _ in range(150):
        a = "".join(r.choice("abc ") for _ in range(r.randint(0, 60)))
        b = edited(r, a, r.randint(0, 9)) if r.random() < 0.7 else "".join(r.choice("abc ") for _ in range(r.randint(0, 60)))
        n = distance(a, b)
        for most in {0, n - 1, n, n + 2} - {-1}:
            assert edit_fingerprint.edits_within(a, b, most) == (n <= most), (a, b, n, most)


def test_near_classes_find_near_copies(spark, empty):
    """Recall of pairs of neighbours at several rates of edits, against what was planted; no unlike texts are linked."""
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(900)]
    rows, family, n = [], {}, 0
    for f in range(60):
        base = " ".join(r.choice(vocabulary) for _ in range(r.choice([12, 60, 300, 900])))
        for k in range(20 if f < 2 else 3):
            rows.append((n, base if k == 0 else edited(r, base, max(1, len(base) * r.choice([1, 5, 15]) // 1000))))
            family[n] = f
            n += 1
    rows += [(n, rows[0][1]), (n + 1, None), (None, rows[0][1]), (n + 2, ""), (n + 3, rows[5][1])]
    family |= {n: 0, n + 3: family[5]}
    got = {x.doc_id: x for x in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.doc_id is not None}
    assert len(got) == len(rows) - 1 and got[n + 1].class_id == n + 1 and got[n + 2].n_links == 0
    assert all(family[i] == family[got[i].class_id] for i in family)
    least = {}
    for i, f in family.items():
        least[f] = min(i, least.get(f, i))
    found = sum(got[i].class_id == least[f] for i, f in family.items() if i != least[f])
    assert found >= 0.95 * (len(family) - len(least))
    assert near_classes(empty).count() == 0


def test_bands_without_a_near_leader_are_split(spark, monkeypatch):
    monkeypatch.setattr(edit_fingerprint, "SMALL", 3)
    r = random.Random(9)
    letters = "abcdefghijklmnop "
    start = "".join(r.choice(letters) for _ in range(700))
    rows, n = [], 0
    for _ in range(12):
        rest = "".join(r.choice(letters) for _ in range(400))  # a third of each text is its family's own
        for k in range(3):
            rows.append((n, edited(r, start + rest, k)))
            n += 1
    got = {x.doc_id: x.class_id for x in near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] // 3 == i // 3 for i in got) and sum(got[i] == i - i % 3 for i in got) >= 0.9 * len(got)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    expected = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    rows = Counter(expected.fetchall())
    assert Counter(tuple(r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect()) == rows and set(columns) == set(queries.QUERIES[name](spark, sf).columns)
