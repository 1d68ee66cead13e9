"""Every alternative of every license template is found by the scan, whatever words it begins with."""

import re
from itertools import product

from placefabric.llm.license_scan import TEMPLATES, compile_all, hints, license_scan


def phrases(markup, optional):
    """The wordings of a template by its alternatives, with all optional parts or none."""
    choices, depth = [], 0
    for part in re.findall(r"\[|\]|\{\w+:\d+\}|[^\s\[\]{}]+", markup):
        if part in "[]":
            depth += 1 if part == "[" else -1
        elif depth and not optional:
            continue
        elif part[0] == "{":
            choices.append([" ".join(["filler"] * int(part[part.index(":") + 1 : -1]))] if optional else [""])
        else:
            choices.append(part.split("/"))
    return [" ".join(w) for w in product(*choices)]


def test_each_alternative_reaches_its_automaton(spark):
    wanted = [(label, text.title() if k % 2 else text) for label, markups in TEMPLATES.items() for m in markups for full in (False, True) for k, text in enumerate(phrases(m, full))]
    df = spark.createDataFrame([(k, f"Note: {text}.") for k, (_, text) in enumerate(wanted)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan(df).collect()}
    missed = [text for k, (label, text) in enumerate(wanted) if label not in got[k].labels.split(",") or not got[k].score]
    assert missed == []


def test_licenses_without_the_word_license(spark):
    texts = ["Released under CC BY 4.0", "available under a Creative Commons CC BY-SA 4.0", "Available under CC BY NC 3.0", "nothing of the kind"]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(got, key=lambda r: r.doc_id)] == ["cc-by", "cc-by-sa", "cc-by-nc", ""]


def test_hints_are_words_of_all_paths():
    found = hints(compile_all())
    for markups in TEMPLATES.values():
        for m in markups:
            for full in (False, True):
                assert all(any(h in text.encode() for h in found) for text in phrases(m, full))
