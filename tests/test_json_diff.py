"""JSON differences against a plain recursion."""

import json
import random

from placefabric.operators.json_diff import json_differences

GONE = object()


def kind(v):
    return "missing" if v is GONE else "null" if v is None else "boolean" if isinstance(v, bool) else "object" if isinstance(v, dict) else "array" if isinstance(v, list) else "string" if isinstance(v, str) else "number"


def plain(a, b, path, ignore, tolerance):
    if kind(a) != kind(b):
        yield path, "extra" if a is GONE else "missing" if b is GONE else "type"
    elif kind(a) == "array":
        for i in range(max(len(a), len(b))):
            yield from plain(a[i] if i < len(a) else GONE, b[i] if i < len(b) else GONE, f"{path}[{i}]", ignore, tolerance)
    elif kind(a) == "object":
        for k in a.keys() | b.keys():
            if k not in ignore:
                yield from plain(a.get(k, GONE), b.get(k, GONE), f"{path}.{k}" if k.isidentifier() else f"{path}[{json.dumps(k)}]", ignore, tolerance)
    elif abs(a - b) > tolerance if kind(a) == "number" else a != b:
        yield path, "value"


def grown(r, depth):
    if depth == 0 or r.random() < 0.3:
        return r.choice([None, True, False, 0, 1, 1.0, 1.5, 2, "", "a", "1", [], {}])
    if r.random() < 0.5:
        return [grown(r, depth - 1) for _ in range(r.randrange(4))]
    return {k: grown(r, depth - 1) for k in r.sample(["a", "b", "skip", "odd key", 'q"t', "c"], r.randrange(5))}


def test_equals_a_recursion(spark):
    r = random.Random(2)
    docs = [(k, grown(r, 4), grown(r, 4)) for k in range(120)] + [(200 + k, d, d) for k, d in enumerate(grown(r, 5) for _ in range(20))]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b), "clash") for k, a, b in docs], "id long, left string, right string, path string")
    got = {(x.id, x.path, x.kind) for x in json_differences(df, ["skip"], 0.5).collect()}
    assert got == {(k, p, d) for k, a, b in docs for p, d in plain(a, b, "$", {"skip"}, 0.5)}


def test_values_missing_sides_and_broken_texts(spark):
    df = spark.createDataFrame([(1, '{"a":1}', '{"a":"1"}'), (2, None, "3"), (3, "{", "{}"), (4, None, None), (5, "7", None)], "id long, left string, right string")
    got = {x.id: (x.path, x.kind, x.left, x.right) for x in json_differences(df).collect()}
    assert got == {1: ("$.a", "type", "1", '"1"'), 2: ("$", "extra", None, "3"), 3: ("$", "invalid", "{", "{}"), 5: ("$", "missing", "7", None)}


def test_no_pairs(spark):
    assert json_differences(spark.createDataFrame([], "id long, left string, right string")).count() == 0
