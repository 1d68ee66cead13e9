"""Folding against a plain replay of the log; rendering against a plain reader of marks and mask."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from placefabric.llm.chat_format import HEADER, INSTRUCT, KINDS, Template, chat_digests, event_log, fold_events, read_back, render, with_probe

EVENTS = "conv_id long, seq long, position long, kind string, role string, text string, more string"
TURNS = "conv_id long, turn long, role string, text string, position string"


def replayed(events):
    """Messages by (conversation, position), one event after the other."""
    state, roles = defaultdict(dict), {}
    for c, s, p, kind, role, text in sorted({e[:6] for e in events}, key=lambda e: tuple((x is not None, x if x is not None else 0) for x in (e[1], e[2], e[3], e[5], e[4]))):
        if p is None or kind not in KINDS:
            continue
        if kind != "delta":
            state[c] = {q: t for q, t in state[c].items() if q < p}
        if role is not None:
            roles[c, p] = role
        if kind == "delete":
            continue
        state[c][p] = state[c].get(p, "") + (text or "")
    return {(c, p, roles.get((c, p), ""), t) for c, kept in state.items() for p, t in kept.items()}


@pytest.mark.parametrize("span", [1, 7, 4096])
def test_fold_equals_replay(spark, span):
    r = random.Random(span)
    events = []
    for c in [None, 1, 2, 3]:
        for s in r.sample(range(200), 60):
            kind = r.choice([*KINDS, "delta", "delta", "unknown", None])
            events.append((c, s, r.choice([0, 1, 2, 3, 4, None]), kind, r.choice([None, "user", "assistant"]), r.choice([None, "", "a", "bc"]), "x"))
    events += events[::5]
    events += [(9, None, 0, "message", "user", "first", "x"), (9, 0, 0, "delta", None, " then", "x")]
    got = fold_events(spark.createDataFrame(events, EVENTS), span)
    rows = [tuple(x) for x in got.collect()]
    assert set(rows) == replayed(events) and len(rows) == len(set(rows))


def test_fold_of_nothing(spark):
    assert not fold_events(spark.createDataFrame([], EVENTS)).count()
    assert not chat_digests(spark.createDataFrame([], TURNS)).count()


def turns_of(spark):
    long_ = "word <|eot_id|> \\ " * 30_000
    odd = ["", None, "\\", "<|eot_id|>", "<\\|eot_id|>", "a</s>b[INST", "[/INST]", "<|start_header_id|>x<|end_header_id|>", "<|", "\n\n", "é𝄞" * 300, "</s>[INST] ok [/INST]"]
    rows = [(1, k, r, t, "clash") for k, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", None, "[INST]\n") for t in odd)]
    rows += [(2, 5, "assistant", "five", ""), (2, None, "user", "null turn", ""), (2, -3, "user", "minus", ""), (2, 5, "assistant", "five", ""), (2, 5, "assistant", "again", "")]
    rows += [(None, 0, "user", "no id", ""), (None, 1, "assistant", "none", ""), (3, 0, "assistant", long_, "")]
    rows += [(4, k * 700, "assistant" if k % 2 else "user", f"turn {k}", "") for k in range(40)]
    return rows, spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("template", [HEADER, INSTRUCT], ids=["header", "instruct"])
def test_digests(spark, template):
    rows, df = turns_of(spark)
    want = defaultdict(list)
    for c, turn, role, text, _ in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]", ""), (-7, 1, "assistant", "</s>[INST] ok [/INST]", "")]:
        want[c].append((turn is not None, turn or 0, role or "", text or ""))
    got = {r.conv_id: r for r in chat_digests(with_probe(df, spark), template).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("template", [HEADER, INSTRUCT], ids=["header", "instruct"])
def test_formatted_text_reads_back_by_its_marks(spark, template):
    rows, df = turns_of(spark)
    formatted = render(fold_events(event_log(df)), template)
    turn = re.compile("|".join([re.escape(template.opening) + "(?P<role>(?s:.)*?)" + re.escape(template.middle) + "(?P<text>(?s:.)*?)" + re.escape(template.close)]))
    for r, s in zip(read_back(formatted, template).orderBy("conv_id").collect(), formatted.orderBy("conv_id").collect(), strict=True):
        assert r.formatted.startswith(template.start)
        plain = [(re.sub(r"(?s)\\(.)", r"\1", m["role"]), re.sub(r"(?s)\\(.)", r"\1", m["text"])) for m in turn.finditer(r.formatted)]
        assert plain == [(t.role, t.text) for t in r.turns]
        assert sum(r.formatted.count(m) for m in (template.opening, template.close)) == 2 * len(plain)  # no mark inside a text
        at, masked = 0, ""
        for seg in s.segments:
            assert r.formatted.startswith(seg.text, at)
            at += len(seg.text)
            masked += re.sub(r"(?s)\\(.)", r"\1", seg.text) if seg.loss else ""
        assert at == len(r.formatted) and masked == r.loss == "".join(t for role, t in plain if role == "assistant")


def test_every_kind_is_in_the_log(spark, sf):
    kinds = {r.kind for r in event_log(spark.read.parquet(f"{sf}/conversations.parquet")).select("kind").distinct().collect()}
    assert kinds == {"message", "delta", "edit", "regenerate"}


def test_marks_that_could_overlap_are_refused():
    with pytest.raises(ValueError):
        Template("<s>", "aba", "[x]", "</s>")
    with pytest.raises(ValueError):
        Template("<s>", "[\\x]", "(x)", "</s>")
