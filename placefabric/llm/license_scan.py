"""License scanning by template-markup matching.

A template is mandatory words with marked regions: `[words]` is optional and may nest, `{name:n}` stands for up to n words
of any kind, `a/b` for either word. Templates compile into automata over tokens, which run as sets of states from every
place where their first words stand. A text is accepted where all mandatory wording matches, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placefabric.llm.arrays import chunks, lower_table, mark_table, word_spans

#: Phrases of the base part and their labels.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))

TEMPLATES = {
    "mit": (
        "released/licensed/distributed/available under [the terms of] the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software [the software is provided as is without warranty of any kind express or implied {disclaimer:90}]",
    ),
    "apache-2.0": (
        "licensed/released/distributed under the apache license [v/version 2 [0]]",
        "licensed under the apache license version 2 0 the license you may not use this {what:3} except in compliance with the license [you may obtain a copy of the license at {url:9}]",
    ),
    "gpl-2.0": ("gnu general public license [as published by the free software foundation] [either] version/v 2",),
    "gpl-3.0": (
        "gnu general public license [as published by the free software foundation] [either] version/v 3 [of the license] [or at your option any later version]",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "lgpl": ("gnu lesser/library general public license [[as published by the free software foundation] [either] version/v {version:2}]",),
    "agpl-3.0": ("gnu affero general public license [[as published by the free software foundation] [either] version/v 3]",),
    "bsd": (
        "licensed/released/distributed under [the terms of] the [new/modified/revised/simplified] bsd [2/3 clause] license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3] neither the name of {holder:12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "mpl-2.0": ("mozilla public license [v/version] 2 0",),
    "cc-by": ("licensed/released/available under [the/a] [creative commons/cc] [license] cc/attribution by [v/version] 4/3/2 0/5",),
    "cc-by-sa": ("licensed/released/available under [the/a] [creative commons] cc by sa [v/version] 4/3/2 0/5",),
    "cc-by-nc": ("licensed/released/available under [the/a] [creative commons] cc by nc [sa/nd] [v/version] 4/3/2 0/5",),
    "cc0": ("released/dedicated/available under/to [the] [creative commons] cc0 [1 0]",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
}


@dataclass
class Automaton:
    """Word edges and free moves between numbered states; 0 starts, `final` accepts."""

    words: list[dict[str, set[int]]] = field(default_factory=lambda: [{}])
    any: list[set[int]] = field(default_factory=lambda: [set()])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    final: int = 0
    mandatory: int = 0

    def state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()] - states:
                states.add(s)
                todo.append(s)
        return states

    def match(self, tokens: list[str], at: int) -> int:
        """The end of the longest accepted run of tokens from `at`, or -1."""
        states, end = self.closure({0}), -1
        while states:
            if self.final in states:
                end = at
            if at == len(tokens):
                break
            word, following = tokens[at], set()
            for s in states:
                following |= self.words[s].get(word, set()) | self.any[s]
            states, at = self.closure(following), at + 1
        return end

    def reaches(self, without: str) -> bool:
        """Whether the end can be reached by words other than this one."""
        states, todo = {0}, [0]
        while todo:
            s = todo.pop()
            following = self.free[s] | self.any[s] | {t for w, to in self.words[s].items() if w != without for t in to}
            todo += following - states
            states |= following
        return self.final in states

    def first_words(self) -> set[str]:
        return {w for s in self.closure({0}) for w in self.words[s]}


def compile_template(markup: str) -> Automaton:
    a, at, open_ = Automaton(), 0, []
    for part in re.findall(r"\[|\]|\{\w+:\d+\}|[^\s\[\]{}]+", markup):
        if part == "[":
            open_.append(at)
        elif part == "]":
            a.free[open_.pop()].add(at)
        elif part[0] == "{":
            start, n = at, int(part[part.index(":") + 1 : -1])
            ends = [start]
            for _ in range(n):
                to = a.state()
                a.any[at].add(to)
                ends.append(at := to)
            at = a.state()
            for e in ends:
                a.free[e].add(at)
        else:
            to = a.state()
            for w in part.split("/"):
                a.words[at].setdefault(w, set()).add(to)
            at = to
            a.mandatory += not open_
    a.final = at
    return a


def compile_all(templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[str, list[tuple[str, Automaton]]]:
    """Automata by the words they may begin with."""
    out: dict[str, list[tuple[str, Automaton]]] = {}
    for label, markups in templates.items():
        for m in markups:
            a = compile_template(m)
            for w in a.first_words():
                out.setdefault(w, []).append((label, a))
    return out


def scan_tokens(tokens: list[str], automata: dict[str, list[tuple[str, Automaton]]]) -> tuple[list[int], set[str], set[str], float]:
    """(starts of base phrases, base labels, all labels, score)."""
    starts, base, score = [], set(), 0.0
    for phrase, label in BASE:
        k = len(phrase)
        last = phrase[-1]
        for i, w in enumerate(tokens):
            if w == last and i >= k - 1 and tuple(tokens[i - k + 1 : i + 1]) == phrase:
                starts.append(i - k + 1)
                base.add(label)
                score = 0.5
    labels = set(base)
    for i, w in enumerate(tokens):
        for label, a in automata.get(w, ()):
            if a.match(tokens, i) >= 0:
                labels.add(label)
                score = max(score, a.mandatory / (a.mandatory + 2))
    return starts, base, labels, score


def hints(automata: dict[str, list[tuple[str, Automaton]]]) -> tuple[bytes, ...]:
    """Words of which every text that a template or a base phrase accepts holds one.

    For each automaton the longest word without whose edge no path leads to the end; all its words' edges alike if there is no such word.
    """
    out = {max(phrase, key=len) for phrase, _ in BASE}
    for a in {id(a): a for listed in automata.values() for _, a in listed}.values():
        words = {w for edges in a.words for w in edges}
        needed = [w for w in words if not a.reaches(w)]
        out |= {max(needed, key=lambda w: (len(w), w))} if needed else words
    return tuple(sorted(w.encode() for w in out if not any(o != w and o in w for o in out)))


def license_scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, a row for each row.

    Null texts are empty; rows that repeat and null ids are rows like any other; other columns are not read. first_word and last_word are null where no base phrase stands. Score: 0.5 for a base phrase, and
    m / (m + 2) for an accepted template of m mandatory words; the largest counts, 0 if there is none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compile_all()
        wanted = hints(automata)
        for batch in batches:
            rows: list[tuple] = []
            for at, to, data, offsets in chunks(batch.column(1)):
                data = lower_table()[data]
                starts, ends, first = word_spans(data, offsets, mark_table())
                raw = data.tobytes()
                for k in range(to - at):
                    a, b = int(first[k]), int(first[k + 1])
                    own = raw[offsets[k] : offsets[k + 1]]
                    found: tuple = ([], (), (), 0.0)
                    if any(h in own for h in wanted):
                        found = scan_tokens([raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)], automata)
                    p = found[0]
                    rows.append((b - a, len(p), min(p, default=None), max(p, default=None), ",".join(sorted(found[1])), ",".join(sorted(found[2])), found[3]))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
