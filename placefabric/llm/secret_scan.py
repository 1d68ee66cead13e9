"""Secret scanning: three base patterns, and an assignment-aware lexer over source and configuration syntax.

The lexer reads quoted strings, names, numbers and operators. `name = "literal"`, `name: literal`, `"name": "literal"`,
`name => literal`, `-Dname=literal`, `--name=literal`, `name := literal`, `map["name"] = "literal"` and
`<name>literal</name>` give name-literal pairs, strings with a letter before the quote among them; `a + b`, adjacent
strings and `${a}` or a bare name on the right side are resolved from constants bound before in the same text, on either
side of a concatenation. A literal is scored by its target's name and by its own look (length, character classes,
entropy); a pair above the threshold is a span `lexed`, and so is every literal that a constant in it was bound to.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "lexed")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Name parts that make a target sensitive, with their weight.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.6, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "key": 0.5, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "private": 0.5, "access": 0.3, "client": 0.1, "signing": 0.4, "bearer": 0.9, "salt": 0.5, "session": 0.3,
}
THRESHOLD = 1.0

# One lexical step: where a name, or a quoted name, is followed by an assigning operator. Everything else is passed over
# by the regular expression engine; a run without = or : costs nothing more.
_TARGET = re.compile(r"""(?<![A-Za-z0-9_$.-])(?:-D|--?)?(["']?)([A-Za-z_$][A-Za-z0-9_$.-]*+)\1(?:(?<=["'])\])?[\x20\t]*(?::=|=>|=(?!=)|:(?![:/]))[\x20\t]*""")
_QUOTED = re.compile(r'(?:[bBfFrRuU]{1,2}(?=["\']))?(?:"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'|`((?:[^`\\\n]|\\.)*)`)')
_ELEMENT = re.compile(r"<([A-Za-z][A-Za-z0-9_.-]*+)>([^<>\s]{6,}+)</\1>")
_BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#%^*$-]+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z")
_IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*+(?:\.[A-Za-z_$][A-Za-z0-9_$]*+)*+(?![\x20\t]*\()")
_JOIN = re.compile(r"[\x20\t]*(?:\+|\.\.|&)?[\x20\t]*(?=[\"'`])")
_PLUS = re.compile(r"[\x20\t]*(?:\+|\.\.|&)[\x20\t]*(?=[A-Za-z_$\"'`])")
_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_.]*)\}")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base matches that hold, by start and kind."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name.rpartition(".")[2])]
    joined = [*parts, *("".join(p) for p in zip(parts, parts[1:], strict=False))]
    return min(1.5, sum(SENSITIVE.get(p, 0.0) for p in dict.fromkeys(joined)))


def look(value: str) -> float:
    """0..1: how much a literal looks like key material rather than like a word, a path or a placeholder."""
    return look_of(Counter(value))


def look_of(counts: Counter[str]) -> float:
    """look of a text that has each character so often; the numbers may be of any size."""
    n = counts.total()
    if n < 6 or len(counts) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values() if c / n > 0)
    kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in counts}
    return min(1.0, 0.12 * len(kinds) + 0.1 * max(0.0, entropy - 1.5) + 0.01 * min(n, 32))


class Literal:
    """A resolved right side: its place as written, the constants in it by reference, and how often it has each character.

    Constants are never put together as text, so that one made of others costs what it adds, however long it would be.
    """

    __slots__ = ("counts", "place", "used")

    def __init__(self, counts: Counter[str], used: list[Literal], place: tuple[int, int] | None = None):
        self.counts, self.used, self.place = counts, used, place


def _merged(parts: list[Literal]) -> Literal:
    if len(parts) == 1:
        return Literal(parts[0].counts, parts[0].used)
    counts: Counter[str] = Counter()
    for p in parts:
        counts.update(p.counts)
    return Literal(counts, [u for p in parts for u in p.used])


def _operand(text: str, at: int, bound: dict[str, Literal]) -> tuple[Literal, int, int, int] | None:
    """(literal, start, end as written, end with the quote) of a string or a bound name."""
    if q := _QUOTED.match(text, at):
        k = q.lastindex
        value, parts, done = q[k], [], 0
        for r in _REFERENCE.finditer(value):
            if r[1] in bound:
                parts += [Literal(Counter(value[done : r.start()]), []), Literal(bound[r[1]].counts, [bound[r[1]]])]
                done = r.end()
        return _merged([*parts, Literal(Counter(value[done:]), [])]), q.start(k), q.end(k), q.end()
    if (r := _REFERENCE.match(text, at)) and r[1] in bound:
        return Literal(bound[r[1]].counts, [bound[r[1]]]), r.start(), r.end(), r.end()
    if (n := _IDENTIFIER.match(text, at)) and n[0] in bound:
        return Literal(bound[n[0]].counts, [bound[n[0]]]), n.start(), n.end(), n.end()
    return None


def pairs(text: str) -> Iterator[tuple[str, Literal]]:
    """Name-literal pairs in order of place, with their resolved literals. An element's text is the literal of its name."""
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield m[1], Literal(Counter(m[2]), [], m.span(2))
    if "=" not in text and ":" not in text:
        return
    bound: dict[str, Literal] = {}
    for m in _TARGET.finditer(text):
        name, at = m[2], m.end()
        b = _BARE.match(text, at)
        operand, parts = _operand(text, at, bound), []
        if operand:
            start = operand[1]
            while operand:
                parts.append(operand[0])
                end, after = operand[2], operand[3]
                j = after > end and _JOIN.match(text, after) or _PLUS.match(text, after)  # only strings stand side by side
                operand = _operand(text, j.end(), bound) if j else None
        quoted = parts and start > at  # what begins with a quote is no bare literal, whatever stands before the quote
        if b and not quoted and not text.startswith("${", at) and (not parts or end < b.end() and len(parts) == 1):
            start, end = b.span()  # a bare literal, not a name alone
            known = bound.get(b[0]) if _NAME.match(b[0]) else None
            value = Literal(known.counts, [known]) if known else Literal(Counter(b[0]), [])
        elif parts:
            value = _merged(parts)
        elif b:
            start, end = b.span()
            value = Literal(Counter(b[0]), [])
        else:
            continue
        value.place = start, end
        bound[name] = value
        yield name, value


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """The literals of sensitive targets and all that the constants in them were bound to. Every constant is visited once."""
    seen: set[Literal] = set()
    places: set[tuple[int, int]] = set()
    weights: dict[str, float] = {}
    for name, literal in pairs(text):
        if name not in weights:
            weights[name] = name_weight(name)
        if not weights[name] or (value := look_of(literal.counts)) < 0.45 or weights[name] + value < THRESHOLD + 0.4:
            continue
        todo = [literal]
        while todo:
            one = todo.pop()
            if one not in seen:
                seen.add(one)
                places.add(one.place)
                todo += one.used
    return [("lexed", *place) for place in places]


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    return base, sorted([*base, *lexed_spans(text)], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, a row for each row.

    Null texts are empty. Rows that repeat and null ids are rows like any other; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[list, list, list] = ([], [], [])
            digests, said = [], []
            for t in batch.column(1):
                base, spans = all_spans(t.as_py() or "")
                n = Counter(k for k, _, _ in base)
                for c, k in zip(counts, KINDS, strict=False):
                    c.append(n[k])
                digests.append(hashlib.sha256(_said(base).encode()).hexdigest())
                said.append(_said(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(said, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every span of the text replaced by a mark and n_chars, if there, set anew. Null texts stay null."""
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for _, a, b in all_spans(text)[1]:
            if b <= done:
                continue
            if a >= done:
                out += [text[done:a], mark]
            done = b
        return "".join(out) + text[done:] if done else text

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, texts = list(batch.columns), [clean(t.as_py()) for t in batch.column(at)]
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            if count is not None:
                cols[count] = pa.array([n if t is None else len(t) for t, n in zip(texts, cols[count].to_pylist(), strict=True)], batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
