"""Secret scans: patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads `name = literal` pairs in the syntaxes of programs, shells,
JSON, YAML, INI and XML attributes; joins literals by + ; follows names to the
constants they stand for, the latest assignment above or else the first below;
and scores each literal by how sensitive the names are that it reaches. Its
time is linear in the text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, read

KINDS = ("assign", "access", "hex", "literal")
MASK = "[SECRET]"
#: Literals that score at least this are secrets.
THRESHOLD = 0.5
#: Shorter literals are no secrets.
SHORT = 8

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of [0-9a-f]+ is matched whole or not at all, so the length can stand in the pattern.
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words in a name that make its value sensitive, and those that do so by half.
STRONG = {"password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "credential", "credentials", "privatekey", "accesskey", "secretkey", "authkey", "bearer"}
WEAK = {"key", "pass", "auth", "signature", "salt", "cert", "dsn", "cookie", "session", "login", "private", "access", "api"}
_LIKELY = re.compile(r"pass|pwd|secret|token|key|cred|bearer|auth|private|signature|salt|cert|dsn|cookie|session|login|access|api", re.I | re.A)
#: A bare name is tried at the first character of its run only, and no run is given back, so that the search is linear.
_NAME = re.compile(r"""(?:(["'])([A-Za-z_][\w.\-]*+)\1|(?<![\w.\-])[\d.\-]*+([A-Za-z_][\w.\-]*+))[ \t]*+(?:=>|:=|[:=](?![:=]))[ \t]*+""", re.A)
_TERM = re.compile(r""""((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s"'`,;{}()\[\]<>#+]++)""", re.A)
_PLUS = re.compile(r"[ \t]*\+[ \t]*\n?[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Values that stand for one to be filled in, apart from those that _stands_in() tells by their ends.
_PLACEHOLDER = re.compile(r"(?:example|sample|changeme|change_me|placeholder|your|dummy|test|todo|none|null|true|false|undefined|nil|env|os|process)(?![A-Za-z0-9])", re.I | re.A)
#: Characters of a joined value's beginning that _PLACEHOLDER needs, and of its end that _stands_in() needs.
_HEAD, _TAIL = 16, 2
_SYMBOLS, _WORD_CHARS = frozenset("xX*.-_"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


class Span(NamedTuple):
    """A found secret: where it is, and where its value is, in code points, ends exclusive."""

    start: int
    kind: int
    end: int
    value_start: int
    value_end: int


def base_spans(text: str) -> list[Span]:
    """The pattern matches, leftmost and without overlap in each kind; those that are too short are dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [Span(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [Span(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


class Assignment(NamedTuple):
    name: str
    terms: list[tuple[str | None, str, int, int]]  # (referred name or None, literal, start, end)


def assignments(text: str) -> list[Assignment]:
    """The name-literal pairs of a text in order; a bare term is a name if it reads as one, else a literal."""
    out, at = [], 0
    while m := _NAME.search(text, at):
        name, at, terms = m[2] or m[3], m.end(), []
        while t := _TERM.match(text, at):
            k = t.lastindex
            literal, start, end = t[k], t.start(k), t.end(k)
            refers = literal if k == 4 and re.fullmatch(r"[A-Za-z_][\w.]*", literal, re.A) else None
            terms.append((refers, literal, start, end))
            at = t.end()
            if not (p := _PLUS.match(text, at)):
                break
            at = p.end()
        if terms:
            # A bare term may itself be a name: `outer: inner = "x"`.
            nested = len(terms) == 1 and terms[0][0] and re.match(r"[ \t]*(?:=>|:=|[:=])", text[at : at + 8])
            if nested:
                at = terms[0][2]
            else:
                out.append(Assignment(name, terms))
    return out


def sensitivity(name: str) -> float:
    """0 to 1: how likely a value of this name is secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = {"".join(words[i : i + 2]) for i in range(len(words))} | set(words)
    if joined & STRONG:
        return 1.0
    hits = len(set(words) & WEAK)
    return 0.0 if not hits else 0.5 if hits == 1 else 0.8


class Value(NamedTuple):
    """What a literal's score is taken from: its characters' counts, its beginning and its end. Joining two needs no more than that."""

    counts: Counter
    head: str
    tail: str

def joined(parts: list[str | Value]) -> Value:
    """The value of literals and values one after the other."""
    counts, head, tail = Counter(), "", ""
    for x in parts:
        text = isinstance(x, str)
        counts.update(x if text else x.counts)
        if len(head) < _HEAD:
            head = (head + (x[:_HEAD] if text else x.head))[:_HEAD]
        tail = (tail + (x[-_TAIL:] if text else x.tail))[-_TAIL:]
    return Value(counts, head, tail)


_EMPTY = Value(Counter(), "", "")


def _stands_in(v: Value, length: int) -> bool:
    """Whether a value is a placeholder: dashes and crosses, a reference to a variable, a tag, or a word like 'changeme'."""
    if v.counts.keys() <= _SYMBOLS:
        return True
    for begins, ends in (("${", "}"), ("{{", "}}"), ("<", ">")):
        if v.head.startswith(begins) and v.tail.endswith(ends) and length >= len(begins) + len(ends):
            return True
    others = v.counts.keys() - _WORD_CHARS
    if v.head[:1] == "$" and others == {"$"} and v.counts["$"] == 1 and length > 1:
        return True
    if v.head[:1] == "%" == v.tail[-1:] and others == {"%"} and v.counts["%"] == 2 and length > 2:
        return True
    return bool(_PLACEHOLDER.match(v.head))


def strength(value: str | Value) -> float:
    """0 to 1: how much a literal looks like a secret, by length, character classes and entropy."""
    v = value if isinstance(value, Value) else joined([value])
    length = sum(v.counts.values())
    if length < SHORT or any(c.isspace() for c in v.counts) or _stands_in(v, length):
        return 0.0
    bits = -sum(n / length * math.log2(n / length) for n in v.counts.values())
    kinds = {"a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else "." for c in v.counts}
    return min(1.0, bits * length / 48) * (0.4 if len(kinds) < 2 else 0.8 if len(kinds) == 2 else 1.0)


def references(found: list[Assignment]) -> list[list[int | None]]:
    """For every term of every assignment the number of the assignment it refers to: None for a literal, -1 for nothing but itself.

    That is the latest assignment of the name above it, else the first one below.
    """
    first: dict[str, int] = {}
    for i, a in enumerate(found):
        first.setdefault(a.name, i)
    latest: dict[str, int] = {}
    out = []
    for i, a in enumerate(found):
        row: list[int | None] = []
        for refers, *_ in a.terms:
            j = None if refers is None else latest.get(refers, first.get(refers))
            row.append(-1 if j == i else j)
        out.append(row)
        latest[a.name] = i
    return out


def literal_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants.

    Every assignment is resolved once, whatever the number of names that refer
    to it and the length of the chains between them; a name that is being
    resolved already, in a circle, adds nothing.
    """
    if not ("=" in text or ":" in text) or not _LIKELY.search(text):
        return []
    found = assignments(text)
    refers = references(found)
    values: dict[int, Value | None] = {}  # None: being resolved

    def resolve(root: int) -> Value:
        todo = [root]
        while todo:
            i = todo[-1]
            if values.get(i) is not None:
                todo.pop()
                continue
            open_ = [j for j in refers[i] if j is not None and j >= 0 and j not in values]
            values[i] = None
            if open_:
                todo += open_
                continue
            parts = [literal if j is None else values.get(j) or _EMPTY for j, (_, literal, *_) in zip(refers[i], found[i].terms, strict=True)]
            values[i] = parts[0] if len(parts) == 1 and isinstance(parts[0], Value) else joined(parts)
            todo.pop()
        return values[root] or _EMPTY

    reached, todo, weights = set(), [], {}
    for i, a in enumerate(found):
        if a.name not in weights:
            weights[a.name] = sensitivity(a.name)
        if not weights[a.name] or all(j is None for j in refers[i]) and sum(len(t[1]) for t in a.terms) < SHORT:
            continue
        if weights[a.name] * strength(resolve(i)) >= THRESHOLD:
            todo.append(i)
    out = set()
    while todo:
        i = todo.pop()
        if i not in reached:
            reached.add(i)
            out.update((start, end) for j, (_, _, start, end) in zip(refers[i], found[i].terms, strict=True) if j is None and end > start)
            todo += [j for j in refers[i] if j is not None and j >= 0]
    return [Span(s, 3, e, s, e) for s, e in sorted(out)]


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): a literal within a base span isn't listed again."""
    base, more, at, reach = base_spans(text), [], 0, -1
    for x in literal_spans(text):
        while at < len(base) and base[at].start <= x.start:
            reach = max(reach, base[at].end)
            at += 1
        if x.end > reach:
            more.append(x)
    return base, sorted(base + more)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def redact(text: str) -> str:
    """The text with every secret value replaced by MASK; overlapping values are replaced as one."""
    spans = sorted((s.value_start, s.value_end) for s in find(text)[1])
    out, at = [], 0
    for start, end in spans:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], MASK]
        at = end
    return "".join([*out, text[at:]]) if spans else text


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs (doc_id, text).

    Every row is scanned whole and by itself: no shuffle. A null text is empty;
    an empty text has no spans and the hash of ''. Repeated rows each get their
    row. Other columns are left out. An empty table gives an empty result.
    """
    fields = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def work(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, spans = find(text.as_py() or "")
                kinds = [s.kind for s in base]
                rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with secret values in text replaced by MASK, and n_chars (if there) as the new length.

    All columns and rows stay; rows without a secret are unchanged, null texts stay null.
    """
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def work(batches):
        for batch in batches:
            column = batch.column(at)
            before = column.to_pylist()
            after = [redact(t) if t else t for t in before]
            if after != before:
                arrays = list(batch.columns)
                arrays[at] = pa.array(after, type=column.type)
                if count is not None:
                    old = arrays[count].to_pylist()
                    arrays[count] = pa.array([len(a) if a is not None and a != b else n for a, b, n in zip(after, before, old, strict=True)], type=arrays[count].type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return map_arrow(docs, work, docs.schema)


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    return scan(read(spark, sf_dir, "documents"))
