"""What a result shows of a chunk: excerpts by bytes and keyword snippets by tokens."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunking import rune_floor
from .text import PY_SPACE, py_fold, py_terms, py_words

#: Bytes of an excerpt, bytes in which its opening looks for a gap, tokens of a snippet.
EXCERPT, OPENING, SNIPPET = 160, 40, 16
DOTS = "…"
#: What separates sentences: a stop, then white space up to the next token.
_STOP = re.compile(r"[.:][ \t\n\r]+\Z")
#: Weights of a phrase's first occurrence in a window, and of a window that begins a sentence or the text.
NEW, SENTENCE_OPENS, TEXT_OPENS = 1000, 100, 120


def head(data: bytes, most: int = EXCERPT) -> str:
    """The first bytes of a text, to a whole character."""
    return data.decode() if len(data) <= most else data[: rune_floor(data, most)].decode() + DOTS


def excerpt(text: str, words: list[str], most: int = EXCERPT) -> str:
    """A window around the earliest of the words; the text's head if none occurs.

    Case is folded letter by letter where that keeps a letter's length, so a
    place found in the folded text is the same place in the text.
    """
    same = [ch.lower() if len(ch.lower().encode()) == len(ch.encode()) else ch for ch in text]
    folded = "".join(same)
    wanted = [w.strip(PY_SPACE).lower() for w in words]
    places = [folded.find(w) for w in wanted if len(w.encode()) >= 2]
    at = min((p for p in places if p >= 0), default=-1)
    data = text.encode()
    if at <= 0:
        return head(data, most)
    start = rune_floor(data, max(0, len(text[:at].encode()) - most // 3))
    if start > 0:
        gap = re.search(rb"[ \n\t]", data[start : start + OPENING])
        start += gap.end() if gap else 0
    return (DOTS if start else "") + head(data[start:], most)


def excerpts(text: Column, words: list[str], most: int = EXCERPT) -> Column:
    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else excerpt(t, words, most))

    return work(text)


_TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*")


def token_spans(text: str) -> list[tuple[str, int, int]]:
    """(folded term, begin, end) of the tokens of a text, in code points."""
    return [(py_fold(m[0]), m.start(), m.end()) for m in _TOKEN.finditer(text)]


def snippet(text: str, query: str, size: int = SNIPPET, mark: str = f" {DOTS} ") -> str:
    """The window of `size` tokens that shows most of the query's phrases; dots mark where text is left out.

    For every occurrence two windows are weighed: the one that begins with it,
    then moved so that its matches lie in the middle, and the one that begins
    with the sentence it is in. A phrase counts NEW the first time and 1 after
    that; a sentence's beginning adds a little, the text's beginning a little
    more. The first of the best windows wins.
    """
    tokens = token_spans(text)
    if not tokens:
        return text
    terms = [t for t, _, _ in tokens]
    hits: list[tuple[int, int, int]] = []
    for number, phrase in enumerate(filter(None, (py_terms(w) for w in py_words(query)))):
        hits += [(i, number, len(phrase)) for i, t in enumerate(terms) if t == phrase[0] and terms[i : i + len(phrase)] == phrase]
    hits.sort()
    begins = [h[0] for h in hits]
    openings = [0] + [i for i in range(1, len(tokens)) if _STOP.search(text, tokens[i - 1][2], tokens[i][1])]

    def inside(at: int) -> list[tuple[int, int, int]]:
        return hits[bisect_left(begins, at) : bisect_left(begins, at + size)]

    def weight(found: list[tuple[int, int, int]]) -> int:
        return len(found) + (NEW - 1) * len({p for _, p, _ in found})

    best, start = 0, 0
    for at in begins:
        found = inside(at)
        if (w := weight(found)) > best:
            spare = size - (found[-1][0] + found[-1][2] - at)
            best, start = w, max(0, min(at - int(spare / 2), len(tokens) - size))
        opening = openings[bisect_right(openings, at) - 1]
        if len(tokens) > size and opening < at and (w := weight(inside(opening)) + (TEXT_OPENS if opening == 0 else SENTENCE_OPENS)) > best:
            best, start = w, opening
    end = min(len(tokens), start + size)
    first = 0 if start == 0 else tokens[start][1]
    last = len(text) if end == len(tokens) else tokens[end - 1][2]
    return (mark if start else "") + text[first:last] + (mark if end < len(tokens) else "")


def snippets(text: Column, query: str, size: int = SNIPPET) -> Column:
    @F.pandas_udf("string")
    def work(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else snippet(t, query, size))

    return work(text)
