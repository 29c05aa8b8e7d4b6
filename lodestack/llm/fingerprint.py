"""Context-triggered piecewise hashing: fingerprints whose likeness is that of the texts.

A rolling hash over seven bytes ends a piece wherever its low bits are all
ones; each piece becomes one of 64 letters. The block size, a power of two,
follows from a text's length: on average a text has 32 to 64 pieces. Where the
context triggers too often or too seldom, as in repetitive texts, the least and
the greatest length of a piece decide. The fingerprint holds the signatures for
the block size and for twice it, so that texts of similar length have a block
size in common. Signatures of the same block size are compared by edit distance.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST_BLOCK, PIECES = 7, 4, 64
#: A piece has at least the block size / SHORT and at most LONG block sizes of bytes.
SHORT, LONG = 4, 4
#: Bytes that are hashed at a time; a text's own size bounds nothing else but its bytes.
SEGMENT = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1 ** (j + 1) & 0xFFFFFFFF for j in range(WINDOW)], dtype=np.uint32)


def _rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte but the first six of data."""
    n = len(data) - WINDOW + 1
    h = np.zeros(n, dtype=np.uint32)
    wide = data.astype(np.uint32)
    for j in range(WINDOW):
        h += wide[j : j + n] * _MULTIPLIERS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h


class _Pieces:
    """The letters of a text's pieces at one block size, fed with segments of the text."""

    def __init__(self, block: int):
        self.block, self.last, self.sum, self.letters = block, -1, np.uint64(0), []

    def feed(self, at: int, h: np.ndarray, running: np.ndarray) -> None:
        """h, running: the rolling hash and its running sum at the bytes from at on."""
        ends = (np.flatnonzero((h & np.uint32(self.block - 1)) == self.block - 1) + at).tolist()
        stop = at + len(h)
        while True:
            k = bisect_left(ends, self.last + max(1, self.block // SHORT))
            end = min(ends[k] if k < len(ends) else stop, self.last + LONG * self.block)
            if end >= stop:
                return
            self.take(end, running[end - at])

    def take(self, end: int, total: np.uint64) -> None:
        piece = int(total) - int(self.sum) & 0xFFFFFFFFFFFFFFFF
        self.letters.append(LETTERS[((piece ^ piece >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> 58])
        self.last, self.sum = end, total


def fingerprint(text: str | bytes) -> str:
    """block size:signature:signature at twice the block size; an empty text's is '4::'."""
    data = text.encode() if isinstance(text, str) else text
    block = LEAST_BLOCK
    while block * PIECES < len(data):
        block *= 2
    scales, total = (_Pieces(block), _Pieces(2 * block)), np.uint64(0)
    for at in range(0, len(data), SEGMENT):
        before = data[at - WINDOW + 1 : at] if at else bytes(WINDOW - 1)
        h = _rolling(np.frombuffer(before + data[at : at + SEGMENT], dtype=np.uint8))
        running = np.cumsum(h ^ (h << np.uint32(7)), dtype=np.uint64) + total
        total = running[-1]
        for s in scales:
            s.feed(at, h, running)
    for s in scales:
        if s.last < len(data) - 1:
            s.take(len(data) - 1, total)
    return f"{block}:{''.join(scales[0].letters)}:{''.join(scales[1].letters)}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, by bit-parallel columns."""
    if not a or not b:
        return len(a) + len(b)
    if a == b:
        return 0
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & mask, up & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
    return score


def likeness(a: str, b: str) -> float:
    """0 to 1: one for equal fingerprints, zero for block sizes that aren't compatible, else by edit distance."""
    if a == b:
        return 1.0
    (size_a, a1, a2), (size_b, b1, b2) = a.split(":"), b.split(":")
    size_a, size_b = int(size_a), int(size_b)
    pairs = [(a1, b1), (a2, b2)] if size_a == size_b else [(a1, b2)] if size_a == 2 * size_b else [(a2, b1)] if size_b == 2 * size_a else []
    return max((1 - edit_distance(x, y) / max(len(x), len(y)) for x, y in pairs if x and y), default=0.0)


def edited_text(text: str, following: str) -> str:
    """text with its last quarter replaced by as much of the beginning of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _listed(numbers: list, kind: str = "bigint") -> Column:
    """A constant array, however long: one literal instead of an expression an item."""
    return F.expr(f"cast(split('{','.join(map(str, numbers))}', ',') as array<{kind}>)")


def _range_of(splits: list[int]) -> Column:
    """How many of the ascending splits aren't above doc_id, by halving; 0 for null."""
    if not splits:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(splits).bit_length()))]
    bounds = _listed(splits)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows (range, tail, doc_id, text) dealt so that a task has its rows in order of (range, tail, doc_id, text).

    The rows of a range that have tail 0 are consecutive documents; what
    follows the last of them is the first row with tail 1, a copy of the next
    range's first document (after the last range: of the first).
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    splits = []
    if parts > 1:
        marks = _listed([i / parts for i in range(1, parts)], "double")
        splits = sorted(set(ids.agg(F.percentile_approx("doc_id", marks, F.lit(max(10000, 2 * parts))).alias("s")).first()["s"] or []))
    # Null ids come before all others.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select(_range_of(splits).alias("range"), "doc_id", "text")
    firsts = {r["range"]: (r["first"], r["nulls"]) for r in rows.groupBy("range").agg(F.min("doc_id").alias("first"), (F.count("*") - F.count("doc_id")).alias("nulls")).collect()}
    present = sorted(firsts)
    if not present:
        return rows.withColumn("tail", F.lit(0)).limit(0)
    before = {r: present[i - 1] for i, r in enumerate(present)}
    every = range(len(splits) + 1)
    to = F.get(_listed([before.get(r, 0) for r in every], "int"), F.col("range"))
    first = F.get(_listed([firsts.get(r, (0, 0))[0] or 0 for r in every]), F.col("range"))
    is_first = F.col("doc_id") == first
    if firsts.get(0, (0, 0))[1]:  # only the first range holds null ids
        is_first = F.when(F.col("range") == 0, F.col("doc_id").isNull()).otherwise(is_first)
    own = F.struct(F.col("range").alias("range"), F.lit(0).alias("tail"))
    copies = F.when(is_first, F.array(own, F.struct(to.alias("range"), F.lit(1).alias("tail")))).otherwise(F.array(own))
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("_to")).select("_to.range", "_to.tail", "doc_id", "text")
    return dealt.repartitionById(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text")


def neighbours(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text) and of its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is the next row by (doc_id, text),
    null ids first; after the last comes the first, and a single row is its own
    next. A null text is empty. Repeated rows are documents of their own. Other
    columns are left out; an empty table gives an empty result.

    The texts are shuffled once, by ranges of doc_id; a task holds two texts at
    a time. Only quantiles and first ids of the ranges reach the driver. Ranges
    can't divide rows with one doc_id.
    """
    parts = parts or max(8, 2 * docs.rdd.getNumPartitions())
    fields = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]

    def row(doc, following):
        (doc_id, text, print_), (_, next_text, next_print) = doc, following
        edited = edited_text(text, next_text)
        edited_print = print_ if edited == text else fingerprint(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), print_, edited_print, likeness(print_, edited_print), likeness(print_, next_print)

    def work(batches):
        rows, held, held_range = [], None, None

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])

        for b in batches:
            for number, tail, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if tail and held_range != number:
                    continue  # only the first tail row follows the range's last document
                text = text.as_py()
                doc = (doc_id, text, fingerprint(text))
                if held is not None:
                    rows.append(row(held, doc))
                held, held_range = (None, None) if tail else (doc, number)
                if len(rows) >= 1000:
                    yield batch()
                    rows.clear()
        if rows:
            yield batch()

    return with_next(docs, parts).mapInArrow(work, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise-hash fingerprints of every document and its edited text."""
    return neighbours(read(spark, sf_dir, "documents").select("doc_id", "text"))
