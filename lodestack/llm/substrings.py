"""Removal of repeated passages: words in a window that also starts in an earlier document.

Windows of `k` words are counted by super-k-mers. Every window has a minimiser,
the least hash among its runs of M words; consecutive windows with the same
minimiser travel as one string of words to the minimiser's bucket, so that
equal windows meet there. Tasks send equal strings of a block of documents
once, with all places. In the bucket the windows are sorted by a hash of their
bytes, equal hashes are compared byte by byte, and the smallest document of
each distinct window is found. Only the places of windows with a smaller
document return, as spans of words, to their documents.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, staged
from .words import BASE, INVERSE, mix

WORDS = 13
#: Words of a minimiser.
M = 4
#: Passes over the texts; each shuffles the strings of its share of the minimisers.
PASSES = 2
#: Bytes of text whose strings are made at a time; most windows of a string.
BLOCK, RUN = 1 << 21, 64
#: Bytes of strings and places that are sorted at a time, and of one minimiser beyond which its windows are dealt by themselves.
CHUNK, GROUP = 1 << 22, 1 << 24
#: Pairs of a place and a window that are judged at a time.
JUDGED = 1 << 20
PLACE = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("start", "<i8")])
_up, _down = np.ones(1, np.uint64), np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    global _up, _down
    if len(_up) < n:
        _up, _down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (BASE, INVERSE))
    return _up[:n], _down[:n]


class Words:
    """Words that each end with a blank: their bounds, and hashes of runs of them by prefix sums."""

    def __init__(self, raw: bytes):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        self.ends = np.flatnonzero(data == 32)
        self.begins = np.concatenate([np.zeros(1, np.int64), self.ends + 1])[:-1]
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def hashes(self, first: np.ndarray, n: int) -> np.ndarray:
        """Of the n words from each of the first ones."""
        b, e = self.begins[first], self.ends[first + n - 1]
        return mix((self.sums[e] - self.sums[b]) * self.down[b] + (e - b).astype(np.uint64))


def split(raw: bytes, k: int):
    """(first word, words joined by blanks) over pieces of a text of about BLOCK bytes that share k - 1 words."""
    if len(raw) <= BLOCK:
        yield 0, b" ".join(raw.split())
        return
    words = raw.split()
    sizes = np.cumsum([len(w) + 1 for w in words])
    at = 0
    while at < len(words):
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK)), at + k)
        yield at, b" ".join(words[at:end])
        if end >= len(words):
            return
        at = end - k + 1


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The minimum of every n consecutive values."""
    out, have = values, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(docs: DataFrame, k: int, share: int, shares: int) -> DataFrame:
    """(minimiser, packed, places) of docs (doc_id, key, text): strings of consecutive windows, and where they stand as PLACE records."""

    def strings(pieces):
        """A batch of the distinct strings of the pieces (doc_id, key, first word, bytes)."""
        words = Words(b" ".join(p[3] for p in pieces) + b" ")
        counts = np.array([p[3].count(b" ") + 1 for p in pieces])
        before = np.cumsum(counts) - counts
        n = len(words.ends)
        if n < k:
            return None
        mini = least(words.hashes(np.arange(n - M + 1), M), k - M + 1)
        piece = np.repeat(np.arange(len(pieces)), counts)[: len(mini)]
        mini = mix(mini)
        valid = (np.arange(len(mini)) + k <= (before + counts)[piece]) & (mini % np.uint64(shares) == share)
        head = valid.copy()
        head[1:] &= ~valid[:-1] | (mini[1:] != mini[:-1])
        at = np.flatnonzero(valid)
        run = np.cumsum(head[at]) - 1
        inside = np.arange(len(at)) - np.flatnonzero(head[at])[run] if len(at) else at
        first = at[inside % RUN == 0]
        if not len(first):
            return None
        lengths = np.diff(np.append(np.flatnonzero(inside % RUN == 0), len(at)))
        seen: dict[bytes, int] = {}
        raw = words.raw
        ids = np.array([seen.setdefault(raw[b:e], len(seen)) for b, e in zip(words.begins[first].tolist(), words.ends[first + lengths + k - 2].tolist(), strict=True)], np.int64)
        order = np.argsort(ids, kind="stable")
        places = np.empty(len(first), PLACE)
        of = piece[first[order]]
        for name, column in (("doc_id", [p[0] for p in pieces]), ("key", [p[1] for p in pieces])):
            places[name] = np.array(column, np.int64)[of]
        places["start"] = first[order] - before[of] + np.array([p[2] for p in pieces], np.int64)[of]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(seen)))])
        where = pa.Array.from_buffers(pa.binary(), len(seen), [None, pa.py_buffer((offsets * PLACE.itemsize).astype(np.int32)), pa.py_buffer(places.tobytes())])
        keys = mini[first[order[offsets[:-1]]]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(list(seen), pa.binary()), where], names=["minimiser", "packed", "places"])

    def work(batches):
        held, size = [], 0
        for b in batches:
            for doc_id, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for first, joined in split(text.as_buffer().to_pybytes(), k):
                    if joined:
                        held.append((doc_id, key, first, joined))
                        size += len(joined) + 1
                    if size >= BLOCK:
                        out = strings(held)
                        held, size = [], 0
                        if out is not None:
                            yield out
        out = strings(held) if held else None
        if out is not None:
            yield out

    return docs.mapInArrow(work, "minimiser long, packed binary, places binary")


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all records, number of them in each row)"""
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    return np.frombuffer(b"".join(column.to_pylist()), PLACE), lengths // PLACE.itemsize


def _first_documents(words: Words, windows: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest document of every window's sequence, where it has several documents, else the largest number.

    low and high: ends of the documents of the string that a window is in.
    """
    out = np.full(len(windows), np.iinfo(np.int64).max)
    h = words.hashes(windows, k)
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
    group_low, group_high = np.minimum.reduceat(low[order], heads), np.maximum.reduceat(high[order], heads)
    ends = np.append(heads[1:], len(order))
    begins, stops = words.begins[windows], words.ends[windows + k - 1]
    raw = words.raw
    for g in np.flatnonzero(group_low < group_high).tolist():
        own = order[heads[g] : ends[g]]
        texts = [raw[b:e] for b, e in zip(begins[own].tolist(), stops[own].tolist(), strict=True)]
        if texts.count(texts[0]) == len(texts):
            out[own] = group_low[g]
            continue
        for text in set(texts):  # different windows with one hash
            same = own[[t == text for t in texts]]
            if low[same].min() < high[same].max():
                out[same] = low[same].min()
    return out


def _spans(table: pa.RecordBatch, k: int):
    """(doc_id, key, start, words) of the places in the table whose windows start in a smaller document."""
    packed = table.column(1).to_pylist()
    words = Words(b" ".join(packed) + b" ")
    stops = np.cumsum([len(p) + 1 for p in packed]) - 1
    last = np.searchsorted(words.ends, stops) + 1
    first = np.concatenate([[0], last[:-1]])
    many = last - first - k + 1
    windows = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
    places, counts = _places(table.column(2))
    begin = np.cumsum(counts) - counts
    low, high = np.minimum.reduceat(places["doc_id"], begin), np.maximum.reduceat(places["doc_id"], begin)
    string = np.repeat(np.arange(len(packed)), many)
    smallest = _first_documents(words, windows, k, low[string], high[string])
    of_string = np.cumsum(many) - many
    hit = np.flatnonzero(np.minimum.reduceat(smallest, of_string) < high)
    # An item is a place of such a string; each meets all windows of the string.
    item = np.repeat(begin[hit] - (np.cumsum(counts[hit]) - counts[hit]), counts[hit]) + np.arange(counts[hit].sum())
    owner = np.repeat(hit, counts[hit])
    size = many[owner]
    edges = np.flatnonzero(np.diff((np.cumsum(size) - 1) // JUDGED)) + 1 if len(size) else []
    for part in np.split(np.arange(len(item)), edges):
        n, place = size[part], places[item[part]]
        row = np.repeat(np.arange(len(part)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = smallest[of_string[owner[part]][row] + offset] < place["doc_id"][row]
        edge = np.append(True, row[1:] != row[:-1]) if len(row) else gone
        begins = np.flatnonzero(gone & (edge | ~np.append(False, gone[:-1])))
        ends = np.flatnonzero(gone & (np.append(edge[1:], True) | ~np.append(gone[1:], False)))
        at = place[row[begins]]
        yield at["doc_id"], at["key"], at["start"] + offset[begins], ends - begins + k


def in_buckets(rows: DataFrame, k: int, group_bytes: int) -> DataFrame:
    """What the sorted buckets find, rows (minimiser, packed, places): spans, kind 0, and the windows of too large buckets, kind 1."""
    names = ["doc_id", "key", "start", "words", "text", "places", "low", "kind"]

    def spans(table):
        for columns in _spans(table, k):
            n = len(columns[0])
            if n:
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], none, none, pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int32))], names=names)

    def alone(table):
        for packed, places in zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True):
            words, at = packed.split(b" "), np.frombuffer(places, PLACE)
            texts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            shifted = []
            for i in range(len(texts)):
                moved = at.copy()
                moved["start"] += i
                shifted.append(moved.tobytes())
            n = len(texts)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(texts, pa.binary()), pa.array(shifted, pa.binary()), pa.array([int(at["doc_id"].min())] * n, pa.int64()), pa.array([1] * n, pa.int32())], names=names)

    def work(batches):
        held, size, over = [], 0, None
        for b in batches:
            if over is not None:
                stop = int(np.searchsorted(b.column(0).to_numpy(), over, side="right"))
                if stop:
                    yield from alone(b.slice(0, stop))
                b = b.slice(stop)
                if not b.num_rows:
                    continue
                over = None
            held.append(b)
            size += b.nbytes
            if size < CHUNK and size < group_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = table.column(0).to_numpy()
            stop = int(np.searchsorted(ids, ids[-1]))
            if stop:
                yield from spans(table.slice(0, stop))
            rest = table.slice(stop)
            held, size = [rest], rest.nbytes
            if size >= group_bytes:
                over = ids[-1]
                yield from alone(rest)
                held, size = [], 0
        if held:
            yield from spans(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    schema = "doc_id long, key long, start long, words long, text binary, places binary, low long, kind int"
    return rows.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(work, schema)


def one_by_one(windows: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, start, words) of the windows (text, places, low) with a smaller document, by a join on the window."""
    smallest = windows.groupBy("text").agg(F.min("low").alias("smallest"))

    def work(batches):
        for b in batches:
            places, counts = _places(b.column(0))
            own = places[places["doc_id"] > np.repeat(b.column(1).to_numpy(), counts)]
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(own[c])) for c in PLACE.names], pa.array(np.full(len(own), k, np.int64))], names=[*PLACE.names, "words"])

    return windows.join(smallest, "text").select("places", "smallest").mapInArrow(work, "doc_id long, key long, start long, words long")


def without_repeats(docs: DataFrame, k: int = WORDS, passes: int = PASSES, group_bytes: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept of every row of docs (doc_id, text): the text without repeated windows.

    Words are runs of bytes other than space and 0x09-0x0D. A word goes where a
    window of k words (M at least) that covers it starts also in a document
    with a smaller doc_id; kept joins the other words by blanks. Windows are
    judged on the whole input. A null text has no words. A row with a null
    doc_id is smaller than none and larger than none: it stays whole and
    removes nothing. Rows that share a doc_id are the same document to each
    other, with spans of their own by a hash of their text. Other columns are
    left out; an empty table gives an empty result.

    Shuffled are the strings, a share of the minimisers in each pass, then the
    spans, then the texts once. Memory in a task is bounded by group_bytes: the
    windows of a larger bucket go one by one through a join, which Spark
    splits where it is skewed. Nothing is collected; the folders of the spans
    stay for the result to read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    known = rows.where("doc_id is not null").select("doc_id", "key", "text")
    spans = None
    for share in range(passes):
        found = in_buckets(super_kmers(known, k, share, passes), k, group_bytes)
        table = spark.read.schema(found.schema).parquet(staged(found, "repeats", "kind"))
        own = table.where("kind = 0").select("doc_id", "key", "start", "words").union(one_by_one(table.where("kind = 1").select("text", "places", "low"), k))
        spans = own if spans is None else spans.union(own)
    spans = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "words")).alias("spans"))

    def work(batches):
        for b in batches:
            out = []
            for text, gone in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = text.as_buffer().to_pybytes().split()
                if not gone:
                    out.append((len(words), 0, b" ".join(words)))
                    continue
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, [g["start"] for g in gone], 1)
                np.add.at(edges, [g["start"] + g["words"] for g in gone], -1)
                stays = np.cumsum(edges[:-1]) == 0
                out.append((len(words), len(words) - int(stays.sum()), b" ".join(compress(words, stays))))
            if out:
                n, removed, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = rows.join(spans, ["doc_id", "key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(work, "doc_id long, n_words long, n_removed long, kept string")


def op13_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated windows of 13 words cover, and the hash of what is kept."""
    out = without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, pos, ws[pos] AS word, CASE WHEN pos + {WORDS - 1} <= len(ws) THEN array_to_string(ws[pos : pos + {WORDS - 1}], ' ') END AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS pos FROM d)),
f AS (SELECT win, min(doc_id) AS low FROM w WHERE win IS NOT NULL GROUP BY win HAVING min(doc_id) < max(doc_id)),
g AS (SELECT w.doc_id, w.pos, w.word, coalesce(f.low < w.doc_id, false) AS hit FROM w LEFT JOIN f USING (win)),
c AS (SELECT doc_id, pos, word, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW) AS gone FROM g),
o AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)
"""
