"""Product codes of vectors by exact integer k-means with Exponion search.

A vector's components become integers and are cut into equal parts. Every part
position has a codebook; each round assigns every part to its nearest entry and
moves the entries to the means. A part's search begins at the entry it had: an
entry c at least as near as the best one known, at squared distance e, lies
within 2 * (d + e) of the previous entry, squared, where d is the squared
distance to that. So only the beginning of the previous entry's list of other
entries, sorted by distance, has to be read. All distances are exact
integers, and ties go to the lower index.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, remove, staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors that a task searches at a time; entries of a list that are read first.
BLOCK, FIRST = 1 << 15, 8
#: Every so many entries are tried where a part has no previous entry.
ANCHOR = 16
#: Largest magnitude of a component.
LIMIT = 1 << 31


class Coded(NamedTuple):
    codes: DataFrame
    books: list[np.ndarray]


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, filled up with zeros to the given width; a row each."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    whole = np.clip(np.floor(flat * SCALE), -LIMIT, LIMIT)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = whole
    return out


def exact(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where every sum of products stays below 2**53, else as Python's integers."""
    most = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * most * most * x.shape[1] < 1 << 53:
        return x, book.astype(np.float64)
    return x.astype(np.int64).astype(object), book.astype(object)


def lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry: all entries by (squared distance, index), and those distances."""
    gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    near = np.argsort(gaps, axis=1, kind="stable")
    return near, np.take_along_axis(gaps, near, 1)


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of every row; start: the entries where the search begins."""
    x, book = exact(x, book)
    near, gaps = lists(book)
    square, norms = (x * x).sum(1), (book * book).sum(1)
    if start is None:
        some = np.arange(0, len(book), ANCHOR)
        start = some[(norms[some] - 2 * (x @ book[some].T)).argmin(1)] if len(x) else np.zeros(0, np.int64)
    first = ((x - book[start]) ** 2).sum(1)
    best, entry = first.copy(), start.astype(np.int64)
    order = np.argsort(start, kind="stable")
    bounds = np.searchsorted(start[order], np.arange(len(book) + 1))
    for a in np.flatnonzero(np.diff(bounds)):
        rows, at, step = order[bounds[a] : bounds[a + 1]], 0, FIRST
        while at < len(book):
            rows = rows[(gaps[a, at] <= 2 * (first[rows] + best[rows])).astype(bool)]
            if not len(rows):
                break
            some = np.sort(near[a, at : at + step])
            d = square[rows][:, None] - 2 * (x[rows] @ book[some].T) + norms[some]
            j = d.argmin(1)
            found, index = d[np.arange(len(rows)), j], some[j]
            better = ((found < best[rows]) | (found == best[rows]) & (index < entry[rows])).astype(bool)
            best[rows[better]], entry[rows[better]] = found[better], index[better]
            at, step = at + step, 2 * step
    return entry, best


def blocks(batches):
    """Arrow batches joined to BLOCK rows or more."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def searched(b: pa.RecordBatch, books: list[np.ndarray], width: int):
    """(parts, entries, squared distances) of a batch (_, _, vector, codes), a list item a part position."""
    x = integers(b.column(2), len(books) * width)
    codes = b.column(3)
    before = None if codes.null_count else np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, len(books))
    parts = [x[:, p * width : (p + 1) * width] for p in range(len(books))]
    found = [nearest(part, book, None if before is None else before[:, p].astype(np.int64)) for p, (part, book) in enumerate(zip(parts, books, strict=True))]
    return parts, [f[0] for f in found], [f[1] for f in found]


def one_round(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """The rows (id, label, vector, codes) with their new codes, kind 0, and each task's sums by part and entry, kind 1."""
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("codes", T.BinaryType()), *[T.StructField(n, T.LongType()) for n in ("part", "entry", "n")], T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("kind", T.IntegerType())])

    def work(batches):
        total = [np.zeros((len(book), width), np.int64) for book in books]
        count = [np.zeros(len(book), np.int64) for book in books]
        types = None
        for b in blocks(batches):
            parts, entries, _ = searched(b, books, width)
            for p, (x, e) in enumerate(zip(parts, entries, strict=True)):
                order = np.argsort(e, kind="stable")
                used, at = np.unique(e[order], return_index=True)
                total[p][used] += np.add.reduceat(x[order].astype(np.int64), at, axis=0)
                count[p] += np.bincount(e, minlength=len(count[p]))
            codes = np.stack(entries, 1).astype(np.uint8).tobytes()
            step, n = len(books), b.num_rows
            codes = pa.array([codes[i : i + step] for i in range(0, step * n, step)], pa.binary())
            types, none = b.schema.types[:3], pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], codes, none, none, none, pa.nulls(n, pa.list_(pa.int64())), pa.array(np.zeros(n, np.int32))], names=schema.names)
        if types:
            used = [(p, int(e)) for p, c in enumerate(count) for e in np.flatnonzero(c)]
            nothing = [pa.nulls(len(used), t) for t in types]
            sums = pa.array([total[p][e].tolist() for p, e in used], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*nothing, pa.nulls(len(used), pa.binary()), *[pa.array(c, pa.int64()) for c in ([p for p, _ in used], [e for _, e in used], [int(count[p][e]) for p, e in used])], sums, pa.array([1] * len(used), pa.int32())], names=schema.names)

    return rows.mapInArrow(work, schema)


def moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """The books with every used entry at the floor of its mean; sums: (part, entry, n, sums), reduced to a row an entry and position."""
    flat = sums.select("part", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "v"))
    out, got = [b.copy() for b in books], {}
    for r in flat.groupBy("part", "entry", "at").agg(F.sum("v").alias("v")).collect():
        got.setdefault((r["part"], r["entry"]), {})[r["at"]] = r["v"]
    for (p, e), v in got.items():
        out[p][e] = [v[i + 1] // v[0] for i in range(out[p].shape[1])]
    return out


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """codes (vec_id, label, code, error) of the rows of vectors (vec_id, embedding, label), and the final codebooks.

    A row whose embedding is null or has a null, infinite or NaN component is
    left out. Shorter vectors count as filled up with zeros to the longest
    one's length, and that to a multiple of parts; components beyond 2**31
    after scaling are cut to it. The books begin with the first rows by
    (vec_id, embedding), null ids last; with fewer rows they are smaller.
    Repeated rows and ids each count. entries is 256 at most. code has two hexadecimal digits a part; error is the sum
    of the squared distances, at most 2**63 - 1. Other columns are left out;
    an empty table gives no codes and empty books.

    Every round reads the rows with their codes once and writes them with the
    next codes, beside each task's sums; nothing else than a row an entry and
    position reaches the driver, and no row is shuffled. The last round's
    folder stays for the result to read.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector")).where("vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    rows = rows.withColumn("codes", F.lit(None).cast("binary"))
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"]
    if longest is None:
        return Coded(rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * parts)
    width = -(-longest // parts)
    firsts = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = integers(pa.array([r["vector"] for r in firsts], pa.list_(pa.float64())), parts * width).astype(np.int64)
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    last = None
    for _ in range(rounds):
        done = one_round(rows, books, width)
        folder = staged(done, "codes", "kind")
        if last:
            remove(spark, last)
        last, table = folder, spark.read.schema(done.schema).parquet(folder)
        books = moved(books, table.where("kind = 1"))
        rows = table.where("kind = 0").select("vec_id", "label", "vector", "codes")

    def finish(batches):
        for b in blocks(batches):
            _, found, distances = searched(b, books, width)
            digits = np.stack(found, 1).astype(np.uint8).tobytes().hex()
            step = 2 * parts
            error = [min(int(e), (1 << 63) - 1) for e in sum(distances)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digits[i : i + step] for i in range(0, step * b.num_rows, step)], pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    final = rows.mapInArrow(finish, T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))
    folder = staged(final, "codes")
    if last:
        remove(spark, last)
    return Coded(spark.read.schema(final.schema).parquet(folder), books)


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors of `embeddings`, with the errors' sums by label."""
    codes, books = encode(read(spark, sf_dir, "embeddings"))
    by_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    text = ",".join(str(v) for book in books for entry in book.tolist() for v in entry)
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """Every round as two steps; distances by inner products, exact in doubles."""
    w = [f"""
v AS (SELECT *, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, list_transform(embedding[p * (len(embedding) // {PARTS}) + 1 : (p + 1) * (len(embedding) // {PARTS})], lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS q
  FROM v, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, q FROM x WHERE r <= {ENTRIES})"""]
    for i in range(ROUNDS + 1):
        w.append(f"""
a{i} AS MATERIALIZED (SELECT x.r, x.p, min(CAST(list_inner_product(x.q, x.q) - 2 * list_inner_product(x.q, b.q) + list_inner_product(b.q, b.q) AS BIGINT) * {ENTRIES} + b.e) AS m
  FROM x JOIN b{i} b USING (p) GROUP BY x.r, x.p)""")
        if i < ROUNDS:
            w.append(f"""
s{i} AS (SELECT p, e, list(mean ORDER BY pos) AS q FROM (
  SELECT p, e, pos, floor((s - ((s % n) + n) % n) / n) AS mean FROM (
    SELECT x.p, a.m % {ENTRIES} AS e, pos, sum(CAST(x.q[pos] AS BIGINT)) AS s, count(*) AS n
    FROM x JOIN a{i} a USING (r, p), range(1, len(x.q) + 1) t(pos) GROUP BY ALL)) GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.q, b.q) AS q FROM b{i} b LEFT JOIN s{i} s USING (p, e))""")
    return f"""WITH {",".join(w)},
c AS (SELECT r, string_agg(format('{{:02x}}', CAST(m % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, e)) AS h FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN v USING (r), h
"""


OP11_SQL = _sql()
