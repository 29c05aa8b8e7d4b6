"""Vectors as column expressions, a top-k scan that keeps a bounded heap per task, and one over int8 codes with bounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float")))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; 0 for vectors of different lengths."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))


def softmax(v: Column) -> Column:
    """Max-shifted softmax of an array."""
    e = F.transform(v, lambda x: F.exp(x.cast("double") - F.array_max(v).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y))


def gelu(x: Column, erf) -> Column:
    """Exact GELU by a given erf; Spark has none of its own."""
    return x * 0.5 * (1 + erf(x / 2**0.5))


def layer_norm(v: Column, eps: float = 1e-12) -> Column:
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")) / F.size(v)
    var = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - mean) * (x.cast("double") - mean)) / F.size(v)
    return F.transform(v, lambda x: (x.cast("double") - mean) / F.sqrt(var + eps))


def quantize_scale(v: Column) -> Column:
    """The largest absolute value over 127; 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.when(top == 0, F.lit(1.0)).otherwise(top / 127)


def quantize_int8(v: Column, scale: Column) -> Column:
    """Nearest steps of the scale, halves to even."""
    return F.transform(v, lambda x: F.bround(x.cast("double") / scale).cast("int"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)


#: Columns of codes behind the id: steps of int8, the step, and the length of what the steps leave of the vector and the vector's own.
CODES = "code array<tinyint>, scale double, error double, length double"
#: Candidates that are found by their ids in a pushed-down condition; more of them by a join.
FEW = 256


def codes(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding", *carried: str) -> DataFrame:
    """(carried..., ids, CODES) of vectors: a quarter of their bytes, and what bounds every score.

    By Cauchy and Schwarz a vector's score differs from its code's by at most
    its error times the length of the query. Without a code (null) are vectors
    with nulls or infinite components, whose scores have no bounds.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vector).isNotNull() & F.col(ids).isNotNull()).select(*carried, F.col(ids), F.when(good, x).alias("_x"))
    scaled = rows.withColumn("scale", F.when(F.size("_x") > 0, quantize_scale(F.col("_x"))).when(F.col("_x").isNotNull(), F.lit(1.0)))
    coded = scaled.withColumn("_q", quantize_int8(F.col("_x"), F.col("scale")))
    left = F.zip_with("_x", "_q", lambda a, q: a - q * F.col("scale"))
    return coded.select(*carried, ids, F.col("_q").cast("array<tinyint>").alias("code"), "scale", norm(left).alias("error"), norm(F.col("_x")).alias("length"))


def _bounds(coded: DataFrame, query: np.ndarray, k: int, ids: str) -> DataFrame:
    """(ids, low, high) of the rows that may be among the k best of their task: bounds of their scores in one pass over the codes."""
    q = query.astype(np.float64)
    size = float(np.sqrt(q @ q))
    # The rounding of sums grows with the number of their terms.
    rounding = 2.0**-48 * (len(q) + 2)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for batch in batches:
            own, code, scale, error, length = batch.columns
            n = len(own)
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
            lengths = np.asarray(code.value_lengths().fill_null(-1))
            low[(lengths >= 0) & (lengths != len(q))] = high[(lengths >= 0) & (lengths != len(q))] = 0.0
            at = np.flatnonzero(lengths == len(q))
            if len(at):
                part = code.take(pa.array(at))
                near = (np.asarray(part.flatten(), np.float64).reshape(-1, len(q)) @ q) * np.asarray(scale, np.float64)[at]
                slack = size * (np.asarray(error, np.float64)[at] * (1 + 1e-9) + rounding * np.asarray(length, np.float64)[at]) + 1e-300
                low[at], high[at] = near - slack, near + slack
            held = [np.concatenate(x) for x in zip(held, (np.asarray(own), low, high), strict=True)]
            if len(held[0]) > k:
                kept = held[2] >= np.partition(held[1], -k)[-k]
                held = [x[kept] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=[ids, "low", "high"])

    return coded.select(F.col(ids).cast("long").alias(ids), *[c.split()[0] for c in CODES.split(", ")]).mapInArrow(work, f"{ids} long, low double, high double")


@dataclass(frozen=True)
class Pruned:
    """Scores by codes: the rows, how many vectors were compared exactly, and whether they were found by their ids."""

    scored: DataFrame
    read: int
    by_ids: bool


def top_vectors_by_codes(coded: DataFrame, vectors: DataFrame, query: list[float], k: int, ids: str = "vec_id", vector: str = "embedding", keep: Callable[[DataFrame], DataFrame] = lambda x: x) -> Pruned:
    """top_vectors() of the same vectors by their codes(): its rows, none lost, with few of the vectors read.

    A first pass over the codes bounds every score. Vectors whose upper bound
    reaches the k-th greatest lower bound are compared exactly: up to FEW by a
    condition on ids that is pushed down to the scan of vectors, which is best
    sorted by id, more of them by a join. Nothing else is read of vectors.
    keep: applied to the codes, such as a join with the files of a tag.
    """
    if k < 1:
        return Pruned(top_vectors(vectors.limit(0), query, 1, ids, vector), 0, True)
    found = _bounds(keep(coded), np.asarray(query, np.float32), k, ids).persist()
    try:
        best = found.select("low").orderBy(F.desc("low")).limit(k).collect()
        enough = best[-1]["low"] if len(best) == k else float("-inf")
        near = found.where(F.col("high") >= enough).select(ids)
        n = near.count()
        few = [r[ids] for r in near.limit(FEW).collect()] if n <= FEW else None
    finally:
        found.unpersist()
    few_rows = vectors.where(F.col(ids).isin(few)) if few is not None else vectors.join(near, ids, "left_semi")
    return Pruned(top_vectors(few_rows, query, k, ids, vector), n, few is not None)


def top_vectors(vectors: DataFrame, query: list[float], k: int, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(ids, score) of the k vectors nearest to the query by dot product; ties by id.

    Every task multiplies its Arrow batches with the query and hands on its best
    k rows, so what is shuffled doesn't grow with the number of vectors. A score
    is a sum in double precision along the vector, which doesn't depend on the
    rest of its batch, so that equal vectors tie wherever they lie. Vectors
    of another length than the query score 0; null vectors are left out.
    """
    q = np.asarray(query, np.float32).astype(np.float64)

    def best(batches):
        held_ids, held = np.zeros(0, np.int64), np.zeros(0, np.float64)
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(column.value_lengths().fill_null(0))
            own, scores = np.asarray(batch.column(0)), np.zeros(len(column))
            if (lengths == len(q)).all() and column.null_count == 0:
                scores = (np.asarray(column.flatten(), np.float64).reshape(-1, len(q)) * q).sum(axis=1)
            else:
                for i in np.flatnonzero(lengths == len(q)):
                    scores[i] = (np.asarray(column[int(i)].as_py(), np.float64) * q).sum()
            held_ids, held = np.concatenate([held_ids, own]), np.concatenate([held, scores])
            order = np.lexsort((held_ids, -held))[:k]
            held_ids, held = held_ids[order], held[order]
        yield pa.RecordBatch.from_arrays([pa.array(held_ids), pa.array(held)], names=[ids, "score"])

    found = vectors.where(F.col(vector).isNotNull() & F.col(ids).isNotNull()).select(F.col(ids).cast("long").alias(ids), F.col(vector).cast("array<float>").alias(vector))
    return found.mapInArrow(best, f"{ids} long, score double").orderBy(F.desc("score"), ids).limit(k)
