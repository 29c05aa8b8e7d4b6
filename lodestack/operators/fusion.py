"""Fusion of ranked lists, relevance floors, and the choice between the legs of a hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reciprocal rank fusion's constant; least score and least share of the best score of a relevant vector hit.
RRF, FLOOR, SHARE = 60, 0.25, 0.5


def relevant(ranked: DataFrame) -> DataFrame:
    """The rows of a truncated list with a score of at least FLOOR and SHARE of the best."""
    best = F.max("score").over(Window.partitionBy())
    return ranked.withColumn("_best", best).where((F.col("score") >= FLOOR) & (F.col("score") >= SHARE * F.col("_best"))).drop("_best")


def ranks(ranked: DataFrame, ties: list[str]) -> DataFrame:
    """A list of at most some hundred rows with the column rank, from 1."""
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), *ties)))


def rrf(lists: list[DataFrame], keys: list[str], limit: int) -> DataFrame:
    """Rows of several ranked lists by the sum of 1 / (RRF + rank); of a key in several lists the first list's record stays.

    The lists have the same columns, keys and score among them.
    """
    parts = [ranks(x, keys).withColumn("_list", F.lit(n)) for n, x in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    others = [c for c in lists[0].columns if c not in (*keys, "score")]
    record = F.min_by(F.struct(*others, F.col("score").alias("_old")), "_list")
    fused = every.groupBy(*keys).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score"), record.alias("_r"))
    return fused.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], "score").orderBy(F.desc("score"), *keys).limit(limit)


def or_else(first: DataFrame, second: DataFrame) -> DataFrame:
    """first, or second if first has no rows: decided within one plan."""
    none = first.limit(1).agg(F.count("*").alias("_n"))
    fallback = second.crossJoin(F.broadcast(none)).where("_n = 0").drop("_n")
    return first.unionByName(fallback.select(*first.columns))


def hybrid(keyword: DataFrame, any_word: DataFrame | None, vector: DataFrame | None, keys: list[str], limit: int, answer: bool = False, embed_failed: bool = False) -> DataFrame:
    """The result of a hybrid search from its legs, each already truncated to limit.

    keyword: hits of all words; any_word: hits of any word, None for a query of
    one word; vector: nearest chunks, None without an embedder or with another
    model's index. Without vectors: keyword, else any_word. If embedding the
    query failed: keyword. Otherwise keyword and the relevant vectors fused; if
    that is empty, nothing for a search, and for an answer the nearest chunks,
    or without any the hits of any word.
    """
    if embed_failed:
        return keyword
    if vector is None:
        return keyword if any_word is None else or_else(keyword, any_word)
    fused = rrf([keyword, relevant(vector)], keys, limit)
    if not answer:
        return fused
    fallback = or_else(vector, any_word) if any_word is not None else or_else(vector, keyword)
    return or_else(fused, fallback)


def resolve_limit(limit: int | None, default: int, most: int) -> int:
    """A request's limit; out of range it is the default, not the bound."""
    return default if limit is None or limit <= 0 or limit > most else limit
