"""Keyword retrieval: postings, phrases and BM25 as joins and aggregates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.phrases import Best, Phrases, pieces
from ..functions.text import PY_SPACE, py_terms, py_words, terms

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Leading bits of a chunk's id that make its block; blocks that are scored first, besides one for each wanted hit; ranges of blocks that are pushed to a scan.
BLOCK_BITS, FIRST, RANGES = 22, 32, 256
#: Phrases of queries that a scan holds at once in the driver and in every task; more take another scan.
SHARE = 1 << 20


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, pos, term) of every token."""
    return chunks.select(key, F.posexplode(terms(F.coalesce(text, F.lit("")))).alias("pos", "term"))


def lengths(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, dl): tokens of every chunk, 0 for those without."""
    return chunks.select(key, F.size(terms(F.coalesce(text, F.lit("")))).cast("long").alias("dl"))


def stored_postings(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_id, pos, term, dl) of every token: with the chunk's length, so that a search needs no other table."""
    found = F.transform(F.array(terms(F.coalesce("text", F.lit("")))), lambda t: F.struct(F.size(t).cast("long").alias("dl"), t.alias("terms")))[0]
    rows = chunks.select("file_id", "chunk_id", found.alias("_t"))
    return rows.select("file_id", "chunk_id", F.col("_t.dl").alias("dl"), F.posexplode("_t.terms").alias("pos", "term"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, total, avgdl): chunks, tokens, tokens a chunk."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).withColumn("avgdl", F.col("total") / F.greatest("n", F.lit(1)))


def term_df(postings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(term, df, cf): chunks that have a term, and its occurrences."""
    return postings.groupBy(key, "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def write_postings(chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Postings as Parquet sorted by term, so that a query's filter reads few row groups."""
    postings(chunks, key).repartitionByRange("term").sortWithinPartitions("term", key, "pos").write.mode("overwrite").parquet(path)


def phrases(query: str) -> dict[tuple[str, ...], int]:
    """A query's words as phrases of terms, with how often each occurs. ValueError for a blank query."""
    words = py_words(query)
    if not words:
        raise ValueError("empty query")
    return dict(Counter(p for p in (tuple(py_terms(w)) for w in words) if p))


def matches(postings: DataFrame, wanted: dict[tuple[str, ...], int], key: str = "chunk_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """(phrase, key, carried..., tf): how often each phrase occurs in each chunk that has it. What is carried is the same all over a chunk.

    Only postings of the query's terms are read: the condition is pushed to
    the scan. A place where the i-th term of a phrase stands votes for the
    place i before it; a phrase occurs where all of its terms vote.
    """
    spark = postings.sparkSession
    rows = [(n, i, t, len(p)) for n, p in enumerate(wanted) for i, t in enumerate(p)]
    # As many rows as the query has terms.
    table = F.broadcast(spark.createDataFrame(rows, "phrase int, i int, term string, size int"))
    found = postings.where(F.col("term").isin(sorted({t for _, _, t, _ in rows})) & F.col(key).isNotNull()).join(table, "term")
    if all(size == 1 for *_, size in rows):
        return found.groupBy("phrase", key, *carried).agg(F.count("*").alias("tf"))
    votes = found.groupBy("phrase", key, *carried, (F.col("pos") - F.col("i")).alias("at"), "size").agg(F.count_distinct("i").alias("votes"))
    return votes.where("votes = size").groupBy("phrase", key, *carried).agg(F.count("*").alias("tf"))


def bm25(postings: DataFrame, lengths: DataFrame | None, query: str, any_word: bool = False, key: str = "chunk_id", stats: tuple[int, int] | None = None) -> DataFrame:
    """(key, score) of the chunks that have all phrases of a query, or any; with file_id where the postings have it.

    Statistics are over all chunks, whatever is filtered afterwards: stats, the
    numbers of chunks and of tokens, or else those of lengths. Postings that
    have dl don't need lengths. A word without terms is ignored; if no word has
    any, nothing is found.
    """
    wanted = phrases(query)
    carried = tuple(c for c in ("file_id", "dl") if c in postings.columns)
    kept = [key, *(c for c in carried if c != "dl")]
    if not wanted:
        return postings.select(*kept, F.lit(0.0).alias("score")).where("false")
    found = matches(postings, wanted, key, carried)
    # Counting tf keeps both uses of the matches alike, so that their shuffle is reused.
    df = found.groupBy("phrase").agg(F.count("tf").alias("df"))
    if stats is None:
        df = df.crossJoin(corpus_stats(lengths))
    else:
        df = df.withColumn("n", F.lit(stats[0])).withColumn("avgdl", F.lit(stats[1] / max(1, stats[0])))
    weight = F.create_map(*[F.lit(x) for n, w in enumerate(wanted.values()) for x in (n, w)])
    # One row a phrase, one row of statistics.
    idf = F.broadcast(df.select("phrase", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF)).alias("idf"), "avgdl"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * weight[F.col("phrase")]
    sized = found if "dl" in carried else found.join(lengths, key)
    scored = sized.join(idf, "phrase").groupBy(*kept).agg(F.sum(part).alias("score"), F.count("*").alias("_phrases"))
    return (scored if any_word else scored.where(F.col("_phrases") == len(wanted))).select(*kept, "score")


def bm25_scan(chunks: DataFrame, query: str, any_word: bool = False, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """bm25() without an index: (key, score) from the texts themselves, in one scan.

    Each text is reduced to its length and its phrases' counts; these narrow
    rows are dealt out once, and both the statistics, one row, and the scores
    are taken from them, so that no text is read twice. Rows without a key
    aren't chunks.
    """
    wanted = phrases(query)
    if not wanted:
        return chunks.select(key, F.lit(0.0).alias("score")).where("false")

    def count(ts, phrase: tuple[str, ...]):
        def here(t, i):
            found = t == phrase[0]
            for n, other in enumerate(phrase[1:], 1):
                found = found & (F.get(ts, i + n) == other)
            return found

        return F.size(F.filter(ts, here))

    def counted(ts):
        return F.struct(F.size(ts).cast("long").alias("dl"), *[count(ts, p).alias(f"tf{n}") for n, p in enumerate(wanted)])

    # The terms are bound to a variable, so that a text is split once for all of its counts.
    rows = chunks.where(F.col(key).isNotNull()).select(key, F.transform(F.array(terms(F.coalesce(text, F.lit("")))), counted)[0].alias("_r"))
    narrow = rows.select(key, F.col("_r.dl").alias("dl"), *[F.col(f"_r.tf{n}").alias(f"_tf{n}") for n in range(len(wanted))]).repartition(key)
    stats = narrow.agg(F.count("*").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"), *[F.count_if(F.col(f"_tf{n}") > 0).alias(f"_df{n}") for n in range(len(wanted))])
    score, present = F.lit(0.0), F.lit(0)
    for n, weight in enumerate(wanted.values()):
        tf, df = F.col(f"_tf{n}"), F.col(f"_df{n}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        score = score + weight * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        present = present + (tf > 0).cast("int")
    # Scores of matches are above 0. The condition is on the score, not on the counts: pushed
    # below the join it would make two different inputs of one.
    score = F.when(present >= (1 if any_word else len(wanted)), score).otherwise(0.0)
    return narrow.crossJoin(F.broadcast(stats)).select(key, score.alias("score")).where("score > 0")


def _impact(tf, dl, avgdl: float):
    """What a term's count in a chunk adds to its score, without the term's own weight: it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _block(key: str, bits: int):
    return F.shiftright(F.col(key), 64 - bits)


def blocks(postings: DataFrame, key: str = "chunk_id", bits: int = BLOCK_BITS) -> DataFrame:
    """(term, block, n, most, least) of postings (key, term, dl): chunks of a block that have a term, their highest count and smallest length.

    A block is a range of ids, the same for all terms and segments.
    """
    counted = postings.where(F.col(key).isNotNull()).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))
    return counted.groupBy("term", _block(key, bits).alias("block")).agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("dl").alias("least"))


class Pruned(NamedTuple):
    """Scores of a part of the chunks that holds the best ones, and how many blocks were read and passed over."""

    scored: DataFrame
    read: int
    passed: int


def single_terms(query: str) -> dict[str, int] | None:
    """A query's terms and how often each is asked for; None where a word has several terms, or none has any."""
    wanted = phrases(query)
    return {p[0]: n for p, n in wanted.items()} if wanted and all(len(p) == 1 for p in wanted) else None


def best(postings: DataFrame, blocks: DataFrame, wanted: dict[str, int], any_word: bool, stats: tuple[int, int], k: int, df: dict[str, int] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda x: x, key: str = "chunk_id", bits: int = BLOCK_BITS) -> Pruned:
    """bm25() of single terms, for the k best chunks and those that tie with them: blocks that can't reach these aren't read.

    A block's highest counts and smallest length bound the scores in it. The
    blocks of the highest bounds are scored first; the k-th best score among
    them is a threshold, and only blocks whose bound reaches it are read, by
    conditions on ranges of ids where they are few. df: chunks of every term,
    where blocks hold dead ones too. keep: what filters scored rows (a tag), so
    that the threshold is one of rows that stay.
    """
    n, avgdl = stats[0], stats[1] / max(1, stats[0])
    asked = F.col("term").isin(sorted(wanted))
    entries = blocks.where(asked).groupBy("block", "term").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).persist()
    if df is None:
        df = {r["term"]: r["n"] for r in entries.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    weights = {t: w * idf_value(n, df.get(t, 0)) for t, w in wanted.items()}
    weight = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, w)])[F.col("term")]
    bounds = entries.groupBy("block").agg(F.sum(weight * _impact(F.col("most"), F.col("least"), avgdl)).alias("bound"), F.count("*").alias("_terms"))
    bounds = bounds if any_word else bounds.where(F.col("_terms") == len(wanted))
    carried = [key, *(c for c in ("file_id",) if c in postings.columns)]

    def scored(of: list[int] | DataFrame) -> DataFrame:
        rows = postings.where(asked & F.col(key).isNotNull())
        if isinstance(of, list):
            width, ranges = 1 << (64 - bits), F.lit(False)
            for b in sorted(of):
                ranges = ranges | F.col(key).between(b * width, (b + 1) * width - 1)
            rows = rows.where(ranges)
        else:
            rows = rows.withColumn("block", _block(key, bits)).join(of.select("block"), "block", "left_semi")
        found = rows.groupBy(*carried, "dl", "term").agg(F.count("*").alias("tf"))
        out = found.groupBy(*carried).agg(F.sum(weight * _impact(F.col("tf"), F.col("dl"), avgdl)).alias("score"), F.count("*").alias("_terms"))
        return (out if any_word else out.where(F.col("_terms") == len(wanted))).select(*carried, "score")

    head = FIRST + k  # enough for a threshold where every block is one chunk
    first = bounds.orderBy(F.desc("bound"), "block").limit(head + 1).collect()
    if len(first) <= head:
        entries.unpersist()
        return Pruned(scored([r["block"] for r in first]), len(first), 0)
    held = keep(scored([r["block"] for r in first[:head]])).orderBy(F.desc("score")).limit(k).collect()
    least = held[-1]["score"] * (1 - 1e-9) if len(held) == k else 0.0
    total, reaching = bounds.count(), bounds.where(F.col("bound") >= least)
    few = [r["block"] for r in reaching.select("block").limit(RANGES + 1).collect()]
    if len(few) <= RANGES:
        entries.unpersist()
        return Pruned(scored(few), len(few), total - len(few))
    many = reaching.count()
    return Pruned(scored(reaching), many, total - many)


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, phrase, weight): the distinct phrases of each query, their terms joined by blanks, and how often each occurs in it."""
    words = queries.select("query_id", F.explode(F.filter(F.split("query", f"[{PY_SPACE}]+"), lambda w: w != "")).alias("w")).select("query_id", terms(F.col("w")).alias("ts")).where(F.size("ts") > 0)
    return words.groupBy("query_id", F.array_join("ts", " ").alias("phrase")).agg(F.count("*").alias("weight"))


def batch(postings: DataFrame, queries: DataFrame, stats: tuple[int, int], k: int, key: str = "chunk_id", strict_first: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k best chunks of each of many queries (query_id, query), ties by key.

    Postings (key, pos, term, dl) are read once for all queries, and every
    distinct phrase is matched once. Chunks with any of a query's phrases are
    hits; with strict_first only those with all of them, where there are any.
    """
    n, avgdl = stats[0], stats[1] / max(1, stats[0])
    asked = _asked(queries)
    asked = asked.withColumn("_all", F.count("*").over(Window.partitionBy("query_id")))
    table = asked.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("i", "term"), F.size(F.split("phrase", " ")).alias("size"))
    carried = [c for c in ("file_id", "dl") if c in postings.columns]
    # Dealt by chunk once, so that counts, and scores for all queries, are taken where a chunk's postings lie.
    dealt = postings.where(F.col(key).isNotNull()).join(table, "term").repartition(key)
    votes = dealt.groupBy("phrase", "size", key, *carried, (F.col("pos") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("votes"))
    found = votes.where("votes = size").groupBy("phrase", key, *carried).agg(F.count("*").alias("tf"))
    df = found.groupBy("phrase").agg(F.count("tf").alias("df"))
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    # As many rows as the queries have phrases.
    parts = found.join(F.broadcast(asked.join(df, "phrase").withColumn("_w", idf * F.col("weight"))), "phrase")
    kept = [key, *(c for c in carried if c != "dl")]
    scored = parts.groupBy("query_id", *kept).agg(F.sum(F.col("_w") * _impact(F.col("tf"), F.col("dl"), avgdl)).alias("score"), (F.count("*") == F.max("_all")).alias("_strict"))
    # Sums of copies may differ in their last bits.
    by = [*([F.desc("_strict")] if strict_first else []), F.desc(F.round("score", 9)), key]
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)
    if strict_first:
        ranked = ranked.withColumn("_any", F.max("_strict").over(Window.partitionBy("query_id"))).where("_strict or not _any")
    return ranked.select("query_id", *kept, "score", "rank")


def batch_scan(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """batch() without an index: (query_id, key, score, rank) from the texts themselves, in two scans.

    The first scan counts the chunks of every phrase, and chunks and tokens; in
    the second every task scores its chunks for all queries and hands on the k
    best ones of each. Neither postings nor scores are shuffled: what is, grows
    with the queries and the tasks, not with the texts. Queries beyond SHARE
    phrases are dealt over shares, each with scans of its own. Rows without a key
    count in the statistics, but are never found.
    """
    asked = _asked(queries)
    shares = 1 + asked.count() // SHARE
    rows = chunks.select(F.col(key).alias("key"), terms(F.coalesce(text, F.lit(""))).alias("terms"))
    parts = [_scan_share(rows, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(shares)) == i), k) for i in range(shares)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("query_id", F.col("key").alias(key), "score", "rank")


def _scan_share(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank) for a share of the queries, as (query_id, phrase, weight), over rows (key, terms)."""
    held = asked.collect()
    ids = list(dict.fromkeys(r["query_id"] for r in held))
    number = {q: i for i, q in enumerate(ids)}
    phrase = {p: i for i, p in enumerate(sorted({r["phrase"] for r in held}))}
    known = Phrases([tuple(p.split(" ")) for p in phrase])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(phrase), np.int64), 0, 0
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            keys, lists = piece.columns
            n, total = n + len(lists), total + len(lists.flatten())
            df += np.bincount(known.counts(lists.filter(keys.is_valid()))[1], minlength=len(phrase))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], names=["phrase", "n"])

    df = {r["phrase"]: r["n"] for r in rows.mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n")).collect()}
    n = df.get(-1, 0)
    avgdl = df.get(-2, 0) / max(1, n)
    weights = [(i, number[r["query_id"]], r["weight"] * idf_value(n, df[i])) for r in held if (i := phrase[r["phrase"]]) in df]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(weights, len(phrase), len(ids), k)
        for piece in (p for batch in batches for p in pieces(batch, 1)):
            keys, lists = piece.columns
            at, i, tf = known.counts(lists)
            best.add(keys, at, i, _impact(tf, np.asarray(lists.value_lengths(), np.int64)[at], avgdl))
        found = best.rows()
        if found is not None:
            yield from found.combine_chunks().to_batches()

    kept = rows.where(F.col("key").isNotNull())
    schema = T.StructType([T.StructField("query", T.LongType()), kept.schema["key"], T.StructField("score", T.DoubleType()), T.StructField("order", T.LongType())])
    ranked = kept.mapInArrow(score, schema).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("order"), "key"))).where(F.col("rank") <= k)
    # As many rows as the share has queries.
    named = rows.sparkSession.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("query", T.LongType()), T.StructField("query_id", asked.schema["query_id"].dataType)]))
    return ranked.join(F.broadcast(named), "query").select("query_id", "key", "score", "rank")


def top(scored: DataFrame, k: int, *ties: str) -> DataFrame:
    """The k best rows by score, then by the given columns."""
    return scored.orderBy(F.desc("score"), *ties).limit(k)


def idf_value(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), LEAST_IDF)
