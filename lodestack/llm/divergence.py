"""Audit of how sources of one language differ in their use of terms.

Terms are counted by (language, source) in one pass over the texts. Every term
that enough documents of its language hold has a sparse vector of counts by
source. Terms with identical vectors are one row with a multiplicity: all
pairs of sources are evaluated once for each such row and multiplied. Terms
themselves return for the ranking of each source's own ones.

All arithmetic is on integers: p = 1 + floor(SCALE * (count + 1) / (size + terms)),
and the divergence of p from q is floor((p - q)^2 / q).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, read, staged

SCALE = 1_000_000_000
#: Documents of a language that hold a kept term, at least; ranks of a source's terms.
MIN_DOCS, TOP = 3, 200
#: Bytes of a text that are split at a time; counts that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 300_000
#: Least number of shards of a language's vectors, and evaluations (terms x sources x sources) that add one.
SHARDS, PER_SHARD = 64, 1 << 28
#: Cells of a dense block of counts, and of the sums of pairs, that a task holds.
CELLS, SUMS = 1 << 18, 1 << 20
#: A-Z in lower case, all other ASCII but a-z as blanks.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
P_SQL = "1 + cast({scale} as decimal(18,0)) * cast({n} + 1 as decimal(20,0)) div cast({size} + terms as decimal(20,0))"


def pieces(raw: bytes):
    """The terms of a text in UTF-8, in lists of bounded length."""
    raw, at = raw.translate(TABLE), 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents with the term, added up within tasks only."""

    def work(batches):
        found, held = {}, 0

        def rows():
            for (lang, source), (n, docs) in found.items():
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                same = lambda x, many=len(n): pa.array([x], pa.string()).take(pa.array(np.zeros(many, np.int32)))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                n, docs = found.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for part in pieces(text.as_buffer().to_pybytes()):
                    n.update(part)
                    own.update(part)
                docs.update(own)
                held += len(n) - before
                if held > HELD:
                    yield from rows()
                    found, held = {}, 0
        yield from rows()

    return docs.select("lang", "source", "text").mapInArrow(work, "lang string, source string, term string, n long, docs long")


def pair_sums(vectors: DataFrame, stats: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from every other, summed over the kept terms of the language.

    vectors: (lang, vector, m), the distinct vectors and their multiplicity;
    stats: (lang, source, size, terms). A language's vectors are dealt over
    shards by their hash; each shard begins with the sizes of its sources, and
    adds up its pairs before they are shuffled.
    """
    kind = "array<struct<source:string,n:bigint>>"
    known = stats.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.col("size").alias("n")))).cast(kind).alias("vector"), F.max("terms").alias("m"), F.count("*").alias("_s"))
    # No language has more distinct vectors than terms.
    work_of = known.agg(F.max(F.expr("m * _s * _s")).alias("n")).first()["n"] or 0
    shards = SHARDS + work_of // PER_SHARD
    heads = known.select("lang", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), F.lit(0).alias("kind"), "vector", "m")
    body = vectors.select("lang", F.expr(f"pmod(xxhash64(vector), {shards}L)").alias("shard"), F.lit(1).alias("kind"), F.col("vector").cast(kind).alias("vector"), "m")
    dealt = heads.union(body).repartition("lang", "shard").sortWithinPartitions("lang", "shard", "kind")

    def work(batches):
        names, sizes, terms, lang, shard = [], None, 0, None, None

        def sums(counts: np.ndarray, m: np.ndarray):
            """Rows of the pairs' sums over dense rows of counts; m: multiplicities."""
            s, step = len(names), max(1, SUMS // len(names))
            if len(counts) and int(counts.max()) > (1 << 62) // SCALE:
                counts = counts.astype(object)
            p = 1 + SCALE * (counts + 1) // (sizes + terms)
            for low in range(0, s, step):
                own = range(low, min(low + step, s))
                total = [(((p[:, [a]] - p) ** 2 // p) * m[:, None]).sum(0).tolist() if len(p) else [0] * s for a in own]
                index = np.repeat(np.arange(low, low + len(own)), s)
                pick = pa.array(names, pa.string()).take
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(index), pa.string()), pick(pa.array(index)), pick(pa.array(np.tile(np.arange(s), len(own)))), pa.array([v for t in total for v in t], pa.int64())], names=["lang", "source", "item", "value"])

        for b in batches:
            langs, kinds, m = b.column(0).to_pylist(), b.column(2).to_numpy(), b.column(4).to_numpy()
            heads = [*np.flatnonzero(kinds == 0).tolist(), len(kinds)]
            begin = 0
            for h in heads:
                if h > begin:  # vectors of the head that came before
                    part, index = b.column(3).slice(begin, h - begin), {x: i for i, x in enumerate(names)}
                    flat, lengths = part.flatten(), np.diff(part.offsets.to_numpy())
                    column = flat.field(0).dictionary_encode()
                    at = np.array([index[x] for x in column.dictionary.to_pylist()], np.int64)[column.indices.to_numpy()]
                    n, row, mult = flat.field(1).to_numpy(), np.repeat(np.arange(h - begin), lengths), m[begin:h]
                    step = max(1, CELLS // len(names))
                    for low in range(0, h - begin, step):
                        high = min(low + step, h - begin)
                        inside = (row >= low) & (row < high)
                        dense = np.zeros((high - low, len(names)), np.int64)
                        dense[row[inside] - low, at[inside]] = n[inside]
                        yield from sums(dense, mult[low:high])
                if h < len(kinds):
                    known = b.column(3)[h].as_py()
                    lang, shard, terms = langs[h], b.column(1)[h].as_py(), int(m[h])
                    names, sizes = [x["source"] for x in known], np.array([x["n"] for x in known], np.int64)
                    if shard == 0:
                        yield from sums(np.zeros((0, len(names)), np.int64), m[:0])
                    begin = h + 1

    found = dealt.mapInArrow(work, "lang string, source string, item string, value long").where("source <> item")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how every source differs from the others and from its language.

    docs needs text, lang and source, nulls of which count as ''; other columns
    are left out, and every row is a document, repeated ones too. Part `pair`
    has all other sources of the language, `term` the terms that a source has
    more of than its language, up to rank `top`; ties go to the item that sorts
    first by its UTF-8 bytes. A group without terms, of empty texts for
    example, has its pairs; in a language without kept terms they are 0. An
    empty table gives an empty result.
    """
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"))
    folder = staged(terms.where(F.col("docs") >= min_docs).drop("docs"), "terms")
    terms = docs.sparkSession.read.schema("lang string, term string, total long, vector array<struct<source:string,n:bigint>>").parquet(folder)
    cells = terms.select("lang", "term", "total", F.explode("vector").alias("_c")).select("lang", "term", "total", "_c.source", "_c.n")
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_size"))
    stats = cut(rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "lang_size"]))

    pairs = pair_sums(terms.groupBy("lang", "vector").agg(F.count("*").alias("m")), stats)
    p, q = (F.expr(P_SQL.format(scale=SCALE, n=n, size=size)) for n, size in (("n", "size"), ("total", "lang_size")))
    own = cells.join(stats, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    own = own.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = [x.withColumn("rank", rank).withColumn("part", F.lit(part)) for part, x in (("pair", pairs), ("term", own))]
    return ranked[0].union(ranked[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sources and over-represented terms of every source of `documents`."""
    return audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN k USING (lang) GROUP BY l.lang),
s AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
t AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
ts AS (SELECT lang, sum(n) AS size FROM t GROUP BY lang),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + (CAST({SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (s.size + v.v) AS BIGINT) AS p
  FROM s JOIN v USING (lang) JOIN k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
q AS (SELECT t.lang, t.term, CAST(1 + (CAST({SCALE} AS HUGEINT) * (t.n + 1)) // (ts.size + v.v) AS BIGINT) AS q FROM t JOIN ts USING (lang) JOIN v USING (lang)),
term AS (SELECT p.lang, p.source, p.term AS item, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) AS value
  FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
both_ AS (SELECT *, 'pair' AS part FROM pair UNION ALL SELECT *, 'term' AS part FROM term),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM both_)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
