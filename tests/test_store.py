"""Changes of the index tables as frames."""

import pytest
from pyspark.sql import functions as F

from lodestack.operators import store


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "sources": make([(1, "/a", "t"), (2, "/b", "")], "source_id long, path string, tag string").withColumn("added_at", F.lit("2024-01-01").cast("timestamp")),
        "files": make([(10, 1, "/a/x", "s1", 5, 0), (11, 1, "/a/y", "s2", 6, 0), (20, 2, "/b/z", "s3", 7, 0)], store.TABLES["files"]),
        "chunks": make([(100, 10, 0, 0, "one"), (101, 10, 1, 0, "two"), (110, 11, 0, 0, "one"), (200, 20, 0, 0, "three")], store.TABLES["chunks"]),
        "embeddings": make([(100, [1.0]), (200, [2.0])], store.TABLES["embeddings"]),
        "embedding_cache": make([("c", "m", [1.0])], store.TABLES["embedding_cache"]),
        "meta": make([("embed_model", "m")], store.TABLES["meta"]),
    }


def ids(df, column):
    return sorted(r[0] for r in df.select(column).collect())


def test_replacing_a_file(spark, tables):
    files = spark.createDataFrame([(10, 2, "/a/x", "new", 1, 1)], store.TABLES["files"])
    chunks = spark.createDataFrame([(100, 10, 0, 0, "fresh")], store.TABLES["chunks"])
    out = store.replace_files(tables, files, chunks)
    assert ids(out["files"], "sha256") == ["new", "s2", "s3"]
    assert ids(out["chunks"], "text") == ["fresh", "one", "three"]
    assert ids(out["embeddings"], "chunk_id") == [200]


def test_pruning(spark, tables):
    out = store.prune(tables, 1, spark.createDataFrame([("/a/y",)], "path string"))
    assert ids(out["files"], "file_id") == [11, 20]
    assert ids(out["chunks"], "chunk_id") == [110, 200]


def test_removing_sources(tables):
    one = store.remove_sources(tables, ["/a"])
    assert [ids(one[t], c) for t, c in (("sources", "path"), ("files", "file_id"), ("chunks", "chunk_id"), ("embeddings", "chunk_id"), ("meta", "value"))] == [["/b"], [20], [200], [200], ["m"]]
    none = store.remove_sources(tables, ["/a", "/b", "/c"])
    assert none["meta"].count() == none["files"].count() == 0
    assert none["embedding_cache"].count() == 1


def test_rollup_and_missing(tables):
    rows = [tuple(r) for r in store.sources_rollup(tables["sources"], tables["files"], tables["chunks"]).collect()]
    assert rows == [("/a", "t", 2, 3), ("/b", "", 1, 1)]
    assert ids(store.missing_embeddings(tables["chunks"], tables["embeddings"]), "chunk_id") == [101, 110]
    assert sorted((r["first"], r["copies"]) for r in store.distinct_texts(tables["chunks"]).collect()) == [(100, 2), (101, 1), (200, 1)]


def test_embedding_what_is_missing(spark, tables):
    asked = []

    def embedder(rows):
        asked.extend(r["text"] for r in rows.collect())
        return rows.select("sha", F.array(F.length("text").cast("float")).alias("vector"))

    missing = store.missing_embeddings(tables["chunks"], tables["embeddings"]).select("file_id", "chunk_id", "text")
    cache = spark.range(1).select(F.sha2(F.lit("two"), 256).alias("sha"), F.lit("m").alias("model"), F.array(F.lit(9.0).cast("float")).alias("vector"))
    vectors, made, meta = store.embed_missing(missing, cache, tables["meta"], embedder, "m")
    assert asked == ["one"]
    assert sorted((r["chunk_id"], r["vector"]) for r in vectors.collect()) == [(101, [9.0]), (110, [3.0])]
    assert made.count() == 1
    assert meta.count() == 1
    with pytest.raises(ValueError, match="vectors of"):
        store.embed_missing(missing, cache, tables["meta"], embedder, "other")


def test_context(spark):
    chunks = spark.createDataFrame([("/a", n, 0, f"t{n}") for n in range(4)], "path string, seq int, page int, text string")
    near = lambda seq, w=1: [(r["seq"], r["current"]) for r in store.context(chunks, "/a", seq, w).collect()]
    assert near(0) == [(0, True), (1, False)]
    assert near(2, 5) == [(0, False), (1, False), (2, True), (3, False)]
    assert near(9) == []
    assert store.context(chunks, "/b", 0).count() == 0


def test_owners(spark):
    paths = spark.createDataFrame([("/data/docs/a",), ("/data/docs2/a",), ("/data",), ("/x",)], "path string")
    roots = spark.createDataFrame([("/data",), ("/data/docs",), ("/data/docs",)], "root string")
    assert {r["path"]: r["root"] for r in store.owners(paths, roots).collect()} == {"/data/docs/a": "/data/docs", "/data/docs2/a": "/data", "/data": "/data", "/x": None}


def test_blocks_and_batches_score_as_single_searches(spark):
    """Block-pruned and batched keyword search against bm25() on whole documents, for several block sizes and thresholds."""
    from lodestack.operators import keyword

    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id file_id", "doc_id chunk_id", "text")
    postings = keyword.stored_postings(docs).cache()
    stats = tuple(keyword.corpus_stats(keyword.lengths(docs)).select("n", "total").first())
    shown = lambda df, k: [(r["chunk_id"], round(r["score"], 9)) for r in df.orderBy(F.desc(F.round("score", 9)), "chunk_id").limit(k).collect()]
    first, ranges = keyword.FIRST, keyword.RANGES
    passed = []
    try:
        for q, any_word in (("the erin of", False), ("ouen thand the", True), ("the the and", True)):
            expected = shown(keyword.bm25(postings, None, q, any_word, stats=stats), 5)
            for bits, keyword.FIRST, keyword.RANGES in ((60, 2, 256), (63, 4, 3), (64, 6, 256), (57, 32, 256)):
                found = keyword.best(postings, keyword.blocks(postings, bits=bits), keyword.single_terms(q), any_word, stats, 5, bits=bits)
                assert shown(found.scored, 5) == expected
                passed.append(found.passed)
    finally:
        keyword.FIRST, keyword.RANGES = first, ranges
    assert sum(p > 0 for p in passed) > 3
    assert keyword.single_terms("of-the erin") is None
    queries = ["the erin of", "of-the erin", "zzqq ouen", "zzqq", "the the"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    got = keyword.batch(postings, asked, stats, 4).collect()
    for n, q in enumerate(queries):
        own = sorted((r["rank"], r["chunk_id"], round(r["score"], 9)) for r in got if r["query_id"] == n)
        assert [x[1:] for x in own] == shown(keyword.bm25(postings, None, q, True, stats=stats), 4)
    strict = keyword.batch(postings, asked, stats, 4, strict_first=True).where("query_id = 0").orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 9)) for r in strict] == shown(keyword.bm25(postings, None, queries[0], stats=stats), 4)
    postings.unpersist()


def test_scanned_batches_by_plain_counts(spark, monkeypatch):
    """batch_scan() against counts in Python: phrases that share beginnings and overlap themselves, copies, nulls, shares and small pieces."""
    import random
    from collections import Counter

    from lodestack.functions import phrases, text
    from lodestack.operators import keyword

    draw = random.Random(4)
    texts = [" ".join(draw.choices("a b c d".split(), k=draw.randrange(30))) for _ in range(80)]
    texts += [None, "", "a a a a a", "e", "b-a " * 700, *texts[:30]]
    rows = [(*r,) for r in enumerate(texts)] + [(None, "a b c d zz")]
    asked = [(i, " ".join("-".join(draw.choices("a b c d".split(), k=draw.randrange(1, 4))) for _ in range(3))) for i in range(12)]
    asked += [(20, "a-a a-a-a a a"), (21, "zz e"), (22, "zz"), (23, " - "), (24, None), (25, "E")]
    split = [(d, (t or "").split(" ") if "-" not in (t or "") else text.py_terms(t)) for d, t in rows]
    split = [(d, [t for t in ts if t]) for d, ts in split]
    n, avgdl = len(split), sum(len(ts) for _, ts in split) / len(split)

    def tf(ts, p):
        return sum(tuple(ts[i : i + len(p)]) == p for i in range(len(ts)))

    expected = set()
    for q, query in asked:
        scores = Counter()
        for p, weight in (keyword.phrases(query) if (query or "").strip() else {}).items():
            tfs = {d: (c, len(ts)) for d, ts in split if d is not None and (c := tf(ts, p))}
            for d, (c, dl) in tfs.items():
                scores[d] += weight * keyword.idf_value(n, len(tfs)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avgdl))
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:5]
        expected |= {(q, d, round(s, 7), r) for r, (d, s) in enumerate(best, 1)}
    assert len(expected) > 60
    docs = spark.createDataFrame(rows, "doc int, t string")
    queries = spark.createDataFrame(asked, "query_id int, query string")
    for share, tokens, cells in ((1 << 20, 1 << 20, 1 << 20), (10, 50, 40), (1 << 20, 1, 1)):
        monkeypatch.setattr(keyword, "SHARE", share)
        monkeypatch.setattr(phrases, "TOKENS", tokens)
        monkeypatch.setattr(phrases, "CELLS", cells)
        got = keyword.batch_scan(docs.repartition(3), queries, 5, "doc", "t")
        assert got.schema["doc"].dataType.simpleString() == "int"
        assert {(r["query_id"], r["doc"], round(r["score"], 7), r["rank"]) for r in got.collect()} == expected
    monkeypatch.undo()
    assert keyword.batch_scan(docs.limit(0), queries, 5, "doc", "t").count() == 0
    assert keyword.batch_scan(docs, queries.limit(0), 5, "doc", "t").count() == 0


def test_batches_deal_postings_once(spark):
    """batch() over postings shuffles about what matches, by chunk, and not scores for each query and chunk."""
    from lodestack.operators import keyword

    from .conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id file_id", "doc_id chunk_id", "text")
    postings = keyword.stored_postings(docs).cache()
    stats = tuple(keyword.corpus_stats(keyword.lengths(docs)).select("n", "total").first())
    queries = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id query_id", "text query")
    context, n = spark.sparkContext._jsc.sc(), postings.count()

    def shuffled() -> int:
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    assert keyword.batch(postings, queries, stats, 3).count() == 3 * queries.count()
    postings.unpersist()
    # 11 bytes a posting; 32 with a shuffle for each grouping.
    assert shuffled() - before < 16 * n
