"""Registered queries and their SQL equivalents, over the driver's tables.

Documents are files: path /{source}/{doc_id}.txt, tag lang, source root
/{source}; each whole text is one passage where a query isn't about chunking.
Conversations are files with one chunk a turn. embeddings.vec_id is taken as
the doc_id of the passage it belongs to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chunking, models, passages, paths, text, vectors
from ..functions.partition import spread
from ..operators import fusion, keyword, store
from ..sources import extract
from ..streaming import watch
from . import oracle

AND, OR, PHRASE, MISSING = "the erin of", "ouen thand rre", "of-the erin", "zzqqx the"
EXCLUDE = ["**/*.bak.txt", "src1/**", "*7.txt", "src{2,3}/1?.txt"]
K = 10


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def heavy(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """A table for work that is heavy by the row."""
    return spread(read(spark, sf, table))


def files(spark: SparkSession, sf: str) -> DataFrame:
    """documents as files."""
    return heavy(spark, sf, "documents").select("doc_id", F.format_string("/%s/%d.txt", "source", "doc_id").alias("path"), F.concat(F.lit("/"), "source").alias("root"), F.col("lang").alias("tag"), F.col("source"), "text", "n_chars")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as chunks: seq is the turn; every turn is a page."""
    return read(spark, sf, "conversations").select("conv_id", F.format_string("/mail/%d.mbox", "conv_id").alias("path"), F.col("turn").cast("int").alias("seq"), (F.col("turn") + 1).cast("int").alias("page"), "role", "text")


def clean_text(spark, sf):
    cleaned = text.strip_junk(text.trim_space(F.col("text")))
    return heavy(spark, sf, "documents").select("doc_id", cleaned.alias("text")).where("text <> ''")


def format_dispatch(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), "doc_id", F.lit("."), "lang").alias("path"))
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"))
    talks = turns(spark, sf).select(F.col("conv_id").alias("id"), F.upper("path").alias("path")).distinct()
    every = docs.unionByName(pages).unionByName(talks)
    return every.select("id", "path", paths.extension(F.col("path")).alias("ext"), paths.supported(F.col("path")).alias("supported"))


def path_exclude(spark, sf):
    """Every document's path, and variants of it in hidden and machine-made directories."""
    rel = files(spark, sf).select(F.expr("substr(path, 2)").alias("rel"))
    variants = rel.select(F.explode(F.array("rel", F.concat(F.lit(".git/"), "rel"), F.concat(F.lit("a/node_modules/"), "rel"), F.concat(F.lit("a/"), "rel", F.lit("/build")), F.regexp_replace("rel", r"\.txt$", ".bak.txt"))).alias("rel"))
    return variants.select("rel", paths.in_hidden_dir(F.col("rel")).alias("hidden"), paths.excluded(F.col("rel"), EXCLUDE).alias("excluded"), paths.eligible(F.col("rel"), EXCLUDE).alias("eligible"))


def with_headings(spark, sf) -> DataFrame:
    """documents as markdown: lines of at most four words become headings, '###'-marked words open fences."""
    marked = F.regexp_replace("text", r"(?m)^(\S+(?: \S+){0,3})$", "## $1")
    return heavy(spark, sf, "documents").select("doc_id", F.regexp_replace(marked, r"(?m)^(\S+\*\*\* )", "```$1").alias("text"))


def markdown_sections(spark, sf):
    return extract.markdown_sections(with_headings(spark, sf))


def html_sections(spark, sf):
    pages = heavy(spark, sf, "pages").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.encode("html", "UTF-8").alias("content"))
    found = extract.extract_files(pages, "page_id", "content", "name")
    return found.select("page_id", F.posexplode("sections").alias("section", "s")).select("page_id", "section", F.col("s.text").alias("text"), F.col("s.page").alias("page"))


def chunk_documents(spark, sf):
    section = F.struct(text.strip_junk(text.trim_space(F.coalesce("text", F.lit("")))).alias("text"), F.lit(0).alias("page"))
    return chunking.chunk_files(heavy(spark, sf, "documents").select("doc_id", F.array(section).alias("sections")), "doc_id")


def _bm25(query: str, any_word: bool = False, tag: str = ""):
    def run(spark, sf):
        docs = files(spark, sf)
        scored = keyword.bm25_scan(docs, query, any_word, "doc_id")
        shown = docs.select("doc_id", "path", "tag")
        if tag:
            found = keyword.top(shown.where(F.col("tag") == tag).join(scored, "doc_id"), K, "doc_id")
        else:  # K rows meet the places, not all scores
            found = shown.join(F.broadcast(keyword.top(scored, K, "doc_id")), "doc_id")
        return found.select("doc_id", text.citation(F.col("path"), F.lit(0), F.lit(0)).alias("cite"), F.round("score", 6).alias("score"))

    return run


def _by_blocks(query: str, any_word: bool):
    """The same hits from postings and their blocks, as an index stores them."""

    def run(spark, sf):
        docs = files(spark, sf)
        posted = keyword.stored_postings(docs.selectExpr("doc_id file_id", "doc_id chunk_id", "text"))
        bits = 56  # the ids are small numbers: 256 of them a block
        stats = tuple(keyword.corpus_stats(keyword.lengths(docs, "doc_id")).select("n", "total").first())
        found = keyword.best(posted, keyword.blocks(posted, bits=bits), keyword.single_terms(query), any_word, stats, K, bits=bits)
        hits = keyword.top(found.scored, K, "chunk_id").withColumnRenamed("chunk_id", "doc_id")
        return docs.select("doc_id", "path").join(F.broadcast(hits), "doc_id").select("doc_id", text.citation(F.col("path"), F.lit(0), F.lit(0)).alias("cite"), F.round("score", 6).alias("score"))

    return run


def batch_search(spark, sf):
    """Every benchmark item as a query over the documents: its three best ones, in two scans of the texts."""
    items = read(spark, sf, "benchmark").selectExpr("item_id query_id", "text query")
    found = keyword.batch_scan(heavy(spark, sf, "documents"), items, 3, "doc_id")
    return found.select(F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("score"), "rank")


def corpus_stats(spark, sf):
    found = keyword.corpus_stats(keyword.lengths(heavy(spark, sf, "documents"), "doc_id"))
    return found.select("n", "total", F.round("avgdl", 6).alias("avgdl"))


def term_df(spark, sf):
    return keyword.term_df(keyword.postings(heavy(spark, sf, "documents"), "doc_id"), "doc_id")


def _query_vector(spark, sf) -> list[float]:
    """The vector of the smallest vec_id."""
    return list(read(spark, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0])


def vector_topk(spark, sf):
    found = vectors.top_vectors(read(spark, sf, "embeddings"), _query_vector(spark, sf), K)
    return found.select("vec_id", F.round("score", 5).alias("score"))


def vector_topk_codes(spark, sf):
    """The same by int8 codes: only vectors whose bounds reach the best ones are compared exactly."""
    e = read(spark, sf, "embeddings")
    found = vectors.top_vectors_by_codes(vectors.codes(e), e, _query_vector(spark, sf), K)
    return found.scored.select("vec_id", F.round("score", 5).alias("score"))


def vector_topk_tag(spark, sf):
    e = read(spark, sf, "embeddings")
    found = vectors.top_vectors(e.where("label = 3"), _query_vector(spark, sf), K)
    return found.select("vec_id", F.round("score", 5).alias("score"))


def relevance_floor(spark, sf):
    found = vectors.top_vectors(read(spark, sf, "embeddings"), _query_vector(spark, sf), 50)
    return fusion.relevant(found).select("vec_id", F.round("score", 5).alias("score"))


def _legs(spark, sf, query: str):
    """(keyword hits, hits of any word, nearest vectors), each truncated, as (path, seq, doc_id, score)."""
    docs = files(spark, sf)

    def hits(scored):
        return keyword.top(docs.select("doc_id", "path").join(scored, "doc_id"), K, "path").select("path", F.lit(0).alias("seq"), "doc_id", "score")

    near = vectors.top_vectors(read(spark, sf, "embeddings"), _query_vector(spark, sf), K).withColumnRenamed("vec_id", "doc_id")
    return hits(keyword.bm25_scan(docs, query, False, "doc_id")), hits(keyword.bm25_scan(docs, query, True, "doc_id")), hits(near)


def _shown(found: DataFrame) -> DataFrame:
    return found.select("path", "doc_id", F.round("score", 6).alias("score"))


def rrf_fuse(spark, sf):
    kw, _, near = _legs(spark, sf, AND)
    return _shown(fusion.rrf([kw, near], ["path", "seq"], K))


def hybrid_strict(spark, sf):
    kw, any_word, near = _legs(spark, sf, AND)
    return _shown(fusion.hybrid(kw, any_word, near, ["path", "seq"], K))


def hybrid_keyword_only(spark, sf):
    kw, any_word, _ = _legs(spark, sf, MISSING)
    return _shown(fusion.hybrid(kw, any_word, None, ["path", "seq"], K))


def hybrid_answer_fallback(spark, sf):
    """No word matches and the vectors are all below the floors: the nearest ones."""
    kw, any_word, near = _legs(spark, sf, "zzqqx")
    far = near.withColumn("score", F.col("score") * 0.1)
    return _shown(fusion.hybrid(kw, None, far, ["path", "seq"], K, answer=True))


def _store(spark, sf) -> dict[str, DataFrame]:
    """documents as an index: a source a folder, a file a document, a chunk a line, vectors by vec_id."""
    docs = files(spark, sf)
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return {
        "sources": docs.groupBy("root").agg(F.min("tag").alias("tag")).select(F.col("root").alias("source_id"), F.col("root").alias("path"), "tag"),
        "files": docs.select(F.col("doc_id").alias("file_id"), F.col("root").alias("source_id"), "path", F.concat(F.sha2("text", 256), F.lit(":2")).alias("sha256"), F.octet_length("text").alias("size")),
        "chunks": chunks.select(F.format_string("%d:%d", "doc_id", "seq").alias("chunk_id"), F.col("doc_id").alias("file_id"), "seq", F.lit(0).alias("page"), "text"),
        "embeddings": read(spark, sf, "embeddings").select(F.format_string("%d:0", "vec_id").alias("chunk_id"), F.col("embedding").alias("vector")),
        "meta": spark.createDataFrame([("embed_model", "driver/64")], "key string, value string"),
    }


def sources_rollup(spark, sf):
    t = _store(spark, sf)
    return store.sources_rollup(t["sources"], t["files"], t["chunks"])


def status_totals(spark, sf):
    return store.totals(sources_rollup(spark, sf))


def changed_files(spark, sf):
    """Files whose cleaned text differs from what was stored, and what they weigh."""
    docs = files(spark, sf)
    clean = F.regexp_replace("text", r"[#*&%$!]+", "")
    scanned = docs.select("path", store.file_sha(clean.cast("binary")).alias("sha256"), F.octet_length(clean).cast("long").alias("size"))
    return store.changed(scanned, _store(spark, sf)["files"])


def prune_files(spark, sf):
    """Files that stay when a pass over /src0 saw only its labelled documents."""
    t = _store(spark, sf)
    seen = files(spark, sf).join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    return store.prune(t, "/src0", seen)["files"].select("path", "size")


def missing_embeddings(spark, sf):
    t = _store(spark, sf)
    return store.missing_embeddings(t["chunks"], t["embeddings"]).select("chunk_id")


def embed_cache_dedupe(spark, sf):
    found = store.distinct_texts(read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return found.select("sha", "first", "copies")


def remove_source_cascade(spark, sf):
    """What each table holds after a source was removed."""
    left = store.remove_sources(_store(spark, sf), ["/src0"])
    counts = [left[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n") for t in ("sources", "files", "chunks", "embeddings", "meta")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def chunk_context(spark, sf):
    """Every assistant turn with the turns beside it."""
    t = turns(spark, sf)
    cited = t.where("role = 'assistant'").select("path", F.col("seq").alias("cited_seq"))
    return store.contexts(t, cited, 1).select("path", "cited_seq", "seq", "page", "current", "text")


def l2_normalize(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    unit = vectors.l2_normalize(v)
    return read(spark, sf, "embeddings").select("vec_id", F.posexplode(unit).alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 5).alias("x"))


def _quantized(spark, sf) -> DataFrame:
    e = read(spark, sf, "embeddings").withColumn("scale", vectors.quantize_scale(F.col("embedding")))
    return e.withColumn("q", vectors.quantize_int8(F.col("embedding"), F.col("scale")))


def quantize_int8(spark, sf):
    return _quantized(spark, sf).select("vec_id", F.round("scale", 9).alias("scale"), F.posexplode("q").alias("i", "q"))


def dequantize(spark, sf):
    found = _quantized(spark, sf).select("vec_id", F.posexplode(vectors.dequantize(F.col("q"), F.col("scale"))).alias("i", "x"))
    return found.select("vec_id", "i", F.round("x", 5).alias("x"))


def softmax_rows(spark, sf):
    found = read(spark, sf, "embeddings").select("vec_id", F.posexplode(vectors.softmax(F.col("embedding"))).alias("i", "p"))
    return found.select("vec_id", "i", F.round("p", 5).alias("p"))


def mean_pool_label(spark, sf):
    rows = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("x"))


def excerpt(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", passages.excerpts(F.col("text"), text.py_words(OR)).alias("excerpt"))


def fts_snippet(spark, sf):
    return heavy(spark, sf, "documents").select("doc_id", passages.snippets(F.col("text"), OR).alias("snippet"))


def citations(spark, sf):
    t = turns(spark, sf)
    path, page, seq = F.col("path"), F.col("page"), F.col("seq")
    return t.select("path", "seq", text.citation(path, page, seq).alias("cite"), text.citation(path, F.lit(0), seq).alias("cite_chunk"), text.prompt_label(path, page, seq).alias("label"), text.prompt_label(path, F.lit(0), seq).alias("label_chunk"), text.one_line(F.col("text")).alias("line"))


def _entries(spark, sf, label) -> DataFrame:
    """Every conversation's turns as one numbered list."""
    t = turns(spark, sf).withColumn("entry", text.numbered(F.col("seq") + 1, label(F.col("path"), F.col("page"), F.col("seq")), F.coalesce("text", F.lit(""))))
    return t.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "entry"))), lambda s: s["entry"]), "").alias("body"))


def prompt_assembly(spark, sf):
    return _entries(spark, sf, text.prompt_label).select("path", F.concat("body", F.lit("Question: why?")).alias("prompt"))


def mcp_render(spark, sf):
    return _entries(spark, sf, text.citation).select("path", text.trim_space(F.col("body")).alias("rendered"))


def owner_longest_prefix(spark, sf):
    docs = files(spark, sf)
    roots = docs.select("root").distinct().unionByName(docs.select(F.concat("root", F.lit("/"), (F.col("doc_id") % 10).cast("string")).alias("root")).distinct())
    deep = docs.select(F.concat("root", F.lit("/"), (F.col("doc_id") % 20).cast("string"), F.lit("/"), "doc_id", F.lit(".txt")).alias("path"))
    return store.owners(deep.unionByName(docs.select(F.concat(F.lit("/other"), "path").alias("path"))), roots)


def _ops(spark, sf) -> DataFrame:
    """events as changes: a user is a file, the event's type an operation."""
    op = F.create_map(*[F.lit(x) for kv in (("view", "write"), ("click", "write"), ("signup", "create"), ("purchase", "rename"), ("error", "remove")) for x in kv])[F.col("event_type")]
    n = F.col("user_id")
    rel = F.when(n % 7 == 0, F.format_string("dist/%d.md", n)).when(n % 5 == 0, F.format_string("notes/%d.jpg", n)).otherwise(F.format_string("notes/%d.md", n))
    return read(spark, sf, "events").select("event_id", "ts", "user_id", op.alias("op"), rel.alias("rel"))


def route_events(spark, sf):
    job = watch.route(F.col("op"), F.col("rel").endswith("0.jpg"), F.col("rel").endswith("11.md"), F.concat(F.lit("/root/"), "rel"), F.col("rel"), ["**/*9.md"])
    return _ops(spark, sf).select("event_id", job.alias("job"))


def debounce_sessions(spark, sf):
    return watch.debounced(read(spark, sf, "events"), "user_id", "ts", 600, "event_id", "event_type")


def eta_ema(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done = read(spark, sf, "events").withColumn("done", F.row_number().over(order))
    found = watch.smoothed_rates(done, "user_id", "ts", "done")
    return found.select("user_id", "samples", F.round("rate", 6).alias("rate"))


def milestones(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf, "events").withColumn("done", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("user_id")))
    return watch.milestones(e, "user_id", "ts", "done", "total", "event_id").select("user_id", "event_id", "pct", "tenth")


def recall_at_k(spark, sf):
    """Share of labelled documents of high quality among the keyword hits of the answer query, by rank."""
    hits = _bm25(OR, True)(spark, sf).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "doc_id")))
    good = read(spark, sf, "labels").where("quality = 1").select("doc_id", F.lit(1).alias("good"))
    ranked = hits.join(good, "doc_id", "left").withColumn("hit", F.coalesce("good", F.lit(0)))
    ks = spark.createDataFrame([(1,), (3,), (10,)], "k int")
    return ranked.crossJoin(F.broadcast(ks)).where("rank <= k").groupBy("k").agg(F.sum("hit").alias("hits"), F.round(F.avg("hit"), 6).alias("recall"))


MODELS = ["all-MiniLM-L6", "llava-7b", "nomic-embed-text", "qwen-VL-7b", "llama-3-8b", "deepseek-ocr"]


def model_pick(spark, sf):
    """Every language as an endpoint that offers a model a source, the largest first: what is picked to chat and to see."""
    offers = read(spark, sf, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("d"), F.count("*").alias("n"))
    pos = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))
    name = F.get(F.array(*map(F.lit, MODELS)), F.pmod("d", F.lit(len(MODELS))).cast("int"))
    m = offers.select("lang", pos.alias("pos"), F.concat(name, F.lit("-"), "source").alias("id"))
    return models.chat_model(m, "lang").select("lang", F.lit("chat").alias("use"), "id").unionByName(models.vision_model(m, "lang").select("lang", F.lit("vision").alias("use"), "id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bm25_and": _bm25(AND),
    "bm25_or": _bm25(OR, True),
    "bm25_phrase": _bm25(PHRASE),
    "bm25_tag": _bm25(OR, True, "fr"),
    "bm25_blocks_and": _by_blocks(AND, False),
    "bm25_blocks_or": _by_blocks(OR, True),
}
for _f in (
    clean_text, format_dispatch, path_exclude, markdown_sections, html_sections, chunk_documents, corpus_stats, term_df, vector_topk, vector_topk_codes, vector_topk_tag, relevance_floor,
    rrf_fuse, hybrid_strict, hybrid_keyword_only, hybrid_answer_fallback, sources_rollup, status_totals, changed_files, prune_files, missing_embeddings, embed_cache_dedupe,
    remove_source_cascade, chunk_context, l2_normalize, quantize_int8, dequantize, softmax_rows, mean_pool_label, excerpt, fts_snippet, citations, prompt_assembly, mcp_render,
    owner_longest_prefix, batch_search, route_events, debounce_sessions, eta_ema, milestones, recall_at_k, model_pick,
):
    QUERIES[_f.__name__] = _f

#: SQL by query; chunk_documents and fts_snippet are tested against brute force instead.
ORACLE: dict[str, str] = oracle.build({"AND": AND, "OR": OR, "PHRASE": PHRASE, "MISSING": MISSING, "MODELS": MODELS, "EXCLUDE": EXCLUDE})
