"""The engine: add folders, search them with citations, keep them fresh."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import __version__
from .functions import chunking, embed, passages, text, vectors
from .operators import fusion, keyword, store
from .sources import extract, folder
from .streaming import watch

MODES = ("", "search", "answer")
HIT = ("path", "seq", "page", "snippet", "text", "score")
#: How many times the limit of a search is taken at first, for rows that tie.
TIES = 4


def _root(path: str) -> str:
    return folder.canonical(path) if "://" not in path else path.rstrip("/")


def by_ids(df: DataFrame, column: str, ids: list[int]) -> DataFrame:
    """The rows with one of a few ids."""
    return df.where(F.col(column).isin(sorted(set(ids))))


@dataclass(frozen=True)
class Stats:
    """What a pass over a source did."""

    indexed: int = 0
    skipped: int = 0
    failed: int = 0
    chunks: int = 0
    scan_skipped: int = 0
    scan_failed: int = 0


class Engine:
    """An index on disk, and the queries over it.

    embedder: "environment" for the one that the environment names, if any;
    with None searches are by keyword. pdf_backend, transcribe: what reads PDF
    pages and their pictures, see extract.pdf().
    """

    def __init__(self, spark: SparkSession, path: str, embedder="environment", pdf_backend: extract.PdfBackend | None = None, transcribe: extract.Transcriber | None = None):
        self.spark, self.store = spark, store.Store(spark, path)
        self.embedder = embed.choose() if embedder == "environment" else embedder
        self.pdf_backend, self.transcribe = pdf_backend, transcribe
        #: Of the last keyword search by blocks.
        self.pruned: keyword.Pruned | None = None
        #: Of the last vector search by codes.
        self.compared: vectors.Pruned | None = None

    def add(self, root: str, tag: str | None = None, exclude: list[str] | None = None) -> Stats:
        """Index a folder or a file, or bring it up to date: changed files are read again, vanished ones leave.

        A file that can't be read is counted, and its last readable version stays.
        """
        root, tag, exclude = self._settings(root, tag, exclude)
        return self._index(root, tag, folder.scan(self.spark, root, exclude), True)

    def add_files(self, root: str, files: list[str], tag: str | None = None, exclude: list[str] | None = None) -> Stats:
        """Index some files of a root again; no other file is read."""
        root, tag, exclude = self._settings(root, tag, exclude)
        return self._index(root, tag, folder.scan_files(self.spark, root, files, exclude), False)

    def watch(self, root: str, checkpoint: str, tag: str | None = None, exclude: list[str] | None = None, interval: str = "1 second", quiet_ms: int = watch.QUIET_MS):
        """A running query that keeps a root fresh; watch.pending() of it is the number of jobs that wait.

        A file that was written is indexed by itself once it has been quiet for
        quiet_ms, anything else brings the root up to date once nothing of that
        kind has happened for as long. Jobs that are due together are one pass.
        """
        base, _, patterns = self._settings(root, tag, exclude)
        path = F.col("path")
        job = watch.route(F.col("op"), F.lit(False), text.base_name(path) == folder.CONFIG_NAME, path, F.substr("path", F.lit(len(base) + 2)), patterns)
        routed = watch.changes(self.spark, base).select(job.alias("job"), "path").where("job is not null")
        events = routed.select(F.when(F.col("job") == "file", path).otherwise(F.lit(base)).alias("key"), "job")

        def take(due: DataFrame) -> None:
            jobs = due.collect()  # no more than the change source has listed
            if any(r["job"] == "reconcile" for r in jobs):
                self.add(root, tag, exclude)
            elif jobs:
                self.add_files(root, [r["key"] for r in jobs], tag, exclude)

        return watch.run(watch.quiet_jobs(events, quiet_ms), checkpoint, take, interval)

    def _settings(self, root: str, tag: str | None, exclude: list[str] | None) -> tuple[str, str, list[str]]:
        root = _root(root)
        config = folder.load_config(root) if "://" not in root else folder.Config()
        return root, config.tag if tag is None else tag, [*config.exclude, *(exclude or [])]

    def _index(self, root: str, tag: str, scanned: DataFrame, whole: bool) -> Stats:
        manifest = self.store.manifest()
        old = self.store.read(manifest)
        source = self.spark.createDataFrame([(root, tag)], "path string, tag string").select(store.stable_id("path").alias("source_id"), "path", "tag", F.current_timestamp().alias("added_at"))
        source_id = source.select("source_id").first()[0]
        scanned = scanned.withColumn("sha256", store.file_sha(F.col("content")))
        fresh = store.changed(scanned, old["files"]).persist()
        read = extract.extract_files(fresh, backend=self.pdf_backend, transcribe=self.transcribe).persist()
        good = read.where("error is null")
        files = fresh.drop("content").join(good.select("path"), "path", "left_semi").select(store.stable_id("path").alias("file_id"), F.lit(source_id).alias("source_id"), "path", "sha256", "size", "mtime")
        chunks = chunking.chunk_files(good).select(store.stable_id("path", "seq").alias("chunk_id"), store.stable_id("path").alias("file_id"), "seq", "page", "text").persist()
        seen = scanned.select("path")
        gone = old["files"].where((F.col("source_id") == source_id) & F.lit(whole)).join(seen, "path", "left_anti").select("file_id")
        dead = old["files"].join(files.select("file_id"), "file_id", "left_semi").select("file_id").unionByName(gone).persist()
        of_file = chunks.select("chunk_id", "file_id")
        added = {
            "sources": store.upsert_sources(old["sources"], source),
            "files": files,
            "chunks": chunks,
            "lengths": keyword.lengths(chunks).join(of_file, "chunk_id"),
            "postings": keyword.stored_postings(chunks),
        }
        added["blocks"] = keyword.blocks(added["postings"])
        if self.embedder is not None:
            missing, waiting = chunks.select("file_id", "chunk_id", "text"), self.store.backlog(manifest, dead)
            if waiting is not None:
                missing = missing.unionByName(waiting)
            added["embeddings"], added["embedding_cache"], added["meta"] = store.embed_missing(missing, old["embedding_cache"], old["meta"], embed.embedder_for(self.embedder), self.embedder.model)
            added["codes"] = vectors.codes(added["embeddings"], "chunk_id", "vector", "file_id")
        failed, changed, total, n_chunks = read.where("error is not null").count(), fresh.count(), scanned.select("path").count(), chunks.count()
        if changed > failed or not dead.isEmpty() or manifest["version"] == 0 or (self.embedder is not None and waiting is not None):
            manifest = self.store.commit(added, dead, manifest)
        else:
            manifest = self.store.commit({"sources": added["sources"]}, None, manifest)
        marks = read.select(F.explode("sections").alias("s")).agg(F.count_if("s.scan_skipped").alias("a"), F.count_if("s.scan_failed").alias("b")).first()
        for df in (fresh, read, chunks, dead, *([added["embedding_cache"]] if "embedding_cache" in added else [])):
            df.unpersist()
        if max(map(len, manifest["segments"].values())) > store.SEGMENTS:
            with contextlib.suppress(store.Conflict):  # another writer was faster; the next commit tries again
                self.store.merge()
        return Stats(changed - failed, total - changed, failed, n_chunks, marks["a"], marks["b"])

    def remove(self, *roots: str) -> None:
        """Sources and all that came from their files leave; cached vectors stay.

        Where no vectors are left, the pinned model goes too, so that another can
        be chosen. LookupError for a root that isn't a source.
        """
        manifest = self.store.manifest()
        old, paths_ = self.store.read(manifest), [_root(r) for r in roots]
        for r in paths_:
            self.source_id(r)
        gone = old["sources"].where(F.col("path").isin(paths_)).select("source_id")
        dead = old["files"].join(gone, "source_id", "left_semi").select("file_id")
        left = old["embeddings"].join(dead, "file_id", "left_anti").limit(1).agg(F.count("*").alias("_left"))
        meta = old["meta"].crossJoin(F.broadcast(left)).where("key <> 'embed_model' or _left > 0").drop("_left")
        self.store.commit({"sources": old["sources"].where(~F.col("path").isin(paths_)), "meta": meta}, dead, manifest)

    def _source(self, root: str):
        return self.store.read()["sources"].where(F.col("path") == _root(root)).first()

    def source_id(self, root: str) -> int:
        """A source's id. LookupError if it isn't indexed."""
        found = self._source(root)
        if found is None:
            raise LookupError(f"{root} is not an indexed source")
        return found["source_id"]

    def source_tag(self, root: str) -> str:
        """A source's tag; empty if it isn't indexed."""
        found = self._source(root)
        return found["tag"] if found else ""

    def health(self) -> dict:
        """What this engine serves: its version, its index and its embedding model."""
        return {"ok": True, "version": __version__, "index": self.store.path, "model": self.embedder.model if self.embedder else ""}

    def render_sources(self) -> str:
        """The sources as text, a line each."""
        lines = [f"{r['path']} — {r['files']} files, {r['chunks']} chunks" + (f" (tag: {r['tag']})" if r["tag"] else "") for r in self.sources().collect()]
        return "\n".join(lines) or "Nothing is indexed yet: add a folder first."

    def render_hits(self, query: str, tag: str = "", limit: int | None = 8) -> str:
        """Numbered, cited passages for a query as text."""
        rows = self.search(query, tag, fusion.resolve_limit(limit, 8, 50)).collect()
        shown = [f"[{i}] {r['path']} ({f'page {r["page"]}' if r['page'] > 0 else f'chunk {r["seq"] + 1}'})\n{r['text'] or r['snippet']}" for i, r in enumerate(rows, 1)]
        return "\n\n".join(shown) or "No passage in the index matches."

    def hit_rate(self, cases: list[tuple[str, list[str]]], k: int = 3) -> tuple[float, list[str]]:
        """(share of hits, missed queries): a query hits if one of its best k paths ends with one of the expected suffixes.

        Without an embedder all cases are one plan over the postings (of chunks
        that tie beyond TIES * k places those with the smallest ids count);
        with one each case is a search.
        """
        if self.embedder is not None:
            missed = [q for q, wanted in cases if not any(r["path"].endswith(tuple(wanted)) for r in self.search(q, limit=k).collect())]
            return 1 - len(missed) / max(1, len(cases)), missed
        manifest = self.store.manifest()
        tables = self.store.read(manifest)
        asked = self.spark.createDataFrame([(n, q, wanted) for n, (q, wanted) in enumerate(cases)], "query_id int, query string, wanted array<string>")
        found = keyword.batch(tables["postings"], asked.select("query_id", "query"), self.store.stats(manifest), TIES * k, strict_first=True)
        placed = found.join(tables["chunks"].select("chunk_id", "seq"), "chunk_id").join(tables["files"].select("file_id", "path"), "file_id")
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "path", "seq")
        best = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(asked, "query_id")
        hit = {r["query_id"] for r in best.where(F.exists("wanted", lambda w: F.col("path").endswith(w))).select("query_id").distinct().collect()}
        missed = [q for n, (q, _) in enumerate(cases) if n not in hit]
        return 1 - len(missed) / max(1, len(cases)), missed

    def sources(self) -> DataFrame:
        t = self.store.read()
        return store.sources_rollup(t["sources"], t["files"], t["chunks"])

    def status(self) -> DataFrame:
        return store.totals(self.sources())

    def _passages(self, tables: dict[str, DataFrame]) -> DataFrame:
        """Chunks with their file's path and their source's tag."""
        files = tables["files"].select("file_id", "source_id", "path").join(tables["sources"].select("source_id", "tag"), "source_id")
        return tables["chunks"].join(files, "file_id").select("chunk_id", "path", "seq", "page", "text", "tag")

    def _hits(self, tables: dict[str, DataFrame], scored: DataFrame, limit: int, shown: Callable[[str], str]) -> DataFrame:
        """The best of scored (chunk_id, score), ties by path and seq, as rows of HIT.

        A few best ids are taken first, and their chunks and files found by
        conditions that are pushed down to the scans. Only where more rows than
        that tie for the last place are all places joined with the scores.
        """
        best = scored.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(TIES * limit).collect()
        if len(best) == TIES * limit and best[-1]["score"] == best[limit - 1]["score"]:
            places = tables["chunks"].select("chunk_id", "file_id", "seq").join(tables["files"].select("file_id", "path"), "file_id")
            best = keyword.top(places.join(scored.select("chunk_id", "score"), "chunk_id"), limit, "path", "seq").select("chunk_id", "score").collect()
        chunks = by_ids(tables["chunks"], "chunk_id", [r["chunk_id"] for r in best]).collect() if best else []
        files = by_ids(tables["files"], "file_id", [r["file_id"] for r in chunks]).select("file_id", "path").collect() if best else []
        path, score = {r["file_id"]: r["path"] for r in files}, {r["chunk_id"]: r["score"] for r in best}
        rows = [(path[r["file_id"]], r["seq"], r["page"], r["text"], float(score[r["chunk_id"]])) for r in chunks if r["file_id"] in path]
        rows = sorted(rows, key=lambda r: (-r[4], r[0], r[1]))[:limit]
        return self.spark.createDataFrame([(*r[:3], shown(r[3]), *r[3:]) for r in rows], "path string, seq int, page int, snippet string, text string, score double")

    def _near(self, tables: dict[str, DataFrame], manifest: dict, query: list[float], k: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The k nearest vectors, by their codes; vectors from before codes were stored are all compared until a merge."""
        if {n for n, _ in manifest["segments"]["embeddings"]} != {n for n, _ in manifest["segments"]["codes"]}:
            return vectors.top_vectors(keep(tables["embeddings"]), query, k, "chunk_id", "vector")
        self.compared = vectors.top_vectors_by_codes(tables["codes"], tables["embeddings"], query, k, "chunk_id", "vector", keep)
        return self.compared.scored

    def search(self, query: str, tag: str = "", limit: int | None = 10, answer: bool = False, mode: str = "") -> DataFrame:
        """The best hits (path, seq, page, snippet, text, score); for an answer, the nearest ones if none are relevant.

        mode: answer for the same as answer=True, search or nothing; anything
        else is a ValueError. Hits of any word are searched for only where the
        decision needs them.
        Scores come from the stored postings of the query's terms and the
        version's own statistics; of words of one term only those blocks are
        read that can hold a hit. Texts are read of the few hits only.
        """
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}, not one of {MODES[1:]}")
        answer = answer or mode == "answer"
        limit = fusion.resolve_limit(limit, 6 if answer else 10, 20 if answer else 100)
        words = text.py_words(query)
        if not words:
            raise ValueError("empty query")
        manifest = self.store.manifest()
        tables, stats = self.store.read(manifest), self.store.stats(manifest)
        # Postings from before blocks were stored are read whole until a merge.
        blocked = {n for n, _ in manifest["segments"]["postings"]} == {n for n, _ in manifest["segments"]["blocks"]}
        terms = keyword.single_terms(query) if blocked else None
        tagged = tables["files"].join(tables["sources"].where(F.col("tag") == tag).select("source_id"), "source_id", "left_semi").select("file_id") if tag else None

        def hits(scored: DataFrame, shown) -> DataFrame:
            return self._hits(tables, keep(scored), limit, shown)

        def keep(rows: DataFrame) -> DataFrame:
            return rows if tagged is None else rows.join(tagged, "file_id", "left_semi")

        def by_keyword(any_word: bool) -> DataFrame:
            shown = lambda t: passages.snippet(t, query)
            if terms is None:
                return hits(keyword.bm25(tables["postings"], None, query, any_word, stats=stats), shown)
            df = None
            if manifest["dead"]:  # blocks count the chunks of replaced files too
                alive = tables["postings"].where(F.col("term").isin(sorted(terms))).groupBy("term").agg(F.count_distinct("chunk_id").alias("n"))
                df = {r["term"]: r["n"] for r in alive.collect()}
            self.pruned = keyword.best(tables["postings"], tables["blocks"], terms, any_word, stats, TIES * limit, df, keep)
            return hits(self.pruned.scored, shown)

        all_words = by_keyword(False)
        vector, failed = None, False
        pinned = tables["meta"].where("key = 'embed_model'").select("value").first()
        if self.embedder is not None and pinned and pinned[0] == self.embedder.model:
            try:
                q = self.embedder.embed([query])[0].tolist()
            except OSError:
                failed = True
            else:
                vector = self._hits(tables, self._near(tables, manifest, q, limit, keep), limit, lambda t: passages.excerpt(t, words))
        # The legs are rows at hand, so that looking at them is no job.
        empty = all_words.isEmpty() and (vector is None or answer and vector.isEmpty())
        any_word = by_keyword(True) if len(words) > 1 and empty and not failed else None
        return fusion.hybrid(all_words, any_word, vector, ["path", "seq"], limit, answer, failed)

    def chunk(self, path: str, seq: int, window: int = 1) -> DataFrame:
        """A chunk and its neighbours, for a citation. ValueError for places and windows out of range."""
        if seq < 0 or not 0 <= window <= 5:
            raise ValueError("chunk and window are out of range")
        chunks = self._passages(self.store.read())
        return store.context(chunks, path, seq, window).select("seq", "page", "text", "current")

    def ask(self, question: str, tag: str = "", limit: int | None = 6, chat: Callable[[str, str], str] | None = None) -> str:
        """An answer by chat(system, prompt), or without a model the passages themselves."""
        rows = self.search(question, tag, limit, answer=True).collect()
        entries = [(r["path"].rsplit("/", 1)[-1] + (f", page {r['page']}" if r["page"] else f", section {r['seq'] + 1}"), r["text"] or r["snippet"]) for r in rows]
        listed = "".join(f"[{i}] {label}\n{body}\n\n" for i, (label, body) in enumerate(entries, 1))
        if chat is None:
            return listed.strip()
        return chat(SYSTEM, f"{listed}Question: {question}")


SYSTEM = "Answer from the numbered passages only. Put the number of each passage that you use in brackets. If they don't hold the answer, say that. Keep it short."
