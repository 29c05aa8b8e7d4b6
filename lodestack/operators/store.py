"""The index store: tables, changes as joins, and immutable generations on disk."""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors
from . import keyword

#: The tables and their columns.
TABLES = {
    "sources": "source_id long, path string, tag string, added_at timestamp",
    "files": "file_id long, source_id long, path string, sha256 string, size long, mtime long",
    "chunks": "chunk_id long, file_id long, seq int, page int, text string",
    "embeddings": "chunk_id long, vector array<float>",
    "embedding_cache": "sha string, model string, vector array<float>",
    "meta": "key string, value string",
}
#: Distinct texts whose cached vectors are looked up by prefixes of their hash; hexadecimal digits of a prefix.
LOOKUPS, PREFIX = 64, 6
#: Raised whenever extraction changes, so that files are read again.
EXTRACT_VERSION = "2"


def stable_id(*columns) -> F.Column:
    """Ids follow from paths, so a table can be rebuilt in parallel with the same ids."""
    return F.xxhash64(*columns)


def file_sha(content) -> F.Column:
    """What says that a file is unchanged: its hash and the extraction's version."""
    return F.concat(F.sha2(content, 256), F.lit(":" + EXTRACT_VERSION))


def sources_rollup(sources: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, tag, files, chunks) of every source by path; sources without files count 0."""
    n_files = files.groupBy("source_id").agg(F.count("*").alias("files"))
    n_chunks = chunks.groupBy("file_id").agg(F.count("*").alias("n")).join(files.select("file_id", "source_id"), "file_id").groupBy("source_id").agg(F.sum("n").alias("chunks"))
    out = sources.join(n_files, "source_id", "left").join(n_chunks, "source_id", "left")
    return out.select("path", "tag", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("path")


def totals(rollup: DataFrame) -> DataFrame:
    return rollup.agg(F.count("*").alias("sources"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def upsert_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources by path; a new row's tag replaces the old one, its id and date don't."""
    o = old.select("path", *[F.col(c).alias(f"_{c}") for c in ("source_id", "tag", "added_at")])
    joined = new.join(o, "path", "full_outer")
    return joined.select(F.coalesce("_source_id", "source_id").alias("source_id"), "path", F.coalesce("tag", "_tag").alias("tag"), F.coalesce("_added_at", "added_at").alias("added_at"))


def changed(scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Scanned files (path, sha256, ...) whose hash isn't the stored one, new ones included."""
    known = files.select("path", F.col("sha256").alias("_sha"))
    return scanned.join(known, "path", "left").where(~F.col("sha256").eqNullSafe(F.col("_sha"))).drop("_sha")


def replace_files(tables: dict[str, DataFrame], files: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """The tables after files (all columns) and their chunks took the place of what was stored for the same paths."""
    stale = tables["files"].join(files.select("path"), "path", "left_semi")
    out = _without_files(tables, stale)
    out["files"] = out["files"].unionByName(files)
    out["chunks"] = out["chunks"].unionByName(chunks)
    return out


def _without_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    ids = gone.select("file_id")
    chunks = tables["chunks"].join(ids, "file_id", "left_semi").select("chunk_id")
    return tables | {
        "embeddings": tables["embeddings"].join(chunks, "chunk_id", "left_anti"),
        "chunks": tables["chunks"].join(ids, "file_id", "left_anti").select(*tables["chunks"].columns),
        "files": tables["files"].join(ids, "file_id", "left_anti").select(*tables["files"].columns),
    }


def prune(tables: dict[str, DataFrame], source_id: int, seen: DataFrame) -> dict[str, DataFrame]:
    """The tables without those files of a source whose path isn't among seen (path)."""
    gone = tables["files"].where(F.col("source_id") == source_id).join(seen.select("path"), "path", "left_anti")
    return _without_files(tables, gone)


def remove_sources(tables: dict[str, DataFrame], paths: list[str]) -> dict[str, DataFrame]:
    """The tables without sources, their files, chunks and vectors; cached vectors stay.

    Where no vectors are left, the pinned model goes too, so that another can be chosen.
    """
    gone = tables["sources"].where(F.col("path").isin(paths))
    out = _without_files(tables, tables["files"].join(gone.select("source_id"), "source_id", "left_semi"))
    out["sources"] = tables["sources"].where(~F.col("path").isin(paths))
    left = out["embeddings"].limit(1).agg(F.count("*").alias("_left"))
    out["meta"] = tables["meta"].crossJoin(F.broadcast(left)).where("key <> 'embed_model' or _left > 0").drop("_left")
    return out


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    return chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """(sha, first, copies, text): every distinct text of chunks once, to be embedded once."""
    keyed = chunks.select(F.sha2("text", 256).alias("sha"), "chunk_id", "text")
    return keyed.groupBy("sha").agg(F.min("chunk_id").alias("first"), F.count("*").alias("copies"), F.min("text").alias("text"))


def cached(cache: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of the cache that keyed (sha) may need: where few texts are asked for, conditions on their prefixes reach the scan, whose files are sorted by sha."""
    few = [r["sha"] for r in keyed.select("sha").distinct().limit(LOOKUPS + 1).collect()]
    if len(few) > LOOKUPS:
        return cache
    wanted = F.lit(False)
    for prefix in sorted({x[:PREFIX] for x in few}):
        wanted = wanted | F.col("sha").startswith(prefix)
    return cache.where(wanted)


def embed_missing(missing: DataFrame, cache: DataFrame, meta: DataFrame, embedder, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(embeddings, new cache rows, meta) for chunks (file_id, chunk_id, text) without a vector.

    embedder: a function from (sha, text) rows to (sha, vector) rows. Cached
    texts aren't embedded again, and equal texts once. ValueError if the index
    was made with another model.
    """
    pinned = meta.where("key = 'embed_model'").select("value").first()
    if pinned and pinned[0] != model:
        raise ValueError(f"the index holds vectors of {pinned[0]}, not {model}")
    keyed = missing.withColumn("sha", F.sha2("text", 256))
    known = cached(cache.where(F.col("model") == model), keyed).select("sha", "vector")
    wanted = keyed.groupBy("sha").agg(F.min("text").alias("text")).join(known.select("sha"), "sha", "left_anti")
    made = embedder(wanted).select("sha", F.lit(model).alias("model"), "vector").persist()
    vectors = keyed.join(known.unionByName(made.select("sha", "vector")), "sha").select("file_id", "chunk_id", "vector")
    if not pinned:
        meta = meta.unionByName(meta.sparkSession.createDataFrame([("embed_model", model)], TABLES["meta"]))
    return vectors, made, meta


def context(chunks: DataFrame, path: str, seq: int, window: int = 1) -> DataFrame:
    """The chunks of a file around one, by seq, with the flag current; nothing if that one isn't there."""
    near = chunks.where((F.col("path") == path) & F.col("seq").between(seq - window, seq + window)).withColumn("current", F.col("seq") == seq)
    there = F.max("current").over(Window.partitionBy("path"))
    return near.withColumn("_there", there).where("_there").drop("_there").orderBy("seq")


def contexts(chunks: DataFrame, cited: DataFrame, window: int = 1) -> DataFrame:
    """context() for many (path, cited_seq) at once: each cited place meets 2 * window + 1 places by equality."""
    places = cited.select("path", "cited_seq", F.explode(F.sequence(F.col("cited_seq") - window, F.col("cited_seq") + window)).alias("seq"))
    found = places.join(chunks, ["path", "seq"]).withColumn("current", F.col("seq") == F.col("cited_seq"))
    there = F.max("current").over(Window.partitionBy("path", "cited_seq"))
    return found.withColumn("_there", there).where("_there").drop("_there")


def owners(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Every path with the longest root (root) that is it or lies above it; null without one.

    A path meets its own ancestors by equality, so no path meets all roots.
    """
    segments = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, 1, n), "/"))
    prefixes = paths.select("path").distinct().select("path", F.explode(above).alias("root")).where("root <> ''")
    best = prefixes.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


#: The stored tables: those of files carry file_id, so that a file's rows can be marked dead everywhere at once.
STORED = {
    "sources": TABLES["sources"],
    "meta": TABLES["meta"],
    "files": TABLES["files"],
    "chunks": TABLES["chunks"],
    "lengths": "file_id long, chunk_id long, dl long",
    "postings": "file_id long, chunk_id long, pos int, term string, dl long",
    "blocks": "term string, block long, n long, most long, least long",
    "embeddings": "file_id long, chunk_id long, vector array<float>",
    "codes": f"file_id long, chunk_id long, {vectors.CODES}",
    "embedding_cache": TABLES["embedding_cache"],
}
#: Small tables that a commit writes anew; the cache and the postings' blocks only grow; the others grow by segments and shrink by dead files.
SMALL, BY_FILE = ("sources", "meta"), ("files", "chunks", "lengths", "postings", "embeddings", "codes")
#: Segments of a table after which small ones are merged.
SEGMENTS = 32
#: The layout of segments: 1 had postings without dl and no backlog, 2 has both.
SCHEMA = 2
#: Seconds for which a commit tries again behind other writers' versions, and between two tries.
PATIENCE, PAUSE = 5.0, 0.2
#: Keys of the small tables, by which two writers' changes are merged.
KEYS = {"sources": "path", "meta": "key"}
#: How a table's segments are laid out, so that a search reads few row groups.
ORDER = {"postings": ("term", "chunk_id", "pos"), "blocks": ("term", "block"), "chunks": ("chunk_id",), "files": ("file_id",), "embeddings": ("chunk_id",), "codes": ("chunk_id",), "embedding_cache": ("sha",)}


class Conflict(RuntimeError):
    """Another writer changed what this commit changes."""


class Store:
    """The index on disk: immutable segments, marks of dead files, and a numbered log that names them.

    A commit writes what is new as a segment, the ids of files whose earlier
    rows are dead, and then the next file of the log, which must not exist yet:
    readers keep the version they opened, and a failed commit leaves no trace in
    the log. Of two writers the later one puts its segments behind the other's
    version if they changed different files and sources, and else gets a
    Conflict. The cost of a commit follows the change, not the index.

    The backlog of a version numbers the commits whose chunks were written
    without vectors; a commit with vectors clears it. Segments carry a schema
    number; older ones are lifted when they are read, until a merge rewrites
    them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest version: number, (number, folder) of every table's segments and of the dead files."""
        log = self._path(f"{self.path}/log")
        names = [f.getPath().getName() for f in self._fs.listStatus(log)] if self._fs.exists(log) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {"version": 0, "segments": {t: [] for t in STORED}, "dead": [], "backlog": [], "schema": {}}
        until = time.monotonic() + PATIENCE
        while True:  # a version that is being written just now is not whole yet
            row = self.spark.read.text(f"{self.path}/log/{max(names)}").first()
            if row is not None or time.monotonic() > until:
                found = json.loads(row[0])
                for t in STORED:
                    found["segments"].setdefault(t, [])
                return found
            time.sleep(PAUSE)

    def read(self, manifest: dict | None = None) -> dict[str, DataFrame]:
        """The live rows of all tables."""
        manifest = manifest or self.manifest()
        return {t: self._table(t, manifest) for t in STORED}

    def _table(self, table: str, manifest: dict) -> DataFrame:
        segments = manifest["segments"][table]
        if not segments:
            return self.spark.createDataFrame([], STORED[table])
        schemas = manifest.get("schema", {})
        old = [s for s in segments if table == "postings" and schemas.get(str(s[0]), 1) < 2]
        if not old:
            return self._live(table, manifest, segments)
        lengths = self._live("lengths", manifest, [s for s in manifest["segments"]["lengths"] if s[0] in {n for n, _ in old}])
        lifted = self._live(table, manifest, old).drop("dl").join(lengths.select("chunk_id", "dl"), "chunk_id").select("file_id", "chunk_id", "pos", "term", "dl")
        others = [s for s in segments if s not in old]
        return lifted.unionByName(self._live(table, manifest, others)) if others else lifted

    def _live(self, table: str, manifest: dict, segments: list) -> DataFrame:
        """The rows of some segments of a table without those of files that later commits marked dead."""
        newest_dead = max((n for n, _ in manifest["dead"]), default=0)
        read = lambda at: self.spark.read.schema(STORED[table]).parquet(f"{self.path}/{at}")
        if table not in BY_FILE or newest_dead <= min(n for n, _ in segments):
            return self.spark.read.schema(STORED[table]).parquet(*[f"{self.path}/{at}" for _, at in segments])
        rows = None
        for n, at in segments:
            part = read(at).withColumn("_segment", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        dead = None
        for n, at in manifest["dead"]:
            part = self.spark.read.schema("file_id long").parquet(f"{self.path}/{at}").select(F.col("file_id").alias("_dead"), F.lit(n).alias("_until"))
            dead = part if dead is None else dead.unionByName(part)
        dead = dead.groupBy("_dead").agg(F.max("_until").alias("_until"))
        return rows.join(dead, (F.col("file_id") == F.col("_dead")) & (F.col("_segment") < F.col("_until")), "left_anti").drop("_segment")

    def backlog(self, manifest: dict, dead: DataFrame | None = None) -> DataFrame | None:
        """Live chunks (file_id, chunk_id, text) without a vector; None where no commit left any, and then nothing is read.

        Only the chunks of commits in the backlog are read, and the ids of
        vectors. dead: files (file_id) that are leaving.
        """
        numbers = manifest.get("backlog", [n for n, _ in manifest["segments"]["chunks"]])
        segments = [s for s in manifest["segments"]["chunks"] if s[0] in numbers]
        if not segments:
            return None
        chunks = self._live("chunks", manifest, segments).select("file_id", "chunk_id", "text")
        if dead is not None:
            chunks = chunks.join(dead, "file_id", "left_anti")
        return missing_embeddings(chunks, self._table("embeddings", manifest)).select("file_id", "chunk_id", "text")

    def stats(self, manifest: dict) -> tuple[int, int]:
        """The numbers of live chunks and of their tokens."""
        return tuple(manifest["stats"]) if "stats" in manifest else self._counts(self._table("lengths", manifest))

    @staticmethod
    def _counts(lengths: DataFrame) -> tuple[int, int]:
        return tuple(lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def commit(self, added: dict[str, DataFrame], dead: DataFrame | None = None, based_on: dict | None = None, replacing: set[int] = frozenset()) -> dict:
        """The next version: small tables replaced by those in added, others grown by them, files in dead (file_id) gone from earlier segments.

        replacing: numbers of commits whose live rows added holds, and whose segments are let go.
        """
        base = based_on or self.manifest()
        folder = f"data/{base['version'] + 1:08d}-{uuid.uuid4().hex[:12]}"
        for t, df in added.items():
            rows = df.select(*[c.split()[0] for c in STORED[t].split(", ")])
            if t in ORDER:
                rows = rows.repartitionByRange(ORDER[t][0]).sortWithinPartitions(*ORDER[t])
            rows.write.parquet(f"{self.path}/{folder}/{t}")
        written, gone, made = {t: f"{folder}/{t}" for t in added}, (0, 0), None
        if dead is not None:
            dead.select("file_id").distinct().write.parquet(f"{self.path}/{folder}/dead")
            if base["segments"]["lengths"]:
                gone = self._counts(self._table("lengths", base).join(self.spark.read.schema("file_id long").parquet(f"{self.path}/{folder}/dead"), "file_id", "left_semi"))
        if "lengths" in added:
            made = self._counts(self.spark.read.schema(STORED["lengths"]).parquet(f"{self.path}/{folder}/lengths"))
        onto, until = base, time.monotonic() + PATIENCE
        while True:
            manifest = self._next(onto, base, written, f"{folder}/dead" if dead is not None else None, gone, made, replacing)
            if self._claim(manifest):
                return manifest
            newest = self.manifest()
            if replacing:
                raise Conflict("the index changed while segments were merged")
            if newest["version"] <= onto["version"]:  # its file isn't listed yet
                if time.monotonic() > until:
                    raise Conflict("the next version is taken")
                time.sleep(PAUSE)
                continue
            written |= self._rebased(base, newest, written, folder if dead is not None else None)
            onto = newest

    def _next(self, onto: dict, base: dict, written: dict[str, str], dead: str | None, gone: tuple[int, int], made: tuple[int, int] | None, replacing: set[int]) -> dict:
        """The version behind `onto` with what a commit based on `base` has written."""
        n = onto["version"] + 1
        segments = {t: [s for s in onto["segments"][t] if t in SMALL or s[0] not in replacing] for t in STORED}
        for t, at in written.items():
            segments[t] = [*([] if t in SMALL else segments[t]), [n, at]]
        chunks, tokens = self.stats(onto) if onto["version"] else (0, 0)
        chunks, tokens = chunks - gone[0], tokens - gone[1]
        rows = {k: v for k, v in onto.get("rows", {}).items() if int(k) not in replacing}
        if made is not None:
            rows[str(n)] = made[0]
            if not replacing:
                chunks, tokens = chunks + made[0], tokens + made[1]
        marks = [*onto["dead"], *([[n, dead]] if dead else [])]
        before = lambda m: set(m.get("backlog", [k for k, _ in m["segments"]["chunks"]]))
        backlog = before(onto)
        if replacing:
            backlog = backlog - replacing | ({n} if backlog & replacing else set())
        elif "embeddings" in written:
            backlog -= before(base)
        elif "chunks" in written:
            backlog.add(n)
        # A mark is of use as long as there are segments from before it.
        first = min((s[0] for t in BY_FILE for s in segments[t]), default=n)
        alive = {str(s[0]) for t in STORED for s in segments[t]}
        schema = {k: v for k, v in onto.get("schema", {}).items() if k in alive} | {str(n): SCHEMA}
        return {"version": n, "segments": segments, "dead": [m for m in marks if m[0] > first], "stats": [chunks, tokens], "rows": rows, "backlog": sorted(backlog), "schema": schema}

    def _claim(self, manifest: dict) -> bool:
        """Write the next file of the log; False if another writer has."""
        at = self._path(f"{self.path}/log/{manifest['version']:08d}.json")
        try:
            out = self._fs.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        return True

    def _rebased(self, base: dict, newest: dict, written: dict[str, str], dead: str | None) -> dict[str, str]:
        """New folders of the small tables, merged with what others have made of them since base. Conflict if both changed the same files, sources, or the backlog."""
        if "embeddings" in written and base.get("backlog") and newest.get("backlog", []) != base["backlog"]:
            raise Conflict("the backlog of vectors changed")

        def touched(files: list, marks: list) -> DataFrame:
            out = self.spark.createDataFrame([], "file_id long")
            for at in (*files, *marks):
                out = out.unionByName(self.spark.read.schema("file_id long").parquet(f"{self.path}/{at}"))
            return out

        since = lambda entries: [at for n, at in entries if n > base["version"]]
        if any(s not in newest["segments"]["files"] for s in base["segments"]["files"]):
            # Segments were merged: only rows that base doesn't have are changes.
            theirs = self._table("files", newest).join(self._table("files", base).select("file_id", "sha256"), ["file_id", "sha256"], "left_anti").select("file_id").unionByName(touched([], since(newest["dead"])))
        else:
            theirs = touched(since(newest["segments"]["files"]), since(newest["dead"]))
        ours = touched([written["files"]] if "files" in written else [], [f"{dead}/dead"] if dead else [])
        if not ours.join(theirs, "file_id", "left_semi").isEmpty():
            raise Conflict("another writer changed the same files")
        out = {}
        for t in SMALL:
            if t in written and newest["segments"][t] != base["segments"][t]:
                rows = self._merged(t, self._table(t, base), self.spark.read.schema(STORED[t]).parquet(f"{self.path}/{written[t]}"), self._table(t, newest))
                out[t] = f"data/{newest['version'] + 1:08d}-{uuid.uuid4().hex[:12]}/{t}"
                rows.write.parquet(f"{self.path}/{out[t]}")
        return out

    @staticmethod
    def _merged(table: str, base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
        """The rows of a small table after both changes to base; Conflict where one key was changed in two ways."""
        key = KEYS[table]
        named = lambda df, c: df.select(key, F.struct(*df.columns).alias(c))
        rows = named(base, "_b").join(named(ours, "_o"), key, "full_outer").join(named(theirs, "_t"), key, "full_outer").persist()
        same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
        clash = rows.where(~same("_o", "_b") & ~same("_t", "_b") & ~same("_o", "_t"))
        if not clash.isEmpty():
            raise Conflict(f"another writer changed {clash.first()[key]}")
        return rows.select(F.when(same("_o", "_b"), F.col("_t")).otherwise(F.col("_o")).alias("_r")).where("_r is not null").select("_r.*")

    def _rewrite(self, manifest: dict, numbers: set[int]) -> dict:
        """The live rows of some commits' segments as one segment a table."""
        part = manifest | {"segments": {t: [s for s in manifest["segments"][t] if s[0] in numbers] for t in STORED}}
        rows = {t: self._table(t, part) for t in STORED if t not in SMALL and part["segments"][t]}
        if "postings" in rows:
            rows["blocks"] = keyword.blocks(rows["postings"])
        if "embeddings" in rows:
            rows["codes"] = vectors.codes(rows["embeddings"], "chunk_id", "vector", "file_id")
        return self.commit(rows, based_on=manifest, replacing=numbers)

    def compact(self) -> dict:
        """One segment a table, without dead rows. vacuum() deletes what no version needs any more."""
        manifest = self.manifest()
        return self._rewrite(manifest, {s[0] for t in STORED if t not in SMALL for s in manifest["segments"][t]})

    def merge(self) -> dict:
        """Small segments as one; a segment of at least twice the rows of all smaller ones stays, so a row is rewritten a logarithmic number of times."""
        manifest = self.manifest()
        rows = manifest.get("rows", {})
        numbers = sorted({s[0] for t in STORED if t not in SMALL for s in manifest["segments"][t]}, key=lambda n: -rows.get(str(n), 0))
        sizes = [rows.get(str(n), 0) for n in numbers]
        first = next((i for i in range(len(numbers)) if sizes[i] < 2 * sum(sizes[i + 1 :]) or sizes[i] == 0), len(numbers))
        return self._rewrite(manifest, set(numbers[first:])) if len(numbers) - first > 1 else manifest

    def vacuum(self, keep: int = 1, age_seconds: float = 3600) -> int:
        """Delete folders that none of the last `keep` versions needs, and older log files; what is younger than age_seconds stays. How many went."""
        log, data = self._path(f"{self.path}/log"), self._path(f"{self.path}/data")
        if not self._fs.exists(log):
            return 0
        logs = sorted((f for f in self._fs.listStatus(log) if f.getPath().getName().endswith(".json")), key=lambda f: f.getPath().getName())
        needed = set()
        for f in logs[-keep:]:
            manifest = json.loads(self.spark.read.text(f.getPath().toString()).first()[0])
            needed.update(at.split("/")[1] for segments in (*manifest["segments"].values(), manifest["dead"]) for _, at in segments)
        folders = self._fs.listStatus(data) if self._fs.exists(data) else []
        old = [f for f in [*logs[:-keep], *(f for f in folders if f.getPath().getName() not in needed)] if f.getModificationTime() <= (time.time() - age_seconds) * 1000]
        for f in old:
            self._fs.delete(f.getPath(), True)
        return len(old)
