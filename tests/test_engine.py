"""The engine end to end over folders, and the store's changes."""

import json
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodestack.engine import Engine
from lodestack.functions.embed import HashedEmbedder
from lodestack.operators import fusion, store
from lodestack.sources import folder


@pytest.fixture(scope="module")
def docs(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    for name, body in {
        "contract.md": "# Terms\nThe vendor may terminate the agreement with ninety days of notice.\n# Payment\nInvoices are due within thirty days.",
        "notes/garden.txt": "Tomatoes need sun and water. Prune the lower leaves.",
        "notes/skip.log.txt": "left out by a pattern",
        "node_modules/x.md": "machine made",
        ".hidden/y.md": "hidden",
        "broken.docx": "not a zip",
        "photo.jpg": "no",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return root


def test_life_of_an_index(spark, docs, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), HashedEmbedder(512))
    stats = engine.add(str(docs), "work", ["*.log.txt"])
    assert (stats.indexed, stats.failed, stats.chunks) == (2, 1, 3)
    assert [tuple(r) for r in engine.sources().select("tag", "files", "chunks").collect()] == [("work", 2, 3)]
    again = engine.add(str(docs), "work", ["*.log.txt"])
    assert (again.indexed, again.skipped, again.failed) == (0, 2, 1)

    hit = engine.search("vendor notice").first()
    assert hit["path"].endswith("contract.md")
    assert hit["seq"] == 0
    assert engine.search("vendor", tag="other").count() == 0
    with pytest.raises(ValueError, match="empty"):
        engine.search("  ")
    around = engine.chunk(hit["path"], 0).collect()
    assert [(r["seq"], r["current"]) for r in around] == [(0, True), (1, False)]
    assert engine.chunk(hit["path"], 9).count() == 0
    assert "contract.md, section 1" in engine.ask("vendor notice")
    assert engine.ask("vendor notice", chat=lambda s, p: p.splitlines()[-1]).startswith("Question: ")

    (docs / "notes/garden.txt").write_text("Roses instead.")
    stats = engine.add(str(docs), "work", ["*.log.txt"])
    assert stats.indexed == 1
    assert engine.search("tomatoes").count() == 0
    assert engine.search("roses").count() == 1
    os.remove(docs / "notes/garden.txt")
    engine.add(str(docs), "work", ["*.log.txt"])
    assert engine.search("roses").count() == 0

    with pytest.raises(ValueError, match="vectors of"):
        Engine(spark, str(tmp_path / "index"), HashedEmbedder(8)).add(str(docs), "work")
    assert engine.source_tag(str(docs)) == "work"
    assert engine.source_tag("/nowhere") == ""
    with pytest.raises(LookupError, match="not an indexed"):
        engine.remove("/nowhere")
    assert engine.render_sources() == f"{docs} — 1 files, 2 chunks (tag: work)"
    assert engine.render_hits("vendor notice").startswith(f"[1] {docs}/contract.md (chunk 1)\n# Terms")
    assert engine.hit_rate([("vendor notice", ["x.md", "contract.md"]), ("vendor notice", ["garden.txt"])]) == (0.5, ["vendor notice"])
    assert engine.health()["model"] == "hashed-terms/512"
    engine.remove(str(docs))
    assert engine.render_sources().startswith("Nothing")
    assert [tuple(r) for r in engine.status().collect()] == [(0, 0, 0)]
    assert Engine(spark, str(tmp_path / "index"), HashedEmbedder(8)).add(str(docs), "work").chunks >= 2


def test_command_line(spark, tmp_path):
    from lodestack import __main__ as cli

    root = tmp_path / "papers"
    root.mkdir()
    (root / "a.txt").write_text("apples and pears")
    (root / "b.log.txt").write_text("noise")
    engine = Engine(spark, str(tmp_path / "index"), None)
    run = lambda *argv: cli.run(engine, cli.parser().parse_args(argv))
    assert run("init", str(root), "--exclude", "*.log.txt").startswith("1 indexed, 0 unchanged, 0 failed")
    assert cli.initialise(str(root), None, None) == folder.Config("papers", ["*.log.txt"])
    assert run("list") == f"{root} — 1 files, 1 chunks (tag: papers)"
    assert run("search", "apples", "--tag", "papers") == f"[1] {root}/a.txt (chunk 1)\napples and pears"
    assert run("search", "noise") == "No passage in the index matches."
    assert "a.txt, section 1" in run("ask", "apples")
    assert run("status") == "1 sources, 1 files, 1 chunks"
    assert run("remove", str(root)).startswith("removed")
    with pytest.raises(LookupError):
        run("remove", str(root))


def test_single_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alone")
    (tmp_path / "b.jpg").write_text("no")
    engine = Engine(spark, str(tmp_path / "index"))
    assert engine.add(str(tmp_path / "a.txt")).indexed == 1
    assert engine.search("alone nothere").count() == 1  # a retry with any word
    assert engine.search("nothere").count() == 0
    with pytest.raises(ValueError, match="unsupported"):
        engine.add(str(tmp_path / "b.jpg"))


def test_watching(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "a.md").write_text("apples")
    engine = Engine(spark, str(tmp_path / "index"))
    query = engine.watch(str(root), str(tmp_path / "checkpoint"), "t", interval="200 milliseconds")

    def wait(word, n):
        end = time.time() + 60
        while time.time() < end:
            if engine.store.manifest()["version"] and engine.search(word).count() == n:
                return
            time.sleep(0.5)
        raise AssertionError(f"{word}: not {n}")

    try:
        wait("apples", 1)
        (root / "b.txt").write_text("pears")
        wait("pears", 1)
        (root / "a.md").write_text("plums")
        wait("plums", 1)
        wait("apples", 0)
        (root / "b.txt").unlink()
        wait("pears", 0)
    finally:
        query.stop()


def test_segments_and_compaction(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    (tmp_path / "d").mkdir()
    for n in range(3):
        (tmp_path / "d/a.txt").write_text(f"version {n} words")
        engine.add(str(tmp_path / "d"))
    manifest = engine.store.manifest()
    assert len(manifest["segments"]["chunks"]) == 3
    before = [tuple(r) for r in engine.search("words").collect()]
    assert [r[4] for r in before] == ["version 2 words"]
    engine.store.compact()
    assert len(engine.store.manifest()["segments"]["chunks"]) == 1
    assert [tuple(r) for r in engine.search("words").collect()] == before
    assert engine.store.read(manifest)["chunks"].count() == 1  # an opened version stays readable
    late = engine.store.commit({}, based_on=manifest)  # behind the compaction
    assert late["version"] == manifest["version"] + 2
    assert [tuple(r) for r in engine.search("words").collect()] == before


def _folders(tmp_path, *names):
    for n in names:
        (tmp_path / n).mkdir(parents=True)
        (tmp_path / n / "a.txt").write_text(f"words of {n}")
    return [str(tmp_path / n) for n in names]


def test_two_writers_of_different_roots(spark, tmp_path):
    """Both threads start from the same version; the later one goes behind the other."""
    roots = _folders(tmp_path, "one", "two")
    engines = [Engine(spark, str(tmp_path / "index"), HashedEmbedder(16)) for _ in roots]
    gate, whole = threading.Barrier(2), store.Store.manifest

    def add(engine, root):
        first = iter([True])

        def manifest(self):
            found = whole(self)
            if next(first, False):
                gate.wait(60)
            return found

        engine.store.manifest = manifest.__get__(engine.store)
        return engine.add(root)

    with ThreadPoolExecutor(2) as pool:
        stats = list(pool.map(add, engines, roots))
    assert [x.indexed for x in stats] == [1, 1]
    fresh = Engine(spark, str(tmp_path / "index"), HashedEmbedder(16))
    manifest = fresh.store.manifest()
    assert manifest["version"] == 2
    assert manifest["stats"] == [2, 6]
    assert sorted(r["path"] for r in fresh.sources().collect()) == sorted(roots)
    assert fresh.store.read()["meta"].count() == 1
    assert {r["path"].split("/")[-2] for r in fresh.search("words").collect()} == {"one", "two"}


def test_writers_of_the_same_files_conflict(spark, tmp_path):
    (root,) = _folders(tmp_path, "one")
    engine = Engine(spark, str(tmp_path / "index"), None)
    engine.add(root)
    base = engine.store.manifest()
    (tmp_path / "one/a.txt").write_text("other words")
    engine.add(root)
    dead = engine.store.read(base)["files"].select("file_id")
    with pytest.raises(store.Conflict, match="same files"):
        engine.store.commit({}, dead, base)
    tagged = base["segments"]["sources"][0]
    sources = spark.read.schema(store.STORED["sources"]).parquet(f"{engine.store.path}/{tagged[1]}")
    base = engine.store.manifest()
    engine.store.commit({"sources": sources.withColumn("tag", F.lit("x"))}, None, base)
    with pytest.raises(store.Conflict, match="changed"):
        engine.store.commit({"sources": sources.withColumn("tag", F.lit("y"))}, None, base)
    with pytest.raises(store.Conflict, match="merged"):
        engine.store._rewrite(base, {1})


def test_a_small_commit_opens_no_old_chunks(spark, tmp_path, monkeypatch):
    root = tmp_path / "d"
    root.mkdir()
    engine = Engine(spark, str(tmp_path / "index"), HashedEmbedder(8))
    for n in range(4):
        (root / f"f{n}.txt").write_text(f"file {n} of words")
        engine.add_files(str(root), [str(root / f"f{n}.txt")])
    opened, write = [], engine.store.commit
    monkeypatch.setattr(engine.store, "commit", lambda added, *more, **how: opened.extend(f for df in added.values() for f in df.inputFiles()) or write(added, *more, **how))
    (root / "f9.txt").write_text("file 9 of words")
    engine.add_files(str(root), [str(root / "f9.txt")])
    assert len(engine.store.manifest()["segments"]["chunks"]) == 5
    assert opened and not any("/chunks/" in f or "/embeddings/" in f for f in opened)
    assert engine.store.manifest()["backlog"] == []
    assert engine.store.read()["embeddings"].count() == 5


def test_backlog_of_vectors(spark, tmp_path):
    """Chunks of commits without an embedder get their vectors with the next one that has one, once, also after a merge."""
    roots = _folders(tmp_path, "one", "two", "three", "four", "five")
    plain, full = Engine(spark, str(tmp_path / "index"), None), Engine(spark, str(tmp_path / "index"), HashedEmbedder(8))
    plain.add(roots[0])
    assert plain.store.manifest()["backlog"] == [1]
    full.add(roots[1])
    assert full.store.manifest()["backlog"] == []
    plain.add(roots[2])
    plain.add(roots[3])
    assert plain.store.manifest()["backlog"] == [3, 4]
    n = plain.store.compact()["version"]
    assert plain.store.manifest()["backlog"] == [n]
    waiting = plain.store.backlog(plain.store.manifest())
    assert sorted(r["text"] for r in waiting.collect()) == ["words of four", "words of three"]
    full.add(roots[4])
    rows = [r["chunk_id"] for r in full.store.read()["embeddings"].collect()]
    assert len(rows) == len(set(rows)) == 5
    assert full.store.backlog(full.store.manifest()) is None


def test_an_index_of_the_first_schema_answers(spark, tmp_path):
    """Postings without dl, and a log that names neither schema nor backlog."""
    (root,) = _folders(tmp_path, "one")
    engine = Engine(spark, str(tmp_path / "index"), None)
    engine.add(root)
    before = [tuple(r) for r in engine.search("words").collect()]
    manifest = engine.store.manifest()
    at = f"{engine.store.path}/{manifest['segments']['postings'][0][1]}"
    spark.read.parquet(at).drop("dl").write.parquet(f"{at}-old")
    manifest["segments"]["postings"][0][1] += "-old"
    for key in ("schema", "backlog"):
        del manifest[key]
    del manifest["segments"]["blocks"]
    log = tmp_path / "index/log/00000001.json"
    (tmp_path / "index/log/.00000001.json.crc").unlink(missing_ok=True)
    log.write_text(json.dumps(manifest))
    old = Engine(spark, str(tmp_path / "index"), HashedEmbedder(8))
    assert [tuple(r) for r in old.search("words").collect()] == before
    assert old.store.backlog(old.store.manifest()).count() == 1
    assert old.pruned is None
    lifted = old.store.compact()
    assert lifted["schema"] == {"2": store.SCHEMA}
    assert [tuple(r) for r in old.search("words").collect()] == before
    assert old.pruned.read == 1


def test_searches_pass_over_blocks(spark, tmp_path, monkeypatch):
    """The same hits as by all postings, with replaced files and tags, while most blocks aren't read."""
    from lodestack.operators import keyword

    monkeypatch.setattr(keyword, "FIRST", 3)
    for tag in ("a", "b"):
        (tmp_path / tag).mkdir()
        for n in range(24):
            (tmp_path / tag / f"{n}.txt").write_text("common " * (1 + n % 3) + "filler " * (5 + n * 7 % 50) + ("rare" if n % 20 == 3 else ""))
    engine = Engine(spark, str(tmp_path / "index"), None)
    engine.add(str(tmp_path / "a"), "a")
    engine.add(str(tmp_path / "b"), "b")
    for n in range(0, 24, 4):
        (tmp_path / "a" / f"{n}.txt").write_text("common words in their place")
    engine.add(str(tmp_path / "a"), "a")
    asked = [("common", ""), ("common rare", ""), ("rare common filler", "b"), ("common filler", "a"), ("nothing common", "")]
    rows = lambda q, tag: [(r["path"], r["seq"], round(r["score"], 9)) for r in engine.search(q, tag, limit=2).collect()]
    by_blocks, passed = [], []
    for q, tag in asked:
        by_blocks.append(rows(q, tag))
        passed.append(engine.pruned.passed)
    monkeypatch.setattr(keyword, "single_terms", lambda q: None)
    assert by_blocks == [rows(q, tag) for q, tag in asked]
    assert sum(p > 0 for p in passed) >= 2
    rate = engine.hit_rate([(q, ["a/0.txt"]) for q, tag in asked if not tag], 2)
    expected = [q for (q, tag), found in zip(asked, by_blocks, strict=True) if not tag and not any(path.endswith("a/0.txt") for path, *_ in found)]
    assert rate == (1 - len(expected) / 3, expected)


def test_modes_and_the_second_leg(spark, tmp_path, monkeypatch):
    from lodestack.operators import keyword

    (root,) = _folders(tmp_path, "one")
    jobs, bm25 = [], keyword.best
    monkeypatch.setattr(keyword, "best", lambda *a, **k: jobs.append(a[3]) or bm25(*a, **k))
    for embedder, empty_legs in ((None, {"": 2, "search": 2, "answer": 2}), (HashedEmbedder(64), {"": 1, "search": 1, "answer": 1})):
        engine = Engine(spark, str(tmp_path / f"index{len(jobs)}"), embedder)
        engine.add(root)
        for mode in ("", "search", "answer"):
            jobs.clear()
            assert engine.search("words of", mode=mode).count() == 1
            assert jobs == [False]
            jobs.clear()
            engine.search("words zzz", mode=mode).collect()
            assert len(jobs) == empty_legs[mode]
    assert engine.search("qq zzz", mode="search").count() == 0
    assert engine.search("qq zzz", mode="answer").count() == engine.search("qq zzz", answer=True).count() == 1
    for mode in ("hybrid", "fuzzy"):
        with pytest.raises(ValueError, match="mode"):
            engine.search("words", mode=mode)


def test_merging_and_vacuum(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"))
    root = tmp_path / "d"
    root.mkdir()
    for n in range(60):
        (root / f"f{n}.txt").write_text(f"file {n} words")
    engine.add(str(root))
    for n in range(3):
        (root / "f1.txt").write_text(f"version {n} words")
        engine.add(str(root))
    before = sorted(tuple(r) for r in engine.search("version words").collect())
    old = engine.store.manifest()
    new = engine.store.merge()
    assert len(new["segments"]["chunks"]) == 2  # the large one stays
    assert old["segments"]["chunks"][0] in new["segments"]["chunks"]
    assert new["stats"] == old["stats"] == [60, 180]
    assert sorted(tuple(r) for r in engine.search("version words").collect()) == before
    assert engine.store.vacuum() == 0  # too young
    assert engine.store.vacuum(age_seconds=-10) > 0
    assert sorted(tuple(r) for r in engine.search("version words").collect()) == before
    assert engine.store.vacuum(age_seconds=-10) == 0


def test_searches_read_few_chunks(spark, tmp_path):
    """Chunks and files are found by pushed conditions; ties beyond what is taken at first are still by path."""
    from lodestack.engine import TIES, by_ids

    engine = Engine(spark, str(tmp_path / "index"))
    root = tmp_path / "d"
    root.mkdir()
    for n in range(9 * TIES):
        (root / f"f{n:03}.txt").write_text("the same words" if n else "the same words and others")
    engine.add(str(root))
    tables = engine.store.read()
    plan = by_ids(tables["chunks"], "chunk_id", [3, 5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(chunk_id, [3,5])]" in plan
    hits = [r["path"].rsplit("/", 1)[1] for r in engine.search("same words", limit=8).collect()]
    assert hits == [f"f{n:03}.txt" for n in range(1, 9)]
    assert [r["path"].rsplit("/", 1)[1] for r in engine.search("others", limit=8).collect()] == ["f000.txt"]
    with pytest.raises(ValueError, match="mode"):
        engine.search("same", mode="fuzzy")


@pytest.mark.parametrize(("limit", "want"), [(None, 10), (0, 10), (-1, 10), (101, 10), (100, 100), (3, 3)])
def test_limits(limit, want):
    assert fusion.resolve_limit(limit, 10, 100) == want


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, seq int, text string, score double")


def test_decision_table(spark):
    kw = frame(spark, ("a", 0, "kw", 9.0), ("b", 0, "kw", 8.0))
    near = frame(spark, ("b", 0, "vec", 0.9), ("c", 0, "vec", 0.8), ("d", 0, "vec", 0.1))
    far = frame(spark, ("d", 0, "vec", 0.1))
    other, none = frame(spark, ("z", 0, "or", 1.0)), frame(spark).where("false")
    run = lambda *a, **k: [(r["path"], r["text"]) for r in fusion.hybrid(*a, ["path", "seq"], 10, **k).collect()]
    assert run(kw, other, None) == [("a", "kw"), ("b", "kw")]
    assert run(none, other, None) == [("z", "or")]
    assert run(none, None, None) == []
    assert run(none, other, near, embed_failed=True) == []
    assert run(kw, other, near) == [("b", "kw"), ("a", "kw"), ("c", "vec")]
    assert run(none, other, far) == []
    assert run(none, other, far, answer=True) == [("d", "vec")]
    assert run(none, other, none, answer=True) == [("z", "or")]
    assert run(none, other, none) == []


def test_sources_keep_their_ids(spark):
    old = spark.createDataFrame([(1, "/a", "t"), (2, "/b", "u")], "source_id long, path string, tag string").withColumn("added_at", F.lit("2024-01-01").cast("timestamp"))
    new = spark.createDataFrame([(9, "/a", ""), (3, "/c", "v")], "source_id long, path string, tag string").withColumn("added_at", F.current_timestamp())
    got = {r["path"]: (r["source_id"], r["tag"]) for r in store.upsert_sources(old, new).collect()}
    assert got == {"/a": (1, ""), "/b": (2, "u"), "/c": (3, "v")}


def test_vector_searches_read_few_vectors(spark, tmp_path):
    """Hits by codes are those of all vectors, with replaced files and tags, also after a merge, and on an index from before codes."""
    for tag in ("a", "b"):
        (tmp_path / tag).mkdir()
        for n in range(20):
            (tmp_path / tag / f"{n}.txt").write_text(f"words{n} of file{n % 7} in {tag} " + "filler " * (n % 5))
    engine = Engine(spark, str(tmp_path / "index"), HashedEmbedder(64))
    engine.add(str(tmp_path / "a"), "a")
    engine.add(str(tmp_path / "b"), "b")
    (tmp_path / "a" / "3.txt").write_text("words4 of file4 in its place")
    engine.add(str(tmp_path / "a"), "a")
    asked = [("words4 file4", ""), ("file2 filler", "a"), ("words9 of file2", "b")]

    def rows():
        return [[(r["path"], r["seq"], round(r["score"], 6)) for r in engine.search(q, tag, limit=3).collect()] for q, tag in asked]

    def without_codes():
        manifest = store.Store.manifest
        try:
            store.Store.manifest = lambda self: (m := manifest(self)) | {"segments": m["segments"] | {"codes": []}}
            engine.compared = None
            found = rows()
            assert engine.compared is None
        finally:
            store.Store.manifest = manifest
        return found

    by_codes = rows()
    assert engine.compared.by_ids and engine.compared.read < 20
    assert by_codes == without_codes() and all(by_codes)
    engine.store.compact()
    assert rows() == by_codes
    codes, live = (engine.store.read()[t].select("chunk_id").distinct() for t in ("codes", "embeddings"))
    assert codes.count() == live.count() == codes.join(live, "chunk_id").count()


def test_writes_in_a_row_are_one_pass(spark, tmp_path, monkeypatch):
    """Ten writes within the quiet time make one pass over the file; the gauge rises, and falls when it is done."""
    from lodestack.streaming import watch

    (root,) = _folders(tmp_path, "busy")
    engine, passes = Engine(spark, str(tmp_path / "index"), None), []
    engine.add(root)
    monkeypatch.setattr(engine, "add_files", lambda r, files, *a: passes.append(sorted(files)))
    monkeypatch.setattr(engine, "add", lambda *a: passes.append("all"))
    query = engine.watch(root, str(tmp_path / "checkpoint"), interval="300 milliseconds", quiet_ms=6000)

    def until(done, seconds=60):
        end = time.time() + seconds
        while time.time() < end and not done():
            time.sleep(0.1)
        assert done()

    try:
        until(lambda: passes and watch.pending(query) == 0)
        passes.clear()
        for n in range(10):
            with open(f"{root}/new.txt", "a") as f:
                f.write(f"line {n}\n")
            time.sleep(0.5)
        until(lambda: watch.pending(query) == 1)
        assert passes == []
        until(lambda: passes and watch.pending(query) == 0)
        assert passes == [[f"{root}/new.txt"]]
        os.remove(f"{root}/new.txt")
        until(lambda: len(passes) == 2)
        assert passes[1] == "all"
    finally:
        query.stop()
