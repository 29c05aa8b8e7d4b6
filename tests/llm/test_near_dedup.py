import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.llm import near_dedup as n
from lodestack.llm import words as w

from ..conftest import SF


def brute(texts, k, percent):
    """The smallest id in every row's component, by comparing all pairs that share a shingle."""
    sets = [n.shingle_set(t or "", k) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for j, c in Counter(j for g in s for j in index.get(g, ())).items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
        for g in s:
            index.setdefault(g, []).append(i)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def test_words_by_a_plain_split():
    rng = random.Random(7)
    texts = ["".join(rng.choice("aB é\t\n\x0b漢.") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", None, "x" * 70]
    seen, before = {}, w.SEGMENT
    for segment in (before, 64):
        w.SEGMENT = segment
        w._powers.cache_clear()
        try:
            rows = [[] for _ in texts]
            for first, _, h, row in w.text_words(pa.array(texts)):
                for x, r in zip(h.tolist(), row.tolist(), strict=True):
                    rows[first + r].append(x)
        finally:
            w.SEGMENT = before
            w._powers.cache_clear()
        for t, hashes in zip(texts, rows, strict=True):
            parts = [p for p in (t or "").translate(n._LOWER).translate(n._GAPS).split(" ") if p]
            assert len(parts) == len(hashes)
            for p, h in zip(parts, hashes, strict=True):
                if len(p.encode()) <= 64:
                    assert seen.setdefault(p, h) == h
    assert len(set(seen.values())) == len(seen)


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        both, one = rng.integers(0, 1 << 63, 2000, dtype=np.uint64), int(2000 * (1 - share) / share / 2)
        a, b = (np.concatenate([both, rng.integers(0, 1 << 63, one, dtype=np.uint64)]) for _ in range(2))
        _, planes = n.packed(np.stack([n.minima(a), n.minima(b)]))
        bits, half = planes.view(np.uint64), n.HASHES // 64
        differ = np.bitwise_count((bits[0, :half] ^ bits[1, :half]) | (bits[0, half:] ^ bits[1, half:])).sum()
        assert abs((1 - differ / n.HASHES - 0.25) / 0.75 - share) < n.MARGIN / 2 + 0.03


@pytest.mark.parametrize("k", [2, 5])
def test_documents_by_brute_force(spark, k):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    sizes, roots = brute(docs.text.tolist(), k, 80)
    ids = docs.doc_id.tolist()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.groups(spark.read.parquet(f"{SF}/documents.parquet"), k, 80).collect()}
    assert got == {i: (s, ids[r]) for i, s, r in zip(ids, sizes, roots, strict=True)}


def test_a_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 40)
    monkeypatch.setattr(n, "INDEXED", 3000)
    monkeypatch.setattr(n, "LOOKED_UP", 2000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base)]
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randrange(1, 12)):
            words[rng.randrange(80)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order] + [" ".join(f"y{i}{j}" for j in range(50)) for i in range(20)]
    sizes, roots = brute(texts, 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in n.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: (s, r) for i, (s, r) in enumerate(zip(sizes, roots, strict=True))}
    assert len({r for r in roots}) > 40


def test_links_at_the_least_similarity_by_set_size(spark):
    """Pairs of exactly 80 and just over: (common shingles, more in one, more in the other)."""
    shapes = [(4, 1, 0), (4, 0, 1), (8, 1, 1), (8, 2, 0), (9, 1, 1), (12, 3, 0), (16, 2, 2), (40, 5, 5), (41, 5, 5), (80, 10, 10), (400, 50, 50)]
    texts = []
    for n_pair in range(100):
        for c, more, other in shapes:
            same = [f"s{len(texts)}_{i}" for i in range(c + 1)]
            texts.append(" ".join(same + [f"a{len(texts)}_{i}" for i in range(more)]))
            texts.append(" ".join(same + [f"b{len(texts)}_{i}" for i in range(other)]))
    got = {r["doc_id"]: r["component_id"] for r in n.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: i - i % 2 for i in range(len(texts))}


def test_small_sets_are_told_apart_alike():
    """Sets of 4 and 5 shingles of similarity 0.8: no pair's estimate falls below the margin, and none lacks a band."""
    rng = np.random.default_rng(2)
    sets = rng.integers(0, 1 << 63, (20000, 5), dtype=np.uint64) * np.uint64(2)
    keys, planes = n.packed(np.stack([n.minima(x) for x in sets]))
    keys4, planes4 = n.packed(np.stack([n.minima(x[:4]) for x in sets]))
    bits, bits4, half = planes.view(np.uint64), planes4.view(np.uint64), n.HASHES // 64
    differ = np.bitwise_count((bits[:, :half] ^ bits4[:, :half]) | (bits[:, half:] ^ bits4[:, half:])).sum(1)
    assert ((1 - differ / n.HASHES - 0.25) / 0.75 >= 0.8 - n.MARGIN).all()
    assert (keys == keys4).any(1).sum() >= 19998


def test_edges(edge, empty):
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in n.groups(edge, 2, 80).collect())
    assert got == sorted(
        [("1", 14, "1"), ("2", 0, "2"), ("3", 0, "3"), ("None", 14, "None"), ("4", 1, "4"), ("5", 14, "1"), ("5", 14, "1"), ("6", 1, "6"), ("7", 0, "7"), ("None", 0, "None")]
    )
    assert n.groups(empty).count() == 0
    kept = n.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None", "None"]


def test_rows_that_share_a_doc_id(spark):
    """A text of its own stays under a repeated doc_id; a copy under one goes."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(30)) for w in "abc")
    rows = [(3, one), (5, one + " more"), (5, two), (5, two), (7, three), (7, ""), (7, None), (8, two + " end"), (None, one)]
    kept = n.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(map(str, kept)) == sorted(str(r) for r in spark.createDataFrame([(3, one), (5, two), (7, three), (7, ""), (7, None), (None, one)], "doc_id long, text string").collect())


def test_hot_pairs_meet_their_member_in_every_salt(spark):
    pairs = spark.range(300).selectExpr("id + 1 a", "if(id < 290, 0, id) b", "pmod(id, 7) salt")
    others = spark.range(400).selectExpr("id b", "id * 2 n")
    got = n.meet(pairs, others).collect()
    assert sorted((r["a"], r["b"], r["n"]) for r in got) == sorted((i + 1, b, 2 * b) for i in range(300) for b in [0 if i < 290 else i])


def test_buckets_with_the_same_documents_are_one(spark):
    """Near copies meet in most of their bands: 30 documents in 40 of them pose the pairs of one bucket."""
    rows = [(key, i) for key in range(40) for i in range(30)] + [(50, i) for i in range(29)] + [(51, 3), (51, 3), (51, 4), (52, 3), (52, 4), (53, 7), (53, 7)]
    got = n.buckets(spark.createDataFrame(rows, "key long, doc_id long").repartition("key")).collect()
    assert sorted(map(tuple, got)) == sorted([(0, i, 0, 29, 1) for i in range(30)] + [(50, i, 0, 28, 1) for i in range(29)] + [(51, 3, 3, 4, 1), (51, 4, 3, 4, 1)])


def test_members_are_joined_before_they_are_dealt(spark):
    """All that don't ask meet all that do, once each; nothing is joined with the copies."""
    rows = [(1, int(i >= 90), i, 4, 3) for i in range(150)] + [(2, i, i, 1, 1) for i in range(2)]
    dealt = n._dealt(spark.createDataFrame(rows, "key long, asks int, doc_id long, blocks int, parts int"), "key")
    assert "Join" not in dealt._jdf.queryExecution().toString()
    at = {}
    for r in dealt.collect():
        at.setdefault((r["key"], r["block"], r["part"]), ([], []))[r["asks"]].append(r["doc_id"])
    met = [(a, b) for here, asking in at.values() for a in here for b in asking]
    assert sorted(met) == sorted([(a, b) for a in range(90) for b in range(90, 150)] + [(0, 1)])


@pytest.mark.parametrize("few", [n.FEW_LINKS, 0])
def test_clusters_and_ids_few_or_many(spark, monkeypatch, few):
    monkeypatch.setattr(n, "FEW_LINKS", few)
    monkeypatch.setattr(n, "FEW_IDS", few)
    rng = random.Random(few)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1050)]
    up = {x: x for ab in links for x in ab}
    for _ in range(len(links)):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in n.clusters(n.cut(spark.createDataFrame(links, "a long, b long").repartition(5))).collect()}
    loops = {a for a, b in links if a == b}
    assert {x: c for x, c in got.items() if x not in loops} == {x: c for x, c in up.items() if x not in loops}
    assert n.clusters(n.cut(spark.createDataFrame([], "a long, b long"))).count() == 0
    ids = n.cut(spark.range(0, 40, 2).toDF("x"))
    assert [n.among(spark.range(50).toDF("x"), ids, "x", how).count() for how in ("left_semi", "left_anti")] == [20, 30]


def test_files_of_finished_shuffles_go(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    names = lambda: {f for f in files().mkString("\n").split("\n") if "shuffle_" in f}
    before, kept = names(), []
    for _ in range(20):
        kept.append(n.cut(spark.range(20000).repartition(3).groupBy((F.col("id") % 5000).alias("k")).count()))
    for _ in range(100):
        ours = {re.search(r"shuffle_\d+", f)[0] for f in names() - before}
        if len(ours) <= 4:
            break
        time.sleep(0.1)
    assert len(ours) <= 4  # two are behind each
    assert {made.count() for made in kept} == {5000}
