import random
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lodestack.llm import decontam as d

from ..conftest import SF


def index(texts):
    items = [d.Item(i, t) for i, t in enumerate(texts)]
    df = {}
    for x in items:
        for w in set(x.words):
            df[w] = df.get(w, 0) + 1
    return d.by_length(items, len(items), sum(len(x.words) for x in items) / max(1, len(items)), df)


@pytest.fixture(scope="module")
def bench():
    return pd.read_parquet(f"{SF}/benchmark.parquet").text.tolist()


@pytest.mark.parametrize("threshold", [0.2, 0.4, 0.6])
def test_wand_finds_what_full_scoring_finds(bench, threshold):
    (ix,), rng = index(bench), random.Random(1)
    for _ in range(300):
        words = rng.choice(bench).split()[: rng.randrange(1, 40)] + rng.choice(bench).split()[: rng.randrange(20)]
        terms = sorted({int(t) for t in ix.encode(d.tokens(" ".join(words)))} - {len(ix.postings)})
        scores = {}
        for t in terms:
            for n, s in ix.postings[t]:
                scores[n] = scores.get(n, 0.0) + s
        got = dict(ix.search(terms, threshold))
        assert got.keys() == {n for n, s in scores.items() if s >= threshold - 1e-6}
        assert all(abs(got[n] - scores[n]) < 1e-9 for n in got)


def test_documents_against_plain_search(spark, bench):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    flat = lambda t: " " + " ".join(d.tokens(t)) + " "
    want = {(i, n) for i, t in zip(docs.doc_id, docs.text, strict=True) for n, b in enumerate(bench) if flat(b) in flat(t)}
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert want
    assert want <= got
    assert len({i for i, _ in got} - {i for i, _ in want}) <= 1


def test_edited_and_moved_items_are_found(bench):
    ix, filler = index(bench), "alpha beta gamma delta " * 200
    for n, b in enumerate(bench):
        words = b.split()
        words[len(words) // 3] = "changed"
        assert (0, n) in d.matches(filler + " ".join(words).upper() + " " + filler, ix)
        half = " ".join(b.split()[: len(b.split()) // 2])
        assert (0, n) not in d.matches(filler + half + " " + filler, ix)


def test_a_long_item_leaves_the_others_alone(bench):
    """A very long item has windows of its own: what is found of the others stays the same."""
    rng = random.Random(3)
    long = " ".join(f"u{rng.randrange(3000)}" for _ in range(20000))
    scattered = " ".join(" ".join([*bench[0].split()[i : i + 3], *(f"z{i}{j}" for j in range(400))]) for i in range(0, len(bench[0].split()), 3))
    for found in (index(bench), index([*bench, long])):
        assert d.matches(scattered, found) == {}
        assert {found[k].items[n].item_id for k, n in d.matches("begin " * 50 + bench[5] + " end" * 50, found)} == {5}
    found = index([*bench, long])
    assert [ix.half for ix in found] == [64, 65536]
    assert {found[k].items[n].item_id for k, n in d.matches("begin " * 50 + long + " end" * 50, found)} == {len(bench)}


def test_edges(spark, edge, empty, bench):
    items = spark.createDataFrame([(0, "quick brown fox jumps over the lazy dog"), (1, None), (2, ""), (3, "fox")], "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in d.contaminated(edge, items).collect())
    assert got == sorted([(i, n) for i in ("1", "5", "5", "None") for n in (0, 3)])
    assert d.contaminated(empty, items).count() == 0
    assert d.contaminated(edge, items.where("false")).count() == 0
    clean = d.keep_clean(edge, items)
    assert clean.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["2", "3", "4", "6", "7", "None"]


def test_shards_find_the_same(spark, bench):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole, parts = (sorted((r["doc_id"], r["item_id"], round(r["score"], 9)) for r in d.contaminated(docs, items, most_bytes=n).collect()) for n in (d.INDEX_BYTES, 3000))
    assert whole == parts
    clean, other = (sorted(r["doc_id"] for r in d.keep_clean(docs, items, n).collect()) for n in (d.INDEX_BYTES, 3000))
    assert clean == other == sorted({r["doc_id"] for r in docs.collect()} - {i for i, *_ in whole})


def test_a_full_share_is_bounded_in_memory():
    """An index over INDEX_BYTES of item texts, words of a Zipf-like vocabulary."""
    rng = np.random.default_rng(7)
    texts, size = [], 0
    while size < d.INDEX_BYTES:
        texts.append(" ".join(f"w{x}" for x in rng.zipf(1.3, 40) % 50_000))
        size += len(texts[-1])
    tracemalloc.start()
    items = [d.Item(n, t) for n, t in enumerate(texts)]
    df = Counter(w for i in items for w in set(i.words))
    index = d.Index(items, len(items), 40.0, df)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(index.items) == len(texts)
    assert held < 200 << 20
