import random

import numpy as np
import pyarrow as pa
import pytest

from lodestack.llm import substrings as S

WS = " \t\n\r\x0b\x0c"


def plain(rows, k=13):
    """(doc_id, n_words, n_removed, kept) by a dictionary of all windows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, ws in split:
        for p in range(len(ws) - k + 1):
            if i is not None:
                w = tuple(ws[p : p + k])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, ws in split:
        gone = set()
        for p in range(len(ws) - k + 1):
            if i is not None and first[tuple(ws[p : p + k])] < i:
                gone.update(range(p, p + k))
        out.append((i, len(ws), len(gone), b" ".join(w for p, w in enumerate(ws) if p not in gone).decode()))
    return sorted(out, key=str)


def got(df, **how):
    return sorted((tuple(r) for r in S.without_repeats(df, **how).collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["a", "b", "the", "Straße", "x" * 40, "été", "END", "　wide"]
    passage = [rng.choice(words) for _ in range(90)]
    out = []
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at, n = rng.randint(0, 60), rng.randint(10, 30)
            text += passage[at : at + n] + [rng.choice(words)]
        out.append((rng.choice([i, i, i, i % 7, -i]), "".join(w + rng.choice(WS) * rng.randint(1, 2) for w in text)))
    return out + [(None, " ".join(passage)), (70, None), (71, ""), (72, "lorem " * 500), (73, "lorem " * 300), (74, " ".join(passage)), (74, " ".join(passage))]


def test_against_a_dictionary(spark, rows):
    assert got(frame(spark, rows)) == plain(rows)
    assert got(frame(spark, rows), k=5, passes=1) == plain(rows, 5)


def test_large_buckets_go_window_by_window(spark, rows):
    assert got(frame(spark, rows), group_bytes=1) == plain(rows)
    assert got(frame(spark, rows), group_bytes=3000) == plain(rows)


def test_small_pieces(spark, rows, monkeypatch):
    for name, value in (("BLOCK", 300), ("RUN", 3), ("CHUNK", 500)):
        monkeypatch.setattr(S, name, value)
    assert got(frame(spark, rows)) == plain(rows)


def test_long_texts_are_split_with_common_words(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 30)
    words = [b"w%d" % i for i in range(50)]
    parts = list(S.split(b" ".join(words), 5))
    windows = [tuple(p.split(b" ")[i : i + 5]) for _, p in parts for i in range(len(p.split(b" ")) - 4)]
    assert windows == [tuple(words[i : i + 5]) for i in range(46)]
    assert all(p.split(b" ")[0] == words[first] for first, p in parts)


def test_equal_hashes_are_compared(monkeypatch):
    """With a hash of two values only the windows' bytes tell them apart, over few pairs at a time."""
    monkeypatch.setattr(S, "mix", lambda h: h % np.uint64(2))
    monkeypatch.setattr(S, "JUDGED", 3)
    k, strings = 3, [("a b c d e", [(4, 0, 10), (9, 0, 0)]), ("b c d x", [(5, 1, 3)]), ("a b c q", [(2, 2, 0)]), ("a b d", [(1, 3, 0), (7, 3, 5)])]
    places = [np.array(p, S.PLACE).tobytes() for _, p in strings]
    table = pa.RecordBatch.from_arrays([pa.array([0] * 4), pa.array([t.encode() for t, _ in strings], pa.binary()), pa.array(places, pa.binary())], names=["m", "p", "w"])
    found = sorted(x for columns in S._spans(table, k) for x in zip(*[c.tolist() for c in columns], strict=True))
    first, expected = {}, []
    for text, at in strings:
        ws = text.split()
        for i in range(len(ws) - k + 1):
            w = tuple(ws[i : i + k])
            first[w] = min([first.get(w, 99), *[d for d, _, _ in at]])
    for text, at in strings:
        ws = text.split()
        for doc, key, start in at:
            expected += [(doc, key, start + i) for i in range(len(ws) - k + 1) if first[tuple(ws[i : i + k])] < doc]
    assert sorted((d, y, s + i) for d, y, s, n in found for i in range(n - k + 1)) == sorted(expected)


def test_super_kmers_hold_every_window_once(spark, rows):
    """The strings' windows are the documents' windows, each in one bucket only."""
    whole = [(i, t) for i, t in rows if i is not None and t]
    k, found, buckets = 13, [], {}
    docs = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(whole)], "doc_id long, key long, text string")
    strings = [r for share in (0, 1) for r in S.super_kmers(docs, k, share, 2).collect()]
    for r in strings:
        ws = bytes(r["packed"]).split(b" ")
        for place in np.frombuffer(bytes(r["places"]), S.PLACE):
            for p in range(len(ws) - k + 1):
                w = tuple(ws[p : p + k])
                found.append((int(place["key"]), int(place["start"]) + p, w))
                buckets.setdefault(w, set()).add(r["minimiser"])
    expected = [(n, p, tuple(ws[p : p + k])) for n, (_, t) in enumerate(whole) for ws in [t.encode().split()] for p in range(len(ws) - k + 1)]
    assert sorted(found) == sorted(expected)
    assert all(len(b) == 1 for b in buckets.values())
    assert len(strings) < len(expected) / 2


def test_edge_cases(spark, edge, empty):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert got(edge) == plain(rows)
    assert S.without_repeats(empty).count() == 0
