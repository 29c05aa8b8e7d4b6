import re
from collections import Counter

from lodestack.llm import divergence as D

LOWER = {i: i + 32 for i in range(65, 91)}


def plain(rows, min_docs=3, top=200):
    """The rows of the audit by dictionaries; rows (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    split = lambda t: [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(split(t), s) for t, language, s in rows if language == lang]
        held = Counter(w for ws, _ in docs for w in set(ws))
        kept = [w for w, n in held.items() if n >= min_docs]
        counts = {s: Counter() for _, s in docs}
        for ws, s in docs:
            counts[s].update(w for w in ws if held[w] >= min_docs)
        whole = sum(counts.values(), Counter())
        p = lambda c, w: 1 + 1_000_000_000 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda a, b: (a - b) ** 2 // b
        for s, c in counts.items():
            pair = [(o, sum(f(p(c, w), p(counts[o], w)) for w in kept)) for o in counts if o != s]
            term = [(w, f(p(c, w), p(whole, w))) for w in kept if c[w] and p(c, w) > p(whole, w)]
            for part, items, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked[:most])]
    return sorted(out)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    return sorted(tuple(r) for r in D.audit(df, **how).collect())


ROWS = [
    *[("Apple pear, Äpfel’s apple-tart x9y", "en", f"s{i % 4}") for i in range(12)],
    *[("plum plum ÉTÉ été pear", "en", "s1")] * 5,
    *[("one two three", "de", "a")] * 3,
    ("four", "de", "b"), ("", "de", "c"), (None, None, None), (None, None, "z"), ("solo", "fr", "a"), ("x " * 5000, "en", None), ("12 34 _ \x7f", "de", "d"),
]


def test_against_dictionaries(spark):
    assert got(spark, ROWS) == plain(ROWS)
    assert got(spark, ROWS, min_docs=1, top=2) == plain(ROWS, 1, 2)


def test_in_small_pieces(spark, monkeypatch):
    """The same with terms handed on early, small blocks, and several rows of sources at a time."""
    for name, value in (("HELD", 3), ("SHARDS", 2), ("PER_SHARD", 40), ("CELLS", 8), ("SUMS", 8)):
        monkeypatch.setattr(D, name, value)
    assert got(spark, ROWS) == plain(ROWS)


def test_pieces_of_a_text(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 4)
    text = "Aa b-c été 12 LONGWORD x" * 3
    assert [w.decode() for p in D.pieces(text.encode()) for w in p] == [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def test_equal_vectors_are_one_row(spark, monkeypatch):
    seen = []
    whole = D.pair_sums
    monkeypatch.setattr(D, "pair_sums", lambda vectors, stats: seen.append(vectors.collect()) or whole(vectors, stats))
    rows = [("alpha beta gamma delta", "en", f"s{i % 2}") for i in range(6)] + [("alpha", "en", "s0")]
    assert got(spark, rows) == plain(rows)
    assert sorted(r["m"] for r in seen[0]) == [1, 3]


def test_counts_beyond_longs(spark, monkeypatch):
    """Products that don't fit a long: the same sums in Python's integers."""
    scale = 1 << 40
    monkeypatch.setattr(D, "SCALE", scale)
    vectors = spark.createDataFrame([("en", [("x", 5_000_000_000), ("y", 1)], 2)], "lang string, vector array<struct<source:string,n:bigint>>, m long")
    stats = spark.createDataFrame([("en", "x", 10_000_000_000, 2), ("en", "y", 2, 2)], "lang string, source string, size long, terms long")
    p = {"x": 1 + scale * 5_000_000_001 // 10_000_000_002, "y": 1 + scale * 2 // 4}
    out = {(r["source"], r["item"]): r["value"] for r in D.pair_sums(vectors, stats).collect()}
    assert out == {(a, b): 2 * ((p[a] - p[b]) ** 2 // p[b]) for a, b in (("x", "y"), ("y", "x"))}


def test_edge_cases(spark, edge, empty):
    rows = [(r["text"], r["lang"], r["source"]) for r in edge.collect()]
    assert sorted(tuple(r) for r in D.audit(edge).collect()) == plain(rows)
    assert D.audit(empty).count() == 0
