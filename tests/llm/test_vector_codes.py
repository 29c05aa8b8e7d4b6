import hashlib
import math

import numpy as np
import pytest

from lodestack.llm import vector_codes as V


def plain(rows, parts=4, entries=256, rounds=4):
    """The codes by trying every entry, in Python's integers; rows (vec_id, embedding, label)."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = -(-max(len(r[1]) for r in good) // parts)
    whole = [[math.floor(1024 * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in good]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, book: min((far(v, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in cut:
                own.setdefault(pick(v[p], books[p])[1], []).append(v[p])
            for e, members in own.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out = []
    for r, v in zip(good, cut, strict=True):
        found = [pick(v[p], books[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, books


def same(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    codes, books = V.encode(df, **how)
    expected, expected_books = plain(rows, **how)
    key = lambda r: (r[0] is None, r)
    assert sorted([tuple(r) for r in codes.select("vec_id", "code", "error").collect()], key=key) == sorted(expected, key=key)
    assert [b.tolist() for b in books] == expected_books


def test_against_trying_every_entry(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 9] + 0.2 * rng.normal(size=8)], int(i % 3)) for i in rng.permutation(300)]
    same(spark, rows, entries=20, rounds=3)
    same(spark, rows, entries=256, rounds=1)


def test_ties_repeats_nulls_and_lengths(spark):
    one, two = [0.5, -0.25, 0.0, 1.0], [1.0, 1.0, -1.0, -1.0]
    rows = [(i, one if i % 3 else two, None) for i in range(40)]
    rows += [(3, one, 1), (3, one, 1), (None, two, 1), (50, None, 1), (51, [1.0, None, 0.0, 0.0], 1), (52, [float("nan")] * 4, 1), (53, [float("inf"), 0.0, 0.0, 0.0], 1), (54, [], 2), (55, [0.125], 2), (56, [0.1, 0.2, 0.3, 0.4, 0.5], 2)]
    same(spark, rows, entries=8, rounds=2)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 1e5], 0) for i in range(30)]
    same(spark, rows, entries=6, rounds=2)


def test_search_from_any_entry():
    rng = np.random.default_rng(5)
    x, book = rng.integers(-9, 9, (500, 3)).astype(float), rng.integers(-9, 9, (40, 3))
    d = ((x[:, None] - book) ** 2).sum(2)
    for start in (None, rng.integers(0, 40, 500), np.zeros(500, np.int64)):
        entry, best = V.nearest(x, book, start)
        assert (entry == d.argmin(1)).all() and (best == d.min(1)).all()


def test_empty_table(spark):
    codes, books = V.encode(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert codes.count() == 0 and len(books) == 4
    assert V.encode(spark.createDataFrame([(1, None, 2)], "vec_id long, embedding array<float>, label int")).codes.count() == 0


def test_query_with_clashing_columns(spark, tmp_path):
    rows = [(i, [i / 7, -i / 5, 1.0, 0.0], None if i % 2 else 1, 5, b"x") for i in range(20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, error int, codes binary").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = V.op11_exponion_codes(spark, str(tmp_path)).collect()
    expected, books = plain([r[:3] for r in rows])
    assert {(r["vec_id"], r["code"], r["error"]) for r in got} == set(expected)
    for odd in (0, 1):
        assert {r["label_error"] for r in got if r["vec_id"] % 2 == odd} == {sum(e for i, _, e in expected if i % 2 == odd)}
    text = ",".join(str(v) for b in books for c in b for v in c)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


@pytest.mark.parametrize("magnitude", [1, 1e6])
def test_list_prefix_is_sufficient(magnitude):
    """No entry outside the radius is nearer, in doubles and in integers beyond them."""
    rng = np.random.default_rng(6)
    x, book = np.floor(rng.normal(size=(200, 4)) * magnitude * 1024), np.floor(rng.normal(size=(64, 4)) * magnitude * 1024).astype(np.int64)
    entry, best = V.nearest(x, book, rng.integers(0, 64, 200))
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in book] for v in x]
    assert [int(b) for b in best] == [min(r) for r in d] and entry.tolist() == [r.index(min(r)) for r in d]
