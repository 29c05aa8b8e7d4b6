import hashlib
import random

import pandas as pd
import pytest

from lodestack.llm import fingerprint as f

from ..conftest import SF


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_by_the_table():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert f.edit_distance(a, b) == levenshtein(a, b)


def by_the_byte(data):
    """The fingerprint, one byte after the other."""
    block = 4
    while block * 64 < len(data):
        block *= 2
    signatures = []
    for size in (block, 2 * block):
        letters, length, total = "", 0, 0
        for i in range(len(data)):
            window = (bytes(6) + data[: i + 1])[-7:] if i < 7 else data[i - 6 : i + 1]
            h = sum(b * (0x9E3779B1 ** (j + 1)) for j, b in enumerate(window)) % 2**32
            h ^= h >> 15
            h = h * 0x2C1B3C6D % 2**32
            h ^= h >> 13
            length, total = length + 1, total + (h ^ h << 7) % 2**32
            triggered = h % size == size - 1 and length >= size // 4
            if triggered or length == 4 * size or i == len(data) - 1:
                letters += f.LETTERS[((total ^ total >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> 58]
                length, total = 0, 0
        signatures.append(letters)
    return f"{block}:{signatures[0]}:{signatures[1]}"


def test_fingerprints_by_the_byte(monkeypatch):
    texts = [random.Random(n).randbytes(n) for n in (0, 1, 2, 6, 7, 8, 255, 256, 257, 1000, 9000)] + [b"ab" * 2000, b"a" * 3000, bytes(700)]
    texts += [t.encode() for t in pd.read_parquet(f"{SF}/documents.parquet").text if len(t) < 3000][:60]
    want = [by_the_byte(t) for t in texts]
    assert [f.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(f, "SEGMENT", 50)
    assert [f.fingerprint(t) for t in texts] == want


def test_segments_do_not_matter(monkeypatch):
    texts = [random.Random(i).randbytes(n) for i, n in enumerate((0, 1, 6, 7, 8, 100, 5000, 20000))] + [b"ab" * 3000, b"a" * 5000]
    whole = [f.fingerprint(t) for t in texts]
    monkeypatch.setattr(f, "SEGMENT", 97)
    assert [f.fingerprint(t) for t in texts] == whole
    assert whole[0] == "4::"


def expected(rows):
    """Neighbours of rows (doc_id, text) in order, one after the other."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        p, e, q = f.fingerprint(text), f.fingerprint(edited), f.fingerprint(following)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), p, e, f.likeness(p, e), f.likeness(p, q)))
    return out


@pytest.mark.parametrize("parts", [1, 3, 16, 150])
def test_documents_one_after_the_other(spark, parts):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    got = f.neighbours(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), parts).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected(list(zip(docs.doc_id.tolist(), docs.text, strict=True))))
    near = sorted(r["near_edited"] for r in got)
    assert near[len(near) // 20] > 0.5 > sorted(r["near_next"] for r in got)[-len(got) // 20]


def test_equal_texts(spark):
    assert f.likeness(f.fingerprint("same text"), f.fingerprint("same text")) == 1
    assert 0 <= f.likeness(f.fingerprint("short"), f.fingerprint("x" * 10000)) <= 1


@pytest.mark.parametrize("parts", [1, 4])
def test_edges(spark, edge, empty, parts):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in edge.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = [tuple(r) for r in f.neighbours(edge, parts).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected(rows)))
    assert f.neighbours(empty, parts).count() == 0
    one = spark.createDataFrame([(7, "alone here")], "doc_id long, text string")
    assert tuple(f.neighbours(one, parts).first()) == expected([(7, "alone here")])[0]
