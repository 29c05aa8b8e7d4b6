"""Pure functions: chunks, passages, globs, tokens."""

import math
import re
import sqlite3
import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.functions import chunking, embed, models, passages, text, vectors
from lodestack.functions.paths import glob_to_regex

from .conftest import SF

CHARS = st.text(alphabet=st.sampled_from("ab \n\t.éß漢"), max_size=6000)


@pytest.mark.parametrize(
    ("sections", "want"),
    [
        ([], 0),
        ([("", 0)], 0),
        ([("  \n \n", 0)], 0),
        ([("one short paragraph", 0)], 1),
        ([("first\n\nsecond", 0)], 1),
        ([("first\r\n\r\nsecond", 0)], 1),
        ([("a", 1), ("b", 2)], 2),
        ([("\n\n".join(["x" * 96] * 30), 0)], 2),
        ([(" ".join(["abcde"] * 1000), 0)], 4),
    ],
)
def test_chunk_counts(sections, want):
    assert abs(len(chunking.split_sections(sections)) - want) <= (1 if want > 2 else 0)


def plain_pieces(line):
    """cut_long() with strings only: the rest is measured and cut anew for every piece."""
    out, rest, lead = [], line, ""
    while len(rest.encode()) > 2000:
        fits = rest
        while len(fits.encode()) > 2000:
            fits = fits[: len(fits) - max(1, (len(fits.encode()) - 2000) // 4)]
        at = fits.rfind(" ")
        at = at if at > 0 and not (at <= len(lead) and len(lead.encode()) > 250) else len(fits)
        out.append(rest[:at])
        lead, rest = chunking.tail(rest[:at]), rest[at:].strip(text.PY_SPACE)
        rest = f"{lead} {rest}" if lead else rest
    return out + ([rest] if rest.strip(text.PY_SPACE) else [])


def plain_chunks(body):
    """split_section() in one pass over paragraphs and lines."""
    pieces = []
    for paragraph in body.replace("\r\n", "\n").split("\n\n"):
        paragraph = paragraph.strip(text.PY_SPACE)
        if len(paragraph.encode()) <= 2000:
            pieces.append(paragraph)
            continue
        block = ""
        for line in paragraph.split("\n"):
            if len((block + line).encode()) + 1 > 2000:
                pieces.append(block.strip(text.PY_SPACE))
                block = ""
            if len(line.encode()) > 2000:
                pieces += plain_pieces(line)
            else:
                block += line + "\n"
        pieces.append(block.strip(text.PY_SPACE))
    out, now = [], ""
    for piece in filter(None, pieces):
        if now and len((now + piece).encode()) + 2 > 2000:
            out.append(now.strip(text.PY_SPACE))
            lead = chunking.tail(now)
            now = f"{lead}\n\n" if lead and len((lead + piece).encode()) + 2 <= 2000 else ""
        now += piece + "\n\n"
    return [c for c in [*out, now.strip(text.PY_SPACE)] if c]


@settings(max_examples=150, deadline=None)
@given(st.one_of(CHARS, st.lists(st.text(alphabet=st.sampled_from("ab .é漢\n"), max_size=900), max_size=12).map("\n\n      ".join)))
def test_chunks_by_a_plain_version(body):
    assert chunking.split_section(body) == plain_chunks(body)


def test_documents_chunked_by_a_plain_version():
    for body in pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text:
        assert chunking.split_section(body) == plain_chunks(body)


def test_blank_lines_at_the_edge_of_a_piece_go():
    lines = ["x" * 90] * 25
    got = chunking.split_section("\n".join([*lines[:21], " ", "      indented", *lines]))
    assert got == plain_chunks("\n".join([*lines[:21], " ", "      indented", *lines]))
    assert all("\n\n " not in c for c in got)


def test_a_very_long_line_is_cut_in_linear_time():
    begun = time.perf_counter()
    assert len(chunking.split_section("word " * 1_000_000)) > 2000
    assert len(chunking.split_section("漢" * 1_000_000)) > 1000
    assert time.perf_counter() - begun < 30


@settings(max_examples=150, deadline=None)
@given(CHARS)
def test_chunks_keep_the_rules(body):
    chunks = chunking.split_sections([(body, 3)])
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    for _, page, t in chunks:
        assert page == 3
        assert t.strip(text.PY_SPACE)
        assert len(t.encode()) <= chunking.BUDGET
    if len(body.encode()) <= chunking.BUDGET:
        assert len(chunks) == (1 if body.strip(text.PY_SPACE) else 0)
    squeeze = lambda s: re.sub(r"\s", "", s)
    at, whole = 0, squeeze(body)
    for _, _, t in chunks:  # with overlaps, the chunks in order cover the text
        s = squeeze(t)
        begin = next((b for b in range(at, max(-1, at - 300), -1) if whole.startswith(s, b)), None)
        assert begin is not None
        at = max(at, begin + len(s))
    assert at == len(whole)


def test_overlap_tail():
    assert chunking.tail("short") == ""
    long = " ".join(f"w{i}" for i in range(200))
    t = chunking.tail(long)
    assert long.endswith(t)
    assert 200 < len(t) <= chunking.OVERLAP


def test_excerpt():
    body = "filler words " * 60 + "needle here " + "more words " * 60
    e = passages.excerpt(body, ["needle"])
    assert e.startswith("…")
    assert e.endswith("…")
    assert "needle" in e
    assert len(e.strip("…").encode()) <= passages.EXCERPT
    assert passages.excerpt(body, ["absent"]) == passages.head(body.encode())
    assert passages.excerpt("İ" * 200 + " needle", ["needle"]).endswith("needle")
    assert passages.excerpt("short", ["x"]) == "short"


@pytest.fixture(scope="module")
def fts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(text)")
    c.executemany("insert into t(rowid, text) values (?, ?)", zip(docs.doc_id.tolist(), docs.text, strict=True))
    return c, dict(zip(docs.doc_id, docs.text, strict=True))


@pytest.mark.parametrize("query", ["ouen thand", "the", "of-the erin", "de la", "und der", "MIT License"])
def test_snippets_are_those_of_fts5(fts, query):
    c, docs = fts
    quoted = " OR ".join(f'"{w}"' for w in query.split())
    found = c.execute("select rowid, snippet(t, 0, '', '', ' … ', 16) from t where t match ?", (quoted,)).fetchall()
    assert found
    assert all(passages.snippet(docs[i], query) == s for i, s in found)


@pytest.mark.parametrize("query", ["ouen thand", "the erin", "of-the erin", "the the of", "& the", "été la"])
@pytest.mark.parametrize("any_word", [False, True])
def test_scores_are_those_of_fts5(spark, fts, query, any_word):
    from lodestack.operators import keyword

    c, _ = fts
    quoted = (" OR " if any_word else " ").join(f'"{w}"' for w in query.split())
    want = dict(c.execute("select rowid, -bm25(t) from t where t match ?", (quoted,)).fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    indexed = keyword.bm25(keyword.postings(docs, "doc_id"), keyword.lengths(docs, "doc_id"), query, any_word, "doc_id")
    for scored in (indexed, keyword.bm25_scan(docs, query, any_word, "doc_id")):
        got = {r["doc_id"]: r["score"] for r in scored.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blank_queries():
    from lodestack.operators import keyword

    with pytest.raises(ValueError, match="empty"):
        keyword.phrases(" \n ")
    assert keyword.phrases("MSA-2024-117 a a") == {("msa", "2024", "117"): 1, ("a",): 2}
    assert keyword.phrases('"unbalanced NEAR( col:x foo*') == {("unbalanced",): 1, ("near",): 1, ("col", "x"): 1, ("foo",): 1}


def test_folding(spark):
    words = ["Café", "naïve", "ÿ", "İ", "ẞ", "ΟΔΟΣ", "é", "foo_bar", "x²", "ế", "ø"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.terms("w")).collect()]
    assert got == [text.py_terms(w) for w in words]
    assert text.py_terms("Café foo_bar") == ["cafe", "foo", "bar"]


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("dir/**", "dir/a/b.txt", True),
        ("dir/**", "dirt/a", False),
        ("*.log", "a.log", True),
        ("*.log", "a/b.log", False),
        ("**/dir/**", "x/dir/y.txt", True),
        ("**/dir/**", "dir/y.txt", True),
        ("a/{b,c}/?.md", "a/c/1.md", True),
        ("a/[!b].md", "a/b.md", False),
        ("a/[b-d].md", "a/c.md", True),
    ],
)
def test_globs(pattern, path, fits):
    assert bool(re.search(glob_to_regex(pattern), path)) == fits


@pytest.mark.parametrize("bad", ["a/[b", "a/{b", "a\\"])
def test_bad_globs(bad):
    with pytest.raises(ValueError, match="bad glob"):
        glob_to_regex(bad)


def test_encoder_tokens():
    assert embed.basic_tokens("Héllo, wörld! 漢字 a​b") == ["hello", ",", "world", "!", "漢", "字", "ab"]
    vocabulary = {"[UNK]": 0, "[CLS]": 1, "[SEP]": 2, "un": 3, "##want": 4, "##ed": 5, "run": 6}
    assert embed.word_pieces("unwanted", vocabulary) == ["un", "##want", "##ed"]
    assert embed.word_pieces("zzz", vocabulary) == ["[UNK]"]
    assert embed.encode("unwanted run", vocabulary) == [1, 3, 4, 5, 6, 2]


def test_embedders():
    e = embed.HashedEmbedder(64)
    v = e.embed(["red house", "house red", ""])
    assert np.allclose(v[0], v[1])
    assert not v[2].any()
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6
    with pytest.raises(ValueError, match="name"):
        embed.choose({"LODESTACK_EMBED_URL": "http://localhost:1"})
    assert embed.choose({}) is None


def test_endpoints():
    assert models.endpoint("", "", "", ["http://localhost:1", "http://localhost:2"], lambda u: u.endswith("2")) == "http://localhost:2"
    assert models.endpoint("http://flag", "http://env", "", [], lambda u: True) == "http://flag"
    with pytest.raises(ValueError, match="plain http"):
        models.endpoint("http://example.com", "", "k", [], lambda u: True)
    assert models.endpoint("http://127.0.0.1:9", "", "k", [], lambda u: True)


def test_layout_labels(spark):
    from pyspark.sql import functions as F

    raw = "text [1, 2, 3, 4]Hello  \n\n\n\n  title [5, 6, 7, 8] World"
    rows = spark.createDataFrame([(raw,), ("plain [1]",)], "t string").select(text.strip_layout(F.col("t"))).collect()
    assert rows[1][0] == "plain [1]"
    assert "[" not in rows[0][0]
    assert rows[0][0].startswith("Hello")


def test_highlight(spark):
    from pyspark.sql import functions as F

    words = text.highlight_terms("The (needle), in a")
    assert words == ["the", "needle"]
    got = spark.createDataFrame([("a Needle",)], "t string").select(text.highlighted(F.col("t"), words)).first()[0]
    assert got == "a <mark>Needle</mark>"


def test_vectors_by_codes(spark, monkeypatch):
    """The rows of the plain scan, also with ties, odd lengths, zero and infinite vectors, by ids and by a join."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 24))
    rows = [(n, [float(x) for x in v]) for n, v in enumerate(base.astype(np.float32))]
    rows += [(5000 + n, rows[n % 3][1]) for n in range(40)] + [(6000, [0.0] * 24), (6001, [1.0]), (6002, []), (6003, None), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    coded = vectors.codes(df)
    plain = lambda d, q, k: [(r["vec_id"], round(r["score"], 4)) for r in vectors.top_vectors(d, q, k).collect()]
    for q, k in ((rows[0][1], 10), (rows[1][1], 60), (rows[7][1], 1), ([0.0] * 24, 5), ([1.0], 3), (rows[9][1], 5000)):
        for few in (vectors.FEW, 0):
            monkeypatch.setattr(vectors, "FEW", few)
            found = vectors.top_vectors_by_codes(coded, df, q, k)
            assert [(r["vec_id"], round(r["score"], 4)) for r in found.scored.collect()] == plain(df, q, k)
            assert found.by_ids == (found.read <= few)
            if k <= 60 and any(q) and len(q) > 1:
                assert found.read <= k + 60
        monkeypatch.undo()
    some = df.where("vec_id % 2 = 0")
    found = vectors.top_vectors_by_codes(coded, df, rows[0][1], 10, keep=lambda x: x.where("vec_id % 2 = 0"))
    assert [(r["vec_id"], round(r["score"], 4)) for r in found.scored.collect()] == plain(some, rows[0][1], 10)
    assert vectors.top_vectors_by_codes(coded, df, rows[0][1], 0).scored.count() == 0
    assert vectors.top_vectors_by_codes(coded.limit(0), df.limit(0), rows[0][1], 3).scored.count() == 0


def test_bounds_of_codes_hold(spark):
    """Every score lies between its bounds; what has no finite components has none and is always compared."""
    rng = np.random.default_rng(6)
    rows = [(n, [float(x) for x in np.float32(rng.normal(size=16) * 10.0 ** rng.integers(-20, 20))]) for n in range(500)] + [(900, [1.0] * 15 + [float("inf")]), (901, [None, *[1.0] * 15])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.float32(rng.normal(size=16))
    got = {r["vec_id"]: r for r in vectors._bounds(vectors.codes(df), q, 10**6, "vec_id").collect()}
    for n, v in rows[:500]:
        products = np.asarray(v, np.float64) * q.astype(np.float64)
        for exact in (float(products.sum()), math.fsum(products)):
            assert got[n]["low"] <= exact <= got[n]["high"]
    assert all((got[n]["low"], got[n]["high"]) == (float("-inf"), float("inf")) for n in (900, 901))
