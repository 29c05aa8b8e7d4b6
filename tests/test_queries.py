"""Every registered query of the engine against its SQL."""

import pytest

from lodestack.plans import catalogue

from . import oracle
from .conftest import SF


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_against_sql(spark, db, name):
    oracle.check(spark, db, SF, catalogue.QUERIES[name], catalogue.ORACLE[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_unchecked_queries_have_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name in ("excerpt", "fts_snippet"):
        assert catalogue.QUERIES[name](spark, SF).count() == docs.count()
    assert catalogue.QUERIES["chunk_documents"](spark, SF).select("doc_id").distinct().count() == docs.count()
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    assert catalogue.QUERIES["html_sections"](spark, SF).select("page_id").distinct().count() == pages


def test_excerpts_by_a_plain_search(spark):
    """Every excerpt is a piece of its text around the first word that occurs, by plain string search."""
    from lodestack.functions import passages

    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    words = catalogue.OR.split()
    for r in catalogue.QUERIES["excerpt"](spark, SF).collect():
        text, shown = texts[r["doc_id"]], r["excerpt"]
        inner = shown.removeprefix("…").removesuffix("…")
        assert inner in text
        assert len(inner.encode()) <= passages.EXCERPT
        places = [p for w in words if (p := text.lower().find(w)) >= 0]
        first = min(places, default=-1)
        if first <= 0:
            assert text.startswith(inner)
        else:
            begin = len(text[: text.find(inner)].encode())
            at = len(text[:first].encode())
            assert at - passages.EXCERPT // 3 - 4 <= begin or text.count(inner) > 1
            assert any(inner.lower().find(w) >= 0 for w in words)


def test_page_sections_by_tags(spark):
    """No script, style or head text is left, and there is a section for each heading that has text."""
    import re

    pages = dict(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect())
    seen = {}
    for r in catalogue.QUERIES["html_sections"](spark, SF).collect():
        assert "track(" not in r["text"]
        assert "margin:0" not in r["text"]
        assert r["page"] == 0
        seen.setdefault(r["page_id"], []).append(r["section"])
    for i, html in pages.items():
        heads = len(re.findall(r"<h[1-6]\b", html))
        assert seen[i] == list(range(len(seen[i])))
        assert heads <= len(seen[i]) <= heads + 1


def test_chunks_by_parts(spark):
    """Chunks of the query are those of the rules, document by document."""
    from lodestack.functions import chunking, text

    docs = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {}
    for r in catalogue.QUERIES["chunk_documents"](spark, SF).orderBy("doc_id", "seq").collect():
        got.setdefault(r["doc_id"], []).append((r["seq"], r["page"], r["text"]))
    for i, t in docs.items():
        body = t.strip(text.PY_SPACE)
        if len(body.encode()) <= chunking.BUDGET:
            assert got[i] == [(0, 0, body)]
        assert all(len(c[2].encode()) <= chunking.BUDGET for c in got[i])
        assert [c[0] for c in got[i]] == list(range(len(got[i])))


def test_many_queries_shuffle_less_than_the_texts(spark, tmp_path):
    """batch_search on copies of documents, in files enough for all cores: its SQL's rows, and what is shuffled stays far below the texts."""
    import duckdb
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = docs.crossJoin(spark.range(12).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + F.col("copy") * 1000).drop("copy")
    copies.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")

    def shuffled() -> int:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = shuffled()
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")  # a part for each file
    try:
        oracle.check(spark, c, str(tmp_path), catalogue.QUERIES["batch_search"], catalogue.ORACLE["batch_search"])
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    size = c.execute("select sum(strlen(text)) from documents").fetchone()[0]
    assert 0 < shuffled() - before < size / 4
