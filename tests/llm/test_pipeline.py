"""Every stage on its own input, against its operator's brute force."""

import pandas as pd
import pytest

import corpus_pipeline as p
from lodestack.llm import decontam, mixing, near_dedup, quality, secrets

from ..conftest import SF
from .test_near_dedup import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(at / str(k)))
        docs = spark.read.parquet(str(at / str(k)))
        out.append(docs.toPandas())
    return out


def test_columns_and_rows(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert list(after.columns) == list(before.columns)
        assert set(after.doc_id) <= set(before.doc_id)
        assert after.doc_id.is_unique


def test_quality(spark, stages):
    net = quality.train(*quality.training_rows(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    want = {i for i, t in zip(stages[0].doc_id, stages[0].text, strict=True) if quality.score(t.encode(), net) >= quality.CUT}
    assert set(stages[1].doc_id) == want


def test_near_duplicates(stages):
    docs = stages[1].sort_values("doc_id")
    _, roots = brute(docs.text.tolist(), 5, 80)
    ids = docs.doc_id.tolist()
    assert set(stages[2].doc_id) == {ids[r] for r in roots}


def test_decontamination(stages):
    items = pd.read_parquet(f"{SF}/benchmark.parquet").text
    flat = lambda t: " " + " ".join(decontam.tokens(t)) + " "
    held = {i for i, t in zip(stages[2].doc_id, stages[2].text, strict=True) if any(flat(b) in flat(t) for b in items)}
    gone = set(stages[2].doc_id) - set(stages[3].doc_id)
    assert held <= gone
    assert len(gone - held) <= 1


def test_secrets(stages):
    before, after = (dict(zip(s.doc_id, zip(s.text, s.n_chars, strict=True), strict=True)) for s in stages[3:5])
    assert before.keys() == after.keys()
    for i, (text, n) in before.items():
        want = secrets.redact(text)
        assert after[i] == (want, len(want) if want != text else n)


def test_mixture(stages):
    before, after = stages[4], stages[5]
    assert sorted(before.doc_id) == sorted(after.doc_id)
    assert after.position.is_unique
    assert (after.position // mixing.BLOCK_DOCS == after.slot).all()
    assert {"block", "slot", "position"} <= set(after.columns)


def test_run(spark, stages):
    got = p.run(spark, SF).toPandas()
    assert sorted(zip(got.doc_id, got.position, strict=True)) == sorted(zip(stages[5].doc_id, stages[5].position, strict=True))


def test_empty(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(p.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() == 0
    assert near_dedup.keep_one(docs).count() == 0


def test_edges(spark, edge, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through all stages."""
    docs = edge
    for k, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name == "source mixture":
            assert [c for c in docs.columns if c not in ("block", "slot", "position")] == [c for c in after.columns if c not in ("block", "slot", "position")]
            assert after.count() == docs.count()
        else:
            assert after.columns == docs.columns
            assert after.count() <= docs.count()
        # What the classifier makes of such rows is its own matter; the next stages get them all.
        docs = after if k else edge


def test_intermediate_rows_are_removed(spark):
    from pathlib import Path

    from lodestack.llm.common import shared_dir

    at = Path(shared_dir(spark).removeprefix("file:"))
    before = set(at.glob("pipeline-*"))
    rows = p.run(spark, SF).count()
    (made,) = set(at.glob("pipeline-*")) - before
    assert [x.name for x in made.iterdir()] == [str(len(p.STAGES) - 1)]
    assert rows > 0
