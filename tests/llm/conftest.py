import pytest

LONG = "lorem " * 60000
PLAIN = "The quick brown fox jumps over the lazy dog near the quiet river bank today."
#: Columns with names that the operators use themselves.
CLASHING = ("score", "predicted", "component_id", "slot", "text_a", "key", "label", "a", "b", "_mix_key", "_mix_range", "kept_id", "quality_score", "_kept_id", "with.dot")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    rows = [(1, PLAIN), (2, None), (3, ""), (None, PLAIN), (4, LONG), (5, PLAIN), (5, PLAIN), (6, "x"), (7, "   \n\t "), (None, None)]
    full = [(i, t, None if i == 2 else "en", None if i in (3, None) else "s", len(t) if t is not None else None, *([1] * len(CLASHING))) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
