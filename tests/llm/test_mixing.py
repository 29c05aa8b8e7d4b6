import heapq
from collections import Counter

import pytest

from lodestack.llm import mixing


@pytest.mark.parametrize("units", [[1, 2, 5], [3, 3, 3, 1], [7, 11, 13, 40, 1, 1, 1], [512] + [32] * 16, [1]])
def test_deviation_below_one_block(spark, units):
    names = [f"s{i:02d}" for i in range(len(units))]
    plan = mixing.pfair_schedule(spark.createDataFrame(list(zip(names, units, strict=True)), "source string, units long")).orderBy("slot").collect()
    total, given = sum(units), Counter()
    assert [r["slot"] for r in plan] == list(range(total))
    for t, r in enumerate(plan, 1):
        given[r["source"]] += 1
        assert all(abs(given[n] - t * u / total) < 1 for n, u in zip(names, units, strict=True))
    assert given == dict(zip(names, units, strict=True))


@pytest.mark.parametrize("n", [9, 900, 2000])
def test_ties_go_to_more_units_at_any_number_of_sources(spark, n):
    """Against earliest deadline first by a plain heap."""
    units = {f"s{i:04d}": 1 + (i * 7) % 5 for i in range(n)}
    period, released, waiting, expected = sum(units.values()), [], [(0, s, 0) for s in units], []
    heapq.heapify(waiting)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(i + 1) * period // units[s]), -units[s], s, i))
        _, _, s, i = heapq.heappop(released)
        expected.append((s, i))
        if i + 1 < units[s]:
            heapq.heappush(waiting, ((i + 1) * period // units[s], s, i + 1))
    plan = mixing.pfair_schedule(spark.createDataFrame(list(units.items()), "source string, units long")).orderBy("slot").collect()
    assert [(r["source"], r["nth"]) for r in plan] == expected


def test_rows_keep_the_schedule(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), {"a": 3, "b": 1}, block_docs=4).collect()
    assert len({r["position"] for r in got}) == len(got) == 2000
    order = sorted({(r["slot"], r["source"]) for r in got})
    assert len({s for s, _ in order}) == len(order)
    given = Counter()
    for n, (slot, source) in enumerate(order[:400], 1):
        assert slot == n - 1
        given[source] += 1
        assert abs(given["a"] - n * 3 / 4) < 1


def test_edges(edge, empty):
    out = mixing.mix(edge)
    assert out.columns == [c for c in edge.columns if c != "slot"] + ["block", "slot", "position"]
    rows = out.collect()
    assert len(rows) == edge.count()
    assert len({r["position"] for r in rows}) == len(rows)
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(edge, {}).count() == edge.count()
    assert mixing.mix(edge, {"s": 5}).count() == edge.count()


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST, 1])
def test_more_sources_than_slots(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST", broadcast)
    sizes = {"hot": 6000} | {f"s{i:04d}": 1 + i % 3 for i in range(2000)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, source string").repartition(3)
    units = {r["source"]: r["units"] for r in mixing.target_units(spark.createDataFrame(list(sizes.items()), "source string, n long")).collect()}
    assert units.keys() == sizes.keys()
    assert min(units.values()) >= 1
    assert sum(units.values()) == 8192
    assert units["hot"] == max(units.values()) > units["s0002"] > 1
    got = mixing.mix(docs, block_docs=4).collect()
    assert Counter(r["source"] for r in got) == sizes
    assert len({r["position"] for r in got}) == len(got)
    # Every block lies between its release slot and its deadline.
    plan = mixing.pfair_schedule(spark.createDataFrame(list(units.items()), "source string, units long")).orderBy("slot").collect()
    assert [r["slot"] for r in plan] == list(range(8192))
    given = Counter()
    for t, r in enumerate(plan):
        s, u = r["source"], r["units"]
        assert r["nth"] == given[s]
        assert given[s] * 8192 // u <= t < -(-(given[s] + 1) * 8192 // u)
        given[s] += 1
    assert given == units
