import random

import pytest

from lodestack.llm import chat_format as c

COLUMNS = "conv_id long, turn long, role string, text string, op string, position int"


def turns(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS).repartition(parts)


def cheapest(roles):
    """The least cost over all repairs, by exhaustion."""
    best = [float("inf")]

    def go(i, state, cost):
        if i == len(roles):
            if state in c.ENDS:
                best[0] = min(best[0], cost)
            return
        for to in range(3):
            change = 0 if roles[i] == to else c.NAME if roles[i] == 3 else c.RELABEL
            if to in c.FOLLOWS[state]:
                go(i + 1, to, cost + change)
            if to == state:
                go(i + 1, to, cost + c.MERGE + change)
            for m in c.FOLLOWS[state]:
                if to in c.FOLLOWS[m]:
                    go(i + 1, to, cost + c.INSERT + change)

    go(0, c.START, 0)
    return best[0]


def test_least_cost_by_exhaustion():
    rng = random.Random(5)
    for _ in range(200):
        roles = bytes(rng.randrange(4) for _ in range(rng.randrange(1, 6)))
        assert sum(f[2] for f in c.fragments(roles, ["t"] * len(roles), c.START, None, True)) == cheapest(roles)


def rendered(rows):
    return "".join(r["fragment"] for r in sorted(rows, key=lambda r: r["position"]))


def legal(text):
    state = c.START
    for part in text.split("<|end|>\n")[:-1]:
        role = c.ROLES.index(part[2 : part.index("|>")])
        assert part.startswith("<|")
        assert role in c.FOLLOWS[state]
        state = role
    assert state in c.ENDS


@pytest.mark.parametrize("shuffle", [1, 7, 40])
def test_a_conversation_over_many_tasks(spark, shuffle):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant", "system", "bot", None]), f"t{i}") for i in range(400)] + [(n, i, rng.choice(["user", "assistant"]), "x") for n in range(2, 12) for i in range(5)]
    before, aqe = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = c.repair(turns(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert len(got) == len(rows)
    for n in range(1, 12):
        own = sorted((r for r in got if r["conv_id"] == n), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert [r["turn"] for r in own] == sorted(r["turn"] for r in own)
        roles = bytes(c.role_code(r["role"]) for r in own)
        assert sum(r["cost"] for r in own) == sum(f[2] for f in c.fragments(roles, [""] * len(roles), c.START, None, True))
        legal(rendered(own))


def test_legal_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "User ", "q <|end|>"), (1, 2, "assistant", None)]
    got = c.repair(turns(spark, rows)).collect()
    assert {(r["op"], r["cost"]) for r in got} == {("open", 0)}
    assert rendered(got) == "<|system|>\ns<|end|>\n<|user|>\nq < |end|><|end|>\n<|assistant|>\n<|end|>\n"


def test_edges(spark):
    rows = [(None, 1, "user", "a"), (None, None, "user", "b"), (2, 0, None, None), (3, 0, "user", "z" * 300000), (4, 0, "user", "r"), (4, 0, "user", "r"), (5, 0, "system", "")]
    got = c.repair(turns(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    assert rendered(by[None]) == "<|user|>\nb\na<|end|>\n"
    assert rendered(by[4]) == "<|user|>\nr\nr<|end|>\n"
    assert by[5][0]["cost"] > 0
    for own in by.values():
        legal(rendered(own))
    assert c.repair(turns(spark, rows).where("false")).count() == 0
