"""Chat formatting: minimum-cost role repair by dynamic programming, then rendering.

A legal conversation opens with a system or user message; user follows system,
assistant follows user, user follows assistant; it ends with user or assistant.
Every turn either opens a message, is merged into the message before it, or
opens a message after an inserted empty one, and may be relabelled. The cheapest
repair is a shortest path over (turn, role of the open message).

One turn's costs form a matrix over roles, and the matrices combine as
min-plus products. So a conversation may span many tasks: rows are dealt by
ranges of (conv_id, turn), every task multiplies up the runs at its two edges,
the driver solves the few states between tasks (two small matrices a task), and
every task then traces its own rows between the states it was given.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

ROLES = ("system", "user", "assistant")
START = 3
#: Costs: a changed role, a role given to a turn without a known one, a merge, an inserted empty message.
RELABEL, NAME, MERGE, INSERT = 2, 1, 1, 3
FOLLOWS = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
ENDS = (1, 2)
INF = float("inf")
OPS = ("open", "merge", "insert")
SCHEMA = "conv_id long, turn long, position long, role string, new_role string, op string, cost int, fragment string"


@lru_cache(None)
def step(state: int, role: int, to: int) -> tuple[float, int, int]:
    """(cost, op, inserted role or -1) of the cheapest way of a turn of `role` (3: unknown) from state to state."""
    change = 0 if role == to else NAME if role == 3 else RELABEL
    ways = []
    if to in FOLLOWS[state]:
        ways.append((change, 0, -1))
    if to == state:
        ways.append((MERGE + change, 1, -1))
    ways += [(INSERT + change, 2, m) for m in FOLLOWS[state] if to in FOLLOWS[m]]
    return min(ways, default=(INF, 0, -1))


def product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """Min-plus product of two matrices over the states."""
    return [[min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def run_matrix(roles: bytes) -> list[list[float]]:
    """The cheapest costs over a run of turns, from every state to every state."""
    total = [[0.0 if i == j else INF for j in range(4)] for i in range(4)]
    for r in roles:
        total = [[min(row[s] + step(s, r, t)[0] for s in range(4)) if t < 3 else INF for t in range(4)] for row in total]
    return total


def trace(roles: bytes, entry: int, leave: int | None) -> list[int]:
    """The states of a cheapest path over the turns from entry, to leave or to any legal end. Ties: the lower state."""
    costs, back = [0.0 if i == entry else INF for i in range(4)], []
    for r in roles:
        ways = [min((costs[s] + step(s, r, t)[0], s) for s in range(4)) for t in range(3)]
        back.append([w[1] for w in ways])
        costs = [w[0] for w in ways] + [INF]
    state = leave if leave is not None else min((costs[e], e) for e in ENDS)[1]
    states = [state]
    for b in reversed(back[1:]):
        states.append(b[states[-1]])
    return states[::-1]


_short_trace = lru_cache(4096)(trace)


def role_code(role: str | None) -> int:
    """A role's number, by its name in any case and without surrounding blanks; 3 if it isn't one."""
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 3


def fragments(roles: bytes, texts: list[str | None], entry: int, leave: int | None, last: bool) -> Iterator[tuple[str, str, int, str]]:
    """(new role, op, cost, fragment) of the turns of a run; the fragments of a conversation join to its rendering."""
    states = (_short_trace if len(roles) <= 64 else trace)(roles, entry, leave)
    state = entry
    for i, (r, to, text) in enumerate(zip(roles, states, texts, strict=True)):
        cost, op, inserted = step(state, r, to)
        body = (text or "").replace("<|", "< |")
        close = "" if state == START else "<|end|>\n"
        if op == 1:
            out = "\n" + body
        else:
            out = close + (f"<|{ROLES[inserted]}|>\n<|end|>\n" if op == 2 else "") + f"<|{ROLES[to]}|>\n" + body
        if last and i == len(roles) - 1:
            out += "<|end|>\n"
        yield ROLES[to], OPS[op], int(cost), out
        state = to


def _runs(batches) -> Iterator[tuple[object, list[dict]]]:
    """(conv_id, rows) of consecutive rows of a task."""
    conv, rows, begun = None, [], False
    for batch in batches:
        for r in batch.to_pylist():
            if begun and r["conv_id"] != conv:
                yield conv, rows
                rows = []
            conv, begun = r["conv_id"], True
            rows.append(r)
    if begun:
        yield conv, rows


def _edges(batches):
    """The first and the last run of a task: place, length, cost matrix."""
    from pyspark import TaskContext

    me, first, last, n = TaskContext.get().partitionId(), None, None, 0
    for conv, rows in _runs(batches):
        last = (conv, bytes(role_code(r["role"]) for r in rows))
        first, n = first or last, n + 1
    if first is None:
        return
    found = [(0, first)] + ([(1, last)] if n > 1 else [])
    yield pa.RecordBatch.from_pylist(
        [{"task": me, "edge": k, "runs": n, "conv_id": c, "rows": len(roles), "matrix": [x for row in run_matrix(roles) for x in row]} for k, (c, roles) in found],
        schema=pa.schema([("task", pa.int32()), ("edge", pa.int32()), ("runs", pa.int64()), ("conv_id", pa.int64()), ("rows", pa.int64()), ("matrix", pa.list_(pa.float64()))]),
    )


def boundary_states(edges: list[dict]) -> dict[tuple[int, int], tuple[int, int | None, bool, int]]:
    """For (task, edge): entry state, state to leave in (None: a legal end), whether the conversation ends there, rows before.

    edges: what the tasks found, any order. Runs of neighbouring tasks with one
    conv_id are one conversation.
    """
    chains: list[list[dict]] = []
    for e in sorted(edges, key=lambda e: (e["task"], e["edge"])):
        if chains and chains[-1][-1]["conv_id"] == e["conv_id"] and e["edge"] == 0:
            chains[-1].append(e)
        else:
            chains.append([e])
    out = {}
    for chain in chains:
        costs, back = [INF] * 3 + [0.0], []
        for e in chain:
            m = [e["matrix"][4 * i : 4 * i + 4] for i in range(4)]
            ways = [min((costs[s] + m[s][t], s) for s in range(4)) for t in range(4)]
            back.append([w[1] for w in ways])
            costs = [w[0] for w in ways]
        states = [min((costs[e], e) for e in ENDS)[1]]
        for b in reversed(back):
            states.append(b[states[-1]])
        states, before = states[::-1], 0
        for k, e in enumerate(chain):
            out[e["task"], e["edge"]] = (states[k], states[k + 1], k == len(chain) - 1, before)
            before += e["rows"]
    return out


def repair(turns: DataFrame) -> DataFrame:
    """Every turn of (conv_id, turn, role, text) with its repair, in the columns of SCHEMA.

    A conversation's turns go by turn (null first), then role, then text; its
    fragments, joined by position, are its rendered text. Rows with a null
    conv_id are one conversation. A null, empty or unknown role is named at the
    cost NAME; a null text is empty; '<|' in a text is rendered as '< |'.
    Repeated rows are turns of their own. An empty table gives an empty result.
    Other columns are left out.

    The driver gets two rows of sixteen numbers a task, whatever the size of
    conversations: one with a third of all rows is spread over many tasks.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("_t", F.xxhash64("text")).withColumn("_u", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "_t", "_u"]
    # The checkpoint fixes which task has which rows: both passes below must agree on it.
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_t", "_u"))
    edges = [r.asDict() for r in dealt.select("conv_id", "role").mapInArrow(_edges, "task int, edge int, runs long, conv_id long, rows long, matrix array<double>").collect()]
    known, runs = boundary_states(edges), {e["task"]: e["runs"] for e in edges}

    def render(batches):
        from pyspark import TaskContext

        me, out = TaskContext.get().partitionId(), []
        names = ("conv_id", "turn", "position", "role", "new_role", "op", "cost", "fragment")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
        schema = pa.schema(list(zip(names, kinds, strict=True)))

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)

        for k, (conv, rows) in enumerate(_runs(batches)):
            edge = 0 if k == 0 else 1 if k == runs[me] - 1 else None
            entry, leave, last, before = known[me, edge] if edge is not None else (START, None, True, 0)
            roles = bytes(role_code(r["role"]) for r in rows)
            for i, (r, done) in enumerate(zip(rows, fragments(roles, [r["text"] for r in rows], entry, leave, last), strict=True)):
                out.append((conv, r["turn"], before + i, r["role"], *done))
                if len(out) >= 2000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    return dealt.mapInArrow(render, SCHEMA)


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of conversations, repaired and rendered; the columns of SCHEMA."""
    return repair(read(spark, sf_dir, "conversations"))
