"""Many queries' phrases over batches of term lists: counts by a walk along shared prefixes, and each query's best rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Tokens that are looked up at once; products of phrases and queries, and cells of rows and queries, that are summed at once.
TOKENS, CELLS = 1 << 20, 1 << 20
#: Decimals by which hits are compared: sums of copies may differ in their last bits.
DECIMALS = 9


class Phrases:
    """Distinct phrases of terms, numbered in the given order.

    Phrases share the nodes of their common prefixes: from a node and a term
    there is at most one next node, and a node may end a phrase.
    """

    def __init__(self, phrases: list[tuple[str, ...]]):
        number = {t: i for i, t in enumerate(sorted({t for p in phrases for t in p}))}
        nexts: dict[tuple[int, int], int] = {}
        ends: list[int] = [-1]
        for n, phrase in enumerate(phrases):
            node = 0
            for t in phrase:
                step = (node, number[t])
                if step not in nexts:
                    nexts[step] = len(ends)
                    ends.append(-1)
                node = nexts[step]
            ends[node] = n
        self.size, self.terms = len(phrases), pa.array(list(number), pa.string())
        self.ends, self.longer = np.array(ends), np.zeros(len(ends), bool)
        self.first = np.full(len(number), -1)  # the node of a phrase's first term
        deeper = sorted((a * len(number) + t, b) for (a, t), b in nexts.items() if a)
        self.steps, self.nodes = np.array([s for s, _ in deeper], np.int64), np.array([b for _, b in deeper], np.int64)
        for (a, t), b in nexts.items():
            self.longer[a] = True
            if not a:
                self.first[t] = b

    def counts(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, phrase, tf) by row and phrase: how often each phrase occurs in each list of terms."""
        found = np.asarray(pc.index_in(lists.flatten(), self.terms).fill_null(-1), np.int64)
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths().fill_null(0)))
        at = np.flatnonzero(found >= 0)
        node = self.first[found[at]]
        hits = [np.zeros(0, np.int64)]
        at, node = at[node >= 0], node[node >= 0]
        while len(at):
            end = self.ends[node]
            hits.append(row[at[end >= 0]] * self.size + end[end >= 0])
            more = self.longer[node] & (at + 1 < len(found))
            at, node = at[more], node[more]
            more = (row[at + 1] == row[at]) & (found[at + 1] >= 0)
            at, node = at[more] + 1, node[more]
            if not len(at):
                break
            step = node * len(self.terms) + found[at]
            i = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            more = self.steps[i] == step
            at, node = at[more], self.nodes[i[more]]
        pairs, tf = np.unique(np.concatenate(hits), return_counts=True)
        return pairs // max(1, self.size), pairs % max(1, self.size), tf


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about TOKENS items of a list column, one row at least."""
    total = np.cumsum(np.asarray(batch.column(column).value_lengths().fill_null(0), np.int64))
    begin = 0
    while begin < len(total):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + TOKENS, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Best:
    """The k best rows of each of a number of queries, by score to DECIMALS and then by key, of all rows that are added."""

    def __init__(self, asked: list[tuple[int, int, float]], phrases: int, queries: int, k: int):
        """asked: (phrase, query, weight)."""
        asked = sorted(asked)
        self.k, self.queries = k, queries
        self.query, self.weight = np.array([q for _, q, _ in asked], np.int64), np.array([w for *_, w in asked], np.float64)
        self.uses = np.bincount(np.array([p for p, *_ in asked], np.int64), minlength=phrases)
        self.start = np.cumsum(self.uses) - self.uses
        self.least = np.full(queries, -1, np.int64)  # the k-th best so far
        self.held: list[pa.Table] = []
        self.n = 0

    def add(self, keys: pa.Array, row: np.ndarray, phrase: np.ndarray, impact: np.ndarray) -> None:
        """Rows as (row, phrase, impact) by row and phrase, so that a score is the same sum in any batch."""
        cost = np.bincount(row, self.uses[phrase], minlength=len(keys)).astype(np.int64) + self.queries
        group = np.cumsum(cost) // CELLS
        cuts = np.searchsorted(row, np.searchsorted(group, np.unique(group)))
        for begin, end in zip(cuts, [*cuts[1:], len(row)], strict=True):
            if begin < end:
                self._add(keys, row[begin:end], phrase[begin:end], impact[begin:end])

    def _add(self, keys: pa.Array, row: np.ndarray, phrase: np.ndarray, impact: np.ndarray) -> None:
        uses = self.uses[phrase]
        use = np.repeat(self.start[phrase] - np.cumsum(uses) + uses, uses) + np.arange(uses.sum())
        cell = np.repeat(row - row[0], uses) * self.queries + self.query[use]
        score = np.bincount(cell, np.repeat(impact, uses) * self.weight[use], minlength=(row[-1] - row[0] + 1) * self.queries).reshape(-1, self.queries)
        order = np.floor(score * 10.0**DECIMALS + 0.5).astype(np.int64)
        at, query = np.nonzero((score > 0) & (order >= self.least))
        self.held.append(pa.table({"query": query, "key": keys.take(pa.array(at + row[0])), "score": score[at, query], "order": order[at, query]}))
        self.n += len(at)
        if self.n > max(CELLS // 16, 2 * self.k * self.queries):
            self._keep()

    def _keep(self) -> None:
        found = pa.concat_tables(self.held).sort_by([("query", "ascending"), ("order", "descending"), ("key", "ascending")])
        query = np.asarray(found["query"])
        place = np.arange(len(query)) - np.searchsorted(query, query)
        found = found.filter(pa.array(place < self.k))
        last = np.flatnonzero(place == self.k - 1)
        self.least[query[last]] = np.asarray(found["order"])[np.flatnonzero(place[place < self.k] == self.k - 1)]
        self.held, self.n = [found], len(found)

    def rows(self) -> pa.Table | None:
        """(query, key, score, order) of the best rows; None if no rows were added."""
        if not self.held:
            return None
        self._keep()
        return self.held[0]
