"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and overlap checks.

Every training passage, a window of words long enough that any item fits whole
into some window, is a query. Items form classes by length, each with its own
index and windows, so that a long item doesn't widen the windows of short ones.
An item's BM25 score is divided by the score the item gives itself, so that one
threshold holds for all items. Block-max WAND retrieves every item at or above
the threshold; in front of it, the maxima of groups of blocks bound all windows
of a text at once. A retrieved item counts if enough of its question words and
of its answer words lie in runs of three words that a part of the passage, of
twice the item's length, shares.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, read

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved; shares of question and answer words that must be found.
THRESHOLD, QUESTION, ANSWER = 0.6, 0.5, 0.5
#: Words of a run, items of a block, words of half a window for the shortest class of items; each further class has items of up to WIDER times that.
RUN, BLOCK, HALF, WIDER = 3, 2, 64, 4
#: Most bytes of item texts in one index; more items are searched index by index. An index holds about 40 times its texts in Python's objects, so under 200 MB.
INDEX_BYTES = 4 << 20
#: Most cells of the table of group maxima.
CELLS = 4 << 20
_WORD = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return _WORD.findall((text or "").lower())


class Item:
    """A test item: its words, and how many of them are the question. Without a given answer it is the last quarter."""

    def __init__(self, item_id, text: str | None, answer: str | None = None):
        words = tokens(text)
        extra = tokens(answer)
        self.item_id, self.words = item_id, words + extra
        n = len(self.words)
        self.question = len(words) if extra else n - min(n, max(RUN, -(-n // 4)))


class Index:
    """Postings of items of at most `half` words with block maxima. total, average and df are over all items, also of other indexes."""

    def __init__(self, items: list[Item], total: int, average: float, df: dict[str, int], half: int = HALF):
        self.items, self.half = items, half
        self.ids: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for n, item in enumerate(items):
            tf: dict[str, int] = {}
            for w in item.words:
                tf[w] = tf.get(w, 0) + 1
            norm = K1 * (1 - B + B * len(item.words) / average)
            score = {w: math.log(1 + (total - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
            own = sum(score.values())
            for w, s in score.items():
                t = self.ids.setdefault(w, len(postings))
                if t == len(postings):
                    postings.append([])
                postings[t].append((n, s / own))
        self.postings = postings
        self.blocks = [{} for _ in postings]
        for t, p in enumerate(postings):
            for n, s in p:
                self.blocks[t][n // BLOCK] = max(s, self.blocks[t].get(n // BLOCK, 0.0))
        self.maxima = [max(b.values()) for b in self.blocks]
        blocks = max(1, -(-len(items) // BLOCK))
        groups = max(1, min(blocks, CELLS // (len(postings) + 1)))
        self.per_group = -(-blocks // groups)
        # The last row is of words that no item has.
        self.bounds = np.zeros((len(postings) + 1, -(-blocks // self.per_group)), np.float32)
        for t, b in enumerate(self.blocks):
            for k, s in b.items():
                g = k // self.per_group
                self.bounds[t, g] = max(self.bounds[t, g], s)

    def encode(self, words: list[str]) -> np.ndarray:
        get, none = self.ids.get, len(self.postings)
        return np.fromiter((get(w, none) for w in words), np.int64, len(words))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items whose postings of the distinct terms add up to the threshold: block-max WAND."""
        lists = [[0, self.postings[t], self.blocks[t], self.maxima[t]] for t in terms]
        least, out = threshold - 1e-6, []
        while lists:
            lists.sort(key=lambda x: x[1][x[0]][0])
            total, pivot = 0.0, -1
            for i, x in enumerate(lists):
                total += x[3]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = lists[pivot][1][lists[pivot][0]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]][0] == doc:
                pivot += 1
            block = doc // BLOCK
            if sum(x[2].get(block, 0.0) for x in lists[: pivot + 1]) >= least:
                if lists[0][1][lists[0][0]][0] == doc:
                    score = 0.0
                    for x in lists[: pivot + 1]:
                        score += x[1][x[0]][1]
                        x[0] += 1
                    if score >= least:
                        out.append((doc, score))
                    lists = [x for x in lists if x[0] < len(x[1])]
                    continue
                to = doc
            else:  # nothing in this block: on to the next block, or the next list's item if that comes first
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = max(doc + 1, min(to, lists[pivot + 1][1][lists[pivot + 1][0]][0]))
            for x in lists[: pivot + 1]:
                k, p = x[0], x[1]
                while k < len(p) and p[k][0] < to:
                    k += 1
                x[0] = k
            lists = [x for x in lists if x[0] < len(x[1])]
        return out

    def candidates(self, codes: np.ndarray, threshold: float):
        """(first word, words, [(item, score)]) of the windows of a text that retrieve anything."""
        n, half, none = len(codes), self.half, len(self.postings)
        starts = np.arange(0, max(1, n - half), half)
        # A window is two neighbouring halves; a term counts once in each, so the sum bounds the window's score.
        halves = np.zeros((max(1, -(-n // half)), self.bounds.shape[1]), np.float32)
        at = np.flatnonzero(codes < none)
        if not len(at):
            return
        keys = np.unique(at // half * none + codes[at])
        of, terms = keys // none, keys % none
        first = np.flatnonzero(np.diff(of, prepend=-1))
        halves[of[first]] = np.add.reduceat(self.bounds[terms], first, axis=0)
        sums = halves.copy()
        sums[:-1] += halves[1:]
        for k in np.flatnonzero(sums[: len(starts)].max(1) >= threshold - 1e-4).tolist():
            at = int(starts[k])
            terms = np.unique(codes[at : at + 2 * half])
            terms = terms[terms < len(self.postings)]
            if self.bounds[terms].sum(0).max(initial=0.0) >= threshold - 1e-4 and (found := self.search(terms.tolist(), threshold)):
                yield at, 2 * half, found


def overlaps(item: Item, words: list[str]) -> tuple[float, float]:
    """Shares of the item's question and answer words that lie in runs of RUN words shared with the passage.

    An item shorter than a run must be there whole. An empty question is found.
    """
    n = min(RUN, len(item.words))
    there = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    covered = [False] * len(item.words)
    for i in range(len(covered) - n + 1):
        if tuple(item.words[i : i + n]) in there:
            covered[i : i + n] = [True] * n
    q, a = covered[: item.question], covered[item.question :]
    return (sum(q) / len(q) if q else 1.0), (sum(a) / len(a) if a else 1.0)


def by_length(items: list[Item], total: int, average: float, df: dict[str, int]) -> list[Index]:
    """An index for each class of lengths among the items; items without words are in none."""
    classes: dict[int, list[Item]] = {}
    for x in items:
        half = HALF
        while half < len(x.words):
            half *= WIDER
        if x.words:
            classes.setdefault(half, []).append(x)
    return [Index(held, total, average, df, half) for half, held in sorted(classes.items())]


def best_overlaps(item: Item, passage: list[str], question: float, answer: float) -> tuple[float, float]:
    """The best overlaps (question, answer) of an item in the parts of a passage of twice its length, each beginning a length after the last; parts with enough of both come first."""
    n = max(RUN, len(item.words))
    return max((overlaps(item, passage[at : at + 2 * n]) for at in range(0, max(1, len(passage) - n), n)), key=lambda v: (v[0] >= question and v[1] >= answer, sum(v)))


def matches(text: str | None, found: list[Index], threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> dict:
    """For each item found in a text, by (index, number): score, question overlap and answer overlap of its best passage."""
    words, out = tokens(text), {}
    for k, index in enumerate(found if words else []):
        for at, size, hits in index.candidates(index.encode(words), threshold):
            passage = words[at : at + size]
            for n, s in hits:
                q, a = best_overlaps(index.items[n], passage, question, answer)
                if q >= question and a >= answer and ((k, n) not in out or (q + a, s) > (sum(out[k, n][1:]), out[k, n][0])):
                    out[k, n] = (s, q, a)
    return out


def indexes(items: DataFrame, most_bytes: int = INDEX_BYTES) -> Iterator[list[Index]]:
    """Indexes of items (item_id, text, optionally answer), those of at most about most_bytes of text at a time.

    Statistics are over all items. Their sizes are summed first: one share is
    the rule, and a larger set is dealt by hash over as many as it takes, so
    what the driver holds and sends to the executors at a time stays bounded.
    """
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select("item_id", "text", answer.alias("answer"))
    size = rows.agg(F.sum(F.octet_length(F.concat_ws(" ", "text", "answer"))).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(size / most_bytes))
    if shards == 1:
        made = [Item(r["item_id"], r["text"], r["answer"]) for r in rows.orderBy("item_id", "text").collect()]
        df: dict[str, int] = {}
        for x in made:
            for w in set(x.words):
                df[w] = df.get(w, 0) + 1
        words = sum(len(x.words) for x in made)
        yield by_length(made, len(made), words / max(1, len(made)), df)
        return

    def counts(batches):
        for batch in batches:
            held: dict[str, int] = {}
            for text, extra in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = Item(None, text, extra).words
                held[""] = held.get("", 0) + len(words)
                for w in set(words):
                    held[w] = held.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

    df_rows = cut(rows.mapInArrow(counts, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = rows.count()
    average = (df_rows.where("w = ''").first() or {"n": 0})["n"] / max(1, total)
    for k in range(shards):
        made = [Item(r["item_id"], r["text"], r["answer"]) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).orderBy("item_id", "text").collect()]
        own = df_rows.sparkSession.createDataFrame([(w,) for w in {w for x in made for w in x.words}], "w string")
        df = {r["w"]: r["n"] for r in df_rows.join(own, "w").collect()}
        yield by_length(made, total, average, df)


def _each(items: DataFrame, most_bytes: int, step: Callable[[Broadcast, DataFrame | None], DataFrame]) -> list[DataFrame]:
    """step(broadcast indexes, the last step's rows) for every share of the items.

    With several shares each one's rows are written before the next share is made, and its broadcast is let go.
    """
    sc, out, last = items.sparkSession.sparkContext, [], None
    for found in indexes(items, most_bytes):
        if last is not None:
            out[-1] = cut(out[-1])
            last.destroy()
        last = sc.broadcast(found)
        out.append(step(last, out[-1] if out else None))
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every item found in every row of docs (doc_id, text).

    Every passage of every whole text is a query; texts aren't shuffled. Null
    and empty texts and items match nothing; items with equal texts are each
    reported; repeated rows each report; other columns are left out; an empty
    table on either side gives an empty result.
    """
    docs = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")

    def step(shared: Broadcast, _: DataFrame | None) -> DataFrame:
        def work(batches):
            found = shared.value
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    rows += [(doc_id, found[k].items[n].item_id, *v) for (k, n), v in sorted(matches(text.as_py(), found, threshold, question, answer).items())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(work, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    parts = _each(items, most_bytes, step)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, most_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns.

    Rows are judged one by one, repeated rows and rows with a null doc_id too;
    rows with a null or empty text stay. Without items all rows stay; an empty
    table gives an empty result.
    """
    at, schema = docs.columns.index("text"), docs.schema

    def step(shared: Broadcast, before: DataFrame | None) -> DataFrame:
        def work(batches):
            for batch in batches:
                yield batch.filter(pa.array([not matches(t.as_py(), shared.value) for t in batch.column(at)], pa.bool_()))

        return map_arrow(docs if before is None else before, work, schema)

    return _each(items, most_bytes, step)[-1]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items: doc_id, item_id, score, question_overlap, answer_overlap."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
