"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks that overlap by half and cover it
whole. Filters over K bytes, learned on one-hot bytes, run along every chunk;
their outputs are max-pooled in the chunk; mean, maximum and spread of the
pooled outputs over all chunks enter a small hidden layer that gives one
probability. The spread shows repetition: chunks that are all alike.

Training is by Adam on the log loss with hand-written gradients, on a bounded
sample of labelled rows (SAMPLE); scoring covers every row and every byte.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_arrow, read

#: Bytes a filter sees, filters, bytes of a chunk, hidden units.
K, FILTERS, CHUNK, HIDDEN = 6, 16, 256, 16
#: Most labelled rows and most bytes of their texts that training gathers (about 12 MB at the driver).
SAMPLE, SAMPLE_BYTES = 3000, 12 << 20
#: Passes of training over the sample, whatever its size; rows of a minibatch; first learning rate.
EPOCHS, BATCH, RATE, SEED = 8, 8, 0.004, 7
#: Scores from here on are predicted 1.
CUT = 0.3
#: Bytes that are run through the filters at a time.
SEGMENT = 1 << 16


def padded(data: bytes) -> np.ndarray:
    """The bytes of a text with zero bytes at its end, to whole half chunks and the last filter's reach."""
    half = CHUNK // 2
    n = max(2, -(-len(data) // half))
    out = np.zeros(n * half + K - 1, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


def activations(codes: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Filter outputs at every position: sums of K table rows. filters: (K, 256, FILTERS)."""
    n = len(codes) - K + 1
    out = filters[0][codes[:n]]
    for j in range(1, K):
        out += filters[j][codes[j : j + n]]
    return out


def pooled(data: bytes, filters: np.ndarray, where: bool = False):
    """Max-pooled outputs of every chunk (chunks, FILTERS); with where, the positions of the maxima too."""
    codes, half = padded(data), CHUNK // 2
    n = (len(codes) - K + 1) // half
    tops, places = np.empty((n, FILTERS), filters.dtype), np.empty((n, FILTERS), np.int64) if where else None
    step = SEGMENT // half
    for at in range(0, n, step):
        m = min(step, n - at)
        out = activations(codes[at * half : (at + m) * half + K - 1], filters).reshape(m, half, FILTERS)
        if where:
            places[at : at + m] = out.argmax(1) + (np.arange(at, at + m) * half)[:, None]
        tops[at : at + m] = out.max(1)
    # A chunk is two neighbouring halves.
    if where:
        right = tops[1:] > tops[:-1]
        return np.maximum(tops[1:], tops[:-1]), np.where(right, places[1:], places[:-1]), codes
    return np.maximum(tops[1:], tops[:-1])


def summary(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, maximum and spread over the chunks, one after the other; then the mean and spread again for gradients."""
    p = np.tanh(tops)
    mean = p.mean(0)
    spread = np.sqrt(((p - mean) ** 2).mean(0) + 1e-4)
    return np.concatenate([mean, p.max(0), spread]), mean, spread


def head(x: np.ndarray, net: dict) -> tuple[np.ndarray, np.ndarray]:
    """(hidden units, logits) of document summaries (n, 3 * FILTERS)."""
    h = np.tanh((x - net["mu"]) / net["sd"] @ net["w1"] + net["b1"])
    return h, h @ net["w2"] + net["b2"]


def score(data: bytes, net: dict) -> float:
    """The probability that a text's label is 1."""
    x, _, _ = summary(pooled(data, net["filters"]))
    return float(1 / (1 + np.exp(-np.clip(head(x[None], net)[1][0], -30, 30))))


def starting_net(share: float, seed: int = SEED) -> dict:
    """Random weights, and the output bias of a share of label 1."""
    rng = np.random.default_rng(seed)
    return {
        "filters": rng.normal(0, 0.3 / np.sqrt(K), (K, 256, FILTERS)).astype(np.float32),
        "w1": rng.normal(0, 1 / np.sqrt(3 * FILTERS), (3 * FILTERS, HIDDEN)).astype(np.float32),
        "b1": np.zeros(HIDDEN, np.float32),
        "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        "b2": np.array([np.log(share / (1 - share))], np.float32),
        "mu": np.zeros(3 * FILTERS, np.float32),
        "sd": np.ones(3 * FILTERS, np.float32),
    }


def gradients(texts: list[bytes], y: np.ndarray, net: dict) -> dict:
    """Gradients of the mean log loss over some texts by the trained weights."""
    parts = [pooled(t, net["filters"], True) for t in texts]
    sums = [summary(p[0]) for p in parts]
    x = np.stack([s[0] for s in sums])
    h, logit = head(x, net)
    d_logit = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(texts)
    d_h = np.outer(d_logit, net["w2"]) * (1 - h**2)
    d_x = d_h @ net["w1"].T / net["sd"]
    # One row a chunk, of all texts one after the other.
    tops, codes = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    shift = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
    n = np.array([len(p[0]) for p in parts])
    of, first = np.repeat(np.arange(len(parts)), n), np.cumsum([0, *n[:-1]])
    places = np.concatenate([p[1] for p in parts]) + shift[of, None]
    mean, spread = (np.stack([s[i] for s in sums]) for i in (1, 2))
    d_mean, d_max, d_spread = d_x[:, :FILTERS], d_x[:, FILTERS : 2 * FILTERS], d_x[:, 2 * FILTERS :]
    p = np.tanh(tops)
    d_p = (d_mean / n[:, None])[of] + (p - mean[of]) * (d_spread / (n[:, None] * spread))[of]
    best = np.stack([f + q[0].argmax(0) for f, q in zip(first, parts, strict=True)])
    d_p[best, np.arange(FILTERS)] += d_max
    d_top = (d_p * (1 - p**2)).ravel()
    filters = [np.bincount((codes[places + j].astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), d_top, 256 * FILTERS).reshape(256, FILTERS) for j in range(K)]
    z = (x - net["mu"]) / net["sd"]
    return {"w2": h.T @ d_logit, "b2": np.array([d_logit.sum()]), "w1": z.T @ d_h, "b1": d_h.sum(0), "filters": np.stack(filters)}


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """A network trained on whole texts by `epochs` passes over them in small shuffled batches.

    Without both labels it gives the share of label 1 (0.5 without rows).
    """
    net = starting_net((sum(labels) + 1) / (len(labels) + 2), seed)
    if len(set(labels)) < 2:
        net["w2"][:] = 0
        return net
    y = np.asarray(labels, np.float32)
    first = np.stack([summary(pooled(t, net["filters"]))[0] for t in texts])
    net["mu"], net["sd"] = first.mean(0).astype(np.float32), (first.std(0) + 0.02).astype(np.float32)
    names = ("filters", "w1", "b1", "w2", "b2")
    m, v = ({k: np.zeros_like(net[k]) for k in names} for _ in range(2))
    rng = np.random.default_rng(seed + 1)
    batches = -(-len(texts) // BATCH)
    for t in range(1, epochs * batches + 1):
        at = (t - 1) % batches
        order = rng.permutation(len(texts)) if at == 0 else order
        some = order[at * BATCH : (at + 1) * BATCH]
        grad = gradients([texts[i] for i in some], y[some], net)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * (t - 1) / (epochs * batches)))
        for k in names:
            g = grad[k].astype(np.float32) + (1e-4 * net[k] if k in ("w1", "w2") else 0)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net[k] = net[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
    return net


def held_out(doc_id: int | None) -> bool:
    """Whether a document's label is kept from training: crc32 of its id as text is divisible by 5."""
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled texts outside the held-out fold: the first rows by a hash of doc_id.

    The sample's ids are found on the narrow labels table; only their texts are
    gathered, least hash first, until sample_bytes are reached. One label per
    document; a document with contradictory labels, a null id, label or text
    doesn't take part.
    """
    fold = F.crc32(F.col("doc_id").cast("string"))
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("_y"), F.max("quality").alias("_y2")).where("_y = _y2").drop("_y2")
    picked = one.where(fold % 5 != 0).withColumn("_h", F.xxhash64("doc_id", F.lit(SEED))).orderBy("_h", "doc_id").limit(sample)
    # At most `sample` rows of three numbers: bounded, so it is broadcast.
    found = docs.select(F.col("doc_id").alias("_id"), "text").where("text is not null").join(F.broadcast(picked), F.col("_id") == F.col("doc_id"))
    size = F.octet_length("text").cast("long")
    narrow = found.select("doc_id", "_h", size.alias("_n")).groupBy("_h", "doc_id").agg(F.max("_n").alias("_n")).orderBy("_h", "doc_id").limit(sample).collect()
    total, ids = 0, []
    for r in narrow:
        if total + r["_n"] <= sample_bytes:
            total += r["_n"]
            ids.append(r["doc_id"])
    if not ids:
        return [], []
    rows = found.where(F.col("doc_id").isin(ids)).groupBy("_h", "doc_id", "_y").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["_h"], r["doc_id"]))
    return [r["text"].encode() for r in rows], [r["_y"] for r in rows]


def with_score(docs: DataFrame, net: dict, name: str) -> DataFrame:
    """docs with the column `name`: every row's score. Null and empty texts are scored as no bytes."""
    at = docs.columns.index("text")

    def work(batches):
        for batch in batches:
            scores = [score((t.as_py() or "").encode(), net) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, type=pa.float64())], names=[*batch.schema.names, f"c{len(batch.columns)}"])

    return map_arrow(docs, work, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text), by a network trained on labels.

    Each row is scored by its own text alone: no shuffle. Repeated rows each
    get their row; a null doc_id isn't held out; other columns are left out; an
    empty table gives an empty result.
    """
    net = train(*training_rows(docs.select("doc_id", "text"), labels))
    scored = with_score(docs.select("doc_id", "text"), net, "score").drop("text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, train_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are predicted 1, with all their columns; trained on train_docs and labels.

    Rows are judged one by one: repeated rows and rows with a null doc_id too;
    a null or empty text is judged as no bytes. Without labels of both kinds
    all rows share one score. An empty table gives an empty result.
    """
    net = train(*training_rows(train_docs.select("doc_id", "text"), labels))
    name = fresh(docs, "quality_score")
    return with_score(docs, net, name).where(F.col(name) >= CUT).drop(name)


def op2_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score: doc_id, held_out, score, predicted."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
