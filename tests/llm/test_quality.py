import numpy as np
import pandas as pd

from lodestack.llm import quality as q

from .conftest import LONG


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n, dtype=np.uint8)) for n in (300, 0, 1500, 40)]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    net = {k: v.astype(np.float64) for k, v in q.starting_net(0.4).items()}
    net["mu"], net["sd"] = rng.normal(0, 0.1, 3 * q.FILTERS), rng.uniform(0.5, 1, 3 * q.FILTERS)

    def loss(net):
        x = np.stack([q.summary(q.pooled(t, net["filters"]))[0] for t in texts])
        logit = q.head(x, net)[1]
        return np.mean(np.logaddexp(0, logit) - y * logit)

    got = q.gradients(texts, y, net)
    assert {k: v.shape for k, v in got.items()} == {k: net[k].shape for k in ("w2", "b2", "w1", "b1", "filters")}
    for k, gradient in got.items():
        flat = gradient.ravel()
        for i in {*rng.choice(flat.size, min(10, flat.size), replace=False).tolist(), *np.argsort(-np.abs(flat))[:20].tolist()}:
            up, down = ({**net, k: net[k].copy()} for _ in range(2))
            up[k].ravel()[i] += 1e-6
            down[k].ravel()[i] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - flat[i]) < 1e-6, (k, i)


def test_training_repeats_and_lowers_the_loss():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 110 if i % 2 else 123, 200, dtype=np.uint8)) for i in range(12)]
    labels = [i % 2 for i in range(12)]
    net = q.train(texts, labels, 60)
    assert q.train(texts, labels, 60)["w1"].tobytes() == net["w1"].tobytes()
    assert all((q.score(t, net) > 0.5) == bool(y) for t, y in zip(texts, labels, strict=True))


def test_pooling_by_plain_loops():
    rng = np.random.default_rng(1)
    filters = rng.normal(size=(q.K, 256, q.FILTERS)).astype(np.float32)
    data = bytes(rng.integers(0, 256, 700, dtype=np.uint8))
    got, codes = q.pooled(data, filters), q.padded(data)
    for c in range(len(got)):
        begin = c * q.CHUNK // 2
        outs = [sum(filters[j, codes[p + j]] for j in range(q.K)) for p in range(begin, begin + q.CHUNK)]
        assert np.allclose(got[c], np.max(outs, axis=0), atol=1e-4)
    _, places, _ = q.pooled(data, filters, True)
    at = places[1, 3]
    assert abs(sum(filters[j, codes[at + j], 3] for j in range(q.K)) - got[1, 3]) < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = q.op2_byte_cnn(spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [q.held_out(i) for i in got.doc_id]).all()
    test = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    ranks, y = test.score.rank(), test.quality == 1
    auc = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.97
    assert (test[y].predicted == 1).mean() > 0.97


def test_held_out_labels_are_never_read(spark, edge):
    ids = [i for i in range(40) if q.held_out(i)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i in ids else 1) for i in range(40)], "doc_id long, quality int")
    texts, ys = q.training_rows(docs, labels)
    assert set(ys) == {1}
    assert len(texts) == 40 - len(ids)


def test_edges(edge, empty, labels):
    got = q.classify(edge, labels).collect()
    assert len(got) == edge.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] in (True, False) for r in got)
    assert q.classify(empty, labels).count() == 0
    assert q.classify(edge, labels.where("false")).count() == edge.count()
    kept = q.keep_good(edge, edge, labels)
    assert kept.columns == edge.columns
    assert kept.count() == sum(r["predicted"] for r in got)
    assert 0 <= q.score(LONG.encode(), q.train([], [])) <= 1
