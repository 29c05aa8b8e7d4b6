"""Weights, the encoder, the chat client, progress lines."""

import io
import json
import math
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from lodestack.functions import chat, embed, encoder
from lodestack.sources import folder


def weights(rng, hidden=8, inner=16, layers=2, words=20):
    shapes = {"embeddings.word_embeddings.weight": (words, hidden), "embeddings.position_embeddings.weight": (32, hidden), "embeddings.token_type_embeddings.weight": (2, hidden)}
    norms = ["embeddings.LayerNorm"]
    for i in range(layers):
        at = f"encoder.layer.{i}"
        for name, shape in (("attention.self.query", (hidden, hidden)), ("attention.self.key", (hidden, hidden)), ("attention.self.value", (hidden, hidden)), ("attention.output.dense", (hidden, hidden)), ("intermediate.dense", (inner, hidden)), ("output.dense", (hidden, inner))):
            shapes[f"{at}.{name}.weight"], shapes[f"{at}.{name}.bias"] = shape, shape[:1]
        norms += [f"{at}.attention.output.LayerNorm", f"{at}.output.LayerNorm"]
    for n in norms:
        shapes[f"{n}.weight"] = shapes[f"{n}.bias"] = (hidden,)
    return {k: rng.normal(size=s).astype(np.float32) for k, s in shapes.items()}


def test_safetensors():
    rng = np.random.default_rng(0)
    w = weights(rng)
    back = encoder.read_safetensors(encoder.write_safetensors(w))
    assert all((back[k] == w[k]).all() for k in w)
    small = encoder.read_safetensors(encoder.write_safetensors(encoder.quantized(w, 64)))
    assert small.keys() == w.keys()
    a, b = (encoder.forward([1, 5, 7, 2], x, 2) for x in (w, small))
    assert a @ b > 0.98
    with pytest.raises(ValueError):
        encoder.read_safetensors(b"x")
    with pytest.raises(ValueError):
        encoder.read_safetensors(struct.pack("<Q", 99) + b"{}")
    bad = json.dumps({"t": {"dtype": "F32", "shape": [4], "data_offsets": [0, 16]}}).encode()
    with pytest.raises(ValueError):
        encoder.read_safetensors(struct.pack("<Q", len(bad)) + bad + bytes(8))


def test_forward_by_loops():
    w, ids, heads = weights(np.random.default_rng(1), layers=1), [3, 1, 4], 2
    norm = lambda v, n: [(x - sum(v) / len(v)) / math.sqrt(sum((y - sum(v) / len(v)) ** 2 for y in v) / len(v) + 1e-12) * g + b for x, g, b in zip(v, w[f"{n}.weight"], w[f"{n}.bias"], strict=True)]
    linear = lambda v, n: [sum(a * b for a, b in zip(v, row, strict=True)) + c for row, c in zip(w[f"{n}.weight"], w[f"{n}.bias"], strict=True)]
    x = [norm([a + b + c for a, b, c in zip(w["embeddings.word_embeddings.weight"][t], w["embeddings.position_embeddings.weight"][p], w["embeddings.token_type_embeddings.weight"][0], strict=True)], "embeddings.LayerNorm") for p, t in enumerate(ids)]
    at, depth = "encoder.layer.0", 4
    q, k, v = ([linear(r, f"{at}.attention.self.{n}") for r in x] for n in ("query", "key", "value"))
    out = []
    for i in range(3):
        mixed = []
        for h in range(heads):
            cols = range(h * depth, h * depth + depth)
            e = [math.exp(sum(q[i][c] * k[j][c] for c in cols) / math.sqrt(depth)) for j in range(3)]
            mixed += [sum(e[j] * v[j][c] for j in range(3)) / sum(e) for c in cols]
        y = norm([a + b for a, b in zip(x[i], linear(mixed, f"{at}.attention.output.dense"), strict=True)], f"{at}.attention.output.LayerNorm")
        inner = [z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in linear(y, f"{at}.intermediate.dense")]
        out.append(norm([a + b for a, b in zip(y, linear(inner, f"{at}.output.dense"), strict=True)], f"{at}.output.LayerNorm"))
    mean = np.mean(out, axis=0)
    assert np.abs(encoder.forward(ids, w, heads) - mean / np.linalg.norm(mean)).max() < 2e-4


class Server(BaseHTTPRequestHandler):
    calls: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.calls.append((self.path, body, self.headers.get("Authorization")))
        if self.path.endswith("embeddings"):
            out = json.dumps({"data": [{"index": i, "embedding": [3.0 * (i + 1), 4.0 * (i + 1)]} for i in reversed(range(len(body["input"])))]}).encode()
        elif body.get("stream"):
            out = b'data: {"choices":[{"delta":{"content":"a"}}]}\n\n: note\ndata: {"choices":[{"delta":{}}]}\ndata: {"choices":[{"delta":{"content":"b"}}]}\ndata: [DONE]\ndata: nothing\n'
        elif body["model"] == "refused":
            self.send_response(404)
            self.end_headers()
            self.wfile.write(b"no such model")
            return
        else:
            out = json.dumps({"choices": [{"message": {"content": " answer "}}]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def address():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_clients(address):
    c = chat.Chat(address, "m", "k")
    assert c("s", "p") == "answer"
    assert "".join(c.stream("s", "p")) == "ab"
    assert {a for _, _, a in Server.calls} == {"Bearer k"}
    v = embed.EndpointEmbedder(address, "e").embed(["x", "y"])
    assert np.allclose(v, [[0.6, 0.8], [0.6, 0.8]])
    see = chat.Transcriber(chat.Chat(address, "ok"), lambda d, p: b"png")
    assert see(b"", 1) == "answer"
    off = chat.Transcriber(chat.Chat(address, "refused"), lambda d, p: b"png")
    for _ in range(2):
        with pytest.raises(LookupError):
            off(b"", 1)
    with pytest.raises(ValueError, match="plain http"):
        chat.Chat("http://example.com", "m", "k")
    assert list(chat.deltas(io.BytesIO(b"data: [DONE]\n"))) == []


def test_progress_lines(spark):
    from pyspark.sql import functions as F

    from lodestack.functions import text

    rows = spark.createDataFrame([("embedding", 1400, 12345), ("extracting", 0, 0), ("x", 5, 5)], "p string, d long, t long")
    got = [r[0] for r in rows.select(text.progress_line(F.col("p"), F.col("d"), F.col("t"), "chunks")).collect()]
    assert got == ["embedding  [#·········]  11% · 1400/12.3k chunks", "extracting…", "x          [##########] 100% · 5/5 chunks"]
    eta = spark.createDataFrame([(5.0,), (44.0,), (150.0,)], "s double").select(text.eta_text(F.col("s"))).collect()
    assert [r[0] for r in eta] == ["almost done", "~40s left", "~3m left"]


def test_browse(tmp_path):
    for n in ("b.TXT", ".hidden.md", "c.jpg"):
        (tmp_path / n).write_text("x")
    (tmp_path / "A").mkdir()
    assert folder.browse(str(tmp_path)) == [("A", True), ("b.TXT", False)]
