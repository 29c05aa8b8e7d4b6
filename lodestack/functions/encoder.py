"""A sentence encoder in numpy: weights from safetensors files, and the forward pass of a BERT-like model."""

from __future__ import annotations

import json
import math
import struct

import numpy as np

from .embed import encode, unit

#: Little-endian element types that are read; others are passed over.
KINDS = {"F32": "<f4", "I8": "i1"}
EPS = 1e-12


def read_safetensors(data: bytes) -> dict[str, np.ndarray]:
    """Tensors by name. I8 tensors are scaled by the rows of `<name>.scale`. ValueError for a broken file."""
    if len(data) < 8:
        raise ValueError("no header length")
    size = struct.unpack("<Q", data[:8])[0]
    if size > len(data) - 8:
        raise ValueError("the header is longer than the file")
    header, body = json.loads(data[8 : 8 + size]), memoryview(data)[8 + size :]
    out = {}
    for name, info in header.items():
        if name == "__metadata__" or info["dtype"] not in KINDS:
            continue
        begin, end = info["data_offsets"]
        kind = np.dtype(KINDS[info["dtype"]])
        if not 0 <= begin <= end <= len(body) or end - begin != kind.itemsize * math.prod(info["shape"]):
            raise ValueError(f"{name} lies outside the file")
        out[name] = np.frombuffer(body[begin:end], kind).reshape(info["shape"])
    for name in [n for n, t in out.items() if t.dtype == np.int8]:
        if f"{name}.scale" not in out:
            raise ValueError(f"{name} has no scale")
        out[name] = out[name].astype(np.float32) * out[f"{name}.scale"].reshape(-1, *[1] * (out[name].ndim - 1))
    return {n: t for n, t in out.items() if not n.endswith(".scale")}


def write_safetensors(tensors: dict[str, np.ndarray]) -> bytes:
    header, parts, at = {}, [], 0
    for name, t in tensors.items():
        raw = np.ascontiguousarray(t).tobytes()
        header[name] = {"dtype": "I8" if t.dtype == np.int8 else "F32", "shape": list(t.shape), "data_offsets": [at, at + len(raw)]}
        parts.append(raw)
        at += len(raw)
    head = json.dumps(header).encode()
    return struct.pack("<Q", len(head)) + head + b"".join(parts)


def quantized(tensors: dict[str, np.ndarray], least: int = 100_000) -> dict[str, np.ndarray]:
    """Matrices of at least `least` numbers as int8 with a scale a row; halves round to even."""
    out = {}
    for name, t in tensors.items():
        if t.ndim == 2 and t.size >= least:
            scale = np.abs(t).max(1) / 127
            scale = np.where(scale == 0, 1, scale).astype(np.float32)
            out[name], out[f"{name}.scale"] = np.rint(t / scale[:, None]).astype(np.int8), scale
        else:
            out[name] = t.astype(np.float32)
    return out


#: Abramowitz and Stegun 7.1.26 isn't exact enough for the encoder's bound, so erf is taken value by value.
_erf = np.vectorize(math.erf, otypes=[np.float32])


def _norm(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    mean = x.mean(-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + EPS) * w[f"{name}.weight"] + w[f"{name}.bias"]


def _linear(x: np.ndarray, w: dict, name: str) -> np.ndarray:
    return x @ w[f"{name}.weight"].T + w[f"{name}.bias"]


def forward(ids: list[int], w: dict[str, np.ndarray], heads: int) -> np.ndarray:
    """The unit-length mean of the last layer over a text's tokens."""
    n = len(ids)
    x = w["embeddings.word_embeddings.weight"][ids] + w["embeddings.position_embeddings.weight"][:n] + w["embeddings.token_type_embeddings.weight"][0]
    x = _norm(x, w, "embeddings.LayerNorm")
    depth, layer = x.shape[1] // heads, 0
    while f"encoder.layer.{layer}.attention.self.query.weight" in w:
        at = f"encoder.layer.{layer}"
        q, k, v = (_linear(x, w, f"{at}.attention.self.{part}").reshape(n, heads, depth).transpose(1, 0, 2) for part in ("query", "key", "value"))
        scores = q @ k.transpose(0, 2, 1) / math.sqrt(depth)
        scores = np.exp(scores - scores.max(-1, keepdims=True))
        mixed = (scores / scores.sum(-1, keepdims=True) @ v).transpose(1, 0, 2).reshape(n, -1)
        x = _norm(x + _linear(mixed, w, f"{at}.attention.output.dense"), w, f"{at}.attention.output.LayerNorm")
        inner = _linear(x, w, f"{at}.intermediate.dense")
        inner = inner * 0.5 * (1 + _erf(inner / math.sqrt(2)))
        x = _norm(x + _linear(inner, w, f"{at}.output.dense"), w, f"{at}.output.LayerNorm")
        layer += 1
    return unit(x.mean(0)[None])[0]


class NumpyEmbedder:
    """An embedder over weights in memory; Spark sends it to the tasks with the function that uses it."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: dict[str, int], heads: int, name: str, max_tokens: int = 256):
        self.weights, self.vocabulary, self.heads, self.model, self.max_tokens = weights, vocabulary, heads, name, max_tokens

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.stack([forward(encode(t, self.vocabulary, self.max_tokens), self.weights, self.heads) for t in texts])
