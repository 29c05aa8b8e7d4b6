"""Encoders of text: a deterministic one for tests, an endpoint client, and an optional ONNX model."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import py_terms

BATCH = 64


class HashedEmbedder:
    """A vector of hashed terms, of length one; no terms give a zero vector. Needs no weights."""

    def __init__(self, dims: int = 256):
        self.dims, self.model = dims, f"hashed-terms/{dims}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, text in enumerate(texts):
            for t in py_terms(text):
                h = int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        return unit(out)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their lengths; zero rows stay."""
    n = np.linalg.norm(rows.astype(np.float64), axis=1, keepdims=True)
    return np.where(n == 0, rows, rows / np.where(n == 0, 1, n)).astype(np.float32)


class EndpointEmbedder:
    """A server with the common /embeddings call. Answers are put in order by their index and made unit length."""

    def __init__(self, base: str, model: str, key: str = "", timeout: float = 120):
        if not model:
            raise ValueError("an embedding endpoint needs a model's name")
        self.base, self.model, self.key, self.timeout = base.rstrip("/"), model, key, timeout

    def embed(self, texts: list[str]) -> np.ndarray:
        request = urllib.request.Request(f"{self.base}/embeddings", json.dumps({"model": self.model, "input": texts}).encode(), {"Content-Type": "application/json"})
        if self.key:
            request.add_header("Authorization", f"Bearer {self.key}")
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            data = json.load(answer)["data"]
        if len(data) != len(texts):
            raise ValueError(f"{len(data)} vectors for {len(texts)} texts")
        return unit(np.array([d["embedding"] for d in sorted(data, key=lambda d: d["index"])], np.float32))


class OnnxEmbedder:
    """A sentence encoder given as an ONNX file and a tokenizer file: mean of the last layer over tokens, unit length."""

    def __init__(self, model_path: str, tokenizer_path: str, name: str, max_tokens: int = 256):
        self.paths, self.model, self.max_tokens, self._loaded = (model_path, tokenizer_path), name, max_tokens, None

    def __getstate__(self):
        return {**self.__dict__, "_loaded": None}

    def _load(self):
        if self._loaded is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1
            tokenizer = Tokenizer.from_file(self.paths[1])
            tokenizer.enable_truncation(self.max_tokens)
            tokenizer.enable_padding()
            self._loaded = onnxruntime.InferenceSession(self.paths[0], options), tokenizer
        return self._loaded

    def embed(self, texts: list[str]) -> np.ndarray:
        session, tokenizer = self._load()
        encoded = tokenizer.encode_batch(texts)
        ids, mask = (np.array([getattr(e, k) for e in encoded], np.int64) for k in ("ids", "attention_mask"))
        feeds = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        states = session.run(None, {i.name: feeds[i.name] for i in session.get_inputs()})[0]
        weight = mask[:, :, None]
        return unit((states * weight).sum(1) / np.maximum(weight.sum(1), 1))


def choose(environment=os.environ):
    """The endpoint or the local encoder that the environment names, else None: keyword search only.

    LODESTACK_ENCODER is a folder with model.onnx and tokenizer.json, or with
    model.safetensors and vocab.txt (and config.json for the number of heads).
    """
    if base := environment.get("LODESTACK_EMBED_URL"):
        return EndpointEmbedder(base, environment.get("LODESTACK_EMBED_MODEL", ""), environment.get("LODESTACK_EMBED_KEY", ""))
    if at := environment.get("LODESTACK_ENCODER"):
        return local_encoder(at)
    return None


def local_encoder(folder: str):
    """The sentence encoder in a folder; ValueError if none is there."""
    at = lambda name: os.path.join(folder, name)
    name = os.path.basename(os.path.abspath(folder))
    if os.path.isfile(at("model.onnx")) and os.path.isfile(at("tokenizer.json")):
        return OnnxEmbedder(at("model.onnx"), at("tokenizer.json"), name)
    if not (os.path.isfile(at("model.safetensors")) and os.path.isfile(at("vocab.txt"))):
        raise ValueError(f"no encoder in {folder}")
    from .encoder import NumpyEmbedder, read_safetensors

    with open(at("model.safetensors"), "rb") as f:
        weights = read_safetensors(f.read())
    with open(at("vocab.txt"), encoding="utf-8") as f:
        vocabulary = {line.rstrip("\n"): n for n, line in enumerate(f)}
    heads = 12
    if os.path.isfile(at("config.json")):
        with open(at("config.json"), encoding="utf-8") as f:
            heads = json.load(f).get("num_attention_heads", heads)
    return NumpyEmbedder(weights, vocabulary, heads, name)


def embed_rows(rows: DataFrame, embedder, key: str = "sha", text: str = "text") -> DataFrame:
    """(key, vector) of rows (key, text), in batches within each task."""
    kind = dict(rows.dtypes)[key]

    def work(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), BATCH):
                made = embedder.embed(texts[at : at + BATCH])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(made)), pa.array([v.tolist() for v in made], pa.list_(pa.float32()))], names=[key, "vector"])

    return rows.select(key, text).mapInArrow(work, f"{key} {kind}, vector array<float>")


def embedder_for(embedder) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: embed_rows(rows, embedder)


def basic_tokens(text: str) -> list[str]:
    """Words and marks of a lower-case encoder: controls gone, CJK and punctuation apart, accents stripped."""
    import unicodedata

    out, word = [], []

    def end():
        if word:
            out.append("".join(word))
            word.clear()

    for ch in unicodedata.normalize("NFD", "".join(c if c.isspace() else c.lower() for c in text)):
        kind, code = unicodedata.category(ch), ord(ch)
        if ch in "\t\n\r" or kind == "Zs":
            end()
        elif code in (0, 0xFFFD) or kind in ("Cc", "Cf", "Mn"):
            continue
        elif kind[0] == "P" or (kind[0] == "S" and code < 128) or 0x4E00 <= code <= 0x9FFF or 0x3400 <= code <= 0x4DBF or 0x20000 <= code <= 0x2CEAF or 0xF900 <= code <= 0xFAFF:
            end()
            out.append(ch)
        else:
            word.append(ch)
    end()
    return out


def word_pieces(word: str, vocabulary: set[str] | dict, unknown: str = "[UNK]", most: int = 100) -> list[str]:
    """Longest pieces of a word from its front, later ones with ##; an unknown or over-long word is one unknown piece."""
    if len(word) > most:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [unknown]
    return out


def encode(text: str, vocabulary: dict[str, int], most: int = 256) -> list[int]:
    """Ids of a text between the marks of its beginning and end, at most `most` in all."""
    pieces = [p for w in basic_tokens(text) for p in word_pieces(w, vocabulary)]
    return [vocabulary[p] for p in ("[CLS]", *pieces[: most - 2], "[SEP]")]
