"""Embeddings: a table of given vectors, a hashing embedder for tests, or a model file for onnxruntime."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.workers import with_python_path

DIM = 384
ROWS = 500  # texts that an embedding function gets at once


def fingerprint(backend: str, model: str, dim: int) -> str:
    return f"{backend}:{model}:{dim}"


def precomputed(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """rows with the embedding of the same key; null where there is none."""
    return rows.join(vectors.select(key, "embedding"), key, "left")


_words = re.compile(r"[^\x20\x09-\x0D]+").findall


def hashing_vectors(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """Unit vectors of signed word hashes; zero for texts without words. The first eight hex digits of a word's MD5 give its
    place, the ninth its sign."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        for word in _words((text or "").lower()):
            digest = hashlib.md5(word.encode()).hexdigest()
            out[i, int(digest[:8], 16) % dim] += 1 if digest[8] >= "8" else -1
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.where(norm == 0, 1, norm)).astype(np.float32)


def encode_texts(encode: Callable, texts: Iterable[str]) -> list[list[float]]:
    """The vectors of texts as lists of floats, whatever number type the embedding function gives."""
    return [[float(x) for x in vector] for vector in encode(list(texts))]


def embedder(backend: str, model: str = "", dim: int = DIM) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A loader of an embedding function for a task; raises for an unknown backend."""
    name = backend.lower()
    if name == "hashing":
        return lambda: lambda texts: hashing_vectors(texts, dim)
    if name in ("onnx", "default"):
        return lambda: _onnx(model)
    raise ValueError(f"unknown embedding backend: {backend}")


def _onnx(model: str):
    import onnxruntime
    from tokenizers import Tokenizer

    session, tokenizer = onnxruntime.InferenceSession(f"{model}/model.onnx"), Tokenizer.from_file(f"{model}/tokenizer.json")
    tokenizer.enable_padding()
    tokenizer.enable_truncation(256)

    def run(texts: list[str]) -> np.ndarray:
        got = tokenizer.encode_batch([t or "" for t in texts])
        ids, mask = np.array([g.ids for g in got]), np.array([g.attention_mask for g in got])
        states = session.run(None, {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)})[0]
        mean = (states * mask[..., None]).sum(axis=1) / mask.sum(axis=1, keepdims=True)
        return mean / np.linalg.norm(mean, axis=1, keepdims=True)

    return run


def embed(rows: DataFrame, load: Callable, text: str = "text") -> DataFrame:
    """rows with `embedding`; the function is loaded once a task and gets ROWS texts at a time, however many an Arrow batch has."""
    columns = [c for c in rows.columns if c != "embedding"]

    def run(batches):
        function = None
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            function = function or load()
            vectors = np.asarray(function(b.column(columns.index(text)).to_pylist()), np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], [*columns, "embedding"])

    with_python_path(rows.sparkSession)
    plain = rows.select(columns)
    return plain.mapInArrow(run, plain.select("*", F.lit(None).cast("array<float>").alias("embedding")).schema)
