"""Quality by compression: a text is closer to the labelled texts whose dictionary shrinks it more.

Two zstandard dictionaries are built, of good and of bad labelled texts. A text is cut into pieces that are compressed
each by itself with either dictionary, so a dictionary counts as much at a long text's end as at its start. The
difference of the two compressed sizes over their sum is the text's value, and a logistic curve makes it a probability.
The curve is fitted to values of texts that the dictionaries of the moment haven't seen: each fold of the labelled texts
is compressed with dictionaries of the other folds.
"""

from __future__ import annotations

import contextlib
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import drawn, held, in_python, parts, sampled, scratch, spread

PIECE = 1024  # bytes that are compressed at once
LEVEL = 3
DICTIONARY = 112 << 10  # bytes of a dictionary
SEGMENT = 256  # bytes of a sample that a dictionary takes at once
LEAST = 16 << 10  # bytes of samples that a dictionary can be trained on
LINES = 8  # lines of a sample that a dictionary is trained on
SAMPLE = 3000  # labelled texts of either class at most
SAMPLE_PIECES = 8  # pieces of a text at most that a dictionary is built of
FOLDS = 3


def data_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def cut(data: bytes, piece: int = PIECE) -> list[bytes]:
    """A text's bytes in pieces of nearly equal length, `piece` at most."""
    n = -(-len(data) // piece)
    return [data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary of sample pieces, of at most a quarter of their bytes; of samples too few to train one, their
    own bytes."""
    total = sum(map(len, samples))
    if total >= LEAST and len(samples) >= 8:
        with contextlib.suppress(zstandard.ZstdError):  # samples that have nothing in common
            return zstandard.train_dictionary(min(size, total // 4), samples, k=SEGMENT, d=8, level=LEVEL).as_bytes()
    return b"".join(samples)[-size:]


class Compressor:
    """Compressed sizes under one dictionary."""

    def __init__(self, content: bytes):
        kind = zstandard.DICT_TYPE_AUTO if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        found = zstandard.ZstdCompressionDict(content, dict_type=kind) if content else None
        if found:
            found.precompute_compress(level=LEVEL)
        self._compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def size(self, pieces: list[bytes]) -> int:
        return sum(len(self._compress(p)) for p in pieces)


class Judge:
    """Scores texts by a model: the contents of both dictionaries and the curve's slope and offset."""

    def __init__(self, model: dict):
        self.good, self.bad = Compressor(model["good"]), Compressor(model["bad"])
        self.slope, self.offset = model["curve"]

    def value(self, text: str | None) -> float:
        """-1 to 1, above 0 where the good dictionary does better; 0 for an empty text."""
        pieces = cut(data_of(text))
        good, bad = self.good.size(pieces), self.bad.size(pieces)
        return (bad - good) / max(1, bad + good)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.value(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on x, by Newton steps with a small penalty on the scaled slope."""
    scale = float(np.abs(x).max()) or 1.0
    a, w = np.c_[x / scale, np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 0.05 * w
        h = (a.T * (weight * p * (1 - p))) @ a + 0.05 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -4, 4)
    return float(w[0] / scale), float(w[1])


def _built(pieces: list[list[bytes]], labels: np.ndarray, kept: np.ndarray) -> dict:
    """The dictionaries of the texts kept. Lines that both classes hold tell nothing and are left out; lines that a class
    repeats count once."""
    lines = [dict.fromkeys(line for i in np.flatnonzero(kept & (labels == y)) for p in pieces[i] for line in p.splitlines(keepends=True)) for y in (0, 1)]
    both = lines[0].keys() & lines[1].keys()
    bad, good = ([line for line in own if line not in both] for own in lines)
    joined = lambda own: [b"".join(own[i : i + LINES]) for i in range(0, len(own), LINES)]
    return {"good": dictionary(joined(good)), "bad": dictionary(joined(bad)), "curve": (1.0, 0.0)}


def fit(pieces: list[list[bytes]], labels: list[int], totals: tuple[int, int] | None = None, folds: int = FOLDS) -> dict:
    """A model of labelled texts (1: good), each by some pieces of it. totals: how many texts of either class there are, if
    these are a sample that holds another share of them. With texts of one class only, or none, all texts get that class's
    score, or a half."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return {"good": b"", "bad": b"", "curve": (0.0, 0.0 if not labels else 6.0 if labels[0] else -6.0)}
    fold = np.empty(len(y), np.int64)
    for c in (0, 1):  # both classes in all folds
        fold[own] = np.arange(len(own := np.flatnonzero(y == c))) % folds
    values = np.zeros(len(y))
    for k in range(folds):
        judge = Judge(_built(pieces, y, fold != k))
        for i in np.flatnonzero(fold == k):
            good, bad = judge.good.size(pieces[i]), judge.bad.size(pieces[i])
            values[i] = (bad - good) / max(1, bad + good)
    model = _built(pieces, y, np.ones(len(y), bool))
    share = np.array(totals or (1, 1)) / (np.bincount(y, minlength=2) if totals else 1)
    model["curve"] = _logistic(values, y, (share / share.max())[y])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 over 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def samples_of(text: str, most: int = SAMPLE_PIECES) -> list[bytes]:
    """At most so many pieces of a text, at places drawn by its bytes."""
    data = data_of(text)
    own = cut(data)
    if len(own) <= most:
        return own
    places = np.random.default_rng(crc32(data)).choice(len(own), most, replace=False)
    return [own[i] for i in np.sort(places).tolist()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, per_text: int = SAMPLE_PIECES) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, quality): of either class `sample` texts at most, those whose
    ids have the smallest hashes, and `per_text` pieces of PIECE bytes of each, which executors cut. Rows that repeat an
    id and a text count once, as do repeated labels, a bad one first; null ids, texts and labels are left out, and so are
    empty texts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    known = known.where(~held_out(F.col("doc_id")))
    totals = dict(known.groupBy("good").count().collect())
    ids = drawn(known.withColumn("h", F.xxhash64("doc_id")), "good", ["h"], sample).select("doc_id", "good")
    def run(batches):
        for b in batches:
            own = [samples_of(t, per_text) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(own, pa.list_(pa.binary()))], ["h", "digest", "good", "pieces"])

    with scratch(docs.sparkSession):
        rows = sampled(docs.select("doc_id", "text").where(F.length("text") > 0), ids, ["doc_id"], "good", sample)
        cuts = in_python(rows.select("h", F.xxhash64("text"), "good", "text"), run, "h long, digest long, good int, pieces array<binary>")
        found = sorted((r["h"], r["digest"], r["good"], [bytes(p) for p in r["pieces"]]) for r in cuts.collect())
    return fit([r[3] for r in found], [r[2] for r in found], (totals.get(0, 1), totals.get(1, 1)))


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) per row of docs from its whole text; null and empty texts have the score of value 0. Repeated and
    null doc_ids are rows of their own; other columns are not read; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, model))
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches):
        name, own = shared.value
        judge = held("quality", name, lambda: Judge(own))
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(judge.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return in_python(rows, run, "doc_id long, score double")
