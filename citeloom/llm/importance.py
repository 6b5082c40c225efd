"""Importance resampling towards a target distribution over hashed word runs.

Every text is a bag of features, its runs of 1 to NGRAM words, each of which falls into one of BUCKETS buckets by CRC-32.
How much likelier a bucket is in the target than in the corpus is its gain, a text's weight is the mean gain of its
features, and a document's score is its weight with Gumbel noise of its doc_id: the highest scores are a sample without
replacement by weight. Texts are scored as arrays: all words of a block of texts advance one byte at a time.

Ranks come by parallel sorting by regular sampling: runs are sorted where they are, every so manieth key of a run is a
regular sample, the samples' quantiles split the keys into segments, segments are exchanged and merged where they arrive,
and the segments' prefix counts make local places ranks. Keys are unique, so no segment is larger than its share and a
stride of every run.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import in_python, parts, shuffle_partitions, spread, written

NGRAM = 2
BUCKETS = 10_000
LEAST_WORDS = 20  # of a document that can be drawn
PERCENT = 25
SEED = 7
SAMPLES = 1_000_000  # regular samples at most, beside one a run
BLOCK_BYTES = 4 << 20  # of texts whose words are in memory at once; a longer text is read in pieces of so many
STEPPED = 64  # bytes of a word that all words step through together
_full = np.uint32(0xFFFFFFFF)
_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_is_word = np.array([c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" for c in range(256)])
_break = re.compile(rb"[^0-9a-z\x80-\xff]").search
_step = np.arange(256, dtype=np.uint32)  # what a byte does to a CRC-32 state
for _ in range(8):
    _step = (_step >> 1) ^ (np.uint32(0xEDB88320) * (_step & 1))


def fed(state: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the bytes flat[start : start + length] of each; a state is a CRC-32 with all bits flipped."""
    order = np.argsort(-length, kind="stable")
    at, size, out = start[order], -length[order], state[order]
    for i in range(min(STEPPED, int(-size[0]) if len(size) else 0)):
        m = np.searchsorted(size, -i, side="left")  # those that are longer than i
        out[:m] = _step[(out[:m] ^ flat[at[:m] + i]) & 0xFF] ^ (out[:m] >> 8)
    for k in range(int(np.searchsorted(size, -STEPPED, side="left"))):
        rest = flat[at[k] + STEPPED : at[k] - size[k]].tobytes()
        out[k] = zlib.crc32(rest, int(out[k] ^ _full)) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def _back(data: bytes, end: int, words: int) -> tuple[int, int]:
    """(where the last `words` words before end begin, how many there are)."""
    for n in range(words):
        head = end
        while head and not _is_word[data[head - 1]]:
            head -= 1
        if not head:
            return end, n
        while head and _is_word[data[head - 1]]:
            head -= 1
        end = head
    return end, words


def pieces(text: str | None, ngram: int, most: int = BLOCK_BYTES) -> Iterator[tuple[bytes, int]]:
    """A text's bytes in lower case, in pieces of some `most` bytes cut between words, each with how many of its first
    words stand in the piece before too, which runs of `ngram` words across the cut need."""
    data, begin = (text or "").encode("utf-8", "replace").translate(_lower), 0
    while True:
        cut = _break(data, begin + most) if len(data) - begin > most else None
        end = cut.start() if cut else len(data)
        head, carried = _back(data, begin, ngram - 1)
        yield data[head:end], carried
        if not cut:
            return
        begin = end


class Runs:
    """The runs of a block of text pieces: crc (CRC-32) and owner (number of the text) of each, and the words of each text."""

    def __init__(self, block: list[tuple[int, bytes, int]], ngram: int):
        data = b" ".join(d for _, d, _ in block) + b" "
        flat = np.frombuffer(data, np.uint8)
        on = _is_word[flat]
        edge = np.flatnonzero(np.diff(np.r_[False, on].astype(np.int8)))
        start, length = edge[::2], edge[1::2] - edge[::2]
        sizes = np.array([len(d) + 1 for _, d, _ in block])
        piece = np.searchsorted(np.cumsum(sizes), start, side="right")
        first = np.searchsorted(piece, np.arange(len(block)))
        carried = np.array([c for _, _, c in block])
        again = np.arange(len(start)) < (first + carried)[piece]  # words of the piece before
        text = np.array([i for i, _, _ in block])[piece] if len(block) else piece
        self.words = text[~again]
        crc, owner, state = [], [], np.full(len(start), _full)
        for k in range(ngram):
            n = len(start) - k
            if n <= 0:
                break
            if k:
                state = _step[(state[:n] ^ np.uint32(0x20)) & 0xFF] ^ (state[:n] >> 8)
            state = fed(state, flat, start[k:], length[k:])
            whole = (piece[:n] == piece[k:]) & ~again[k:]
            crc.append(state[whole] ^ _full)
            owner.append(text[:n][whole])
        self.crc = np.concatenate(crc) if crc else np.empty(0, np.uint32)
        self.owner = np.concatenate(owner) if owner else np.empty(0, np.int64)


def blocks(texts: list[str | None], ngram: int, most: int = BLOCK_BYTES) -> Iterator[Runs]:
    """The runs of texts, some bytes at a time."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for data, carried in pieces(text, ngram, most):
            block.append((i, data, carried))
            size += len(data)
            if size >= most:
                yield Runs(block, ngram)
                block, size = [], 0
    if block:
        yield Runs(block, ngram)


def bucket_counts(docs: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts each bucket holds. Tasks add up their own, and their sums are shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in parts(batches):
            for runs in blocks(b.column(0).to_pylist(), ngram):
                total += np.bincount(runs.crc % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return in_python(spread(docs.select("text")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket; the driver gets the two counts of each bucket."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (corpus, target))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    value = lambda b: math.log(((t.get(b, 0) + 1.0) * (whole_s + buckets)) / ((s.get(b, 0) + 1.0) * (whole_t + buckets)))
    return np.array([math.floor(1000 * value(b)) for b in range(buckets)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A document's Gumbel noise in thousandths, from the SHA-256 of seed and doc_id (null: none)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, n_words, weight) per row of docs; a text without features weighs 0."""
    buckets = len(gain)
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), "text"))

    def run(batches):
        for b in parts(batches):
            n, words, total = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for runs in blocks(b.column(1).to_pylist(), ngram):
                n += np.bincount(runs.owner, minlength=b.num_rows)
                words += np.bincount(runs.words, minlength=b.num_rows)
                total += np.bincount(runs.owner, gain[runs.crc % buckets], b.num_rows).astype(np.int64)
            mean = total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, words, mean))], ["doc_id", "n_features", "n_words", "weight"])

    return in_python(rows, run, "doc_id long, n_features long, n_words long, weight long")


_KEYS = ["k0", "k1", "k2", "k3", "k4"]


def _numbers(b: pa.RecordBatch) -> np.ndarray:
    """(keys, rows)"""
    return np.array([b.column(c).to_numpy(zero_copy_only=False) for c in _KEYS])


def _segments(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """How many splitters come before each key or are equal to it."""
    both = np.concatenate([splitters, keys], axis=1)
    split = np.r_[np.ones(splitters.shape[1], bool), np.zeros(keys.shape[1], bool)]
    order = np.lexsort((~split, *both[::-1]))
    passed = np.cumsum(split[order])
    out = np.empty(len(order), np.int64)
    out[order] = passed
    return out[splitters.shape[1] :]


def ranked(rows: DataFrame, total: int, samples: int = SAMPLES) -> DataFrame:
    """rows (k0 .. k4, all long, together unique) with rank, their place from 1 in the order of these keys.

    rows are read twice and must give the same both times, as those of a written table do. The driver gets the regular
    samples (`samples` at most and one a run), splitters and a count of each segment.
    """
    spark = rows.sparkSession
    runs = rows.sortWithinPartitions(*_KEYS)
    n_runs, n_segments = max(1, rows.rdd.getNumPartitions()), shuffle_partitions(spark)
    stride = max(1, -(-total // min(samples, n_runs * n_segments * 4)))

    def regular(batches):
        ahead = 0
        for b in batches:
            at = np.arange(-ahead % stride, b.num_rows, stride)
            ahead += b.num_rows
            yield b.take(pa.array(at))

    keys = ", ".join(f"{c} long" for c in _KEYS)
    picked = in_python(runs.select(_KEYS), regular, keys).toArrow()
    found = np.array([picked.column(c).to_numpy() for c in _KEYS]).reshape(len(_KEYS), -1)
    found = found[:, np.lexsort(found[::-1])]
    splitters = found[:, [found.shape[1] * i // n_segments for i in range(1, n_segments)]] if found.shape[1] >= n_segments else found[:, :0]

    def cut(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_segments(_numbers(b), splitters), pa.int32())], [*b.schema.names, "segment"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    cut_runs = in_python(runs, cut, f"{fields}, segment int")
    sizes = dict(cut_runs.groupBy("segment").count().collect())
    ahead_of, ahead = {}, 0
    for s in range(n_segments):
        ahead_of[s] = ahead
        ahead += sizes.get(s, 0)
    merged = cut_runs.repartitionById(n_segments, F.col("segment")).sortWithinPartitions("segment", *_KEYS)

    def number(batches):
        current, nth = -1, 0
        for b in batches:
            segment = b.column("segment").to_numpy()
            rank = np.empty(len(segment), np.int64)
            for s in np.unique(segment).tolist():  # a batch may end one segment and begin another
                own = np.flatnonzero(segment == s)
                nth = nth if s == current else 0
                rank[own] = ahead_of[s] + nth + 1 + np.arange(len(own))
                current, nth = s, nth + len(own)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rank)], [*b.schema.names[:-1], "rank"])

    return in_python(merged, number, f"{fields}, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row of docs, drawn towards the texts of target (text).

    Of the documents with least_words words, `percent` of a hundred are drawn, rounded down: those of the highest scores,
    ties to the smaller doc_id (null last; rows that tie in that too by their features, then in the order in which they are
    read). rank counts them from 1 and is null for all others. Null and empty texts have no features and weigh 0. Repeated
    and null doc_ids are rows of their own; further columns are not read. Without documents there are no rows; without
    target texts all buckets have the gain of none.
    """
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets), buckets)
    scored = weights(docs, gain, ngram).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored.withColumn("no", F.monotonically_increasing_id()), "scored")
    can = scored.where(F.col("n_words") >= least_words)
    total = can.count()
    keys = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("n_features"), F.col("no")]
    order = ranked(can.select(*(k.alias(c) for k, c in zip(keys, _KEYS, strict=True)), "doc_id", "weight"), total)
    order = order.select("doc_id", F.col("k3").alias("n_features"), "weight", (-F.col("k0")).alias("score"), F.when(F.col("rank") <= total * percent // 100, F.col("rank")).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return order.unionByName(rest)
