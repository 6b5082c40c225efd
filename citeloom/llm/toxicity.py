"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel with Nystroem landmarks.

The kernel of two words sums over all subsequences of ORDER letters, each weighted by DECAY to the power of the span
that it takes in either word, so a letter put between or left out changes a word's value by a factor and not to zero.
Landmark words span the Nystroem space in which a linear machine is trained. As the kernel is a sum over subsequences,
the landmarks' weighted sum folds into one table of a weight per subsequence, and a word is scored by adding up table
values. Labels are given for texts: training takes the sentences' words as instances and, round by round, the best
words of each toxic text as its positive ones. A text's score comes from its highest-scoring words by a logistic curve.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations, pairwise
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.shared import drawn, held, in_python, parts, release, sampled, scratch, spread, written

ORDER, DECAY = 3, 0.6
WINDOW = 16  # longer words are scored by windows of so many characters, half of them new
LANDMARKS = 256
FEATURED = 64  # words whose kernel values are made at once
AT_ONCE = 4096  # words that training makes values of at once
CHANCE = 1e-5
POOL = 150_000  # clean words at most that training looks at
SAMPLE = 3000  # training texts of either class at most
CLEAN_WORDS = 40_000  # clean training words in a round at most, beside those that earlier rounds found hard
MEMO_WORDS = 300_000
EDGE, DIGIT, OTHER, ACCENTED = 27, 28, 29, 30
_single = re.compile(r"(?:(?<!\S)\S\s+){3,}\S(?!\S)").finditer
_space = re.compile(r"\s+").sub
_inner = re.compile(r"[\W_]+").sub
_runs = re.compile(r"(.)\1{2,}").sub
_outer = " \t\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class _Codes(dict):
    """Characters' kernel letters, as code points below 32."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        code = point - 96 if "a" <= c <= "z" else EDGE if not point else DIGIT if c.isdigit() else ACCENTED if c.isalpha() else OTHER
        self[point] = code
        return code


_codes = _Codes()


def forms(token: str) -> tuple[str, ...]:
    """What is scored for a token in lower case: it without outer signs and with no character more than twice in a row,
    and that without inner signs too."""
    word = _runs(r"\1\1", token.strip(_outer))
    if word.isalnum():
        return (word,)
    bare = _inner("", word)
    return (word, bare) if bare and bare != word else (word,) if word else ()


def tokens(text: str | None) -> set[str]:
    """The distinct tokens of a text in lower case, with runs of four or more single characters joined to tokens too."""
    if not text:
        return set()
    low = text.lower()
    found = set(low.split())
    if sum(map((1).__eq__, map(len, found))) > 2:
        found |= {_space("", m[0]) for m in _single(low)}
    return found


def units(text: str | None) -> set[str]:
    """All strings of a text that are scored."""
    return {w for t in tokens(text) for w in forms(t)}


@lru_cache(64)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All ORDER places in n characters, and the weight of each: DECAY to the span."""
    at = np.array(list(combinations(range(n), ORDER)), np.int64).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1.0)).astype(np.float32)


def _normed(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weights of each row's codes over the root of the row's kernel with itself."""
    key = np.sort(code.astype(np.int64) << 16 | np.arange(code.shape[1]), axis=1)
    ranked, w = key >> 16, weight[key & 0xFFFF]
    new = np.c_[np.ones((len(code), 1), bool), ranked[:, 1:] != ranked[:, :-1]]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    row = np.nonzero(new)[0]
    norm = np.sqrt(np.bincount(row, sums * sums, len(code)))
    return (weight / norm[:, None]).astype(np.float32)


def _pieces(word: str) -> list[str]:
    marked = f"\0{word}\0"
    if len(marked) <= WINDOW:
        return [marked]
    return [marked[i : i + WINDOW] for i in range(0, len(marked) - WINDOW // 2, WINDOW // 2)]


def subsequences(pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of equal length, some at a time: (their places in the list, subsequence codes, weights)."""
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        by_length.setdefault(len(p), []).append(i)
    for n, own in by_length.items():
        if n < ORDER:
            continue
        at, weight = _places(n)
        for s in range(0, len(own), max(1, 500_000 // len(at))):
            some = own[s : s + max(1, 500_000 // len(at))]
            letters = np.frombuffer("".join([pieces[i] for i in some]).translate(_codes).encode("latin-1"), np.uint8).reshape(-1, n).astype(np.int32)
            code = letters[:, at[:, 0]]
            for k in range(1, ORDER):
                code = code * 32 + letters[:, at[:, k]]
            yield np.array(some), code, _normed(code, weight)


def features(words: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values (words, landmarks); landmarks is a table (32**ORDER, m). Of a long word's windows the mean."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        own = _pieces(w)
        pieces += own
        owner += [i] * len(own)
    out = np.zeros((len(pieces), landmarks.shape[1]), np.float32)
    for some, code, weight in subsequences(pieces):
        for s in range(0, len(some), FEATURED):
            out[some[s : s + FEATURED]] = np.einsum("wjm,wj->wm", landmarks[code[s : s + FEATURED]], weight[s : s + FEATURED])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return np.add.reduceat(out, first, axis=0) / np.diff(np.r_[first, len(owner)])[:, None] if len(words) else np.zeros((0, landmarks.shape[1]))


def table_of(words: list[str]) -> np.ndarray:
    """(32**ORDER, words): each word's weighted subsequences, of a long word's windows the mean."""
    pieces, owner = [], []
    for i, w in enumerate(words):
        own = _pieces(w)
        pieces += own
        owner += [i] * len(own)
    share = (1 / np.bincount(owner, minlength=len(words))).astype(np.float32) if words else np.empty(0, np.float32)
    table = np.zeros((32**ORDER, len(words)), np.float32)
    for some, code, weight in subsequences(pieces):
        for k, row, w in zip(some, code, weight, strict=True):
            np.add.at(table[:, owner[k]], row, w * share[owner[k]])
    return table


def svm(blocks: list[tuple[np.ndarray, float, np.ndarray]], c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """A linear machine's weights, the last one its bias: squared hinge loss, by Newton steps. blocks: (rows, their label,
    a weight for each), of which no joint copy is made."""
    n = blocks[0][0].shape[1]
    w = np.zeros(n + 1)
    for _ in range(rounds):
        h, g = np.eye(n + 1), np.zeros(n + 1)
        for z, t, weight in blocks:
            on = t * (z @ w[:-1] + w[-1]) < 1
            a, k = np.c_[z[on], np.ones(on.sum())].astype(np.float64), c * weight[on]
            h += (a.T * k) @ a
            g += a.T @ (k * t)
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _gapped(words: list[str], rng) -> list[str]:
    """The words with a sign or letter put in at one or two places, two of each."""
    out = []
    for w in words:
        if len(w) >= 4:
            for _ in range(2):
                v = w
                for _ in range(rng.integers(1, 3)):
                    at = int(rng.integers(1, len(v)))
                    v = v[:at] + str(rng.choice(list("*.-_'xeh0"))) + v[at:]
                out.append(v)
    return out


def marks_of(text: str | None) -> list[int]:
    """The four smallest word-pair digests of a text; near copies have some in common."""
    words = (text or "").lower().split()
    return sorted({crc32(f"{a} {b}".encode()) for a, b in pairwise(words)})[:4]


def _apart(marks: list[list[int]]) -> list[int]:
    """The places of texts that are no near copies of earlier ones: no mark in common."""
    seen: set[int] = set()
    kept = []
    for i, own in enumerate(marks):
        if not seen.intersection(own):
            kept.append(i)
        seen.update(own)
    return kept


def _at_once(of, words: list[str], places: np.ndarray) -> list[np.ndarray]:
    """of(words), for some words at a time."""
    return [of([words[i] for i in places[s : s + AT_ONCE]]) for s in range(0, max(1, len(places)), AT_ONCE)]


def learned(words: list[str], sets: list[np.ndarray], labels: list[int], rounds: int = 3, seed: int = 7) -> dict:
    """A model of texts of both classes, each by its units(): their ascending places in words, which are ascending too, so
    that four bytes stand for each word of a text."""
    rng, n = np.random.default_rng(seed), len(words)
    toxic = [s for s, y in zip(sets, labels, strict=True) if y]
    in_clean, in_toxic = np.zeros(n, bool), np.zeros(n, np.int64)
    for s, y in zip(sets, labels, strict=True):
        if y:
            in_toxic[s] += 1
        else:
            in_clean[s] = True
    count = np.where(in_clean, 0, in_toxic)  # of fresh words, those of toxic texts alone
    # Words that so many toxic texts and no clean one hold that chance is out of question are the first positive ones.
    share = len(toxic) / max(1, len(sets))
    least = max(3, int(np.ceil(np.log(CHANCE) / np.log(max(1e-3, min(share, 0.9))))))
    is_sure = count >= least if (count >= least).any() else (count == count.max(initial=0)) & (count > 0)
    sure = np.flatnonzero(is_sure)
    open_texts, is_plain = [], np.zeros(n, bool)  # the other words of the texts that hold a sure one
    for s in toxic:
        if is_sure[s].any():
            is_plain[s] = True
        else:
            open_texts.append(s)
    pool = np.r_[np.flatnonzero(in_clean), np.flatnonzero(is_plain & (count > 0) & ~is_sure)]
    if len(pool) > POOL:
        pool = pool[np.sort(rng.choice(len(pool), POOL, replace=False))]
    marked = sure if len(sure) <= LANDMARKS // 2 else np.random.default_rng(seed).choice(sure, LANDMARKS // 2, replace=False)
    landmarks = np.unique(np.r_[marked, pool[rng.choice(len(pool), min(len(pool), LANDMARKS // 2), replace=False)]]) if len(pool) else sure
    base = table_of([words[i] for i in landmarks])
    values, vectors = np.linalg.eigh((base.T @ base).astype(np.float64))
    keep = values > 1e-4 * values[-1]
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def rows(own: list[str]) -> np.ndarray:
        return features(own, base) @ root

    some = pool[rng.choice(len(pool), min(len(pool), CLEAN_WORDS // 2), replace=False)]
    clean = _at_once(rows, words, some)
    negative = np.zeros(n, bool)
    negative[some] = True
    positive = sure
    for step in range(rounds):
        every = [words[i] for i in positive]
        every += _gapped(every, rng)
        at = [bisect_left(words, w) for w in every]
        own = np.array([min(50.0, float(count[i])) if i < n and words[i] == w and count[i] else 2.0 for i, w in zip(at, every, strict=True)])
        w = svm([*((z, -1.0, np.ones(len(z))) for z in clean), (rows(every), 1.0, own)])
        model = {"table": (base @ (root @ w[:-1]).astype(np.float32)).astype(np.float32), "bias": float(w[-1]), "curve": (1.0, 0.0)}
        scorer = Scorer(model)
        if step == rounds - 1:
            break
        # The clean words that score highest are the next negatives; texts without a sure word name their best one.
        value = np.concatenate(_at_once(scorer.values, words, pool))
        hard = pool[np.argsort(-value, kind="stable")[: CLEAN_WORDS // 4]]
        hard = hard[~negative[hard]]
        negative[hard] = True
        clean += _at_once(rows, words, hard)
        named = [c for s in open_texts if len(c := np.array([i for i in s[count[s] > 0] if len(words[i]) > 2], np.int64))]
        if named:
            asked = np.unique(np.concatenate(named))
            value = np.zeros(n)
            value[asked] = np.concatenate(_at_once(scorer.values, words, asked))
            best = np.array([c[np.flatnonzero(value[c] == value[c].max())[-1]] for c in named])
            positive = np.union1d(sure, best[value[best] > 0])
    held_words = np.unique(np.concatenate(sets))
    value = np.full(n, -np.inf)
    value[held_words] = np.concatenate(_at_once(scorer.values, words, held_words))
    x = np.array([value[s].max(initial=scorer.bias) for s in sets])
    model["curve"] = _logistic(x, np.array(labels, float))
    return model


def numbered(batches: Iterable[pa.RecordBatch]) -> tuple[list[str], list[np.ndarray], list[int]]:
    """What learned() takes, of (doc_id, digest, toxic, units) in any order: texts in the order of the first three."""
    keys, lengths, chunks = [], [], []
    for b in batches:
        keys.append(np.stack([c.to_numpy().astype(np.int64) for c in b.columns[:3]]))
        lengths.append(b.column(3).value_lengths().to_numpy().copy())
        chunks.append(b.column(3).flatten().dictionary_encode())
    chunks = pa.chunked_array(chunks).unify_dictionaries().chunks
    order = pc.array_sort_indices(chunks[0].dictionary)  # by UTF-8 bytes, which is the order of code points
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    own = np.split(np.concatenate([rank[c.indices.to_numpy()] for c in chunks]), np.cumsum(np.concatenate(lengths))[:-1])
    key = np.concatenate(keys, axis=1)
    first = np.lexsort(key[::-1]).tolist()
    return chunks[0].dictionary.take(order).to_pylist(), [own[i] for i in first], key[2, first].tolist()


def fit(texts: DataFrame, marks: list[list[int]], labels: list[int]) -> dict:
    """A model of labelled texts (doc_id, digest, toxic, units): table (a weight per subsequence), bias, and slope and
    offset of the logistic curve. marks_of() the texts and their labels are in the order of the first three columns.

    With texts of one class only, the model gives that class's score to all texts. A task learns from the sample, whose
    size is bounded; words and kernel values don't come to the driver.
    """
    if len(set(labels)) < 2:
        return {"table": np.zeros(32**ORDER, np.float32), "bias": 0.0, "curve": (0.0, 6.0 if 1 in labels else -6.0)}
    kept = _apart(marks)

    def run(batches):
        release()
        words, sets, known = numbered(batches)
        model = learned(words, [sets[i] for i in kept], [known[i] for i in kept])
        yield pa.RecordBatch.from_pylist([{"table": model["table"].tobytes(), "bias": model["bias"], "slope": model["curve"][0], "origin": model["curve"][1]}])
        del words, sets, model
        release()

    rows = texts.select("doc_id", "digest", "toxic", "units").repartition(1)
    row = in_python(rows, run, "table binary, bias double, slope double, origin double").collect()[0]
    return {"table": np.frombuffer(bytes(row["table"]), np.float32), "bias": row["bias"], "curve": (row["slope"], row["origin"])}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of y on x, by Newton steps with a small penalty."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 0.05 * w
        h = (a.T * (p * (1 - p))) @ a + 0.05 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


class Scorer:
    """Scores texts with a model; the values of words are memoised."""

    def __init__(self, model: dict):
        self.table, self.bias, (self.slope, self.offset) = model["table"], model["bias"], model["curve"]
        self.memo: dict[str, float] = {}

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; of a long word's windows the largest."""
        pieces, owner = [], []
        for i, w in enumerate(words):
            own = _pieces(w)
            pieces += own
            owner += [i] * len(own)
        value = np.zeros(len(pieces), np.float32)
        for some, code, weight in subsequences(pieces):
            value[some] = np.einsum("wj,wj->w", self.table[code], weight)
        best = np.full(len(words), -np.inf)
        np.maximum.at(best, np.array(owner, np.int64), value)
        return best + self.bias

    def learn(self, new: set[str]) -> None:
        """Memoises the largest value of each token's forms."""
        spelled = [(t, f) for t in new for f in forms(t)]
        self.memo.update(dict.fromkeys(new, self.bias))
        for (t, _), v in zip(spelled, self.values([f for _, f in spelled]).tolist(), strict=True):
            if v > self.memo[t]:
                self.memo[t] = v

    def _highest(self, sets: list[set[str]]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        if new := set().union(*sets) - self.memo.keys():
            self.learn(new)
        return np.array([max(map(self.memo.__getitem__, s), default=self.bias) for s in sets])

    def highest(self, text: str | None) -> float:
        return float(self._highest([tokens(text)])[0])

    def score(self, texts: list[str | None]) -> list[float]:
        """Of each text, 0 to 1; null and empty texts have the bias alone."""
        out: list[float] = []
        for s in range(0, len(texts), 500):
            x = self._highest([tokens(t) for t in texts[s : s + 500]])
            out += (1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))).tolist()
        return out


def scorer_of(shared) -> Scorer:
    """One per process and model, so that what one task memoised serves the next."""
    name, model = shared.value
    return held("toxicity", name, lambda: Scorer(model))


def trainable(doc_id: Column) -> Column:
    """Whether a document's label may be learned from: crc32 of its id as text is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = 200_000) -> dict:
    """A model from docs (doc_id, text) and labels (doc_id, toxic): of either class `sample` texts at most, those whose
    ids have the smallest hashes, and none over `longest` characters. Rows that repeat an id and a text count once, and so do
    repeated labels, a toxic one first; null labels, ids and texts are left out. Executors cut the texts into units; the
    driver gets keys and marks_of() the texts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = known.where(trainable(F.col("doc_id")))
    ids = drawn(known.withColumn("h", F.xxhash64("doc_id")), "toxic", ["h"], sample).select("doc_id", "toxic")
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("toxic", pa.int32()), ("units", pa.list_(pa.string())), ("marks", pa.list_(pa.int64()))])

    def run(batches):
        for b in parts(batches):
            texts = b.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([sorted(units(t)) for t in texts], schema.field(3).type), pa.array([marks_of(t) for t in texts], schema.field(4).type)], schema=schema)

    with scratch(docs.sparkSession):
        rows = sampled(own, ids, ["doc_id"], "toxic", sample)
        rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("digest"), "toxic", "text")
        texts = written(in_python(rows, run, "doc_id long, digest long, toxic int, units array<string>, marks array<long>"), "units")
        keys = sorted(texts.select("doc_id", "digest", "toxic", "marks").collect(), key=lambda r: r[:3])
        return fit(texts, [r["marks"] for r in keys], [r["toxic"] for r in keys])


def shared_model(spark: SparkSession, model: dict):
    return spark.sparkContext.broadcast((uuid4().hex, model))


def scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) per row of docs, from its whole text; null and empty texts have the score of no words."""
    shared = shared_model(docs.sparkSession, model)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches):
        scorer = scorer_of(shared)
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return in_python(rows, run, "doc_id long, score double")


def keep_civil(docs: DataFrame, model: dict, limit: float = 0.5) -> DataFrame:
    """docs without the rows that score `limit` or more; rows are judged where they are, columns are those of docs."""
    shared, place = shared_model(docs.sparkSession, model), docs.columns.index("text")

    def run(batches):
        scorer = scorer_of(shared)
        for b in parts(batches):
            yield b.filter(pa.array([s < limit for s in scorer.score(b.column(place).to_pylist())], pa.bool_()))

    return in_python(spread(docs), run, docs.schema)
