"""Language identification by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads the bytes of a text in lower case in windows of WINDOW bytes, forwards and backwards, with its state
kept across words; at every position, be it a letter, a sign or a space, it gives the probabilities of the languages, and
a text's are their normed geometric mean over all its positions. Windows of many texts are read side by side, longest
first, so that at each step the rows that still have a byte are the first ones and nothing is padded. It is trained by
backpropagation through time on windows of labelled texts, each position with its text's language.
"""

from __future__ import annotations

from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import drawn, held, in_python, parts, sampled, scratch, spread

HIDDEN = 10
WINDOW = 96  # bytes that are read with one state
ROWS = 4096  # windows that are read side by side, fewer with many languages
TEXTS_BYTES = 4 << 20  # bytes of texts whose windows are in memory at once
DOCS_PER_LANG = 400
SAMPLES_PER_DOC = 24  # windows of at most SAMPLE_BYTES of a text that are learned from
SAMPLE_BYTES = 48
STEPS, BATCH, RATE = 900, 128, 0.012
LANGUAGES = 1_000  # the most that a model learns; more is an error


def data_of(text: str | None) -> bytes:
    """What the network reads of a text: its bytes in lower case; nothing if it has no letter (of Unicode's letter classes,
    so neither fractions nor numerals are letters)."""
    return text.lower().encode("utf-8", "replace") if text and any(map(str.isalpha, text)) else b""


def start(languages: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
    p["o"], p["c"] = rng.normal(0, 0.1, (2 * hidden, languages)), np.zeros(languages)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _step(a: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """(new state, update gate, reset gate, candidate) of what a byte gives (a), what the state gives (g) and the state."""
    hidden = h.shape[1]
    zr = _sigmoid(a[:, : 2 * hidden] + g[:, : 2 * hidden])
    z, r = zr[:, :hidden], zr[:, hidden:]
    n = r * g[:, 2 * hidden :]
    n += a[:, 2 * hidden :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, z, r, n


def _log_softmax(y: np.ndarray) -> np.ndarray:
    y = y - y.max(axis=-1, keepdims=True)
    return y - np.log(np.exp(y).sum(axis=-1, keepdims=True))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class _Reader:
    """One direction of a network, its gates apart, so that each is read and written as a whole."""

    def __init__(self, p: dict, d: str):
        cut = lambda m: [np.ascontiguousarray(part) for part in np.split(m, 3, axis=1)]
        self.x, self.u = cut(p[f"x{d}"]), cut(p[f"u{d}"])
        self.hidden = self.u[0].shape[0]

    def step(self, byte: np.ndarray, h: np.ndarray) -> np.ndarray:
        (xz, xr, xn), (uz, ur, un) = self.x, self.u
        z, r, n = h @ uz, h @ ur, h @ un
        z += np.take(xz, byte, axis=0)
        r += np.take(xr, byte, axis=0)
        n *= _sigmoid(r)
        n += np.take(xn, byte, axis=0)
        np.tanh(n, out=n)
        new = h - n
        new *= _sigmoid(z)
        new += n
        return new


def window_sums(p: dict, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(windows, languages): log probabilities summed over the positions of windows x (windows, WINDOW at most), which
    stand longest first; bytes beyond a window's length aren't read."""
    forward, back = _Reader(p, "f"), _Reader(p, "b")
    hidden, bias = forward.hidden, p["c"][:, None]
    ahead_o, back_o = np.ascontiguousarray(p["o"][:hidden].T), np.ascontiguousarray(p["o"][hidden:].T)
    most = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, most + 1), side="right")  # windows that reach step i
    x = np.ascontiguousarray(x[:, :most].T)
    ahead = []
    h = np.zeros((len(lengths), hidden), np.float32)
    for i in range(most):
        m = active[i]
        h = forward.step(x[i, :m], h[:m])
        ahead.append(ahead_o @ h.T)
    sums = np.zeros((len(bias), len(lengths)), np.float32)
    h = np.zeros((0, hidden), np.float32)
    for i in range(most - 1, -1, -1):
        m = active[i]
        if m > len(h):  # windows that end here begin with no state
            h = np.concatenate([h, np.zeros((m - len(h), hidden), np.float32)])
        h = back.step(x[i, :m], h)
        y = back_o @ h.T
        y += ahead[i]
        y += bias
        y -= y.max(axis=0)
        y -= np.log(np.exp(y).sum(axis=0))
        sums[:, :m] += y
    return sums.T


def _read(p: dict, x: np.ndarray, d: str):
    """States (t, b, hidden) of one direction over x (b, t), and what backpropagation needs."""
    hidden = p[f"u{d}"].shape[0]
    b, t = x.shape
    h, out, kept = np.zeros((b, hidden), p[f"u{d}"].dtype), np.empty((t, b, hidden), p[f"u{d}"].dtype), []
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        g = h @ p[f"u{d}"]
        new, z, r, n = _step(p[f"x{d}"][x[:, i]], g, h)
        kept.append((i, h, z, r, n, g[:, 2 * hidden :]))
        out[i] = h = new
    return out, kept


def gradients(p: dict, x: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy of all positions of x (b, t) and its gradients, by backpropagation through time."""
    b, t = x.shape
    hidden = p["uf"].shape[0]
    parts = {d: _read(p, x, d) for d in "fb"}
    states = np.concatenate([parts["f"][0], parts["b"][0]], axis=2)
    y = _log_softmax(states @ p["o"] + p["c"])
    loss = -y[:, np.arange(b), label].mean()
    dy = np.exp(y)
    dy[:, np.arange(b), label] -= 1
    dy /= t * b
    g = {"o": np.einsum("tbh,tbl->hl", states, dy), "c": dy.sum(axis=(0, 1))}
    back = dy @ p["o"].T
    order = np.argsort(x.T.ravel(), kind="stable")  # by byte, to add up what each byte's row gets
    seen, first = np.unique(x.T.ravel()[order], return_index=True)
    for k, d in enumerate("fb"):
        g[f"x{d}"], g[f"u{d}"] = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"u{d}"])
        dh, das = np.zeros((b, hidden), p["o"].dtype), np.empty((t, b, 3 * hidden), p["o"].dtype)
        for i, h, z, r, n, gn in reversed(parts[d][1]):
            dh = dh + back[i, :, k * hidden : (k + 1) * hidden]
            dn = dh * (1 - z) * (1 - n * n)
            das[i] = np.concatenate([dh * (h - n) * z * (1 - z), dn * gn * r * (1 - r), dn], axis=1)
            dg = das[i].copy()
            dg[:, 2 * hidden :] *= r
            g[f"u{d}"] += h.T @ dg
            dh = dh * z + dg @ p[f"u{d}"].T
        g[f"x{d}"][seen] = np.add.reduceat(das.reshape(t * b, -1)[order], first, axis=0)
    return float(loss), g


def fit(windows: list[bytes], labels: np.ndarray, languages: int, steps: int = STEPS, seed: int = 3) -> dict:
    """A network trained on windows of bytes with a language number each, by Adam. A step takes a random part of equal
    length of each of its windows, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    p = start(languages, seed=seed)
    if not windows:
        return p
    length = np.array([len(w) for w in windows])
    data = np.zeros((len(windows), int(length.max())), np.uint8)
    for i, w in enumerate(windows):
        data[i, : len(w)] = np.frombuffer(w, np.uint8)
    # Languages weigh alike: a window is drawn by the inverse of its language's count.
    weight = (1 / np.bincount(labels, minlength=languages).clip(1))[labels]
    parts = [(n, own, weight[own] / weight[own].sum()) for n in (4, 8, 16, 32, SAMPLE_BYTES) if len(own := np.flatnonzero(length >= n))]
    if not parts:
        parts = [(int(length.min()), np.arange(len(windows)), weight / weight.sum())]
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        n, own, q = parts[rng.integers(len(parts))]
        some = rng.choice(own, BATCH * max(1, SAMPLE_BYTES // (2 * n)), p=q)
        at = (rng.random(len(some)) * (length[some] - n + 1)).astype(np.int64)
        x = data[some[:, None], at[:, None] + np.arange(n)]
        _, g = gradients(p, x, labels[some])
        rate = RATE * (1 - 0.9 * step / steps)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _windows(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a view of WINDOW bytes from each place on, the places at which windows begin, their lengths, the places of their
    texts in the list), longest windows first."""
    size = np.array([len(d) for d in data], np.int64)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(data)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(size[owner] - nth * WINDOW, WINDOW)
    begin = (np.cumsum(size) - size)[owner] + nth * WINDOW
    order = np.argsort(-length, kind="stable")
    flat = np.frombuffer(b"".join(data) + bytes(WINDOW), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, WINDOW), begin[order], length[order], owner[order]


class Identifier:
    """Languages of texts under a trained network."""

    def __init__(self, network: dict, languages: list[str]):
        self.p, self.languages = network, languages

    def _means(self, data: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean log probability over all positions of each text, 0 for one without bytes."""
        sums = np.zeros((len(data), len(self.languages)))
        view, begin, length, owner = _windows(data)
        rows = max(64, 16 * ROWS // max(16, len(self.languages)))
        for s in range(0, len(begin), rows):
            np.add.at(sums, owner[s : s + rows], window_sums(self.p, view[begin[s : s + rows]], length[s : s + rows]))
        return sums / np.array([max(1, len(d)) for d in data])[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(language, pooled probability) of each text; und and 0 for a null text or one without a letter. Of languages
        that are equally likely the first by name."""
        names, values = [], []
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        held_bytes: list[bytes] = []

        def flush():
            for d, mean in zip(held_bytes, self._means(held_bytes), strict=True):
                best = int(mean.argmax())
                names.append(self.languages[best] if d else "und")
                values.append(float(1 / np.exp(mean - mean[best]).sum()) if d else 0.0)
            held_bytes.clear()

        size = 0
        for t in texts:
            held_bytes.append(data_of(t))
            size += len(held_bytes[-1])
            if size > TEXTS_BYTES:
                flush()
                size = 0
        if held_bytes:
            flush()
        return names, values


def _identifier(shared) -> Identifier:
    name, network, languages = shared.value
    return held("language", name, lambda: Identifier(network, languages))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 over 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def samples_of(text: str, doc_id: int, most: int = SAMPLES_PER_DOC) -> list[bytes]:
    """At most so many windows of a text's bytes to learn from, at places drawn by its doc_id."""
    data = data_of(text)
    if len(data) <= SAMPLE_BYTES:
        return [data] if data else []
    rng = np.random.default_rng(crc32(str(doc_id).encode()))
    places = rng.choice(len(data) - SAMPLE_BYTES + 1, min(most, -(-len(data) // SAMPLE_BYTES)), replace=False)
    return [data[i : i + SAMPLE_BYTES] for i in np.sort(places).tolist()]


def train(docs: DataFrame, per_lang: int = DOCS_PER_LANG, per_doc: int = SAMPLES_PER_DOC) -> tuple[dict, list[str]]:
    """(network, languages) from docs (doc_id, text, lang): of each language `per_lang` rows at most, those whose ids have
    the smallest hashes, and of each text `per_doc` windows at most, which executors cut; the driver gets these alone. Rows
    that repeat an id, a text and a language count once. Null ids, texts and languages are left out. More than LANGUAGES
    languages are an error, as the network would have an output for each.
    """
    rows = docs.select("doc_id", "lang", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = [r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(known) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not known:
        return fit([], np.empty(0, np.int64), 1), []
    languages = sorted(known)

    def run(batches):
        for b in batches:
            cut = [samples_of(t, i, per_doc) for i, t in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cut, pa.list_(pa.binary()))], ["digest", "doc_id", "lang", "windows"])

    ids = drawn(rows.select("doc_id", "lang").withColumn("h", F.xxhash64("doc_id")), "lang", ["h"], per_lang).select("doc_id", "lang")
    with scratch(docs.sparkSession):
        some = sampled(rows, ids, ["doc_id", "lang"], "lang", per_lang)
        cuts = in_python(some.select("h", F.col("doc_id").cast("long"), "lang", "text"), run, "digest long, doc_id long, lang string, windows array<binary>")
        got = sorted(tuple(r) for r in cuts.collect())
    windows, labels = [], []
    for _, _, lang, own in got:
        windows += map(bytes, own)
        labels += [languages.index(lang)] * len(own)
    return fit(windows, np.array(labels, np.int64), len(languages)), languages


def identify(docs: DataFrame, network: dict, languages: list[str]) -> DataFrame:
    """(doc_id, lang_pred, score) per row of docs from its whole text; und and 0 where it is null or has no letter.

    Without a learned language all are und. Repeated and null doc_ids are rows of their own; other columns are not read;
    an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((uuid4().hex, network, languages))
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def run(batches):
        identifier = _identifier(shared)
        for b in parts(batches, 2000):
            names, values = identifier.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], ["doc_id", "lang_pred", "score"])

    return in_python(rows, run, "doc_id long, lang_pred string, score double")
