"""Nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Vectors are dealt to clusters, whose centres come from a bounded sample, and a cluster of more than `shard_rows` rows by
hash to several shards. A shard's graph is built in one task by insertion: a batch of nodes is searched in the graph so
far, layer by layer, each node is linked to diverse ones of those found and of its batch, and lists that overflow are
chosen anew. It is kept as a row of flat arrays: the vectors, the ids of equal vectors (which are one node), and for each
layer the fixed-width neighbour array of its nodes, which stand in the order of their levels. Inner products become
distances by one added component, sqrt(max |x|^2 - |x|^2), so lengths may differ.

A query goes to the clusters that, by the mean and variance of their vectors along it, are expected to hold all but a
small part of its neighbours: few where vectors form clusters, all where they don't. Shard results are merged by a window
per query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import in_python, written

SHARD_ROWS = 100_000
DEGREE = 20
CANDIDATES = 80  # nodes that an insertion looks at
EF = 320
EXPAND = 6  # nodes whose neighbours are looked at in one step of an insertion, of a search twice as many
BLOCK = 512
CLUSTERS = 1024  # the most; further shards are parts of clusters
SAMPLE = 64  # vectors of the sample for each cluster
DIMS = 1000  # the most lengths of vectors in a table; more is an error
MISSED = 0.005  # the share of a query's neighbours that clusters which aren't searched may be expected to hold
ASKED = 50_000  # queries of a shard that one task takes
INDEX_SCHEMA = "dim int, cluster int, shard long, n int, kind string, vectors binary, id_starts binary, ids binary, layers binary, layer_sizes array<int>, rows long, mean array<double>, variance array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) without the vectors that are null, empty, zero or not finite throughout."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & e.isNotNull())
    return rows.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def _chosen(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """For each node of own at most so many (-1 for none) of its row of near: those nearer to it than to one chosen
    before; places that are left go to the nearest of the others. Rows may hold -1 and repeats."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == own[:, None]] = -1
    square = np.einsum("nd,nd->n", x, x)
    d = square[near] - 2 * np.matmul(np.take(x, near, axis=0), x[own][:, :, None])[..., 0]  # less a node's own square, which orders alike
    d[near < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1) + square[own][:, None]
    kept, count = np.zeros(near.shape, bool), np.zeros(len(own), int)
    closest = np.full(near.shape, np.inf, np.float32)  # of each candidate to a kept one
    for c in range(near.shape[1]):
        fit = (count < most) & (d[:, c] <= closest[:, c]) & (near[:, c] >= 0)
        kept[:, c] = fit
        count += fit
        rows = np.flatnonzero(fit & (count < most))
        if len(rows) and c + 1 < near.shape[1]:
            one, rest = near[rows, c], near[rows, c + 1 :]
            between = square[one][:, None] + square[rest] - 2 * np.matmul(np.take(x, rest, axis=0), x[one][:, :, None])[..., 0]
            closest[rows, c + 1 :] = np.minimum(closest[rows, c + 1 :], between)
    more = (near >= 0) & ~kept
    kept |= more & (np.cumsum(more, axis=1) <= (most - count)[:, None])
    first = np.argsort(~kept, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(kept, first, axis=1), np.take_along_axis(near, first, axis=1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """Vectors x and the neighbour arrays of its layers, widest first; a layer's nodes are the first ones of all."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    def beam(self, q: np.ndarray, start: np.ndarray, step: int, ef: int, expand: int) -> np.ndarray:
        """Nodes (b, ef), best first, -1 for none: a best-first search for all queries in a layer, from start (b, e)."""
        b, near = len(q), self.layers[step]
        seen = np.zeros((b, len(near) + 1), bool)  # the last column takes what is no node
        pool, score, done = np.full((b, ef), -1, np.int32), np.full((b, ef), -np.inf, np.float32), np.ones((b, ef), bool)
        fresh, live = start.astype(np.int32), np.arange(b)
        while True:
            seen[live[:, None], fresh] = True
            s = np.matmul(np.take(self.x, fresh, axis=0), q[live, :, None])[..., 0]
            s[fresh < 0] = -np.inf
            every, scores, over = np.concatenate([pool[live], fresh], axis=1), np.concatenate([score[live], s], axis=1), np.concatenate([done[live], fresh < 0], axis=1)
            best = np.argpartition(-scores, ef - 1, axis=1)[:, :ef]
            row = np.arange(len(live))[:, None]
            order = np.argsort(-scores[row, best], axis=1)
            best = best[row, order]
            own_pool, own_score, own_done = every[row, best], scores[row, best], over[row, best]
            to = np.argsort(own_done, axis=1, kind="stable")[:, :expand]
            idle = own_done[row, to]
            own_done[row, to] = True
            pool[live], score[live], done[live] = own_pool, own_score, own_done
            on = ~idle.all(axis=1)
            if not on.any():
                return pool
            live, nodes = live[on], np.where(idle, -1, own_pool[row, to])[on]
            fresh = near[nodes]
            fresh[nodes < 0] = -1
            fresh = np.sort(fresh.reshape(len(live), -1), axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[seen[live[:, None], fresh]] = -1
            fresh.sort(axis=1)
            fresh = fresh[:, min(int((fresh >= 0).any(axis=0).argmax()), fresh.shape[1] - 1) :]  # columns without a node go

    def entry(self, q: np.ndarray, until: int, top: int) -> np.ndarray:
        """(b, 1 or more) nodes to start from in layer `until`, by descent from the top layer."""
        at = np.zeros((len(q), 1), np.int64)
        for step in range(top, until, -1):
            at = self.beam(q, at, step, 8, 2)
        return at

    def insert(self, first: int, end: int, levels: np.ndarray, top: int) -> None:
        """Links the nodes first to end - 1, whose nodes ahead are in the graph already; top: the highest layer in use."""
        new = np.arange(first, end)
        at = self.entry(self.x[new], top, top) if first else None
        for step in range(len(self.layers) - 1, -1, -1):
            here = new[levels[new] >= step]
            if not len(here):
                if first and step <= top:
                    at = self.beam(self.x[new], at, step, 8, 2)
                continue
            row = here - first
            found = np.empty((len(here), 0), np.int32)
            if first and step <= top:
                q, start = (self.x[new], at) if step else (self.x[here], at[row])
                at = self.beam(q, start, step, CANDIDATES, EXPAND)
                found = at[row] if step else at
            peers = self.x[here] @ self.x[here].T * -2 + np.einsum("nd,nd->n", self.x[here], self.x[here])[None]
            take = min(len(here), CANDIDATES // 4)
            found = np.c_[found, here[np.argpartition(peers, take - 1, axis=1)[:, :take]]]
            near = self.layers[step]
            width = near.shape[1]
            near[here] = np.pad(_chosen(self.x, here, found, width // 2), ((0, 0), (0, width - width // 2)), constant_values=-1)
            self._answer(step, here)

    def _answer(self, step: int, here: np.ndarray) -> None:
        """Links back from the nodes that the nodes here link to."""
        near = self.layers[step]
        width = near.shape[1]
        source, target = np.repeat(here, width), near[here].ravel()
        on = target >= 0
        order = np.lexsort((source[on], target[on]))
        source, target = source[on][order], target[on][order]
        ends, start, count = np.unique(target, return_index=True, return_counts=True)
        for s in range(0, len(ends), 2048):
            own, most = ends[s : s + 2048], int(count[s : s + 2048].max())
            size = count[s : s + 2048]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            more = np.full((len(own), most), -1, np.int64)
            more[np.repeat(np.arange(len(own)), size), place] = source[start[s] : start[s] + size.sum()]
            every = np.sort(np.c_[near[own].astype(np.int64), more], axis=1)[:, ::-1]
            every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
            every = np.sort(every, axis=1)[:, ::-1]
            over = (every >= 0).sum(axis=1) > width
            near[own[~over]] = every[~over, :width] if every.shape[1] >= width else np.pad(every[~over], ((0, 0), (0, width - every.shape[1])), constant_values=-1)
            if over.any():
                near[own[over]] = _chosen(self.x, own[over], every[over].copy(), width)


def build_graph(x: np.ndarray, levels: np.ndarray, degree: int) -> Graph:
    """The graph of vectors x, whose nodes stand in descending order of their levels."""
    layers = [np.full((int((levels >= s).sum()), 2 * degree if s == 0 else degree), -1, np.int32) for s in range(int(levels.max()) + 1)]
    graph, at = Graph(x, layers), 0
    while at < len(x):
        end = min(len(x), at + max(1, min(BLOCK, at)))
        graph.insert(at, end, levels, int(levels[0]))
        at = end
    return graph


def build_shard(ids: np.ndarray, vectors: np.ndarray, degree: int = DEGREE) -> dict:
    """The flat arrays of one shard's graph. ids and vectors are parallel; equal vectors become one node, and equal rows
    one entry of it."""
    vectors = np.ascontiguousarray(vectors) + 0.0
    own, which = np.unique(vectors, axis=0, return_inverse=True)
    n = len(own)
    rng = np.random.default_rng(n)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
    order = np.lexsort((rng.random(n), -level))  # highest levels first, otherwise in random order
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    own, level, node = own[order], level[order], place[which.ravel()]
    pair = np.unique(np.rec.fromarrays([node, ids]))
    starts = np.r_[0, np.cumsum(np.bincount(pair.f0, minlength=n))]
    length = np.einsum("nd,nd->n", own, own)
    x = np.c_[own, np.sqrt(np.maximum(length.max() - length, 0))].astype(np.float32)
    graph = build_graph(x, level, degree)
    small = own.astype("<f4")
    exact = bool((small == own).all())
    return {
        "n": n, "kind": "<f4" if exact else "<f8", "vectors": (small if exact else own).tobytes(), "id_starts": starts.astype(np.int64).tobytes(), "ids": pair.f1.astype(np.int64).tobytes(),
        "layers": b"".join(a.tobytes() for a in graph.layers), "layer_sizes": [len(a) for a in graph.layers],
        "rows": len(vectors), "mean": vectors.mean(axis=0).tolist(), "variance": vectors.var(axis=0).tolist(),
    }


class Shard:
    """A shard's graph, read from its flat arrays."""

    def __init__(self, row: dict, degree: int = DEGREE):
        self.n = row["n"]
        self.own = np.frombuffer(row["vectors"], row["kind"]).reshape(self.n, -1)
        self.starts, self.ids = np.frombuffer(row["id_starts"], np.int64), np.frombuffer(row["ids"], np.int64)
        flat, at, layers = np.frombuffer(row["layers"], np.int32), 0, []
        for step, size in enumerate(row["layer_sizes"]):
            width = 2 * degree if step == 0 else degree
            layers.append(flat[at : at + size * width].reshape(size, width))
            at += size * width
        self.graph = Graph(self.own.astype(np.float32), layers)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score) of the k best found for each query, each vec_id once, the query's own left out."""
        q = queries.astype(np.float32)
        found = self.graph.beam(q, self.graph.entry(q, 0, len(self.graph.layers) - 1), 0, max(ef, 2 * k), 2 * EXPAND)
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        copies = np.minimum(self.starts[node + 1] - self.starts[node], k + 1)  # only the smallest ids of equal vectors can be among k
        score = np.repeat(np.einsum("nd,nd->n", queries[r], self.own[node].astype(np.float64)), copies)
        first = np.repeat(self.starts[node], copies)
        r = np.repeat(r, copies)
        ids = self.ids[first + np.arange(len(r)) - np.repeat(np.cumsum(copies) - copies, copies)]
        other = ids != query_ids[r]
        r, ids, score = r[other], ids[other], score[other]
        order = np.lexsort((-score, ids, r))
        r, ids, score = r[order], ids[order], score[order]
        once = np.r_[True, (r[1:] != r[:-1]) | (ids[1:] != ids[:-1])] if len(r) else np.empty(0, bool)
        r, ids, score = r[once], ids[once], score[once]
        order = np.lexsort((ids, -score, r))
        r, ids, score = r[order], ids[order], score[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        return query_ids[r[best]], ids[best], score[best]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _runs(b: pa.RecordBatch, keys: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of equal values in the first so many columns."""
    if not b.num_rows:
        return []
    change = np.zeros(b.num_rows - 1, bool)
    for i in range(keys):
        c = b.column(i).to_numpy(zero_copy_only=False)
        change |= c[1:] != c[:-1]
    cuts = np.flatnonzero(np.r_[True, change]).tolist()
    return list(zip(cuts, [*cuts[1:], b.num_rows], strict=True))


def centres(sample: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """n centres of the sample by Lloyd's rounds; fewer where the sample has fewer rows."""
    rng = np.random.default_rng(n)
    c = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)
        count = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *[((c * c).sum(axis=1)[None] - 2 * x[s : s + 4096] @ c.T).argmin(axis=1) for s in range(0, len(x), 4096)]])


def clustered(rows: DataFrame, shard_rows: int) -> DataFrame:
    """(dim, cluster, no, vec_id, embedding) of rows, written: each vector at the nearest centre of its length."""
    spark = rows.sparkSession
    counts = {r["dim"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("dim")).count().limit(DIMS + 1).collect()}
    if len(counts) > DIMS:
        raise ValueError(f"over {DIMS} lengths of vectors")
    wanted = {d: min(CLUSTERS, -(-n // shard_rows)) for d, n in counts.items() if n > shard_rows}
    known = {}
    for dim, n in wanted.items():
        share = min(1.0, 2.0 * SAMPLE * n / counts[dim])
        some = rows.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)).select("embedding").limit(SAMPLE * n)
        known[dim] = centres(np.array([r[0] for r in some.collect()]), n)
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            dims = b.column(0).to_numpy()
            cluster = np.zeros(b.num_rows, np.int32)
            for dim, c in shared.value.items():
                at = np.flatnonzero(dims == dim)
                if len(at):
                    cluster[at] = nearest(_matrix(b.column(3).take(pa.array(at)), dim), c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster), *b.columns[1:]], ["dim", "cluster", "no", "vec_id", "embedding"])

    numbered = rows.select(F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("no"), "vec_id", "embedding")
    return written(in_python(numbered, run, "dim int, cluster int, no long, vec_id long, embedding array<double>"), "vectors")


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """One row of flat arrays (INDEX_SCHEMA) per shard, written to the shared folder. Every usable vector is in it.

    Centres are fitted on SAMPLE vectors for each of CLUSTERS clusters at most. Vectors of unequal length go to shards of
    their own, DIMS lengths at most. A vec_id may have several vectors. No usable vector: no rows.
    """
    rows = clustered(usable(vectors), shard_rows)
    parts, at = [], 0
    for r in rows.groupBy("dim", "cluster").count().orderBy("dim", "cluster").collect():
        n = -(-r["count"] // shard_rows)
        parts.append((r["dim"], r["cluster"], at, n))
        at += n
    schema = pa.schema([("dim", pa.int32()), ("cluster", pa.int32()), ("shard", pa.int64()), ("n", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in ("vectors", "id_starts", "ids", "layers")), ("layer_sizes", pa.list_(pa.int32())), ("rows", pa.int64()), ("mean", pa.list_(pa.float64())), ("variance", pa.list_(pa.float64()))])

    def run(batches):
        held: list = []

        def build():
            shard, dim, cluster = held[0][0]
            made = build_shard(np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]), degree)
            return pa.RecordBatch.from_pylist([{"dim": dim, "cluster": cluster, "shard": shard} | made], schema)

        for b in batches:
            for s, e in _runs(b, 1):
                key = tuple(b.column(i)[s].as_py() for i in range(3))
                if held and held[0][0] != key:
                    yield build()
                    held.clear()
                held.append((key, b.column(3)[s:e].to_numpy(zero_copy_only=False), _matrix(b.column(4)[s:e], key[1])))
        if held:
            yield build()

    spark = vectors.sparkSession
    listed = spark.createDataFrame(parts, "dim int, cluster int, first long, parts long")
    shard = (F.col("first") + F.pmod(F.xxhash64("no"), F.col("parts"))).alias("shard")
    dealt = rows.join(F.broadcast(listed), ["dim", "cluster"]).select(shard, "dim", "cluster", "vec_id", "embedding")
    return written(in_python(dealt.repartition(max(1, at), "shard").sortWithinPartitions("shard"), run, INDEX_SCHEMA), "hnsw")


def _tail(z: np.ndarray) -> np.ndarray:
    """How much of a normal distribution is above z, nearly."""
    half = 0.5 * np.exp(-0.717 * np.abs(z) - 0.416 * z * z)
    return np.where(z >= 0, half, 1 - half)


def routes(q: np.ndarray, mean: np.ndarray, variance: np.ndarray, rows: np.ndarray, k: int, missed: float = MISSED) -> np.ndarray:
    """(queries, clusters): whether a cluster is to be searched. Inner products with a cluster's vectors are taken as
    normal; the score that k of all vectors are above gives the neighbours to expect in each, and clusters are taken,
    most first, until at most `missed` of k are left. The cluster with the nearest mean is always taken."""
    at, width = q @ mean.T, np.sqrt((q * q) @ variance.T) + 1e-12
    low, high = (at - 8 * width).min(axis=1), (at + 8 * width).max(axis=1)
    for _ in range(40):
        mid = (low + high) / 2
        many = (rows * _tail((mid[:, None] - at) / width)).sum(axis=1) > k
        low, high = np.where(many, mid, low), np.where(many, high, mid)
    expected = rows * _tail((low[:, None] - at) / width)
    order = np.argsort(-expected, axis=1, kind="stable")
    sums = np.cumsum(np.take_along_axis(expected, order, axis=1), axis=1)
    taken = np.empty(expected.shape, bool)
    np.put_along_axis(taken, order, np.c_[np.zeros(len(q)), sums[:, :-1]] < (1 - missed) * sums[:, -1:], axis=1)
    taken[np.arange(len(q)), ((mean * mean).sum(axis=1)[None] - 2 * at).argmin(axis=1)] = True
    return taken


def _router(index: DataFrame, k: int, missed: float):
    """A function for in_python: queries (dim, vec_id, embedding) to (shard, vec_id, embedding) by routes()."""
    # The parts of a cluster are dealt by hash, so the first one's mean and variance stand for all.
    first = lambda c: F.min_by(c, "shard").alias(c)
    stats = index.groupBy("dim", "cluster").agg(F.min("shard").alias("shard"), F.count("*").alias("parts"), F.sum("rows").alias("rows"), first("mean"), first("variance"))
    by_dim: dict = {}
    for r in stats.collect():
        by_dim.setdefault(r["dim"], []).append((range(r["shard"], r["shard"] + r["parts"]), r["mean"], r["variance"], float(r["rows"])))
    known = {d: (shards, *map(np.array, rest)) for d, (shards, *rest) in ((d, zip(*of, strict=True)) for d, of in by_dim.items())}
    shared = index.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            for s, e in _runs(b, 1):
                dim = b.column(0)[s].as_py()
                if dim not in shared.value:
                    continue
                shards, mean, variance, rows = shared.value[dim]
                some = b.slice(s, e - s)
                who, cluster = np.nonzero(routes(_matrix(some.column(2), dim), mean, variance, rows, k, missed))
                to = [(i, x) for i, c in zip(who.tolist(), cluster.tolist(), strict=True) for x in shards[c]]
                rows_at = pa.array([i for i, _ in to], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x for _, x in to], pa.int64()), some.column(1).take(rows_at), some.column(2).take(rows_at)], ["shard", "vec_id", "embedding"])

    return run


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = EF, degree: int = DEGREE, missed: float = MISSED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows that the graphs find for each usable query.

    Ties go to the smaller vec_id; a query's own id is no candidate. A vec_id that several rows of queries hold asks once,
    with its smallest vector; one that several rows of the index hold is one neighbour, with its best score. A task holds
    one shard's arrays and asks them ASKED queries at most, in blocks.
    """
    q = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    q = written(q.select(F.size("embedding").alias("dim"), "vec_id", "embedding"), "queries")
    salts = max(1, -(-q.count() // ASKED))
    asked = in_python(q, _router(index, k, missed), "shard long, vec_id long, embedding array<double>")
    asked = asked.select("shard", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("part"), "vec_id", "embedding")
    fields = ["n", "kind", "vectors", "id_starts", "ids", "layers", "layer_sizes"]
    graphs = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("part"), F.struct(*fields).alias("graph"))
    rows = graphs.unionByName(asked, allowMissingColumns=True).select("shard", "salt", "part", "graph", "vec_id", "embedding")
    n = max(1, index.count() * salts)
    rows = rows.repartition(n, "shard", "salt").sortWithinPartitions("shard", "salt", "part")

    def run(batches):
        graph = None
        for b in batches:
            for s, e in _runs(b, 3):
                if b.column(2)[s].as_py() == 0:
                    graph = Shard(b.column(3)[s].as_py(), degree)
                    continue
                ids, vectors = b.column(4)[s:e].to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(5)[s:e], graph.own.shape[1])
                for i in range(0, len(ids), BLOCK):
                    out = graph.search(ids[i : i + BLOCK], vectors[i : i + BLOCK], k, ef)
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = in_python(rows, run, "query_id long, vec_id long, score double")
    once = Window.partitionBy("query_id", "vec_id").orderBy(F.desc("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
