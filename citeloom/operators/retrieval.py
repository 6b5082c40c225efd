"""Hybrid retrieval: exact dense neighbours, content-word overlap, and their blend."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import content_words
from citeloom.functions.workers import with_python_path

TEXT_TOP, FIGURE_TOP, CANDIDATES, WEIGHT, FIGURE_WEIGHT = 5, 3, 24, 0.35, 0.25
QUERY_BLOCK = 2_000  # questions that every task gets; more are dealt out in blocks
TIES = 12  # places to which distances are ranked
CORPUS_BLOCK = 8_192  # rows of the corpus that a task multiplies with a block of questions


def fine(column: str = "embedding") -> Column:
    """Whether a vector's components are neither null nor infinite nor NaN; null for a null vector."""
    return F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def dense_top(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(query_id, row_id, distance, dense_score, dense_rank): the k rows of corpus (row_id, embedding) of least cosine
    distance to each of queries (query_id, embedding), ties by row_id; dense_score is 1 - distance, 0 at least.

    Up to QUERY_BLOCK questions are broadcast: a task multiplies its rows with them and keeps k rows a question. More are
    packed into matrices, as is the corpus, and met in a cogroup of a block of each (see _dealt_top), so neither passes
    through the driver. Tasks x questions x k rows are shuffled. A row whose vector is null, empty or zero is at distance 1
    from every question; vectors of another length than the question's and those with null or non-finite components are
    left out. Questions of the latter kinds, and zero ones, have no neighbours; rows that repeat a query_id ask once, with
    the smallest vector.
    """
    spark = corpus.sparkSession
    with_python_path(spark)
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    asked = queries.where("query_id is not null and embedding is not null").where(fine()).select(F.col("query_id").cast("long"), vector)
    asked = asked.groupBy("query_id").agg(F.min("embedding").alias("embedding")).where(F.exists("embedding", lambda x: x != 0))
    none = F.array().cast("array<double>")
    rows = corpus.where("row_id is not null").where(F.coalesce(fine(), F.lit(True)))
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), F.coalesce(vector, none).alias("embedding"))
    few = asked.limit(QUERY_BLOCK + 1).collect()
    if len(few) <= QUERY_BLOCK:
        shared = spark.sparkContext.broadcast([(q, list(e)) for q, e in few])
        found = rows.mapInArrow(_top_of_task(shared, k), TOP_SCHEMA)
    else:
        found = _dealt_top(rows, asked, k)
    best = Window.partitionBy("query_id").orderBy(F.round("distance", TIES), "row_id")
    ranked = found.withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)
    return ranked.select("query_id", "row_id", "distance", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("dense_score"), "dense_rank")


TOP_SCHEMA = "query_id long, row_id long, distance double"


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all pairs of unit vectors."""
    return 1 - a @ b.T


def tied(distance: np.ndarray) -> np.ndarray:
    """Distances for ranking: to TIES places, so that equal vectors tie whichever matrix they are in."""
    return np.round(distance, TIES)


def _nearest(distance: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The places (questions, k) of the rows at the least distances, equal ones by row: what can be among them is parted
    from the rest, and sorted."""
    if distance.shape[1] <= 4 * k:
        return np.lexsort((np.broadcast_to(rows, distance.shape), distance), axis=1)[:, :k]
    within = distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k]  # more than k where the last one ties
    some = np.argsort(~within, axis=1, kind="stable")[:, : int(within.sum(axis=1).max())]
    near = np.where(np.take_along_axis(within, some, axis=1), np.take_along_axis(distance, some, axis=1), np.inf)
    return np.take_along_axis(some, np.lexsort((rows[some], near), axis=1)[:, :k], axis=1)


class _Kept:
    """The k nearest rows so far of a block of questions of one length."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, k: int):
        self.ids, self.units, self.k = ids, units, k
        self.rows, self.distance = np.empty((len(ids), 0), np.int64), np.empty((len(ids), 0))

    def meet(self, rows: np.ndarray, units: np.ndarray, bare: np.ndarray) -> None:
        distance = np.c_[cosine_distance(self.units, units), np.ones((len(self.ids), len(bare)))]
        names = np.r_[rows, bare]
        best = _nearest(tied(distance), names, self.k)
        every = np.c_[self.rows, names[best]], np.c_[self.distance, np.take_along_axis(distance, best, axis=1)]
        order = np.lexsort((every[0], tied(every[1])), axis=1)[:, : self.k]
        self.rows, self.distance = (np.take_along_axis(e, order, axis=1) for e in every)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.rows.shape[1])), pa.array(self.rows.ravel()), pa.array(self.distance.ravel())], ["query_id", "row_id", "distance"])


def _by_length(b: pa.RecordBatch) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """({length: (row_ids, unit vectors)}, row_ids without a vector) of rows (row_id, embedding)."""
    names, sizes = b.column(0).to_numpy(), np.diff(b.column(1).offsets.to_numpy())
    out = {}
    for d in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == d)
        x = b.column(1).take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        norm = np.linalg.norm(x, axis=1)
        out[d] = names[own], x / np.where(norm > 0, norm, 1)[:, None]
    return out, names[sizes == 0]


def _top_of_task(shared, k: int):
    def run(batches):
        by_dim: dict[int, tuple[list, list]] = {}
        for q, e in shared.value:
            ids, vectors = by_dim.setdefault(len(e), ([], []))
            ids.append(q)
            vectors.append(np.array(e) / np.linalg.norm(e))
        kept = {d: _Kept(np.array(ids), np.array(v), k) for d, (ids, v) in by_dim.items()}
        for b in batches:
            units, bare = _by_length(b)
            for d, own in kept.items():
                own.meet(*units.get(d, (np.empty(0, np.int64), np.empty((0, d)))), bare)
        for own in kept.values():
            yield own.batch()

    return run


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """(part, nth, dim, ids, units): rows (id, embedding) as matrices of up to `most` unit vectors of one length, dim 0 for
    rows without a vector; numbered within their partition."""

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        held: dict[int, tuple[list, list, int]] = {}

        def block(d):
            nonlocal nth
            ids, units, _ = held.pop(d)
            nth += 1
            row = [pa.array([part], pa.int32()), pa.array([nth], pa.int32()), pa.array([d], pa.int32()), pa.array([np.concatenate(ids).astype("<i8").tobytes()]), pa.array([np.concatenate(units).tobytes() if units else b""])]
            return pa.RecordBatch.from_arrays(row, ["part", "nth", "dim", "ids", "units"])

        for b in batches:
            for i in range(0, b.num_rows, most):
                units, bare = _by_length(b.slice(i, most))
                for d, (names, x) in {**units, **({0: (bare, None)} if len(bare) else {})}.items():
                    ids, own, n = held.get(d, ([], [], 0))
                    held[d] = [*ids, names], own if x is None else [*own, x], n + len(names)
                    if held[d][2] >= most:
                        yield block(d)
        for d in list(held):
            yield block(d)

    return rows.mapInArrow(run, "part int, nth int, dim int, ids binary, units binary")


def _dealt_top(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """dense_top() of many questions: every block of questions goes to each of some salts, every block of the corpus to one
    salt of each group of questions, and the blocks of a cell of (group, salt) are multiplied there. Cells hold a bounded
    number of rows of either side, whatever their ids."""
    n_rows, n_asked = rows.count(), asked.count()
    groups, salts = -(-n_asked // QUERY_BLOCK), max(1, -(-n_rows // (4 * CORPUS_BLOCK)))
    of = lambda n: F.pmod(F.xxhash64("part", "nth"), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    body = ["part", "nth", "dim", "ids", "units"]
    left = _packed(asked, QUERY_BLOCK // 4).select(*body, of(groups).alias("g")).select(*body, "g", every(salts, "s"))
    right = _packed(rows, CORPUS_BLOCK).select(*body, of(salts).alias("s")).select(*body, "s", every(groups, "g"))

    def meet(key, q, c):
        ids = lambda b: np.frombuffer(b["ids"], "<i8")
        q, c = q.select(["dim", "ids", "units"]).to_pylist(), c.select(["dim", "ids", "units"]).to_pylist()
        bare = [ids(b) for b in c if b["dim"] == 0]
        out = []
        for a in q:
            d = a["dim"]
            kept = _Kept(ids(a), np.frombuffer(a["units"]).reshape(-1, d), k)
            for b in c:
                if b["dim"] == d:
                    kept.meet(ids(b), np.frombuffer(b["units"]).reshape(-1, d), np.empty(0, np.int64))
            for names in bare:
                kept.meet(np.empty(0, np.int64), np.empty((0, d)), names)
            out.append(kept.batch())
        schema = pa.schema([("query_id", pa.int64()), ("row_id", pa.int64()), ("distance", pa.float64())])
        return pa.Table.from_batches(out, schema)

    return left.groupBy("g", "s").cogroup(right.groupBy("g", "s")).applyInArrow(meet, TOP_SCHEMA)


def overlaps(candidates: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, row_id, shared, n_words, lexical_score) of candidates (query_id, row_id), a bounded number for each
    query: how many of the query's distinct content words the row holds. corpus (row_id, words), queries (query_id, words).
    The score is log1p(shared) / log1p(words of the query), 0 for a query without any."""
    rows = candidates.select("query_id", "row_id").join(corpus.select("row_id", "words"), "row_id")
    rows = rows.join(queries.select("query_id", F.col("words").alias("q_words")), "query_id")
    return rows.select("query_id", "row_id", _shared().alias("shared"), F.size("q_words").alias("n_words"), _lexical().alias("lexical_score"))


def _shared():
    return F.size(F.array_intersect("words", "q_words"))


def _lexical():
    n = F.size("q_words")
    return F.when(n == 0, 0.0).otherwise(F.log1p(_shared()) / F.log1p(n))


def blended(candidates: DataFrame, weight: float = WEIGHT, top: int = TEXT_TOP) -> DataFrame:
    """The top candidates (query_id, row_id, words, q_words, dense_score, dense_rank) by (1 - w) dense + w lexical;
    equal scores keep their dense order."""
    w = min(1.0, max(0.0, weight))
    rows = candidates.withColumn("lexical_score", _lexical()).withColumn("score", (1 - w) * F.col("dense_score") + w * F.col("lexical_score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "dense_rank")
    return rows.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= top)


def hybrid(corpus: DataFrame, queries: DataFrame, top: int = TEXT_TOP, candidates: int = CANDIDATES, weight: float = WEIGHT, where=None) -> DataFrame:
    """corpus (row_id, text, embedding, ..) ranked for queries (query_id, text, embedding): hits with distance,
    dense_score, lexical_score, score and hit_rank. A blank query has no hits. `where` filters before ranking."""
    rows = corpus if where is None else corpus.where(where)
    asked = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    near = dense_top(rows, asked, candidates)
    words = content_words(F.col("text"))
    near = near.join(rows.drop("embedding"), "row_id").withColumn("words", words)
    near = near.join(asked.select("query_id", words.alias("q_words")), "query_id")
    return blended(near, weight, top).drop("words", "q_words")


def figures(corpus: DataFrame, queries: DataFrame, top: int = FIGURE_TOP) -> DataFrame:
    return hybrid(corpus, queries, top, max(3 * top, 9), FIGURE_WEIGHT)


def bundle(passages: DataFrame, pictures: DataFrame) -> DataFrame:
    """Both kinds of hits with `collection` and hit_ord, passages first."""
    both = passages.withColumn("collection", F.lit("chunks")).unionByName(pictures.withColumn("collection", F.lit("figures")), allowMissingColumns=True)
    return both.withColumn("hit_ord", F.row_number().over(Window.partitionBy("query_id").orderBy("collection", "hit_rank")) - 1)
