"""An exact index of vectors: rows in balls, of which a question reads the near ones.

Rows are clustered by their directions and packed as blocks: the unit vectors of a block's rows as one matrix, its centre
and its radius. By the triangle inequality no row of a block is nearer to a question than the centre's distance less the
radius, so blocks are read best first, until that bound passes the k-th neighbour found. Results are those of a scan.

The driver holds a centre for each block, whose number is bounded by CENTRES and ROWS, not the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import content_words
from citeloom.functions.workers import with_python_path
from citeloom.operators.retrieval import CANDIDATES, WEIGHT, blended, cosine_distance, fine, tied
from citeloom.sources.opened import open_path

CENTRES = 1024  # clusters at most
SAMPLE = 8192  # rows that centres are learned from
ROUNDS = 8  # of assigning the sample and moving its centres
ROWS = 256  # rows of a block; more where there would be over BLOCKS blocks
BLOCKS = 16_384
FIRST = 1024  # rows that a question reads at least before it knows a bound
FILE_ROWS = 8192  # of a file
FEW = 64  # questions whose hits one task ranks
HELD = 256 << 20  # bytes of files that a worker process keeps
SLACK = 1e-9  # of rounding in bounds
BARE = -1  # the cluster of rows without a direction, at distance 1 from every question


def centres_of(units: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """n centres of unit vectors: rows chosen far from those before, moved to the means of their clusters."""
    rng = np.random.default_rng(seed)
    n = min(n, len(units))
    centres = units[rng.choice(len(units), n, replace=False)] if n else units[:0]
    for _ in range(rounds):
        own = _nearest(units, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        count = np.bincount(own, minlength=n)
        empty = np.flatnonzero(count == 0)
        centres = sums / np.maximum(count, 1)[:, None]
        if len(empty):  # a centre that lost its rows moves to one of the rows that are farthest from theirs
            far = np.argsort(np.einsum("ij,ij->i", units, centres[own]))[: len(empty)]
            centres[empty] = units[far]
    return centres


def _nearest(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = np.einsum("ij,ij->i", centres, centres) / 2
    return np.concatenate([(units[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(units), 4096)]) if len(units) else np.empty(0, np.int64)


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, whether a row has a direction) of a list array; rows without one are 0."""
    sizes = np.diff(vectors.offsets.to_numpy())
    has = sizes == dim
    x = np.zeros((len(vectors), dim))
    if has.any():
        x[has] = vectors.filter(pa.array(has)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    norm = np.linalg.norm(x, axis=1)
    return x / np.where(norm > 0, norm, 1)[:, None], norm > 0


def build(corpus: DataFrame, path: str, dim: int) -> None:
    """Writes the index of corpus (row_id, embedding, ..) at path. Further columns come along and are given with hits. Rows
    without a vector or with a zero one are kept apart; those of another length than dim and those with null or non-finite
    components, which no question finds, and null row_ids are left out."""
    spark = corpus.sparkSession
    with_python_path(spark)
    vector = F.coalesce(F.col("embedding").cast("array<double>"), F.array().cast("array<double>"))
    others = [c for c in corpus.columns if c not in ("row_id", "embedding")]
    rows = corpus.where("row_id is not null").where(F.coalesce(fine(), F.lit(True))).where(F.size(vector).isin(0, dim))
    rows = rows.select(F.col("row_id").cast("long").alias("row_id"), vector.alias("vector"), F.struct(*others, F.lit(None).alias("_")).alias("payload"))
    payload = rows.schema["payload"].dataType.simpleString()
    some = rows.where(F.size("vector") == dim).orderBy(F.xxhash64("row_id"), "row_id").limit(SAMPLE).select("vector").toArrow()
    units, has = _matrix(pa.concat_arrays(some.column(0).chunks) if some.num_rows else pa.array([], pa.list_(pa.float64())), dim)
    total = rows.count()
    shared = spark.sparkContext.broadcast(centres_of(units[has], min(CENTRES, int(np.sqrt(total)) + 1)))

    def assign(batches):
        for b in batches:
            x, has = _matrix(b.column(1), dim)
            ball = np.full(b.num_rows, BARE, np.int32)
            ball[has] = _nearest(x[has], shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ball)], [*b.schema.names, "ball"])

    most = max(ROWS, -(-total // BLOCKS))
    balls = rows.mapInArrow(assign, f"row_id long, vector array<double>, payload {payload}, ball int").persist()
    sizes = balls.groupBy("ball").count().select("ball", F.ceil(F.col("count") / most).alias("salts"))
    dealt = balls.join(F.broadcast(sizes), "ball").select("ball", F.pmod(F.xxhash64("row_id"), "salts").alias("salt"), "row_id", "vector", "payload")

    def pack(batches):
        held, key, n = [], None, 0

        def block():
            nonlocal n
            table = pa.Table.from_batches(held).combine_chunks()
            x, has = _matrix(table.column("vector").chunk(0), dim)
            centre = x.mean(axis=0)
            radius = float(np.linalg.norm(x - centre, axis=1).max())
            n += 1
            number = TaskContext.get().partitionId() << 32 | n
            ids = table.column("row_id").to_numpy().astype("<i8").tobytes()
            own = table.column("payload").chunk(0)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(x)], pa.int32()), pa.array([not has.any()]), pa.array([centre.tolist()]), pa.array([radius]), pa.array([ids]), pa.array([x.tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), own)],
                ["block", "n", "bare", "centre", "radius", "ids", "units", "payload"],
            )

        for b in batches:
            keys = np.c_[b.column(0).to_numpy(), b.column(1).to_numpy()]
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for i, j in zip([0, *cut], [*cut, len(keys)], strict=True):
                if held and tuple(keys[i]) != key:
                    yield block()
                    held.clear()
                key = tuple(keys[i])
                held.append(b.slice(i, j - i))
        if held:
            yield block()

    packed = dealt.repartition("ball", "salt").sortWithinPartitions("ball", "salt").mapInArrow(
        pack, f"block long, n int, bare boolean, centre array<double>, radius double, ids binary, units binary, payload array<{payload}>"
    )
    packed.write.mode("overwrite").option("maxRecordsPerFile", max(1, FILE_ROWS // most)).parquet(path)
    balls.unpersist()


_files: dict[str, tuple] = {}  # of this worker process, by their use


def _opened(path: str, open_file) -> tuple[dict[int, int], pa.Table]:
    """({block: row}, table) of a file of the index, kept in this process for the next questions, up to HELD bytes."""
    found = _files.pop(path, None)
    if found is None:
        with open_file(path) as file:
            table = pq.read_table(pa.BufferReader(file.read()), columns=["block", "ids", "units", "payload"])
        found = {b: i for i, b in enumerate(table.column("block").to_pylist())}, table.combine_chunks()
    _files[path] = found
    while len(_files) > 1 and sum(t.nbytes for _, t in _files.values()) > HELD:
        del _files[next(iter(_files))]
    return found


class BallIndex:
    """An index that build() wrote, open for questions: tasks open its files by their paths and keep them for the next."""

    def __init__(self, spark: SparkSession, path: str, open_file: Callable = open_path):
        self.spark, self.open_file = spark, open_file
        with_python_path(spark)
        blocks = spark.read.parquet(path)
        meta = blocks.select("block", "n", "bare", "centre", "radius", F.col("_metadata.file_path").alias("file")).toArrow()
        self.block, self.n, self.bare, self.radius = (meta.column(c).to_numpy() for c in ("block", "n", "bare", "radius"))
        self.centre = np.array(meta.column("centre").to_pylist()) if len(self.block) else np.empty((0, 0))
        self.file = [unquote(f) for f in meta.column("file").to_pylist()]
        self.payload = blocks.schema["payload"].dataType.elementType
        self.rows_read = 0

    def _bounds(self, units: np.ndarray) -> np.ndarray:
        """(questions, blocks): no row of a block is at a smaller cosine distance."""
        square = 1 + np.einsum("ij,ij->i", self.centre, self.centre) - 2 * units @ self.centre.T
        apart = np.maximum(0, np.sqrt(np.maximum(0, square)) - self.radius)
        return np.where(self.bare, 1.0, apart * apart / 2) - SLACK

    def _read(self, wanted: np.ndarray, names: np.ndarray, units: np.ndarray, k: int) -> pa.Table:
        """The k nearest rows (query_id, row_id, distance, payload) of each question in the blocks that it wants, task by
        task."""
        some = np.flatnonzero(wanted.any(axis=0))
        self.rows_read += int(self.n[some].sum())
        by_file: dict[str, list[int]] = {}
        for i in some.tolist():
            by_file.setdefault(self.file[i], []).append(i)
        asked_of = {int(self.block[i]): np.flatnonzero(wanted[:, i]) for i in some}
        number, open_file = self.block.tolist(), self.open_file

        def run(batches):
            for b in batches:
                for path, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    row_of, table = _opened(path, open_file)
                    ids, units_of, payload = (table.column(c).chunk(0) for c in ("ids", "units", "payload"))
                    held: dict[int, list] = {}
                    for i in own:
                        r = row_of[number[i]]
                        names_of = np.frombuffer(ids[r].as_buffer(), "<i8")
                        x = np.frombuffer(units_of[r].as_buffer(), np.float64).reshape(len(names_of), -1)
                        asked = asked_of[number[i]]
                        for q, d in zip(asked.tolist(), cosine_distance(units[asked], x), strict=True):
                            near = np.lexsort((names_of, tied(d)))[:k]
                            held.setdefault(q, []).append((d[near], names_of[near], payload.offsets[r].as_py() + near))
                    for q, found in held.items():
                        d, rows, at = (np.concatenate(x) for x in zip(*found, strict=True))
                        best = np.lexsort((rows, tied(d)))[:k]
                        taken = payload.values.take(pa.array(at[best]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), names[q])), pa.array(rows[best]), pa.array(d[best]), taken], ["query_id", "row_id", "distance", "payload"])

        files = self.spark.createDataFrame(pa.table({"file": pa.array(list(by_file)), "blocks": pa.array(list(by_file.values()), pa.list_(pa.int32()))}))
        return files.mapInArrow(run, f"query_id long, row_id long, distance double, payload {self.payload.simpleString()}").toArrow()

    def top(self, questions: list[tuple[int, list[float]]], k: int = CANDIDATES, said: dict[int, str] | None = None) -> DataFrame:
        """(query_id, row_id, distance, dense_score, dense_rank, the further columns and question, what is said by the
        questions' ids) of the k rows of least cosine distance to each of some questions (id, vector), ties by row_id, as
        dense_top() gives them. Questions without a
        direction, of another length or with null or non-finite components have no neighbours."""
        asked = [] if not len(self.block) else [(q, np.array(v, float)) for q, v in questions if v is not None and len(v) == self.centre.shape[1] and None not in v]
        asked = [(q, v / np.linalg.norm(v)) for q, v in asked if np.isfinite(v).all() and v.any()]
        names, units = np.array([q for q, _ in asked], np.int64), np.array([v for _, v in asked]).reshape(len(asked), self.centre.shape[1])
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.payload.fields if f.name != "_")
        schema = f"query_id long, row_id long, distance double, dense_score double, dense_rank int, question string{', ' * bool(fields)}{fields}"
        if not asked:
            return self.spark.createDataFrame([], schema)
        bound = self._bounds(units)
        order = np.argsort(bound, axis=1, kind="stable")
        ahead = np.cumsum(self.n[order], axis=1) - self.n[order]
        wanted = np.zeros(bound.shape, bool)
        np.put_along_axis(wanted, order, ahead < max(k, FIRST), axis=1)
        found = self._read(wanted, names, units, k)
        last = self._kth(found, names, k)
        more = (bound <= last[:, None]) & ~wanted
        if more.any():
            found = pa.concat_tables([found, self._read(more, names, units, k)])
        found = self._best(found, k)
        rank = _within(found.column("query_id").to_numpy()) + 1
        distance = found.column("distance").to_numpy()
        payload = pa.concat_arrays(found.column("payload").chunks) if found.num_rows else None
        columns = {"query_id": found.column("query_id"), "row_id": found.column("row_id"), "distance": distance, "dense_score": np.maximum(0.0, 1 - distance), "dense_rank": pa.array(rank, pa.int32())}
        columns["question"] = pa.array([(said or {}).get(q) for q in found.column("query_id").to_pylist()], pa.string())
        columns |= {f.name: payload.field(f.name) for f in self.payload.fields if f.name != "_"} if payload is not None else {}
        return self.spark.createDataFrame(pa.table(columns), schema) if found.num_rows else self.spark.createDataFrame([], schema)

    @staticmethod
    def _best(found: pa.Table, k: int) -> pa.Table:
        """The k nearest rows of each question, nearest first."""
        q, r, d = (found.column(c).to_numpy() for c in ("query_id", "row_id", "distance"))
        order = np.lexsort((r, tied(d), q))
        return found.take(pa.array(order[_within(q[order]) < k]))

    def _kth(self, found: pa.Table, names: np.ndarray, k: int) -> np.ndarray:
        """The distance of each question's k-th row so far, infinite where it has fewer."""
        best = self._best(found, k)
        q, d = best.column("query_id").to_numpy(), best.column("distance").to_numpy()
        full = _within(q) == k - 1
        known = dict(zip(q[full].tolist(), d[full].tolist(), strict=True))
        return np.array([known.get(n, np.inf) for n in names.tolist()])

    def hybrid(self, questions: list[tuple[int, str, list[float]]], top: int, candidates: int = CANDIDATES, weight: float = WEIGHT) -> DataFrame:
        """retrieval.hybrid() for some questions (id, text, vector) over an index whose rows have a text."""
        asked = {q: (t, v) for q, t, v in questions if (t or "").strip()}
        near = self.top([(q, v) for q, (_, v) in asked.items()], candidates, {q: t for q, (t, _) in asked.items()})
        near = near.withColumns({"words": content_words(F.col("text")), "q_words": content_words(F.col("question"))})
        return blended(near.coalesce(1) if len(asked) <= FEW else near, weight, top).drop("words", "q_words", "question")


def _within(keys: np.ndarray) -> np.ndarray:
    """Each place's number within its run of equal keys, from 0."""
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return np.arange(len(keys)) - first[np.cumsum(new) - 1] if len(keys) else np.empty(0, np.int64)
