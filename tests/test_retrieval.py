"""Nearest rows by scans, by dealt blocks and by the ball index, against a plain loop."""

import math
import random

import numpy as np
import pytest

from citeloom.operators import ball_index, retrieval
from citeloom.operators.ball_index import BallIndex


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        if v is None or not any(v) or any(x is None or not math.isfinite(x) for x in v):
            continue
        unit, near = np.array(v) / np.linalg.norm(v), []
        for r, w, _ in rows:
            if r is None or (w and (len(w) != len(v) or any(x is None or not math.isfinite(x) for x in w))):
                continue
            d = 1 - float(unit @ (np.array(w) / np.linalg.norm(w))) if w and any(w) else 1.0
            near.append((round(d, 12), r, d))
        out += [(q, r, round(d, 9), n) for n, (_, r, d) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    """Rows in clusters, equal ones, odd ones."""
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        rows += [(len(rows) + i, (centre + 0.15 * rng.normal(size=16)).tolist(), f"text {c}") for i in range(150)]
    rows += [(5000 + i, rows[3][1], "same vector") for i in range(700)]
    rows += [(6000, None, "none"), (6001, [], "empty"), (6002, [0.0] * 16, "zero"), (6003, [1.0] * 9, "short"), (6004, [math.nan] * 16, "nan"), (6005, [None, *[1.0] * 15], "null"), (None, [1.0] * 16, "no id"), (6006, [math.inf] * 16, "inf")]
    asked = [(i, rows[(i * 37) % 1800][1]) for i in range(40)] + [(100, [0.0] * 16), (101, None), (102, [1.0] * 9), (103, [math.nan] * 16), (104, (-np.array(rows[0][1])).tolist())]
    random.Random(1).shuffle(rows)
    return rows, asked


def found(df):
    return sorted((r["query_id"], r["row_id"], round(r["distance"], 9), r["dense_rank"]) for r in df.collect())


@pytest.mark.parametrize(("questions", "corpus"), [(2000, 8192), (7, 100), (40, 400)])
def test_dense_top_equals_brute_force(spark, vectors, questions, corpus, monkeypatch):
    rows, asked = vectors
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", questions)
    monkeypatch.setattr(retrieval, "CORPUS_BLOCK", corpus)
    table = spark.createDataFrame(rows, "row_id long, embedding array<double>, text string").repartition(5)
    got = found(retrieval.dense_top(table, spark.createDataFrame(asked, "query_id long, embedding array<double>").repartition(3), 24))
    assert got == brute(rows, asked, 24)


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "a b%20c")
    ball_index.build(spark.createDataFrame(vectors[0], "row_id long, embedding array<double>, text string").repartition(5), path, 16)
    return BallIndex(spark, path)


def test_index_equals_brute_force_and_reads_few_rows(spark, vectors, index):
    rows, asked = vectors
    assert found(index.top(asked)) == brute(rows, [a for a in asked if a[1] is None or len(a[1]) == 16], 24)
    for q, v in asked[:10]:
        index.rows_read = 0
        assert index.top([(q, v)]).count() == 24
        assert index.rows_read <= len(rows) / 2  # FIRST rows and what ties with them: a third of the rows are copies
    assert index.top([]).count() == index.top([(1, [0.0] * 16)]).count() == 0


def test_index_reads_a_fifth_of_clustered_rows(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + 0.1 * rng.normal(size=24)).tolist()) for i in range(9000)]
    ball_index.build(spark.createDataFrame(rows, "row_id long, embedding array<double>"), str(tmp_path / "i"), 24)
    index = BallIndex(spark, str(tmp_path / "i"))
    asked = [(i, rows[i * 7][1]) for i in range(5)]
    for one in asked:
        index.rows_read = 0
        got = found(index.top([one]))
        assert got == brute([(*r, "") for r in rows], [one], 24) and index.rows_read <= len(rows) / 5


def test_hybrid_by_index_equals_the_scan(spark, vectors, index):
    rows, asked = vectors
    said = [(q, "text 3 same words here" if q % 2 else "  " if q == 4 else "vector of text", v) for q, v in asked]
    table = spark.createDataFrame(rows, "row_id long, embedding array<double>, text string")
    same = lambda df: sorted((r["query_id"], r["hit_rank"], r["row_id"], r["text"], round(r["score"], 9)) for r in df.collect())
    want = same(retrieval.hybrid(table, spark.createDataFrame([a for a in said if a[2] is None or len(a[2]) == 16], "query_id long, text string, embedding array<double>")))
    assert same(index.hybrid(said, 5)) == want
    assert same(index.hybrid(said[:1], 5)) == [w for w in want if w[0] == said[0][0]]


def test_index_of_no_rows(spark, tmp_path):
    ball_index.build(spark.createDataFrame([], "row_id long, embedding array<double>, text string"), str(tmp_path / "i"), 4)
    index = BallIndex(spark, str(tmp_path / "i"))
    assert index.hybrid([(1, "a question", [1.0] * 4)], 5).count() == 0
