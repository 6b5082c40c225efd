"""The pipeline's stages in order, each against what it must keep and drop."""

from collections import Counter

import corpus_pipeline
from citeloom.llm import mixing

STAGES = dict(corpus_pipeline.STAGES)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, sf_dir)
        assert docs.columns == columns, name
        if name != "mixing":
            assert bag(docs) <= bag(before), name
        else:
            times = {r["doc_id"]: len(r["starts"]) for r in mixing.mix(before).collect() if r["starts"]}
            assert {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()} == times
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in tokens.collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ends = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_mixing_takes_rows_without_doc_id(spark, sf_dir):
    rows = [(None if s == "b" or i % 3 == 0 else i, " ".join(f"{s}{i}w{j}" for j in range(5 + i)), s) for s in "abc" for i in range(40)]
    rows += [(7, "of the same id", "a"), (None, "", "b"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = bag(corpus_pipeline.mix_sources(spark, docs, sf_dir))
    assert set(got) <= set(rows) and got[None, "", "b"] == got[None, None, None] == 1
    sizes = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    for s, _, target in mixing.targets(list(sizes.items())):  # a document comes whole, so the last one is over or under
        assert abs(sum(n * len((r[1] or "").split()) for r, n in got.items() if r[2] == s) - int(target)) <= 45, s


def test_mixing_writes_the_order_of_the_slots(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([(i, "w " * (300 + i), "ab"[i % 2]) for i in range(60)], "doc_id long, text string, source string")
    path = str(tmp_path / "mixed")
    corpus_pipeline.mix_sources(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
    got = [r[0] for r in spark.read.parquet(path).selectExpr("doc_id", "_metadata.file_name AS f").collect()]
    starts = {r["doc_id"]: r["starts"] for r in mixing.mix(docs).collect()}
    assert got == [d for _, d in sorted((s, d) for d, own in starts.items() for s in own)]


ODD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n ", None, None, None), (None, "first without an id here", "en", "b", 1), (None, "second without an id there", "en", "b", 1),
    (4, "same row twice in it", "en", "c", 5), (4, "same row twice in it", "en", "c", 5), (4, "another text of id four", "fr", None, 5), (-9, "below zero is an id too", "en", "a", 3), (5, "long " * 60_000, "en", "a", 300_000),
]


def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.selectExpr("*", "'x' AS fp", "1 AS size", "2 AS no", "3 AS slot", "'y' AS kind", "4 AS score")


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd(spark)
    rows = [(*r, "x", 1, 2, 3, "y", 4) for r in ODD]
    assert bag(STAGES["toxicity"](spark, docs, sf_dir)) == Counter(rows)
    one = bag(STAGES["near_dedup"](spark, docs, sf_dir))
    assert one == Counter(r for i, r in enumerate(rows) if i not in (1, 2, 6))
    assert bag(STAGES["decontamination"](spark, docs, sf_dir)) == Counter(rows)
    mixed = bag(STAGES["mixing"](spark, docs, sf_dir))
    assert set(mixed) <= set(rows) and all(mixed[r] == 1 for r in rows if not (r[1] or "").split())
    tokens = STAGES["token_files"](spark, docs, sf_dir).collect()
    assert Counter(r["doc_id"] for r in tokens) == Counter(r[0] for r in ODD)
    assert sum(r["n_tokens"] == 1 for r in tokens) == 2


def test_stages_of_an_empty_table(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark).limit(0), sf_dir).collect() == [], name
