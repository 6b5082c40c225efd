"""The registered queries over the smallest tables: beside their SQL, or against what their operators are tested to give."""

import os
import zlib

import duckdb
import numpy as np
import pytest

from citeloom.llm import license, queries, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_hnsw": ["query_id", "rank", "vec_id", "score"],
    "op3_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_decontam": ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
    "op7_mix": ["doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots"],
    "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_token_counts": ["doc_id", "start", "n_tokens"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_quality": ["doc_id", "held_out", "score", "predicted"],
    "op13_importance": ["doc_id", "n_features", "weight", "score", "rank"],
    "pipeline": ["doc_id", "start", "n_tokens", "ids_crc32"],
}
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in row) for row in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in df.select(columns).collect()) == want


def test_license_sql_has_the_rule_of_the_query(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for text, _ in license.NOTICES:
        words = text.split(" ")
        for _ in range(6):
            own = list(words)
            for _ in range(rng.integers(0, 4)):  # words that are missing, put in, exchanged or repeated
                at = int(rng.integers(0, len(own)))
                own[at : at + 1] = [[], ["and", own[at]], ["other"], [own[at]] * 2][rng.integers(0, 4)]
            rows.append(" ".join(["some text", *own, "ends.", *(own[::-1] if rng.random() < 0.2 else []), *(own if rng.random() < 0.2 else [])]))
    rows += ["permission is hereby granted free of charge to person obtaining a copy of this software", None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{next((tmp_path / 'docs').glob('*.parquet'))}'")
    cursor = con.execute(queries.license_sql())
    columns = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(v) for v in row) for row in cursor.fetchall())
    assert sorted(tuple(plain(v) for v in row) for row in license.scan(docs).select(columns).collect()) == want
    assert sum(row[columns.index("labels")] != "" for row in want) > len(rows) / 2


@pytest.fixture(scope="module")
def texts(spark):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_fingerprints_are_in_hex(spark, texts):
    for r in queries.op1_simhash(spark, SF).collect():
        assert r["fingerprint"] == f"{simhash.fingerprint(texts[r['doc_id']]) % 2**64:016x}"


def test_tokens_of_both_queries_agree(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts.items()}
    got = sorted(queries.op3_token_files(spark, SF).collect())
    assert [r["doc_id"] for r in got] == sorted(texts)
    at = 0
    for r in got:
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert {r["doc_id"]: r["n_tokens"] for r in queries.op9_token_counts(spark, SF).collect()} == {d: len(x) for d, x in ids.items()}


def test_held_out_rows_and_predictions(spark, texts):
    for name, base, rest in (("op8_language", 4, 2), ("op10_toxicity", 5, 0), ("op12_quality", 4, 2)):
        rows = queries.queries()[name](spark, SF).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(texts)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % base == rest) and 0 <= r["score"] <= 1 for r in rows)
        assert name == "op8_language" or all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_empty_tables(spark, tmp_path, name):
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    rows = queries.queries()[name](spark, str(tmp_path))
    assert rows.columns == COLUMNS[name] and rows.collect() == []
