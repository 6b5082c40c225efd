"""Collocations, quality and importance against brute force on small fixtures, with nulls, empty and long texts, ties,
repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import collocations, importance, quality

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").encode().translate(UPPER).decode()


# collocations


def brute_collocations(rows, most_words=3, least=10, top=2000):
    n, f = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in known.items():
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            held = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in known.items())
            if not held:
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)] + ["É", "ß ü", "\x00z", "日本"]
    fixed = ["new york city", "red, green", "New  York", "a\tb c", "x y x y x"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randrange(40)))
        rows.append((text + rng.choice(["", ".", "\n", "!?"]), rng.choice(["en", "de", None, "und"])))
    rows += [("same words here", "fr")] * 12 + [(None, "en"), ("", None), ("...", "de"), ("x " * 30_000, "es"), ("y" * 100_000, "es")]
    return rows


@pytest.mark.parametrize(("most_words", "slices", "bits"), [(3, (1 << 18, 1 << 20), 27), (3, (40, 100), 27), (4, (1 << 18, 1 << 20), 3)])
def test_collocations_equal_brute_force(spark, spoken, most_words, slices, bits, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 3000)
    docs = spark.createDataFrame(spoken, "text string, lang string").selectExpr("*", "1 AS n", "'q' AS phrase", "2 AS a").repartition(3)
    got = collocations.collocations(docs, most_words, slice_size=slices[0], at_once=slices[1], bits=bits).collect()
    want = brute_collocations(spoken, most_words)
    assert len(want) > 100
    assert sorted(map(tuple, got)) == want


def test_collocations_are_cut_at_the_top_with_ties(spark):
    rows = [("p q, r s, t u", "en")] * 10 + [("a b", "de")] * 9
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), top=2).orderBy("rank").collect()
    assert [(r["lang"], r["rank"], r["phrase"], r["score"]) for r in got] == [("en", 1, "p q", 1_000_000), ("en", 2, "r s", 1_000_000)]
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_large_counts_are_exact(spark):
    found = spark.createDataFrame([("en", "a b", 30_000_000_000_007)], "lang string, phrase string, a long")
    words = spark.createDataFrame([("en", "a", 40_000_000_000_001), ("en", "b", 30_000_000_000_011)], "lang string, word string, f long")
    row = collocations.ranked(found, words).first()
    assert row["score"] == 1_000_000 * 30_000_000_000_007**2 // (40_000_000_000_001 * 30_000_000_000_011)


def test_more_tries_take_no_more_jobs(spark, spoken):
    docs = spark.createDataFrame(spoken, "text string, lang string").repartition(3)
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for at_once in (1 << 20, 30):
        spark.sparkContext.setJobGroup(f"tries of {at_once}", "collocations")
        collocations.collocations(docs, slice_size=30, at_once=at_once).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"tries of {at_once}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[1] <= jobs[0]


def test_runs_that_are_held_in_parts_are_counted_whole(spark, spoken, monkeypatch):
    for name, size in (("BLOCK_WORDS", 500), ("HELD_RUNS", 400), ("HELD_WORDS", 600), ("SPLIT_BYTES", 1000)):
        monkeypatch.setattr(collocations, name, size)
    got = collocations.collocations(spark.createDataFrame(spoken, "text string, lang string").repartition(3), 4).collect()
    assert sorted(map(tuple, got)) == brute_collocations(spoken, 4)


def test_distinct_rows_of_large_numbers():
    rows = [(1, 2**31 - 1, 2**31 - 2, 7), (1, 2**31 - 1, 2**31 - 2, 7), (0, 5, 0, 2**31 - 1), (0, 5, 1, 0), (1, 2**31 - 1, 2**31 - 3, 7)]
    columns, n = collocations._distinct([np.array(c) for c in zip(*rows, strict=True)], np.array([1, 2, 4, 8, 16]))
    assert list(zip(*(c.tolist() for c in columns), n.tolist(), strict=True)) == [(0, 5, 0, 2**31 - 1, 4), (0, 5, 1, 0, 8), (1, 2**31 - 1, 2**31 - 3, 7, 16), (1, 2**31 - 1, 2**31 - 2, 7, 3)]


def test_tries_count_all_places():
    rng = random.Random(2)
    words = [b"v%d" % i for i in range(50)]
    phrases = sorted({b" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(2000)})
    trie = collocations.trie_of(phrases)
    number = {w: i for i, w in enumerate(trie.words, 1)}
    text = [rng.choice([*words, b"other", b"\n"]) for _ in range(5000)]
    want = Counter(b" ".join(text[i : i + k]) for k in range(1, 5) for i in range(len(text) - k + 1))
    got = trie.counts(np.array([number.get(w, 0) for w in text], np.int32))
    assert got.tolist() == [want[p] for p in phrases]
    assert collocations.trie_of([]).counts(np.zeros(3, np.int32)).tolist() == []


# quality


GOOD = ["the river runs past the old mill", "she wrote a long letter to her friend", "rain fell on the quiet town", "we walked home after the concert"]
BAD = ["BUY NOW!! $$$ CLICK", "| 12 | 99 | n/a |", "### *** %%% &&&", "zz zz zz zz zz zz"]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        docs.append((i, " ".join(rng.choice(GOOD if good else BAD) for _ in range(rng.randrange(3, 30)))))
        labels.append((i, int(good)))
    docs += [(9000, None), (9001, ""), (None, "the river runs past the old mill " * 5), (9002, "the river runs past the old mill " * 20_000), (5, docs[5][1])]
    labels += [(0, 1), (None, 1), (3, None), (123_456, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS good", "'x' AS h", "0 AS quality")
    return docs, frame, spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "'t' AS text", "0 AS toxic")


def test_quality_of_held_out_texts(judged):
    docs, frame, labels = judged
    found = quality.scores(frame, quality.train(frame, labels)).collect()
    assert sorted(map(str, (r["doc_id"] for r in found))) == sorted(str(d) for d, _ in docs)
    assert all(0 <= r["score"] <= 1 for r in found)
    out = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(out) > 100 and np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 != 0) for r in out]) > 0.97
    by_id = {r["doc_id"]: r["score"] for r in found}
    assert by_id[None] > 0.7 and by_id[9002] > 0.7 and by_id[9000] == by_id[9001]


def test_quality_equals_a_plain_loop(judged):
    docs, frame, labels = judged
    model = quality.train(frame, labels)

    def plain(text):
        import zstandard

        data, sizes = (text or "").encode(), []
        n = -(-len(data) // quality.PIECE)
        for content in (model["good"], model["bad"]):
            kind = zstandard.DICT_TYPE_AUTO if content.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_RAWCONTENT
            one = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(one.compress(data[len(data) * i // n : len(data) * (i + 1) // n])) for i in range(n)))
        x = (sizes[1] - sizes[0]) / max(1, sum(sizes))
        return 1 / (1 + math.exp(-max(-30, min(30, model["curve"][0] * x + model["curve"][1]))))

    got = quality.Judge(model).scores([t for _, t in docs])
    assert np.allclose(got, [plain(t) for _, t in docs], atol=0.02)
    assert quality.Judge(model).scores([None, ""]).tolist() == [pytest.approx(1 / (1 + math.exp(-model["curve"][1])))] * 2


def test_quality_trains_on_a_bounded_sample(spark, monkeypatch):
    sent = []
    monkeypatch.setattr(quality, "fit", lambda pieces, labels, totals: sent.append((len(pieces), max(map(len, pieces)), sorted(set(labels)), totals)))
    docs = spark.range(20_000).selectExpr("0L AS doc_id", "concat('text ', id % 500, repeat(' more', 3000)) AS text")
    docs = docs.unionByName(spark.range(2000, 2100).selectExpr("id AS doc_id", "'other text' AS text"))
    labels = spark.range(2000, 2100).selectExpr("id AS doc_id", "1 AS quality").unionByName(spark.range(0, 1).selectExpr("id AS doc_id", "0 AS quality"))
    quality.train(docs, labels, sample=40, per_text=3)
    (n, most, classes, totals), = sent
    assert 60 <= n <= 80 and most <= 3 and classes == [0, 1] and totals[0] == 1


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(1, 1)], 1 / (1 + math.exp(-6))), ([(1, 0)], 1 / (1 + math.exp(6)))])
def test_quality_of_one_class(spark, labels, score):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r["score"] for r in quality.scores(docs, model).collect()] == [pytest.approx(score)] * 2
    assert quality.scores(docs.limit(0), model).count() == 0


# importance


def brute_importance(docs, target, percent=25, least=20, buckets=10_000):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    def features(text):
        w = words(text)
        return [zlib.crc32(r.encode()) % buckets for r in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    s, t = (Counter(b for text in texts for b in features(text)) for texts in ([x for _, x in docs], target))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {i: n for n, i in enumerate((id(r) for r in able[: len(able) * percent // 100]), 1)}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (None, "no id " * 20), (904, "É" * 400 + " ß " * 30), (905, "a " * 30_000), (906, "long" * 30_000 + " end"), (907, "9 x-y_z " * 9)]
    docs += [(908, "many rows of one id " * 6)] * 150 + [(909 + i, "equal words in unlike rows " * 5) for i in range(60)]
    target = [r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text").collect()] + [None, ""]
    return docs, target


@pytest.mark.parametrize("block", [importance.BLOCK_BYTES, 500])
def test_importance_equals_brute_force(spark, corpus, block, monkeypatch):
    docs, target = corpus
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    monkeypatch.setattr(importance.pieces, "__defaults__", (block,))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'z' AS k0", "2 AS n_words").repartition(5)
    got = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_importance(docs, target)


def test_texts_cut_in_pieces_hold_the_same_runs():
    text = "alpha Beta, gamma delta " * 50 + "x" * 300 + " end of it"
    whole = Counter(b for runs in importance.blocks([text], 3) for b in runs.crc.tolist())
    for most in (1, 7, 40, 250):
        found, words = Counter(), 0
        for data, carried in importance.pieces(text, 3, most):
            runs = importance.Runs([(0, data, carried)], 3)
            found.update(runs.crc.tolist())
            words += len(runs.words)
        assert found == whole and words == 204


@pytest.mark.parametrize("samples", [importance.SAMPLES, 10])
def test_ranks_of_many_runs(spark, samples):
    rng = np.random.default_rng(4)
    rows = [(int(a), 0, int(b), 0, i) for i, (a, b) in enumerate(zip(rng.integers(0, 9, 3000), rng.integers(-4, 4, 3000), strict=True))]
    frame = spark.createDataFrame(rows, "k0 long, k1 long, k2 long, k3 long, k4 long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        got = importance.ranked(frame, len(rows), samples).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r)[:5] for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))


def test_importance_of_empty_tables(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    few = [(1, "just a few words"), (2, None)]
    got = importance.resample(spark.createDataFrame(few, "doc_id long, text string"), none).collect()
    assert sorted(map(tuple, got), key=str) == brute_importance(few, [])
