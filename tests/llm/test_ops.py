"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties and clashing columns."""

import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import decontam, hnsw, langid, license, mixing, nearcopies, simhash, tokencount, tokenfile, toxicity, urlfilter
from citeloom.llm.components import connected_components
from citeloom.llm.elias_fano import EliasFano
from citeloom.llm.queries import RULES, tokenizer_path
from citeloom.llm.shared import new_path

ODD = [(900, None), (901, ""), (902, " \n\t "), (903, "one two"), (903, "one two"), (904, "x" * 3000 + " end"), (None, "no id here at all"), (905, "a " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += ODD
    return rows


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'z' AS fp", "1 AS n", "text AS words", "'q' AS source") if extra else df


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_simhash_equals_brute_force(spark, docs, hot):
    rng = random.Random(1)
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(300)).split()
    near = []
    for i in range(40):  # a class of near copies, each a few words apart
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = "new"
        near.append((1000 + i, " ".join(w)))
    rows = [r for r in docs if r[0] is None or r[0] < 60 or r[0] >= 900] + near
    got = simhash.near_duplicates(frame(spark, rows), hot=hot).collect()
    assert len(got) == len(rows)
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    assert sorted((d or -1, f % 2**64) for d, f, _ in got) == sorted((d or -1, f) for d, f in fps)
    known = [(d, f) for d, f in fps if d is not None]
    want = classes({d for d, _ in known}, [(a, b) for a, f in known for b, g in known if a != b and (f ^ g).bit_count() <= 4])
    assert {d: c for d, _, c in got if d is not None} == want


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(0)
    for n in (1, 17, 300, 900):
        centre = rng.integers(0, 2**63, 8).astype(np.uint64)
        codes = centre[rng.integers(0, 8, n)]
        for _ in range(5):
            codes = codes ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
        codes = np.unique(codes)
        label = simhash.GrayIndex(codes).links()
        near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
        want = classes(range(len(codes)), zip(*map(list, np.nonzero(np.triu(near, 1))), strict=True))
        assert label.tolist() == [want[i] for i in range(len(codes))]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    rows = spark.createDataFrame([(a, b) for a, b in chain], "a long, b long")
    got = dict(connected_components(spark, rows).collect())
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(50)}
    assert connected_components(spark, rows.limit(0)).collect() == []


def test_keep_one(spark, docs):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "A b c\nd e"), (3, "p q r s t"), (3, "of the same id"), (None, "a b c d e"), (None, "without an id"), (4, None), (5, ""), (None, " ")]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert Counter((r[0], r[1]) for r in kept) == Counter([(1, "a b c d e"), (3, "p q r s t"), (3, "of the same id"), (None, "without an id"), (4, None)])
    assert simhash.keep_one(frame(spark, rows).limit(0)).collect() == []


def brute_shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {b" ".join(words)}


def test_keep_one_equals_brute_force(spark, docs):
    rng = random.Random(5)
    rows = [r for r in docs if r[0] is not None]
    for n in (6, 30, 200, 600):  # near copies about 0.8, also a crowd of them, which share every shingle
        base = [f"v{rng.randrange(10**5)}" for _ in range(n)]
        for i in range(60 if n == 200 else 12):
            w = list(base)
            for _ in range(rng.randrange(1 + n // 25)):
                w[rng.randrange(n)] = f"u{rng.randrange(10**6)}"
            rows.append((10_000 + 100 * n + i, " ".join(w[: n - rng.randrange(1 + n // 10)])))
    sets = {i: brute_shingles(t) for i, t in rows}
    ids = sorted(sets)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert any((simhash.fingerprint(dict(rows)[a]) ^ simhash.fingerprint(dict(rows)[b])).bit_count() > 4 for a, b in near)
    want = set(classes(ids, near).values())
    kept = [r[0] for r in simhash.keep_one(frame(spark, rows).repartition(3)).collect()]
    assert sorted(kept) == sorted(want)


def test_near_copies_make_few_pairs(spark, monkeypatch):
    rng, looked_at = random.Random(3), []
    base, rows = [f"w{rng.randrange(3000)}" for _ in range(150)], []
    for i in range(1600):  # about half of them are near to many others, the rest to none
        w = list(base)
        for _ in range(min(12, int(rng.expovariate(1 / 3.5)))):
            w[rng.randrange(150)] += rng.choice("abcdefgh")
        rows.append((i, " ".join(w)))
    written = nearcopies.written

    def counting(df, what):
        got = written(df, what)
        looked_at.extend([got.count()] if what == "pairs" else [])
        return got

    monkeypatch.setattr(nearcopies, "written", counting)
    kept = sorted(r[0] for r in simhash.keep_one(frame(spark, rows)).collect())
    assert 0 < sum(looked_at) <= 20 * len(rows)
    sets = [nearcopies.shingles(t) for _, t in rows]
    places = {x: k for k, x in enumerate(np.unique(np.concatenate(sets)).tolist())}
    held = np.zeros((len(sets), len(places)), np.float32)
    for i, codes in enumerate(sets):
        held[i, [places[x] for x in codes.tolist()]] = 1
    same, size = held @ held.T, held.sum(axis=1)
    near = np.argwhere(5 * same >= 4 * (size[:, None] + size - same))
    assert kept == sorted(set(classes(range(len(rows)), near.tolist()).values()))


def brute_neighbours(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in good:
        if q in queries:
            near = sorted(((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def found_by_query(rows):
    found = {}
    for q, rank, i, score in rows:
        assert rank not in found.setdefault(q, {})
        found[q][rank] = (i, score)
    assert all(sorted(f) == list(range(1, len(f) + 1)) for f in found.values())
    return {q: [f[r] for r in sorted(f)] for q, f in found.items()}


def recall(found, want):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want) / sum(map(len, want.values()))


@pytest.mark.parametrize("shard_rows", [hnsw.SHARD_ROWS, 150])
def test_hnsw_recall_and_odd_vectors(spark, sf_dir, shard_rows):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(40)] + [(2000, None), (2020, [0.0] * 64), (2040, [float("nan")] * 64), (2060, [None] + [1.0] * 63), (2080, [x * 3 for x in rows[3][1]]), (-20, [1.0, 2.0]), (-40, [2.0, 1.0]), (-41, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS shard", "0 AS kind")
    index = hnsw.build_index(df, shard_rows=shard_rows)
    got = hnsw.search(index, df.where("vec_id % 20 = 0"), 20).collect()
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    found = found_by_query(got)
    assert found.keys() == want.keys() and all(len(found[q]) == len(want[q]) for q in want)
    assert recall(found, want) >= 0.95 and found[-20] == want[-20]
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, _, i, s in got if (q, i) in exact)
    assert hnsw.search(hnsw.build_index(df.limit(0)), df, 3).collect() == []


def test_hnsw_of_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(5, [9.0] + [0.0] * 7), (5, [9.0] + [0.0] * 7), (20, [5.0] * 8), (20, [-5.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = found_by_query(hnsw.search(hnsw.build_index(df), df.where("vec_id % 20 = 0"), 20).collect())
    for q, near in found.items():
        asked = min(v for i, v in rows if i == q)
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -np.inf), float(np.dot(asked, v)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
        assert [i for i, _ in near] == [i for i, _ in want]


def test_hnsw_routes_queries(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(30, 16)) * 4
    x = (centre[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = hnsw.build_index(df, shard_rows=300)
    assert index.count() >= 20 and index.agg(F.sum("rows")).first()[0] == 6000
    queries = df.where("vec_id % 20 = 0")
    found = found_by_query(hnsw.search(index, queries, 20).collect())
    x = x.astype(float)
    want = {q: [(int(i), 0.0) for i in sorted(range(6000), key=lambda j: -s[j]) if i != q][:20] for q in range(0, 6000, 300) for s in [x @ x[q]]}
    assert recall({q: found[q] for q in want}, want) >= 0.95
    mean, variance, n = (np.array(c) for c in zip(*index.select("mean", "variance", "rows").collect(), strict=True))
    assert hnsw.routes(x[::300], mean, variance, n, 20).mean() < 0.5


def test_elias_fano_round_trip():
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 0), (1, 10**9), (500, 3), (1000, 10**6), (129, 10**12)):
        v = np.sort(rng.integers(0, top + 1, n))
        code = EliasFano.encode(v)
        assert code.slice(0, n).tolist() == v.tolist()
        for a, b in ((n // 3, n // 2), (n // 2, n), (0, min(n, 65))):
            assert code.slice(a, b).tolist() == v[a:b].tolist()
        assert [code.rank(x) for x in (0, top // 2, top + 1)] == [int((v < x).sum()) for x in (0, top // 2, top + 1)]
        assert [code.select(i) for i in range(n)] == v.tolist()
        if n >= 500:
            assert len(code.low) + len(code.high) < n * (2 + max(1, np.log2((top + 1) / n))) / 8 + 16
    with pytest.raises(IndexError):
        EliasFano.encode([1]).select(1)


HARD = ["it's  we'll\n\n he'd\t\tX", "½ ² Ⅷ x٣ naïve e\u0301", "a\u00a0b\u2003c\x1cd", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", "  lead and trail  ", "é ñandú 'S don'T", "日本語 テスト 🎉🎉 ok", "a_b __ -- ?!", "\r\nx\r\n"]


def test_tokens_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = docs + [(950 + i, t) for i, t in enumerate(HARD)] + [(-1, "minus one"), (-5, "minus five"), (-(2**63), "least"), (2**63 - 1, "most"), (None, "second without id")]
    path = new_path(spark, "test")
    tokenfile.write_tokens(frame(spark, rows), path, tokenizer_path(), block_ids=20_000)
    got = sorted(tokenfile.read_documents(spark, path).collect(), key=lambda r: r[1])
    order = lambda d: (d is not None, d or 0)
    assert [r[0] for r in got] == sorted((d for d, _ in rows), key=order)
    want, texts = Counter(), {}
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        texts.setdefault(d, []).append(ids)
    assert Counter((d, n, crc) for d, _, n, crc in got) == want
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    some = tokenfile.read_documents(spark, path, -5, 40, with_ids=True).collect()
    assert sorted((r["doc_id"], r["start"]) for r in some) == sorted((r[0], r[1]) for r in got if r[0] is not None and -5 <= r[0] <= 40)
    assert all(list(r["ids"]) in texts[r["doc_id"]] for r in some)


def test_equal_units_of_a_column_are_looked_up_once():
    encoder, asked = tokenfile.Encoder(tokenizer_path()), Counter()
    unit = encoder.unit
    encoder.unit = lambda u: (asked.update([u]), unit(u))[1]
    texts = ["the cat, the dog. the cat", None, "", "\nthe (dog) été."] * 300
    got = list(encoder.each(pa.array(["cut off", *texts])[1:]))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked == Counter(["the", " cat", ",", " the", " dog", ".", "\nthe", " (", "dog", ")", " été"])


@pytest.mark.parametrize("chunk", [1, 300, 4 << 20])
def test_units_are_encoded_as_in_whole_texts(monkeypatch, chunk):
    monkeypatch.setattr(tokenfile, "CHUNK_BYTES", chunk)
    encoder, rng = tokenfile.Encoder(tokenizer_path()), np.random.default_rng(4)
    some = [*" \n\t\x1c\x85\xa0\u2003\u3000abst1é×ßĀ½Ⅷ٣\u0301日🎉.,!-_<|>()»—'\x00", "  ", "\r\n", "<|endoftext|>", "'s", "'ll", "%%%", "word"]
    texts = HARD + ["".join(rng.choice(some, n)) for n in rng.integers(0, 12, 5000)]
    for column in (texts, texts[:1], []):
        got = [np.frombuffer(g, "<u2").tolist() for g in encoder.each(pa.array(column, pa.string()))]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in column]


def test_added_tokens_that_a_cut_would_part_are_found(tmp_path):
    from tokenizers import AddedToken, Tokenizer

    for i, token in enumerate((AddedToken("a.b"), AddedToken("[x]"), AddedToken("<two words>"), AddedToken("<r>", rstrip=True), AddedToken("<w>", single_word=True))):
        tokenizer, path = Tokenizer.from_file(tokenizer_path()), str(tmp_path / f"{i}.json")
        tokenizer.add_special_tokens([token])
        tokenizer.save(path)
        texts = [f"see {token.content}, x{token.content} y", f"{token.content}  {token.content}s", None, ""]
        got = [np.frombuffer(g, "<u2").tolist() for g in tokenfile.Encoder(path).each(pa.array(texts))]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_doc_id_of_many_rows_is_dealt(spark):
    rows = spark.range(4000).selectExpr("if(id % 3 > 0, null, id) AS doc_id", "concat('text ', id % 900) AS text")
    parts = tokenfile.in_order(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(r["count"] for r in parts) < 2000


def test_token_counts_equal_those_of_the_texts(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = docs + [(950 + i, t) for i, t in enumerate(HARD)] + [(980, "hello <|endoftext|> world"), (-7, "below zero")]
    df = frame(spark, rows)
    for block in (64, 1 << 19):
        path = new_path(spark, "flat")
        tokencount.write_flat(df, path, tokenizer_path(), block_ids=block)
        counts = tokencount.count_tokens(spark, path)
        got = sorted(tokencount.numbered(spark, path).join(counts, "ordinal").collect())
        assert [r[0] for r in got] == list(range(len(rows)))
        want = Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want and want[980, 5] == 1
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]


def test_token_files_of_an_empty_table(spark):
    none = frame(spark, []).limit(0)
    path = new_path(spark, "empty")
    tokenfile.write_tokens(none, path, tokenizer_path())
    assert tokenfile.read_documents(spark, path).collect() == []
    path = new_path(spark, "empty")
    tokencount.write_flat(none, path, tokenizer_path())
    assert tokencount.count_tokens(spark, path).collect() == [] and tokencount.numbered(spark, path).collect() == []


def brute_rule(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, key=lambda r: (-len(r[0]), r[0], r[1]), default=(None, None))
    return host, path, best[0], best[1] or "allow"


URLS = ["http://A.Example.org/es/1", "https://example.org/en/12?x=/", "http://xexample.org/en/1", "http://org", "http://org/", "no scheme", None, "", "x://y://z/p", "http://a.b.com/fr/#/de/", "http://com/de/", "http://com.org/de/", "ftp://u@h.com:80/de/", "http:///path", "http://example.org./es/", "http://.org/", "HTTP://EXAMPLE.ORG/ES/"]


@pytest.mark.parametrize("limit", [50_000, 3])
def test_url_filter_equals_brute_force(spark, sf_dir, limit):
    urls = [r[0] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()] + URLS * 2
    rules = [*RULES, *((f"s{i}.example.{x}", p, v) for i in range(20) for x in ("org", "com") for p, v in (("/", "block"), ("/en/", "allow"))), ("tionsh.example.net", "/en/", "block")]
    urls += [f"http://{a}s{i}.example.org/{p}" for i in range(25) for a in ("", "www.", "s1.") for p in ("", "en/", "en")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'old' AS rule", "'k' AS key", "1 AS row")
    known = spark.createDataFrame([*rules, (None, "/", "block"), rules[0]], "host string, path string, verdict string")
    got = urlfilter.judge(pages, known, broadcast_rules=limit).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in got) == sorted((i, *(x or "" for x in brute_rule(u, rules))) for i, u in enumerate(urls))
    assert urlfilter.judge(pages.limit(0), known).collect() == []
    assert {r["rule"] for r in urlfilter.judge(pages, known.limit(0)).collect()} == {None}


def brute_base(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda c: c[0].lower(), (text or "").encode()))
    found = []
    for phrase, label in license.PHRASES:
        p = phrase.encode().split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_equals_brute_force(spark, docs):
    more = ["GNU General Public License gnu general public license", "Apache-License, MIT license cc by cc by", "gnu general license public license", "mit", "cc by", "the gnu general\npublic license version",
            "Permission is hereby granted, free of charge, to any single person obtaining a copy of this software", "All rights reserved."]
    rows = docs + [(960 + i, t) for i, t in enumerate(more)]
    got = license.scan(frame(spark, rows)).collect()
    assert sorted((r[0] or -1, *r[1:3], r[3] or -1, r[4] or -1, r[5]) for r in got) == sorted((d or -1, *(b := brute_base(t))[:2], b[2] or -1, b[3] or -1, b[4]) for d, t in rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[966]["labels"] == "mit" and by_id[966]["n_base"] == 0 and 0.8 <= by_id[966]["score"] < 1
    assert by_id[967]["labels"] == "all-rights-reserved" and by_id[962]["n_base"] == 0
    assert license.scan(frame(spark, []).limit(0)).collect() == []


def test_license_finds_notices_with_missing_words(spark):
    rows, want = [], {}
    for text, label in license.NOTICES:
        w = text.split()
        if len(w) > 10:  # one word missing costs two word pairs, one put in costs one
            for at in (len(w) // 2, len(w) // 2 - 1):
                rows.append((len(rows), " ".join([*w[:at], *w[at + 1 :]])))
                want[rows[-1][0]] = (label, (len(w) - 3) / (len(w) - 1))
        if len(w) > 15:
            for gone, new in ((4, 9), (9, 4)):
                changed = [x for i, x in enumerate(w) for x in ([] if i == gone else ["zzz", x] if i == new else [x])]
                rows.append((len(rows), "some words of the text first " + " ".join(changed) + " and of the rest"))
                want[rows[-1][0]] = (label, (len(w) - 4) / (len(w) - 1))
    for text, label in license.PARAGRAPHS:  # a whole notice with words put in, missing and changed, amid other text
        w = text.split()
        w[5:5] = ["zzz"]
        del w[20]
        w[len(w) // 2] = "qqq"
        rows.append((len(rows), "x y z " + " ".join(w) + " and more of it"))
        want[rows[-1][0]] = (label, (len(text.split()) - 1 - 5) / (len(text.split()) - 1))
    got = {r["doc_id"]: r for r in license.scan(frame(spark, rows)).collect()}
    for i, (label, share) in want.items():
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= share - 1e-9, rows[i]
    assert "mit" == license.scan(frame(spark, [(1, "permission is hereby granted free of charge to person obtaining a copy of this software")])).first()["labels"]


def brute_bm25(rows, items, threshold=0.6):
    """(row, item_id) -> (score, question, answer, first word): every window of every text against every item."""
    split = [(i, decontam.words_of(t)) for i, t in items]
    n, mean = len(split), sum(len(w) for _, w in split) / len(split)
    df = Counter(t for _, w in split for t in set(w))
    out = {}
    for item_id, w in sorted(split):
        tf, half = Counter(w), 2 ** max(6, (len(w) - 1).bit_length())
        own = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in tf.items()}
        whole, cut = sum(own.values()), -(-len(w) // 2)
        for no, text in enumerate(rows):
            for at in range(0, len(text), half):
                here = Counter(text[at : at + 2 * half])
                score = sum(v for t, v in own.items() if t in here) / whole
                if score >= threshold - 1e-9:
                    common = [sum((Counter(side) & here).values()) for side in (w[:cut], w[cut:])]
                    shares = [c / len(side) if side else 1.0 for c, side in zip(common, (w[:cut], w[cut:]), strict=True)]
                    hit = (round(float(score), 9), *shares, at)
                    if min(shares) >= 0.6 and sum(common) >= 0.8 * len(w) and ((no, item_id) not in out or hit[:3] > out[no, item_id][:3]):
                        out[no, item_id] = hit
    return out


@pytest.fixture(scope="module")
def leaked(spark, sf_dir, docs):
    """Rows (doc_id, text), some with items put in, and the items, of several lengths, repeated ids and equal rows."""
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in items for w in decontam.words_of(t)})
    items += [(items[0][0], " ".join(rng.choices(vocabulary, k=90))), (8000, " ".join(rng.choices(vocabulary, k=200))), (8001, "tiny one"), items[3]]
    rows = [r for r in docs if r[0] is None or r[0] < 60 or 900 <= r[0] < 905]
    for i, (_, t) in enumerate(items):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        filler = [rng.choice(vocabulary) if rng.random() < 0.3 else f"f{rng.randrange(10**6)}" for _ in range(rng.randrange(300))]
        at = rng.randrange(len(filler) + 1)
        rows.append((2000 + i, " ".join([*filler[:at], *w, *filler[at:]])))
    rows.append((2999, " ".join(rng.choices(vocabulary, k=5000)) + " " + items[5][1]))
    return rows, items


@pytest.mark.parametrize("max_items", [5, 20, 20_000])
def test_decontamination_equals_brute_force(spark, leaked, max_items):
    rows, items = leaked
    bench = spark.createDataFrame([*items, (None, "a b"), (7000, None), (7001, " ")], "item_id long, text string").selectExpr("*", "1 AS score")
    df = frame(spark, rows)
    want = brute_bm25([decontam.words_of(t) for _, t in rows], sorted(set(items)))
    got = Counter((r[0], r[1], r[2], *r[3:]) for r in decontam.matches(df, bench, max_items=max_items).collect())
    assert got == Counter((rows[no][0], i, *hit) for (no, i), hit in want.items())
    assert sum(i >= 2000 for i, *_ in got if i is not None) >= len(items) - 3
    left = decontam.clean(df, bench, max_items=max_items)
    assert left.columns == df.columns
    hit = {no for no, _ in want}
    assert Counter((r[0], r[1]) for r in left.collect()) == Counter(r for no, r in enumerate(rows) if no not in hit)


def test_decontamination_of_empty_tables(spark, leaked):
    rows, items = leaked
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.matches(frame(spark, rows), bench.limit(0)).collect() == []
    assert decontam.clean(frame(spark, rows), bench.limit(0)).count() == len(rows)
    assert decontam.matches(frame(spark, rows).limit(0), bench).collect() == []


def test_long_texts_are_searched_in_parts(monkeypatch, leaked):
    _, items = leaked
    own = sorted(set(items))
    split = [decontam.words_of(t) for _, t in own]
    df = Counter(t for w in split for t in set(w))
    one = decontam.Benchmark(own, df, len(own), sum(map(len, split)) / len(own))
    rng = random.Random(8)
    text = "".join(f"{rng.choice(list(df)) if rng.random() < 0.1 else 'x' + str(rng.randrange(999))} " for _ in range(60_000)) + own[7][1]
    found = []
    for words, chars in ((1 << 18, 4 << 20), (300, 1000)):
        monkeypatch.setattr(decontam, "RUN_WORDS", words)
        monkeypatch.setattr(decontam, "CHARS", chars)
        vocabulary = decontam.Vocabulary()
        found.append(one.hits([vocabulary.numbers(text)], vocabulary))
    assert found[0] == found[1] and own[7][0] in found[0][0]


def test_mix_meets_targets(spark, sf_dir):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows += [(5000, None, "tiny"), (5001, "one", "tiny"), (5001, "one", "tiny"), (5002, "a b c", None), (None, "d e", "zz"), (5003, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS nth")
    got = mixing.mix(df, block=16).collect()
    assert len(got) == len(rows)
    total, by_source = 0, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_source.setdefault(r["source"], [0, r["source_size"], r["target"], 0])
        s[0] += r["size"]
        s[3] += r["taken"]
        total += r["size"]
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    want = mixing.targets([(s, by_source[s][0]) for s in order])
    for (s, n, t) in want:
        assert by_source[s][1] == n and abs(by_source[s][2] - t) < 1e-6 and by_source[s][3] == int(t)
        assert t <= 2 * n + 1e-9
    assert abs(sum(t for _, _, t in want) - 1.5 * total) < 1e-6
    again = mixing.mix(df.repartition(7), block=16).collect()
    key = lambda r: (r["doc_id"] or -1, r["source"] or "", r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(df.limit(0)).collect() == []


def test_points_are_bits_in_reverse(spark):
    slots = [0, 1, 2, 3, 5, 2**31, 2**40 + 7]
    got = spark.createDataFrame([(i,) for i in slots], "slot long").select("slot", mixing.point(F.col("slot"))).collect()
    assert dict(got) == {i: int(format(i, "062b")[::-1], 2) for i in slots}


def test_schedule_is_even_and_whole(spark):
    known = [(0, 10_000, 5000), (1, 100, 200), (2, 7, 14), (3, 0, 0), (4, 3000, 2999)]
    slots = mixing.schedule(spark, known, block=10).collect()
    for nth, _, take in known:
        own = sorted((r for r in slots if r["nth"] == nth), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(-(-take // 10))) and sum(r["words"] for r in own) == take
    big = sorted(r["slot"] for r in slots if r["nth"] == 0)
    share = len(big) / len(slots)
    assert all(abs((i + 1) - share * (s + 1)) < 8 for i, s in enumerate(big))
    assert mixing.schedule(spark, []).collect() == []


def test_mix_is_even_in_the_order_of_its_slots(spark):
    """Whatever part of the mix is read first, it holds each source by its share; slots in another order don't."""
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "abc"[i % 3]) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16).collect()
    starts = sorted((s, r["source"], r["size"]) for r in got for s in r["starts"])
    assert all(r["first_slot"] is None if not r["n_slots"] else r["first_slot"] >= 0 for r in got)

    def worst(order):
        total, sums, off = sum(n for *_, n in order), Counter(), 0.0
        share = {s: sum(n for _, x, n in order if x == s) / total for s in "abc"}
        for _, s, n in order:
            sums[s] += n
            off = max(off, *(abs(sums[x] - share[x] * sum(sums.values())) for x in "abc"))
        return off

    assert worst(starts) < 400
    random.Random(1).shuffle(starts)
    assert worst(starts) > 400


def test_language_learns_and_marks_und(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network, languages = langid.train(df)
    rows = [(r[0], r[1], r[2]) for r in df.select("doc_id", "text", "lang").collect() if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    got = {r[0]: r for r in langid.identify(frame(spark, [(d, t) for d, t, _ in rows]), network, languages).collect()}
    assert sum(got[d]["lang_pred"] == lang for d, _, lang in rows) >= 0.9 * len(rows)
    odd = langid.identify(frame(spark, [*ODD, (990, "12 34 --"), (991, "½ ² ① ⅷ")]), network, languages).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {900, 901, 902, 990, 991}
    assert langid.identify(frame(spark, [(1, "abc")]), *langid.train(df.limit(0))).collect()[0]["lang_pred"] == "und"


def test_models_learn_from_bounded_samples(spark, monkeypatch):
    sent = {}
    monkeypatch.setattr(langid, "fit", lambda windows, labels, languages, **_: sent.update(lang=(len(windows), np.bincount(labels).tolist())))
    monkeypatch.setattr(toxicity, "fit", lambda sets, marks, labels: sent.update(toxic=Counter(labels)))
    many = spark.range(50_000).selectExpr("0L AS doc_id", "concat('text ', id, repeat(' more', 30)) AS text", "'en' AS lang")
    same = spark.range(5_000).selectExpr("1L AS doc_id", "'one text that comes again and again' AS text", "'en' AS lang")
    few = spark.range(100, 400).selectExpr("id AS doc_id", "concat('words of ', id) AS text", "'de' AS lang")
    docs = many.unionByName(same).unionByName(few)
    langid.train(docs, per_lang=50, per_doc=2)
    assert sent["lang"][0] <= 200 and min(sent["lang"][1]) >= 50
    labels = spark.range(400).selectExpr("id AS doc_id", "cast(id < 2 AS int) AS toxic")
    toxicity.train(docs, labels.unionByName(labels), sample=60)
    assert sent["toxic"][1] <= 60 and sent["toxic"][0] <= 60 and sent["toxic"][1] > 1


def plain_predict(p, text):
    """Mean log probabilities of a text, a byte at a time."""
    data, hidden = langid.data_of(text), p["uf"].shape[0]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    sums = np.zeros(p["c"].shape[0])
    for at in range(0, len(data), langid.WINDOW):
        part, states = data[at : at + langid.WINDOW], {}
        for d in "fb":
            h, out = np.zeros(hidden), []
            for byte in part if d == "f" else part[::-1]:
                a, g = p[f"x{d}"][byte].astype(float), h @ p[f"u{d}"].astype(float)
                z, r = sigmoid(a[:hidden] + g[:hidden]), sigmoid(a[hidden : 2 * hidden] + g[hidden : 2 * hidden])
                n = np.tanh(a[2 * hidden :] + r * g[2 * hidden :])
                h = z * h + (1 - z) * n
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        for f, b in zip(states["f"], states["b"], strict=True):
            y = np.r_[f, b] @ p["o"] + p["c"]
            sums += y - np.log(np.exp(y).sum())
    return sums / max(1, len(data))


def test_language_equals_a_plain_loop():
    p = langid.start(3, hidden=5, seed=1)
    texts = ["a", "Ünd 12, so", "word " * 50, "x" * langid.WINDOW, "z" * (langid.WINDOW + 1), "end.", "12 34", None, ""]
    names, values = langid.Identifier(p, ["aa", "bb", "cc"]).predict(texts)
    for t, name, value in zip(texts, names, values, strict=True):
        if not langid.data_of(t):
            assert (name, value) == ("und", 0.0)
            continue
        mean = plain_predict(p, t)
        assert name == ["aa", "bb", "cc"][mean.argmax()] and abs(value - 1 / np.exp(mean - mean.max()).sum()) < 1e-4


def test_gradients_equal_differences():
    p = {k: v.astype(np.float64) for k, v in langid.start(3, hidden=4).items()}
    x, y = np.array([list(b" abc "), list(b" zzy ")], np.uint8), np.array([0, 2])
    _, g = langid.gradients(p, x, y)
    for k in p:
        flat = np.argsort(-np.abs(g[k]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, p[k].shape)
            old = p[k][at]
            p[k][at] = old + 1e-3
            up, _ = langid.gradients(p, x, y)
            p[k][at] = old - 1e-3
            down, _ = langid.gradients(p, x, y)
            p[k][at] = old
            assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3


def test_string_kernel_equals_brute_force():
    from itertools import combinations

    def phi(word):
        w, out = [toxicity._codes[ord(c)] for c in word], {}
        for at in combinations(range(len(w)), 3):
            k = tuple(w[i] for i in at)
            out[k] = out.get(k, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        n = sum(v * v for v in out.values()) ** 0.5
        return {k: v / n for k, v in out.items()}

    def cut(word):  # a long word by windows of 16 signs, half of them new
        marked = f"\0{word}\0"
        return [marked] if len(marked) <= 16 else [marked[i : i + 16] for i in range(0, len(marked) - 8, 8)]

    def mean(word):
        out = Counter()
        for piece in (own := cut(word)):
            out.update({k: v / len(own) for k, v in phi(piece).items()})
        return out

    words = ["banana", "clown", "cl.own", "aaaa", "chón", "a-very-long-word-of-many-signs", "a-very-long-wordxof other ends"]
    values = toxicity.features(words, toxicity.table_of(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            x, y = mean(a), mean(b)
            assert abs(values[i, j] - sum(v * y.get(k, 0) for k, v in x.items())) < 1e-4


def test_toxicity_scores_equal_a_plain_loop():
    from itertools import combinations

    rng = np.random.default_rng(3)
    model = {"table": rng.normal(0, 1, 32**3).astype(np.float32), "bias": -0.7, "curve": (1.3, -0.4)}

    def value(word):  # the best window's weighted sum of table values
        best = -np.inf
        marked = f"\0{word}\0"
        for piece in [marked] if len(marked) <= 16 else [marked[i : i + 16] for i in range(0, len(marked) - 8, 8)]:
            own = Counter()
            for at in combinations(range(len(piece)), 3):
                a, b, c = (toxicity._codes[ord(piece[i])] for i in at)
                own[(a * 32 + b) * 32 + c] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            norm = sum(v * v for v in own.values()) ** 0.5
            best = max(best, sum(v * model["table"][k] for k, v in own.items()) / norm if norm else 0.0)
        return best + model["bias"]

    def score(text):
        low = (text or "").lower()
        found = low.split()
        joined = [re.sub(r"\s+", "", m[0]) for m in re.finditer(r"(?:(?<!\S)\S\s+){3,}\S(?!\S)", low)]
        x = [model["bias"]] if not found else []
        for token in [*found, *joined]:
            word = re.sub(r"(.)\1{2,}", r"\1\1", token.strip(" \t\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
            forms = {word, re.sub(r"[\W_]+", "", word)} - {""}
            x.append(max([model["bias"], *map(value, forms)]))
        return 1 / (1 + np.exp(-np.clip(1.3 * max(x) - 0.4, -30, 30)))

    texts = ["One two, three.", "i.d-i*o_t!", "a b c d e f", "x" * 90, "aaaaaaa bbbb", "!!!", "", None, "Ünïcode wörds ①", "of a-very-long-word-with-many-many-signs here", "w " * 2]
    assert np.allclose(toxicity.Scorer(model).score(texts), [score(t) for t in texts], atol=1e-4)


def test_toxicity_learns_gapped_insults(spark, sf_dir):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("*", "1 AS text")
    model = toxicity.train(df, labels.unionByName(spark.createDataFrame([(None, 1, 1, 1), (3, 1, None, 1)], labels.schema)))
    scorer = toxicity.Scorer(model)
    assert min(scorer.score(["what an idiot", "you m.o-r*o_n", "an i d i o t here"])) > 0.5 > max(scorer.score(["the thing was on the", "", None, "a" * 9000]))
    rows = {r[0]: r[1] for r in toxicity.scores(frame(spark, ODD), model).collect()}
    assert all(0 <= s <= 1 for s in rows.values())
    assert toxicity.keep_civil(frame(spark, [(1, "an idiot"), (2, "the thing"), (3, None)]), model).select("doc_id").collect() == [(2,), (3,)]
    assert toxicity.train(df.limit(0), labels)["curve"]


def test_toxicity_training_stays_off_the_driver(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    tracemalloc.start()
    try:
        model = toxicity.train(df, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model["table"].any() and peak < 8e6  # the landmarks' table alone is over 20 MB


def test_toxicity_numbers_stand_for_units():
    rows = [(7, 1, 0, ["a", "é", "\U0001f600"]), (3, 2, 1, []), (3, 1, 1, ["b", "�"]), (3, 1, 0, ["a", "b"])]
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("toxic", pa.int32()), ("units", pa.list_(pa.string()))])
    whole = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
    words, sets, known = toxicity.numbered([whole.slice(0, 1), whole.slice(1, 1), whole.slice(2, 2)])
    assert words == sorted({w for r in rows for w in r[3]}) and all((np.diff(s) > 0).all() for s in sets)
    assert [([words[i] for i in s], y) for s, y in zip(sets, known, strict=True)] == [(r[3], r[2]) for r in sorted(rows, key=lambda r: r[:3])]
