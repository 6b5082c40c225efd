"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import collocations, decontam, hnsw, importance, langid, license, mixing, quality, simhash, tokencount, tokenfile, toxicity, urlfilter
from citeloom.llm.shared import new_path, table

#: The rules of op4 (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
NEIGHBOURS = 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build_index(vectors), vectors.where("vec_id % 20 = 0"), NEIGHBOURS)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokenfile.read_documents(spark, path)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, *langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens): the token blocks have no index, so their nth document is the nth of the names."""
    docs = table(spark, sf_dir, "documents")
    path = new_path(spark, "flat")
    tokencount.write_flat(docs, path, tokenizer_path())
    counts = tokencount.count_tokens(spark, path)
    return tokencount.numbered(spark, path).join(counts, "ordinal").select("doc_id", "start", "n_tokens")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = ~toxicity.trainable(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.scores(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = (op1_simhash, op2_hnsw, op3_token_files, op4_url_filter, op5_license_scan, op6_decontam, op7_mix, op8_language, op9_token_counts, op10_toxicity, op11_collocations, op12_quality, op13_importance)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH p AS (
  SELECT page_id,
    coalesce({_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (
  SELECT p.*, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC, rhost || rpath, verdict) AS nth
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE nth = 1
"""


#: The whole schedule: targets fill up in the order of size over weight, slots go to sources by their van der Corput
#: points, and documents meet the slots that take their words in each pass of their source's stream.
OP7_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size, row_number() OVER () AS no FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT AS nth FROM sized GROUP BY source),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 1.5::DOUBLE * sum(n) OVER () AS goal FROM by_source),
steps AS (
  SELECT *, coalesce(sum(2 * n) OVER (ORDER BY n::DOUBLE / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_n,
    sum(w) OVER (ORDER BY n::DOUBLE / w, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free_w, row_number() OVER (ORDER BY n::DOUBLE / w, nth) AS k FROM weighed),
cut AS (SELECT full_n, free_w, k FROM steps WHERE (goal - full_n) * w / free_w <= 2.0::DOUBLE * n ORDER BY k LIMIT 1),
targets AS (
  SELECT s.source, s.nth, s.n, CASE WHEN c.k IS NULL OR s.k < c.k THEN 2.0::DOUBLE * s.n ELSE (s.goal - c.full_n) * s.w / c.free_w END AS target FROM steps s LEFT JOIN cut c ON true),
wanted AS (SELECT *, floor(target)::BIGINT AS take, ((floor(target)::BIGINT + {mixing.BLOCK - 1}) // {mixing.BLOCK})::BIGINT AS need FROM targets),
spread AS (
  SELECT *, coalesce(sum(need) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT * {1 << mixing.POINT_BITS} // total AS low,
    sum(need) OVER (ORDER BY nth)::HUGEINT * {1 << mixing.POINT_BITS} // total AS high FROM (SELECT *, sum(need) OVER () AS total FROM wanted WHERE n > 0 AND take > 0)),
points AS (
  SELECT i AS slot, list_sum(list_transform(range({mixing.POINT_BITS}), lambda k: ((i >> k) & 1) << ({mixing.POINT_BITS - 1} - k)))::HUGEINT AS u FROM (SELECT unnest(range((SELECT max(total) FROM spread)::BIGINT)) AS i)),
ranked AS (SELECT slot, nth, need, take, row_number() OVER (PARTITION BY nth ORDER BY slot) - 1 AS rank FROM points JOIN spread ON low <= u AND u < high),
rest AS (
  SELECT (total + rank * (SELECT count(*) FROM targets) + nth)::BIGINT AS slot, nth, need, take, rank FROM (
    SELECT s.*, unnest(range(coalesce(g.got, 0), s.need)) AS rank FROM spread s LEFT JOIN (SELECT nth, count(*) AS got FROM ranked GROUP BY nth) g USING (nth))),
slots AS (
  SELECT slot, nth, rank * {mixing.BLOCK} AS a, least(take, (rank + 1) * {mixing.BLOCK}) AS b FROM (SELECT slot, nth, need, take, rank FROM ranked UNION ALL SELECT slot, nth, need, take, rank FROM rest) WHERE rank < need),
stream AS (
  SELECT no, doc_id, size, t.n AS source_size, target, t.nth, coalesce(sum(size) OVER (PARTITION BY t.nth ORDER BY md5(concat('{mixing.SEED}:', coalesce(doc_id::VARCHAR, 'null'), ':', size)), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
met AS (
  SELECT no, slot, least(b, pass * source_size + ahead + size) - greatest(a, pass * source_size + ahead) AS words
  FROM (SELECT *, unnest([0, 1, 2]) AS pass FROM stream WHERE size > 0) d JOIN slots s ON d.nth = s.nth AND s.a < pass * source_size + ahead + size AND s.b > pass * source_size + ahead),
given AS (SELECT no, sum(words) AS taken, min(slot) AS first_slot, count(*) AS n_slots FROM met GROUP BY no)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot::BIGINT AS first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots FROM stream LEFT JOIN given USING (no)
"""


#: All runs of one to three words are counted; the cuts of the frequent ones meet the counts of both parts.
OP11_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
runs AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM lists
  UNION ALL SELECT lang, 2 AS k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM lists
  UNION ALL SELECT lang, 3 AS k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM lists),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY lang, k, phrase HAVING count(*) >= {collocations.LEAST}),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, w[1] AS head, array_to_string(w[2:], ' ') AS tail FROM cand
  UNION ALL SELECT lang, phrase, a, 2 AS cut, w[1] || ' ' || w[2] AS head, w[3] AS tail FROM cand WHERE k = 3),
scored AS (
  SELECT c.lang, c.phrase, a, cut, h.f AS l, t.f AS r, ({collocations.PER_MILLE}::HUGEINT * a * a) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f t ON c.lang = t.lang AND c.tail = t.phrase),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM scored),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM cand WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase
  WHERE nth = 1 AND (longer IS NULL OR 100 * longer < {collocations.COVERED} * a)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM placed JOIN totals USING (lang) WHERE rank <= {collocations.TOP}
"""

#: CRC-32 by a table of 256 steps over a distinct run's bytes; gains, weights and scores as the operator's contract states.
OP13_SQL = rf"""
WITH steps AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
words AS (
  SELECT 's' AS side, row_number() OVER () AS no, doc_id, text FROM documents UNION ALL SELECT 't' AS side, -row_number() OVER () AS no, NULL AS doc_id, text FROM benchmark),
lists AS (SELECT side, no, doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM words),
runs AS (
  SELECT side, no, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS run FROM lists),
counted AS (SELECT side, no, run, count(*) AS n FROM runs GROUP BY side, no, run),
distinct_runs AS (SELECT run, hex(encode(run)) AS h FROM (SELECT DISTINCT run FROM counted)),
crc AS (
  SELECT run, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % {importance.BUCKETS} AS bucket
  FROM distinct_runs, steps),
features AS (SELECT side, no, bucket, sum(n)::BIGINT AS n FROM counted JOIN crc USING (run) GROUP BY side, no, bucket),
sides AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t FROM features GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sides) + {importance.BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sides) + {importance.BUCKETS})::DOUBLE)))::BIGINT AS gain FROM sides),
weighed AS (SELECT no, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM features JOIN gains USING (bucket) WHERE side = 's' GROUP BY no),
scored AS (
  SELECT no, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(floor(total::DOUBLE / n), 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('{importance.SEED}:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM lists LEFT JOIN weighed USING (no) WHERE side = 's'),
placed AS (
  SELECT *, weight + noise AS score, n_words >= {importance.LEAST_WORDS} AS able,
    row_number() OVER (PARTITION BY n_words >= {importance.LEAST_WORDS} ORDER BY weight + noise DESC, doc_id, n_features) AS place,
    count(*) OVER (PARTITION BY n_words >= {importance.LEAST_WORDS}) AS all_able FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND place <= all_able * {importance.PERCENT} // 100 THEN place END::BIGINT AS rank FROM placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op5_license_scan": license_sql(), "op7_mix": OP7_SQL, "op11_collocations": OP11_SQL, "op13_importance": OP13_SQL}


def license_sql() -> str:
    """op5 as joins of word pairs to template pairs, with the same merging of diagonals: whole ones upward, and single matches
    by place in the text, which may move both ways."""
    rows = []
    listed = [(t, x, True) for t, x in license.PHRASES] + [(t, x, False) for t, x in license.NOTICES]
    for no, (text, label, exact) in enumerate(listed):
        w = text.split(" ")
        rows += [f"('{w[i]}', '{w[i + 1]}', {no}, {exact}, '{label}', {len(w) - 1}, {i})" for i in range(len(w) - 1)]
    return rf"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
pairs AS (SELECT doc_id, unnest(range(len(w) - 1)) AS place, unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM words WHERE len(w) > 1),
grams(w1, w2, template, exact, label, n_grams, at_) AS (VALUES {", ".join(rows)}),
diag AS (
  SELECT doc_id, template, exact, label, n_grams, place - at_ AS diagonal, count(*) AS n, min(place) AS first, max(place) AS last, list(place) AS places
  FROM pairs JOIN grams USING (w1, w2) GROUP BY doc_id, template, exact, label, n_grams, place - at_),
steps AS (
  SELECT *, coalesce(diagonal - lag(diagonal) OVER near > {license.DRIFT}, true) AS far, coalesce(first <= lag(last) OVER near, false) AS met
  FROM diag WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal, first)),
bands AS (
  SELECT *, sum((exact OR far OR met)::INT) OVER near AS upward, sum(far::INT) OVER near AS band
  FROM steps WINDOW near AS (PARTITION BY doc_id, template ORDER BY diagonal, first)),
parts AS (
  SELECT doc_id, template, exact, label, n_grams, n AS votes, upward, band, diagonal, false AS single, n, first, last FROM bands
  UNION ALL
  SELECT doc_id, template, exact, label, n_grams, n AS votes, upward, band, diagonal, true AS single, 1 AS n, p AS first, p AS last
  FROM (SELECT *, unnest(places) AS p FROM bands WHERE NOT exact)),
met_again AS (
  SELECT *, coalesce(first = lag(first) OVER along, false) AS again
  FROM parts WINDOW along AS (PARTITION BY doc_id, template, single, band ORDER BY first, votes DESC, diagonal)),
moves AS (
  SELECT *, coalesce(abs(diagonal - lag(diagonal) OVER along) > {license.DRIFT} OR first - diagonal <= lag(first - diagonal) OVER along, true) AS moved
  FROM met_again WINDOW along AS (PARTITION BY doc_id, template, single, band, again ORDER BY first, votes DESC, diagonal)),
islands AS (
  SELECT *, sum(moved::INT) OVER along AS onward
  FROM moves WINDOW along AS (PARTITION BY doc_id, template, single, band, again ORDER BY first, votes DESC, diagonal)),
merged AS (
  SELECT doc_id, template, exact, label, n_grams, sum(n) AS n, min(first) AS start FROM islands
  GROUP BY doc_id, template, exact, label, n_grams, single, CASE WHEN single THEN onward ELSE upward END, CASE WHEN single THEN band END, CASE WHEN single THEN again END),
good AS (
  SELECT *, least(n / n_grams, 1.0)::DOUBLE AS score FROM merged WHERE CASE WHEN exact THEN n >= n_grams ELSE least(n / n_grams, 1.0) >= {license.COVERAGE} END),
found AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
    coalesce(array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(score) AS score
  FROM good GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)
"""
