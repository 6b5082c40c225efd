"""Near copies by exact Jaccard similarity of five-word shingles: a prefix-filter join, verified pair by pair.

A text's shingles stand in one order for all texts, those that a sample finds common last. Of n shingles, two texts with
a Jaccard of 0.8 share 0.8 n of the larger and 8/9 n of the smaller at least, so that the first l of the shingles that
they share lie among the first n - 0.8 n + l of the one and n - 8/9 n + l of the other. These prefixes are joined by
shingle, pairs that share fewer than l are left, and the others are verified over all shingles. Nothing is missed, and the
sample only decides how many pairs are looked at.

A text's sketch holds for each of 256 classes of digests whether an odd number of its shingles are in it. Two sketches
differ in no more places than there are shingles that one text has and the other hasn't, so pairs whose sketches differ in
more than a Jaccard of 0.8 allows are left out before anything is made of them.

Texts with equal shingles are one node from the start, and links that another method proposes are verified first. Of the
shingles of a node that many nodes share, a few of each order of magnitude are searched for links between neighbours in a
random order, and then, for nodes that these haven't joined to the largest class, between a node and the few whose
sketches are nearest to its own. A large group of near copies is one class by then: only pairs of different classes are
looked at, all of them, so the group doesn't meet itself pair by pair.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.components import connected_components
from citeloom.llm.shared import in_python, parts, release, written

SHINGLE = 5
#: Two texts are near copies from a Jaccard of TIMES / OF on.
TIMES, OF = 4, 5
SAMPLE, COMMON, MOST_COMMON = 16, 4, 200_000  # one text in SAMPLE is sampled; COMMON texts of them make a shingle common
CROWD, CHAIN = 16, 2  # nodes that crowd a shingle; of a node's shingles of a like crowd, CHAIN are searched for links beforehand
REACH = 6  # nodes on either side that a node is compared with in a random order
LONG, START = 512, 4  # sketches don't tell texts of LONG shingles apart: of these only the rarest START shingles are searched beforehand
PART = 512  # nodes of a crowded shingle, about, that are searched by one another beforehand
NEAREST = 4  # nodes of other classes, by sketches, that a node is compared with after that
BROADCAST = 200_000
SKETCH = ["s0", "s1", "s2", "s3"]
BLOCK = 1 << 17  # rows or pairs that are in memory at once


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct digests of a text's k-word shingles in ascending order: A-Z lower-cased, white space folded. A text
    of fewer words is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    buffer = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[k - 1 :], strict=False) if len(words) >= k else [(0, len(buffer))]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(buffer[a:b], 42) for a, b in spans], np.uint64).view(np.int64))


def node_of(codes: np.ndarray) -> int:
    """The signed 64-bit digest of a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(codes.tobytes())).astype(np.int64))


def sketch_of(codes: np.ndarray) -> np.ndarray:
    """The parities of a set of shingles in 256 classes, as four signed 64-bit integers."""
    odd = (np.bincount(codes & 255, minlength=256) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def least_shared(n):
    """l: how many shingles of the prefixes a smaller text of n shingles must share."""
    return 1 + n // 40


def longest_prefix(n):
    """How many shingles a text of n looks for others with, whatever their size."""
    return n - (TIMES * n + OF - 1) // OF + least_shared(n)


def nodes(texts: DataFrame, code_of) -> DataFrame:
    """(_no, node, fp, s0 to s3) per row of texts (_no, text): the digest of its set of shingles, code_of these, its sketch."""

    def run(batches):
        release()
        for b in parts(batches):
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            columns = [pa.array(map(node_of, sets), pa.int64()), pa.array([code_of(x.view(np.uint64)) for x in sets], pa.int64())]
            sketches = np.stack([sketch_of(x) for x in sets], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, *map(pa.array, sketches)], ["_no", "node", "fp", *SKETCH])

    return in_python(texts.select("_no", "text"), run, "_no long, node long, fp long, s0 long, s1 long, s2 long, s3 long")


def _all_shingles(batches):
    release()
    for b in parts(batches):
        nodes, codes = b.column(0), [shingles(t) for t in b.column(1).to_pylist()]
        at = np.cumsum([0, *map(len, codes)])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *codes]), pa.int64()))
        yield pa.RecordBatch.from_arrays([nodes, lists], ["key", "codes"])


def _prefixes(common):
    """(token, node, n, pos) of the prefixes; a task takes each set of shingles once."""

    def run(batches):
        release()
        last, known = np.array(common.value, np.int64), set()
        for b in parts(batches):
            out, rows = [], 0
            for text in b.column(0).to_pylist():
                codes = shingles(text)
                node = node_of(codes)
                if not len(codes) or node in known:
                    continue
                known.add(node)
                if len(last):
                    at = np.minimum(np.searchsorted(last, codes), len(last) - 1)
                    late = last[at] == codes
                    codes = np.r_[codes[~late], codes[late]]
                n = len(codes)
                p = min(n, longest_prefix(n))
                out.append((codes[:p], np.full(p, node), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
                rows += p
                if rows > BLOCK:
                    yield block(out)
                    out, rows = [], 0
            if out:
                yield block(out)

    def block(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "node", "n", "pos"])

    return run


def _by_token(function, names: list[str]):
    """mapInArrow over rows in the order of their tokens: function gets the columns of whole tokens, some at a time, and
    yields columns of int64."""

    def run(batches):
        kept, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            kept.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)])
            rows += b.num_rows
            if rows > BLOCK:
                columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
                cut = int(np.flatnonzero(columns[0] != columns[0][-1])[-1]) + 1 if columns[0][0] != columns[0][-1] else 0
                if cut:
                    yield from emit([c[:cut] for c in columns])
                kept, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        if kept:
            yield from emit([np.concatenate(c) for c in zip(*kept, strict=True)])

    def emit(columns):
        for out in function(*columns):
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in out], names)

    return run


def _shared(token, n, node, pos):
    """The rows of tokens of two nodes or more, each node once, with the number of nodes."""
    first = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]
    token, n, node, pos = token[first], n[first], node[first], pos[first]
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, token[1:] != token[:-1]]), len(token)])
    many = np.repeat(sizes, sizes)
    two = many > 1
    yield token[two], n[two], node[two], pos[two], many[two]


def _fits(small_n, small_pos, large_n, large_pos):
    """Whether two texts fit in size and a token is among the places that the first shared ones have, if as many are shared
    as a Jaccard of TIMES / OF asks for."""
    missing = least_shared(small_n) - (TIMES * (small_n + large_n) + TIMES + OF - 1) // (TIMES + OF)
    return (OF * small_n >= TIMES * large_n) & (small_pos < small_n + missing) & (large_pos < large_n + missing)


def _slack(i, j, n, sketch):
    """How much less than a Jaccard of TIMES / OF allows the sketches of rows i and j differ; below 0 it is impossible."""
    apart = sum(np.bitwise_count(s[i].view(np.uint64) ^ s[j].view(np.uint64)).astype(np.int64) for s in sketch)
    return (OF - TIMES) * (n[i] + n[j]) - (TIMES + OF) * apart


def _alike(i, j, n, sketch):
    """Whether the sketches of rows i and j leave a Jaccard of TIMES / OF possible."""
    return _slack(i, j, n, sketch) >= 0


def _neighbours(token, n, node, *sketch):
    """Pairs of nodes that are near each other in a random order of those of a part of a crowd."""
    mixed = (node ^ token).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.lexsort((mixed ^ (mixed >> np.uint64(31)), token))
    token, n, node, sketch = token[order], n[order], node[order], [s[order] for s in sketch]
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(token)])
    i = np.flatnonzero(np.repeat(sizes, sizes) >= CROWD)
    for d in range(1, REACH + 1):
        i = i[i + d < len(token)]
        i = i[token[i] == token[i + d]]
        small, large = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
        k = i[OF * small >= TIMES * large]
        k = k[_alike(k, k + d, n, sketch)]
        yield node[k], node[k + d]


def _others(own_n, own_kind):
    """(r, rows that fit it in size) for the rows of a token that aren't of its largest class; own_n ascends."""
    values, counts = np.unique(own_kind, return_counts=True)
    largest = values[counts.argmax()]  # its members only meet the others
    for r in np.flatnonzero(own_kind != largest).tolist():
        a = int(np.searchsorted(own_n, -(-TIMES * own_n[r] // OF)))
        b = int(np.searchsorted(own_n, OF * own_n[r] // TIMES, side="right"))
        other = np.arange(a, b)
        yield r, other[own_kind[other] != own_kind[r]], largest


def _nearest(token, n, node, kind, *sketch):
    """Pairs of a node and the few of other classes whose sketches are nearest, of those of a part of a crowd; n ascends in
    it. Members of its largest class are found by the others."""
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    for s, m in zip(starts[sizes >= CROWD].tolist(), sizes[sizes >= CROWD].tolist(), strict=True):
        held = []
        for r, other, _ in _others(n[s : s + m], kind[s : s + m]):
            slack = _slack(s + r, s + other, n, sketch)
            best = np.argsort(-slack, kind="stable")[:NEAREST]
            held.append((np.full(len(best), node[s + r]), node[s + other[best]], slack[best] >= 0))
        if held:
            a, b, ok = map(np.concatenate, zip(*held, strict=True))
            yield a[ok], b[ok]


def _apart(token, n, node, pos, kind, *sketch):
    """(a, b, least): all pairs of nodes of different classes that share a token of their prefixes; n ascends in a token."""
    starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[starts, len(token)])
    low, high = np.minimum.reduceat(kind, starts), np.maximum.reduceat(kind, starts)
    mixed = low != high

    def pairs(i, j):
        ok = (kind[i] != kind[j]) & _fits(n[i], pos[i], n[j], pos[j])
        i, j = i[ok], j[ok]
        ok = _alike(i, j, n, sketch)
        i, j = i[ok], j[ok]
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), least_shared(n[i])

    few = np.repeat(mixed & (sizes <= CROWD), sizes)
    i = np.flatnonzero(few)
    for d in range(1, CROWD):
        i = i[i + d < len(token)]
        i = i[(token[i] == token[np.minimum(i + d, len(token) - 1)])]
        if not len(i):
            break
        yield pairs(i, i + d)
    for s, m in zip(starts[mixed & (sizes > CROWD)].tolist(), sizes[mixed & (sizes > CROWD)].tolist(), strict=True):
        own_kind = kind[s : s + m]
        held, rows = [], 0
        for r, other, largest in _others(n[s : s + m], own_kind):
            other = other[(own_kind[other] == largest) | (other > r)]
            held.append((s + np.minimum(other, r), s + np.maximum(other, r)))
            rows += len(other)
            if rows > BLOCK:
                yield pairs(*map(np.concatenate, zip(*held, strict=True)))
                held, rows = [], 0
        if held:
            yield pairs(*map(np.concatenate, zip(*held, strict=True)))


def _some(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST else rows


def verified(pairs: DataFrame, texts: DataFrame, firsts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of nodes whose Jaccard is TIMES / OF or more. firsts (node, _no) name a row of texts (_no, text) each."""
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    asked = written(firsts.join(asked, "node", "left_semi"), "asked")
    found = texts.join(_some(asked, asked.count()), "_no").select("node", "text")
    sets = written(in_python(found, _all_shingles, "key long, codes array<long>"), "shingles")
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("codes").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("whole"))
    return both.where(F.lit(OF) * F.col("same") >= F.lit(TIMES) * (F.col("whole") - F.col("same"))).select("a", "b")


def classes(texts: DataFrame, nodes: DataFrame, proposed: DataFrame) -> DataFrame:
    """(_no, node, kind) per row of texts (_no, text): rows with one kind are joined by links of near copies. _no is unique
    and stays the same when texts are read again. nodes are those of nodes(), written; proposed (a, b) pairs of them that
    another method takes for near copies. Texts without words are one kind."""
    spark = texts.sparkSession
    distinct = written(nodes.groupBy("node").agg(*[F.min(c).alias(c) for c in ["_no", *SKETCH]]), "distinct")
    sketches, firsts = distinct.select("node", *SKETCH), distinct.select("node", "_no")
    texts, nodes = texts.select("_no", "text"), nodes.select("_no", "node")
    sample = in_python(texts.where(F.pmod(F.xxhash64("_no"), F.lit(SAMPLE)) == 0), _all_shingles, "key long, codes array<long>")
    counted = sample.select(F.explode("codes").alias("token")).groupBy("token").count().where(F.col("count") >= COMMON)
    last = np.sort(np.array([r[0] for r in counted.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect()], np.int64))
    common = spark.sparkContext.broadcast(last)
    prefixes = in_python(texts.select("text"), _prefixes(common), "token long, node long, n int, pos int").select("token", "n", "node", "pos")
    in_order = lambda rows: rows.repartition("token").sortWithinPartitions("token", "n", "node")
    unordered = lambda pairs: pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    schema = "token long, n long, node long, pos long, many long"
    shared = in_python(in_order(prefixes), _by_token(_shared, ["token", "n", "node", "pos", "many"]), schema)
    shared = written(shared, "shared")
    like = Window.partitionBy("node", F.floor(F.log2("many") / 2)).orderBy("token")  # crowds that differ by less than a factor of four
    crowds = shared.where((F.col("many") >= CROWD) & ((F.col("n") < LONG) | (F.col("pos") < START))).withColumn("nth", F.row_number().over(like)).where(F.col("nth") <= CHAIN)
    part = F.xxhash64("token", F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / PART))).alias("token")
    crowds = written(crowds.select(part, "n", "node").join(sketches, "node").select("token", "n", "node", *SKETCH), "crowds")
    near = in_python(in_order(crowds), _by_token(_neighbours, ["a", "b"]), "a long, b long")
    links = written(verified(unordered(near.unionByName(proposed)), texts, firsts), "links")
    kinds = written(connected_components(spark, links).withColumnRenamed("component", "kind"), "kinds")
    kind = F.coalesce("kind", "node").alias("kind")
    rows = in_order(crowds.join(kinds, "node", "left").select("token", "n", "node", kind, *SKETCH))
    near = in_python(rows, _by_token(_nearest, ["a", "b"]), "a long, b long")
    links = written(verified(unordered(near), texts, firsts).unionByName(links), "links")
    kinds = written(connected_components(spark, links).withColumnRenamed("component", "kind"), "kinds")
    rows = in_order(shared.join(sketches, "node").join(kinds, "node", "left").select("token", "n", "node", "pos", kind, *SKETCH))
    apart = in_python(rows, _by_token(_apart, ["a", "b", "least"]), "a long, b long, least long")
    apart = apart.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("least").alias("least")).where("n >= least").select("a", "b")
    more = verified(apart, texts, firsts)
    for end in ("a", "b"):
        more = more.join(kinds.select(F.col("node").alias(end), F.col("kind").alias(f"{end}_kind")), end, "left")
    more = written(more.select(F.coalesce("a_kind", "a").alias("a"), F.coalesce("b_kind", "b").alias("b")).distinct(), "links")
    joined = connected_components(spark, more).select(F.col("node").alias("kind"), F.col("component").alias("whole"))
    known = nodes.join(kinds, "node", "left").select("_no", "node", F.coalesce("kind", "node").alias("kind"))
    return known.join(joined, "kind", "left").select("_no", "node", F.coalesce("whole", "kind").alias("kind"))
