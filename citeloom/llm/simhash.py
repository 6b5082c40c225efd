"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of equal value are one node, so exact copies never meet each other. Distinct fingerprints are dealt by
the pigeonhole rule: 64 bits in six blocks, at most four bits differ, so two blocks agree; each fingerprint goes to
the 15 buckets of its block pairs. A bucket with more than `hot` fingerprints is dealt again by the bits that its key
leaves open, where the same rule holds, so no task gets an unbounded bucket. Within a bucket the fingerprints stand in
the order of their Gray rank; runs of them share masked bit patterns, which the upper nodes of the index hold, and
groups whose accumulated differences exceed the distance are pruned whole. A bucket returns links to one member per
class (never all its pairs), and a distributed star contraction joins the classes of all buckets.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm import nearcopies
from citeloom.llm.components import connected_components
from citeloom.llm.shared import in_python, parts, release, scratch, spread, written

BITS, BLOCKS, DISTANCE, SHINGLE = 64, 6, 4, 4
LEAF, FAN = 16, 16
HOT = 50_000


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The signed 64-bit SimHash of a text's k-word shingles; 0 where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    buffer = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[k - 1 :], strict=False) if len(words) >= k else [(0, len(buffer))]
    digest = xxhash.xxh64_intdigest
    return code_of(np.array([digest(buffer[a:b], 42) for a, b in spans], np.uint64))


def code_of(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of unsigned 64-bit hashes: a bit is set where over half of them have it; 0 for none."""
    set_bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row of docs; whole texts, null texts are empty. Other columns are not read."""

    def run(batches):
        release()
        for b in parts(batches):
            fps = [fingerprint(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_python(spread(rows), run, "doc_id long, fp long")


def gray_rank(code):
    """A Column: the rank of a 64-bit code in the Gray sequence, as a long that sorts in unsigned order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(2**63)))


def block_masks(free: int) -> list[int]:
    """The masks of all pairs of the six blocks that the free bits are cut into."""
    places = [i for i in range(BITS) if free >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(places, BLOCKS)]
    return [blocks[i] | blocks[j] for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


class GrayIndex:
    """Masked bit patterns over fingerprints in Gray order, level by level; links() is a self-join by descent."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        ones, zeros, self.levels = codes, ~codes, []
        step = LEAF
        while True:
            at = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
            self.levels.append((ones | zeros, ones))
            step = FAN
            if len(at) == 1:
                break

    def _pairs(self, level: int, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Of these node pairs, which can hold a link, and which are links throughout."""
        mask, pattern = self.levels[level]
        both = mask[a] & mask[b]
        differ = np.bitwise_count((pattern[a] ^ pattern[b]) & both).astype(np.int64)
        return differ <= distance, differ + np.bitwise_count(~both) <= distance

    def links(self, distance: int = DISTANCE) -> np.ndarray:
        """For each fingerprint the first index of its class under links of at most this many bits."""
        n = len(self.codes)
        label = np.arange(n)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > 4096:
                for i in range(0, len(a), 4096):
                    stack.append((level, a[i : i + 4096], b[i : i + 4096]))
                continue
            near, whole = self._pairs(level, a, b, distance)
            span = LEAF * FAN**level
            for i, j in zip(a[near & whole], b[near & whole], strict=True):
                label = self._merge(label, np.arange(i * span, min(n, (i + 1) * span)), i * span)
                label = self._merge(label, np.arange(j * span, min(n, (j + 1) * span)), i * span)
            a, b = a[near & ~whole], b[near & ~whole]
            low, high = np.minimum.reduceat(label, np.arange(0, n, span)), np.maximum.reduceat(label, np.arange(0, n, span))
            apart = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b = a[apart], b[apart]
            if not len(a):
                continue
            fan = LEAF if level == 0 else FAN
            size = n if level == 0 else len(self.levels[level - 1][0])
            x = np.repeat(a * fan, fan * fan) + np.tile(np.repeat(np.arange(fan), fan), len(a))
            y = np.repeat(b * fan, fan * fan) + np.tile(np.arange(fan), fan * len(b))
            keep = (x < size) & (y < size) & (x <= y)
            x, y = x[keep], y[keep]
            if level:
                stack.append((level - 1, x, y))
                continue
            hit = (np.bitwise_count(self.codes[x] ^ self.codes[y]) <= distance) & (label[x] != label[y])
            label = self._merge(label, x[hit], y[hit])
        return label

    @staticmethod
    def _merge(label: np.ndarray, a: np.ndarray, b) -> np.ndarray:
        pairs = np.unique(np.stack(np.broadcast_arrays(label[a], label[b]), axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if not len(pairs):
            return label
        root: dict[int, int] = {}

        def find(i):
            while root.get(i, i) != i:
                root[i] = root.get(root[i], root[i])
                i = root[i]
            return i

        for i, j in pairs.tolist():
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        ids = np.array(sorted(root))
        to = np.array([find(i) for i in ids.tolist()])
        at = np.minimum(np.searchsorted(ids, label), len(ids) - 1)
        return np.where(ids[at] == label, to[at], label)


def bucket_links(key: np.ndarray, codes: np.ndarray, nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, node of its class's first member) within runs of equal key; codes stand in Gray order in a run."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    size_of = np.repeat(sizes, sizes)
    at = np.flatnonzero((size_of > 1) & (size_of <= LEAF))
    out_a, out_b = [], []
    if len(at):  # buckets of a single leaf
        k, c, v = key[at], codes[at], nodes[at]
        for d in range(1, LEAF):
            same = np.flatnonzero(k[d:] == k[:-d])
            if not len(same):
                break
            hit = same[np.bitwise_count(c[same] ^ c[same + d]) <= distance]
            out_a.append(v[hit])
            out_b.append(v[hit + d])
    for s, m in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        label = GrayIndex(codes[s : s + m]).links(distance)
        moved = np.flatnonzero(label != np.arange(m))
        out_a.append(nodes[s + moved])
        out_b.append(nodes[s + label[moved]])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _search(distance: int):
    def run(batches):
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            rows = np.concatenate([*held, rows]) if held else rows
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [rows[cut:]]
            if cut:
                yield from emit(rows[:cut])
        if held:
            yield from emit(held[0])

    def emit(rows):
        run_no = np.cumsum(np.r_[0, (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])])
        a, b = bucket_links(run_no, np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 3], distance)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def linked_classes(codes: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(node, component) of those rows of codes (fp, node), one per fp, that have a link at `distance` bits or fewer.

    distance is at most 4. component is the smallest node that links reach; rows without links are absent.
    """
    return connected_components(codes.sparkSession, gray_links(codes, distance, hot))


def gray_links(codes: DataFrame, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b) by the Gray indexes of all buckets of codes (fp, node): b is the first member of a's class in the bucket."""
    masks = [0]  # the bits that are fixed so far, by path
    rows = codes.select("fp", "node", F.lit(0).alias("path"))
    links = []
    for level in range(3):
        longer = [[m | x for x in block_masks(~m & (2**64 - 1))] for m in masks]
        table = F.array(*[F.array(*[F.lit(signed(x)) for x in xs]) for xs in longer])
        pairs = rows.select("fp", "node", "path", F.posexplode(F.get(table, F.col("path"))).alias("i", "mask"))
        keyed = pairs.select(
            (F.col("path") * len(longer[0]) + F.col("i")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node"
        )
        cold = keyed
        if level < 2:
            crowded = keyed.groupBy("path", "key").count().where(F.col("count") > hot).select("path", "key")
            crowded = written(crowded, "hot-buckets")
            if not crowded.isEmpty():
                cold = keyed.join(crowded, ["path", "key"], "left_anti")
                rows = keyed.join(crowded, ["path", "key"], "left_semi").select("fp", "node", "path")
                masks = [x for xs in longer for x in xs]
            else:
                rows = None
        else:
            rows = None
        cold = cold.select(F.col("path").cast("long").alias("path"), "key", "fp", "node").repartition("path", "key")
        cold = cold.withColumn("gray", gray_rank(F.col("fp"))).sortWithinPartitions("path", "key", "gray").drop("gray")
        links.append(written(in_python(cold, _search(distance), "a long, b long"), "links"))
        if rows is None:
            break
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, distance: int = DISTANCE, hot: int = HOT
) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs: component_id is the smallest doc_id that links reach.

    Null, empty and blank texts have fingerprint 0 and link like any other. Rows that repeat a doc_id give a row each.
    A null doc_id gets a fingerprint, takes no part in links and has the component of its fingerprint, or null. An
    empty table gives no rows; columns beside the two named are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    codes = fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node"))
    codes = written(codes, "codes")
    classes = linked_classes(codes, distance, hot)
    of_code = codes.join(classes, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_code, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row for each class of near copies, texts whose five-word shingles have a Jaccard of 0.8 or more.

    The pipeline's stage. SimHash fingerprints of the distinct five-word shingles go through the Gray index, and its links
    are verified by exact Jaccard. At 0.8 fingerprints differ by about 10 bits, so the index alone finds too few: the
    links between classes that it leaves open come from the exact join of nearcopies. A class keeps the row of its
    smallest doc_id (null after all others), of several that of the smallest digest of the text, of equal rows one. Texts
    without words, null ones too, are one class. An empty table gives no rows; further columns are kept as they are.
    """
    numbered = written(docs.withColumn("_no", F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession, "gone"):
        nodes = written(nearcopies.nodes(numbered, code_of), "nodes")
        codes = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "codes")
        same = nodes.select("fp", F.col("node").alias("a")).distinct().join(codes.withColumnRenamed("node", "b"), "fp").where("a <> b").select("a", "b")
        kinds = nearcopies.classes(numbered, nodes, gray_links(codes).unionByName(same))
        place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "_no").alias("place")
        found = written(kinds.join(numbered.select("_no", place), "_no").select("_no", "kind", "place"), "classes")
        kept = found.groupBy("kind").agg(F.min("place").alias("best")).select(F.col("best._no").alias("_no"))
        gone = written(found.select("_no").join(kept, "_no", "left_anti"), "gone")
    gone = F.broadcast(gone) if gone.count() <= nearcopies.BROADCAST else gone
    return numbered.join(gone, "_no", "left_anti").select(docs.columns)
