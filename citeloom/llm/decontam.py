"""Benchmark decontamination: a BM25 inverted index of the test items, asked by every passage with block-max WAND.

Items are the index's documents, and passages of the corpus, half-overlapping windows of words, are the queries. A
posting's weight is the term's BM25 share of its item's own score, so a passage that holds all of an item scores 1.
Document frequencies, mean length and number of items are those of the whole benchmark. Items stand in blocks; the index
keeps each term's largest weight of all and of each block.

A passage's terms are lists of blocks. In each round its lists are put in the order of their next block; the pivot is
the first block at which the largest weights of the lists so far, with what common terms can add, reach the threshold.
Lists ahead of it skip to it. Only where the block maxima there reach the threshold, too, are the block's items scored,
exactly and over all terms; then its lists go on. A round is taken for all passages of a batch at once. Common terms, that
together can't add more than COMMON to an item, are only counted. So all items at or above the threshold are retrieved. A
retrieved pair is verified by the overlap of the item's two halves, question and answer, with the passage.

A benchmark is cut into slices of `max_items` items, all of which are asked in one pass over the corpus, whose words are
split once. Items are put into length classes, each with windows of its own, so that every item lies in a window whole.
Neither scores nor hits depend on the slices.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import in_python, parts, release, spread, written

K1, B = 1.2, 0.75
THRESHOLD = 0.6
SLACK = 1e-9  # sums of weights are compared with this much less than the threshold
COMMON = 0.25  # the most that the terms that aren't followed may add to an item
HALF, BOTH = 0.6, 0.8
BLOCK_ITEMS = 4
MAX_ITEMS = 20_000
SMALLEST = 6  # items of up to 2**SMALLEST words are one length class
CHARS = 4 << 20  # characters of texts that are split into words at once
RUN_WORDS = 1 << 18  # words whose passages are asked at once
KEPT = 2  # slices that a worker keeps open; of more it opens one after the other
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
words = re.compile(r"[^\W_]+").findall
_break = re.compile(r"[\W_]").search


def words_of(text: str | None) -> list[str]:
    return words(text.lower()) if text else []


def _pieces(text: str) -> Iterator[str]:
    """text in parts of about CHARS characters, cut between words."""
    at = 0
    while len(text) - at > CHARS and (cut := _break(text, at + CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Vocabulary(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """A text's words by their numbers."""
        parts = [np.fromiter(map(self.__getitem__, words(p.lower())), np.int32) for p in _pieces(text)] if text else []
        return np.concatenate(parts) if parts else np.empty(0, np.int32)


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of these lengths, joined."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class BlockMaxIndex:
    """Postings (term, item, weight) of the items of one length class, by term and by term and block of items.

    terms is how many terms the slice has, numbered from the rarest to the most common.
    """

    def __init__(self, half: int, of_item: list[tuple[np.ndarray, np.ndarray]], terms: int, threshold: float):
        self.half, self.of_item, self.threshold = half, of_item, threshold - SLACK
        count = np.array([len(t) for t, _ in of_item])
        term, weight = np.concatenate([t for t, _ in of_item]), np.concatenate([w for _, w in of_item])
        item = np.repeat(np.arange(len(of_item)), count)
        order = np.lexsort((item, term))
        term, item, weight = term[order], item[order], weight[order]
        start = np.searchsorted(term, np.arange(terms + 1))
        # From the most common term on, those whose weights add up to COMMON at most in every item aren't followed.
        adds, cut = np.zeros(len(of_item)), terms
        for t in range(terms - 1, -1, -1):
            own = item[start[t] : start[t + 1]]
            if len(own):
                adds[own] += weight[start[t] : start[t + 1]]
                if adds[own].max() > min(COMMON, threshold / 2):
                    adds[own] -= weight[start[t] : start[t + 1]]
                    break
            cut = t
        self.followed = cut
        self.blocks = -(-len(of_item) // BLOCK_ITEMS)
        self.common_max = np.maximum.reduceat(adds, np.arange(0, len(of_item), BLOCK_ITEMS))
        rare = slice(0, start[cut])
        key = term[rare] * self.blocks + item[rare] // BLOCK_ITEMS
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.key = np.r_[key[at], np.iinfo(np.int64).max]  # a term's blocks in order; the last one ends the search
        self.block_max = np.maximum.reduceat(weight[rare], at) if len(at) else np.empty(0)
        first = np.searchsorted(self.key, np.arange(cut + 1) * self.blocks)
        self.first, self.end = first[:-1], first[1:]
        self.list_max = np.array([self.block_max[s:e].max() if e > s else 0.0 for s, e in zip(self.first, self.end, strict=True)])

    def candidates(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) pairs whose block maxima reach the threshold, by WAND over passages' distinct followed terms."""
        place, end, top = self.first[term], self.end[term], self.list_max[term]
        least = self.threshold - self.common_max.max()  # what followed terms have to give
        found_p, found_b = [], []
        while True:
            on = place < end
            passage, term, place, end, top = passage[on], term[on], place[on], end[on], top[on]
            if not len(passage):
                break
            block = self.key[place] - term * self.blocks
            order = np.argsort(passage * self.blocks + block, kind="stable")
            passage, term, place, end, top, block = passage[order], term[order], place[order], end[order], top[order], block[order]
            start = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
            size = np.diff(np.r_[start, len(passage)])
            run = np.cumsum(top)
            run -= np.repeat(run[start] - top[start], size)
            reach = np.flatnonzero(run >= least)
            first = np.searchsorted(reach, start)  # the pivot's place among those that reach, if it is in the passage
            pivot = np.r_[reach, len(passage)][first]
            alive = pivot < start + size
            whose = np.repeat(np.arange(len(start)), size)
            at = np.where(alive, block[np.minimum(pivot, len(passage) - 1)], 0)
            on = alive[whose]
            passage, term, place, end, top, whose, block = passage[on], term[on], place[on], end[on], top[on], whose[on], block[on]
            to = at[whose]
            behind = np.flatnonzero(block < to)
            place[behind] = np.searchsorted(self.key, term[behind] * self.blocks + to[behind])
            place = np.minimum(place, end)
            here = np.flatnonzero((place < end) & (self.key[place] == term * self.blocks + to))
            bound = np.bincount(whose[here], self.block_max[place[here]], len(start)) + self.common_max[at]
            good = np.flatnonzero(alive & (bound >= self.threshold))
            of = np.zeros(len(start), np.int64)
            of[whose] = passage
            found_p.append(of[good])
            found_b.append(at[good])
            place[here] += 1
        none = np.empty(0, np.int64)
        return np.concatenate([none, *found_p]), np.concatenate([none, *found_b])

    def passages(self, texts: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(text, window, item, score) at or above the threshold; a text is its words' term numbers, -1 for none.
        Window i of a text is the words from i * half on, twice half of them. Long texts are taken in parts."""
        out, run, size = [], [], 0
        step = max(1, RUN_WORDS // self.half) * self.half
        for no, terms in enumerate(texts):
            for s in range(0, len(terms), step):  # a part's last window reaches one half into the next part
                run.append((no, s // self.half, terms[s : s + step + self.half], -(-min(step, len(terms) - s) // self.half)))
                size += len(run[-1][2])
                if size >= RUN_WORDS:
                    out += self._run(run)
                    run, size = [], 0
        return out + self._run(run)

    def _run(self, run: list[tuple[int, int, np.ndarray, int]]) -> list[tuple[int, int, int, float]]:
        if not run:
            return []
        length = np.array([len(t) for _, _, t, _ in run])
        halves = -(-length // self.half) + 1  # one more, so no window meets the next text
        first = np.cumsum(halves) - halves
        terms = np.concatenate([t for _, _, t, _ in run])
        part = _runs(length) // self.half + np.repeat(first, length)
        asked = (terms >= 0) & (terms < self.followed)
        t, p = terms[asked].astype(np.int64), part[asked]
        pair = np.unique(np.r_[p, p[p > 0] - 1] * self.followed + np.r_[t, t[p > 0]])
        nth = _runs(halves)  # a window's place in its part
        asks = nth < np.repeat([n for *_, n in run], halves)
        passage, term = pair // self.followed, pair % self.followed
        on = asks[passage]
        out = []
        inside = np.zeros(int(terms.max(initial=-1)) + 2, bool)  # the last place takes words without a term
        starts = np.searchsorted(part, np.arange(len(nth) + 2))
        found = self.candidates(passage[on], term[on])
        for half, block in zip(*map(np.ndarray.tolist, found), strict=True):
            here = terms[starts[half] : starts[half + 2]]
            inside[here] = True
            inside[-1] = False
            no, offset, *_ = run[int(np.searchsorted(first, half, side="right")) - 1]
            for i in range(block * BLOCK_ITEMS, min(len(self.of_item), (block + 1) * BLOCK_ITEMS)):
                own, weight = self.of_item[i]
                known = own < len(inside) - 1
                score = float(weight[known][inside[own[known]]].sum())
                if score >= self.threshold:
                    out.append((no, offset + int(nth[half]), i, score))
            inside[here] = False
        return out


class Benchmark:
    """The indexes of a slice of items by length class, and the verified hits of texts in it.

    df gives of each term of the slice in how many of all `n` items it is; mean is their mean number of words.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, threshold: float = THRESHOLD):
        self.term = {t: i for i, t in enumerate(sorted(df, key=lambda t: (df[t], t)))}
        classes: dict[int, list] = {}
        for item_id, text in sorted(items):
            if w := words_of(text):
                own = {self.term[t]: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(w) / mean)) for t, f in Counter(w).items()}
                ids, weight = np.array(sorted(own), np.int64), np.array([own[t] for t in sorted(own)])
                classes.setdefault(max(SMALLEST, (len(w) - 1).bit_length()), []).append((item_id, [self.term[t] for t in w], (ids, weight / weight.sum())))
        self.classes = [([x[:2] for x in items], BlockMaxIndex(1 << k, [x[2] for x in items], len(self.term), threshold)) for k, items in sorted(classes.items())]

    def hits(self, texts: list[np.ndarray], vocabulary: Vocabulary) -> list[dict[int, tuple[float, float, float, int]]]:
        """Per text (numbers of the vocabulary's words): item_id -> (score, question overlap, answer overlap, first word of
        the window) of its best verified window; of equally good ones the first, and the first of equal item_ids."""
        known = np.fromiter((self.term.get(w, -1) for w in vocabulary), np.int32, len(vocabulary))
        terms = [known[t] for t in texts]
        best: list[dict[int, tuple]] = [{} for _ in texts]
        for items, index in self.classes:
            for no, window, i, score in sorted(index.passages(terms)):
                item_id, item = items[i]
                here = Counter(terms[no][window * index.half : (window + 2) * index.half].tolist())
                cut = -(-len(item) // 2)
                shares, same = [], 0
                for side in (item[:cut], item[cut:]):
                    common = sum(min(n, here.get(t, 0)) for t, n in Counter(side).items())
                    shares.append(common / len(side) if side else 1.0)
                    same += common
                if min(shares) >= HALF and same >= BOTH * len(item):
                    hit = (round(score, 9), *shares, window * index.half)
                    if item_id not in best[no] or hit[:3] > best[no][item_id][:3]:
                        best[no][item_id] = hit
        return best


def _item_terms(batches):
    for b in batches:
        found = [words_of(t) for t in b.column(1).to_pylist()]
        rows = [(t, None) for w in found for t in set(w)] + [(None, len(w)) for w in found if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "length"])


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> list:
    """Broadcast Benchmarks of slices of max_items at most of the benchmark's distinct (item_id, text), in their order.

    Items without id or words are left out. The statistics of all items are counted in Spark; the driver holds one slice
    at a time, and of the document frequencies those of its terms.
    """
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    rows = written(rows, "items")
    terms = in_python(rows, _item_terms, "term string, length long").groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length"))
    terms = written(terms, "item-terms")
    total = terms.where("term is null").first()
    out, last = [], None
    while total:
        part = rows if last is None else rows.where(F.struct("item_id", "text") > F.struct(F.lit(last[0]).alias("item_id"), F.lit(last[1]).alias("text")))
        items = [tuple(r) for r in part.orderBy("item_id", "text").limit(max_items).collect()]
        if not items:
            break
        last = items[-1]
        own = spark.createDataFrame([(t,) for t in sorted({t for _, text in items for t in words_of(text)})], "term string")
        df = {r["term"]: r["df"] for r in terms.join(own, "term").select("term", "df").collect()}
        if df:
            out.append(spark.sparkContext.broadcast(Benchmark(items, df, total["df"], total["length"] / total["df"], threshold)))
    return out


def _hits(shared: list, texts: list[str | None]) -> Iterator[dict[int, tuple]]:
    """Per text the verified hits in all slices."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t or "")
        if size < CHARS and i + 1 < len(texts):
            continue
        vocabulary = Vocabulary()
        numbers = [vocabulary.numbers(x) for x in group]
        best: list[dict[int, tuple]] = [{} for _ in group]
        for one in shared:
            for have, more in zip(best, one.value.hits(numbers, vocabulary), strict=True):
                for item_id, hit in more.items():
                    if item_id not in have or hit[:3] > have[item_id][:3]:
                        have[item_id] = hit
            if len(shared) > KEPT:
                one.__dict__.pop("_value", None)  # opened again from the worker's disk for the next texts
        yield from best
        group, size = [], 0


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): verified hits, the best per document and item.

    Whole texts of docs are searched; null and empty ones have no hits. Rows that repeat a doc_id are searched each and
    may repeat a pair; a null doc_id is kept. Items without words or id are left out, equal rows of the benchmark are one
    item, other rows that repeat an item_id are items of their own under one id. Empty tables give no rows; further
    columns are not read.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    shared = indexes(benchmark, threshold, max_items)

    def run(batches):
        release()
        for b in parts(batches, 2000):
            ids = b.column(0).to_pylist()
            out = [(ids[i], item, *hit) for i, found in enumerate(_hits(shared, b.column(1).to_pylist())) for item, hit in sorted(found.items())]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return in_python(rows, run, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> DataFrame:
    """docs without the rows whose text has a verified hit; the columns are those of docs, rows are judged where they are.
    Null and empty texts stay, and so does every row where the benchmark is empty."""
    place = docs.columns.index("text")
    shared = indexes(benchmark, threshold, max_items)

    def run(batches):
        release()
        for b in parts(batches, 2000):
            yield b.filter(pa.array([not h for h in _hits(shared, b.column(place).to_pylist())], pa.bool_()))

    return in_python(spread(docs), run, docs.schema)
