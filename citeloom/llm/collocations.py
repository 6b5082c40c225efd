"""Phrase collocations: candidates by Apriori, counted by double-array tries.

Texts are cut into pieces and words once and kept as blocks of one language: the distinct words of many texts and the
places of their words as an array of numbers. All later passes read these arrays.

Candidates are Apriori-safe: a phrase is looked at only if its parts can be frequent. For single words that is known
exactly. For longer phrases the places whose parts pass are hashed, the hashes' counts are summed, and those that reach
the least count set bits of a filter of fixed size, which lets every frequent phrase through and some others.

The places of candidates are dealt into slices by the hash of their first two words, each once, with as many words as pass. A
slice's candidates become double-array tries over words: a state's edge by a word leads to the state base[state] + word if
check there names the state. Every place of a slice starts at the root and all of them advance together, a word a level; the
accepting states they reach are counted by bincount. So a place is sent and walked once, however many candidates there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import in_python, new_path, parts, scratch, spread, written

LEAST = 10  # occurrences of a candidate
MOST_WORDS = 3
TOP = 2000
PER_MILLE = 1_000_000  # the score of a phrase whose parts never stand apart
COVERED = 50  # a candidate goes if a longer one has that share of its occurrences, of a hundred
BLOCK_WORDS = 1 << 19
HELD_WORDS = 1 << 20  # words of all languages that a task holds before it writes blocks, or distinct ones before it sends their counts
HELD_HASHES = 1 << 20  # that a task counts before it sends them on
SPLIT_BYTES = 1 << 22  # of texts that are split at once
FILTER_BITS = 26  # places of a filter at most, as a power of two: 8 MB
SLICE = 1 << 17  # phrases of a slice, about
SLICE_WORDS = 1 << 22  # words of the corpus to a slice
AT_ONCE = 1 << 19  # phrases of a trie; where a slice has more, they are taken in turn
HELD_RUNS = 1 << 20  # places of candidates that a task holds before it sends them on
RANGE_WORDS = 1 << 20  # words of the corpus to a range of hashes
WORD_RANGE = 1 << 22  # words of the corpus to a range of distinct words
BLOCKS_PER_FILE = 8
ROUNDS = 30  # of 64 places each that are tried for a state's edges, before they go behind all others
_cut = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_BLOCK = "lang string, words binary, hashes binary, places binary, n long"


class _Numbers(dict):
    """Numbers words from 2 on, in the order of their first use; 0 is nothing, 1 the end of a piece."""

    def __init__(self):
        super().__init__({b"": 0, b"\n": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Held:
    """The texts of one language that a task holds."""

    def __init__(self):
        self.numbers, self.arrays, self.size, self.texts, self.bytes = _Numbers(), [], 0, [], 0

    def add(self, data: bytes) -> int:
        """Takes a text and gives how many places it has, about."""
        data = data.translate(_cut)
        n = data.count(b" ") + data.count(b"\n") + 2
        self.texts.append(data)
        self.size += n
        self.bytes += len(data)
        if self.bytes >= SPLIT_BYTES:
            self.number()
        return n

    def number(self) -> None:
        """Numbers the words of the texts that wait, split some bytes at a time."""
        data, begin = b"\n".join([*self.texts, b""]).replace(b"\n", b" \n "), 0
        self.texts, self.bytes = [], 0
        while begin < len(data):
            end = data.find(b" ", begin + SPLIT_BYTES)
            end = len(data) if end < 0 else end
            found = pc.split_pattern(pa.array([data[begin:end]], pa.large_binary()), " ").values.dictionary_encode()
            number = np.array([self.numbers[w] for w in found.dictionary.to_pylist()], np.int32)
            places = number[found.indices.to_numpy()]
            self.arrays.append(places[places > 0] - 1)
            begin = end

    def row(self, lang: str) -> pa.RecordBatch:
        self.number()
        places = np.concatenate(self.arrays)
        words = list(self.numbers)[2:]
        n = pa.array([np.count_nonzero(places)], pa.int64())
        packed = [pa.array([x], pa.binary()) for x in (b"\n".join(words), _hash(lang, words).tobytes(), places.tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([lang]), *packed, n], ["lang", "words", "hashes", "places", "n"])


def word_blocks(docs: DataFrame) -> DataFrame:
    """Blocks (lang, words, hashes, places, n) of docs (text, lang): distinct words by lines, their hashes, and places, which
    are 0 for the end of a piece or i for the i-th word; n of them are words. Null languages are `und`; null texts hold
    nothing. A text stays in one block."""
    rows = spread(docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text")).where(F.col("text").isNotNull()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Held] = {}
        size = 0
        for b in parts(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = held.setdefault(lang, _Held())
                size += own.add(text.encode("utf-8", "replace"))
                if own.size >= BLOCK_WORDS or size >= HELD_WORDS:
                    most = max(held, key=lambda x: held[x].size)
                    size -= held[most].size
                    yield held.pop(most).row(most)
        for lang in sorted(held):
            yield held[lang].row(lang)

    return in_python(rows, run, _BLOCK)


class _Block(NamedTuple):
    lang: str
    words: bytes  # by lines; empty where the column isn't read
    hashes: np.ndarray
    places: np.ndarray


def _blocks_of(batches: Iterable[pa.RecordBatch]) -> Iterator[_Block]:
    for b in batches:
        for row in b.to_pylist():
            yield _Block(row["lang"], row.get("words", b""), np.frombuffer(row["hashes"], np.uint64), np.frombuffer(row["places"], np.int32))


def _summed_words(lists: list[tuple[bytes, np.ndarray]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some lists of (words by lines, counts), the sums of their counts (up to 2 ** 53), and the number
    of the distinct word at each place of the lists."""
    found = pa.concat_arrays([pc.split_pattern(pa.array([w], pa.large_binary()), "\n").values for w, _ in lists]).dictionary_encode()
    at = found.indices.to_numpy()
    n = np.bincount(at, np.concatenate([n for _, n in lists]))
    return found.dictionary, n.astype(np.int64), at


def word_counts(blocks: DataFrame, n_words: int) -> DataFrame:
    """(lang, word, f) of all words. A task sums its own and sends them packed, in ranges of their hashes by n_words; the sums
    of a range's lists are taken where they meet."""
    ranges = 64 + n_words // WORD_RANGE

    def sent(lang, lists):
        words, n, at = _summed_words([x[:2] for x in lists])
        part = np.zeros(len(n), np.int64)
        part[at] = np.concatenate([h for *_, h in lists]) % np.uint64(ranges)
        order = np.argsort(part, kind="stable")
        found, cuts = np.unique(part[order], return_index=True)
        ranged = pa.LargeListArray.from_arrays(pa.array(np.r_[cuts, len(order)], pa.int64()), words.take(pa.array(order)))
        packed = [_squeezed(w.as_py()) for w in pc.binary_join(ranged, pa.scalar(b"\n", pa.large_binary()))]
        counts = [_planes(own) for own in np.split(n[order], cuts[1:])]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.int32()), pa.array(packed, pa.binary()), pa.array(counts, pa.binary())], ["lang", "r", "words", "n"])

    def run(batches):
        held: dict[str, list[tuple]] = {}
        size = 0
        for b in _blocks_of(batches):
            if len(b.hashes):
                held.setdefault(b.lang, []).append((b.words, np.bincount(b.places, minlength=len(b.hashes) + 1)[1:], b.hashes))
                size += len(b.hashes)
            if size > HELD_WORDS:
                most = max(held, key=lambda x: sum(len(h) for *_, h in held[x]))
                size -= sum(len(h) for *_, h in held[most])
                yield sent(most, held.pop(most))
        for lang in sorted(held):
            yield sent(lang, held[lang])

    def meet(key, rows):
        lists = zip(rows.column("words").to_pylist(), rows.column("n").to_pylist(), strict=True)
        words, n, _ = _summed_words([(_opened(w), _values(c, np.int64)) for w, c in lists])
        return pa.table({"lang": pa.array([key[0].as_py()] * len(n), pa.string()), "word": words.cast(pa.binary()).cast(pa.string()), "f": n})

    sent_lists = in_python(blocks, run, "lang string, r int, words binary, n binary")
    return sent_lists.groupBy("lang", "r").applyInArrow(meet, "lang string, word string, f long")


def _hash(lang: str, words: list[bytes]) -> np.ndarray:
    digest, seed = xxhash.xxh64_intdigest, xxhash.xxh32_intdigest(lang)
    return np.array([digest(w, seed) for w in words], np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in this order."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019) + (a >> np.uint64(17)))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Filter:
    """A set of hashes as bits: what was put in is found, and by chance some others."""

    def __init__(self, rows: Iterable, bits: int = FILTER_BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.bytes = np.zeros(1 << max(0, bits - 3), np.uint8)
        for r in rows:
            own = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(self.bytes)]
            self.bytes[r["part"] * 4096 : r["part"] * 4096 + len(own)] |= own

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def filter_of(hashes: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """A filter of the hashes (h long) of a table; its parts of 32,768 bits are made by aggregation and then collected."""
    at = F.col("h").bitwiseAND((1 << bits) - 1)
    rows = hashes.groupBy(F.shiftright(at, 15).cast("int").alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits"))
    return Filter(rows.collect(), bits)


def _squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _opened(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _planes(values: np.ndarray) -> bytes:
    """Numbers by their bytes, all first bytes, all second ones and so on, compressed."""
    return _squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _values(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(_opened(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _hashed(block: _Block, filters: list[Filter], most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, .. most words, one more than there are filters at most: the places at which a run stands whose parts
    pass, and the run's hash. A run of more words than there are filters has not been asked in a filter of its own."""
    word, places = np.r_[np.uint64(0), block.hashes], block.places
    passed = np.r_[False, filters[0].holds(word[1:])]
    at = np.flatnonzero(passed[places])
    h = word[places[at]]
    out = [(at, h)]
    for n in range(2, most + 1):
        # A run of n words at a place has one of n - 1 there and one at the next place.
        both = np.flatnonzero(np.diff(at) == 1)
        start, joined = at[both], _mixed(h[both], word[places[at[both] + n - 1]])
        out.append((start, joined))
        if n <= len(filters):
            own = filters[n - 1].holds(joined)
            at, h = start[own], joined[own]
            out[-1] = (at, h)
    return out


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and the sums of their counts."""
    if not len(h):
        return h, n
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n[order], first)


def frequent_hashes(blocks: DataFrame, filters: list[Filter], least: int, n_words: int) -> DataFrame:
    """(h) of the runs of one word more than there are filters whose parts pass these and which may stand `least` times.

    Hashes are cut to 32 bits and as many as there are ranges, by n_words, so a range's hashes fit in one task. A task sums
    its own and sends each range's as sorted differences; the sums of a range's lists are taken where they meet.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(filters)
    bits = max(6, (n_words // RANGE_WORDS).bit_length())
    low = np.uint64((1 << (32 + bits)) - 1)

    def sent(h, n):
        cuts = np.searchsorted(h, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))
        found = np.flatnonzero(np.diff(cuts))
        lists = [slice(cuts[r], cuts[r + 1]) for r in found.tolist()]
        steps = [_planes(np.diff(h[own] & np.uint64(0xFFFFFFFF), prepend=np.uint64(0)).astype(np.uint32)) for own in lists]
        counts = [_planes(n[own].astype(np.uint32)) for own in lists]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], ["r", "steps", "n"])

    def run(batches):
        held, size = [], 0
        for b in _blocks_of(batches):
            held.append(np.unique(_hashed(b, shared.value, len(shared.value) + 1)[-1][1] & low, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_HASHES:
                held = [_summed(held)]
                if len(held[0][0]) > HELD_HASHES // 2:
                    yield from sent(*held.pop())
                size = sum(len(h) for h, _ in held)
        if held:
            yield from sent(*_summed(held))

    def meet(key, rows):
        lists = [(np.cumsum(_values(s, np.uint32), dtype=np.uint64), _values(n, np.uint32).astype(np.int64)) for s, n in zip(rows.column("steps").to_pylist(), rows.column("n").to_pylist(), strict=True)]
        h, n = _summed(lists)
        return pa.table({"h": (h[n >= least] + (np.uint64(key[0].as_py()) << np.uint64(32))).view(np.int64)})

    return in_python(blocks.select("lang", "hashes", "places"), run, "r int, steps binary, n binary").groupBy("r").applyInArrow(meet, "h long")


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of some lists of (hashes, counts), and their sums, in order."""
    h, n = (np.concatenate(x) for x in zip(*lists, strict=True))
    if not len(h):
        return h, n
    order = np.argsort(h, kind="stable")  # runs in order merge fast
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    return h[first], np.add.reduceat(n[order], first)


def _distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of some columns of whole numbers from 0 on, in order, and the sums of their counts."""
    if not len(n):
        return columns, n
    key, span = columns[0].astype(np.int64), int(columns[0].max()) + 1
    for c in columns[1:]:
        own = int(c.max()) + 1
        if span * own >= 1 << 63:  # too many for a number: what is there is numbered anew
            known, key = np.unique(key, return_inverse=True)
            span = len(known)
        key, span = key * own + c, span * own
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return [c[order[first]] for c in columns], np.add.reduceat(n[order], first)


def dealt_runs(blocks: DataFrame, filters: list[Filter], slices: int) -> DataFrame:
    """(lang, slice, words, runs, n): the places at which a run of two words or more passes the filters, in slices by the
    hash of its first two words. Of a place the longest run is sent; equal ones of a task are sent once, with their number.
    runs are columns, one a word, of numbers: 0 for nothing or i for words[i - 1]."""
    shared = blocks.sparkSession.sparkContext.broadcast(filters)
    most = len(filters)

    def sent(lang, known, columns, n):
        words, part, runs = list(known), columns[0], np.stack(columns[1:])
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
        rows = []
        for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True):
            used, local = np.unique(np.r_[0, runs[:, i:j].ravel()], return_inverse=True)
            rows.append((lang, int(part[i]), _squeezed(b"\n".join([words[w - 1] for w in used[1:].tolist()])), _planes(local[1:].astype(np.uint32)), _planes(n[i:j].astype(np.uint32))))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "slice", "words", "runs", "n"])

    def run(batches):
        held: dict[str, tuple[dict[bytes, int], list[list[np.ndarray]]]] = {}

        def all_of(lang):
            known, lists = held.pop(lang)
            *columns, n = (np.concatenate(x) for x in zip(*lists, strict=True))
            return sent(lang, known, *_distinct(columns, n))

        for b in _blocks_of(batches):
            (at, h), *longer = _hashed(b, shared.value, most)[1:]
            if not len(at):
                continue
            columns = [b.places[at], b.places[at + 1]]
            for k, (start, _) in enumerate(longer, 2):
                columns.append(np.zeros(len(at), np.int32))
                columns[-1][np.searchsorted(at, start)] = b.places[start + k]
            known, lists = held.setdefault(b.lang, ({}, []))
            words, number = b.words.split(b"\n"), np.zeros(len(b.hashes) + 1, np.int32)
            number[columns[0]] = number[columns[1]] = 1
            used = np.flatnonzero(number)
            number[used] = [known.setdefault(words[w - 1], len(known) + 1) for w in used.tolist()]
            lists.append([((h >> np.uint64(40)) % np.uint64(slices)).astype(np.int32), *(number[c] for c in columns), np.ones(len(at), np.int64)])
            if sum(len(x[0]) for _, own in held.values() for x in own) > HELD_RUNS:
                yield all_of(max(held, key=lambda x: sum(len(own[0]) for own in held[x][1])))
        for lang in sorted(held):
            yield all_of(lang)

    return in_python(blocks, run, "lang string, slice int, words binary, runs binary, n binary")


@dataclass
class Trie:
    """A double array over words. State 0 is nothing, states 1 to len(words) are those after one word, by its number."""

    words: list[bytes]
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray  # a state's phrase, by its number, or -1
    phrases: int

    def counts(self, number: np.ndarray, at: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """How often each phrase stands in an array of word numbers, 0 for other words and the ends of pieces: at all its
        places, or at some (distinct or not), each as often as times has it (in all up to 2 ** 53)."""
        at = np.flatnonzero(number) if at is None else at
        times = np.ones(len(at)) if times is None else times.astype(np.float64)
        state = number[at].astype(np.int64)
        total = np.zeros(self.phrases, np.int64)
        while len(at):
            own = self.accept[state]
            total += np.bincount(own[own >= 0], times[own >= 0], self.phrases).astype(np.int64)
            deeper = (self.base[state] != 0) & (at + 1 < len(number))
            at, state, times = at[deeper] + 1, state[deeper], times[deeper]
            symbol = number[at]
            reached = self.base[state] + symbol
            on = (symbol > 0) & (reached > 0) & (reached < len(self.check))
            on[on] = self.check[reached[on]] == state[on]
            at, state, times = at[on], reached[on].astype(np.int64), times[on]
        return total


def trie_of(phrases: list[bytes]) -> Trie:
    """The double array of distinct phrases of one word or more, numbered by their places in the list."""
    split = [p.split(b" ") for p in phrases]
    use: dict[bytes, int] = {}
    for ws in split:
        for w in ws:
            use[w] = use.get(w, 0) + 1
    words = sorted(use, key=lambda w: (-use[w], w))  # common words have small numbers, so edges stand close together
    number = {w: i for i, w in enumerate(words, 1)}
    edges: dict[int, list[tuple[int, int]]] = {}  # by node: (word, node); nodes are numbered as they come
    nodes, ends = len(words) + 1, {}
    known: dict[tuple[int, int], int] = {}
    for i, ws in enumerate(split):
        node = number[ws[0]]
        for w in ws[1:]:
            key = (node, number[w])
            if key not in known:
                known[key] = nodes
                edges.setdefault(node, []).append((key[1], nodes))
                nodes += 1
            node = known[key]
        ends[node] = i
    # A node's edges take free places that lie as its words' numbers do; nodes of many edges first, those of one last.
    size = len(words) + 1
    used = np.zeros(max(1024, 2 * (nodes + len(words))), bool)
    used[: size] = True
    place = np.zeros(nodes, np.int64)  # a node's state
    place[: size] = np.arange(size)
    shift = {}
    rng = np.random.default_rng(1)
    single = []
    top = size
    for node, own in sorted(edges.items(), key=lambda e: -len(e[1])):
        if len(own) == 1:
            single.append((node, *own[0]))
            continue
        symbols = np.array([s for s, _ in own])
        symbols.sort()
        low, span = int(symbols[0]), int(symbols[-1] - symbols[0])
        b = None
        for _ in range(ROUNDS if top - span > size else 0):
            tries = rng.integers(size, top - span, 64) - low
            free = ~used[tries[:, None] + symbols].any(axis=1)
            if free.any():
                b = int(tries[np.argmax(free)])
                break
        if b is None:
            b = top - low
            if top + span >= len(used):
                used = np.r_[used, np.zeros(max(len(used), span + 2), bool)]
        used[b + symbols] = True
        top = max(top, b + low + span + 1)
        shift[node] = b
        for s, child in own:
            place[child] = b + s
    if single:
        spots = np.flatnonzero(~used[size:])[: len(single)] + size
        if len(spots) < len(single):
            spots = np.r_[spots, np.arange(len(used), len(used) + len(single) - len(spots))]
        # A base of 0 means no edges, so no edge may lie where its word's number is: such places are beyond the words'.
        for (node, s, child), spot in zip(single, spots.tolist(), strict=True):
            shift[node], place[child] = spot - s, spot
    last = int(place.max()) + 1 if nodes else 1
    base, check, accept = np.zeros(last, np.int32), np.zeros(last, np.int32), np.full(last, -1, np.int32)
    for node, own in edges.items():
        base[place[node]] = shift[node]
        for _, child in own:
            check[place[child]] = place[node]
    for node, i in ends.items():
        accept[place[node]] = i
    return Trie(words, base, check, accept, len(phrases))


def counted(runs: DataFrame, least: int = LEAST, at_once: int = AT_ONCE) -> DataFrame:
    """(lang, phrase, a): the exact occurrences of the candidates of dealt runs that stand `least` times. A slice has all
    places of its candidates, whose tries hold up to at_once phrases; where there are more, in turn."""

    def meet(key, rows):
        number: dict[bytes, int] = {}
        lists = []
        for words, codes, n in zip(rows.column("words").to_pylist(), rows.column("runs").to_pylist(), rows.column("n").to_pylist(), strict=True):
            own = np.array([0, *(number.setdefault(w, len(number) + 1) for w in _opened(words).split(b"\n"))], np.int32)
            times = _values(n, np.uint32)
            lists.append((own[_values(codes, np.uint32)].reshape(-1, len(times)), times))
        places, times = (np.concatenate(x, axis=-1) for x in zip(*lists, strict=True))
        words = list(number)
        phrases = []
        longest = _distinct(list(places), times)[0]
        for n in range(2, len(longest) + 1):
            some = longest[n - 1] > 0
            own = np.stack(_distinct([c[some] for c in longest[:n]], np.ones(np.count_nonzero(some), np.int64))[0], axis=1) - 1
            phrases += [b" ".join([words[i] for i in w]) for w in own.tolist()]
        a = np.zeros(len(phrases), np.int64)
        for i in range(0, len(phrases), at_once):
            trie = trie_of(phrases[i : i + at_once])
            symbol = np.zeros(len(words) + 1, np.int32)
            symbol[[number[w] for w in trie.words]] = np.arange(1, len(trie.words) + 1)
            symbols = np.zeros((places.shape[1], len(places) + 1), np.int32)  # a row a place, with an end
            symbols[:, :-1] = symbol[places.T]
            begin = np.flatnonzero(symbols[:, 0])
            a[i : i + at_once] = trie.counts(symbols.ravel(), begin * symbols.shape[1], times[begin])
        some = np.flatnonzero(a >= least)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(some), pa.string()), "phrase": pa.array([phrases[i] for i in some.tolist()], pa.binary()).cast(pa.string()), "a": a[some]})

    return runs.groupBy("lang", "slice").applyInArrow(meet, "lang string, phrase string, a long")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _part(words: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, most_words: int = MOST_WORDS, least: int = LEAST, top: int = TOP, covered: int = COVERED, slice_size: int = SLICE, at_once: int = AT_ONCE, bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to most_words words.

    docs (text, lang) are lower-cased (A-Z), cut into pieces at signs and line ends, and pieces into words at blanks and
    tabs. A phrase stands `a` times in pieces, `least` times or more; its cut into two parts that stand l and r times gives
    a * a / (l * r) in millionths, rounded down, and the lowest cut counts, of equal ones the first. A phrase goes if a
    longer candidate holds it and has `covered` of a hundred of its occurrences. n is the words of the language. Ranks go
    by score, occurrences and the phrase's bytes. Null languages are `und`; null and empty texts hold no words; repeated
    rows count as often as they come; further columns are not read; an empty table gives no rows.

    Counts are exact: a hash lets too many candidates through, never too few. Whatever is broadcast has a bound: filters
    of a fixed size. A place is sent and walked once: slices grow in number, by slice_size phrases and by the words of the
    corpus, not in size, and a trie holds at_once phrases at most.
    """
    with scratch(docs.sparkSession, "words", "counted"):
        blocks = written_blocks(word_blocks(docs))
        n = blocks.agg(F.sum("n")).first()[0] or 1
        words = written(word_counts(blocks, n), "words")
        bits = min(bits, max(15, n.bit_length() + 3))  # eight places a word, so that few phrases pass by chance
        filters, passed = [_word_filter(words.where(F.col("f") >= least), bits)], 0
        for _ in range(2, most_words + 1):
            often = written(frequent_hashes(blocks, filters, least, n), "hashes")
            filters.append(filter_of(often, bits))
            passed += often.count()
        if most_words > 1:
            runs = dealt_runs(blocks, filters, 1 + max(passed // slice_size, n // SLICE_WORDS))
            found = written(counted(runs, least, at_once), "counted")
        else:
            found = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long")
    return ranked(found, words, least, top, covered)


def written_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks as a table of small files and row groups, so that a reader holds few of them at once."""
    spark: SparkSession = blocks.sparkSession
    path = new_path(spark, "blocks")
    blocks.write.option("compression", "zstd").option("maxRecordsPerFile", BLOCKS_PER_FILE).option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def _word_filter(often: DataFrame, bits: int) -> Filter:
    def run(batches):
        for b in batches:
            langs, words = b.column(0).to_pylist(), b.column(1).to_pylist()
            h = np.array([xxhash.xxh64_intdigest(w.encode(), xxhash.xxh32_intdigest(x)) for x, w in zip(langs, words, strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    return filter_of(in_python(often.select("lang", "word"), run, "h long"), bits)


def ranked(found: DataFrame, words: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The report of counted phrases (lang, phrase, a) and word counts (lang, word, f)."""
    part = words.where(F.col("f") >= least).select("lang", F.col("word").alias("part"), "f").unionByName(found.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    w = _words(F.col("phrase"))
    cuts = found.select("lang", "phrase", "a", w.alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("head"), _part(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    cuts = cuts.join(part.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    # Whole numbers of up to 38 digits, so counts up to 10 ** 14 are exact.
    score = F.expr(f"({PER_MILLE}BD * cast(a as decimal(14,0)) * cast(a as decimal(14,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("cut")).select("lang", "phrase", "a", "cut.*")
    inner = found.select("lang", "a", w.alias("w")).where(F.size("w") > 2)
    inner = inner.select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: _part(F.col("w"), i, F.col("m")))).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
