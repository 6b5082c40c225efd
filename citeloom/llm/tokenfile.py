"""Token-ID files: documents encoded to one concatenated id array with Elias-Fano document boundaries.

Documents are range-partitioned by doc_id, so the files of a data set, in the order of (part, block), hold all ids in
ascending doc_id order. A block is one row of the files: about a million ids as 16-bit (or, for larger vocabularies,
32-bit) little-endian integers, and the ends of its documents and their doc_ids as Elias-Fano codes. Blocks start at a
document; where a block starts in the whole array is a prefix sum over the blocks' lengths, so no table of 64-bit
offsets is kept. Readers take documents and their offsets by select, some at a time, and a range of doc_ids by a binary
search of selects in the blocks that can hold it. The files are Parquet with binary columns.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.elias_fano import EliasFano
from citeloom.llm.shared import held, in_python, release, shuffle_partitions

END_ID = 2
BLOCK_IDS = 1 << 20
SPREAD = 1 << 61  # doc_ids of a block lie within so many of its first
SELECTED = 4096  # documents that a reader selects at a time
MEMO_UNITS = 600_000  # a cache's bound, about 100 MB; what is beyond it is encoded again
MEMO_LENGTH = 100  # longer units aren't kept
CHUNK_BYTES = 4 << 20  # of texts that are cut at a time; a longer text is one chunk
FILE_SCHEMA = (
    "part int, block int, n_docs int, n_null int, n_ids long, id_bytes int, ids binary, doc_base long, doc_last long, "
    + ", ".join(f"{x}_width int, {x}_low binary, {x}_high binary, {x}_samples binary" for x in ("end", "doc"))
)

#: Characters whose class is the same for Python and the tokenizer; a unit with others is encoded by the tokenizer as a whole.
_plain = re.compile("[\t\n\x0b\x0c\r !-;=-~À-ÖØ-öø-ſ]*").fullmatch
_pieces = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself, or the next free code point from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


OTHER, WHITE, WORD, MARK, TAIL = range(5)
# Classes of bytes. An apostrophe may begin a piece with the letters behind it, and <, | and > an added token: OTHER.
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[list(b"\t\n\x0b\x0c\r ")] = WHITE
_CLASS[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = WORD
_CLASS[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = MARK
_CLASS[0x80:0xC0] = TAIL  # the later bytes of a character
_CUT = np.zeros((8, 8), bool)  # whether a unit ends between bytes of two classes
_CUT[[OTHER, WORD, MARK, TAIL], WHITE] = _CUT[[WORD, TAIL], MARK] = _CUT[MARK, WORD] = True
_CUT = _CUT.ravel()
# The last two bytes of the white space beyond ASCII (Unicode White_Space) are among these.
_WIDE = np.zeros((256, 256), bool)
_WIDE[np.ix_([0xC2, 0x80, 0x81, 0x9A], [*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])] = True
_LATIN = np.zeros((256, 256), bool)  # letters from À to ÿ
_LATIN[0xC3, [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def units(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the units of texts begin, which lie one after another in data (UTF-8) and begin at starts.

    A unit's ids don't depend on its neighbours: it ends where a text does, ahead of white space that follows a character
    other than white space, and between letters or digits and marks, each of ASCII (letters before marks: from À to ÿ too).
    """
    kind = _CLASS[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = _CUT[kind[:-1] << 3 | kind[1:]]
    unsure = np.flatnonzero(cut[1:] & (kind[:-1] == TAIL)) + 1  # what stands there is told by a character's last two bytes
    ends = data[unsure - 2], data[unsure - 1]
    cut[unsure] = np.where(kind[unsure] == WHITE, ~_WIDE[ends], _LATIN[ends])
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class _Units(dict):
    """Ids of a unit, or of a piece of one that byte-level BPE never splits further, by the tokenizer's model."""

    def __init__(self, tokenizer, kind: str):
        self.tokenizer, self.kind, self.letters = tokenizer, kind, _byte_letters()
        self.model = tokenizer.model

    def __missing__(self, unit: str) -> bytes:
        word = unit[1:] if unit[0] == " " else unit
        if word.isascii() and word.isalpha():
            ids = self._of_piece(unit.replace(" ", self.letters[0x20]))
        elif not _plain(unit):
            ids = array.array(self.kind, self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        elif len(pieces := _pieces(unit)) > 1:
            ids = b"".join(map(self.__getitem__, pieces))
        else:
            ids = self._of_piece(unit.encode().decode("latin-1").translate(self.letters))
        if len(unit) <= MEMO_LENGTH and len(self) < MEMO_UNITS:
            self[unit] = ids
        return ids

    def _of_piece(self, written: str) -> bytes:
        return array.array(self.kind, [t.id for t in self.model.tokenize(written)]).tobytes()


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library, as little-endian bytes, units memoised.

    The ids equal those of encode(text, add_special_tokens=False). Only files whose splitter is the plain byte-level
    one, and whose added tokens stand within a unit, take the way through units; any other is asked for whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() < 1 << 16 else 4  # the largest integer stays free
        self.kind = {2: "H", 4: "I"}[self.id_bytes]
        plain = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, ByteLevel) and not self.tokenizer.pre_tokenizer.add_prefix_space
        by_unit = plain and all(map(self._stays_whole, self.tokenizer.get_added_tokens_decoder().values()))
        self.unit = _Units(self.tokenizer, self.kind).__getitem__ if by_unit else None

    @staticmethod
    def _stays_whole(token) -> bool:
        """Whether an added token is found in the unit that holds it, as in the whole text."""
        one = len(units(np.frombuffer(token.content.encode(), np.uint8), np.zeros(1, np.int64))) == 1
        return one and not (_plain(token.content) or token.rstrip or token.single_word)

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per process, so that what one task memoised serves the next."""
        return held("encoder", path, lambda: cls(path))

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each of texts (string; null as empty), of which so many are cut to units at a time as are CHUNK_BYTES
        long. Equal units of a chunk are looked up once, and Arrow puts their ids in the order of the texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.unit:
            for text in texts:
                yield array.array(self.kind, self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids).tobytes()
            return
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        first = 0
        while first < len(texts):
            end = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1)
            yield from self._chunk(texts.buffers()[2], at[first : end + 1])
            first = end

    def _chunk(self, buffer: pa.Buffer, at: np.ndarray) -> Iterator[bytes]:
        """The ids of the texts between the places `at` of buffer."""
        size = int(at[-1] - at[0])
        if not size:
            yield from [b""] * (len(at) - 1)
            return
        data = buffer.slice(int(at[0]), size)
        begins = units(np.frombuffer(data, np.uint8), at[:-1] - at[0])
        coded = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(np.r_[begins, size]), data).dictionary_encode()
        ids = pa.array(list(map(self.unit, coded.dictionary.to_pylist())), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(begins, at - at[0])].tolist()
        run = memoryview(ids.buffers()[2])
        for s, e in pairwise(ends):
            yield bytes(run[s:e])


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id and sorted within; null doc_ids come first, equal ones by their texts'
    digest. A doc_id that many rows hold, or null, is cut by digest and row, so it fills no task alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(shuffle_partitions(docs.sparkSession), rows.rdd.getNumPartitions() // 4)
    keyed = rows.select("doc_id", "text", F.xxhash64("text").alias("_d"), F.monotonically_increasing_id().alias("_no"))
    return keyed.repartitionByRange(n, "doc_id", "_d", "_no").sortWithinPartitions("doc_id", "_d", "_no").select("doc_id", "text")


def encoded(rows: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (FILE_SCHEMA) of rows as in_order() gives them, each document's ids followed by end_id."""

    def run(batches):
        encoder = Encoder.of(tokenizer)
        end = array.array(encoder.kind, [end_id]).tobytes()
        part, block, docs, parts, ends, size, first = TaskContext.get().partitionId(), 0, [], [], [], 0, None

        def flush():
            nonlocal block, size
            known = np.array([d for d in docs if d is not None], np.int64)  # nulls come first
            base = int(known[0]) if len(known) else 0
            codes = {"end": EliasFano.encode(np.array(ends)), "doc": EliasFano.encode(known - base)}
            row = {"part": part, "block": block, "n_docs": len(docs), "n_null": len(docs) - len(known), "n_ids": size, "id_bytes": encoder.id_bytes, "ids": b"".join(parts)}
            row |= {"doc_base": base, "doc_last": int(known[-1])} if len(known) else {}
            for x, code in codes.items():
                row |= {f"{x}_width": code.low_width, f"{x}_low": code.low, f"{x}_high": code.high, f"{x}_samples": code.samples}
            block, size = block + 1, 0
            docs.clear(), parts.clear(), ends.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        schema = pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in FILE_SCHEMA.split(", "))])
        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.each(b.column(1)), strict=True):
                own = ids + end
                first = doc_id if not docs or docs[-1] is None else first
                if docs and doc_id is not None and doc_id - first >= SPREAD:
                    yield flush()
                    first = doc_id
                size += len(own) // encoder.id_bytes
                docs.append(doc_id)
                parts.append(own)
                ends.append(size)
                if size >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return in_python(rows, run, FILE_SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the token files of docs (doc_id, text) to path.

    Whole texts are encoded; a null or empty text is the end id alone. Rows that repeat a doc_id are documents of
    their own, in the order of their texts' digests. Rows without doc_id come ahead of all others and are counted in
    their block; any 64-bit doc_id is allowed. An empty table gives files without blocks. Other columns are not read.
    """
    encoded(in_order(docs), tokenizer, end_id, block_ids).write.option("compression", "zstd").parquet(path)


def starts_of(blocks: DataFrame) -> DataFrame:
    """(part, block, base): the ids ahead of each block, from blocks (part, block, n_ids). A prefix sum in two steps:
    over the parts, of which there are as many as tasks, and over the blocks of each part."""
    by_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("own"))
    return own.join(by_part, "part").select("part", "block", (F.col("own") + F.col("ahead")).alias("base"))


def select_documents(row: dict, low: int | None = None, high: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, null, begins, ends) of a block's documents in their order, SELECTED at a time, by selects; ids are
    counted from the block's start. With low or high, only those of doc_ids from low to high."""
    ends, docs = (EliasFano(n, row[f"{x}_width"], row[f"{x}_low"], row[f"{x}_high"], row[f"{x}_samples"]) for x, n in (("end", row["n_docs"]), ("doc", row["n_docs"] - row["n_null"])))
    nulls, base = row["n_null"], row["doc_base"] or 0
    first = nulls + docs.rank(low - base) if low is not None else 0 if high is None else nulls
    last = nulls + docs.rank(high - base + 1) if high is not None else row["n_docs"]
    for s in range(first, last, SELECTED):
        e = min(last, s + SELECTED)
        stop = ends.slice(s, e)
        begin = np.r_[ends.select(s - 1) if s else 0, stop[:-1]]
        null = np.arange(s, e) < nulls
        yield np.r_[np.zeros(null.sum(), np.int64), docs.slice(max(0, s - nulls), max(0, e - nulls)) + base], null, begin, stop


def read_documents(spark: SparkSession, path: str, low: int | None = None, high: int | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the token files at path; with_ids adds the ids themselves.

    With low or high only blocks that can hold doc_ids from low to high are read, and of these only such documents.
    """
    files = spark.read.parquet(path)
    some = files
    if low is not None:
        some = some.where(F.col("doc_last") >= low)
    if high is not None:
        some = some.where(F.col("doc_base") <= high)

    def run(batches):
        release()
        for b in batches:
            for i in range(b.num_rows):  # a block at a time
                row = b.slice(i, 1).to_pylist()[0]
                ids = np.frombuffer(row["ids"], {2: "<u2", 4: "<u4"}[row["id_bytes"]])
                for docs, null, begins, ends in select_documents(row, low, high):
                    at = int(begins[0])
                    own = ids[at : int(ends[-1])].astype("<u4")
                    data, cuts = memoryview(own.tobytes()), [*(begins - at).tolist(), int(ends[-1]) - at]
                    crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in pairwise(cuts)]
                    same = np.full(len(docs), 1)
                    columns = [pa.array(same * row["part"], pa.int32()), pa.array(same * row["block"], pa.int32()), pa.array(docs, pa.int64(), mask=null), pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, block int, doc_id long, begin long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    joined = in_python(some, run, schema).join(starts_of(files.select("part", "block", "n_ids")), ["part", "block"])
    return joined.select("doc_id", (F.col("begin") + F.col("base")).alias("start"), *names[4:])
