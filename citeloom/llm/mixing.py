"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order (by a digest of seed, doc_id and size) as one stream of words, cut into
blocks of `block` words. Slot i of the mix gets the van der Corput point of i, its bits in reverse as a fraction of 2**62,
which the cumulative weights map to a source; a slot's rank among its source's slots is the block that it takes, over and
over the stream. A source's slots end where its target is full, the last one in mid-block. Where the schedule gives a
source fewer slots than its target asks for (a few at most), the missing ones follow at the end. Points are exact integers,
so a source's slots stay evenly spread however many there are. Every prefix sum and rank is taken in two steps, within
buckets, whose number grows with the input, and over their totals, so one source may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.shared import spread, written

POINT_BITS = 62
CELLS = 4096  # equal parts of the points, by which slots and the sources' intervals are joined
SOURCES = 100_000  # the most that are mixed; more is an error
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256
BLOCK = 256
SLOTS_PER_BUCKET = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
TIMES = 2.0


def sizes(docs: DataFrame, text_col: str = "text", no_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, no): size is the number of words in the whole text, 0 for a null one; no is unique, that of
    no_col where it is named."""
    no = [F.col(no_col).alias("no")] if no_col else []
    rows = spread(docs.select("doc_id", "source", F.col(text_col).alias("text"), *no))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    no = F.col("no") if no_col else F.monotonically_increasing_id().alias("no")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), no)


def targets(by_source: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, times: float = TIMES) -> list[tuple]:
    """(source, source_size, target) by code point with null last: shares by weight, none over `times` its size.

    by_source is one row per source. What a full source can't take is shared among the others by weight, until none is
    above; when all are full, the rest isn't taken.
    """
    ordered = sorted(by_source, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    left, free, target = share * sum(n for _, n in ordered), list(range(len(ordered))), [0.0] * len(ordered)
    while free:
        whole = sum(weight[i] for i in free)
        full = [i for i in free if left * weight[i] / whole > times * ordered[i][1]]
        if not full:
            for i in free:
                target[i] = left * weight[i] / whole
            break
        for i in full:
            target[i] = times * ordered[i][1]
        left -= sum(target[i] for i in full)
        free = [i for i in free if i not in full]
    return [(s, n, t) for (s, n), t in zip(ordered, target, strict=True)]


def _bucketed_sum(rows: DataFrame, keys: list[str], bucket: str, order: list, value: str, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the rows of the same keys ahead in (bucket, order)."""
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    over = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return own.join(totals, [*keys, bucket]).withColumn(name, F.col("_own") + F.col("_ahead")).drop("_own", "_ahead", bucket)


def shuffled_stream(sized: DataFrame, seed: str = SEED, buckets: int = 256) -> DataFrame:
    """sized (no, doc_id, nth, size) with `begin`: the words ahead of the document in its source's shuffled stream, which
    is in the order of the digests, whatever the number of buckets."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = sized.withColumn("_d", F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.col("size").cast("string"))))
    rows = rows.withColumn("_b", F.shiftright(F.conv(F.substring("_d", 1, 8), 16, 10).cast("long") * buckets, 32))
    return _bucketed_sum(rows, ["nth"], "_b", ["_d", "doc_id", "size", "no"], "size", "begin").drop("_d")


def point(slot: Column) -> Column:
    """The van der Corput point of a slot: its bits in reverse, as an integer below 2**POINT_BITS."""
    for step, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        right = F.shiftrightunsigned(slot, step).bitwiseAND(F.lit(mask))
        slot = right.bitwiseOR(F.shiftleft(slot.bitwiseAND(F.lit(mask)), step))
    slot = F.shiftrightunsigned(slot, 32).bitwiseOR(F.shiftleft(slot, 32))
    return F.shiftrightunsigned(slot, 64 - POINT_BITS)


def intervals(wanted: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, low, high, nth, need, take): the points of each source, low to high - 1, by the cells that they meet. wanted:
    (nth, slots, words to take)."""
    total, cum, out = sum(n for _, n, _ in wanted), 0, []
    size = (1 << POINT_BITS) // CELLS
    for nth, n, take in wanted:
        low, cum = (cum << POINT_BITS) // total, cum + n
        high = (cum << POINT_BITS) // total
        out += [(cell, low, high, nth, n, take) for cell in range(low // size, (high - 1) // size + 1)]
    return out


def schedule(spark: SparkSession, known: list[tuple[int, int, int]], block: int = BLOCK) -> DataFrame:
    """(slot, nth, rank, words): the slots of all sources. known: (nth, source_size, words to take), a row per source."""
    wanted = [(nth, -(-take // block), take) for nth, size, take in known if size and take]
    total = sum(n for _, n, _ in wanted)
    by_cell = spark.createDataFrame(intervals(wanted), "cell long, low long, high long, nth int, need long, take long")
    slots = spark.range(total).select(F.col("id").alias("slot"), point(F.col("id")).alias("u"))
    slots = slots.withColumn("cell", F.shiftright("u", POINT_BITS - CELLS.bit_length() + 1)).join(F.broadcast(by_cell), "cell").where("low <= u and u < high")
    slots = slots.select("slot", "nth", "need", "take", F.lit(1).cast("long").alias("one"), F.floor(F.col("slot") / SLOTS_PER_BUCKET).alias("_b"))
    ranked = _bucketed_sum(slots, ["nth"], "_b", ["slot"], "one", "rank").select("slot", "nth", "need", "take", "rank").where("rank < need")
    got = ranked.groupBy("nth").agg(F.count("*").alias("got"))
    rest = spark.createDataFrame(wanted, "nth int, need long, take long").join(got, "nth", "left")
    rest = rest.withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    rest = rest.select("nth", "need", "take", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    rest = rest.withColumn("slot", F.lit(total) + F.col("rank") * len(known) + F.col("nth"))
    every = ranked.unionByName(rest.select(ranked.columns))
    return every.select("slot", "nth", "rank", F.least(F.lit(block), F.col("take") - F.col("rank") * block).alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, times: float = TIMES, block: int = BLOCK, seed: str = SEED, no_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots, starts, source, no) per row of docs; no is that of
    no_col, if named.

    taken is how many of the document's words the mix takes, repeats counted; n_slots how often a slot takes some of them
    in a pass of its stream, first_slot the first of these slots (null for none), and starts the slots that take its first
    word, in ascending order. A
    source's taken words are its target, rounded down. Texts that are null or blank have size 0 and are taken 0 words; a
    null source is a source of its own; repeated and null doc_ids are rows of their own. Sources of size 0 have target 0.
    An empty table gives no rows. The driver holds the sources, SOURCES at most, not their documents.
    """
    spark = docs.sparkSession
    sized = written(sizes(docs, no_col=no_col), "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size"), F.count("*")).limit(SOURCES + 1).collect()
    if len(by_source) > SOURCES:
        raise ValueError(f"over {SOURCES} sources")
    known = targets([(r[0], r[1]) for r in by_source], weights, share, times)
    listed = spark.createDataFrame([(s, i, n, float(t)) for i, (s, n, t) in enumerate(known)], "source string, nth int, source_size long, target double")
    sized = sized.join(F.broadcast(listed), sized["source"].eqNullSafe(listed["source"])).drop(listed["source"])
    placed = shuffled_stream(sized.where("size > 0").select("no", "doc_id", "nth", "size"), seed, max(LEAST_BUCKETS, sum(r[2] for r in by_source) // BUCKET_ROWS))
    plan = schedule(spark, [(i, n, int(t)) for i, (_, n, t) in enumerate(known)], block)
    # The stream is cut anew in each pass, so a slot's words are one interval of a pass or of two that meet.
    plan = plan.join(F.broadcast(listed.select("nth", "source_size")), "nth")
    start = F.col("rank") * block
    plan = plan.select("slot", "nth", "source_size", start.alias("from"), (start + F.col("words")).alias("to"))
    first, last = F.floor(F.col("from") / F.col("source_size")), F.floor((F.col("to") - 1) / F.col("source_size"))
    plan = plan.withColumn("pass", F.explode(F.sequence(first, last)))
    base = F.col("pass") * F.col("source_size")
    plan = plan.select("slot", "nth", F.greatest(F.col("from") - base, F.lit(0)).alias("from"), F.least(F.col("to") - base, "source_size").alias("to"))
    # Tiles of a stream join slots and documents: a document's words in a tile meet the slots' words in it.
    tile = lambda c: F.floor(F.col(c) / block)
    plan = plan.withColumn("tile", F.explode(F.sequence(tile("from"), F.floor((F.col("to") - 1) / block))))
    plan = plan.groupBy("nth", "tile").agg(F.collect_list(F.struct("slot", "from", "to")).alias("slots"))
    pieces = placed.withColumn("end", F.col("begin") + F.col("size")).select("no", "nth", "begin", "end")
    pieces = pieces.withColumn("tile", F.explode(F.sequence(tile("begin"), F.floor((F.col("end") - 1) / block))))
    met = pieces.join(plan, ["nth", "tile"]).select("no", "begin", "end", "tile", F.explode("slots").alias("s")).select("no", "begin", "end", "tile", "s.*")
    a, b = F.greatest("from", "begin"), F.least("to", "end")
    # What a slot takes of the document is counted in its first tile; its words in this tile alone make up the sum.
    low, high = F.greatest(a, F.col("tile") * block), F.least(b, (F.col("tile") + 1) * block)
    met = met.where(low < high).select("no", "slot", (high - low).alias("words"), (low == a).alias("opens"), (low == F.col("begin")).alias("heads"))
    taken = met.groupBy("no").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count_if("opens").alias("n_slots"),
        F.array_sort(F.collect_list(F.when(F.col("heads"), F.col("slot")))).alias("starts"),
    )
    out = sized.join(taken, "no", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    starts = F.coalesce("starts", F.array().cast("array<bigint>")).alias("starts")
    return out.select("doc_id", "size", "source_size", "target", zero("taken"), "first_slot", zero("n_slots"), starts, "source", "no")
