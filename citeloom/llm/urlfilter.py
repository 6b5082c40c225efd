"""URL filters as a sort-merge range join.

A host's canonical key is its labels in reverse, each closed by U+0001, so a rule's host and all its subdomains are
one interval of keys, and intervals are nested or apart. Urls are sorted by key; one sweep over them keeps a stack of
the rules whose interval is open, each level of the stack being a host with its path rules by length and path, and a
url's rule is the longest one of the stack whose path the url's path starts with.

Rules that fit `broadcast_rules` go to every task, and urls are sorted where they are, without a shuffle. Beyond that,
both sides are dealt by segments of the key space, which are cut at every broadcast_rules-th rule; a rule is copied to
each segment that its interval meets, and the urls of a segment are salted, so a hot host is many tasks' work.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.shared import ascii_lower, in_python, spread

SEP = "\x01"
BROADCAST_RULES = 50_000
SALTS = 8
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEP), F.lit(SEP))


class Sweep:
    """Rules [(key, path, rule, verdict)] in key order, and the stack of those open at the last key that was asked."""

    def __init__(self, rules: list[tuple]):
        self.hosts: list[str] = []
        self.at: dict[str, tuple[list[int], dict[str, tuple]]] = {}  # of a host the lengths of its paths, longest first, and its rules by path
        for key, path, rule, verdict in sorted(rules, key=lambda r: (r[0], -len(r[1]), r[2], r[3])):
            if key not in self.at:
                self.hosts.append(key)
                self.at[key] = ([], {})
            lengths, by_path = self.at[key]
            if not lengths or lengths[-1] != len(path):
                lengths.append(len(path))
            by_path.setdefault(path, (rule, verdict))
        self.next, self.open, self.last = 0, [], ""

    def find(self, key: str, path: str) -> tuple[str | None, str | None]:
        """The rule and verdict for a key that is no smaller than the one before; of equally long rules the first."""
        if key < self.last:  # another sorted run begins
            self.next, self.open = bisect.bisect_left(self.hosts, key[: key.index(SEP) + 1]), []
        self.last = key
        while self.open and not key.startswith(self.open[-1]):
            self.open.pop()
        while self.next < len(self.hosts) and self.hosts[self.next] <= key:
            host = self.hosts[self.next]
            if key.startswith(host):
                while self.open and not host.startswith(self.open[-1]):
                    self.open.pop()
                self.open.append(host)
                self.next += 1
            else:  # on to the next rule that can hold this key or a later one
                self.next = max(self.next + 1, bisect.bisect_left(self.hosts, key[: key.index(SEP) + 1], self.next))
        found = []
        for host in self.open:
            lengths, by_path = self.at[host]
            n = next((n for n in lengths if n <= len(path) and path[:n] in by_path), None)
            if n is not None:
                found.append(by_path[path[:n]])
        return min(found, key=lambda r: (-len(r[0]), r[0], r[1] or "")) if found else (None, None)


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", broadcast_rules: int = BROADCAST_RULES, salts: int = SALTS, default: str = DEFAULT) -> DataFrame:
    """urls with host, path, rule and verdict added (columns of those names are replaced); one row per row of urls.

    rules: host, path, verdict (allow or block), in any number; null hosts or paths are left out, and of rules that
    are equally long for a url the first by name and verdict holds. rule is host and path joined; null and the default
    verdict where none fits. A null url, or one without ://, has an empty host and path, which no rule fits unless its
    host and path are both empty. Empty tables are allowed.
    """
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rows = urls.select(F.struct(*names).alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("key", key_of(F.col("host")))
    known = rules.where("host is not null and path is not null").select(
        key_of(ascii_lower(F.col("host"))).alias("key"), "path", F.concat(ascii_lower(F.col("host")), "path").alias("rule"), "verdict"
    ).distinct()
    n = known.count()
    out = ["row", "host", "path", "rule", "verdict"]
    if n <= broadcast_rules:
        shared = known.sparkSession.sparkContext.broadcast([tuple(r) for r in known.collect()])
        plain = spread(rows).sortWithinPartitions("key").select("key", "host", "path", "row")

        def sweep(batches):
            state = Sweep(shared.value)
            for b in batches:
                found = [state.find(k, p) for k, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(3), b.column(1), b.column(2), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], out
                )

        judged = in_python(plain, sweep, _schema(rows))
    else:
        judged = _by_segments(rows, known, n, broadcast_rules, salts)
    return judged.select("row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _schema(rows: DataFrame) -> str:
    return f"row {rows.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string"


def _by_segments(rows: DataFrame, known: DataFrame, n: int, size: int, salts: int) -> DataFrame:
    spark = rows.sparkSession
    keys = known.select("key").distinct()
    share = [i * size / n for i in range(1, -(-n // size))]
    hashed = keys.select(F.expr("cast(conv(hex(substring(rpad(encode(key, 'utf-8'), 7, x'00'), 1, 7)), 16, 10) as long)").alias("h"))
    cuts = sorted(set(hashed.approxQuantile("h", share, 0.1 * size / n)))
    if len(cuts) > 10_000:
        raise ValueError("over 10,000 segments: raise broadcast_rules")
    bounds = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")

    def segment(key: Column) -> Column:
        head = F.conv(F.hex(F.substring(F.rpad(F.encode(key, "utf-8"), 7, F.lit(b"\0")), 1, 7)), 16, 10).cast("long")
        return F.size(F.filter(bounds, lambda b: b <= head))

    last = F.concat(F.col("key"), F.lit("\U0010ffff"))
    copies = known.withColumn("segment", F.explode(F.sequence(segment(F.col("key")), segment(last))))
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("kind", F.lit(0))
    asked = rows.withColumn("segment", segment(F.col("key"))).withColumn("kind", F.lit(1))
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("key", "path", F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    both = copies.unionByName(asked, allowMissingColumns=True).select("segment", "salt", "kind", "key", "path", "rule", "verdict", "host", "row")
    both = both.repartition("segment", "salt").sortWithinPartitions("segment", "salt", "kind", "key")
    out = ["row", "host", "path", "rule", "verdict"]

    def sweep(batches):
        here, rules, state = None, [], None
        for b in batches:
            lists = [b.column(i).to_pylist() for i in range(7)]
            keep, found = [], []
            for i, (segment_no, salt, kind, key, path, rule, verdict) in enumerate(zip(*lists, strict=True)):
                if (segment_no, salt) != here:
                    here, rules, state = (segment_no, salt), [], None
                if kind == 0:
                    rules.append((key, path, rule, verdict))
                else:
                    state = state or Sweep(rules)
                    keep.append(i)
                    found.append(state.find(key, path))
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(8), kept.column(7), kept.column(4), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], out
            )

    return in_python(both, sweep, _schema(rows))
