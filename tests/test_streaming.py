import json
import time

import pandas as pd
from pyspark.sql import functions as F

from citeloom.plans.ingest import Ingest
from citeloom.plans.settings import Settings
from citeloom.sources import fixtures as fx
from citeloom.sources.spans import plain_text
from citeloom.streaming import changes, feed, watch


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_of_bursts_equals_the_batch(spark, sf_dir, tmp_path):
    acts = watch.actions(fx.fixture(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros("us")))
    acts.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    last = acts.agg(F.max("ts")).first()[0]
    end = spark.createDataFrame([(10**9, "zz.pdf", "upsert", last + pd.Timedelta(hours=2).to_pytimedelta())], acts.schema)
    stream = spark.readStream.schema(acts.schema).parquet(str(tmp_path / "in"))
    query = watch.bursts(stream, late="1 hour").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    end.write.mode("append").parquet(str(tmp_path / "in"))
    query.processAllAvailable()
    query.stop()
    want = watch.bursts(acts)
    cols = ["path", "started", "due", "action", "n_events"]
    assert rows(spark.table("bursts"), *cols) == rows(want, *cols)


def test_exact_gap_is_one_burst(spark):
    events = spark.createDataFrame([(i, "a.pdf", "modified", None, t, False) for i, t in enumerate([0, 4, 7, 12])], "event_id long, path string, op string, dest string, s long, is_dir boolean")
    got = watch.bursts(watch.actions(events.withColumn("ts", F.timestamp_seconds("s")))).collect()
    assert sorted(r["n_events"] for r in got) == [1, 3]


def test_moves_and_last_event(spark):
    events = spark.createDataFrame([(1, "a.pdf", "created", None, 1, False), (2, "a.pdf", "moved", "b.PDF", 2, False), (3, "d", "created", None, 3, True), (4, "x.txt", "moved", "y.pdf", 4, False)], "event_id long, path string, op string, dest string, ts long, is_dir boolean")
    assert rows(watch.last_actions(watch.actions(events), []), "path", "action") == [("a.pdf", "remove"), ("b.PDF", "upsert"), ("y.pdf", "upsert")]


def test_apply_hands_over_removals_first(spark, tmp_path):
    df = spark.createDataFrame([("a.pdf", "remove"), ("b.pdf", "upsert")], "path string, action string")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    take = lambda kind: lambda batch: seen.extend((kind, r[0]) for r in batch.collect())
    query = watch.apply(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "c"), take("remove"), take("upsert"))
    query.processAllAvailable()
    query.stop()
    assert seen == [("remove", "a.pdf"), ("upsert", "b.pdf")]


def test_changes_between_listings():
    before = {"a": [1, 10], "b": [2, 20], "c": [3, 30], "d": [4, 40], "e": [4, 40]}
    after = {"a": [1, 10], "b": [2, 21], "x": [3, 30], "y": [9, 90], "z": [4, 40]}
    assert changes.changes(before, after) == [("b", "modified", None, 2), ("c", "moved", "x", 3), ("d", "deleted", None, None), ("e", "deleted", None, None), ("y", "created", None, 9), ("z", "created", None, 4)]


def test_versions_can_be_read_again(tmp_path):
    docs = tmp_path / "docs"
    (docs / "sub").mkdir(parents=True)
    (docs / "a.pdf").write_text("one")
    log = changes.Log(str(tmp_path / "log"), str(docs))
    assert log.latest() == log.look() == 0
    (docs / "sub" / "b.pdf").write_text("two")
    assert log.look() == 1 and log.look() == 1
    (docs / "a.pdf").rename(docs / "sub" / "c.pdf")
    again = changes.Log(str(tmp_path / "log"), str(docs))
    assert again.look() == 2
    rows = [(r[1], r[2], r[3], r[6]) for r in again.rows(0, 2)]
    assert rows == [("sub/b.pdf", "created", None, 3), ("a.pdf", "moved", "sub/c.pdf", 3)] and [r[1] for r in log.rows(1, 2)] == ["a.pdf"]
    again.forget(1)
    assert [p.name for p in (tmp_path / "log").glob("changes-*")] == ["changes-000000002.json"]


def wait_for(true, seconds=240):
    end = time.time() + seconds
    while time.time() < end and not true():
        time.sleep(0.5)
    return true()


def test_follow_goes_on_after_a_restart(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.pdf").write_text("one line of text")
    (docs / "gone.pdf").write_text("a line that goes")
    said = []
    settings = Settings(pdf_dir=str(docs), store_dir=str(tmp_path / "s"), state_dir=str(tmp_path / "t"), embedding_dim=8, debounce_seconds=1.0, stability_seconds=1.0)
    ingest = Ingest(spark, settings, plain_text, progress=said.append)
    known = lambda: sorted(r[0] for r in ingest.store.read("manifest").where("status = 'indexed'").select("rel_path").collect())
    query = feed.follow(ingest, "1 second")
    assert known() == ["a.pdf", "gone.pdf"]
    time.sleep(2)
    (docs / "gone.pdf").unlink()
    (docs / "b.pdf").write_text("another line")
    assert wait_for(lambda: known() == ["a.pdf", "b.pdf"]), query.exception()
    assert wait_for(lambda: len([x for x in said if x.startswith("ingest-")]) == 2 and not query.status["isTriggerActive"])
    query.stop()
    words = [x.split(":")[0] for x in said if not x.startswith(("indexed", "recovered"))]
    assert words.index("removed") < words.index("ingest-start")
    (docs / "c.pdf").write_text("a line that nobody saw")
    (docs / "a.pdf").rename(docs / "moved.pdf")
    said.clear()
    query = feed.follow(ingest, "1 second", initial_sync=False)
    assert wait_for(lambda: known() == ["b.pdf", "c.pdf", "moved.pdf"]), query.exception()
    time.sleep(4)
    query.stop()
    assert sum(x.startswith("ingest-start") for x in said) <= 2 and not any("b.pdf" in x for x in said)


def test_a_path_is_due_when_it_is_quiet(spark, tmp_path):
    """A stream of files of events: a path that is heard of again waits on, and the last action counts."""
    schema = "event_id long, path string, action string, ts timestamp, size long"
    (tmp_path / "in").mkdir()
    put = lambda n, *rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "path", "action", "ts", "size"), r, strict=True))) for r in rows))
    at = "2024-01-01T00:00:00"
    put(0, (1, "a", "upsert", at, 5), (2, "b", "upsert", at, 5), (3, "b", "remove", at, None))
    got = []
    stream = watch.quiet(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), 3.0)
    query = watch.apply(stream, str(tmp_path / "c"), lambda d: got.extend(("remove", r[0]) for r in d.collect()), lambda d: got.extend(("upsert", r[0]) for r in d.collect()))
    assert wait_for(lambda: got == [("remove", "b"), ("upsert", "a")]), query.exception()
    put(1, (4, "b", "upsert", at, 6))
    assert wait_for(lambda: len(got) == 3) and got[-1] == ("upsert", "b")
    query.stop()
