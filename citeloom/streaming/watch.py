"""A corpus's change feed: normalised events, bursts, stability, and the stream that applies them."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from citeloom.functions.workers import with_python_path
from citeloom.sources.listing import is_watched

DEBOUNCE, STABLE = 4.0, 2.0
KEEP = 86_400.0  # seconds after which a path's state goes, whatever became of its timer


def actions(events: DataFrame, *more: str) -> DataFrame:
    """events (event_id, path, op, dest, ts, is_dir) as (event_id, path, action, ts): created and modified upsert,
    deleted removes, moved removes one path and upserts the other; folders and other files are left out. Further columns that
    are named come along."""
    upsert, remove = F.lit("upsert"), F.lit("remove")
    one = lambda p, a: F.struct(F.col(p).alias("path"), a.alias("action"))
    made = (
        F.when(F.col("op").isin("created", "modified"), F.array(one("path", upsert))).when(F.col("op") == "deleted", F.array(one("path", remove)))
        .when(F.col("op") == "moved", F.array(one("path", remove), one("dest", upsert)))
    )
    rows = events.where(~F.col("is_dir")).select("event_id", "ts", *more, F.explode(made).alias("a")).select("event_id", "a.path", "a.action", "ts", *more)
    return rows.where(F.col("path").isNotNull() & is_watched(F.col("path")))


def last_actions(acts: DataFrame, burst: list[str]) -> DataFrame:
    """Per burst and path the last action."""
    return acts.groupBy(*burst, "path").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"), F.count("*").alias("n_events"))


def bursts(acts: DataFrame, gap: float = DEBOUNCE, late: str = "10 minutes") -> DataFrame:
    """(path, started, due, action, n_events): a burst ends when no event follows for over `gap` seconds.

    Works on a table and on a stream; on a stream, in append mode, a burst comes out once the watermark passes `due`.
    """
    window = F.session_window("ts", f"{gap:g} seconds")
    rows = acts.withWatermark("ts", late) if acts.isStreaming else acts
    found = rows.groupBy("path", window).agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"), F.count("*").alias("n_events"))
    return found.select("path", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("due"), "action", "n_events")


def stable(looks: DataFrame, wait: float = STABLE) -> DataFrame:
    """(path, stable_at): of looks (path, us, size), sizes null where the file can't be read, the first look at which the
    size has been the same for `wait` seconds. A change of size starts anew."""
    order = Window.partitionBy("path").orderBy("us")
    new = F.coalesce(~F.col("size").eqNullSafe(F.lag("size").over(order)), F.lit(True)).cast("int")
    rows = looks.withColumn("_run", new).withColumn("_run", F.sum("_run").over(order))
    since = F.min("us").over(Window.partitionBy("path", "_run"))
    ready = rows.where(F.col("size").isNotNull()).withColumn("_since", since).where(F.col("us") - F.col("_since") >= int(wait * 1e6))
    return ready.groupBy("path").agg(F.min("us").alias("stable_at"))


class Quiet(StatefulProcessor):
    """Keeps a path's last action and size and when it is due; each event sets the time anew, and the action comes out when
    the timer fires, be there events or not. For transformWithState in processing time."""

    OUT, STATE = "path string, action string", "action string, size long, due long"

    def __init__(self, wait: float, keep: float = KEEP):
        self.wait, self.keep = int(wait * 1000), int(keep * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.STATE, self.keep)

    def handleInputRows(self, key, rows, timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        action, size = events["action"].iloc[-1], events["size"].iloc[-1]
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[2])
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait
        self.handle.registerTimer(due)
        self.last.update((action, -1 if pd.isna(size) else int(size), due))
        yield pd.DataFrame({"path": [], "action": []}, dtype=object)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[2] == expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame({"path": [key[0]], "action": [self.last.get()[0]]})
            self.last.clear()

    def close(self) -> None:
        pass


def quiet(acts: DataFrame, wait: float = max(DEBOUNCE, STABLE)) -> DataFrame:
    """(path, action) of a stream of actions (event_id, path, action, ts, size): a path's last action, once nothing has
    been heard of it for `wait` seconds. A file that is being written is heard of at each look, so it waits for its end."""
    spark = acts.sparkSession
    with_python_path(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return acts.groupBy("path").transformWithStateInPandas(Quiet(wait), Quiet.OUT, "Append", "processingtime")


def steps(due: DataFrame) -> DataFrame:
    """due (path, action) with `step`: removals come first, then upserts."""
    return due.withColumn("step", F.when(F.col("action") == "remove", 0).otherwise(1))


def hand_over(due: DataFrame, on_remove, on_upsert) -> None:
    """Hands the removals of due (path, action) over, then its upserts; both take a DataFrame (path) that has rows."""
    rows = steps(due)
    for step, function in enumerate((on_remove, on_upsert)):
        own = rows.where(F.col("step") == step).select("path")
        if not own.isEmpty():
            function(own)


def apply(stream: DataFrame, checkpoint: str, on_remove, on_upsert, every: str = "1 second", busy: type[Exception] | tuple = ()):
    """Starts the query that hands each batch of a stream of due actions over. The checkpoint makes a restart go on where it
    ended, with the batch that wasn't finished. A hand-over that raises `busy` is tried again."""

    def drain(batch: DataFrame, _epoch: int) -> None:
        rows = batch.persist()
        try:
            while True:
                try:
                    hand_over(rows, on_remove, on_upsert)
                    break
                except busy:
                    time.sleep(1)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
