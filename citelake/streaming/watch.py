"""Watched items as a stream: status changes counted in windows, and the latest state of each item kept up to date."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citelake.operators.records import latest_state


def status_windows(changes: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, status, n): changes of each status in windows of time. A change counts once by its id, if it is at most `late` late; a
    window is given out when no change for it is awaited any more."""
    once = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    counted = once.groupBy(F.window("ts", length), F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "status", "n")


def run_to_end(spark: SparkSession, result: DataFrame, folder: str) -> DataFrame:
    """Work through all input that is there, and read what came out of it. State and results are in `folder`, which the cluster shares."""
    base = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    started = result.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/out")


def keep_state(changes: DataFrame, state_path: str, checkpoint: str, key: str = "user_id"):
    """A query that, after each batch, writes the latest state of every item as a new version under `state_path`.

    A version holds the batch's number, so a batch that runs again writes the same version again; it reads the version before, so
    that one is kept, too, and older ones are deleted."""
    columns = [c for c in changes.columns if c != key]

    def merge(batch: DataFrame, number: int) -> None:
        new = batch
        if number > 0:
            new = batch.sparkSession.read.schema(batch.schema).parquet(f"{state_path}/v{number - 1}").unionByName(batch)
        latest_state(new, key, ["ts", "event_id"], columns).write.mode("overwrite").parquet(f"{state_path}/v{number}")
        if number > 1:
            spark = batch.sparkSession
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/v{number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What an event does to an item: it is tracked (again), its status or note is set, it is removed.
TRACK, STATUS, NOTE, REMOVE = "track", "status", "note", "remove"
_SLOTS = "tracked boolean, track_at long, track_id long, item_id long, status string, status_at long, status_id long, note string, note_at long, note_id long, gone_at long, gone_id long"
ITEM = "key string, item_id long, status string, note string, removed boolean"


class _Items(StatefulProcessor):
    """Each part of an item keeps the time and id of the event that set it, so late and repeated events change nothing. A status or note from before the last
    removal doesn't count; what a removal leaves, a tombstone, goes when a timer says that no event so old is awaited any more."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("item", _SLOTS)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        names = [x.split()[0] for x in _SLOTS.split(", ")]
        old = dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names)
        now = dict(old)
        later = lambda mark, slot: now[f"{slot}_at"] is None or mark > (now[f"{slot}_at"], now[f"{slot}_id"])
        for r in rows:
            kind, mark = r["action"], (r["at"], r["event_id"])
            slot = {TRACK: "track", REMOVE: "track", STATUS: "status", NOTE: "note"}.get(kind)
            if slot is None:
                continue
            if kind == REMOVE and later(mark, "gone"):
                now["gone_at"], now["gone_id"] = mark
                for x in (STATUS, NOTE):
                    if later(mark, x):
                        now[x], now[f"{x}_at"], now[f"{x}_id"] = None, None, None
            if not later(mark, slot) or (slot != "track" and not later(mark, "gone")):
                continue
            now[f"{slot}_at"], now[f"{slot}_id"] = mark
            if slot == "track":
                now |= {"tracked": kind == TRACK, "item_id": r["item_id"] if kind == TRACK else now["item_id"]}
            else:
                now[slot] = r["value"]
        if now == old:
            return
        if now["tracked"] is False:
            self.handle.registerTimer(now["track_at"] + self.keep_ms)
        self.state.update(tuple(now[n] for n in names))
        yield Row(key=key[0], item_id=now["item_id"], status=now["status"], note=now["note"], removed=now["tracked"] is not True)

    def handleExpiredTimer(self, key: tuple, timer_values, expired) -> Iterator[Row]:
        if self.state.exists():
            tracked, at, *_ = self.state.get()
            if tracked is False and at + self.keep_ms <= expired.getExpiryTimeInMs():
                self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def tracked_items(events: DataFrame, late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """(key, item_id, status, note, removed): each item's new state whenever events change it, as a stream in update mode.

    events, a stream: key, event_id (distinct), action (track, status, note, remove), item_id, value, ts. The latest event by time, then id, sets each of
    whether an item is tracked, its status and its note, in whatever order and however often events come; a removal takes status and note along. Removed
    items' states are dropped `keep` after their removal (longer than events may be late). Only keys with events are read and written in a batch. An item that has a status or
    note but was never tracked is given as removed. Events of other actions, or with a null key or time, are passed over."""
    interval = F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00 UTC' + interval {keep})")
    spark = events.sparkSession
    keep_ms = spark.range(1).select(interval).first()[0]
    known = events.filter(F.col("key").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return known.groupBy("key").transformWithState(_Items(keep_ms), ITEM, "Update", "EventTime")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_updates(spark: SparkSession, result: DataFrame, folder: str) -> DataFrame:
    """Work through all input that is there, and read every state that came out, with the number of its batch. A folder that was used before goes on where it
    ended; a batch that runs again replaces what it wrote."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        result.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(f"{ITEM}, batch long").parquet(f"{folder}/out")


def current(states: DataFrame) -> DataFrame:
    """The last state of each key out of run_updates, without removed ones."""
    last = states.groupBy("key").agg(F.max_by(F.struct("item_id", "status", "note", "removed"), "batch").alias("s"))
    return last.filter(~F.col("s.removed")).select("key", "s.item_id", "s.status", "s.note")
