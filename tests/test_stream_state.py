"""Items that a stream keeps: events in any order and repeated, removal and return, restart from the checkpoint."""

import random
import tempfile

from pyspark.sql import functions as F

from citelake.streaming import watch

SCHEMA = "key string, event_id long, action string, item_id long, value string, ts timestamp"


def plain(events):
    """The state after all events, by time and id."""
    out = {}
    for key in {e[0] for e in events if e[0]}:
        own = sorted({e for e in events if e[0] == key}, key=lambda e: (e[5], e[1]))
        tracked = [e for e in own if e[2] in ("track", "remove")]
        if not tracked or tracked[-1][2] != "track":
            continue
        gone = max(((e[5], e[1]) for e in own if e[2] == "remove"), default=(0, 0))
        last = lambda a: next((e[4] for e in reversed(own) if e[2] == a and (e[5], e[1]) > gone), None)  # noqa: E731, B023
        out[key] = (tracked[-1][3], last("status"), last("note"))
    return out


def made_up(rng):
    out = []
    for i in range(120):
        action = rng.choice(["track", "track", "status", "note", "remove", "odd"])
        out.append((rng.choice([None, *"abcdefgh"]), i, action, i % 5 if action == "track" else None, f"v{i}" if action in ("status", "note") else None, 1_700_000_000 + rng.randrange(3000)))
    out += rng.sample(out, 20)
    rng.shuffle(out)
    return out


def feed(spark, folder, rows):
    df = spark.createDataFrame([(*r[:5], r[5]) for r in rows], SCHEMA.replace("timestamp", "long")).withColumn("ts", F.timestamp_seconds("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)


def test_events_in_any_order_with_restarts(spark):
    rng = random.Random(3)
    events = made_up(rng)
    base = tempfile.mkdtemp(prefix="spark-")
    for start in range(0, len(events), 50):  # each feed is worked on by a query of its own, which begins at the checkpoint
        feed(spark, f"{base}/in", events[start : start + 50])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        states = watch.run_updates(spark, watch.tracked_items(stream), f"{base}/run")
    got = {r["key"]: (r["item_id"], r["status"], r["note"]) for r in watch.current(states).collect()}
    assert got == plain(events) and got
    again = watch.run_updates(spark, watch.tracked_items(spark.readStream.schema(SCHEMA).parquet(f"{base}/in")), f"{base}/run")
    assert again.count() == states.count()  # nothing new: nothing is written
    once = tempfile.mkdtemp(prefix="spark-")
    whole = watch.run_updates(spark, watch.tracked_items(spark.readStream.schema(SCHEMA).parquet(f"{base}/in")), once)
    assert {r["key"]: (r["item_id"], r["status"], r["note"]) for r in watch.current(whole).collect()} == got
