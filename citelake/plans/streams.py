"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.sources.shared import shared_dir
from citelake.streaming import watch

from .citations import query


@query("stream_status_windows", "SELECT start, status, count(*) AS n FROM (SELECT date_trunc('day', ts) AS start, event_type AS status FROM events) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL")
def stream_status_windows(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    changes = source.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return watch.run_to_end(spark, watch.status_windows(changes), shared_dir(spark))


_KIND = "CASE event_type WHEN 'click' THEN 'track' WHEN 'view' THEN 'status' WHEN 'purchase' THEN 'note' ELSE 'remove' END"


@query("tracked_items", f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, {_KIND} AS action, event_id % 100 AS item_id, 'v' || event_id AS value, ts FROM events),
g AS (SELECT key, max((ts, event_id)) FILTER (action = 'remove') AS gone, arg_max(action, (ts, event_id)) FILTER (action IN ('track', 'remove')) AS last FROM e GROUP BY key),
s AS (SELECT key, action, arg_max(item_id, (e.ts, e.event_id)) AS item_id, arg_max(value, (e.ts, e.event_id)) AS value FROM e JOIN g USING (key) WHERE last = 'track' AND (action = 'track' OR gone IS NULL OR (e.ts, e.event_id) > gone) AND action <> 'remove' GROUP BY key, action)
SELECT key, max(item_id) FILTER (action = 'track') AS item_id, max(value) FILTER (action = 'status') AS status, max(value) FILTER (action = 'note') AS note FROM s GROUP BY key""")
def tracked_items(spark, d):
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    events = source.selectExpr("cast(user_id as string) AS key", "event_id", f"{_KIND} AS action", "event_id % 100 AS item_id", "concat('v', event_id) AS value", "cast(ts as timestamp) AS ts")
    # The table isn't in the order of time: nothing is too late.
    states = watch.run_updates(spark, watch.tracked_items(events, "3650 days", "36500 days"), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    return watch.current(states)
