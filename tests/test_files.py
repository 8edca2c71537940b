"""Files and streams."""

from pyspark.sql import functions as F

from citelake.sources import files
from citelake.streaming import watch


def test_json_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for compress in (True, False):
        files.write_json(rows, f"{tmp_path}/x{compress}", compress)
        assert sorted(files.read_json(spark, f"{tmp_path}/x{compress}", rows.schema).collect()) == sorted(rows.collect())


def test_references(spark):
    schema = "recid long, references array<struct<record:string,label:string>>"
    rows = spark.createDataFrame([(1, [("https://x/literature/7", "1"), (None, "2")]), (2, None)], schema)
    assert [tuple(r) for r in files.references_of(rows).collect()] == [(1, 0, 7, "1"), (1, 1, None, "2")]


def test_state_stream(spark, tmp_path):
    rows = [(i % 3, i, "view" if i < 5 else "purchase") for i in range(8)]
    table = spark.createDataFrame(rows, "user_id long, event_id long, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    table.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    watch.keep_state(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    table.withColumn("event_id", F.col("event_id") + 100).withColumn("ts", F.timestamp_seconds(F.col("event_id"))).limit(1).write.mode("append").parquet(f"{tmp_path}/in")
    watch.keep_state(stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    state = {r["user_id"]: r["event_id"] for r in spark.read.parquet(f"{tmp_path}/state/v1").collect()}
    assert len(state) == 3 and max(state.values()) >= 100
