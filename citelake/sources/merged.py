"""Tables in buckets that updates are merged into: only the buckets that an update changes are written anew, and a second run of it changes nothing.

A table is a folder with a manifest, which names for each bucket (a hash of the key) the folder of Parquet files that holds it. A merge reads the buckets that
hold the update's keys, compares, writes those that differ into a new folder and then the next manifest, by one rename: until then readers see the old state, and a
run that breaks off leaves nothing but an unused folder. One merge runs at a time.

The number of buckets is the table's own and fixed when it is made; the driver handles a row for each bucket, never rows of the table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, own = _fs(spark, f"{path}/manifests")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(own) if x.getPath().getName().isdigit()) if fs.exists(own) else []


def manifest(spark: SparkSession, path: str) -> dict:
    """The newest manifest: key, buckets, schema and the folder of each bucket that has rows."""
    return json.loads(spark.read.text(f"{path}/manifests/{_versions(spark, path)[-1]}", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    version = (_versions(spark, path) or [0])[-1] + 1
    fs, temporary = _fs(spark, f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(json.dumps(content).encode())
    out.close()
    if not fs.rename(temporary, _fs(spark, f"{path}/manifests/{version}")[1]):
        raise RuntimeError(f"another merge has written version {version} of {path}")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> list[tuple[int, str]]:
    """Write rows by bucket into a new folder; (bucket, folder) of each."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.withColumn("_bucket", _bucket(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", key).write.partitionBy("_bucket").parquet(f"{path}/{folder}")
    fs, own = _fs(spark, f"{path}/{folder}")
    return [(int(name.split("=")[1]), f"{folder}/{name}") for name in (x.getPath().getName() for x in fs.listStatus(own)) if name.startswith("_bucket=")]


def create(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A table of rows with distinct keys that aren't null."""
    _commit(rows.sparkSession, path, {"key": key, "buckets": buckets, "schema": rows.schema.json(), "folders": {str(b): f for b, f in _write(rows, path, key, buckets)}})


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The table, or some of its buckets."""
    from pyspark.sql.types import StructType

    own = manifest(spark, path)
    folders = [f"{path}/{f}" for b, f in own["folders"].items() if only is None or int(b) in only]
    schema = StructType.fromJson(json.loads(own["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def merge(updates: DataFrame, path: str, columns: dict[str, Column] | None = None, insert: bool = True) -> int:
    """Merge rows with distinct keys into the table; the number of buckets that were written.

    An update's columns are those of the table, or the key and some of them. columns: for some the new value, worked out from old and new ones (F.col("old.x"),
    F.col("new.x"), null where a side has no row); else the update's value counts. Without insert, keys that the table doesn't have are passed over. Rows with
    a null key are passed over."""
    spark = updates.sparkSession
    own = manifest(spark, path)
    key, buckets = own["key"], own["buckets"]
    new = updates.filter(F.col(key).isNotNull())
    touched = sorted(r[0] for r in new.select(_bucket(key, buckets)).distinct().collect())
    if not touched:
        return 0
    old = read(spark, path, touched)
    met = old.alias("old").join(new.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full" if insert else "left")
    is_new = F.col(f"new.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(f"old.{key}"), F.col(f"new.{key}"))
        if columns and c in columns:
            return F.when(is_new, columns[c]).otherwise(F.col(f"old.{c}"))
        return F.when(is_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in updates.columns else F.col(f"old.{c}")

    after = met.select(*(value(c).cast(old.schema[c].dataType).alias(c) for c in old.columns), *(F.col(f"old.{c}").alias(f"_{c}") for c in old.columns))
    same = F.lit(True)
    for c in old.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    changed = sorted(r[0] for r in after.filter(~same).select(_bucket(key, buckets)).distinct().collect())
    if changed:
        rows = after.select(*old.columns).filter(_bucket(key, buckets).isin(changed))
        _commit(spark, path, own | {"folders": own["folders"] | {str(b): f for b, f in _write(rows, path, key, buckets)}})
    return len(changed)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what no bucket of the newest manifest names, and older manifests; how many bucket folders went. Not while a merge or an older reader runs."""
    used = set(manifest(spark, path)["folders"].values())
    gone = 0
    fs, own = _fs(spark, f"{path}/data")
    for run in fs.listStatus(own):
        for part in fs.listStatus(run.getPath()):
            name = f"data/{run.getPath().getName()}/{part.getPath().getName()}"
            if name not in used and part.getPath().getName().startswith("_bucket="):
                fs.delete(part.getPath(), True)
                gone += 1
    for version in _versions(spark, path)[:-1]:
        fs.delete(_fs(spark, f"{path}/manifests/{version}")[1], False)
    return gone
