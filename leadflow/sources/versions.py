"""Keyed tables in versions: new rows are written beside the old ones, and a one-row pointer, written last, makes them current.

Layout under a root folder: ``data/version=<v>/bucket=<b>/`` holds rows, dealt to a fixed number of
buckets by a hash of their key; ``manifests/<v>`` says in which version each bucket was last
written; ``pointers`` has one row per version.  Readers follow the pointer with the highest number.
An upsert reads and writes only the buckets that its keys fall in.  A job that dies before its
pointer is written leaves the old version current; what it wrote is never read, and the next upsert
takes another version name.  One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators.shared import handover
from leadflow.sources.tables import upsert

#: Buckets of a new table; a table keeps the number it was made with.
BUCKETS = 64

POINTER = "number bigint, version string, buckets int, layout string"
MANIFEST = "bucket int, version string"


def bucket_of(key: list[str] | list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder has been written to, on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def pointer(spark: SparkSession, root: str):
    """The current pointer row; None before the first version."""
    path = f"{root}/pointers"
    if not _exists(spark, path):
        return None
    return spark.read.schema(POINTER).parquet(path).orderBy(F.desc("number"), F.desc("version")).first()


def _point(spark: SparkSession, root: str, row: tuple) -> None:
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The current version, with ``bucket``, by which scans are pruned; the schema is the one it was made with."""
    now = pointer(spark, root)
    if now is None:
        raise FileNotFoundError(f"no version has been written under {root}")
    # at most one row per bucket
    held = spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{now.version}").collect()
    paths = [f"{root}/data/version={r.version}/bucket={r.bucket}" for r in held]
    layout = f"{now.layout}, version string, bucket int"
    if not paths:
        return spark.createDataFrame([], layout).drop("version")
    return spark.read.schema(layout).option("basePath", f"{root}/data").parquet(*paths).drop("version")


def lookup(spark: SparkSession, root: str, key: str, value: Column) -> DataFrame:
    """The row of a key, or none; only the key's bucket is scanned."""
    now = pointer(spark, root)
    table = read(spark, root)
    return table.filter((F.col("bucket") == bucket_of([value], now.buckets)) & (F.col(key) == value)).drop("bucket")


def create(df: DataFrame, root: str, key: list[str], buckets: int = BUCKETS) -> None:
    """Makes ``df`` (one row per key) the first version of a table, or replaces all rows of an existing one."""
    spark = df.sparkSession
    now = pointer(spark, root)
    number, version = (now.number + 1 if now else 0), f"{now.number + 1 if now else 0}-{uuid.uuid4().hex}"
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    _write(df, root, key, buckets, version)
    _finish(spark, root, number, version, buckets, layout, None)


def save(delta: DataFrame, root: str, key: list[str], keep: list[str] | None = None, order: str | None = None, buckets: int = BUCKETS) -> None:
    """Upserts ``delta`` into the table at ``root``, as ``tables.upsert`` does, and makes the result current.

    Without a table yet, ``delta`` becomes the first version.  Only buckets with keys of ``delta``
    are read and written.
    """
    spark = delta.sparkSession
    now = pointer(spark, root)
    if now is None:
        base = spark.createDataFrame([], delta.schema)
        create(upsert(base, delta, key, keep, order), root, key, buckets)
        return
    delta = handover(delta.withColumn("_bucket", bucket_of(key, now.buckets)), "delta")
    touched = [r._bucket for r in delta.select("_bucket").distinct().collect()]  # at most as many as there are buckets
    table = read(spark, root)
    base = table.filter(F.col("bucket").isin(touched)).drop("bucket")
    version = f"{now.number + 1}-{uuid.uuid4().hex}"
    _write(upsert(base, delta.drop("_bucket"), key, keep, order), root, key, now.buckets, version)
    _finish(spark, root, now.number + 1, version, now.buckets, now.layout, now.version)


def _write(df: DataFrame, root: str, key: list[str], buckets: int, version: str) -> None:
    # few files a bucket, however many tasks there were; a bucket too large for one task is split again
    placed = df.withColumn("bucket", bucket_of(key, buckets)).hint("rebalance", "bucket")
    placed.write.partitionBy("bucket").parquet(f"{root}/data/version={version}")


def _finish(spark: SparkSession, root: str, number: int, version: str, buckets: int, layout: str, before: str | None) -> None:
    """Writes the manifest of a version and then, last of all, its pointer."""
    written = spark.read.schema(f"{layout}, bucket int").parquet(f"{root}/data/version={version}")
    own = written.select("bucket").distinct().withColumn("version", F.lit(version))
    if before is not None:
        old = spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{before}")
        own = own.unionByName(old.join(own.select("bucket"), "bucket", "left_anti"))
    own.select("bucket", "version").coalesce(1).write.parquet(f"{root}/manifests/{version}")
    _point(spark, root, (number, version, buckets, layout))
