"""Joins that survive hot keys, and hand-over tables between the steps of a long job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the context's checkpoint folder, else ``spark.checkpoint.dir``.

    Only a session on one machine that names none gets a private one; a cluster without a shared
    folder is refused, as its executors would each write to their own disk.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return private_dir(spark.sparkContext.master, spark.sparkContext.setCheckpointDir)


def private_dir(master: str, use) -> str:
    """A folder of this machine, handed to ``use``; refused where ``master`` is not ``local``."""
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="leadflow-")
    use(made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/leadflow/{label}-{uuid.uuid4().hex}"


def handover(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the table.

    Cuts lineage (a lost executor repeats tasks of one step only) and makes a result that several
    branches read cost one computation.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_factor(spark: SparkSession) -> int:
    """Parts a hot key is cut into: one per shuffle partition."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_rows(df: DataFrame, *by: str) -> DataFrame:
    """Deal rows to all shuffle partitions by their key ``by``, before work that is heavy per row.

    A table of one or a few row groups would otherwise be worked on by one or a few tasks.  Project
    to narrow rows first.
    """
    return df.repartition(spread_factor(df.sparkSession), *by)


def spread_lookup(
    left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str], how: str = "left"
) -> DataFrame:
    """Join many ``left`` rows to the one ``right`` row of their key, cutting hot keys into parts.

    The left side first says which (key, part) pairs it needs: a distinct with map-side combine, so
    a key held by a third of all rows becomes at most ``spread_factor`` small rows.  The right row
    is copied to exactly those parts, and the final join spreads the hot key over all of them.
    The left side is read twice: pass a stored table or a cheap projection.
    """
    parts = spread_factor(left.sparkSession)
    spread = left.withColumn("_part", F.pmod(F.xxhash64(*spread_by), F.lit(parts)))
    wanted = spread.select(*on, "_part").distinct()
    answers = wanted.join(right, on, "inner")
    return spread.join(answers, [*on, "_part"], how).drop("_part")
