"""Stored tables: keyed upsert, lookups, appends and the JSON run archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def upsert(base: DataFrame, delta: DataFrame, key: list[str], keep: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Keyed upsert: new keys inserted, old keys replaced except for the ``keep`` columns.

    Several delta rows of one key: the one with the greatest ``order`` wins, and of those with equal
    order (or without one) the greatest row, column by column.  ``base`` has one row per key.  The
    result is a new table version, to be written beside the old one (``sources.versions``).
    """
    keep = keep or []
    rest = F.struct(*[c for c in delta.columns if c not in key])
    by = rest if order is None else F.struct(F.col(order).alias("_order"), rest.alias("_row"))
    latest = delta.groupBy(*key).agg(F.max_by(rest, by).alias("_row"))
    delta = latest.select(*key, "_row.*").select(*delta.columns)
    new = delta.select(*key, *[F.col(c).alias(f"_new_{c}") for c in delta.columns if c not in key], F.lit(True).alias("_hit"))
    joined = base.join(new, key, "full_outer")

    def merged(c: str) -> Column:
        if c in key or c not in delta.columns:
            return F.col(c)
        if c in keep:
            return F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c)
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*[merged(c) for c in base.columns])


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    """The run of an id; no row when unknown.  The filter reaches the scan; ``versions.lookup`` scans one bucket."""
    return runs.filter(F.col("run_id") == run_id)


def shortlist_records(options: DataFrame, created_at: Column) -> DataFrame:
    """One pending record per shortlist: shortlist_id, run_id, number of options, status, created_at."""
    return options.groupBy("shortlist_id", "run_id").agg(F.count(F.lit(1)).alias("n_options")).select(
        "shortlist_id", "run_id", "n_options", F.lit("pending").alias("status"), F.lit(None).cast("int").alias("selected_option"),
        created_at.alias("created_at"), created_at.alias("updated_at"),
    )


def settled(records: DataFrame, chosen: DataFrame, at: Column) -> DataFrame:
    """Records that a selection moves from pending to cleared, as rows to be saved.

    ``chosen``: (shortlist_id, option_number), one row per shortlist, see ``operators.route.promote``.
    A record that is not pending stays as it is and gives no row: a selection that comes twice, or
    late, changes nothing.
    """
    won = chosen.select("shortlist_id", F.col("option_number").alias("_option"))
    return records.filter(F.col("status") == "pending").join(won, "shortlist_id").select(
        *[
            {"status": F.lit("cleared").alias("status"), "selected_option": F.col("_option").alias("selected_option"), "updated_at": at.alias("updated_at")}.get(c, F.col(c))
            for c in records.columns
        ]
    )


def pending_shortlists(shortlists: DataFrame) -> DataFrame:
    return shortlists.filter(F.col("status") == "pending")


def clear_shortlists(shortlists: DataFrame, ids: DataFrame) -> DataFrame:
    done = ids.select("shortlist_id", F.lit(True).alias("_done")).distinct()
    status = F.when(F.col("_done"), "cleared").otherwise(F.col("status"))
    return shortlists.join(done, "shortlist_id", "left").withColumn("status", status).drop("_done")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def slug(c: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.lower(cut), F.lit("")), F.lit("artifact"))


def archive_rows(df: DataFrame, kind: str, stamp: Column, run_id: str = "run_id") -> DataFrame:
    """``(name, payload)``: UTC stamp, kind and run id as name, the row as JSON, nulls kept."""
    name = F.concat_ws(
        "_",
        F.date_format(stamp, "yyyyMMdd'T'HHmmss'Z'"),
        slug(F.lit(kind)),
        slug(F.coalesce(F.nullif(F.col(run_id), F.lit("")), F.lit("no-run"))),
    )
    payload = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.concat(name, F.lit(".json")).alias("name"), payload.alias("payload"))


def archive(df: DataFrame, kind: str, path: str, stamp: Column | None = None) -> None:
    """Append rows to the JSON archive, one folder per kind and day, in compressed text files."""
    rows = archive_rows(df, kind, F.current_timestamp() if stamp is None else stamp)
    day = F.substring("name", 1, 8)
    rows.select(
        F.to_json(F.struct("name", "payload")).alias("value"), slug(F.lit(kind)).alias("kind"), day.alias("day")
    ).write.mode("append").option("compression", "gzip").partitionBy("kind", "day").text(path)


def read_archive(spark: SparkSession, path: str, kind: str, schema: StructType, day: str | None = None) -> DataFrame:
    """``(name, document)`` of archived rows of a kind, documents read by ``schema``; other kinds and days are not scanned."""
    lines = spark.read.schema("value string, kind string, day string").text(path).filter(F.col("kind") == slug(F.lit(kind)))
    if day is not None:
        lines = lines.filter(F.col("day") == day)
    entry = F.from_json("value", "struct<name:string,payload:string>")
    return lines.select(entry["name"].alias("name"), F.from_json(entry["payload"], schema).alias("document"))
