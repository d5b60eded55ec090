"""Exploration memory: a long table (scope, kind, value, value_norm, first_seen) plus a counter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow import vocab as V
from leadflow.operators.shared import spread_lookup


KINDS = [V.QUERY_HISTORY, V.VISITED_URLS, V.COMPANY_NAMES, V.LEAD_NAMES]
#: What tells memory entries apart.
KEY = ["scope", "kind", "value"]


def entries(memory: DataFrame, kind: str) -> DataFrame:
    return memory.filter(F.col("kind") == kind)


def visited_urls(memory: DataFrame) -> DataFrame:
    return entries(memory, V.VISITED_URLS).select("scope", F.col("value").alias("url"))


def explored_companies(memory: DataFrame) -> DataFrame:
    return entries(memory, V.COMPANY_NAMES).select("scope", F.col("value_norm").alias("company_key"))


def query_history(memory: DataFrame) -> DataFrame:
    return entries(memory, V.QUERY_HISTORY).select("scope", "value_norm")


def merge_memory(memory: DataFrame, deltas: DataFrame) -> DataFrame:
    """Union by exact value, first occurrence kept.  Repeats are combined before the shuffle."""
    both = memory.unionByName(deltas)
    return both.groupBy("scope", "kind", "value").agg(
        F.min("value_norm").alias("value_norm"), F.min("first_seen").alias("first_seen")
    ).select(*memory.columns)


def reset_memory(memory: DataFrame, fields: list[str], include_lead_names: bool = False) -> DataFrame:
    """Clear the named kinds; lead names only with the flag; unknown names are ignored."""
    cleared = [V.RESET_FIELDS[f] for f in fields if f in V.RESET_FIELDS]
    if include_lead_names:
        cleared.append(V.LEAD_NAMES)
    return memory.filter(~F.col("kind").isin(cleared)) if cleared else memory


def reset_counters(counters: DataFrame, fields: list[str]) -> DataFrame:
    if "consecutiveHardMissRuns" not in fields:
        return counters
    return counters.withColumn(V.MISS_STREAK, F.lit(0).cast("bigint"))


def load_counters(counters: DataFrame, scopes: DataFrame) -> DataFrame:
    """Counter of each scope; 0 for a scope without a stored one."""
    return (
        scopes.select("scope").distinct().join(counters, "scope", "left")
        .withColumn(V.MISS_STREAK, F.coalesce(V.MISS_STREAK, F.lit(0).cast("bigint")))
    )


def load_memory(memory: DataFrame, counters: DataFrame, scopes: DataFrame) -> DataFrame:
    """Read-or-initialise: one row per asked scope with its counter and how many entries of each kind it holds;
    a scope without a memory has none, its counter is 0.  Counts are combined on the map side."""
    mine = memory.groupBy("scope").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
        F.min("first_seen").alias("oldest"),
        F.max("first_seen").alias("newest"),
    )
    loaded = load_counters(counters, scopes).join(mine, "scope", "left")
    return loaded.select(
        "scope", V.MISS_STREAK, *[F.coalesce(f"n_{k}", F.lit(0).cast("bigint")).alias(f"n_{k}") for k in KINDS], "oldest", "newest"
    )


def miss_streak(counters: DataFrame, runs: DataFrame) -> DataFrame:
    """Consecutive runs without result per scope after a batch of finished runs.

    ``runs``: scope, run_order (any orderable column), status.  Two aggregations with map-side
    combine replace the running window, since one scope may hold every run.
    """
    ended = runs.filter(F.col("status") != "running")
    hit = F.col("status") != "no_result"
    last = ended.groupBy("scope").agg(F.max(F.when(hit, F.col("run_order"))).alias("_last_hit"))
    since = spread_lookup(ended, last, ["scope"], ["run_order"], "inner").groupBy("scope").agg(
        F.count_if(F.col("_last_hit").isNull() | (F.col("run_order") > F.col("_last_hit"))).alias("_since"),
        F.max("_last_hit").isNotNull().alias("_reset"),
    )
    joined = counters.join(since, "scope", "full_outer")
    before = F.coalesce(F.col(V.MISS_STREAK), F.lit(0).cast("bigint"))
    return joined.select(
        "scope",
        F.when(F.col("_reset"), F.col("_since")).otherwise(before + F.coalesce("_since", F.lit(0))).alias(V.MISS_STREAK),
    )
