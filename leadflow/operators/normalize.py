"""Briefs to search requests, and repair of requests that were normalised elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import vocab as V
from leadflow.functions import extract as E
from leadflow.functions import text as T
from leadflow.sources.briefs import bounds_error


def derived_id(prefix: str, *key: Column) -> Column:
    """Reproducible id: prefix and 128 bits of the key's hash, in hex."""
    text = F.concat_ws("\u001f", *[k.cast("string") for k in key])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(text, 256), 1, 32))


def constraints_of(count: Column, place: Column, low: Column, high: Column) -> Column:
    """Constraint struct from the numbers and the country code found in a brief."""
    sized = low.isNotNull() | high.isNotNull()
    hard = F.array_compact(
        F.array(F.when(place.isNotNull(), F.lit(V.MISS_COUNTRY)), F.when(sized, F.lit(V.MISS_SIZE)))
    )
    return F.struct(
        F.coalesce(F.nullif(count, F.lit(0)), F.lit(3)).alias("target_count"),
        place.alias("preferred_country"),
        F.when(place == "es", T.strings(["eu"])).otherwise(T.strings([])).alias("preferred_regions"),
        low.alias("min_company_size"),
        high.alias("max_company_size"),
        F.lit(True).alias("prefer_named_person"),
        hard.alias("hard_constraints"),
        T.strings(["named_person"]).alias("relaxable_constraints"),
    )


def _or_default(values: Column, default: Column) -> Column:
    return F.when(F.size(values) > 0, values).otherwise(default)


def normalize_briefs(briefs: DataFrame) -> DataFrame:
    """One request per brief: constraints, buyer targets and search themes."""
    text = F.col("user_text")
    normed = briefs.withColumn("_norm", T.norm(text)).withColumn("_place", T.country_of("_norm"))
    read = E.brief_numbers(normed, "user_text").select(
        "*",
        E.buyers_mentioned(text).alias("_buyers"),
        E.themes_mentioned("_norm").alias("_themes"),
    )
    fallback_id = derived_id("req", F.col("brief_id"))
    return read.select(
        "brief_id",
        F.coalesce(F.nullif(F.col("request_id"), F.lit("")), fallback_id).alias("request_id"),
        T.strip(text).alias("user_text"),
        constraints_of(F.col("_count"), F.col("_place"), F.col("_low"), F.col("_high")).alias("constraints"),
        _or_default(F.col("_buyers"), T.strings(V.DEFAULT_BUYERS)).alias("buyer_targets"),
        _or_default(F.col("_themes"), T.strings(V.DEFAULT_THEMES)).alias("search_themes"),
        "meta",
    )


def _completed(values: Column, entry: str, wanted: Column) -> Column:
    missing = wanted & ~F.array_contains(values, entry)
    return F.when(missing, F.array_append(values, F.lit(entry))).otherwise(values)


def repair_requests(requests: DataFrame, external: DataFrame, given_ids: DataFrame | None = None) -> DataFrame:
    """Merge externally normalised requests over the rule baseline.

    ``external``: brief_id, request_id, constraints, buyer_targets, search_themes.  Rows whose
    constraints are out of bounds count as absent.  ``given_ids`` (brief_id, request_id) are ids the
    caller set; they win over external ones.
    """
    country = F.col("constraints.preferred_country")
    valid = bounds_error(F.col("constraints")).isNull() & (country.isNull() | (F.length(country) == 2))
    ext = external.filter(valid).select(
        "brief_id",
        F.lit(True).alias("_has"),
        *[F.col(c).alias(f"x_{c}") for c in ("request_id", "constraints", "buyer_targets", "search_themes")],
    )
    joined = requests.join(ext, "brief_id", "left")
    if given_ids is not None:
        given = given_ids.select("brief_id", F.nullif(F.col("request_id"), F.lit("")).alias("_given"))
        joined = joined.join(given, "brief_id", "left")
    else:
        joined = joined.withColumn("_given", F.lit(None).cast("string"))

    def base(f: str) -> Column:
        return F.col(f"constraints.{f}")

    def outer(f: str) -> Column:
        return F.col(f"x_constraints.{f}")

    def listed(f: str) -> Column:
        return T.dedupe_norm(_or_default(F.coalesce(outer(f), T.strings([])), base(f)))

    lists = joined.withColumn("_norm", T.norm(outer("preferred_country"))).select(
        "*",
        F.coalesce(T.country_of("_norm"), base("preferred_country")).alias("_country"),
        F.coalesce(F.nullif(outer("min_company_size"), F.lit(0)), base("min_company_size")).alias("_min"),
        F.coalesce(F.nullif(outer("max_company_size"), F.lit(0)), base("max_company_size")).alias("_max"),
        listed("preferred_regions").alias("_regions"),
        listed("hard_constraints").alias("_hard"),
        listed("relaxable_constraints").alias("_relaxable"),
        T.canonical_buyers(F.coalesce("x_buyer_targets", T.strings([]))).alias("_buyers"),
        T.canonical_themes(F.coalesce("x_search_themes", T.strings([]))).alias("_themes"),
    )
    sized = F.col("_min").isNotNull() | F.col("_max").isNotNull()
    hard = _completed(F.col("_hard"), V.MISS_COUNTRY, F.col("_country").isNotNull())
    repaired = F.struct(
        F.coalesce(outer("target_count"), F.lit(3)).alias("target_count"),
        F.col("_country").alias("preferred_country"),
        F.col("_regions").alias("preferred_regions"),
        F.col("_min").alias("min_company_size"),
        F.col("_max").alias("max_company_size"),
        F.coalesce(outer("prefer_named_person"), F.lit(True)).alias("prefer_named_person"),
        _completed(hard, V.MISS_SIZE, sized).alias("hard_constraints"),
        _completed(F.col("_relaxable"), "named_person", F.lit(True)).alias("relaxable_constraints"),
    )
    has = F.col("_has").isNotNull()
    named = F.when(~T.norm(F.col("x_request_id")).isin("", "null", "none"), F.col("x_request_id"))
    return lists.select(
        "brief_id",
        F.when(has, F.coalesce("_given", named, "request_id")).otherwise(F.col("request_id")).alias("request_id"),
        "user_text",
        F.when(has, repaired).otherwise(F.col("constraints")).alias("constraints"),
        F.when(has, _or_default(F.col("_buyers"), F.col("buyer_targets")))
        .otherwise(F.col("buyer_targets"))
        .alias("buyer_targets"),
        F.when(has, _or_default(F.col("_themes"), F.col("search_themes")))
        .otherwise(F.col("search_themes"))
        .alias("search_themes"),
        "meta",
    )
