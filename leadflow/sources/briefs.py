"""Brief intake: contract check of raw JSON briefs, with a quarantine for refused rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import vocab as V
from leadflow.functions import text as T

_FIELDS = ["user_text", "request_id", "meta"]


def _kind(body: Column, field: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(body, f"$.{field}", "variant"))


def contract_error(payload: Column) -> Column:
    """Why a raw brief breaks the contract; null when it is sound."""
    body = F.try_parse_json(payload)
    unknown = F.array_sort(F.array_except(F.json_object_keys(payload), T.strings(_FIELDS)))
    text = F.try_variant_get(body, "$.user_text", "string")
    given = F.coalesce(_kind(body, "request_id"), F.lit("VOID"))
    meta = F.coalesce(_kind(body, "meta"), F.lit("OBJECT<>"))
    return (
        F.when(body.isNull() | ~F.startswith(F.schema_of_variant(body), F.lit("OBJECT")), "not a JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.array_join(unknown, ",")))
        .when(F.coalesce(_kind(body, "user_text"), F.lit("")) != "STRING", "user_text must be a string")
        .when(T.strip(text) == "", "user_text must not be empty")
        .when(~given.isin("STRING", "VOID"), "request_id must be a string")
        .when(~F.startswith(meta, F.lit("OBJECT")), "meta must be an object")
    )


def parse_briefs(raw: DataFrame) -> DataFrame:
    """``(brief_id, payload)`` to brief columns plus ``error``."""
    body = F.try_parse_json("payload")
    return raw.select(
        "brief_id",
        "payload",
        F.try_variant_get(body, "$.user_text", "string").alias("user_text"),
        F.try_variant_get(body, "$.request_id", "string").alias("request_id"),
        F.coalesce(F.try_variant_get(body, "$.meta", "string"), F.lit("{}")).alias("meta"),
        contract_error(F.col("payload")).alias("error"),
    )


def validate_briefs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split raw briefs into ``(sound, quarantine)``."""
    parsed = parse_briefs(raw)
    sound = parsed.filter(F.col("error").isNull()).drop("payload", "error")
    return sound, parsed.filter(F.col("error").isNotNull()).select("brief_id", "payload", "error")


def bounds_error(constraints: Column) -> Column:
    """Why extracted constraints are out of range; null when they are within."""
    low, high = V.TARGET_COUNT_RANGE
    small, large = V.COMPANY_SIZE_RANGE
    return (
        F.when(~constraints["target_count"].between(low, high), "target_count out of range")
        .when(~constraints["min_company_size"].between(small, large), "min_company_size out of range")
        .when(~constraints["max_company_size"].between(small, large), "max_company_size out of range")
    )


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split normalised requests into ``(within bounds, quarantine)``; pass a stored table, so that
    the bounds are checked on stored numbers instead of pushing the text patterns into a filter."""
    beyond = F.when(F.col("user_text").rlike(r"(?U)\d{19}"), "number out of range")
    checked = requests.withColumn("error", F.coalesce(bounds_error(F.col("constraints")), beyond))
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())
