"""Extraction from free text: brief constraints, candidate fields, theme signals."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import vocab as V
from leadflow.functions import text as T

#: Every decimal digit but the ASCII ones, and its ASCII digit.
_DIGITS = [c for c in map(chr, range(128, 0x110000)) if unicodedata.category(c) == "Nd"]
_FOREIGN, _ASCII = "".join(_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _DIGITS)

PERSON_TYPE = "struct<full_name:string,role_title:string>"
COMPANY_TYPE = "struct<name:string,website:string,country_code:string,employee_estimate:bigint>"


def number(digits: Column) -> Column:
    """BIGINT of a string of decimal digits of any script; null if it is empty or more than a BIGINT holds."""
    foreign = F.octet_length(digits) > F.length(digits)
    return F.when(foreign, F.translate(digits, _FOREIGN, _ASCII)).otherwise(digits).try_cast("bigint")


def brief_numbers(df: DataFrame, text: str) -> DataFrame:
    """Add ``_count`` (number before "lead(s)", else the first number) and ``_low``/``_high``
    (company size; a range wins over separate bounds).  Each pattern runs once per row."""
    t = F.col(text)
    kept = df.columns
    found = df.select(
        "*",
        F.regexp_extract(t, V.COUNT_PATTERN, 1).alias("_leads"),
        F.regexp_extract(t, V.ANY_NUMBER_PATTERN, 1).alias("_any"),
        F.regexp_extract(t, V.SIZE_RANGE_PATTERN, 1).alias("_from"),
        F.regexp_extract(t, V.SIZE_RANGE_PATTERN, 2).alias("_to"),
        F.regexp_extract(t, V.SIZE_MIN_PATTERN, 1).alias("_over"),
        F.regexp_extract(t, V.SIZE_MAX_PATTERN, 1).alias("_under"),
    )
    ranged = F.col("_from") != ""
    chosen = found.select(
        *kept,
        F.when(F.col("_leads") != "", F.col("_leads")).otherwise(F.col("_any")).alias("_count"),
        F.when(ranged, F.col("_from")).otherwise(F.col("_over")).alias("_low"),
        F.when(ranged, F.col("_to")).otherwise(F.col("_under")).alias("_high"),
    )
    return chosen.select(*kept, *[number(F.col(c)).alias(c) for c in ("_count", "_low", "_high")])


def buyers_mentioned(text: Column) -> Column:
    """Canonical buyer roles in order of first mention."""
    aliases = T.literal_map(V.BUYER_ALIASES)
    hits = F.regexp_extract_all(text, F.lit(V.ROLE_WORD_PATTERN), F.lit(1))
    return F.array_distinct(
        F.array_compact(F.transform(hits, lambda h: F.try_element_at(aliases, F.lower(h))))
    )


def _themes_in(normed: str, aliases: dict[str, str]) -> Column:
    return F.array_distinct(
        F.expr(T.sql_texts(*[(f"contains({normed}, {T.quoted(a)})", t) for a, t in aliases.items()]))
    )


def themes_mentioned(normed: str) -> Column:
    """Themes of a column of normalised brief text, in alias-table order."""
    return _themes_in(normed, {**V.THEME_ALIASES, **V.EXTRA_BRIEF_THEMES})


def theme_hits(normed: str) -> Column:
    """All themes for which a column of normalised evidence text contains an alias."""
    return _themes_in(normed, V.THEME_ALIASES)


def fit_signals(themes: Column, hits: Column) -> Column:
    """Requested themes, in request order, that were hit."""
    return F.array_distinct(F.filter(themes, lambda t: F.array_contains(hits, t)))


def _labelled(text: str, pattern: str) -> str:
    """SQL for the value a label pattern captures, '' without a match.

    A substring test on the upper-case text decides whether the pattern is tried at all: most texts
    lack most labels, and case-insensitive alternations are slow to scan.
    """
    words = " OR ".join(f"contains(_upper, {T.quoted(w)})" for w in V.LABEL_WORDS[pattern])
    return f"CASE WHEN {words} THEN regexp_extract({text}, {T.quoted(pattern)}, 1) ELSE '' END"


def parse_candidates(
    df: DataFrame, text: str, url: str, person: str = "person", company: str = "company"
) -> DataFrame:
    """Add ``person`` and ``company`` structs read from ``text`` (found at ``url``).

    Each label pattern runs at most once per row; later steps only use its captured value.
    """
    t, u = F.col(text), F.col(url)
    kept = df.columns
    # A dotted capital I counts as an i when case is ignored, but has no other upper case.
    upper = df.withColumn("_upper", F.upper(F.translate(t, "İ", "I")))
    labels = upper.select(
        *kept,
        "_upper",
        F.expr(_labelled(text, V.PERSON_LABEL)).alias("_person"),
        F.expr(_labelled(text, V.ROLE_LABEL)).alias("_role"),
        F.expr(_labelled(text, V.COMPANY_LABEL)).alias("_company"),
        F.expr(_labelled(text, V.COUNTRY_LABEL)).alias("_country"),
        F.expr(_labelled(text, V.EMPLOYEES_LABEL)).alias("_employees"),
        T.host(u).alias("_host"),
    )
    values = labels.select(
        *kept,
        "_host",
        F.when(F.col("_person") != "", T.strip(F.col("_person"))).alias("_person"),
        F.when(F.col("_role") != "", T.strip(F.col("_role")))
        .otherwise(F.expr(f"nullif({_labelled(text, V.ROLE_WORD_PATTERN)}, '')"))
        .alias("_role"),
        F.when(F.col("_company") != "", T.company_letters(F.col("_company"))).alias("_labelled"),
        T.domain_letters(u, F.col("_host")).alias("_by_url"),
        T.norm(F.when(F.col("_country") != "", F.col("_country")).otherwise(t)).alias("_place"),
        number(F.col("_employees")).alias("_employees"),
    ).withColumns({"_labelled": T.company_case(F.col("_labelled")), "_by_url": T.company_case(F.col("_by_url"))})
    values = values.withColumn("_name", F.coalesce("_labelled", "_by_url"))
    first_line = F.get(F.split(t, V.LINE_BREAK, 2), F.lit(0))
    final_name = F.when(
        T.is_long_name(F.col("_name")), F.coalesce(F.col("_by_url"), T.title_company(first_line))
    ).otherwise(F.col("_name"))
    named = values.withColumn("_name", final_name)
    has_person = (F.coalesce("_person", F.lit("")) != "") | (F.coalesce("_role", F.lit("")) != "")
    return named.select(
        *kept,
        F.when(
            has_person, F.struct(F.col("_person").alias("full_name"), F.col("_role").alias("role_title"))
        ).alias(person),
        F.when(
            F.col("_name").isNotNull(),
            F.struct(
                F.col("_name").alias("name"),
                T.official_website(t, u, F.col("_host")).alias("website"),
                T.country_of("_place").alias("country_code"),
                F.col("_employees").alias("employee_estimate"),
            ),
        ).alias(company),
    )
