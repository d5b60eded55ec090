"""Search queries of a request: expansion by relaxation stage, history check, first unused one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import vocab as V
from leadflow.functions import text as T
from leadflow.operators.shared import spread_lookup

def relaxation_stage(attempts_used: Column) -> Column:
    return F.when(attempts_used >= 4, 2).when(attempts_used >= 2, 1).otherwise(0)


def _sql_lists(table: dict[str, list[str]]) -> str:
    return f"map({', '.join(f'{T.quoted(k)}, {T.sql_array(v)}' for k, v in table.items())})"


def query_pairs(df: DataFrame, stage: Column, alias: str = "candidates", suggested: Column | None = None) -> DataFrame:
    """Add the ordered candidate queries of each request at a relaxation stage.

    ``suggested`` are externally proposed queries, which go first after clean-up.
    """
    kept = df.columns
    places = f"coalesce(try_element_at({_sql_lists(V.COUNTRY_TERMS)}, coalesce(constraints.preferred_country, 'es')), {T.sql_array(V.UNLISTED_COUNTRY_TERMS)})"
    hint = (
        "CASE WHEN constraints.max_company_size IS NOT NULL "
        "THEN concat('under ', constraints.max_company_size, ' employees') "
        "WHEN constraints.min_company_size IS NOT NULL "
        "THEN concat('over ', constraints.min_company_size, ' employees') END"
    )
    software = "CASE WHEN _stage >= 1 AND NOT array_contains(search_themes, 'software company') THEN array('software company') ELSE array() END"
    automation = "CASE WHEN _stage >= 2 AND NOT array_contains(search_themes, 'automation') THEN array('automation') ELSE array() END"
    relaxed = f"slice(concat(search_themes, {software}, {automation}), 1, 3)"
    terms = f"flatten(transform({relaxed}, t -> coalesce(try_element_at({_sql_lists(V.THEME_TERMS)}, t), array(t))))"
    sized = df.withColumn("_stage", stage).select(
        "*",
        F.expr(f"{places}[0]").alias("_country"),
        F.expr(f"slice(filter({places}, p -> p IN ({', '.join(map(T.quoted, V.CITIES))})), 1, 2)").alias("_cities"),
        F.expr(hint).alias("_hint"),
        F.expr("transform(slice(buyer_targets, 1, 2), b -> translate(b, '_', ' '))").alias("_buyers"),
        F.slice(T.dedupe_norm(F.expr(terms)), 1, 3).alias("_terms"),
    )
    slots = {"country": "_country", "term": "t", "hint": "_hint", "city": "y", "buyer": "b"}

    def filled(templates: list[str]) -> str:
        return f"array({', '.join(T.sql_fill(t, **slots) for t in templates)})"

    none = "cast(array() AS array<string>)"
    lists = [
        f"flatten(transform(_terms, t -> array_compact({filled([*V.TERM_TEMPLATES, V.SIZED_TERM_TEMPLATE])})))",
        f"flatten(transform(_cities, y -> {filled(V.CITY_TEMPLATES)}))",
        f"flatten(transform(_buyers, b -> transform(slice(_terms, 1, 2), t -> {T.sql_fill(V.BUYER_TEMPLATE, **slots)})))",
        *[f"CASE WHEN _stage >= {n} THEN {filled(ts)} ELSE {none} END" for n, ts in V.STAGE_TEMPLATES.items()],
    ]
    own = F.expr(f"concat({', '.join(lists)})")
    if suggested is not None:
        own = F.concat(T.tidy_queries(F.coalesce(suggested, T.strings([]))), own)
    raw = sized.select(*kept, own.alias("_raw")).select(*kept, T.norm_pairs(F.col("_raw")).alias("_pairs"))
    return raw.select(*kept, T.first_of_each(F.col("_pairs")).alias(alias))


def expand_queries(requests: DataFrame, stage: Column) -> DataFrame:
    """One row per candidate query: request columns plus ``pos`` (from 0) and ``query``."""
    listed = query_pairs(requests, stage)
    return listed.select(*requests.columns, F.posexplode("candidates").alias("pos", "_pair")).select(
        *requests.columns, "pos", F.col("_pair.v").alias("query")
    )


def first_unused(pairs: Column, used: Column) -> Column:
    """First candidate whose normal form is not in ``used``; null when none is left."""
    left = F.filter(pairs, lambda p: ~F.array_contains(used, p["n"]))
    return F.get(left, F.lit(0))["v"]


def with_known_queries(df: DataFrame, history: DataFrame, pairs: list[str], key: list[str]) -> DataFrame:
    """Add ``known``: the normal forms among the candidate lists that the scope's history holds.

    ``history``: scope, value_norm.  Candidate lists are short, so ``known`` is too.
    """
    asked = F.array_distinct(F.concat(*[F.transform(p, lambda x: x["n"]) for p in pairs]))
    rows = df.select(*key, "scope", F.explode(asked).alias("value_norm"))
    past = history.select("scope", "value_norm").distinct()
    hits = spread_lookup(rows, past, ["scope", "value_norm"], key, "inner")
    known = hits.groupBy(*key).agg(F.array_sort(F.collect_set("value_norm")).alias("known"))
    return df.join(known, key, "left").withColumn("known", F.coalesce("known", T.strings([])))


def choose_queries(df: DataFrame, history: DataFrame, key: list[str], used: Column | None = None) -> DataFrame:
    """Add ``query``: the first candidate neither in the scope's history nor in ``used``."""
    listed = with_known_queries(df, history, ["candidates"], key)
    taken = F.col("known") if used is None else F.concat("known", used)
    return listed.withColumn("query", first_unused(F.col("candidates"), taken)).drop("known")
