"""Evidence and page text: landed search responses, top results per query, page lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow import vocab as V
from leadflow.functions import text as T
from leadflow.operators.shared import handover, spread_lookup

_RESPONSE = "struct<results:array<struct<url:string,title:string,content:string,raw_content:string>>>"


def explode_search_responses(
    responses: DataFrame, k: int = V.MAX_RESULTS, source_type: str = "tavily_search"
) -> DataFrame:
    """Landed ``(query, body)`` search responses to evidence rows, first ``k`` results each."""
    results = F.slice(F.from_json("body", _RESPONSE)["results"], 1, k)
    rows = responses.select("query", F.posexplode(results).alias("rank", "r"))
    blank = F.lit("")
    return rows.select(
        "query",
        "rank",
        F.coalesce("r.url", blank).alias("url"),
        F.coalesce("r.title", blank).alias("title"),
        F.coalesce(
            F.nullif(F.col("r.content"), blank), F.nullif(F.col("r.raw_content"), blank), blank
        ).alias("snippet"),
        F.lit(source_type).alias("source_type"),
    )


def rank_results(results: DataFrame, order: list[str], k: int) -> DataFrame:
    """Rank unranked results per query (from 0) and keep the first ``k``.

    The rank filter sits directly on the window, so each task keeps ``k`` rows per query before the
    shuffle and a query with any number of results never meets in one task.
    """
    by_query = Window.partitionBy("query").orderBy(*order)
    numbered = results.withColumn("_n", F.row_number().over(by_query)).filter(F.col("_n") <= k)
    return numbered.withColumn("rank", F.col("_n") - 1).drop("_n")


def retrieve(questions: DataFrame, evidence: DataFrame, k: int = V.MAX_RESULTS) -> DataFrame:
    """Evidence rows of the asked ``query`` strings (exact match), first ``k`` each, ranks kept."""
    return questions.join(evidence.filter(F.col("rank") < k), "query", "inner")


def page_texts(html_pages: DataFrame) -> DataFrame:
    """``(url, html)`` to ``(url, text)``."""
    return html_pages.select("url", T.html_to_text(F.col("html")).alias("text"))


def with_page_text(df: DataFrame, pages: DataFrame, spread_by: list[str]) -> DataFrame:
    """Add ``page_text`` by ``url``; '' where there is no page.  ``pages`` has one row per URL.

    Pages are first cut down to the asked URLs; these are stored, so that Spark knows their size and,
    where they are few, filters the rows that a ``pages`` yet to be derived is grouped from.
    """
    asked = handover(df.select("url").distinct(), "urls")
    pages = pages.join(asked, "url", "left_semi")
    found = spread_lookup(df, pages.select("url", F.col("text").alias("page_text")), ["url"], spread_by)
    return found.withColumn("page_text", F.coalesce("page_text", F.lit("")))


def unvisited(evidence: DataFrame, visited: DataFrame) -> DataFrame:
    """Evidence rows whose (scope, url) is not in ``visited``; rows of one popular URL are spread by their other columns."""
    seen = visited.select("scope", "url", F.lit(True).alias("_seen")).distinct()
    found = spread_lookup(evidence, seen, ["scope", "url"], [c for c in evidence.columns if c not in ("scope", "url")])
    return found.where("_seen is null").select(*evidence.columns)


def usable_results(evidence: DataFrame) -> DataFrame:
    return evidence.filter(T.usable_url(F.col("url")))
