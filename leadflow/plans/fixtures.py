"""Lead-shaped inputs derived from the star-schema tables: briefs, evidence, page texts.

Every customer is a brief, every line item a search result, and parts and suppliers give the
companies, places and topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators.shared import spread_rows
from leadflow.sources.evidence import rank_results

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
SINGLE_RESULT_QUERIES = ["%AI agents software", "%startup automation software company", "%cto AI software startup"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BRIEFS_SQL = """
SELECT c_custkey AS brief_id,
  concat('find ', CASE WHEN c_custkey % 97 = 96 THEN 25 ELSE 1 + c_custkey % 5 END, ' leads',
    CASE c_custkey % 6 WHEN 0 THEN ' CTO' WHEN 1 THEN ' founder' WHEN 2 THEN ' head of engineering'
      WHEN 3 THEN ' technical recruiter' WHEN 4 THEN ' CEO or CTO' ELSE '' END,
    CASE c_nationkey % 6 WHEN 0 THEN ' in Spain' WHEN 1 THEN ' in France' WHEN 2 THEN ' in Germany'
      WHEN 3 THEN ' in Portugal' WHEN 4 THEN ' in the UK' ELSE '' END,
    CASE c_custkey % 4
      WHEN 0 THEN concat(' between ', 5 + c_custkey % 20, ' and ', 60 + c_custkey % 90, ' employees')
      WHEN 1 THEN concat(' under ', translate(cast(40 + c_custkey % 100 AS STRING), '0123456789',
        CASE c_custkey % 5 WHEN 1 THEN '٠١٢٣٤٥٦٧٨٩' WHEN 2 THEN '０１２３４５６７８９'
          ELSE '0123456789' END), CASE WHEN c_custkey % 37 = 5 THEN '00000000' ELSE '' END, ' employees')
      WHEN 2 THEN concat(' over ', 10 + c_custkey % 50, ' employees') ELSE '' END,
    CASE c_mktsegment WHEN 'MACHINERY' THEN ' for automation' WHEN 'BUILDING' THEN ' for genai'
      WHEN 'AUTOMOBILE' THEN ' for agentic workflow' WHEN 'FURNITURE' THEN ' with llm and software' ELSE '' END) AS user_text,
  cast(NULL AS STRING) AS request_id,
  '{{}}' AS meta
FROM {customer}"""

KEYS_SQL = """
SELECT *,
  CASE l_orderkey % 3
    WHEN 0 THEN concat('site:eu-startups.com/directory/ ', place, ' ', term, ' software')
    WHEN 1 THEN concat(place, ' startup ', term, ' software company')
    ELSE concat(place, ' cto ', term, ' software startup') END AS query
FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, p_name, p_brand, p_size, p_type,
    CASE s_nationkey % 5 WHEN 0 THEN 'Spain' WHEN 1 THEN 'France' WHEN 2 THEN 'Germany' WHEN 3 THEN 'Portugal'
      ELSE 'United Kingdom' END AS place,
    CASE l_partkey % 6 WHEN 0 THEN 'AI' WHEN 1 THEN 'GenAI' WHEN 2 THEN 'automation' WHEN 3 THEN 'AI agents'
      WHEN 4 THEN 'AI software' ELSE 'software company' END AS term
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey)"""

TEXT_COLUMNS = [
    """
  CASE l_suppkey % 8
    WHEN 0 THEN concat('https://www.eu-startups.com/directory/', replace(p_name, ' ', '-'), '-', l_partkey, '/')
    WHEN 1 THEN concat('https://linkedin.com/company/', replace(p_name, ' ', '_'), l_partkey)
    WHEN 2 THEN concat('https://x.com/', replace(p_name, ' ', ''), '/', l_orderkey)
    WHEN 3 THEN concat('https://WWW.', replace(p_name, ' ', '_'), l_suppkey, '.dev:8443/team')
    ELSE concat('https://www.', replace(p_name, ' ', ''), l_suppkey, '.dev/blog/', l_orderkey) END AS url""",
    """
  concat(p_name, CASE l_linenumber % 3 WHEN 0 THEN ' | team' WHEN 1 THEN ' - top startups' ELSE ' news' END) AS title""",
    """
  concat(
    CASE l_partkey % 4 WHEN 0 THEN concat('Company: ', p_name, ' | ') WHEN 1 THEN concat('Company: ', p_name, '_', p_brand, ' | ')
      WHEN 2 THEN 'Company: a maker of many small and large parts for each and every buyer | ' ELSE '' END,
    CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('Persona: Eva ', l_suppkey, ' | ')
      ELSE concat('Person: Ana ', l_suppkey, ' | ') END,
    CASE l_linenumber % 6 WHEN 0 THEN 'Role: CTO | ' WHEN 1 THEN 'Role: Engineering Manager | ' WHEN 2 THEN 'Role: Director of Sales | '
      WHEN 3 THEN 'led by the founder | ' WHEN 4 THEN '' ELSE 'Role: Talent Lead | ' END,
    CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Country: Unknown | ' ELSE concat('Country: ', place, ' | ') END,
    CASE l_partkey % 5 WHEN 0 THEN '' ELSE concat('Employees: ', translate(cast(p_size * 3 AS STRING), '0123456789',
      CASE l_suppkey % 7 WHEN 1 THEN '٠١٢٣٤٥٦٧٨٩' WHEN 2 THEN '０１２３４５６７８９' ELSE '0123456789' END),
      CASE WHEN l_suppkey % 41 = 3 THEN '000000000' ELSE '' END, ' | ') END,
    CASE l_suppkey % 4 WHEN 0 THEN 'see https://site.example.com/a). GenAI automation' WHEN 1 THEN 'agentic workflow'
      WHEN 2 THEN 'machine learning engineering' ELSE 'parts' END) AS snippet""",
    "'fixture' AS source_type",
]

PAGE_TEXT_SQL = """concat(p_type, ' page | Employees: ', p_size * 3, ' | Country: ', place, ' | Role: ',
  CASE WHEN p_size > 25 THEN 'CTO' ELSE 'Founder' END, ' | AI engineering automation https://', replace(p_name, ' ', ''),
  '.example.org/about.')"""


def _run(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One brief per customer; dealt out, as reading briefs is work on text."""
    return spread_rows(_run(spark, sf_dir, BRIEFS_SQL, "customer"), "brief_id")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item with its query, before any text is built."""
    return _run(spark, sf_dir, KEYS_SQL, "lineitem", "part", "supplier")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unranked search result per line item, with its order columns and line attributes; dealt
    out before its texts are built."""
    kept = ["l_returnflag", "l_linestatus", "p_name", "p_type", "p_size", "place", "query"]
    return spread_rows(_keys(spark, sf_dir), *ORDER).selectExpr(*ORDER, *kept, *TEXT_COLUMNS)


def _single() -> Column:
    return F.expr(" OR ".join(f"query LIKE '{p}'" for p in SINGLE_RESULT_QUERIES))


def evidence(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Ranked evidence, first ``k`` per query; some queries have a single result."""
    ranked = rank_results(_keys(spark, sf_dir).select(*ORDER, "query", "place"), ORDER, k)  # narrow rows are ranked
    shown = ranked.filter((F.col("rank") == 0) | ~_single())
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_size")
    return shown.join(parts, "l_partkey").selectExpr("query", "rank", *TEXT_COLUMNS)


def all_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence row, without ranks: the first row of single-result queries is found by a
    minimum with map-side combine instead of ranking whole queries."""
    rows = results(spark, sf_dir)
    rest = [c for c in rows.columns if c not in ORDER and c != "query"]
    first = (
        rows.filter(_single())
        .groupBy("query")
        .agg(F.min(F.struct(*ORDER, *rest)).alias("r"))
        .select("query", "r.*")
        .select(*rows.columns)
    )
    return rows.filter(~_single()).unionByName(first)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page text per evidence URL of open line items; the least text where lines share a URL."""
    rows = results(spark, sf_dir).filter("l_linestatus = 'O'")
    return rows.groupBy("url").agg(F.min(F.expr(PAGE_TEXT_SQL)).alias("text"))
