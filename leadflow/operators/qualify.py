"""Rule qualification of dossiers, external reviews, and grounding of external dossiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.functions import extract as E
from leadflow.functions import text as T
from leadflow.operators.shared import handover, spread_lookup
from leadflow.sources.evidence import with_page_text


# Qualification checks, in SQL over the work row; k_* columns are never null.
_SIZED = "(constraints.min_company_size IS NOT NULL OR constraints.max_company_size IS NOT NULL)"
_OUTSIDE = (
    "(coalesce(company.employee_estimate < constraints.min_company_size, false) "
    "OR coalesce(company.employee_estimate > constraints.max_company_size, false))"
)
_COUNTRY = "nullif(company.country_code, '')"
_ADJACENT = "|".join(V.ADJACENT_ROLE_WORDS)
CHECKS = {
    "k_found": "sourcing_status = 'FOUND' AND company IS NOT NULL",
    "k_exact": "coalesce(exists(buyer_targets, b -> contains(_role, translate(b, '_', ' '))), false)",
    "k_near": f"coalesce(rlike(_role, '{_ADJACENT}'), false)",
    "k_country": f"coalesce({_COUNTRY} = constraints.preferred_country, false)",
    "k_country_miss": f"coalesce({_COUNTRY} <> constraints.preferred_country, false)",
    "k_country_unknown": f"constraints.preferred_country IS NOT NULL AND {_COUNTRY} IS NULL",
    "k_size": f"{_SIZED} AND company.employee_estimate IS NOT NULL AND NOT {_OUTSIDE}",
    "k_size_miss": f"{_SIZED} AND company.employee_estimate IS NOT NULL AND {_OUTSIDE}",
    "k_size_unknown": f"{_SIZED} AND company.employee_estimate IS NULL",
    "k_named": "coalesce(person.full_name, '') <> ''",
    "k_signals": "size(fit_signals)",
    "k_evidence": "size(evidence)",
}
POINTS = """least(100, CASE WHEN k_exact THEN 30 WHEN k_near THEN 15 ELSE 0 END + CASE WHEN k_country THEN 20 ELSE 0 END
  + CASE WHEN k_size THEN 20 ELSE 0 END + least(k_signals * 10, 20) + CASE WHEN k_named THEN 5 ELSE 0 END
  + CASE WHEN k_evidence >= 2 THEN 15 WHEN k_evidence = 1 THEN 5 ELSE 0 END)"""
# The decision table: the first rule that holds decides.
RULES = [
    ("NOT k_found", "none"),
    ("size(k_hard) > 0", "hard_miss"),
    ("k_evidence < 2 AND k_score >= 35", "enrich"),
    ("size(k_unknown) > 0 AND k_score >= 55", "unknown_close"),
    ("size(k_unknown) > 0", "unknown_reject"),
    ("k_score >= 70 AND k_exact", "accept"),
    ("k_score >= 55", "close"),
    ("true", "weak"),
]


def _case(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"


def qualify(df: DataFrame) -> DataFrame:
    """Add ``decision``: score, outcome by the ordered decision table, and its explanation."""
    q, R = T.quoted, V.REASONS
    reasons = T.sql_texts(
        ("k_exact", R["role_exact"]),
        ("NOT k_exact AND k_near", R["role_adjacent"]),
        ("NOT k_exact AND NOT k_near", R["role_none"]),
        ("k_country", R["country_match"]),
        ("k_country_unknown", R["country_unknown"]),
        ("k_size_unknown", R["size_unknown"]),
        ("k_size", R["size_match"]),
        ("k_signals > 0", R["signals"]),
        ("k_named", R["named"]),
        ("k_evidence >= 2", R["many_urls"]),
        ("k_evidence = 1", R["one_url"]),
    )
    role = F.col("person.role_title")
    checked = df.withColumn("_role", F.when(role.isNotNull(), T.norm(role))).selectExpr(
        "*", *[f"{check} AS {name}" for name, check in CHECKS.items()]
    )
    explained = checked.selectExpr(
        "*",
        f"{POINTS} AS k_score",
        f"{reasons} AS k_reasons",
        f"{T.sql_texts(('k_country_miss', V.MISS_COUNTRY), ('k_size_miss', V.MISS_SIZE))} AS k_hard",
        f"{T.sql_texts(('k_country_unknown', V.MISS_COUNTRY), ('k_size_unknown', V.MISS_SIZE))} AS k_unknown",
        f"{T.sql_texts(('NOT k_exact', V.MISS_PERSONA))} AS k_close",
    )
    ruled = explained.selectExpr("*", f"{_case([(c, q(v)) for c, v in RULES])} AS k_rule")
    close = "k_rule IN ('close', 'unknown_close')"

    def listed(prefix: str, values: str) -> str:
        return f"concat(k_reasons, transform({values}, v -> concat({q(prefix)}, v)))"

    all_reasons = _case(
        [
            ("k_rule = 'none'", f"array({q(V.NO_DOSSIER_REASON)})"),
            ("k_rule = 'hard_miss'", listed("hard miss: ", "k_hard")),
            ("k_rule = 'enrich'", listed("missing evidence: ", "k_unknown")),
            ("k_rule = 'unknown_reject'", listed("missing hard proof: ", "k_unknown")),
            ("true", "k_reasons"),
        ]
    )
    summaries = {"none": V.NO_DOSSIER_SUMMARY, **V.SUMMARIES}
    missed = "concat(k_close, k_unknown)"
    decision = f"""named_struct(
      'outcome', CASE WHEN k_rule = 'enrich' THEN 'ENRICH' WHEN k_rule = 'accept' THEN 'ACCEPT'
        WHEN {close} THEN 'REJECT_CLOSE_MATCH' ELSE 'REJECT' END,
      'match_type', CASE WHEN k_rule = 'accept' THEN 'exact' WHEN {close} THEN 'close_match' END,
      'score', CASE WHEN k_rule = 'none' THEN 0 ELSE k_score END,
      'summary', {_case([(f"k_rule = {q(r)}", q(t)) for r, t in summaries.items()])},
      'reasons', {all_reasons},
      'type', CASE WHEN k_rule <> 'none' THEN coalesce(nullif(person.role_title, ''), 'unknown') END,
      'region', CASE WHEN k_rule <> 'none' THEN coalesce({_COUNTRY}, constraints.preferred_country, 'unknown') END,
      'close_match', CASE WHEN {close} THEN named_struct('summary', {q(V.CLOSE_MATCH_SUMMARY)},
        'missed_filters', CASE WHEN size({missed}) > 0 THEN {missed} ELSE array({q(V.NO_MISS_NAMED)}) END,
        'reasons', k_reasons) END)"""
    kept = [c for c in df.columns if c != "decision"]
    return ruled.select(*kept, F.expr(decision).cast(S.DECISION).alias("decision"))


def merge_reviews(decided: DataFrame, reviews: DataFrame, key: list[str]) -> DataFrame:
    """Merge external reviews (outcome, summary, type, region, close_summary; one per key)."""
    reviewed = merged_review(decided.join(review_columns(reviews, key), key, "left"))
    return reviewed.select(*decided.columns)


def review_columns(reviews: DataFrame, key: list[str]) -> DataFrame:
    """Reviews under the column names that :func:`merged_review` reads."""
    fields = ["outcome", "summary", "type", "region", "close_summary"]
    return reviews.select(*key, *[F.col(f).alias(f"r_{f}") for f in fields])


def merged_review(df: DataFrame) -> DataFrame:
    """``decision`` with the review beside it, row by row (no review: ``r_outcome`` is null).

    The rule outcome always stands; an agreeing review may reword it, a disagreeing one is noted.
    """
    d = F.col("decision")
    same = F.col("r_outcome") == d["outcome"]
    other = F.col("r_outcome").isNotNull() & ~same
    note = F.concat(F.lit("llm_review_disagreed="), F.col("r_outcome"))

    def given(field: str) -> Column:
        return F.nullif(F.col(f"r_{field}"), F.lit(""))

    def filled(field: str) -> Column:
        return F.when(same, F.coalesce(F.nullif(d[field], F.lit("")), F.col(f"r_{field}"))).otherwise(d[field])

    close = F.when(
        d["close_match"].isNotNull(),
        F.struct(
            F.when(same, F.coalesce(given("close_summary"), d["close_match"]["summary"]))
            .otherwise(d["close_match"]["summary"])
            .alias("summary"),
            d["close_match"]["missed_filters"].alias("missed_filters"),
            d["close_match"]["reasons"].alias("reasons"),
        ),
    )
    merged = F.struct(
        d["outcome"].alias("outcome"),
        d["match_type"].alias("match_type"),
        d["score"].alias("score"),
        F.when(same, F.coalesce(given("summary"), d["summary"])).otherwise(d["summary"]).alias("summary"),
        F.when(other, T.dedupe_norm(F.array_append(d["reasons"], note))).otherwise(d["reasons"]).alias("reasons"),
        filled("type").alias("type"),
        filled("region").alias("region"),
        close.alias("close_match"),
    )
    return df.withColumn("decision", merged.cast(S.DECISION))


def ground(work: DataFrame, claims: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """Check externally produced dossiers against the evidence of their work row.

    ``work``: key columns, request columns, ``query``, ``items`` (evidence offered) and the rule
    dossier as ``person``, ``company``, ``fit_signals``, ``evidence``; stored, as it is read twice.
    ``claims``: key columns, ``claim`` struct (person, company, fit_signals, urls), one per key.
    Returns grounded dossier columns for the claims that hold; refused claims are left out, so the
    rule dossier stands for them.
    """
    claimed = work.join(claims, key, "inner")
    offered = F.transform(
        "items", lambda i: F.struct(*[i[f].alias(f) for f in ("url", "title", "snippet", "source_type")])
    )
    c = F.col("claim")
    # A URL offered twice stands for its last offer.
    matched = F.array_compact(
        F.transform(
            F.coalesce(c["urls"], T.strings([])),
            lambda u: F.try_element_at(F.filter("_offered", lambda i: i["url"] == u), F.lit(-1)),
        )
    )
    support = (
        claimed.filter(c["company"].isNotNull())
        .withColumn("_offered", offered)
        .withColumn("_matched", matched)
        .withColumn(
            "_support",
            F.when(F.size("_matched") > 0, F.col("_matched"))
            .when(F.size("evidence") > 0, F.col("evidence"))
            .otherwise(F.slice("_offered", 1, 1)),
        )
    )
    support = handover(support, "claims")
    rows = support.select(*key, F.posexplode("_support").alias("_pos", "_e")).select(*key, "_pos", "_e.*")
    paged = with_page_text(rows, pages, key + ["_pos"]).withColumn(
        "_text", F.concat_ws(" ", "title", "snippet", "page_text")
    )
    parsed = E.parse_candidates(paged, "_text", "url", "_p", "_c")
    per_claim = parsed.groupBy(*key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_text"))), lambda s: s["_text"]), " "
        ).alias("_all_text"),
        F.min_by(
            F.col("_c.employee_estimate"), F.when(F.col("_c.employee_estimate").isNotNull(), F.col("_pos"))
        ).alias("_employees"),
    )
    df = support.join(per_claim, key, "left").withColumn("_all_text", F.coalesce("_all_text", F.lit("")))

    base = F.col("company")
    raw_name = c["company"]["name"]
    df = df.withColumn("_letters", T.company_letters(raw_name)).withColumn("_cleaned", T.company_case(F.col("_letters")))
    cleaned = F.col("_cleaned")
    sound = cleaned.isNotNull() & (T.words(cleaned) <= 8) & ~raw_name.rlike(r"[{}]")
    first_url = F.coalesce(F.get("_support", F.lit(0))["url"], F.lit(""))
    offered_text = F.expr("array_join(transform(items, i -> concat(i.title, ' ', i.snippet)), ' ')")
    df = df.withColumns({"_all_norm": T.norm(F.col("_all_text")), "_offered_norm": T.norm(offered_text)})
    named = df.select(
        "*",
        F.when(sound, cleaned).otherwise(base["name"]).alias("_name"),
        T.host(first_url).alias("_host"),
        T.country_of("_all_norm").alias("_supported_country"),
    )
    hidden = reduce(lambda a, b: a | b, [F.endswith(F.col("_host"), F.lit(h)) for h in V.NO_WEBSITE_HOST_SUFFIXES])
    full_name = F.coalesce(c["person"]["full_name"], F.lit(""))
    invented = (full_name != "") & ~F.contains(F.col("_all_text"), full_name)
    person = F.coalesce(F.when(~invented, c["person"]), F.col("person"))
    themes = F.col("search_themes")
    claimed_signals = F.filter(
        T.dedupe_norm(F.coalesce(c["fit_signals"], T.strings([]))), lambda s: F.array_contains(themes, s)
    )
    signals = (
        F.when(F.size(claimed_signals) > 0, claimed_signals)
        .when(F.size("fit_signals") > 0, F.col("fit_signals"))
        .otherwise(E.fit_signals(themes, E.theme_hits("_offered_norm")))
    )
    country = F.coalesce(
        F.col("_supported_country"),
        F.when(base.isNotNull(), base["country_code"]).otherwise(c["company"]["country_code"]),
    )
    website = F.coalesce(T.official_website(F.col("_all_text"), first_url, F.col("_host")), base["website"])
    company = F.struct(
        F.col("_name").alias("name"),
        F.when(~hidden, website).alias("website"),
        country.alias("country_code"),
        F.coalesce("_employees", base["employee_estimate"]).alias("employee_estimate"),
    )
    # Stored, so that the filter reads the cleaned name instead of repeating its patterns.
    named = handover(named.withColumn("_usable", T.usable_company(F.col("_name"))), "claims")
    return (
        named.filter("_usable")
        .withColumn("_person", person)
        .select(
            *key,
            F.lit("FOUND").alias("sourcing_status"),
            F.col("query").alias("query_used"),
            F.when(T.usable_person(F.col("_person.full_name")), F.col("_person")).cast(S.PERSON).alias("person"),
            company.cast(S.COMPANY).alias("company"),
            signals.alias("fit_signals"),
            F.col("_support").cast(f"array<{S.EVIDENCE_ITEM}>").alias("evidence"),
            F.array(F.concat(F.lit("query_used="), F.col("query")), F.lit(V.NOTE_EXTERNAL)).alias("notes"),
        )
    )


def prefer_grounded(dossiers: DataFrame, grounded: DataFrame, explored: DataFrame, key: list[str]) -> DataFrame:
    """Replace rule dossiers by grounded external ones, except for companies explored before.

    The rule dossiers that stay are taken as they are: check them with ``drop_explored`` first.
    """
    names = explored.select("scope", "company_key", F.lit(True).alias("_known")).distinct()
    scoped = grounded.join(dossiers.select(*key, "scope"), key).withColumn("company_key", F.lower("company.name"))
    fresh = spread_lookup(scoped, names, ["scope", "company_key"], key).where("_known is null")
    new = fresh.select(*key, *[F.col(c).alias(f"g_{c}") for c in S.DOSSIER_COLUMNS])
    joined = dossiers.join(new, key, "left")
    held = F.col("g_sourcing_status").isNotNull()
    return joined.select(
        *[
            F.when(held, F.col(f"g_{c}")).otherwise(F.col(c)).alias(c) if c in S.DOSSIER_COLUMNS else F.col(c)
            for c in dossiers.columns
        ]
    )
