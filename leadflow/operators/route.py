"""Routing of decided rows to the lead tables, shortlists, and promotion of shortlist options.

Decided rows carry ``run_id``, ``idx`` (1-based iteration), dossier columns, ``decision`` and
``commercial``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.functions import text as T
from leadflow.operators.normalize import derived_id
from leadflow.operators.shared import handover


def _route(outcome: str) -> Column:
    return (
        (F.col("decision.outcome") == outcome) & F.col("company").isNotNull() & F.col("commercial").isNotNull()
    )


def accepted_leads(decided: DataFrame) -> DataFrame:
    return decided.filter(_route("ACCEPT")).select(
        "run_id",
        "idx",
        derived_id("lead", F.col("run_id"), F.col("idx")).alias("lead_id"),
        T.tidy_person(F.col("person.full_name")).alias("person_name"),
        T.tidy_role(F.col("person.role_title")).alias("role_title"),
        F.col("company.name").alias("company_name"),
        F.col("company.website").alias("website"),
        F.col("company.country_code").alias("country_code"),
        "evidence",
        F.col("decision").alias("qualification"),
        "commercial",
    )


def rejected_candidates(decided: DataFrame) -> DataFrame:
    """Close matches and rejects (an ENRICH left over counts as reject), with their log key."""
    key = F.coalesce(
        F.nullif(F.col("company.name"), F.lit("")), F.nullif(F.col("query_used"), F.lit("")), F.lit("candidate")
    )
    return decided.filter(~F.coalesce(_route("ACCEPT"), F.lit(False))).select(
        "run_id",
        "idx",
        key.alias("candidate_key"),
        F.col("company.name").alias("company_name"),
        "query_used",
        F.col("decision").alias("qualification"),
    )


def shortlist_id(run_id: Column) -> Column:
    return F.concat(F.lit("short_"), F.regexp_replace(run_id, "^run_", ""))


def shortlist_options(decided: DataFrame, size: int = V.SHORTLIST_SIZE) -> DataFrame:
    """Close matches numbered per run in arrival order, at most ``size`` per run.

    A run has no more iterations than its budget, and the rank filter on the window trims before
    the shuffle, so no run can outgrow a task.
    """
    by_run = Window.partitionBy("run_id").orderBy("idx")
    numbered = (
        decided.filter(_route("REJECT_CLOSE_MATCH"))
        .withColumn("option_number", F.row_number().over(by_run))
        .filter(F.col("option_number") <= size)
    )
    return numbered.select(
        shortlist_id(F.col("run_id")).alias("shortlist_id"),
        "run_id",
        "option_number",
        F.col("company.name").alias("company_name"),
        T.tidy_person(F.col("person.full_name")).alias("person_name"),
        F.col("decision.summary").alias("summary"),
        F.col("decision.close_match").alias("close_match"),
        F.col("decision").alias("qualification"),
        "commercial",
    )


def source_traces(decided: DataFrame) -> DataFrame:
    """One dossier per iteration, whatever its outcome."""
    return decided.select("run_id", "idx", *S.DOSSIER_COLUMNS)


def crm_records(accepted: DataFrame) -> DataFrame:
    """CRM export rows: the lead as JSON, null fields kept."""
    lead = F.struct(*[c for c in accepted.columns if c not in ("run_id", "idx")])
    return accepted.select(
        "run_id", "lead_id", F.to_json(lead, {"ignoreNullFields": "false"}).alias("payload_json")
    )


def route(decided: DataFrame, shortlist_size: int = V.SHORTLIST_SIZE) -> dict[str, DataFrame]:
    """All tables decided rows go to.  ``decided`` feeds each of them: pass a stored table."""
    accepted = accepted_leads(decided)
    return {
        "accepted_leads": accepted,
        "crm_records": crm_records(accepted),
        "shortlist_options": shortlist_options(decided, shortlist_size),
        "rejected_candidates": rejected_candidates(decided),
        "source_traces": source_traces(decided),
    }


def memory_deltas(decided: DataFrame) -> DataFrame:
    """What decided rows add to the exploration memory of their ``scope``.

    ``first_seen`` orders entries; here it is the iteration number.
    """
    lead = F.when(_route("ACCEPT"), T.tidy_person(F.col("person.full_name")))
    single = F.array(
        F.struct(F.lit(V.QUERY_HISTORY).alias("kind"), F.nullif(F.col("query_used"), F.lit("")).alias("value")),
        F.struct(F.lit(V.COMPANY_NAMES).alias("kind"), F.col("company.name").alias("value")),
        F.struct(F.lit(V.LEAD_NAMES).alias("kind"), lead.alias("value")),
    )
    urls = F.transform(
        "evidence", lambda e: F.struct(F.lit(V.VISITED_URLS).alias("kind"), e["url"].alias("value"))
    )
    rows = decided.select("scope", F.col("idx").cast("bigint").alias("first_seen"), F.inline(F.concat(single, urls)))
    return rows.filter(F.col("value").isNotNull()).select(
        "scope", "kind", "value", memory_key(F.col("kind"), F.col("value")).alias("value_norm"), "first_seen"
    )


def memory_key(kind: Column, value: Column) -> Column:
    """Form in which memory entries are compared: URLs as they are, names in lower case."""
    return (
        F.when(kind == V.QUERY_HISTORY, T.norm(value))
        .when(kind == V.COMPANY_NAMES, F.lower(value))
        .otherwise(value)
    )


def promote(selections: DataFrame, options: DataFrame, shortlists: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """Turn chosen shortlist options into accepted leads.

    ``selections``: shortlist_id, option_number and, if known, selected_at.  ``shortlists``:
    shortlist_id, run_id, status.  ``options``: see :func:`shortlist_options`.  ``runs``: run_id,
    scope, status, ....  A selection clears its whole shortlist, so only the first valid one of a
    pending shortlist counts (the lowest option among simultaneous ones).
    """
    pending = shortlists.filter(F.col("status") == "pending").select("shortlist_id", "run_id")
    at = F.col("selected_at") if "selected_at" in selections.columns else F.lit(0)
    asked = selections.groupBy("shortlist_id", "option_number").agg(F.min(at).alias("_at"))
    valid = (
        asked.join(pending, "shortlist_id")
        .join(options.drop("run_id"), ["shortlist_id", "option_number"])
        .join(runs.select("run_id", "scope"), "run_id")
    )
    first = valid.groupBy("shortlist_id").agg(
        F.min_by("option_number", F.struct("_at", "option_number")).alias("option_number")
    )
    won = valid.join(first, ["shortlist_id", "option_number"])
    # Stored, as every table that follows reads them.
    leads = handover(won.select(
        "run_id",
        "scope",
        "shortlist_id",
        "option_number",
        derived_id("lead", F.col("shortlist_id"), F.col("option_number")).alias("lead_id"),
        "person_name",
        F.col("qualification.type").alias("role_title"),
        "company_name",
        F.lit(None).cast("string").alias("website"),
        F.lit(None).cast("string").alias("country_code"),
        F.array().cast(f"array<{S.EVIDENCE_ITEM}>").alias("evidence"),
        "qualification",
        "commercial",
    ), "promoted")
    picked = leads.select("shortlist_id", "option_number")
    done = leads.select("shortlist_id", F.lit(True).alias("_cleared"))
    ended = leads.select("run_id", F.lit(True).alias("_done")).distinct()
    learned = F.array(
        F.struct(F.lit(V.COMPANY_NAMES).alias("kind"), F.col("company_name").alias("value")),
        F.struct(F.lit(V.LEAD_NAMES).alias("kind"), F.nullif(F.col("person_name"), F.lit("")).alias("value")),
    )
    deltas = leads.select("scope", F.inline(learned)).filter(F.col("value").isNotNull())
    return {
        "accepted_leads": leads,
        "memory_deltas": deltas.select(
            "scope",
            "kind",
            "value",
            memory_key(F.col("kind"), F.col("value")).alias("value_norm"),
            F.lit(0).cast("bigint").alias("first_seen"),
        ),
        "remaining_options": options.join(picked, ["shortlist_id", "option_number"], "left_anti"),
        "shortlists": shortlists.join(done, "shortlist_id", "left")
        .withColumn("status", F.when(F.col("_cleared"), "cleared").otherwise(F.col("status")))
        .drop("_cleared"),
        "runs": runs.join(ended, "run_id", "left")
        .withColumn("status", F.when(F.col("_done"), "completed").otherwise(F.col("status")))
        .drop("_done"),
        "refused": asked.drop("_at").join(picked, ["shortlist_id", "option_number"], "left_anti"),
    }
