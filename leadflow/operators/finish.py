"""Planning and ending of runs as plain expressions over their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.operators.expand import relaxation_stage


def run_counts(decided: DataFrame) -> DataFrame:
    """Per run: iterations made, accepted leads, close matches."""
    outcome = F.col("decision.outcome")
    return decided.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("iterations"),
        F.count_if(outcome == "ACCEPT").alias("accepted"),
        F.count_if(outcome == "REJECT_CLOSE_MATCH").alias("close_matches"),
    )


def plan(state: DataFrame) -> DataFrame:
    """Add ``action``, ``relaxation_stage`` and ``reason`` to run counters."""
    done = F.col("accepted") >= F.col("target_count")
    spent = F.col("source_attempts_used") >= F.col("source_attempt_budget")
    listed = F.col("shortlisted") > 0
    action = (
        F.when(done, "FINISH_ACCEPTED").when(spent & listed, "FINISH_SHORTLIST").when(spent, "FINISH_NO_RESULT")
        .otherwise("SOURCE")
    )
    return state.withColumns(
        {
            "action": action,
            "relaxation_stage": relaxation_stage(F.col("source_attempts_used")),
            "reason": F.coalesce(completed_reason(done, spent, listed), F.lit("continue_sourcing")),
        }
    )


def completed_reason(done: Column, spent: Column, listed: Column) -> Column:
    return (
        F.when(done, "target_count_reached")
        .when(spent & listed, "budget_exhausted_with_shortlist")
        .when(spent, "budget_exhausted_without_results")
    )


def status_after_finish(accepted: Column, errors: Column, listed: Column) -> Column:
    return (
        F.when(errors, "completed_with_errors").when(accepted | listed, "completed").otherwise("no_result")
    )


def finish(state: DataFrame) -> DataFrame:
    """Add ``status`` and ``completed_reason``; unfinished runs stay ``running``."""
    done = F.col("accepted") >= F.col("target_count")
    spent = F.col("source_attempts_used") >= F.col("source_attempt_budget")
    listed = F.col("shortlisted") > 0
    status = status_after_finish(F.col("accepted") > 0, F.lit(False), listed)
    return state.withColumns(
        {
            "status": F.when(done | spent, status).otherwise("running"),
            "completed_reason": completed_reason(done, spent, listed),
        }
    )
