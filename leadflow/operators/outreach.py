"""Outreach text for accepted and close candidates, from fixed templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.functions import text as T

DRAFTED = ["ACCEPT", "REJECT_CLOSE_MATCH"]


def draft(decided: DataFrame) -> DataFrame:
    """Add ``commercial``: null for outcomes that get no outreach.

    An unusable person name drops the whole person, role included.
    """
    topics = "slice(CASE WHEN size(fit_signals) > 0 THEN fit_signals ELSE search_themes END, 1, {})"
    named = decided.select(
        "*",
        T.usable_person(F.col("person.full_name")).alias("_known"),
        F.expr("coalesce(company.name, 'your company')").alias("_company"),
        F.expr(f"array_join({topics.format(2)}, ', ')").alias("_two"),
        F.expr(f"array_join({topics.format(3)}, ', ')").alias("_three"),
    ).select(
        "*",
        F.expr("CASE WHEN _known THEN person.full_name ELSE 'there' END").alias("_name"),
        F.expr("coalesce(CASE WHEN _known THEN nullif(person.role_title, '') END, 'your team')").alias("_role"),
    )
    slots = {"person": "_name", "company": "_company", "role": "_role", "two": "_two", "three": "_three"}

    def text(template: str) -> str:
        return T.sql_fill(template, **slots)

    cited = "array_join(transform(slice(evidence, 1, 3), e -> concat(e.title, ' (', e.url, ')')), '; ')"
    bundle = F.expr(
        f"""CASE WHEN decision.outcome IN ({', '.join(map(T.quoted, DRAFTED))}) THEN named_struct(
          'source_notes', CASE WHEN size(evidence) > 0 THEN {cited} ELSE {T.quoted(V.NO_EVIDENCE_NOTE)} END,
          'hooks', array({', '.join(text(t) for t in V.HOOK_TEMPLATES)}),
          'fit_summary', decision.summary,
          'connection_note_draft', {text(V.CONNECTION_NOTE_TEMPLATE)},
          'dm_draft', {text(V.DM_TEMPLATE)},
          'email_subject', {text(V.SUBJECT_TEMPLATE)},
          'email_body', {text(V.BODY_TEMPLATE)}) END"""
    )
    return named.select(*decided.columns, bundle.cast(S.COMMERCIAL).alias("commercial"))
