"""Run documents: lists nested once per form against lists gathered row by row, and how they are archived."""

from pathlib import Path

from pyspark.sql import functions as F

from leadflow.operators import finish as Z
from leadflow.operators.shared import handover
from leadflow.plans import queries as P
from leadflow.sources import tables as TB


def test_documents_of_forms_are_those_of_rows(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "DOCUMENTS", 3)  # forms are dealt to several tasks
    asked = P.requests(spark, small)
    asked = handover(asked.unionByName(asked.where("brief_id % 9 = 4")), "asked")  # some runs are asked for twice
    drafted = P.form_drafts(spark, small, asked)
    runs = Z.finish(P.counted_runs(asked, drafted)).select(
        "run_id", "brief_id", "status", "completed_reason", F.struct("source_attempt_budget", "source_attempts_used").alias("budget")
    )
    want = P.nested_documents(runs, P.addressed(drafted, asked))
    documents = handover(P.run_documents(asked, drafted).select(want.columns), "documents")
    text = lambda rows: sorted(r[0] for r in rows.select(F.to_json(F.struct(*want.columns))).collect())
    got = text(documents)
    assert got == text(want) and any('"lead_id":"lead_' in d for d in got) and any('"shortlist_id":"short_' in d for d in got)
    TB.archive(documents, "kind", str(tmp_path / "a"), F.lit("2030-01-02 03:04:05").cast("timestamp_ntz"))
    files = [p for p in Path(tmp_path / "a").rglob("part-*")]
    assert files and sum(p.stat().st_size for p in files) < sum(map(len, got)) / 3
    assert text(TB.read_archive(spark, str(tmp_path / "a"), "kind", documents.schema).select("document.*")) == got
