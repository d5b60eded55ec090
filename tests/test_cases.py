"""Known cases: the common brief and its accepted and close candidates."""

import pytest
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.operators import dossier as D
from leadflow.operators import expand as Q
from leadflow.operators import finish as Z
from leadflow.operators import outreach as O
from leadflow.operators import qualify as K
from leadflow.operators import route as R
from leadflow.operators.normalize import normalize_briefs
from leadflow.operators.shared import handover
from leadflow.plans.campaign import responses, run_campaign
from leadflow.sources.briefs import validate_briefs, validate_requests

BRIEF = "busca 1 lead CTO en españa entre 5 y 50 empleados con genai"
QUERY = "site:eu-startups.com/directory/ Spain AI software"


def world(name, host, first, second, person, role, staff):
    snippet = f"Company: {name} | Person: {person} | Role: {role} | Country: Spain"
    evidence = [
        (QUERY, 0, f"https://{host}/{first}", f"{name} people", snippet, "fixture"),
        (QUERY, 1, f"https://{host}/{second}", f"{name} on GenAI", f"Company: {name} | Country: Spain | Employees: {staff} | GenAI automation", "fixture"),
    ]
    page = f"Company: {name}\nCountry: Spain\nEmployees: {staff}\nPerson: {person}\nRole: {role}\nGenAI automation engineering"
    return evidence, [(f"https://{host}/{first}", page)]


def campaign(spark, evidence, pages):
    briefs = spark.createDataFrame([(1, BRIEF, "r-1", "{}")], S.BRIEFS)
    requests, _ = validate_requests(handover(normalize_briefs(briefs), "requests"))
    return run_campaign(
        requests.withColumn("scope", F.lit("global")),
        handover(spark.createDataFrame(evidence, S.EVIDENCE), "evidence"),
        handover(spark.createDataFrame(pages, S.PAGES), "pages"),
        spark.createDataFrame([], S.MEMORY),
        spark.createDataFrame([], S.COUNTERS),
        source_attempt_budget=2,
    )


def test_accept_end_to_end(spark):
    evidence, pages = world("Acme AI", "acme.ai", "about", "blog/agentic-workflows", "Laura Martin", "CTO", 25)
    out = campaign(spark, evidence, pages)
    run = out["runs"].collect()[0]
    assert (run.status, run.accepted, run.completed_reason, run.iterations) == ("completed", 1, "target_count_reached", 1)
    lead = out["accepted_leads"].collect()[0]
    assert (lead.company_name, lead.person_name, lead.role_title) == ("Acme AI", "Laura Martin", "CTO")
    assert lead.qualification.score == 100 and lead.commercial.email_body and "Acme AI" in lead.commercial.email_subject
    response = responses(out).collect()[0]
    assert [x.company_name for x in response.accepted_leads] == ["Acme AI"] and response.shortlist_options == []
    first = out["iterations"].collect()[0]
    assert first.query == QUERY and first.sourcing_status == "FOUND" and len(first.evidence) == 2
    assert out["memory"].filter(F.col("kind") == V.LEAD_NAMES).collect()[0].value == "Laura Martin"


def test_close_match_and_promotion(spark):
    evidence, pages = world("Bravo Dev", "bravo.dev", "team", "blog/genai", "Marta Diaz", "Engineering Manager", 30)
    out = campaign(spark, evidence, pages)
    run = out["runs"].collect()[0]
    assert (run.status, run.completed_reason) == ("completed", "budget_exhausted_with_shortlist")
    options = handover(out["shortlist_options"], "options")
    option = options.collect()[0]
    assert (option.option_number, option.company_name, option.qualification.score) == (1, "Bravo Dev", 85)
    shortlists = options.select("shortlist_id", "run_id", F.lit("pending").alias("status")).distinct()
    chosen = spark.createDataFrame([(option.shortlist_id, 1), (option.shortlist_id, 7), ("short_unknown", 1)], S.SELECTIONS)
    done = R.promote(chosen, options, shortlists, out["runs"])
    lead = done["accepted_leads"].collect()[0]
    assert (lead.company_name, lead.role_title, lead.website, lead.evidence) == ("Bravo Dev", "Engineering Manager", None, [])
    assert done["remaining_options"].count() == 0 and done["shortlists"].collect()[0].status == "cleared"
    assert {(r.shortlist_id, r.option_number) for r in done["refused"].collect()} == {(option.shortlist_id, 7), ("short_unknown", 1)}
    assert {r.value for r in done["memory_deltas"].collect()} == {"Bravo Dev", "Marta Diaz"}


def dossier(spark, role, country="es", staff=25, urls=2, signals=("genai", "automation")):
    requests = normalize_briefs(spark.createDataFrame([(1, BRIEF, None, "{}")], S.BRIEFS))
    evidence = [(f"https://acme.ai/{n}", "t", "s", "fixture") for n in range(urls)]
    row = [(1, "FOUND", "q", ("Ana", role), ("Acme AI", "https://acme.ai", country, staff), list(signals), evidence, ["n"])]
    schema = (
        f"brief_id long, sourcing_status string, query_used string, person {S.PERSON}, company {S.COMPANY}, "
        f"fit_signals array<string>, evidence array<{S.EVIDENCE_ITEM}>, notes array<string>"
    )
    return requests.join(spark.createDataFrame(row, schema), "brief_id")


@pytest.mark.parametrize(
    "role,country,staff,urls,outcome",
    [
        ("CTO", "es", 25, 2, "ACCEPT"),
        ("Engineering Manager", "es", 25, 2, "REJECT_CLOSE_MATCH"),
        ("CTO", "fr", 25, 2, "REJECT"),
        ("CTO", "es", 51, 2, "REJECT"),
        ("CTO", "es", 25, 1, "ENRICH"),
        ("Director", None, 25, 2, "REJECT_CLOSE_MATCH"),  # "Director" contains "cto"
        ("Chief Technology Officer", "es", 25, 2, "REJECT_CLOSE_MATCH"),
        ("Clerk", None, None, 2, "REJECT"),
    ],
)
def test_decisions(spark, role, country, staff, urls, outcome):
    decided = O.draft(K.qualify(dossier(spark, role, country, staff, urls))).collect()[0]
    assert decided.decision.outcome == outcome
    assert (decided.commercial is not None) == (outcome in O.DRAFTED)


def test_plan(spark):
    rows = [(3, 3, 0, 1, 6), (3, 0, 2, 1, 1), (3, 0, 0, 6, 6), (3, 1, 0, 4, 6)]
    state = spark.createDataFrame(rows, "target_count int, accepted int, shortlisted int, source_attempts_used int, source_attempt_budget int")
    got = Z.finish(Z.plan(state)).collect()
    assert [r.action for r in got] == ["FINISH_ACCEPTED", "FINISH_SHORTLIST", "FINISH_NO_RESULT", "SOURCE"]
    assert [r.relaxation_stage for r in got] == [0, 0, 2, 2]
    assert [r.status for r in got] == ["completed", "completed", "no_result", "running"]


def test_contract(spark):
    raw = spark.createDataFrame([(1, '{"unexpected": "value"}'), (2, '{"user_text": "find 2 leads"}')], "brief_id long, payload string")
    sound, refused = validate_briefs(raw)
    assert [r.brief_id for r in sound.collect()] == [2] and [r.error for r in refused.collect()] == ["unknown field: unexpected"]


def test_suggested_queries_come_first(spark):
    requests = normalize_briefs(spark.createDataFrame([(1, BRIEF, None, "{}")], S.BRIEFS))
    own = [p.v for p in Q.query_pairs(requests, F.lit(0)).first().candidates]
    suggested = F.array(F.lit("too short"), F.lit("  Spain   AI people "), F.lit(own[2].upper()))
    got = [p.v for p in Q.query_pairs(requests, F.lit(0), suggested=suggested).first().candidates]
    assert got == ["Spain AI people", own[2].upper(), *own[:2], *own[3:]]


def test_second_search_without_buyer_target(spark):
    """Enrichment asks for the known person's role before a founder; following up always for a founder."""
    row = "named_struct('preferred_country', 'france') AS constraints, named_struct('name', 'Acme', 'country_code', 'es') AS company"
    cases = {"array('sales_lead')": "'CTO'", "array()": "'CTO'", "cast(array() AS array<string>)": "''", "cast(null AS array<string>)": "cast(null AS string)"}
    found = []
    for buyers, role in cases.items():
        df = spark.sql(f"SELECT {row}, named_struct('full_name', 'A B', 'role_title', {role}) AS person, cast({buyers} AS array<string>) AS buyer_targets, array('ai') AS fit_signals, array('x') AS search_themes")
        found.append(tuple(df.select(D.enrichment_query(df), D.follow_up_query(df)).first()))
    assert found == [
        ("Acme sales lead france ai", "Acme sales lead france ai"),
        ("Acme CTO france ai", "Acme founder france ai"),
        ("Acme founder france ai", "Acme founder france ai"),
        ("Acme founder france ai", "Acme founder france ai"),
    ]
