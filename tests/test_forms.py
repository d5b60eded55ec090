"""Steps done once per request form give every request its own rows."""

from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.operators import forms as FM
from leadflow.operators import qualify as K
from leadflow.operators.shared import handover
from leadflow.plans import campaign as C
from leadflow.plans import queries as QQ
from leadflow.sources import evidence as EV

FIELDS = f"brief_id bigint, user_text string, constraints {S.CONSTRAINTS}, buyer_targets array<string>, search_themes array<string>"


def request(brief_id, count, country, low, buyers=("cto",)):
    return brief_id, f"text {brief_id}", (count, country, [], low, None, True, [], []), list(buyers), ["genai"]


def test_requests_of_one_form(spark):
    rows = [request(1, 2, "es", None), request(2, 5, "es", None), request(3, 2, "es", 7), request(4, 2, None, None), request(5, 2, "es", None, ("cto", "ceo"))]
    asked = handover(FM.with_form(spark.createDataFrame(rows, FIELDS)), "asked")
    forms = FM.distinct_forms(asked).collect()
    assert len(forms) == 4 and all(f.constraints.target_count is None for f in forms)
    found = handover(FM.distinct_forms(asked).withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))), "found")
    back = FM.per_request(found, asked).select("brief_id", "pos", "user_text", "constraints.target_count", "constraints.min_company_size").collect()
    want = [(b, p, t, c.target_count if hasattr(c, "target_count") else c[0], c[3]) for b, t, c, *_ in rows for p in (0, 1)]
    assert sorted(map(tuple, back)) == sorted(want)


def test_expansion_work_does_not_follow_the_briefs(spark, small):
    """Thrice the requests of the same forms ask for the same work rows."""
    asked = QQ.requests(spark, small)
    copies = handover(asked.withColumn("brief_id", F.explode(F.array(*[F.col("brief_id") + n * 10**6 for n in range(3)]))), "copies")
    once, thrice = (sorted((r.form, r.pos, r.query) for r in QQ.work_rows(d).collect()) for d in (asked, copies))
    assert once and once == thrice
    assert len(once) == FM.per_request(QQ.work_rows(asked), asked).select("form", "pos").distinct().count()


def test_derived_pages_are_filtered_before_they_are_grouped(spark):
    rows = spark.range(1000).selectExpr("concat('u', id % 500) AS url", "concat('t', id) AS text")
    pages = rows.groupBy("url").agg(F.min("text").alias("text"))
    asked = spark.createDataFrame([("u1", 1), ("none", 2), (None, 3)], "url string, n int")
    found = EV.with_page_text(asked, pages, ["n"])
    assert sorted((r.n, r.page_text) for r in found.collect()) == [(1, "t1"), (2, ""), (3, "")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [url") < plan.index("LeftSemi"), plan


def test_reviews_beside_decisions_as_by_join(spark, small):
    asked = QQ.requests(spark, small)
    decided = handover(FM.per_request(QQ.form_decisions(spark, small, asked), asked).select("brief_id", "pos", "decision"), "all")
    reviews = decided.filter("pos % 2 = 0").selectExpr("brief_id", "pos", "'REJECT' AS outcome", "'s' AS summary", "'t' AS type", "'r' AS region", "'c' AS close_summary")
    key = ["brief_id", "pos"]
    joined = K.merge_reviews(decided, reviews, key)
    beside = K.merged_review(K.review_columns(reviews, key).join(decided, key, "right")).select(*joined.columns)
    assert sorted(map(str, joined.collect())) == sorted(map(str, beside.collect()))


def test_campaign_start_by_form_scope_and_suggestion(spark):
    """Runs of one form share their lists within a scope; each scope has its own history, each run its own suggestions."""
    rows = [(*request(n, 1 + n % 2, "es", None), "b" if n == 3 else "a", f"r{n}") for n in (1, 2, 3)]
    asked = spark.createDataFrame(rows, f"{FIELDS}, scope string, request_id string")
    empty = spark.createDataFrame([], S.MEMORY)
    state, _ = C._start(asked, empty, None)
    first = {r.brief_id: r.query for r in state.collect()}
    assert len(set(first.values())) == 1
    memory = spark.createDataFrame([("a", V.QUERY_HISTORY, first[1], first[1].lower(), 0)], S.MEMORY)
    state, askable = C._start(asked, memory, None)
    got = {r.brief_id: r for r in state.collect()}
    assert got[1].query == got[2].query != first[1] and got[3].query == first[3]
    assert [got[n].constraints.target_count for n in (1, 2, 3)] == [2, 1, 2]
    pairs = {(r.scope, r.query) for r in askable.collect()}
    assert ("b", first[1]) in pairs and ("a", first[1]) not in pairs and askable.count() == len(pairs)
    suggested = spark.createDataFrame([(1, ["Rust agents in Vigo"]), (3, ["Go agents in Porto"])], "brief_id bigint, suggested array<string>")
    state, askable = C._start(asked, empty, suggested)
    assert {r.brief_id: r.query for r in state.collect()} == {1: "Rust agents in Vigo", 2: first[2], 3: "Go agents in Porto"}
    assert ("a", "Go agents in Porto") not in {(r.scope, r.query) for r in askable.collect()}
