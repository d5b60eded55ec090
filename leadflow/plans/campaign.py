"""The round loop: all active runs make one attempt per round, side by side.

Each attempt of a run depends on its earlier ones, so the loop is driven from outside while every
round is a set of Spark jobs over all active runs.  Evidence, pages and memory are read before the
first round only (``operators.answers``); rounds look answers up.  A run's own findings (queries,
URLs; bounded by its budget) travel in its state row.  Runs of one scope share the companies they
find: the first run to find a company holds it, in the order of rounds and, within a round, of
run_id; to all others it is explored.  Queries and URLs are shared through the memory only, which is
merged at the end, so the result does not depend on task order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.functions import text as T
from leadflow.operators import answers as A
from leadflow.operators import expand as Q
from leadflow.operators import finish as Z
from leadflow.operators import forms as FM
from leadflow.operators import memory as M
from leadflow.operators import outreach as O
from leadflow.operators import qualify as K
from leadflow.operators import route as R
from leadflow.operators.normalize import derived_id
from leadflow.operators.shared import handover, spread_rows

_REQUEST = ["brief_id", "scope", "request_id", "user_text", "constraints", "buyer_targets", "search_themes"]
_COUNTERS = ["attempts", "enriched", "searches", "accepted", "shortlisted"]
_STAGES = ["stage_0", "stage_1", "stage_2"]
STATE = ["run_id", *_REQUEST, *_COUNTERS, "own_history", "own_visited", "query", *_STAGES]
#: What an attempt needs of a run; ``query`` is the one it asks next.
_ASKED = ["run_id", "scope", "constraints", "buyer_targets", "search_themes", "enriched", "own_visited", "query"]


def _start(requests: DataFrame, memory: DataFrame, suggested: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Initial run states with their unused queries, and the distinct (scope, query) they may ask.

    Candidate queries are listed and checked against the history once per scope and request form;
    with queries from outside every run has a form of its own.
    """
    runs = requests.select(derived_id("run", F.col("brief_id")).alias("run_id"), *_REQUEST)
    if suggested is None:
        formed, given, first = FM.with_form(runs), [], None
        formed = formed.withColumn("form", F.concat_ws("\u001f", "scope", "form"))
    else:
        formed, given, first = runs.join(suggested.select("brief_id", "suggested"), "brief_id", "left"), ["suggested"], F.col("suggested")
        formed = formed.withColumn("form", F.col("run_id"))
    formed = handover(spread_rows(formed, "run_id"), "runs")
    listed = handover(FM.distinct_forms(formed, "scope", *given), "forms")
    if given:
        listed = spread_rows(listed, "form")
    for stage, name in enumerate(_STAGES):
        listed = Q.query_pairs(listed, F.lit(stage), name, first)
    known = Q.with_known_queries(handover(listed, "queries"), M.query_history(memory), _STAGES, ["form"])
    unused = [F.filter(s, lambda p: ~F.array_contains("known", p["n"])).alias(s) for s in _STAGES]
    lists = handover(known.select("form", "scope", *unused), "unused")
    none = T.strings([])
    state = FM.per_request(lists, formed).select(
        "run_id",
        *_REQUEST,
        *[F.lit(0).alias(c) for c in _COUNTERS],
        *[none.alias(c) for c in ("own_history", "own_visited")],
        F.lit(None).cast("string").alias("query"),
        *_STAGES,
    )
    state = handover(state.withColumn("query", _next_query()), "state")
    asked = lists.select("scope", F.explode(F.concat(*[F.transform(s, lambda p: p["v"]) for s in _STAGES])).alias("query"))
    return state, handover(asked.distinct(), "askable")


def _next_query() -> Column:
    """First candidate of the run's stage that it has not asked itself, ``query`` being its last; null when there is none."""
    stage = Q.relaxation_stage(F.col("attempts"))
    pairs = F.when(stage == 0, F.col("stage_0")).when(stage == 1, F.col("stage_1")).otherwise(F.col("stage_2"))
    current = F.array_compact(F.array(F.when(F.col("query").isNotNull(), T.norm(F.col("query")))))
    return Q.first_unused(pairs, F.concat("own_history", current))


def _attempt(state: DataFrame, answers: DataFrame, follow_ups: DataFrame, enrichments: DataFrame, claimed: DataFrame | None, enrich_budget: int):
    """One attempt of every active run up to its outcome, and the claims of the round; both stored."""
    asked = state.select(*_ASKED)
    found = handover(A.find(asked, answers), "found")
    claims = handover(A.claim(found, claimed), "claims")
    tried = handover(_with_outcome(A.follow(found, claims, follow_ups).withColumn("enrich_searches", F.lit(0))), "tried")
    may_enrich = (F.col("outcome") == "ENRICH") & (F.col("enriched") < enrich_budget)
    todo = tried.filter(may_enrich).drop("outcome")
    if todo.isEmpty():
        return tried, claims
    fuller = A.enrich(todo, enrichments).withColumn("enrich_searches", F.lit(1))
    return tried.filter(~may_enrich).unionByName(handover(_with_outcome(fuller), "enriched")), claims


def _with_outcome(df: DataFrame) -> DataFrame:
    """Adds what a round must know of the decision; its texts are written once, after the last round."""
    return K.qualify(A.with_evidence_column(df)).select(*df.columns, F.col("decision.outcome").alias("outcome"))


def _next_state(state: DataFrame, tried: DataFrame, budget: int, shortlist_size: int) -> DataFrame:
    """State after a round, with ``status`` and ``completed_reason``."""
    seen = tried.select("run_id", "query_used", "follow_ups", "enrich_searches", "outcome", F.expr("transform(held, h -> h.item.url)").alias("urls"))
    asked = F.col("query").isNotNull()
    used = F.array_compact(F.array(F.when(F.col("query_used").isNotNull(), T.norm(F.col("query_used")))))
    moved = state.join(seen, "run_id").withColumns(
        {
            "attempts": F.when(asked, F.col("attempts") + 1).otherwise(F.lit(budget)),
            "enriched": F.col("enriched") + F.col("enrich_searches"),
            "searches": F.col("searches") + asked.cast("int") + F.col("follow_ups") + F.col("enrich_searches"),
            "accepted": F.col("accepted") + (F.col("outcome") == "ACCEPT").cast("int"),
            "shortlisted": F.least(F.col("shortlisted") + (F.col("outcome") == "REJECT_CLOSE_MATCH").cast("int"), F.lit(shortlist_size)),
            "own_history": F.array_distinct(F.concat("own_history", used)),
            "own_visited": F.array_distinct(F.concat("own_visited", "urls")),
            "stage": Q.relaxation_stage(F.col("attempts")),
            "target_count": F.col("constraints.target_count"),
        }
    )
    counted = moved.withColumns({"source_attempts_used": F.col("attempts"), "source_attempt_budget": F.lit(budget)})
    ended = Z.finish(counted).withColumn("query", F.when(F.col("status") == "running", _next_query()))
    return handover(ended.select(*STATE, "stage", "status", "completed_reason"), "state")


def run_campaign(
    requests: DataFrame,
    evidence: DataFrame,
    pages: DataFrame,
    memory: DataFrame,
    counters: DataFrame,
    source_attempt_budget: int = V.SOURCE_ATTEMPT_BUDGET,
    enrich_attempt_budget: int = V.ENRICH_ATTEMPT_BUDGET,
    max_results: int = V.MAX_RESULTS,
    shortlist_size: int = V.SHORTLIST_SIZE,
    batch: int = 1,
    suggested: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Run all requests to their end.

    ``requests``: normalised, within bounds, with ``scope``; ``evidence``, ``pages``, ``memory`` and
    ``counters`` are stored tables; ``suggested``: (brief_id, suggested) query lists from outside, which
    go before a run's own ones.  Returns ``runs``, ``iterations``, the routed tables, the ``claims``
    (scope, company_key, holder, idx), and the merged ``memory`` and ``counters``.
    """
    state, askable = _start(requests, memory, suggested)
    answers, companies = A.first_answers(askable, evidence, pages, memory, max_results)
    follow_ups, enrichments = A.second_answers(companies, evidence, pages, memory, max_results)
    attempts, ended, claimed = [], [], []
    for idx in range(1, source_attempt_budget + 1):
        before = reduce(DataFrame.unionByName, claimed).select("scope", "company_key") if claimed else None
        decided, claims = _attempt(state, answers, follow_ups, enrichments, before, enrich_attempt_budget)
        claimed.append(claims.withColumn("idx", F.lit(idx)))
        attempts.append(decided.withColumn("idx", F.lit(idx)))
        after = _next_state(state, decided, source_attempt_budget, shortlist_size)
        ended.append(after.filter(F.col("status") != "running").withColumn("iterations", F.lit(idx)))
        state = after.filter(F.col("status") == "running").drop("status", "completed_reason", "stage")
        if idx == source_attempt_budget or state.isEmpty():
            break
    made = A.with_evidence_column(reduce(DataFrame.unionByName, attempts).drop("own_visited", "outcome")).drop("held")
    decided = handover(K.qualify(made), "decided")
    iterations = handover(O.draft(decided), "iterations")
    runs = reduce(DataFrame.unionByName, ended)
    deltas = R.memory_deltas(iterations).withColumn("first_seen", F.lit(batch * 1000) + F.col("first_seen"))
    order = runs.select("scope", F.col("run_id").alias("run_order"), "status")
    return {
        "runs": runs.select(
            "run_id",
            *_REQUEST,
            "status",
            "completed_reason",
            F.col("stage").alias("applied_relaxation_stage"),
            "iterations",
            *_COUNTERS,
            F.when(F.col("shortlisted") > 0, R.shortlist_id(F.col("run_id"))).alias("shortlist_id"),
        ),
        "iterations": iterations.select(
            "run_id", "idx", F.lit("SOURCE").alias("planner_action"), "query", *S.DOSSIER_COLUMNS, "decision", "follow_ups", "enrich_searches"
        ),
        **R.route(iterations, shortlist_size),
        "claims": reduce(DataFrame.unionByName, claimed),
        "memory": M.merge_memory(memory, deltas),
        "counters": M.miss_streak(counters, order),
    }


def responses(tables: dict[str, DataFrame]) -> DataFrame:
    """One nested document per run for the archive: the run with its leads, shortlist options and, where given, iterations.

    A run has at most one lead, option or iteration per attempt, so the collected lists stay short.
    """

    def listed(name: str, order: str) -> DataFrame:
        rows = tables[name]
        row = F.struct(*[c for c in rows.columns if c not in ("run_id", order)])
        entries = F.array_sort(F.collect_list(F.struct(order, row.alias("row"))))
        return rows.groupBy("run_id").agg(F.transform(entries, lambda e: e["row"]).alias(name))

    runs = tables["runs"]
    for name, order in (("accepted_leads", "idx"), ("shortlist_options", "option_number"), ("iterations", "idx")):
        if name not in tables:
            continue
        if name in runs.columns:  # a count of theirs
            runs = runs.withColumnRenamed(name, f"n_{name}")
        per_run = listed(name, order)
        empty = F.array().cast(per_run.schema[name].dataType)
        runs = runs.join(per_run, "run_id", "left").withColumn(name, F.coalesce(name, empty))
    return runs
