"""From chosen queries to candidate dossiers: retrieval lists, best evidence, parsing, follow-up,
enrichment.

Work rows carry key columns, ``scope``, ``query``, ``constraints``, ``buyer_targets`` and
``search_themes``.  Text work that does not depend on the brief (parsing evidence and pages) is done
once per distinct evidence row or evidence combination, never once per brief, and only its small
results travel to the briefs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.functions import extract as E
from leadflow.functions import text as T
from leadflow.operators.shared import handover, spread_lookup
from leadflow.sources.evidence import retrieve, unvisited, usable_results, with_page_text



def _item(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{f}").alias(f) for f in ("url", "title", "snippet", "source_type")])


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# ---------------------------------------------------------------- selection


def with_facts(rows: DataFrame) -> DataFrame:
    """Add ``facts``: what the selection score needs to know about one evidence row."""
    kept = rows.columns
    text = rows.withColumn("_text", F.concat_ws(" ", "title", "snippet")).withColumn("_norm", T.norm(F.col("_text")))
    parsed = E.parse_candidates(text, "_text", "url", "_person", "_company")
    facts = parsed.select(
        *kept,
        "_company",
        "_person.full_name",
        F.when(F.col("_person.role_title").isNotNull(), T.norm(F.col("_person.role_title"))).alias("_role"),
        E.theme_hits("_norm").alias("_hits"),
    )
    return facts.select(
        *kept,
        F.expr(
            "struct(_company IS NOT NULL AS found, _role AS role, coalesce(full_name, '') <> '' AS named, "
            "_company.country_code AS country, _company.employee_estimate IS NOT NULL AS sized, _hits AS hits)"
        ).alias("facts"),
    )


def score_sql(facts: str, evidence_count: int = 1) -> str:
    """Score by which the best result of a query is picked; -100 without a company."""
    adjacent = "|".join(V.ADJACENT_ROLE_WORDS)
    return f"""CASE WHEN NOT {facts}.found THEN -100 ELSE 20
        + CASE WHEN exists(buyer_targets, b -> contains({facts}.role, translate(b, '_', ' '))) THEN 20
               WHEN rlike({facts}.role, '{adjacent}') THEN 10 ELSE 0 END
        + CASE WHEN {facts}.country = constraints.preferred_country THEN 15 ELSE 0 END
        + CASE WHEN {facts}.sized THEN 10 ELSE 0 END
        + least(8 * size(filter(search_themes, t -> array_contains({facts}.hits, t))), 16)
        + {min(evidence_count * 4, 12)} + CASE WHEN {facts}.named THEN 8 ELSE 0 END END"""


def evidence_lists(
    questions: DataFrame, evidence: DataFrame, k: int = V.MAX_RESULTS, visited: DataFrame | None = None
) -> DataFrame:
    """``(scope, query, items)``: usable, unvisited results of each asked query, in rank order.

    The first ``k`` results are taken before visited and social URLs are removed.
    """
    rows = usable_results(retrieve(questions.select("scope", "query").distinct(), evidence, k))
    if visited is not None:
        rows = unvisited(rows, visited)
    item = F.struct("rank", "url", "title", "snippet", "source_type", "facts")
    return with_facts(rows).groupBy("scope", "query").agg(F.array_sort(F.collect_list(item)).alias("items"))


def with_evidence(
    work: DataFrame,
    evidence: DataFrame,
    key: list[str],
    k: int = V.MAX_RESULTS,
    visited: DataFrame | None = None,
    own_visited: Column | None = None,
) -> DataFrame:
    """Add ``items``, the result list of each work row's query (empty when there is none)."""
    lists = evidence_lists(work, evidence, k, visited)
    found = spread_lookup(work, lists, ["scope", "query"], key)
    empty = F.filter(F.array(F.lit(None).cast(lists.schema["items"].dataType.elementType)), lambda x: x.isNotNull())
    items = F.coalesce(F.col("items"), empty)
    if own_visited is not None:
        items = F.filter(items, lambda i: ~F.array_contains(own_visited, i["url"]))
    return found.withColumn("items", items)


def select_best(work: DataFrame) -> DataFrame:
    """Add ``best_score`` and ``selected``: highest selection score, earliest rank on ties.

    The list is at most the search limit long, so this is a row-local step without a shuffle.
    """
    scores = F.expr(f"transform(items, (i, n) -> struct({score_sql('i.facts')} AS s, -n AS n))")
    best = work.withColumn("_best", F.array_max(scores))
    return best.select(*work.columns, F.col("_best.s").alias("best_score"), F.expr("items[-_best.n]").alias("selected"))


# ---------------------------------------------------------------- dossiers


def _combination_facts(chosen: DataFrame, pages: DataFrame) -> DataFrame:
    """Parse each distinct (query, first two results, selected result) once, with its page text."""
    combo = ["query", "_r0", "_r1", "_rs"]
    texts = chosen.groupBy(*combo).agg(
        *[F.any_value(F.col(f"selected.{f}")).alias(f) for f in ("url", "title", "snippet")],
        F.any_value(
            F.array_join(
                F.transform(F.slice("items", 1, 2), lambda i: F.concat(i["title"], F.lit(" "), i["snippet"])), " "
            )
        ).alias("_lead"),
    )
    paged = (
        with_page_text(texts, pages, combo)
        .withColumn("_combined", F.concat_ws(" ", "title", "snippet", "page_text"))
        .withColumn("_norm", T.norm(F.concat_ws(" ", "_lead", "_combined")))
        .withColumn("_page_norm", T.norm(F.col("_combined")))
    )
    parsed = E.parse_candidates(paged, "_combined", "url", "c_person", "c_company")
    by_title = T.title_company(F.col("title"))
    titled = F.when(
        by_title.isNotNull(),
        F.struct(
            by_title.alias("name"),
            T.official_website(F.col("page_text"), F.col("url"), T.host(F.col("url"))).alias("website"),
            T.country_of("_page_norm").alias("country_code"),
            F.lit(None).cast("bigint").alias("employee_estimate"),
        ),
    )
    return parsed.select(
        *combo,
        "c_person",
        F.coalesce("c_company", titled).alias("c_company"),
        E.theme_hits("_norm").alias("c_hits"),
    )


def _plain(item: Column) -> Column:
    return F.struct(*[item[f].alias(f) for f in ("url", "title", "snippet", "source_type")])


def build_dossiers(
    work: DataFrame,
    pages: DataFrame,
    key: list[str],
    empty_note: str = V.NOTE_NO_RESULT,
) -> DataFrame:
    """Dossier columns for work rows that carry ``items``.  Pages are read for selected results only."""
    chosen = select_best(work).withColumns(
        {
            "_r0": F.coalesce(F.get("items", F.lit(0))["rank"], F.lit(-1)),
            "_r1": F.coalesce(F.get("items", F.lit(1))["rank"], F.lit(-1)),
            "_rs": F.coalesce(F.col("selected.rank"), F.lit(-1)),
        }
    )
    chosen = handover(chosen, "selected")
    combo = ["query", "_r0", "_r1", "_rs"]
    facts = _combination_facts(chosen.filter(F.col("_rs") >= 0), pages)
    df = spread_lookup(chosen, facts, combo, key)
    df = df.withColumn(
        "_state",
        F.when(F.col("selected").isNull(), "empty").when(F.col("c_company").isNull(), "nameless").otherwise("found"),
    )
    found = F.col("_state") == "found"
    none = T.strings([])
    no_items = F.array().cast(f"array<{S.EVIDENCE_ITEM}>")
    others = F.filter("items", lambda i: i["url"] != F.col("selected.url"))
    support = F.concat(F.array(_plain(F.col("selected"))), F.transform(F.slice(others, 1, 1), _plain))
    picked = F.array(F.concat(F.lit("query_used="), F.col("query")), F.lit(V.NOTE_HEURISTIC))
    base = [c for c in work.columns if c not in S.DOSSIER_COLUMNS]
    return df.select(
        *base,
        F.when(found, "FOUND").otherwise("NO_CANDIDATE").alias("sourcing_status"),
        F.col("query").alias("query_used"),
        F.when(found, F.col("c_person")).cast(S.PERSON).alias("person"),
        F.when(found, F.col("c_company")).cast(S.COMPANY).alias("company"),
        F.when(found, E.fit_signals(F.col("search_themes"), F.col("c_hits"))).otherwise(none).alias("fit_signals"),
        F.when(found, support)
        .when(F.col("_state") == "nameless", F.transform(F.slice("items", 1, 2), _plain))
        .otherwise(no_items)
        .cast(f"array<{S.EVIDENCE_ITEM}>")
        .alias("evidence"),
        F.when(found, picked)
        .when(F.col("_state") == "empty", F.array(F.lit(empty_note)))
        .otherwise(F.array(F.lit(V.NOTE_NO_COMPANY)))
        .alias("notes"),
    )


def drop_explored(
    dossiers: DataFrame, explored: DataFrame, key: list[str], own_explored: Column | None = None
) -> DataFrame:
    """Turn candidates whose company was handled before into empty dossiers with a note.

    ``explored``: (scope, company_key), lower-case names.  ``dossiers`` is read twice: pass a stored
    table.
    """
    known = explored.select("scope", "company_key", F.lit(True).alias("_known")).distinct()
    name_key = F.lower(F.col("company.name"))
    df = spread_lookup(dossiers.withColumn("company_key", name_key), known, ["scope", "company_key"], key)
    repeated = F.col("_known").isNotNull()
    if own_explored is not None:
        repeated = repeated | F.coalesce(F.array_contains(own_explored, name_key), F.lit(False))
    df = df.withColumn("_again", repeated)

    def unless_again(c: str) -> Column:
        dtype = dossiers.schema[c].dataType
        empty = F.array().cast(dtype) if c in ("fit_signals", "evidence") else F.lit(None).cast(dtype)
        return F.when(F.col("_again"), empty).otherwise(F.col(c)).alias(c)

    changed = {c: unless_again(c) for c in ("person", "company", "fit_signals", "evidence")}
    changed["sourcing_status"] = (
        F.when(F.col("_again"), "NO_CANDIDATE").otherwise(F.col("sourcing_status")).alias("sourcing_status")
    )
    changed["notes"] = (
        F.when(F.col("_again"), F.array_append("notes", F.lit(V.NOTE_EXPLORED))).otherwise(F.col("notes")).alias("notes")
    )
    return df.select(*[changed.get(c, F.col(c)) for c in dossiers.columns])


# ---------------------------------------------------------------- gaps


def first_known(values: Column, found: Column, pick) -> Column:
    """``values`` if known, else the first non-null ``pick(entry)`` of ``found`` in order."""
    return F.coalesce(values, F.get(F.filter(F.transform(found, pick), lambda v: v.isNotNull()), F.lit(0)))


def fill_gaps(df: DataFrame, found: str, person_rule=None) -> DataFrame:
    """Fill missing person and company fields from parsed entries, first known value in order.

    A person is taken whole; the company name never changes.  ``person_rule`` restricts which
    persons may be taken.
    """
    entries = F.col(found)
    company = F.col("company")

    def person_of(p: Column) -> Column:
        return p["person"] if person_rule is None else F.when(person_rule(p["person"]["full_name"]), p["person"])

    def field(name: str) -> Column:
        return first_known(company[name], entries, lambda p: p["company"][name])

    filled = F.struct(
        company["name"].alias("name"),
        field("website").alias("website"),
        field("country_code").alias("country_code"),
        field("employee_estimate").alias("employee_estimate"),
    )
    return df.withColumns(
        {
            "person": first_known(F.col("person"), entries, person_of).cast(S.PERSON),
            "company": F.when(company.isNotNull(), filled).cast(S.COMPANY),
        }
    )


def _with_evidence_signals(df: DataFrame, condition: Column) -> DataFrame:
    """Signals recomputed from the titles and snippets of the evidence, where there are any."""
    text = F.expr("array_join(transform(evidence, i -> concat(i.title, ' ', i.snippet)), ' ')")
    hits = df.withColumn("_norm", T.norm(text)).withColumn("_hits", E.theme_hits("_norm"))
    new = hits.withColumn("_signals", E.fit_signals(F.col("search_themes"), F.col("_hits")))
    return new.withColumn(
        "fit_signals", F.when(condition & (F.size("_signals") > 0), F.col("_signals")).otherwise(F.col("fit_signals"))
    )


def _keep_or(new: Column, old: Column) -> Column:
    return F.when(F.size(new) > 0, new).otherwise(old)


# ---------------------------------------------------------------- follow-up


def _hints(df: DataFrame, role: Column | None = None) -> tuple[Column, Column, Column]:
    """Country, buyer and topic words of a second search for a known company; ``role`` stands in for a missing buyer target."""
    country = F.coalesce(F.col("constraints.preferred_country"), F.col("company.country_code"), F.lit("spain"))
    buyer = F.coalesce(F.translate(F.get("buyer_targets", F.lit(0)), "_", " "), *([] if role is None else [role]), F.lit("founder"))
    return country, buyer, F.slice(_keep_or(F.col("fit_signals"), F.col("search_themes")), 1, 2)


def follow_up_query(df: DataFrame) -> Column:
    country, buyer, topics = _hints(df)
    return T.strip(F.concat_ws(" ", F.col("company.name"), buyer, country, F.array_join(topics, " ")))


def enrichment_query(df: DataFrame) -> Column:
    country, buyer, topics = _hints(df, F.nullif(F.col("person.role_title"), F.lit("")))
    return T.strip(F.concat_ws(" ", F.col("company.name"), buyer, country, F.array_join(topics, "  ")))


def needs_follow_up() -> Column:
    return (
        (F.col("sourcing_status") == "FOUND") & F.col("company").isNotNull() & (F.size("evidence") < 2)
    )


def _parsed_lists(rows: DataFrame, text: Column, group: list[str]) -> DataFrame:
    """Parse rows and collect them per question as ``parsed`` in rank order (at most k each)."""
    parsed = E.parse_candidates(rows.withColumn("_text", text), "_text", "url", "p_person", "p_company")
    entry = F.struct(
        "rank", _item().alias("item"), F.col("p_person").alias("person"), F.col("p_company").alias("company")
    )
    return parsed.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))).alias("_sorted")
    ).select(*group, F.transform("_sorted", lambda s: s["e"]).alias("parsed"))


def _with_parsed(df: DataFrame, lists: DataFrame, on: list[str], key: list[str]) -> DataFrame:
    found = spread_lookup(df, lists, on, key)
    return found.withColumn("parsed", F.coalesce("parsed", F.array().cast(f"array<{S.PARSED_ITEM}>")))


def follow_up(
    dossiers: DataFrame,
    evidence: DataFrame,
    pages: DataFrame,
    key: list[str],
    k: int = V.MAX_RESULTS,
    visited: DataFrame | None = None,
    own_visited: Column | None = None,
) -> DataFrame:
    """Second search for found candidates with fewer than two evidence rows.

    Takes the first result that is new, unvisited, usable and mentions the company, and fills gaps
    from it.  ``dossiers`` is read more than once: pass a stored table.  Adds ``follow_ups`` (0/1),
    the number of searches made.
    """
    asked = dossiers.withColumn(
        "_follow_query", F.when(needs_follow_up(), follow_up_query(dossiers))
    ).withColumn("asked_company", F.col("company.name"))
    questions = (
        asked.filter(F.col("_follow_query").isNotNull())
        .select("scope", F.col("_follow_query").alias("query"), "asked_company")
        .distinct()
    )
    rows = usable_results(retrieve(questions, evidence, k))
    if visited is not None:
        rows = unvisited(rows, visited)
    group = ["scope", "query", "asked_company"]
    paged = with_page_text(rows, pages, group + ["rank"])
    text = F.concat_ws(" ", "title", "snippet", "page_text")
    mentioning = paged.filter(F.contains(F.lower(text), F.lower(F.col("asked_company"))))
    lists = _parsed_lists(mentioning, text, group).withColumnRenamed("query", "_follow_query")
    found = _with_parsed(asked, lists, ["scope", "_follow_query", "asked_company"], key)

    def is_new(p: Column) -> Column:
        fresh = ~F.exists("evidence", lambda e: e["url"] == p["item"]["url"])
        return fresh if own_visited is None else fresh & ~F.array_contains(own_visited, p["item"]["url"])

    taken = found.withColumn("parsed", F.slice(F.filter("parsed", is_new), 1, 1))
    filled = fill_gaps(taken, "parsed", T.usable_person).withColumn("_added", F.size("parsed") > 0)
    grown = filled.withColumn(
        "evidence", F.concat("evidence", F.transform("parsed", lambda p: p["item"]))
    )
    note = F.concat(F.lit("follow_up_query="), F.col("_follow_query"))
    return _with_evidence_signals(grown, F.col("_added")).withColumns(
        {
            "notes": F.when(F.col("_added"), T.dedupe_norm(F.array_append("notes", note))).otherwise(F.col("notes")),
            "follow_ups": F.col("_follow_query").isNotNull().cast("int"),
        }
    ).select(*[c for c in dossiers.columns if c != "follow_ups"], "follow_ups")


# ---------------------------------------------------------------- enrichment


def enrich(
    dossiers: DataFrame, evidence: DataFrame, pages: DataFrame, key: list[str], k: int = V.MAX_RESULTS
) -> DataFrame:
    """Enrichment pass over dossiers that have a company.

    Adds the new results of one more search, fills gaps from all evidence in order, recomputes the
    signals and keeps at most two more evidence rows than before (two at least).  Visited and social
    URLs are not excluded here.  ``dossiers`` is read more than once: pass a stored table.
    """
    asked = dossiers.withColumn("_query", enrichment_query(dossiers)).withColumn("_n", F.size("evidence"))
    questions = asked.select(F.col("_query").alias("query")).distinct()
    paged = with_page_text(retrieve(questions, evidence, k), pages, ["query", "rank"])
    text = F.concat_ws(" ", F.col("title"), F.col("snippet"), T.excerpt(F.col("page_text")))
    lists = _parsed_lists(paged, text, ["query"]).withColumnRenamed("query", "_query")

    held = dossiers.select(*key, F.posexplode("evidence").alias("rank", "_e")).select(*key, "rank", "_e.*")
    old = _parsed_lists(held, F.concat_ws(" ", "title", "snippet", F.lit("")), key).withColumnRenamed(
        "parsed", "_old"
    )
    found = _with_parsed(asked, lists, ["_query"], key).join(old, key, "left")
    new = F.filter("parsed", lambda p: ~F.exists("evidence", lambda e: e["url"] == p["item"]["url"]))
    both = found.withColumn("_new", new).withColumn(
        "_all", F.concat(F.coalesce("_old", F.array().cast(f"array<{S.PARSED_ITEM}>")), F.col("_new"))
    )
    grown = fill_gaps(both, "_all").withColumn(
        "evidence", F.concat("evidence", F.transform("_new", lambda p: p["item"]))
    )
    return (
        _with_evidence_signals(grown, F.lit(True)).withColumns(
            {
                "query_used": F.col("_query"),
                "sourcing_status": F.lit("FOUND"),
                "notes": F.array_append("notes", F.concat(F.lit("enrichment_query="), F.col("_query"))),
            }
        )
        .withColumn("evidence", F.slice("evidence", 1, F.greatest(F.col("_n") + 2, F.lit(2))))
        .select(*dossiers.columns)
    )
