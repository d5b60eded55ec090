"""Answers to all searches a batch of runs can make, found once and looked up in every round.

What a run searches first is among its candidate queries.  What it searches second names a company
that one of those results mentions, so the evidence that can matter later is found by a semi-join of
its queries with those companies.  Both sets of results are read, parsed and checked against the
stored memory here, before the rounds begin; rounds join small answer tables and touch neither
evidence, nor pages, nor memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow import schemas as S
from leadflow import vocab as V
from leadflow.functions import extract as E
from leadflow.functions import text as T
from leadflow.operators.dossier import enrichment_query, follow_up_query, needs_follow_up, score_sql
from leadflow.operators.shared import handover, spread_lookup
from leadflow.sources.evidence import with_page_text

#: One evidence row of a dossier with what its own text, without its page, says.
HELD = f"struct<item:{S.EVIDENCE_ITEM},person:{S.PERSON},company:{S.COMPANY},hits:array<string>,edge:string>"
#: A result of a second search: the same, and what its text with its page says.
SECOND = f"struct<rank:int,held:{HELD},person:{S.PERSON},company:{S.COMPANY}>"

_LONGEST = max(map(len, V.THEME_ALIASES))


def _edge(normed: str) -> Column:
    """Both ends of a normalised text: all that a phrase across its borders can use of it."""
    n = F.col(normed)
    cut = F.concat(F.left(n, F.lit(_LONGEST)), F.lit("\0"), F.right(n, F.lit(_LONGEST)))
    return F.when(F.length(n) <= 2 * _LONGEST, n).otherwise(cut)


def joint_hits(df: DataFrame, hits: str, edges: str, out: str) -> DataFrame:
    """Themes named in texts joined by blanks, from what each text names and from their joined ends.

    ``hits``: SQL for an array of the texts' hit lists; ``edges``: SQL for an array of their ends.
    """
    seam = df.withColumn("_seam", F.expr(f"array_join(filter({edges}, e -> e <> ''), ' ')"))
    both = seam.withColumn("_at_seams", E.theme_hits("_seam"))
    return both.withColumn(out, F.expr(f"concat(flatten({hits}), _at_seams)")).drop("_seam", "_at_seams")


def _by_title(rows: DataFrame) -> Column:
    """Company named by the title, where the text names none."""
    name = T.title_company(F.col("title"))
    return F.when(
        name.isNotNull(),
        F.struct(
            name.alias("name"),
            T.official_website(F.col("page_text"), F.col("url"), T.host(F.col("url"))).alias("website"),
            T.country_of("_full_norm").alias("country_code"),
            F.lit(None).cast("bigint").alias("employee_estimate"),
        ),
    )


def read_results(rows: DataFrame) -> DataFrame:
    """Everything later steps ask of results (query, rank, url, title, snippet, source_type, page_text), as columns.

    ``facts``: for the choice of the best; ``held``: see ``HELD``; ``p_full``, ``c_full``: person and
    company read from the text with its page, ``c_found`` falls back to the title; ``p_short``,
    ``c_short``: read from the text with the beginning of its page; ``text``: lower-case, with page.
    The three texts of a result are read as rows of one pass, side by side, and put together again.
    """
    item = [F.col(c) for c in ("url", "title", "snippet", "source_type")]
    bare, short, full = (
        F.concat_ws(" ", F.col("title"), F.col("snippet"), page) for page in (F.lit(""), T.excerpt(F.col("page_text")), F.col("page_text"))
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in enumerate((bare, short, full))])
    each = rows.select("query", "rank", F.struct(*item).alias("item"), "page_text", F.inline(kinds)).withColumn("url", F.col("item.url"))
    normed = E.parse_candidates(each, "text", "url").withColumn("_norm", T.norm(F.col("text"))).withColumns(
        {"hits": E.theme_hits("_norm"), "edge": _edge("_norm"), "title": F.col("item.title"), "_full_norm": F.col("_norm")}
    )
    told = normed.select(
        "query", "rank", "item", "kind", "hits", "edge",
        F.col("person").cast(S.PERSON).alias("person"),
        F.col("company").cast(S.COMPANY).alias("company"),
        F.when(F.col("kind") == 2, F.coalesce("company", _by_title(normed))).cast(S.COMPANY).alias("found"),
        F.when((F.col("kind") == 0) & F.col("person.role_title").isNotNull(), T.norm(F.col("person.role_title"))).alias("role"),
        F.when(F.col("kind") == 2, F.lower("text")).alias("lower"),
    )

    def of(kind: int, c: str) -> Column:
        return F.any_value(F.when(F.col("kind") == kind, F.col(c)), True)

    both = told.groupBy("query", "rank").agg(
        F.any_value("item").alias("item"),
        *[of(k, c).alias(f"{c}_{k}") for k in (0, 1, 2) for c in ("person", "company")],
        *[of(k, c).alias(f"{c}_{k}") for k in (0, 2) for c in ("hits", "edge")],
        of(0, "role").alias("role"), of(2, "found").alias("c_found"), of(2, "lower").alias("text"),
    )
    facts = F.expr(
        "struct(company_0 IS NOT NULL AS found, role, coalesce(person_0.full_name, '') <> '' AS named, company_0.country_code AS country, "
        "company_0.employee_estimate IS NOT NULL AS sized, hits_0 AS hits)"
    )
    held = F.struct("item", F.col("person_0").alias("person"), F.col("company_0").alias("company"), F.col("hits_0").alias("hits"), F.col("edge_0").alias("edge"))
    return both.select(
        "query", "rank", F.col("item.url").alias("url"), T.usable_url(F.col("item.url")).alias("usable"), facts.alias("facts"),
        held.cast(HELD).alias("held"), F.col("person_2").alias("p_full"), F.col("company_2").alias("c_full"), "c_found",
        F.col("hits_2").alias("full_hits"), F.col("edge_2").alias("full_edge"), F.col("person_1").alias("p_short"), F.col("company_1").alias("c_short"), "text",
    )


def _results(asked: DataFrame, evidence: DataFrame, pages: DataFrame, k: int, label: str) -> DataFrame:
    """First ``k`` results of the distinct ``asked`` queries, each read once; a stored table."""
    mine = handover(evidence.filter(F.col("rank") < k).join(asked, "query", "left_semi"), f"{label}_evidence")
    return handover(read_results(with_page_text(mine, pages, ["query", "rank"])), f"{label}_results")


def _seen(pairs: DataFrame, key: list[str], memory: DataFrame, kind: str, form: str, out: str) -> DataFrame:
    """Per ``key``: which of its values (column ``v``, few) the memory of its scope holds under ``kind``."""
    known = memory.filter(F.col("kind") == kind).select("scope", F.col(form).alias("v"), F.lit(True).alias("_k")).distinct()
    hits = spread_lookup(pairs, known, ["scope", "v"], [k for k in key if k != "scope"], "inner")
    return hits.groupBy(*key).agg(F.collect_set("v").alias(out))


def first_answers(asked: DataFrame, evidence: DataFrame, pages: DataFrame, memory: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Answers to the first searches, and the companies they can lead to.

    ``asked``: distinct (scope, query), stored.  Answers: one row (scope, query, items) per asked
    query with usable results that the scope has not visited, in rank order; an item is marked
    ``explored`` where its company is in the scope's memory.  Companies: distinct (scope, name) of
    the others.  A result is read once however many scopes ask for it, and its list is copied to the
    parts that need it.
    """
    rows = _results(asked.select("query").distinct(), evidence, pages, k, "first")
    fields = ["rank", "url", "facts", "held", "p_full", "c_found", "full_hits", "full_edge"]
    lists = rows.filter("usable").groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    mine = handover(spread_lookup(asked, lists, ["query"], ["scope"], "inner"), "listed")
    key = ["scope", "query"]
    urls = handover(mine.select(*key, F.explode(F.expr("array_distinct(transform(items, i -> i.url))")).alias("v")), "urls")
    names = handover(
        mine.select(*key, F.explode(F.expr("array_distinct(filter(transform(items, i -> lower(i.c_found.name)), n -> n IS NOT NULL))")).alias("v")), "names"
    )
    visited = _seen(urls, key, memory, V.VISITED_URLS, "value", "_visited")
    explored = _seen(names, key, memory, V.COMPANY_NAMES, "value_norm", "_explored")
    marked = mine.join(visited, key, "left").join(explored, key, "left").select(
        *key,
        F.expr(
            "transform(filter(items, i -> NOT coalesce(array_contains(_visited, i.url), false)), i -> struct(i.*, "
            "coalesce(array_contains(_explored, lower(i.c_found.name)), false) AS explored))".replace("i.*", ", ".join(f"i.{f} AS {f}" for f in fields))
        ).alias("items"),
    )
    answers = handover(marked.filter(F.size("items") > 0), "answers")
    found = answers.select("scope", F.explode("items").alias("i")).filter("i.c_found IS NOT NULL AND NOT i.explored")
    return answers, handover(found.select("scope", F.col("i.c_found.name").alias("name")).distinct(), "companies")


def second_answers(companies: DataFrame, evidence: DataFrame, pages: DataFrame, memory: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Answers to follow-up and enrichment searches that can name one of ``companies`` (scope, name; stored).

    A second query begins with the company's name and a blank.  Follow-up answers: (scope,
    company_name, query, parsed) with usable, unvisited results that mention the company; enrichment
    answers: (query, parsed), nothing excluded.  ``parsed`` is in rank order, see ``SECOND``.
    """
    queries = evidence.filter(F.col("rank") < k).select("query").distinct()
    starts = "transform(sequence(1, size(split(query, ' ')) - 1), n -> array_join(slice(split(query, ' '), 1, n), ' '))"
    heads = queries.filter("contains(query, ' ')").select("query", F.explode(F.expr(starts)).alias("name"))
    naming = handover(heads.join(companies.select("name").distinct(), "name", "left_semi").distinct(), "naming")
    rows = _results(naming.select("query").distinct(), evidence, pages, k, "second")

    def listed(person: str, company: str) -> Column:
        entry = F.struct("rank", "held", F.col(person).alias("person"), F.col(company).alias("company"))
        return F.array_sort(F.collect_list(entry)).cast(f"array<{SECOND}>").alias("parsed")

    enrich = handover(rows.groupBy("query").agg(listed("p_short", "c_short")), "enrichments")
    # a query's results are few, and so are the companies its beginning can name
    named = naming.join(rows.filter("usable"), "query").filter(F.contains("text", F.lower("name")))
    fields = ["query", "name", "rank", "url", "held", "p_full", "c_full"]
    offered = handover(named.select(*fields), "offered")
    lists = handover(offered.groupBy("name", "query").agg(listed("p_full", "c_full")), "offers")
    wanted = handover(companies.join(lists.select("name", "query"), "name"), "wanted")
    key = ["scope", "name", "query"]
    urls = handover(wanted.join(offered.select("name", "query", F.col("url").alias("v")), ["name", "query"]).distinct(), "urls")
    visited = _seen(urls, key, memory, V.VISITED_URLS, "value", "_visited")
    mine = spread_lookup(wanted, lists, ["name", "query"], ["scope"], "inner").join(visited, key, "left")
    follow = mine.select(
        "scope", F.col("name").alias("company_name"), "query",
        F.expr("filter(parsed, p -> NOT coalesce(array_contains(_visited, p.held.item.url), false))").alias("parsed"),
    )
    return handover(follow, "follow_ups"), enrich


# ---------------------------------------------------------------- rounds


def find(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Dossier columns and ``held`` for the runs of a round.

    ``asked``: run_id, scope, query (null: none left), own_visited and the request; stored.  Adds
    ``explored``, whether the memory holds the company.  Everything after the look-up is row-local.
    """
    found = spread_lookup(asked, answers, ["scope", "query"], ["run_id"])
    unseen = found.withColumn("items", F.expr("filter(items, i -> NOT array_contains(own_visited, i.url))"))
    scores = F.expr(f"transform(items, (i, n) -> struct({score_sql('i.facts')} AS s, -n AS n))")
    best = unseen.withColumn("_n", F.coalesce(-F.array_max(scores)["n"], F.lit(-1)))
    best = best.withColumn("_s", F.when(F.col("_n") >= 0, F.get("items", F.col("_n"))))
    best = joint_hits(
        best, "array_append(transform(slice(coalesce(items, array()), 1, 2), i -> i.held.hits), coalesce(_s.full_hits, array()))",
        "array_append(transform(slice(coalesce(items, array()), 1, 2), i -> i.held.edge), coalesce(_s.full_edge, ''))", "_hits",
    )
    state = F.when(F.col("_s").isNull(), "empty").when(F.col("_s.c_found").isNull(), "nameless").otherwise("found")
    df = best.withColumn("_state", state)
    is_found, none = F.col("_state") == "found", T.strings([])
    support = F.expr("concat(array(_s.held), transform(slice(filter(items, i -> i.url <> _s.url), 1, 1), i -> i.held))")
    notes = (
        F.when(F.col("query").isNull(), F.array(F.lit(V.NOTE_NO_QUERY)))
        .when(is_found, F.array(F.concat(F.lit("query_used="), F.col("query")), F.lit(V.NOTE_HEURISTIC)))
        .when(F.col("_state") == "empty", F.array(F.lit(V.NOTE_ALL_VISITED)))
        .otherwise(F.array(F.lit(V.NOTE_NO_COMPANY)))
    )
    return df.select(
        *asked.columns,
        F.when(is_found, "FOUND").otherwise("NO_CANDIDATE").alias("sourcing_status"),
        F.col("query").alias("query_used"),
        F.when(is_found, F.col("_s.p_full")).alias("person"),
        F.when(is_found, F.col("_s.c_found")).alias("company"),
        F.when(is_found, E.fit_signals(F.col("search_themes"), F.col("_hits"))).otherwise(none).alias("fit_signals"),
        F.when(is_found, support).when(F.col("_state") == "nameless", F.expr("transform(slice(items, 1, 2), i -> i.held)"))
        .otherwise(F.array().cast(f"array<{HELD}>")).alias("held"),
        notes.alias("notes"),
        F.when(is_found, F.col("_s.explored")).otherwise(F.lit(False)).alias("explored"),
    )


def claim(found: DataFrame, claimed: DataFrame | None) -> DataFrame:
    """(scope, company_key, holder): companies that the runs of a round find first, one row each.

    Of several runs of a scope that find the same company the one with the smallest run_id holds it,
    as if runs acted in that order; companies ``claimed`` in earlier rounds or explored before stay
    as they are.  A company that very many runs find is combined on the map side.
    """
    fresh = found.filter((F.col("sourcing_status") == "FOUND") & ~F.col("explored"))
    first = fresh.groupBy("scope", F.lower("company.name").alias("company_key")).agg(F.min("run_id").alias("holder"))
    return first if claimed is None else first.join(claimed, ["scope", "company_key"], "left_anti")


def _without_lost(df: DataFrame) -> DataFrame:
    """Empties the dossiers of runs that found a company which they do not hold (``held_by_run`` is null)."""
    df = df.withColumn("_lost", (F.col("sourcing_status") == "FOUND") & F.col("held_by_run").isNull())
    empty = {c: F.lit(None) if c in ("person", "company") else F.array() for c in ("person", "company", "fit_signals", "held")}
    return df.withColumns(
        {
            "sourcing_status": F.when(F.col("_lost"), "NO_CANDIDATE").otherwise(F.col("sourcing_status")),
            **{c: F.when(F.col("_lost"), none.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, none in empty.items()},
            "notes": F.when(F.col("_lost"), F.array_append("notes", F.lit(V.NOTE_EXPLORED))).otherwise(F.col("notes")),
        }
    )


def _signals(df: DataFrame, changed: Column) -> DataFrame:
    """Signals of the evidence that is held now, where it ``changed`` and shows any."""
    told = joint_hits(df, "transform(held, h -> h.hits)", "transform(held, h -> h.edge)", "_hits")
    new = told.withColumn("_new", E.fit_signals(F.col("search_themes"), F.col("_hits")))
    return new.withColumn("fit_signals", F.when(changed & (F.size("_new") > 0), F.col("_new")).otherwise(F.col("fit_signals"))).drop("_hits", "_new")


def _filled(df: DataFrame, found: str, named=None) -> DataFrame:
    """Gaps of person and company filled by the first known value of the entries in ``found`` (SQL for an array)."""
    entries = df.withColumn("_entries", F.expr(found))

    def first(pick) -> Column:
        return F.get(F.filter(F.transform("_entries", pick), lambda v: v.isNotNull()), F.lit(0))

    def person(e: Column) -> Column:
        return e["person"] if named is None else F.when(named(e["person"]["full_name"]), e["person"])

    def field(name: str) -> Column:
        return F.coalesce(company[name], first(lambda e: e["company"][name])).alias(name)

    company = F.col("company")
    fields = [field(name) for name in ("website", "country_code", "employee_estimate")]
    return entries.withColumns(
        {
            "person": F.coalesce("person", first(person)).cast(S.PERSON),
            "company": F.when(company.isNotNull(), F.struct(company["name"].alias("name"), *fields)).cast(S.COMPANY),
        }
    ).drop("_entries")


def with_evidence_column(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.expr("transform(held, h -> h.item)").cast(f"array<{S.EVIDENCE_ITEM}>"))


def follow(found: DataFrame, claims: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """Dossiers of runs that hold their company, after a second search for the thin ones; ``found`` is stored.

    The first new answer is added and fills gaps.  A run holds one company at most, so claims are
    joined by run.  Adds ``follow_ups`` (0/1), the searches made.
    """
    thin = with_evidence_column(found)
    asked = thin.select(
        *found.columns,
        F.when(needs_follow_up(), follow_up_query(thin)).alias("_follow_query"),
        F.col("company.name").alias("company_name"),
    )
    answers = follow_ups.withColumnRenamed("query", "_follow_query")
    df = spread_lookup(asked, answers, ["scope", "company_name", "_follow_query"], ["run_id"])
    mine = claims.select(F.col("holder").alias("run_id"), F.lit(True).alias("held_by_run"))
    df = _without_lost(df.join(mine, "run_id", "left"))
    searched = F.col("_follow_query").isNotNull() & ~F.col("_lost")
    new = "filter(parsed, p -> NOT exists(held, h -> h.item.url = p.held.item.url) AND NOT array_contains(own_visited, p.held.item.url))"
    df = df.withColumn("_taken", F.when(searched, F.expr(f"slice(coalesce({new}, array()), 1, 1)")).otherwise(F.array().cast(f"array<{SECOND}>")))
    df = _filled(df, "_taken", T.usable_person).withColumn("held", F.expr("concat(held, transform(_taken, p -> p.held))"))
    added = F.size("_taken") > 0
    note = F.concat(F.lit("follow_up_query="), F.col("_follow_query"))
    return _signals(df, added).withColumns(
        {
            "notes": F.when(added, T.dedupe_norm(F.array_append("notes", note))).otherwise(F.col("notes")),
            "follow_ups": searched.cast("int"),
        }
    ).select(*[c for c in found.columns if c != "explored"], "follow_ups")


def enrich(todo: DataFrame, enrichments: DataFrame) -> DataFrame:
    """One more search for dossiers with a company; new results fill gaps and at most two of them stay.  ``todo`` is stored."""
    thin = with_evidence_column(todo)
    asked = thin.select(*todo.columns, enrichment_query(thin).alias("_query"))
    df = spread_lookup(asked, enrichments.withColumnRenamed("query", "_query"), ["_query"], ["run_id"])
    df = df.withColumn("_new", F.expr("filter(coalesce(parsed, array()), p -> NOT exists(held, h -> h.item.url = p.held.item.url))"))
    entry = "struct(e.person AS person, e.company AS company)"
    df = _filled(df, f"concat(transform(held, e -> {entry}), transform(_new, e -> {entry}))")
    df = df.withColumns({"_n": F.size("held"), "held": F.expr("concat(held, transform(_new, p -> p.held))")})
    return _signals(df, F.lit(True)).withColumns(
        {
            "query_used": F.col("_query"),
            "notes": F.array_append("notes", F.concat(F.lit("enrichment_query="), F.col("_query"))),
            "held": F.slice("held", F.lit(1), F.greatest(F.col("_n") + 2, F.lit(2))),
        }
    ).select(*todo.columns)
