"""Independent SQL statements of the registered queries, for a DuckDB cross-check.

Each statement is assembled from named common table expressions; a small set of text helpers writes
the recurring scalar expressions.
"""

from __future__ import annotations

import re

from leadflow import vocab as V

W = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lits(values: list[str]) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def re2(pattern: str) -> str:
    if "(?iU)" in pattern or "(?U)" in pattern:  # digits of every script
        pattern = pattern.replace(r"\d", r"\p{Nd}")
    return lit(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


#: The scripts whose digits the fixture tables hold.
DIGITS = "\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19"


def as_number(x: str) -> str:
    return f"try_cast(nullif(translate({x}, '{DIGITS}', '01234567890123456789'), '') AS BIGINT)"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '{W}+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def let(x: str, name: str, body: str) -> str:
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def uniq(x: str) -> str:
    return let(x, "ul", "list_filter(ul, lambda ux, ui: list_position(ul, ux) = ui)")


def uniq_norm(x: str) -> str:
    inner = let(
        f"list_transform(nl, lambda ny: {norm('ny')})", "nn", "list_filter(nl, lambda nx, ni: list_position(nn, nn[ni]) = ni)"
    )
    return let(x, "nl", inner)


def not_null(x: str) -> str:
    return f"list_filter({x}, lambda z: z IS NOT NULL)"


def case_of(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"


def country(n: str) -> str:
    alias = " ".join(f"WHEN contains({n}, {lit(a)}) THEN {lit(c)}" for a, c in V.COUNTRY_ALIASES.items())
    codes = ", ".join(lit(c) for c in V.COUNTRY_TERMS)
    return f"CASE WHEN {n} IN ({codes}) THEN {n} {alias} WHEN regexp_matches({n}, '^\\p{{L}}{{2}}$') THEN {n} END"


def host(u: str) -> str:
    pattern = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?([^/?#:@\[\]]*)"
    return f"regexp_replace(lower(regexp_extract({u}, '{pattern}', 1)), '^www\\.', '')"


def clean(x: str) -> str:
    letters = (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[_\\-]+', ' ', 'g'), "
        f"'[^A-Za-z0-9.& ]+', ' ', 'g'), {re2(V.NAME_NOISE_WORDS)}, ' ', 'g'), ' +', ' ', 'g'))"
    )
    title = (
        "array_to_string(list_transform(range(1, length(cs) + 1), lambda ci: "
        "CASE WHEN ci > 1 AND regexp_matches(substr(cs, ci - 1, 1), '[A-Za-z]') THEN substr(cs, ci, 1) "
        "ELSE upper(substr(cs, ci, 1)) END), '')"
    )
    return let(
        letters,
        "cs",
        f"CASE WHEN length(cs) < 2 THEN NULL WHEN regexp_matches(cs, '[a-z]') AND NOT regexp_matches(cs, '[A-Z]') "
        f"THEN {title} ELSE cs END",
    )


def n_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, ' ', '')) + 1 END"


def title_company(t: str) -> str:
    head = strip(f"regexp_split_to_array({strip(t)}, '{W}+[|\\-]{W}+')[1]")
    return let(head, "th", f"CASE WHEN NOT regexp_matches(th, {re2(V.LISTING_TITLE_WORDS)}) THEN {clean('th')} END")


def domain_company(url: str, h: str) -> str:
    path = (
        f"regexp_replace(regexp_extract({url}, '^[\\x00-\\x20]*(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), "
        "';[^/]*$', '')"
    )
    parts = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    hosts = ", ".join(lit(x) for x in V.DIRECTORY_HOSTS)
    segment = let(
        parts,
        "ps",
        "CASE WHEN list_contains(ps, 'directory') AND list_position(ps, 'directory') < len(ps) "
        "THEN ps[list_position(ps, 'directory') + 1] ELSE ps[-1] END",
    )
    return f"CASE WHEN {h} = '' THEN NULL WHEN {h} IN ({hosts}) THEN {clean(segment)} ELSE {clean(f'string_split({h}, chr(46))[1]')} END"


def website(text: str, url: str, h: str) -> str:
    hosts = lits(V.DIRECTORY_HOSTS + [""])
    pattern = r"(?i)https?://[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000})]+"
    found = f"list_filter(regexp_extract_all({text}, '{pattern}'), lambda wu: NOT list_contains({hosts}, {host('wu')}) AND {host('wu')} <> {h})"
    return f"coalesce(rtrim({found}[1], '.,)'), CASE WHEN NOT list_contains({hosts}, {h}) THEN {url} END)"


def themes_in(n: str, aliases: dict[str, str] | None = None) -> str:
    table = aliases or V.THEME_ALIASES
    return uniq(not_null("[" + ", ".join(f"CASE WHEN contains({n}, {lit(a)}) THEN {lit(t)} END" for a, t in table.items()) + "]"))


def signals(themes: str, hits: str) -> str:
    return f"list_filter({themes}, lambda st: list_contains({hits}, st))"


def usable_person(x: str) -> str:
    return let(
        squeeze(f"coalesce({x}, '')"),
        "up",
        f"(up <> '' AND length(up) <= 80 AND {n_words('up')} <= 6 AND NOT contains(lower(up), 'industries:'))",
    )


def usable_company(x: str) -> str:
    generic = ", ".join(lit(g) for g in V.GENERIC_COMPANY_NAMES)
    return let(
        strip(f"lower(coalesce({x}, ''))"), "uc", f"(uc <> '' AND uc NOT IN ({generic}) AND {n_words(squeeze('uc'))} <= 8)"
    )


def tidy_person(x: str) -> str:
    return f"CASE WHEN {usable_person(x)} THEN {squeeze(x)} END"


def tidy_role(x: str) -> str:
    return let(squeeze(x), "tr", "CASE WHEN tr <> '' AND length(tr) <= 80 THEN tr END")


def run_id(key: str) -> str:
    return f"'run_' || substr(sha256(cast({key} AS VARCHAR)), 1, 32)"


def role_exact(role_norm: str, buyers: str) -> str:
    return f"coalesce(len(list_filter({buyers}, lambda rb: contains({role_norm}, replace(rb, '_', ' ')))) > 0, false)"


def role_adjacent(role_norm: str) -> str:
    return "coalesce(" + " OR ".join(f"contains({role_norm}, {lit(w)})" for w in V.ADJACENT_ROLE_WORDS) + ", false)"


def filled(template: str, **slots: str) -> str:
    parts, rest = [], template
    for m in re.finditer(r"\{(\w+)\}", template):
        head = template[len(template) - len(rest) : m.start()]
        if head:
            parts.append(lit(head).replace("\n", "' || chr(10) || '"))
        parts.append(slots[m.group(1)])
        rest = template[m.end() :]
    if rest:
        parts.append(lit(rest).replace("\n", "' || chr(10) || '"))
    return "(" + " || ".join(parts) + ")"


CTE: dict[str, str] = {}


def parse(name: str, source: str) -> None:
    """CTEs that read person and company fields from ``text`` and ``url`` of a source CTE."""
    CTE[f"{name}_labels"] = f"""
      SELECT *, regexp_extract(text, {re2(V.PERSON_LABEL)}, 1) AS g_person,
        regexp_extract(text, {re2(V.ROLE_LABEL)}, 1) AS g_role,
        regexp_extract(text, {re2(V.ROLE_WORD_PATTERN)}, 1) AS g_word,
        regexp_extract(text, {re2(V.COMPANY_LABEL)}, 1) AS g_company,
        regexp_extract(text, {re2(V.COUNTRY_LABEL)}, 1) AS g_country,
        regexp_extract(text, {re2(V.EMPLOYEES_LABEL)}, 1) AS g_staff, {host('url')} AS h
      FROM {source}"""
    CTE[f"{name}_names"] = f"""
      SELECT *, CASE WHEN g_person <> '' THEN {strip('g_person')} END AS x_name,
        CASE WHEN g_role <> '' THEN {strip('g_role')} WHEN g_word <> '' THEN g_word END AS x_role,
        CASE WHEN g_company <> '' THEN {clean('g_company')} END AS labelled,
        {domain_company('url', 'h')} AS by_url,
        {norm("CASE WHEN g_country <> '' THEN g_country ELSE text END")} AS place_text
      FROM {name}_labels"""
    first_line = r"regexp_extract(text, '^[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*', 0)"
    CTE[name] = f"""
      SELECT * EXCLUDE (g_person, g_role, g_word, g_company, g_country, labelled, by_url, place_text, g_staff, x_name, x_role),
        coalesce(x_name, '') <> '' OR coalesce(x_role, '') <> '' AS p_any,
        CASE WHEN coalesce(x_name, '') <> '' OR coalesce(x_role, '') <> '' THEN x_name END AS p_name,
        CASE WHEN coalesce(x_name, '') <> '' OR coalesce(x_role, '') <> '' THEN x_role END AS p_role,
        c_name, CASE WHEN c_name IS NOT NULL THEN {website('text', 'url', 'h')} END AS c_site,
        CASE WHEN c_name IS NOT NULL THEN {country('place_text')} END AS c_country,
        CASE WHEN c_name IS NOT NULL THEN {as_number('g_staff')} END AS c_staff
      FROM (SELECT *, CASE WHEN length(nm) > 80 OR ({n_words('nm')}) > 8 THEN coalesce(by_url, {title_company(first_line)})
              ELSE nm END AS c_name
            FROM (SELECT *, coalesce(labelled, by_url) AS nm FROM {name}_names))"""


# ---------------------------------------------------------------- fixture views

CTE["v_briefs"] = """
SELECT c_custkey AS brief_id, c_nationkey, c_acctbal,
  concat('find ', cast(CASE WHEN c_custkey % 97 = 96 THEN 25 ELSE 1 + c_custkey % 5 END AS VARCHAR), ' leads',
    CASE c_custkey % 6 WHEN 0 THEN ' CTO' WHEN 1 THEN ' founder' WHEN 2 THEN ' head of engineering'
      WHEN 3 THEN ' technical recruiter' WHEN 4 THEN ' CEO or CTO' ELSE '' END,
    CASE c_nationkey % 6 WHEN 0 THEN ' in Spain' WHEN 1 THEN ' in France' WHEN 2 THEN ' in Germany'
      WHEN 3 THEN ' in Portugal' WHEN 4 THEN ' in the UK' ELSE '' END,
    CASE c_custkey % 4
      WHEN 0 THEN concat(' between ', cast(5 + c_custkey % 20 AS VARCHAR), ' and ', cast(60 + c_custkey % 90 AS VARCHAR), ' employees')
      WHEN 1 THEN concat(' under ', translate(cast(40 + c_custkey % 100 AS VARCHAR), '0123456789',
        CASE c_custkey % 5 WHEN 1 THEN '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669' WHEN 2 THEN '\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19'
          ELSE '0123456789' END), CASE WHEN c_custkey % 37 = 5 THEN '00000000' ELSE '' END, ' employees')
      WHEN 2 THEN concat(' over ', cast(10 + c_custkey % 50 AS VARCHAR), ' employees') ELSE '' END,
    CASE c_mktsegment WHEN 'MACHINERY' THEN ' for automation' WHEN 'BUILDING' THEN ' for genai'
      WHEN 'AUTOMOBILE' THEN ' for agentic workflow' WHEN 'FURNITURE' THEN ' with llm and software' ELSE '' END) AS user_text
FROM customer"""

CTE["v_terms"] = """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, p_name, p_brand, p_size, p_type,
    CASE s_nationkey % 5 WHEN 0 THEN 'Spain' WHEN 1 THEN 'France' WHEN 2 THEN 'Germany' WHEN 3 THEN 'Portugal'
      ELSE 'United Kingdom' END AS place,
    CASE l_partkey % 6 WHEN 0 THEN 'AI' WHEN 1 THEN 'GenAI' WHEN 2 THEN 'automation' WHEN 3 THEN 'AI agents'
      WHEN 4 THEN 'AI software' ELSE 'software company' END AS term
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey"""

CTE["v_results"] = """
SELECT *,
  CASE l_orderkey % 3
      WHEN 0 THEN concat('site:eu-startups.com/directory/ ', place, ' ', term, ' software')
      WHEN 1 THEN concat(place, ' startup ', term, ' software company')
      ELSE concat(place, ' cto ', term, ' software startup') END AS query,
  CASE l_suppkey % 8
    WHEN 0 THEN concat('https://www.eu-startups.com/directory/', replace(p_name, ' ', '-'), '-', cast(l_partkey AS VARCHAR), '/')
    WHEN 1 THEN concat('https://linkedin.com/company/', replace(p_name, ' ', '_'), cast(l_partkey AS VARCHAR))
    WHEN 2 THEN concat('https://x.com/', replace(p_name, ' ', ''), '/', cast(l_orderkey AS VARCHAR))
    WHEN 3 THEN concat('https://WWW.', replace(p_name, ' ', '_'), cast(l_suppkey AS VARCHAR), '.dev:8443/team')
    ELSE concat('https://www.', replace(p_name, ' ', ''), cast(l_suppkey AS VARCHAR), '.dev/blog/', cast(l_orderkey AS VARCHAR)) END AS url,
  concat(p_name, CASE l_linenumber % 3 WHEN 0 THEN ' | team' WHEN 1 THEN ' - top startups' ELSE ' news' END) AS title,
  concat(
    CASE l_partkey % 4 WHEN 0 THEN concat('Company: ', p_name, ' | ') WHEN 1 THEN concat('Company: ', p_name, '_', p_brand, ' | ')
      WHEN 2 THEN 'Company: a maker of many small and large parts for each and every buyer | ' ELSE '' END,
    CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('Persona: Eva ', cast(l_suppkey AS VARCHAR), ' | ')
      ELSE concat('Person: Ana ', cast(l_suppkey AS VARCHAR), ' | ') END,
    CASE l_linenumber % 6 WHEN 0 THEN 'Role: CTO | ' WHEN 1 THEN 'Role: Engineering Manager | ' WHEN 2 THEN 'Role: Director of Sales | '
      WHEN 3 THEN 'led by the founder | ' WHEN 4 THEN '' ELSE 'Role: Talent Lead | ' END,
    CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Country: Unknown | ' ELSE concat('Country: ', place, ' | ') END,
    CASE l_partkey % 5 WHEN 0 THEN '' ELSE concat('Employees: ', translate(cast(p_size * 3 AS VARCHAR), '0123456789',
      CASE l_suppkey % 7 WHEN 1 THEN '\u0660\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669' WHEN 2 THEN '\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19' ELSE '0123456789' END),
      CASE WHEN l_suppkey % 41 = 3 THEN '000000000' ELSE '' END, ' | ') END,
    CASE l_suppkey % 4 WHEN 0 THEN 'see https://site.example.com/a). GenAI automation' WHEN 1 THEN 'agentic workflow'
      WHEN 2 THEN 'machine learning engineering' ELSE 'parts' END) AS snippet
FROM v_terms"""

CTE["v_evidence"] = """
SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY query ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS rank
  FROM v_results)
WHERE rank = 0 OR NOT (query LIKE '%AI agents software' OR query LIKE '%startup automation software company'
  OR query LIKE '%cto AI software startup')"""

CTE["v_pages"] = """
SELECT url, min(concat(p_type, ' page | Employees: ', cast(p_size * 3 AS VARCHAR), ' | Country: ', place, ' | Role: ',
  CASE WHEN p_size > 25 THEN 'CTO' ELSE 'Founder' END, ' | AI engineering automation https://', replace(p_name, ' ', ''),
  '.example.org/about.')) AS page_text
FROM v_results WHERE l_linestatus = 'O' GROUP BY url"""

# ---------------------------------------------------------------- requests and queries


def _number(pattern: str, group: int = 1) -> str:
    return as_number(f"regexp_extract(user_text, {re2(pattern)}, {group})")


CTE["r_read"] = f"""
SELECT *, {norm('user_text')} AS n,
  coalesce({_number(V.COUNT_PATTERN)}, {_number(V.ANY_NUMBER_PATTERN)}) AS counted,
  {_number(V.SIZE_RANGE_PATTERN)} AS low, {_number(V.SIZE_RANGE_PATTERN, 2)} AS high,
  {_number(V.SIZE_MIN_PATTERN)} AS over_n, {_number(V.SIZE_MAX_PATTERN)} AS under_n,
  {uniq(not_null(f"list_transform(regexp_extract_all(user_text, {re2(V.ROLE_WORD_PATTERN)}, 1), lambda rw: {case_of('lower(rw)', V.BUYER_ALIASES)})"))} AS found_buyers
FROM v_briefs"""

CTE["req_all"] = f"""
SELECT brief_id, c_nationkey, c_acctbal, user_text, n, 'req_' || substr(sha256(cast(brief_id AS VARCHAR)), 1, 32) AS request_id,
  coalesce(nullif(counted, 0), 3) AS target_count, {country('n')} AS country,
  coalesce(low, over_n) AS min_size, CASE WHEN low IS NOT NULL THEN high ELSE under_n END AS max_size,
  CASE WHEN len(found_buyers) > 0 THEN found_buyers ELSE {lits(V.DEFAULT_BUYERS)} END AS buyers,
  {let(themes_in('n', {**V.THEME_ALIASES, **V.EXTRA_BRIEF_THEMES}), 'ft', f'CASE WHEN len(ft) > 0 THEN ft ELSE {lits(V.DEFAULT_THEMES)} END')} AS themes
FROM r_read"""

CTE["req"] = """SELECT * FROM req_all WHERE target_count BETWEEN 1 AND 20
  AND coalesce(min_size BETWEEN 1 AND 100000, true) AND coalesce(max_size BETWEEN 1 AND 100000, true)"""


def _terms_case() -> str:
    return "CASE t " + " ".join(f"WHEN {lit(k)} THEN {lits(v)}" for k, v in V.THEME_TERMS.items()) + " END"


def _country_case(pick) -> str:
    return "CASE coalesce(country, 'es') " + " ".join(f"WHEN {lit(k)} THEN {pick(v)}" for k, v in V.COUNTRY_TERMS.items()) + " END"


CTE["relaxed"] = f"""
SELECT req.*, stage,
  {uniq(f"flatten(list_transform(list_concat(list_concat(themes, CASE WHEN stage >= 1 AND NOT list_contains(themes, 'software company') THEN ['software company'] ELSE [] END), CASE WHEN stage >= 2 AND NOT list_contains(themes, 'automation') THEN ['automation'] ELSE [] END)[1:3], lambda t: {_terms_case()}))")}[1:3] AS terms,
  {_country_case(lambda v: lit(v[0]))} AS c,
  {_country_case(lambda v: lits([x for x in v if x in V.CITIES][:2]) + '::VARCHAR[]')} AS cities,
  CASE WHEN max_size IS NOT NULL THEN 'under ' || max_size || ' employees' WHEN min_size IS NOT NULL THEN 'over ' || min_size || ' employees' END AS hint,
  list_transform(buyers[1:2], lambda b: replace(b, '_', ' ')) AS two_buyers
FROM req, (VALUES (0), (1), (2)) s(stage)"""

_per_term = "[" + ", ".join(
    filled(t, country="c", term="t") for t in V.TERM_TEMPLATES
) + f", CASE WHEN hint IS NOT NULL THEN {filled(V.SIZED_TERM_TEMPLATE, country='c', term='t', hint='hint')} END]"
_per_city = "[" + ", ".join(filled(t, city="y") for t in V.CITY_TEMPLATES) + "]"
_stage = {s: "[" + ", ".join(filled(t, country="c") for t in ts) + "]" for s, ts in V.STAGE_TEMPLATES.items()}
CTE["query_lists"] = f"""
SELECT * EXCLUDE (raw), {uniq_norm('raw')} AS qs FROM (
  SELECT *, flatten([
    flatten(list_transform(terms, lambda t: {not_null(_per_term)})),
    flatten(list_transform(cities, lambda y: {_per_city})),
    flatten(list_transform(two_buyers, lambda b: list_transform(terms[1:2], lambda t: {filled(V.BUYER_TEMPLATE, country='c', buyer='b', term='t')}))),
    CASE WHEN stage >= 1 THEN {_stage[1]} ELSE []::VARCHAR[] END,
    CASE WHEN stage >= 2 THEN {_stage[2]} ELSE []::VARCHAR[] END]) AS raw
  FROM relaxed)"""
CTE["cand"] = """
SELECT * EXCLUDE (qs, terms, cities, two_buyers, hint, c), unnest(qs) AS query, cast(generate_subscripts(qs, 1) - 1 AS INTEGER) AS pos
FROM query_lists"""
CTE["work"] = "SELECT * EXCLUDE (stage) FROM cand WHERE stage = 0"

# ---------------------------------------------------------------- evidence and selection

CTE["ev"] = "SELECT query, rank, url, title, snippet FROM v_evidence WHERE rank < 5"
CTE["ev_text"] = f"""
SELECT *, title || ' ' || snippet AS text FROM ev WHERE {host('url')} NOT IN ({', '.join(lit(s) for s in V.SOCIAL_HOSTS)})"""
parse("ev_parsed", "ev_text")
CTE["ev_facts"] = f"""
SELECT *, {themes_in(norm('text'))} AS hits, CASE WHEN p_role IS NOT NULL THEN {norm('p_role')} END AS role_norm FROM ev_parsed"""
CTE["scored"] = f"""
SELECT *, CASE WHEN c_name IS NULL THEN -100 ELSE 20
    + CASE WHEN {role_exact('role_norm', 'buyers')} THEN 20 WHEN {role_adjacent('role_norm')} THEN 10 ELSE 0 END
    + CASE WHEN c_country = country THEN 15 ELSE 0 END + CASE WHEN c_staff IS NOT NULL THEN 10 ELSE 0 END
    + least(len(sig) * 8, 16) + 4 + CASE WHEN coalesce(p_name, '') <> '' THEN 8 ELSE 0 END END AS score
FROM (SELECT work.*, ev_facts.* EXCLUDE (query), {signals('themes', 'hits')} AS sig FROM work JOIN ev_facts USING (query))"""
CTE["best_row"] = """
SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY brief_id, pos ORDER BY score DESC, rank) = 1"""
CTE["item_lists"] = """
SELECT brief_id, pos, list({'url': url, 'title': title, 'snippet': snippet} ORDER BY rank) AS items FROM scored GROUP BY ALL"""
CTE["chosen"] = """
SELECT b.brief_id, b.pos, b.url, b.title, b.snippet, b.themes, coalesce(page_text, '') AS page_text, items,
  b.title || ' ' || b.snippet || ' ' || coalesce(page_text, '') AS text,
  array_to_string(list_transform(items[1:2], lambda i: i.title || ' ' || i.snippet), ' ') AS lead_text
FROM best_row b JOIN item_lists USING (brief_id, pos) LEFT JOIN v_pages ON b.url = v_pages.url"""
parse("chosen_parsed", "chosen")
CTE["doss"] = f"""
SELECT work.*, CASE WHEN d.c_name IS NULL THEN 'NO_CANDIDATE' ELSE 'FOUND' END AS sourcing_status, query AS query_used,
  CASE WHEN d.c_name IS NOT NULL THEN d.p_name END AS full_name, CASE WHEN d.c_name IS NOT NULL THEN d.p_role END AS role_title,
  d.c_name AS company_name, d.c_site AS website, d.c_country AS country_code, d.c_staff AS employee_estimate,
  CASE WHEN d.c_name IS NOT NULL THEN {signals('work.themes', 'd.hits')} ELSE [] END AS fit,
  CASE WHEN d.brief_id IS NULL THEN [] WHEN d.c_name IS NULL THEN d.items[1:2]
    ELSE list_concat([{{'url': d.url, 'title': d.title, 'snippet': d.snippet}}], list_filter(d.items, lambda i: i.url <> d.url)[1:1]) END AS evidence,
  CASE WHEN d.brief_id IS NULL THEN ['{V.NOTE_NO_RESULT}'] WHEN d.c_name IS NULL THEN ['{V.NOTE_NO_COMPANY}']
    ELSE ['query_used=' || query, '{V.NOTE_HEURISTIC}'] END AS notes,
  d.items
FROM work LEFT JOIN (
  SELECT * EXCLUDE (c_name, c_site, c_country, c_staff), coalesce(c_name, tc) AS c_name,
    CASE WHEN c_name IS NULL THEN {website('page_text', 'url', 'h')} ELSE c_site END AS c_site,
    CASE WHEN c_name IS NULL THEN {country(norm('text'))} ELSE c_country END AS c_country, c_staff,
    {themes_in(norm("lead_text || ' ' || text"))} AS hits
  FROM (SELECT *, {title_company('title')} AS tc FROM chosen_parsed)) d
ON work.brief_id = d.brief_id AND work.pos = d.pos"""


def flat(source: str, *extra: str) -> str:
    more = "".join(f"{e}, " for e in extra)
    return f"""SELECT brief_id, pos, {more}sourcing_status, query_used, full_name, role_title, company_name, website, country_code,
      employee_estimate, array_to_string(fit, '; ') AS fit_signals,
      array_to_string(list_transform(evidence, lambda e: e.url), ' ') AS evidence_urls, array_to_string(notes, '; ') AS notes
      FROM {source}"""


# ---------------------------------------------------------------- decisions


def texts(*pairs: tuple[str, str]) -> str:
    return not_null("[" + ", ".join(f"CASE WHEN {c} THEN {lit(t)} END" for c, t in pairs) + "]")


def decide(name: str, source: str) -> None:
    role = f"CASE WHEN role_title IS NOT NULL THEN {norm('role_title')} END"
    R = V.REASONS
    CTE[f"{name}_checks"] = f"""
SELECT *, q_exact AS k_exact, (NOT q_exact AND q_adj0) AS k_adj,
  coalesce(country_code = country, false) AS k_country,
  (country IS NOT NULL AND country_code IS NOT NULL AND country_code <> country) AS k_cmiss,
  (country IS NOT NULL AND country_code IS NULL) AS k_cunk,
  ((min_size IS NOT NULL OR max_size IS NOT NULL) AND employee_estimate IS NULL) AS k_sunk,
  (coalesce(employee_estimate < min_size, false) OR coalesce(employee_estimate > max_size, false)) AS k_smiss,
  len(evidence) AS k_ev, coalesce(full_name, '') <> '' AS k_named
FROM (SELECT *, {role_exact(role, 'buyers')} AS q_exact, {role_adjacent(role)} AS q_adj0 FROM {source})"""
    CTE[f"{name}_scored"] = f"""
SELECT *, ((min_size IS NOT NULL OR max_size IS NOT NULL) AND employee_estimate IS NOT NULL AND NOT k_smiss) AS k_size,
  cast(least(100, CASE WHEN k_exact THEN 30 WHEN k_adj THEN 15 ELSE 0 END + CASE WHEN k_country THEN 20 ELSE 0 END
    + CASE WHEN (min_size IS NOT NULL OR max_size IS NOT NULL) AND employee_estimate IS NOT NULL AND NOT k_smiss THEN 20 ELSE 0 END
    + least(len(fit) * 10, 20) + CASE WHEN k_named THEN 5 ELSE 0 END
    + CASE WHEN k_ev >= 2 THEN 15 WHEN k_ev = 1 THEN 5 ELSE 0 END) AS INTEGER) AS points
FROM {name}_checks"""
    CTE[f"{name}_texts"] = f"""
SELECT *, {texts(('k_exact', R['role_exact']), ('k_adj', R['role_adjacent']), ('NOT k_exact AND NOT k_adj', R['role_none']),
    ('k_country', R['country_match']), ('k_cunk', R['country_unknown']), ('k_sunk', R['size_unknown']), ('k_size', R['size_match']),
    ('len(fit) > 0', R['signals']), ('k_named', R['named']), ('k_ev >= 2', R['many_urls']), ('k_ev = 1', R['one_url']))} AS rs,
  {texts(('k_cmiss', V.MISS_COUNTRY), ('k_smiss', V.MISS_SIZE))} AS hard,
  {texts(('k_cunk', V.MISS_COUNTRY), ('k_sunk', V.MISS_SIZE))} AS unk,
  {texts(('NOT k_exact', V.MISS_PERSONA))} AS near
FROM {name}_scored"""
    CTE[f"{name}_ruled"] = f"""
SELECT *, CASE WHEN company_name IS NULL THEN 'none' WHEN len(hard) > 0 THEN 'hard_miss' WHEN k_ev < 2 AND points >= 35 THEN 'enrich'
  WHEN len(unk) > 0 AND points >= 55 THEN 'unknown_close' WHEN len(unk) > 0 THEN 'unknown_reject'
  WHEN points >= 70 AND len(near) = 0 THEN 'accept' WHEN points >= 55 THEN 'close' ELSE 'weak' END AS rule
FROM {name}_texts"""
    CTE[name] = f"""
SELECT *, CASE rule WHEN 'enrich' THEN 'ENRICH' WHEN 'accept' THEN 'ACCEPT' WHEN 'close' THEN 'REJECT_CLOSE_MATCH'
    WHEN 'unknown_close' THEN 'REJECT_CLOSE_MATCH' ELSE 'REJECT' END AS outcome,
  CASE rule WHEN 'accept' THEN 'exact' WHEN 'close' THEN 'close_match' WHEN 'unknown_close' THEN 'close_match' END AS match_type,
  CASE WHEN rule = 'none' THEN 0 ELSE points END AS score,
  CASE WHEN rule = 'none' THEN {lit(V.NO_DOSSIER_SUMMARY)} ELSE {case_of('rule', V.SUMMARIES)} END AS summary,
  CASE WHEN rule <> 'none' THEN coalesce(nullif(role_title, ''), 'unknown') END AS type,
  CASE WHEN rule <> 'none' THEN coalesce(country_code, country, 'unknown') END AS region,
  CASE rule WHEN 'none' THEN [{lit(V.NO_DOSSIER_REASON)}]
    WHEN 'hard_miss' THEN list_concat(rs, list_transform(hard, lambda m: 'hard miss: ' || m))
    WHEN 'enrich' THEN list_concat(rs, list_transform(unk, lambda m: 'missing evidence: ' || m))
    WHEN 'unknown_reject' THEN list_concat(rs, list_transform(unk, lambda m: 'missing hard proof: ' || m)) ELSE rs END AS reasons,
  CASE WHEN rule IN ('close', 'unknown_close') THEN {lit(V.CLOSE_MATCH_SUMMARY)} END AS close_summary,
  CASE WHEN rule IN ('close', 'unknown_close') THEN
    CASE WHEN len(near) + len(unk) > 0 THEN list_concat(near, unk) ELSE [{lit(V.NO_MISS_NAMED)}] END END AS missed,
  CASE WHEN rule IN ('close', 'unknown_close') THEN rs END AS close_reasons,
  {run_id('brief_id')} AS run_id, pos + 1 AS idx
FROM {name}_ruled"""


decide("decided", "doss")
CTE["lead_rows"] = f"""
SELECT *, 'lead_' || substr(sha256(run_id || chr(31) || cast(idx AS VARCHAR)), 1, 32) AS lead_id,
  {tidy_person('full_name')} AS person_name, {tidy_role('role_title')} AS tidy_role FROM decided WHERE outcome = 'ACCEPT'"""
CTE["short_rows"] = f"""
SELECT 'short_' || substr(run_id, 5) AS shortlist_id, run_id, brief_id, company_name, {tidy_person('full_name')} AS person_name,
  summary, missed, type, cast(row_number() OVER (PARTITION BY run_id ORDER BY idx) AS INTEGER) AS option_number
FROM decided WHERE outcome = 'REJECT_CLOSE_MATCH' QUALIFY option_number <= {V.SHORTLIST_SIZE}"""
CTE["reject_rows"] = """
SELECT run_id, idx, coalesce(nullif(company_name, ''), nullif(query_used, ''), 'candidate') AS candidate_key, company_name,
  query_used, outcome FROM decided WHERE outcome <> 'ACCEPT'"""
CTE["runs"] = f"""
SELECT run_id, brief_id, target_count, accepted, least(closes, {V.SHORTLIST_SIZE}) AS shortlisted, used FROM (
  SELECT run_id, brief_id, target_count, count(*) FILTER (WHERE outcome = 'ACCEPT') AS accepted,
    count(*) FILTER (WHERE outcome = 'REJECT_CLOSE_MATCH') AS closes, count(*) AS used
  FROM decided GROUP BY ALL)"""
CTE["ended_runs"] = """
SELECT *, CASE WHEN accepted >= target_count OR used >= 11 THEN
    CASE WHEN accepted > 0 OR shortlisted > 0 THEN 'completed' ELSE 'no_result' END ELSE 'running' END AS status,
  CASE WHEN accepted >= target_count THEN 'target_count_reached'
    WHEN used >= 11 AND shortlisted > 0 THEN 'budget_exhausted_with_shortlist'
    WHEN used >= 11 THEN 'budget_exhausted_without_results' END AS completed_reason FROM runs"""

# ---------------------------------------------------------------- second searches

_hints = "company_name || ' ' || replace(buyers[1], '_', ' ') || ' ' || coalesce(country, country_code, 'spain') || ' ' || "
_topics = "CASE WHEN len(fit) > 0 THEN fit ELSE themes END[1:2]".replace("END[1:2]", "END")
CTE["thin"] = f"""
SELECT *, {strip(_hints + f"array_to_string(({_topics})[1:2], ' ')")} AS follow_query,
  {strip(_hints + f"array_to_string(({_topics})[1:2], '  ')")} AS enrich_query
FROM doss WHERE company_name IS NOT NULL"""
CTE["asked"] = """
SELECT query, min(company_name) AS nm, min(known) AS known FROM (
  SELECT unnest([follow_query, enrich_query]) AS query, company_name, evidence[1].url AS known FROM thin WHERE len(evidence) < 2)
GROUP BY query"""
CTE["second"] = """
SELECT query, 0 AS rank, known AS url, 'known page' AS title, 'seen before' AS snippet FROM asked
UNION ALL SELECT query, 1, 'https://other.example.org/list', 'other page', 'Person: Otto Other | Employees: 7' FROM asked
UNION ALL SELECT query, 2, 'https://extra.example.org/' || replace(nm, ' ', '-'), 'extra page',
  nm || ' | Person: Eva Extra | Role: CTO | Country: Spain | Employees: 42' FROM asked"""
CTE["follow_hits"] = f"""
SELECT t.brief_id, t.pos, s.rank, s.url, s.title, s.snippet, s.title || ' ' || s.snippet || ' ' || coalesce(page_text, '') AS text
FROM thin t JOIN second s ON t.follow_query = s.query LEFT JOIN v_pages p ON s.url = p.url
WHERE len(t.evidence) < 2 AND NOT list_contains(list_transform(t.evidence, lambda e: e.url), s.url)
  AND {host('s.url')} NOT IN ({', '.join(lit(s) for s in V.SOCIAL_HOSTS)})
  AND contains(lower(s.title || ' ' || s.snippet || ' ' || coalesce(page_text, '')), lower(t.company_name))
QUALIFY row_number() OVER (PARTITION BY t.brief_id, t.pos ORDER BY s.rank) = 1"""
parse("follow_parsed", "follow_hits")
_no_person = "(coalesce(d.full_name, '') = '' AND coalesce(d.role_title, '') = '')"
CTE["followed"] = f"""
SELECT brief_id, pos, sourcing_status, query_used, full_name, role_title, company_name, website, country_code, employee_estimate,
  CASE WHEN added AND len(new_fit) > 0 THEN new_fit ELSE fit END AS fit, ev2 AS evidence,
  CASE WHEN added THEN list_append(notes, 'follow_up_query=' || follow_query) ELSE notes END AS notes, follow_ups
FROM (SELECT *, {signals('themes', themes_in(norm("array_to_string(list_transform(ev2, lambda e: e.title || ' ' || e.snippet), ' ')")))} AS new_fit FROM (
  SELECT d.* EXCLUDE (full_name, role_title, website, country_code, employee_estimate),
    f.brief_id IS NOT NULL AS added, t.follow_query,
    CASE WHEN d.company_name IS NOT NULL AND len(d.evidence) < 2 THEN 1 ELSE 0 END AS follow_ups,
    CASE WHEN {_no_person} AND f.p_any AND {usable_person('f.p_name')} THEN f.p_name ELSE d.full_name END AS full_name,
    CASE WHEN {_no_person} AND f.p_any AND {usable_person('f.p_name')} THEN f.p_role ELSE d.role_title END AS role_title,
    coalesce(d.website, f.c_site) AS website, coalesce(d.country_code, f.c_country) AS country_code,
    coalesce(d.employee_estimate, f.c_staff) AS employee_estimate,
    CASE WHEN f.brief_id IS NOT NULL THEN list_append(d.evidence, {{'url': f.url, 'title': f.title, 'snippet': f.snippet}}) ELSE d.evidence END AS ev2
  FROM doss d LEFT JOIN thin t USING (brief_id, pos) LEFT JOIN follow_parsed f USING (brief_id, pos)))"""

CTE["asking"] = """
SELECT t.* FROM thin t JOIN decided USING (brief_id, pos) WHERE outcome = 'ENRICH'"""
CTE["enrich_rows"] = f"""
SELECT brief_id, pos, generate_subscripts(evidence, 1) - 100 AS ord, unnest(evidence).url AS url, unnest(evidence).title AS title,
  unnest(evidence).snippet AS snippet, '' AS page_text FROM asking
UNION ALL SELECT a.brief_id, a.pos, s.rank, s.url, s.title, s.snippet, coalesce(page_text, '')
FROM asking a JOIN second s ON a.enrich_query = s.query LEFT JOIN v_pages p ON s.url = p.url
WHERE NOT list_contains(list_transform(a.evidence, lambda e: e.url), s.url)"""
CTE["enrich_text"] = f"SELECT *, title || ' ' || snippet || ' ' || substr(page_text, 1, {V.EXCERPT_CHARS}) AS text FROM enrich_rows"
parse("enrich_parsed", "enrich_text")
CTE["enrich_found"] = """
SELECT brief_id, pos, list({'url': url, 'title': title, 'snippet': snippet} ORDER BY ord) AS all_ev,
  arg_min(p_name, ord) FILTER (WHERE p_any) AS n1, arg_min({'r': p_role}, ord) FILTER (WHERE p_any) AS r1,
  arg_min(c_site, ord) FILTER (WHERE c_site IS NOT NULL) AS s1, arg_min(c_country, ord) FILTER (WHERE c_country IS NOT NULL) AS c1,
  arg_min(c_staff, ord) FILTER (WHERE c_staff IS NOT NULL) AS e1,
  arg_min({'n': p_name}, ord) FILTER (WHERE p_any) AS n0
FROM enrich_parsed GROUP BY ALL"""
CTE["enriched"] = f"""
SELECT brief_id, pos, 'FOUND' AS sourcing_status, enrich_query AS query_used, full_name, role_title, company_name, website, country_code,
  employee_estimate, CASE WHEN len(new_fit) > 0 THEN new_fit ELSE fit END AS fit,
  all_ev[1:greatest(len(evidence) + 2, 2)] AS evidence, list_append(notes, 'enrichment_query=' || enrich_query) AS notes
FROM (SELECT d.* EXCLUDE (full_name, role_title, website, country_code, employee_estimate), f.all_ev,
    CASE WHEN {_no_person} AND f.n0 IS NOT NULL THEN f.n0.n ELSE d.full_name END AS full_name,
    CASE WHEN {_no_person} AND f.n0 IS NOT NULL THEN f.r1.r ELSE d.role_title END AS role_title,
    coalesce(d.website, f.s1) AS website, coalesce(d.country_code, f.c1) AS country_code, coalesce(d.employee_estimate, f.e1) AS employee_estimate,
    {signals('d.themes', themes_in(norm("array_to_string(list_transform(f.all_ev, lambda e: e.title || ' ' || e.snippet), ' ')")))} AS new_fit
  FROM asking d JOIN enrich_found f USING (brief_id, pos))"""

CTE["gap_text"] = "SELECT *, title || ' ' || snippet AS text FROM ev"
parse("gap_parsed", "gap_text")
CTE["gap_found"] = """
SELECT query, arg_min({'n': p_name, 'r': p_role}, rank) FILTER (WHERE p_any) AS p1,
  arg_min(c_site, rank) FILTER (WHERE c_site IS NOT NULL) AS s1, arg_min(c_country, rank) FILTER (WHERE c_country IS NOT NULL) AS c1,
  arg_min(c_staff, rank) FILTER (WHERE c_staff IS NOT NULL) AS e1 FROM gap_parsed GROUP BY query"""
CTE["gap_filled"] = f"""
SELECT d.* EXCLUDE (full_name, role_title, website, country_code, employee_estimate),
  CASE WHEN {_no_person} AND p1 IS NOT NULL THEN p1.n ELSE d.full_name END AS full_name,
  CASE WHEN {_no_person} AND p1 IS NOT NULL THEN p1.r ELSE d.role_title END AS role_title,
  coalesce(d.website, s1) AS website, coalesce(d.country_code, c1) AS country_code, coalesce(d.employee_estimate, e1) AS employee_estimate
FROM doss d JOIN gap_found USING (query) WHERE company_name IS NOT NULL"""

# ---------------------------------------------------------------- external claims

CTE["claims"] = """
SELECT *, CASE n4 % 5 WHEN 1 THEN 'acme_labs directory' WHEN 2 THEN 'source{d}' WHEN 3 THEN 'AI'
    ELSE 'one two three four five six seven eight nine' END AS claim_name,
  CASE n4 % 4 WHEN 0 THEN NULL WHEN 1 THEN 'The ' || coalesce(company_name, 'x') || ' startup' ELSE 'Acme {0}' END AS claim_person,
  CASE WHEN n4 % 2 = 0 THEN list_filter(list_reverse(items), lambda i: true) ELSE [] END AS picked
FROM (SELECT *, brief_id + pos AS n4 FROM doss WHERE items IS NOT NULL) WHERE n4 % 5 <> 0"""
CTE["support"] = """
SELECT *, CASE WHEN len(picked) > 0 THEN list_transform(picked, lambda u: list_filter(items, lambda i: i.url = u.url)[-1])
  WHEN len(evidence) > 0 THEN evidence ELSE items[1:1] END AS sup FROM claims"""
CTE["support_text"] = """
SELECT s.brief_id, s.pos, s.ord, s.e.url AS url, s.e.title || ' ' || s.e.snippet || ' ' || coalesce(page_text, '') AS text
FROM (SELECT brief_id, pos, unnest(sup) AS e, generate_subscripts(sup, 1) AS ord FROM support) s LEFT JOIN v_pages p ON s.e.url = p.url"""
parse("support_parsed", "support_text")
CTE["support_all"] = """
SELECT brief_id, pos, array_to_string(list(text ORDER BY ord), ' ') AS all_text,
  arg_min(c_staff, ord) FILTER (WHERE c_staff IS NOT NULL) AS staff FROM support_parsed GROUP BY ALL"""
CTE["grounded_1"] = f"""
SELECT s.*, a.all_text, a.staff, s.sup[1].url AS url1, {host('s.sup[1].url')} AS h1,
  CASE WHEN cn IS NOT NULL AND ({n_words('cn')}) <= 8 AND NOT contains(claim_name, '{{') THEN cn ELSE company_name END AS g_name,
  CASE WHEN claim_person IS NOT NULL AND contains(a.all_text, claim_person) THEN true ELSE false END AS own_person
FROM (SELECT *, {clean('claim_name')} AS cn FROM support) s JOIN support_all a USING (brief_id, pos)"""
CTE["grounded"] = f"""
SELECT brief_id, pos, 'FOUND' AS sourcing_status, query AS query_used,
  CASE WHEN {usable_person('gp')} THEN gp END AS full_name, CASE WHEN {usable_person('gp')} THEN gr END AS role_title,
  g_name AS company_name,
  CASE WHEN NOT ({' OR '.join(f"ends_with(h1, {lit(x)})" for x in V.NO_WEBSITE_HOST_SUFFIXES)}) THEN coalesce({website('all_text', 'url1', 'h1')}, website) END AS website,
  coalesce({country(norm('all_text'))}, CASE WHEN company_name IS NOT NULL THEN country_code ELSE 'pt' END) AS country_code,
  coalesce(staff, employee_estimate) AS employee_estimate,
  CASE WHEN len(own_fit) > 0 THEN own_fit WHEN len(fit) > 0 THEN fit
    ELSE {signals('themes', themes_in(norm("array_to_string(list_transform(items, lambda i: i.title || ' ' || i.snippet), ' ')")))} END AS fit,
  sup AS evidence, ['query_used=' || query, '{V.NOTE_EXTERNAL}'] AS notes
FROM (SELECT *, CASE WHEN own_person THEN claim_person ELSE full_name END AS gp, CASE WHEN own_person THEN 'Founder' ELSE role_title END AS gr,
    list_filter(CASE WHEN n4 % 3 = 0 THEN ['automation', 'genai'] ELSE ['moon'] END, lambda x: list_contains(themes, x)) AS own_fit FROM grounded_1)
WHERE {usable_company('g_name')}"""

# ---------------------------------------------------------------- memory

CTE["old_memory"] = f"""
SELECT DISTINCT kind, value FROM (
  SELECT '{V.VISITED_URLS}' AS kind, url AS value FROM v_results WHERE l_returnflag = 'R'
  UNION ALL SELECT '{V.QUERY_HISTORY}', query FROM v_results WHERE l_returnflag = 'R')"""
CTE["new_memory"] = f"""
SELECT '{V.QUERY_HISTORY}' AS kind, query_used AS value, idx FROM decided
UNION ALL SELECT '{V.COMPANY_NAMES}', company_name, idx FROM decided WHERE company_name IS NOT NULL
UNION ALL SELECT '{V.LEAD_NAMES}', person_name, idx FROM lead_rows WHERE person_name IS NOT NULL
UNION ALL SELECT '{V.VISITED_URLS}', unnest(list_transform(evidence, lambda e: e.url)), idx FROM decided"""
CTE["all_memory"] = f"""
SELECT 'global' AS scope, kind, value, CASE kind WHEN '{V.QUERY_HISTORY}' THEN {norm('value')} WHEN '{V.COMPANY_NAMES}' THEN lower(value)
  ELSE value END AS value_norm, cast(min(seen) AS BIGINT) AS first_seen
FROM (SELECT kind, value, 0 AS seen FROM old_memory UNION ALL SELECT kind, value, idx FROM new_memory) GROUP BY kind, value"""


def sql(final: str) -> str:
    """Prefix a final SELECT with the CTEs it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_one(name)

    def visit_one(name: str) -> None:
        for other in CTE:
            if other != name and other not in order and re.search(rf"\b{other}\b", CTE[name]):
                visit_one(other)
        if name not in order:
            order.append(name)

    visit(final)
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in order)
    return f"WITH {heads}\n{final}" if order else final


ORACLES: dict[str, str] = {}


def oracle(name: str, final: str) -> None:
    ORACLES[name] = sql(final)


_page_text = (
    f"{squeeze('regexp_replace(regexp_replace(regexp_replace(html, ' + lit('(?is)<script.*?</script>') + ', ' + lit(' ') + ', ' + lit('g') + '), ' + lit('(?is)<style.*?</style>') + ', ' + lit(' ') + ', ' + lit('g') + '), ' + lit('<[^>]+>') + ', ' + lit(' ') + ', ' + lit('g') + ')')}"
)
oracle(
    "html_text",
    f"""SELECT page_id, page_text, {norm('page_text')} AS normalized, substr(page_text, 1, {V.EXCERPT_CHARS}) AS excerpt
    FROM (SELECT page_id, {_page_text} AS page_text FROM pages)""",
)
oracle(
    "page_hosts",
    f"""SELECT page_id, url_host, url_host NOT IN ({', '.join(lit(s) for s in V.SOCIAL_HOSTS)}) AS usable,
    {domain_company('url', 'url_host')} AS company_name, {website('html', 'url', 'url_host')} AS website
    FROM (SELECT *, {host('url')} AS url_host FROM pages)""",
)
oracle(
    "page_titles",
    f"""SELECT page_id, title, {title_company('title')} AS company_name
    FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)""",
)
oracle(
    "theme_signals_docs",
    f"""SELECT doc_id, array_to_string({themes_in('n', {**V.THEME_ALIASES, **V.EXTRA_BRIEF_THEMES})}, '; ') AS themes,
    array_to_string({themes_in('n')}, '; ') AS hits FROM (SELECT doc_id, {norm('text')} AS n FROM documents)""",
)
oracle(
    "usable_values",
    f"""SELECT value, {usable_company('value')} AS company_ok, {usable_person('value')} AS person_ok,
    {tidy_person('value')} AS person_name, {tidy_role('value')} AS role_title, {clean('value')} AS company_name
    FROM (SELECT text AS value FROM conversations UNION ALL SELECT p_name || ' ' || p_type FROM part UNION ALL SELECT text FROM benchmark)""",
)
oracle(
    "suggested_queries",
    f"""SELECT conv_id, cast(generate_subscripts(qs, 1) - 1 AS INTEGER) AS pos, unnest(qs) AS query FROM (
      SELECT conv_id, {uniq("list_filter(list_transform(l, lambda v: " + squeeze('v') + "), lambda v: length(v) >= 10)")}[1:6] AS qs
      FROM (SELECT conv_id, list(text ORDER BY turn, text) AS l FROM conversations GROUP BY conv_id))""",
)
oracle(
    "brief_quarantine",
    """SELECT brief_id, CASE WHEN e = 'ok' THEN user_text END AS user_text,
      CASE WHEN e = 'ok' AND c_nationkey = 1 THEN 'r-1' END AS request_id, e AS error
    FROM (SELECT *, CASE c_nationkey WHEN 0 THEN 'unknown field: unexpected' WHEN 3 THEN 'meta must be an object'
      WHEN 4 THEN 'request_id must be a string' WHEN 6 THEN 'meta must be an object' WHEN 7 THEN 'unknown field: alpha,zeta'
      WHEN 10 THEN 'user_text must be a string' WHEN 11 THEN 'user_text must not be empty' WHEN 12 THEN 'not a JSON object'
      WHEN 13 THEN 'user_text must be a string' WHEN 14 THEN 'not a JSON object' WHEN 15 THEN 'user_text must be a string'
      ELSE 'ok' END AS e FROM v_briefs)""",
)
oracle(
    "brief_constraints",
    f"""SELECT brief_id, request_id, target_count, country AS preferred_country, CASE WHEN country = 'es' THEN 'eu' ELSE '' END AS preferred_regions,
      min_size AS min_company_size, max_size AS max_company_size,
      array_to_string({not_null("[CASE WHEN country IS NOT NULL THEN 'preferred_country' END, CASE WHEN min_size IS NOT NULL OR max_size IS NOT NULL THEN 'company_size' END]")}, '; ') AS hard_constraints,
      'named_person' AS relaxable_constraints,
      CASE WHEN target_count NOT BETWEEN 1 AND 20 THEN 'target_count out of range' WHEN min_size NOT BETWEEN 1 AND 100000 THEN 'min_company_size out of range'
        WHEN max_size NOT BETWEEN 1 AND 100000 THEN 'max_company_size out of range' END AS error
    FROM req_all""",
)
oracle(
    "brief_targets",
    "SELECT brief_id, user_text, array_to_string(buyers, '; ') AS buyer_targets, array_to_string(themes, '; ') AS search_themes FROM req_all",
)
_has = "(c_acctbal > 0 AND c_nationkey % 5 <> 4)"
_hard0 = not_null(
    "[CASE WHEN country IS NOT NULL THEN 'preferred_country' END, CASE WHEN min_size IS NOT NULL OR max_size IS NOT NULL THEN 'company_size' END]"
)
oracle(
    "repaired_requests",
    f"""SELECT brief_id,
      CASE WHEN has AND c_nationkey % 3 = 2 THEN 'ext-' || brief_id ELSE request_id END AS request_id,
      CASE WHEN has THEN 2 ELSE target_count END AS target_count, ctry AS preferred_country,
      CASE WHEN has AND c_nationkey % 3 = 0 THEN 'EU; latam' WHEN country = 'es' THEN 'eu' ELSE '' END AS preferred_regions,
      mn AS min_company_size, mx AS max_company_size,
      CASE WHEN has AND c_nationkey % 7 = 0 THEN false ELSE true END AS prefer_named_person,
      array_to_string(CASE WHEN NOT has THEN {_hard0} ELSE
        {let("CASE WHEN c_nationkey % 3 = 0 THEN ['Company_Size', 'budget'] ELSE " + _hard0 + " END", 'hd',
             "list_concat(list_concat(hd, CASE WHEN ctry IS NOT NULL AND NOT list_contains(hd, 'preferred_country') THEN ['preferred_country'] ELSE [] END), "
             "CASE WHEN (mn IS NOT NULL OR mx IS NOT NULL) AND NOT list_contains(hd, 'company_size') THEN ['company_size'] ELSE [] END)")} END, '; ') AS hard_constraints,
      'named_person' AS relaxable_constraints,
      CASE WHEN has AND c_nationkey % 2 = 0 THEN 'cto; head_of_engineering' ELSE array_to_string(buyers, '; ') END AS buyer_targets,
      CASE WHEN has AND c_nationkey % 3 = 0 THEN 'genai; automation; software company' ELSE array_to_string(themes, '; ') END AS search_themes
    FROM (SELECT *, {_has} AS has,
      CASE WHEN NOT {_has} THEN country ELSE coalesce(CASE c_nationkey % 4 WHEN 0 THEN 'es' WHEN 1 THEN 'gb' WHEN 2 THEN 'zz' END, country) END AS ctry,
      CASE WHEN {_has} AND c_nationkey % 2 = 0 THEN 7 ELSE min_size END AS mn,
      CASE WHEN {_has} AND c_nationkey % 3 = 1 THEN 70 ELSE max_size END AS mx FROM req_all)""",
)
oracle("query_expansion", "SELECT brief_id, stage, pos, query FROM cand")
oracle(
    "unused_queries",
    f"""SELECT brief_id, arg_min(query, pos) FILTER (WHERE NOT used) AS query FROM (
      SELECT brief_id, pos, query, {norm('query')} IN (SELECT {norm('query')} FROM v_results WHERE place IN ('Spain', 'France')) AS used FROM work)
    GROUP BY brief_id""",
)
oracle(
    "search_response_json",
    """SELECT query, rank, CASE WHEN rank <> 2 THEN url ELSE '' END AS url, title,
      CASE WHEN rank % 2 = 0 THEN snippet WHEN rank <> 3 THEN 'raw ' || snippet ELSE '' END AS snippet, 'tavily_search' AS source_type
    FROM ev WHERE rank < 4""",
)
oracle(
    "retrieve_topk",
    """SELECT brief_id, query, rank, url, title FROM scored WHERE pos = 0""",
)
oracle(
    "evidence_pages",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, e.url, coalesce(page_text, '') AS page_text
    FROM v_evidence e LEFT JOIN v_pages p ON e.url = p.url""",
)
oracle(
    "unvisited_evidence",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, query, url FROM v_evidence
    WHERE url NOT IN (SELECT url FROM v_results WHERE l_returnflag = 'R') AND {host('url')} NOT IN ({', '.join(lit(s) for s in V.SOCIAL_HOSTS)})""",
)
CTE["all_text"] = "SELECT *, title || ' ' || snippet AS text FROM v_evidence"
parse("all_parsed", "all_text")
oracle(
    "candidates",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name_1 AS full_name, p_role AS role_title, c_name AS company_name,
      c_site AS website, c_country AS country_code, c_staff AS employee_estimate FROM all_parsed""",
)
oracle("fit_signals", "SELECT brief_id, pos, rank, array_to_string(sig, '; ') AS fit_signals, cast(score AS INTEGER) AS score FROM scored")
oracle("best_evidence", "SELECT brief_id, pos, rank, url, cast(score AS INTEGER) AS score FROM best_row")
oracle("dossiers", flat("doss"))
CTE["checked"] = (
    f"""SELECT brief_id, pos, query_used, CASE WHEN again THEN 'NO_CANDIDATE' ELSE sourcing_status END AS sourcing_status,
      CASE WHEN NOT again THEN full_name END AS full_name, CASE WHEN NOT again THEN role_title END AS role_title,
      CASE WHEN NOT again THEN company_name END AS company_name, CASE WHEN NOT again THEN website END AS website,
      CASE WHEN NOT again THEN country_code END AS country_code, CASE WHEN NOT again THEN employee_estimate END AS employee_estimate,
      CASE WHEN again THEN [] ELSE fit END AS fit, CASE WHEN again THEN [] ELSE evidence END AS evidence,
      CASE WHEN again THEN list_append(notes, '{V.NOTE_EXPLORED}') ELSE notes END AS notes
      FROM (SELECT *, coalesce(lower(company_name) IN (SELECT lower(p_name) FROM v_results WHERE l_returnflag = 'R'), false) AS again FROM doss)"""
)
oracle("explored_companies", flat("checked"))
oracle("follow_up", flat("followed", "follow_ups"))
oracle("enrich_pass", flat("enriched"))
oracle("gap_fill", flat("gap_filled"))
oracle("ground_external", flat("grounded"))
_fields = "brief_id, pos, sourcing_status, query_used, full_name, role_title, company_name, website, country_code, employee_estimate, fit, evidence, notes"
CTE["fresh_claims"] = f"""
SELECT {_fields} FROM grounded WHERE lower(company_name) NOT IN (SELECT lower(p_name) FROM v_results WHERE l_returnflag = 'R')"""
CTE["preferred"] = f"""
SELECT * FROM fresh_claims UNION ALL SELECT {_fields} FROM checked ANTI JOIN fresh_claims USING (brief_id, pos)"""
oracle("grounded_dossiers", flat("preferred"))
oracle("qualify", "SELECT brief_id, pos, outcome, match_type, score, summary, type, region FROM decided")
oracle(
    "qualify_reasons",
    """SELECT brief_id, pos, array_to_string(reasons, '; ') AS reasons, close_summary, array_to_string(missed, '; ') AS missed_filters,
      array_to_string(close_reasons, '; ') AS close_reasons FROM decided""",
)
oracle(
    "merge_reviews",
    """SELECT brief_id, pos, outcome, CASE WHEN r = outcome AND n4 % 3 <> 0 THEN 'Reviewed ' || pos ELSE summary END AS summary,
      CASE WHEN r = outcome THEN coalesce(type, 'reviewed type') ELSE type END AS type,
      CASE WHEN r = outcome THEN coalesce(region, 'reviewed region') ELSE region END AS region,
      array_to_string(CASE WHEN r <> outcome THEN list_append(reasons, 'llm_review_disagreed=' || r) ELSE reasons END, '; ') AS reasons,
      CASE WHEN close_summary IS NOT NULL AND r = outcome AND n4 % 2 = 0 THEN 'Close by review.' ELSE close_summary END AS close_summary
    FROM (SELECT *, brief_id + pos AS n4, CASE (brief_id + pos) % 4 WHEN 0 THEN NULL WHEN 1 THEN outcome WHEN 2 THEN 'ACCEPT' ELSE 'REJECT' END AS r FROM decided)""",
)
_slots = dict(person="pn", company="cn", role="rn", two="t2", three="t3")
oracle(
    "drafts",
    f"""SELECT brief_id, pos, {' || '.join(filled(t, **_slots) for t in V.HOOK_TEMPLATES).replace(') || (', ") || ' / ' || (")} AS hooks,
      array_to_string(list_transform(evidence[1:3], lambda e: e.title || ' (' || e.url || ')'), '; ') AS source_notes, summary AS fit_summary,
      {filled(V.CONNECTION_NOTE_TEMPLATE, **_slots)} AS connection_note_draft, {filled(V.DM_TEMPLATE, **_slots)} AS dm_draft,
      {filled(V.SUBJECT_TEMPLATE, **_slots)} AS email_subject, {filled(V.BODY_TEMPLATE, **_slots)} AS email_body
    FROM (SELECT *, CASE WHEN ok THEN full_name ELSE 'there' END AS pn, coalesce(company_name, 'your company') AS cn,
        coalesce(CASE WHEN ok THEN nullif(role_title, '') END, 'your team') AS rn,
        array_to_string(tp[1:2], ', ') AS t2, array_to_string(tp[1:3], ', ') AS t3
      FROM (SELECT *, {usable_person('full_name')} AS ok, CASE WHEN len(fit) > 0 THEN fit ELSE themes END AS tp FROM decided
        WHERE outcome IN ('ACCEPT', 'REJECT_CLOSE_MATCH')))""",
)
oracle(
    "accepted_leads",
    """SELECT run_id, idx, lead_id, person_name, tidy_role AS role_title, company_name, website, country_code,
      array_to_string(list_transform(evidence, lambda e: e.url), ' ') AS evidence_urls, score FROM lead_rows""",
)
oracle(
    "crm_records",
    f"""SELECT run_id, lead_id, company_name, outcome, {filled(V.SUBJECT_TEMPLATE, company='company_name')} AS email_subject,
      evidence[1].url AS first_url FROM lead_rows""",
)
oracle("rejected_candidates", "SELECT run_id, idx, candidate_key, company_name, query_used, outcome FROM reject_rows")
oracle(
    "source_traces",
    """SELECT run_id, idx, sourcing_status, query_used, cast(len(evidence) AS INTEGER) AS evidence_count, array_to_string(notes, '; ') AS notes FROM decided""",
)
oracle(
    "shortlist_topk",
    "SELECT shortlist_id, run_id, option_number, company_name, person_name, summary, array_to_string(missed, '; ') AS missed_filters FROM short_rows",
)
oracle(
    "route_counts",
    """SELECT 'accepted_leads' AS table_name, count(*) AS row_count FROM lead_rows UNION ALL SELECT 'crm_records', count(*) FROM lead_rows
    UNION ALL SELECT 'shortlist_options', count(*) FROM short_rows UNION ALL SELECT 'rejected_candidates', count(*) FROM reject_rows
    UNION ALL SELECT 'source_traces', count(*) FROM decided""",
)
oracle(
    "run_status",
    """SELECT run_id, target_count, accepted, shortlisted, used AS source_attempts_used,
      CASE WHEN accepted >= target_count THEN 'FINISH_ACCEPTED' WHEN used >= 11 AND shortlisted > 0 THEN 'FINISH_SHORTLIST'
        WHEN used >= 11 THEN 'FINISH_NO_RESULT' ELSE 'SOURCE' END AS action,
      CASE WHEN used >= 4 THEN 2 WHEN used >= 2 THEN 1 ELSE 0 END AS relaxation_stage,
      coalesce(completed_reason, 'continue_sourcing') AS reason, status, completed_reason FROM ended_runs""",
)
oracle("run_lookup", f"SELECT run_id, brief_id, status FROM ended_runs WHERE run_id = {run_id('1')}")
oracle(
    "miss_streak",
    f"""SELECT coalesce(b.scope, r.scope) AS scope, CASE WHEN r.last_hit IS NOT NULL THEN r.misses ELSE coalesce(b.n, 0) + coalesce(r.misses, 0) END AS {V.MISS_STREAK}
    FROM (SELECT cast(n_nationkey AS VARCHAR) AS scope, cast(n_regionkey AS BIGINT) AS n FROM nation) b FULL JOIN (
      SELECT scope, max(last_hit) AS last_hit, count(*) FILTER (WHERE island = max_island) - max(CASE WHEN last_hit IS NOT NULL THEN 1 ELSE 0 END) AS misses
      FROM (SELECT *, max(island) OVER (PARTITION BY scope) AS max_island, max(CASE WHEN hit = 1 THEN brief_id END) OVER (PARTITION BY scope) AS last_hit
        FROM (SELECT *, sum(hit) OVER (PARTITION BY scope ORDER BY brief_id) AS island
          FROM (SELECT e.brief_id, cast(c.c_nationkey AS VARCHAR) AS scope, CASE WHEN status <> 'no_result' THEN 1 ELSE 0 END AS hit
            FROM ended_runs e JOIN customer c ON e.brief_id = c.c_custkey WHERE status <> 'running')))
      GROUP BY scope) r ON b.scope = r.scope""",
)
oracle("memory_merge", "SELECT scope, kind, value, value_norm, first_seen FROM all_memory")
oracle("memory_reset", f"SELECT scope, kind, value FROM all_memory WHERE kind NOT IN ('{V.QUERY_HISTORY}', '{V.VISITED_URLS}')")
oracle(
    "upsert_runs",
    f"""SELECT coalesce(b.run_id, d.run_id) AS run_id, coalesce(d.status, b.status) AS status,
      coalesce(b.created_at, '2030-01-01 00:00:00') AS created_at, CASE WHEN d.run_id IS NOT NULL THEN '2030-01-01 00:00:00' ELSE b.updated_at END AS updated_at
    FROM (SELECT {run_id('o_custkey')} AS run_id, 'running' AS status, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS created_at,
        strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS updated_at FROM orders GROUP BY o_custkey) b
    FULL JOIN ended_runs d ON b.run_id = d.run_id""",
)
CTE["selections"] = """
SELECT DISTINCT 'short_' || substr(run_id, 5) AS shortlist_id, run_id, cast(1 + brief_id % 4 AS INTEGER) AS option_number FROM decided"""
CTE["won"] = "SELECT s.* FROM short_rows s JOIN selections USING (shortlist_id, option_number)"
oracle(
    "promote",
    """SELECT 'lead' AS part, shortlist_id, option_number, company_name, person_name, type AS detail FROM won
    UNION ALL SELECT 'option', shortlist_id, option_number, company_name, person_name, summary FROM short_rows
      WHERE (shortlist_id, option_number) NOT IN (SELECT (shortlist_id, option_number) FROM won)
    UNION ALL SELECT DISTINCT 'shortlist', shortlist_id, 0, NULL, NULL,
      CASE WHEN shortlist_id IN (SELECT shortlist_id FROM won) THEN 'cleared' ELSE 'pending' END FROM short_rows
    UNION ALL SELECT DISTINCT 'run', run_id, 0, NULL, NULL, CASE WHEN run_id IN (SELECT run_id FROM won) THEN 'completed' ELSE 'no_result' END FROM decided
    UNION ALL SELECT 'refused', shortlist_id, option_number, NULL, NULL, NULL FROM selections
      WHERE shortlist_id NOT IN (SELECT shortlist_id FROM won)""",
)
CTE["two_choices"] = """
SELECT DISTINCT 'short_' || substr(run_id, 5) AS shortlist_id, unnest([1 + brief_id % 4, 1 + brief_id % 3]) AS option_number,
  unnest([10 + brief_id % 2, 11]) AS selected_at FROM decided"""
CTE["first_choice"] = """
SELECT * FROM two_choices SEMI JOIN short_rows USING (shortlist_id, option_number)
QUALIFY row_number() OVER (PARTITION BY shortlist_id ORDER BY selected_at, option_number) = 1"""
oracle(
    "shortlist_records",
    """SELECT s.shortlist_id, run_id, count(*) AS n_options, CASE WHEN f.shortlist_id IS NULL THEN 'pending' ELSE 'cleared' END AS status,
      cast(f.option_number AS INTEGER) AS selected_option, '2030-01-01 00:00:00' AS created_at,
      CASE WHEN f.shortlist_id IS NULL THEN '2030-01-01 00:00:00' ELSE '2030-01-02 00:00:00' END AS updated_at
    FROM short_rows s LEFT JOIN first_choice f ON s.shortlist_id = f.shortlist_id GROUP BY ALL""",
)
oracle(
    "run_responses",
    """SELECT '20300102T030405Z_lead-search-run_' || r.run_id || '.json' AS name, r.run_id, r.brief_id, status, completed_reason, used,
      cast(coalesce(n_leads, 0) AS INTEGER) AS n_leads, first_company, first_score, first_urls, cast(coalesce(n_options, 0) AS INTEGER) AS n_options, last_option,
      cast(n_iterations AS INTEGER) AS n_iterations, outcomes
    FROM ended_runs r JOIN (SELECT run_id, count(*) AS n_iterations, string_agg(outcome, ' ' ORDER BY idx) AS outcomes FROM decided GROUP BY run_id) i USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n_leads, arg_min(company_name, idx) AS first_company, arg_min(score, idx) AS first_score,
      arg_min(array_to_string(list_transform(evidence, lambda e: e.url), ' '), idx) AS first_urls FROM lead_rows GROUP BY run_id) l USING (run_id)
    LEFT JOIN (SELECT run_id, count(*) AS n_options, arg_max(company_name, option_number) AS last_option FROM short_rows GROUP BY run_id) s USING (run_id)""",
)
oracle(
    "archive_json",
    """SELECT '20300102T030405Z_lead-search-run_' || run_id || '.json' AS name,
      '{"run_id":"' || run_id || '","status":"' || status || '","accepted":' || accepted || ',"completed_reason":' ||
      coalesce('"' || completed_reason || '"', 'null') || '}' AS payload FROM ended_runs""",
)
oracle(
    "outcome_counts",
    """SELECT coalesce(country, 'any') AS country, outcome, count(*) AS candidates, cast(sum(score) AS BIGINT) AS total_score
    FROM decided GROUP BY ALL""",
)

# ---------------------------------------------------------------- streams

CTE["raw_in"] = """
SELECT *, CASE c_nationkey WHEN 10 THEN '{"user_text": 12}' WHEN 11 THEN '{"user_text": "  "}' WHEN 12 THEN 'not json' WHEN 13 THEN '{}'
    WHEN 14 THEN '[]' WHEN 15 THEN '{"user_text": null}' ELSE '{"user_text": "' || user_text || '"' ||
      CASE c_nationkey WHEN 0 THEN ', "unexpected": "value"' WHEN 1 THEN ', "request_id": "r-1"' WHEN 2 THEN ', "meta": {"n": 1}' WHEN 3 THEN ', "meta": 5'
        WHEN 4 THEN ', "request_id": 7' WHEN 5 THEN ', "request_id": null' WHEN 6 THEN ', "meta": null' WHEN 7 THEN ', "zeta": 1, "alpha": 2' ELSE '' END || '}' END AS payload,
  CASE c_nationkey WHEN 0 THEN 'unknown field: unexpected' WHEN 3 THEN 'meta must be an object' WHEN 4 THEN 'request_id must be a string'
    WHEN 6 THEN 'meta must be an object' WHEN 7 THEN 'unknown field: alpha,zeta' WHEN 10 THEN 'user_text must be a string'
    WHEN 11 THEN 'user_text must not be empty' WHEN 12 THEN 'not a JSON object' WHEN 13 THEN 'user_text must be a string'
    WHEN 14 THEN 'not a JSON object' WHEN 15 THEN 'user_text must be a string' ELSE 'ok' END AS fault
FROM v_briefs"""
CTE["waves"] = """
SELECT *, substr(sha256(CASE c_nationkey WHEN 1 THEN 'r-1' WHEN 4 THEN '7' ELSE payload END), 1, 32) AS key FROM (
  SELECT 0 AS wave, brief_id, c_nationkey, user_text, payload, fault FROM raw_in
  UNION ALL SELECT 1, brief_id, c_nationkey, 'please ' || user_text, replace(payload, 'find ', 'please find '), fault FROM raw_in WHERE c_nationkey = 1)"""
CTE["winners"] = """
SELECT w.wave, w.key, w.payload, t.user_text, r.target_count, r.country,
  CASE WHEN target_count NOT BETWEEN 1 AND 20 THEN 'target_count out of range' WHEN min_size NOT BETWEEN 1 AND 100000 THEN 'min_company_size out of range'
    WHEN max_size NOT BETWEEN 1 AND 100000 THEN 'max_company_size out of range' ELSE 'ok' END AS error
FROM (SELECT wave, key, max(payload) AS payload FROM waves WHERE fault = 'ok' GROUP BY ALL) w
JOIN (SELECT wave, payload, min(brief_id) AS brief_id, any_value(user_text) AS user_text FROM waves GROUP BY ALL) t ON w.wave = t.wave AND w.payload = t.payload
JOIN req_all r ON r.brief_id = t.brief_id"""
oracle(
    "landed_briefs",
    """SELECT key AS brief_id, 'ok' AS error, CASE WHEN key = substr(sha256('r-1'), 1, 32) THEN 'r-1' ELSE 'req_' || substr(sha256(key), 1, 32) END AS request_id,
      arg_max(user_text, wave) AS user_text, arg_max(target_count, wave) AS target_count, max_by({'c': country}, wave).c AS preferred_country,
      cast(min(wave) AS BIGINT) AS first_batch, cast(max(wave) AS BIGINT) AS batch FROM winners WHERE error = 'ok' GROUP BY key
    UNION ALL SELECT max(key), max(error), NULL, payload, NULL, NULL, cast(min(wave) AS BIGINT), cast(max(wave) AS BIGINT) FROM (
      SELECT wave, key, fault AS error, payload FROM waves WHERE fault <> 'ok'
      UNION ALL SELECT wave, key, error, user_text FROM winners WHERE error <> 'ok') GROUP BY payload""",
)
CTE["picks"] = """
SELECT 0 AS batch, shortlist_id, option_number FROM selections
UNION ALL SELECT DISTINCT 1, shortlist_id, 1 FROM short_rows"""
CTE["picked_rows"] = f"""
SELECT p.batch, s.*, s.person_name AS who FROM picks p JOIN short_rows s ON p.shortlist_id = s.shortlist_id AND p.option_number = s.option_number
WHERE p.batch = 0 OR p.shortlist_id NOT IN (SELECT shortlist_id FROM won)"""
CTE["learned"] = f"""
SELECT kind, value, min(batch) AS batch FROM (
  SELECT '{V.COMPANY_NAMES}' AS kind, company_name AS value, batch FROM picked_rows
  UNION ALL SELECT '{V.LEAD_NAMES}', who, batch FROM picked_rows WHERE coalesce(who, '') <> '') GROUP BY ALL"""
oracle(
    "landed_selections",
    """SELECT 'lead' AS part, shortlist_id AS key, option_number, company_name, type AS detail, cast(batch AS BIGINT) AS batch FROM picked_rows
    UNION ALL SELECT 'crm', run_id, 0, company_name, NULL, batch FROM picked_rows
    UNION ALL SELECT 'option', shortlist_id, option_number, company_name, NULL, NULL FROM short_rows ANTI JOIN picked_rows USING (shortlist_id, option_number)
    UNION ALL SELECT DISTINCT 'run', run_id, 0, NULL, CASE WHEN run_id IN (SELECT run_id FROM picked_rows) THEN 'completed' ELSE 'no_result' END, NULL FROM decided
    UNION ALL SELECT 'shortlist', shortlist_id, option_number, NULL, 'cleared', batch FROM picked_rows
    UNION ALL SELECT 'refused', shortlist_id, option_number, NULL, NULL, batch FROM picks
      WHERE (batch, shortlist_id, option_number) NOT IN (SELECT (batch, shortlist_id, option_number) FROM picked_rows)
    UNION ALL SELECT 'memory', kind, 0, value, NULL, batch FROM learned""",
)

# ---------------------------------------------------------------- the campaign, round by round

_SOCIAL = ", ".join(lit(x) for x in V.SOCIAL_HOSTS)
ROUNDS = V.SOURCE_ATTEMPT_BUDGET

CTE["seg_old"] = """
SELECT lower(c_mktsegment) AS scope, url, query, p_name, place FROM v_results
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'"""
CTE["seg_memory"] = f"""
SELECT DISTINCT scope, '{V.VISITED_URLS}' AS kind, url AS value, url AS value_norm FROM seg_old
UNION ALL SELECT DISTINCT scope, '{V.QUERY_HISTORY}', query, {norm('query')} FROM seg_old WHERE place = 'Portugal'
UNION ALL SELECT DISTINCT scope, '{V.COMPANY_NAMES}', p_name, lower(p_name) FROM seg_old WHERE place = 'Portugal'"""
CTE["seg_req"] = f"""
SELECT req.*, lower(c_mktsegment) AS scope, {run_id('brief_id')} AS run FROM req JOIN customer ON brief_id = c_custkey"""
CTE["seg_cand"] = f"""
SELECT c.brief_id, c.stage, c.pos, c.query, c.qn
FROM (SELECT *, {norm('query')} AS qn FROM cand) c JOIN seg_req r ON c.brief_id = r.brief_id
WHERE NOT EXISTS (SELECT 1 FROM seg_memory m WHERE m.scope = r.scope AND m.kind = '{V.QUERY_HISTORY}' AND m.value_norm = c.qn)"""
#: Every result once, as read with and without its page.
CTE["res"] = """
SELECT e.query, e.rank, e.url, e.title, e.snippet, coalesce(page_text, '') AS page_text
FROM (SELECT query, rank, url, title, snippet FROM ev UNION ALL SELECT query, rank, url, title, snippet FROM second) e
LEFT JOIN v_pages p ON e.url = p.url"""
CTE["res_bare_text"] = "SELECT *, title || ' ' || snippet || ' ' AS text FROM res"
parse("res_bare", "res_bare_text")
CTE["res_short_text"] = f"SELECT *, title || ' ' || snippet || ' ' || substr(page_text, 1, {V.EXCERPT_CHARS}) AS text FROM res"
parse("res_short", "res_short_text")
CTE["res_full_text"] = "SELECT *, title || ' ' || snippet || ' ' || page_text AS text FROM res"
parse("res_full", "res_full_text")
CTE["res_named"] = f"""
SELECT * EXCLUDE (c_site, c_country), coalesce(c_name, tc) AS d_name,
  CASE WHEN c_name IS NULL AND tc IS NOT NULL THEN {website('page_text', 'url', 'h')} ELSE c_site END AS d_site,
  CASE WHEN c_name IS NULL AND tc IS NOT NULL THEN {country(norm('text'))} ELSE c_country END AS d_country, c_site, c_country
FROM (SELECT *, {title_company('title')} AS tc FROM res_full)"""
CTE["start_1"] = """
SELECT run, 0 AS attempts, 0 AS enriched, 0 AS searches, 0 AS accepted, 0 AS shortlisted, []::VARCHAR[] AS history,
  []::VARCHAR[] AS visited, NULL::VARCHAR AS current FROM seg_req"""
CTE["held_0"] = "SELECT scope, value_norm AS company_key, NULL::VARCHAR AS run_id, 0 AS idx FROM seg_memory WHERE kind = '" + V.COMPANY_NAMES + "'"


def _evidence(q: str) -> str:
    return f"{{'url': {q}.url, 'title': {q}.title, 'snippet': {q}.snippet, 'q': {q}.query, 'r': {q}.rank}}"


def round_ctes(n: int) -> None:
    """One attempt of every run that is still active."""
    CTE[f"ask_{n}"] = f"""
SELECT s.*, r.* EXCLUDE (run), q.query
FROM start_{n} s JOIN seg_req r ON s.run = r.run LEFT JOIN (
  SELECT s2.run, arg_min(c.query, c.pos) AS query FROM start_{n} s2 JOIN seg_req r2 ON s2.run = r2.run JOIN seg_cand c ON c.brief_id = r2.brief_id
  WHERE c.stage = CASE WHEN attempts >= 4 THEN 2 WHEN attempts >= 2 THEN 1 ELSE 0 END
    AND NOT list_contains(history, c.qn) AND c.qn IS DISTINCT FROM CASE WHEN current IS NOT NULL THEN {norm('current')} END
  GROUP BY s2.run) q ON q.run = s.run"""
    CTE[f"shown_{n}"] = f"""
SELECT *, CASE WHEN c_name IS NULL THEN -100 ELSE 20
    + CASE WHEN {role_exact('role_norm', 'buyers')} THEN 20 WHEN {role_adjacent('role_norm')} THEN 10 ELSE 0 END
    + CASE WHEN c_country = country THEN 15 ELSE 0 END + CASE WHEN c_staff IS NOT NULL THEN 10 ELSE 0 END
    + least(len({signals('themes', 'hits')}) * 8, 16) + 4 + CASE WHEN coalesce(p_name, '') <> '' THEN 8 ELSE 0 END END AS score
FROM (SELECT a.run, a.buyers, a.country, a.themes, f.* FROM ask_{n} a JOIN ev_facts f ON a.query = f.query
  WHERE NOT list_contains(a.visited, f.url)
    AND NOT EXISTS (SELECT 1 FROM seg_memory m WHERE m.scope = a.scope AND m.kind = '{V.VISITED_URLS}' AND m.value = f.url))"""
    CTE[f"top_{n}"] = f"SELECT run, query, rank, url FROM shown_{n} QUALIFY row_number() OVER (PARTITION BY run ORDER BY score DESC, rank) = 1"
    CTE[f"lists_{n}"] = f"SELECT run, list({_evidence('s')} ORDER BY rank) AS items FROM shown_{n} s GROUP BY run"
    CTE[f"made_{n}"] = f"""
SELECT *, CASE WHEN state <> 'found' THEN [] ELSE {signals('themes', themes_in(norm("array_to_string(list_transform(items[1:2], lambda i: i.title || ' ' || i.snippet), ' ') || ' ' || best_text")))} END AS fit,
  CASE state WHEN 'found' THEN list_concat(list_filter(items, lambda i: i.r = best_rank), list_filter(items, lambda i: i.url <> best_url)[1:1])
    WHEN 'nameless' THEN items[1:2] ELSE [] END AS evidence,
  CASE state WHEN 'none' THEN ['{V.NOTE_NO_QUERY}'] WHEN 'empty' THEN ['{V.NOTE_ALL_VISITED}'] WHEN 'nameless' THEN ['{V.NOTE_NO_COMPANY}']
    ELSE ['query_used=' || query, '{V.NOTE_HEURISTIC}'] END AS notes
FROM (SELECT a.*, l.items, t.rank AS best_rank, t.url AS best_url, d.text AS best_text,
    CASE WHEN a.query IS NULL THEN 'none' WHEN t.run IS NULL THEN 'empty' WHEN d.d_name IS NULL THEN 'nameless' ELSE 'found' END AS state,
    CASE WHEN d.d_name IS NOT NULL THEN d.p_any END AS any0, CASE WHEN d.d_name IS NOT NULL THEN d.p_name END AS full0,
    CASE WHEN d.d_name IS NOT NULL THEN d.p_role END AS role0, d.d_name, d.d_site, d.d_country, CASE WHEN d.c_name IS NOT NULL THEN d.c_staff END AS d_staff
  FROM ask_{n} a LEFT JOIN top_{n} t ON a.run = t.run LEFT JOIN lists_{n} l ON a.run = l.run
  LEFT JOIN res_named d ON t.query = d.query AND t.rank = d.rank)"""
    earlier = " UNION ALL ".join(f"SELECT scope, company_key FROM held_{k}" for k in range(n))
    CTE[f"held_{n}"] = f"""
SELECT scope, lower(d_name) AS company_key, min(run) AS run_id, {n} AS idx FROM made_{n}
WHERE state = 'found' AND (scope, lower(d_name)) NOT IN (SELECT (scope, company_key) FROM ({earlier})) GROUP BY ALL"""
    CTE[f"kept_{n}"] = f"""
SELECT m.* EXCLUDE (fit, evidence, notes, d_name), state = 'found' AND h.run_id IS NULL AS lost,
  CASE WHEN state = 'found' AND h.run_id IS NULL THEN [] ELSE fit END AS fit, CASE WHEN state = 'found' AND h.run_id IS NULL THEN [] ELSE evidence END AS evidence,
  CASE WHEN state = 'found' AND h.run_id IS NULL THEN list_append(notes, '{V.NOTE_EXPLORED}') ELSE notes END AS notes,
  CASE WHEN h.run_id IS NOT NULL THEN d_name END AS company_name
FROM made_{n} m LEFT JOIN held_{n} h ON m.run = h.run_id"""
    hint = "company_name || ' ' || replace(buyers[1], '_', ' ') || ' ' || coalesce(country, {c}, 'spain') || ' ' || array_to_string((CASE WHEN len(fit) > 0 THEN fit ELSE themes END)[1:2], '{glue}')"
    CTE[f"thin_{n}"] = f"""
SELECT *, CASE WHEN company_name IS NOT NULL AND len(evidence) < 2 THEN {strip(hint.format(c='d_country', glue=' '))} END AS fq FROM kept_{n}"""
    CTE[f"hit_{n}"] = f"""
SELECT t.run, f.* FROM thin_{n} t JOIN res_full f ON t.fq = f.query
WHERE NOT list_contains(list_transform(t.evidence, lambda e: e.url), f.url) AND NOT list_contains(t.visited, f.url) AND f.h NOT IN ({_SOCIAL})
  AND NOT EXISTS (SELECT 1 FROM seg_memory m WHERE m.scope = t.scope AND m.kind = '{V.VISITED_URLS}' AND m.value = f.url)
  AND contains(lower(f.text), lower(t.company_name))
QUALIFY row_number() OVER (PARTITION BY t.run ORDER BY f.rank) = 1"""
    CTE[f"grown_{n}"] = f"""
SELECT * EXCLUDE (fit, new_fit), CASE WHEN added AND len(new_fit) > 0 THEN new_fit ELSE fit END AS fit
FROM (SELECT *, {signals('themes', themes_in(norm("array_to_string(list_transform(evidence, lambda e: e.title || ' ' || e.snippet), ' ')")))} AS new_fit FROM (
  SELECT t.* EXCLUDE (evidence, notes), h.run IS NOT NULL AS added, CASE WHEN fq IS NULL THEN 0 ELSE 1 END AS follow_ups,
    CASE WHEN NOT coalesce(any0, false) OR company_name IS NULL THEN h.p_any AND {usable_person('h.p_name')} ELSE any0 END AS any1,
    CASE WHEN company_name IS NULL THEN NULL WHEN any0 THEN full0 WHEN h.p_any AND {usable_person('h.p_name')} THEN h.p_name END AS full_name,
    CASE WHEN company_name IS NULL THEN NULL WHEN any0 THEN role0 WHEN h.p_any AND {usable_person('h.p_name')} THEN h.p_role END AS role_title,
    CASE WHEN company_name IS NOT NULL THEN coalesce(d_site, h.c_site) END AS website,
    CASE WHEN company_name IS NOT NULL THEN coalesce(d_country, h.c_country) END AS country_code,
    CASE WHEN company_name IS NOT NULL THEN coalesce(d_staff, h.c_staff) END AS employee_estimate,
    CASE WHEN h.run IS NOT NULL THEN list_append(evidence, {_evidence('h')}) ELSE evidence END AS evidence,
    CASE WHEN h.run IS NOT NULL THEN list_append(notes, 'follow_up_query=' || fq) ELSE notes END AS notes
  FROM thin_{n} t LEFT JOIN hit_{n} h ON t.run = h.run))"""
    CTE[f"first_{n}"] = f"SELECT *, 'q' AS dummy, {n} - 1 AS pos, query AS query_used FROM grown_{n}"
    decide(f"ruled_{n}", f"first_{n}")
    CTE[f"more_{n}"] = f"""
SELECT *, {strip(hint.format(c='country_code', glue='  '))} AS eq FROM ruled_{n} WHERE outcome = 'ENRICH' AND enriched < {V.ENRICH_ATTEMPT_BUDGET}"""
    CTE[f"said_{n}"] = f"""
SELECT m.run, x.ord, b.p_any, b.p_name, b.p_role, b.c_site, b.c_country, b.c_staff
FROM more_{n} m, unnest(m.evidence) WITH ORDINALITY AS x(e, ord) JOIN res_bare b ON x.e.q = b.query AND x.e.r = b.rank
UNION ALL SELECT m.run, 100 + b.rank, b.p_any, b.p_name, b.p_role, b.c_site, b.c_country, b.c_staff
FROM more_{n} m JOIN res_short b ON m.eq = b.query WHERE NOT list_contains(list_transform(m.evidence, lambda e: e.url), b.url)"""
    CTE[f"gaps_{n}"] = f"""
SELECT run, arg_min({{'n': p_name, 'r': p_role}}, ord) FILTER (WHERE p_any) AS who,
  arg_min(c_site, ord) FILTER (WHERE c_site IS NOT NULL) AS s1, arg_min(c_country, ord) FILTER (WHERE c_country IS NOT NULL) AS c1,
  arg_min(c_staff, ord) FILTER (WHERE c_staff IS NOT NULL) AS e1 FROM said_{n} GROUP BY run"""
    CTE[f"added_{n}"] = f"""
SELECT m.run, list({_evidence('b')} ORDER BY b.rank) AS new_ev FROM more_{n} m JOIN res b ON m.eq = b.query
WHERE NOT list_contains(list_transform(m.evidence, lambda e: e.url), b.url) GROUP BY m.run"""
    CTE[f"second_{n}"] = f"""
SELECT * EXCLUDE (fit, new_fit, all_ev, evidence, k_ev0), CASE WHEN len(new_fit) > 0 THEN new_fit ELSE fit END AS fit,
  all_ev[1:greatest(k_ev0 + 2, 2)] AS evidence
FROM (SELECT *, {signals('themes', themes_in(norm("array_to_string(list_transform(all_ev, lambda e: e.title || ' ' || e.snippet), ' ')")))} AS new_fit FROM (
  SELECT g.* EXCLUDE (full_name, role_title, website, country_code, employee_estimate, notes, query_used),
    CASE WHEN any1 THEN full_name ELSE who.n END AS full_name, CASE WHEN any1 THEN role_title ELSE who.r END AS role_title,
    coalesce(website, s1) AS website, coalesce(country_code, c1) AS country_code, coalesce(employee_estimate, e1) AS employee_estimate,
    list_append(notes, 'enrichment_query=' || eq) AS notes, eq AS query_used, len(g.evidence) AS k_ev0,
    list_concat(g.evidence, coalesce(new_ev, [])) AS all_ev
  FROM first_{n} g JOIN (SELECT run, eq FROM more_{n}) e ON g.run = e.run LEFT JOIN gaps_{n} p ON g.run = p.run LEFT JOIN added_{n} d ON g.run = d.run))"""
    decide(f"again_{n}", f"second_{n}")
    columns = (
        "run, brief_id, scope, query, query_used, full_name, role_title, company_name, website, country_code, employee_estimate, fit, evidence, notes, "
        "follow_ups, outcome, score, reasons, attempts, enriched, searches, accepted, shortlisted, history, visited, target_count"
    )
    CTE[f"done_{n}"] = f"""
SELECT {columns}, 0 AS enrich_searches, {n} AS idx FROM ruled_{n} WHERE run NOT IN (SELECT run FROM more_{n})
UNION ALL SELECT {columns}, 1, {n} FROM again_{n}"""
    CTE[f"after_{n}"] = f"""
SELECT *, accepted >= target_count OR attempts >= {ROUNDS} AS over FROM (
  SELECT run, brief_id, scope, target_count, idx, CASE WHEN attempts >= 4 THEN 2 WHEN attempts >= 2 THEN 1 ELSE 0 END AS stage,
    CASE WHEN query IS NULL THEN {ROUNDS} ELSE attempts + 1 END AS attempts, enriched + enrich_searches AS enriched,
    searches + CASE WHEN query IS NULL THEN 0 ELSE 1 END + follow_ups + enrich_searches AS searches,
    accepted + CASE WHEN outcome = 'ACCEPT' THEN 1 ELSE 0 END AS accepted,
    least(shortlisted + CASE WHEN outcome = 'REJECT_CLOSE_MATCH' THEN 1 ELSE 0 END, {V.SHORTLIST_SIZE}) AS shortlisted,
    CASE WHEN query_used IS NULL THEN history ELSE list_append(history, {norm('query_used')}) END AS history,
    list_concat(visited, list_transform(evidence, lambda e: e.url)) AS visited, query AS current
  FROM done_{n})"""
    if n < ROUNDS:
        CTE[f"start_{n + 1}"] = f"SELECT run, attempts, enriched, searches, accepted, shortlisted, history, visited, current FROM after_{n} WHERE NOT over"


for _n in range(1, ROUNDS + 1):
    round_ctes(_n)


def every_round(select: str, table: str, where: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {select} FROM {table}_{n} {where}" for n in range(1, ROUNDS + 1))


CTE["camp_runs"] = f"""
SELECT *, CASE WHEN accepted > 0 OR shortlisted > 0 THEN 'completed' ELSE 'no_result' END AS status,
  CASE WHEN accepted >= target_count THEN 'target_count_reached' WHEN shortlisted > 0 THEN 'budget_exhausted_with_shortlist'
    ELSE 'budget_exhausted_without_results' END AS completed_reason
FROM ({every_round("* EXCLUDE (history, visited, current)", "after", "WHERE over")})"""
CTE["camp_steps"] = every_round("*", "done")
oracle(
    "campaign",
    """SELECT run AS run_id, brief_id, scope, status, completed_reason, stage AS applied_relaxation_stage, idx AS iterations, attempts, enriched, searches,
      accepted, shortlisted, CASE WHEN shortlisted > 0 THEN 'short_' || substr(run, 5) END AS shortlist_id FROM camp_runs""",
)
oracle(
    "campaign_iterations",
    """SELECT run AS run_id, idx, query, CASE WHEN company_name IS NULL THEN 'NO_CANDIDATE' ELSE 'FOUND' END AS sourcing_status, query_used,
      full_name, role_title, company_name, website, country_code, employee_estimate, array_to_string(fit, '; ') AS fit_signals,
      array_to_string(list_transform(evidence, lambda e: e.url), ' ') AS evidence_urls, array_to_string(notes, '; ') AS notes,
      follow_ups, enrich_searches, outcome, score, array_to_string(reasons, '; ') AS reasons FROM camp_steps""",
)
oracle("campaign_claims", every_round("scope, company_key, run_id, idx", "held"))
CTE["camp_memory"] = f"""
SELECT scope, kind, value, min(seen) AS seen FROM (
  SELECT scope, kind, value, 0 AS seen FROM seg_memory
  UNION ALL SELECT scope, '{V.QUERY_HISTORY}', query_used, 1000 + idx FROM camp_steps WHERE query_used IS NOT NULL
  UNION ALL SELECT scope, '{V.COMPANY_NAMES}', company_name, 1000 + idx FROM camp_steps WHERE company_name IS NOT NULL
  UNION ALL SELECT scope, '{V.LEAD_NAMES}', {tidy_person('full_name')}, 1000 + idx FROM camp_steps WHERE outcome = 'ACCEPT' AND {usable_person('full_name')}
  UNION ALL SELECT scope, '{V.VISITED_URLS}', unnest(list_transform(evidence, lambda e: e.url)), 1000 + idx FROM camp_steps)
GROUP BY ALL"""
oracle(
    "campaign_memory",
    f"""SELECT scope, kind, value, CASE kind WHEN '{V.QUERY_HISTORY}' THEN {norm('value')} WHEN '{V.COMPANY_NAMES}' THEN lower(value) ELSE value END AS value_norm,
      cast(seen AS BIGINT) AS first_seen FROM camp_memory
    UNION ALL SELECT scope, '{V.MISS_STREAK}', NULL, NULL, count(*) FILTER (WHERE last_hit IS NULL OR run > last_hit) + CASE WHEN max(last_hit) IS NULL THEN 2 ELSE 0 END
    FROM (SELECT *, max(CASE WHEN status <> 'no_result' THEN run END) OVER (PARTITION BY scope) AS last_hit FROM camp_runs) GROUP BY scope""",
)
oracle(
    "memory_loaded",
    f"""SELECT s.scope, coalesce(c.n, 0) AS {V.MISS_STREAK}, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in (V.QUERY_HISTORY, V.VISITED_URLS, V.COMPANY_NAMES, V.LEAD_NAMES))},
      cast(CASE WHEN count(kind) > 0 THEN 0 END AS BIGINT) AS oldest, cast(CASE WHEN count(kind) > 0 THEN 0 END AS BIGINT) AS newest
    FROM (SELECT DISTINCT lower(c_mktsegment) AS scope FROM customer UNION SELECT lower(n_name) FROM nation) s
    LEFT JOIN (SELECT lower(c_mktsegment) AS scope, count(*) % 7 AS n FROM customer GROUP BY ALL) c ON s.scope = c.scope
    LEFT JOIN seg_memory m ON s.scope = m.scope GROUP BY s.scope, c.n""",
)
