"""Text clean-up as Column expressions: normalising, names, hosts, websites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadflow import vocab as V

_NAME_BREAK = "\u0001 "


def squeeze(c: Column) -> Column:
    """Whitespace runs (Unicode) become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"(?U){V.SPACE}+", " "))


def strip(c: Column) -> Column:
    """Whitespace removed at both ends, kept inside."""
    return F.regexp_replace(c, rf"(?U)\A{V.SPACE}+|{V.SPACE}+\z", "")


def norm(c: Column) -> Column:
    """Lower case, single spaces, null as the empty string."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def words(squeezed: Column) -> Column:
    """Number of words of an already squeezed text."""
    return F.when(squeezed == "", 0).otherwise(F.size(F.split(squeezed, " ")))


def quoted(value: str) -> str:
    """SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def sql_array(values: list[str]) -> str:
    return f"array({', '.join(map(quoted, values))})" if values else "cast(array() AS array<string>)"


def sql_map(table: dict[str, str]) -> str:
    return f"map({', '.join(f'{quoted(k)}, {quoted(v)}' for k, v in table.items())})"


def strings(values: list[str]) -> Column:
    return F.expr(sql_array(values))


def literal_map(table: dict[str, str]) -> Column:
    return F.expr(sql_map(table))


def one_of(c: Column, values: list[str]) -> Column:
    return F.array_contains(strings(values), c)


def sql_texts(*pairs: tuple[str, str]) -> str:
    """SQL array of the texts whose condition holds, in order."""
    return f"array_compact(array({', '.join(f'CASE WHEN {c} THEN {quoted(t)} END' for c, t in pairs)}))"


def sql_fill(template: str, **slots: str) -> str:
    """SQL that fills a ``{slot}`` template; slots are SQL expressions."""
    parts, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        if head:
            parts.append(quoted(head))
        parts.append(slots[slot])
    if rest:
        parts.append(quoted(rest))
    return f"concat({', '.join(parts)})"


# ---------------------------------------------------------------- countries, list entries


def country_of(normed: str) -> Column:
    """Country code of a column of normalised text: known code, first alias contained, two letters,
    else null."""
    aliases = " ".join(
        f"WHEN contains({normed}, {quoted(alias)}) THEN {quoted(code)}" for alias, code in V.COUNTRY_ALIASES.items()
    )
    known = ", ".join(map(quoted, V.COUNTRY_TERMS))
    two_letters = quoted(r"\A\p{L}{2}\z")
    return F.expr(
        f"CASE WHEN {normed} IN ({known}) THEN {normed} {aliases} WHEN rlike({normed}, {two_letters}) THEN {normed} END"
    )


def canonical_buyers(values: Column) -> Column:
    """Known buyer targets of a list, canonical, first occurrence kept."""
    aliases = literal_map(V.BUYER_ALIASES)
    return F.array_distinct(
        F.array_compact(
            F.transform(values, lambda v: F.try_element_at(aliases, F.translate(norm(v), "-_", "  ")))
        )
    )


def canonical_themes(values: Column) -> Column:
    """Known themes of a list by exact alias, canonical, first occurrence kept."""
    aliases = literal_map({**V.THEME_ALIASES, **V.THEME_ENTRY_OVERRIDES})
    return F.array_distinct(
        F.array_compact(F.transform(values, lambda v: F.try_element_at(aliases, norm(v))))
    )


def norm_pairs(values: Column) -> Column:
    """Entries with their normal form, as (v, n)."""
    return F.transform(values, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))


def first_of_each(pairs: Column) -> Column:
    """Pairs with the first entry of each normal form kept, in order.

    Mostly nothing repeats, which a hash-based distinct settles; only else are entries compared.
    """
    kept = F.aggregate(
        pairs,
        F.array().cast("array<struct<v:string,n:string>>"),
        lambda acc, p: F.when(F.exists(acc, lambda a: a["n"] == p["n"]), acc).otherwise(
            F.array_append(acc, p)
        ),
    )
    return F.when(F.size(F.array_distinct(F.transform(pairs, lambda p: p["n"]))) == F.size(pairs), pairs).otherwise(kept)


def dedupe_norm(values: Column) -> Column:
    """Drop entries equal after ``norm``; order and first spelling are kept."""
    return F.transform(first_of_each(norm_pairs(values)), lambda p: p["v"])


# ---------------------------------------------------------------- company names


def _title_case(c: Column) -> Column:
    # initcap starts a word at a space only; mark the other places where a letter follows a
    # non-letter with a removable break.
    marked = F.regexp_replace(c, r"(?<=[^\p{Alpha} ])(?=\p{Lower})", _NAME_BREAK)
    return F.replace(F.initcap(marked), F.lit(_NAME_BREAK), F.lit(""))


def company_letters(c: Column) -> Column:
    """Name reduced to letters, digits, dots, ampersands and single spaces, noise words dropped."""
    # POSIX classes (ASCII here) scan several times faster than negated letter ranges.
    plain = F.regexp_replace(c, r"[^\p{Alnum}.\& ]+", " ")
    plain = F.regexp_replace(plain, V.NAME_NOISE_WORDS, " ")
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def company_case(letters: Column) -> Column:
    """Title case for all-lower names; null when fewer than two characters."""
    all_lower = letters.rlike(r"\p{Lower}") & ~letters.rlike(r"\p{Upper}")
    return F.when(F.length(letters) >= 2, F.when(all_lower, _title_case(letters)).otherwise(letters))


def clean_company(c: Column) -> Column:
    """Printable company name, or null when fewer than two characters remain.

    On hot paths select :func:`company_letters` first and :func:`company_case` of it after, so that
    the patterns run once.
    """
    return company_case(company_letters(c))


def is_long_name(name: Column) -> Column:
    return (words(name) > 8) | (F.length(name) > 80)


def title_company(title: Column) -> Column:
    """Company named by a page title; null for listing titles."""
    head = strip(F.get(F.split(strip(title), V.TITLE_SEPARATOR, 2), F.lit(0)))
    return F.when(~head.rlike(V.LISTING_TITLE_WORDS), clean_company(head))


# ---------------------------------------------------------------- URLs

_AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# One pass over an authority without user info: bracketed address, or name with ``www.`` and port
# cut off; anything else (unbalanced brackets) leaves nothing.
_HOST_OF_AUTHORITY = r"(?s)^\[([^\[\]]*)\].*$|^(?:www\.)?([^:\[\]]*)(?::[^\[\]]*)?$|^.*$"
_PATH = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def well_formed(url: Column) -> Column:
    """False for authorities with unbalanced IPv6 brackets, which strict URL readers refuse."""
    authority = F.regexp_extract(url, _AUTHORITY, 1)
    return F.contains(authority, F.lit("[")) == F.contains(authority, F.lit("]"))


def host(url: Column) -> Column:
    """Lower-case host without user info, port and one leading ``www.``; '' if there is none."""
    server = F.substring_index(F.regexp_extract(url, _AUTHORITY, 1), "@", -1)
    return F.regexp_replace(F.lower(server), _HOST_OF_AUTHORITY, "$1$2")


def url_path_parts(url: Column) -> Column:
    """Non-empty path segments; parameters of the last segment are cut off."""
    path = F.regexp_replace(F.regexp_extract(url, _PATH, 1), ";[^/]*$", "")
    return F.filter(F.split(path, "/"), lambda p: p != "")


def domain_letters(url: Column, url_host: Column) -> Column:
    """Letters of the company a URL names: directory hosts use the path, others their first label."""
    parts = url_path_parts(url)
    after = F.array_position(parts, "directory")
    segment = F.coalesce(F.when(after > 0, F.get(parts, after)), F.try_element_at(parts, F.lit(-1)))
    label = F.substring_index(url_host, ".", 1)
    named = F.when(one_of(url_host, V.DIRECTORY_HOSTS), segment).otherwise(label)
    return F.when(url_host != "", company_letters(named))


def domain_company(url: Column, url_host: Column) -> Column:
    return company_case(domain_letters(url, url_host))


def official_website(text: Column, url: Column, url_host: Column) -> Column:
    """First URL in the text that is neither on the source host nor on a directory; else the
    source URL unless its host is a directory."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(V.URL_IN_TEXT), F.lit(0)), lambda u: F.struct(u.alias("u"), host(u).alias("h"))
    )
    other = F.filter(found, lambda x: ~one_of(x["h"], V.DIRECTORY_HOSTS + [""]) & (x["h"] != url_host))
    own = F.when(~one_of(url_host, V.DIRECTORY_HOSTS + [""]), url)
    # Most texts name no URL at all: a plain substring test spares them the pattern.
    listed = F.when(F.contains(text, F.lit("://")), F.get(other, F.lit(0))["u"])
    return F.coalesce(F.rtrim(listed, F.lit(".,)")), own)


def usable_url(url: Column) -> Column:
    """True unless the URL is malformed or on a social network."""
    return well_formed(url) & ~one_of(host(url), V.SOCIAL_HOSTS)


def excerpt(c: Column) -> Column:
    return F.substring(c, 1, V.EXCERPT_CHARS)


def html_to_text(html: Column) -> Column:
    """Page text: script and style blocks and tags removed; entities stay as they are."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return squeeze(text)


# ---------------------------------------------------------------- usable values


def usable_company(name: Column) -> Column:
    lowered = strip(F.lower(F.coalesce(name, F.lit(""))))
    return (lowered != "") & ~one_of(lowered, V.GENERIC_COMPANY_NAMES) & (words(squeeze(lowered)) <= 8)


def usable_person(name: Column) -> Column:
    flat = squeeze(F.coalesce(name, F.lit("")))
    return (
        (flat != "")
        & (F.length(flat) <= 80)
        & (words(flat) <= 6)
        & ~F.contains(F.lower(flat), F.lit("industries:"))
    )


def tidy_person(name: Column) -> Column:
    return F.when(usable_person(name), squeeze(name))


def tidy_role(role: Column) -> Column:
    flat = squeeze(role)
    return F.when((flat != "") & (F.length(flat) <= 80), flat)


def tidy_queries(values: Column, limit: int = 6, min_chars: int = 10) -> Column:
    """Suggested queries: squeezed, at least ten characters, distinct, first six."""
    flat = F.transform(values, lambda v: squeeze(F.coalesce(v, F.lit(""))))
    return F.slice(F.array_distinct(F.filter(flat, lambda v: F.length(v) >= min_chars)), 1, limit)
