"""Text functions against the plain-Python model, traps included."""

import model
from pyspark.sql import functions as F

from leadflow.functions import extract as E
from leadflow.functions import text as T
from leadflow.operators import expand as Q
from leadflow.operators.normalize import normalize_briefs

NBSP = " "
NAMES = [
    "acme.ai", "Acme AI", "cold_ring--page", "a", "", "  ", "1st a&b co", "Startups directory", "startup", "companies", "company",
    "ñandú sl", "x1b.y c", "OMEGA labs", "A-B_C", "..a b.c.d", "companie of page", "tab\tname", f"nb{NBSP}sp",
]
URLS = [
    "https://www.Acme.ai/about", "http://user:pw@Host.Example.com:8443/x", "https://www.eu-startups.com/directory/cold-ring-5/",
    "https://eu-startups.com/directory", "https://linkedin.com/company/two_x;v=1?q#f", "https://x.com/a", "HTTPS://WWW.X.COM/a",
    "ftp://files.example.org/directory/a", "//no-scheme.example.org/p", "not a url", "", "https://", "https://under_score.dev:8443/team",
    "https://m.x.com/", "https://crunchbase.com", "https://[::1]:80/x", "https://[bad/x", "https://a@b@c.org/", "mailto:a@b.org",
    "https://tracxn.com/a/directory/b/c", "https://www.www.org/",
]
TITLES = [
    "Acme AI | team", "cold ring - top startups", "Jobs at Acme | x", "", "  ", "Acme-AI -- x", "Acme AI |team", "one - two | three",
    "Best companies - 2024", f"Omega{NBSP}|{NBSP}x", "rankingsx | y",
]
TEXTS = [
    "Company: Acme AI | Person: Laura Martin | Role: CTO | Country: Spain | Employees: 25",
    "Persona: Ana\nempresa - Bravo\npuesto: head of talent\nPAÍS: Portugal\nempleados 30",
    "title ", "role:|", "company: |x", "no labels, led by the Founder and CTO", "25 employees of a company", "Country: Unknown | UK",
    "company builds one two three four five six seven eight nine ten", "madrid office", "es", "é1", "ñu", "Europa league",
    "see https://acme.ai/x). and (https://other.example.org/y.), ok", "HTTP://LinkedIn.com/a https://sub.linkedin.com/b",
    "contact: Eva | contact: Bo", "Employees: 99999999999", "PERSON:  Q  | x", "machine learning, llm and generative ai", "workflow It",
]


def column(spark, values, fn):
    rows = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r[0] for r in rows.repartition(3).select("n", fn(F.col("v")).alias("out")).orderBy("n").select("out").collect()]


def test_norm_and_names(spark):
    odd = [*NAMES, *TEXTS, " A B \x1c C\x85d ", None]
    assert column(spark, odd, T.norm) == [model.norm(v) for v in odd]
    assert column(spark, NAMES, T.clean_company) == [model.company(v) for v in NAMES]
    assert column(spark, TITLES, T.title_company) == [model.by_title(v) for v in TITLES]


def test_urls(spark):
    assert column(spark, URLS, T.host) == [model.host(v) or "" for v in URLS]
    usable = [model.host(v) is not None and model.host(v) not in ("x.com",) for v in URLS]
    assert column(spark, URLS, T.usable_url) == usable
    assert column(spark, URLS, lambda c: T.domain_company(c, T.host(c))) == [model.by_url(v) if model.host(v) else None for v in URLS]


def test_country_and_candidates(spark):
    assert column(spark, TEXTS, lambda c: F.get(F.transform(F.array(c), lambda x: T.norm(x)), F.lit(0))) == [model.norm(v) for v in TEXTS]
    pairs = [(n, t, u) for n, (t, u) in enumerate((t, u) for t in TEXTS for u in URLS[:5] + ["https://x.com/a", "not a url"])]
    df = spark.createDataFrame(pairs, "n int, t string, u string").repartition(4)
    got = E.parse_candidates(df, "t", "u").withColumn("k", T.norm(F.col("t"))).select("*", T.country_of("k").alias("code"))
    for r in got.orderBy("n").collect():
        person, firm = model.parse(r.t, r.u)
        assert (None if r.person is None else tuple(r.person)) == person, r.t
        if firm and firm["staff"] and firm["staff"] > 2**63 - 1:
            firm["staff"] = None  # more than a BIGINT holds
        assert (None if r.company is None else tuple(r.company)) == (
            firm and (firm["name"], firm["website"], firm["country"], firm["staff"])
        ), (r.t, r.u)
        assert r.code == model.country(r.t)


def test_lists(spark):
    values = [["CTO", "cto ", "Head-of_Engineering", "x", "vp engineering"], [], ["recruiter", "Recruiter"]]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v array<string>").orderBy("n")
    rows = df.select(
        T.canonical_buyers(F.col("v")).alias("b"), T.dedupe_norm(F.col("v")).alias("d"),
        T.canonical_themes(F.array(*[F.lit(x) for x in ("LLM", "workflow", "agentic workflows", "it", "agentic")])).alias("t"),
    ).collect()
    assert [r.b for r in rows] == [["cto", "head_of_engineering"], [], ["technical_recruiter"]]
    assert [r.d for r in rows] == [["CTO", "Head-of_Engineering", "x", "vp engineering"], [], ["recruiter"]]
    assert rows[0].t == ["genai", "automation", "software company", "agentic workflows"]
    suggested = F.array(*[F.lit(x) for x in ("short", "a  longer   query", "a longer query", None, "another long query")])
    assert df.select(T.tidy_queries(suggested).alias("q")).first().q == ["a longer query", "another long query"]


def test_requests_and_queries(spark):
    texts = [
        "busca 3 leads que trabajen en españa y esten en empresas de entre 5 y 50 empleados", "leads", "find 0 leads",
        "más de 10 empleados, menos de 99 empleados, 7 leads", "chief executive officer and CEO in MADRID", "entre 5 y 50 empleados",
        "Director of automation, over 10 employees", "Europe wide machine learning", "find 25 leads",
    ]
    briefs = spark.createDataFrame([(n, t, None, "{}") for n, t in enumerate(texts)], "brief_id long, user_text string, request_id string, meta string")
    got = normalize_briefs(briefs).orderBy("brief_id").collect()
    for r, t in zip(got, texts):
        want, c = model.request(t), r.constraints
        assert (c.target_count, c.preferred_country, c.min_company_size, c.max_company_size, r.buyer_targets, r.search_themes) == (
            want["count"], want["country"], want["low"], want["high"], want["buyers"], want["themes"],
        ), t
    for stage in (0, 1, 2):
        rows = Q.query_pairs(normalize_briefs(briefs), F.lit(stage)).orderBy("brief_id").collect()
        for r, t in zip(rows, texts):
            assert [p.v for p in r.candidates] == model.queries(model.request(t), stage)
