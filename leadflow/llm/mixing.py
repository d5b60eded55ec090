"""Mixing to target weights with soft domain membership, in DataFrame operations only."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.operators.shared import handover

#: Labelled rows the classifier is fitted on (about), words it keeps, places of its word table.
SAMPLE, WORDS, PLACES = 20_000, 2_000, 1 << 14
#: A text's evidence counts as that of so many words at most; documents a word must be in.
EVIDENCE, LEAST = 12, 5
#: Rounds of the fit, how near to its target each domain must come, rounds between stored tables.
ROUNDS, NEAR, CUT = 60, 1e-3, 8


def with_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words``: as written, split at single spaces and line ends, and one mark of how many of them are distinct."""
    docs = docs.withColumn("words", F.filter(F.split(F.coalesce("text", F.lit("")), "[ \n]"), lambda w: w != ""))
    share = F.floor(F.size(F.array_distinct("words")) * 10 / F.greatest(F.size("words"), F.lit(1)))
    return docs.withColumn("words", F.concat("words", F.array(F.concat(F.lit("\t distinct "), share.cast("string")))))


class Domains:
    """A table of words and their log-lift for each domain, laid out by hash, as constants of an expression."""

    def __init__(self, names: list[str], prior: list[float], rows: list):
        self.names, self.prior = names, prior
        self.place: list[str] = [""] * PLACES
        self.lift = [[0.0] * PLACES for _ in names]
        for r in rows:  # best words first; a word whose place is taken is left out
            if not self.place[r["place"]]:
                self.place[r["place"]] = r["word"]
                for k, v in enumerate(r["lift"]):
                    self.lift[k][r["place"]] = v

    def posterior(self, rows: DataFrame) -> DataFrame:
        """``rows(words, ...)`` with ``posterior``, an array of the probabilities of each domain, for ``words``.

        One projection per step, so that each step runs once per row: what a lambda function
        mentions is worked out anew for every element.
        """
        if not self.names:
            return rows.drop("words").withColumn("posterior", F.array().cast("array<double>"))
        names = F.from_json(F.lit(json.dumps(self.place)), "array<string>")
        lifts = [F.from_json(F.lit(json.dumps(x)), "array<double>") for x in self.lift]
        place = lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
        lifted = lambda lift: F.aggregate("known", F.lit(0.0), lambda a, k: a + lift[k])
        rows = rows.withColumn("known", F.transform(F.filter("words", lambda w: names[place(w)] == w), place)).drop("words")
        weight = F.least(F.lit(1.0), F.lit(float(EVIDENCE)) / F.greatest(F.size("known"), F.lit(1)))
        rows = rows.withColumn("weight", weight)
        logs = [F.lit(p) + F.col("weight") * lifted(x) for p, x in zip(self.prior, lifts, strict=True)]
        rows = rows.withColumn("logs", F.array(*logs)).drop("known", "weight")
        rows = rows.withColumn("top", F.array_max("logs"))
        rows = rows.withColumn("odds", F.transform("logs", lambda v: F.exp(v - F.col("top")))).drop("logs", "top")
        rows = rows.withColumn("whole", total("odds"))
        return rows.withColumn("posterior", F.transform("odds", lambda v: v / F.col("whole"))).drop("odds", "whole")


def learn(docs: DataFrame, labelled: DataFrame) -> Domains:
    """A classifier from the ``labelled(doc_id, domain)`` rows of ``docs``, on about ``SAMPLE`` of them chosen by a hash of the id.

    Keeps the ``WORDS`` words that tell domains apart most.  Null ids and domains are left out.  Without
    any labelled row there are no domains: posteriors are empty.
    """
    known = labelled.where("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string").alias("domain"))
    names = sorted(r["domain"] for r in known.select("domain").distinct().collect())  # one row a domain
    if not names:
        return Domains([], [], [])
    share = min(1.0, SAMPLE / known.count())
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6 < share)
    # bounded by SAMPLE, whatever the input
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    told = with_words(texts).select("domain", F.explode(F.array_distinct("words")).alias("word"))
    sizes = {r["domain"]: r["count"] for r in texts.groupBy("domain").count().collect()}
    total = max(sum(sizes.values()), 1)
    counts = told.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(names)])
    # share of a domain's documents that hold the word, over the share of all that do; both smoothed
    lift = F.array(*[
        F.log((F.col(f"n{k}") + 0.5 * F.col("n") / total) / (sizes.get(d, 0) + 0.5)) - F.log(F.col("n") / total) for k, d in enumerate(names)
    ])
    gain = sum((F.col(f"n{k}") * F.abs(lift[k]) for k in range(len(names))), F.lit(0.0))
    best = counts.where(F.col("n") >= LEAST).select("word", gain.alias("gain"), lift.alias("lift"), F.pmod(F.xxhash64("word"), F.lit(PLACES)).alias("place"))
    rows = best.orderBy(F.desc("gain"), "word").limit(WORDS).collect()  # the size of the model


    return Domains(names, [math.log((sizes.get(d, 0) + 0.5) / (total + 0.5 * len(names))) for d in names], rows)


def _stepped(steps: list[list[float]], max_rate: float) -> Column:
    """The rate after further rounds, each the sums a document's posterior is multiplied with."""
    if not steps:
        return F.col("rate")
    rounds = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
    dot = lambda s: F.aggregate(F.zip_with("posterior", s, lambda p, v: p * v), F.lit(0.0), lambda a, b: a + b)
    return F.aggregate(rounds, F.col("rate"), lambda r, s: F.least(F.greatest(r - dot(s), F.lit(0.0)), F.lit(max_rate)))


def fit_rates(members: DataFrame, names: list[str], weights: dict[str, float], total: float | None, max_rate: float) -> list[list[float]]:
    """Steps whose sum (``rated``) gives each row of ``members(posterior, tokens)`` a nonnegative rate that meets the targets.

    Projected gradient on the sum over domains of (expected tokens - target)^2 / natural tokens,
    from rate 1 for all.  A document's gradient is its posterior times the domains' relative
    misses, so a round is one aggregation to as many sums as there are domains, and a rate follows
    from a posterior and the misses of all rounds.  Targets are ``weights`` times ``total`` tokens; by
    default the most tokens that no domain need be repeated for.  Ends when every target is met
    within ``NEAR`` of it, or comes no nearer under ``max_rate``.  Without domains no step is made: rate 1.
    """
    if not names:
        return []

    def sums(rate: Column) -> list[float]:
        parts = [F.sum(F.col("tokens") * rate * F.col("posterior")[k]).alias(f"s{k}") for k in range(len(names))]
        return [float(v or 0.0) for v in now.select(*parts).first()]

    # two short columns; texts stay where they are
    now = members.select("posterior", "tokens").withColumn("rate", F.lit(1.0))
    natural = sums(F.lit(1.0))
    share = [max(weights.get(n, 0.0), 0.0) for n in names]
    share = [s / (sum(share) or 1.0) for s in share]
    if total is None:
        total = min([sum(natural), *[n / s for n, s in zip(natural, share, strict=True) if s > 0]])
    target = [s * total for s in share]
    steps, fresh, last = [], [], None
    for _ in range(ROUNDS):
        miss = [(s - t) / max(n, 1e-9) for s, t, n in zip(sums(_stepped(fresh, max_rate)), target, natural, strict=True)]
        far = max((abs(m) * n / max(t, 1e-3 * n, 1e-9) for m, n, t in zip(miss, natural, target, strict=True)), default=0.0)
        if far < NEAR or (last is not None and abs(last - far) < 1e-3 * far):
            break
        last = far
        steps.append(miss)
        fresh.append(miss)
        if len(fresh) == CUT:
            now, fresh = handover(now.withColumn("rate", _stepped(fresh, max_rate)), "rates"), []
    return steps


def rated(members: DataFrame, steps: list[list[float]], max_rate: float) -> DataFrame:
    return members.withColumn("rate", F.lit(1.0)).withColumn("rate", _stepped(steps, max_rate))


def membership(docs: DataFrame, domains: Domains) -> DataFrame:
    """``docs`` as struct ``_doc``, with ``tokens`` (words) and ``posterior``."""
    rows = with_words(docs.select(F.struct(*docs.columns).alias("_doc"), "text")).drop("text")
    return domains.posterior(rows.withColumn("tokens", (F.size("words") - 1).cast("long")))


def mix_report(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], total: float | None = None, max_rate: float = 4.0) -> DataFrame:
    """(doc_id, tokens, posterior, rate, copies) for every row of ``docs``.

    copies is the rate, rounded up with the probability of its fraction, by a hash of id and text.
    The posterior is a column ``p_<domain>`` for each domain of ``weights``, 0 for one that no label
    names.  Null and empty texts have no tokens and the prior as posterior; repeated rows get one rate
    each, all the same.  Without labelled rows all posteriors are 0 and all rates 1; no rows, no rows.
    Other columns of ``docs`` are ignored.
    """
    domains = learn(docs, labelled)
    members = handover(membership(docs.select("doc_id", "text"), domains), "members")
    members = rated(members, fit_rates(members, domains.names, weights, total, max_rate), max_rate)
    place = {n: k for k, n in enumerate(domains.names)}
    chance = F.pmod(F.xxhash64("_doc.doc_id", "_doc.text"), F.lit(1_000_000)) / 1e6
    p = [(F.col("posterior")[place[n]] if n in place else F.lit(0.0)).alias(f"p_{n}") for n in weights]
    return members.select("_doc.doc_id", "tokens", *p, "rate", (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies"))


def whole_rates(natural: dict[str, float], weights: dict[str, float]) -> dict[str, float]:
    """Rates of domains with ``natural`` tokens, measured by the one of the largest weight, which stays whole.

    Others have their weight's tokens beside it; scarcer ones stay as they are and fall short, and a
    domain without weight goes.
    """
    main = max(sorted(weights), key=lambda n: weights[n])
    total = natural.get(main, 0.0) / weights[main] if weights[main] > 0 else 0.0
    rates = {n: 1.0 if total <= 0 or v <= 0 else min(1.0, weights.get(n, 0.0) * total / v) for n, v in natural.items()}
    return {n: (1.0 if n == main else r) if weights.get(n, 0.0) > 0 else 0.0 for n, r in rates.items()}


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` thinned to the target weights; all columns as they were, no row more than once.

    A row is of the domain that it most likely belongs to; see ``whole_rates`` for how many rows of
    a domain stay, chosen by a hash of id and text.  Without labelled rows all rows stay.
    """
    domains = learn(docs, labelled)
    if not domains.names:
        return docs
    members = membership(docs, domains)
    likeliest = F.array_position("posterior", F.array_max("posterior")).cast("int")
    members = handover(members.withColumn("domain", F.element_at(F.array(*map(F.lit, domains.names)), likeliest)).drop("posterior"), "members")
    # one row a domain
    natural = {r["domain"]: float(r["n"] or 0) for r in members.groupBy("domain").agg(F.sum("tokens").alias("n")).collect()}
    rates = whole_rates(natural, weights)
    if not rates:
        return docs.limit(0)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("domain")]
    chance = F.pmod(F.xxhash64("_doc.doc_id", "_doc.text"), F.lit(1_000_000)) / 1e6
    return members.where(chance < rate).select(*[F.col("_doc")[n].alias(n) for n in docs.columns])
