"""How filters interact: every coalition of them tabulated, order effects and Shapley values from the table.

A filter's share of the removals is its Shapley value over all orders.  It is found without walking
the orders: the values solve a least-squares problem over coalitions, weighted by the Shapley kernel
and held to efficiency (they add up to what all filters remove together), here in rationals and so
exactly.  What a filter removes at a step is a difference of two coalitions.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import stored
from leadflow.operators.shared import spread_lookup

#: More filters have too many orders to list (8! is 40,320 rows a step and part).
MOST = 7

#: The text filters of the audit; E, identity with an earlier document, is a matter of the whole table.
WORDS_AT_LEAST = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 3
SYMBOLS = "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text: short, repetitive, shouting, holding symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    n = F.size(words)
    return {
        "A": n < WORDS_AT_LEAST,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * capitals.cast("long") > CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E): which filters each row of ``docs`` fails; one row per row.

    ``part`` is the value of that column, null as the empty text; a null text counts as empty.  E
    holds where a smaller doc_id of the table has the identical text (told by SHA-256); a null
    doc_id is neither smaller nor larger than any, and rows that repeat a doc_id do not fail for
    each other.  Texts of any length are read whole, each once; of what follows, rows are digests
    and marks, and a text that very many rows share is spread over all shuffle partitions.  Columns
    of ``docs`` other than doc_id, text and ``part`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.monotonically_increasing_id().alias("n"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        *[c.alias(name) for name, c in text_failures(text).items()],
    )
    marks = stored(marks, "marks")
    shared = marks.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    shared = shared.where("rows > 1").select("digest", "least")
    found = spread_lookup(marks, shared, ["digest"], ["n"])
    again = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    return found.select("doc_id", "part", *"ABCD", again.alias("E"))


def coalitions(failing: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """(part, coalition, docs, removed, good, toxic): what each set of filters removes together, per part.

    ``failing`` has doc_id, part and a boolean per filter; bit k of ``coalition`` stands for the k-th
    filter.  ``docs`` are all documents of the part, ``good`` and ``toxic`` the removed ones that
    ``labels`` (doc_id, quality, toxic) marks with 1; a document marked in any of its rows there is
    marked.  Documents without labels count as neither.  All coalitions appear, zeros included; no
    documents, no rows.  Documents are counted by the set of filters they fail, with map-side
    combine, so a part with any share of all rows is at most 2^filters rows a task.
    """
    one = F.lit(1)
    marked = labels.groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"),
    ).where("good + toxic > 0")
    fails = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate(names)), F.lit(0))
    slim = stored(failing.select("doc_id", "part", fails.alias("fails"), F.monotonically_increasing_id().alias("n")), "failing")
    known = spread_lookup(slim, marked, ["doc_id"], ["n"])
    sets = known.groupBy("part", "fails").agg(
        F.count(one).alias("rows"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    each = sets.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))))
    hit = F.col("coalition").bitwiseAND(F.col("fails")) != 0

    def total(c: str) -> Column:
        return F.sum(F.when(hit, F.col(c)).otherwise(0))

    return each.groupBy("part", "coalition").agg(
        F.sum("rows").alias("docs"), total("rows").alias("removed"), total("good").alias("good"), total("toxic").alias("toxic")
    )


def _solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """Solution of a regular system by elimination in rationals."""
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    for k in range(len(rows)):
        pivot = next(r for r in range(k, len(rows)) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(len(rows)):
            if r != k and rows[r][k]:
                rows[r] = [x - rows[r][k] * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [row[-1] for row in rows]


def shapley(worth: list[int]) -> list[Fraction]:
    """Exact Shapley values of a game; ``worth[S]`` is the worth of coalition S as a bit set, worth[0] = 0.

    They minimise the sum over proper coalitions of k(S) (worth(S) - sum of values in S)^2 with
    k(S) = (n - 1) / (C(n, |S|) |S| (n - |S|)), under the constraint that all values add up to the
    worth of the full set.  The normal equations are bordered by that constraint and solved.
    """
    n = len(worth).bit_length() - 1
    if n == 1:
        return [Fraction(worth[1])]
    full = (1 << n) - 1
    matrix = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    right = [Fraction(0)] * (n + 1)
    for s in range(1, full):
        members = [k for k in range(n) if s >> k & 1]
        size = len(members)
        kernel = Fraction(n - 1, comb(n, size) * size * (n - size))
        for i in members:
            right[i] += kernel * worth[s]
            for j in members:
                matrix[i][j] += kernel
    for k in range(n):
        matrix[k][n] = matrix[n][k] = Fraction(1)
    right[n] = Fraction(worth[full])
    return _solved(matrix, right)[:n]


STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def _orders(names: str):
    def audit(table: pa.Table) -> pa.Table:
        size = 1 << len(names)
        of = {c: [0] * size for c in ("docs", "removed", "good", "toxic")}
        for row in table.to_pylist():
            for c in of:
                of[c][row["coalition"]] = row[c]
        gone, full = of["removed"], size - 1
        # summed over all orders instead of averaged: integers
        share = [int(v * factorial(len(names))) for v in shapley(gone)]
        part, out = table["part"][0].as_py(), []
        for order in permutations(range(len(names))):
            before = 0
            for step, f in enumerate(order, 1):
                after = before | 1 << f
                removed = gone[after] - gone[before]
                out.append({
                    "part": part, "filter_order": "".join(names[k] for k in order), "step": step, "kept": of["docs"][0] - gone[after],
                    "removed": removed, "redundant": gone[1 << f] - removed, "unique_fails": gone[full] - gone[full & ~(1 << f)],
                    "good_lost": of["good"][after] - of["good"][before], "toxic_lost": of["toxic"][after] - of["toxic"][before], "shapley": share[f],
                })
                before = after
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        return pa.Table.from_pylist(out, pa.schema([(c, kinds[k]) for c, k in (f.split() for f in STEPS.split(", "))]))

    return audit


def order_steps(table: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step of it, from a table of ``coalitions``.

    kept: documents left after the step; removed: those it takes; redundant: those failing its
    filter that earlier steps took; unique_fails: those failing no other filter; good_lost and
    toxic_lost: marked ones among the removed; shapley: what its filter removes, summed over all
    orders.  A part is one group of 2^filters rows, however many documents it has.
    """
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"between 1 and {MOST} filters can be audited")
    return table.groupBy("part").applyInArrow(_orders(names), STEPS)


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of filters A to E over ``docs``: see ``failures``, ``coalitions`` and ``order_steps``."""
    return order_steps(coalitions(failures(docs, part), labels))
