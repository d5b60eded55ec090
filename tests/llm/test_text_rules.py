"""Filter audit, repetition rules and fill-in-middle, each against brute force on an awkward small table."""

import hashlib
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import filters, infill, repetition
from leadflow.llm.queries import op11_filter_audit, op12_repetition, op13_infill

KIND = "doc_id long, text string, lang string, n int, key string, part string, digest string, A string, output string"
SEPARATORS = " \t\n\x0b\x0c\r"


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    bits = ["ab", "Cd", "é", "中文", "#", "x|y", "\n", "\t", "\x0b", " ", "  ", "A.", "once more with feeling and again ", "<P>", "\n\n", "1"]
    texts = [None, "", "   \n\t", "\n", "\n\n\n", "one line", "one line\n", "<S", "a<M>b\nc", "\x00\n\x00", "😀\n" * 30, "aaaa" * 60, ("w%d " * 250) % tuple(range(250)), "same " * 250]
    texts += ["".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randrange(1, 120))) for _ in range(60)]
    line = "this line of more than forty bytes comes again and again\n"
    texts += [line * 9, line + " ".join(f"w{k}" for k in range(300)) + "\n" + line, " ".join(f"v{k}" for k in range(4000)) + "\n" + line * 3]
    texts += ["".join(f"word{k} " + "\n" * (k % 7 == 0) for k in range(40_000))]  # many blocks
    out = [(k, t, [None, "", "en", "de"][k % 4], 1, "k", "p", "d", "a", "o") for k, t in enumerate(texts)]
    out += [(3, texts[9], "en", *out[0][3:]), (200, texts[20], "de", *out[0][3:]), (201, texts[20], "en", *out[0][3:]), (200, texts[20], "de", *out[0][3:])]
    return [*out, (None, texts[20], "en", *out[0][3:]), (None, "nobody", None, *out[0][3:])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    """The tables as the registered queries read them, and an empty copy."""
    out = tmp_path_factory.mktemp("tables")
    labels = [(k, q, t, "x") for k, q, t in [(3, 1, 0), (3, None, 1), (5, 0, 1), (6, 1, 1), (200, 1, None), (999, 1, 1), (None, 1, 1), (12, None, None)]]
    spark = docs.sparkSession
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")
    for name, size in (("full", 10**6), ("empty", 0)):
        docs.limit(size).write.parquet(f"{out}/{name}/documents.parquet")
        table.limit(size).write.parquet(f"{out}/{name}/labels.parquet")
    return str(out), labels


def fails(i, text, rows):
    w, t = words(text), text
    return {
        "A": len(w) < 200,
        "B": 100 * len(set(w)) < 50 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
        "D": bool(set("#$%&*|") & set(t)),
        "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
    }


def test_filter_audit(spark, rows, folder):
    out, labels = folder
    marks = {i: (any(q == 1 for j, q, _, _ in labels if j == i), any(x == 1 for j, _, x, _ in labels if j == i)) for i, *_ in labels if i is not None}
    judged = [(lang or "", fails(i, t or "", rows), *marks.get(i, (False, False))) for i, t, lang, *_ in rows]
    want = []
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        share = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                share[f] += len(gone)
                all_failing = [j for j in own if j[1][f]]
                want.append([part, "".join(order), step, len(left), len(gone), len(all_failing) - len(gone), sum(sum(j[1].values()) == 1 for j in all_failing), sum(j[2] for j in gone), sum(j[3] for j in gone)])
        for w in want:
            if w[0] == part:
                w.append(share[w[1][w[2] - 1]])
    got = op11_filter_audit(spark, f"{out}/full")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(list, got.collect())) == sorted(want)
    assert op11_filter_audit(spark, f"{out}/empty").count() == 0
    unlabelled = filters.filter_audit(spark.read.parquet(f"{out}/full/documents.parquet"), spark.read.parquet(f"{out}/empty/labels.parquet"))
    assert unlabelled.agg(F.sum(F.col("good_lost") + F.col("toxic_lost"))).first()[0] == 0


def test_one_text_held_by_all(spark):
    """A text of all rows, without broadcasts, is spread and judged once per row."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("copy").alias("text"), F.lit("en").alias("lang"))
        got = filters.failures(same)
        assert got.where("E").count() == 1999 and got.where("not E").first().doc_id == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_shapley_values_are_exact(n):
    draw = random.Random(n)
    worth = [0] + [draw.randrange(-50, 10**12) for _ in range((1 << n) - 1)]
    want = [Fraction(0)] * n
    orders = list(permutations(range(n)))
    for order in orders:
        before = 0
        for k in order:
            want[k] += Fraction(worth[before | 1 << k] - worth[before], len(orders))
            before |= 1 << k
    assert filters.shapley(worth) == want


def test_too_many_filters(spark):
    table = spark.createDataFrame([], "part string, coalition int, docs long, removed long, good long, toxic long")
    for names in ("", "ABCDEFGH"):
        with pytest.raises(ValueError, match="between 1 and 7"):
            filters.order_steps(table, names)
    assert filters.order_steps(table, "AB").count() == 0


def repeated(text: bytes, least: int):
    """Maximal repeated substrings and the places inside any repeated substring, by trying all lengths."""
    n, at, longest, maximal = len(text), set(), 0, set()
    width = least
    while width <= n:
        places = {}
        for k in range(n - width + 1):
            places.setdefault(text[k : k + width], []).append(k)
        again = {w: p for w, p in places.items() if len(p) > 1}
        if not again:
            break
        longest = width
        for w, p in again.items():
            if width == least:
                at |= {x for k in p for x in range(k, k + width)}
            left = {text[k - 1] if k else -1 for k in p}
            right = {text[k + width] if k + width < n else -1 for k in p}
            if len(left) > 1 and len(right) > 1:
                maximal.add(w)
        width += 1
    return len(maximal), longest, at


def test_repetition(spark, docs, rows, folder, monkeypatch):
    monkeypatch.setattr(repetition, "SLICE", 3000)  # texts of several slices
    least = 12
    got = {}
    for r in repetition.repetition(docs.withColumn("at", F.lit(0)), least=least).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        text = t or ""
        raw, w = text.encode(), words(text)
        if len(raw) > 30_000:
            continue
        count, longest, at = repeated(raw, least)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        often = Counter(windows)
        n_repeat = len({x for k, g in enumerate(windows) if often[g] > 1 for x in range(k, k + 8)})
        lines = [x for x in text.split("\n") if x.strip(SEPARATORS)]
        base = len(w) < 20 or 100 * n_repeat > 30 * len(w)
        verdict = not base and 100 * len(at) <= 30 * len(raw) and 100 * longest <= 20 * len(raw)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n_repeat, len(raw), count, len(at), longest, base, verdict)
        found = [
            (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_bytes, r.n_repeats, r.n_covered, r.longest, r.base_failed, r.kept)
            for r in got[i]
        ]
        assert want in found, (i, text[:60])
        spans = [{x for s in r.spans for x in range(s.start, s.end)} for r in got[i]]
        assert at in spans
    assert sum(map(len, got.values())) == len(rows)
    assert 0 < sum(r.kept for own in got.values() for r in own) < len(rows)
    kept = repetition.keep_sound(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    with pytest.raises(ValueError, match="fewer than"):
        repetition.repetition(docs, least=3)
    out, _ = folder
    full = op12_repetition(spark, f"{out}/full").collect()
    assert len(full) == len(rows) and all(not (r.kept and r.base_failed) for r in full)
    long = next(r for r in full if r.n_bytes > 300_000)
    assert long.n_words == 40_000 and long.kept and long.n_repeat_words == 0
    assert op12_repetition(spark, f"{out}/empty").count() == 0


def test_maximal_repeats_of_random_texts():
    draw = random.Random(1)
    for _ in range(150):
        least, texts = draw.choice([5, 6, 9, 12]), []
        for _ in range(draw.randint(0, 4)):
            base = bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 25)))
            texts.append(base + bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 15))) + base[: draw.randint(0, 25)] + base)
        texts.append(b"a" * draw.randint(0, 30))
        bounds = np.cumsum([0] + [len(t) for t in texts])
        text, length, begin, stop = repetition.repeats(np.frombuffer(b"".join(texts), np.uint8), bounds[:-1], bounds[1:], least)
        for k, t in enumerate(texts):
            own = length[text == k]
            at = {x - bounds[k] for b, e in zip(begin, stop, strict=True) if bounds[k] <= b < bounds[k + 1] for x in range(b, e)}
            assert (len(own), max(own, default=0), at) == repeated(t, least)


def test_infill(spark, docs, rows, folder, monkeypatch):
    monkeypatch.setattr(infill, "BLOCK", 16)  # cuts in many blocks
    monkeypatch.setattr(infill, "SLICE", 2000)
    out, _ = folder
    for settings in ({}, {"seed": 1, "rate": 60, "spm": 20, "marks": ("p", "s", "m")}):
        made = infill.fill_in_middle(docs, **settings)
        marks = settings.get("marks", infill.MARKS)
        back = made.withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).collect()
        want, forms = [], Counter()
        for i, t, *_ in rows:
            text = t or ""
            units = re.findall(r"[^\n]*\n|[^\n]+", text)
            digest = hashlib.sha256(f"{settings.get('seed', 7)}:{'' if i is None else i}".encode()).hexdigest()
            h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
            low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
            p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
            if not text or any(x in text for x in marks) or h[2] % 100 >= settings.get("rate", 100):
                want.append((repr(i), len(units), "plain", None, None, text, text))
            elif h[3] % 100 < settings.get("spm", 50):
                want.append((repr(i), len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m, text))
            else:
                want.append((repr(i), len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m, text))
            forms[want[-1][2]] += 1
        found = [(repr(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in back]
        assert sorted(found, key=repr) == sorted(want, key=repr)
        assert min(forms.values()) > 5 and len(forms) == 3
        if not settings:
            digests = sorted((repr(r.doc_id), r.output_sha256, r.restored_sha256) for r in op13_infill(spark, f"{out}/full").collect())
            assert digests == sorted((w[0], *(hashlib.sha256(x.encode()).hexdigest() for x in w[5:])) for w in want)
    assert op13_infill(spark, f"{out}/empty").count() == 0
    for bad in (("<P>", "<S>", "<P>"), ("<P>", "[S]", "<M>"), ("", "a", "b"), ("<", "<S>", "<M>")):
        with pytest.raises(ValueError, match="marks"):
            infill.fill_in_middle(docs, marks=bad)


def test_fenwick_descent():
    draw = np.random.default_rng(2)
    for size in (1, 2, 7, 8, 33):
        counts = draw.integers(0, 4, size)
        tree, sums = infill.Fenwick(counts), np.concatenate([[0], np.cumsum(counts)])
        assert (tree.before(np.arange(size + 1)) == sums).all()
        nth = np.arange(1, sums[-1] + 1)
        block, left = tree.descend(nth)
        assert (sums[block] < nth).all() and (sums[block + 1] >= nth).all() and (left == nth - sums[block]).all()
