"""Each operator on an awkward small table, against brute force or a round trip."""

import hashlib
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadflow.llm import common, decontaminate, embeddings, langid, mixing, pii, pitman_yor, quality, rans, simhash, substrings, tokens
from leadflow.llm.common import components

WORDS = [f"{a}{b}{c}" for a in ("ba", "do", "ki") for b in ("la", "ne", "ru", "so") for c in ("", "m", "t")]
KIND = "doc_id long, text string, lang string, row string, fp int, part string, key string, kind int, _doc string, node int, held_out boolean"


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 150)
    long = prose(2, 30_000)
    near = base.replace(" ", "  ", 3)
    out = {1: base, 2: base, 3: near, 4: "", 5: None, 6: "   \n\t", 7: long, 8: base + " tail " + prose(3, 300), 9: "é", 10: "12 !!"}
    out |= {k: prose(k, 60) + "." for k in range(20, 50)}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "xx" if k % 2 else "yy", "r", 1, "p", "k", 2, "d", 3, False) for k, t in texts.items()]
    rows += [(21, texts[21], None, None, None, None, None, None, None, None, None), (None, "nobody here", None, "r", 1, "p", "k", 2, "d", 3, True)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def all_rows(docs):
    return [(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()]


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 1), (1, 9), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got.get(9) == 1 and got[160] == 100 and 7 not in got
    hub = [(0, k) for k in range(1, 400)]
    assert {r.component for r in components(spark.createDataFrame(hub, "a long, b long")).collect()} == {0}


def test_simhash(docs, empty):
    got = simhash.simhash_groups(docs, width=3, radius=2).collect()
    rows = all_rows(docs)
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(i) for i, _ in rows)
    prints = {t: simhash.fingerprint(t.encode(), 3)[0] for _, t in rows}
    group = {f: f for f in prints.values()}
    for _ in prints:  # smallest fingerprint within reach
        group = {f: min(group[g] for g in group if bin(f ^ g).count("1") <= 2) for f in group}
    least = {}
    for i, t in rows:
        if i is not None:
            least[group[prints[t]]] = min(i, least.get(group[prints[t]], i))
    want = sorted((repr(i), f"{prints[t]:016x}", repr(least.get(group[prints[t]]))) for i, t in rows)
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    assert simhash.simhash_groups(empty).count() == 0


def test_wide_fingerprints_keep_one(docs, empty):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {1, 7, 8, 10} <= set(ids) and not {2, 3} & set(ids) and ids.count(21) == 1
    assert len({4, 5, 6} & set(ids)) == 1 and ids.count(None) == 1
    assert simhash.keep_one_of_each(empty).count() == 0


def alike(a: str, b: str) -> float:
    """Share of distinct runs of five words that two texts have in common."""
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_near_duplicates_are_verified(spark, monkeypatch):
    texts = {}
    for k in range(40):  # pairs that share a beginning: similarities from 0.55 to 0.95
        base, other = prose(1000 + k, 400), prose(2000 + k, 400)
        shared = 300 + 2 * k + (k % 3)
        texts[2 * k], texts[2 * k + 1] = base, " ".join(base.split()[:shared] + other.split()[shared:])
    line = prose(7, 8) + " "
    texts |= {200 + k: line * 60 + prose(3000 + k, 30) for k in range(2)}  # one line often, else different
    texts |= {300 + k: " ".join(f"crowd{i}" for i in range(200)) + f" {k}" for k in range(30)}
    links = [(a, b) for a in texts for b in texts if a < b and alike(texts[a], texts[b]) >= 0.8]
    least = {k: k for k in texts}
    for _ in texts:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    want = {k for k in texts if least[k] == k}
    assert {200, 201} <= want and 31 < len(texts) - len(want) < 70
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == want
    monkeypatch.setattr(simhash, "SET_BYTES", 6_000)  # several tiles a group
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == want


def test_embeddings(spark):
    draw = np.random.default_rng(5)
    base = draw.normal(size=(30, 16))
    rows = [(k, [float(x) for x in v], k % 2) for k, v in enumerate(base)]
    rows += [(100 + k, [float(x) for x in base[k % 4] + draw.normal(size=16) * 0.05], (k % 4) % 2) for k in range(60)]
    rows += [(200, [0.0] * 16, 1), (201, None, 1), (202, [1.0, None], 1), (203, [float("nan")] * 16, 1), (204, rows[0][1], None), (205, [], 0), (206, [1e-200] * 16, 0), (207, [1e200] * 16, 0), (0, rows[0][1], 0)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(data).collect())

    def usable(r):
        return r[2] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])

    unit = [np.array(r[1]) / max(map(abs, r[1])) if usable(r) else None for r in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    link = [[j for j in range(len(rows)) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98] for i in range(len(rows))]
    least = [r[0] for r in rows]
    for _ in rows:
        least = [min([least[i], *(least[j] for j in link[i])]) for i in range(len(rows))]
    assert got == sorted((r[0], len(link[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows))
    assert embeddings.embedding_groups(data.limit(0)).count() == 0


def test_decontamination(spark, docs, empty, monkeypatch):
    long = prose(2, 30_000).split()
    items = [(1, " ".join(long[500:530])), (2, " ".join(long[505:512]) + "!"), (3, None), (4, ""), (5, prose(24, 60).upper()), (6, "É"), (2, "never seen")]
    bench = spark.createDataFrame([(str(i), t, "x") for i, t in items], "item_id string, text string, doc_id string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = []
    for i, t in all_rows(docs):
        w, hit, ids = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (own := grams.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= own
        want.append((repr(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))

    def report():
        return sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontamination_report(docs, bench).collect())

    assert report() == sorted(want)
    clean = decontaminate.remove_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)  # several parts
    assert report() == sorted(want)
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).where("doc_id is not null").collect()}
    assert cut[1] == prose(1, 150) and len(cut[7].split()) == 30_000 - 30 and cut[4] == ""
    assert decontaminate.decontamination_report(empty, bench).count() == 0
    assert decontaminate.decontamination_report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_rans_round_trip():
    draw = np.random.default_rng(3)
    ids = np.minimum(draw.zipf(1.4, 400_000), 49_999).astype(np.uint16)
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=50_257)))
    block = table.encode(ids)
    assert len(block) < ids.nbytes and (table.decode(block) == ids).all()
    step = rans.LANES * rans.EVERY
    assert (table.decode(block, 1, 3) == ids[step : 3 * step]).all()  # from a checkpoint
    for n in (0, 1, 7):
        assert (table.decode(table.encode(ids[:n])) == ids[:n]).all()
    with pytest.raises(ValueError):
        table.decode(block[:-1] + bytes([block[-1] ^ 1]))
    assert rans.scaled(np.array([0, 5, 10**12, 1])).sum() == 1 << rans.SCALE


def test_tokens(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = tokens.token_files(docs, path, end=2).collect()
    rows = sorted(all_rows(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    at, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((repr(i), at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((repr(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert tokens.token_files(empty, path).count() == 0


def test_tokens_equal_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.Tokens(path), Tokenizer.from_file(path)
    draw = random.Random(4)
    bits = ["the", "don't", "  ", " \n", "\n", "\n\n", "a.", "é,", "ß", "1,", ",,", "'s", " ", " x", "\x1c", "\t", "中文。", "<|endoftext|>", " ", "x" * 40, "Ġ", "\r\n", "é."]
    texts = ["", " ", "a", *["".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randrange(1, 14))) for _ in range(1500)]]
    import pyarrow as pa

    for text, ids in zip(texts, own.batch(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, own.width).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert 0 < own.held and max(map(len, own.ids)) <= tokens.SHORT
    monkeypatch.setattr(tokens, "REMEMBER", 2000)  # forgets over and over
    for text, ids in zip(texts, own.batch(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, own.width).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert own.held <= 2000


def test_near_duplicates_move_no_texts(spark, docs):
    """Which rows stay is told without a shuffle of the texts, whatever may be broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.keep_one_of_each(docs)
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_links_of_grouped_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "GROUP", 3)
    monkeypatch.setattr(simhash, "SPREAD", 2)
    draw = random.Random(5)
    fps = [draw.getrandbits(64) for _ in range(60)]
    fps = list({f ^ (1 << draw.randrange(64)) if k % 2 else f for k in range(4) for f in fps})
    rows = [(k, [f - (1 << 64) if f >> 63 else f]) for k, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "node long, fp array<long>"), 2).collect()
    near = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]

    def groups(pairs):
        root = list(range(len(fps)))
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert near and groups([(r.a, r.b) for r in links]) == groups(near)
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in links} <= {(a, b) for a in range(len(fps)) for b in range(a)}


def test_chosen_rows(spark):
    from leadflow.llm.common import chosen_rows

    rows = spark.range(0, 70_000, 1, 3).withColumn("row", F.monotonically_increasing_id()).localCheckpoint()
    wanted = rows.where("id % 7 = 3 or id between 40000 and 40050").select("row")
    got = chosen_rows(rows, wanted)
    assert got.columns == ["id", "row"]
    assert sorted(r.id for r in got.collect()) == [k for k in range(70_000) if k % 7 == 3 or 40000 <= k <= 40050]
    assert chosen_rows(rows, wanted.limit(0)).count() == 0


def test_tokens_learn_each_piece_once(monkeypatch):
    """Three hundred thousand distinct words fit in a worker's memory of ids, and the library sees each once."""
    import pyarrow as pa

    own, asked = tokens.Tokens(public_tokenizers.path("byte_bpe_50k.json")), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda pieces: (asked.append(len(pieces)), learn(pieces))[1])
    letters = "abcdefghij"
    words = ["".join(letters[int(c)] for c in str(k)) for k in range(100_000, 400_000)]
    texts = pa.array([" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)])
    first = [i for at in range(0, 300, 50) for i in own.batch(texts[at : at + 50])]
    assert sum(asked) >= 300_000 and own.held < tokens.REMEMBER
    asked.clear()
    assert own.batch(texts) == first
    assert sum(asked) == 0


def test_language(spark, docs, empty):
    rows = [(k, prose(k, 40) if k % 2 else " ".join(w[::-1] + "x" for w in prose(k, 40).split()), "xx" if k % 2 else "yy") for k in range(300)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = langid.train(known.where("doc_id < 200"))
    found = {r.doc_id: r for r in langid.predict(known.where("doc_id >= 200"), network).collect()}
    assert sum(found[k].lang_pred == lang for k, _, lang in rows[200:]) >= 97
    odd = {r.doc_id: r for r in langid.predict(docs, network).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (4, 5, 6, 10)) and odd[9].lang_pred != "und"
    assert len(langid.predict(docs, network).collect()) == docs.count()
    kept = langid.keep_recognised(docs, network)
    assert kept.columns == docs.columns and not {4, 5, 6, 10} & {r.doc_id for r in kept.collect()}
    assert langid.train(empty) is None and langid.predict(docs, None).where("lang_pred <> 'und'").count() == 0


def test_gradients():
    network = langid.Network(["a", "b", "c"], seed=1)
    symbols, active, order = langid._matrix([b"abcab", b"ca", b"bbb"])
    labels = np.array([0, 2, 1])[order]

    def loss():
        _, logits = network.logits(symbols, active)
        logs = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        on = np.arange(3)[None, :] < active[:, None]
        return -(logs[:, labels, np.arange(3)] * on).sum() / active.sum()

    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    grads = network._gradients(symbols, active, labels)
    for name, cell in (("out", (1, 3)), ("re_f", (2, 1)), ("re_b", (20, 5)), ("in_f", (9, 97)), ("in_b", (17, 98)), ("bias", (2, 0))):
        old = network.p[name][cell]
        sides = []
        for move in (1e-2, -1e-2):
            network.p[name][cell] = old + move
            sides.append(loss())
        network.p[name][cell] = old
        assert abs((sides[0] - sides[1]) / 2e-2 - grads[name][cell]) < 2e-3


def test_quality(spark, docs, empty):
    rows = [(prose(k, 80) if k % 3 else (prose(k, 6) + "!! ").upper() * 9, int(k % 3 > 0)) for k in range(400)]
    known = spark.createDataFrame(rows, "text string, y int")
    model = quality.train(known)
    test = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.score for r in quality.score(test, model).collect()}
    assert sum((found[k] > 0.5) == bool(y) for k, (_, y) in enumerate(rows)) > 395
    assert len(model.pairs) == quality.PAIRS
    scores = [r.score for r in quality.score(docs, model).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert quality.train(known.where("y > 5")) is None and quality.score(empty, model).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(k, prose(k, 50) + (" spam" * 5 if k % 4 == 0 else " ham" * 5), "x") for k in range(200)]
    data = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x"), (7, rows[7][1], "y"), (None, "spam spam", "z")], "doc_id long, text string, tokens string")
    labels = spark.createDataFrame([(k, "bad" if k % 4 == 0 else "good") for k in range(120)] + [(None, "bad"), (3, None)], "doc_id long, domain string")
    got = mixing.mix_report(data, labels, {"good": 0.9, "bad": 0.1}).collect()
    assert len(got) == 204 and all(r.rate >= 0 and abs(r.p_good + r.p_bad - 1) < 1e-9 for r in got)
    of = {d: sum(r.tokens * r.rate * r[f"p_{d}"] for r in got) for d in ("good", "bad")}
    assert abs(of["bad"] / (of["good"] + of["bad"]) - 0.1) < 0.002
    # the same rates from the posteriors alone
    p, n = np.array([[r.p_bad, r.p_good] for r in got]), np.array([r.tokens for r in got], float)
    natural, rate = n @ p, np.ones(len(n))
    total = min(natural.sum(), natural[1] / 0.9, natural[0] / 0.1)
    for _ in range(500):
        rate = np.clip(rate - p @ (((n * rate) @ p - total * np.array([0.1, 0.9])) / natural), 0, 4)
    assert np.abs(rate - [r.rate for r in got]).max() < 0.02
    kept = mixing.mix(data, labels, {"good": 0.95, "bad": 0.05})
    assert kept.columns == data.columns and kept.count() < 204


def test_mixing_keeps_the_good(spark):
    """However scarce the others are, good rows all stay; rows of no weight go."""
    kinds = {k: "toxic" if k % 100 == 0 else "low" if k % 10 == 1 else "good" for k in range(1000)}
    mark = {"toxic": " venom" * 6, "low": " spam" * 6, "good": " ham" * 6}
    data = spark.createDataFrame([(k, prose(k, 30) + mark[d]) for k, d in kinds.items()], "doc_id long, text string")
    labels = spark.createDataFrame([*kinds.items()], "doc_id long, domain string")
    kept = Counter(kinds[r.doc_id] for r in mixing.mix(data, labels, {"good": 0.9, "low": 0.07, "toxic": 0.0}).collect())
    want = 0.07 / 0.9 * sum(d == "good" for d in kinds.values())
    assert kept["good"] == sum(d == "good" for d in kinds.values()) and kept["toxic"] == 0
    assert abs(kept["low"] - want) < 20
    scarce = mixing.whole_rates({"good": 950.0, "low": 40.0, "toxic": 10.0}, {"good": 0.9, "low": 0.07, "toxic": 0.0})
    assert scarce == {"good": 1.0, "low": 1.0, "toxic": 0.0}
    assert mixing.mix(data.limit(0), labels, {"good": 1.0}).count() == 0


def test_mixing_without_labels(spark):
    """No labels, unknown marks, or one domain only: rate 1 where nothing is known, the same columns always."""
    data = spark.createDataFrame([(1, "some text"), (2, None), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    weights = {"good": 0.9, "low": 0.1}
    for labels in (none, spark.createDataFrame([(1, None), (None, "good")], none.schema)):
        report = mixing.mix_report(data, labels, weights)
        assert report.columns == ["doc_id", "tokens", "p_good", "p_low", "rate", "copies"]
        assert [(r.p_good, r.p_low, r.rate, r.copies) for r in report.collect()] == [(0.0, 0.0, 1.0, 1)] * 3
        assert mixing.mix(data, labels, weights).count() == 3
    one = mixing.mix_report(data, spark.createDataFrame([(1, "good")], none.schema), weights)
    assert one.columns == ["doc_id", "tokens", "p_good", "p_low", "rate", "copies"] and one.count() == 3
    assert mixing.mix_report(data.limit(0), none, weights).count() == 0


def test_language_model(docs, empty):
    held = docs.withColumn("held_out", F.col("doc_id") % 5 == 0)
    got = pitman_yor.lm_scores(held).collect()
    rows = [(r.doc_id, r.text or "", bool(r.held_out)) for r in held.collect()]
    split = [[*re.findall(r"[^\x20\x09-\x0D]+", t.lower() if t.isascii() else t), ""] for _, t, _ in rows]
    seen = Counter(w for s, (_, _, h) in zip(split, rows, strict=True) if not h for w in s)
    total, distinct = sum(seen.values()), len(seen)
    want = sorted((repr(i), len(s), sum(seen[w] > 0 for w in s), total, round(sum(np.log10((seen[w] + 1) / (total + distinct + 1)) for w in s), 4)) for s, (i, _, _) in zip(split, rows, strict=True))
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.lm_scores(empty).count() == 0


def one_by_one(pairs, dishes, d, sweeps, seed, counts=None):
    """p(w | u) by plain Gibbs sampling: every customer leaves and sits again, in both restaurants."""
    draw = random.Random(seed)
    child, root, mean = {}, {}, Counter()
    contexts = sorted({u for u, _ in pairs})
    size = Counter(u for u, w in pairs.elements())
    tables, all_t, all_r = Counter(), 0, 0
    strength, back = pitman_yor.STRENGTH, pitman_yor.ROOT_DISCOUNT

    def p_root(w):
        own = root.get(w, [])
        return (sum(own) - back * len(own) + (strength + back * all_r) / dishes) / (strength + all_t)

    def sit(own, d, fresh):
        at = draw.random() * (fresh + sum(own) - d * len(own)) - fresh
        for k, s in enumerate(own):
            if 0 <= at < s - d:
                own[k] += 1
                return 0
            at -= s - d if at >= 0 else 0
        own.append(1)
        return 1

    def leave(own):
        k = draw.choices(range(len(own)), own)[0]
        own[k] -= 1
        if own[k]:
            return 0
        own.pop(k)
        return 1

    for sweep in range(sweeps):
        for u, w in pairs.elements():
            own = child.setdefault((u, w), [])
            if sweep and leave(own):
                tables[u], all_t = tables[u] - 1, all_t - 1
                all_r -= leave(root[w])
            if sit(own, d, (strength + d * tables[u]) * p_root(w)):
                tables[u] += 1
                fresh = (strength + back * all_r) / dishes
                all_t, all_r = all_t + 1, all_r + sit(root.setdefault(w, []), back, fresh)
        if sweep >= sweeps // 4:
            for u in contexts:
                for w in {w for _, w in pairs}:
                    own = child.get((u, w), [])
                    if counts is not None:
                        counts[u, w] += len(own) / (sweeps - sweeps // 4)
                    near = sum(own) - d * len(own)
                    mean[u, w] += (near + (strength + d * tables[u]) * p_root(w)) / (strength + size[u]) / (sweeps - sweeps // 4)
    return mean


def test_every_training_word_is_a_dish(spark):
    draw = random.Random(4)
    follow = {w: draw.sample(WORDS, 3) for w in WORDS}
    rows = []
    for k in range(60):
        text = [draw.choice(WORDS[:6])]
        while len(text) < 20:
            text.append(draw.choice(follow[text[-1]]))
        rows.append((k, " ".join(text), False))
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    pairs = Counter(p for _, t, _ in rows for p in zip(["<", *t.split()], [*t.split(), ">"], strict=True))
    n1, n2 = (sum(c == n for c in pairs.values()) for n in (1, 2))
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))
    mean = one_by_one(pairs, len({w for _, w in pairs}) + 1, d, 200, 1)
    for r in pitman_yor.lm_scores(docs).collect():
        text = rows[r.doc_id][1].split()
        want = sum(np.log10(mean[p]) for p in zip(["<", *text], [*text, ">"], strict=True))
        assert abs(r.score - want) < 0.05 * abs(want)


def tables_of(c: int, others: int, p: float, d: float) -> float:
    """Mean number of tables of a row with ``c`` customers, given what it shares, summed over all counts."""
    t = np.arange(c + 1)
    ways = np.where(t == 1, 0.0, -np.inf)
    with np.errstate(divide="ignore"):
        for k in range(1, c):
            ways = np.logaddexp(np.log(np.maximum(k - d * t, 0)) + ways, np.concatenate([[-np.inf], ways[:-1]]))
        ways[1:] += np.cumsum(np.log(p * (pitman_yor.STRENGTH + d * (others + t[:-1]))))
    chance = np.exp(ways - ways.max())
    return (chance * t).sum() / chance.sum()


@pytest.mark.parametrize(("c", "others", "p", "d"), [(2, 5, 0.1, 0.7), (200, 50, 0.05, 0.8), (1500, 300, 0.05, 0.8), (1500, 2, 0.5, 0.5)])
def test_all_customers_are_seated(monkeypatch, c, others, p, d):
    monkeypatch.setattr(pitman_yor, "CHUNK", 10_000)
    n, seen = 300, []
    columns = [np.arange(n), np.arange(n), np.full(n, c), pa.array([[0]] * n, pa.list_(pa.int64())), np.zeros(n, np.int64), np.full(n, others + 1), np.full(n, p)]
    for sweep in range(24):
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "w", "c", "opened", "c_old", "t_u", "p"])
        got = next(pitman_yor._seat(sweep, d)([batch]))
        columns[3:6] = got.column("opened"), np.full(n, c), others + got.column("t").to_numpy()
        seen.append(got.column("t").to_numpy().mean())
    assert abs(np.mean(seen[9:]) / tables_of(c, others, p, d) - 1) < 0.05


def test_tables_of_frequent_rows(spark):
    """A row of thousands has as many tables as when its customers leave and sit one by one."""
    pairs = Counter({(u, w): 2000 for u in range(3) for w in range(4)} | {(u, 4): 1 for u in range(2)} | {(2, 4): 2})
    near, _, d = pitman_yor.sampled(spark.createDataFrame([(*k, c) for k, c in pairs.items()], "u long, w long, c long"), dishes=6)
    size = Counter(u for u, _ in pairs.elements())
    got = [(pairs[r.u, r.w] - r.near * (pitman_yor.STRENGTH + size[r.u])) / d for r in near.collect() if r.w < 4]
    opened = np.mean(got)
    assert len(got) == 12
    tables = Counter()
    one_by_one(pairs, 6, d, 24, 3, tables)
    want = np.mean([tables[u, w] for u in range(3) for w in range(4)])
    assert abs(opened / want - 1) < 0.3


def test_model_probabilities_add_up(spark):
    """Averaged predictive probabilities of all dishes after any context add up to 1."""
    draw = np.random.default_rng(2)
    counts = Counter((int(u), int(w)) for u, w in zip(draw.integers(0, 4, 3000), draw.zipf(1.5, 3000) % 9, strict=True))
    pairs = spark.createDataFrame([(u, w, c) for (u, w), c in counts.items()], "u long, w long, c long")
    near, samples, d = pitman_yor.sampled(pairs, dishes=9)
    near = {(r.u, r.w): r.near for r in near.collect()}
    of = {r.id: r for r in samples.collect()}
    assert 0 < d < 1
    for u in range(4):
        assert abs(sum(near.get((u, w), 0.0) + np.mean(np.array(of[u].g) * of[w].p) for w in range(9)) - 1) < 1e-9


def test_language_model_in_many_buckets(spark, monkeypatch):
    """Parts of a few words, contexts dealt to many buckets: counts exact, probabilities add up, scores as in one bucket."""
    draw = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{int(x) % 30}" for x in draw.zipf(1.4, 25)), k % 4 == 0) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    counts = Counter((int(u), int(w)) for u, w in zip(draw.integers(0, 4, 3000), draw.zipf(1.5, 3000) % 9, strict=True))
    pairs = spark.createDataFrame([(u, w, c) for (u, w), c in counts.items()], "u long, w long, c long")
    plain = {r.doc_id: r for r in pitman_yor.lm_scores(docs).collect()}
    monkeypatch.setattr(pitman_yor, "PART", 300)
    monkeypatch.setattr(pitman_yor, "HOT", 20)
    monkeypatch.setattr(pitman_yor, "WORD_BYTES", 2000)
    monkeypatch.setattr(pitman_yor, "CONTEXT_BYTES", 1000)
    got = {r.doc_id: r for r in pitman_yor.lm_scores(docs).collect()}
    assert got.keys() == plain.keys()
    for k, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (plain[k].n_tokens, plain[k].n_known, plain[k].train_tokens)
        assert abs(r.base_score - plain[k].base_score) < 1e-9
    # every seating is a draw of its own
    assert abs(sum(r.score for r in got.values()) / sum(r.score for r in plain.values()) - 1) < 0.01
    near, samples, _ = pitman_yor.sampled(pairs, dishes=9)
    near, of = {(r.u, r.w): r.near for r in near.collect()}, {r.id: r for r in samples.collect()}
    for u in range(4):
        assert abs(sum(near.get((u, w), 0.0) + np.mean(np.array(of[u].g) * of[w].p) for w in range(9)) - 1) < 1e-9


def test_unseen_words_have_the_rest(spark):
    """What words of the training texts leave over is the probability of all others."""
    texts = [(k, "", False) for k in range(30)] + [(100, "", True), (101, "new", True), (102, "new words", True)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean")
    score = {r.doc_id: r.score for r in pitman_yor.lm_scores(docs).where("held_out").collect()}
    again = 10 ** (score[102] - score[101])  # unseen after unseen
    assert abs(10 ** score[101] - (1 - 10 ** score[100]) * (1 - again)) < 1e-9


def test_personal_data(spark, empty):
    texts = ["mail a.b@c-d.org, 1.2.3.400 or 1.2.3.4; +1 (244) 555-4688 and 4111 1111 1111 1111", None, "", "é 4111-1111-1111-1112 +12 34", "call tel 244-555-4688 or john [at] host [dot] com", "x" * 300_000 + "@y.z"]
    docs = spark.createDataFrame([(k, t, "b") for k, t in enumerate(texts)] + [(0, texts[0], "c")], "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    first = got[0]
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 1, 1)
    at = {k: texts[0].index(v) for k, v in (("email", "a.b@"), ("ip", "1.2.3.4;"), ("card", "4111"), ("phone", "+1"))}
    base = f"email:{at['email']}:{at['email'] + 11},ip:{at['ip']}:{at['ip'] + 7},card:{at['card']}:{at['card'] + 19},phone:{at['phone']}:{at['phone'] + 17}"
    assert first.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and first.spans == base
    assert got[1].spans == got[2].spans == "" and got[3].n_card == 0 and got[5].n_email == 1
    assert pii.pii_report(empty).count() == 0


#: Kinds of personal data with their pattern and what a match must hold, as the contract states them.
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= sum(c.isdigit() for c in m) <= 19 and check_digit(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= sum(c.isdigit() for c in m) <= 15),
}


def check_digit(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def test_base_spans_equal_plain_patterns(spark):
    draw = random.Random(8)
    bits = ["a.b@c-d.org", "@", "x@y", ".com", "1.2.3.4", "255", "256", ".", "00", "4111 1111 1111 1111", "4", "1", "-", " ", "+1 ", "(244)", "555", "é", "中", "ip ", "tel ", "\n"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(0, 40))) for _ in range(1500)]
    texts += ["0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 5000 + "4", "9" * 6000 + ".1.1.1", "4" * 7000, "+1" + "2" * 9000, "a" * 5000 + "@b" + ".c" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.pii_report(docs).collect():
        spans, counts = [], []
        for kind, (pattern, holds) in PLAIN.items():
            own = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, texts[r.doc_id]) if holds(m.group())]
            spans, counts = spans + own, [*counts, len(own)]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts, texts[r.doc_id][:80]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r.spans.split(","))


def test_reliabilities_find_the_bad_labeler():
    draw = np.random.default_rng(1)
    truth = draw.integers(0, 5, 2000)
    good = [np.where(draw.random(2000) < 0.9, truth, draw.integers(0, 5, 2000)) for _ in range(3)]
    votes = np.stack([*good, draw.integers(0, 5, 2000)], axis=1)
    _, table, belief = pii.reliabilities(votes, np.ones(2000))
    assert (belief.argmax(axis=1) == truth).mean() > 0.95
    right = [np.mean([table[j, c, c + 1] for c in range(5)]) for j in range(4)]
    assert min(right[:3]) > 0.8 > 0.4 > right[3]


@pytest.mark.parametrize("crowd", [300, 2])
def test_repeated_strings(docs, empty, monkeypatch, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = [(i, t.encode()) for i, t in all_rows(docs)]
    seen = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    want = []
    for i, t in rows:
        gone = np.zeros(len(t) + 2, np.int8)
        for k in range(len(t) - 199):
            if seen[t[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        want.append((repr(i), len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = substrings.repeats_report(docs).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert crowd < 300 or substrings.repeats_report(empty).count() == 0


def test_units_of_anchors():
    """Each window lies in the unit of one anchor, its own, and in no other."""
    draw = np.random.default_rng(5)
    for size in (150, 200, 201, 900, 5000):
        bounds = np.array([0, size, size, size + 450])
        body = draw.integers(97, 99, bounds[-1]).astype(np.uint8)
        at, h, low, high = substrings.anchors(body, bounds, 200)
        windows = [x for a, b in zip(low.tolist(), high.tolist(), strict=True) for x in range(a, b - 199)]
        assert windows == [x for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for x in range(a, b - 199)]
        assert (low <= at).all() and (at + substrings.GRAM <= high).all() and len(h) == len(at) == len(set(at.tolist()))


def test_splits_of_crowds_are_written(spark, monkeypatch):
    """However often crowds are split, what is left to run only reads tables."""
    monkeypatch.setattr(substrings, "CROWD", 2)
    draw = random.Random(3)
    line = bytes(draw.choices(range(97, 123), k=300)).decode()
    docs = spark.createDataFrame([(k, "".join(draw.choices("ab", k=90)) + line + "".join(draw.choices("ab", k=90))) for k in range(12)], "doc_id long, text string")
    plans = []
    split = substrings._split_crowds
    monkeypatch.setattr(substrings, "_split_crowds", lambda *x: plans.extend(split(*x)) or tuple(plans))
    assert all(r.n_removed >= 300 for r in substrings.repeats_report(docs).collect())
    for df in plans:
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_lookups_of_hot_keys(spark):
    """A key with a third of all rows, many with one row, and keys that share slots with hot ones: as a plain join gives, broadcasts off."""
    draw = np.random.default_rng(2)
    rows = [(None if k % 50 == 0 else 7 if k % 3 == 0 else int(draw.integers(0, 3000)), k) for k in range(9000)]
    left = common.stored(spark.createDataFrame(rows, "key long, x long"), "left")
    sizes = common.stored(left.groupBy("key").count().where("count > 1"), "sizes")
    want = Counter(k for k, _ in rows if k is not None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot in (0, 4, 1000, 10_000):
            found = common.hot_lookup(left, sizes, ["key"], "count", ["x"], hot)
            assert sorted(map(tuple, found.select("key", "x", "count").collect())) == sorted((k, x, want[k]) for k, x in rows if k is not None and want[k] > 1)
            dealt = common.in_slots(left, common.hot_slots(sizes, ["key"], "count", hot), ["key"], ["x"])
            assert dealt.where("key = 7").select("_part").distinct().count() == (4 if hot < want[7] else 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_repeated_strings_in_random_units():
    draw = np.random.default_rng(1)
    for _ in range(100):
        n, base = int(draw.integers(3, 9)), bytes(draw.integers(97, 100, 30).tolist())
        units = [bytes(draw.integers(97, 100, int(draw.integers(0, 25))).tolist()) + base[: int(draw.integers(0, 30))] for _ in range(int(draw.integers(1, 7)))]
        seen = Counter(u[k : k + n] for u in units for k in range(len(u) - n + 1))
        places = np.cumsum([0] + [len(u) + 5 for u in units[:-1]])
        for u, spans in zip(units, substrings.repeated(units, places, n), strict=True):
            gone = {x for k in range(len(u) - n + 1) if seen[u[k : k + n]] > 1 for x in range(k, k + n)}
            assert {x for a, b in spans for x in range(a, b)} == gone


def test_token_cuts_of_any_code_points():
    """Runs of letters, numbers, others and white space of many scripts, contractions at any place."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.Tokens(path), Tokenizer.from_file(path)
    draw = random.Random(9)
    bits = ["'", "'s", "'re", "'ll", "'v", "e", " ", "  ", "\n", "\t ", "　", "\x85", "᠎", "́", "Ⅷ", "²", "٣", "😀", "𝒳", "힣", "͸", "ab", "S", "12", "…", "\x00"]
    texts = ["".join(draw.choices(bits, k=draw.randrange(12))) for _ in range(4000)]
    texts += ["".join(map(chr, draw.choices(range(1, 0x3000), k=9))) for _ in range(1000)]
    import pyarrow as pa

    for text, ids in zip(texts, own.batch(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, own.width).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_samples_take_copies_row_by_row(spark, monkeypatch):
    """A text held by most rows gives its share of a sample, not all or none of its rows; repeated rows count once."""
    monkeypatch.setattr(quality, "SAMPLE", 200)
    sizes = []
    monkeypatch.setattr(quality.Additive, "fit", lambda self, x, y: sizes.append(len(x)) or self)
    rows = [(k, "the same text again" if k % 3 else f"text {k} of its own", k % 2) for k in range(2000)]
    quality.train(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    assert 100 < sizes[0] < 320
    quality.train(spark.createDataFrame([(1, "one row", 1)] * 150, "doc_id long, text string, y int"))
    assert sizes[1] == 1


def test_texts_travel_together(monkeypatch):
    """Texts that are numbered together are one row, whatever their number; ids, ends and empty texts stay as they are."""
    monkeypatch.setattr(pitman_yor, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = {7: b"a b a", -3: b"", None: b"B a", 9: None}
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([*texts], pa.int64()), "held_out": [False, False, True, False], "text": pa.array([*texts.values()], pa.binary())})
    rows = pa.Table.from_batches([*pitman_yor._number(1, 1000)([batch])])
    assert rows.column("kind").to_pylist() == [pitman_yor.TEXT, pitman_yor.WORDS]
    words = pitman_yor._words(1)(rows.slice(1, 1))
    assert [(r["x"], r["y"]) for r in words.to_pylist() if r["kind"] == pitman_yor.COUNTS] == [(6, 3)]
    part = pitman_yor.Part(pa.concat_tables([rows.slice(0, 1), words]), pitman_yor.Deal(1, 100), pitman_yor.WORDS)
    assert part.doc_id.to_pylist() == [*texts] and part.held.tolist() == [False, False, True, False]
    assert part.sizes.tolist() == [4, 1, 3, 1] and part.counts[part.codes].tolist() == [2, 1, 2, 3, 3, 1, 2, 3, 3]


@pytest.mark.parametrize(("most", "n"), [(50, 400), (10**6, 400), (2**40, 400), (2**62, 400), (5, 0), (1, 1)])
def test_places_are_those_of_distinct_values(most, n):
    x = np.random.default_rng(1).integers(0, most, n)
    x = np.concatenate([x, x[::3]])
    values, place = pitman_yor._numbered(x)
    want, of = np.unique(x, return_inverse=True)
    assert values.tolist() == want.tolist() and place.tolist() == of.tolist() and place.dtype == np.int64
    assert pitman_yor._found_in(values, x).tolist() == of.tolist()
    assert pitman_yor.unpack(pitman_yor.pack(x)).tolist() == x.tolist()


def test_turns_are_the_seating_of_short_rows():
    """Rows seated by turns have the weights and places that they have when seated one after another."""
    draw = np.random.default_rng(5)
    c = draw.integers(1, 40, 200)
    others, p, d = draw.integers(0, 9, 200), draw.uniform(0.001, 0.3, 200), 0.6
    turns, plain = pitman_yor.Turns(c, others, p, d), pitman_yor.Seating(c, others, p, d)
    opened, weight = turns.draw(np.zeros(0, np.int64), np.zeros(200, np.int64), np.random.default_rng(6))
    row, k = turns.found(opened)
    assert sorted(row[k == 0]) == [*range(200)] and (k < c[row]).all() and len({*zip(row, k, strict=True)}) == len(row) > 300
    assert np.array_equal(np.sort(turns.places(row, k)), opened)
    kept, same = plain.draw(np.sort(plain.places(row, k)), c, np.random.default_rng(7))
    assert np.allclose(weight, same) and {*zip(*plain.found(kept), strict=True)} == {*zip(row, k, strict=True)}
    # one customer after another, with the same random numbers
    random, tables, want = np.random.default_rng(6), np.zeros(200), set()
    order = np.argsort(-c, kind="stable")
    for turn in range(c.max()):
        rows = order[c[order] > turn]
        for r, chance in zip(rows, random.random(len(rows)), strict=True):
            base = p[r] * (pitman_yor.STRENGTH + d * others[r])
            fresh = (base + p[r] * d * tables[r]) * ((base + turn + 1) / (base + c[r])) ** (d * (1 - p[r]))
            if turn == 0 or chance * (fresh + turn - d * tables[r]) < fresh:
                want.add((r, turn))
                tables[r] += 1
    assert {*zip(row, k, strict=True)} == want


def test_model_of_far_ids(spark):
    """Ids that are far apart are sorted, not counted: probabilities add up all the same."""
    draw = np.random.default_rng(8)
    ids = draw.choice(2**33, 600, replace=False)
    counts = Counter((int(u), int(w)) for u, w in zip(ids[draw.zipf(1.3, 4000) % 40], ids[draw.zipf(1.2, 4000) % 600], strict=True))
    pairs = spark.createDataFrame([(u, w, c) for (u, w), c in counts.items()], "u long, w long, c long")
    dishes = len({w for _, w in counts})
    near, samples, _ = pitman_yor.sampled(pairs, dishes=dishes)
    near, of = Counter({(r.u, r.w): r.near for r in near.collect()}), {r.id: r for r in samples.collect()}
    whole = np.sum([r.p for r in of.values() if r.p], axis=0)
    for u in {u for u, _ in counts}:
        assert abs(sum(v for (x, _), v in near.items() if x == u) + np.mean(np.array(of[u].g) * whole) - 1) < 1e-9
