"""Candidates of near duplicates: lists of shared shingles instead of comparing every text with every other."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadflow.llm import simhash


def grouped(n, pairs):
    root = list(range(n))
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_prefixes_of_similar_sets_meet():
    draw = random.Random(3)
    for _ in range(400):
        base = draw.sample(range(1, 10**6), draw.randrange(1, 60))
        other = [x for x in base if draw.random() > 0.12] + draw.sample(range(10**6, 2 * 10**6), draw.randrange(3))
        a, b = (np.array(sorted(s), np.uint64) for s in (base, other))
        frequent = np.array(sorted(x for x in base if draw.random() < 0.5), np.uint64)
        if len(b) and simhash.similar(a, b):
            assert set(simhash.prefix(a, frequent).tolist()) & set(simhash.prefix(b, frequent).tolist())
    assert simhash.prefix(np.zeros(0, np.uint64), np.zeros(0, np.uint64)).tolist() == []


@pytest.mark.parametrize("crowd", [1 << 27, 10])
def test_links_of_shared_shingles(spark, monkeypatch, crowd):
    """Connected as by brute force, in short, long and crowded lists."""
    for name, value in (("SHORT", 4), ("LEADERS", 2), ("CROWD", crowd), ("TILE", 5), ("POSTINGS", 50)):
        monkeypatch.setattr(simhash, name, value)
    draw = random.Random(11)
    bases = [draw.getrandbits(128) for _ in range(12)]
    texts = []
    for k in range(150):
        fp = bases[k % 12]
        for _ in range(draw.randrange(24)):
            fp ^= 1 << draw.randrange(128)
        texts.append((fp, {draw.randrange(4) if draw.random() < 0.5 else 10 + draw.randrange(300) for _ in range(3)}))
    rows = [(k, [(f >> s & (2**64 - 1)) - (1 << 64 if f >> s + 63 & 1 else 0) for s in (0, 64)], np.array(sorted(t), np.uint32).tobytes()) for k, (f, t) in enumerate(texts)]
    stored = spark.createDataFrame(rows, "node long, fp array<long>, prefix binary").repartition(3).localCheckpoint()
    links = [(r.a, r.b) for r in simhash.candidate_links(stored, 2, 30).collect()]
    near = [(a, b) for a, (f, s) in enumerate(texts) for b, (g, t) in enumerate(texts[:a]) if s & t and (f ^ g).bit_count() <= 30]
    assert len(near) > 100 and 12 <= len(set(grouped(150, near))) < 140
    assert grouped(150, links) == grouped(150, near)
    assert simhash.candidate_links(stored.limit(0).localCheckpoint(), 2, 30).count() == 0


def test_texts_are_not_compared_all_with_all(spark, monkeypatch):
    """The near copies of a group are found, and no fingerprint of an unlike text is compared with theirs."""
    monkeypatch.setattr(simhash, "near_links", None)
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 60), k -> concat('w', id div 3, 'x', k)), ' ') || ' end' || id").alias("text")
    )
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == list(range(0, 600, 3))


@pytest.mark.parametrize("product", [0, 10**9])
@pytest.mark.parametrize("tiles", [1, 2])
def test_sets_of_many_tiles(spark, monkeypatch, product, tiles):
    """A group in many tiles, whose parts meet pair by pair: one chain of sets, each like the next one only."""
    for name, value in (("SET_BYTES", 2000), ("SET_TILES", tiles), ("PRODUCT", product), ("BLOCK", 200)):
        monkeypatch.setattr(simhash, name, value)
    words = [f"v{i}" for i in range(400)]
    rows = [(k, " ".join(words[3 * k : 3 * k + 100])) for k in range(40)] + [(100 + k, " ".join(words[300 - 50 * k : 400 - 50 * k]) + " odd") for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    prints = [simhash._set_print(simhash.shingles(t.encode(), 5), 2)[0] for _, t in rows]
    apart = [[sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q, strict=True)) for q in prints] for p in prints]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and apart[a][b] <= 34]
    root = grouped(len(rows), links)
    want = sorted(rows[k][0] for k in set(root))
    assert 1 <= len(want) < 30
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(docs).collect()) == want
