"""Near-duplicate vectors: groups and tiles against brute force, and what the job writes."""

from pathlib import Path

import numpy as np
import pytest

from leadflow.llm import embeddings


def expected(rows, threshold=0.98):
    units = [np.array(v, np.float64) / np.linalg.norm(v) for _, v, _ in rows]
    link = [[j for j in range(len(rows)) if j != i and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(len(rows))]
    least = [r[0] for r in rows]
    before = None
    while before != least:
        before = [*least]
        least = [min([least[i], *(least[j] for j in link[i])]) for i in range(len(rows))]
    return sorted((r[0], len(link[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows))


@pytest.mark.parametrize("own", [0, 1 << 20])
def test_groups_meet_in_pairs(spark, monkeypatch, own):
    """Labels of several groups and labels that share a task; vectors that single precision does not hold among others."""
    for name, value in (("TILE", 4), ("CHUNK", 8), ("GROUP_BYTES", 700), ("OWN_BYTES", own)):
        monkeypatch.setattr(embeddings, name, value)
    draw = np.random.default_rng(9)
    base = draw.normal(size=(12, 8))
    rows = []
    for k in range(160):
        v = base[k % 12] + draw.normal(size=8) * 0.1
        v = v.astype(np.float32).astype(np.float64) if k % 3 else v
        rows.append((k, [float(x) for x in (v[:6] if k % 20 == 7 else v)], f"l{k % 2}"))
    rows += [(300 + k, rows[k][1], rows[k][2]) for k in range(9)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.embedding_groups(data).collect())
    want = expected(rows)
    assert got == want and sum(r[1] for r in want) > 300


def test_vectors_are_not_written_many_times(spark, tmp_path):
    """What the job leaves in the shared folder is about the size of the vectors."""
    draw = np.random.default_rng(2)
    rows = [(k, draw.normal(size=64).astype(np.float32).tolist(), k % 3) for k in range(3000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "in"))
    folder = Path(embeddings.stored(spark.range(1), "mark").inputFiles()[0].removeprefix("file:")).parent.parent
    before = sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    assert embeddings.embedding_groups(spark.read.parquet(str(tmp_path / "in"))).count() == 3000
    assert sum(p.stat().st_size for p in folder.rglob("*.parquet")) - before < 3 * 3000 * 256
