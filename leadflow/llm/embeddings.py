"""Near-duplicate vectors by tiled comparison within each label."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import chosen_rows, components, forest, release, released, stored, written
from leadflow.operators.shared import handover, spread_factor, spread_lookup

#: Vectors of a tile.
TILE = 1024
#: Candidate pairs verified at once.
CHUNK = 1 << 15
#: Bytes of a label's vectors that stay in one group; the vectors of two groups meet in one task.
GROUP_BYTES = 64 << 20
#: Bytes from which on a label has groups of its own; smaller labels share tasks.
OWN_BYTES = 1 << 20


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that neither squares overflow nor vanish."""
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _near_together(units: np.ndarray) -> np.ndarray:
    """An order of rows whose runs of ``TILE`` lie close: halved again and again along the widest coordinate."""
    order, todo = np.arange(len(units)), [(0, len(units))]
    while todo:
        low, high = todo.pop()
        if high - low > TILE:
            part = units[order[low:high]]
            half = -(-(high - low) // (2 * TILE)) * TILE
            order[low:high] = order[low:high][np.argpartition(part[:, part.var(axis=0).argmax()], half)]
            todo += [(low, low + half), (low + half, high)]
    return order


class _Vectors:
    """Vectors of one label, length and group, laid into tiles that know their middle and how far they reach."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, raw: np.ndarray):
        units = np.concatenate([_unit(raw[k : k + TILE].astype(np.float64)).astype(np.float32) for k in range(0, len(raw), TILE)])
        order = _near_together(units)
        self.ids, self.weights, self.raw, self.units = ids[order], weights[order], raw[order], units[order]
        self.linked = np.zeros(len(ids), np.int64)
        self.tiles = [slice(k, min(k + TILE, len(ids))) for k in range(0, len(ids), TILE)]
        self.middles = np.stack([self.units[t].mean(axis=0, dtype=np.float64) for t in self.tiles])
        self.reaches = np.array([np.linalg.norm(self.units[t] - m, axis=1).max() for t, m in zip(self.tiles, self.middles, strict=True)])


def _links(p: _Vectors, q: _Vectors, threshold: float) -> list[np.ndarray]:
    """Star forests of the links of two groups, or of one with itself; their weights are added to ``linked`` of either side."""
    dims, kept = p.units.shape[1], []
    # single precision finds candidates, with room for its rounding
    least, reach = threshold - 1e-5 - dims * 2.4e-7, np.sqrt(2 - 2 * threshold) + 1e-4
    for k, own in enumerate(p.tiles):
        apart = np.linalg.norm(q.middles - p.middles[k], axis=1) - p.reaches[k] - q.reaches
        for j in np.flatnonzero(apart <= reach).tolist():
            if p is q and j < k:
                continue
            other = q.tiles[j]
            i, o = np.nonzero(p.units[own] @ q.units[other].T >= least)
            i, o = i + own.start, o + other.start
            i, o = i[apart := p.ids[i] != q.ids[o]], o[apart]
            for at in range(0, len(i), CHUNK):
                x, y = i[at : at + CHUNK], o[at : at + CHUNK]
                near = np.einsum("ij,ij->i", _unit(p.raw[x].astype(np.float64)), _unit(q.raw[y].astype(np.float64))) >= threshold
                if not near.any():
                    continue
                x, y = x[near], y[near]
                np.add.at(p.linked, x, q.weights[y])
                if p is not q or j != k:  # a tile with itself has each pair twice
                    np.add.at(q.linked, y, p.weights[x])
                kept.append(np.stack(forest(p.ids[x], q.ids[y])))
    return kept


def _verify(threshold: float):
    """Of each two groups of a cell: per vector the weight it links with, and star forests of the links."""

    def links(rows: pa.Table, weights: pa.Table) -> pa.Table:
        ids, part = rows.column("id").to_numpy(), rows.column("part").to_numpy()
        known, each = weights.column("id").to_numpy(), weights.column("weight").to_numpy()
        order = np.argsort(known)
        each = each[order][np.searchsorted(known, ids, sorter=order)]
        kind = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy(), rows.column("dims").to_numpy()
        by = np.lexsort((part, *kind))
        found, out = [np.zeros((2, 0), np.int64)], [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        changes = np.flatnonzero(np.any([np.diff(c[by]) != 0 for c in (*kind, part)], axis=0)) + 1
        sides, g, h = {}, rows.column("g")[0].as_py(), rows.column("h")[0].as_py()
        raw = rows.column("raw").combine_chunks()
        for mine in np.split(by, changes):
            dims = int(kind[1][mine[0]])
            values = [np.frombuffer(v.as_buffer(), np.float32 if len(v.as_buffer()) == 4 * dims else np.float64) for v in raw.take(pa.array(mine))]
            sides.setdefault((int(kind[0][mine[0]]), dims), {})[int(part[mine[0]])] = _Vectors(ids[mine], each[mine], np.stack(values))
        for side in sides.values():
            if g in side and h in side:
                found += _links(side[g], side[h], threshold)
            for vectors in side.values():
                has = np.flatnonzero(vectors.linked)
                out[0].append(vectors.ids[has])
                out[1].append(vectors.linked[has])
        child, root = np.concatenate(found, axis=1)
        n = sum(map(len, out[0]))
        result = pa.table(
            {
                "id": np.concatenate([*out[0], child]),
                "linked": np.concatenate([*out[1], np.zeros(len(child), np.int64)]),
                "root": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(root)]),
            }
        )
        release()
        return result

    return links


def _usable(batches):
    """Vectors as they are, in single precision where that holds them, and 63 bits of a digest of their
    unit vector and label; null where a vector links with nothing."""
    for batch in batches:
        raw, ids, dims = [], [], []
        for v, label in zip(batch.column(2), batch.column(1), strict=True):
            x = None if not label.is_valid or v.values is None or v.values.null_count or not len(v.values) else np.asarray(v.values, dtype=np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                ids.append(None)
                raw.append(None)
            else:
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype(np.float32)
                ids.append(int.from_bytes(hashlib.sha256(_unit(x[None, :])[0].tobytes() + label.as_buffer().to_pybytes()).digest()[:8], "big") >> 1)
                raw.append((short if np.array_equal(short, x) else x).tobytes())
            dims.append(0 if x is None else len(x))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "label", "id", "dims", "raw"]
        )


def embedding_groups(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one non-null label link if their cosine, in double precision, reaches ``threshold``.
    Equal unit vectors of a label are one class, named by a digest, and one vector stands for it.
    The vectors of a label are dealt to groups of ``GROUP_BYTES``; each two groups meet in a task, which
    lays them into tiles of close vectors, passes over tiles too far apart and compares the others:
    candidates by a matrix product, then exactly.  That is quadratic in a label's vectors where they do
    not cluster, with memory bounded and a vector sent once per group of its label.  A task gives link
    counts and a star forest, never its pairs.

    Null, empty, zero vectors and such with null or non-finite components link with nothing: 0
    links, own component.  Vectors of other length link with none of this length.  Rows that repeat
    a vec_id count as one vector each; a null vec_id is never a component's name unless it is alone
    (component_id null, kept true).  Other columns are ignored; an empty table gives an empty one.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(released(_usable), "vec_id long, label string, id long, dims int, raw binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least_id"), F.min("row").alias("row"))
    classes = written(classes, "classes")
    one = chosen_rows(rows, classes.select("row"))
    sizes = one.groupBy("label", "dims").agg(F.sum(F.octet_length("raw")).alias("bytes")).where(F.col("bytes") > OWN_BYTES)
    # no more rows than megabytes of input
    sizes = handover(sizes.select("label", "dims", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("n")), "labels")
    shared = F.pmod(F.xxhash64("label", "dims"), F.lit(spread_factor(rows.sparkSession))).cast("string")
    laid = one.join(F.broadcast(sizes), ["label", "dims"], "left").select(
        "label", "dims", "id", "raw", "row",
        F.when(F.col("n").isNull(), shared).otherwise(F.concat_ws(" ", F.lit("label"), "dims", "label")).alias("cell"),
        F.coalesce("n", F.lit(1)).alias("n"),
    ).withColumn("part", F.pmod(F.xxhash64("id"), "n").cast("int"))
    met = laid.withColumn("of", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumns({"g": F.least("part", "of"), "h": F.greatest("part", "of")})
    key = ["cell", "g", "h"]
    weights = written(spread_lookup(met.select(*key, "id"), classes.select("id", "weight"), ["id"], key, "inner"), "weights")
    both = met.select(*key, "label", "dims", "id", "part", "raw").groupBy(*key).cogroup(weights.groupBy(*key))
    found = written(both.applyInArrow(_verify(threshold), "id long, linked long, root long"), "found")
    counts = found.where("root is null").groupBy("id").agg(F.sum("linked").alias("linked"))
    group = components(found.where("root is not null").select(F.col("id").alias("a"), F.col("root").alias("b")))
    group = group.withColumnsRenamed({"node": "id", "component": "group"})
    told = classes.join(counts, "id", "left").join(group, "id", "left").withColumn("group", F.coalesce("group", "id"))
    told = handover(told.select("id", "weight", "least_id", "linked", "group"), "told")
    named = told.groupBy("group").agg(F.min("least_id").alias("component_id"))
    told = spread_lookup(told, named, ["group"], ["id"])
    told = told.select("id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = spread_lookup(rows.select("vec_id", "id"), handover(told, "told"), ["id"], ["vec_id"])
    own = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return own.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
