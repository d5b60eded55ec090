"""SimHash near-duplicates by tiled exact comparison of fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import LOWER, chosen_rows, components, forest, raw, release, released, stored, written
from leadflow.operators.shared import handover, spread_factor, spread_lookup

#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Fingerprints of a tile; two tiles of 32 KB make a block of 16 million comparisons.
TILE = 4096
#: Tiles of a group, and groups at least, if there are as many tiles: the pairs of two groups' tiles are compared by one task.
GROUP, SPREAD = 64, 16
#: Bytes of shingle hashes in a tile of a candidate group; tiles of a larger group that meet as many others in one task.
SET_BYTES, SET_TILES = 1 << 20, 16
#: Pairs of sets from which on they are compared by a matrix product, and numbers of its blocks.
PRODUCT, BLOCK = 32, 1 << 22
#: Texts that tell which shingles are frequent, and the least hashes of each that are counted.
SAMPLE, LEAST = 4096, 256
#: Shingles kept that a task deals out at once, and that a bucket has on average.
POSTINGS = 1 << 20
#: Texts of a shingle that are compared by their distance in its list; leaders of a longer list, and its comparisons from which on it is dealt out in tiles.
SHORT, LEADERS, CROWD = 32, 8, 1 << 27


def _mixed(h: np.ndarray) -> np.ndarray:
    """Other 64 bits from 64 bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: bytes, width: int, words: int = 1) -> list[int]:
    """SimHash of a text's word shingles (XXH64, seed 42), 64 bits a word; 0 if it has no words."""
    split = text.translate(LOWER).split()
    if not split:
        return [0] * words
    joined, width = b" ".join(split), min(width, len(split))
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(split) - width + 1].tolist()
    ends, digest, votes = ends[width - 1 :].tolist(), xxhash.xxh64_intdigest, np.zeros((words, 64), np.int64)
    for at in range(0, len(starts), CHUNK):
        part = zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)
        hashes = np.array([digest(joined[s:e], 42) for s, e in part], np.uint64)
        for k in range(words):
            hashes = _mixed(hashes) if k else hashes
            votes[k] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(starts)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def fingerprints(docs: DataFrame, width: int, words: int = 1, key: str = "doc_id") -> DataFrame:
    """(``key``, fp): the fingerprint of each whole text, ``words`` longs."""

    def score(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), width, words) for t in batch.column("text")], np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * words, pa.int32()), pa.array(fps.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), raw())
    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, fp array<long>").withColumnRenamed("key", key)


def _counts(words: int, radius: int) -> tuple[Column, list[int]]:
    """What tiles are laid by, as one number, and the differences of it at which links are possible.

    For a small radius over one word: set bits of each 16-bit quarter; else set bits in all.
    Of a difference and its opposite one is listed.
    """
    if words > 1 or radius > 4:
        return sum((F.bit_count(F.col("fp")[k]).cast("int") for k in range(words)), F.lit(0)), list(range(radius + 1))
    quarter = [F.bit_count(F.shiftrightunsigned(F.col("fp")[0], 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("int") for q in range(4)]
    reach = range(-radius, radius + 1)
    near = [(a, b, c, d) for a in reach for b in reach for c in reach for d in reach if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    return sum((n * F.lit(32**q) for q, n in enumerate(quarter)), F.lit(0)), [sum(d * 32**q for q, d in enumerate(s)) for s in near if s >= (0, 0, 0, 0)]


def _compare(words: int, radius: int):
    """Star forests of the links of the pairs of tiles (x, i) and (y, j) of a cell, given its tiles."""

    def links(tiles: pa.Table, pairs: pa.Table) -> pa.Table:
        kept, own = [np.zeros((2, 0), np.int64)], {}
        for counts, tile, fps, ids in zip(*(tiles.column(c) for c in ("counts", "tile", "fps", "ids")), strict=True):
            own[counts.as_py(), tile.as_py()] = np.frombuffer(fps.as_buffer(), np.uint64).reshape(-1, words), np.frombuffer(ids.as_buffer(), np.int64)
        for x, i, y, j in zip(*(pairs.column(c).to_pylist() for c in ("x", "i", "y", "j")), strict=True):
            (p, p_id), (q, q_id) = own[x, i], own[y, j]
            for at in range(0, len(p), 512):  # what stays in a core's cache
                part = p[at : at + 512]
                apart = np.bitwise_count(part[:, None, 0] ^ q[None, :, 0])
                for k in range(1, words):
                    apart += np.bitwise_count(part[:, None, k] ^ q[None, :, k])
                left, right = np.nonzero(apart <= radius)
                near = p_id[at + left] != q_id[right]
                if near.any():
                    kept.append(np.stack(forest(p_id[at + left[near]], q_id[right[near]])))
        a, b = np.concatenate(kept, axis=1)
        release()
        return pa.table({"a": a, "b": b})

    return links


def _packed(batches):
    """One row per tile: its fingerprints and their nodes as bytes."""
    for batch in batches:
        fps = [np.asarray(v.values.flatten(), dtype=np.int64).tobytes() for v in batch.column("fps")]
        ids = [np.asarray(v.values, dtype=np.int64).tobytes() for v in batch.column("ids")]
        yield pa.RecordBatch.from_arrays([batch.column("counts"), batch.column("tile"), pa.array(fps, pa.binary()), pa.array(ids, pa.binary())], ["counts", "tile", "fps", "ids"])


def near_links(distinct: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """(a, b): links among distinct ``(node, fp)`` whose fingerprints differ in ``radius`` bits at most.

    Fingerprints are laid into tiles by their population counts; a pair of tiles whose counts differ
    by more than the radius cannot hold a link and is never formed.  Each remaining pair is compared
    exactly, every fingerprint with every other, by exclusive-or and bit count.  A pair of tiles
    gives star forests of its links: no more rows than a few times its fingerprints, and no
    connection is lost.  Tiles fall into groups, and a tile goes to each pair of groups that has a
    pair of its own once, not to each pair of tiles.
    """
    key, shifts = _counts(words, radius)
    laid = distinct.select("node", "fp", key.alias("counts"))
    # at most 17^4 rows of two numbers, whatever the input
    sizes = laid.groupBy("counts").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    sizes = handover(sizes, "tile-sizes")
    placed = laid.join(F.broadcast(sizes), "counts").withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    tiles = placed.groupBy("counts", "tile").agg(F.collect_list(F.struct("fp", "node")).alias("rows"))
    tiles = tiles.select("counts", "tile", F.col("rows.fp").alias("fps"), F.col("rows.node").alias("ids"))
    tiles = handover(tiles.mapInArrow(released(_packed), "counts int, tile int, fps binary, ids binary"), "tiles")
    left = sizes.select(F.col("counts").alias("x"), F.col("tiles").alias("n"), F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    pairs = left.withColumn("y", F.col("x") + F.col("shift")).join(F.broadcast(sizes.select(F.col("counts").alias("y"), F.col("tiles").alias("m"))), "y")
    pairs = pairs.select("x", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "y", "m").select(
        "x", "i", "y", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j")
    )
    pairs = pairs.where((F.col("x") != F.col("y")) | (F.col("i") <= F.col("j")))
    total = sizes.agg(F.sum("tiles")).first()[0] or 0
    return _tile_links(tiles, pairs, total, words, radius)


def _tile_links(tiles: DataFrame, pairs: DataFrame, total: int, words: int, radius: int) -> DataFrame:
    """(a, b): star forests of the links of ``pairs(x, i, y, j)`` of the ``total`` stored ``tiles(counts, tile, fps, ids)``."""
    groups = max(1, -(-total // GROUP), min(total, SPREAD))
    g, h = (F.pmod(F.xxhash64(*tile), F.lit(groups)) for tile in (("x", "i"), ("y", "j")))
    pairs = handover(pairs.select(F.least(g, h).alias("g"), F.greatest(g, h).alias("h"), "x", "i", "y", "j"), "tile-pairs")
    asked = pairs.select(F.col("g").alias("of_g"), F.col("h").alias("of_h"), F.col("x").alias("counts"), F.col("i").alias("tile"))
    asked = asked.union(pairs.select("g", "h", "y", "j")).distinct()
    # little to move and much to compare: as many tasks as there are shuffle partitions
    parts = spread_factor(tiles.sparkSession)
    sent, pairs = asked.join(tiles, ["counts", "tile"]).repartition(parts, "of_g", "of_h"), pairs.repartition(parts, "g", "h")
    return sent.groupBy("of_g", "of_h").cogroup(pairs.groupBy("g", "h")).applyInArrow(_compare(words, radius), "a long, b long")


def simhash_groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id
    that links reach.  Rows with equal fingerprints are one class before anything is compared, so a
    group of thousands of copies costs one comparison.  Null and empty texts have fingerprint 0 and
    are linked like any other; repeated rows stay repeated; a null doc_id keeps its row but names no
    group (component_id is null if no other id is in the group); other columns are ignored; an empty
    table gives an empty one.  A wrapped difference of bit counts only adds comparisons, never
    loses one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = handover(fingerprints(rows, width).select("doc_id", F.col("fp")[0].alias("fp")), "fingerprints")
    classes = handover(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    group = components(near_links(classes.select(F.col("fp").alias("node"), F.array("fp").alias("fp")), radius)).withColumnsRenamed({"node": "fp", "component": "root"})
    rooted = handover(classes.join(group, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = handover(spread_lookup(rooted.select("fp", "root"), named, ["root"], ["fp"]).select("fp", "component_id"), "named")
    joined = spread_lookup(prints, of_class, ["fp"], ["doc_id"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hashes (XXH64) of a text's distinct word shingles, sorted; a shorter text is one shingle, none without words."""
    split = text.translate(LOWER).split()
    width = min(width, len(split))
    runs = {b" ".join(split[k : k + width]) for k in range(len(split) - width + 1)} if split else ()
    return np.unique(np.array([xxhash.xxh64_intdigest(r, 42) for r in runs], np.uint64))


def _set_print(hashes: np.ndarray, words: int) -> tuple[list[int], int]:
    """SimHash of a set of shingles, and a digest of the set."""
    votes, own = np.zeros((words, 64), np.int64), hashes
    for k in range(words):
        own = _mixed(own) if k else own
        for at in range(0, len(own), CHUNK):
            votes[k] += np.unpackbits(own[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0].tolist(), xxhash.xxh64_intdigest(hashes.tobytes(), 7) - 2**63


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have four fifths of their union in common."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    common = len(a) + len(b) - len(np.union1d(a, b))
    return 5 * common >= 4 * (len(a) + len(b) - common)


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Hashes, sorted, of shingles that are frequent in about ``SAMPLE`` of the texts: one in 1000 of them has it, four at least.

    They only decide the order of shingles, so what is missed costs comparisons and never a link.
    """
    parts = max(1, docs.count() // SAMPLE)

    def least(batches):
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes(), width)[:LEAST].tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["least"])

    rows = docs.select(raw()).where(F.pmod(F.xxhash64("text"), F.lit(parts)) == 0).mapInArrow(released(least), "least binary").toArrow()
    values, n = np.unique(np.frombuffer(b"".join(v.as_py() for v in rows.column("least")), np.uint64), return_counts=True)
    return values[n >= max(4, rows.num_rows // 1000)]


def prefix(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last: sets of similarity 0.8 or more have one of them in common.

    Such sets have at least four fifths of either in common, so the first common one is not behind the last fifth of
    either.  32 bits of a hash stand for it; equal ones of different shingles only add comparisons.
    """
    n = len(hashes)
    if n and len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    return (hashes[: n - (4 * n + 4) // 5 + 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _dealt(buckets: int):
    """Shingles of prefixes with their texts' nodes and fingerprints, packed by bucket."""

    def packed(held):
        tokens = [np.frombuffer(v.as_buffer(), np.uint32) for batch in held for v in batch.column("prefix")]
        nodes = np.concatenate([batch.column("node").to_numpy() for batch in held])
        fps = np.concatenate([np.asarray(batch.column("fp").flatten(), dtype=np.int64).reshape(batch.num_rows, -1) for batch in held])
        owner, tokens = np.repeat(np.arange(len(nodes)), [len(t) for t in tokens]), np.concatenate(tokens)
        of = tokens % np.uint32(buckets)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(buckets + 1))
        out = [[], [], [], []]
        for k in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[k] : ends[k + 1]]
            for column, value in zip(out, (k, tokens[mine].tobytes(), nodes[owner[mine]].tobytes(), fps[owner[mine]].tobytes()), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], ["bucket", "tokens", "nodes", "fps"])

    def deal(batches):
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += sum(len(v.as_buffer()) for v in batch.column("prefix")) // 4
            if size >= POSTINGS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return deal


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints, each with each or broadcast."""
    out = np.bitwise_count(p[..., 0] ^ q[..., 0]).astype(np.uint16)
    for k in range(1, p.shape[-1]):
        out += np.bitwise_count(p[..., k] ^ q[..., k])
    return out


def _listed(words: int, radius: int):
    """Star forests of the close texts in the lists of a bucket's shingles; of crowded lists the tiles that are still to be compared.

    In a long list some leaders take the texts close to them, which are then linked and not compared
    among each other; all other pairs are.
    """

    def compared(ids, fps, kept, own=None, other=None):
        """Links of the rows ``own`` with ``other``, or among the rows ``own``."""
        for at in range(0, len(own), 512):
            part = own[at : at + 512]
            against = own[at:] if other is None else other
            left, right = np.nonzero(_apart(fps[part][:, None, :], fps[against][None, :, :]) <= radius)
            if len(left):
                kept.append(np.stack(forest(ids[part[left]], ids[against[right]])))

    def long(token, ids, fps, kept, tiles):
        open_, parts = np.arange(len(ids)), []
        for _ in range(LEADERS):
            if not len(open_):
                break
            near = _apart(fps[open_[0]], fps[open_]) <= radius
            parts.append(open_[near])
            kept.append(np.stack(forest(ids[parts[-1]], np.full(len(parts[-1]), ids[open_[0]]))))
            open_ = open_[~near]
        if len(ids) ** 2 - sum(len(p) ** 2 for p in parts) <= CROWD:
            compared(ids, fps, kept, open_)
            for k, p in enumerate(parts):
                compared(ids, fps, kept, p, np.concatenate([*parts[k + 1 :], open_]))
            return
        number = 0
        for cluster, rows in enumerate([open_, *parts]):
            for at in range(0, len(rows), TILE):
                mine = rows[at : at + TILE]
                tiles.append((token, number, cluster, fps[mine].tobytes(), ids[mine].tobytes()))
                number += 1

    def links(table: pa.Table) -> pa.Table:
        tokens, ids, fps = (
            np.frombuffer(b"".join(v.as_buffer() for v in table.column(c)), kind) for c, kind in (("tokens", np.uint32), ("nodes", np.int64), ("fps", np.uint64))
        )
        order = np.argsort(tokens, kind="stable")
        sizes = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(tokens[order]) != 0)), len(order)))
        order = order[np.repeat(sizes > 1, sizes)]  # most shingles are of one text only
        sizes = sizes[sizes > 1]
        tokens, ids, fps = tokens[order], ids[order], fps.reshape(-1, words)[order]
        starts = np.cumsum(sizes) - sizes
        after = np.repeat(np.where(sizes > SHORT, 0, starts + sizes - 1), sizes) - np.arange(len(order))
        kept, tiles = [np.zeros((2, 0), np.int64)], []
        for step in range(1, SHORT):
            left = np.flatnonzero(after >= step)
            left = left[_apart(fps[left], fps[left + step]) <= radius]
            kept.append(np.stack([ids[left], ids[left + step]]))
        for k in np.flatnonzero(sizes > SHORT).tolist():
            mine = slice(starts[k], starts[k] + sizes[k])
            long(int(tokens[starts[k]]), ids[mine], fps[mine], kept, tiles)
        a, b = forest(*np.concatenate(kept, axis=1))
        columns = [pa.array(np.concatenate(c)) for c in ((a, np.zeros(0, np.int64)), (b, np.zeros(0, np.int64)))]
        none = len(a)
        out = pa.table(
            {
                "a": pa.concat_arrays([columns[0], pa.nulls(len(tiles), pa.int64())]),
                "b": pa.concat_arrays([columns[1], pa.nulls(len(tiles), pa.int64())]),
                **{
                    name: pa.concat_arrays([pa.nulls(none, kind), pa.array([t[k] for t in tiles], kind)])
                    for k, (name, kind) in enumerate((("counts", pa.int64()), ("tile", pa.int32()), ("cluster", pa.int32()), ("fps", pa.binary()), ("ids", pa.binary())))
                },
            }
        )
        release()
        return out

    return links


def candidate_links(texts: DataFrame, words: int, radius: int) -> DataFrame:
    """(a, b): star forests of links among stored ``texts(node, fp, prefix)``: fingerprints close, a shingle of the prefixes in common.

    Texts meet in the lists of the shingles of their prefixes, so the work grows with the input
    where shingles are rare.  Crowded lists are dealt out in tiles.
    """
    total = (texts.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 4
    buckets = max(spread_factor(texts.sparkSession), -(-total // POSTINGS))
    dealt = texts.mapInArrow(released(_dealt(buckets)), "bucket int, tokens binary, nodes binary, fps binary")
    schema = "a long, b long, counts long, tile int, cluster int, fps binary, ids binary"
    found = written(dealt.groupBy("bucket").applyInArrow(_listed(words, radius), schema), "listed")
    links, tiles = found.where("counts is null").select("a", "b"), found.where("counts is not null")
    crowded = tiles.count()
    if not crowded:
        return links
    each = tiles.select(F.col("counts").alias("x"), F.col("tile").alias("i"), F.col("cluster").alias("own"))
    pairs = each.join(each.select(F.col("x").alias("y"), F.col("i").alias("j"), F.col("own").alias("other")), F.col("x") == F.col("y"))
    pairs = pairs.where("i <= j and (own = 0 or own <> other)").select("x", "i", "y", "j")
    return links.union(_tile_links(tiles.select("counts", "tile", "fps", "ids"), pairs, crowded, words, radius))


class _Sets:
    """Texts of some tiles: nodes, fingerprints and sets of shingles; numbers of the shingles among all of them."""

    def __init__(self, tiles: list, words: int):
        self.ends = np.cumsum([0, *map(len, tiles)])
        nodes = tiles[0] if len(tiles) == 1 else pa.concat_arrays(tiles)
        self.ids = np.asarray(nodes.field("node"))
        self.fps = np.asarray(nodes.field("fp").flatten(), dtype=np.int64).view(np.uint64).reshape(-1, words)
        self.grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in nodes.field("grams")]
        self.sizes = np.array([len(g) for g in self.grams])
        self.starts = np.append(0, np.cumsum(self.sizes))
        self.codes, self.total = None, 0

    def tile(self, k: int) -> np.ndarray:
        return np.arange(self.ends[k], self.ends[k + 1])

    def numbers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shingle): places in ``rows`` and numbers of the shingles of their sets."""
        if self.codes is None:
            names, self.codes = np.unique(np.concatenate(self.grams), return_inverse=True)
            self.total = len(names)
        return np.repeat(np.arange(len(rows)), self.sizes[rows]), np.concatenate([self.codes[self.starts[r] : self.starts[r + 1]] for r in rows])

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many shingles each row of ``p`` has in common with each of ``q``; sums of ones are exact up to 16 million."""
        (x, a), (y, b) = self.numbers(p), self.numbers(q)
        marks = np.zeros(self.total, np.uint8)
        marks[a] = 1
        marks[b] |= 2
        place = np.cumsum(marks == 3) - 1
        x, a, y, b = x[marks[a] == 3], place[a[marks[a] == 3]], y[marks[b] == 3], place[b[marks[b] == 3]]
        out, width = np.zeros((len(p), len(q))), max(16, BLOCK // (len(p) + len(q)))
        for at in range(0, int(place[-1]) + 1, width):
            own, other = (a >= at) & (a < at + width), (b >= at) & (b < at + width)
            left, right = np.zeros((len(p), width), np.float32), np.zeros((len(q), width), np.float32)
            left[x[own], a[own] - at] = 1
            right[y[other], b[other] - at] = 1
            out += left @ right.T
        return out

    def links(self, p: np.ndarray, q: np.ndarray, radius: int) -> list[np.ndarray]:
        """Star forests of the links of rows ``p`` with rows ``q``: close fingerprints whose sets are ``similar``."""
        kept = []
        for at in range(0, len(p), 512):
            part = p[at : at + 512]
            near = (_apart(self.fps[part][:, None, :], self.fps[q][None, :, :]) <= radius) & (self.ids[part][:, None] != self.ids[q][None, :])
            x, y = np.nonzero(near)
            if len(x) <= PRODUCT:
                good = np.array([similar(self.grams[part[i]], self.grams[q[j]]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
            else:
                rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                both = self.sizes[part[x]] + self.sizes[q[y]]
                met = self.common(part[rows], q[columns])[np.searchsorted(rows, x), np.searchsorted(columns, y)]
                good = 9 * met >= 4 * both
            if good.any():
                kept.append(np.stack(forest(self.ids[part[x[good]]], self.ids[q[y[good]]])))
        return kept


def _verified(words: int, radius: int):
    """Star forests of the links within a candidate group: in the one tile of it, or between those of two parts of it."""

    def alone(batches):
        for batch in batches:
            kept = [np.zeros((2, 0), np.int64)]
            for rows in batch.column("rows"):
                own = _Sets([rows.values], words)
                kept += own.links(own.tile(0), own.tile(0), radius)
            a, b = np.concatenate(kept, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def together(table: pa.Table) -> pa.Table:
        own = _Sets([rows.values for rows in table.column("rows")], words)
        part = [k // SET_TILES for k in table.column("tile").to_pylist()]
        g, h = table.column("g")[0].as_py(), table.column("h")[0].as_py()
        kept = [np.zeros((2, 0), np.int64)]
        for k, first in enumerate(part):
            for j, second in enumerate(part):
                if (first, second) == (g, h) and (g != h or k <= j):
                    kept += own.links(own.tile(k), own.tile(j), radius)
        a, b = np.concatenate(kept, axis=1)
        release()
        return pa.table({"a": a, "b": b})

    return alone, together


def _similar_links(members: DataFrame, words: int, radius: int) -> DataFrame:
    """(a, b): links among ``members(root, tiles, tile, node, fp, grams)`` of the same root, verified on their shingles.

    A group is laid into tiles of about ``SET_BYTES`` of shingles, each compared with each; of a
    group of many tiles, ``SET_TILES`` and as many others meet in a task.
    """
    tiles = members.groupBy("root", "tiles", "tile").agg(F.collect_list(F.struct("node", "fp", "grams")).alias("rows"))
    tiles = written(tiles, "set-tiles")
    alone, together = _verified(words, radius)
    within = tiles.where("tiles = 1").select("rows").mapInArrow(released(alone), "a long, b long")
    own, last = (F.floor(F.col(c) / SET_TILES).cast("int") for c in ("tile", "last"))
    wide = tiles.where("tiles > 1").withColumn("last", F.col("tiles") - 1).withColumn("of", F.explode(F.sequence(F.lit(0), last)))
    sent = wide.select("root", F.least(own, "of").alias("g"), F.greatest(own, "of").alias("h"), "tile", "rows")
    return within.union(sent.groupBy("root", "g", "h").applyInArrow(together, "a long, b long"))


def keep_one_of_each(docs: DataFrame, width: int = 5, words: int = 2, radius: int = 34) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest doc_id stays, all columns as they were.

    Texts link if the sets of their distinct shingles of ``width`` words have a similarity (common
    over all) of 0.8 or more and the fingerprints of ``words`` * 64 bits over the sets are ``radius``
    bits apart at most.  Such sets share a shingle of their prefixes: candidates are the texts that
    shared ones and close fingerprints connect; each link is then verified on the sets.  Sets
    of similarity 0.8 differ in some 19 of 128 bits, give or take 4: by that estimate (not measured)
    about one pair in 10,000 of just 0.8 is missed, and 1 in 100 of sets of five shingles or fewer.
    Rows with equal ids are told apart; of a group without ids, or with the smallest id twice, one
    row stays.  Null and empty texts are alike.
    """
    names, frequent = docs.columns, frequent_shingles(docs, width)

    def prints(batches):
        for batch in batches:
            found = []
            for t in batch.column("text"):
                hashes = shingles(t.as_buffer().to_pybytes(), width)
                found.append((*_set_print(hashes, words), prefix(hashes, frequent).tobytes()))
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.list_(pa.int64()), pa.int64(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_doc"), *arrays], ["_doc", "fp", "digest", "prefix"])

    def sets(batches):
        for batch in batches:
            found = [shingles(t.as_buffer().to_pybytes(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "tiles", "tile", "node", "fp")), pa.array(found, pa.binary())], ["root", "tiles", "tile", "node", "fp", "grams"])

    keyed = docs.select(F.struct(*names).alias("_doc"), raw())
    printed = keyed.mapInArrow(released(prints), f"_doc {keyed.schema['_doc'].dataType.simpleString()}, fp array<long>, digest long, prefix binary")
    printed = stored(printed.withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    rows = printed.select("row", F.col("_doc.doc_id").alias("doc_id"), "fp", "digest")
    classes = rows.groupBy("fp", "digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best"))
    # the best row of a class names it
    classes = written(classes.select(F.col("best.row").alias("node"), "best"), "classes")
    own = chosen_rows(printed.select("row", "fp", "prefix"), classes.select(F.col("node").alias("row"))).withColumnRenamed("row", "node")
    near = components(candidate_links(own, words, radius)).withColumnRenamed("component", "root")
    near = written(near.join(own.select("node", "fp", F.octet_length("prefix").alias("least")), "node"), "candidates")
    # a prefix has four bytes for five shingles, a set eight for each
    sizes = handover(near.groupBy("root").agg(F.greatest(F.ceil(F.sum(F.col("least") * 10) / SET_BYTES), F.lit(1)).cast("int").alias("tiles")), "set-sizes")
    placed = spread_lookup(near, sizes, ["root"], ["node"]).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles").cast("int"))
    # texts of candidates only are moved, and none to say which rows stay
    texts = chosen_rows(printed, near.select(F.col("node").alias("row"))).select(F.col("row").alias("node"), raw("_doc.text"))
    members = placed.join(texts, "node").select("root", "tiles", "tile", "node", "fp", "text")
    members = members.mapInArrow(released(sets), "root long, tiles int, tile int, node long, fp array<long>, grams binary")
    group = components(_similar_links(members, words, radius)).withColumnRenamed("component", "root")
    rooted = classes.join(group, "node", "left").select("best", F.coalesce("root", "node").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"))
    return chosen_rows(printed, kept).select(*[F.col("_doc")[n].alias(n) for n in names])
