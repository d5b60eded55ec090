"""Exact removal of long repeated strings: a Burrows-Wheeler transform per bucket, expanded breadth first.

Only text near repeated anchors can repeat.  An anchor is the gram with the smallest hash of a
window of ``length`` bytes, so equal windows have equal anchors at equal places.  Around each
anchor that occurs twice lies a unit: all windows whose anchor it is.  Equal units repeat as a whole and
are settled by their hash; of the differing units of an anchor one each goes to the anchor's bucket.
There the transform of all its units is expanded: intervals of strings grow backwards by one byte a
round, each round sets the common prefixes of its length, and what is not set below ``length``
repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import by_size, hot_lookup, hot_slots, in_slots, raw, released, written

#: Bytes of an anchor; bytes hashed at once; bytes of units in a bucket; units an anchor may bring
#: to a bucket before it is split.
GRAM, SLICE, BUCKET, CROWD = 64, 2 << 20, 512 << 10, 4000


def anchors(body: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, low, high) of the anchors of all windows that lie within one text, and the stretch of their windows; ``starts`` bounds the texts."""
    n = len(body)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (body.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    size, factor = 1, np.uint64(0xBF58476D1CE4E5B9)
    while size < GRAM:  # hashes of twice as many bytes each time
        h = h[:-size] * factor + h[size:]
        h ^= h >> np.uint64(31)
        factor = np.uint64(int(factor) * int(factor) % (1 << 64))
        size *= 2
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(30)
    # the smallest of each window, the first of several: 40 bits of hash above 24 of position
    least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    inside = np.ones(len(least), bool)
    for end in starts[1:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    # windows of one anchor follow each other
    window = np.flatnonzero(inside)
    at = (least[window] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else window
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], h[at[first]], window[first], window[last] + length


def _stretches(batch: pa.RecordBatch, length: int):
    """Texts of a batch end to end, as (rows, first positions, bounds, bytes); a text too long for 24-bit positions in overlapping pieces."""
    most = 1 << 23
    rows, begins, blobs = [], [], []
    for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
        body = np.frombuffer(text.as_buffer(), np.uint8)
        for at in range(0, max(len(body) - length + 1, 1), most):
            rows.append(row)
            begins.append(at)
            blobs.append(body[at : at + most + length - 1])
    group: list[int] = []
    for k, blob in enumerate(blobs):
        if group and sum(len(blobs[g]) for g in group) + len(blob) > most:
            yield _joined(rows, begins, blobs, group)
            group = []
        group.append(k)
    if group:
        yield _joined(rows, begins, blobs, group)


def _joined(rows, begins, blobs, group):
    bounds = np.concatenate([[0], np.cumsum([len(blobs[g]) for g in group])]).astype(np.int64)
    return np.array([rows[g] for g in group]), np.array([begins[g] for g in group]), bounds, np.concatenate([blobs[g] for g in group])


FOUND = "h long, row long, low long, high long, left long, d long, e long"


def _find_anchors(length: int):
    """Anchors with their units: where these lie, and two halves of their digest."""
    salts = [k.to_bytes(8, "little") for k in range(length)]

    def run(batches):
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                for rows, begins, bounds, body in _stretches(batch, length):
                    at, h, low, high = anchors(body, bounds, length)
                    k = np.searchsorted(bounds, at, side="right") - 1
                    shift, view = begins[k] - bounds[k], memoryview(body)
                    digests = b"".join([
                        hashlib.blake2b(view[a:b], digest_size=16, salt=salts[x]).digest()
                        for a, b, x in zip(low.tolist(), high.tolist(), (at - low).tolist(), strict=True)
                    ])
                    halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
                    columns = [h.view(np.int64), rows[k], low + shift, high + shift, at - low, *np.ascontiguousarray(halves.T)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "row", "low", "high", "left", "d", "e"])

    return run


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``s``, read as a ring, sorted by the ``depth`` or more symbols that start there.

    Symbols are 0 to 256.  Sorting by the first symbols, then by twice as many each time; only
    positions that still share their rank with others are sorted again, within their ranks' places.
    """
    n = len(s)
    seen = np.zeros(257, np.int64)
    seen[s] = 1
    bits = max(1, int(seen.sum() - 1).bit_length())
    small = (np.cumsum(seen) - 1)[s]
    width, key = max(1, (61 - max(1, n - 1).bit_length()) // bits), small.copy()
    for k in range(1, width):
        key = (key << bits) | np.roll(small, -k)
    order = _order(key)
    ranked = key[order]
    # a rank is the first place of all that share it
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while width < depth:
        slots = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(slots):
            break
        at = order[slots]
        after = at + width
        key = rank[at] * n + rank[np.where(after >= n, after % n, after)]
        by = _order(key)
        at, key = at[by], key[by]
        order[slots] = at
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = fresh
        rank[at] = np.maximum.accumulate(np.where(fresh, slots, 0))
        width *= 2
    return order


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of nonnegative keys; keys and places are sorted as one number while both fit."""
    bits = max(1, len(key) - 1).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 62:
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def common_below(s: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each sorted position but the first: whether it shares ``length`` symbols with the one before.

    Breadth-first backward extension: a round takes the intervals of strings of one length, extends
    each by every symbol before it, and notes the length at the end of each new interval not yet
    noted.  After ``length`` rounds what has no note has a longer common prefix.
    """
    n = len(s)
    before = s[order - 1]
    step = np.empty(n, np.int64)
    step[_order(before)] = np.arange(n)
    noted = np.zeros(n + 1, bool)
    noted[n] = True
    # places up to each at which the symbol before is another than one place earlier
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    low, high = np.array([0]), np.array([n])
    for _ in range(length):
        # one symbol before all of an interval: it moves as a whole
        same = turns[low] == turns[high - 1]
        moved_low, moved_high = step[low[same]], step[high[same] - 1] + 1
        low, high = low[~same], high[~same]
        if len(low):
            size = high - low
            which = np.repeat(np.arange(len(low)), size)
            at = np.arange(len(which)) + np.repeat(low - np.cumsum(size) + size, size)
            key = which * 512 + before[at]
            by = _order(key)
            key, at = key[by], at[by]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            moved_low = np.concatenate([moved_low, step[at[new]]])
            moved_high = np.concatenate([moved_high, step[at[np.concatenate([new[1:], [len(at)]]) - 1]] + 1])
        fresh = ~noted[moved_high]
        noted[moved_high] = True
        low, high = moved_low[fresh], moved_high[fresh]
        if not len(low):
            break
    return ~noted[1:n]


def repeated(units: list[bytes], places: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Per unit the stretches covered by strings of ``length`` bytes that also start elsewhere in the units.

    ``places`` names where each unit starts in the input; a string and itself, met in two units, is
    no repeat.
    """
    sizes = np.array([len(u) for u in units])
    s = np.zeros(sizes.sum() + len(units), np.int64)  # a 0 after each unit
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    inner = np.ones(len(s), bool)
    inner[starts + sizes] = False
    s[inner] = np.frombuffer(b"".join(units), np.uint8).astype(np.int64) + 1
    unit = np.repeat(np.arange(len(units)), sizes + 1)
    at = np.arange(len(s)) - starts[unit]
    order = suffix_order(s, length)
    group = np.concatenate([[0], np.cumsum(~common_below(s, order, length))])
    full = (sizes[unit] - at >= length)[order]  # strings that a unit holds to their end
    place = (places[unit] + at)[order]
    group, place, order = group[full], place[full], order[full]
    if not len(group):
        return [[] for _ in units]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least, most = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
    twice = np.repeat(least != most, np.diff(np.concatenate([first, [len(group)]])))
    hits = np.sort(order[twice])
    out: list[list[tuple[int, int]]] = [[] for _ in units]
    if len(hits):
        u, x = unit[hits], at[hits]
        start = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (x[1:] > x[:-1] + length)]))
        end = x[np.concatenate([start[1:], [len(x)]]) - 1] + length
        for k, low, high in zip(u[start].tolist(), x[start].tolist(), end.tolist(), strict=True):
            out[k].append((low, high))
    return out


def _units(batches):
    """Bytes of given units of a text."""
    for batch in batches:
        out = [[] for _ in range(6)]
        for row, text, found in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("found").to_pylist(), strict=True):
            body = memoryview(text.as_buffer())
            for f in found:
                for k, v in enumerate((f["h"], row, f["low"], f["high"], f["left"], bytes(body[f["low"] : f["high"]]))):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([*[pa.array(o, pa.int64()) for o in out[:5]], pa.array(out[5], pa.binary())], ["h", "row", "low", "high", "left", "unit"])


UNIT = "h long, row long, low long, high long, left long, unit binary"


def _bucket(length: int):
    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for rows in batch.column("rows").to_pylist():
                # the same unit may come with several keys of a crowded anchor
                own = sorted({(r["row"], r["low"], r["unit"]) for r in rows})
                # a number for each byte position of the texts met here
                number = {row: k for k, row in enumerate(dict.fromkeys(r for r, _, _ in own))}
                room = max(low + len(u) for _, low, u in own)
                places = np.array([number[row] * room + low for row, low, _ in own])
                for (row, low, _), spans in zip(own, repeated([u for _, _, u in own], places, length), strict=True):
                    for a, b in spans:
                        out[0].append(row)
                        out[1].append(low + a)
                        out[2].append(low + b)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["row", "low", "high"])

    return run


def _apply(batches):
    """What is left of each text, and what was removed."""
    for batch in batches:
        out = [[], [], [], []]
        for text, found in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
            body, spans = text.as_buffer().to_pybytes(), []
            for f in sorted((s["low"], s["high"]) for s in found or []):
                if spans and f[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], f[1])
                else:
                    spans.append([*f])
            kept, at = [], 0
            for a, b in spans:
                kept.append(body[at:a])
                at = b
            kept.append(body[at:])
            out[0].append(len(body))
            out[1].append(sum(b - a for a, b in spans))
            out[2].append([{"start": a, "end": b} for a, b in spans])
            out[3].append(b"".join(kept))
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], spans_type), pa.array(out[3], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "spans", "kept"],
        )


def _split_crowds(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(rows for buckets, settled spans): crowded keys are split until each has ``CROWD`` units at most.

    Units of a key agree on ``a`` bytes left and ``b`` right of the anchor.  For a common window they
    must agree on ``slack`` bytes more, so on half of them at one side: each unit goes to two new
    keys, by its next bytes on either side.  Units of a key without slack share a window, if their keys are
    no chance match: its digest is compared.
    """
    now, ready, settled = rows.withColumns({"key": F.col("h"), "a": F.lit(0), "b": F.lit(0)}), [], []
    while True:
        sizes = written(now.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key-sizes")
        if ready:  # units that no other unit agrees with any more are left out
            now = written(hot_lookup(now, sizes, ["key"], "n", ["row", "low"], CROWD).drop("n"), "keys")
        slots = written(hot_slots(sizes, ["key"], "n", CROWD), "crowded-slots")
        if slots.isEmpty():
            ready.append(now.drop("a", "b"))
            break
        # a slot may have other keys than crowded ones: told apart by their sizes
        dealt = in_slots(now, slots, ["key"], ["row", "low"])
        unsure = written(hot_lookup(dealt.where("_part > 0").drop("_part"), sizes, ["key"], "n", ["row", "low"], CROWD), "crowds")
        # written at once: the plan of all rounds would fill the driver
        ready += [written(dealt.where("_part = 0").drop("a", "b", "_part"), "ready"), unsure.where(F.col("n") <= CROWD).drop("a", "b", "n")]
        crowd = unsure.where(F.col("n") > CROWD).drop("n")
        slack = F.lit(length - GRAM) - F.col("a") - F.col("b")
        window = F.expr(f"substring(unit, cast(left - a + 1 as int), a + {GRAM} + b)")
        full = crowd.where(slack <= 0).select("row", (F.col("low") + F.col("left") - F.col("a")).alias("low"), F.sha2(window, 256).alias("window"))
        full = written(full, "whole-windows")
        same = written(full.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "window-counts")
        spans = hot_lookup(full, same, ["window"], "n", ["row", "low"], CROWD).select("row", "low", (F.col("low") + length).alias("high"))
        settled.append(written(spans, "settled"))
        more = F.ceil(slack / 2).cast("int")
        crowd = crowd.where(slack > 0).withColumn("more", more)
        to_left = crowd.where("left >= a + more").withColumn("key", F.xxhash64("key", F.lit("left"), F.expr("substring(unit, cast(left - a - more + 1 as int), more)")))
        to_right = crowd.where(f"length(unit) - left - {GRAM} >= b + more").withColumn(
            "key", F.xxhash64("key", F.lit("right"), F.expr(f"substring(unit, cast(left + {GRAM} + b + 1 as int), more)"))
        )
        now = to_left.withColumn("a", F.col("a") + F.col("more")).union(to_right.withColumn("b", F.col("b") + F.col("more"))).drop("more")
        now = written(now, "keys")
    keyed = ready[0]
    for r in ready[1:]:
        keyed = keyed.unionByName(r)
    spans = None
    for x in settled:
        spans = x if spans is None else spans.union(x)
    return keyed, spans if spans is not None else rows.select("row", "low", "high").limit(0)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) per row: UTF-8 texts without the bytes that repeated strings of ``length`` cover.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this text or
    another; strings are judged on the input and do not cross texts.  spans are the maximal removed
    runs (start, end), kept the remaining bytes.  Null counts as empty; a text shorter than ``length``
    loses nothing; repeated rows are texts of their own and repeat each other.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw()).withColumn("row", F.monotonically_increasing_id())
    own = written(own, "texts")
    texts = own.select("row", "text")
    found = written(texts.mapInArrow(released(_find_anchors(length)), FOUND), "anchors")
    differ = (F.min("d") != F.max("d")) | (F.min("e") != F.max("e"))
    twice = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), differ.alias("differ")).where("n > 1"), "anchor-counts")
    again = written(hot_lookup(found, twice, ["h"], "n", ["row", "low"]).drop("n"), "repeated-anchors")
    # all of a class have the same left, and h; the first of one row is that of the others
    one = [F.first(x).alias(x) for x in ("row", "low", "high", "left", "differ")]
    classes = written(again.groupBy("h", "d", "e").agg(F.count(F.lit(1)).alias("n"), *one), "unit-classes")
    alike = classes.where("n > 1").select("h", "d", "e", "n")
    whole = written(hot_lookup(again, alike, ["h", "d", "e"], "n", ["row", "low"]).select("row", "low", "high"), "whole-units")
    ask = classes.where("differ").groupBy("row").agg(F.collect_list(F.struct("h", "low", "high", "left")).alias("found"))
    ask = written(ask, "asked")
    units = written(texts.join(ask, "row").mapInArrow(released(_units), UNIT), "units")
    keyed, settled = _split_crowds(units, length)
    volume = keyed.agg(F.sum(F.length("unit"))).first()[0] or 0
    buckets = max(1, -(-volume // BUCKET))
    packed = keyed.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).agg(F.collect_list(F.struct("row", "low", "unit")).alias("rows"))
    near = written(packed.select("rows").mapInArrow(released(_bucket(length)), "row long, low long, high long"), "near")
    spans = whole.union(settled).union(near).groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    spans = written(spans, "spans")
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return own.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(_apply, schema)


def repeats_report(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row; see ``remove_repeats``."""
    done = remove_repeats(docs, length)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
