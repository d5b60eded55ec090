"""Language-model scores by a hierarchical Pitman-Yor model whose seating is sampled by Gibbs.

Restaurants are contexts (the word before); all share one parent restaurant over words, whose base
is uniform.  Every word of the training texts is a dish and a context of its own; all words that only
held-out texts have are one more dish and context.  So the model grows with the corpus, and every
count is over all of it.

Seating is kept per (context, dish): which of its customers opened a table.  A sweep seats all customers
anew, each row by itself: what rows share, the tables of a restaurant and the parent's
probabilities, are sums of the sweep before.  So no restaurant, however large, meets in one task.

Tables hold packed arrays: the words of many texts, those of a part of the texts that fall into a word bucket, the
rows of a context bucket.  Contexts with many customers are dealt to several context buckets.  Between
sweeps context buckets send table counts to word buckets, which seat the parent's customers and answer
with its counts; rows of one customer always have one table and are only counted.
"""

from __future__ import annotations

import math
import struct
import zlib
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import LOWER, by_size, raw, release, released, word_codes, written
from leadflow.operators.shared import spread_factor

#: Sweeps before and while sampling.
BURN, SAMPLES = 1, 3
STRENGTH, ROOT_DISCOUNT = 1.0, 0.5
#: Rows of up to so many customers are seated by turns; of longer ones, customers whose seats are drawn at once.
TURNS, CHUNK = 256, 1 << 14
#: Bytes of text numbered at once; words of a part; bytes of text to a word bucket and to a context bucket;
#: customers from which on a context is dealt to several buckets.
SLICE, PART, WORD_BYTES, CONTEXT_BYTES, HOT = 8 << 20, 1_500_000, 32 << 20, 8 << 20, 250_000
#: Ids of the dish of words not seen in training and of the start of a text; others are from 0.
UNSEEN, START = -1, -2
#: Arrays of so many bytes are not worth compressing.
PLAIN = 128


#: Rows of all tables between the steps: who gets it, what it is, whom it is about, packed arrays and sums.
ROW = "key long, kind int, other long, a binary, b binary, c binary, d binary, e binary, f binary, x long, y long"
TEXT, WORDS, PAIRS, COUNTS, PLACES, ROWS, SHARED, LISTED, SENT, ROOT, ANSWER, SEATS, FOUND, DRAWN = range(14)


def squeeze(body: bytes) -> bytes:
    return struct.pack("<q", len(body)) + pa.compress(body, codec="zstd", asbytes=True)


def unsqueeze(body: bytes) -> bytes:
    return pa.decompress(body[8:], decompressed_size=struct.unpack_from("<q", body)[0], codec="zstd", asbytes=True)


def pack(x: np.ndarray) -> bytes:
    """Nonnegative integers, byte by byte: all lowest bytes first, as many as the largest needs."""
    x = np.ascontiguousarray(x, "<i8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    body = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return bytes([width + PLAIN]) + body if len(body) < PLAIN else bytes([width]) + squeeze(body)


def unpack(body: bytes) -> np.ndarray:
    width, body = (body[0] - PLAIN, body[1:]) if body[0] > PLAIN else (body[0], unsqueeze(body[1:]))
    planes = np.frombuffer(body, np.uint8).reshape(width, -1)
    out = planes[0].astype(np.int64)
    for k in range(1, width):
        out |= planes[k].astype(np.int64) << (8 * k)
    return out


class Rows:
    """Rows of ``ROW`` to be handed back to Spark."""

    def __init__(self):
        self.rows = []

    def add(self, key: int, kind: int, other: int | None, *arrays: np.ndarray | bytes, x: int = 0, y: int = 0) -> None:
        blobs = [v if isinstance(v, bytes) else pack(v) for v in arrays]
        self.rows.append((key, kind, other, *blobs, *[None] * (6 - len(blobs)), x, y))

    def columns(self) -> dict[str, pa.Array]:
        types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
        names = [field.split()[0] for field in ROW.split(", ")]
        return {n: pa.array([r[k] for r in self.rows], t) for k, (n, t) in enumerate(zip(names, types, strict=True))}

    def table(self) -> pa.Table:
        return pa.table(self.columns())


def _of(rows: pa.Table, kind: int, x: int | None = None) -> list[dict]:
    """Rows of one kind, by whom they are about."""
    some = rows.filter(pc.equal(rows.column("kind"), kind))
    some = some if x is None else some.filter(pc.equal(some.column("x"), x))
    return some.sort_by("other").to_pylist()


def _step(tables: list[DataFrame], run) -> DataFrame:
    """``run`` over all rows of each key."""
    return _by_key(tables).applyInArrow(_freed(run), ROW)


def _by_key(tables: list[DataFrame]):
    rows = reduce(DataFrame.union, tables)
    return rows.repartition(spread_factor(rows.sparkSession), "key").groupBy("key")


def _freed(run):
    """``run`` over the rows of a group, after which the worker gives its memory back."""

    def whole(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            release()

    return whole


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays])


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nonnegative integers in order, and the place of each of ``x`` among them: by counting or a plain sort where they fit."""
    n, top = len(x), int(x.max(initial=0))
    if top < 4 * n:
        there = np.zeros(top + 1, bool)
        there[x] = True
        return np.flatnonzero(there), (np.cumsum(there) - 1)[x]
    low = n.bit_length()
    if top.bit_length() + low > 63:
        return np.unique(x, return_inverse=True)
    both = x << low
    both |= np.arange(n)
    both.sort()
    first = _runs(both >> low)
    values = both[first] >> low
    both &= (1 << low) - 1
    place = np.empty(n, np.int64)
    place[both] = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    return values, place


def _found_in(own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in ``own``, which is sorted and has them all."""
    if len(own) and own[-1] < 4 * len(own):
        place = np.zeros(own[-1] + 1, np.int64)
        place[own] = np.arange(len(own))
        return place[x]
    return np.searchsorted(own, x)


def _grouped(bucket: np.ndarray) -> list[np.ndarray]:
    """Places of each bucket's values, in order of the buckets."""
    short = bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket  # these are sorted digit by digit
    order = np.argsort(short, kind="stable")
    return np.split(order, _runs(bucket[order])[1:]) if len(order) else []


def _split(x: np.ndarray, buckets: int) -> dict[int, np.ndarray]:
    """Places of the values of each bucket that has any."""
    of = x % buckets
    return {int(of[at[0]]): at for at in _grouped(of)}


def _number(buckets: int, most: int):
    """Texts as codes of their part's own dictionary, then the dictionary by word bucket with counts in training texts.

    A part is what a task reads until it has ``most`` words.  The end of a text is an empty word.
    """

    def run(batches):
        task, parts, read, words = TaskContext.get().partitionId() << 24, 0, [], 0
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                read.append((batch.column("doc_id"), held, *word_codes(batch.column("text"), LOWER)))
                words += len(read[-1][2]) + len(held)
                if words >= most:
                    yield _part(task + parts, read, buckets)
                    parts, read, words = parts + 1, [], 0
        if words:
            yield _part(task + parts, read, buckets)

    return run


def _part(part: int, read: list, buckets: int) -> pa.RecordBatch:
    """Rows of a part: its texts, a row for each slice of them, and its dictionary."""
    met = pa.concat_arrays([pa.array([b""], pa.large_binary()), *(names.cast(pa.large_binary()) for *_, names in read)]).dictionary_encode()
    own, at = met.indices.to_numpy().astype(np.int64), 1
    out, seen = Rows(), np.zeros(len(met.dictionary), np.int64)
    for doc_id, held, codes, bounds, names in read:
        sizes = np.diff(bounds)
        # each text's words, then its end
        texts = np.insert(own[at : at + len(names)][codes], bounds[1:], 0)
        seen += np.bincount(texts[np.repeat(~held, sizes + 1)], minlength=len(seen))
        nulls = doc_id.is_null().to_numpy(zero_copy_only=False)
        ids = pc.fill_null(doc_id, 0).to_numpy().astype("<i8")
        out.add(part, TEXT, None, texts, sizes + 1, held, squeeze(ids.tobytes()), nulls)
        at += len(names)
    dealt = _word_bucket(met.dictionary, buckets)
    for some in _grouped(dealt):
        words = met.dictionary.take(pa.array(some))
        offsets, body = _bytes_of(words)
        out.add(int(dealt[some[0]]), WORDS, part, squeeze(body.tobytes()), some, seen[some], np.diff(offsets))
    return pa.RecordBatch.from_pydict(out.columns())


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of large binaries."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    body = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], body


def _word_bucket(words: pa.Array, buckets: int) -> np.ndarray:
    """Bucket of each word, by a hash of its bytes and their places."""
    offsets, body = _bytes_of(words)
    factors = np.cumprod(np.full(1 << 10, 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(body)) - np.repeat(offsets[:-1], np.diff(offsets))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * factors[place % len(factors)])])
    sums = sums[offsets[1:]] - sums[offsets[:-1]]
    sums ^= sums >> np.uint64(32)
    return ((sums * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def _words(buckets: int):
    """Ids and training counts of a bucket's words, to each part; the frequent ones have small ids."""

    def run(rows: pa.Table) -> pa.Table:
        out, rows = Rows(), _of(rows, WORDS)
        sizes = [unpack(r["d"]) for r in rows]
        offsets, body = np.concatenate([[0], np.cumsum(_joined(sizes))]), b"".join([unsqueeze(r["a"]) for r in rows])
        met = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
        at, k = met.indices.to_numpy(), rows[0]["key"]
        c = np.bincount(at, _joined([unpack(r["c"]) for r in rows])).astype(np.int64)
        rank = np.empty(len(c), np.int64)
        rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
        ids = np.where(c > 0, rank * buckets + k, UNSEEN)
        ends = np.cumsum([len(x) for x in sizes])
        for r, own in zip(rows, np.split(at, ends[:-1]), strict=True):
            out.add(r["other"], WORDS, k, r["b"], ids[own] + 1, c[own])
        out.add(k, COUNTS, None, x=int(c.sum()), y=int((c > 0).sum()))
        return out.table()

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


class Deal(NamedTuple):
    """Rows to ``contexts`` buckets by their context; one with more than ``hot`` customers goes to several, by dish."""

    contexts: int
    hot: int

    def buckets(self, c_u: np.ndarray) -> np.ndarray:
        """How many buckets a context with ``c_u`` customers is dealt to."""
        return np.minimum(self.contexts, np.maximum(1, -(-c_u // self.hot)))

    def bucket(self, u: np.ndarray, w: np.ndarray, c_u: np.ndarray) -> np.ndarray:
        return (_mixed(u) + _mixed(w) % self.buckets(c_u)) % self.contexts


class Part:
    """Texts of a part, and their pairs (u, w) in order of u and w."""

    def __init__(self, rows: pa.Table, deal: Deal, kind: int):
        texts, words = _of(rows, TEXT), _of(rows, kind)
        code = _joined([unpack(r["a"]) for r in words])
        ids, self.counts = np.full(code.max(initial=-1) + 1, UNSEEN), np.zeros(code.max(initial=-1) + 1, np.int64)
        ids[code] = _joined([unpack(r["b"]) for r in words]) - 1
        self.counts[code] = _joined([unpack(r["c"]) for r in words])
        self.words, self.code = words, code
        ids_of = np.concatenate([np.zeros(0, "<i8"), *(np.frombuffer(unsqueeze(r["d"]), "<i8") for r in texts)])
        self.doc_id = pa.array(ids_of, mask=_joined([unpack(r["e"]) for r in texts]).astype(bool))
        self.held, self.sizes = _joined([unpack(r["c"]) for r in texts]).astype(bool), _joined([unpack(r["b"]) for r in texts])
        # a part's words are counted in 32 bits, as there are many copies of them here
        self.codes = np.concatenate([np.zeros(0, np.int32), *(unpack(r["a"]).astype(np.int32) for r in texts)])
        known, place = _numbered(np.append(ids, START) - START)
        place = place.astype(np.int32)
        self.known, self.place = known + START, place[:-1]
        # the word before: the start for the first of a text
        self.w = self.place[self.codes]
        u = np.empty_like(self.w)
        u[1:] = self.w[:-1]
        u[np.cumsum(self.sizes) - self.sizes] = place[-1]
        c_u = np.zeros(len(known), np.int64)
        c_u[self.place] = self.counts
        c_u[place[-1]] = self.counts[0] if len(self.counts) else 0
        c_u[self.known == UNSEEN] = 0
        self.inside = (self.known != UNSEEN)[u]
        bits = len(known).bit_length()
        both = u[self.inside].astype(np.int64)
        both <<= bits
        both |= self.w[self.inside]
        del u
        key, at = _numbered(both)
        self.at = at.astype(np.int32)
        training = np.repeat(~self.held, self.sizes)[self.inside]
        self.n = np.bincount(self.at[training], minlength=len(key))
        del both, at, training
        pu, self.pair_w = key >> bits, (key & ((1 << bits) - 1)).astype(np.int32)
        self.pu, self.pw, self.c_u = self.known[pu], self.known[self.pair_w], c_u[pu]
        self.bucket = deal.bucket(self.pu, self.pw, self.c_u)
        self.by_bucket = _grouped(self.bucket)


def _pairs(deal: Deal):
    """The pairs of a part with their counts in training texts, to each context bucket."""

    def run(rows: pa.Table) -> pa.Table:
        out, part = Rows(), Part(rows, deal, WORDS)
        name = rows.column("key")[0].as_py()
        for at in part.by_bucket:
            _send(out, int(part.bucket[at[0]]), name, part.pu[at], part.pw[at], part.n[at], part.c_u[at])
        return out.table()

    return run


def _send(out: Rows, bucket: int, part: int, u: np.ndarray, w: np.ndarray, n: np.ndarray, c_u: np.ndarray) -> None:
    first = _runs(u)
    out.add(bucket, PAIRS, part, u[first] + 2, np.diff(np.append(first, len(u))), w + 1, n, c_u[first])


def _gather(buckets: int, deal: Deal):
    """Counts of a context bucket's pairs over all parts, the places of each part's pairs among them, and what sweeps need."""

    def run(rows: pa.Table) -> pa.Table:
        out, sent = Rows(), _of(rows, PAIRS)
        b = sent[0]["key"]
        us, rank = _numbered(_joined([unpack(r["a"]) for r in sent]))
        us -= 2
        c_us = np.zeros(len(us), np.int64)
        c_us[rank] = _joined([unpack(r["e"]) for r in sent])
        u = np.repeat(rank, _joined([unpack(r["b"]) for r in sent]))
        lists = [unpack(r["c"]) for r in sent]
        ws, w = _numbered(_joined(lists))
        ws -= 1
        bits = len(ws).bit_length()
        keys, place = _numbered(u << bits | w)
        c = np.bincount(place, _joined([unpack(r["d"]) for r in sent]), len(keys)).astype(np.int64)
        u, w = keys >> bits, keys & ((1 << bits) - 1)
        trained, many, one = c > 0, c > 1, c == 1
        out.add(b, COUNTS, None, c, np.bincount(u, minlength=len(us)), c_us, x=int(one.sum()), y=int((c == 2).sum()))
        out.add(b, LISTED, -1, x=int(trained.sum()))
        for r, own in zip(sent, np.split(place, np.cumsum([len(x) for x in lists])[:-1]), strict=True):
            out.add(b, PLACES, r["other"], np.diff(own, prepend=0))
        singles = np.bincount(u[one], minlength=len(us))
        first = _runs(u[many])
        head = u[many][first]
        out.add(b, ROWS, None, us[head] + 2, np.diff(np.append(first, many.sum())), ws[w[many]], c[many], c_us[head], singles[head])
        hot = np.flatnonzero(deal.buckets(c_us) > 1)
        out.add(b, SHARED, None, us[hot] + 2, singles[hot], hot)
        # who is asked for what: dishes of rows that are seated, customers that never move, contexts in several buckets
        dish_n, lone_n = np.bincount(w[many], minlength=len(ws)), np.bincount(w[one], minlength=len(ws))
        dishes, lone = ws[dish_n > 0], ws[lone_n > 0]
        dish_n, lone_n = dish_n[dish_n > 0], lone_n[lone_n > 0]
        types = np.bincount(u[trained], minlength=len(us))[hot]
        asked, none = [_split(x, buckets) for x in (dishes, lone, us[hot])], np.zeros(0, np.int64)
        for k in sorted(set().union(*asked)):
            a, l, h = (x.get(k, none) for x in asked)
            out.add(k, LISTED, b, dishes[a] // buckets, dish_n[a], lone[l] // buckets, lone_n[l], us[hot][h] // buckets + 2, types[h])
        return out.table()

    return run


class Seating:
    """Which customers of many rows open a table, in order of arrival; flat: row k has the places from ``at[k]`` on.

    With t tables among the k customers before, the next one opens a table by a(t) = p * (strength +
    d * (others + t)) against k - d * t, ``others`` being the restaurant's tables of other rows.
    Table counts follow from the openings alone, so sizes of tables are not kept.
    """

    def __init__(self, c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float):
        self.at, self.d = np.concatenate([[0], np.cumsum(c)]), d
        self.base, self.step = p * (STRENGTH + d * np.maximum(others, 0)), p * d
        # a table more makes all later customers likelier to open one: about this power of k
        self.power, self.end = d * (1 - p), self.base + c

    def places(self, row: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Where customers ``k`` of the rows are; sorted as they are."""
        return self.at[row] + k

    def draw(self, kept: np.ndarray, given: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(places that open a table, log weight of each row): the first ``given`` customers of a row as in ``kept``, the others drawn.

        All customers are drawn, ``CHUNK`` at a time.  Whether one opens a table depends on the tables
        before, and only grows with them: from none, repeated passes come to just what drawing one
        after another gives.  The weight is the chance of the seating over that of drawing it so.
        """
        at, opened, weight = self.at, [], np.zeros(len(self.at) - 1)
        carried = 0  # tables so far of the row that the last chunk ended in
        for low in range(0, int(at[-1]), CHUNK):
            high = min(low + CHUNK, int(at[-1]))
            first, last = np.searchsorted(at, [low, high - 1], side="right") - 1
            starts = np.maximum(at[first : last + 1], low) - low
            sizes = np.diff(np.append(starts, high - low))
            rows = np.repeat(np.arange(first, last + 1), sizes)
            k = np.arange(low, high) - at[rows]
            begin = np.zeros(last + 1 - first, np.int64)
            begin[0] = carried if at[first] < low else 0
            base, step, power = self.base[rows], self.step[rows], self.power[rows]
            lift = np.exp(power * np.log((base + k + 1) / self.end[rows]))
            fixed = k < given[rows]
            new = np.zeros(high - low, bool)
            new[kept[np.searchsorted(kept, low) : np.searchsorted(kept, high)] - low] = True
            new &= fixed
            if (free := ~fixed).any():
                chance = random.random(high - low)
                new |= free & (k == 0)
            while True:
                before = np.cumsum(new) - new
                tables = before - np.repeat(before[starts] - begin, sizes)
                fresh, old = (base + step * tables) * lift, k - self.d * tables
                if not free.any():
                    break
                now = np.where(free, chance * (fresh + old) < fresh, new)
                if np.array_equal(now, new):
                    break
                new = now
            weight[first : last + 1] += np.add.reduceat(np.log(fresh + old) - np.where(new, np.log(lift), 0.0), starts)
            opened.append(np.flatnonzero(new) + low)
            carried = int(tables[-1] + new[-1])
        return np.concatenate([*opened, np.zeros(0, np.int64)]), weight

    def found(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, customer) of places."""
        row = np.repeat(np.arange(len(self.at) - 1), np.diff(np.searchsorted(places, self.at)))
        return row, places - self.at[row]


class Turns:
    """``Seating`` of rows of few customers: the first customers of all rows, then the second ones, and so on.

    Places are in that order, rows with more customers first, so each turn is a run of them.
    """

    def __init__(self, c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float):
        self.rows, self.d = np.argsort(-c.astype(np.int32), kind="stable"), d
        self.rank = np.empty(len(c), np.int64)
        self.rank[self.rows] = np.arange(len(c))
        self.sizes = np.cumsum(np.bincount(c)[::-1])[::-1][1:]
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        c, p = c[self.rows], p[self.rows]
        self.base, self.step = p * (STRENGTH + d * np.maximum(others[self.rows], 0)), p * d
        self.power, self.end = d * (1 - p), self.base + c
        self.lifts = [self.power[:m] * np.log((self.base[:m] + (k + 1)) / self.end[:m]) for k, m in enumerate(self.sizes)]

    def places(self, row: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.at[k] + self.rank[row]

    def draw(self, kept: np.ndarray, given: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        opened, given = np.zeros(self.at[-1], bool), given[self.rows]
        opened[kept] = True
        tables, weight = np.zeros(len(self.rows)), np.zeros(len(self.rows))
        for k, m in enumerate(self.sizes):
            new = opened[self.at[k] : self.at[k + 1]]
            fresh = (self.base[:m] + self.step[:m] * tables[:m]) * np.exp(self.lifts[k])
            both = fresh + (k - self.d * tables[:m])
            free = given[:m] <= k
            if free.any():
                new |= free & ((random.random(m) * both < fresh) | (k == 0))
            weight[:m] += np.log(both) - self.lifts[k] * new
            tables[:m] += new
        return np.flatnonzero(opened), weight[self.rank]

    def found(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.repeat(np.arange(len(self.sizes)), np.diff(np.searchsorted(places, self.at)))
        return self.rows[places - self.at[k]], k


def _seat(seed: int, d: float):
    """Seats all customers of rows (u, w, c, opened, c_old, t_u, p), and where there is a seating (``c_old``), keeps it or takes the new one.

    A row's new seating of all its customers is proposed and accepted by Metropolis-Hastings, so that
    the row's conditional, given what other rows share, is kept.  Customers that a row has gained
    since then are first seated behind the old ones, those that it has lost leave from the end.
    """

    def some(way, c, c_old, others, p, row, own, random):
        """(row, customer) of those that open tables of some rows, which had ``own`` of ``row``."""
        seating = way(c, others, p, d)
        left = own < c[row]
        places, weight = seating.draw(seating.places(row[left], own[left]), c_old, random)
        row, k = seating.found(places)
        if (c_old > 0).any():
            other, other_weight = seating.draw(np.zeros(0, np.int64), np.zeros(len(c), np.int64), random)
            take = (c_old > 0) & (np.log(1 - random.random(len(c))) < other_weight - weight)
            other_row, other_k = seating.found(other)
            stay, go = ~take[row], take[other_row]
            row, k = np.concatenate([row[stay], other_row[go]]), np.concatenate([k[stay], other_k[go]])
        return row, k

    def run(batches):
        for batch in batches:
            u, w, c, c_old, t_u, p = (batch.column(x).to_numpy() for x in ("u", "w", "c", "c_old", "t_u", "p"))
            random = np.random.default_rng([seed, zlib.crc32(u.tobytes() + w.tobytes())])
            lists = batch.column("opened")
            row = np.repeat(np.arange(len(c)), pc.list_value_length(lists).to_numpy())
            own = lists.flatten().to_numpy()
            others = t_u - np.bincount(row, minlength=len(c))
            short, seated = c <= TURNS, []
            for way, at in ((Turns, np.flatnonzero(short)), (Seating, np.flatnonzero(~short))):
                if not len(at):
                    continue
                of, place = short[row] == short[at[0]], np.zeros(len(c), np.int64)
                place[at] = np.arange(len(at))
                got, k = some(way, c[at], c_old[at], others[at], p[at], place[row[of]], own[of], random)
                seated.append(at[got] << 36 | k)
            both = np.sort(_joined(seated))
            row, k = both >> 36, both & ((1 << 36) - 1)
            t = np.bincount(row, minlength=len(c))
            # offsets of 32 bits: a batch holds so many openings only if they fit in memory twice
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(t)]), pa.int32()), pa.array(k))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("w"), batch.column("c"), lists, pa.array(t)], ["u", "w", "c", "opened", "t"])

    return run


def _seated(u, w, c, own, t, c_old, t_u, p, seed: int, d: float) -> tuple[np.ndarray, np.ndarray]:
    """(openings, tables) of rows seated by ``_seat``; ``own`` are the openings so far, ``t`` of each row."""
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(t)]), pa.int32()), pa.array(own))
    columns = [pa.array(u), pa.array(w), pa.array(c), lists, pa.array(c_old), pa.array(t_u), pa.array(p)]
    got = next(_seat(seed, d)([pa.RecordBatch.from_arrays(columns, ["u", "w", "c", "opened", "c_old", "t_u", "p"])]))
    return got.column("opened").flatten().to_numpy(), got.column("t").to_numpy()


def _root(buckets: int, dishes: int, seed: int, tables: int, sweep: int):
    """Seats the parent's customers of a word bucket, which are the children's tables, and answers the context buckets.

    ``tables`` are the parent's tables of the sweep before.
    """

    def run(rows: pa.Table) -> pa.Table:
        out, k = Rows(), rows.column("key")[0].as_py()
        listed = [r for r in _of(rows, LISTED) if r["other"] >= 0]
        sent = {r["other"]: r for r in _of(rows, SENT)}
        asked = [unpack(r["a"]) for r in listed]
        lone = [unpack(r["c"]) for r in listed]
        own, at = _numbered(_joined([*asked, *lone]))
        n = [unpack(sent[r["other"]]["a"] if sent else r["b"]) for r in listed] + [unpack(r["d"]) for r in listed]
        c = np.bincount(at, _joined(n), len(own)).astype(np.int64)
        if before := _of(rows, ROOT):
            c_old, t, opened = (unpack(before[0][x]) for x in "abc")
        else:
            c_old, t, opened = np.zeros(len(c), np.int64), np.ones(len(c), np.int64), np.zeros(len(c), np.int64)
        many = np.full(len(c), tables), np.full(len(c), 1.0 / dishes)
        opened, t = _seated(np.zeros(len(c), np.int64), own * buckets + k, c, opened, t, c_old, *many, seed, ROOT_DISCOUNT)
        out.add(k, ROOT, -1, c, t, opened, own, x=int(c.sum()), y=int(t.sum()))
        hot = [unpack(r["e"]) for r in listed]
        shared, of = np.unique(_joined(hot), return_inverse=True)
        sums = np.bincount(of, _joined([unpack(sent[r["other"]]["b"] if sent else r["f"]) for r in listed]), len(shared)).astype(np.int64)
        for r, place, h in zip(listed, np.split(at, np.cumsum([len(a) for a in asked])), hot, strict=False):
            out.add(r["other"], ANSWER, k, c[place], t[place], sums[np.searchsorted(shared, h)], x=sweep)
        return out.table()

    return run


def _share(c: np.ndarray, t: np.ndarray, all_c: int, all_t: int, dishes: int) -> np.ndarray:
    """The parent's probability of dishes with ``c`` customers at ``t`` tables."""
    return (c - ROOT_DISCOUNT * t + (STRENGTH + ROOT_DISCOUNT * all_t) / dishes) / (STRENGTH + all_c)


def _first_tables(d: float, c: np.ndarray | float, types: np.ndarray | float) -> np.ndarray:
    """Tables to begin with: as many as ``c`` customers open on average whatever they eat, one for each dish at least."""
    ratio = math.exp(math.lgamma(STRENGTH) - math.lgamma(STRENGTH + d))
    return np.maximum((ratio * np.power(c + STRENGTH + (d - 1) / 2, d) - 1) * STRENGTH / d, types)


def _hot_sums(answers: list[dict], hot: np.ndarray, buckets: int) -> np.ndarray:
    """Tables of the contexts in several buckets, as the word buckets answered."""
    sums, of = np.zeros(len(hot), np.int64), _split(hot, buckets)
    for r in answers:
        if r["other"] in of:
            sums[of[r["other"]]] = unpack(r["c"])
    return sums


class Bucket:
    """Rows of a context bucket with several customers each, and what word buckets answered."""

    def __init__(self, rows: pa.Table, buckets: int, sweep: int):
        own, shared = _of(rows, ROWS)[0], _of(rows, SHARED)[0]
        self.key = own["key"]
        self.us, sizes, self.w, self.c, self.c_us, self.singles = (unpack(own[x]) for x in "abcdef")
        self.us = self.us - 2
        self.u, self.types = np.repeat(np.arange(len(self.us)), sizes), sizes + self.singles
        self.hot, self.hot_singles = unpack(shared["a"]) - 2, unpack(shared["b"])
        self.dishes, self.dish = _numbered(self.w)
        answers, none = _of(rows, ANSWER, sweep), np.zeros(0, np.int64)
        dishes, hot = _split(self.dishes, buckets), _split(self.hot, buckets)
        self.asked = [(r["other"], dishes.get(r["other"], none), hot.get(r["other"], none)) for r in answers]
        self.root_c, self.root_t = np.zeros(len(self.dishes), np.int64), np.zeros(len(self.dishes), np.int64)
        for r, (_, a, _) in zip(answers, self.asked, strict=True):
            self.root_c[a], self.root_t[a] = unpack(r["a"]), unpack(r["b"])
        self.hot_sums = _hot_sums(answers, self.hot, buckets)

    def tables(self, t: np.ndarray) -> np.ndarray:
        """Tables of each context whose rows have ``t``, with those in other buckets."""
        return self.with_shared(self.singles + np.bincount(self.u, t, len(self.us)).astype(np.int64))

    def with_shared(self, sums: np.ndarray) -> np.ndarray:
        _, at, of = np.intersect1d(self.us, self.hot, assume_unique=True, return_indices=True)
        sums = sums.copy()
        sums[at] = self.hot_sums[of]
        return sums


def _sweep(buckets: int, dishes: int, d: float, all_c: int, all_t: int, sweep: int):
    """Seats a bucket's rows, given the sums of the sweep before, and sends the tables to the word buckets."""

    def run(rows: pa.Table) -> pa.Table:
        out, b = Rows(), Bucket(rows, buckets, sweep)
        if state := _of(rows, SEATS):
            t, opened = unpack(state[0]["a"]), unpack(state[0]["b"])
            t_u, c_old = b.tables(t)[b.u], b.c
        else:
            first = _first_tables(d, b.c_us, b.with_shared(b.types))[b.u]
            t_u = (first * (1 - b.c / b.c_us[b.u])).astype(np.int64) + 1
            t, opened, c_old = np.ones(len(b.c), np.int64), np.zeros(len(b.c), np.int64), np.zeros(len(b.c), np.int64)
        p = _share(b.root_c, b.root_t, all_c, all_t, dishes)[b.dish]
        opened, t = _seated(b.us[b.u], b.w, b.c, opened, t, c_old, t_u, p, 1 + sweep, d)
        out.add(b.key, SEATS, None, t, opened, x=sweep + 1)
        n = np.bincount(b.dish, t, len(b.dishes)).astype(np.int64)
        sums = b.singles + np.bincount(b.u, t, len(b.us)).astype(np.int64)
        _, at, of = np.intersect1d(b.us, b.hot, assume_unique=True, return_indices=True)
        shared = b.hot_singles.copy()
        shared[of] = sums[at]
        for k, a, h in b.asked:
            out.add(k, SENT, b.key, n[a], shared[h])
        return out.table()

    return run


class Fit:
    """Gibbs sampling over packed pairs: ``gathered`` counts, and seats and parent's seats of each sample."""

    def __init__(self, sent: DataFrame, dishes: int, distinct: int, buckets: int, deal: Deal):
        self.gathered = written(_step([sent], _gather(buckets, deal)), "gathered")
        kinds = F.col("kind")
        sums = self.gathered.agg(*[F.sum(F.when(kinds == COUNTS, F.col(x))).alias(x) for x in "xy"], F.sum(F.when((kinds == LISTED) & (F.col("other") < 0), F.col("x"))).alias("n")).first()
        n1, n2 = sums["x"] or 0, sums["y"] or 0
        self.d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
        listed, rows = self.gathered.where((kinds == LISTED) & (F.col("other") >= 0)), self.gathered.where(kinds.isin(ROWS, SHARED))
        tables = int(_first_tables(ROOT_DISCOUNT, float(sums["n"] or 0), float(distinct)))
        root = written(_step([listed], _root(buckets, dishes, 0, tables, 0)), "root")
        states, self.samples = [], []
        for sweep in range(BURN + SAMPLES):
            total = self._total(root)
            answers = root.where(kinds == ANSWER)
            state = written(_step([rows, answers, *states], _sweep(buckets, dishes, self.d, *total, sweep)), "seats")
            states = [state.where(kinds == SEATS)]
            steps = [listed, state.where(kinds == SENT), root.where(kinds == ROOT)]
            root = written(_step(steps, _root(buckets, dishes, 100 + sweep, total[1], sweep + 1)), "root")
            if sweep >= BURN:
                self.samples.append((state, root, self._total(root)))

    def _total(self, root: DataFrame) -> tuple[int, int]:
        found = root.where(F.col("kind") == ROOT).agg(F.sum("x").alias("c"), F.sum("y").alias("t")).first()
        return found["c"] or 0, found["t"] or 0

    def seats(self) -> list[DataFrame]:
        """All that ``Sampled`` reads."""
        kinds, tables = F.col("kind"), [self.gathered.where(F.col("kind").isin(COUNTS, ROWS, SHARED))]
        for state, root, _ in self.samples:
            tables += [state.where(kinds == SEATS), root.where(kinds == ANSWER)]
        return tables

    def roots(self) -> list[DataFrame]:
        """The parent's seats of each sample, told apart by ``x``."""
        return [root.where(F.col("kind") == ROOT).withColumn("x", F.lit(k).cast("long")) for k, (_, root, _) in enumerate(self.samples)]

    def totals(self) -> list[tuple[int, int]]:
        return [total for *_, total in self.samples]


class Sampled:
    """All pairs of a bucket: customers, tables summed over the samples, and each context's tables in each sample."""

    def __init__(self, rows: pa.Table, buckets: int):
        counts, shared = _of(rows, COUNTS)[0], _of(rows, SHARED)[0]
        hot, hot_us = unpack(shared["c"]), unpack(shared["a"]) - 2
        self.c, sizes, self.c_us = (unpack(counts[x]) for x in "abc")
        self.u = np.repeat(np.arange(len(sizes)), sizes)
        many, self.t, self.tables = self.c > 1, np.where(self.c == 1, SAMPLES, 0), []
        for sweep in range(BURN + 1, BURN + SAMPLES + 1):
            t = (self.c == 1).astype(np.int64)
            t[many] = unpack(_of(rows, SEATS, sweep)[0]["a"])
            self.t[many] += t[many]
            sums = np.bincount(self.u, t, len(sizes)).astype(np.int64)
            sums[hot] = _hot_sums(_of(rows, ANSWER, sweep), hot_us, buckets)
            self.tables.append(sums)


def _found(buckets: int):
    """To each part: customers and tables of its pairs in a context bucket, and tables of their contexts in each sample."""

    def run(rows: pa.Table) -> pa.Table:
        out, whole, b = Rows(), Sampled(rows, buckets), rows.column("key")[0].as_py()
        for r in _of(rows, PLACES):
            at = np.cumsum(unpack(r["a"]))
            own = whole.u[at]
            own = own[_runs(own)]
            out.add(r["other"], FOUND, b, whole.c[at], whole.t[at], _joined([t[own] for t in whole.tables]))
        return out.table()

    return run


def _drawn(buckets: int):
    """To each part: the parent's customers and tables of its words in each sample."""

    def run(rows: pa.Table) -> pa.Table:
        out, k = Rows(), rows.column("key")[0].as_py()
        roots = [[unpack(r[x]) for x in "dab"] for s in range(SAMPLES) for r in _of(rows, ROOT, s)]
        for r in _of(rows, WORDS):
            ids = unpack(r["b"]) - 1
            c, t = np.zeros((SAMPLES, len(ids)), np.int64), np.zeros((SAMPLES, len(ids)), np.int64)
            for s, (own, root_c, root_t) in enumerate(roots):
                at = _found_in(own, ids[ids != UNSEEN] // buckets)
                c[s, ids != UNSEEN], t[s, ids != UNSEEN] = root_c[at], root_t[at]
            out.add(r["other"], DRAWN, k, r["a"], r["b"], r["c"], c.ravel(), t.ravel())
        return out.table()

    return run


class Pairs:
    """Customers, tables and their contexts' weights of pairs, as found in the context buckets; in order of bucket, u and w."""

    def __init__(self, found: list[dict], u: np.ndarray, c_u: np.ndarray, d: float):
        c, t = [unpack(r["a"]) for r in found], _joined([unpack(r["b"]) for r in found])
        self.near = (_joined(c) - d * t / SAMPLES) / (STRENGTH + c_u)
        tables, at = [np.zeros((SAMPLES, 0), np.int32)], 0
        for r, n in zip(found, map(len, c), strict=True):
            first = _runs(u[at : at + n])
            own = unpack(r["c"]).reshape(SAMPLES, -1)
            tables.append(np.repeat(own.astype(np.int32) if own.max(initial=0) < 1 << 31 else own, np.diff(np.append(first, n)), axis=1))
            at += n
        self.tables, self.c_u, self.d = np.concatenate(tables, axis=1), c_u, d

    def g(self, sample: int) -> np.ndarray:
        """Weight of the parent's probability after each pair's context."""
        return (STRENGTH + self.d * self.tables[sample]) / (STRENGTH + self.c_u)


def _score(deal: Deal, d: float, totals: list[tuple[int, int]], dishes: int, total: int, distinct: int):
    """Base and model scores of a part's texts."""

    def run(rows: pa.Table) -> pa.Table:
        part = Part(rows, deal, DRAWN)
        p = np.stack([np.full(len(part.known), _share(0, 0, *totals[s], dishes)) for s in range(SAMPLES)])
        place = part.place[part.code]
        root_c, root_t = (np.concatenate([unpack(r[x]).reshape(SAMPLES, -1) for r in part.words], axis=1) for x in "de")
        for s in range(SAMPLES):
            p[s, place] = _share(root_c[s], root_t[s], *totals[s], dishes)
        order = np.concatenate([np.zeros(0, np.int64), *part.by_bucket])
        pairs, w = Pairs(_of(rows, FOUND), part.pu[order], part.c_u[order], d), part.pair_w[order]
        mean = pairs.near
        for s in range(SAMPLES):
            mean += pairs.g(s) * p[s, w] / SAMPLES
        chance = np.empty(len(order))
        chance[order] = np.log10(mean)
        # an unseen word before: nobody sits there
        each = np.log10(p.mean(axis=0))[part.w]
        each[part.inside] = chance[part.at]
        starts = np.cumsum(part.sizes) - part.sizes
        summed = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        base = np.log10((part.counts + 1.0) / (total + distinct + 1.0))
        return pa.table({
            "doc_id": part.doc_id, "held_out": pa.array(part.held), "n_tokens": pa.array(part.sizes), "n_known": pa.array(summed((part.counts > 0).astype(np.int64)[part.codes])),
            "base_score": pa.array(summed(base[part.codes])), "score": pa.array(summed(each)),
        })

    return run


def _table_pairs(deal: Deal):
    """Rows (key, u, w, c, c_u) to the context buckets."""

    def run(rows: pa.Table) -> pa.Table:
        out, key = Rows(), rows.column("key")[0].as_py()
        for b, u, w, c, c_u in _dealt(rows, deal):
            _send(out, b, key, u, w, c, c_u)
        return out.table()

    return run


def _dealt(rows: pa.Table, deal: Deal):
    rows = rows.sort_by([("u", "ascending"), ("w", "ascending")])
    u, w, c, c_u = (rows.column(x).to_numpy() for x in ("u", "w", "c", "c_u"))
    bucket = deal.bucket(u, w, c_u)
    order = np.argsort(bucket, kind="stable")
    for at in np.split(order, _runs(bucket[order])[1:]):
        yield int(bucket[at[0]]), u[at], w[at], c[at], c_u[at]


def _table_found(deal: Deal, d: float):
    """(u, w, near, g) of rows (key, u, w, c, c_u)."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        dealt = [*_dealt(rows, deal)]
        u, w, c_u = (_joined([x[k] for x in dealt]) for k in (1, 2, 4))
        pairs = Pairs(_of(found, FOUND), u, c_u, d)
        return pa.table({"u": u, "w": w, "near": pairs.near, "g": pa.array(np.stack([pairs.g(s) for s in range(SAMPLES)], axis=1).tolist(), pa.list_(pa.float64()))})

    return run


def _table_root(buckets: int, totals: list[tuple[int, int]], dishes: int):
    """(id, p) of the dishes of a word bucket."""

    def run(rows: pa.Table) -> pa.Table:
        roots = [_of(rows, ROOT, s)[0] for s in range(SAMPLES)]
        p = np.stack([_share(unpack(r["a"]), unpack(r["b"]), *totals[s], dishes) for s, r in enumerate(roots)], axis=1)
        return pa.table({"id": unpack(roots[0]["d"]) * buckets + roots[0]["key"], "p": pa.array(p.tolist(), pa.list_(pa.float64()))})

    return run


def sampled(pairs: DataFrame, dishes: int) -> tuple[DataFrame, DataFrame, float]:
    """Gibbs sampling over training pairs (u, w, c): (u, w, near), (id, p, g), and the discount.

    The averaged predictive probability of w after u is near(u, w), nothing if the pair is new, plus
    the mean over samples of g(u) * p(w).
    """
    pairs = pairs.join(pairs.groupBy("u").agg(F.sum("c").alias("c_u")), "u")
    sums = pairs.agg(F.sum("c").alias("c"), F.countDistinct("w").alias("w")).first()
    contexts = 1 + (sums["c"] or 0) // PART
    deal = Deal(contexts, HOT)
    rows = written(pairs.select(F.pmod(F.xxhash64("u", "w"), F.lit(contexts)).alias("key"), "u", "w", "c", "c_u"), "rows")
    fit = Fit(rows.groupBy("key").applyInArrow(_table_pairs(deal), ROW), dishes, sums["w"], contexts, deal)
    found = _step([fit.gathered.where(F.col("kind") == PLACES), *fit.seats()], _found(contexts))
    near = rows.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(_table_found(deal, fit.d), "u long, w long, near double, g array<double>")
    near = written(near, "near")
    roots = reduce(DataFrame.union, fit.roots())
    p = roots.groupBy("key").applyInArrow(_table_root(contexts, fit.totals(), dishes), "id long, p array<double>")
    g = near.groupBy(F.col("u").alias("id")).agg(F.first("g").alias("g"))
    return near.select("u", "w", "near"), written(g.join(p, "id", "full"), "samples"), fit.d


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs(doc_id, text, held_out)``.

    Learns from the rows that are not held out and scores all whole texts, lower-cased A-Z, null as
    empty: words between white space, then one end.  Rows repeat as they come.  With nothing to
    learn from, every token has the base's and the model's uniform share.  Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("held_out", F.lit(False)).alias("held_out"), raw())
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets, deal = 1 + size // WORD_BYTES, Deal(1 + size // CONTEXT_BYTES, HOT)
    # the task's number names its parts: one table, written once
    numbered = written(rows.mapInArrow(released(_number(buckets, PART)), ROW), "codes")
    texts, kind = numbered.where(F.col("kind") == TEXT), F.col("kind")
    found = written(_step([numbered.where(kind == WORDS)], _words(buckets)), "words")
    sums = found.where(kind == COUNTS).agg(F.sum("x").alias("n"), F.sum("y").alias("v")).first()
    total, distinct = sums["n"] or 0, sums["v"] or 0
    words = found.where(kind == WORDS)
    dishes = max(distinct, 1) + 1  # one for all words that training texts have not
    fit = Fit(_step([texts, words], _pairs(deal)), dishes, distinct, buckets, deal)
    by_bucket = words.select(F.col("other").alias("key"), "kind", F.col("key").alias("other"), *"abcdef", "x", "y")
    drawn = _step([by_bucket, *fit.roots()], _drawn(buckets))
    asked = _step([fit.gathered.where(kind == PLACES), *fit.seats()], _found(buckets))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scores = _by_key([texts, drawn, asked]).applyInArrow(_freed(_score(deal, fit.d, fit.totals(), dishes, total, distinct)), schema)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
