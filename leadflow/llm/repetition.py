"""Quality rules on repetition: maximal repeated substrings of each text, from a suffix array and its common prefixes.

Only suffixes whose first ``LEAST`` bytes occur again in their text matter.  They are found and
sorted by prefix doubling; the common prefixes of neighbours come from the places where the byte
before differs (all others follow from the place before).  Intervals of common prefixes are the
repeated substrings that cannot grow to the right; those with different bytes before them cannot
grow to the left either and are maximal.  The union of their occurrences is the repeated part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import by_size, word_codes

#: Bytes of the shortest repeated substring that counts.
LEAST = 40
#: A text is sound with at most this percentage of its bytes repeated, and ...
COVERED_PERCENT = 30
#: ... with a longest repeat of at most this percentage of its bytes.
LONGEST_PERCENT = 20
#: Base rules: fewest words, most percent of words in repeated windows, words of a window.
FEWEST_WORDS = 20
REPEATED_PERCENT = 30
WINDOW = 8
#: Bytes of texts that are sorted together; a longer text is taken by itself.
SLICE = 1 << 20
#: Texts sorted together at most: their number must fit the key of the first sort.
TEXTS = 1 << 20

#: Bytes of the first sort; with the text's number and how many of them lie in the text they fill 64 bits.
_HEAD = 5
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_IS_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])


def _heads(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Key per place: its text, the next bytes (zeros beyond the text's end), how many of them there are."""
    n = len(body)
    padded = np.concatenate([body, np.zeros(_HEAD, np.uint8)])
    key = np.repeat(np.arange(len(start), dtype=np.uint64), end - start)
    for k in range(_HEAD):
        key = key << np.uint64(8) | padded[k : k + n]
    key = key << np.uint64(3) | np.uint64(_HEAD)
    for left in range(1, _HEAD):  # places whose head runs over the end
        at = (end - left)[end - left >= start]
        beyond = np.uint64((1 << 8 * (_HEAD - left) + 3) - 1)
        key[at] = key[at] & ~beyond | np.uint64(left)
    return key


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order of ``key``, where each sorted entry's group starts, and which entries are not alone."""
    order = np.argsort(key)
    ordered = key[order]
    fresh = np.ones(len(key) + 1, bool)
    fresh[1:-1] = ordered[1:] != ordered[:-1]
    begin = np.maximum.accumulate(np.where(fresh[:-1], np.arange(len(key)), 0))
    return order, begin, ~(fresh[:-1] & fresh[1:])


class Suffixes:
    """Suffixes of some texts that share ``least`` bytes or more with another one of the same text.

    ``at``: their places in sorted order; ``lcp``: what each has in common with the one before, 0
    where that is less than ``least``.
    """

    def __init__(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, least: int):
        n = len(body)
        self.body = body
        self.start, self.end = (np.repeat(x.astype(np.int32), end - start) for x in (start, end))
        self.head = _heads(body, start, end)
        order, begin, shared = _grouped(self.head)
        self.rank = np.empty(n, np.int32)
        self.rank[order] = begin
        active, known = order[shared], _HEAD
        while known < least and len(active):
            step = min(known, least - known)
            active, known = self._finer(active, step), known + step
        self.block = self.rank.copy()  # equal where ``least`` bytes are
        chosen, known = active, least
        while len(active):
            active, known = self._finer(active, known), 2 * known
        self.at = chosen[np.argsort(self.rank[chosen])] if len(chosen) else chosen
        self.lcp = self._common(least)

    def _finer(self, active: np.ndarray, step: int) -> np.ndarray:
        """Sorts groups by what follows ``step`` bytes on; returns the places that are still not alone."""
        after = active + step
        inside = after < self.end[active]
        rest = np.where(inside, self.rank[np.minimum(after, len(self.rank) - 1)], -1)
        before = self.rank[active].astype(np.int64)
        order, begin, shared = _grouped(before * (len(self.rank) + 1) + rest + 1)
        old = before[order]
        top = np.ones(len(old), bool)
        top[1:] = old[1:] != old[:-1]
        first = np.maximum.accumulate(np.where(top, np.arange(len(old)), 0))
        self.rank[active[order]] = old + begin - first
        return active[order][shared]

    def _common(self, least: int) -> np.ndarray:
        at, lcp = self.at, np.zeros(len(self.at) + 1, np.int64)
        near = np.flatnonzero(self.block[at[1:]] == self.block[at[:-1]]) + 1
        if not len(near):
            return lcp
        by_place = near[np.argsort(at[near])]
        p, q = at[by_place], at[by_place - 1]
        edge = (p == self.start[p]) | (q == self.start[q])
        own = edge | (self.body[p - 1] != self.body[q - 1])
        value = np.zeros(len(p), np.int64)
        value[own] = self._compared(p[own], q[own], least)
        last = np.maximum.accumulate(np.where(own, np.arange(len(p)), 0))
        lcp[by_place] = value[last] - (p - p[last])
        return lcp

    def _compared(self, p: np.ndarray, q: np.ndarray, least: int) -> np.ndarray:
        """Common bytes of the suffixes at ``p`` and ``q``, known to be ``least`` at any rate."""
        total = np.full(len(p), least, np.int64)
        limit = np.minimum(self.end[p] - p, self.end[q] - q)
        for values, step in ((self.block, least), (self.head, _HEAD), (self.body, 1)):
            on = np.flatnonzero(total + step <= limit)
            while len(on):
                on = on[values[p[on] + total[on]] == values[q[on] + total[on]]]
                total[on] += step
                on = on[total[on] + step <= limit[on]]
        return total


def _smaller_before(values: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier smaller value for every positive one; values[0] is 0."""
    near = np.maximum(np.arange(len(values)) - 1, 0)
    on = np.flatnonzero(values > 0)
    while len(on := on[values[near[on]] >= values[on]]):
        near[on] = near[near[on]]
    return near


def repeats(body: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, length) of each maximal repeated substring of ``least`` bytes or more, and the union of
    their occurrences as (begin, stop) places in ``body``."""
    suffixes = Suffixes(body, start, end, least)
    at, lcp = suffixes.at, suffixes.lcp
    m = len(at)
    if not m:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    left = _smaller_before(lcp)
    right = len(lcp) - 1 - _smaller_before(lcp[::-1])[::-1]  # entries left .. right - 1 of an interval
    before = np.where(at == suffixes.start[at], -1, body[at - 1].astype(np.int64))
    differs = np.zeros(m, np.int64)
    differs[1:] = before[1:] != before[:-1]
    differs = np.cumsum(differs)
    real = np.flatnonzero(lcp > 0)
    diverse = np.zeros(len(lcp), bool)
    diverse[real] = differs[right[real] - 1] > differs[left[real]]
    found = real[diverse[real]]
    _, one = np.unique(left[found] * np.int64(m + 1) + right[found], return_index=True)
    one = found[one]
    # the longest repeat that starts at each place; where it is not maximal, a longer one starts a byte before
    deepest = np.where(lcp[1:] > lcp[:-1], np.arange(1, m + 1), np.arange(m))
    taken = diverse[deepest]
    begin, stop = at[taken], at[taken] + lcp[deepest[taken]]
    order = np.argsort(begin)
    begin, stop = begin[order], np.maximum.accumulate(stop[order])
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] > stop[:-1]) | (begin[1:] == suffixes.start[begin[1:]])  # spans end with their text
    ends = np.append(np.flatnonzero(fresh)[1:], len(begin)) - 1
    text = np.searchsorted(end, at[left[one]], side="right")
    return text, lcp[one], begin[fresh], stop[ends]


def _per_text(marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return np.diff(sums[bounds])


def repeated_words(codes: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each text that lie in a window of ``size`` words (a power of two) found twice or more in it."""
    n, rows = len(codes), np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    stop = bounds[1:][rows]
    at, key, width = np.arange(n), rows * (np.int64(codes.max()) + 1 if n else 1) + codes, 1
    while len(at):
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        at, name = at[again], name[again]
        if width == size:
            break
        names = np.full(n + 1, -1, np.int64)
        names[at] = name
        other = names[np.minimum(at + width, n)]
        inside = (at + 2 * width <= stop[at]) & (other >= 0)
        at, key, width = at[inside], name[inside] * (n + 1) + other[inside], 2 * width
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size if len(at) else at, -1)
    return _per_text(np.cumsum(change[:-1]) > 0, bounds)


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_bytes long, n_repeats long, n_covered long, longest long, spans array<struct<start: long, end: long>>"
)


def _measured(least: int):
    def measure(batches):
        for whole in batches:
            for part in (whole.slice(k, TEXTS) for k in range(0, whole.num_rows, TEXTS)):
                for batch in by_size(part, "text", SLICE):
                    yield _measure(batch, least)

    return measure


def _measure(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    texts = batch.column("text").cast(pa.large_binary())
    codes, word_bounds, _ = word_codes(texts, _SPACES)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    start, end = bounds[:-1], bounds[1:]
    own = [body[a:b].tobytes().split(b"\n") for a, b in zip(start, end, strict=True)]
    lines = [[x for x in y if x.strip(b" \t\n\x0b\x0c\r")] for y in own]
    text, length, begin, stop = repeats(body, start, end, least)
    n_repeats = np.bincount(text, minlength=len(texts))
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, length)
    span_text = np.searchsorted(end, begin, side="right")
    covered = np.bincount(span_text, weights=stop - begin, minlength=len(texts)).astype(np.int64)
    span_bounds = np.searchsorted(span_text, np.arange(len(texts) + 1))
    spans = pa.StructArray.from_arrays([pa.array(x - start[span_text], pa.int64()) for x in (begin, stop)], fields=list(SPAN))
    point = (body & 0xC0) != 0x80
    columns = {
        "n_words": np.diff(word_bounds),
        "word_chars": _per_text(point & ~_IS_SPACE[body], bounds),
        "n_symbols": _per_text(_IS_SYMBOL[body], bounds),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated_words(codes.astype(np.int64), word_bounds),
        "n_bytes": end - start,
        "n_repeats": n_repeats,
        "n_covered": covered,
        "longest": longest,
    }
    arrays = [batch.column("key"), *[pa.array(c, pa.int64()) for c in columns.values()], pa.ListArray.from_arrays(pa.array(span_bounds, pa.int32()), spans)]
    return pa.RecordBatch.from_arrays(arrays, ["key", *columns, "spans"])


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def sound(covered_percent: int = COVERED_PERCENT, longest_percent: int = LONGEST_PERCENT) -> Column:
    """The verdict on what is repeated: neither too much of the text nor too long a piece of it."""
    return (100 * F.col("n_covered") <= covered_percent * F.col("n_bytes")) & (100 * F.col("longest") <= longest_percent * F.col("n_bytes"))


def repetition(docs: DataFrame, key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """Measures of every row of ``docs``, with its ``key``: one row per row.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: words, code points in words,
    characters of ``#*$%&|<>``, lines with a word that equal an earlier line, words in windows of
    eight words found twice or more.  n_repeats, longest: number of maximal repeated substrings of
    ``least`` bytes or more (occurrences may overlap) and bytes of the longest; spans, n_covered: the
    union of all their occurrences as byte ranges, and its bytes.  base_failed, kept: see
    ``base_failed`` and ``sound``; ``kept`` is false where the base rules fail.

    A null text counts as empty: all zeros, base_failed.  Repeated rows and null keys are measured
    like all others; other columns are ignored; no rows, no rows.  Nothing is shuffled: a text is
    measured whole where it is, a long one by itself, with some 60 bytes of memory per byte of it.
    """
    if least < _HEAD:
        raise ValueError(f"repeats of fewer than {_HEAD} bytes cannot be asked for")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), text).mapInArrow(_measured(least), f"key {kind}, {SCHEMA}")
    judged = found.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & sound()).withColumnRenamed("key", key)


def keep_sound(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the rows that the rules reject; all columns as they were, whatever their names."""
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("_doc"), "text")
    return repetition(keyed, "_doc", least).where("kept").select(*[F.col("_doc")[n].alias(n) for n in names])
