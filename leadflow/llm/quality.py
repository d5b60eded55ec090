"""Quality classifier: an additive model of lookup tables with pairwise interactions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import LOWER, raw

#: Labelled rows the model is fitted on at most (about), chosen by a hash of the text.
SAMPLE = 30_000
BINS, PAIR_BINS, PAIRS = 32, 8, 12
ROUNDS, PAIR_ROUNDS, RATE, SHRINK = 120, 60, 0.15, 1.0

FEATURES = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "long_words", "one_letter", "upper", "lower", "digits", "spaces",
    "newlines", "exclaims", "stops", "commas", "bars", "other_marks", "non_ascii", "distinct_words", "top_word", "repeated_pairs",
    "distinct_lines", "top_line", "line_length", "short_lines", "compressed", "entropy", "capital_words", "doubled_words",
]


def features(text: bytes) -> list[float]:
    """Shape of a whole text as numbers; an empty text has zeros."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = seen / n
    words = text.split()
    lowered = text.translate(LOWER).split()
    sizes = np.array([len(w) for w in words]) if words else np.zeros(1)
    count = max(len(words), 1)
    distinct = dict.fromkeys(lowered, 0)
    for w in lowered:
        distinct[w] += 1
    pairs = len(set(zip(lowered, lowered[1:], strict=False)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    by_line: dict[bytes, int] = {}
    for x in lines:
        by_line[x] = by_line.get(x, 0) + 1
    lengths = np.array([len(x) for x in lines]) if lines else np.zeros(1)
    some = share[share > 0]
    marks = share[33:48].sum() + share[58:65].sum() + share[91:97].sum() + share[123:127].sum()
    named = {c: share[ord(c)] for c in "!.,|"}
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), sizes.std(), (sizes > 15).mean(), (sizes == 1).mean(),
        share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[32], share[10], named["!"], named["."], named[","], named["|"],
        marks - sum(named.values()), share[128:].sum(), len(distinct) / count, max(distinct.values(), default=0) / count,
        1 - pairs / max(count - 1, 1) if count > 1 else 0.0, len(by_line) / max(len(lines), 1), max(by_line.values(), default=0) / max(len(lines), 1),
        np.log1p(lengths.mean()), (lengths < 20).mean(), len(zlib.compress(text, 1)) / n, float(-(some * np.log2(some)).sum()),
        sum(w[:1].isupper() for w in words) / count, sum(a == b for a, b in zip(lowered, lowered[1:], strict=False)) / count,
    ]


def _best_cuts(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf of each bin: a tree of up to ``leaves`` leaves, grown by the split that gains most."""
    bounds = [(0, len(g))]
    value = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + SHRINK)
    while len(bounds) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(bounds):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + SHRINK) + (all_g - left_g) ** 2 / (all_h - left_h + SHRINK) - value(a, b)
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (gain[at], k, a + at + 1)
        if best[1] is None:
            break
        a, b = bounds.pop(best[1])
        bounds += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in bounds:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two levels over a grid: one cut of the rows, then one of the columns on either side."""
    best = (np.zeros_like(g), 0.0)
    for k in range(1, len(g)):
        table, gain = np.zeros_like(g), 0.0
        for side in (slice(0, k), slice(k, len(g))):
            rows_g, rows_h = g[side].sum(axis=0), h[side].sum(axis=0)
            leaf = _best_cuts(rows_g, rows_h, 2)
            table[side] = leaf
            gain += float((leaf * rows_g).sum())
        if gain > best[1]:
            best = (table, gain)
    return best


class Additive:
    """Sum of one table per feature and one per chosen pair of features, on the log-odds scale."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        n, f = x.shape
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(f)]
        self.coarse = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for k in range(f)]
        rate = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs, self.pair_tables = [], []
        bins, total = self._bins(x, self.cuts), np.full(n, self.bias)

        def sums(index: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return np.bincount(index, y - p, size), np.bincount(index, p * (1 - p), size)

        for _ in range(ROUNDS):
            for k in range(f):  # one feature after another, each a small step
                move = RATE * _best_cuts(*sums(bins[k], len(self.tables[k])), leaves=3)
                self.tables[k] += move
                total += move[bins[k]]
        grid, size = self._bins(x, self.coarse), PAIR_BINS
        gains = []
        for a in range(f):
            for b in range(a + 1, f):
                g, h = sums(grid[a] * size + grid[b], size * size)
                gains.append((_pair_tree(g.reshape(size, size), h.reshape(size, size))[1], a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((size, size)) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for k, (a, b) in enumerate(self.pairs):
                cell = grid[a] * size + grid[b]
                g, h = sums(cell, size * size)
                move = RATE * _pair_tree(g.reshape(size, size), h.reshape(size, size))[0]
                self.pair_tables[k] += move
                total += move.ravel()[cell]
        return self

    @staticmethod
    def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, grid = self._bins(x, self.cuts), self._bins(x, self.coarse)
        total = np.full(len(x), self.bias)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for table, (a, b) in zip(self.pair_tables, self.pairs, strict=True):
            total += table[grid[a], grid[b]]
        return 1 / (1 + np.exp(-total))


def _described(batches):
    for batch in batches:
        rows = [features(t.as_buffer().to_pybytes()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], ["y", "x"])


def train(labelled: DataFrame) -> Additive | None:
    """A model from ``labelled(text, y)``, y 0 or 1 (null rows are left out); None without any label.

    Fitted on about ``SAMPLE`` rows at most, chosen by a hash of all columns, so that copies of a text with
    other ids are chosen one by one and repeated rows count once: the driver holds a bounded table of
    ``FEATURES`` whatever the input.  Null and empty texts teach like others.
    """
    drawn = labelled.withColumn("_draw", F.xxhash64(*labelled.columns))
    known = drawn.where(F.col("y").isin(0, 1)).select(F.col("y").cast("int").alias("y"), raw(), "_draw")
    count = known.count()
    if not count:
        return None
    chance = F.pmod("_draw", F.lit(1_000_000)) / 1e6
    return _fitted(known.where(chance < SAMPLE / count).dropDuplicates(["_draw"]).select("y", "text"))


def train_on(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> Additive | None:
    """As :func:`train`, from ``docs(key, text)`` and ``labels(key, y)``, both read by key.

    Labels meet the digests of the texts; the texts themselves are read again for the chosen rows, which
    are few enough for every task to hold their keys, so that no other text is ever shuffled.
    """
    told = labels.where(F.col("y").isin(0, 1)).select(key, F.col("y").cast("int").alias("y"))
    digests = docs.withColumn("_text", F.xxhash64(key, "text"))
    known = digests.select(key, "_text").join(told, key).withColumn("_draw", F.xxhash64("_text", "y"))
    count = known.count()
    if not count:
        return None
    chance = F.pmod("_draw", F.lit(1_000_000)) / 1e6
    chosen = known.where(chance < SAMPLE / count).dropDuplicates(["_draw"]).drop("_draw")
    found = digests.join(F.broadcast(chosen), [key, "_text"]).dropDuplicates([key, "_text", "y"])
    return _fitted(found.select("y", raw()))


def _fitted(chosen: DataFrame) -> Additive | None:
    rows = chosen.mapInArrow(_described, "y int, x array<double>").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["x"], r["y"]))
    return Additive().fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: Additive | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, score) per row: how likely its whole text is of quality 1; null counts as empty; 0.5 without a model."""
    if model is None:
        return docs.select(key, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain values only

    def run(batches):
        own = Additive.__new__(Additive)
        own.__dict__ = shared.value
        for batch in batches:
            x = np.array([features(t.as_buffer().to_pybytes()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(own.score(x))], ["key", "score"])

    rows = docs.select(F.col(key).alias("key"), raw(text))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)
