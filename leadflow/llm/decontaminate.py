"""Benchmark decontamination: a hash set of test n-grams against the words of training texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import raw, released, word_codes
from leadflow.operators.shared import handover

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Windows of the benchmark that are broadcast at once (some 30 MB); a larger benchmark is taken in
#: several parts, each scanned for, and the parts' hits are merged.
BROADCAST_WINDOWS = 200_000


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class Grams:
    """Windows of test items: the words they hold, and for each window's hash the window and its items."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], list[str]]]):
        self.word = {w: k + 1 for k, w in enumerate(sorted({w for ws, _ in windows for w in ws}))}
        rows = [np.array([self.word[w] for w in ws], np.int64) for ws, _ in windows]
        self.items = [items for _, items in windows]
        for seed in range(1000):  # a seed under which no two windows share a hash
            draw = np.random.default_rng(seed)
            self.mark = np.concatenate([[0], draw.integers(1, 2**63, len(self.word) + 1, np.uint64)]).astype(np.uint64)
            self.factor = np.uint64(draw.integers(1, 2**62) * 2 + 1)
            hashes = np.array([self.hashed(r, len(r))[0] for r in rows], np.uint64)
            if len(np.unique(hashes)) == len(hashes):
                break
        self.by_length = {}
        for n in sorted({len(r) for r in rows}):
            which = np.array([k for k, r in enumerate(rows) if len(r) == n])
            which = which[np.argsort(hashes[which])]
            self.by_length[n] = hashes[which], which, np.stack([rows[k] for k in which])

    def hashed(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of every run of ``n`` words."""
        marks, size = self.mark[ids], len(ids) - n + 1
        total = np.zeros(max(size, 0), np.uint64)
        for k in range(n):
            total = total * self.factor + marks[k : k + size]
        return total

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, first word, words) of each occurrence; ids are 0 for words no window holds."""
        found = [[], [], []]
        for n, (hashes, which, words) in self.by_length.items():
            if len(ids) < n:
                continue
            full = np.concatenate([[0], np.cumsum(ids == 0)])
            starts = np.flatnonzero(full[n:] == full[:-n])  # runs of known words only
            if not len(starts):
                continue
            own = self.hashed(ids, n)[starts]
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            match = np.flatnonzero(hashes[at] == own)
            starts, at = starts[match], at[match]
            same = (ids[starts[:, None] + np.arange(n)] == words[at]).all(axis=1) if len(starts) else np.zeros(0, bool)
            found[0].append(which[at[same]])
            found[1].append(starts[same])
            found[2].append(np.full(same.sum(), n))
        return tuple(np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(gram, items): distinct windows of ``size`` words of the items' texts, with the ids of the items that hold them."""

    def cut(batches):
        for batch in batches:
            out = [[], []]
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = _words(text.as_py())
                for k in range(max(len(words) - size, 0) + 1 if words else 0):
                    out[0].append(b" ".join(words[k : k + size]))
                    out[1].append(item.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["gram", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), raw())
    grams = items.mapInArrow(cut, "gram binary, item string").distinct()
    return grams.groupBy("gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _scan(shared):
    """Per document: its words, and the occurrences of windows with the items they stand for."""

    def scan(batches):
        grams = Grams.__new__(Grams)
        grams.__dict__ = shared.value
        for batch in batches:
            codes, bounds, names = word_codes(batch.column("text"), WORDS)
            known = np.array([grams.word.get(n.as_buffer().to_pybytes() if n.is_valid else b"", 0) for n in names], np.int64)
            # a 0 between documents keeps windows inside them
            rows = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            ids = np.zeros(len(codes) + batch.num_rows, np.int64)
            ids[np.arange(len(codes)) + rows] = known[codes] if len(codes) else 0
            first = bounds[:-1] + np.arange(batch.num_rows)
            window, start, n = grams.hits(ids)
            row = np.searchsorted(first, start, side="right") - 1
            order = np.lexsort((start, row))
            window, start, n, row = window[order], start[order] - first[row[order]], n[order], row[order]
            bound = np.searchsorted(row, np.arange(batch.num_rows + 1))
            spans, items = [], []
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                spans.append([{"start": int(s), "words": int(k)} for s, k in zip(start[a:b], n[a:b], strict=True)])
                items.append(sorted({i for w in set(window[a:b].tolist()) for i in grams.items[w]}))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(bounds)), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))],
                ["row", "n_words", "hits", "items"],
            )

    return scan


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def find_hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", size: int = 10) -> DataFrame:
    """(``key``, n_words, hits, items) per row of ``docs``: occurrences of benchmark windows in its text.

    A window is ``size`` consecutive words of an item, or the whole of a shorter item; ``hits`` are
    its occurrences as (first word, number of words), ``items`` the ids of the items concerned.  The
    windows travel as a broadcast hash set while they are few (``BROADCAST_WINDOWS``, checked);
    more are taken in parts by hash, and the parts' results are joined by row.  Every occurrence is
    verified word by word.  Null and empty texts have no words and no hits; an empty benchmark gives
    no hits; repeated rows of documents are scanned as rows of their own.
    """
    spark = docs.sparkSession
    grams = handover(windows(benchmark, size), "windows")
    parts = max(1, -(-grams.count() // BROADCAST_WINDOWS))
    texts = docs.select(F.col(key).alias("row"), raw())
    if parts > 1:  # rows are told apart when their parts are merged
        texts = handover(texts.select(F.struct("row", F.monotonically_increasing_id().alias("n")).alias("row"), "text"), "texts")
    kind = texts.schema["row"].dataType.simpleString()
    schema = f"row {kind}, n_words long, hits array<struct<start: long, words: long>>, items array<string>"
    scanned = []
    for part in range(parts):
        own = grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).toLocalIterator()
        # plain values only: executors need not have this class
        shared = spark.sparkContext.broadcast(vars(Grams([(tuple(bytes(g.gram).split(b" ")), g["items"]) for g in own])))
        scanned.append(texts.mapInArrow(released(_scan(shared)), schema))
    if parts > 1:
        each = scanned[0]
        for more in scanned[1:]:
            each = each.union(more)
        hits, items = F.flatten(F.collect_list("hits")), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
        merged = each.groupBy("row.n").agg(F.first("row.row").alias("row"), F.first("n_words").alias("n_words"), hits.alias("hits"), items.alias("items"))
        scanned = [merged.drop("n")]
    return scanned[0].withColumnRenamed("row", key)


def hit_words(hits: str = "hits") -> Column:
    """Number of words inside any of the hits: the length of their union."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))

    def step(acc, h):
        end = h["start"] + h["words"]
        fresh = F.greatest(end - F.greatest(h["start"], acc["end"]), F.lit(0).cast("long"))
        return F.struct((acc["total"] + fresh).alias("total"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(hits), zero, step)["total"]


def decontamination_report(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    See ``find_hits``; n_hit counts the words inside any occurrence, items_sha256 is over the item
    ids, sorted as strings and comma-joined (over the empty text if there are none).
    """
    found = find_hits(docs, benchmark, "doc_id", size)
    n_hit = hit_words().alias("n_hit")
    return found.select(
        "doc_id", "n_words", n_hit, F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; all columns as they were.

    The text is scanned where the row is, so nothing is shuffled while the benchmark fits one
    broadcast; rows with a null id are judged by their text like all others.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("_doc"), raw())
    # the whole row travels through the scan as its key
    clean = find_hits(keyed, benchmark, "_doc", size).where(F.size("hits") == 0)
    return clean.select(*[F.col("_doc")[n].alias(n) for n in names])


def _cut(batches):
    for batch in batches:
        out = []
        for text, hits in zip(batch.column("text"), batch.column("hits"), strict=True):
            body = text.as_py()
            if not len(hits.values):
                out.append(body)
                continue
            clean, at, bounds = body.translate(WORDS), 0, []
            for w in clean.split():
                at = clean.index(w, at)
                bounds.append((at, at + len(w)))
                at += len(w)
            drop = sorted((bounds[h["start"]][0], bounds[h["start"] + h["words"] - 1][1]) for h in hits.as_py())
            kept, end = [], 0
            for a, b in drop:
                kept.append(body[end:a] if a > end else b"")
                end = max(end, b)
            out.append(b"".join([*kept, body[end:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([o.decode("utf-8", "replace") for o in out], pa.string())], ["doc_id", "text"])


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, text): the texts without the words inside benchmark windows, and what lies between those words."""
    keyed = docs.select(F.struct(F.col("doc_id"), raw()).alias("_doc"), raw())
    found = find_hits(keyed, benchmark, "_doc", size)
    return found.select(F.col("_doc.doc_id").cast("long").alias("doc_id"), "_doc.text", "hits").mapInArrow(_cut, "doc_id long, text string")
