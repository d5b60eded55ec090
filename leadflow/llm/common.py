"""What several operators of this package share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadflow.operators.shared import handover, new_folder, spread_factor, spread_lookup

#: Byte table that lower-cases A-Z and nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``handover`` of a large table: compressed harder, as texts and their digests fill the shared folder."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """``stored``, after which the shuffle files that it took are given back: nothing reads them again."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        return stored(df, label)
    finally:
        spark.conf.set(name, before)


def chosen_rows(rows: DataFrame, wanted: DataFrame, row: str = "row") -> DataFrame:
    """Those of stored ``rows`` whose number is in ``wanted``, without a shuffle of them.

    Numbers are those of ``monotonically_increasing_id``.  The wanted ones are sent as bitmaps, a bit
    for each row of the table at most, so 10 million rows take little more than a megabyte.
    """
    number = F.col(row) + 1  # buckets of bitmaps are numbered from 1
    bits = wanted.groupBy(F.bitmap_bucket_number(number).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    bits = handover(bits, "chosen-rows")
    place = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), "_bucket")
    return met.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(8)).cast("int"))) != 0).select(*rows.columns)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text (remainder 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def raw(text: str = "text") -> Column:
    """A text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """All texts of a batch with each byte replaced by ``table``, in one pass over their buffer."""
    texts = texts.cast(pa.large_binary()) if texts.type != pa.large_binary() else texts
    if texts.null_count:
        texts = pc.fill_null(texts, b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    body = (memoryview(data)[int(offsets[0]) : int(offsets[-1])] if data is not None else b"")
    moved = pa.py_buffer(bytes(body).translate(table))
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), moved])


def word_codes(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of a batch of texts as codes: (code of each word, rows' bounds in it, distinct words).

    ``table`` must turn every separator into a space.  Splitting and numbering run in Arrow.
    """
    clean = translated(texts, table)
    # only ASCII bytes are replaced, and only by ASCII ones: still UTF-8
    lists = pc.ascii_split_whitespace(clean.view(pa.large_string()))
    flat = lists.flatten()
    sizes = np.diff(np.frombuffer(lists.buffers()[1], np.int64 if pa.types.is_large_list(lists.type) else np.int32, len(lists) + 1, lists.offset * (8 if pa.types.is_large_list(lists.type) else 4)))
    numbered = flat.dictionary_encode()
    codes, names = numbered.indices.to_numpy(zero_copy_only=False), numbered.dictionary
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    empty = pc.index(names, pa.scalar("", names.type)).as_py()
    if empty >= 0:  # a split at the start or end of a text leaves an empty piece
        real = codes != empty
        before = np.concatenate([[0], np.cumsum(real)]).astype(np.int64)
        codes, bounds = codes[real], before[bounds]
    return codes, bounds, names


def by_size(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch, cut where ``column`` has gathered ``limit`` bytes; a longer row is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


#: Slots that hot keys are marked in; rows of a key from which on it is dealt to many tasks.
SLOTS, HOT = 1 << 16, 4000


def _slot(on: list[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(SLOTS))


def hot_slots(sizes: DataFrame, on: list[str], n: str, hot: int = HOT) -> DataFrame:
    """(slot): the slots of keys with more than ``hot`` rows; at most ``SLOTS`` rows, so it may be broadcast at any size of input."""
    return sizes.where(F.col(n) > hot).select(_slot(on).alias("_slot")).distinct()


def in_slots(rows: DataFrame, slots: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """``rows`` with ``_part``: 0 where the slot of their key has no hot key, else 1 and up, dealt by ``by`` over the shuffle partitions."""
    dealt = F.pmod(F.xxhash64(*by), F.lit(spread_factor(rows.sparkSession))) + 1
    marked = rows.withColumn("_slot", _slot(on)).join(F.broadcast(slots.withColumn("_hot", F.lit(True))), "_slot", "left")
    return marked.withColumn("_part", F.when(F.col("_hot"), dealt).otherwise(F.lit(0))).drop("_slot", "_hot")


def hot_lookup(left: DataFrame, sizes: DataFrame, on: list[str], n: str, by: list[str], hot: int = HOT) -> DataFrame:
    """Inner join of stored ``left`` rows to the one row of their key in stored ``sizes``, ``n`` being its rows on the left.

    Keys with more than ``hot`` rows, and those that share their slots, are dealt to many tasks by
    ``by``; all others are joined plainly.  Each part of a dealt key gets one copy of its row.
    """
    slots = handover(hot_slots(sizes, on, n, hot), "hot-slots")
    parts = in_slots(left, slots, on, by)
    wanted = parts.where("_part > 0").select(*on, "_part").distinct().join(sizes, on)
    plain = in_slots(sizes, slots, on, on).where("_part = 0")
    return parts.join(plain.unionByName(wanted), [*on, "_part"]).drop("_part")


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system, as the worker process goes on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim is not None:
        trim(0)


def released(run):
    """``run`` over the batches of a task, after which the worker gives its memory back."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among values as a star forest: each linked value but the smallest of its group, with that smallest."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(jumped := label[label], label):
            label = jumped
        x, y = label[x], label[y]
        x, y = x[keep := x != y], y[keep]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forest_of(batches):
    for batch in batches:
        child, root = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(root)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of ``links(a, b)``, longs, the smallest node it is linked with.

    Rounds of hooking and contraction: each node points to the smallest of itself and its
    neighbours, pointers are followed twice, and links are renamed to what their ends point to.
    Every round at least halves the nodes that still have links.  All look-ups are spread, so a
    group with a third of all nodes does not meet in one task; each round's tables are written to
    the shared folder.  No link, or only links of a node with itself: no row.
    """
    now = handover(links.select("a", "b").where("a <> b").mapInArrow(_forest_of, "a long, b long").distinct(), "links")
    found = None
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        points = handover(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")), "points")
        onward = points.select(F.col("a").alias("b"), F.col("b").alias("onto"))
        points = handover(spread_lookup(points, onward, ["b"], ["a"]).select("a", F.coalesce("onto", "b").alias("b")), "points")
        if found is None:
            found = points
        else:
            moves = points.select(F.col("a").alias("b"), F.col("b").alias("onto"))
            found = handover(spread_lookup(found, moves, ["b"], ["a"]).select("a", F.coalesce("onto", "b").alias("b")), "found")
        first = spread_lookup(now, points.select("a", F.col("b").alias("x")), ["a"], ["b"])
        first = handover(first.select(F.coalesce("x", "a").alias("a"), "b"), "links")
        second = spread_lookup(first, points.select(F.col("a").alias("b"), F.col("b").alias("y")), ["b"], ["a"])
        now = handover(second.select("a", F.coalesce("y", "b").alias("b")).where("a <> b").distinct(), "links")
    if found is None:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select(F.col("a").alias("node"), F.col("b").alias("component"))
