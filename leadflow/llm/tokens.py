"""Token-id files: tokenise texts, write them as rANS blocks in id order, read them back.

A file set is a folder of Parquet files written by Spark, so it can lie in any store that Spark
reaches: ``blocks`` (part, seq, first, doc_ids, lengths, payload), one self-contained block
(``rans``) a row, rows in ascending doc_id order within a file and from file to file; ``parts`` (part,
tokens), one row a file; ``table`` (id, count), the corpus counts from which all blocks' shared
frequencies follow.
"""

from __future__ import annotations

import json
import os
import string
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from leadflow.llm.common import by_size, released
from leadflow.llm.rans import Table, scaled
from leadflow.operators.shared import handover, new_folder

#: Ids after which a block is closed; a longer document makes a longer block of its own.
BLOCK = 1 << 18
#: Bytes of text whose pieces are numbered together; pieces that the library gets as one text.
SLICE, GROUP = 2 << 20, 500
#: Bytes that a worker's memory of ids may take (pieces, ids and their bounds); it forgets all when
#: there is more, and at the end of each task.
REMEMBER = 16 << 20
#: Bytes of the longest piece of text whose ids are remembered.
SHORT = 64


def _worker(name: str, make):
    """What ``make`` gives, once per Python worker."""
    home = sys.modules.setdefault("_leadflow_worker", types.ModuleType("_leadflow_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


#: Classes of code points that a byte-level pre-tokenizer tells apart; UNSURE: versions of Unicode differ.
SPACE, BLANK, LETTER, NUMBER, OTHER, UNSURE = range(6)
#: Code points of white space other than the space (the Unicode property), as ranges with both ends.
BLANKS = [(9, 13), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
#: Code points with a class of their own; all above are UNSURE.
POINTS = 0x20000


def _classes() -> np.ndarray:
    """Class of each code point; sure is what an old version of Unicode classes alike, or what is neither letter nor number now."""

    def of(category: str) -> int:
        return LETTER if category[0] == "L" else NUMBER if category[0] == "N" else OTHER

    table = np.full(POINTS + 1, UNSURE, np.uint8)
    for k in range(POINTS):
        now, old = unicodedata.category(chr(k)), unicodedata.ucd_3_2_0.category(chr(k))
        if now != "Cn" and (of(now) == of(old) or (old == "Cn" and of(now) == OTHER)):
            table[k] = of(now)
    for low, high in BLANKS:
        table[low : high + 1] = BLANK
    table[0x20], table[0x180E] = SPACE, UNSURE
    return table


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies have for each byte; a line end stands between spaces."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return letters | {10: f" {letters[10]} "}


def _starts(points: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of a byte-level pre-tokenizer begin, one mark a code point; ``bounds`` are those of the texts.

    A piece is a run of letters, of numbers or of others, with one space before it if there is one; a
    contraction at the beginning of such a run; or white space up to the last one before a run.
    """
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    blank = kind <= BLANK
    start = np.empty(n, bool)
    start[0] = True
    # the last white space before a run begins a piece, as does the first after one
    ends = np.append(~blank[1:], True) & ~first[1:]
    same = np.where(blank[1:], blank[:-1] & ~ends[1:], (kind[:-1] == SPACE) | (kind[1:] == kind[:-1]))
    np.logical_not(same, out=start[1:])
    start |= first[:n]
    # a run and its text end before each of these
    at = np.flatnonzero((points == ord("'")) & start)
    if len(at):
        text_end = bounds[np.searchsorted(bounds, at, side="right")]
        padded = np.append(points, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        single = np.isin(one, [ord(c) for c in "stmd"]) & (at + 1 < text_end)
        double = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (at + 2 < text_end)
        start[at[single | double] + 1] = False
        after = at + 2 + double
        after = after[(single | double) & (after < text_end)]
        start[after] = True
    return start


class Tokens:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of text once.

    The cuts of a byte-level pre-tokenizer follow from classes of code points, so they are found for
    many texts at once, and the ids of a text are those of its pieces in order.  Texts that hold an
    added token or a code point of no sure class, and all texts under another pre-tokenizer, go to
    the library whole.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.width = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        made = {k: json.loads(self.library.to_str()).get(k) for k in ("pre_tokenizer", "normalizer")}
        pre = made["pre_tokenizer"] or {}
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        line = self.whole("\n")
        # pieces are told apart by line ends between them
        self.cuts = bool(byte_level and not made["normalizer"] and len(line) == 1 and all(t.isascii() and not set(t) & set(string.whitespace) for t in self.added))
        self.line = int(line[0]) if len(line) else -1
        self.kinds = _classes() if self.cuts else None
        self.of_texts, self.of_pieces, self.letters = self.library.pre_tokenizer, WhitespaceSplit(), _byte_letters()
        self.forget()

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.width)

    def forget(self) -> None:
        self.names, self.coded = (pa.array([], pa.large_binary()) for _ in range(2))

    @property
    def held(self) -> int:
        """Bytes that are remembered."""
        return self.names.nbytes + self.coded.nbytes

    @property
    def ids(self) -> dict[bytes, bytes]:
        """Remembered pieces with their ids."""
        return dict(zip(self.names.to_pylist(), self.coded.to_pylist(), strict=True))

    def learn(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, each as bytes, by one call for many: they are joined by line ends.

        As they are cut, the library gets them in the letters that a byte-level pre-tokenizer makes, spaces between them.
        """
        bounds, data = _parts(pieces)
        last = data[np.maximum(bounds[1:] - 1, 0)]
        blank = np.zeros(len(pieces), bool)
        for k in np.flatnonzero((last <= 0x20) | (last >= 0x80)).tolist():
            piece = pieces[k].as_py()
            blank[k] = piece.isspace() or (not piece.isascii() and piece.decode().isspace())
        plain = pieces.filter(pa.array(~blank)) if blank.any() else pieces
        ends = np.append(np.arange(0, len(plain), GROUP), len(plain))
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), plain), pa.scalar(b"\n", pa.large_binary())).to_pylist()
        self.library.pre_tokenizer = self.of_pieces
        try:
            coded = self.library.encode_batch_fast([t.decode("latin-1").translate(self.letters) for t in texts], add_special_tokens=False)
        finally:
            self.library.pre_tokenizer = self.of_texts
        flat = np.concatenate([np.append(np.array(e.ids, self.width), self.width(self.line)) for e in coded]) if coded else np.zeros(0, self.width)
        ends = flat == self.line
        sizes = np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(ends)
        sizes[~blank] = np.diff(np.append(-1, at)) - 1
        flat = flat[~ends]
        if blank.any():  # white space may hold line ends: by itself, and put in its place
            own = {k: self.whole(pieces[k].as_py().decode()) for k in np.flatnonzero(blank).tolist()}
            before = np.cumsum(sizes)
            flat = np.insert(flat, np.repeat(before[list(own)], [len(i) for i in own.values()]), np.concatenate(list(own.values())))
            sizes[list(own)] = [len(i) for i in own.values()]
        return _binaries(sizes * flat.itemsize, flat)

    def remember(self, pieces: pa.Array, ids: pa.Array) -> None:
        short = pa.array(np.diff(_parts(pieces)[0]) <= SHORT)
        pieces, ids = pieces.filter(short), ids.filter(short)
        if self.held + pieces.nbytes + ids.nbytes > REMEMBER:
            self.forget()
        if pieces.nbytes + ids.nbytes <= REMEMBER:
            self.names, self.coded = pa.concat_arrays([self.names, pieces]), pa.concat_arrays([self.coded, ids])

    def encoded(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces, each as bytes."""
        if self.held > REMEMBER:
            self.forget()
        at = pc.index_in(pieces, value_set=self.names)
        if not at.null_count:
            return self.coded.take(at)
        missing = pieces.filter(pc.is_null(at))
        learned = self.learn(missing)
        places = at.to_numpy(zero_copy_only=False)
        new = np.isnan(places)
        places = np.where(new, len(self.coded) + np.cumsum(new) - 1, np.nan_to_num(places)).astype(np.int64)
        found = pa.concat_arrays([self.coded, learned]).take(pa.array(places))
        self.remember(missing, learned)
        return found

    def pieces(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(pieces of all texts in order, bounds of each text in them, texts with a code point of no sure class)."""
        body = b"".join(texts)
        points = np.frombuffer(body.decode().encode("utf-32-le"), np.uint32)
        offsets = np.flatnonzero((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)
        bounds = np.searchsorted(offsets, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        kind = self.kinds[np.minimum(points, POINTS)]
        unsure = np.zeros(len(texts), bool)
        unsure[np.searchsorted(bounds, np.flatnonzero(kind == UNSURE), side="right") - 1] = True
        at = np.flatnonzero(_starts(points, kind, bounds)) if len(points) else np.zeros(0, np.int64)
        cuts = np.append(offsets[at], len(body))
        arrays = [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(body)]
        return pa.Array.from_buffers(pa.large_binary(), len(at), arrays), np.searchsorted(at, bounds), unsure

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as bytes."""
        odd = np.full(len(texts), not self.cuts)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        raw_texts = texts.cast(pa.binary() if texts.type == pa.string() else pa.large_binary())
        plain = np.flatnonzero(~odd)
        if len(plain):
            pieces, bounds, unsure = self.pieces([raw_texts[k].as_py() for k in plain.tolist()])
            odd[plain[unsure]] = True
            numbered = pieces.dictionary_encode()
            ends, ids = _parts(self.encoded(numbered.dictionary).take(numbered.indices))
            ends = ends[bounds]
            for k, a, b in zip(plain.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                out[k] = ids[a:b].tobytes()
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.whole(texts[k].as_py()).tobytes()
        return out


def _parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes) of large binaries."""
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8) if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2]
    return bounds, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def _binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Large binaries of these sizes, end to end in ``data``."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, ids): ids of each whole text with ``end`` appended, as little-endian unsigned integers (16 bits if they fit), each row compressed by Zstandard."""

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread: Spark deals out the cores
        tokens = _worker("tokens:" + path, lambda: Tokens(path))
        last = np.array([end], tokens.width).tobytes()
        pack = zstandard.ZstdCompressor(level=1).compress
        try:
            for batch in batches:
                for part in by_size(batch, "text", SLICE):
                    # compressed here, as they are stored and shuffled before they are coded
                    ids = [pack(i + last) for i in tokens.batch(part.column("text"))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        finally:  # workers go on with other work
            tokens.forget()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(released(run), "doc_id long, ids binary")


def _counted(width):
    def run(batches):
        total, unpack = np.zeros(0, np.int64), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = np.frombuffer(b"".join([unpack(v.as_buffer()) for v in batch.column(0)]), width)
            more = np.bincount(ids, minlength=len(total))
            more[: len(total)] += total
            total = more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "count"])

    return run


def _blocks(shared, width):
    """Blocks of the rows of a partition, which are in order."""

    def close(table, part, seq, first, held):
        ids = np.frombuffer(b"".join(i for _, i in held), width)
        lengths = [len(i) // np.dtype(width).itemsize for _, i in held]
        row = [part, seq, first, [d for d, _ in held], lengths, table.encode(ids)]
        types_ = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        names = ["part", "seq", "first", "doc_ids", "lengths", "payload"]
        return len(ids), pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types_, strict=True)], names)

    def run(batches):
        table, seq, first, held, size, part = None, 0, 0, [], 0, 0
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            table = table or Table(shared.value)
            for part, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                ids = unpack(packed)
                held.append((doc, ids))
                size += len(ids) // np.dtype(width).itemsize
                if size >= BLOCK:
                    n, row = close(table, part, seq, first, held)
                    yield row
                    seq, first, held, size = seq + 1, first + n, [], 0
        if held:
            yield close(table, part, seq, first, held)[1]

    return run


def write_tokens(docs: DataFrame, folder: str, path: str, end: int = 2) -> None:
    """Write the ids of ``docs(doc_id, text)`` to ``folder`` in ascending doc_id order (null ids first).

    Texts are tokenised where they are, then only their ids travel: one range shuffle by doc_id,
    which also parts the rows of one id.
    Counts cover all ids; as many rows as the vocabulary has come to the driver.  Repeated rows are
    written as often as they occur, rows of one doc_id next to each other.
    """
    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(path).get_vocab_size(), end + 1)
    width = np.uint16 if vocabulary <= 1 << 16 else np.uint32
    rows = new_folder(spark, "ids")
    tokenised(docs, path, end).write.option("compression", "none").parquet(rows)
    ids = spark.read.schema("doc_id long, ids binary").parquet(rows)
    counted = ids.select("ids").mapInArrow(released(_counted(width)), "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))
    counted.write.parquet(f"{folder}/table")
    counts = np.zeros(vocabulary, np.int64)
    for row in spark.read.parquet(f"{folder}/table").collect():
        counts[row["id"]] = row["count"]
    shared = spark.sparkContext.broadcast(scaled(counts))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one doc_id, or without any, may be too many for one task: they are dealt by a number of their own
    told = ids.withColumn("row", F.monotonically_increasing_id())
    ordered = told.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    schema = "part int, seq int, first long, doc_ids array<long>, lengths array<long>, payload binary"
    ordered.mapInArrow(released(_blocks(shared, width)), schema).write.option("compression", "none").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks").select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    blocks.groupBy("part").agg(F.sum("n").alias("tokens")).write.parquet(f"{folder}/parts")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids): every document of a file set, decoded block by block on the executors.

    start is the number of ids before it; ids are little-endian unsigned 32-bit integers.
    """
    found = spark.read.schema("id long, count long").parquet(f"{folder}/table").collect()
    counts = np.zeros(max([r["id"] for r in found], default=0) + 1, np.int64)
    for row in found:
        counts[row["id"]] = row["count"]
    shared = spark.sparkContext.broadcast(scaled(counts))

    def run(batches):
        table = None
        for batch in batches:
            table = table or Table(shared.value)
            for row in range(batch.num_rows):
                ids = table.decode(batch.column("payload")[row].as_buffer().to_pybytes()).astype("<u4")
                lengths = np.asarray(batch.column("lengths")[row].values)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                body = ids.tobytes()
                out = [body[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                start = starts + batch.column("first")[row].as_py() + batch.column("before")[row].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[row].values, pa.array(start), pa.array(out, pa.binary())], ["doc_id", "start", "ids"])

    schema = "part int, seq int, first long, doc_ids array<long>, lengths array<long>, payload binary"
    # one row per file: a running sum over as many rows as there are files
    parts = spark.read.schema("part int, tokens long").parquet(f"{folder}/parts")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = handover(parts.select("part", before.alias("before")), "parts")
    blocks = spark.read.schema(schema).parquet(f"{folder}/blocks").join(F.broadcast(parts), "part")
    return blocks.select("doc_ids", "lengths", "first", "before", "payload").mapInArrow(released(run), "doc_id long, start long, ids binary")


def token_report(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document of a file set."""
    ids = read_tokens(spark, folder)
    return ids.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def token_files(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """Write ``docs`` to a new file set in the shared folder, read it back and report per document.

    Null and empty texts have the end id only; an empty table gives an empty report.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    write_tokens(docs, folder, path, end)
    return token_report(docs.sparkSession, folder)
