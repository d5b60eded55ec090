"""Fill-in-middle documents: texts cut after whole lines into prefix, middle and suffix, and put in another order.

Each text is laid out in blocks of fixed size.  Fenwick trees over the blocks hold how many lines end
in them and how many code points they have; a cut after k lines is found by descending the first
tree by powers of two to the block of the k-th line end and looking for it inside that block only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import by_size

#: Bytes of a text per block.
BLOCK = 1024
#: Bytes of texts that are cut together; a longer text is taken by itself.
SLICE = 4 << 20
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


class Fenwick:
    """Counts of blocks with prefix sums and their inverse, many look-ups at a time."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.tree = np.concatenate([[0], counts]).astype(np.int64)
        step = 1
        while 2 * step <= self.size:
            at = np.arange(2 * step, self.size + 1, 2 * step)
            self.tree[at] += self.tree[at - step]
            step *= 2
        self.top = step

    def before(self, blocks: np.ndarray) -> np.ndarray:
        """Sum over the first ``blocks`` blocks."""
        at, total = np.array(blocks, np.int64), np.zeros(len(blocks), np.int64)
        while at.any():
            total += self.tree[at]
            at &= at - 1
        return total

    def descend(self, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block that holds the ``nth`` counted thing (from 1), and the how-manieth it is in there."""
        at, left, step = np.zeros(len(nth), np.int64), np.array(nth, np.int64), self.top
        while step:
            to = at + step
            held = self.tree[np.minimum(to, self.size)]
            on = (to <= self.size) & (held < left)
            at, left = np.where(on, to, at), left - np.where(on, held, 0)
            step //= 2
        return at, left


class Blocks:
    """Texts laid end to end, each starting a block; ``bounds`` are their places in ``body``."""

    def __init__(self, body: np.ndarray, bounds: np.ndarray):
        self.body, self.start, self.end = body, bounds[:-1], bounds[1:]
        own = -(-(self.end - self.start) // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(own)])
        text = np.repeat(np.arange(len(own)), own)
        self.at = self.start[text] + (np.arange(len(text)) - self.first[text]) * BLOCK
        self.to = np.minimum(self.at + BLOCK, self.end[text])
        if len(text):
            lines = np.add.reduceat(body == 10, self.at, dtype=np.int64)
            points = np.add.reduceat((body & 0xC0) != 0x80, self.at, dtype=np.int64)
        else:
            lines = points = np.zeros(0, np.int64)
        self.lines, self.points = Fenwick(lines), Fenwick(points)
        self.lines_before = self.lines.before(self.first)
        self.points_before = self.points.before(self.first)
        self.ended = np.diff(self.lines_before)
        open_end = np.zeros(len(own), bool)
        full = self.end > self.start
        open_end[full] = body[self.end[full] - 1] != 10
        #: lines of each text, the last one with or without a line end
        self.units = self.ended + open_end

    def cut(self, text: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place right after the first ``units`` lines of each ``text``, and the code points before it in the text."""
        place = np.where(units == 0, self.start[text], self.end[text])
        points = np.where(units == 0, 0, self.points_before[text + 1] - self.points_before[text])
        inside = np.flatnonzero((units > 0) & (units <= self.ended[text]))
        block, nth = self.lines.descend(self.lines_before[text[inside]] + units[inside])
        upto = self.points.before(block) - self.points_before[text[inside]]
        for k, b, n, before in zip(inside, block, nth, upto, strict=True):
            own = self.body[self.at[b] : self.to[b]]
            here = int(np.flatnonzero(own == 10)[n - 1]) + 1
            place[k] = self.at[b] + here
            points[k] = before + np.count_nonzero((own[:here] & 0xC0) != 0x80)
        return place, points


def _laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def _rearranged(rate: int, spm: int, marks: tuple[str, str, str]):
    p_mark, s_mark, m_mark = (m.encode() for m in marks)

    def rearrange(batches):
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                body, bounds = _laid_out(batch.column("text"))
                blocks = Blocks(body, bounds)
                h = [batch.column(f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
                text = np.arange(batch.num_rows)
                low, high = np.sort([h[0] % (blocks.units + 1), h[1] % (blocks.units + 1)], axis=0)
                (one, one_points), (two, two_points) = blocks.cut(text, low), blocks.cut(text, high)
                raw = body.tobytes()
                forms, prefixes, middles, outputs = [], [], [], []
                for k in range(batch.num_rows):
                    a, b, c, d = bounds[k], one[k], two[k], bounds[k + 1]
                    own = raw[a:d]
                    if not own or any(m in own for m in (p_mark, s_mark, m_mark)) or h[2][k] % 100 >= rate:
                        forms.append("plain")
                        prefixes.append(None)
                        middles.append(None)
                        outputs.append(own)
                        continue
                    prefix, middle, suffix = raw[a:b], raw[b:c], raw[c:d]
                    prefixes.append(int(one_points[k]))
                    middles.append(int(two_points[k] - one_points[k]))
                    if h[3][k] % 100 < spm:
                        forms.append("spm")
                        outputs.append(b"".join((s_mark, suffix, p_mark, prefix, m_mark, middle)))
                    else:
                        forms.append("psm")
                        outputs.append(b"".join((p_mark, prefix, s_mark, suffix, m_mark, middle)))
                columns = [
                    batch.column("doc_id"), pa.array(blocks.units, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                    pa.array(middles, pa.int64()), pa.array(outputs, pa.binary()).view(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rearrange


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of ``docs``.

    A text (null: empty) has ``n`` lines, each with its line end.  Two numbers drawn from the SHA-256
    of ``seed`` and doc_id say after how many lines prefix and middle end; a third rearranges
    ``rate`` percent of the texts, a fourth puts the suffix first in ``spm`` percent of those.
    ``output`` is the rearranged text (form ``psm`` or ``spm``) or, ``plain``, the text itself: if
    it is empty, holds one of the ``marks``, or is not drawn.  Sizes are in code points, null for
    plain.  Cuts depend on doc_id and text alone, so repeated rows come out alike; a null doc_id
    draws as an empty one.  Texts of any length are cut whole, a long one by itself; memory is
    about twice the text beside the text.  Other columns are ignored; no rows, no rows.

    Marks must begin with one character that they hold nowhere else, so that ``restored`` can find
    them next to any text.
    """
    if len(set(marks)) != 3 or any(not m or m[0] != marks[0][:1] or m[0] in m[1:] for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError("marks must differ, begin with one character and not hold it again")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *drawn)
    return texts.mapInArrow(
        _rearranged(rate, spm, marks), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of, from the output and its form alone."""

    def pieces(first: str, second: str, third: str) -> list[Column]:
        two = F.call_function("locate", F.lit(second), output)
        three = F.call_function("locate", F.lit(third), output, two)
        rest = F.length(output)
        return [
            F.substring(output, F.lit(len(first) + 1), two - len(first) - 1),
            F.substring(output, two + len(second), three - two - len(second)),
            F.substring(output, three + len(third), rest),
        ]

    p, s, m = marks
    prefix, suffix, middle = pieces(p, s, m)
    late, early, centre = pieces(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, centre, late)).otherwise(output)
