"""Static range asymmetric numeral coding of token ids in interleaved blocks, with numpy.

A block: header, checkpoints, words.  All numbers are little-endian.

    magic "TRB1" | u32 crc32 of all that follows | u32 tokens | u16 lanes | u16 steps between checkpoints
    u32 words | u32 crc32 of the ids as u32 | checkpoints, each u32 word offset and one u64 state a lane | words, u32 each

Token k belongs to lane k mod lanes and step k // lanes.  Checkpoint c holds every lane's state and
the word offset before step c * every, so any stretch of steps decodes on its own.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TRB1"
HEAD = "<4sIIHHII"
LANES, EVERY = 1024, 128
#: Bits of the frequency scale; the lower bound of a state; bits moved at once.
SCALE, LOW, MOVE = 20, np.uint64(1 << 31), np.uint64(32)
MASK = np.uint64((1 << SCALE) - 1)
WORD = np.uint64(0xFFFFFFFF)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^SCALE, at least 1 for every id that occurs."""
    if np.count_nonzero(counts) > 1 << SCALE:
        raise ValueError(f"more than 2^{SCALE} distinct ids")
    total = counts.sum()
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) / total * (1 << SCALE)), 0).astype(np.int64)
    rest = (1 << SCALE) - freq.sum()
    order = np.argsort(-freq, kind="stable")
    if rest > 0:
        freq[order[0]] += rest
    for k in order:  # taken back from the most frequent ids
        if rest >= 0:
            break
        take = min(-rest, freq[k] - 1 if k != order[0] else freq[k] // 2)
        freq[k] -= take
        rest += take
    while rest < 0:
        k = int(np.argmax(freq))
        take = min(-rest, freq[k] - 1)
        freq[k] -= take
        rest += take
    return freq


class Table:
    """Shared frequencies, with what encoding and decoding look up."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(63 - SCALE)  # a state from here on moves a word out first

    def encode(self, ids: np.ndarray) -> bytes:
        lanes, n = LANES, len(ids)
        steps = -(-n // lanes)
        state, out = np.full(lanes, LOW, np.uint64), []
        marks, written = {}, 0
        for step in range(steps - 1, -1, -1):
            own = ids[step * lanes : (step + 1) * lanes]
            x, f = state[: len(own)], self.freq[own]
            full = np.flatnonzero(x >= self.limit[own])
            if len(full):
                out.append((x[full] & WORD).astype(np.uint32))
                written += len(full)
                x[full] >>= MOVE
            whole = x // f
            x[:] = (whole << np.uint64(SCALE)) + (x - whole * f) + self.start[own]
            if step % EVERY == 0:
                marks[step // EVERY] = written, state.copy()
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        points = b"".join(struct.pack("<I", written - marks[c][0]) + marks[c][1].astype("<u8").tobytes() for c in sorted(marks))
        body = struct.pack("<IHHII", n, lanes, EVERY, len(words), zlib.crc32(ids.astype("<u4"))) + points + words.astype("<u4").tobytes()
        return MAGIC + struct.pack("<I", zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of checkpoints ``first`` up to ``last`` (excluded; all by default) of a block."""
        magic, crc, n, lanes, every, count, ids_crc = struct.unpack_from(HEAD, block)
        if magic != MAGIC or zlib.crc32(memoryview(block)[8:]) != crc:
            raise ValueError("not a token block, or a damaged one")
        steps = -(-n // lanes)
        points = -(-steps // every)
        at, size = struct.calcsize(HEAD), 4 + 8 * lanes
        words = np.frombuffer(block, "<u4", count, at + points * size).astype(np.uint64)
        out = np.empty(n, np.uint32)
        last = points if last is None else min(last, points)
        for point in range(first, last):
            offset = struct.unpack_from("<I", block, at + point * size)[0]
            state = np.frombuffer(block, "<u8", lanes, at + point * size + 4).astype(np.uint64)
            for step in range(point * every, min(steps, (point + 1) * every)):
                own = out[step * lanes : (step + 1) * lanes]
                x = state[: len(own)]
                slot = x & MASK
                own[:] = self.symbol[slot]
                x[:] = self.freq[own] * (x >> np.uint64(SCALE)) + slot - self.start[own]
                need = np.flatnonzero(x < LOW)
                if len(need):
                    x[need] = (x[need] << MOVE) | words[offset : offset + len(need)]
                    offset += len(need)
        part = out[first * every * lanes : last * every * lanes]
        if first == 0 and last == points and zlib.crc32(part.astype("<u4")) != ids_crc:
            raise ValueError("a token block decodes to other ids than were written")
        return part
