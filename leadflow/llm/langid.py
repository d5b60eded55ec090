"""Language identification by a bidirectional gated recurrent network over bytes, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import LOWER, released, translated

#: Units of each direction; bytes the network reads from a zero state; windows run side by side.
HIDDEN, WINDOW, LANES = 8, 128, 1024
#: Documents a language gives to the training sample (about), and windows of each document.
SAMPLE, PIECES = 400, 4
STEPS, BATCH, RATE = 500, 192, 0.02


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Network:
    """Forward and backward gated units over bytes, and a softmax over languages at every position.

    ``inputs[d]`` has a column per byte: what the byte adds to the reset, update and candidate
    gates of direction d.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        draw, h = np.random.default_rng(seed), HIDDEN
        self.languages = languages
        self.p = {}
        for d in "fb":
            self.p[f"in_{d}"] = (draw.normal(size=(3 * h, 256)) * 0.3).astype(np.float32)
            self.p[f"re_{d}"] = (draw.normal(size=(3 * h, h)) / np.sqrt(h)).astype(np.float32)
        self.p["out"] = (draw.normal(size=(len(languages), 2 * h)) * 0.3).astype(np.float32)
        self.p["bias"] = np.zeros((len(languages), 1), np.float32)

    def _run(self, d: str, symbols: np.ndarray, active: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each position, (position, unit, window); windows are sorted by falling length."""
        steps, lanes, h = len(symbols), symbols.shape[1], HIDDEN
        into, again = self.p[f"in_{d}"], self.p[f"re_{d}"]
        states = np.zeros((steps, h, lanes), np.float32)
        state = np.zeros((h, lanes), np.float32)
        for k in range(steps) if d == "f" else range(steps - 1, -1, -1):
            n = active[k]
            before = state[:, :n]
            x, g = np.take(into, symbols[k, :n], axis=1), again @ before
            gates = x[: 2 * h]
            gates += g[: 2 * h]
            _sigmoid(gates)
            new = g[2 * h :]
            inner = new.copy() if keep is not None else None
            new *= gates[:h]
            new += x[2 * h :]
            np.tanh(new, out=new)
            after = states[k, :, :n]
            np.subtract(before, new, out=after)
            after *= gates[h:]
            after += new
            if keep is not None:
                keep.append((k, before.copy(), gates.copy(), new.copy(), inner))
            state = states[k] if n == lanes else np.concatenate([after, state[:, n:]], axis=1)
        return states

    def logits(self, symbols: np.ndarray, active: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        states = np.concatenate([self._run(d, symbols, active, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=1)
        return states, np.matmul(self.p["out"], states) + self.p["bias"]

    def train(self, windows: list[bytes], labels: np.ndarray, seed: int = 11) -> None:
        """Cross-entropy at every position, by backpropagation through time and Adam; languages weigh alike."""
        draw = np.random.default_rng(seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(STEPS):
            of = draw.integers(0, len(by_label), BATCH)
            pick = np.array([by_label[k][draw.integers(0, len(by_label[k]))] for k in of])
            symbols, active, order = _matrix([windows[k] for k in pick])
            grads = self._gradients(symbols, active, labels[pick][order])
            rate = RATE * (1 - step / STEPS) + 1e-4
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.p[k] -= rate * (first[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-6)

    def _gradients(self, symbols: np.ndarray, active: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        h, steps, lanes = HIDDEN, *symbols.shape
        keep: dict = {}
        states, logits = self.logits(symbols, active, keep)
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        prob[:, labels, np.arange(lanes)] -= 1
        prob *= (np.arange(lanes)[None, :] < active[:, None])[:, None, :] / active.sum()
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"] = np.einsum("tkn,thn->kh", prob, states, optimize=True)
        grads["bias"] = prob.sum(axis=(0, 2))[:, None]
        back = np.matmul(self.p["out"].T, prob)
        for d, at in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            again, carry = self.p[f"re_{d}"], np.zeros((h, lanes), np.float32)
            into, times = grads[f"in_{d}"], grads[f"re_{d}"]
            for k, before, gates, new, inner in reversed(keep[d]):
                n = before.shape[1]
                g = carry[:, :n] + back[k, at, :n]
                reset, update = gates[:h], gates[h:]
                d_new = g * (1 - update) * (1 - new * new)
                d_update = g * (before - new) * update * (1 - update)
                d_reset = d_new * inner * reset * (1 - reset)
                inner_grad = np.concatenate([d_reset, d_update, d_new * reset])
                times += inner_grad @ before.T
                np.add.at(into.T, symbols[k, :n], np.concatenate([d_reset, d_update, d_new]).T)
                carry[:, :n] = g * update + again.T @ inner_grad
        return grads

    def pooled(self, windows: list[bytes]) -> np.ndarray:
        """Sum over a window's positions of the probabilities of each language, (window, language)."""
        out = np.zeros((len(windows), len(self.languages)))
        longest = np.argsort([-len(w) for w in windows], kind="stable")
        for at in range(0, len(windows), LANES):
            own = longest[at : at + LANES]
            symbols, active, order = _matrix([windows[k] for k in own])
            _, prob = self.logits(symbols, active)
            prob -= prob.max(axis=1, keepdims=True)
            np.exp(prob, out=prob)
            prob /= prob.sum(axis=1, keepdims=True)
            if active[-1] < len(own):
                prob *= (np.arange(len(own))[None, :] < active[:, None])[:, None, :]
            out[own[order]] = prob.sum(axis=0).T
        return out


def _matrix(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as columns of bytes, longest first; windows that reach each position; their order."""
    sizes = np.array([len(w) for w in windows])
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max())
    body = b"".join([windows[k].ljust(steps, b"\0") for k in order.tolist()])
    symbols = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(len(windows), steps).T)
    return symbols, (sizes[:, None] > np.arange(steps)[None, :]).sum(axis=0), order


def train(labelled: DataFrame) -> Network | None:
    """A network from ``labelled(text, lang)``: every non-null lang value of texts with a letter is learned.

    The sample is bounded: about ``SAMPLE`` documents a language, chosen by a hash of all columns, so that
    copies of a text with other ids are chosen one by one, and ``PIECES`` windows of each, drawn over its
    whole length.  Null and empty texts, and texts without a letter, teach
    nothing; repeated rows count once.  None if there is nothing to learn from.
    """
    labelled = labelled.withColumn("_draw", F.xxhash64(*labelled.columns))
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "_draw", F.col("lang").cast("string").alias("lang"))
    sizes = known.groupBy("lang").count().collect()  # one row a language
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, SAMPLE / r["count"])))])
    chance = F.pmod("_draw", F.lit(1_000_000)) / 1e6
    # every place at which a whole window fits
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    pieces = F.array(*[F.substring("text", F.pmod(F.xxhash64("_draw", F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)) for k in range(PIECES)])
    rows = known.where(chance < share[F.col("lang")]).select("_draw", "lang", pieces.alias("pieces")).dropDuplicates(["_draw"]).collect()
    windows, labels = [], []
    for lang, found in sorted((r["lang"], p) for r in rows for p in set(r["pieces"])):
        if found.strip():
            windows.append(found.encode().translate(LOWER)[:WINDOW])
            labels.append(languages.index(lang))
    network = Network([x for k, x in enumerate(languages) if k in set(labels)])
    network.train(windows, np.unique(labels, return_inverse=True)[1])
    return network


def _predict(shared):
    def run(batches):
        network = Network.__new__(Network)
        network.__dict__ = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column("text")
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                clean = translated(texts.cast(pa.binary()), LOWER)
                windows, row = [], []
                for k, text in enumerate(clean):
                    body = text.as_buffer()
                    for start in range(0, len(body) if letters[k] else 0, WINDOW):
                        windows.append(body[start : start + WINDOW].to_pybytes())
                        row.append(k)
                total = np.zeros((batch.num_rows, len(network.languages)))
                if windows:
                    np.add.at(total, np.array(row), network.pooled(windows))
                mean = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)
                best = mean.argmax(axis=1)
                lang = [network.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, np.minimum(mean.max(axis=1), 1.0), 0.0)
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(lang), pa.array(score)], [*rest, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, lang_pred, score) for every row: the language with the largest mean probability over all bytes of the text.

    The network reads the whole text in windows of ``WINDOW`` bytes.  Null and empty texts, and
    texts without a letter, are ``und`` with score 0, as is everything without a network.
    """
    if network is None:
        return docs.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(vars(network))  # plain values only
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(released(_predict(shared)), f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double")
    return found.withColumnRenamed("key", key)


def keep_recognised(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """``docs`` whose language is recognised with at least ``least``; all columns as they were."""
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("_doc"), "text")
    kept = predict(keyed, network, "_doc").where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.select(*[F.col("_doc")[n].alias(n) for n in names])
