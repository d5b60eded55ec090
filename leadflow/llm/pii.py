"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Base patterns, in the order of KINDS; fixed values.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What else may be personal data: numbers in groups, and addresses whose at-sign is spelt out.
NUMBERS = r"(?<![A-Za-z0-9])\(?[0-9][0-9 ().-]{5,}[0-9](?![A-Za-z0-9])"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_SPELT_AT = re.compile(r" ?[\[({](?:at|AT)[\])}]")
_SPELT_HOST = re.compile(r" ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]+)+")
#: As BASE, but begun at the first digit only: no later start in a row of digits can match.
_IP = re.compile(r"(?<![0-9])" + BASE["ip"])
#: Gazetteers: ends of host names, dialling codes, first digits of card issuers.
HOST_ENDS = frozenset("com org net edu gov info io de fr es it uk eu at ch nl be pt br mx ca us au in jp cn ru pl se".split())
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91", "351", "353", "358")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
#: Words before a span that hint at its kind.
CUES = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "node"),
    "card": ("card", "visa", "mastercard", "credit", "pan"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
    "none": ("version", "isbn", "page", "pages", "id", "no", "nr", "order", "item", "chapter"),
}
LABELERS = ("address_form", "dotted_form", "check_digit", "plus_form", "grouped_form", "gazetteer", "context", "length")
CLASSES = ("none", *KINDS)
#: How likely a span must be personal data to be added to the base ones.
SURE = 0.8


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _holds(kind: str, span: str) -> bool:
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "ip":
        parts = [p.lstrip("0") for p in span.split(".")]  # any number of zeros may lead
        return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def _before(text: str, at: int, least: int) -> int:
    """Where the run of address characters that ends at ``at`` begins, not before ``least``."""
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def _emails(text: str):
    """The leftmost matches of the base pattern, from each at-sign outwards: no run is searched twice, however long."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start, host = _before(text, at, end), _HOST.match(text, at)
        if host and start < at:
            end = host.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _spelt(text: str):
    end = 0
    for m in _SPELT_AT.finditer(text):
        start, host = _before(text, m.start(), end), _SPELT_HOST.match(text, m.end())
        if host and start < m.start():
            end = host.end()
            yield start, end


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, mark in (("ip", _IP, "."), ("card", re.compile(BASE["card"]), ""), ("phone", re.compile(BASE["phone"]), "+")):
        if mark in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _holds(kind, m.group())]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans that may be personal data and overlap no base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], [*accumulate((b for _, b in taken), max)]
    out = []
    for a, b in sorted([*_spelt(text), *((m.start(), m.end()) for m in re.finditer(NUMBERS, text))]):
        k = bisect_left(starts, b)
        if (k == 0 or ends[k - 1] <= a) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


def votes(text: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's class for a span, -1 where it has no opinion; labelers in the order of LABELERS."""
    span, before = text[start:end], text[max(0, start - 30) : start].lower()
    digits = re.sub(r"[^0-9]", "", span)
    of = CLASSES.index
    spelt = re.sub(r" ?[\[({](?:at)[\])}] ?", "@", re.sub(r" ?[\[({](?:dot)[\])}] ?", ".", span, flags=re.I), flags=re.I)
    address = re.fullmatch(BASE["email"], spelt) is not None
    dotted = re.fullmatch(BASE["ip"], span) is not None
    out = [-1] * len(LABELERS)
    out[0] = of("email") if address else -1
    out[1] = (of("ip") if _holds("ip", span) else of("none")) if dotted else -1
    if 13 <= len(digits) <= 19 and not address:
        out[2] = of("card") if luhn(digits) else of("none")
    if span.startswith("+") or text[max(0, start - 1) : start] == "+":
        out[3] = of("phone") if 8 <= len(digits) <= 15 else of("none")
    if re.fullmatch(r"(\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?([ .-][0-9]{2,4}){2,3}", span) and not dotted and 8 <= len(digits) <= 13:
        out[4] = of("phone")
    if address:
        out[5] = of("email") if spelt.rsplit(".", 1)[-1].lower() in HOST_ENDS else of("none")
    elif span.startswith("+"):
        out[5] = of("phone") if digits.startswith(DIALLING) else of("none")
    elif len(digits) in (13, 14, 15, 16, 19) and not dotted:
        out[5] = of("card") if digits.startswith(ISSUERS) else of("none")
    words = re.findall(r"[a-z-]+", before)[-3:]
    for kind, cues in CUES.items():
        if any(w in cues for w in words):
            out[6] = of(kind)
    if not address and (len(digits) < 8 or len(digits) > 19):
        out[7] = out[7] if dotted else of("none")
    return tuple(out)


def shape(text: str, start: int, end: int) -> tuple[int, ...]:
    """What the span classifier sees of a span: a few yes-or-no features, so that equal ones can be counted together."""
    span, before = text[start:end], text[max(0, start - 30) : start].lower()
    digits = sum(c.isdigit() for c in span)
    words = re.findall(r"[a-z-]+", before)[-3:]
    cue = [any(w in c for w in words) for c in CUES.values()]
    number = re.sub(r"[^0-9]", "", span)
    at = "@" in span or re.search(r"[\[({]at[\])}]", span, re.I) is not None
    return tuple(
        int(x)
        for x in (
            True, at, span.startswith("+"), "(" in span, span.count(".") == 3, span.count("-") > 1, " " in span, digits < 8, 8 <= digits <= 11,
            12 <= digits <= 15, 16 <= digits <= 19, digits > 19, not at and len(number) > 12 and luhn(number), digits * 2 < len(span), *cue,
        )
    )


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over distinct vote patterns (rows of class or -1) with their counts.

    Gives the share of each class, each labeler's chance of each vote under each class
    (labeler, class, vote + 1), and each pattern's class probabilities.  Starts from the votes' majority.
    """
    k, n = len(CLASSES), patterns.shape[1]
    belief = np.full((len(patterns), k), 0.05)
    for vote in range(k):
        belief[:, vote] += (patterns == vote).sum(axis=1)
    belief /= belief.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        weight = belief * counts[:, None]
        share = (weight.sum(axis=0) + 1) / (weight.sum() + k)
        table = np.full((n, k, k + 1), 0.02)
        for labeler in range(n):
            for vote in range(-1, k):
                table[labeler, :, vote + 1] += weight[patterns[:, labeler] == vote].sum(axis=0)
            # a labeler that speaks is taken to be right more often than by chance
            for c in range(k):
                table[labeler, c, c + 1] += 1.0
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(share)[None, :] + sum(np.log(table[j][:, patterns[:, j] + 1]).T for j in range(n))
        belief = np.exp(logs - logs.max(axis=1, keepdims=True))
        belief /= belief.sum(axis=1, keepdims=True)
    return share, table, belief


def fit_spans(shapes: np.ndarray, belief: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Softmax weights (feature, class) trained on the probabilities that EM gives the spans."""
    weights = np.zeros((shapes.shape[1], len(CLASSES)))
    total = max(counts.sum(), 1)
    for _ in range(rounds):
        odds = np.exp(shapes @ weights - (shapes @ weights).max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        weights -= 2.0 * (shapes.T @ ((odds - belief) * counts[:, None]) / total + 1e-4 * weights)
    return weights


_ANY = re.compile(r"[@0-9]|[\[({](?:at|AT)[\])}]").search


def _vote(batches):
    """Votes and shapes of all spans, base ones and candidates, counted per batch."""
    for batch in batches:
        seen: dict[tuple, int] = {}
        for text in batch.column("text").to_pylist():
            if not text or not _ANY(text):
                continue
            base = base_spans(text)
            for a, b in [*((a, b) for _, a, b in base), *candidates(text, base)]:
                key = votes(text, a, b), shape(text, a, b)
                seen[key] = seen.get(key, 0) + 1
        keys = list(seen)
        kind = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in keys], kind), pa.array([s for _, s in keys], kind), pa.array(list(seen.values()), pa.int64())], ["votes", "shape", "n"])


def train(docs: DataFrame) -> np.ndarray | None:
    """Span classifier learnt from all spans of ``docs(text)`` without any label; None if there are none.

    Spans are counted by their votes and shape on the executors.  Both are short lists of small
    numbers, so the driver gets as many rows as there are combinations, however many spans.
    """
    spans = docs.select("text").mapInArrow(_vote, "votes array<int>, shape array<int>, n long")
    rows = spans.groupBy("votes", "shape").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["votes"], r["shape"]))
    counts = np.array([r["n"] for r in rows], float)
    _, _, belief = reliabilities(np.array([r["votes"] for r in rows]), counts)
    return fit_spans(np.array([r["shape"] for r in rows], float), belief, counts)


def find(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """(doc_id, base, spans) per row: base spans, and these with what the classifier adds; structs (kind, start, end).

    Null and empty texts have none.  Positions are code points, ends exclusive; lists are by kind as
    in KINDS, then start.  Base spans always stay; an added span overlaps none and is likely
    personal data by ``SURE``.  Whole texts are searched; repeated rows are searched each.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = [[], []]
            for text in batch.column("text").to_pylist():
                base, more = [], []
                if text and _ANY(text):
                    base = base_spans(text)
                    for a, b in candidates(text, base) if weights is not None else []:
                        odds = np.array(shape(text, a, b), float) @ weights
                        odds = np.exp(odds - odds.max())
                        best = int(odds.argmax())
                        if best and odds[best] / odds.sum() >= SURE:
                            more.append((CLASSES[best], a, b))
                both = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                for k, spans in enumerate((base, both)):
                    out[k].append([{"kind": s[0], "start": s[1], "end": s[2]} for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], span), pa.array(out[1], span)], ["doc_id", "base", "spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``; counts are of base spans."""
    found = find(docs, train(docs))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _of(kind: str):
    return lambda s: s["kind"] == kind
