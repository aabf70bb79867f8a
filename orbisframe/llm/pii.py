"""Personal data by weak supervision.

Strict patterns give the base spans, which are always reported. Looser patterns propose more (obfuscated addresses, IPv6,
short cards, national phone numbers, and cards and phones whose strict match ran on into the next number and failed). On every candidate five labelers vote for, against, or abstain: the strict pattern,
the shape, a gazetteer, the words around, and the characters at the edges. Expectation-maximisation (Dawid-Skene with two
classes) estimates from the vote counts of the whole table how often each labeler gives each vote under either class.
Its posteriors are the soft labels of a logistic span classifier over the votes, the kind and the length; a proposed
span is added when the classifier gives it at least ``THRESHOLD``.

Both fits see counts of (kind, votes, length class) over all texts. There are at most 4 * 3^5 * 4 such rows, whatever the
size of the table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
ROUNDS = 50
LABELERS = ("strict", "shape", "gazetteer", "context", "edges")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[(\[ ]at[)\] ]|[A-Fa-f]:[A-Fa-f]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[(\[]at[)\]]|(?<= )at(?= )) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]|(?<= )dot(?= )) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:(?:\+|00)[1-9][0-9]{0,2}[ -]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
}
#: Common endings of domains, first digits of card issuers, words that go with a kind, words that speak against it.
_TLDS = frozenset("com org net edu gov io co uk de fr es it nl eu ch at be info biz us ca au jp cn in br ru pl se no fi dk".split())
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "22", "23", "24", "25", "26", "27", "35", "36", "38", "30")
_NEAR = {
    "email": ("mail", "contact", "write to", "correo", "courriel", "reach"),
    "ip": ("ip", "address", "host", "server", "client", "adresse", "ping"),
    "card": ("card", "visa", "mastercard", "amex", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "anruf", "appel", "llam"),
}
_AGAINST = ("version", "isbn", "issn", "doi", "figure", "section", "chapter", "order", "serial", "invoice", "tracking")
_BEFORE, _AFTER = 40, 12


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the strict patterns; leftmost, non-overlapping for each kind, linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates that touch no base span; for each kind leftmost, non-overlapping."""
    out, starts, ends = [], [], []
    for s, e in sorted((s, e) for _, s, e in base):  # overlapping ones as one
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for k, kind in enumerate(KINDS):
        for m in _LOOSE[kind].finditer(text):
            if kind == "card" and not luhn(_digits(m[0])):
                continue
            near = bisect_right(ends, m.start())  # the first that ends beyond the candidate's start
            if near == len(ends) or starts[near] >= m.end():
                out.append((k, *m.span()))
    return out


def _votes(text: str, k: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """The labelers' votes on a candidate: 1, 0 (abstains) or -1, in the order of LABELERS."""
    span, kind = text[start:end], KINDS[k]
    shape = 0
    if kind == "email":
        shape = 1 if strict or "(" in span or "[" in span else -1
        ending = re.split(r"[^a-z]+", span.lower())[-1]
        gazetteer = 1 if ending in _TLDS else -1
    elif kind == "ip":
        shape = 1 if ":" in span or span.count(".") == 3 else -1
        gazetteer = -1 if re.match(r"(?:0+|127|255)\.", span) else 1
    elif kind == "card":
        d = _digits(span)
        shape = 1 if len(d) == 16 or d[:2] in ("34", "37") and len(d) == 15 else -1 if len(set(d)) < 4 else 0
        gazetteer = 1 if d.startswith(_ISSUERS) else -1
    else:
        shape = 1 if "(" in span or span.startswith(("+", "00")) else 0
        gazetteer = 1 if "555" in span or span.startswith(("+", "00")) else 0
    around = (text[max(0, start - _BEFORE) : start] + " " + text[end : end + _AFTER]).lower()
    context = -1 if any(w in around for w in _AGAINST) else int(any(w in around for w in _NEAR[kind]))
    before, after = text[start - 1 : start], text[end : end + 1]
    edges = -1 if before.isalnum() or after.isalnum() else 1
    return int(strict), shape, gazetteer, context, edges


def _length_class(n: int) -> int:
    return (n > 12) + (n > 16) + (n > 24)


def candidates(text: str | None) -> list[tuple]:
    """(kind, start, end, strict, votes, length class) of the base spans and the proposed ones."""
    if not text or not _HINT.search(text):
        return []
    base = base_spans(text)
    both = [(*s, True) for s in base] + [(*s, False) for s in _loose_spans(text, base)]
    return [(k, s, e, strict, _votes(text, k, s, e, strict), _length_class(e - s)) for k, s, e, strict in both]


@dataclass
class Labeling:
    """reliability[kind, labeler, class, vote + 1]; prior[kind]; weights of the classifier."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def accepts(self, kind: int, votes: tuple[int, ...], length: int) -> bool:
        return self.probability(kind, votes, length) >= THRESHOLD

    def probability(self, kind: int, votes: tuple[int, ...], length: int) -> float:
        return float(1 / (1 + np.exp(-_features(np.array([[kind, *votes, length]]))[0] @ self.weights)))


def _features(rows: np.ndarray) -> np.ndarray:
    """One-hot kind and length, and the votes without the strict pattern's, which proposed spans lack."""
    kinds = np.eye(len(KINDS))[rows[:, 0]]
    return np.hstack([kinds, rows[:, 2:-1], np.eye(4)[rows[:, -1]]])


def estimate(rows: np.ndarray, counts: np.ndarray) -> Labeling:
    """EM over the counted vote patterns, then the classifier; rows: (kind, votes..., length class)."""
    n = len(LABELERS)
    # what one believes before any vote: a labeler votes right three times as often as wrong; its weight is ten spans
    belief = np.array([[5.0, 3.0, 2.0], [1.0, 3.0, 6.0]])
    reliability = np.tile(belief / belief.sum(axis=1, keepdims=True), (len(KINDS), n, 1, 1))
    prior = np.full(len(KINDS), 0.5)
    if not len(rows):
        return Labeling(reliability, prior, np.zeros(len(KINDS) + n - 1 + 4))
    kind, votes = rows[:, 0], rows[:, 1:-1] + 1
    for _ in range(ROUNDS):
        logs = np.log(reliability)[kind[:, None], np.arange(n)[None, :], :, votes].sum(axis=1)
        odds = logs[:, 1] - logs[:, 0] + np.log(prior[kind] / (1 - prior[kind]))
        sure = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for k in range(len(KINDS)):
            mine = kind == k
            w = np.stack([(1 - sure[mine]) * counts[mine], sure[mine] * counts[mine]], axis=1)
            prior[k] = (w[:, 1].sum() + 5) / (w.sum() + 10)
            for j in range(n):
                got = np.stack([np.bincount(votes[mine, j], weights=w[:, c], minlength=3) for c in (0, 1)]) + belief
                reliability[k, j] = got / got.sum(axis=1, keepdims=True)
    x, beta = _features(rows), np.zeros(len(KINDS) + n - 1 + 4)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (counts * (sure - p)) - beta
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + np.eye(len(beta))
        beta += np.clip(np.linalg.solve(curve, slope), -2, 2)
    return Labeling(reliability, prior, beta)


def learn(docs: DataFrame, text_col: str = "text") -> Labeling:
    """Labeling from the votes on all candidates of all texts."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        found: Counter = Counter()
        for b in small(batches):
            for t in b.column(0).to_pylist():
                found.update((k, *votes, length) for k, _, _, _, votes, length in candidates(t))
        if found:
            cols = [*zip(*found, strict=True), found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.int64()) for c in cols], names=names)

    names = ["kind", *LABELERS, "length", "n"]
    votes = docs.select(F.col(text_col)).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    got = votes.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).collect()  # at most 4 * 3^5 * 4 rows
    table = np.array(sorted(tuple(r) for r in got), dtype=np.int64).reshape(-1, len(names))
    return estimate(table[:, :-1], table[:, -1].astype(float))


def find(text: str | None, labeling: Labeling) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, by kind, then start."""
    base, every = [], []
    for k, s, e, strict, votes, length in candidates(text):
        if strict:
            base.append((k, s, e))
        if strict or labeling.accepts(k, votes, length):
            every.append((k, s, e))
    return sorted(base), sorted(every)


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each span replaced by its kind in capitals between angle brackets; overlapping spans become one mask."""
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in sorted((s, -e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, -e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, labeling: Labeling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs.

    The four counts and base_sha256 are of the base spans; spans holds all. Offsets are code points, end exclusive. Null
    and empty texts have no spans (the hash of the empty text, and an empty string); texts of any length are read whole. Spans of
    different kinds may overlap and all are listed; ties in start go to the kind listed first. Repeated rows and null ids each give a
    row, an empty table none; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            found = [find(t, labeling) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], type=pa.int64()) for k in range(len(KINDS))]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], type=pa.string())
            spans = pa.array([joined(every) for _, every in found], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digests, spans], names=names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, labeling: Labeling, text_col: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with all spans masked in text and n_chars (where there is one) counted anew; no row goes.

    Null texts stay null, empty ones empty; repeated rows are masked alike, long texts whole. An empty table gives no rows.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            texts = [masked(t, find(t, labeling)[1]) for t in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(texts, type=b.column(place).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(n_chars, F.length(text_col).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
