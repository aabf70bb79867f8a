"""Best-fit packing of token pieces by patterns and non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver, whatever the number of pieces. There:

1. Patterns of one to three lengths that fill a sequence exactly are enumerated over the lengths that occur.
2. Repeat counts x >= 0 that minimise |A x - histogram| are fitted by multiplicative updates.
3. The counts are rounded, largest first, as far as pieces remain.
4. Residual pieces are packed best-fit decreasing, many equal pieces at a time; this extends open patterns, too.

The result is a list of (pattern, repeats). Each length has a run of slots in it; a piece gets its slot from its rank among
the pieces of its length. Ranks are counted by (length, salt), with offsets from the counts of the salts before, so a
length that a third of the pieces share is spread over many tasks.
"""

from __future__ import annotations

import json
import re
import zlib
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import small
from .scratch import Scratch

CAPACITY = 2048
MAX_PATTERNS = 400_000
PER_SALT = 20_000
CACHE_WORDS = 700_000


#: How a vocabulary with word ends prepares a text. Only with these may words be encoded apart.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_apart(tokenizer: str) -> bool:
    """Whether a tokenizer (its JSON) never joins two words and marks the last token of each."""
    made = json.loads(tokenizer)
    model, before = made["model"], (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and (made.get("normalizer") or {}).get("normalizers") == _NORMAL and not made.get("truncation") and not made.get("padding")
        and before[0].get("pattern") == {"Regex": _CUT} and before[0].get("behavior") == "Removed" and before[0].get("invert") is True
        and all(b["type"] == "ByteLevel" and not b["add_prefix_space"] and not b["use_regex"] for b in before[1:])
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in made["added_tokens"])
    )


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, ids of white-space-separated words remembered.

    Whole texts are given to tokenizers for which ``words_apart`` doesn't hold. Where it does, no token spans white space, so a text's ids are its words' ids in order. New words of Latin letters, with or without
    marks after them, are taken apart: no token holds both letters and marks. The letters need none of the tokenizer's
    normalisers but lower case; runs not met before are encoded many at a time by the same model, and as only the last token
    of a run has the vocabulary's end-of-word suffix, it shows where a run's ids end.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.apart = words_apart(self.tokenizer.to_str())
        if not self.apart:
            return
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.apart:
            out = []
            for t in texts:  # one at a time: a text may be very long
                out.append(np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes())
            return out
        split = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = set(chain.from_iterable(split))
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self._forget()
            new = words.difference(self.known)
        self._plain(list(filter(_PLAIN.fullmatch, new)))
        rest = [w for w in new if w not in self.known]
        for word, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[word] = np.array(e.ids, dtype="<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _forget(self) -> None:
        """Keep the shorter words, which come back most, up to three quarters of the room."""
        lengths = np.bincount([len(w) for w in self.known])
        longest = int(np.searchsorted(np.cumsum(lengths), 0.75 * CACHE_WORDS, side="right")) - 1
        self.known = {w: ids for w, ids in self.known.items() if len(w) <= longest}

    def _plain(self, words: list[str]) -> None:
        """Remember words of letters and marks: their letters in lower case are looked up, or encoded many at a time."""
        low = "\n".join(words).lower().split("\n") if words else []
        cores = [w.rstrip(_MARKS) for w in low]
        ids: dict[str, bytes] = {}
        new = list(set(cores).difference(self.known))
        for at in range(0, len(new), 20_000):
            ids.update(self._together(new[at : at + 20_000]))
        marks = {w[len(c) :] for w, c in zip(low, cores, strict=True)}
        ends = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, dtype="<u4").tobytes() for m in marks}
        known = self.known
        for word, l, c in zip(words, low, cores, strict=True):
            letters = ids.get(c) or known.get(c)
            if letters:
                known[word] = letters + ends[l[len(c) :]]

    def _together(self, runs: list[str]) -> dict[str, bytes]:
        """The ids of runs of letters; empty if they can't be told apart."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(runs) or stops[-1] != len(ids):
            return {}
        raw, cuts = ids.tobytes(), [0, *(4 * stops).tolist()]
        return dict(zip(runs, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))


_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+[.,;:!?%&*$#|()]*")
_MARKS = ".,;:!?%&*$#|()"
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The one of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids, then id 0, cut where they exceed capacity."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        of = encoder(tokenizer_path)
        for b in small(batches):
            rows = []
            for d, raw in enumerate(of.encode(b.column(1).to_pylist())):
                raw += b"\0\0\0\0"
                for p, s in enumerate(range(0, len(raw), 4 * capacity)):
                    ids = raw[s : s + 4 * capacity]
                    rows.append((d, p, s // 4, len(ids) // 4, zlib.crc32(ids)))
            cols = [list(c) for c in zip(*rows, strict=True)]
            if rows:
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0])), *(pa.array(c, type=k) for c, k in zip(cols[1:], kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def exact_patterns(lengths: np.ndarray, capacity: int, most: int = MAX_PATTERNS) -> np.ndarray:
    """(n, 3) lengths in falling order, 0 where there are fewer, that sum to capacity; lengths: those that occur."""
    there = np.zeros(capacity + 1, dtype=bool)
    there[lengths] = True
    out = [[capacity, 0, 0]] if there[capacity] else []
    high = lengths[(lengths < capacity) & (2 * lengths >= capacity)]
    found = [np.array(out, dtype=np.int64).reshape(-1, 3), np.stack([p := high[there[capacity - high]], capacity - p, 0 * p], axis=1)]
    total = sum(map(len, found))
    for a in lengths[::-1]:
        rest = capacity - a
        b = lengths[(lengths <= a) & (2 * lengths >= rest) & (lengths < rest)]
        b = b[there[rest - b]]
        found.append(np.stack([0 * b + a, b, rest - b], axis=1))
        total += len(b)
        if total > most:
            break
    return np.concatenate(found)[:most]


def fit_repeats(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative least squares by multiplicative updates: x such that the patterns use up the histogram."""
    used = (patterns > 0).sum(axis=1)
    x = np.full(len(patterns), histogram.sum() / max(1, used.sum()))

    def back(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        v[0] = 0
        return v[patterns].sum(axis=1)

    target = back(histogram.astype(float))
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), weights=np.repeat(x, 3), minlength=len(histogram))
        x *= target / np.maximum(back(made), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every piece; histogram[length] pieces of each length."""
    left, out = histogram.astype(np.int64).copy(), []
    lengths = np.flatnonzero(left)
    patterns = exact_patterns(lengths, capacity) if len(lengths) else np.empty((0, 3), np.int64)
    if len(patterns):
        x = fit_repeats(patterns, left)
        for n in np.argsort(-x, kind="stable"):
            want = int(np.rint(x[n]))
            if want < 1:
                break
            lens, times = np.unique(patterns[n][patterns[n] > 0], return_counts=True)
            repeats = min(want, int((left[lens] // times).min()))
            if repeats:
                left[lens] -= repeats * times
                out.append((tuple(int(v) for v in patterns[n] if v), repeats))
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free = np.zeros(capacity + 1, dtype=bool)
    for length in np.flatnonzero(histogram)[::-1]:
        length, n = int(length), int(histogram[length])
        while n:
            fits = np.flatnonzero(free[length:])
            if not len(fits):
                each = min(n, capacity // length)
                bins = n // each
                room = capacity - each * length
                open_.setdefault(room, []).append(((length,) * each, bins))
                free[room] = True
                n -= each * bins
                continue
            room = length + int(fits[0])
            pattern, bins = open_[room].pop()
            take = min(n, bins)
            if bins > take:
                open_[room].append((pattern, bins - take))
            free[room] = bool(open_[room])
            open_.setdefault(room - length, []).append(((*pattern, length), take))
            free[room - length] = True
            n -= take
    return [entry for entries in open_.values() for entry in entries]


def slots(planned: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """Runs of slots by length: length, the first rank, the first sequence, and the offset in it."""
    rows, seen, sequence = [], [0] * (capacity + 1), 0
    for pattern, repeats in planned:
        at = 0
        for length in pattern:
            rows.append((length, seen[length], sequence, at))
            seen[length] += repeats
            at += length
        sequence += repeats
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of each row of docs.

    A null or empty text is one piece that holds id 0 alone. Repeated rows and null ids are packed like any others. An
    empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.write(pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():  # at most capacity rows
        histogram[r["length"]] = r["count"]
    table = slots(plan(histogram, capacity), capacity)
    salts = int(histogram.sum()) // PER_SALT + 1
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")
    cut = cut.withColumn("salt", salt)
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("in_salt", F.row_number().over(within)).join(first, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("in_salt") - 1).alias("rank"))
    sent = docs.sparkSession.sparkContext.broadcast(table)  # bounded by MAX_PATTERNS and capacity
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches):
        import pyarrow as pa

        t = sent.value
        high = int(t["rank"].max()) + 1 if len(t["rank"]) else 1
        runs = t["length"] * high + t["rank"]
        for b in batches:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(runs, length * high + np.minimum(rank, high - 1), side="right") - 1
            found = [pa.array(t["sequence"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *found], names=names)

    kind = cut.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
