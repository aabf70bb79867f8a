"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as their words in lower case, joined by single spaces. An item of n characters may occur
with up to k = floor(error_rate * n) edits. It is split into k + 1 pieces; an occurrence with k edits leaves at least one
piece intact, so an Aho-Corasick automaton over all pieces finds every candidate place. Each candidate window is
verified with Myers' bit-parallel edit distance, the whole item being one bit vector. Items of under ``MIN_CHARS`` characters
are too short for edits: they occur where all their words stand unchanged, in whole words.

Items reach the workers in blocks of at most ``block_chars`` characters, one pass over the texts for each block, so
what a worker holds is bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small
from .scratch import Scratch

ERROR_RATE = 0.05
MIN_CHARS = 20
BLOCK_CHARS = 4_000_000
_WORD = re.compile(r"\w+")


def normalize(text: str | None) -> str:
    """Lower-case words joined by single spaces."""
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(pattern: str, text: str, anchored: bool = False) -> list[int]:
    """Edit distance of the whole pattern to the best substring of text ending at each position, 0 to len(text).

    anchored: the substring starts where text does.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for j, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << j
    full, top = (1 << m) - 1, 1 << m - 1 if m else 0
    pv, mv, score, out = full, 0, m, [m]
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | anchored) & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        out.append(score)
    return out


def best_match(item: str, k: int, text: str, windows: list[tuple[int, int]]) -> tuple[int, int, int] | None:
    """(distance, start, end) of the closest, then first occurrence of item within the windows of text, up to k edits."""
    merged: list[list[int]] = []
    for a, b in sorted(windows):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    best = None
    for a, b in merged:
        scores = myers(item, text[a:b])
        low = min(scores)
        if low <= k and (best is None or low < best[0]):
            end = a + scores.index(low)
            back = myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1], anchored=True)
            best = (low, end - back.index(low), end)
    return best


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple], error_rate: float, min_chars: int):
        import ahocorasick

        self.items, self.auto, by_piece = [], ahocorasick.Automaton(), {}
        self.short, exact = ahocorasick.Automaton(), {}
        for item_id, raw in items:
            item = normalize(raw)
            if len(item) >= min_chars:
                k = int(error_rate * len(item))
                for offset, piece in pieces(item, k):
                    by_piece.setdefault(piece, []).append((len(self.items), offset + len(piece)))
                self.items.append((item_id, item, k))
            elif item:
                exact.setdefault(item, []).append(item_id)
        for item, ids in exact.items():
            self.short.add_word(f" {item} ", (len(item), ids))
        if exact:
            self.short.make_automaton()
        for piece, where in by_piece.items():
            self.auto.add_word(piece, where)
        if by_piece:
            self.auto.make_automaton()

    def find(self, raw: str | None) -> list[tuple]:
        """(item_id, distance, start, end): an entry for each item that occurs; code points of raw, end exclusive."""
        if not (self.items or len(self.short)) or not raw:
            return []
        text = normalize(raw)
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, where in self.auto.iter(text) if self.items else ():
            for n, upto in where:
                _, item, k = self.items[n]
                start = end + 1 - upto
                windows.setdefault(n, []).append((max(0, start - k), min(len(text), start + len(item) + k)))
        out, words = [], None
        for n in sorted(windows):
            item_id, item, k = self.items[n]
            hit = best_match(item, k, text, windows[n])
            if hit:
                words = words or _places(raw)
                out.append((item_id, hit[0], _first(words, hit[1], raw), _last(words, hit[2], raw)))
        seen = set()
        for end, (size, ids) in self.short.iter(f" {text} ") if len(self.short) else ():
            start = end - 1 - size
            if ids[0] not in seen:
                seen.update(ids)
                words = words or _places(raw)
                out += [(item_id, 0, _first(words, start, raw), _last(words, end - 1, raw)) for item_id in ids]
        return out


def _places(raw: str) -> tuple[list[int], list[tuple[int, int]]]:
    """Where each word starts in the normal form, and its span in raw; by lower-casing word by word."""
    spans, starts, at = [], [], 0
    for m in _WORD.finditer(raw):
        spans.append(m.span())
        starts.append(at)
        at += len(m[0].lower()) + 1
    return starts, spans


def _first(words, position: int, raw: str) -> int:
    from bisect import bisect_right

    starts, spans = words
    return spans[max(0, bisect_right(starts, position) - 1)][0] if spans else 0


def _last(words, position: int, raw: str) -> int:
    from bisect import bisect_left

    starts, spans = words
    return spans[max(0, bisect_left(starts, position) - 1)][1] if spans else len(raw)


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """The distinct items with a text, in lists of at most block_chars characters (or one item)."""
    items = benchmark.select(F.col(item_id).alias("i"), F.col(text_col).alias("t")).filter("t is not null").distinct()
    block, held = [], 0
    for r in items.orderBy("i", "t").toLocalIterator():
        if block and held + len(r["t"]) > block_chars:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += len(r["t"])
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and benchmark item that occurs in it: (doc_id, item_id, distance, start, end).

    distance is the smallest number of edits, start and end the code points of the first such place (of those, the one that ends
    first, and of its beginnings the last), widened to whole words. Items whose normal form is shorter than min_chars match whole words
    without edits; null items, items without words, and null or empty texts match nothing. Items and texts of any length are matched
    whole. Repeated rows of docs each give their rows, repeated items one. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    kind, of = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {of}, distance int, start long, end long"
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], schema)
    for n, block in enumerate(item_blocks(benchmark, item_id, "text", block_chars)):
        sent = spark.sparkContext.broadcast(block)  # bounded by block_chars

        def run(batches, sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, error_rate, min_chars)
            for b in small(batches):
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for hit in matcher.find(t)]
                cols = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
                kinds = [b.column(0).type, None if rows else pa.null(), pa.int32(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "distance", "start", "end"])

        found = narrow.mapInArrow(run, schema)
        out = out.unionByName(found) if n else found
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows whose text holds a benchmark item, by the same matching; all columns stay.

    Null and empty texts hold nothing and stay; repeated rows are judged alike, texts of any length whole. What one block leaves is
    written before the next, so that a worker never holds two. Empty tables change nothing.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontaminate")
    place, out = docs.columns.index(text_col), docs
    for n, block in enumerate(item_blocks(benchmark, "item_id", "text", block_chars)):
        if n:
            out = scratch.write(out, f"b{n}")
            if n > 1:
                scratch.drop(f"b{n - 1}")
        sent = spark.sparkContext.broadcast(block)  # bounded by block_chars

        def run(batches, sent=sent):
            import pyarrow as pa

            matcher = Matcher(sent.value, error_rate, min_chars)
            for b in small(batches):
                clean = [not matcher.find(t) for t in b.column(place).to_pylist()]
                yield b.filter(pa.array(clean, type=pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
