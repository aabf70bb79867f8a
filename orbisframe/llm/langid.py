"""Language ID by prediction by partial matching over bytes.

For each language a context tree holds how often each byte followed each context of 0 to ``ORDER`` = 3 bytes. A byte's
probability comes from the longest context the language has seen: count / (total + distinct) for a byte seen there, and
otherwise the escape probability distinct / (total + distinct) times the next shorter context's probability, shared
among the bytes not seen at the longer one; below order 0 all bytes are alike. The statistics are frozen, so the code
length of a byte depends only on the bytes before it, and a text's code length is the sum over its 4-grams. The language
with the shortest code is predicted.

A tree is sparse: sorted codes of the contexts and grams that its language has seen, with their bits. All trees together hold
at most 2 * (ORDER + 1) entries of 12 bytes for each of ``FIT_TOTAL`` bytes, however many languages there are; prose repeats itself, and four
languages of 600,000 bytes each come to 1.4 MB. A batch of texts looks each of its distinct 4-grams up once in each tree.

The trees are fitted on a bounded sample of the labelled rows, drawn by hash: of about ``FIT_BYTES`` for each language, with a
span of at most ``SPAN`` characters of each drawn row, at a place that its hash chooses, so that no single text speaks
for its language and a language of long texts only is learned like any other. Every text is scored whole. The settings were
chosen on an inner split of the labelled rows (fitted where crc32 modulo 3 is 0, judged where it is 2).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import small

ORDER = 3
FIT_BYTES = 600_000
FIT_TOTAL = 16_000_000
SPAN = 2_000
#: A lang column with more values than this is no language column.
MAX_LANGS = 10_000
_PART = 1 << 19
_ALNUM = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; superscripts and fractions are none."""
    return any(any(map(str.isalpha, m[0])) for m in _ALNUM.finditer(text or ""))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in the sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _places(unique: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places in unique, which is sorted and holds all grams: by a table of hashes, and by search where two share an entry."""
    shift = np.uint64(64 - max(8, int(len(unique)).bit_length() + 3))
    mixed = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)
    table = np.zeros(1 << 64 - int(shift), dtype=np.int32)
    table[mixed(unique)] = np.arange(len(unique), dtype=np.int32)
    out = table[mixed(grams)]
    wrong = np.flatnonzero(unique[out] != grams)
    out[wrong] = np.searchsorted(unique, grams[wrong])
    return out


@dataclass
class Tree:
    """By order: grams (context and byte as one number) with their bits, contexts with the bits of an escape."""

    symbols: int
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def code(self, grams: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last symbol of each gram after the order symbols before it; quick where grams are sorted."""
        if order < 0:
            return np.full(len(grams), np.log2(self.symbols))
        at, seen = _find(self.grams[order], grams)
        out = np.empty(len(grams))
        out[seen] = self.bits[order][at[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            rest = grams[new]
            at, known = _find(self.contexts[order], rest // self.symbols)
            shorter = rest % self.symbols**order if order else rest
            out[new] = self.code(shorter, order - 1)
            out[new[known]] += self.escapes[order][at[known]]
        return out

    @classmethod
    def grow(cls, grams: np.ndarray, symbols: int) -> Tree:
        """The tree of all (ORDER + 1)-grams of a language's texts."""
        tree = cls(symbols, [], [], [], [])
        for order in range(ORDER + 1):
            codes, counts = np.unique(grams % symbols ** (order + 1), return_counts=True)
            contexts, first = np.unique(codes // symbols, return_index=True)
            if len(codes):
                distinct = np.diff(np.append(first, len(codes)))
                total = np.add.reduceat(counts, first)
                lower = np.exp2(-tree.code(codes % symbols**order if order else codes, order - 1))
                left = np.maximum(1 - np.add.reduceat(lower, first), 1e-12)  # the shorter context's share of unseen bytes
                escapes = -np.log2(distinct / (total + distinct) / left)
                bits = -np.log2(counts / np.repeat(total + distinct, distinct))
            else:
                escapes = bits = np.empty(0)
            tree.grams.append(codes)
            tree.bits.append(bits.astype(np.float32))
            tree.contexts.append(contexts)
            tree.escapes.append(escapes.astype(np.float32))
        return tree


@dataclass
class Model:
    """langs: sorted; symbol: byte -> symbol (0 stands before a text, the last for all bytes never seen); a tree each."""

    langs: list[str]
    symbol: np.ndarray
    trees: list[Tree]

    def grams(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(part, gram) of each byte, the first bytes of a part after boundary symbols."""
        symbols = int(self.symbol.max()) + 1
        joined = np.frombuffer(b"".join(b"\0" * ORDER + p for p in parts), dtype=np.uint8)
        sym = self.symbol[joined]
        lengths = np.array([len(p) + ORDER for p in parts], dtype=np.int64)
        real = np.ones(len(sym), dtype=bool)
        pads = ((np.cumsum(lengths) - lengths)[:, None] + np.arange(ORDER)).ravel()
        sym[pads], real[pads] = 0, False
        at = np.flatnonzero(real)
        gram = sym[at - ORDER]
        for back in range(ORDER - 1, -1, -1):
            gram = gram * symbols + sym[at - back]
        return np.repeat(np.arange(len(parts)), lengths - ORDER), gram

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """(text, language) bits."""
        out = np.zeros((len(texts), len(self.langs)))
        held, size = [], 0
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            for start in range(0, len(raw), _PART):  # a long text in parts, each after the bytes before it
                part = raw[max(0, start - ORDER) : start + _PART]
                held.append((k, part, min(start, ORDER)))
                size += len(part)
                if size > _PART:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list, out: np.ndarray) -> None:
        if not held:
            return
        of, gram = self.grams([part for _, part, _ in held])
        lengths = np.array([len(part) for _, part, _ in held])
        skips = np.array([skip for _, _, skip in held])
        first = np.cumsum(lengths) - lengths
        if skips.any():
            new = np.arange(len(of)) - first[of] >= skips[of]
            of, gram = of[new], gram[new]
        unique = np.sort(gram)
        unique = unique[np.flatnonzero(np.diff(unique, prepend=-1))]
        place, text = _places(unique, gram), np.array([k for k, _, _ in held])
        for n, tree in enumerate(self.trees):
            out[:, n] += np.bincount(text, weights=np.bincount(of, weights=tree.code(unique, ORDER)[place], minlength=len(held)), minlength=len(out))


def fit(texts_by_lang: dict[str, list[str]]) -> Model:
    """Frozen statistics of the given texts."""
    langs = sorted(texts_by_lang)
    raw = {g: [t.encode("utf-8", "surrogatepass") for t in texts_by_lang[g]] for g in langs}
    seen = np.zeros(256, dtype=bool)
    for parts in raw.values():
        for p in parts:
            seen[np.frombuffer(p, dtype=np.uint8)] = True
    symbol = np.full(256, int(seen.sum()) + 1, dtype=np.int64)
    symbol[seen] = 1 + np.arange(seen.sum())
    symbols = int(seen.sum()) + 2
    model = Model(langs, np.where(seen, symbol, symbols - 1), [])
    if seen.all():  # the symbol of unseen bytes is counted though no byte has it
        model.symbol = np.append(model.symbol, symbols - 1)
    model.trees = [Tree.grow(model.grams(raw[g])[1], symbols) for g in langs]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 1 modulo 3; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_bytes: int = FIT_BYTES, span: int = SPAN) -> dict[str, list[str]]:
    """Spans by language, from rows that aren't held out: a hash sample of about fit_bytes for each language.

    A row gives its whole text, or of a longer one span characters at a place that the row's hash chooses. Rows alike in
    id, text and lang count once, so that the sample stays bounded whatever repeats. ValueError beyond MAX_LANGS values of lang.
    """
    text, size = F.col(text_col), F.length(F.col(text_col))
    chosen = F.xxhash64(F.col(id_col), text)
    start = F.pmod(chosen, F.greatest(size - span + 1, F.lit(1)).cast("long")).cast("int")
    usable = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & (size > 0))
    sizes = usable.groupBy(F.col(lang_col).alias("lang")).agg(F.sum(F.least(F.octet_length(text), F.lit(span))).alias("n")).limit(MAX_LANGS + 1).collect()
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{lang_col} has more than {MAX_LANGS} values")
    if not sizes:
        return {}
    most = min(fit_bytes, FIT_TOTAL // len(sizes))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 1.2 * most / r["n"]))])
    drawn = usable.filter(F.pmod(F.xxhash64(chosen), F.lit(1_000_003)) < share[F.col(lang_col)] * 1_000_003)
    drawn = drawn.select(F.col(lang_col).alias("lang"), F.substring(text, start + 1, F.lit(span)).alias("span"), chosen.alias("h")).distinct()
    out: dict[str, list[str]] = {}
    held: dict[str, int] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["lang"], r["h"], r["span"])):  # about 1.2 * most bytes a language
        if held.get(r["lang"], 0) < most:
            out.setdefault(r["lang"], []).append(r["span"])
            held[r["lang"]] = held.get(r["lang"], 0) + len(r["span"].encode("utf-8", "surrogatepass"))
    return out


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted languages and scores; ("und", 0) for null, for texts without a letter, and where nothing was learned."""
    good = [bool(model.langs) and has_letter(t) for t in texts]
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    rows = np.flatnonzero(good)
    if len(rows):
        bits = model.code_lengths([texts[k] for k in rows])
        best = bits.argmin(axis=1)
        scores[rows] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        for k, b in zip(rows, best, strict=True):
            langs[k] = model.langs[b]
    return langs, scores


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of docs.

    score is the posterior probability of lang_pred under equal priors, 0 to 1. Ties go to the first language by name.
    Null, empty and letterless texts give ("und", 0); long texts are scored whole, in parts. An empty table gives no
    rows. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_TOTAL, see Tree
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            langs, scores = predict(sent.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, type=pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language with at least min_score.

    Null, empty and letterless texts go; ties go to the first language by name. Repeated rows are judged alike and null ids like
    any other; long texts are scored whole. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_TOTAL, see Tree
    place = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            langs, scores = predict(sent.value, b.column(place).to_pylist())
            yield b.filter(pa.array([g != "und" and s >= min_score for g, s in zip(langs, scores, strict=True)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_bytes: int = FIT_BYTES, span: int = SPAN) -> Model:
    """fit(fit_sample(...))."""
    return fit(fit_sample(docs, id_col, text_col, lang_col, fit_bytes, span))
