"""SimHash near-duplicates: pivot distance tables over banded candidates.

A document's fingerprint has 64 bits; documents link when their fingerprints differ in at most ``max_bits`` = 4 of them.

* Distinct fingerprints stand for their documents, so any number of equal texts is one row from here on.
* Two fingerprints within 4 bits agree on at least two of six blocks. Each of the 15 pairs of blocks gives an equi-join
  key of 21 or 22 bits. Pivot distances alone can't be such a key: distances between unrelated fingerprints gather at
  32 +- 4, and a tolerance of 4 keeps over half the pairs for each pivot.
* Within a key, a table of Hamming distances to 16 fixed reference fingerprints discards a pair when some coordinate
  differs by more than 4 (triangle inequality); the survivors are verified by XOR and bit count.
* A key with over ``tile`` fingerprints is cut into chunks, and each pair of chunks is a group of its own. A group gives
  a spanning forest of its links, found breadth first, never all its pairs. Any two linked fingerprints of a key share
  a group, so the forests together keep every component.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from .arrow import small
from .graph import components
from .scratch import Scratch

MAX_BITS = 4
WORDS = 4
SEED = 42
TILE = 4096
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
KEYS = tuple(combinations(range(len(BLOCKS)), 2))
N_PIVOTS = 16
HOT = 1000


#: The reference fingerprints, from a fixed generator.
PIVOTS = np.random.default_rng(SEED).integers(0, 2**64, N_PIVOTS, dtype=np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """int8 (n, pivots): Hamming distances of fps to the reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for null and for texts without words.

    A-Z are lower-cased, words are runs of other bytes than ASCII white space, shingles are of 4 words with repeats;
    a text of one to three words is one shingle. A bit is set when over half of the shingles' XXH64 have it.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = max(1, len(words) - WORDS + 1)
    counts, hash64 = np.zeros((8, 256), dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        starts = ends[at - 1 : to - 1] if at else [0, *ends[: to - 1]]
        stops = ends[at + WORDS - 1 : to + WORDS - 1] if len(words) >= WORDS else ends[-1:]
        hashes = np.array([hash64(joined[s : e - 1], SEED) for s, e in zip(starts, stops, strict=True)], dtype="<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(octets[:, k], minlength=256)
    ones = counts @ _BITS  # [byte, bit] -> shingles that set it
    bits = (2 * ones > n).reshape(64)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            fps = np.fromiter((fingerprint(t) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind}, fp long")


def with_fingerprint(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with fp, the fingerprint as a signed long, as last column."""
    place, schema = docs.columns.index(text_col), StructType([*docs.schema.fields, StructField("fp", LongType())])

    def run(batches):
        import pyarrow as pa

        for b in small(batches):
            fps = np.fromiter((fingerprint(t) for t in b.column(place).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield b.append_column("fp", pa.array(fps.view(np.int64)))

    return docs.mapInArrow(run, schema)


def of_sortable(kind: DataType) -> bool:
    """Whether values of a type can be ordered: all can but maps and variants, and what holds them."""
    said = kind.simpleString()
    return "map<" not in said and "variant" not in said


def _key(fp: str, n: int) -> Column:
    """The n-th pair of blocks of a fingerprint, tagged with n."""
    (s0, w0), (s1, w1) = (BLOCKS[b] for b in KEYS[n])
    low = F.shiftrightunsigned(fp, s0).bitwiseAND(F.lit((1 << w0) - 1))
    high = F.shiftrightunsigned(fp, s1).bitwiseAND(F.lit((1 << w1) - 1))
    return low + high * F.lit(1 << w0).cast("long") + F.lit(n << 22).cast("long")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one group, as pairs of positions."""
    table, todo, edges = pivot_table(fps), np.arange(len(fps)), []
    while len(todo):
        stack, todo = [todo[0]], todo[1:]
        while stack and len(todo):
            i = stack.pop()
            near = todo
            for p in range(0, N_PIVOTS, 4):
                near = near[(np.abs(table[near, p : p + 4] - table[i, p : p + 4]) <= max_bits).all(axis=1)]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= max_bits]
            if len(near):
                edges += [(int(i), int(j)) for j in near]
                stack += list(near)
                todo = todo[~np.isin(todo, near, assume_unique=True)]
    return edges


def _group_links(key: np.ndarray, tile: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole groups (equal key and tile), which lie together. Small groups are compared by shifting the rows."""
    n = len(key)
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    group = np.cumsum(new) - 1
    found = []
    small = (sizes <= 16)[group] & (sizes > 1)[group]
    at = np.flatnonzero(small)
    shift = 1
    while len(at):
        at = at[at + shift < n]
        at = at[group[at] == group[np.minimum(at + shift, n - 1)]]
        a, b = at, at + shift
        if len(a):
            near = (np.abs(pivot_table(fps[a]) - pivot_table(fps[b])) <= max_bits).all(axis=1)
            a, b = a[near], b[near]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
            found.append(np.stack([a[near], b[near]], axis=1))
        shift += 1
    for g in np.flatnonzero(sizes > 16):
        pairs = _forest(fps[starts[g] : starts[g] + sizes[g]], max_bits)
        if pairs:
            found.append(np.array(pairs) + starts[g])
    if not found:
        return fps[:0], fps[:0]
    pairs = np.concatenate(found)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def links(fps: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that span every component."""
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys are exact up to {MAX_BITS} bits")
    keyed = fps.select("fp", F.explode(F.array(*[_key("fp", n) for n in range(len(KEYS))])).alias("key"))
    hot = keyed.groupBy("key").count().filter(F.col("count") > tile)
    hot = scratch.write(hot.select("key", F.ceil(F.col("count") / tile).cast("int").alias("chunks")), "hot")
    keyed = keyed.join(hot, "key", "left")
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    keyed = keyed.select("fp", "key", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("other"))
    tile_id = F.least("mine", "other") * F.lit(1 << 20).cast("long") + F.greatest("mine", "other")
    keyed = keyed.select("key", tile_id.alias("tile"), "fp").repartition("key", "tile").sortWithinPartitions("key", "tile", "fp")

    def run(batches):
        import pyarrow as pa

        names, held = ["a", "b"], [np.empty(0, np.int64)] * 3

        def out(cols):
            a, b = _group_links(cols[0], cols[1], cols[2].view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            if len(last):
                cut = last[-1] + 1
                yield out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield out(held)

    return keyed.mapInArrow(run, "a long, b long")


def _components(prints: DataFrame, scratch: Scratch, max_bits: int, tile: int) -> DataFrame:
    """Of the distinct fingerprints of prints (doc_id, fp): fp, the rows n, the smallest id first_id (no_id: none has one), how many
    rows have that id too (same), and the smallest fingerprint that links reach (root); written."""
    each = prints.groupBy("fp", "doc_id").agg(F.count("*").alias("same"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("first_id"), F.col("same").alias("same")))
    classes = each.groupBy("fp").agg(first.alias("f"), F.sum("same").alias("n")).select("fp", "f.no_id", "f.first_id", "f.same", "n")
    classes = scratch.write(classes, "classes")
    found = components(links(classes, scratch, max_bits, tile), scratch)
    rooted = classes.join(found, classes.fp == found.node, "left").drop("node").withColumn("root", F.coalesce("root", "fp"))
    return scratch.write(rooted, "rooted")


def _often(classes: DataFrame, rows: int) -> list[int]:
    """The fingerprints that over a thousandth of all rows share: fewer than HOT."""
    return [r["fp"] for r in classes.filter(F.col("n") > rows / HOT).select("fp").collect()]


def _told(rows: DataFrame, by_fp: DataFrame, often: list[int]) -> DataFrame:
    """rows joined to by_fp on fp; the rows of frequent fingerprints by broadcast, so that none gathers in a task."""
    if not often:
        return rows.join(by_fp, "fp")
    hot = F.col("fp").isin(often)
    return rows.filter(hot).join(F.broadcast(by_fp.filter(hot)), "fp").unionByName(rows.filter(~hot).join(by_fp.filter(~hot), "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id).

    fingerprint has 16 hex digits; component_id is the smallest non-null id among the documents that links reach.
    Null texts and texts without words have fingerprint zero and link like any other; rows with a null id keep it and
    get the component of their text (null if nobody in it has an id). Texts of any length are read whole. Repeated rows each
    give a row. An empty table gives no rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col), "prints")
    rooted = _components(prints, scratch, max_bits, tile)
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = scratch.write(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    joined = _told(prints, named, _often(rooted, prints.count()))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """The rows of docs, all columns, but one row only of each near-duplicate component.

    It is the row with the smallest id (rows without an id come last); of rows that share id and fingerprint, the first by all
    columns. Nulls, empty texts, repeated ids and repeated rows thus follow the one rule; a row goes only for its own text, whatever
    else has its id. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    cols = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called
    plain = docs.toDF(*cols)
    of_id, of_text = cols[docs.columns.index(id_col)], cols[docs.columns.index(text_col)]
    marked = scratch.write(with_fingerprint(plain, of_text), "marked")
    prints = marked.select(F.col(of_id).alias("doc_id"), "fp")
    rooted = _components(prints, scratch, max_bits, tile)
    first = F.min(F.struct("no_id", "first_id", "fp", "same"))
    kept = scratch.write(rooted.groupBy("root").agg(first.alias("k")).select("k.fp", F.col("k.first_id").alias("kept_id"), "k.same"), "kept")
    match = F.col(of_id).eqNullSafe(F.col("kept_id"))
    unique, repeated = kept.filter("same = 1").drop("same"), kept.filter("same > 1").drop("same")
    out = marked.join(unique, [marked.fp == unique.fp, match], "left_semi").select(*cols)
    if not repeated.isEmpty():
        several = marked.join(repeated, [marked.fp == repeated.fp, match], "left_semi")
        order = [F.col(c) if of_sortable(docs.schema.fields[k].dataType) else F.to_json(F.struct(c)) for k, c in enumerate(cols)]
        one = several.groupBy("fp", F.col(of_id)).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r"))
        out = out.unionByName(one.select("r.*"))
    return out.toDF(*docs.columns)
