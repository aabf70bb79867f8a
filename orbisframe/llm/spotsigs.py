"""SpotSigs document fingerprints and their near-duplicate join, in DataFrame functions only.

A text's words are its runs of letters and digits in lower case. Common words of four languages are anchors; all others
are content words. Each content word right after an anchor starts a chain of ``CHAIN`` = 3 content words (fewer at the
end), and one chain starts at the text's first content word. The hashes of the distinct chains are the signature set. A text
without content words has one signature, of the text itself. With ``run`` given, every word of a run of more than ``run``
content words without an anchor between starts a chain, so that tables, word lists, code and languages without anchors enter
the fingerprint whole; only the run itself decides, so an edit changes no chains elsewhere. The fingerprint is the sorted set
written out, eight hex digits a signature, and the likeness of two fingerprints is the Jaccard coefficient of their sets.

``similar`` joins a corpus with itself. Equal sets are one class. Classes are partitioned by the length of their sets, so wide that
sets alike enough lie in the same or the next partition. In a partition classes meet at the rare signatures of their sets: of a
set of n, ordered from rare to frequent, the first n - ceil(t n) + 1 must hold one in common. A pair is dropped where the two
lengths, or what the sets have left after the common signature, can't give the likeness t; the rest is verified. The result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DecimalType, FractionalType, IntegralType, StringType, TimestampNTZType, TimestampType

from .scratch import Scratch

CHAIN = 3
#: Prose seldom has more content words than this between two anchors (5 % of the runs of ``check_s``).
RUN = 9
PER_BUCKET = 500
#: Ranges of ids grow beyond PER_BUCKET rows only where there would be more ranges than this; their bounds are broadcast (8 MB).
MAX_BUCKETS = 1_000_000
LIKENESS = 0.8
#: How often signatures occur is counted in this many hash buckets; those FREQUENT times the mean, at most BUCKETS / 64, are told.
BUCKETS = 1 << 20
FREQUENT = (64, 1024)
TILE = 4096
HOT = 1000
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an of and to in is was for on that it as with are be by this at or from had not but "
    "der die das und zu den von mit ist ein eine des dem im auf für nicht sich auch als "
    "le la les de du et en un une que qui dans pour est sur au il par ce pas "
    "el los las y del se con no por su para al lo como"
).split()


def _any_of(words: list[str]) -> str:
    """A pattern for the words that shares their beginnings."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by_first.setdefault(w[:1], []).append(w[1:])
    parts = [c + (_any_of(rest) if len(rest) > 1 else rest[0]) for c, rest in by_first.items() if c]
    return "(?:" + "|".join(parts) + ")" + ("?+" if "" in by_first else "") if parts else ""


def signatures(text: Column, run: int | None = None) -> Column:
    """The sorted distinct signatures of a text (null: of the empty text), as longs below 2^32.

    run: the longest run of content words that has only the chain at its start; None: each run has only that.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.concat(F.lit(" the "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    words = F.regexp_replace(F.regexp_replace(words, "  +", " "), f" {_any_of(ANCHORS)}(?= )", "#")
    chain = rf"(?= ([^ #]+(?:[ #]+[^ #]+){{0,{CHAIN - 1}}}))"
    if run is None:
        starts = f"#{chain}"
    else:  # past a start: the whole of a short run, else one word, and the next match starts at the next word
        starts = rf"(?:#|\G){chain}(?:(?<=#)(?!(?: [^ #]++){{{run + 1}}})(?: [^ #]++)++| [^ #]++)"
    chains = F.regexp_extract_all(words, F.lit(starts), F.lit(1))
    chains = F.when(F.size(chains) == 0, F.array(F.concat(F.lit("#"), low))).otherwise(chains)
    hashed = F.transform(chains, lambda c: F.xxhash64(F.regexp_replace(c, "[ #]+", " ")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.array_sort(F.array_distinct(hashed))


def written(sigs: Column) -> Column:
    """The fingerprint string of a signature set."""
    return F.lower(F.array_join(F.transform(sigs, lambda s: F.lpad(F.hex(s), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two signature sets."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sigs), a row for each row of docs; null texts become empty ones."""
    return _texts(docs, id_col, text_col).withColumn("sigs", signatures(F.col("text")))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _key(kind: DataType) -> tuple[Column, bool]:
    """A number in the order of column doc_id, and whether it tells ids apart; the smallest for null."""
    c = F.col("doc_id")
    if isinstance(kind, (IntegralType, BooleanType)):
        return F.coalesce(c.cast("long"), F.lit(-(1 << 63))), True
    if isinstance(kind, DateType):
        return F.coalesce(F.unix_date(c).cast("long"), F.lit(-(1 << 63))), True
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-(1 << 63))), True
    if isinstance(kind, (FractionalType, DecimalType)):
        return F.coalesce(c.cast("double"), F.lit(float("-inf"))), False
    # the seven bytes after what all ids begin with
    shared = F.length(F.regexp_extract(F.concat("least_id", F.lit("\n"), "most_id"), r"(?s)^(.*).*\n\1.*$", 1))
    head = F.rpad(F.hex(F.substring(c.cast("string"), shared + 1, F.lit(7)).cast("binary")), 14, "0")
    return F.coalesce(F.conv(F.substring(head, 1, 14), 16, 10).cast("long"), F.lit(-1)), False


def _ranged(docs: DataFrame, per_bucket: int) -> DataFrame:
    """docs (doc_id, text) with key and h, by which rows are ordered, the number of their range of rows (bucket) among all (buckets),
    and whether a row may be the first of its range (head).

    Ranges are cut in two steps at approximate quantiles: of the key, up to a thousand, and again within each of these. A key that
    fills several of the first is cut by the hash of the text instead. No range is empty.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    key, exact = _key(kind)
    if isinstance(kind, (StringType, BinaryType)):
        ends = docs.agg(F.min(F.col("doc_id").cast("string")).alias("least_id"), F.max(F.col("doc_id").cast("string")).alias("most_id"))
        docs = docs.crossJoin(F.broadcast(ends))  # one row
    body = docs.withColumn("key", key).withColumn("h", F.xxhash64("text")).drop("least_id", "most_id")
    body = body.withColumn("at", F.col("key").cast("double"))  # quantiles are doubles; the order within a range is that of key
    n = body.count()
    per = max(per_bucket, n // MAX_BUCKETS + 1)
    outer = max(1, min(1000, n // per))
    shares = [i / outer for i in range(1, outer)]
    cuts = (body.agg(F.percentile_approx("at", shares, 10 * outer + 1000).alias("c")).first()["c"] or []) if shares else []
    hot = sorted({c for c in cuts if cuts.count(c) > 1}) if exact else []
    bounds = sorted(set(cuts))
    step = F.size(F.filter(F.lit(bounds), lambda c: c <= F.col("at"))) if bounds else F.lit(0)
    whole = F.col("doc_id").isNull() | F.col("at").between(-(2.0**53), 2.0**53)  # no other key has this double
    alone = F.col("at").isin(hot) & whole if hot else F.lit(False)
    body = body.withColumn("outer", 2 * step + F.when(alone, 0).otherwise(1))
    body = body.withColumn("sub", F.when(alone, F.col("h").cast("double")).otherwise(F.col("at")))

    def inner(rows: DataFrame, most: int) -> DataFrame:
        m = max(1, min(1000, most // per))
        cuts = F.percentile_approx("sub", [i / m for i in range(1, m)] or [0.5], 10 * m + 1000)
        found = rows.groupBy("outer").agg(F.min("sub").alias("low"), cuts.alias("cuts"))
        return found if m > 1 else found.withColumn("cuts", F.slice("cuts", 1, 0))

    ranges = inner(body.filter(~alone), n // outer * 2) if hot else inner(body, n // outer * 2)
    if hot:
        ranges = ranges.unionByName(inner(body.filter(alone), n))
    ranges = ranges.withColumn("cuts", F.filter(F.array_distinct("cuts"), lambda c: c > F.col("low"))).withColumn("k", F.size("cuts") + 1)
    past = Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1)  # some 1,500 rows
    ranges = ranges.withColumn("before", F.coalesce(F.sum("k").over(past), F.lit(0))).withColumn("buckets", F.sum("k").over(Window.partitionBy()))
    ranges = Scratch(spark, "spotsigs").write(ranges.drop("k"), "ranges")
    body = body.join(F.broadcast(ranges), "outer")  # at most 1.5 MAX_BUCKETS numbers
    place = F.size(F.filter("cuts", lambda c: c <= F.col("sub")))
    head = F.col("sub") == F.when(place == 0, F.col("low")).otherwise(F.get("cuts", place - 1))
    return body.select("doc_id", "text", "key", "h", (F.col("before") + place).alias("bucket"), "buckets", head.alias("head"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET, run: int | None = None) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): of the row itself and of the row that follows by doc_id, then by the text's hash.

    After the last row comes the first. Rows are dealt into ranges of about per_bucket rows, so no task sorts more than a
    few ranges; the first row of each range is also sent to the range before, where it follows the last. Ids may be of any type
    that can be ordered; null ids come first. A lone row follows itself.
    """
    rows = _ranged(_texts(docs, id_col, text_col), per_bucket)
    line = ["key", "doc_id", "h"]
    first = rows.filter("head").withColumn("to", F.pmod(F.col("bucket") - 1, F.col("buckets")))
    first = first.groupBy("to").agg(F.min(F.struct(*line, "text")).alias("s"))
    ghosts = first.select(F.col("to").alias("bucket"), F.lit(True).alias("ghost"), "s.*")
    both = rows.select("bucket", F.lit(False).alias("ghost"), *line, "text").unionByName(ghosts)
    both = both.withColumn("sigs", signatures(F.col("text"), run))
    order = Window.partitionBy("bucket").orderBy("ghost", *line)
    both = both.select("ghost", "doc_id", "text", "sigs", F.lead("text").over(order).alias("next_text"), F.lead("sigs").over(order).alias("next_sigs"))
    return both.filter(~F.col("ghost")).drop("ghost")


def probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET, run: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document. Null
    texts are empty; repeated rows follow each other; null ids come first. An empty table gives no rows. Other columns
    are not read. run is that of ``signatures``.
    """
    rows = with_next(docs, id_col, text_col, per_bucket, run)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "edited", "sigs", "next_sigs", signatures(F.col("edited"), run).alias("edited_sigs"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("sigs")).alias("fingerprint"),
        written(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def _rarity(classes: DataFrame) -> Callable[[Column], Column]:
    """A function that tells how frequent a signature is, in steps; counted over all classes (column sigs) in BUCKETS hash buckets."""
    bucket = lambda x: x.bitwiseAND(F.lit(BUCKETS - 1))
    counts = classes.select(F.explode(F.transform("sigs", bucket)).alias("b")).groupBy("b").count()
    mean = max(1.0, (counts.agg(F.sum("count").alias("n")).first()["n"] or 0) / BUCKETS)
    many = counts.filter(F.col("count") > FREQUENT[0] * mean).collect()  # at most BUCKETS / 64 rows
    steps = [[r["b"] for r in many if r["count"] > f * mean] for f in FREQUENT]
    return lambda x: sum((bucket(x).isin(told).cast("int") for told in steps if told), F.lit(0))


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", likeness_: float = LIKENESS, run: int | None = RUN, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_links), a row for each row of docs.

    class_id is the smallest id with an equal fingerprint (null if none has an id), n_links how many other classes have a likeness of at
    least likeness_. Null texts are empty ones, which are one class; texts of any length are read whole; repeated rows and null ids
    each give a row, an empty table none. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spotsigs")
    prints = _texts(docs, id_col, text_col).select("doc_id", signatures(F.col("text"), run).alias("sigs"))
    prints = scratch.write(prints.select("doc_id", F.unhex(F.md5(F.array_join("sigs", ","))).alias("sid"), "sigs"), "prints")
    classes = prints.groupBy("sid").agg(F.first("sigs").alias("sigs"), F.min("doc_id").alias("class_id"), F.count("*").alias("rows"))
    classes = scratch.write(classes, "classes")
    found = scratch.write(links(classes, scratch, likeness_, tile), "links")
    ends = found.select(F.col("a").alias("sid")).unionByName(found.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("n_links"))
    named = classes.join(ends, "sid", "left").select("sid", "class_id", "rows", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = scratch.write(named, "named")
    often = [bytes(r["sid"]) for r in named.filter(F.col("rows") > prints.count() / HOT).select("sid").collect()]  # fewer than HOT
    told = F.col("sid").isin(often) if often else F.lit(False)
    named, prints = named.drop("rows"), prints.select("doc_id", "sid")
    joined = prints.filter(~told).join(named.filter(~told), "sid")
    if often:
        joined = joined.unionByName(prints.filter(told).join(F.broadcast(named.filter(told)), "sid"))
    return joined.select("doc_id", "class_id", "n_links")


def links(classes: DataFrame, scratch: Scratch, likeness_: float = LIKENESS, tile: int = TILE) -> DataFrame:
    """(a, b, likeness): every pair of classes (sid, sigs) that alike, once.

    A signature at which over tile sets of a partition meet is dealt into chunks; each pair of chunks meets in a task of its own.
    """
    if not 0 < likeness_ <= 1:
        raise ValueError("the likeness must be over 0 and at most 1")
    rarity, n = _rarity(classes), F.size("sigs")
    by_rarity = F.array_sort(F.transform("sigs", lambda x: F.struct(rarity(x).alias("f"), x.alias("x"))))
    # partitions a little wider than the lengths that can be alike, so that rounding never parts two of them by more than one
    part = F.floor(F.log(n.cast("double")) / max(-math.log(likeness_), 1e-9) * 0.999999).cast("long")
    short = F.slice(by_rarity, F.lit(1), n - F.ceil(n * likeness_ - 1e-9).cast("int") + 1)
    meets = classes.select("sid", n.alias("n"), part.alias("part"), F.posexplode(short).alias("at", "s"))
    meets = scratch.write(meets.select("sid", "n", "part", "at", F.col("s.x").alias("x")), "meets")
    left = meets.select("x", "part", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    right = meets.select("x", F.explode(F.array("part", F.col("part") - 1)).alias("part"), F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    heavy = right.groupBy("x", "part").count().filter(F.col("count") > tile)
    heavy = scratch.write(heavy.select("x", "part", F.ceil(F.col("count") / tile).cast("int").alias("chunks")), "heavy")
    chunks = F.coalesce("chunks", F.lit(1))
    left = left.join(heavy, ["x", "part"], "left").withColumn("ca", F.pmod(F.xxhash64("a"), chunks).cast("int"))
    left = left.withColumn("cb", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    right = right.join(heavy, ["x", "part"], "left").withColumn("cb", F.pmod(F.xxhash64("b"), chunks).cast("int"))
    right = right.withColumn("ca", F.explode(F.sequence(F.lit(0), chunks - 1))).drop("chunks")
    ordered = F.struct("na", "a") < F.struct("nb", "b")
    length = F.col("na") >= F.col("nb") * likeness_ - 1e-9
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # the most that both can hold from here on
    enough = rest * (1 + likeness_) >= (F.col("na") + F.col("nb")) * likeness_ - 1e-9
    pairs = left.join(right, ["x", "part", "ca", "cb"]).filter(ordered & length & enough).select("a", "b").distinct()
    pairs = pairs.join(classes.select(F.col("sid").alias("a"), F.col("sigs").alias("sa")), "a").join(classes.select(F.col("sid").alias("b"), F.col("sigs").alias("sb")), "b")
    return pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= likeness_ - 1e-12)
