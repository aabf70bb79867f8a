"""Chat formatting by Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours have the same role, and concatenated:

    <|im_start|>ROLE newline TEXT [<|im_sep|>TEXT ...]<|im_end|> newline

Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles a newline becomes ``&#10;``), so
control strings stand only where the template puts them and everything can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_blocks): loss_blocks tells for each merged block whether its text is learned.

    Turns are sorted by turn, role and text, nulls first; null roles and texts are empty. Repeated rows are turns of their own.
    Rows with a null conv_id are one conversation. An empty table gives no rows. Other columns are not read.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    row = F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), row.alias("row"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("t"))
    n = F.size("t")
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("t", i)["role"] != F.get("t", i - 1)["role"]))
    marked = sorted_.withColumn("starts", starts)

    def block(start: Column, k: Column) -> Column:
        own = F.slice("t", start + 1, F.coalesce(F.get("starts", k + 1), n) - start)
        texts = F.array_join(F.transform(own, lambda r: escape(r["text"])), SEP)
        return F.struct(F.get("t", start)["role"].alias("role"), texts.alias("body"))

    blocks = marked.select("conv_id", F.transform("starts", block).alias("blocks"))
    name = lambda b: F.replace(escape(b["role"]), F.lit("\n"), F.lit("&#10;"))
    said = F.transform("blocks", lambda b: F.concat(F.lit(START), name(b), F.lit("\n"), b["body"], F.lit(END)))
    learned = F.transform("blocks", lambda b: b["role"] == LEARNED)
    return blocks.select("conv_id", F.array_join(said, "").alias("formatted"), learned.alias("loss_blocks"))


def parse(formatted: DataFrame) -> DataFrame:
    """Add turns (array of role, text) and loss_text to (conv_id, formatted, loss_blocks), from formatted and the mask alone."""
    parts = F.split("formatted", r"<\|im_start\|>", -1)
    cut = formatted.withColumn("parts", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))

    def read(p: Column) -> Column:
        name = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(name) + 2, F.length(p) - F.length(name) - 1 - len(END))
        return F.struct(unescape(F.replace(name, F.lit("&#10;"), F.lit("\n"))).alias("role"), F.transform(F.split(body, r"<\|im_sep\|>", -1), unescape).alias("texts"))

    cut = cut.withColumn("blocks", F.transform("parts", read)).drop("parts")
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), x.alias("text")))))
    under = F.filter("blocks", lambda b, k: F.get("loss_blocks", k))
    loss = F.array_join(F.transform(under, lambda b: F.array_join(b["texts"], "")), "")
    return cut.withColumn("turns", turns).withColumn("loss_text", loss).drop("blocks")


def digests(parsed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what parse() read."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
