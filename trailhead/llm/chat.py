"""Chat formatting with a grammar round trip, on DataFrame functions alone.

Grammar of the output, read by one regular expression from left to right:

    conversation = turn*
    turn         = "<|im_start|>" role "\\n" body "<|im_end|>\\n"

The role is written percent-encoded. A turn is first written with its text as it is, read again by the grammar and
compared with its source; if the two differ, or the text holds a control string of a vocabulary, control strings in
it are escaped: a backslash goes behind their first character, and one more where there are such backslashes
already, so that removing one from each gives the text back, whatever it was. Then the whole conversation is
read again and compared with all of its turns; a difference stops the job.

Defined results: turns are ordered by turn, then role, then text (null first); null role and null text count as
empty; repeated rows are repeated turns; rows whose conversation is null form one conversation; an empty table gives
no rows; further columns are ignored. A conversation is one output row, so its turns meet in one task; nothing
else is gathered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Strings that the usual vocabularies give a meaning of their own.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

TURN = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"


def _controls(backslashes: str) -> str:
    """Matches just backslashes (a pattern) where they stand behind the first character of a control string."""
    firsts = sorted({c[0] for c in CONTROLS})
    each = (
        rf"(?<=\{first}){backslashes}(?=\\*(?:{'|'.join(re.escape(c[1:]) for c in CONTROLS if c[0] == first)}))"
        for first in firsts
    )
    return "|".join(each).replace(r"\<", "<")


def escape(text: Column) -> Column:
    """Put a backslash behind the first character of each control string, over those that are there."""
    return F.regexp_replace(text, _controls(""), r"\\")


def unescape(text: Column) -> Column:
    """Take one backslash from each escaped control string."""
    return F.regexp_replace(text, _controls(r"\\"), "")


def parse(formatted: Column) -> Column:
    """The turns that the grammar reads in a formatted text: array of struct<role, text>."""
    both = F.arrays_zip(
        F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)).alias("role"),
        F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2)).alias("body"),
    )
    return F.transform(both, lambda t: F.struct(F.url_decode(t["role"]).alias("role"), unescape(t["body"]).alias("text")))


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_spans (code points: array of struct<start, length>).

    loss_spans mark the bodies of the turns of loss_role.
    """
    named = F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    source = rows.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    plain = source.withColumn("head", named).withColumn("back", parse(F.concat("head", "text", F.lit(CLOSE))))
    same = F.col("back") == F.array(F.struct("role", "text"))
    clean = ~F.col("text").rlike("|".join(re.escape(c) for c in CONTROLS))
    written = plain.withColumn("body", F.when(same & clean, F.col("text")).otherwise(escape(F.col("text")))).drop("back")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "head", "body")))
    whole = written.groupBy("conv").agg(turns.alias("turns"))
    whole = whole.select(
        "conv",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform("turns", lambda t: t["role"] == loss_role).alias("loss"),
        F.transform("turns", lambda t: F.struct(F.length(t["head"]).alias("head"), F.length(t["body"]).alias("body"))).alias("sizes"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, t):
        start = acc["at"] + t["sizes"]["head"]
        here = F.array(F.struct(start.alias("start"), t["sizes"]["body"].alias("length")))
        return F.struct(
            (start + t["sizes"]["body"] + len(CLOSE)).alias("at"),
            F.when(t["loss"], F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"),
        )

    checked = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation isn't the same when it is read again"))
    )
    return whole.select(
        F.col("conv").alias(conv),
        checked.alias("formatted"),
        F.aggregate(F.arrays_zip(F.col("loss").alias("loss"), F.col("sizes").alias("sizes")), zero, step)["spans"].alias("loss_spans"),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output holds, read from it alone: conv, turns, loss_text (unescaped), formatted."""
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(
        conv, parse(F.col("formatted")).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted"
    )


def digests(back: DataFrame, conv: str = "conv_id") -> DataFrame:
    """n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of read_back()'s rows."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
