"""Quotation linking: conversations in order of reply, without their quotes.

Lines that open with ``>`` marks are quoted, as deep as they have marks.  A passage
is a quoted line without its marks, normalised (lower case, runs of white space as
one blank, trimmed), and known by its hash.  It is joined to the latest earlier
message of the conversation that has it as a line of its own; the message that most
passages of the first quote level lead to, of equals the latest, is the parent.
Passages of deeper levels count as linked where their message is found, but choose
no parent.  A line that says who wrote what follows (``On ... wrote:``) leaves the body
with the quote that it stands before.  Threads follow parents to the message that has none, by pointer
doubling, and rows come in order of conversation, thread and turn: every reply
stands after what it replies to, in the thread that it belongs to.

All of it is DataFrame operations.  The latest earlier message of a passage is found
without pairing passages and messages: turns are cut into blocks; within a block a
running maximum does it, and across blocks one over the maxima of each.  So a passage
that a third of all messages share, or a conversation that holds a third of them,
makes rows in proportion to it and no task of its size.

Defined results: a null text has no lines and no body; a text of quotes alone has an
empty body; a null conversation or turn links with nothing and starts a thread of
its own; messages that repeat conversation and turn count as one for links and are
all returned; quoted lines found in no earlier message are removed all the same; a
table without rows gives none.  Columns other than the four named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import written

#: Quote marks at the start of a line, with blanks between them, and one blank after.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: How mail programs introduce a quote.
ATTRIBUTION = r"^[ \t]*(?:On|Le|Am|El)[ \t].*(?:wrote|écrit|schrieb.*|escribió)[ \t\x{a0}]*:[ \t]*$"
#: Turns that one running maximum goes over.
BLOCK_TURNS = 1024


def lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\n|\r")


def level(line: Column) -> Column:
    """How deep a line is quoted."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[ \t]+", " "))


def body(text: Column) -> Column:
    """The lines of the text that aren't quoted nor introduce a quote, without blank ones at the ends."""
    every = lines(text)
    quoted = lambda x: F.coalesce(x.rlike(MARKS), F.lit(False))
    own = F.filter(every, lambda x, i: ~quoted(x) & ~(x.rlike(ATTRIBUTION) & quoted(F.get(every, i + 1))))
    return F.regexp_replace(F.array_join(own, "\n"), r"\A[ \t\n]+|[ \t\n]+\z", "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, n): non-blank lines of each message by depth, 0 for its own."""
    rows = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.explode(lines(F.col("text"))).alias("line"))
    rows = rows.select("conv_id", "turn", level(F.col("line")).alias("level"), normalised(F.col("line")).alias("passage")).filter("passage <> ''")
    return rows.groupBy("conv_id", "turn", "level", F.md5(F.col("passage").cast("binary")).alias("hash")).agg(F.count("*").alias("n"))


def _latest_earlier(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """``quoted`` with ``found``, the latest turn before its own that has the passage."""
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    wanted = quoted.select("conv_id", "hash").distinct()
    own = own.select("conv_id", "hash", "turn").distinct().join(wanted, ["conv_id", "hash"], "left_semi")
    either = own.select("conv_id", "hash", "turn", F.col("turn").alias("own"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("n"))
    either = either.union(quoted.select("conv_id", "hash", "turn", F.lit(None).cast("long"), "level", "n")).withColumn("block", block)
    within = Window.partitionBy("conv_id", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    either = either.withColumn("found", F.max("own").over(within))
    blocks = own.groupBy("conv_id", "hash", block.alias("block")).agg(F.max("turn").alias("last"))
    heads = quoted.select("conv_id", "hash", block.alias("block"), F.lit(None).cast("long").alias("last")).distinct()
    blocks = blocks.union(heads).groupBy("conv_id", "hash", "block").agg(F.max("last").alias("last"))
    before = Window.partitionBy("conv_id", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "hash", "block", F.max("last").over(before).alias("carried"))
    found = either.filter("level IS NOT NULL").join(blocks, ["conv_id", "hash", "block"])
    return found.select("conv_id", "turn", "level", "n", F.coalesce("found", "carried").alias("found"))


def parents(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, n_quoted, n_linked) of every message that quotes."""
    rows = written(passages(messages), "passages")
    quoted = rows.filter("level > 0").withColumn("turn", F.col("turn").cast("long"))
    found = _latest_earlier(rows.filter("level = 0").withColumn("turn", F.col("turn").cast("long")), quoted)
    votes = found.groupBy("conv_id", "turn", F.col("found"), (F.col("level") == 1).alias("direct")).agg(F.sum("n").alias("n"))
    best = F.max(F.when(F.col("direct") & F.col("found").isNotNull(), F.struct("n", "found")))
    linked = F.coalesce(F.sum(F.when(F.col("found").isNotNull(), F.col("n"))), F.lit(0))
    return votes.groupBy("conv_id", "turn").agg(best["found"].alias("parent_turn"), F.sum("n").alias("n_quoted"), linked.alias("n_linked"))


def threads(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth) of every reply (conv_id, turn, parent_turn):
    the message without parent that its parents lead to, and how many they are."""
    reached = written(replies.select("conv_id", "turn", F.col("parent_turn").alias("thread_turn"), F.lit(1).cast("long").alias("depth")), "replies")
    while True:
        further = reached.select("conv_id", F.col("turn").alias("thread_turn"), F.col("thread_turn").alias("next"), F.col("depth").alias("more"))
        joined = reached.join(further, ["conv_id", "thread_turn"], "left")
        if joined.filter("next IS NOT NULL").isEmpty():
            return reached
        reached = written(joined.select("conv_id", "turn", F.coalesce("next", "thread_turn").alias("thread_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def linked(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, body, parent_turn, thread_turn, depth, n_quoted, n_linked)
    of every message, in order of conversation, thread and turn."""
    messages = df.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    replies = written(parents(messages), "parents")
    roots = threads(replies.filter("parent_turn IS NOT NULL"))
    known = replies.join(roots, ["conv_id", "turn"], "left")
    out = messages.join(known, ["conv_id", "turn"], "left")
    out = out.select(
        "conv_id",
        "turn",
        "role",
        body(F.col("text")).alias("body"),
        "parent_turn",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    return out.orderBy("conv_id", "thread_turn", "turn", "role", "body")
