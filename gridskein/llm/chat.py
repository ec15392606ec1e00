"""Chat formatting by quotation linking, in DataFrame operations only.

Messages are parsed into lines with their quote level (the number of ``>`` at
their start).  Quoted passages are normalised (lower case, white space) and
hashed line by line and joined with the messages of the same conversation that
have such a line of their own; a quoted line belongs to the latest earlier one.
A message replies to the message that most of its outermost quoted lines belong
to, the latest of those with most; with ``nested``, lines of deeper levels are
linked too and decide where none of the levels above finds an original.  Replies make threads; a conversation in reply
order has its threads by their first turns and each thread's messages by turn,
without the quotes.

Scale: lines are keyed by conversation and hash, so a conversation with a third
of all messages is spread by its lines.  Quoted lines find the latest earlier
line in blocks of ``BLOCK`` turns, with the last own line of the blocks before
carried over: one line that everybody writes and quotes is spread by blocks and
no pairs of messages are made.  Threads come by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialise

#: Turns of one line in a block.
BLOCK = 4096
_QUOTES = r"^[ \t]*(?:>[ \t]?)+"


def quote_level(line: Column) -> Column:
    """Number of quote marks at a line's start."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTES, 0), "[^>]", "")).cast("long")


def unquoted(line: Column) -> Column:
    """A line without its quote marks."""
    return F.regexp_replace(line, _QUOTES, "")


def normalised(line: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\r\x0B\f]+", " "))


def _latest_earlier(lines: DataFrame) -> DataFrame:
    """For each quoted line (conv, turn, level, hash) the latest earlier turn that has it as its own."""
    own = lines.filter("level = 0").select("conv", "hash", "turn").distinct()
    quoted = lines.filter("level > 0").groupBy("conv", "hash", "turn", "level").agg(F.count(F.lit(1)).alias("n"))
    own = own.join(quoted.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi")
    marked = own.select("conv", "hash", "turn", F.lit(0).cast("long").alias("level"), F.col("turn").alias("own"), F.lit(0).cast("long").alias("n"))
    marked = marked.unionByName(quoted.select("conv", "hash", "turn", "level", F.lit(None).cast("long").alias("own"), "n"))
    marked = marked.withColumn("block", F.floor(F.col("turn") / BLOCK))
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("conv", "hash", "block").agg(F.max("own").alias("own")).withColumn("carried", F.max("own").over(before)).drop("own")
    within = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = marked.withColumn("latest", F.max("own").over(within)).filter("n > 0").join(carried, ["conv", "hash", "block"])
    return found.select("conv", "turn", "level", "n", F.coalesce("latest", "carried").alias("original")).filter("original IS NOT NULL")


def _threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, thread): the first turn of each reply's thread."""
    links = materialise(replies.select("conv", "turn", F.col("reply_to").alias("root")), "threads")
    while True:
        up = links.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"))
        moved = links.join(up, ["conv", "root"], "left")
        if moved.filter("next IS NOT NULL").isEmpty():
            return links.withColumnRenamed("root", "thread")
        links = materialise(moved.select("conv", "turn", F.coalesce("next", "root").alias("root")), "threads")


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", nested: bool = False) -> DataFrame:
    """All columns of ``messages`` with the text's quotes taken out, and reply_to, thread, n_quoted, n_linked.

    reply_to is the turn of the message replied to (null: none found), thread the
    turn that its thread begins with (its own for a message that replies to none),
    n_quoted the number of its quoted lines that aren't blank, n_linked those of
    level 1 (with ``nested`` of every level) that were found in earlier messages.
    With ``nested``, reply_to comes from the least level that finds an original.  Sorted by conversation, thread
    and turn this is the reply-ordered conversation.  Own lines keep their text;
    blank lines at either end of what is left go.  Null texts stay null and null
    conversations or turns are in no thread (thread null).  Rows that repeat
    conversation and turn are parts of one message and share its links.  Input
    columns of the new names are replaced.  An empty table gives an empty one.
    """
    messages = messages.drop("reply_to", "thread", "n_quoted", "n_linked")
    names = messages.columns
    conv, turn = "__conv", "__turn"
    text = F.col(f"`{text_col}`").cast("string")
    base = messages.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text.alias("text")).filter("conv IS NOT NULL AND turn IS NOT NULL")
    lines = base.select("conv", "turn", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("conv", "turn", quote_level(F.col("line")).alias("level"), normalised(unquoted(F.col("line"))).alias("line")).filter("line <> ''")
    if not nested:
        lines = lines.filter("level < 2")
    lines = lines.select("conv", "turn", "level", F.md5("line").alias("hash"))
    found = _latest_earlier(lines).groupBy("conv", "turn", "level", "original").agg(F.sum("n").alias("n"))
    replies = found.groupBy("conv", "turn").agg(F.max_by("original", F.struct(-F.col("level"), "n", "original")).alias("reply_to"), F.sum("n").alias("n_linked"))
    replies = materialise(replies, "replies")
    links = replies.join(_threads(replies), ["conv", "turn"]).select(F.col("conv").alias(conv), F.col("turn").alias(turn), "reply_to", "n_linked", "thread")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x: quote_level(x) == 0)
    quoted = F.filter(split, lambda x: (quote_level(x) > 0) & (normalised(unquoted(x)) != ""))
    own = F.regexp_replace(F.array_join(kept, "\n"), r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")
    rows = messages.withColumns({text_col: own, "n_quoted": F.when(text.isNull(), 0).otherwise(F.size(quoted)).cast("long")})
    rows = rows.join(links, (F.col(f"`{conv_col}`") == F.col(conv)) & (F.col(f"`{turn_col}`").cast("long") == F.col(turn)), "left")
    lone = F.when(F.col(f"`{conv_col}`").isNotNull(), F.col(f"`{turn_col}`").cast("long"))
    extra = [F.coalesce("thread", lone).alias("thread"), "n_quoted", F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked")]
    return rows.select(*[F.col(f"`{c}`") for c in names], "reply_to", *extra)
