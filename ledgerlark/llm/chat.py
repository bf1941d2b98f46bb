"""Chat formatting by prefix-target expansion, in DataFrame operations.

Every assistant turn becomes an example of its own: all turns before it as context and its text alone under the loss
mask. A conversation is formatted once; an example is a prefix of that, with the place of the trainable text in code
points. Turns after the last assistant turn (or of a conversation without one) make one more example, without loss, so
that the output holds every turn.

A turn is ``<|im_start|>role`` line feed ``text<|im_end|>`` line feed. In roles and texts ``&``, ``<`` and ``[`` are
written as entities (line feeds in roles too), so no control string of this or another template survives in them, and
the reverse replacement restores them exactly.

Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. Null roles and texts
are empty; a null conv_id is a conversation. A conversation's turns make one row, as its last example does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(c: Column) -> Column:
    for plain, entity in ENTITIES:
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def unescape(c: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def format_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end, is_last from ``conversations(conv_id, turn, role, text)``.

    loss_start and loss_end are null where nothing is trainable; is_last marks the example that holds all turns.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = (
        rows.withColumn("at", F.row_number().over(order))
        .withColumn("end", F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("loss_start", F.col("end") - F.length("piece") + F.length("head"))
        .withColumn("loss_end", F.col("loss_start") + F.length("body"))
    )
    turns = placed.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda t: t["piece"]), "").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("at", "end", "loss_start", "loss_end")))).alias("targets"),
        F.count("*").alias("n"),
    )
    tail = F.struct(F.col("n").cast("int").alias("at"), F.length("whole").cast("bigint").alias("end"), F.lit(None).cast("bigint").alias("loss_start"), F.lit(None).cast("bigint").alias("loss_end"))
    ended = F.exists("targets", lambda t: t["at"] == F.col("n"))
    examples = turns.withColumn("t", F.explode(F.when(ended, F.col("targets")).otherwise(F.concat("targets", F.array(tail)))))
    return examples.select("conv_id", F.col("t.at").alias("example"), F.substr("whole", F.lit(1), F.col("t.end").cast("int")).alias("formatted"), "t.loss_start", "t.loss_end", (F.col("t.at") == F.col("n")).alias("is_last"))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) of a formatted text."""
    pieces = F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda p: p != "")

    def turn(p: Column) -> Column:
        line = F.locate("\n", p)
        role = F.replace(F.substr(p, F.lit(1), line - 1), F.lit("&#10;"), F.lit("\n"))
        body = F.substr(p, line + 1, F.length(p) - line - len(END) - 1)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def digests(examples: DataFrame) -> DataFrame:
    """For each conversation what its examples say, read back from them."""
    masked = F.substr("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    read = examples.groupBy("conv_id").agg(
        F.max(F.when(F.col("is_last"), F.col("formatted"))).alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("loss_start").isNotNull(), F.struct("example", masked.alias("reply"))))).alias("replies"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.transform("replies", lambda r: unescape(r["reply"])), "")
    turns = read.withColumn("turns", read_turns(F.col("whole"))).withColumn("loss", loss)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
