r"""Chat formatting whose output parses back to its source.

Grammar (``x*`` is repetition)::

    conversation := turn*
    turn         := <s> head text </s>
    head         := [INST] (user) | [/INST] (assistant) | [SYS] (system) | [NULL] (no role) | [ROLE] name [/ROLE]

No control string may stand inside a text or a name. The parser is deterministic: it cuts at ``</s>``,
reads the head, refuses bodies with control strings, and removes one backslash from each escaped one.
A turn that does not parse back to its source is escaped: each control string, however many
backslashes it already holds behind its opening bracket, gets one more. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TAIL = r"(/?s>|/?INST\]|SYS\]|NULL\]|/?ROLE\])"
HEADS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}


def escape(text: Column) -> Column:
    """Every control string gets one more backslash behind its bracket."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAIL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + TAIL, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    """One turn, as it is."""
    head = F.when(role.isNull(), "[NULL]")
    for name, mark in HEADS.items():
        head = head.when(role == name, mark)
    return F.concat(F.lit("<s>"), head.otherwise(F.concat(F.lit("[ROLE]"), role, F.lit("[/ROLE]"))), text, F.lit("</s>"))


def parse(turn: Column) -> Column:
    """Struct of role and text of one turn without its ``</s>``; null where the grammar does not hold."""
    head = F.regexp_extract(turn, r"^<s>(\[(?:/?INST|SYS|NULL|ROLE)\])", 1)
    name = F.regexp_extract(turn, r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\]", 1)
    ends = F.when(head == "[ROLE]", 16 + F.length(name)).otherwise(3 + F.length(head))
    body = F.substring(turn, ends + 1, F.length(turn))
    role = F.when(head == "[NULL]", F.lit(None).cast("string"))
    for known, mark in HEADS.items():
        role = role.when(head == mark, F.lit(known))
    clean = ~(F.concat(name, F.lit("\n"), body).rlike(r"[<\[]" + TAIL))
    return F.when((head != "") & clean, F.struct(role.otherwise(unescape(name)).alias("role"), unescape(body).alias("text")))


def parse_all(formatted: Column) -> Column:
    """Array of role and text, from a whole formatted conversation."""
    turns = F.split(formatted, "</s>", -1)
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), parse)


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_mask``.

    ``loss_mask`` holds ``(start, length)`` in code points of ``formatted``, one for each assistant text.

    * Turns stand in the order of ``turn`` (null first), ties in the order of role and text; repeated rows are repeated turns.
    * A null text is empty; a null role stays null; a null conv_id is one conversation.
    * An empty table gives no rows. Other columns are ignored. A conversation must fit into one row.
    * A turn that would not parse back even when escaped raises an error; no input is known that does.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = F.struct("role", "text")
    cut_end = lambda c: F.substring(c, 1, F.length(c) - 4)
    turns = conversations.select("conv_id", "turn", "role", text.alias("text")).withColumn("raw", render(F.col("role"), F.col("text")))
    same = F.coalesce(parse(cut_end(F.col("raw"))) == source, F.lit(False))
    turns = turns.withColumn("piece", F.when(same, F.col("raw")).otherwise(render(F.when(F.col("role").isin(*HEADS), F.col("role")).otherwise(escape(F.col("role"))), escape(F.col("text"))))).drop("raw")
    again = F.coalesce(parse(cut_end(F.col("piece"))) == source, F.lit(False))
    turns = turns.withColumn("piece", F.when(again, F.col("piece")).otherwise(F.raise_error(F.lit("a turn does not parse back"))))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select("conv_id", "role", "piece", F.row_number().over(order).alias("at"), F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("until"))
    size = F.length("piece") - F.lit(14)  # <s>, [/INST] and </s>
    span = F.when(F.col("role") == "assistant", F.struct((F.col("until") - size - 4).alias("start"), size.cast("long").alias("length")))
    rows = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("t"))
    return rows.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), F.filter("t.span", lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted text and its loss mask say, after unescaping."""
    turns = F.col("turns")
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"].cast("int")))), "")
    told = formatted.select("conv_id", parse_all(F.col("formatted")).alias("turns"), masked.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return told.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
