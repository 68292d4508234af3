"""Chat formatting by a grammar round trip, in DataFrame functions only.

A turn is rendered as its header line, its text, and an end mark on a line of its own. Control strings are the start of a header
and the end mark. A rendered turn is read again by a strict parser, which refuses control strings inside a text and takes
one backslash off those behind backslashes; where what it recovers is not the source, the text gets one backslash
before each control string, and is rendered and read again. Escaping once is always enough, see restored(), so a turn that then still differs is an
error, as is a conversation whose whole rendering does not read back as its turns.

Null texts and null roles are empty; rows without a conversation id are one conversation. Turns are ordered by turn, then role,
then text, nulls first; repeated rows are turns of their own. A conversation's rows meet in one row of the output, as its
text must. Only the named columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import let

HEADER, END = "### ", "</turn>"
CONTROL = "(?:### |</turn>)"
TERMINATOR = f"\n{END}\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{CONTROL})", r"\\$1")


def restored(body: Column) -> Column:
    """The text of a body; null where a control string stands without a backslash before it.

    escaped() puts exactly one backslash before each maximal run of backslashes and control string, and this takes
    exactly one off each such run, so restored(escaped(t)) = t for every t.
    """
    return F.when(~body.rlike(rf"(?<!\\){CONTROL}"), F.regexp_replace(body, rf"\\(\\*{CONTROL})", "$1"))


def role_written(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def role_restored(role: Column) -> Column:
    halves = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def rendered(role: Column, body: Column) -> Column:
    return F.concat(F.lit(HEADER), role_written(role), F.lit(":\n"), body, F.lit(TERMINATOR))


def parsed(formatted: Column) -> Column:
    """array<struct<role, text, body>> of a rendered conversation."""
    parts = F.filter(F.split(formatted, TERMINATOR, -1), lambda x: x != "")
    head = r"^### ([^\n]*):\n"
    return F.transform(
        parts,
        lambda x: F.struct(
            role_restored(F.regexp_extract(x, head, 1)).alias("role"),
            restored(F.regexp_replace(x, head, "")).alias("text"),
            F.regexp_replace(x, head, "").alias("body"),
        ),
    )


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, end>>: code points of formatted that the loss covers."""
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def reads_back(body: Column) -> Column:
        back = parsed(rendered(F.col("role"), body))
        return F.coalesce((F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")), F.lit(False))

    mended = let(escaped(F.col("text")), lambda body: F.when(reads_back(body), body).otherwise(F.raise_error(F.lit("a turn does not read back"))))
    rows = rows.withColumn("body", F.when(reads_back(F.col("text")), F.col("text")).otherwise(mended))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("out", rendered(F.col("role"), F.col("body"))).withColumn("k", F.row_number().over(order))
    end = F.sum(F.length("out")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    stop = end - F.length(F.lit(TERMINATOR))
    rows = rows.withColumn("span", F.when(F.col("role") == loss_role, F.struct((stop - F.length("body")).alias("start"), stop.alias("end"))))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("k", "out", "span", "role", "text"))).alias("all"))
    spans = F.filter(F.transform("all", lambda x: x["span"]), lambda s: s.isNotNull())
    chats = chats.select("conv_id", "all", F.array_join(F.transform("all", lambda x: x["out"]), "").alias("formatted"), spans.alias("loss_spans"))
    source = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    back = F.transform(parsed(F.col("formatted")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    checked = F.when(back == source, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not read back")))
    return chats.select("conv_id", checked.alias("formatted"), "loss_spans")


def read_back(chats: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from formatted and loss_spans alone."""
    turns = chats.select("conv_id", "formatted", "loss_spans", parsed(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: restored(F.substring(F.col("formatted"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    out = turns.withColumn("loss_text", F.array_join(masked, ""))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
