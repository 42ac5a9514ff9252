r"""Chat formatting with prefix-target expansion, in DataFrame functions only.

A conversation is rendered once, turn after turn:

    ### <role>:\n<text></turn>\n

Every assistant turn is exploded into one example, a row of its own: all preceding turns are its context
and only that reply is trainable. An example ends with its target turn, so its context is the slice of the
rendering before it, given by its end; only the reply is copied. The expansion thus grows with the number
of turns, not with its square. A rendering is kept in rows of up to CHUNK turns, so a conversation with
very many turns is spread over many tasks.

Control strings inside roles and texts are escaped reversibly: "\" to "\b", "</turn>" to "\t", "###" to
"\h", and in roles ":" to "\c". After that a rendering has its markers only where the template put them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>\n"
#: Turns of one row of a rendering.
CHUNK = 256


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column, role: bool = False) -> Column:
    text = _replace(_replace(_replace(text, "\\", "\\b"), "</turn>", "\\t"), "###", "\\h")
    return _replace(text, ":", "\\c") if role else text


def unescape(text: Column) -> Column:
    return _replace(_replace(_replace(_replace(text, "\\c", ":"), "\\h", "###"), "\\t", "</turn>"), "\\b", "\\")


EXAMPLES = "array<struct<target:bigint,context_chars:bigint,loss_start:bigint,loss_chars:bigint>>"


def render(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, chunk, start_chars, turns, formatted, examples: a conversation is the formatted strings of its
    rows in the order of chunk.

    Turns are in the order of turn (null first), then role and text, so ties and repeated rows have one
    order. Null roles and texts are empty; rows without conv_id make one conversation. examples has one
    entry for each assistant turn of the chunk: target (its number in the conversation, from 0),
    context_chars (characters of the conversation before its turn), loss_start and loss_chars (the reply,
    escaped, in characters of the conversation). Other columns are ignored. An empty table gives no rows.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK)).withColumn("head", F.concat(F.lit("### "), escape(F.col("role"), role=True), F.lit(":\n"))).withColumn("body", escape(F.col("text")))
    rows = rows.withColumn("line", F.concat("head", "body", F.lit(END)))
    inner = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")) - 1)
    rows = rows.withColumn("at", F.sum(F.length("line")).over(inner) - F.length("line"))
    reply = F.when(F.col("role") == "assistant", F.struct(F.col("n").cast("long").alias("target"), F.col("at").alias("context_chars"), (F.col("at") + F.length("head")).alias("loss_start"), F.length("body").cast("long").alias("loss_chars")))
    chunks = rows.groupBy("conv_id", "chunk").agg(
        F.count("*").alias("turns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "").alias("formatted"),
        F.array_sort(F.collect_list(reply)).alias("found"),
    )
    outer = Window.partitionBy("conv_id").orderBy(F.col("chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chunks = chunks.withColumn("start_chars", F.sum(F.length("formatted")).over(outer) - F.length("formatted"))
    chunks = chunks.withColumn("first", F.sum("turns").over(outer) - F.col("turns"))
    shifted = F.transform("found", lambda x: F.struct((x["target"] + F.col("first")).alias("target"), *((x[c] + F.col("start_chars")).alias(c) for c in ("context_chars", "loss_start")), x["loss_chars"].alias("loss_chars")))
    return chunks.select("conv_id", "chunk", "start_chars", "turns", "formatted", shifted.cast(EXAMPLES).alias("examples"))


def expand(rendered: DataFrame) -> DataFrame:
    """One row for each assistant turn: conv_id, target (its number, from 0), context_chars (where its context ends in
    the conversation's rendering), loss_start, loss_chars (where its trainable characters are), reply (these, escaped)."""
    each = rendered.select("conv_id", "start_chars", "formatted", F.explode("examples").alias("e"))
    reply = F.substr("formatted", (F.col("e.loss_start") - F.col("start_chars") + 1).cast("int"), F.col("e.loss_chars").cast("int"))
    return each.select("conv_id", "e.target", "e.context_chars", "e.loss_start", "e.loss_chars", reply.alias("reply"))


def whole_texts(rendered: DataFrame) -> DataFrame:
    """The examples with their whole texts: conv_id, target, text (all turns up to and with the reply), loss_start, loss_chars.

    These grow with the square of a conversation's turns; training reads slices of the rendering instead.
    """
    whole = rendered.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_chars", "formatted"))), lambda x: x["formatted"]), "").alias("whole"))
    each = expand(rendered).withColumnRenamed("conv_id", "conv").join(whole, F.expr("conv <=> conv_id"))
    end = F.col("loss_start") + F.col("loss_chars")
    return each.select("conv_id", "target", F.substring("whole", F.lit(1), (end + len(END)).cast("int")).alias("text"), "loss_start", "loss_chars")


def read_back(rendered: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation: turns parsed from
    the rendering, the loss from the rows of its examples.

    A digest needs its text in order, so a conversation's turns meet in one row here.
    """
    lines = F.expr(f"filter(split(formatted, '{END[:-1]}\\n'), (x, i) -> i < turns)")

    def parse(line: Column) -> Column:
        role = F.substring_index(line, ":\n", 1)
        body = F.substr(line, F.length(role) + 3)
        return F.concat(unescape(F.substr(role, F.lit(5))), F.lit("\n"), unescape(body), F.lit("\n"))

    none = F.lit(None).cast("struct<place:bigint,text:string>")
    turns = rendered.select("conv_id", F.size(lines).alias("n"), F.length("formatted").alias("chars"), F.struct(F.col("start_chars").cast("long").alias("place"), F.array_join(F.transform(lines, parse), "").alias("text")).alias("turns"), none.alias("reply"))
    replies = examples.select("conv_id", F.lit(0).alias("n"), F.lit(0).alias("chars"), none.alias("turns"), F.struct(F.col("target").cast("long").alias("place"), unescape(F.col("reply")).alias("text")).alias("reply"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), "")
    whole = turns.unionByName(replies).groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), ordered("turns").alias("turns"), ordered("reply").alias("loss"), F.sum("chars").cast("long").alias("formatted_chars"))
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return whole.select("conv_id", "n_turns", digest("turns").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")
