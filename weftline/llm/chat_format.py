"""Relational chat formatting with a reversible template and a loss mask.

Turns are collected as structs, sorted, and concatenated with Spark
expressions only. Adjacent turns of one role are merged into one block, the
original turns inside it being parted by a separator, so the formatted string
can be read back turn by turn.

Template of a block::

    <|im_start|>ROLE\\n TEXT (<|im_sep|> TEXT)* <|im_end|>\\n

Escaping: a control string inside a text has its first character replaced by
an entity (``&lt;`` for ``<``, ``&lb;`` for ``[``); an ``&`` that already
begins one of these entities becomes ``&amp;``. ``unescape(escape(t)) == t``
for every text, and no control string is left inside an escaped text.

Defined results: null text is the empty text; a null role is the empty role;
turns are ordered by (turn, role, text) with null turns first; repeated rows
are repeated turns; rows with a null conv_id form one conversation with a null
id; an empty table gives no conversations; further columns are ignored; very
long texts are formatted whole; a chunk of equal or null turn numbers is larger
than others and is formatted by one task.

Scale: a conversation is first formatted in chunks of ``CHUNK`` consecutive
turn numbers and then concatenated, so that one huge conversation is escaped
and sorted by many tasks and only its finished chunks meet in one row. The
result is one string per conversation, so a conversation must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import before, table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of common chat templates, as regular expressions without their first character.
ANGLE = r"(?=\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|</?SYS>>|\|endoftext\|>|\|startoftext\|>)"
BRACKET = r"(?=/?INST\])"
CHUNK = 256


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, "&(?=(?:amp|lt|lb|nl);)", "&amp;")
    text = F.regexp_replace(text, "<" + ANGLE, "&lt;")
    return F.regexp_replace(text, r"\[" + BRACKET, "&lb;")


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&lb;", "["), ("&nl;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _running(lengths: Column) -> Column:
    """Sums of the elements before each position."""
    return before(lengths, lambda a, x: a + x, "bigint")


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans, n_blocks.

    ``loss_spans`` holds (start, length) in code points of ``formatted``: one
    span per turn of a loss role, covering its escaped text and nothing else.
    """
    turns = rows.select(
        "conv_id",
        F.floor(F.col("turn") / CHUNK).alias("chunk"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    chunks = turns.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("raw"))  # by the texts as they are
    written = F.transform(
        "raw",
        lambda t: F.struct(
            _escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), F.coalesce(t["role"].isin(*loss_roles), F.lit(False)).alias("loss")
        ),
    )
    chunks = chunks.select("conv_id", "chunk", written.alias("ts"))

    def opening(x: Column, i: Column) -> Column:
        before = F.get("ts", i - 1)["role"]
        return (
            F.when(i == 0, F.lit(""))
            .when(before == x["role"], F.lit(SEP))
            .otherwise(F.concat(F.lit(END + START), x["role"], F.lit("\n")))
        )

    chunks = chunks.withColumn("opens", F.transform("ts", opening))
    chunks = chunks.withColumn(
        "at", _running(F.transform(F.arrays_zip("opens", "ts"), lambda z: (F.length(z["opens"]) + F.length(z["ts"]["text"])).cast("long")))
    )
    spans = F.transform(
        F.filter(F.arrays_zip("ts", "opens", "at"), lambda z: z["ts"]["loss"]),
        lambda z: F.struct((z["at"] + F.length(z["opens"])).alias("start"), F.length(z["ts"]["text"]).cast("long").alias("length")),
    )
    chunks = chunks.select(
        "conv_id",
        F.struct(
            "chunk",
            F.get("ts", F.lit(0))["role"].alias("first"),
            F.element_at("ts", -1)["role"].alias("last"),
            F.concat_ws("", F.transform(F.arrays_zip("opens", "ts"), lambda z: F.concat(z["opens"], z["ts"]["text"]))).alias("body"),
            spans.alias("spans"),
            F.size(F.filter("opens", lambda o: o.startswith(END))).alias("blocks"),
        ).alias("c"),
    )
    whole = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("cs"))

    def joint(x: Column, i: Column) -> Column:
        return (
            F.when(i == 0, F.concat(F.lit(START), x["first"], F.lit("\n")))
            .when(F.get("cs", i - 1)["last"] == x["first"], F.lit(SEP))
            .otherwise(F.concat(F.lit(END + START), x["first"], F.lit("\n")))
        )

    whole = whole.withColumn("joints", F.transform("cs", joint))
    whole = whole.withColumn(
        "at", _running(F.transform(F.arrays_zip("joints", "cs"), lambda z: (F.length(z["joints"]) + F.length(z["cs"]["body"])).cast("long")))
    )
    moved = F.transform(
        F.arrays_zip("cs", "joints", "at"),
        lambda z: F.transform(
            z["cs"]["spans"],
            lambda s: F.struct((s["start"] + z["at"] + F.length(z["joints"])).alias("start"), s["length"].alias("length")),
        ),
    )
    return whole.select(
        "conv_id",
        F.concat(
            F.concat_ws("", F.transform(F.arrays_zip("joints", "cs"), lambda z: F.concat(z["joints"], z["cs"]["body"]))), F.lit(END)
        ).alias("formatted"),
        F.flatten(moved).alias("loss_spans"),
        (
            F.aggregate("cs", F.lit(0), lambda a, c: a + c["blocks"])
            + F.size(F.filter("joints", lambda j: ~j.startswith(SEP)))
        ).cast("long").alias("n_blocks"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string as array<struct<role, text>>."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def parse(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        content = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.transform(
            F.split(content, r"<\|im_sep\|>"),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, parse))


def with_loss(out: DataFrame, page: int = 8192) -> DataFrame:
    """Add ``loss``: all text under the loss mask, unescaped, in order.

    A substring is found by walking over all code points before it, so the
    string is cut into pages first and a span is read from its own two pages;
    only spans longer than a page walk over the whole string.
    """
    formatted = F.col("formatted")
    pages = F.transform(
        F.sequence(F.lit(0), F.floor(F.length(formatted) / page).cast("int")),
        lambda i: F.substring(formatted, i * page + 1, F.lit(page)),
    )

    def read(s: Column) -> Column:
        at, length = s["start"].cast("int"), s["length"].cast("int")
        k = F.floor(at / page).cast("int")
        near = F.concat(F.get("pages", k), F.coalesce(F.get("pages", k + 1), F.lit("")))
        return unescape(F.when(length <= page, F.substring(near, at % page + 1, length)).otherwise(F.substring(formatted, at + 1, length)))

    return out.withColumn("pages", pages).withColumn("loss", F.concat_ws("", F.transform("loss_spans", read))).drop("pages")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted conversations, and conversation -1."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(odd).alias("text"),
    )
    out = format_conversations(rows.unionByName(extra))
    out = with_loss(out.withColumn("turns", read_turns(F.col("formatted"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).cast("binary"), 256
        ).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
