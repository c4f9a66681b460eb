r"""Chat formatting with Spark expressions only.

Every conversation becomes one string. The turns of a slice of SLICE turns are collected and sorted as
structs, adjacent turns of one role are merged by an array aggregation into a block, and the slices of
a conversation are then merged in the same way, so that no aggregation runs over more than a slice or
the blocks of a conversation. A block is

    ### role: text</turn>text</turn>

with one header for all its turns. In texts and roles a backslash becomes two, and "##" and "</turn>"
get a backslash inside; a colon in a role is written <\c>. Every conversation can be read back exactly. The loss
mask lists start and length, in code points, of each turn's text of the roles that are trained on.

Result: one row for each conv_id, NULL being one of them. NULL text and role are empty. Turns are
ordered by turn (NULL first), then role, then text; repeated rows are turns of their own. Other columns
are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER, COLON, END = "### ", ": ", "</turn>"
SLICE = 256


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("##"), F.lit("#\\#")), F.lit(END), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("<\\/turn>"), F.lit(END)), F.lit("#\\#"), F.lit("##"))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("<\\c>"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\c>"), F.lit(":")))


BLOCKS = "array<struct<role: string, texts: array<string>>>"


def merged(blocks: Column) -> Column:
    """Blocks in order, adjacent ones of one role as one: their first numbers, then the texts up to the next."""
    n = F.size(blocks)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(blocks, i)["role"] != F.get(blocks, i - 1)["role"]))
    ends = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(n))
    runs = F.arrays_zip(first.alias("first"), ends.alias("stop"))
    return F.when(
        n > 0,
        F.transform(
            runs,
            lambda r: F.struct(
                F.get(blocks, r["first"])["role"].alias("role"),
                F.flatten(F.transform(F.slice(blocks, r["first"] + 1, r["stop"] - r["first"]), lambda b: b["texts"])).alias("texts"),
            ),
        ),
    ).cast(BLOCKS)


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted and loss_spans (start and length in code points, and both in bytes) of every conversation."""
    rows = turns.select(
        "conv_id",
        F.floor(F.col("turn") / SLICE).alias("slice"),
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            escaped(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("one"),
    )
    slices = rows.groupBy("conv_id", "slice").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    singles = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts")))
    slices = slices.withColumn("blocks", singles).withColumn("blocks", merged(F.col("blocks")))
    whole = slices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("slice", "blocks"))).alias("slices"))
    whole = whole.withColumn("blocks", F.flatten(F.transform("slices", lambda s: s["blocks"]))).withColumn("blocks", merged(F.col("blocks")))
    head = lambda b: F.concat(F.lit(HEADER), escaped_role(b["role"]), F.lit(COLON))
    parts = F.transform(
        "blocks",
        lambda b: F.struct(
            F.concat(head(b), F.array_join(b["texts"], END), F.lit(END)).alias("string"),
            F.length(head(b)).alias("start"),
            F.octet_length(head(b)).alias("first_byte"),
            b["role"].isin(*trained).alias("loss"),
            F.transform(b["texts"], lambda t: F.struct(F.length(t).alias("length"), F.octet_length(t).alias("bytes"))).alias("sizes"),
        ),
    )
    whole = whole.withColumn("parts", parts)
    return whole.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: p["string"]), "").alias("formatted"),
        spans(F.col("parts")).alias("loss_spans"),
    )


SPANS = "array<struct<start: int, length: int, first_byte: int, bytes: int>>"


def spans(parts: Column) -> Column:
    """Place and size of every trained text: within its block first, then of the block in the conversation."""
    step = F.lit(len(END))
    within = F.transform(
        parts,
        lambda p: F.struct(
            F.length(p["string"]).alias("size"),
            F.octet_length(p["string"]).alias("bytes"),
            F.when(
                p["loss"],
                F.aggregate(
                    p["sizes"],
                    F.struct(p["start"].alias("at"), p["first_byte"].alias("byte"), F.array().cast(SPANS).alias("found")),
                    lambda s, n: F.struct(
                        (s["at"] + n["length"] + step).alias("at"),
                        (s["byte"] + n["bytes"] + step).alias("byte"),
                        F.concat(s["found"], F.array(span(s["at"], n["length"], s["byte"], n["bytes"]))).alias("found"),
                    ),
                    lambda s: s["found"],
                ),
            ).alias("found"),
        ),
    )
    return F.aggregate(
        within,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), F.array().cast(SPANS).alias("found")),
        lambda s, p: F.struct(
            (s["at"] + p["size"]).alias("at"),
            (s["byte"] + p["bytes"]).alias("byte"),
            F.when(p["found"].isNull(), s["found"])
            .otherwise(
                F.concat(
                    s["found"],
                    F.transform(p["found"], lambda x: span(x["start"] + s["at"], x["length"], x["first_byte"] + s["byte"], x["bytes"])),
                )
            )
            .alias("found"),
        ),
        lambda s: s["found"],
    )


def span(start: Column, length: Column, first_byte: Column, size: Column) -> Column:
    return F.struct(start.alias("start"), length.alias("length"), first_byte.alias("first_byte"), size.alias("bytes"))


def between(text: Column, first: Column, stop: Column) -> Column:
    return F.substring(text, first, stop - first)


def read_chats(chats: DataFrame, formatted: str = "formatted", into: str = "turns") -> DataFrame:
    """``chats`` with the turns (role, text) that the formatted conversations hold.

    The pieces between turn ends are a column of their own: inside a lambda they would be cut again for
    every turn.
    """
    ends = F.split(F.col(formatted), END)  # the last piece is empty
    cut = chats.withColumn("pieces__", F.slice(ends, F.lit(1), F.size(ends) - 1))
    pieces = F.col("pieces__")
    starts = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.startswith(F.get(pieces, i), F.lit(HEADER)))
    cut = cut.withColumn("starts__", F.when(F.size(pieces) > 0, starts))
    stops = F.concat(F.slice("starts__", F.lit(2), F.size("starts__")), F.array(F.size(pieces)))
    colon = lambda piece: F.instr(piece, COLON)  # noqa: E731  escaped roles have none
    role = lambda head: unescaped_role(between(head, F.lit(len(HEADER) + 1), colon(head)))
    runs = F.transform(
        F.arrays_zip(F.col("starts__").alias("first"), stops.alias("stop")),
        lambda r: F.struct(role(F.get(pieces, r["first"])).alias("role"), F.slice(pieces, r["first"] + 1, r["stop"] - r["first"]).alias("texts")),
    )
    cut = cut.withColumn("runs__", runs)
    text = lambda p, i: unescaped(F.when(i == 0, between(p, colon(p) + len(COLON), F.length(p) + 1)).otherwise(p))
    turns = F.transform("runs__", lambda r: F.transform(r["texts"], lambda p, i: F.struct(r["role"].alias("role"), text(p, i).alias("text"))))
    return cut.withColumn(into, F.flatten(turns)).drop("pieces__", "starts__", "runs__")


def masked(chats: DataFrame, into: str = "loss") -> DataFrame:
    """``chats`` with the text under the loss mask, as it was before escaping."""
    raw = chats.withColumn("raw__", F.encode("formatted", "UTF-8"))  # places in bytes are found at once
    part = lambda s: F.decode(F.substring(F.col("raw__"), s["first_byte"] + 1, s["bytes"]), "UTF-8")
    return raw.withColumn(into, F.array_join(F.transform("loss_spans", lambda s: unescaped(part(s))), "")).drop("raw__")
