"""Dialogues rendered once from the perspective of each participant, with masks of what that participant says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS_PER_PART = 64
HEAD, END = "<|", "<|end|>\n"


def name(role: Column) -> Column:
    """A speaker as it appears in a header: characters other than letters, digits, ``_``, ``-`` become ``_``."""
    return F.regexp_replace(speaker(role), r"[^\p{L}\p{N}_-]", "_")


def speaker(role: Column) -> Column:
    """Who speaks: the role as it is but for spaces around it; null and empty ones are ``unknown``."""
    bare = F.trim(role)
    return F.when(bare.isNull() | (bare == ""), F.lit("unknown")).otherwise(bare)


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 instructions: str = "system", turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Rows (conv, perspective, part, n_turns, rendered, masks) for every participant of every conversation.

    Every speaker but ``instructions`` is a participant; in its perspective its turns are the assistant's, those of
    others are ``user name=...``, instructions stay. ``masks`` are (start, end) in code points of ``rendered``, end
    exclusive: the text of that participant's turns and the end mark. Speakers that differ in any character are different
    participants, even where the headers, which show ``name``, write them alike; null and empty roles are one.

    A conversation is rendered in parts of ``turns_per_part`` turn numbers, so that one of any length is spread over
    tasks; parts in order, joined, are the whole dialogue. Within a part turns go by number (null last, in part -1
    which comes last), then role and text. A null text is empty. A conversation with instructions alone gives no rows;
    an empty table gives none. Extra columns are ignored.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.floor(F.col(turn) / turns_per_part), F.lit(-1)).alias("part"),
        F.col(turn).isNull().alias("_late"), F.col(turn).alias("_turn"), speaker(F.col(role)).alias("_who"), name(F.col(role)).alias("_name"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"))
    speakers = said.where(F.col("_who") != instructions).select("conv_id", F.col("_who").alias("perspective")).distinct()
    parts = said.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(
        F.struct("_late", "_turn", "_who", "_text", "_name"))).alias("_said"))
    both = parts.withColumnRenamed("conv_id", "_conv").join(speakers, F.col("_conv").eqNullSafe(F.col("conv_id")))
    own = F.col("perspective")

    def rendered(x: Column) -> Column:
        header = F.when(x["_who"] == own, F.lit("assistant")).when(
            x["_who"] == instructions, F.lit(instructions)).otherwise(F.concat(F.lit("user name="), x["_name"]))
        head = F.concat(F.lit(HEAD), header, F.lit("|>\n"))
        body = F.concat(x["_text"], F.lit(END))
        return F.struct(head.alias("head"), body.alias("body"), (x["_who"] == own).alias("own"))

    def place(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        mask = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
        return F.struct(end.cast("int").alias("at"),
                        F.when(x["own"], F.concat(acc["masks"], F.array(mask))).otherwise(acc["masks"]).alias("masks"))

    pieces = F.transform("_said", rendered)
    begin = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,end:int>>").alias("masks"))
    return both.withColumn("_pieces", pieces).select(
        "conv_id", "perspective", F.col("part").cast("long").alias("part"), F.size("_said").cast("long").alias("n_turns"),
        F.array_join(F.transform("_pieces", lambda x: F.concat(x["head"], x["body"])), "").alias("rendered"),
        F.aggregate("_pieces", begin, place, lambda acc: acc["masks"]).alias("masks"))
