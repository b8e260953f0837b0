"""Chat formatting by multi-party perspective rotation.

Every participant of a conversation (every role but ``system``) is once the assistant; the others are users named by their
role, and system turns stay what they are. A rendered dialogue is given as one row per turn: its rendered text, its place
in the dialogue's string, and whether it is trained on (the assistant's own turns are). So a very long conversation is
never one value; ``dialogues`` puts turns together to parts of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
#: Turns of a part in a running sum.
PART = 256


def rendered(role: Column, speaker: Column, text: Column) -> Column:
    """One turn as seen by speaker: <|role|> or <|user name|>, the text, <|end|>."""
    head = F.when(role == SYSTEM, F.lit("<|system|>")).when(role == speaker, F.lit("<|assistant|>")).otherwise(F.concat(F.lit("<|user "), role, F.lit("|>")))
    return F.concat(head, F.lit("\n"), text, F.lit("<|end|>\n"))


def perspectives(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to one row per conversation, speaker and turn.

    Columns: conv_id, speaker, turn, position (from 0), chat_role, name, content, segment, start_char, end_char, trained.
    Turns go by turn, then role and text; null turns come last, in that order. A null role is the participant
    ``unknown``, a null text is empty, a null conv_id is one conversation. Repeated rows are turns each. A conversation
    of system turns alone has no participant and gives no rows; an empty table gives none. A very long text is one segment.
    Other columns stay out, whatever their names.
    """
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # turns without a number are in parts of their order too: by role and how the text begins
    unnumbered = F.when(F.col("turn").isNull(), F.concat(F.col("role"), F.lit("\0"), F.substring("text", 1, 2))).otherwise("")
    t = t.withColumn("part", F.struct(F.coalesce(F.floor(F.col("turn") / PART), F.lit(1 << 62)).alias("number"), unnumbered.alias("begin")))
    # a null conv_id is a key like any other
    t = t.withColumn("key", F.xxhash64("conv_id", F.col("conv_id").isNull()))
    speakers = t.filter(F.col("role") != SYSTEM).groupBy("key", "role").agg(F.count("*").alias("own")).select("key", F.col("role").alias("speaker"))
    seen = t.join(speakers, "key").withColumn("segment", rendered(F.col("role"), F.col("speaker"), F.col("text")))
    chars = F.length("segment")
    parts = seen.groupBy("key", "speaker", "part").agg(F.sum(chars).alias("c"), F.count("*").alias("n"))
    w = Window.partitionBy("key", "speaker").orderBy("part")
    parts = parts.select("key", "speaker", "part", (F.sum("c").over(w) - F.col("c")).alias("c0"), (F.sum("n").over(w) - F.col("n")).alias("n0"))
    order = Window.partitionBy("key", "speaker", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    out = seen.withColumn("n", F.row_number().over(Window.partitionBy("key", "speaker", "part").orderBy(F.col("turn").asc_nulls_last(), "role", "text")) - 1).withColumn("c", F.sum(chars).over(order))
    out = out.join(parts, ["key", "speaker", "part"])
    own, system = F.col("role") == F.col("speaker"), F.col("role") == SYSTEM
    return out.select(
        "conv_id",
        "speaker",
        "turn",
        (F.col("n") + F.col("n0")).cast("long").alias("position"),
        F.when(system, "system").when(own, "assistant").otherwise("user").alias("chat_role"),
        F.when(~system & ~own, F.col("role")).alias("name"),
        F.col("text").alias("content"),
        "segment",
        (F.col("c0") + F.col("c") - chars).cast("long").alias("start_char"),
        (F.col("c0") + F.col("c")).cast("long").alias("end_char"),
        own.alias("trained"),
    )


def dialogues(segments: DataFrame, most_chars: int = 1 << 20) -> DataFrame:
    """One row per conversation, speaker and part: text and the stretches [start, end) of it that are trained on.

    A dialogue of at most most_chars characters is one part, 0. A longer one is cut between turns, where every most_chars
    characters a part begins; a turn longer than that ends its part.
    """
    part = F.floor(F.col("start_char") / most_chars).alias("part")
    one = segments.groupBy("conv_id", "speaker", part).agg(F.array_sort(F.collect_list(F.struct("position", "segment", "start_char", "end_char", "trained"))).alias("s"))
    first = F.element_at("s", 1)["start_char"]
    spans = F.transform(F.filter("s", lambda x: x["trained"]), lambda x: F.struct((x["start_char"] - first).alias("start"), (x["end_char"] - first).alias("end")))
    return one.select("conv_id", "speaker", "part", F.concat_ws("", F.transform("s", lambda x: x["segment"])).alias("text"), spans.alias("mask"))
