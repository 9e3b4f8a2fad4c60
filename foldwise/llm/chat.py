"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users, with the spans that bear loss (the speaker's own
turns). A rendering is returned in blocks of consecutive turns with the character offset
of each block, so a conversation that holds a large share of all turns is no single row;
the blocks of one perspective joined in order are its rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stash
from foldwise.operators.rank import prefix_sums

BLOCK_TURNS = 32
NO_ROLE = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SUPER = 256  # blocks whose sizes are added up first


def escaped(text: Column) -> Column:
    """Control marks inside a message are broken up, so no message can end its own turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv_id, speaker, block, n_turns, char_start, text, loss_spans) for every participant.

    Turns are ordered by (turn, role, text), nulls first; ties and repeated rows are all
    kept. ``block`` is turn div ``block_turns`` (a null turn: block -1). A null role is the
    speaker ``unknown``, a null text is empty, null conversation keys are one conversation.
    ``loss_spans`` are half-open character ranges within the block's text: the content and
    end mark of the speaker's turns, as an array of (begin, end).
    """
    m = turns.select(
        turns[conv_col].alias("conv_id"), turns[turn_col].cast("long").alias("turn"),
        F.coalesce(turns[role_col].cast("string"), F.lit(NO_ROLE)).alias("role"),
        escaped(turns[text_col].cast("string")).alias("body"))
    m = m.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-1)).cast("long"))
    speakers = m.select("conv_id", F.col("role").alias("speaker")).distinct()
    blocks = m.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"),
                                             "role", "body"))).alias("turns"))
    j = blocks.join(speakers.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")

    def part(t: Column) -> Column:
        own = t["role"] == F.col("speaker")
        head = F.concat(F.lit(OPEN), F.when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), escaped(t["role"]))),
                        F.lit("\n"))
        tail = F.concat(t["body"], F.lit(CLOSE), F.lit("\n"))
        return F.struct(F.concat(head, tail).alias("s"), own.alias("own"), F.length(head).alias("head"),
                        (F.length(head) + F.length(tail)).alias("size"))

    rendered = j.select("conv_id", "speaker", "block", F.transform("turns", part).alias("p"))
    start = F.aggregate(  # where each turn begins in the block
        F.col("p"), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))
    rendered = rendered.withColumn("a", start)
    spans = F.filter(F.zip_with("p", "a.starts", lambda x, at: F.struct(
        F.when(x["own"], at + x["head"]).alias("begin"), (at + x["size"] - 1).alias("end"))), lambda s: s["begin"].isNotNull())
    rendered = rendered.select(
        "conv_id", "speaker", "block", F.size("p").alias("n_turns"), F.col("a.at").cast("long").alias("size"),
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("text"), spans.alias("loss_spans"))
    rendered = stash(rendered.withColumn("super", F.floor(F.col("block") / SUPER)), "chat")
    sizes = rendered.select(F.col("conv_id").isNull().alias("no_conv"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
                            "speaker", "super", "block", "size")
    at = prefix_sums(sizes, ["size"], ["super"], ["block"], ["no_conv", "conv", "speaker"]).select(
        F.when(~F.col("no_conv"), F.col("conv")).cast(rendered.schema["conv_id"].dataType).alias("_c"), F.col("speaker").alias("_s"), F.col("block").alias("_b"),
        F.col("before_size").alias("char_start"))
    out = rendered.join(at, rendered["conv_id"].eqNullSafe(at["_c"]) & (rendered["speaker"] == at["_s"]) &
                        (rendered["block"] == at["_b"]))
    return out.select("conv_id", "speaker", "block", "n_turns", "char_start", "text", "loss_spans")
