"""Chat formatting by perspective rotation.

A dialogue is rendered once for every participant: that speaker's turns are the assistant's, all other speakers are users
with their names, and the mask covers what the assistant says. Long dialogues are rendered in parts of ``TURNS`` turns, so no
row has to hold one that grows without bound. Each later part begins with the dialogue's opening system turns and
the last ``CONTEXT`` turns before it, outside the mask: every turn is trained on once. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.materialize import written_table
from gaugeflow.operators.ordered import running_totals

#: Turns in a part, and turns before it that a later part shows again.
TURNS, CONTEXT = 64, 8
SYSTEM, UNNAMED = "system", "unnamed"


def _plain(text: Column) -> Column:
    """Text that can't open or close a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(turn: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user:"), turn["name"], F.lit("|>\n"))
    return F.when(turn["name"] == SYSTEM, "<|system|>\n").when(turn["name"] == speaker, "<|assistant|>\n").otherwise(named)


TAIL = "<|end|>\n"


def _parts(rows: DataFrame, turns: int, context: int) -> DataFrame:
    """(conv_id, part, turns): the turns of each part in order, with ``kind`` 0 for opening, 1 for context, 2 for its own.

    Turns are numbered like any running total, so a dialogue that holds a third of all rows is cut too. A row gets at most the
    system turns of the first part, the context and its own turns.
    """
    numbered = written_table(
        running_totals(rows, ["conv_id"], ["turn", "name", "text"], {"place": F.lit(1).cast("long")}), "chat"
    ).withColumn("part", F.expr(f"(place - 1) div {turns}"))
    last = numbered.groupBy(F.col("conv_id").alias("conv")).agg(F.max("part").alias("last")).where("last > 0")
    opens = (F.col("part") == 0) & (F.col("name") == SYSTEM)
    longer = numbered.join(last, F.col("conv_id").eqNullSafe(F.col("conv")))
    row = ["conv_id", "part", "kind", "place", "name", "text"]
    opening = longer.where(opens).withColumns({"part": F.explode(F.sequence(F.lit(1).cast("long"), "last")), "kind": F.lit(0)})
    before = longer.where((F.col("part") < F.col("last")) & (F.col("place") > (F.col("part") + 1) * turns - context) & ~opens)
    before = before.withColumns({"part": F.col("part") + 1, "kind": F.lit(1)})
    own = numbered.withColumn("kind", F.lit(2))
    shown = own.select(row).unionByName(opening.select(row)).unionByName(before.select(row))
    return shown.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("kind", "place", "name", "text"))).alias("turns"))


def rotate_perspectives(conversations: DataFrame, turns: int = TURNS, context: int = CONTEXT) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask, n_masked) for every participant of every conversation.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. A participant is a role other than
    ``system``, trimmed; null and blank roles are the participant ``unnamed``. The ``mask`` lists start:end in code points of
    what the perspective's speaker says in the part's own ``n_turns`` turns, the closing mark included; a part in which that
    speaker is silent has an empty mask. Turns are ordered by number, nulls first, ties by role and text; repeated rows are repeated
    turns. Null conv_ids are one conversation. A conversation with nothing but system turns has no participant and gives no row;
    an empty table gives an empty result.
    """
    name = F.coalesce(F.nullif(F.trim(_plain(F.col("role"))), F.lit("")), F.lit(UNNAMED))
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), name.alias("name"), _plain(F.col("text")).alias("text")
    )
    parts = _parts(rows, turns, context)
    speakers = rows.where(F.col("name") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("name").alias("perspective")).distinct()
    speaker = F.col("perspective")
    joined = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(_head(t, speaker), t["text"], F.lit(TAIL)).alias("text"),
            F.when((t["name"] == speaker) & (t["kind"] == 2), F.char_length(_head(t, speaker))).alias("skip"),
        ),
    )
    # (end so far, mask so far): strings grow by one entry for each turn of the part.
    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("mask"), F.lit(0).alias("masked"))
    folded = F.aggregate(
        "pieces",
        start,
        lambda done, p: F.struct(
            (done["end"] + F.char_length(p["text"])).alias("end"),
            F.when(p["skip"].isNull(), done["mask"])
            .otherwise(
                F.concat(
                    done["mask"],
                    F.when(done["mask"] == "", "").otherwise(","),
                    (done["end"] + p["skip"]).cast("string"),
                    F.lit(":"),
                    (done["end"] + F.char_length(p["text"]) - 1).cast("string"),
                )
            )
            .alias("mask"),
            (done["masked"] + F.coalesce(F.char_length(p["text"]) - 1 - p["skip"], F.lit(0))).alias("masked"),
        ),
    )
    return (
        joined.withColumn("pieces", pieces)
        .withColumn("folded", folded)
        .select(
            "conv_id",
            "perspective",
            "part",
            F.size(F.filter("turns", lambda t: t["kind"] == 2)).alias("n_turns"),
            F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
            F.col("folded.mask").alias("mask"),
            F.col("folded.masked").alias("n_masked"),
        )
    )
