"""Chat formatting: every participant's view of a dialogue.

For each participant the dialogue is rendered with that speaker as the assistant and
all others as named users; system turns stay what they are. A loss mask covers what the
assistant says and the end tag after it. Long dialogues come in blocks of turns, each
with its place in the whole: the places are running sums of lengths, so that no
dialogue's texts are gathered in one task, only a block's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
OWN_HEAD, TAIL = f"{START}assistant\n", f"{END}\n"
BLOCK_TURNS = 256
#: Blocks whose lengths are summed in one task.
SPAN = 4096


def _safe(text: Column) -> Column:
    """Text in which no control tag can be read: ``<|`` becomes ``<\\|``."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def perspectives(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    context_roles: tuple[str, ...] = ("system",),
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """One row for each dialogue, participant and block of turns.

    Returns conv_id, participant, block, n_turns, char_offset (of the block in the whole
    rendering), text, masks (array of start and end, in characters of the whole) and
    mask_chars. Participants are the distinct roles without ``context_roles``; null and
    empty roles are one participant, "unknown". A block holds turns whose number falls
    into the same span of ``block_turns``; null turn numbers form a block of their own
    that comes first (these turns, and those of one repeated number, are one row by definition). Ties of turn number are ordered by role, then text (nulls first);
    repeated rows stay. A null text is empty. Rows with a null conversation form one
    dialogue. A dialogue of context turns only has no participant and gives no row; so
    does an empty table. Other columns are not read.
    """
    role = F.when(F.coalesce(F.trim(role_col), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(role_col))
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("long").alias("__turn"),
        role.alias("__role"),
        _safe(F.col(text_col)).alias("__text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("__turn") / block_turns), F.lit(-1)).cast("long"))
    turns = turns.withColumn("__null", F.col("conv_id").isNull()).withColumn("__key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    at = ["__null", "__key", "block"]
    parties = _parties(turns, context_roles)
    turn = F.struct(F.col("__turn").alias("t"), F.col("__role").alias("r"), F.col("__text").alias("x"))
    # Texts move once, to their blocks; the participants with their offsets come to the blocks.
    blocks = turns.groupBy(*at).agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("__turns"))
    blocks = blocks.join(parties, at).select("conv_id", "block", "__turns", F.explode("__parties").alias("__p"))
    blocks = blocks.select("*", F.col("__p.participant").alias("participant"), F.col("__p.start").alias("char_offset"))
    own = lambda x: x["r"] == F.col("participant")
    heads = F.transform("__turns", lambda x: F.when(own(x), F.lit(OWN_HEAD)).otherwise(_head(x["r"], context_roles)))
    parts = F.zip_with("__turns", heads, lambda x, h: F.struct(F.concat(h, x["x"], F.lit(TAIL)).alias("s"), F.length(h).alias("h"), own(x).alias("m")))
    blocks = blocks.withColumn("__parts", parts).withColumn("text", F.array_join(F.transform("__parts", lambda x: x["s"]), ""))
    ends = F.aggregate(
        "__parts",
        F.array().cast("array<long>"),
        lambda a, x: F.concat(a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x["s"])).cast("long"))),
    )
    spans = F.filter(
        F.zip_with(
            "__parts",
            ends,
            lambda x, e: F.when(
                x["m"],
                F.struct(
                    (F.col("char_offset") + e - F.length(x["s"]) + x["h"]).cast("long").alias("start"),
                    (F.col("char_offset") + e - 1).cast("long").alias("end"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    out = blocks.withColumn("masks", spans)
    chars = F.aggregate("masks", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("conv_id", "participant", "block", F.size("__turns").cast("long").alias("n_turns"), "char_offset", "text", "masks", chars.alias("mask_chars"))


def _head(role: Column, context_roles: tuple[str, ...]) -> Column:
    """What stands before a turn of ``role`` where it is not the assistant's."""
    plain = F.concat(F.lit(START), role, F.lit("\n"))
    return F.when(role.isin(*context_roles), plain).otherwise(F.concat(F.lit(f"{START}user name="), _safe(role), F.lit("\n")))


def _parties(turns: DataFrame, context_roles: tuple[str, ...]) -> DataFrame:
    """For each block (``__null``, ``__key``, ``block``) the array ``__parties`` of participants and the characters before the block in their rendering.

    Only counts and lengths move here, one row for each block and role. The running sums are
    formed in spans of SPAN blocks first, so that a long dialogue is not one task's.
    """
    key = ["__null", "__key"]
    by_role = turns.groupBy(*key, "block", "__role").agg(F.count(F.lit(1)).alias("__n"), F.sum(F.length("__text").cast("long")).alias("__chars"))
    head = F.length(_head(F.col("__role"), context_roles))
    sizes = by_role.withColumn("__all", F.col("__chars") + F.col("__n") * (head + len(TAIL)))
    speaks = F.when(~F.col("__role").isin(*context_roles), F.struct(F.col("__role").alias("participant"), (F.col("__n") * (len(OWN_HEAD) - head)).alias("more")))
    sizes = sizes.groupBy(*key, "block").agg(F.sum("__all").alias("__size"), F.collect_list(speaks).alias("__own"))
    sizes = sizes.withColumn("__span", F.floor(F.col("block") / SPAN))
    speakers = turns.where(~F.col("__role").isin(*context_roles)).select(*key, F.col("__role").alias("participant")).distinct()
    # a conversation's spans with its participants, then the blocks of each span
    spans = sizes.select(*key, "__span").distinct().join(speakers, key)
    rows = sizes.join(spans, [*key, "__span"])
    more = F.aggregate(F.filter("__own", lambda x: x["participant"] == F.col("participant")), F.lit(0).cast("long"), lambda a, x: a + x["more"])
    rows = rows.select(*key, "__span", "block", "participant", (F.col("__size") + more).alias("__len"))
    who = [*key, "participant"]
    order = Window.rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*who, "__span").agg(F.sum("__len").alias("__len"))
    before = whole.select(*who, "__span", F.coalesce(F.sum("__len").over(order.partitionBy(*who).orderBy("__span")), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__len").over(order.partitionBy(*who, "__span").orderBy("block")), F.lit(0))
    rows = rows.withColumn("__inside", inside).join(before, [*who, "__span"])
    party = F.struct("participant", (F.col("__before") + F.col("__inside")).cast("long").alias("start"))
    return rows.groupBy(*key, "block").agg(F.collect_list(party).alias("__parties"))
