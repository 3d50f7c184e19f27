"""Chat formatting after cumulative-snapshot collapse.

Chat logs hold a conversation again each time it grows. Every turn gets the hash of
all turns up to it: the sum over these turns of two 64-bit hashes of (place, role,
text), which prefixes share exactly if their turns agree. Conversations equal as a
whole keep the smallest id; those whose hash is that of a shorter prefix of another
one are dropped by an anti join. What is left is rendered turn by turn.

Places and sums are built from blocks of turns, joined by their totals, so that a
conversation with very many turns is spread over tasks; no conversation is gathered.

Defined results: exactly repeated rows count once; turns of equal number are ordered
by role and text, null first; null role and null text are values of their own and are
rendered as empty; a null conv_id is a conversation like others; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promospark.llm.common import cut

BLOCK = 256


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.coalesce("role", F.lit("")),
                      F.col("text").isNull(), F.coalesce("text", F.lit("")))


def _place_hash(column: str) -> Column:
    return F.xxhash64("place", column).cast("decimal(20,0)")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, place, p1, p2): each turn's place and the hashes up to it."""
    slim = turns.select("conv_id", "turn", _turn_hash(1).alias("h1"), _turn_hash(2).alias("h2"), "role", "text")
    keys = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = (slim.withColumn("block", F.floor(F.coalesce("turn", F.lit(0)) / BLOCK))
              .withColumn("in_block", F.row_number().over(keys)).drop("role", "text"))
    placed = cut(placed)
    earlier = Window.partitionBy("o_conv", "o_block_group").orderBy("o_block").rowsBetween(Window.unboundedPreceding, -1)

    def with_earlier(df: DataFrame, totals: dict[str, Column]) -> DataFrame:
        blocks = df.groupBy("conv_id", "block").agg(*[c.alias(f"o_{k}") for k, c in totals.items()]).select(
            F.col("conv_id").alias("o_conv"), F.col("block").alias("o_block"), F.lit(0).alias("o_block_group"),
            *[f"o_{k}" for k in totals])
        before = blocks.select("o_conv", "o_block", *[
            F.coalesce(F.sum(f"o_{k}").over(earlier), F.lit(0)).alias(f"before_{k}") for k in totals])
        return df.join(before, F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("block") == F.col("o_block"))
                       ).drop("o_conv", "o_block")

    placed = (with_earlier(placed, {"n": F.count(F.lit(1))})
              .withColumn("place", F.col("before_n") + F.col("in_block")).drop("before_n")
              .withColumn("e1", _place_hash("h1")).withColumn("e2", _place_hash("h2")))
    so_far = Window.partitionBy("conv_id", "block").orderBy("place")
    summed = with_earlier(placed, {"e1": F.sum("e1"), "e2": F.sum("e2")})
    return summed.select("conv_id", "turn", "h1", "h2", "place", *[
        (F.col(f"before_e{i}") + F.sum(f"e{i}").over(so_far)).cast("decimal(38,0)").alias(f"p{i}") for i in (1, 2)])


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that no other one continues or, with a smaller id, equals."""
    whole = hashed.groupBy("conv_id").agg(F.max("place").alias("n_turns"),
                                          F.max_by(F.struct("p1", "p2"), "place").alias("p"))
    chosen = whole.groupBy("n_turns", "p.p1", "p.p2").agg(F.min(F.struct(F.col("conv_id").alias("id"))).alias("c"))
    ends = whole.select(F.col("conv_id").alias("w_conv"), "n_turns")
    prefixes = (hashed.join(ends, F.col("conv_id").eqNullSafe(F.col("w_conv"))).where(F.col("place") < F.col("n_turns"))
                .select(F.col("place").alias("n_turns"), "p1", "p2").distinct())
    return chosen.join(prefixes, ["n_turns", "p1", "p2"], "left_anti").select(
        F.col("c.id").alias("conv_id"), "n_turns")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")),
                    F.lit("<|im_end|>\n"))


def formatted_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn of the maximal conversations, in ``place`` order the rendered text."""
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                                 F.col("text").cast("string").alias("text")).distinct()
    hashed = cut(prefix_hashes(turns))
    kept = maximal_conversations(hashed).withColumnRenamed("conv_id", "k_conv")
    places = (hashed.join(kept, F.col("conv_id").eqNullSafe(F.col("k_conv")))
              .select(F.col("conv_id").alias("k_conv"), F.col("turn").alias("k_turn"), F.col("h1").alias("k1"),
                      F.col("h2").alias("k2"), "place", "n_turns"))
    keyed = turns.withColumn("h1", _turn_hash(1)).withColumn("h2", _turn_hash(2))
    return (keyed.join(places, F.col("conv_id").eqNullSafe(F.col("k_conv")) & F.col("turn").eqNullSafe(F.col("k_turn"))
                       & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
            .select("conv_id", F.col("place").cast("long").alias("place"), F.col("n_turns").cast("long").alias("n_turns"),
                    "role", render(F.col("role"), F.col("text")).alias("rendered"),
                    (F.coalesce("role", F.lit("")) == "assistant").alias("is_target")))
