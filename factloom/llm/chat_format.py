"""Logged conversations without their snapshots, rendered as one text each.

A log that saves a chat after each turn holds every beginning of it as a conversation of its own. Each turn gets a hash of its
role, text and place; the XOR of a conversation's first n of them is the hash of its prefix of n turns. A conversation whose
whole hash is a proper prefix of a longer one is a snapshot and goes (an anti-join of whole hashes against prefix hashes).
Two 64-bit hashes and n are compared, so with N prefixes a chance meeting has odds of about N^2 / 2^129. Only hashes are dealt for
that; texts are moved once, those of the conversations that stay.

Equal conversations are no snapshots of each other: all stay, and first_id (the smallest conv_id among them) tells copies apart.
They are joined to their class by _spread, so that one conversation logged very often is not dealt to one task.

Turns are ordered by turn (nulls first), then role, then text; a repeated row (same conv_id, turn, role and text) counts once.
Null roles and texts are empty. Ids and turns that are no numbers count as null. Each different row with a null conv_id is a conversation of its own. An empty table gives an empty
result. Texts are not escaped. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from factloom.llm.common import stored
from factloom.llm.parity_join import _spread

KEY = ["id", "alone"]  # alone tells rows with a null conv_id apart; else 0


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def _turns(rows: DataFrame) -> DataFrame:
    """The different turns as hashes. Only those that share place and role with another one keep their text, for their order."""
    place = [*KEY, "turn", "role"]
    ends = [f(h).alias(f"{name}_{h}") for h in ("h1", "h2") for name, f in (("least", F.min), ("most", F.max))]
    places = stored(rows.groupBy(*place).agg(*ends), "turns")  # drops repeated rows before they are dealt
    alone = (F.col("least_h1") == F.col("most_h1")) & (F.col("least_h2") == F.col("most_h2"))
    turns = places.where(alone).select(*place, F.col("least_h1").alias("h1"), F.col("least_h2").alias("h2"), F.lit(None).cast("string").alias("text"))
    shared = places.where(~alone).select(*[F.col(c).alias(f"of_{c}") for c in place])
    if shared.isEmpty():
        return turns
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in place]
    return turns.unionByName(rows.join(shared, same, "left_semi").select(*turns.columns).distinct())


def collapse(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, first_id (the smallest id of its equals) and text of each conversation that is not the beginning of another."""
    rows = turns.select(F.col(conv_id).try_cast("long").alias("conv_id"), F.col(turn).try_cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    rows = rows.withColumns({f"h{i}": F.xxhash64(F.lit(i), "role", "text") for i in (1, 2)})
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64(F.col("turn").isNull(), "turn", "h1", "h2")).otherwise(F.lit(0).cast("long"))
    rows = rows.select(F.coalesce("conv_id", F.lit(0)).alias("id"), alone.alias("alone"), "turn", "role", "h1", "h2", "text")

    order = W.partitionBy(*KEY).orderBy("turn", "role", "text")
    placed = _turns(rows).withColumn("n", F.row_number().over(order))
    rolling = [F.bit_xor(F.xxhash64(F.lit(i), "n", f"h{i}")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) for i in (1, 2)]
    prefixes = placed.select(*KEY, F.struct("n", *[r.alias(f"r{i}") for i, r in enumerate(rolling)]).alias("prefix"), F.lead("n").over(order).isNull().alias("whole"))
    prefixes = stored(prefixes, "prefixes")

    whole = prefixes.where("whole").drop("whole")
    of_id = F.when(F.col("alone") == 0, F.col("id"))
    classes = whole.groupBy("prefix").agg(F.min(of_id).alias("first_id"), F.lit(True).alias("stays"))
    classes = stored(classes.join(prefixes.where("not whole").select("prefix").distinct(), "prefix", "left_anti"), "classes")
    kept = _spread(whole, classes, "prefix").where("stays").select(*KEY, "first_id")

    # a set is made in each task before rows are dealt, so that rows repeated very often move once from each
    chats = rows.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("said")).join(kept, KEY)
    chat = F.array_join(F.transform("said", lambda x: rendered(x["role"], x["text"])), "")
    return chats.select(of_id.alias("conv_id"), F.size("said").alias("n_turns"), "first_id", chat.alias("text"))
