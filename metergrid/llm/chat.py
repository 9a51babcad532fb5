"""Chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation several times, each time with a few turns more. Every turn gets a rolling hash of
the turns up to it. A conversation whose last hash is the hash of an earlier turn of another one is a prefix of it and
goes (an anti-join of hashes); of equal conversations the one with the smallest id stays. What stays is rendered.

All of it is DataFrame functions. The rolling hash is a running sum over the turns of one conversation, so a turn's
hash needs no more than its predecessors' sum: each turn is hashed with its place, and two independent sums of such
hashes are kept. Hashes travel instead of texts; equal prefixes are found by equal hashes and lengths. Copies are
grouped before the anti-join, so a conversation that many logs hold is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed words around a turn.
TURN = ("<|", "|>\n", "\n<|end|>\n")


def _turn_hash(seed: int, role: Column, text: Column) -> Column:
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), role, text, F.char_length(role).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(38,0)")


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, role, text): the turns numbered from 1, by turn, role and text. A row that repeats another one
    altogether counts once. Null roles and texts are empty; null turns come first. Rows without a conversation id
    are left out, since no conversation can be named for them."""
    rows = conversations.select(
        F.col(conv_id).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).where("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.distinct().withColumn("place", F.row_number().over(order)).drop("turn")


def prefix_hashes(numbered: DataFrame) -> DataFrame:
    """(conv, place, last, h): the hash of the turns up to each one; last marks the conversation's last turn.

    A turn's hash is mixed with its place, and the running sums of two such hashes identify the prefix: a sum over
    (place, role, text) that equal prefixes share and different ones share with a probability of about 2**-90."""
    upto = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("conv")
    key = F.concat_ws("\x1e", F.col("place").cast("string"), "role")
    sums = [F.sum(_turn_hash(s, key, F.col("text"))).over(upto).cast("string") for s in (1, 2)]
    return numbered.select("conv", "place", (F.col("place") == F.max("place").over(whole)).alias("last"), F.concat_ws("/", F.col("place").cast("string"), *sums).alias("h"))


def maximal(conversations: DataFrame, **columns: str) -> DataFrame:
    """(conv, place, role, text) of the conversations that are no prefix of another one."""
    numbered = turns(conversations, **columns)
    hashes = prefix_hashes(numbered)
    inner = hashes.where("NOT last").select("h").distinct()
    whole = hashes.where("last").groupBy("h").agg(F.min("conv").alias("conv"))
    kept = whole.join(inner, "h", "left_anti").select("conv")
    return numbered.join(kept, "conv", "left_semi")


def render(kept: DataFrame) -> DataFrame:
    """(conv, n_turns, chat): one text for each conversation, its turns in order. Texts are kept as they are, also where
    they hold the words that mark turns."""
    piece = F.concat(F.lit(TURN[0]), "role", F.lit(TURN[1]), "text", F.lit(TURN[2]))
    gathered = kept.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("piece")))).alias("pieces"))
    return gathered.select("conv", F.size("pieces").cast("long").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("chat"))
