"""Chat formatting: logged conversations that are prefixes of longer ones collapse, the rest are rendered.

Chat logs hold cumulative snapshots: a conversation is logged after each turn. A turn's hash covers its place, role
and text; the rolling hash of a prefix combines the hashes of its turns (two independent 64-bit hashes, combined
by exclusive or over a running window, so a prefix of k turns is known by k and 128 bits). A conversation whose
full hash is the hash of a proper prefix of another is dropped by an anti-join; of identical ones the smallest
conv_id stays. Prefix hashes are made distinct before the join, so a first turn that a third of all
conversations share is one row of it. Rendering gathers the turns of kept conversations only; a rendered
conversation is one value by nature.

Edge cases: turns are ordered by (turn, role, text), nulls first; null roles and texts are empty but differ from
empty ones in hashes. Repeated rows are turns of their own. A null conv_id is one conversation. Empty tables give
empty results. Further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: How a turn is rendered: a fixed format.
TURN = "<|{role}|>\n{text}\n<|end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place (from 1), h1 and h2: rolling hashes of the prefix that ends here."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    # a null is told apart from the empty text
    parts = [F.col("place"), F.coalesce(F.concat(F.lit("+"), "role"), F.lit("")), F.coalesce(F.concat(F.lit("+"), "text"), F.lit(""))]
    so_far = W.partitionBy("conv_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rolling = [F.bit_xor(F.xxhash64(F.lit(seed), *parts)).over(so_far).alias(f"h{seed}") for seed in (1, 2)]
    return rows.select("conv_id", "role", "text", "place", *rolling)


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one extends."""
    ends = prefixes.groupBy(F.col("conv_id").alias("own")).agg(F.max("place").alias("n_turns"))
    marked = prefixes.select("conv_id", "place", "h1", "h2").join(ends, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
    whole = marked.where("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = marked.where("place < n_turns").select("place", "h1", "h2").distinct()
    kept = whole.join(inner, ["place", "h1", "h2"], "left_anti")
    return kept.select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat for every maximal conversation."""
    prefixes = written(turn_prefixes(turns), "prefixes")
    kept = written(maximal(prefixes), "maximal")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    one = F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))
    turns_of = prefixes.select("conv_id", "place", one.alias("said")).join(kept.select(F.col("conv_id").alias("own")), F.col("conv_id").eqNullSafe(F.col("own")), "left_semi")
    chats = turns_of.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "").alias("chat"))
    joined = kept.join(chats.withColumnRenamed("conv_id", "own"), F.col("conv_id").eqNullSafe(F.col("own")))
    return joined.select("conv_id", "n_turns", "n_copies", "chat")
