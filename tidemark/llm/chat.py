"""Chat formatting after collapsing cumulative snapshots.

Chat logs often hold a conversation again after every turn.  Every prefix of every conversation
gets a rolling hash of its turns; a conversation whose own hash is a proper prefix of a longer one
goes (anti-join), as do exact copies but one.  What is left is rendered.

Prefix hashes are 128 bits: two XORs of 64-bit hashes of (turn, role, text).  Turns are dealt to
blocks by ranges of (conversation, turn, role, text), so a conversation that holds a third of all
rows, or whose turns share one number, is as many blocks as it needs.  Rows are numbered and hashed
within their block; block totals, one row a block, carry number and prefix from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Turns in a rendered part.
PART = 64
#: Characters of a text that its block is chosen by (bounds of ranges pass through the driver).
LEAD = 64


def _hash(seed: int) -> Column:
    parts = [x for c in ("turn", "role", "text") for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(F.lit(seed), *parts)


def _blocks(turns: DataFrame) -> DataFrame:
    """The distinct turns with their hashes and their ``block``; written, as ranges are drawn anew on every run."""
    light = turns.select("conv_id", "turn", "role", "text").distinct().withColumns({"h1": _hash(1), "h2": _hash(2)})
    light = light.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, LEAD))
    return checkpointed(light.withColumn("block", F.spark_partition_id()))


def _numbered(light: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the turns, their place ``k`` in the conversation (from 1), its ``size``, and the prefix hashes ``p1``, ``p2``."""
    upto = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    inside = light.select(*columns, "block", *(F.bit_xor(h).over(upto).alias(h) for h in ("h1", "h2")), F.count("*").over(upto).alias("k"))
    totals = light.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("conv_id").alias("of"), F.col("block").alias("at"),
        *(F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(b) for b in ("b1", "b2")),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("size"),
    )
    both = inside.join(carried, inside["conv_id"].eqNullSafe(carried["of"]) & (inside["block"] == carried["at"]))
    prefixes = (F.col(h).bitwiseXOR(F.col(b)).alias(p) for h, b, p in (("h1", "b1", "p1"), ("h2", "b2", "p2")))
    return both.select(*columns, "size", (F.col("k") + F.col("before")).alias("k"), *prefixes)


def _maximal(light: DataFrame) -> DataFrame:
    prefixes = _numbered(light, "conv_id")
    whole = prefixes.where("k = size").groupBy("k", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("k < size").select("k", "p1", "p2").distinct()
    return whole.join(proper, ["k", "p1", "p2"], "left_anti").select("conv_id")


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations (conv_id, turn, role, text) that prefix no longer one.

    Rows with the same turn number follow by role and text, nulls first.  Of conversations with
    the same turns the smallest id stays.
    """
    return _maximal(_blocks(turns))


def _guarded(x: Column) -> Column:
    """Text in which no template mark can begin."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def render(turns: DataFrame, template: str = "<|im_start|>{role}\n{text}<|im_end|>\n") -> DataFrame:
    """``conv_id``, ``part``, ``n_turns`` and ``text``: the maximal conversations in parts of ``PART`` turns, numbered from 0.

    The parts of a conversation, in order, make up its whole rendering.  A turn repeated whole is
    rendered once; turns follow by number, role and text, nulls first.  A null role reads
    ``unknown``, a null text is empty.  Rows with a null conv_id are a conversation of their own.
    Marks of the template inside a text are broken up.  Other columns are not read; an empty table
    gives an empty table.
    """
    light = _blocks(turns)
    kept = _maximal(light).withColumnRenamed("conv_id", "kept")
    whole = light.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")  # all turns of what is kept, and of nothing else
    own = _numbered(whole, "conv_id", "role", "text")
    before, _, rest = template.partition("{role}")
    middle, _, after = rest.partition("{text}")
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    shown = F.concat(F.lit(before), _guarded(role), F.lit(middle), _guarded(text), F.lit(after))
    parts = own.groupBy("conv_id", F.floor((F.col("k") - 1) / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("k", shown.alias("shown")))).alias("turns"))
    return parts.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.shown"), "").alias("text"))
