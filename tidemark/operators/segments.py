"""Scans along a key in segments: a block of rows (a day, say) is scanned by itself, and what it ends
with is carried to the blocks after it.

Only a row a block is ordered along a key, so a key that holds a third of all rows is as many tasks
as it has blocks.  Blocks must follow one another in the rows' order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_blocks(rows: DataFrame, keys: Sequence[str], block: str, carried: DataFrame) -> DataFrame:
    """``rows`` with the columns of a table of (keys, block); null keys meet."""
    own = [*keys, block]
    named = carried.select(*(F.col(c).alias(f"__b_{c}") for c in own), *(c for c in carried.columns if c not in own))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in own))
    return rows.join(named, same, "left").drop(*(f"__b_{c}" for c in own))


def _before(partition: Sequence[str], *order: str):
    return Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def last_before(rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: Column, to: str) -> DataFrame:
    """``rows`` with ``to``: the last non-null ``value`` of the rows before each one along (block, order) of its key."""
    held = rows.withColumn("__v", value)
    place = F.struct(*order)
    ends = held.groupBy(*keys, block).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), place)).alias("__end"))
    carried = ends.select(*keys, block, F.last("__end", ignorenulls=True).over(_before(keys, block)).alias("__carried"))
    within = F.last("__v", ignorenulls=True).over(_before([*keys, block], *order))
    return _with_blocks(held.withColumn("__within", within), keys, block, carried).withColumn(to, F.coalesce("__within", "__carried")).drop("__v", "__within", "__carried")


def sum_before(rows: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], value: Column, to: str) -> DataFrame:
    """``rows`` with ``to``: the sum of ``value`` over the rows before each one along (block, order) of its key, 0 if none."""
    held = rows.withColumn("__v", value)
    totals = held.groupBy(*keys, block).agg(F.sum("__v").alias("__total"))
    carried = totals.select(*keys, block, F.sum("__total").over(_before(keys, block)).alias("__carried"))
    within = F.sum("__v").over(_before([*keys, block], *order))
    found = _with_blocks(held.withColumn("__within", within), keys, block, carried)
    return found.withColumn(to, F.coalesce("__within", F.lit(0)) + F.coalesce("__carried", F.lit(0))).drop("__v", "__within", "__carried")
