"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's documents are dealt to shards by a hash of id and text and laid end to end in each shard,
in a seeded order; every ``BLOCK`` words of that line are a block.  The blocks of the whole mix
are allocated to sources, and each source's blocks to its shards, by highest quotients, so quotas
are whole numbers.  Each shard then takes its quota of blocks, spread over the line from a seeded
start, every block once or twice at most evenly.  Which blocks are taken has a closed form, so no
table of blocks is ever made.

Shards hold about ``SHARD_ROWS`` documents, however many a source has, so a source with a third
of all rows is spread over as many tasks as it needs.  A source's blocks go to bundles of
``BUNDLE`` shards first and from there to shards, so no task holds the totals of all its shards.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, n_words, whole_row

#: Relative weights of the sources in code point order, null last, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a multiple of all words, and of a source as a multiple of its own.
TOTAL, MOST = 1.5, 2.0
#: Words in a block.
BLOCK = 16
#: Documents in a shard, about.
SHARD_ROWS = 2_000
#: Shards in a bundle: a task apportions among so many, or among a source's bundles.
BUNDLE = 2_048
#: Distinct sources, whose totals the driver holds (a few dozen bytes each).
MOST_SOURCES = 1_000_000


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int]) -> list[int]:
    """Seats by highest quotients ``weight / (2 * seats + 1)``, none beyond its ``most``.

    Ties go to the earlier party.  Highest quotients give every party the seats whose quotients
    lie above some divisor; bisection finds one a few seats from the end, and those go one by one.
    """
    w, cap = np.asarray(weights, np.float64), np.asarray(most, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = min(seats, int(cap.sum()))
    if seats <= 0:
        return [0] * len(w)

    def above(quotient: float) -> np.ndarray:
        """Seats of each party whose quotients exceed ``quotient``: w / (2k + 1) > q."""
        return np.minimum(cap, np.maximum(0, np.ceil(np.minimum((w / quotient - 1) / 2, 2.0**62))).astype(np.int64))

    low, high = 0.0, float(w.max())  # no seat lies above the largest weight, all of them above nothing
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        n = above(middle).sum(dtype=np.float64)
        low, high = (low, middle) if n <= seats else (middle, high)
        if seats - len(w) <= n <= seats:
            break
    given = above(high).tolist()
    worth = lambda k, n: weights[k] / (2 * n + 1)
    # rounding in ``above`` can be a seat off; nothing given is worth less than what is taken next
    takes = [(-worth(k, given[k]), k) for k in range(len(w)) if given[k] < cap[k]]
    gives = [(worth(k, given[k] - 1), -k) for k in range(len(w)) if given[k]]
    heapq.heapify(takes)
    heapq.heapify(gives)
    left = seats - sum(given)

    def step(k: int, by: int) -> None:
        given[k] += by
        if given[k] < cap[k]:
            heapq.heappush(takes, (-worth(k, given[k]), k))
        if given[k]:
            heapq.heappush(gives, (worth(k, given[k] - 1), -k))

    while True:
        while takes and (given[k := takes[0][1]] >= cap[k] or -takes[0][0] != worth(k, given[k])):
            heapq.heappop(takes)  # no longer what that party would take next
        while gives and (not given[k := -gives[0][1]] or gives[0][0] != worth(k, given[k] - 1)):
            heapq.heappop(gives)
        if left > 0:
            step(heapq.heappop(takes)[1], 1)
            left -= 1
        elif left < 0:
            step(-heapq.heappop(gives)[1], -1)
            left += 1
        elif takes and gives and (-takes[0][0], -takes[0][1]) > (gives[0][0], gives[0][1]):
            (_, to), (_, of) = heapq.heappop(takes), heapq.heappop(gives)
            step(-of, -1)
            step(to, 1)
        else:
            return given


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, total: float = TOTAL, most: float = MOST) -> list[float]:
    """Words each source shall give: ``total`` times all words by weight, none above ``most`` times its own.

    What a source can't give is shared again among the others, by weight, until none is above.
    """
    own = [weights[k % len(weights)] for k in range(len(sizes))]
    found, rest, free = [0.0] * len(sizes), total * sum(sizes), set(range(len(sizes)))
    while free:
        share = rest / sum(own[k] for k in free)
        full = [k for k in free if own[k] * share > most * sizes[k]]
        for k in full or free:
            found[k] = most * sizes[k] if full else own[k] * share
        if not full:
            break
        rest -= sum(found[k] for k in full)
        free -= set(full)
    return found


def _quotas(parts: pd.DataFrame) -> pd.DataFrame:
    """Parts (rank, part, words, most) with their share ``quota`` of the ``seats`` they have together."""
    parts = parts.sort_values("part", ignore_index=True)
    quota = sainte_lague(parts["words"].tolist(), int(parts["seats"].iloc[0]), parts["most"].tolist())
    return parts.assign(quota=quota)[["rank", "part", "quota"]]


def _shard_quotas(shards: DataFrame, bundle: int) -> DataFrame:
    """Shards (rank, shard, words, seats of their source) with their ``blocks`` and ``quota``."""
    blocks = F.ceil(F.col("words") / BLOCK)
    shards = shards.withColumn("blocks", blocks).withColumn("bundle", F.floor(F.col("shard") / bundle))
    bundles = shards.groupBy("rank", "bundle").agg(F.sum("words").alias("words"), F.sum(2 * F.col("blocks")).alias("most"), F.first("seats").alias("seats"))
    shape = "rank int, part long, quota long"
    of_bundle = bundles.withColumnRenamed("bundle", "part").groupBy("rank").applyInPandas(_quotas, shape).select("rank", F.col("part").alias("bundle"), F.col("quota").alias("given"))
    parts = shards.join(of_bundle, ["rank", "bundle"]).select("rank", "bundle", F.col("shard").alias("part"), "words", (2 * F.col("blocks")).alias("most"), F.col("given").alias("seats"))
    of_shard = parts.groupBy("rank", "bundle").applyInPandas(_quotas, shape)
    return shards.select("rank", "shard", "blocks").join(of_shard.withColumnRenamed("part", "shard"), ["rank", "shard"])


def _taken_before(words: Column, blocks: Column, quota: Column, start: Column) -> Column:
    """Words taken of the first ``words`` words of a shard's line."""

    def chosen(k: Column) -> Column:
        """Copies of the blocks before block ``k``: (k * quota + start) div blocks."""
        at = k * quota + start
        return ((at - F.pmod(at, blocks)) / blocks).cast("long")

    whole = ((words - F.pmod(words, F.lit(BLOCK))) / BLOCK).cast("long")
    return chosen(whole) * BLOCK + F.pmod(words, F.lit(BLOCK)) * (chosen(whole + 1) - chosen(whole))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 7, columns: Sequence[str] | None = None, shard_rows: int = SHARD_ROWS, bundle: int = BUNDLE) -> DataFrame:
    """``columns`` of ``docs`` (default: all) with a struct ``mixed`` of size, source_size, target and taken.

    ``size`` is the row's words, ``taken`` the words the mix takes of it, repeats counted: from 0
    to twice its size.  Rows without words take part with size 0.  A null source is a source of its
    own.  The seeded order is that of a hash of key and text, so null or repeated keys are no hot
    shard.  Repeated rows are documents of their own that share a place in it; which of them comes
    first makes no difference to the rows returned.
    Reruns agree, whatever the partitioning.
    """
    keep = list(docs.columns if columns is None else columns)
    base = docs.select(whole_row(docs.select(*(f"`{c}`" for c in keep))).alias("row"), F.col(source).alias("source"), F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("body"), n_words(F.col(text)).alias("size"))
    if text not in keep:  # narrow rows: texts are read once
        base = checkpointed(base)
    totals = base.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    found = totals.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.words for r in found]
    want = targets(sizes)
    seats = sainte_lague(want, round(sum(want) / BLOCK), [2 * -(-w // BLOCK) for w in sizes])
    table = docs.sparkSession.createDataFrame(
        [(r.source, k, r.words, want[k], seats[k], max(1, -(-r.n // shard_rows))) for k, r in enumerate(found)],
        "source string, rank int, source_size long, target double, seats long, n_shards long",
    )
    at = base.join(F.broadcast(table), base["source"].eqNullSafe(table["source"])).drop("source")
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("key"), F.lit("")), "body")
    at = at.withColumn("order", order).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), "n_shards"))
    shards = checkpointed(at.groupBy("rank", "shard").agg(F.sum("size").alias("words"), F.first("seats").alias("seats")))  # read three times
    quotas = _shard_quotas(shards, bundle)
    line = Window.partitionBy("rank", "shard").orderBy("order", "key", "size")
    placed = at.withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(quotas, ["rank", "shard"])
    blocks = F.greatest(F.col("blocks"), F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "rank", "shard"), blocks)
    before = lambda words: _taken_before(words, blocks, F.col("quota"), start)
    taken = F.when(F.col("size") > 0, before(F.col("end")) - before(F.col("end") - F.col("size"))).otherwise(F.lit(0)).cast("long")
    return placed.select("row.*", F.struct("size", "source_size", "target", taken.alias("taken")).alias("mixed"))
