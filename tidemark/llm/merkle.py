"""Merkle manifest of a corpus: a tree of three for each source, a tree over the sources, a proof for each row.

Leaves are numbered along (source, id) by ranges, so no source is ordered by one task.  Trees are
built bottom up in hops of ``HOP`` levels: a stored node row holds the digests of those levels below
one node and a link to the row above.  A recursive query then climbs from every leaf, a hop a step,
appending the siblings it passes and folding the (perhaps tampered) hash.

All leaves meet the rows near the root.  A stored row is therefore repeated for each block of
``BLOCK`` neighbouring leaves below it, and a leaf asks with its block: no join key has more rows
than a block, and the repeats add a row a block and hop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .components import looked_up

#: Levels of a stored row, and leaves that share its repeat.
HOP, BLOCK = 3, 729
#: Up to so many sources, their rows (some 100 bytes) are broadcast; beyond, looked up by salted keys.
FEW_SOURCES = 100_000
#: Steps of the tree over the sources are numbered from here.
TOP = 100

_WIDTH = 3**HOP
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(text: Column) -> Column:
    """SHA-256 of a text's UTF-8, as bytes."""
    return F.unhex(F.sha2(text, 256))


def _none() -> Column:
    return F.lit(b"").cast("binary")


def joined(*digests: Column) -> Column:
    """The digest of digests put side by side as hexadecimal text; null ones are left out."""
    return digest_of(F.lower(F.hex(F.concat(*(F.coalesce(d, _none()) for d in digests)))))


def hexadecimal(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def record(fields: list[Column]) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value, of each field."""
    each = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (f.cast("string") for f in fields)]
    return F.concat(*each)


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, ``name`` (the source, so marked that null sorts first), ``leaf`` and the ``start`` of its climb, of each row.

    Rows whose id has an even CRC-32 are tampered with: their climb starts from the text without
    its line feeds.
    """
    given = [F.col(f"`{c}`") for c in _FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    damaged = [*given[:-1], F.when(even, F.replace(given[-1], F.lit("\n"), F.lit(""))).otherwise(given[-1])]
    name = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"), digest_of(record(given)).alias("leaf"), digest_of(record(damaged)).alias("start"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``g``, their place (from 0) along ``order``: ranges are sorted each by itself, then moved up by the sizes of those before."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # one row a task
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    found = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return found.withColumn("g", F.coalesce("before", F.lit(0)) + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__at", "before")


def _runs(level: Column) -> Column:
    """The digests of a level's runs of three."""
    starts = F.sequence(F.lit(0), ((F.size(level) - 1) / 3).cast("int"))
    return F.transform(starts, lambda i: joined(*(F.get(level, i * 3 + j) for j in range(3))))


def _hop(nodes: DataFrame) -> DataFrame:
    """Of nodes (tree, first, n, no, digest, low, high), the rows above ``_WIDTH`` of them each, with the digests of their levels.

    ``n`` is the number of nodes of the tree at this height: a tree that fits one row ends with it.
    """
    above = nodes.groupBy("tree", "first", "n", F.floor(F.col("no") / _WIDTH).cast("long").alias("no")).agg(
        F.sort_array(F.collect_list(F.struct("no", "digest"))).alias("below"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    above = above.withColumn("v0", F.transform("below", lambda x: x["digest"]))
    for k in range(HOP):
        above = above.withColumn(f"v{k + 1}", _runs(F.col(f"v{k}")))
    depth = sum((F.when(F.col("n") > 3**k, 1).otherwise(0) for k in range(1, HOP)), F.lit(1))
    levels = F.slice(F.array(*(f"v{k}" for k in range(HOP))), 1, depth)
    top = F.get(F.get(F.array(*(f"v{k}" for k in range(HOP + 1))), depth), F.lit(0))
    return above.select("tree", "first", "n", "no", levels.alias("levels"), top.alias("digest"), "low", "high")


def _trees(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored rows of every height, and (tree, digest, low, high) of the roots of all trees; a lone node is its own root."""
    kept = ["tree", "digest", "low", "high"]
    roots, rows = [nodes.where("n = 1").select(*kept)], []
    nodes = nodes.where("n > 1")
    while largest > 1:
        above = checkpointed(_hop(nodes))
        rows.append(above)
        roots.append(above.where(F.col("n") <= _WIDTH).select(*kept))
        nodes = above.where(F.col("n") > _WIDTH).withColumn("n", F.ceil(F.col("n") / _WIDTH))
        largest = math.ceil(largest / _WIDTH)
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return rows, found


def _stored(rows: DataFrame, step: Column, at: Column, next_at: Column, leads_on: Column, out: tuple[Column, Column, Column]) -> DataFrame:
    """Rows as the climb reads them, repeated for each block of leaves below; ``out`` is the link of a tree's last row."""
    link = [F.when(leads_on, a).otherwise(b) for a, b in zip((step + 1, next_at, F.col("no") % _WIDTH), out, strict=True)]
    blocks = F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK)))
    return rows.select(step.cast("int").alias("step"), at.cast("long").alias("at"), blocks.alias("block"), "levels", link[0].cast("int").alias("next_step"), link[1].cast("long").alias("next_at"), link[2].cast("int").alias("next_pos"))


_RUN = [f"get(v, a.i - a.i % 3 + {j})" for j in range(3)]
_FOLDED = ", ".join(f"coalesce(if(a.i % 3 = {j}, a.h, {_RUN[j]}), x'')" for j in range(3))
_OTHERS = ", ".join(f"if(a.i % 3 = {j}, x'', coalesce({_RUN[j]}, x''))" for j in range(3))
CLIMB = f"""
WITH RECURSIVE climb(g, nth, step, at, pos, folded, siblings) AS (
  SELECT g, 0, step, at, pos, start, x'' FROM {{leaves}}
  UNION ALL
  SELECT g, nth + 1, next_step, next_at, next_pos, up.h, up.s FROM (
    SELECT c.g, c.nth, n.next_step, n.next_at, n.next_pos,
           aggregate(n.levels, named_struct('i', c.pos, 'h', c.folded, 's', x''), (a, v) -> named_struct(
             'i', CAST(a.i div 3 AS INT), 'h', unhex(sha2(lower(hex(concat({_FOLDED}))), 256)), 's', concat(a.s, {_OTHERS}))) AS up
    FROM climb c JOIN {{nodes}} n ON n.step = c.step AND n.at = c.at AND n.block = c.g div {{block}}))
SELECT g, nth, folded, siblings FROM climb LIMIT ALL
"""


def _by_source(rows: DataFrame, table: DataFrame, on: str, n_sources: int) -> DataFrame:
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(table), on)
    return looked_up(rows, on, "g", table)


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns don't matter.  Leaves of a
    source stand by id, null ids first, and equal ids by leaf; equal rows are leaves of their own,
    whose proofs differ by their place.  Null sources form a source, the first.  A row without id
    isn't tampered with.  A lone leaf is its source's root, and a lone source's root is the root;
    a leaf without siblings has the digest of nothing as proof.  No rows: no rows.
    """
    spark = docs.sparkSession
    rows = checkpointed(hashed(docs).withColumn("tie", F.monotonically_increasing_id()))
    leaves = numbered(rows, "name", "doc_id", "leaf", "tie").drop("tie")
    sizes = leaves.groupBy("name").agg(F.min("g").alias("first"), F.count("*").alias("n"))
    sources = checkpointed(numbered(sizes, "name").withColumnRenamed("g", "source_no"))
    counted = sources.agg(F.count("*").alias("sources"), F.max("n").alias("largest")).first()
    n_sources, largest = counted["sources"], counted["largest"] or 0
    no = F.col("g") - F.col("first")
    leaves = checkpointed(_by_source(leaves, sources, "name", n_sources).select("g", "doc_id", "leaf", "start", "source_no", "first", "n", no.alias("no")))

    own = [F.col("g").alias("low"), (F.col("g") + 1).alias("high")]
    below, subroots = _trees(leaves.select(F.col("source_no").alias("tree"), "first", "n", "no", F.col("leaf").alias("digest"), *own), largest)
    subroots = checkpointed(subroots)
    over, roots = _trees(subroots.select(F.lit(-1).cast("long").alias("tree"), F.lit(0).cast("long").alias("first"), F.lit(n_sources).cast("long").alias("n"), F.col("tree").alias("no"), "digest", "low", "high"), n_sources)
    found = roots.select(hexadecimal(F.col("digest")).alias("root")).first()  # one digest

    number, first = F.col("no"), F.col("first")
    parts = []
    for k, row in enumerate(below):
        span = _WIDTH ** (k + 1)
        at, next_at = first + number * span, first + F.floor(number / _WIDTH) * span * _WIDTH
        out = F.lit(TOP), F.floor(F.col("tree") / _WIDTH), F.col("tree") % _WIDTH
        parts.append(_stored(row, F.lit(k), at, next_at, F.col("n") > _WIDTH, out))
    for k, row in enumerate(over):
        nothing = F.lit(None), F.lit(None), F.lit(None)
        parts.append(_stored(row, F.lit(TOP + k), number, F.floor(number / _WIDTH), F.col("n") > _WIDTH, nothing))
    lone = F.col("n") == 1
    begin = leaves.select(
        "g", "start",
        F.when(lone, TOP).otherwise(0).cast("int").alias("step"),
        F.when(lone, F.floor(F.col("source_no") / _WIDTH)).otherwise(first + F.floor(number / _WIDTH) * _WIDTH).cast("long").alias("at"),
        F.when(lone, F.col("source_no") % _WIDTH).otherwise(number % _WIDTH).cast("int").alias("pos"),
    )
    if parts:
        nodes = parts[0]
        for more in parts[1:]:
            nodes = nodes.unionByName(more)
        steps = spark.sql(CLIMB, leaves=begin, nodes=checkpointed(nodes), block=BLOCK)
    else:  # at most one leaf in all
        steps = begin.select("g", F.lit(0).alias("nth"), F.col("start").alias("folded"), _none().alias("siblings"))
    passed = F.aggregate(F.sort_array(F.collect_list(F.struct("nth", "siblings"))), _none(), lambda a, x: F.concat(a, x["siblings"]))
    climbed = steps.groupBy("g").agg(F.max_by("folded", "nth").alias("folded"), F.sha2(hexadecimal(passed), 256).alias("proof_sha256"))
    named = _by_source(leaves.select("g", "doc_id", "leaf", F.col("source_no").alias("tree")), subroots.select("tree", F.col("digest").alias("subroot")), "tree", n_sources)
    root = F.lit(found["root"] if found else None).cast("string")
    folded = hexadecimal(F.col("folded"))
    return named.join(climbed, "g").select(
        "doc_id", hexadecimal(F.col("leaf")).alias("leaf"), hexadecimal(F.col("subroot")).alias("subroot"), root.alias("root"), "proof_sha256",
        folded.alias("folded_root"), (folded == root).alias("verified"),
    )
