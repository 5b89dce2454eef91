"""Exact top-k search by integer inner product: tiles of queries times shards of candidates.

Vectors are packed once into shards of one width, written to the shared folder.  Queries are packed
into tiles of their own.  The plane of (query, candidate) pairs is cut into cells of bounded size:
``QUERIES`` queries meet ``CANDIDATES`` candidates, so a query travels once for each strip of
candidates and a candidate once for each strip of queries, and nothing is broadcast.  A cell
multiplies tile by shard and selects only what beats a query's k-th best so far.  The lists of a
query's cells are merged in a tree, ``FAN`` at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, whole_row

#: Rows of a shard at most, and components of it.
SHARD, SHARD_COMPONENTS = 8_192, 1 << 19
#: Queries and candidates of a cell, on average.
QUERIES, CANDIDATES = 65_536, 262_144
#: Queries of one matrix product, and lists merged at a time.
TILE, FAN = 1_024, 8

_LONG = np.iinfo(np.int64)
_PACKED = "shard long, n int, width int, ids binary, unnamed binary, spots binary, numbers binary, wide int"
_LISTS = "row long, query_id long, strip long, best array<struct<loss: long, unnamed: boolean, vec_id: long>>"


def quantised(values: np.ndarray) -> np.ndarray:
    """floor(256 x), as longs; what no long holds becomes the nearest one."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * 256), -(2.0**63), 2.0**63 - 1024).astype(np.int64)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """In the narrowest of int16, int32 and int64 that holds them."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return numbers.astype(kind)


def _shards(ids: np.ndarray, unnamed: np.ndarray, spots: np.ndarray, numbers: np.ndarray) -> Iterator[tuple]:
    """Rows of ``_PACKED``, of rows of one width; a shard is called by its first row's spot."""
    width = numbers.shape[1]
    most = max(1, min(SHARD, SHARD_COMPONENTS // max(width, 1)))
    for at in range(0, len(ids), most):
        part = _narrow(numbers[at : at + most])
        cut = slice(at, at + most)
        yield int(spots[at]), len(part), width, ids[cut].tobytes(), unnamed[cut].tobytes(), spots[cut].tobytes(), part.tobytes(), part.dtype.itemsize


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _PACKED.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in _PACKED.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _packing(id_column: int, vector_column: int, spot_column: int) -> Callable:
    """Packs record batches of (id, vector, spot) by width; at most a shard of each width waits in memory, ``SHARD`` rows in all."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = [row for parts in waiting.values() for row in _shards(*(np.concatenate(x) for x in zip(*parts, strict=True)))]
            waiting.clear()
            return _batch(rows)

        for batch in batches:
            ids, vectors, spots = batch.column(id_column), batch.column(vector_column), batch.column(spot_column)
            widths = np.asarray(vectors.value_lengths())
            flat = np.asarray(vectors.flatten())
            starts = np.cumsum(widths) - widths
            unnamed = np.asarray(ids.is_null())
            numbers = np.asarray(ids.fill_null(0)), unnamed, np.asarray(spots)
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                values = flat[starts[own][:, None] + np.arange(width)] if width else np.zeros((len(own), 0))
                waiting.setdefault(int(width), []).append((*(x[own] for x in numbers), quantised(values)))
            held += len(widths)
            if held >= SHARD:
                yield flush()
                held = 0
        if held:
            yield flush()

    return pack


class _Block:
    """Rows of one width: ids (and whether they are null), spots and integer components."""

    def __init__(self, rows: list[dict]):
        self.width = rows[0]["width"]
        self.ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows])
        self.unnamed = np.concatenate([np.frombuffer(r["unnamed"], bool) for r in rows])
        self.spots = np.concatenate([np.frombuffer(r["spots"], np.int64) for r in rows])
        kind = np.dtype(f"i{max(r['wide'] for r in rows)}")
        self.numbers = np.concatenate([np.frombuffer(r["numbers"], f"i{r['wide']}").reshape(r["n"], self.width).astype(kind) for r in rows])

    def sorted(self) -> _Block:
        """In place, by id, null ids last."""
        order = np.lexsort((self.ids, self.unnamed))
        self.ids, self.unnamed, self.spots, self.numbers = (x[order] for x in (self.ids, self.unnamed, self.spots, self.numbers))
        return self


def _blocks(table: pa.Table) -> list[_Block]:
    by_width: dict[int, list[dict]] = {}
    for row in table.select(["n", "width", "ids", "unnamed", "spots", "numbers", "wide"]).to_pylist():
        by_width.setdefault(row["width"], []).append(row)
    return [_Block(by_width[w]) for w in sorted(by_width)]


def _largest(numbers: np.ndarray) -> int:
    return max(abs(int(numbers.min())), abs(int(numbers.max()))) if numbers.size else 0


def _exact_kind(tile: np.ndarray, blocks: list[_Block]) -> type:
    """A type in which no sum of products loses a digit: floats where all partial sums fit, else Python integers."""
    bound = max((_largest(tile) * _largest(b.numbers) * max(min(tile.shape[1], b.width), 1) for b in blocks), default=0)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


def _own_places(spots: np.ndarray, block: _Block) -> np.ndarray:
    """Where each query stands among the candidates itself, -1 if it doesn't."""
    order = np.argsort(block.spots)
    at = np.minimum(np.searchsorted(block.spots, spots, sorter=order), len(order) - 1)
    return np.where(block.spots[order[at]] == spots, order[at], -1)


def best_of(queries: _Block, blocks: list[_Block], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(query, score, unnamed, vec_id) of the ``k`` best candidates of each query among ``blocks``.

    Candidates of a block go by id, so that within the first block an equal score never beats what
    is held; in further blocks (of other widths) equal scores are compared by id.  Steps grow from
    64 candidates to a shard, so that few of them pass before the k-th best is known.
    """
    for low in range(0, len(queries.ids), TILE):
        tile, spots = queries.numbers[low : low + TILE], queries.spots[low : low + TILE]
        kind = _exact_kind(tile, blocks)
        whole = object if kind is object else np.int64
        held = [np.zeros(0, np.int64), np.zeros(0, whole), np.zeros(0, bool), np.zeros(0, np.int64)]
        worst = np.full(len(tile), -np.inf, kind)
        for nth, block in enumerate(blocks):
            width, own = min(queries.width, block.width), _own_places(spots, block)
            left = tile[:, :width].astype(kind)
            at, step = 0, 64
            while at < len(block.ids):
                end = min(at + step, len(block.ids))
                scores = left @ block.numbers[at:end, :width].astype(kind).T if width else np.zeros((len(tile), end - at), kind)
                passed = scores > worst[:, None] if nth == 0 else scores >= worst[:, None]
                inside = np.flatnonzero((own >= at) & (own < end))
                passed[inside, own[inside] - at] = False
                rows, columns = np.nonzero(passed)
                if len(rows):
                    new = rows, scores[rows, columns].astype(whole), block.unnamed[at:end][columns], block.ids[at:end][columns]
                    touched = np.isin(held[0], rows)
                    merged = [np.concatenate([h[touched], n]) for h, n in zip(held, new, strict=True)]
                    order = _order(merged)
                    merged = [m[order] for m in merged]
                    place = _place(merged[0])
                    full = place == k - 1
                    worst[merged[0][full]] = merged[1][full]
                    held = [np.concatenate([h[~touched], m[place < k]]) for h, m in zip(held, merged, strict=True)]
                at, step = end, min(step * 4, SHARD)
        yield low + held[0], held[1], held[2], held[3]


def _order(lists: list[np.ndarray]) -> np.ndarray:
    """By query, then highest score, then smallest id, null ids last."""
    rows, scores, unnamed, ids = lists
    if scores.dtype == object:
        scores = np.unique(scores, return_inverse=True)[1]
    return np.lexsort((ids, unnamed, -scores, rows))


def _place(rows: np.ndarray) -> np.ndarray:
    """The place of each entry in its query's list, of rows sorted by query."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))


def _cell(k: int) -> Callable:
    """Lists of the queries of a cell, each from the strip of candidates that it holds."""

    def lists(key: tuple, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        blocks = [b.sorted() for b in _blocks(candidates)]
        strip, out = key[1].as_py(), []
        for own in _blocks(queries):
            for rows, scores, unnamed, ids in best_of(own, blocks, k):
                order = np.argsort(rows, kind="stable")
                rows, scores, unnamed, ids = rows[order], scores[order], unnamed[order], ids[order]
                starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
                losses = np.array([-min(max(int(s), -_LONG.max), _LONG.max) for s in scores], np.int64)
                entries = pa.StructArray.from_arrays([pa.array(losses), pa.array(unnamed.astype(bool)), pa.array(ids.astype(np.int64), mask=unnamed.astype(bool))], ["loss", "unnamed", "vec_id"])
                offsets = pa.array(np.r_[starts, len(rows)].astype(np.int32))
                at = rows[starts].astype(np.int64)
                out.append(pa.table({"row": own.spots[at], "query_id": own.ids[at], "strip": np.full(len(at), strip, np.int64), "best": pa.ListArray.from_arrays(offsets, entries)}))
        schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("strip", pa.int64()), ("best", pa.list_(pa.struct([("loss", pa.int64()), ("unnamed", pa.bool_()), ("vec_id", pa.int64())])))])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return lists


def _merged(lists: DataFrame, strips: int, k: int) -> DataFrame:
    """Each query's lists merged ``FAN`` at a time until one is left; one shuffle by query serves all rounds."""
    lists = lists.repartition("row") if strips > 1 else lists
    while strips > 1:
        strips = math.ceil(strips / FAN)
        lists = lists.withColumn("strip", F.floor(F.col("strip") / FAN).cast("long"))
        lists = lists.groupBy("row", "query_id", "strip").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return lists


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``is_query``, the ``k`` other rows of highest integer inner product.

    Components count as floor(256 x).  Equal scores go by smaller id, null ids last; a query has
    fewer rows if there are fewer candidates.  Rows whose vector is null or holds a null or
    non-finite component take no part; an empty vector scores 0, and of vectors of unequal length
    the missing components count as 0.  Rows without id are candidates, and ``is_query`` is false
    for them if null.  Repeated rows are rows of their own: each is a query, and a candidate of the
    others.  Components and scores that no long holds become the nearest one that does; scores are
    compared before that.  Other columns don't matter.  No row, or no query: no rows.
    """
    spark, vector = vectors.sparkSession, F.col(f"v.`{vector_column}`")
    named = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), whole_row(vectors.select(F.col(f"`{vector_column}`"))).alias("v"))
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    narrow = vectors.schema[vector_column].dataType.elementType in (T.FloatType(), T.DoubleType())
    plain = vector if narrow else F.transform(vector, lambda x: x.cast("double"))
    # a row's spot tells it from every other row; its lowest bit says whether it asks
    spot = F.monotonically_increasing_id() * 2 + F.col("asks").cast("long")
    rows = named.where(vector.isNotNull() & finite).select("id", plain.alias("vector"), spot.alias("spot"))
    packed = checkpointed(rows.mapInArrow(_packing(0, 1, 2), _PACKED))

    asking = packed.mapInArrow(_asking, _PACKED)
    sizes = packed.select(F.sum("n").alias("n")).first()["n"] or 0
    n_queries = asking.select(F.sum("n").alias("n")).first()["n"] or 0
    cores = spark.sparkContext.defaultParallelism
    across = max(1, math.ceil(n_queries / QUERIES))
    strips = max(math.ceil(sizes / CANDIDATES), min(math.ceil(2 * cores / across), math.ceil(sizes / 1_024)), 1)
    column = F.pmod(F.xxhash64("shard"), F.lit(strips)).alias("strip")
    line = F.pmod(F.xxhash64("shard", F.lit(1)), F.lit(across)).alias("line")
    each = lambda n, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(name)
    left = asking.select("*", line).select("*", each(strips, "strip"))
    right = packed.select("*", column).select("*", each(across, "line"))
    lists = left.groupBy("line", "strip").cogroup(right.groupBy("line", "strip")).applyInArrow(_cell(k), _LISTS)
    best = _merged(lists, strips, k).select("query_id", F.posexplode("best").alias("at", "e"))
    return best.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.loss")).alias("score"))


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of packed shards that ask, as shards of their own."""
    for batch in batches:
        blocks = [_Block([row]) for row in batch.to_pylist()]
        asks = [(b, np.flatnonzero(b.spots & 1)) for b in blocks]
        yield _batch([x for b, own in asks if len(own) for x in _shards(b.ids[own], b.unnamed[own], b.spots[own], b.numbers[own])])
