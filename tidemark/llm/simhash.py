"""Near duplicates by SimHash, found through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits.  The embedding counts the set bits of
each segment; written in unary (the two bits of a segment sorted) it fits 64 bits again, and the
Manhattan distance of two embeddings is the number of bits in which the unary forms differ.
Flipping one bit moves one count by one, so Manhattan distance is a lower bound of Hamming distance.

The range join takes unit grid cells over groups of segments.  The segments form eight blocks; two
embeddings within distance 4 differ in at most four blocks, so they agree on at least four and
share the cell of one of the 70 choices of four blocks.  Every distinct fingerprint goes to its
70 cells.  Cells are read as sorted runs: within a run the Manhattan bound is tested first and
the Hamming distance then settles the pair.  Only a spanning forest of each cell's links is
returned, never all its pairs; a run too long for one task is dealt out again in pairs of chunks.

The cells are read in two passes.  The first takes six of the 70 choices and joins what they link;
the second takes the rest, carries each fingerprint's component along, and returns a link only
where it joins two components.  So a large group of near copies isn't linked again in every cell.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, row_hashes, whole_row
from .components import connected_components, looked_up

SHINGLE, SEED = 4, 42
#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 4
#: Blocks of 64 / BLOCKS bits; a linked pair agrees on at least BLOCKS - DISTANCE of them.
BLOCKS = 8
#: A cell with more fingerprints than this is dealt out in pairs of chunks of CHUNK.
LONG_RUN, CHUNK = 16_384, 8_192
#: Runs up to this length are compared all at once, shift by shift.
SHORT_RUN = 32

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text whose words are hashed at a time, and what ends a word.
PIECE, SPACE = 1 << 20, re.compile(rb"[\x20\x09-\x0D]")
EVEN = 0x5555555555555555


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``PIECE`` bytes of it at a time."""
    at = 0
    while at < len(raw):
        m = SPACE.search(raw, at + PIECE)
        end = m.start() if m else len(raw)
        yield raw[at:end].split()
        at = end


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles, as an unsigned number; 0 without words.

    A long text is hashed in pieces, so beside its bytes memory holds the words of one piece only.
    """
    ones, n, words = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text.encode().translate(LOWER) if text else b""):
        words += piece
        if len(words) >= SHINGLE:
            more, words = _ones(map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))), words[1 - SHINGLE :]
            ones, n = ones + more[0], n + more[1]
    if not n and words:
        ones, n = _ones([b" ".join(words)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def _ones(shingles: Iterable[bytes]) -> tuple[np.ndarray, int]:
    """How often each bit is set among the hashes, and their number."""
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], "<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64), len(h)


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """The rows of ``docs`` with a long column ``name`` (the fingerprint's 64 bits)."""
    docs = docs.drop(name)
    place = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(place).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Unary segment counts: the two bits of every segment sorted."""
    shifted = F.shiftrightunsigned(fp, 1)
    some, all_ = fp.bitwiseOR(shifted).bitwiseAND(F.lit(EVEN)), fp.bitwiseAND(shifted).bitwiseAND(F.lit(EVEN))
    return some.bitwiseOR(F.shiftleft(all_, 1))


def _embedding(fps: np.ndarray) -> np.ndarray:
    even, one = np.uint64(EVEN), np.uint64(1)
    return ((fps | (fps >> one)) & even) | ((fps & (fps >> one) & even) << one)


def cell_masks() -> tuple[list[int], list[int]]:
    """The bits of each choice of BLOCKS - DISTANCE blocks: those of whole pairs of blocks, and the others."""
    width = 64 // BLOCKS
    block = [((1 << width) - 1) << (k * width) for k in range(BLOCKS)]
    paired = lambda chosen: all(k ^ 1 in chosen for k in chosen)
    choices = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    return tuple([sum(block[k] for k in c) for c in choices if paired(c) == first] for first in (True, False))


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints link: the Manhattan bound first, the Hamming distance where it allows."""
    near = np.bitwise_count(_embedding(a) ^ _embedding(b)) <= DISTANCE
    near[near] = np.bitwise_count((a ^ b)[near]) <= DISTANCE
    return near


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints.

    Breadth first, each found fingerprint compared with those not found yet: a dense group is used
    up after a few steps.
    """
    edges, left, queue = [], fps, []
    emb = _embedding(left)
    while len(left):
        if not queue:
            queue.append(left[0])
            left, emb = left[1:], emb[1:]
        at = queue.pop()
        near = np.bitwise_count(emb ^ _embedding(at[None])) <= DISTANCE
        near[near] = np.bitwise_count(left[near] ^ at) <= DISTANCE
        if near.any():
            found = left[near]
            edges.append((np.full(len(found), at), found))
            queue.extend(found)
            left, emb = left[~near], emb[~near]
    return edges


def _links_of_runs(cells: np.ndarray, fps: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Distinct pairs of labels that links within runs of equal cells join; the arrays are sorted by cell."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    pairs: list[np.ndarray] = [_label_links(fps[a : a + n], labels[a : a + n]) for a, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True)]
    ends = np.repeat(np.where(sizes > SHORT_RUN, 0, starts + sizes), sizes)  # long runs are done
    at = np.flatnonzero(np.arange(len(cells)) + 1 < ends)
    for shift in range(1, SHORT_RUN):
        at = at[at + shift < ends[at]]
        if not len(at):
            break
        apart = at[labels[at] != labels[at + shift]]
        near = apart[_linked(fps[apart], fps[apart + shift])]
        pairs.append(np.stack([labels[near], labels[near + shift]], axis=1))
    return _distinct(pairs)


def _label_links(fps: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Distinct pairs of different labels along a spanning forest of distinct fingerprints."""
    order = np.argsort(fps)
    fps, labels = fps[order], labels[order]
    of = lambda x: labels[np.searchsorted(fps, x)]
    return _distinct([np.stack([of(a), of(b)], axis=1) for a, b in _forest(fps)])


def _distinct(pairs: list[np.ndarray]) -> np.ndarray:
    if not pairs:
        return np.zeros((0, 2), np.int64)
    found = np.concatenate(pairs)
    return np.unique(np.sort(found[found[:, 0] != found[:, 1]], axis=1), axis=0)


#: A pair of labels (a, b), or of a long run a member: a its cell, b its fingerprint, its label and place.
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("label", pa.int64()), ("at", pa.int64())])


def _batch(pairs: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(pairs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none], schema=LINKS)


def _read_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of labels from sorted cells (cell, fingerprint, label); of a long run its members instead."""
    cells, fps, labels = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    long_cell, passed = None, 0

    def members(n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cells[:n]), pa.array(fps[:n].view(np.int64)), pa.array(labels[:n]), pa.array(np.arange(passed, passed + n))], schema=LINKS)

    for batch in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cells, fps, labels = np.concatenate([cells, new[0]]), np.concatenate([fps, new[1].view(np.uint64)]), np.concatenate([labels, new[2]])
        if long_cell is not None:
            n = int(np.searchsorted(cells, long_cell, "right"))
            yield members(n)
            passed, cells, fps, labels = passed + n, cells[n:], fps[n:], labels[n:]
            if not len(cells):
                continue
            long_cell, passed = None, 0
        if not len(cells):
            continue
        last = int(np.searchsorted(cells, cells[-1]))
        if last:
            yield _batch(_links_of_runs(cells[:last], fps[:last], labels[:last]))
        cells, fps, labels = cells[last:], fps[last:], labels[last:]
        if len(cells) > LONG_RUN:
            long_cell = cells[0]
            yield members(len(cells))
            passed, cells, fps, labels = len(cells), cells[:0], fps[:0], labels[:0]
    if len(cells):
        yield _batch(_links_of_runs(cells, fps, labels))


def _pair_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of labels from two chunks of a long run, at most 2 * CHUNK fingerprints."""
    rows = rows.drop_duplicates("fp")
    return pd.DataFrame(_label_links(rows["fp"].to_numpy().view(np.uint64), rows["label"].to_numpy()), columns=["a", "b"])


def label_links(labelled: DataFrame, masks: list[int]) -> DataFrame:
    """Distinct pairs (a, b) of labels that fingerprints within ``DISTANCE`` bits join, over the cells of ``masks``.

    ``labelled`` has distinct longs ``fp`` and their long ``label``; pairs within a label don't show.
    """
    emb = labelled.select("fp", "label", embedding(F.col("fp")).alias("emb"))
    cell = F.explode(F.array(*(F.xxhash64(F.lit(m), F.col("emb").bitwiseAND(F.lit(m))) for m in map(_signed, masks))))
    cells = emb.select(cell.alias("cell"), "fp", "label").repartition("cell").sortWithinPartitions("cell", "fp")
    found = checkpointed(cells.mapInArrow(_read_cells, "a long, b long, label long, at long"))
    links = found.where(F.col("at").isNull()).select("a", "b")
    long_runs = found.where(F.col("at").isNotNull()).select(F.col("a").alias("cell"), F.col("b").alias("fp"), "label", F.floor(F.col("at") / CHUNK).alias("chunk"))
    chunks = long_runs.groupBy("cell").agg((F.max("chunk") + 1).alias("n"))
    dealt = long_runs.join(chunks, "cell").select("cell", "fp", "label", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    pairs = dealt.groupBy("cell", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    return links.union(pairs.applyInPandas(_pair_links, "a long, b long")).distinct()


def _rooted(fingerprints: DataFrame, key: str, name: str) -> DataFrame:
    """For each distinct fingerprint: ``fp``, its smallest non-null key, and ``root``, a fingerprint that names its component."""
    classes = fingerprints.groupBy(F.col(name).alias("fp")).agg(F.min(key).alias("smallest"))
    first, rest = cell_masks()
    classes = checkpointed(classes.withColumn("label", F.col("fp")))
    for masks in (first, rest):
        roots = connected_components(label_links(classes, masks)).withColumnRenamed("node", "label")
        classes = looked_up(classes, "label", "fp", roots, "left").select("fp", "smallest", F.coalesce("root", "label").alias("label"))
        classes = checkpointed(classes)
    return classes.withColumnRenamed("label", "root")


def near_duplicate_classes(fingerprints: DataFrame, key: str = "doc_id", name: str = "fp") -> DataFrame:
    """For each distinct fingerprint: ``fp``, ``root`` (its component), ``component_id`` (the
    component's smallest non-null key), of a table that is cheap to read twice."""
    rooted = _rooted(fingerprints, key, name)
    smallest = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return looked_up(rooted, "root", "fp", smallest).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of every row.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows and exact
    copies share a fingerprint and are compared once.  Rows with a null key belong to components
    but don't name them; a component of such rows alone has a null ``component_id``.  An empty
    table gives an empty table; other columns are not read.
    """
    marked = with_fingerprint(docs.select(F.col(key), F.col(text)), text).select(key, "fp")
    marked = checkpointed(marked.withColumn("__place", F.monotonically_increasing_id()))  # deals rows out, whatever their keys
    classes = checkpointed(near_duplicate_classes(marked, key))
    return looked_up(marked, "fp", "__place", classes.select("fp", "component_id")).select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` less near duplicates: of each component the row with the smallest key.

    Exactly one row of each component stays.  Rows are told apart by all their columns: of several
    with the smallest key (repeated ids), or of rows without any key, the one with the smallest
    hash of the row stays; of repeated rows, one.  Keys sort before null.  Winners are chosen among
    narrow rows, and whole rows are moved once.
    """
    marked = docs.select(F.col(f"`{key}`").alias("key"), *row_hashes(docs), F.col(f"`{text}`").alias("text"))
    marked = checkpointed(with_fingerprint(marked).drop("text"))
    counted = marked.groupBy("fp", "key", "h1", "h2").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "h1", "h2", "n")).alias("best")
    roots = _rooted(marked, "key", "fp").select("fp", "root")
    chosen = counted.groupBy("fp").agg(best).join(roots, "fp").select("root", "best.*").groupBy("root").agg(best)
    chosen = checkpointed(chosen.select(F.col("best.h1").alias("h1"), F.col("best.h2").alias("h2"), F.col("best.n").alias("n")))
    rows = docs.select(whole_row(docs).alias("row"), *row_hashes(docs)).join(chosen, ["h1", "h2"])
    once = rows.where("n = 1").select("row.*")
    repeated = rows.where("n > 1").groupBy(F.concat_ws(" ", "h1", "h2").alias("which")).agg(F.first("row").alias("row"))
    return once.unionByName(repeated.select("row.*"))
