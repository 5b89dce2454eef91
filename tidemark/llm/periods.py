"""Periodic runs of words, caught online by squares over dyadic blocks.

Each completed block of ``m = 2^k`` words gets a catcher.  While the words between ``m`` and ``2 m``
places later are appended, it compares the suffix of ``m`` words with its block, by hashes that are
doubled from those of level ``k - 1``; two neighbouring blocks that recur at one distance ``p``
(``m <= p < 2 m``) make a square of period ``p``.  A run of four periods holds two such blocks
wherever it starts, so none is missed.  A caught square is compared word by word, extended as far
as its period holds, and merged into its run; squares inside a run of a smaller period are that
run's own and add nothing.

The words of a group of documents are appended side by side: one numpy step advances the catchers
of a level at all their places.  Documents are parted by words that equal no other, so nothing runs
across, and stand by length, so long levels only touch long documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose words are appended side by side (a longer text is a group of its own).
GROUP = 1 << 20
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

_ODD = np.uint64(0x9E3779B97F4A7C15)
Run = tuple[int, int, int]

FOUND = T.StructType(
    [T.StructField("n_runs", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "period", "exponent_milli")), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]
)


def _scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit values that look random, one for each word number."""
    x = x.astype(np.uint64) * _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many places from ``at`` on, in direction ``step``, a word equals that ``period`` places further on; compared in growing pieces."""
    n, size = 0, 32
    last = len(words) - period - 1
    while True:
        if step > 0:
            low, high = at + n, min(at + n + size, last + 1)
        else:
            low, high = max(at - n - size + 1, 0), at - n + 1
        if low >= high:
            return n
        same = words[low:high] == words[low + period : high + period]
        if not same.all():
            return n + int(np.argmin(same if step > 0 else same[::-1]))
        n, size = n + high - low, size * 2


class _Runs:
    """Runs found so far, each with its smallest period, by start."""

    def __init__(self):
        self.runs: list[Run] = []
        self.starts = self.ends = np.zeros(0, np.int64)

    def settle(self) -> None:
        """Makes the runs found meanwhile count for :meth:`hold`."""
        self.runs.sort()
        self.starts = np.array([r[0] for r in self.runs], np.int64)
        self.ends = np.maximum.accumulate(np.array([r[0] + r[1] for r in self.runs], np.int64)) if self.runs else self.starts

    def hold(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a run has all words from ``low`` up to, not including, ``high``."""
        at = np.searchsorted(self.starts, low, "right") - 1
        return (at >= 0) & (self.ends[np.maximum(at, 0)] >= high) if len(self.starts) else np.zeros(len(low), bool)


def runs_of(words: np.ndarray, longest: int, reach: np.ndarray | None = None) -> list[Run]:
    """(start, length, period) of every maximal stretch of four periods or more, and of shorter ones on the way.

    ``longest`` is the length of the longest document in ``words``; ``reach[k]`` (if given) is where
    the documents begin that are long enough for blocks of 2^k words.
    """
    found = _Runs()
    suffix, factor, m, k = _scrambled(words), int(_ODD), 1, 0  # suffix[i]: the hash of the m words that end at i
    while LEAST_PERIODS * m <= longest:
        base = 0 if reach is None else int(reach[k]) // m * m
        here = suffix[base:]
        n = len(here)
        if n >= 3 * m:
            # at i the suffix starts at i - m + 1; the one block m to 2m - 1 places before it that is aligned
            i = np.arange(2 * m - 1, n)
            block = (i - m + 1) // m * m - m
            caught = here[i] == here[block + m - 1]
            both = np.flatnonzero(caught[:-m] & caught[m:]) if n > 3 * m - 1 else np.zeros(0, np.int64)
            if len(both):
                a = base + block[both]
                p = base + i[both] - m + 1 - a
                _merge(words, found, a, p, m)
        if LEAST_PERIODS * 2 * m <= longest:
            longer = np.zeros_like(suffix)
            longer[m:] = suffix[:-m] * np.uint64(factor) + suffix[m:]
            suffix, factor = longer, factor * factor % (1 << 64)
        m, k = 2 * m, k + 1
    return found.runs


def _merge(words: np.ndarray, found: _Runs, a: np.ndarray, p: np.ndarray, m: int) -> None:
    """Adds the runs of the squares of ``a`` (two blocks of ``m`` words that recur ``p`` places on)."""
    open_ = ~found.hold(a, a + p + 2 * m)
    order = np.lexsort((a[open_], p[open_]))
    end = period = -1
    for at, by in zip(a[open_][order].tolist(), p[open_][order].tolist(), strict=True):
        if by != period:
            end, period = -1, by
        if at + by + 2 * m <= end or not np.array_equal(words[at : at + 2 * m], words[at + by : at + by + 2 * m]):
            continue  # in the run just merged, or hashes met by chance
        left, right = _reach(words, at - 1, by, -1), _reach(words, at, by, 1)
        end = at + right + by
        found.runs.append((at - left, left + right + by, by))
    found.settle()


def long_runs(runs: Iterable[Run]) -> list[Run]:
    return sorted((s, n, q) for s, n, q in runs if n >= max(LEAST_WORDS, LEAST_PERIODS * q))


def altered(n: int, doc_id: int | None) -> np.ndarray | None:
    """For the ids that the contract names, which word stands at each place instead; else None."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.r_[np.arange(a), a + np.arange(n - a) % p]


def summary(words: list[bytes], runs: list[Run]) -> tuple:
    """The values of ``FOUND``."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
    collapsed = hashlib.sha256(b" ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k) if runs else b" ".join(words)).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), listed, collapsed)


def runs_of_group(documents: list[list[bytes]]) -> list[list[Run]]:
    """The long runs of each document, of documents whose words are appended side by side."""
    order = sorted(range(len(documents)), key=lambda k: len(documents[k]))
    numbers: dict[bytes, int] = {}
    parts, starts, at = [], [], 0
    for nth, k in enumerate(order):
        words = documents[k]
        starts.append(at)
        parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        parts.append(np.array([-1 - nth], np.int64))
        at += len(words) + 1
    longest = len(documents[order[-1]]) if order else 0
    lengths = [len(documents[k]) for k in order]
    reach = [starts[at] if (at := int(np.searchsorted(lengths, LEAST_PERIODS << k))) < len(starts) else 0 for k in range(longest.bit_length())]
    out: list[list[Run]] = [[] for _ in documents]
    bounds = np.array(starts, np.int64)
    for start, length, period in long_runs(runs_of(np.concatenate(parts), longest, np.array(reach, np.int64))) if parts else []:
        own = int(np.searchsorted(bounds, start, "right")) - 1
        out[order[own]].append((start - starts[own], length, period))
    return out


def _documents(batch: pa.RecordBatch, alter: bool) -> Iterator[tuple[int, list[bytes]]]:
    for k, (key, text) in enumerate(zip(batch.column(0), batch.column(1), strict=True)):
        words = text.as_py().encode("utf-8", "surrogatepass").split() if text.is_valid else []
        places = altered(len(words), key.as_py()) if alter else None
        yield k, words if places is None else [words[i] for i in places.tolist()]


def periodic_runs(docs: DataFrame, alter: bool = False) -> DataFrame:
    """``docs`` with a struct column ``runs``: n_runs; start, length, period and exponent_milli of the longest run; two digests.

    A run is a stretch of words of smallest period q, at least ``max(6, 4 q)`` long, that neither
    neighbour extends.  Words are runs of characters other than ASCII white space, numbered from 0;
    of equally long runs the first counts, then that of the smaller period.  ``runs_sha256`` is the
    digest of all runs' lines ``start,length,period``; ``collapsed_sha256`` that of the words left
    when each run keeps its first period only.  A null or empty text has no words: no runs, nulls
    for the longest, digests of nothing.  ``alter`` first repeats words in texts whose id's CRC-32
    ends in 0, as the contract says (a null id's text stays).  Other columns are kept, an own
    ``runs`` is replaced; equal rows have equal results.  Memory holds a group of ``GROUP`` bytes of
    text, or one longer text, and its hashes.
    """
    kept = [c for c in docs.columns if c != "runs"]
    given = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"))
    schema = T.StructType([T.StructField("__row", given.schema["__row"].dataType), T.StructField("runs", FOUND)])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(f.name, pa.string() if f.dataType == T.StringType() else pa.int64()) for f in FOUND])
        for batch in batches:
            results: list = [None] * batch.num_rows
            places, group, size = [], [], 0

            def flush(places=places, group=group, results=results) -> None:
                for k, words, runs in zip(places, group, runs_of_group(group), strict=True):
                    results[k] = summary(words, runs)
                places.clear()
                group.clear()

            for k, words in _documents(batch, alter):
                places.append(k)
                group.append(words)
                size += sum(map(len, words)) + len(words)
                if size >= GROUP:
                    flush()
                    size = 0
            flush()
            columns = [pa.array(c, f.type) for c, f in zip(zip(*results, strict=True), kind, strict=True)] if results else [pa.array([], f.type) for f in kind]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.StructArray.from_arrays(columns, names=[f.name for f in kind])], ["__row", "runs"])

    found = given.mapInArrow(find, schema)
    return found.select(*(F.col(f"__row.`{c}`").alias(c) for c in kept), "runs")
