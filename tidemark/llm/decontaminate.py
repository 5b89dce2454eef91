"""Benchmark decontamination with an Aho-Corasick automaton over normalised item windows.

Text and items are normalised alike: A-Z to lower case, words are runs of ASCII letters and
digits and of anything outside ASCII.  The automaton holds every window of 13 item words, so one
scan of a document's words finds all occurrences.  It is kept small by its alphabet: every word of
the items is a pair of symbols, so a window takes some 24 nodes where its letters would take 80,
and any other word is one pair that no window has.  Places in the scanned string are word numbers
twice over, which are mapped to code points of the original text.

One automaton holds at most about ``shard_windows`` (window, item) rows, so driver, broadcast and
tasks hold a known amount whatever the benchmark's size.  A larger benchmark is cut into shards;
each scans the documents in turn, is dropped before the next is made, and leaves narrow rows of
the documents it hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from math import isqrt

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, row_hashes

#: Words in a window.
WINDOW = 13
#: (window, item) rows in one automaton, about: 250,000 windows are 6 million nodes, some 290 MB.
SHARD_WINDOWS = 250_000
#: Byte -> normalised byte: A-Z to a-z, other ASCII but digits and a-z to a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
HITS = (
    T.StructType()
    .add("n_words", "long").add("n_hit", "long").add("n_items", "long").add("items_sha256", "string").add("contaminated", "boolean")
    .add("spans", T.ArrayType(T.ArrayType(T.IntegerType())))
)
#: A word before it is lower-cased.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text whose words are scanned at a time.
PIECE = 1 << 20
#: Symbols: no key holds those of OTHER; the first and the second of a word have codes of their own.
OTHER, FIRST, SECOND = "\x01\x01", 0x100, 0x8000


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(NORMAL).split() if text else []


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, about ``PIECE`` bytes of it at a time."""
    raw, at = text.encode().translate(NORMAL) if text else b"", 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, window) rows; a window is its normalised words between single spaces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, more = [], False
                for piece in _pieces(whole):
                    words += piece
                    if len(words) >= WINDOW:
                        found = {b" ".join(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)}
                        words, more = words[1 - WINDOW :], True
                        yield _item_rows(item, found)
                if words and not more:
                    yield _item_rows(item, {b" ".join(words)})

    return items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).mapInArrow(cut, "item string, window string").distinct()


def _item_rows(item: str, windows: set[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([item] * len(windows), pa.string()), pa.array([w.decode() for w in windows], pa.string())], ["item", "window"])


class Shard:
    """What a task builds an automaton from: the words, each window as word numbers, and its items."""

    def __init__(self, rows: list[tuple[str, str]]):
        """``rows``: (window, item), sorted."""
        numbers: dict[str, int] = {}
        names: dict[str, int] = {}
        windows, lengths, owners, last = [], [], [], None
        for window, item in rows:
            if window != last:
                own = [numbers.setdefault(w, len(numbers)) for w in window.split(" ")]
                windows += own
                lengths.append(len(own))
                owners.append([])
                last = window
            owners[-1].append(names.setdefault(item, len(names)))
        self.words = [w.encode() for w in numbers]
        self.windows, self.lengths = np.array(windows, np.int32), np.array(lengths, np.int32)
        self.owners, self.n_owners = np.array([k for own in owners for k in own], np.int32), np.array([len(own) for own in owners], np.int32)
        self.items = list(names)


class Scanner:
    """The automaton of a shard."""

    def __init__(self, shard: Shard):
        base = isqrt(max(0, len(shard.words) - 1)) + 1
        symbols = [chr(FIRST + k % base) + chr(SECOND + k // base) for k in range(len(shard.words))]
        self.symbols, self.lengths, self.items = dict(zip(shard.words, symbols, strict=True)), shard.lengths, shard.items
        self.owners, self.first_owner = shard.owners, np.concatenate([[0], np.cumsum(shard.n_owners)])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS) if len(shard.lengths) else None
        at = 0
        for k, n in enumerate(shard.lengths.tolist()):
            self.automaton.add_word("".join([symbols[w] for w in shard.windows[at : at + n].tolist()]), k)
            at += n
        if self.automaton:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged stretches [from, to) of words inside occurrences, and the items that occur."""
        n, tail, steps, windows = 0, "", [], set()
        for words in _pieces(text):
            if self.automaton:
                own = tail + "".join(map(self.symbols.get, words, repeat(OTHER)))
                begin = n - len(tail) // 2
                for at, window in self.automaton.iter(own):
                    windows.add(window)
                    steps.append((begin + at // 2 + 1 - int(self.lengths[window]), begin + at // 2 + 1))
                tail = own[-2 * (WINDOW - 1) :]
                steps = _merged(steps)
            n += len(words)
        owners = {o for w in windows for o in self.owners[self.first_owner[w] : self.first_owner[w + 1]].tolist()}
        return n, steps, {self.items[o] for o in owners}


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(b, found[-1][1]))
        else:
            found.append((a, b))
    return found


def _places(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Stretches of words as [from, to) code points of the text."""
    edges, found = iter(spans), []
    a, b = next(edges, (-1, -1))
    for k, m in enumerate(regex.finditer(ITEM_WORD, text) if spans else ()):
        if k == a:
            begin = m.start()
        if k == b - 1:
            found.append([begin, m.end()])
            a, b = next(edges, (-1, -1))
            if a < 0:
                break
    return found


def _verdict(text: str | None, n: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    hit, names = sum(b - a for a, b in spans), ",".join(sorted(items))
    digest = hashlib.sha256(names.encode()).hexdigest()
    return {"n_words": n, "n_hit": hit, "n_items": len(items), "items_sha256": digest, "contaminated": hit > 0 and 20 * hit >= n, "spans": _places(text or "", spans)}


_built: dict[str, tuple[object, Scanner]] = {}


def _scanner(shared) -> Scanner:
    """The automaton of a broadcast shard, kept by the worker while it serves that shard."""
    shard = shared.value
    if "last" not in _built or _built["last"][0] is not shard:
        _built.clear()
        _built["last"] = (shard, Scanner(shard))
    return _built["last"][1]


KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.list_(pa.int32())))])


def _with_hits(docs: DataFrame, text: str, shared) -> DataFrame:
    """``docs`` judged by one automaton."""
    place = docs.columns.index(text)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanner = _scanner(shared)
            rows = [_verdict(t, *scanner.scan(t)) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, KIND)], [*batch.schema.names, "hits"])

    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, T.StructField("hits", HITS)]))


FOUND = "h1 long, h2 long, spans array<array<int>>, items array<string>"


def _found(docs: DataFrame, text: str, shared) -> DataFrame:
    """(h1, h2, spans, items) of the documents that one shard hits; repeated rows once."""
    narrow = docs.select(*row_hashes(docs), F.col(f"`{text}`").alias("text"))
    kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanner, rows = _scanner(shared), []
            for h1, h2, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, spans, items = scanner.scan(t)
                if spans:
                    rows.append({"h1": h1, "h2": h2, "spans": [list(s) for s in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(rows, kind)

    return narrow.mapInArrow(scan, FOUND).dropDuplicates(["h1", "h2"])


def _judged(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` (row, text, and per shard the spans and items found) with the struct ``hits`` in place of those."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, spans, items in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own = _merged([(a, b) for part in spans or () for a, b in part])
                rows.append(_verdict(t, sum(map(len, _pieces(t))), own, {i for part in items or () for i in part}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, KIND)], ["row", "hits"])

    return docs.mapInArrow(judge, T.StructType([docs.schema["row"], T.StructField("hits", HITS)])).select("row.*", "hits")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """The rows of ``docs`` with a struct ``hits`` of n_words, n_hit, n_items, items_sha256,
    contaminated and ``spans``, the hit stretches as [from, to) code points of the original text.

    A document is contaminated if it has hit words and they are a twentieth of its words or more.
    Null and empty texts have no words and are clean.  Items without words match nothing; a null
    item id reads as the empty string.  Rows are judged one by one (repeated rows alike), an empty
    table of documents or items gives an empty or all-clean result, other columns stay as they
    are; a column ``hits`` is replaced.  A long text is scanned in pieces.  Documents aren't
    shuffled, but for a benchmark of several shards.
    """
    docs, spark = docs.drop("hits"), docs.sparkSession
    windows = checkpointed(_windows(items, item_key, item_text))
    parts = max(1, -(-windows.count() // shard_windows))
    dealt = windows.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(parts)))

    def shared(k: int):
        rows = dealt.where(F.col("part") == k).select("window", "item").toArrow()
        return spark.sparkContext.broadcast(Shard(sorted(zip(*(rows.column(c).to_pylist() for c in ("window", "item")), strict=True))))

    if parts == 1:
        return _with_hits(docs, text, shared(0))
    found = []
    for k in range(parts):
        shard = shared(k)
        found.append(checkpointed(_found(docs, text, shard)))
        shard.destroy()
    merged = reduce(DataFrame.unionByName, found).groupBy("h1", "h2").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").alias("text"), *row_hashes(docs))
    return _judged(rows.join(merged, ["h1", "h2"], "left").select("row", "text", "spans", "items"), text)
