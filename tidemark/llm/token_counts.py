"""Token counts with a whole-token shortcut.

Most pre-tokens of a text are themselves entries of the vocabulary.  Which entries encode alone
as exactly one token is proved once, on the driver, by encoding every entry; the proved set is
broadcast (its size is the vocabulary's).  Tasks count proved pre-tokens as one each and hand
only the rest, each distinct string once, to the library's merges.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-token pattern, with \s spelt as the Unicode property that the library means by it.
PRE_TOKEN = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"\s+", r"\p{White_Space}+")
#: Characters whose classes no Unicode version has changed; other texts are split by the library.
STABLE = regex.compile(r"[\x00-ɏ‐-‧]*+")
#: Distinct merged strings that a task remembers before it starts anew.
REMEMBERED = 800_000
#: A text of this many characters is counted in groups of GROUP pre-tokens, for memory's sake.
LONG, GROUP = 1 << 20, 1 << 16


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that, encoded alone, give exactly their one token."""
    own, byte_of, found = tokenizer(path), _byte_of(), []
    special = {t.content for t in own.get_added_tokens_decoder().values()}
    for piece in own.get_vocab():
        if piece not in special:
            try:
                found.append(bytes(byte_of[c] for c in piece).decode())
            except UnicodeDecodeError:  # part of a character: no whole pre-token
                continue
    return sorted(s for s, e in zip(found, own.encode_batch(found, add_special_tokens=False), strict=True) if len(e.ids) == 1)


class _Counter:
    def __init__(self, path: str, whole: list[str]):
        self.own, self.whole = tokenizer(path), whole
        self.find, self.each = regex.compile(PRE_TOKEN).findall, regex.compile(PRE_TOKEN).finditer
        added = sorted((t.content for t in self.own.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, added))).split if added else lambda text: [text]
        self.size = dict.fromkeys(whole, 1)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text: at once, or of a long one in groups."""
        if not text.isascii() and not STABLE.fullmatch(text):
            yield [text[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(text)]
        elif len(text) < LONG:
            yield self.find(text)
        else:
            found = self.each(text)
            while group := [m[0] for m in islice(found, GROUP)]:
                yield group

    def __call__(self, text: str) -> int:
        parts = self.split(text)
        total = len(parts) - 1
        for pre in chain.from_iterable(map(self.pre_tokens, parts)):
            sizes = list(map(self.size.get, pre))
            if None in sizes:
                rest = list({p for p, n in zip(pre, sizes, strict=True) if n is None})
                if len(self.size) + len(rest) > len(self.whole) + REMEMBERED:
                    self.size = dict.fromkeys(self.whole, 1)
                self.size.update(zip(rest, (len(e.ids) for e in self.own.encode_batch_fast(rest, add_special_tokens=False)), strict=True))
                sizes = [n if n is not None else self.size[p] for p, n in zip(pre, sizes, strict=True)]
            total += sum(sizes)
        return total


#: The counter of this worker process, with what it remembers from earlier tasks.
_own: dict[str, _Counter] = {}


def _counter(path: str, whole) -> _Counter:
    if path not in _own:
        _own[path] = _Counter(path, whole.value)
    return _own[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row of ``docs``.

    Counts are the library's for the byte-level BPE file at ``path``, without added special
    tokens; a special string inside a text counts as its one token.  A null text is empty: zero
    bytes, zero tokens.  Rows are counted one by one, so repeated rows, ties and clashing extra
    columns change nothing, and an empty table gives an empty table.  No shuffle.
    """
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, whole)
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([counter(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.select(F.col(key), F.col(text))
        .mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
        .withColumnRenamed("key", key)
    )
