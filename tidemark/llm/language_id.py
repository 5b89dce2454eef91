"""Language identification with a byte convolutional network.

A text is lower-cased and cut, whole, into windows of 256 UTF-8 bytes.  Filters two, three and
four bytes wide run over a learned byte embedding, each is max-pooled over the window, and a
softmax gives the window's language; a text has the mean over its windows, weighted by their bytes.
The network is trained in numpy on the driver, on a bounded sample of labelled windows, and
applied to batches of windows inside the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import Adam, bounded_sample, softmax

WINDOW = 256
#: Training documents of each language (about), and windows of each document, at most: defaults of :func:`fit`.
TRAIN_DOCS, TRAIN_WINDOWS = 400, 4
EMBED, WIDTHS, FILTERS = 8, (2, 3, 4), 16
#: Windows that go through the network at once.
CHUNK = 64
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def windows(text: str | None) -> np.ndarray:
    """The text's windows as rows of bytes; the last is padded with zeros."""
    raw = text.lower().encode() if text else b""
    raw += bytes(-len(raw) % WINDOW)
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 3):
        rng, wide, n = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
        self.languages = languages
        self.mask = np.zeros((wide, EMBED, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(wide * EMBED, n)
        self.params = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filters": (rng.normal(0, 0.3, (wide * EMBED, n)) * self.mask).astype(np.float32),
            "bias": np.zeros(n, np.float32),
            "out": rng.normal(0, 0.2, (n, len(languages))).astype(np.float32),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.params["embed"][0] = 0

    def _patches(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = max(WIDTHS)
        padded = np.concatenate([x, np.zeros((len(x), wide - 1), np.uint8)], axis=1)
        emb = self.params["embed"][padded]
        rows, cells, _ = emb.strides
        view = np.lib.stride_tricks.as_strided(emb, (len(x), WINDOW, wide * EMBED), (rows, cells, emb.itemsize))
        return np.ascontiguousarray(view), padded

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p, found = self.params, []
        for k in range(0, len(x), CHUNK):
            patches, _ = self._patches(x[k : k + CHUNK])
            pooled = (patches.reshape(-1, patches.shape[2]) @ p["filters"]).reshape(len(patches), WINDOW, -1).max(axis=1)
            found.append(softmax(np.maximum(pooled + p["bias"], 0) @ p["out"] + p["out_bias"]))
        return np.concatenate(found)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 5) -> None:
        rng, p, adam, wide = np.random.default_rng(seed), self.params, Adam(self.params, rate), max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for k in range(0, len(x), batch):
                at = order[k : k + batch]
                patches, padded = self._patches(x[at])
                conv = (patches.reshape(-1, patches.shape[2]) @ p["filters"]).reshape(len(at), WINDOW, -1)
                top = conv.argmax(axis=1)
                act = np.maximum(np.take_along_axis(conv, top[:, None], axis=1)[:, 0] + p["bias"], 0)
                d = softmax(act @ p["out"] + p["out_bias"])
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                back = (d @ p["out"].T) * (act > 0)
                picked = patches[np.arange(len(at))[:, None], top]
                grads = {"out": act.T @ d, "out_bias": d.sum(0), "bias": back.sum(0)}
                grads["filters"] = np.einsum("nf,nfk->kf", back, picked) * self.mask
                to_emb = (back[:, :, None] * p["filters"].T[None]).reshape(len(at), -1, wide, EMBED)
                grads["embed"] = np.zeros_like(p["embed"])
                np.add.at(grads["embed"], padded[np.arange(len(at))[:, None, None], top[:, :, None] + np.arange(wide)], to_emb)
                grads["embed"][0] = 0
                adam.step(grads)


def _training_windows(most: int):
    """Batches of (order, language, text) as at most ``most`` windows of each text, spread over the whole of it."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for order, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = windows(text)
                at = np.unique(np.linspace(0, len(cut) - 1, most).astype(int)) if len(cut) else []
                rows += [{"order": order, "lang": lang, "bytes": cut[k].tobytes()} for k in at]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("order", pa.int64()), ("lang", pa.string()), ("bytes", pa.binary())]))

    return cut_up


def fit(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> ByteCNN | None:
    """A network trained on about ``train_docs`` texts of each language in ``labelled``, ``train_windows`` of each at most; None without a labelled text."""
    rows = bounded_sample(labelled.where(F.length(text) > 0), key, lang, train_docs)
    found = rows.select(F.col("order").cast("long"), F.col(lang), F.col(text)).mapInArrow(_training_windows(train_windows), "order long, lang string, bytes binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "order", "bytes"])
    found = found[found.groupby("lang").cumcount() < train_docs * train_windows]
    languages = sorted(found["lang"].unique())
    net = ByteCNN(languages)
    x = np.frombuffer(b"".join(found["bytes"]), np.uint8).reshape(-1, WINDOW)
    net.train(x, found["lang"].map({v: k for k, v in enumerate(languages)}).to_numpy())
    return net


def predict(net: ByteCNN | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, in bounded groups of windows."""
    langs, scores, group, n = [UNKNOWN] * len(texts), [0.0] * len(texts), [], 0

    def settle() -> None:
        cuts = [windows(texts[k]) for k in group]
        sums = net.probabilities(np.concatenate(cuts)) * np.concatenate([(c != 0).sum(axis=1) for c in cuts])[:, None]
        edges = np.cumsum([0] + [len(c) for c in cuts])
        for k, a, b in zip(group, edges[:-1], edges[1:], strict=True):
            mean = sums[a:b].sum(axis=0)
            best = int(mean.argmax())
            langs[k], scores[k] = net.languages[best], min(1.0, float(mean[best] / max(mean.sum(), 1e-9)))

    for k, text in enumerate(texts):
        if net is not None and text and LETTER.search(text):
            group.append(k)
            n += len(text)
            if n > 1 << 20:
                settle()
                group, n = [], 0
    if group:
        settle()
    return langs, scores


def identify(docs: DataFrame, net: ByteCNN | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred`` and ``lang_score``.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if the
    network had nothing to learn from.  Rows are judged one by one: repeated rows alike (to single
    precision, as products of matrices round by what stands beside a row), an empty table gives an empty table, other columns stay as they are; columns of the two names are
    replaced.  No shuffle.
    """
    docs = docs.drop("lang_pred", "lang_score")
    place, model = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(net)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(model.value, batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]))


def accepted(lang: Column, score: Column, least: float = 0.5) -> Column:
    """Whether a prediction is kept: a known language, with a score of ``least`` or more."""
    return (lang != UNKNOWN) & (score >= least)
