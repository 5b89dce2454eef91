"""Document quality by attention-based multiple-instance learning.

A text is cut, whole, into passages of 2,048 bytes.  Each passage is encoded from its byte and
byte-pair frequencies, its length and how well it compresses (repetition).  Gated attention weighs
the encodings of a document's passages; the weighted sum is scored.  Only documents have labels,
so encoder, attention and score are learned together from them, in numpy on the driver, over a
bounded sample; tasks apply the model to batches of passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .training import Adam, bounded_sample, sigmoid

PASSAGE = 2_048
#: Training documents of each label (about), and passages of each of them, at most: defaults of :func:`fit`.
TRAIN_DOCS, TRAIN_PASSAGES = 1_200, 32
PAIRS, ENCODED, ATTENDED = 128, 32, 16
FEATURES = 256 + PAIRS + 3
#: Bytes of text that are encoded at once.
GROUP_BYTES = 1 << 21
#: Passages that are measured at once.
GROUP = 1_024


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and each text's number of passages (1 for an empty text).

    Passages are measured ``GROUP`` at a time, so beside texts and features memory holds little.
    """
    raws = [(t or "").encode() for t in texts]
    counts = np.array([max(1, -(-len(r) // PASSAGE)) for r in raws])
    x, at = np.zeros((counts.sum(), FEATURES), np.float32), 0
    pieces = (r[k : k + PASSAGE] for r in raws for k in range(0, max(1, len(r)), PASSAGE))
    while group := list(islice(pieces, GROUP)):
        _measure(group, x[at : at + len(group)])
        at += len(group)
    x[:, -1] = np.repeat(np.log(counts), counts)
    return x, counts


def _measure(pieces: list[bytes], x: np.ndarray) -> None:
    """Puts what passages say by themselves into their rows of ``x``."""
    sizes = np.array([len(p) for p in pieces])
    flat = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    if len(flat):
        per = np.maximum(sizes, 1)[:, None]
        x[:, :256] = np.sqrt(np.bincount(owner * 256 + flat, minlength=len(pieces) * 256).reshape(-1, 256) / per)
        pair = (flat[:-1] * 31 + flat[1:]) % PAIRS
        same = owner[:-1] == owner[1:]
        x[:, 256 : 256 + PAIRS] = np.sqrt(np.bincount((owner[:-1] * PAIRS + pair)[same], minlength=len(pieces) * PAIRS).reshape(-1, PAIRS) / per)
    x[:, -3] = np.log1p(sizes) / 8
    x[:, -2] = [len(zlib.compress(p, 1)) / (len(p) + 64) for p in pieces]


class AttentionMIL:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        init = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.params = {
            "enc": init(FEATURES, ENCODED), "enc_bias": np.zeros(ENCODED, np.float32),
            "tanh": init(ENCODED, ATTENDED), "gate": init(ENCODED, ATTENDED), "att": init(ATTENDED),
            "out": init(ENCODED), "out_bias": np.zeros(1, np.float32),
        }

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.params, np.concatenate([[0], np.cumsum(counts)[:-1]])
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["enc"] + p["enc_bias"])
        t, g = np.tanh(h @ p["tanh"]), sigmoid(h @ p["gate"])
        e = (t * g) @ p["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "starts": starts, "score": sigmoid(z @ p["out"] + p["out_bias"])}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward(x, counts)["score"]

    def attention(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each passage's weight within its document."""
        return self._forward(x, counts)["a"]

    def train(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 2e-3, decay: float = 1e-3, seed: int = 13) -> None:
        rng, p, adam = np.random.default_rng(seed), self.params, Adam(self.params, rate)
        edges = np.concatenate([[0], np.cumsum(counts)])
        for _ in range(epochs):
            order = rng.permutation(len(counts))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                n = counts[at]
                f = self._forward(np.concatenate([x[edges[d] : edges[d + 1]] for d in at]), n)
                ds = ((f["score"] - y[at]) / len(at)).astype(np.float32)
                dz = np.repeat(ds[:, None] * p["out"], n, axis=0)
                da = (dz * f["h"]).sum(axis=1)
                de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), n))
                dtg = de[:, None] * p["att"]
                dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
                dh = (f["a"][:, None] * dz + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - f["h"] ** 2)
                grads = {
                    "out": f["z"].T @ ds, "out_bias": ds.sum(keepdims=True), "att": (f["t"] * f["g"]).T @ de,
                    "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg, "enc": f["x"].T @ dh, "enc_bias": dh.sum(axis=0),
                }
                adam.step({k: g + (decay * p[k] if k in ("enc", "out") else 0) for k, g in grads.items()})


def _training_features(most: int):
    """Batches of (order, label, text) as features of at most ``most`` passages of each text, spread over the whole of it."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for order, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, _ = encode([text])
                at = np.unique(np.linspace(0, len(x) - 1, most).astype(int))
                rows.append({"order": order, "label": label, "n": len(at), "x": x[at].tobytes()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("order", pa.int64()), ("label", pa.int32()), ("n", pa.int64()), ("x", pa.binary())]))

    return measured


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES) -> AttentionMIL | None:
    """A model of label 1 against label 0; None unless both occur among ``labels`` of ``docs``.

    The sample is drawn from the labels alone, is bounded, and is then joined to the texts; of
    texts that share a key the smallest counts.  About ``train_docs`` documents of each label are
    learned from, and at most ``train_passages`` passages of each.
    """
    sample = bounded_sample(labels.where(F.col(label).isin(0, 1)), key, label, train_docs)
    chosen = sample.select(F.col(key), F.col(label).cast("int").alias("label"), F.col("order").cast("long").alias("order")).orderBy("order", key).limit(8 * train_docs).collect()
    if len({r["label"] for r in chosen}) < 2:
        return None
    table = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], f"{key} {docs.schema[key].dataType.simpleString()}, label int, order long")
    joined = docs.select(key, text).join(F.broadcast(table), key).groupBy(key, "label", "order").agg(F.min(text).alias(text))
    found = joined.select("order", "label", text).mapInArrow(_training_features(train_passages), "order long, label int, n long, x binary").toPandas()
    found = found.sort_values(["label", "order", "x"])
    found = found[found.groupby("label").cumcount() < train_docs]
    if found["label"].nunique() < 2:
        return None
    x = np.frombuffer(b"".join(found["x"]), np.float32).reshape(-1, FEATURES)
    model = AttentionMIL(x.mean(axis=0), x.std(axis=0) + 0.02)
    model.train(x, found["n"].to_numpy(), found["label"].to_numpy())
    return model


def score(docs: DataFrame, model: AttentionMIL | None, text: str = "text", name: str = "score") -> DataFrame:
    """The rows of ``docs`` with a double ``name``: how likely label 1 is.

    Null texts count as empty; an empty text is one empty passage.  Without a model every score is
    0.5.  Rows are scored one by one: repeated rows alike (to single precision), an empty table gives an empty table,
    other columns stay as they are; a column ``name`` is replaced.  No shuffle.
    """
    docs = docs.drop(name)
    place, shared = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, scores, a, n = batch.column(place).to_pylist(), [], 0, 0
            for k, t in enumerate(texts):
                n += len(t or "")
                if n > GROUP_BYTES or k + 1 == len(texts):
                    scores += own.score(*encode(texts[a : k + 1])).tolist() if own is not None else [0.5] * (k + 1 - a)
                    a, n = k + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))
