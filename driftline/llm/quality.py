"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded by a score quantile.

A labelled sample of at most ``sample`` documents (the documented bound; one row each, whatever repeats) gives pairs of
a good and a bad document: all of them, or where there are more than ``pairs`` of them that many, spread evenly (the other
documented bound).
The chance that the good one is preferred is sigmoid(s(good) - s(bad)), s linear in the features; the weights
minimise the logistic loss on feature differences. The threshold is the quantile of the sample's scores at the
share of bad rows, in the middle of the gap there; ``score`` is a sigmoid that takes 0.7 at the threshold.

Features come from the whole text alone: byte-class shares and repetition. Null text counts as empty. Without
both labels in the sample nothing is rejected: every score is 1. Repeated rows and rows with a null doc_id are
scored like any other; columns besides the id and the text are not read. An id with labels of both kinds is left out of
the sample; of several texts with one id, the one with the least features is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

#: Labelled documents, and pairs of them, that the weights are learned from at most.
SAMPLE = 6000
PAIRS = 40_000
CUT = 0.7

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!?", b".,;:", b"|", b"#$%&*@^~=<>\\/{}[]_+", b"()\"'-", b" ", b"\n\r\t", bytes(range(128, 256))]
_BY_BYTE = np.zeros((256, len(_CLASSES)))
for _k, _chars in enumerate(_CLASSES):
    _BY_BYTE[list(_chars), _k] = 1


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _BY_BYTE / size
    words = raw.lower().split()
    n = max(len(words), 1)
    lines = [x for x in raw.splitlines() if x.strip()]
    kinds = len(set(words))
    triples = len(words) - 2
    rest = [
        math.log1p(len(words)) / 10,
        kinds / n,
        kinds / math.sqrt(n) / 10,
        math.log((1 + kinds) / (1 + len(words))),
        len(set(lines)) / max(len(lines), 1),
        len(set(zip(words, words[1:], words[2:], strict=False))) / triples if triples > 0 else 1.0,
        sum(map(len, words)) / n / 10,
        max(map(len, words), default=0) / 100,
        (raw.count(b". ") + raw.count(b".\n")) / n,
        raw.count(b" | ") / n,
        sum(w[-1:] in b"!#$%&*@" for w in words) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(not words),
    ]
    return [1.0, *share.tolist(), *np.sqrt(share).tolist(), *rest]


@dataclass(frozen=True)
class Model:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.ones(len(x))
        raw = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + math.log(CUT / (1 - CUT)), -500, 500)))


def _pairs(good: int, bad: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """As many distinct pairs as wanted, or all there are, spread evenly over both sides."""
    picks = np.linspace(0, good * bad - 1, min(wanted, good * bad)).astype(np.int64)
    return picks // bad, (picks % bad + picks // bad) % bad


def learn(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 30) -> Model:
    """Newton steps on the mean logistic loss of the pairs' feature differences; the order of rows doesn't matter."""
    order = np.lexsort((*x.T[::-1], y)) if len(x) else []
    x, y = x[order], y[order]
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model((), (), (), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    i, j = _pairs(len(good), len(bad), pairs)
    d = (good[i] - bad[j]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        grad = -(d * p[:, None]).mean(0) + ridge * w
        if np.abs(grad).max() < 1e-7:
            break
        w -= np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w)), grad)
    s = np.sort((x - mean) / scale @ w)
    k = min(max(len(bad), 1), len(s) - 1)
    return Model(tuple(mean), tuple(scale), tuple(w), float((s[k - 1] + s[k]) / 2))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        x = [features(t) for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents that aren't held out, the first by a hash of the id."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    ids = known.where("quality = most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample has at most `sample` rows of two numbers, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "quality", "text")
    found = chosen.mapInArrow(_features_of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, quality int, x array<double>")
    rows = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()  # at most `sample` rows
    if not len(rows):
        return Model((), (), (), 0.0)
    return learn(np.stack(rows["x"].to_numpy()), rows["quality"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1: score >= 0.7), in place of columns of these names if there are any;
    all other columns of ``docs`` stay."""
    base = docs.drop("score", "predicted")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(np.array([features(t) for t in texts(b.column("text"))]))
            cols = [*b.columns, pa.array(s), pa.array((s >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted"])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(run, schema)
