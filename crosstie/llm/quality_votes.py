"""Quality by nearest-neighbour votes in a latent space.

A bounded sample of labelled documents is turned into weighted term vectors and
reduced by a singular value decomposition.  The labelled latent vectors go to
every task; each document's vector is multiplied with all of them, block by
block, and its nearest labelled neighbours vote with their cosine as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import ship

ship(__name__)

#: hashed byte triples, hashed triples of byte classes, and measures of repetition
TEXT_TERMS, CLASS_TERMS, MEASURES = 640, 320, 8
TERMS = TEXT_TERMS + CLASS_TERMS + MEASURES
MEASURE_WEIGHT = 6.0
#: labelled documents of each class that are kept, and latent dimensions
PER_CLASS, LATENT = 2000, 48
NEIGHBOURS, BLOCK = 25, 256


class Model(NamedTuple):
    weights: np.ndarray  # per term
    axes: np.ndarray  # terms x latent
    vectors: np.ndarray  # labelled x latent, unit length
    labels: np.ndarray


def _byte_classes() -> np.ndarray:
    """One class per kind of byte; punctuation keeps a class of its own."""
    table = np.full(256, 1, np.int64)  # bytes of non-ASCII letters
    for b in range(128):
        c = chr(b)
        table[b] = (2 if c.islower() else 3 if c.isupper() else 4 if c.isdigit() else 5 if c == "\n" else 6 if c.isspace()
                    else 7 + b % 57)
    return table


_CLASSES = _byte_classes()


def _triples(codes: np.ndarray, buckets: int) -> np.ndarray:
    if codes.size < 3:
        return np.zeros(buckets, np.float32)
    mixed = (codes[:-2] * 65_599 + codes[1:-1]) * 65_599 + codes[2:]
    mixed = (mixed * 2_654_435_761 >> 16) & 0x7FFFFFFF
    return np.bincount(mixed % buckets, minlength=buckets).astype(np.float32)


def _repetition(text: str) -> np.ndarray:
    ws = text.split()
    out = np.zeros(MEASURES, np.float32)
    if not ws:
        return out
    h = np.fromiter(map(hash, ws), np.int64, len(ws))
    n = len(ws)
    distinct = np.unique(h).size / n
    out[0] = (h[1:] == h[:-1]).mean() if n > 1 else 0
    out[1] = max(0.0, 0.4 - distinct) if n >= 20 else 0
    if n > 3:
        with np.errstate(over="ignore"):
            g = (h[:-2] * 31 + h[1:-1]) * 31 + h[2:]
        out[2] = 1 - np.unique(g).size / g.size
    lines = [x for x in text.split("\n") if x.strip()]
    out[3] = 1 - len(set(lines)) / len(lines)
    out[4] = sum(w.isupper() for w in ws) / n
    out[5] = sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in ws) / n
    out[6] = sum(not w[0].isalnum() for w in ws) / n
    out[7] = 1.0 if n < 20 else 0.0
    return out


def term_vectors(texts: list[str]) -> np.ndarray:
    """Dampened term counts of whole texts, one row each."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.int64)
        for counts, at in ((_triples(raw, TEXT_TERMS), 0), (_triples(_CLASSES[raw], CLASS_TERMS), TEXT_TERMS)):
            total = counts.sum()
            if total:
                out[i, at:at + counts.size] = np.sqrt(counts / total)  # each family has unit length
        out[i, -MEASURES:] = _repetition(text)
    return out


def _labelled(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int) -> pd.DataFrame:
    """Term vectors and labels of at most ``per_class`` documents per class.

    The documents with the smallest hash of their id are taken; a repeated id
    counts once, with its smallest label and one of its texts.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = one.where("y = 0").orderBy(order, "doc_id").limit(per_class).union(one.where("y = 1").orderBy(order, "doc_id").limit(per_class))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "v": [v.tobytes() for v in term_vectors(b["text"].tolist())]})

    rows = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
        .mapInPandas(vectors, "doc_id long, y int, v binary").toPandas()
    )
    return rows.sort_values(["doc_id", "v"]).drop_duplicates("doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, latent: int = LATENT) -> Model:
    """Latent space and labelled vectors from a bounded sample of labelled rows."""
    rows = _labelled(docs, labels, label_col, per_class)
    y = rows["y"].to_numpy(np.float32)
    if not len(rows):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, latent), np.float32), np.zeros((0, latent), np.float32), y)
    x = np.stack([np.frombuffer(v, np.float32) for v in rows["v"]])
    seen = (x > 0).mean(axis=0)
    weights = np.log((1 + 1) / (seen + 1e-3) + 1).astype(np.float32)
    weights[-MEASURES:] = MEASURE_WEIGHT
    x = x * weights
    _, vectors = np.linalg.eigh(x.T @ x)
    axes = vectors[:, ::-1][:, :latent].astype(np.float32)
    return Model(weights, axes, _unit(x @ axes), y)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def votes(model: Model, texts: list[str], neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest labelled neighbours, by similarity.

    All cosines are computed.  Without labelled rows, or without a positive
    cosine, the result is the labelled share of 1, or a half without labels.
    """
    prior = float(model.labels.mean()) if model.labels.size else 0.5
    out = np.full(len(texts), prior)
    if not model.labels.size:
        return out
    k = min(neighbours, model.labels.size)
    for i in range(0, len(texts), BLOCK):
        z = _unit((term_vectors(texts[i:i + BLOCK]) * model.weights) @ model.axes)
        cos = z @ model.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(cos, near, axis=1), 0) ** 8
        total = w.sum(axis=1)
        found = total > 1e-9
        out[i:i + BLOCK][found] = ((w * model.labels[near]).sum(axis=1)[found] / total[found])
    return out


def score(docs: DataFrame, model: Model, threshold: float = 0.5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns named in ``keep``.

    One row per input row.  A null text is scored as the empty text, null ids
    and repeated rows are kept, further columns of any name are not looked at.
    """
    # the model, at most 2 x PER_CLASS rows of LATENT numbers, is broadcast to the workers with the function
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(votes(model, ["" if t is None else t for t in texts]))

    voted = F.pandas_udf(run, "double")
    out = docs.select(*keep, voted(F.coalesce("text", F.lit(""))).alias("__score"))
    return out.select(*keep, F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
