"""Toxic text by a subsequence string kernel.

Pieces (words, and letters spelt out one by one) are compared by the subsequences
of four letters that they share, each gap lowering the weight, so inserted
characters and changed endings cost little.  A support vector machine is trained
in the Nyström space of some landmark pieces.  As the kernel is a product of
explicit subsequence weights, the trained function is folded into one weight per
subsequence; the score of a sentence is that of its most toxic piece.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import saved, ship

ship(__name__)

#: places (relative to the first letter) of four- and five-letter subsequences, and the weight of their gaps
PATTERNS = [((1, 2, 3), 1.0), ((1, 2, 4), 0.5), ((1, 3, 4), 0.5), ((2, 3, 4), 0.5),
            ((1, 2, 3, 4), 1.0), ((1, 2, 3, 5), 0.5), ((1, 2, 4, 5), 0.5), ((1, 3, 4, 5), 0.5), ((2, 3, 4, 5), 0.5)]
BUCKETS = 1 << 18
#: letters of a piece; longer pieces are cut into overlapping parts
PIECE, OVERLAP = 24, 12
#: bounds of the training sample
DOCS_PER_CLASS, TOXIC_PIECES, CLEAN_PIECES, HARD_PIECES, LANDMARKS = 3000, 1500, 12_000, 4000, 320
#: letters of a stem, and the chance at which toxic documents hold a piece too often
STEM, CHANCE = 6, 1e-7
#: toxic pieces that are altered, altered copies of each, steepness of the calibration
ALTERED, COPIES, SLOPE = 300, 6, 4.0
#: signs that stand for letters
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
SPELT = re.compile(r"(?<!\S)(?:\w[\s.*_-]{1,2}){3,}\w(?!\w)")
SENTENCE = re.compile(r"[.!?]\s|\n")
CACHE = 400_000


class Model(NamedTuple):
    weights: np.ndarray  # per bucket of subsequences
    bias: float
    slope: float  # calibration of the best piece of a document
    shift: float


def letters(word: str) -> str:
    """Lower-case letters of a word; look-alike signs count as letters when
    the word holds letters besides."""
    low = word.lower()
    if low.isalpha() or (low := low.strip(".,;:!?\"'()")).isalpha():
        return low
    if any(c.isalpha() for c in low):
        low = low.strip("$@").translate(LOOKALIKE) if low[-1:].isalpha() else low.rstrip(".,;:!?\"')").translate(LOOKALIKE)
    return "".join(c for c in unicodedata.normalize("NFC", low) if c.isalpha())


def parts(word: str) -> list[str]:
    """Letters of a word between marks of its start and end, long words in parts."""
    s = letters(word)
    if len(s) < 4:
        return []
    s = f"^{s}$"
    if len(s) <= PIECE:
        return [s]
    return [s[i:i + PIECE] for i in range(0, len(s) - OVERLAP, PIECE - OVERLAP)]


def _altered(pieces: list[str], copies: int) -> list[str]:
    """Copies with a letter put in or doubled at a place that follows from the piece."""
    out = []
    for p in pieces:
        for k in range(copies):
            seed = zlib.crc32(f"{p}{k}".encode())
            at = 2 + seed % max(1, len(p) - 3)
            out.append(p[:at] + (p[at - 1] if k % 3 == 0 else "abcdefghijklmnopqrstuvwxyz"[seed // 97 % 26]) + p[at:])
    return out


def raw_pieces(text: str) -> set[str]:
    """Words of a whole text, and its words spelt out letter by letter."""
    out = set(text.split())
    for m in SPELT.finditer(text):
        out.add(re.sub(r"[\W_]", "", m.group()))
    return out


def subsequences(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece number, bucket and weight of every subsequence of the pieces."""
    n = max(map(len, pieces), default=1)
    width = n + 5
    codes = np.array(pieces, dtype=f"<U{width}").view(np.uint32).reshape(len(pieces), width).astype(np.int64)
    rows, ids, values = [], [], []
    for at, weight in PATTERNS:
        r, col = np.nonzero(codes[:, at[-1]:at[-1] + n])
        key = codes[r, col]
        for k in at:
            key = key * 1_000_003 + codes[r, col + k]
        key ^= key >> 29
        rows.append(r)
        ids.append((key * 0x9E3779B97F4A7C1 >> 20) & (BUCKETS - 1))
        values.append(np.full(r.size, weight))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def _norms(pieces: list[str]) -> np.ndarray:
    """Root of the summed squared weights, which depends on the length alone."""
    by_length = np.array([sum(w * w * max(0, n - at[-1]) for at, w in PATTERNS) for n in range(PIECE + OVERLAP + 2)])
    return np.sqrt(by_length[[len(p) for p in pieces]])


def piece_values(model: Model, pieces: list[str]) -> np.ndarray:
    """The trained function at each piece (letters only)."""
    if not pieces:
        return np.zeros(0)
    rows, ids, values = subsequences(pieces)
    norms = _norms(pieces)
    product = np.bincount(rows, weights=values * model.weights[ids], minlength=len(pieces))
    return product / np.maximum(norms, 1e-9) + model.bias


def best_values(model: Model, texts: list[str], cache: dict[str, float]) -> np.ndarray:
    """Largest value over the pieces of each whole text; the bias at least."""
    sets = [raw_pieces(t) for t in texts]
    if len(cache) > CACHE:
        cache.clear()
    fresh = [w for w in set().union(*sets) if w not in cache] if sets else []
    for i in range(0, len(fresh), 20_000):
        some = fresh[i:i + 20_000]
        cut = [parts(w) for w in some]
        flat = [p for ps in cut for p in ps]
        value = piece_values(model, flat)
        at = 0
        for w, ps in zip(some, cut):
            cache[w] = max(value[at:at + len(ps)], default=model.bias)
            at += len(ps)
    return np.array([max(map(cache.__getitem__, s), default=model.bias) for s in sets])


def _support_vectors(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    balance = weight * np.where(y > 0, 0.5 / weight[y > 0].sum(), 0.5 / weight[y < 0].sum()) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xa, ca = x[active], (c * balance[active])[:, None]
        new = np.linalg.solve(ridge + xa.T @ (xa * ca), xa.T @ (ca[:, 0] * y[active]))
        if np.allclose(new, w, atol=1e-7):
            break
        w = 0.5 * w + 0.5 * new if _ > 5 else new
    return w


def _train(toxic: dict[str, float], clean: list[str]) -> tuple[np.ndarray, float]:
    """Nyström map on landmarks of both kinds, machine, and folding."""
    marks = list(toxic)[:LANDMARKS // 2] + clean[:LANDMARKS // 2]
    pieces = [*toxic, *clean]
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    rows, ids, values = subsequences(marks)
    known, col = np.unique(ids, return_inverse=True)
    phi = np.zeros((len(marks), known.size))
    np.add.at(phi, (rows, col), values)
    phi /= np.maximum(np.linalg.norm(phi, axis=1, keepdims=True), 1e-9)
    lam, vec = np.linalg.eigh(phi @ phi.T)
    good = lam > 1e-6
    root = vec[:, good] / np.sqrt(lam[good])
    kernel = np.zeros((len(pieces), len(marks)))
    for i in range(0, len(pieces), 2000):
        some = pieces[i:i + 2000]
        r, k, v = subsequences(some)
        norms = _norms(some)
        at = np.searchsorted(known, k).clip(max=known.size - 1)
        hit = known[at] == k
        dense = np.zeros((len(some), known.size), np.float32)
        np.add.at(dense, (r[hit], at[hit]), v[hit])
        kernel[i:i + len(some)] = dense @ phi.T / np.maximum(norms, 1e-9)[:, None]
    w = _support_vectors(kernel @ root, y, np.r_[list(toxic.values()), np.ones(len(clean))])
    weights = np.zeros(BUCKETS, np.float32)
    weights[known] = (root @ w[:-1]) @ phi
    return weights, float(w[-1])


def _calibrated(values: np.ndarray, y: np.ndarray, threshold: float) -> tuple[float, float]:
    """Logistic curve that reaches the threshold midway between the upper end of
    the clean and the lower end of the toxic documents of the sample."""
    clean, toxic = np.quantile(values[y == 0], 0.995), np.quantile(values[y > 0], 0.1)
    cut = max((clean + toxic) / 2, np.quantile(values[y == 0], 0.95))
    return SLOPE, float(np.log(threshold / (1 - threshold)) - SLOPE * cut)


def _sample(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """At most ``DOCS_PER_CLASS`` labelled texts of each class: the smallest hashes of the id."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("y"))
    order = F.xxhash64(F.lit("sample"), "doc_id")
    picked = one.where("y = 0").orderBy(order, "doc_id").limit(DOCS_PER_CLASS).union(
        one.where("y = 1").orderBy(order, "doc_id").limit(DOCS_PER_CLASS))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", threshold: float = 0.3) -> Model:
    """Trains on the sentences of a bounded sample of labelled documents.

    Every sentence of a clean document is clean.  A sentence of a toxic document
    is labelled toxic by those of its pieces that toxic documents hold far too
    often for chance and clean ones hardly ever, taken by themselves or with the
    pieces that begin with the same five letters; its other pieces say nothing
    and are left out.  The clean pieces nearest to the first machine join the
    clean side of the second.  Without both classes the score is constant.
    """
    sample = saved(_sample(docs, labels, label_col), "toxicity-sample")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 2.0 if sizes.get(1) else -2.0)
    least = math.ceil(math.log(CHANCE) / math.log(sizes[1] / (sizes[0] + sizes[1])))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = []
            for y, t in zip(b["y"], b["text"]):
                found = {q for s in SENTENCE.split(t) for w in raw_pieces(s) for q in parts(w)}
                seen += [(y, p, False) for p in found] + [(y, p, True) for p in {q[:STEM] for q in found}]
            yield pd.DataFrame(seen, columns=["y", "piece", "is_stem"])

    counted = saved(
        sample.mapInPandas(pieces, "y int, piece string, is_stem boolean").groupBy("piece", "is_stem")
        .agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")), "toxicity-pieces")
    telling = counted.where((F.col("toxic") >= least) & (F.col("clean") * 20 <= F.col("toxic")))
    whole = counted.where(~F.col("is_stem"))
    stems = telling.where("is_stem").select(F.col("piece").alias("stem"))
    marked = telling.where(~F.col("is_stem")).select("piece", "toxic").union(
        whole.where("clean = 0").join(stems, F.substring("piece", 1, STEM) == F.col("stem"), "left_semi").select("piece", "toxic"))
    # a piece weighs as the root of the toxic documents that hold it, an altered copy a part of that
    toxic = {r.piece: math.sqrt(r.n) for r in marked.groupBy("piece").agg(F.max("toxic").alias("n")).orderBy(F.desc("n"), "piece")
             .limit(TOXIC_PIECES).collect()}
    others = whole.where("clean > 0").select("piece")
    clean = [r.piece for r in others.orderBy(F.xxhash64("piece"), "piece").limit(CLEAN_PIECES).collect()]
    clean = [p for p in clean if p not in toxic]
    if not toxic or not clean:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -2.0)
    seen_clean = set(clean)
    altered = {q: toxic[p] / COPIES for p in list(toxic)[:ALTERED] for q in _altered([p], COPIES) if q not in seen_clean}
    toxic = toxic | {q: w for q, w in altered.items() if q not in toxic}
    first = Model(*_train(toxic, clean), 1.0, 0.0)

    def nearness(pieces: pd.Series) -> pd.Series:
        return pd.Series(piece_values(first, pieces.tolist()))

    hard = [r.piece for r in others.select("piece", F.pandas_udf(nearness, "double")("piece").alias("v")).orderBy(F.desc("v"), "piece").limit(HARD_PIECES).collect()]
    weights, bias = _train(toxic, clean + [p for p in dict.fromkeys(hard) if p not in seen_clean and p not in toxic])
    raw = Model(weights, bias, 1.0, 0.0)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "v": best_values(raw, b["text"].tolist(), cache)})

    seen = sample.mapInPandas(values, "y int, v double").toPandas()
    slope, shift = _calibrated(seen["v"].to_numpy(), seen["y"].to_numpy(), threshold)
    return Model(weights, bias, slope, shift)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ``score`` and ``predicted`` to the columns named in ``keep``.

    One row per input row.  A null or empty text has the score of a text
    without pieces; null ids and repeated rows are kept, further columns of any
    name are not looked at.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[str, float] = {}
        for texts in batches:
            got = np.concatenate([best_values(model, list(texts[i:i + 200]), cache) for i in range(0, len(texts), 200)]
                                 or [np.zeros(0)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * got + model.shift, -30, 30))))

    valued = F.pandas_udf(run, "double")
    out = docs.select(*keep, valued(F.coalesce("text", F.lit(""))).alias("__score"))
    return out.select(*keep, F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))
