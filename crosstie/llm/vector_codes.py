"""Vector codes: product quantisation in exact integers.

Components become integers, vectors are cut into equal parts, and each part is
named by the nearest entry of its codebook.  Distances are taken as
|a|^2 - 2 ab + |b|^2 with the products from float64 matrix multiplication: the
integers are broken into limbs so small that every sum of products stays below
2^53, where float64 is exact, and the limbs' products are put together in int64.
The first least distance wins.

Codebooks are a few thousand integers; their sums are made inside the tasks and
added by Spark, so a pass moves one small row set per task whatever the input.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import saved, ship, small

ship(__name__)

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def largest(dim: int) -> int:
    """Integers up to this size keep the distance of two vectors below 2^62."""
    return math.isqrt(2**62 // max(dim, 1)) // 2


def limbs(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Parts of the integers, lowest first, as float64: their sum times 2^(bits k) is ``a``."""
    out, rest = [], a
    while not out or rest.any():
        if ((rest >= -(1 << bits)) & (rest < (1 << bits))).all():
            out.append(rest.astype(np.float64))
            break
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a b^T of int64 matrices whose products fit int64."""
    bits = (53 - max(a.shape[1], 1).bit_length()) // 2
    out = np.zeros((a.shape[0], b.shape[0]), np.int64)
    second = limbs(b, bits)
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(second):
            out += (x @ y.T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of every part, the lowest of equal ones, and
    its squared distance.  ``parts`` is (n, parts, width), ``books`` (parts, entries, width)."""
    codes = np.empty(parts.shape[:2], np.int64)
    gaps = np.empty(parts.shape[:2], np.int64)
    for p in range(parts.shape[1]):
        a, b = np.ascontiguousarray(parts[:, p]), books[p]
        d = (a * a).sum(1)[:, None] - 2 * products(a, b) + (b * b).sum(1)[None]
        codes[:, p] = d.argmin(1)
        gaps[:, p] = d[np.arange(len(a)), codes[:, p]]
    return codes, gaps


def _integers(vectors: pa.ListArray, dim: int, n_parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be encoded, and their integers by part; a last part that
    is too short is filled with zeros, which changes no distance."""
    usable = pc.list_value_length(vectors).to_numpy(zero_copy_only=False) == dim
    width = -(-dim // n_parts)
    floats = vectors.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False).reshape(int(usable.sum()), dim)
    with np.errstate(over="ignore"):
        floats = np.floor(floats * scale)
    fits = (np.abs(floats) <= largest(dim)).all(1)
    usable[usable] = fits
    out = np.zeros((int(fits.sum()), n_parts * width), np.int64)
    out[:, :dim] = floats[fits].astype(np.int64)
    return usable, out.reshape(len(out), n_parts, width)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def train(rows: DataFrame, dim: int, n_parts: int, n_entries: int, rounds: int, scale: int) -> np.ndarray:
    """Codebooks (parts, entries, width) after some rounds.  ``rows``: id, v."""
    first = rows.where(F.col("id").isNotNull() & (F.size("v") == dim) & F.forall("v", lambda x: F.abs(x * scale) <= largest(dim)))
    start = first.orderBy("id", "v").limit(n_entries).select("v").toArrow()["v"].combine_chunks()
    _, books = _integers(start, dim, n_parts, scale)
    books = np.ascontiguousarray(books.transpose(1, 0, 2))
    width, n = books.shape[2], books.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((n_parts, n), np.int64)
        for batch in batches:
            _, parts = _integers(batch["v"], dim, n_parts, scale)
            codes, _ = nearest(parts, books)
            for p in range(n_parts):
                count[p] += np.bincount(codes[:, p], minlength=n)
                np.add.at(total[p], codes[:, p], parts[:, p])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"p": p, "e": e, "n": count[p, e], "s": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    for _ in range(rounds if n else 0):
        made = rows.select("v").mapInArrow(sums, "p long, e long, n long, s array<long>")
        # decimal sums: no input is large enough to overflow them
        added = made.select("p", "e", "n", F.posexplode("s").alias("i", "x")).groupBy("p", "e", "i").agg(
            F.sum(F.col("x").cast("decimal(20,0)")).alias("x"), F.sum("n").alias("n"))
        books = books.copy()
        for p, e, i, x, k in added.collect():  # at most parts x entries x width rows
            books[p, e, i] = int(x) // int(k)
    return books


def compress(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id",
             vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """Codes and errors of the vectors, and the codebooks.

    Returns the id, the label, ``code`` (array of entry numbers), ``error``
    (squared distances summed over the parts) and ``label_error`` (errors summed
    over equal labels, nulls together).  Rows are left out whose vector is null or
    holds null or non-finite components.  The codebooks start with the smallest
    ids (equal ids by their vectors); rows without an id are encoded and learnt
    from but never start an entry.  The length is that of the vector with the
    smallest id that has any; vectors of another length, and those with integers
    beyond ``largest``, stay with a null code and error.  A length that the parts
    do not divide is filled up with zeros.  Repeated rows are encoded and counted
    each.  Other columns of any name are not looked at.
    """
    rows = vectors.where(_finite(F.col(vector_col))).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    smallest = rows.where("id IS NOT NULL AND size(v) > 0").orderBy("id", "v").limit(1).select(F.size("v")).collect()
    dim = smallest[0][0] if smallest else 0
    books = train(rows, dim, n_parts, n_entries, rounds, scale)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, parts = _integers(batch["v"], dim, n_parts, scale)
            if not books.shape[1]:
                usable[:] = False
            found, errors = np.zeros((0, n_parts), np.int64), np.zeros(len(usable), np.int64)
            if usable.any():
                found, gaps = nearest(parts, books)
                errors[usable] = gaps.sum(1)
            starts = np.concatenate([[0], np.cumsum(usable * n_parts)])
            codes = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found.ravel(), pa.int32()), mask=pa.array(~usable))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], codes, pa.array(errors, mask=~usable)], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = saved(rows.mapInArrow(encode, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long"), "vector-codes")
    by_label = saved(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).cast("long").alias("label_error")), "label-errors")
    by_label = small(by_label.withColumnRenamed("label", "other"), by_label.count())
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("other")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
