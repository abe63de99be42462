"""Personal data by boosted trees over candidate spans.

Fixed patterns find the plain forms of e-mail and IP addresses, card and phone
numbers; those spans always stay.  Wider generators propose further, overlapping
spans (addresses spelt out, numbers without a plus, ...).  Boosted trees judge
each by its format and its surroundings, and a threshold per kind, calibrated on
samples that were not used for training, selects what else is personal data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits can only match from its start, which keeps the search linear
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: wide generators: spelt-out addresses, numbers in groups
WIDE_EMAIL = re.compile(
    r"(?<![\w.%+-])[\w.%+-]{1,64}(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at | AT | @ )[\w-]{1,63}"
    r"(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot | DOT |\.)[\w-]{1,63}){1,5}")
WIDE_NUMBER = re.compile(r"(?<![\w.])[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9]){6,24}(?![\w])")
GROUPS = re.compile(r"[0-9]+")
DIGIT = re.compile(r"[0-9]")
CONTEXT = 32
WORDS_NEAR = {
    "email": ("mail", "contact", "write", "@", "address", "reach"),
    "ip": ("ip", "host", "server", "addr", "log", "from"),
    "card": ("card", "visa", "credit", "pay", "account", "expir"),
    "phone": ("call", "phone", "tel", "mobile", "fax", "contact"),
    "none": ("version", "token", "password", "id", "order", "isbn", "v.", "key", "=", "#"),
}

#: bounds of the training sample: documents with a candidate, and spans of each kind
SAMPLE_DOCS, SAMPLE_SPANS = 3000, 4000
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 3, 0.2, 32, 10
PRECISION = 0.995


class Model(NamedTuple):
    edges: np.ndarray  # bin edges of each feature
    trees: list  # (feature, bin) of each inner node and the leaf values, per tree and kind
    thresholds: dict[str, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain forms: leftmost spans of each kind, failing ones dropped."""
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    if DIGIT.search(text) is None:
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in m.groups())]
    for kind, pattern, least, most in (("card", CARD, 13, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = "".join(GROUPS.findall(m.group()))
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, of every kind that they resemble."""
    out = []
    if " at " in text or " AT " in text or "@" in text or "(at" in text.lower() or "[at" in text.lower():
        out += [("email", m.start(), m.end()) for m in WIDE_EMAIL.finditer(text)]
    if DIGIT.search(text) is None:
        return out
    for m in WIDE_NUMBER.finditer(text):
        s = m.group()
        n = len(GROUPS.findall(s))
        digits = sum(map(len, GROUPS.findall(s)))
        if n == 4 and "." in s:
            out.append(("ip", m.start(), m.end()))
        if 12 <= digits <= 19:
            out.append(("card", m.start(), m.end()))
        if 7 <= digits <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of a span and what stands around it."""
    s = text[start:end]
    groups = GROUPS.findall(s)
    digits = "".join(groups)
    before, after = text[max(0, start - CONTEXT):start].lower(), text[end:end + CONTEXT].lower()
    sizes = [len(g) for g in groups] or [0]
    near = before + " " + after
    return [
        len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], s.count("."), s.count("-"), s.count(" "),
        s.count("(") + s.count("["), s.startswith("+"), s.startswith("("), s.lower().count("dot"), " at " in s.lower(), "@" in s,
        luhn(digits) if digits else 0, max((int(g[:6]) for g in groups), default=0) <= 255,
        int(digits[:1] or 0), len(s.rsplit(".", 1)[-1]) if "." in s else 0,
        before[-1:].isspace() or not before, before[-1:] in "=\"'#:/", after[:1].isalnum(), after[:1].isspace() or not after,
        sum(c.isdigit() for c in near), *(sum(w in near for w in WORDS_NEAR[k]) for k in (kind, "none")),
    ]


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[list, np.ndarray]:
    """One tree of fixed depth on binned features: inner nodes level by level, leaf values."""
    node = np.zeros(len(x), np.int64)
    inner = []
    for level in range(DEPTH):
        width = 1 << level
        best = [(0.0, 0, BINS)] * width
        for f in range(x.shape[1]):
            key = node * BINS + x[:, f]
            g = np.bincount(key, weights=grad, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
            h = np.bincount(key, weights=hess, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
            n = np.bincount(key, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
            gain = g ** 2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1) - g[:, -1:] ** 2 / (h[:, -1:] + 1)
            gain[(n < MIN_LEAF) | (n[:, -1:] - n < MIN_LEAF)] = 0
            at = gain.argmax(axis=1)
            for k in range(width):
                if gain[k, at[k]] > best[k][0] + 1e-9:
                    best[k] = (gain[k, at[k]], f, int(at[k]))
        inner.append([(f, b) for _, f, b in best])
        split = np.array(inner[-1])
        node = node * 2 + (x[np.arange(len(x)), split[node, 0]] > split[node, 1])
    leaves = -np.bincount(node, weights=grad, minlength=1 << DEPTH) / (np.bincount(node, weights=hess, minlength=1 << DEPTH) + 1)
    return inner, leaves * RATE


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1) if len(x) else \
        np.zeros((0, len(edges)), np.int64)


def _sum_of_trees(x: np.ndarray, trees: list) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for inner, leaves in trees:
        node = np.zeros(len(x), np.int64)
        for split in map(np.array, inner):
            node = node * 2 + (x[rows, split[node, 0]] > split[node, 1])
        total += leaves[node]
    return total


def _boost(x: np.ndarray, y: np.ndarray) -> list:
    total = np.zeros(len(x))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        trees.append(_grow(x, weight * (p - y), weight * p * (1 - p)))
        total += _sum_of_trees(x, trees[-1:])
    return trees


def _variants(text: str, kind: str, start: int, end: int) -> list[tuple[str, int, int, int]]:
    """Texts with the span written in another way, and whether it is still personal data."""
    s = text[start:end]
    left, right = text[max(0, start - 64):start], text[end:end + 64]
    digits = "".join(GROUPS.findall(s))
    forms = [(s, 1)]
    if kind == "email":
        name, _, host = s.partition("@")
        bare, plain_host = re.sub(r"[\W\d]+", "", name) or "x", re.sub(r"[0-9]+", "", host)
        for who, where in ((name, host), (f"{bare[:3]}.{bare}", plain_host), (bare, plain_host)):
            forms += [(f"{who} at {where.replace('.', ' dot ')}", 1), (f"{who} [at] {where}", 1), (f"{who}(at){where.replace('.', '(dot)')}", 1),
                      (f"{who} (at) {where.replace('.', ' (dot) ')}", 1)]
        tail = re.findall(r"\w+", right)[:3]
        if len(tail) == 3:
            forms += [(f"{tail[0]} at {tail[1]}.{tail[2]}", 0), (f"{tail[0]} at {tail[1]} dot {tail[2]}", 0)]
    elif kind == "ip":
        forms += [(".".join(str(int(g[:3]) + 300) for g in GROUPS.findall(s)), 0), ("v" + s, 0)]
    elif kind == "card":
        forms += [("-".join(digits[i:i + 4] for i in range(0, len(digits), 4)), 1), (".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), 1),
                  (digits[:-1] + str((int(digits[-1]) + 1) % 10), 0)]
    else:
        body = digits[-10:]
        forms += [(f"({body[:3]}) {body[3:6]}-{body[6:]}", 1), (f"{body[:3]}-{body[3:6]}-{body[6:]}", 1), (f"{body[:3]}.{body[3:6]}.{body[6:]}", 1),
                  (body, 0), (f"{body[0]}.{body[1]}.{body[2]}.{body[3:]}", 0), (f"{body[0]}.{body[1:3]}.{body[3:]}", 0), (f"{body[:4]}-{body[4:6]}-{body[6:8]} {body[8:]}", 0)]
    return [(left + f + right, len(left), len(left) + len(f), y) for f, y in forms]


def fit(docs: DataFrame) -> Model:
    """Trains on spans of a bounded sample of documents.

    There are no labelled spans, so the plain forms are the seeds: rewritten in
    other usual ways they stay personal data, spoilt ones are not, and neither
    are proposals that no plain form explains.  Half of the spans train the
    trees, the other half set each kind's threshold: the lowest at which the
    chosen share of the selected spans is right.
    """
    # the sample is cut by hash: only hashes are ordered, the texts stay where they are
    with_signs = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").rlike("@|[0-9]{4}"))
    last = with_signs.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    rows = with_signs.where(F.col("h") <= F.lit(last)).select("text").distinct()

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                plain = base_spans(t)
                for kind, s, e in plain:
                    for v, vs, ve, y in _variants(t, kind, s, e):
                        out.append((kind, y, [float(v) for v in features(v, kind, vs, ve)]))
                for kind, s, e in candidates(t):
                    if not any(s < pe and ps < e for _, ps, pe in plain):
                        out.append((kind, 0, [float(v) for v in features(t, kind, s, e)]))
            yield pd.DataFrame(out, columns=["kind", "y", "x"])

    spans = rows.mapInPandas(seen, "kind string, y int, x array<double>")
    found = spans.where(F.col("kind").isNotNull())
    kept = None
    for kind in KINDS:
        part = found.where(F.col("kind") == kind).orderBy(F.xxhash64("x"), "y").limit(SAMPLE_SPANS)
        kept = part if kept is None else kept.union(part)
    sample = kept.toPandas()
    width = len(features("", "email", 0, 0))
    x = np.array(sample["x"].tolist(), float).reshape(len(sample), width)
    edges = np.quantile(x, np.linspace(0, 1, BINS)[1:], axis=0).T if len(x) else np.zeros((width, BINS - 1))
    binned = _binned(x, edges).clip(max=BINS - 1)
    trees: list = []
    thresholds = {}
    for kind in KINDS:
        at = np.flatnonzero((sample["kind"] == kind).to_numpy())
        y = sample["y"].to_numpy()[at].astype(float) if len(at) else np.zeros(0)
        if len(at) < 4 * MIN_LEAF or y.min() == y.max():
            trees.append([])
            thresholds[kind] = 2.0  # nothing was learnt: only plain forms are taken
            continue
        trees.append(_boost(binned[at[::2]], y[::2]))
        p = 1 / (1 + np.exp(-_sum_of_trees(binned[at[1::2]], trees[-1])))
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[1::2][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = max(0.5, float(p[order[good[-1]]])) if good.size else 2.0
    return Model(edges, trees, thresholds)


def select(model: Model, text: str) -> tuple[list, list]:
    """Plain spans, and all selected spans: the plain ones and the best further
    candidates that overlap none selected before."""
    plain = base_spans(text)
    taken = list(plain)
    further = [c for c in candidates(text) if c not in plain]
    scored = []
    for k, kind in enumerate(KINDS):
        mine = [c for c in further if c[0] == kind]
        if mine and model.trees[k]:
            x = _binned(np.array([features(text, *c) for c in mine], float), model.edges).clip(max=BINS - 1)
            p = 1 / (1 + np.exp(-_sum_of_trees(x, model.trees[k])))
            scored += [(-q, c) for q, c in zip(p, mine) if q >= model.thresholds[kind]]
    busy = sorted((s, e) for _, s, e in taken)
    for _, (kind, s, e) in sorted(scored):
        if not any(s < be and bs < e for bs, be in busy):
            taken.append((kind, s, e))
            busy.append((s, e))
    rank = {k: i for i, k in enumerate(KINDS)}
    return plain, sorted(taken, key=lambda c: (rank[c[0]], c[1], c[2]))


def find(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Plain and selected spans of every whole text.

    One row per input row: the columns named in ``keep``, ``plain`` and
    ``spans``, arrays of (kind, start, end) in code points, the end exclusive,
    ordered by kind and start.  A null or empty text has none; null ids and
    repeated rows are kept; further columns of any name are not looked at.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            both = [select(model, t) for t in texts]
            as_rows = [[[{"kind": k, "start": s, "end": e} for k, s, e in side] for side in pair] for pair in both]
            yield pd.DataFrame({"plain": [r[0] for r in as_rows], "spans": [r[1] for r in as_rows]}, columns=["plain", "spans"])

    span = "array<struct<kind: string, start: int, end: int>>"
    found = F.pandas_udf(run, f"plain {span}, spans {span}")
    return docs.select(*keep, found(F.coalesce("text", F.lit(""))).alias("__found")).select(*keep, "__found.plain", "__found.spans")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each selected span replaced by its kind; of overlapping
    spans the one that starts first, and the longer one, stands for both."""
    out, done = [], 0
    for kind, s, e in sorted(spans, key=lambda c: (c[1], -c[2])):
        if s >= done:
            out += [text[done:s], f"[{kind}]"]
        done = max(done, e)
    return "".join(out) + text[done:]

