"""Prefix trie, suffix dedup and vector codes against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstie.llm import prefix_trie, suffix_dedup, vector_codes

TURNS = "conv_id long, turn long, role string, text string, depth int"  # depth clashes with a column of the operator


def plain_trie(turns: list[tuple], ids: list[int]) -> set[tuple]:
    convs = {c: [] for c in ids}
    for c, _, role, text in sorted(turns, key=lambda t: (t[0], -1 if t[1] is None else t[1])):
        convs[c].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    out = set()
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = sum(1 for n in below if not any(m[:len(n)] == n and len(m) > len(n) for m in below))
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].split()) if n else 0) for n in below)
        text = ",".join(map(str, sorted(ends[node])))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return out


def trie_rows(spark, turns: list[tuple], ids: list[int] | None = None, **limits) -> set[tuple]:
    rows = spark.createDataFrame([(*t, 5) for t in turns], TURNS)
    if ids is None:
        made = prefix_trie.conversation_trie(rows, **limits)
    else:
        made = prefix_trie.trie(prefix_trie.numbered(rows, limits.get("long_turns", prefix_trie.LONG_TURNS)), spark.createDataFrame([(i,) for i in ids], "c long"))
    found = [tuple(r) for r in made.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("band, long_turns", [(8, 10_000), (2, 4)])
def test_trie_equals_plain_version(spark, band, long_turns):
    rng = random.Random(band)
    turns = []
    for c in range(40):
        for t in range(rng.randrange(1, 14)):
            turns.append((c, t, "user" if t % 2 == 0 else None, "x y" if rng.random() < 0.85 else rng.choice(["", None, "a b c"])))
    turns += [(77, None, None, None), (77, 1, "user", "x y")]
    rng.shuffle(turns)
    assert trie_rows(spark, turns, band=band, long_turns=long_turns) == plain_trie(turns, sorted({t[0] for t in turns}))


def test_trie_edges(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    assert trie_rows(spark, []) == set()
    assert trie_rows(spark, [(None, 1, "user", "lost")]) == set()
    # conversations without turns are members of the root; one conversation alone is a chain from the root
    assert trie_rows(spark, [], [3, 1, 3]) == {(1, 0, None, 2, 0, 1, 0, hashlib.sha256(b"1,3").hexdigest())}
    assert trie_rows(spark, [(9, 4, "u", "a")]) == {(9, 0, None, 1, 1, 1, 0, nothing), (9, 1, 9, 1, 0, 1, 0, hashlib.sha256(b"9").hexdigest())}


def test_trie_of_repeated_and_long_conversations(spark):
    long = [(1, t, "u", f"w{t % 7} v") for t in range(300)]
    turns = long + [(2, *t[1:]) for t in long] + [(3, *t[1:]) for t in long[:150]] + [(4, 0, "u", "w0 v")] * 2
    assert trie_rows(spark, turns, band=3, long_turns=50) == plain_trie(turns, [1, 2, 3, 4])


def test_common_openings(spark):
    import zlib

    rng = random.Random(4)
    turns = [(c, t, "u", rng.choice("ab")) for c in range(0, 65) if c not in (20, 33) for t in range(rng.randrange(1, 6))]
    rows = spark.createDataFrame([(*t, 5) for t in turns], TURNS)
    convs = defaultdict(list)
    for c, t, *turn in sorted(turns):
        convs[c].append((c, t, *turn))
    rebuilt = []
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt += [(c, i, *t[2:]) for i, t in enumerate(convs.get(c - c % 20, [])[:h] + own[h:])]
    for long_turns in (10_000, 3):
        made = prefix_trie.trie(prefix_trie.with_common_openings(prefix_trie.numbered(rows, long_turns), rows.select("conv_id"), 20, 3), rows.select("conv_id"))
        assert {tuple(r) for r in made.collect()} == plain_trie(rebuilt, list(convs))


def plain_suffix_dedup(texts: list[bytes]) -> list[tuple]:
    n, seen = suffix_dedup.LENGTH, defaultdict(int)
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i:i + n]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return out


def _suffix_texts() -> list[str]:
    rng = random.Random(12)

    def prose(n: int) -> str:
        return "".join(rng.choice("abcdefgh éß\n") for _ in range(n))

    base, passage = prose(2500), prose(420)
    texts = [base, base, base[300:1800], prose(200) + base[1000:2200] + prose(300)]
    texts += [prose(rng.randrange(0, 900)) + passage + prose(rng.randrange(0, 900)) for _ in range(6)]
    texts += [prose(500) + base[900:1299], prose(500) + base[900:1300], prose(500) + base[899:1305]]  # about the least length
    texts += [base[:1200] + "#" + base[1201:], base[:700] + prose(20) + base[720:1500]]  # near copies
    texts += ["z" * 1300, "ab" * 500, prose(600) * 3, prose(399), "", prose(5000)]
    texts += [base[k:k + 700] for k in range(0, 1800, 90)]  # matches that end inside those of others
    return texts


@pytest.mark.parametrize("block_bytes, bucket_bytes", [(4 << 20, 16 << 20), (3000, 500)])
def test_suffix_dedup_equals_plain_version(spark, monkeypatch, block_bytes, bucket_bytes):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1000 if block_bytes == 3000 else suffix_dedup.SLICE)
    texts = _suffix_texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, block int").repartition(4)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect()}
    expected = plain_suffix_dedup([t.encode() for t in texts])
    assert [found[i] for i in range(len(texts))] == expected


def test_suffix_dedup_edges(spark):
    long = "".join(random.Random(1).choice("abcd ") for _ in range(450))
    rows = [(None, long), (None, long), ("x", None), ("x", ""), ("y", "short"), ("y", "short")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.dedup(docs).collect())
    assert found == sorted([("None", 450, 450, 1, b"")] * 2 + [("x", 0, 0, 0, b"")] * 2 + [("y", 5, 0, 0, b"short")] * 2)
    assert suffix_dedup.dedup(docs.where("false")).collect() == []


def test_cover_has_every_difference():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))


def plain_codes(rows: list[tuple], n_parts: int, n_entries: int, rounds: int, scale: int):
    """Python integers throughout."""
    ints = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // n_parts
    cut = [[v[p * width:(p + 1) * width] for p in range(n_parts)] for _, v in ints]
    first = sorted(range(len(ints)), key=lambda k: (ints[k][0], rows[k][1]))[:n_entries]
    books = [[cut[k][p] for k in first] for p in range(n_parts)]

    def near(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        held = defaultdict(list)
        for row in cut:
            for p, x in enumerate(row):
                held[p, near(p, x)[0]].append(x)
        for (p, e), xs in held.items():
            books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    codes = [[near(p, x) for p, x in enumerate(row)] for row in cut]
    return [([c for c, _ in row], sum(d for _, d in row)) for row in codes], books


@pytest.mark.parametrize("scale", [4, 256, 1 << 25])  # the last needs several limbs
def test_vector_codes_equal_plain_version(spark, scale):
    rng = np.random.default_rng(scale)
    rows = [(i, (rng.integers(-8, 8, 12) / 4).tolist()) for i in range(150)] + [(3, [0.25] * 12), (3, [-0.25] * 12)]
    df = spark.createDataFrame([(i, v, i % 3 if i % 7 else None) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    coded, books = vector_codes.compress(df, n_parts=4, n_entries=16, rounds=2, scale=scale)
    expected, plain_books = plain_codes(rows, 4, 16, 2, scale)
    assert books.tolist() == plain_books
    found = sorted((r.vec_id, r.label is None, tuple(r.code), r.error) for r in coded.collect())
    assert found == sorted((i, i % 7 == 0, tuple(c), e) for (i, _), (c, e) in zip(rows, expected))
    by_label = defaultdict(int)
    for (i, _), (_, e) in zip(rows, expected):
        by_label[i % 3 if i % 7 else None] += e
    assert {(r.label, r.label_error) for r in coded.collect()} == set(by_label.items())


def test_products_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-2**28, 2**28, (20, 9)), rng.integers(-2**28, 2**28, (30, 9))
    assert vector_codes.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]


def test_vector_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label string, code int"
    rows = [(1, [0.5] * 5, "a", 0), (None, [0.25] * 5, None, 0), (2, None, "a", 0), (3, [1.0, None, 1.0, 1.0, 1.0], "a", 0), (4, [float("nan")] * 5, "a", 0),
            (5, [float("inf")] * 5, "a", 0), (6, [0.5] * 4, "b", 0), (7, [1e30] * 5, "b", 0), (8, [], "b", 0), (1, [0.5] * 5, "a", 0)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, schema), n_parts=2)
    found = sorted(((r.vec_id or 0, r.code, r.error, r.label_error) for r in coded.collect()), key=lambda f: f[0])
    assert books.shape == (2, 2, 3)  # five components in two parts of three; the row without an id starts no entry
    assert [f[0] for f in found] == [0, 1, 1, 6, 7, 8] and [f[1] is None for f in found] == [False, False, False, True, True, True]
    assert found[1][1] == [1, 1]  # the first of the equal entries moved to its mean with the row without an id
    empty, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert empty.collect() == [] and books.shape == (16, 0, 0)
    assert coded.where(F.col("label") == "b").select("label_error").distinct().collect()[0][0] is None
