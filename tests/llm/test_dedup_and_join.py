"""Line dedup, the Jaccard join and decontamination against brute force."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from crosstie.llm import decontaminate as D
from crosstie.llm import jaccard_join as J
from crosstie.llm import line_dedup as L

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "pra", "sto") for b in ("da", "fe", "gi", "ro", "tu", "ven", "zas")]


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(rng, n=8):
    return "".join(sentence(rng) + ("\n" if rng.random() < 0.3 else " ") for _ in range(n))


# ---- line dedup


def test_repeated_passage_goes_from_all_but_its_first_place(spark, make_docs):
    rng = random.Random(5)
    passage = text(rng, 8)
    rows = [(i, text(rng) + passage + text(rng)) for i in range(1, 6)] + [(i, text(rng)) for i in range(6, 12)]
    got = {r.doc_id: r for r in L.dedup(make_docs(rows)).collect()}
    for i, t in rows:
        if 2 <= i <= 5:
            assert passage not in got[i].clean_text and got[i].chars_removed > len(passage) / 3
            # only text of the passage is removed
            assert t[:t.index(passage)][:-60] in got[i].clean_text and t[t.index(passage) + len(passage):][60:] in got[i].clean_text
        else:
            assert got[i].clean_text == t and got[i].n_removed == 0


def test_removed_segments_occur_at_an_earlier_place(spark, make_docs):
    rng = random.Random(8)
    shared = [text(rng, 4) for _ in range(4)]
    rows = [(i, "".join(rng.choice([text(rng, 2), rng.choice(shared)]) for _ in range(5))) for i in range(30)]
    got = {r.doc_id: r.clean_text for r in L.dedup(make_docs(rows), min_run_chars=1).collect()}
    assert any(got[i] != t for i, t in rows)
    for i, t in rows:
        whole, kept = ([s for s in re.split(L.CUT, x) if s] for x in (t, got[i]))
        before = {s for j, u in rows if j < i for s in re.split(L.CUT, u)}
        assert set(whole) - set(kept) <= before


@pytest.mark.parametrize("punctuated", [True, False])
def test_every_repeated_passage_of_fifty_words_goes(spark, make_docs, punctuated):
    rng = random.Random(15)

    def prose(sentences):
        whole = "".join(sentence(rng, rng.choice([5, 9, 14])) + " " for _ in range(sentences))
        return whole if punctuated else whole.lower().replace(".", "")

    def passage(n=50):
        return " ".join(prose(14).split()[:n]) + " "

    planted = [passage() for _ in range(40)]
    rows = [(i, prose(6) + p + prose(6)) for i, p in enumerate(planted)] + [(100 + i, prose(6) + p + prose(6)) for i, p in enumerate(planted)]
    rows += [(200, prose(6)), (201, "a" * 300 + " " + "b" * 300), (202, "one  two\n\n" * 30)]
    got = {r.doc_id: r for r in L.dedup(make_docs(rows)).collect()}
    assert all(got[i].clean_text == t for i, t in rows if i < 100 or i in (200, 201))
    for i, p in enumerate(planted):
        # all but the segments or words at which it meets what stands around it
        assert len(p) / (2 if punctuated else 3) < got[100 + i].chars_removed <= len(p)
    whole = make_docs(rows).select("text", F.array_join(L._segments(F.col("text")), "").alias("joined"))
    assert whole.where("text <> joined").count() == 0


def test_passages_of_scripts_without_blanks_go(spark, make_docs):
    rng = random.Random(6)

    def run(n, stops):
        return "".join("。" if stops and rng.random() < 0.06 else chr(0x4E00 + rng.randrange(3000)) for _ in range(n))

    for stops in (True, False):
        passage = run(390, stops)
        rows = [(i, run(200, stops) + passage + run(200, stops)) for i in range(4)]
        got = {r.doc_id: r for r in L.dedup(make_docs(rows)).collect()}
        assert got[0].chars_removed == 0
        # all but the segments at which a passage meets what stands around it
        assert all(0.7 * 390 < got[i].chars_removed <= 390 for i in (1, 2, 3)), [got[i].chars_removed for i in (1, 2, 3)]


def test_segments_lose_nothing(spark, make_docs):
    rows = ["\U0001F600\U0001F680" * 60, "e\u0301a " * 40, "a\x00b c" * 50, "\x00", "。！？" * 30, "\u0e01\u0e02" * 80, "x" * 500, "  " * 90, "漢字 kana " * 30]
    whole = make_docs(list(enumerate(rows))).select("text", F.array_join(L._segments(F.col("text")), "").alias("joined"))
    assert [r.joined for r in whole.collect()] == [r.text for r in whole.collect()]


def brute_dedup(spark, make_docs, rows, min_run):
    """Chunks cut by the operator's rule, then looked up, kept and removed in plain Python."""
    cut = make_docs(rows).select("doc_id", L._segments(F.col("text")).alias("seg"), L._starts(L._hashes(L._segments(F.col("text")))).alias("starts"))
    texts = sorted((r.doc_id, r.seg, r.starts) for r in cut.collect())
    seen, out = set(), {}
    for i, seg, starts in texts:
        gone = [False] * len(seg)
        # in a text of two segments both chunks are the same place
        for s, e in sorted({(max(a - 1, 0), min(b + 1, len(seg))) for a, b in zip(starts, starts[1:] + [len(seg) + 1])}):
            chunk = "".join(seg[s:e])
            if chunk in seen:
                gone[s:e] = [True] * (e - s)
            seen.add(chunk)
        left, at = "", 0
        while at < len(seg):
            end = at
            while end < len(seg) and gone[end] == gone[at]:
                end += 1
            piece = "".join(seg[at:end])
            left += "" if gone[at] and len(piece) >= min_run else piece
            at = end
        out[i] = left
    return out


@pytest.mark.parametrize("min_run", [1, 80])
def test_dedup_equals_brute_force(spark, make_docs, min_run):
    rng = random.Random(40 + min_run)
    shared = [text(rng, n) for n in (1, 2, 4, 7)]
    rows = [(i, "".join(rng.choice([text(rng, 2), rng.choice(shared)]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += [(100, text(rng, 600) + shared[3] * 40), (101, "One, two. " * 300), (102, "One, two. " * 300)]
    rows += [(103, sentence(rng) + " " + sentence(rng))]
    got = {r.doc_id: r.clean_text for r in L.dedup(make_docs(rows), min_run_chars=min_run).collect()}
    assert got == brute_dedup(spark, make_docs, rows, min_run) and any(got[i] != t for i, t in rows) and got[103] == rows[-1][1]


def test_dedup_edge_rows(spark, make_docs):
    rng = random.Random(1)
    t = text(rng, 12)
    docs = make_docs([(1, None), (2, ""), (None, t), (7, t), (7, t), (9, "One. Two."), (10, " \n\n ")]).withColumn("h", F.lit(1)).withColumn("s", F.lit("x"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.clean_text) for r in L.dedup(docs).collect())
    assert got == [(False, 0, t), (True, 1, None), (True, 2, ""), (True, 7, ""), (True, 7, ""), (True, 9, "One. Two."), (True, 10, " \n\n ")]
    rows = L.dedup_rows(docs)
    assert rows.columns == docs.columns and sorted(r.doc_id or 0 for r in rows.collect()) == [0, 1, 2, 9, 10]
    assert L.dedup(make_docs([])).count() == 0


def test_dedup_is_native_and_never_crosses(spark, make_docs):
    plan = L.dedup(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# ---- Jaccard join


def shingles(t, n):
    ws = (t or "").encode().lower().split()
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute_components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, b in combinations(sets, 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n,percent,common", [(3, 90, 64), (3, 90, 2), (5, 80, 3), (2, 60, 4)])
def test_components_equal_brute_force(spark, make_docs, n, percent, common):
    rng = random.Random(n * percent + common)
    rows, i = [], 0
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([2, 5, 12, 40, 90]))]
        if rng.random() < 0.5:
            base += passage.split()
        for _ in range(rng.choice([1, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                w = w[: rng.randrange(1, len(w) + 1)] if rng.random() < 0.2 else w + [rng.choice(WORDS)]
            rows.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
            i += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(make_docs(rows), n, percent, common).collect()}
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_heads_of_similar_sets_share_what_they_must(percent):
    rng = random.Random(percent)

    def head(x):
        m = J.spare(len(x), percent)
        return set(sorted(x)[:m + m // 2 + 1])

    similar = 0
    for _ in range(4000):
        n = rng.choice([1, 2, 3, 9, 20, 21, 40])
        x = set(rng.sample(range(10 ** 6), n))
        y = set(rng.sample(sorted(x), rng.randint(max(1, n * percent // 100), n))) | set(rng.sample(range(10 ** 6), rng.choice([0, 0, 1, 2])))
        if 100 * len(x & y) >= percent * len(x | y):
            similar += 1
            assert len(head(x) & head(y)) >= max(J.least_shared(len(x), percent), J.least_shared(len(y), percent)) >= 1
    assert similar > 1000


def test_a_common_passage_makes_no_square_of_pairs(spark, make_docs, monkeypatch):
    # a passage whose hash comes first in nearly every head
    passage = min((f"p{i} q{i} r{i}" for i in range(5000)), key=lambda t: J.shingle_hashes(t, 3, J._WordHashes())[0])
    rows = [(i, passage + "".join(f" w{i}x{j}" for j in range(16 + i % 5))) for i in range(150)]
    counts, saved = {}, J.saved

    def counted(df, label):
        out = saved(df, label)
        if label in ("star-pivot-pairs", "group-pairs"):  # the pairs that are looked at
            counts[label] = out.count()
        return out

    monkeypatch.setattr(J, "saved", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.link(make_docs(rows)).collect()}
    assert got == brute_components(rows, 3, 90)
    assert sum(counts.values()) < 4 * len(rows), counts


def test_join_edge_rows(spark, make_docs):
    t = "alpha beta gamma delta epsilon zeta"
    docs = make_docs([(5, t), (5, t), (3, t), (None, t), (8, None), (9, ""), (10, " \t"), (11, "alpha"), (12, "ALPHA"), (13, "é a b"), (14, "É a b")])
    docs = docs.withColumn("n", F.lit(1)).withColumn("head", F.lit(2)).withColumn("id", F.lit(3))
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in J.link(docs).collect())
    assert got == [(-1, 4, None), (3, 4, 3), (5, 4, 3), (5, 4, 3), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 1, 11), (12, 1, 11), (13, 1, 13), (14, 1, 14)]
    assert J.link(make_docs([])).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.id: r.comp for r in J.components(edges, "path").collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


# ---- decontamination


def brute_leaks(docs, items, percent=80):
    def grams(t):
        ws = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
        return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())

    out = set()
    for d, t in docs:
        have = grams(t)
        for k, u in items:
            want = grams(u)
            if want and 100 * len(want & have) >= percent * len(want):
                out.add((d, k, len(want), len(want & have)))
    return out


@pytest.mark.parametrize("limit", [10 ** 6, 0])
def test_leaks_equal_brute_force(spark, make_docs, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_ROWS", limit)  # both ways of the join
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 5, 8, 20, 60])))) for k in range(25)]
    docs = []
    for i in range(60):
        w = [rng.choice(WORDS) for _ in range(rng.choice([0, 4, 50, 400]))]
        for _ in range(rng.choice([0, 1, 2])):
            leak = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
        t = " ".join(w)
        docs.append((i, t.upper() + "!" if i % 5 == 0 else t))
    docs += [(100, items[0][1]), (101, None), (102, "")]
    bench = spark.createDataFrame(items + [(98, None), (99, "")], "item_id long, text string")
    got = {tuple(r) for r in D.leaks(make_docs(docs), bench).select("doc_id", "item_id", "n_shingles", "n_found").collect()}
    assert got == brute_leaks(docs, items) and len(got) > 20


def test_leak_edge_rows(spark, make_docs):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, "a b c d e f g")],
                                  "item_id long, text string")
    docs = make_docs([(4, "x one two three four five six y"), (4, "x one two three four five six y"), (None, "a b c d e f g"), (5, "clean")])
    docs = docs.withColumn("h", F.lit(1)).withColumn("item_id", F.lit(1)).withColumn("shingles", F.lit(1))
    got = sorted(((r.doc_id or 0), (r.item_id or 0), r.n_shingles, r.n_found) for r in D.leaks(docs, bench).collect())
    assert got == [(0, 0, 3, 3), (4, 1, 2, 2)]
    kept = D.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [5]
    assert D.leaks(make_docs([]), bench).count() == 0
    assert D.leaks(docs, bench.where("false")).count() == 0
