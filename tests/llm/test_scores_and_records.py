"""Rules, models, token counts, mixing and archives on small tables."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from crosstie.llm import line_quality as Q
from crosstie.llm import mixing as M
from crosstie.llm import personal_data as D
from crosstie.llm import quality_votes as V
from crosstie.llm import toxicity as T
from crosstie.llm import token_counts as C
from crosstie.llm import warc_index as W
from crosstie.llm.queries import QUERIES

WORDS = ["bara", "kelo", "timu", "nosa", "prate", "livon", "dagem", "sutor", "wemi", "galto"]


def prose(rng, n=60):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(9)).capitalize() + "." for _ in range(n // 9))


# ---- quality rules


def test_line_rules_and_counts(spark, make_docs):
    good = "This line is plain prose.\n" * 2 + "Another line of plain prose ends here."
    bad = "Home » News » About » Contact »\nAll rights reserved.\nBUY NOW!! CHEAP!! GOODS!!\nplain words without an end\n$$ ## word."
    docs = make_docs([(1, good), (2, bad), (3, None), (4, ""), (5, " \n\t"), (None, good), (1, good)]).withColumn("n_words", F.lit(7))
    got = {(r.doc_id, r.n_words): r for r in Q.assess(docs).collect()}
    assert Q.assess(docs).count() == 7 and Q.assess(make_docs([])).count() == 0
    r = got[(1, 17)]
    assert (r.keep, r.n_dup_lines, r.lost_words, r.failed, r.clean_text) == (True, 1, 0, {}, good)
    assert r.n_repeat_words == 10 and r.word_chars == len(re.sub(r"\s", "", good))
    r = next(v for k, v in got.items() if k[0] == 2)
    assert not r.keep and r.clean_text == "" and r.n_symbols == 4
    assert r.failed == {"navigation": 1, "boilerplate": 1, "shouting": 1, "punctuation": 1, "symbols": 1}
    for i in (3, 4, 5):
        assert got[(i, 0)].keep is False and got[(i, 0)].clean_text == ""


def test_repeated_words_equal_brute_force(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd"][: rng.choice([1, 2, 4])]) for _ in range(rng.choice([0, 1, 2, 3, 9, 40])))) for i in range(60)]

    def brute(t):
        ws = t.split()
        wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
        return len({p for i, w in enumerate(wins) if wins.count(w) > 1 for p in (i, i + 1, i + 2)})

    got = {r.doc_id: r.n_repeat_words for r in Q.assess(make_docs(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


# ---- quality votes


def labelled(make_docs, spark, rng):
    rows = [(i, prose(rng) if i % 2 else " ".join([rng.choice(WORDS).upper() + "!!"] * 50)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    return make_docs(rows + [(90, None), (91, ""), (None, prose(rng)), (61, prose(rng))]), labels


def test_votes_on_held_out_rows(spark, make_docs):
    docs, labels = labelled(make_docs, spark, random.Random(4))
    model = V.fit(docs.withColumn("y", F.lit(1)).withColumn("v", F.lit(1)), labels)
    got = V.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == 84
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and 60 <= r.doc_id < 80)
    assert all(0 <= r.score <= 1 for r in got)
    empty = V.fit(docs, labels.where("false"))
    assert {r.score for r in V.score(docs, empty).collect()} == {0.5}
    assert V.score(make_docs([]), model).count() == 0


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(40, V.LATENT)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    model = V.Model(np.ones(V.TERMS, np.float32), rng.normal(size=(V.TERMS, V.LATENT)).astype(np.float32), vectors, (np.arange(40) % 3 == 0).astype(np.float32))
    texts = ["some plain words", "OTHER!! WORDS!!", "one two three four five six"] * 100  # more than a block
    z = (V.term_vectors(texts) * model.weights) @ model.axes
    want = []
    for row in z:
        cos = vectors @ row / np.linalg.norm(row)
        near = np.argsort(-cos)[: V.NEIGHBOURS]
        w = np.maximum(cos[near], 0) ** 8
        want.append((w * model.labels[near]).sum() / w.sum())
    assert np.allclose(V.votes(model, texts), want, atol=1e-4)


# ---- toxicity


def test_toxic_words_in_other_guises(spark, make_docs):
    rng = random.Random(6)
    insults = ["dumbork", "snivelrat", "grubface"]
    rows = []
    for i in range(240):
        t = prose(rng)
        if i % 3 == 0:
            at = t.index(" ", rng.randrange(len(t) - 20))
            t = t[:at] + " " + rng.choice(insults) + t[at:]
        rows.append((i, t))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(180)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows + [(300, None), (301, ""), (None, "plain"), (302, "d u m b o r k"), (303, "what a Grub-face, bara"), (304, "snivelrats kelo"), (305, "dumborkk")])
    model = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs.withColumn("score", F.lit(1)), model).collect()}
    assert len(got) == 247 and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(180, 240))
    assert [got[i].predicted for i in (300, 301, 302, 303, 304, 305)] == [0, 0, 1, 1, 1, 1]
    constant = T.fit(docs, labels.where("toxic = 0"))
    assert len({r.score for r in T.score(docs, constant).collect()}) == 1
    assert T.score(make_docs([]), model).count() == 0


def test_folded_weights_equal_the_kernel_machine():
    pieces = ["^stupid$", "^stxupid$", "^house$", "^a" + "b" * 20]
    rows, ids, values = T.subsequences(pieces)
    weights = np.random.default_rng(1).normal(size=T.BUCKETS).astype(np.float32)
    got = T.piece_values(T.Model(weights, 0.5, 1, 0), pieces)
    for k, p in enumerate(pieces):
        total = norm = 0.0
        for at, w in T.PATTERNS:
            for i in range(len(p) - at[-1]):
                norm += w * w
        total = sum(v * weights[j] for r, j, v in zip(rows, ids, values) if r == k)
        assert got[k] == pytest.approx(total / norm ** 0.5 + 0.5, rel=1e-5)


# ---- personal data


def reference_spans(t):
    def found(kind, pattern, good):
        return [(kind, m.start(), m.end()) for m in re.finditer(pattern, t) if good(m.group())]

    def digits(s):
        return re.sub(r"[^0-9]", "", s)

    return (
        found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
        + found("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))
        + found("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and D.luhn(digits(s)))
        + found("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15)
    )


def test_plain_spans_equal_the_patterns():
    rng = random.Random(9)
    alphabet = ["a", "b.c", "@", "@x.yz", ".", "-", "+", " ", "1", "23", "255", "256", "4111111111111111", "1.2.3.4", "+1 (555) 123-4567", "é", "\n", "%", "("]
    for _ in range(4000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(14)))
        assert D.base_spans(t) == reference_spans(t), repr(t)


def test_long_runs_stay_linear():
    for t in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 100_000, "+1" + " " * 300_000, "(1" * 100_000):
        D.base_spans(t)
        D.candidates(t)


def test_selected_spans(spark, make_docs):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        mail, ip = f"{rng.choice(WORDS)}.{rng.randrange(90)}@mail{i % 9}.example.org", ".".join(str(rng.randrange(256)) for _ in range(4))
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((i, f"{prose(rng, 18)} {mail} {prose(rng, 18)} {ip} {prose(rng, 9)} {phone} {prose(rng, 9)}"))
    docs = make_docs(rows + [(200, None), (201, ""), (None, "a@b.cd"), (202, f"{rows[0][1]} mail anna (at) example (dot) org bara")]).withColumn("spans", F.lit(1))
    model = D.fit(docs)
    got = {r.doc_id: r for r in D.find(docs, model).collect()}
    assert len(got) == 154 and got[200].spans == [] and got[201].plain == [] and len(got[None].plain) == 1
    for i, t in rows:
        plain = [tuple(s) for s in got[i].plain]
        assert plain == reference_spans(t) and set(plain) <= {tuple(s) for s in got[i].spans}
    text = docs.where("doc_id = 202").first().text
    assert "anna (at) example (dot) org" in {text[s.start:s.end] for s in got[202].spans}
    assert "@" not in D.redact(text, [tuple(s) for s in got[202].spans]) and "[email]" in D.redact(text, [tuple(s) for s in got[202].spans])
    nothing = D.fit(make_docs([]))
    assert D.find(make_docs([(1, "x@y.zz")]), nothing).first().spans[0].kind == "email"


# ---- token counts


def test_tokens_come_through_the_cache(spark, make_docs, tmp_path):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [(1, "Hello  world"), (2, "Hello  world"), (3, None), (4, ""), (None, "<s> é 日本 </s>\n"), (5, "long " * 5000), (1, "Hello  world")]
    docs = make_docs(rows).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit(1))
    cache = str(tmp_path / "cache")
    want = sorted((i or 0, len((t or "").encode()), len(tokenizer.encode(t or "")), len(tokenizer.encode(t or "")) > 4096) for i, t in rows)

    def counted():
        return sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(docs, model, cache).collect())

    assert counted() == want
    assert C.read_cache(spark, cache).count() == 4  # distinct texts
    assert counted() == want and C.read_cache(spark, cache).count() == 4  # all hits: nothing is appended
    more = docs.union(make_docs([(9, "new")]).withColumn("digest", F.lit(1)).withColumn("n_tokens", F.lit(1)))
    assert C.count_tokens(more, model, cache).count() == 8 and C.read_cache(spark, cache).count() == 5
    assert C.count_tokens(make_docs([]), model, str(tmp_path / "none")).count() == 0


# ---- mixing


def test_exponent_meets_its_target(spark):
    tokens = [1000, 300, 50, 7]
    totals = spark.createDataFrame([(str(k), t) for k, t in enumerate(tokens)], "src string, tokens long")

    def weights(e):
        x = np.array(tokens, float) ** e
        return x / x.sum()

    e = M.exponent(totals, 0, entropy_share=0.8)
    w = weights(e)
    assert -(w * np.log(w)).sum() == pytest.approx(0.8 * np.log(4), abs=1e-5)
    e = M.exponent(totals, 1357, max_repeats=3.0)
    assert (weights(e) * 1357 / tokens).max() == pytest.approx(3.0, abs=1e-4)
    assert M.exponent(totals, 1357, entropy_share=0.01) == 1.0 and M.exponent(totals, 1357, entropy_share=1.5) == 0.0
    assert M.exponent(totals.where("false"), 5, entropy_share=0.5) == 1.0


def test_budgets_are_met_within_a_document(spark, make_docs):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 20, 90])), rng.choice(["a"] * 12 + ["b", "b", None])) for i in range(400)]
    docs = make_docs(rows + [(500, None, "c"), (501, "", "c"), (None, "w w", "a"), (1, rows[1][1], rows[1][2])])
    got = M.mix(docs.withColumn("tok", F.lit(1)).withColumn("epoch", F.lit(1)), entropy_share=0.9, block_tokens=150).collect()
    total, read = {}, {}
    for r in docs.collect():
        total[r.source] = total.get(r.source, 0) + len((r.text or "").split())
    for r in got:
        read[r.source] = read.get(r.source, 0) + r.n_tokens
    total.pop("c")
    e = M.exponent(spark.createDataFrame(list(total.items()), "src string, tokens long"), 0, entropy_share=0.9)
    x = {s: t ** e for s, t in total.items()}
    for s in total:
        budget = x[s] / sum(x.values()) * sum(total.values())
        assert budget - 90 < read[s] <= budget + 1e-3
        epochs = {}
        for r in got:
            if r.source == s:
                epochs.setdefault(r.epoch, []).append(r.doc_id)
        last = max(epochs)
        sizes = sorted(r[0] for r in rows if r[2] == s and r[1])
        for k, ids in epochs.items():  # whole epochs read each row once
            if k < last:
                assert sorted(i for i in ids if i is not None and i != 1) == [i for i in sizes if i != 1]
        places = {(r.epoch, r.block): r.block_place for r in got if r.source == s}
        assert len(set((k[0], v) for k, v in places.items())) == len(places)
    assert M.mix(make_docs([]), entropy_share=0.9).count() == 0 and M.mix(make_docs([(1, "", "a")])).count() == 0


# ---- archives


def test_loser_tree_merges_like_a_sort():
    rng = random.Random(0)
    for k in range(12):
        runs = [sorted((rng.randrange(30), rng.random()) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(W.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path):
    nasty = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n é </p>\n"
    rows = [(5, "http://b.example.org/x?y#z", nasty), (3, "https://user@A.example.org:80/", nasty), (9, None, None), (8, "", ""), (7, "http://a.example.org/\r\nX: y", "x"),
            (None, "http://c.org", nasty), (None, "http://c.org", "only"), (5, "http://b.example.org/x?y#z", nasty)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5).withColumn("sha", F.lit(1)).withColumn("payload", F.lit(1))
    got = W.archive_pages(pages, str(tmp_path / "a")).collect()
    import base64
    import hashlib

    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        ids = [k for k, _, g in rows if (g or "") == (h or "") and k is not None]
        first = min(ids) if ids else None
        want.append((i or -1, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda w: (w[:4]))
    order = [(r.url_key, r.ts, r.page_id or -1) for r in sorted(got, key=lambda r: (r.key_range, r.place))]
    assert order == sorted(order)
    assert {r.url_key for r in got} >= {"org,example,b)/x?y#z", "org,example,a)/", ")"}
    for r in got:  # offsets lead to the record
        with gzip.open(r.archive.removeprefix("file:")) as f:
            f.seek(r.offset)
            record = f.read(r.length)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            body = record.split(b"\r\n\r\n", 1)[1][:-4]
            assert len(body) == r.payload_bytes and base64.b32encode(hashlib.sha1(body).digest()).decode() == r.payload_digest
    assert W.archive_pages(pages.where("false"), str(tmp_path / "none")).count() == 0


# ---- pipeline and queries


def test_stages_keep_the_columns_and_take_effect(spark, make_docs, tmp_path):
    rng = random.Random(12)
    junk = " ".join(["WOW!!"] * 60)
    item = " ".join(rng.choice(WORDS) for _ in range(30))
    base = prose(rng, 200)
    rows = [(i, prose(rng, 120), "ab"[i % 2]) for i in range(30)] + [(40, junk, "a"), (41, junk + "!", "a"), (42, base + " " + item, "a"), (43, prose(rng, 90), "b")]
    near = base.replace(WORDS[0] + " ", "other ", 1)
    rows += [(50, near.replace("\n", " "), "b"), (51, near, "b"), (52, None, "a"), (53, "", "a")]
    docs = make_docs(rows)
    d = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(40, 0, 0), (41, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        docs = P.saved(stage(spark, docs, d), name)
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id for r in docs.collect()}
    assert not kept["quality_votes"] & {40, 41} and kept["quality_votes"] >= set(range(30))
    assert kept["line_dedup"] >= set(range(30))
    assert kept["jaccard_join"] >= set(range(30)) and len(kept["jaccard_join"] & {50, 51}) <= 1
    assert 42 not in kept["decontaminate"] and kept["decontaminate"] >= set(range(30))
    assert kept["mixing"] >= set(range(30)) - {None} or kept["mixing"] <= kept["decontaminate"]
    assert P.run(spark, d).count() > 0


def test_one_row_stays_of_a_repeated_document(spark, make_docs):
    rng = random.Random(1)
    t, u = prose(rng, 90), prose(rng, 90)
    docs = make_docs([(2, t), (2, t), (5, t), (3, u), (None, t), (None, t), (7, None), (8, "")])
    got = P.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 2, 3, 7, 8]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_agree_with_sql(spark, name):
    from collections import Counter

    import duckdb

    from crosstie.llm.queries import ORACLES

    sf = "/root/testdata/sf0.001"
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    assert sum(got.values()) > 0 or name == "op8_decontaminate"
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        res = con.execute(ORACLES[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(r[i] for i in at) for r in res.fetchall())


def test_damaged_payload_is_refused(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/", "<p>payload é</p>"), (2, "http://b.example/", "<p>payload é</p>"), (3, None, None)],
                                  "page_id long, url string, html string")
    W.write_archives(pages.coalesce(1), str(tmp_path / "a"))
    content = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "a").glob("part-*")))
    assert len(list(W.parse_archive("a", content))) == 3
    for damaged in (content.replace(b"payload \xc3", b"paxload \xc3"), content.replace(b"X-Payload-Length: 17", b"X-Payload-Length: 18", 1)):
        assert damaged != content
        with pytest.raises(ValueError, match="payload"):
            list(W.parse_archive("a", damaged))


def test_rows_of_one_id_are_judged_by_their_own_text(spark, make_docs, monkeypatch):
    from crosstie.llm import decontaminate

    words = [f"w{i}" for i in range(400)]

    def t(at):
        return " ".join(words[at:at + 40])

    rows = [(1, t(0)), (5, t(0)), (5, t(50)), (7, t(100)), (7, t(150)), (7, t(150)), (None, t(200)), (None, t(250))]
    docs = make_docs(rows)
    got = sorted(((r.doc_id or 0), r.text) for r in P.one_of_each_group(spark, docs, "").collect())
    assert got == sorted([(1, t(0)), (5, t(50)), (7, t(100)), (7, t(150)), (0, t(200)), (0, t(250))])
    bench = spark.createDataFrame([(1, t(0)), (2, t(200))], "item_id long, text string")
    for limit in (10 ** 6, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
        left = sorted(((r.doc_id or 0), r.text) for r in decontaminate.remove_leaks(docs, bench).collect())
        assert left == sorted([(5, t(50)), (7, t(100)), (7, t(150)), (7, t(150)), (0, t(250))])
