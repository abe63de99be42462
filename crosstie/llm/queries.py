"""Registered queries of the corpus operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.llm import (
    decontaminate, jaccard_join, line_dedup, line_quality, mixing, personal_data, prefix_trie, quality_votes, suffix_dedup, token_counts, toxicity, vector_codes, warc_index,
)
from crosstie.llm.common import table
from crosstie.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunk dedup leaves of every document."""
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_removed", "chars_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


@query("op2_line_quality", oracle=r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (
    SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY doc_id
), line AS (
  SELECT doc_id, x, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) AS t, regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') AS v,
    regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(ls) AS x FROM d)
), judged AS (
  SELECT doc_id, len(w) AS n, regexp_matches(t, '[.!?:;…。！？][\"''”’»)\]]*$') AS ends,
    length(v) AS nv, length(v) - length(translate(v, '#*$%&|<>', '')) AS sym,
    len(list_filter(w, lambda a: regexp_matches(a, '^[|>»•·/\\]+,?$'))) AS sep,
    CASE WHEN regexp_matches(t, '!!|\p{Lu}[^\p{Ll} ]|[^\p{Ll} ]\p{Lu}')
      THEN len(list_filter(w, lambda a: length(a) > 1 AND ((a <> lower(a) AND a = upper(a)) OR ends_with(a, '!!')))) ELSE 0 END AS shout,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS runs,
    len(list_filter(['all rights reserved', 'licensed under', 'released under', 'privacy policy', 'terms of use', 'terms of service',
      'cookie policy', 'accept cookies', 'accept all cookies', 'enable javascript', 'subscribe now', 'click here', 'read more', 'share this',
      'powered by', 'skip to content'], lambda p: contains(lower(t), p))) > 0 AS boiler
  FROM line
), lost AS (
  SELECT doc_id, sum(n) AS total, sum(CASE WHEN sym > 0.1 * nv OR sep > 0.2 * n OR (n < 3 AND NOT ends) OR (n >= 3 AND shout > 0.7 * n)
    OR (n >= 3 AND runs > 0.3 * n) OR boiler OR NOT ends THEN n ELSE 0 END) AS gone
  FROM judged GROUP BY doc_id
), stat AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(total, 0) AS total, coalesce(gone, 0) AS gone
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
), base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stat)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND total > 0 AND gone <= 0.5 * total AND gone < total AS kept
FROM base
""")
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text counts and the verdict of the line rules for every document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return line_quality.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("keep")).alias("kept"),
    )


def held_out(parts: int, rest: int):
    """Whether the remainder of the id's checksum keeps a document out of training."""
    return F.crc32(F.col("doc_id").cast("string")) % parts == rest


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of held-out documents are not learnt."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out(4, 2)))
    return toxicity.score(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the plain spans, and all selected spans, of every document."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data.find(docs, personal_data.fit(docs))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(kind: str):
        return F.filter("plain", lambda x: x["kind"] == kind)

    return found.withColumn("plain", F.concat(*map(of, personal_data.KINDS))).select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in personal_data.KINDS), F.sha2(joined("plain"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op5_quality_votes")
def op5_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of held-out documents are not learnt."""
    docs = table(spark, sf_dir, "documents")
    model = quality_votes.fit(docs, table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return quality_votes.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted through a cache that starts empty."""
    import public_tokenizers

    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), shared_dir(spark, "token-cache"))


def _mix_oracle(share: float, block_tokens: int, steps: int) -> str:
    """Bisection unrolled into one common table per step."""
    halves = ", ".join(f"""b{i + 1} AS MATERIALIZED (SELECT CASE WHEN h >= goal THEN mid ELSE lo END AS lo, CASE WHEN h >= goal THEN hi ELSE mid END AS hi FROM (
      SELECT any_value(lo) AS lo, any_value(hi) AS hi, any_value((lo + hi) / 2) AS mid, any_value(goal) AS goal, ln(sum(x)) - sum(x * ln(x)) / sum(x) AS h
      FROM (SELECT lo, hi, goal, pow(tokens / mx, (lo + hi) / 2) AS x FROM t, b{i}, g)))""" for i in range(steps))
    key = "md5(concat_ws('|', 'mix', {}))"
    return f"""
WITH d AS MATERIALIZED (SELECT * FROM (SELECT doc_id AS id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tok
    FROM documents) WHERE tok > 0),
t AS MATERIALIZED (SELECT src, sum(tok)::BIGINT AS tokens FROM d GROUP BY src),
g AS MATERIALIZED (SELECT max(tokens)::DOUBLE AS mx, sum(tokens)::DOUBLE AS budget, {share} * ln(count(*)) AS goal FROM t),
b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi), {halves},
o AS (SELECT ln(sum(x)) - sum(x * ln(x)) / sum(x) AS h FROM (SELECT tokens / mx AS x FROM t, g)),
e AS MATERIALIZED (SELECT CASE WHEN h >= goal THEN 1.0 ELSE lo END AS e FROM b{steps}, o, g),
z AS MATERIALIZED (SELECT sum(pow(tokens / mx, e)) AS z FROM t, g, e),
p AS (SELECT src, tokens, ceil(tokens / {block_tokens})::BIGINT AS n_blocks, floor(pow(tokens / mx, e) / z * budget + 1e-6)::BIGINT AS bud FROM t, g, e, z),
r AS MATERIALIZED (SELECT id, d.src, tok, bud // tokens AS full_, bud % tokens AS rest,
    ('0x' || substr({key.format("coalesce(id::VARCHAR, '')")}, 1, 12))::BIGINT % n_blocks AS block FROM d JOIN p ON d.src IS NOT DISTINCT FROM p.src),
s AS (SELECT src, block, full_, rest, sum(tok)::BIGINT AS size FROM r GROUP BY ALL),
x AS (SELECT *, {key.format("coalesce(src, ''), epoch::VARCHAR, block::VARCHAR")} AS k FROM (SELECT *, unnest(range(0, full_ + 1)) AS epoch FROM s)),
w AS (SELECT src, block, epoch, size, row_number() OVER v AS block_place,
    CASE WHEN epoch < full_ THEN size ELSE rest - sum(size) OVER v + size END AS room
  FROM x WINDOW v AS (PARTITION BY src, epoch ORDER BY k, block ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT id, r.src, tok, epoch, r.block, block_place, room, size,
    sum(tok) OVER (PARTITION BY r.src, epoch, r.block ORDER BY {key.format("coalesce(r.src, ''), epoch::VARCHAR, coalesce(id::VARCHAR, '')")}, id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM r JOIN w ON w.src IS NOT DISTINCT FROM r.src AND w.block = r.block AND room > 0)
SELECT id AS doc_id, src AS source, tok AS n_tokens, epoch, block, block_place FROM a WHERE room >= size OR upto <= room
"""


@query("op7_mixing", oracle=_mix_oracle(0.95, mixing.BLOCK_TOKENS, mixing.STEPS))
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of all documents so that the sources' entropy is 0.95 of the largest."""
    return mixing.mix(table(spark, sf_dir, "documents"), entropy_share=0.95)


@query("op8_decontaminate", oracle=r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM dw WHERE len(w) BETWEEN 1 AND 4),
its AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM iw WHERE len(w) >= 5)
  UNION ALL SELECT item_id, array_to_string(w, ' ') FROM iw WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT item_id, count(*) AS n FROM its GROUP BY item_id)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_found FROM ds JOIN its USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
""")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it contains."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_jaccard_join", oracle=r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
""")
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return jaccard_join.link(table(spark, sf_dir, "documents"))


@query("op10_warc_index", oracle="""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha, (k // 4 * 5 + 1)::BIGINT, 5))::INTEGER >> ((3 - k % 4) * 5)::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
""")
def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives, through the merged index."""
    captures = warc_index.archive_pages(table(spark, sf_dir, "pages"), shared_dir(spark, "archives"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_prefix_trie", oracle=r"""
WITH c AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 20 AS b FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c, b, list_transform(range(0, strlen(c::VARCHAR)), lambda k: ascii(substr(c::VARCHAR, k::BIGINT + 1, 1))) AS s FROM c),
crc AS (SELECT c, b, xor(list_reduce(list_prepend(4294967295::BIGINT, s::BIGINT[]), lambda a, x:
    list_reduce(list_prepend(xor(a, x), range(0, 8)), lambda r, _: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END)),
    4294967295::BIGINT) % 4 AS h FROM bits),
r AS (SELECT crc.c, 0 AS own, t.i, role, text FROM crc JOIN t ON t.c = crc.b AND t.i <= h
  UNION ALL SELECT crc.c, 1, t.i, role, text FROM crc JOIN t ON t.c = crc.c AND t.i > h),
n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    md5(len(role) || ':' || role || text) AS x FROM r),
path AS (SELECT c, d, words, string_agg(x, '') OVER (PARTITION BY c ORDER BY d) AS k FROM n UNION ALL SELECT c, 0, 0, '' FROM c),
node AS (SELECT d, k, min(c) AS m, count(*) AS n_convs, min(words) AS words, left(k, greatest(32 * (d - 1), 0)::BIGINT) AS up FROM path GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
ends AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d, max(k) AS k FROM path GROUP BY c) GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k),
total AS (SELECT p.d, p.k, sum((own.n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum((own.n_convs - 1) * own.words)::BIGINT AS saved
  FROM own JOIN path p ON p.c = own.m AND p.d <= own.d GROUP BY ALL)
SELECT own.m AS conv_id, own.d::BIGINT AS depth, parent.m AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM own JOIN total ON total.d = own.d AND total.k = own.k LEFT JOIN ends ON ends.d = own.d AND ends.k = own.k
  LEFT JOIN node parent ON parent.d = own.d - 1 AND parent.k = own.up
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the conversations with their common openings."""
    turns = table(spark, sf_dir, "conversations")
    ids = turns.select("conv_id")
    return prefix_trie.trie(prefix_trie.with_common_openings(prefix_trie.numbered(turns), ids, 20, 3), ids)


@query("op12_suffix_dedup")
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 400 bytes that start twice."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _codes_oracle() -> str:
    """Assignment and update unrolled, one common table each."""

    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT r, p, min({{'d': d, 'e': e}}) AS m FROM (SELECT r, s.p, e,
      list_sum(list_transform(range(1, len(s.v) + 1), lambda j: (s.v[j] - b.v[j]) * (s.v[j] - b.v[j])))::BIGINT AS d
      FROM part s JOIN b{i} b ON b.p = s.p) GROUP BY r, p)"""

    def updated(i: int) -> str:
        return f"""u{i} AS (SELECT p, e, list(q ORDER BY j) AS v FROM (SELECT s.p, m.e AS e, j, floor(sum(s.v[j]) / count(*))::BIGINT AS q
      FROM part s JOIN a{i} a ON a.r = s.r AND a.p = s.p, range(1, (SELECT max(len(v)) FROM part) + 1) g(j) GROUP BY s.p, m.e, j) GROUP BY p, e),
    b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(u.v, b.v) AS v FROM b{i} b LEFT JOIN u{i} u ON u.p = b.p AND u.e = b.e)"""

    steps = ", ".join(f"{assigned(i)}, {updated(i)}" for i in range(vector_codes.ROUNDS)) + ", " + assigned(vector_codes.ROUNDS)
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, v[p * len(v) // {vector_codes.PARTS} + 1:(p + 1) * len(v) // {vector_codes.PARTS}] AS v FROM kept, range({vector_codes.PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= {vector_codes.ENTRIES}),
{steps},
f AS MATERIALIZED (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{vector_codes.ROUNDS} GROUP BY r),
k AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b{vector_codes.ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN kept USING (r), k
"""


@query("op13_vector_codes", oracle=_codes_oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, and the digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))
