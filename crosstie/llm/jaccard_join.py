"""N-gram Jaccard join by grouped prefixes, for any threshold near one.

Documents with the same shingle set are one class.  Of each class's sorted
hashes a head is kept; a prefix of the head, chosen so that two similar sets
must share a part of it, is indexed.  Classes with the same prefix and size form
one group, so near copies are indexed once.  Groups that share a prefix hash
and fit in size are paired, then expanded to their classes and verified.

Only components are wanted, so pairs that are already connected are skipped:
members are first verified against the leader of their group and of each index
entry, which is linear.  Documents near one leader are compared by what sets
them apart from it, again by prefixes.  The exhaustive pairing is left for
documents of different leaders that those links do not connect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import saved, ship, small

ship(__name__)

SHINGLE = 3
#: similarity in percent
PERCENT = 90
#: an index hash that more classes hold than this comes last in the order
COMMON = 64

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _WordHashes(dict):
    """Hash of each word, computed on its first use."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_hashes(text: str, size: int, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text.

    Letters A to Z count as lower case, words are parted by ASCII white space.
    A text with fewer words than a shingle is one shingle of its own kind.
    """
    ws = text.encode("utf-8", "replace").lower().split()  # bytes: only ASCII letters and spaces count
    if not ws:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    if len(ws) < size:
        parts, seed = [h[i:i + 1] for i in range(len(ws))], len(ws)
    else:
        parts, seed = [h[i:len(h) - size + 1 + i] for i in range(size)], size
    mixed = np.full(parts[0].size, seed, np.uint64)
    for p in parts:
        mixed = (mixed ^ p) * _A
        mixed ^= mixed >> np.uint64(29)
        mixed *= _B
    mixed ^= mixed >> np.uint64(32)
    return np.unique((mixed * _C).view(np.int64))


def spare(n: int, percent: int) -> int:
    """Elements of a set of n that a similar set may lack."""
    return n - -(-n * percent // 100)


def least_shared(n: int, percent: int) -> int:
    """Elements that the heads of a set of n and of any similar set share.

    Sets of a and b elements are similar if they share ``o`` = percent * (a + b) /
    (100 + percent), rounded up.  The one whose head ends first lacks a - o of its
    elements at most, and the other's head holds all the rest of that head.
    """

    def head(k: int) -> int:
        m = spare(k, percent)
        return min(k, m + m // 2 + 1)

    def of(b: int) -> int:
        o = -(-percent * (n + b) // (100 + percent))
        return min(head(n) - n, head(b) - b) + o

    return min(map(of, range(-(-n * percent // 100), n * 100 // percent + 1)))


def _trim(words: dict, most: int = 1_000_000) -> None:
    if len(words) > most:
        words.clear()


def _heads(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Size, digest and head of every set, and the elements that it shares at least
    with the head of a similar one."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, shared = _WordHashes(), {}
        for texts_ in batches:
            out = []
            for t in texts_:
                u = shingle_hashes(t, size, words)
                m = spare(u.size, percent)
                if u.size not in shared:
                    shared[u.size] = least_shared(u.size, percent) if u.size else 0
                out.append((u.size, hashlib.blake2b(u.tobytes(), digest_size=16).digest(), u[:m + m // 2 + 1].tolist() if u.size else [], shared[u.size]))
                _trim(words)
            yield pd.DataFrame(out, columns=["n", "sig", "head", "shared"])

    made = F.pandas_udf(run, "n int, sig binary, head array<bigint>, shared int")
    return texts.select("id", made("text").alias("m")).select("id", "m.*")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = _WordHashes()
        for texts_ in batches:
            yield pd.Series([shingle_hashes(t, size, words).tolist() for t in texts_])
            _trim(words)

    return texts.select("id", F.pandas_udf(run, "array<bigint>")("text").alias("hashes"))


def _spare(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int")


def _heads_share(na: Column, nb: Column, ha: Column, hb: Column, percent: int) -> Column:
    """Elements that the heads, of ``ha`` and ``hb`` elements, of two similar sets share at least (see ``least_shared``)."""
    overlap = F.ceil(percent * (na + nb) / (100 + percent)).cast("int")
    return F.least(ha - na, hb - nb) + overlap


def _fits(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def components(edges: DataFrame, label: str) -> DataFrame:
    """Smallest reachable id of every id in the edges (a, b): id, comp.

    Every id points to its smallest neighbour, then to the pointer of that one,
    and edges are drawn between the pointers, until none joins two of them.
    Each round is written, so its plan and lost work stay short.
    """
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = saved(left, f"{label}-edges")
    comp = saved(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().withColumn("comp", F.col("id")), f"{label}-ids")
    while not left.isEmpty():
        # a root takes the smallest root that an edge joins it to
        hook = left.groupBy("a").agg(F.min("b").alias("b"))
        hook = saved(hook, f"{label}-hooks")
        while True:  # pointers to pointers, until all point to roots
            nxt = hook.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = hook.join(nxt, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.col("c").isNotNull().alias("moved"))
            jumped = saved(jumped, f"{label}-jumps")
            hook = jumped.select("a", "b")
            if jumped.where("moved").isEmpty():
                break
        to = hook.select(F.col("a").alias("comp"), F.col("b").alias("root"))
        comp = saved(comp.join(to, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), f"{label}-ids")
        a, b = (hook.select(F.col("a").alias(k), F.col("b").alias(f"r{k}")) for k in ("a", "b"))
        moved = left.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        left = saved(moved.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), f"{label}-edges")
    return comp


def _verified(pairs: DataFrame, heads: DataFrame, texts: DataFrame, size: int, percent: int, label: str,
              wide: bool = False) -> tuple[DataFrame, ...]:
    """Pairs (a, b) whose sets are similar: heads first, then the whole sets.
    Also the pairs whose heads agree, and the sets of their documents; ``wide``
    asks less of the heads, so that more documents come near one another.

    The set whose head ends first has its whole head below that end, and lacks
    few of its elements in a similar set, so the heads must share the rest.
    """
    one = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"))
    two = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"))
    least = (F.least(F.size("ha") - _spare(F.col("na"), percent), F.size("hb") - _spare(F.col("nb"), percent)) if wide
             else _heads_share(F.col("na"), F.col("nb"), F.size("ha"), F.size("hb"), percent))
    near = pairs.join(one, "a").join(two, "b").where(_fits(F.col("na"), F.col("nb"), percent)).where(
        F.size(F.array_intersect("ha", "hb")) >= least).select("a", "b")
    near = saved(near, f"{label}-near")
    wanted = saved(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), f"{label}-wanted")
    full = saved(_sets(texts.join(small(wanted, wanted.count()), "id", "left_semi"), size), f"{label}-sets")
    x = full.select(F.col("id").alias("a"), F.col("hashes").alias("xa"))
    y = full.select(F.col("id").alias("b"), F.col("hashes").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    union = F.size("xa") + F.size("xb") - both
    links = saved(near.join(x, "a").join(y, "b").where(both * 100 >= union * percent).select("a", "b"), f"{label}-links")
    return links, near, full


def _pivoted(near: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Documents by the pivot of their neighbourhood: id, pivot, q and d.

    ``d`` is the symmetric difference from the pivot's set.  Two sets of one
    pivot differ by |da| + |db| - 2 |da & db|, so with t the threshold in
    percent they are similar if q(a) + q(b) + 2 (100 + t) |da & db| >= 0, where
    q = (100 - t) |set| - (100 + t) |d|.
    """
    # the smallest id that near pairs reach: the relation holds for any set that serves as pivot
    pivot = components(near, "near").select(F.col("comp").alias("a"), F.col("id").alias("b"))
    x = full.select(F.col("id").alias("a"), F.col("hashes").alias("xa")).dropDuplicates(["a"])
    y = full.select(F.col("id").alias("b"), F.col("hashes").alias("xb")).dropDuplicates(["b"])
    d = F.concat(F.array_except("xb", "xa"), F.array_except("xa", "xb"))
    out = pivot.join(x, "a").join(y, "b").select(F.col("b").alias("id"), F.col("a").alias("pivot"), F.size("xb").alias("n"), d.alias("d"))
    return out.select("id", "pivot", ((100 - percent) * F.col("n") - (100 + percent) * F.size("d")).alias("q"), "d")


def _within_pivots(by_pivot: DataFrame, comps: DataFrame, percent: int, label: str) -> DataFrame:
    """Links (a, b) between documents of one pivot and different components.

    A pair with q(a) + q(b) >= 0 is linked through the document of the largest
    q; every other pair must share a number of differences that follows from its
    q's.  So the differences are joined by their own prefixes, rarest first,
    whose length depends on the band of the partner's q.  Bands double in width
    below the largest q of the pivot, so their number is the logarithm of the
    spread, and a document is indexed that many times at most.
    """
    unit = 100 + percent
    band = F.floor(F.log2(1 + (F.col("top") - F.col("q")) / unit)).cast("int")
    rows = by_pivot.join(comps, "id", "left").select("id", "pivot", "q", "d", F.coalesce("comp", "id").alias("comp"))
    mixed = rows.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("q").alias("low"), F.max("q").alias("top")).where("lo <> hi")
    rows = saved(rows.join(mixed.select("pivot", "low", "top"), "pivot"), f"{label}-pivot-rows")
    each = rows.select("pivot", "id", F.explode("d").alias("h"))
    held = each.groupBy("pivot", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")  # a difference of one document joins nothing
    ranked = each.join(held, ["pivot", "h"]).groupBy("pivot", "id").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("r"))
    last = F.floor(F.log2(1 + (F.col("top") - F.col("low")) / unit)).cast("int")
    partner = rows.select("id", "pivot", "q", "top", "comp", F.size("d").alias("m"), band.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    largest = F.col("top") - unit * (F.pow(F.lit(2), F.col("other")) - 1)  # q of the band
    least = F.greatest(F.lit(1), F.ceil(-(F.col("q") + largest) / (2 * unit)).cast("int"))
    # differences of one document come first in the order and are passed over
    length = F.col("m") - least + 1 - (F.col("m") - F.size("r"))
    entries = partner.join(ranked, ["pivot", "id"]).where((least <= F.col("m")) & (length > 0)).select(
        "pivot", "id", "comp", "own", "other", "q", F.size("r").alias("n"), F.posexplode(F.slice("r", 1, length)).alias("i", "r")).select(
        "pivot", "id", "comp", "own", "other", "q", (F.col("n") - F.col("i")).alias("left"), "r.h")
    entries = saved(entries, f"{label}-pivot-entries")
    two = entries.select("pivot", "h", F.col("id").alias("b"), F.col("comp").alias("cb"), F.col("own").alias("other"), F.col("other").alias("own"),
                         F.col("q").alias("qb"), F.col("left").alias("lb"))
    # a linked pair meets at the first difference that it shares, so it shares no more than are left from there on
    enough = F.col("qa") + F.col("qb") + 2 * unit * F.least("la", "lb") >= 0
    pairs = saved(entries.withColumnsRenamed({"id": "a", "comp": "ca", "q": "qa", "left": "la"}).join(two, ["pivot", "h", "own", "other"])
                  .where((F.col("ca") < F.col("cb")) & enough).select("a", "b").distinct(), f"{label}-pivot-pairs")
    x, y = (by_pivot.select(F.col("id").alias(k), F.col("q").alias(f"q{k}"), F.col("d").alias(f"d{k}")) for k in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where(
        F.col("qa") + F.col("qb") + 2 * unit * F.size(F.array_intersect("da", "db")) >= 0).select("a", "b")


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, common: int = COMMON, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Size of each document's shingle set and its component.

    Returns one row per input row: the id, ``n_shingles`` and ``component_id``,
    the smallest id that links reach.  A null or text without words has no
    shingles and is linked with nothing.  Rows that repeat an id count as one
    document with several texts; a null id is linked with nothing and has a null
    component.  Other columns of any name are not looked at.

    No candidate is dropped: hashes that many classes hold only come last in the
    order in which prefixes are taken, which is a choice of order and not of pairs.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = base.where(F.col("id").isNotNull())
    heads = saved(_heads(base, size, percent), "shingle-heads")
    linked = heads.where("id IS NOT NULL AND n > 0")

    # same sets: one class, named by its smallest id
    classes = saved(linked.groupBy("n", "sig").agg(F.min("id").alias("class_id")), "shingle-classes")
    members = saved(linked.select("id", "n", "sig").join(classes, ["n", "sig"]).select("id", "class_id").distinct(), "class-members")
    reps = linked.join(classes.withColumnRenamed("class_id", "id"), ["id", "n", "sig"], "left_semi").select("id", "n", "sig", "head", "shared").distinct()
    reps = saved(reps, "shingle-reps")

    # Index prefix.  In the order of all hashes come first those of one class, then those of a few, then the common
    # ones.  The first can join nothing, so they only use up places of a prefix and are never dealt again.
    key = ["id", "s"]  # an id may stand for several sets
    reps = reps.withColumn("s", F.xxhash64("sig"))
    entries = reps.select(*key, F.explode("head").alias("h"))
    held = entries.groupBy("h").count().where("count > 1").select("h", (F.col("count") > common).alias("often"))
    held = saved(held, "shared-hashes")
    joint = entries.join(small(held, held.count()), "h").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("all"))
    # similar sets share more of their heads than the places behind the prefix
    places = F.size("all") - F.col("shared") + 1  # of the prefix's |head| - shared + 1, those not used up
    taken = reps.select(*key, "n", "shared", F.size("head").alias("n_head")).join(joint, key).where(places > 0).select(
        "id", "n", "n_head", F.col("shared").alias("s"), F.transform(F.slice("all", 1, F.greatest(places, F.lit(1))), lambda x: x["h"]).alias("p"))
    taken = saved(taken, "prefixes")
    groups = taken.groupBy("n", "p").agg(F.min("id").alias("group_id"), F.first("n_head").alias("n_head"), F.first("s").alias("s"))  # by n
    grouped = saved(taken.join(groups, ["n", "p"]).select("id", "group_id"), "prefix-members")
    groups = saved(groups, "prefix-groups")

    # leaders: of the group, and of the groups with one hash and about one size (in either of two shifted bands)
    # with a hash come the shared ones of the head from it on: a similar pair meets at its first and has as many as it must share
    index = groups.select("group_id", "n", "n_head", (F.size("p") + F.col("s") - 1).alias("all"), F.posexplode("p").alias("i", "h")).select(
        "group_id", "n", "n_head", (F.col("all") - F.col("i")).alias("left"), "h")
    steps = F.log(F.col("n")) / F.log(F.lit(100 / percent))
    banded = index.withColumn("band", F.explode(F.array(2 * F.floor(steps), 2 * F.floor(steps + 0.5) + 1)))
    leader = banded.groupBy("h", "band").agg(F.min("group_id").alias("a"), F.count(F.lit(1)).alias("k")).where("k > 1")
    stars = banded.join(leader, ["h", "band"]).where("group_id <> a").select("a", F.col("group_id").alias("b"))
    own = grouped.where("id <> group_id").select(F.col("group_id").alias("a"), F.col("id").alias("b"))
    links, near, full = _verified(stars.union(own).distinct(), reps, texts, size, percent, "star", wide=True)
    by_pivot = saved(_pivoted(near, full, percent), "pivots")
    top = by_pivot.groupBy("pivot").agg(F.max(F.struct("q", "id")).alias("t")).select("pivot", F.col("t.id").alias("a"), F.col("t.q").alias("qa"))
    links = links.union(by_pivot.join(top, "pivot").where("q + qa >= 0 AND id <> a").select("a", F.col("id").alias("b")))
    zeroth = components(links, "star")
    inner = saved(_within_pivots(by_pivot, zeroth, percent, "star"), "inner-links")
    first = components(links.union(inner), "inner")

    # what is not connected yet: members of groups that share a hash, by component; pairs of one pivot are settled
    named_pivot = by_pivot.select("id", "pivot")
    placed = grouped.distinct().join(first, "id", "left").join(named_pivot, "id", "left")
    placed = saved(placed.select("id", "group_id", F.coalesce("comp", "id").alias("comp"), F.coalesce("pivot", "id").alias("pivot")), "placed")
    parts = placed.select("group_id", "comp", "pivot").distinct()
    spread = index.join(parts, "group_id")
    mixed = spread.groupBy("h").agg(*(f("comp") for f in (F.min, F.max)), *(f("pivot") for f in (F.min, F.max))).toDF("h", "c1", "c2", "p1", "p2")
    open_ = saved(spread.join(mixed.where("c1 <> c2 AND p1 <> p2").select("h"), "h"), "open-entries")

    def side(k: str) -> DataFrame:
        return open_.select("h", F.col("group_id").alias(f"g{k}"), F.col("comp").alias(f"c{k}"), F.col("pivot").alias(f"p{k}"), F.col("n").alias(f"n{k}"),
                            F.col("n_head").alias(f"h{k}"), F.col("left").alias(f"l{k}"))

    def of_side(k: str) -> DataFrame:
        return placed.select(F.col("group_id").alias(f"g{k}"), F.col("comp").alias(f"c{k}"), F.col("pivot").alias(f"p{k}"), F.col("id").alias(k))

    enough = F.least("la", "lb") >= _heads_share(F.col("na"), F.col("nb"), F.col("ha"), F.col("hb"), percent)
    pairs = side("a").join(side("b"), "h").where(
        (F.col("ca") < F.col("cb")) & (F.col("pa") != F.col("pb")) & _fits(F.col("na"), F.col("nb"), percent) & enough)
    pairs = saved(pairs.select("ga", "ca", "pa", "gb", "cb", "pb").distinct(), "group-pairs")
    expanded = pairs.join(of_side("a"), ["ga", "ca", "pa"]).join(of_side("b"), ["gb", "cb", "pb"]).select("a", "b")
    rest, *_ = _verified(expanded, reps, texts, size, percent, "rest")
    # classes without a prefix are linked with nothing
    of = classes.select(F.col("class_id").alias("id")).distinct().join(placed.select("id", F.col("comp").alias("c")).distinct(), "id", "left").select(
        "id", F.coalesce("c", "id").alias("comp"))
    joined = rest.join(of.withColumnsRenamed({"id": "a", "comp": "x"}), "a").join(of.withColumnsRenamed({"id": "b", "comp": "y"}), "b")
    # an id with several texts joins their classes
    ids = members.join(of.withColumnRenamed("id", "class_id"), "class_id").groupBy("id").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    several = members.join(ids.where("x <> y").select("id", "x"), "id").join(of.withColumnRenamed("id", "class_id"), "class_id").select(
        "x", F.col("comp").alias("y"))
    second = components(joined.select("x", "y").union(several).toDF("a", "b"), "rest").toDF("comp", "root")

    named = (
        members.join(of.withColumnRenamed("id", "class_id"), "class_id").join(second, "comp", "left")
        .groupBy("id").agg(F.min(F.coalesce("root", "comp")).alias("comp"))
    )
    return heads.select("id", "n").join(named, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))
