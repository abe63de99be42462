"""Prefix trie of conversations, rolled up by bands of depths.

A node is a distinct sequence of first turns.  Its key is its depth and the
exclusive or of the hashes of its turns, each hashed with its place, so keys are
running aggregates: a conversation of any length is numbered and keyed in blocks
whose carries are added afterwards, and the key of a parent is that of the child
without its last turn.

Below a node that only one conversation reaches nothing branches, so those
chains are written from their two ends.  What is left, nodes of several
conversations and the tops of such chains, is summed by bands of ``BAND`` depths:
a node explodes to its ancestors in its own band only, the roots of the bands
are a tree a ``BAND`` times lower that is summed the same way, and their
completed totals are handed to the band above.  So there are as many rounds as
the depth has digits to the base ``BAND``, and no row explodes to more than
``BAND`` others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstie.llm.common import saved, ship, small, words
from crosstie.session import salted_lookup

ship(__name__)

#: depths of a band
BAND = 8
#: a conversation of more turns is numbered in blocks
LONG_TURNS = 10_000
#: members of a node that are written as one text before their digest is taken
CHUNK_IDS = 4096
#: depths of a chain that are written at once
CHAIN_STEP = 4096

KEY = ["depth", "k1", "k2"]


@dataclass
class Turns:
    """Turns in order: conv, block, depth (from 1), x1, x2 (hashes of role and
    text), n_words.  ``long`` holds the conversations of several blocks, None if
    there are none."""

    rows: DataFrame
    long: DataFrame | None


def numbered(turns: DataFrame, long_turns: int = LONG_TURNS, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text") -> Turns:
    """The turns of each conversation in order of their number, a null number first.

    Turns of one number are ordered by the hashes of role and text.  Null roles
    and texts count as empty.  Rows without a conversation id belong to no
    conversation and are left out.  Conversations of more than ``long_turns``
    turns are dealt by ranges of turns, numbered there, and moved on by what the
    ranges before hold.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    narrow = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("x1"),
        F.xxhash64(F.lit("second"), role, text).alias("x2"), F.size(words(text)).cast("long").alias("n_words"))
    order = ["turn", "x1", "x2"]
    local = F.row_number().over(Window.partitionBy("conv", "block").orderBy(*order)).cast("long")
    columns = ["conv", "block", "depth", "x1", "x2", "n_words"]

    long = saved(narrow.groupBy("conv").count().where(F.col("count") > long_turns).select("conv"), "long-conversations")
    n_long = long.count()
    if n_long == 0:
        return Turns(narrow.withColumn("block", F.lit(0)).withColumn("depth", local).select(columns), None)
    marked = narrow.join(small(long.withColumn("is_long", F.lit(True)), n_long), "conv", "left")
    rest = marked.where("is_long IS NULL").withColumn("block", F.lit(0)).withColumn("depth", local)
    # equal rows have no order among them; a running number lets even those be dealt over several ranges
    dealt = marked.where("is_long").withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("conv", *order, "tie")
    hot = saved(dealt.withColumn("block", F.spark_partition_id()), "long-turns")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = saved(hot.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n")).select("conv", "block", before.alias("before")), "turn-blocks")
    hot = hot.join(small(blocks, blocks.count()), ["conv", "block"]).withColumn("depth", local + F.col("before"))
    return Turns(rest.select(columns).union(hot.select(columns)), long)


def _positions(turns: Turns) -> DataFrame:
    """Key of every node that a conversation passes, and of the node above."""
    at = turns.rows.withColumn("y1", F.xxhash64("depth", "x1")).withColumn("y2", F.xxhash64(F.lit("second"), F.col("depth"), F.col("x2")))
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = at.select("conv", "block", "depth", "n_words", "y1", "y2", F.bit_xor("y1").over(so_far).alias("k1"), F.bit_xor("y2").over(so_far).alias("k2"))
    if turns.long is not None:
        ahead = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            at.join(small(turns.long, turns.long.count()), "conv", "left_semi").groupBy("conv", "block").agg(F.bit_xor("y1").alias("b1"), F.bit_xor("y2").alias("b2"))
            .select("conv", "block", F.bit_xor("b1").over(ahead).alias("c1"), F.bit_xor("b2").over(ahead).alias("c2"))
        )
        carry = saved(carry, "key-carries")
        out = out.join(small(carry, carry.count()), ["conv", "block"], "left")
        for i in (1, 2):
            out = out.withColumn(f"k{i}", F.col(f"k{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))))
    above = [F.col(f"k{i}").bitwiseXOR(F.col(f"y{i}")).alias(f"a{i}") for i in (1, 2)]
    return out.select("conv", *KEY, *above, "n_words")


def _band(depth: Column, height: int) -> Column:
    return F.floor(depth / height)


def _rolled(nodes: DataFrame, positions: DataFrame, step: int, band: int) -> DataFrame:
    """Sums of ``leaf`` and ``saved`` over the subtree of every node.

    ``nodes`` (conv, depth, leaf, saved) lie at multiples of ``step``, ``conv`` is
    any conversation that passes the node; ``positions`` are all nodes on the
    ways of those conversations.  Returns conv, depth, k1, k2, leaf, saved.
    """
    height = step * band
    ways = positions.where(F.col("depth") % step == 0).select(
        F.col("conv").alias("c"), *KEY, _band(F.col("depth"), height).alias("b"))

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).select("conv", *KEY, "leaf", "saved")

    own = nodes.select("conv", F.col("depth").alias("d"), "leaf", "saved")
    inside = own.join(ways, (ways["c"] == own["conv"]) & (ways["b"] == _band(own["d"], height)) & (ways["depth"] <= own["d"]))
    inside = saved(summed(inside), "band-sums")
    deepest = inside.agg(F.max("depth")).first()[0]
    if deepest is None or deepest < height:
        return inside
    roots = inside.where(F.col("depth") % height == 0).select("conv", "depth", "leaf", "saved")
    done = _rolled(roots, positions, height, band).where("depth > 0").select("conv", F.col("depth").alias("d"), "leaf", "saved")
    handed = done.join(ways, (ways["c"] == done["conv"]) & (ways["b"] == _band(done["d"], height) - 1))
    return saved(summed(inside.union(handed.select("conv", *KEY, "leaf", "saved"))), "band-totals")


def _ends_digest(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at each node, ascending and joined by commas.

    A digest is taken from front to back, so the ids of one node end up in one
    task, but as texts of ``CHUNK_IDS`` ids that are read one after the other.
    """
    columns = [f.dataType.simpleString() for f in ends.select("conv").schema]

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["run"] = f.groupby(KEY, sort=False).cumcount() // CHUNK_IDS
            made = f.groupby([*KEY, "run"], sort=False)["conv"].agg([("first", "first"), ("ids", lambda c: ",".join(map(str, c)))])
            yield made.reset_index()[[*KEY, "first", "ids"]]

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for f in frames:
            done = []
            for depth, k1, k2, ids in f[[*KEY, "ids"]].itertuples(index=False):
                if (depth, k1, k2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (depth, k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=[*KEY, "sha"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=[*KEY, "sha"])

    keys = "depth long, k1 long, k2 long"
    packed = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInPandas(pack, f"{keys}, first {columns[0]}, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInPandas(digest, f"{keys}, sha string")


def trie(turns: Turns, convs: DataFrame, band: int = BAND) -> DataFrame:
    """Nodes of the trie of the conversations ``convs`` (one column, their ids).

    Returns per node: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` and ``saved_tokens`` over the subtree, ``ends_sha256`` of the
    members that end there.  A conversation without turns is a member of the root
    alone; without any conversation there is no node.  A null id is left out, a
    repeated one counts once.
    """
    ids = convs.toDF("conv").where("conv IS NOT NULL").distinct()
    positions = saved(_positions(turns), "positions")
    none = F.lit(0).cast("long")
    at_root = saved(ids, "conversations").select("conv", *(none.alias(c) for c in (*KEY, "a1", "a2", "n_words")))
    positions = positions.union(at_root)
    nodes = positions.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), *(F.min(c).alias(c) for c in ("conv", "a1", "a2", "n_words")))
    nodes = saved(nodes, "nodes")

    # chains that one conversation alone reaches
    chains = nodes.where("n_convs = 1").groupBy("conv").agg(F.min_by(F.struct("depth", "k1", "k2", "a1", "a2"), "depth").alias("top"), F.max("depth").alias("end"))
    chains = saved(chains.select("conv", "top.*", "end"), "chains")
    shared = nodes.where("n_convs > 1")
    up = [(F.col("depth") - 1).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2")]
    children = shared.select("depth", "a1", "a2").union(chains.select("depth", "a1", "a2")).where("depth > 0").select(*up)
    facts = ["n_convs", "conv", "a1", "a2", "n_words"]
    counted = shared.select(*KEY, *facts, none.alias("child")).unionByName(children.withColumn("child", F.lit(1).cast("long")), allowMissingColumns=True)
    shared = counted.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in facts), F.sum("child").alias("n_children"))
    shared = saved(shared, "shared-nodes")

    own = shared.select("conv", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"),
                        ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    tops = chains.select("conv", "depth", F.lit(1).cast("long").alias("leaf"), none.alias("saved"))
    totals = _rolled(own.union(tops), positions, 1, band).select(*KEY, "leaf", "saved")

    ends = positions.groupBy("conv").agg(F.max_by(F.struct(*KEY), "depth").alias("end")).join(chains.select("conv"), "conv", "left_anti")
    digests = _ends_digest(saved(ends.select("conv", "end.*"), "shared-ends"))

    # parents have several conversations; one may have a third of all nodes below it
    n_shared = shared.count()
    parents = shared.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv").alias("parent"))

    def with_parent(rows: DataFrame) -> DataFrame:
        keys = ["depth", "a1", "a2"]
        return salted_lookup(rows, parents, keys, "conv") if small(parents, n_shared) is parents else rows.join(F.broadcast(parents), keys, "left")

    whole = shared.select(*KEY, "n_convs", "conv", "a1", "a2", "n_children").unionByName(
        totals.join(small(shared.select(*KEY), n_shared), KEY, "left_semi"), allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    whole = whole.groupBy(*KEY).agg(*(F.max(c).alias(c) for c in ("n_convs", "conv", "a1", "a2", "n_children", "leaf", "saved", "sha")))
    nothing = F.sha2(F.lit(""), 256)
    several = with_parent(whole).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", nothing).alias("ends_sha256"))

    stretch = F.sequence(F.floor(F.col("depth") / CHAIN_STEP), F.floor(F.col("end") / CHAIN_STEP))
    parted = with_parent(chains).select("conv", "depth", "end", "parent", F.explode(stretch).alias("part"))
    if turns.long is not None:
        parted = parted.repartition("conv", "part")
    first, last = F.greatest("depth", F.col("part") * CHAIN_STEP), F.least("end", F.col("part") * CHAIN_STEP + CHAIN_STEP - 1)
    alone = parted.withColumn("d", F.explode(F.sequence(first, last))).select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(F.col("d") < F.col("end"), 1).otherwise(0).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), none.alias("saved_tokens"),
        F.when(F.col("d") == F.col("end"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(nothing).alias("ends_sha256"))
    return several.union(alone)


def conversation_trie(turns: DataFrame, long_turns: int = LONG_TURNS, band: int = BAND, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Trie of the conversations of a table of turns; see ``numbered`` and ``trie``."""
    return trie(numbered(turns, long_turns, conv_col, turn_col, role_col, text_col), turns.select(conv_col), band)


def with_common_openings(turns: Turns, convs: DataFrame, group: int, most: int) -> Turns:
    """Conversations that open like the first of their group of ids.

    Of conversation c the first h = crc32(c) mod (``most`` + 1) turns are those of
    conversation c - c mod ``group`` (all if that has fewer), then come its own
    turns after its first h.
    """
    ids = convs.toDF("conv").where("conv IS NOT NULL").distinct()
    h = F.crc32(F.col("conv").cast("string")) % (most + 1)
    model = F.col("conv") - F.col("conv") % group
    members = saved(ids.select("conv", h.alias("h"), model.alias("model")).where("h > 0"), "members")
    openings = turns.rows.where((F.col("conv") % group == 0) & (F.col("depth") <= most)).select(F.col("conv").alias("model"), "depth", "x1", "x2", "n_words")
    openings = saved(openings, "openings")
    heads = members.join(openings, "model").where("depth <= h").select("conv", F.lit(0).alias("block"), "depth", "x1", "x2", "n_words")
    lengths = openings.groupBy("model").agg(F.max("depth").alias("n"))
    moved = members.join(lengths, "model", "left").select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken"))
    # h follows from the id, so only the length of the model is looked up; a long conversation is many rows of one id
    own = salted_lookup(turns.rows, moved, ["conv"], "depth") if turns.long is not None else turns.rows.join(moved, "conv", "left")
    own = own.where(F.col("h").isNull() | (F.col("depth") > F.col("h"))).withColumn(
        "depth", F.col("depth") - F.coalesce("h", F.lit(0)) + F.coalesce("taken", F.lit(0)))
    return Turns(heads.union(own.select("conv", "block", "depth", "x1", "x2", "n_words")), turns.long)
