"""Suffix dedup: removes bytes of long strings that start at several places.

Suffixes are sorted one bucket at a time, and only those that a difference cover
cannot settle.  Texts are packed into blocks of some megabytes with places
numbered through; the cover ``COVER`` modulo ``PERIOD`` samples places so that
any two places have a common distance, below ``PERIOD``, to two sampled ones.
So if the strings of ``LENGTH`` bytes at two places agree, then

1. the cover sample: some sampled place less than a period on starts a string of
   ``LENGTH - PERIOD + 1`` bytes that starts elsewhere too.  Places without such
   a sample are settled: they are not repeated.
2. long ties: where a sampled string of ``LENGTH + PERIOD`` bytes is repeated,
   all the strings inside it are, so these places are settled by the rank (the
   name) of the sample alone and never sorted.
3. what is left, a period or two at the ends of each match, goes into buckets of
   suffixes that are sorted by their ``LENGTH`` bytes.  The first block of a long
   tie sends the suffixes inside it too, so that a place whose only equal lies
   inside a long tie of others meets it.

Each of the three is one exchange of names: a block sends each of its names once,
packed by bucket, a bucket is sorted in one task and answers every block with a
bit for each of its names, whether another place has it too.  So a passage that a third of all
documents hold is one name per block.  The texts themselves are packed and
written once, bucketed by block, and not dealt again.

Names are hashes of the bytes: 32 bits beside the bucket where a false hit only
costs work (1), 96 bits beside the bucket where they decide (2, 3).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import saved, ship
from crosstie.session import shared_dir

ship(__name__)

#: bytes of the strings that may start only once
LENGTH = 400
#: fixed values: a perfect difference set, every difference modulo 57 occurs once
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
#: bytes of text in a block; a longer text is a block of its own
BLOCK_BYTES = 4 << 20
#: bytes of names that a bucket should hold
BUCKET_BYTES = 16 << 20
#: places whose hashes are computed at once
SLICE = 1 << 20

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per hash: values of the bytes, powers of the base and of its inverse."""
    out = []
    for k, base in enumerate(_ODD):
        values = np.random.Generator(np.random.PCG64(k)).integers(0, 2**64, 256, np.uint64)
        n = SLICE + LENGTH + PERIOD
        inverse = np.uint64(pow(int(base), -1, 2**64))
        up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (base, inverse))
        out.append((values, up, down))
    return out


class Namer:
    """Hashes of the strings of one length at chosen places of a block."""

    def __init__(self) -> None:
        self.tables = _tables()

    def names(self, block: np.ndarray, places: np.ndarray, length: int, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """64-bit hash of each string, and another one if ``second``.  ``places`` ascend."""
        out = [np.empty(places.size, np.uint64) for _ in range(2 if second else 1)]
        cuts = np.searchsorted(places, np.arange(0, block.size + SLICE, SLICE))
        for i in range(len(cuts) - 1):
            here = places[cuts[i]:cuts[i + 1]] - i * SLICE
            if not here.size:
                continue
            part = block[i * SLICE:(i + 1) * SLICE + length]
            for k, target in enumerate(out):
                values, up, down = self.tables[k]
                sums = np.zeros(part.size + 1, np.uint64)
                np.cumsum(values[part] * up[:part.size], out=sums[1:])
                h = (sums[here + length] - sums[here]) * down[here]
                h ^= h >> np.uint64(30)
                h *= _MIX[0]
                h ^= h >> np.uint64(27)
                h *= _MIX[1]
                target[cuts[i]:cuts[i + 1]] = h ^ (h >> np.uint64(31))
        return out[0], out[1] if second else None


def sampled(n: int) -> np.ndarray:
    """Sampled places below n."""
    return np.flatnonzero(np.isin(np.arange(PERIOD), COVER)[np.arange(n) % PERIOD])


def room(lengths: np.ndarray) -> np.ndarray:
    """Bytes from every place of a block to the end of its text."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    return ends - np.arange(ends.size)


def spread(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """Which of n places lie from ``before`` ahead of one of the places to ``after`` behind it."""
    starts = np.bincount(np.maximum(places - before, 0), minlength=n + 1)
    ends = np.bincount(np.minimum(places + after + 1, n), minlength=n + 1)
    return np.cumsum(starts - ends)[:n] > 0


#: names where a false hit costs work only, and where they decide
NARROW = np.dtype("<u4")
WIDE = np.dtype([("x", "<u8"), ("y", "<u4")])


class Listed:
    """Distinct names of a block in order of their hashes, and so of their
    buckets, which are ranges of hashes."""

    def __init__(self, h: np.ndarray, other: np.ndarray | None, buckets: int) -> None:
        order = np.argsort(h, kind="stable") if other is None else np.lexsort((other, h))
        s = h[order]
        new = np.ones(s.size, bool)
        new[1:] = s[1:] != s[:-1]
        if other is None:
            self.names = (s[new] & np.uint64(0xFFFFFFFF)).astype(NARROW)
        else:
            o = other[order]
            new[1:] |= o[1:] != o[:-1]
            self.names = np.empty(int(new.sum()), WIDE)
            self.names["x"], self.names["y"] = s[new], o[new].astype(np.uint32)
        self.many = np.diff(np.append(np.flatnonzero(new), s.size)) > 1
        #: of every place the number of its name
        self.of = np.empty(s.size, np.int64)
        self.of[order] = np.cumsum(new) - 1
        bucket = (s[new] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        self.cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))

    def rows(self, block: int) -> Iterator[tuple]:
        """Bucket, block, names, and which of them the block holds several times."""
        for b in np.flatnonzero(np.diff(self.cuts)):
            part = slice(self.cuts[b], self.cuts[b + 1])
            yield int(b), block, self.names[part].tobytes(), np.packbits(self.many[part]).tobytes()

    def flagged(self, answers: pa.Table, column: str) -> np.ndarray:
        """Places whose names the answers mark."""
        marked = np.zeros(self.names.size, bool)
        for b, bits in zip(answers["b"].to_pylist(), answers[column].to_pylist()):
            marked[self.cuts[b]:self.cuts[b + 1]] = _bits(bits, self.cuts[b + 1] - self.cuts[b])
        return marked[self.of]


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=int(n)).view(bool)


def _repeated(names: np.ndarray, many: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the names, each once per block, occur in another block or were
    several in their own; and which of these are in the first of their blocks."""
    order = np.lexsort((block, names) if names.dtype == NARROW else (block, names["y"], names["x"]))
    s = names[order]
    same = s[1:] == s[:-1]
    hit, first = many[order].copy(), np.ones(names.size, bool)
    hit[1:] |= same
    hit[:-1] |= same
    first[1:] = ~same
    out, lead = np.empty(names.size, bool), np.empty(names.size, bool)
    out[order], lead[order] = hit, hit & first
    return out, lead


SENT = (("b", pa.int64()), ("block", pa.int64()), ("names", pa.binary()), ("many", pa.binary()))
ANSWER = (("b", pa.int64()), ("block", pa.int64()), ("hit", pa.binary()), ("lead", pa.binary()))


def _table(rows: list[tuple], columns: tuple) -> pa.Table:
    return pa.table({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate(columns)})


def _ddl(columns: tuple) -> str:
    return ", ".join(f"{c} {'binary' if t == pa.binary() else 'long'}" for c, t in columns)


def _answers(sent: DataFrame, kind: np.dtype) -> DataFrame:
    """For every block, as bits over the names it sent: those that are repeated,
    and those of them of which it is the first block."""

    def settle(table: pa.Table) -> pa.Table:
        columns = [table[c].to_pylist() for c, _ in SENT]
        parts = [np.frombuffer(x, kind) for x in columns[2]]
        cuts = np.cumsum([0, *(x.size for x in parts)])
        many = np.concatenate([_bits(x, p.size) for x, p in zip(columns[3], parts)])
        hit, lead = _repeated(np.concatenate(parts), many, np.repeat(columns[1], np.diff(cuts)))
        return _table([(b, block, np.packbits(hit[s:e]).tobytes(), np.packbits(lead[s:e]).tobytes())
                       for b, block, s, e in zip(columns[0], columns[1], cuts[:-1], cuts[1:]) if hit[s:e].any()], ANSWER)

    return sent.groupBy("b").applyInArrow(settle, _ddl(ANSWER))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts of ``LENGTH`` bytes or more, packed: block, ids, lengths, data."""
    kind = docs.schema[id_col].dataType.simpleString()
    long_enough = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).where(F.octet_length("text") >= LENGTH)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from pyspark import TaskContext

        squeeze = zstandard.ZstdCompressor(level=3)
        part, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row(id_type: pa.DataType) -> pa.RecordBatch:
            lengths = pa.array([[len(t) for t in texts]], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([
                pa.array([(part << 32) | n], pa.int64()), pa.array([ids], pa.list_(id_type)), lengths,
                pa.array([squeeze.compress(b"".join(texts))], pa.binary())], names=["block", "ids", "lengths", "data"])

        id_type = None
        for batch in batches:
            id_type = batch["id"].type
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist()):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield row(id_type)
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield row(id_type)

    return long_enough.mapInArrow(pack, f"block long, ids array<{kind}>, lengths array<long>, data binary")


def _opened(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text lengths of the block in a table of one row."""
    import zstandard

    lengths = row["lengths"].combine_chunks().flatten().to_numpy()
    data = zstandard.ZstdDecompressor().decompress(row["data"][0].as_py(), max_output_size=int(lengths.sum()))
    return np.frombuffer(data, np.uint8), lengths


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each text without bytes of strings that start at several places.

    A text is its UTF-8 bytes.  Every byte is removed that a string of ``LENGTH``
    bytes covers which also starts anywhere else, in the same text or another,
    overlapping or not, judged on the input.  No string crosses texts.

    Returns one row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans``
    (removed runs) and ``kept`` (binary).  A null text counts as empty; texts
    under ``LENGTH`` bytes stay.  Rows are judged each by its own text whatever
    their ids, so repeated rows of a long text remove each other.  Other columns
    of any name are not looked at.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    path = shared_dir(spark, "text-blocks")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    name = f"text_blocks_{uuid.uuid4().hex}"
    # bucketed by block: every later pass joins the blocks with their answers without dealing the texts
    _blocks(docs, id_col, text_col).write.option("path", path).bucketBy(partitions, "block").saveAsTable(name)
    blocks = spark.table(name)
    total = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    share = len(COVER) / PERIOD
    n_sample = max(1, -(-int(total * share) * NARROW.itemsize // BUCKET_BYTES))
    n_rest = max(1, -(-int(total * share) * WIDE.itemsize // BUCKET_BYTES))
    short, long = LENGTH - PERIOD + 1, LENGTH + PERIOD

    def sample_of(data: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, Listed]:
        places = sampled(data.size)
        places = places[left[places] >= short]
        return places, Listed(*Namer().names(data, places, short, second=False), n_sample)

    def send_sample(row: pa.Table) -> pa.Table:
        data, lengths = _opened(row)
        return _table(list(sample_of(data, room(lengths))[1].rows(row["block"][0].as_py())), SENT)

    sample = saved(_answers(blocks.groupBy("block").applyInArrow(send_sample, _ddl(SENT)), NARROW), "sample-answers")

    def send_long(row: pa.Table, answers: pa.Table) -> pa.Table:
        """Repeated samples of the block, and the names of the long strings there."""
        if not (row.num_rows and answers.num_rows):
            return _table([], SENT)
        data, lengths = _opened(row)
        left, block = room(lengths), row["block"][0].as_py()
        places, names = sample_of(data, left)
        hit = names.flagged(answers, "hit")
        longer = places[hit & (left[places] >= long)]
        listed = Listed(*Namer().names(data, longer, long, second=True), n_rest)
        return _table([(-1, block, zlib.compress(np.packbits(hit).tobytes(), 1), b""), *listed.rows(block)], SENT)

    stage = saved(blocks.groupBy("block").cogroup(sample.groupBy("block")).applyInArrow(send_long, _ddl(SENT)), "long-names")
    # the block's own samples travel with its answers, marked by the bucket -1
    own = stage.where("b < 0").select("b", "block", F.col("names").alias("hit"), F.col("many").alias("lead"))
    state = saved(_answers(stage.where("b >= 0"), WIDE).union(own), "long-answers")

    def settled(data: np.ndarray, lengths: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, Listed]:
        """Places that long ties prove repeated, and the places that are sorted with their names.

        Sorted are those left open, and those inside long ties of none of which
        another block is the first: following first blocks from any of them ends
        at one that sends the same string.
        """
        left, places = room(lengths), sampled(data.size)
        places = places[left[places] >= short]
        mine = np.array(answers["b"].to_pylist()) == -1
        bits = zlib.decompress(answers.filter(pa.array(mine))["hit"][0].as_py())
        hit = places[_bits(bits, places.size)]
        longer = hit[left[hit] >= long]
        namer, ties = Namer(), answers.filter(pa.array(~mine))
        listed = Listed(*namer.names(data, longer, long, second=True), n_rest)
        tied, lead = listed.flagged(ties, "hit"), listed.flagged(ties, "lead")
        proven = spread(longer[tied], 0, PERIOD, data.size)
        # a sample of the next text never vouches for a place of this one: its string would cross the end
        open_ = spread(hit, PERIOD - 1, 0, data.size) & (left >= LENGTH) & ~proven
        first = proven & ~spread(longer[tied & ~lead], 0, PERIOD, data.size)
        rest = np.flatnonzero(open_ | first)
        return proven, rest, Listed(*namer.names(data, rest, LENGTH, second=True), n_rest)

    def send_rest(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not (row.num_rows and answers.num_rows):
            return _table([], SENT)
        return _table(list(settled(*_opened(row), answers)[2].rows(row["block"][0].as_py())), SENT)

    last = _answers(blocks.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(send_rest, _ddl(SENT)), WIDE)
    # answers of the sorted suffixes are told from those of the long ties by their bucket
    both = state.union(last.withColumn("b", F.col("b") + n_rest))

    def cut(row: pa.Table, answers: pa.Table) -> pa.Table:
        if not row.num_rows:
            return pa.table({"id": pa.array([], row["ids"].type.value_type), **{c: pa.array([], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")},
                             "kept": pa.array([], pa.binary())})
        data, lengths = _opened(row)
        gone = np.zeros(data.size, bool)
        if answers.num_rows:
            bucket = np.array(answers["b"].to_pylist())
            proven, rest, listed = settled(data, lengths, answers.filter(pa.array(bucket < n_rest)))
            late = answers.filter(pa.array(bucket >= n_rest))
            late = late.set_column(0, "b", pa.array(bucket[bucket >= n_rest] - n_rest))
            more = rest[listed.flagged(late, "hit")]
            gone = spread(np.concatenate([np.flatnonzero(proven), more]), 0, LENGTH - 1, data.size)
        ends = np.cumsum(lengths)
        out = []
        for s, e in zip(ends - lengths, ends):
            g = gone[s:e]
            spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1]))
            out.append((e - s, int(g.sum()), spans, data[s:e][~g].tobytes()))
        columns = {c: pa.array([o[j] for o in out], pa.int64() if j < 3 else pa.binary()) for j, c in enumerate(("n_bytes", "n_removed", "n_spans", "kept"))}
        return pa.table({"id": row["ids"].combine_chunks().flatten()} | columns)

    done = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    short_ones = docs.select(F.col(id_col), text.alias("kept")).where(F.octet_length("kept") < LENGTH).select(
        F.col(id_col), F.octet_length("kept").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), "kept")
    return short_ones.union(done)
