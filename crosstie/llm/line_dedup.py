"""Line dedup by content-defined chunks of neighbouring segments.

A text is cut into segments: its lines, inside a line the parts that end with
punctuation, and long parts of those once more after words (in scripts without
blanks: characters) that their neighbours choose.  A rolling hash over the hashes
of two neighbouring segments decides whether a chunk begins between them, so
boundaries depend on the passage alone and not on what stands before it.  A
chunk is looked up together with the segments that decided its two boundaries:
these are the same wherever the boundaries are.  Chunks that occur again anywhere
are compared byte by byte and removed from all but their first place.

Everything is DataFrame expressions: no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import let, saved

#: a segment ends after a line feed, after punctuation and a blank, or after a full-width sign; nothing is lost
CUT = r"(?<=[.!?,;:] )|(?<=[\n。！？])"
SEGMENT_ENDS = ("\n", ". ", "! ", "? ", ", ", "; ", ": ", "。", "！", "？")
SIGN = "\x00"
#: segments of more characters are cut again, so that 50 words always hold several
LONG_CHARS = 60
#: chunks with more than this share of all places are looked up by a broadcast, so there are fewer than its inverse
HOT_SHARE = 1 / 1000
#: repeated chunks that touch form a run; shorter runs stay
MIN_RUN_CHARS = 80


def _pieces(segment: Column) -> Column:
    """A long segment cut after each word whose hash is smaller than those of the
    two words on either side: inside equal passages the same words are chosen."""

    def joined(ws: Column, ends: Column) -> Column:
        return F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(ends, F.array(F.size(ws))),
                          lambda s, e: F.array_join(F.slice(ws, s + 1, e - s), ""))

    def cut(ws: Column, h: Column) -> Column:
        def least(i: Column) -> Column:
            x = F.get(h, i)
            return (x < F.get(h, i - 2)) & (x < F.get(h, i - 1)) & (x <= F.get(h, i + 1)) & (x <= F.get(h, i + 2))

        # words with fewer than two neighbours on a side are not chosen
        inner = F.when(F.size(h) > 4, F.filter(F.sequence(F.lit(2), F.size(h) - 3), least)).otherwise(F.array().cast("array<int>"))
        return let(F.transform(inner, lambda i: i + 1), lambda ends: joined(ws, ends))

    # scripts without blanks take three bytes for a character; an empty pattern splits at each
    blanks = F.split(F.replace(segment, F.lit(" "), F.lit(" " + SIGN)), SIGN)
    ws = (F.when(F.octet_length(segment) >= 2 * F.length(segment), F.split(segment, ""))
          .when(segment.contains(SIGN), F.split(segment, "(?<= )")).otherwise(blanks))
    return let(ws, lambda ws: let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: cut(ws, h)))


def _segments(text: Column) -> Column:
    """Segments in order; joined they are the text.  Plain replacements and a
    split at one sign do the work of ``CUT`` at a fraction of its cost; a text
    that holds the sign itself takes the long way."""
    marked = text
    for end in SEGMENT_ENDS:
        marked = F.replace(marked, F.lit(end), F.lit(end + SIGN))
    parts = F.array_remove(F.when(text.contains(SIGN), F.split(text, CUT)).otherwise(F.split(marked, SIGN)), "")
    return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > LONG_CHARS, _pieces(x)).otherwise(F.array(x))))


def _starts(h: Column) -> Column:
    """First segment of each chunk, from the hashes of all segments: a place
    between two segments is a boundary unless its rolling hash is the largest of
    three, so of two neighbouring places one at least is a boundary."""

    def boundary(r: Column, i: Column) -> Column:
        return F.coalesce((F.get(r, i) <= F.get(r, i - 1)) | (F.get(r, i) <= F.get(r, i + 1)), F.lit(True))

    def inner(r: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: boundary(r, i - 1))

    rolling = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(h, i), x))
    return F.concat(F.array(F.lit(0)), F.when(F.size(h) > 1, let(rolling, inner)).otherwise(F.array().cast("array<int>")))


def _hashes(segments: Column) -> Column:
    return F.transform(segments, lambda x: F.xxhash64(x))


#: a chunk has at most four segments: a place is its first segment times this, plus their number
PLACE = 8


def _chunks(text: Column) -> Column:
    """Place and hash of each chunk of a text, with the segments that decided its boundaries."""

    def of(h: Column, starts: Column) -> Column:
        def one(i: Column) -> Column:
            s = F.greatest(F.get(starts, i) - 1, F.lit(0))
            n = F.least(F.coalesce(F.get(starts, i + 1) + 1, F.size(h)), F.size(h)) - s
            return F.struct((s * PLACE + n).alias("at"), F.xxhash64(F.slice(h, s + 1, n)).alias("h"))

        return F.transform(F.sequence(F.lit(0), F.size(starts) - 1), one)

    return let(_hashes(_segments(text)), lambda h: let(_starts(h), lambda starts: of(h, starts)))


def _span(at: Column) -> tuple[Column, Column]:
    """First segment of a place and the number of its segments."""
    return F.floor(at / PLACE).cast("int"), F.pmod(at, F.lit(PLACE))


def repeated_chunks(texts: DataFrame) -> DataFrame:
    """Chunks that occur more than once, and which of their places come first.

    ``texts`` has ``id``, ``th`` (hash of the text), ``k`` (hash of both) and
    ``text``.  Returns k, ``marks``, the places of the chunks with a repeated
    hash, and ``firsts``, an array of (id, th, at), the chunks of that text whose
    bytes come first there; at the others they come again.
    The hashes are computed once and written.  First they are only counted, so a
    chunk that a third of all documents hold is one row per map task.  The few
    hashes with a large share of all places are looked up by a broadcast, so none
    of the others can fill a task.  Places of repeated hashes are gathered by
    document (bounded by its length) and the bytes behind them are grouped, again
    after map-side aggregation.
    """
    # k stands in for id and th; bytes are compared, and first places given, under the true ones
    hashed = saved(texts.select("k", _chunks(F.col("text")).alias("chunks")), "line-chunks")
    chunks = hashed.select("k", F.inline("chunks"))
    repeated = saved(chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-repeats")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(repeated.where(F.col("n") > total * HOT_SHARE).select("h"))
    others = chunks.join(hot, "h", "left_anti").join(repeated.select("h"), "h", "left_semi")
    found = chunks.join(hot, "h", "left_semi").union(others)
    marks = found.groupBy("k").agg(F.array_sort(F.collect_set("at")).alias("marks"))

    def bytes_of(segments: Column) -> Column:
        def one(at: Column) -> Column:
            s, n = _span(at)
            return F.struct(at.alias("at"), F.array_join(F.slice(segments, s + 1, n), "").alias("bytes"))

        return F.transform("marks", one)

    # the outer form, for Spark would compute the array again to leave out empty ones
    held = texts.join(marks, "k").select("k", "id", "th", F.inline_outer(let(_segments(F.col("text")), bytes_of)))
    first = held.groupBy("bytes").agg(F.min(F.struct("id", "th", "at", "k")).alias("first")).select("first.*")
    firsts = first.groupBy("k").agg(F.collect_list(F.struct("id", "th", "at")).alias("firsts"))
    return marks.join(firsts, "k", "left")


def _cleaned(docs: DataFrame, min_run_chars: int, keep: list[str], text_col: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts with what is left of them, and the rows without a text."""
    carried = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carried)
    texts = base.where(F.col("text") != "").withColumn("th", F.xxhash64("text")).withColumn("k", F.xxhash64("id", "th"))
    found = repeated_chunks(texts)
    mine = F.filter(F.coalesce("firsts", F.array()), lambda x: x["id"].eqNullSafe(F.col("id")) & (x["th"] == F.col("th")))
    again = F.array_except("marks", F.transform(mine, lambda x: x["at"]))
    kept = F.struct(F.col("id").alias(id_col), *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep))).alias("kept")

    def runs(spans: Column) -> Column:
        """Spans merged where they touch; they are in order of their starts and of their ends."""
        first = F.filter(spans, lambda x, i: F.coalesce(F.get(spans, i - 1)["e"] < x["s"], F.lit(True)))
        last = F.filter(spans, lambda x, i: F.coalesce(F.get(spans, i + 1)["s"] > x["e"], F.lit(True)))
        return F.zip_with(first, last, lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e")))

    def cleaned(seg: Column) -> Column:
        def joined(s: Column, e: Column) -> Column:
            return F.array_join(F.slice(seg, s + 1, e - s), "")

        def span(at: Column) -> Column:
            s, n = _span(at)
            return F.struct(s.alias("s"), (s + n).alias("e"))

        def rebuilt(gone: Column) -> Column:
            # what stands between the removed runs
            stops = F.concat(F.transform(gone, lambda r: r["s"]), F.array(F.size(seg)))
            begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda r: r["e"]))
            kept = F.zip_with(begins, stops, joined)
            return F.struct(F.array_join(kept, "").alias("clean_text"),
                            F.aggregate(gone, F.lit(0), lambda a, r: a + r["e"] - r["s"]).cast("long").alias("n_removed"))

        return let(F.filter(let(F.transform("again", span), runs), lambda r: F.length(joined(r["s"], r["e"])) >= min_run_chars), rebuilt)

    untouched = F.struct(F.col("text").alias("clean_text"), F.lit(0).cast("long").alias("n_removed"))
    # joined by k alone, as the chunks' bytes were: the texts are dealt once for both
    with_again = texts.join(found, "k", "left").withColumn("again", again)
    result = F.when(F.coalesce(F.size("again"), F.lit(0)) < 1, untouched).otherwise(let(_segments(F.col("text")), cleaned))
    done = with_again.select(kept, "text", F.inline(F.array(result)))
    rest = base.where(F.col("text").isNull() | (F.col("text") == "")).select(
        kept, "text", F.col("text").alias("clean_text"), F.lit(0).cast("long").alias("n_removed"))
    return done, rest


def dedup(docs: DataFrame, min_run_chars: int = MIN_RUN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What is left of each document without passages that another place holds first.

    Returns one row per input row: the id, ``clean_text``, ``n_removed``
    (segments) and ``chars_removed``.  The first place is that
    with the smallest id, then text hash, then position; a null id comes before
    all others.  A null text stays null, an empty text
    stays empty.  Repeated rows of one id and text count as one document and get
    the same result.  Other columns of any name are not looked at.
    """
    done, rest = _cleaned(docs, min_run_chars, [], text_col, id_col)
    return done.union(rest).select(
        "kept.*", "clean_text", "n_removed",
        F.coalesce(F.length("text") - F.length("clean_text"), F.lit(0)).cast("long").alias("chars_removed"))


def dedup_rows(docs: DataFrame, min_run_chars: int = MIN_RUN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns and the cleaned text in place of the text.

    A row whose whole text was repetition is left out; rows whose text was null
    or empty before are kept as they are.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    done, rest = _cleaned(docs, min_run_chars, others, text_col, id_col)
    return done.where("clean_text <> ''").union(rest).select("kept.*", F.col("clean_text").alias(text_col)).select(*docs.columns)
