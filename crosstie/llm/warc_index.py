"""Web archives with an externally merged capture index.

Pages become WARC records in many archives, one per task, each sorted by URL key
and time.  Reading an archive back gives a sorted run of captures; the runs are
dealt by ranges of (URL key, time) and each range merges its part of all runs
with a loser tree, so the ranges in order are one globally ordered index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstie.llm.common import saved, ship

ship(__name__)

VERSION = "WARC/1.1"
EPOCH = "2020-01-01T00:00:00Z"
#: an archive never exceeds this, whatever the pages are like
MAX_ARCHIVE_BYTES = 512 * 1024 * 1024
#: room for the head of a record besides its payload and address
HEAD_BYTES = 2048
RECORD_DDL = ("archive string, offset long, length long, page_id long, url string, url_key string, ts string, record_type string,"
              " refers_to long, payload_bytes long, payload_digest string")


def url_key(url: Column) -> Column:
    """Sortable form of a URL: host labels from the top, then path and query.

    ``http://a.example.org/x?y`` becomes ``org,example,a)/x?y``; scheme, port
    and user are left out, letters are lower-cased, null stands for ``)``.
    """
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?#]*)", 1), r"^.*@", ""), r":\d*$", "")
    rest = F.regexp_extract(bare, r"^[^/?#]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def _one_line(c: Column) -> Column:
    """A header value: line ends and other control characters are escaped."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x1f\x7f]", " ")


def typed_pages(pages: DataFrame) -> DataFrame:
    """Each page with its payload digest and whether it repeats another's payload.

    Of the pages of one payload, that with the smallest id is the response; all
    rows with that id are.  Pages without an id are responses if no page of the
    payload has one, and revisits otherwise.  Only digests are dealt; the
    payload travels once, by its page.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", payload.alias("payload"))
    keys = base.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("bytes"))
    first = keys.groupBy("sha", "bytes").agg(F.min("page_id").alias("first_id"))
    typed = (
        keys.join(first, ["sha", "bytes"])
        .select("page_id", "sha", "bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to"))
        .distinct().withColumnRenamed("page_id", "typed_id").withColumnRenamed("sha", "typed_sha")
    )
    carried = base.withColumn("sha", F.sha1("payload"))
    same = carried["page_id"].eqNullSafe(typed["typed_id"]) & (carried["sha"] == typed["typed_sha"])
    return carried.join(typed, same).select("page_id", "url", "payload", "sha", "bytes", "refers_to")


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes gzip-packed WARC files, one or more per task, the records sorted by URL key and time.

    A record is written by the text sink with the record's end as line end, so
    the files hold exactly the records, in any store Spark writes to, and a task
    that is run again replaces its file.  The capture time follows from the page
    id, as the pages have none.  A revisit carries no payload.
    """
    longest = pages.agg(F.max(F.octet_length("html") + 3 * F.octet_length("url"))).first()[0] or 0
    t = typed_pages(pages)
    ts = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2020-01-01"), "yyyy-MM-dd") + F.pmod(F.coalesce("page_id", F.lit(0)),
                       F.lit(10 ** 9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), _one_line(F.col("url")), F.lit("\r\nWARC-Date: "), F.col("ts"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("sha"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                                       "\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string"), F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    (
        t.withColumn("ts", ts).withColumn("key", url_key(_one_line(F.col("url"))))
        .sortWithinPartitions("key", "ts", "page_id")
        .select(head.alias("value"))
        .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", max(1, MAX_ARCHIVE_BYTES // (longest + HEAD_BYTES))).text(path)
    )


def parse_archive(name: str, content: bytes) -> Iterator[tuple]:
    """Records of one unpacked archive in file order, by their stated lengths;
    offsets count unpacked bytes.  Raises if a response's payload has another
    length or digest than its head states."""
    at, size = 0, len(content)
    while at < size:
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"{name}: no record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        start, length = end + 4, int(head["Content-Length"])
        stop = start + length
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at byte {at} does not end at {stop}")
        sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (length != int(head["X-Payload-Length"]) or hashlib.sha1(memoryview(content)[start:stop]).hexdigest() != sha):
            raise ValueError(f"{name}: the payload of the record at byte {at} is not the one its head states")
        digest = base64.b32encode(bytes.fromhex(sha)).decode()
        yield (name, at, stop + 4 - at, _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Type"],
               _page(head.get("WARC-Refers-To", "")), int(head["X-Payload-Length"]), digest)
        at = stop + 4


def _page(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives; the rows of an archive are a sorted run."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "offset", "length", "page_id", "url", "ts", "record_type", "refers_to", "payload_bytes", "payload_digest"]
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                rows = pd.DataFrame(list(parse_archive(name, gzip.decompress(content))), columns=columns)
                for c in ("page_id", "refers_to"):
                    rows[c] = rows[c].astype("Int64")
                yield rows

    fields = RECORD_DDL.replace(" url_key string,", "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInPandas(parse, fields).withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: the root holds the smallest head, every inner node
    the loser of the match played there, so a new head replays one path."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.k = runs, [0] * len(runs), max(1, len(runs))
        self.losers = [-1] * self.k
        for run in range(len(runs)):
            self._replay(run)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; a spent run comes last."""
        if self.at[a] >= len(self.runs[a]):
            return False
        if self.at[b] >= len(self.runs[b]):
            return True
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _replay(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the opponent has not come yet: wait here
                self.losers[node] = winner
                return
            if self._before(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs:
            run = self.losers[0]
            if self.at[run] >= len(self.runs[run]):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self._replay(run)


def merge_runs(runs: DataFrame) -> DataFrame:
    """One globally ordered capture index out of sorted runs.

    Adds ``key_range`` and ``place``: ordered by both, the captures are ordered
    by URL key, time and page id (null first).  Ranges are cut from a sample of the keys of
    all runs, time and page included, so a URL with a third of all captures is
    dealt over several; a task holds the captures of its range only.
    """
    names = [f.split(" ")[0] for f in RECORD_DDL.split(", ")]
    dealt = runs.repartitionByRange("url_key", "ts", "page_id").withColumn("key_range", F.spark_partition_id())

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        exact = rows["page_id"].astype("Int64").fillna(-(1 << 63)).tolist()
        keys = list(zip(rows["url_key"], rows["ts"], exact, range(len(rows))))
        by_run: dict[str, list[tuple]] = {}
        for name, key in zip(rows["archive"], keys):
            by_run.setdefault(name, []).append(key)
        order = [key[3] for key in LoserTree(list(by_run.values()))]
        merged = rows.iloc[order].assign(place=range(len(rows)))
        for c in ("page_id", "refers_to"):
            merged[c] = merged[c].astype("Int64")
        yield merged

    sorted_runs = dealt.sortWithinPartitions("archive", "offset")  # the runs of a range, each in its order
    return sorted_runs.select(*names, "key_range").mapInPandas(merge, f"{RECORD_DDL}, key_range int, place long")


def archive_pages(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives, reads them back and merges their captures.

    Returns one row per page: archive, offset, length, page_id, url, url_key,
    ts, record_type, refers_to, payload_bytes, payload_digest, key_range and
    place.  A null html is an empty payload, a null url an empty address; null
    ids and repeated rows are kept; further columns of any name are not looked
    at; an empty table gives an empty result.
    """
    write_archives(pages, path)
    return merge_runs(saved(read_runs(pages.sparkSession, path), "capture-runs"))
