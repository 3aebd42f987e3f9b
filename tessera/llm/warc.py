"""WARC archives of page captures, and their index merged from sorted runs.

Writing: each page is one record. Payloads are hashed where they are read, and what repeats is found on narrow rows
(page, digest, size). Revisits carry no payload and are written from those rows; responses are the pages that are no
revisits, told apart by (page, digest), so no digest, however common, gathers page bodies in one task. A record is one
string, its two closing line ends the separator of the engine's text writer: archives are plain WARC files,
committed whole, in any store the engine writes to. Pages of like size share archives, so that none has many more than
``ARCHIVE_BYTES`` unless a single record has.

Reading: whole archives, parsed by Content-Length. The captures of one archive, sorted by URL key and time, are one run
of the index. Merging deals the runs' rows out by ranges of (URL key, time, page) of about ``RANGE`` captures, where they
arrive run by run in order and are joined with a k-way loser tree; in order of ``part`` and ``at`` the result is the
captures of all archives in global order, the history of each URL together.

Defined results: null html is an empty payload, null url an empty target; line ends in a url are percent-coded; payloads
under ``MIN_BYTES`` are always responses; a page_id that occurs more than once with the smallest id of its payload is a
response each time; a null page_id is never the smallest, and a payload with no id but null ones is a response each
time. Dates are in UTC. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

MIN_BYTES = 100
#: Bytes of an archive's payloads, and its records, at most (a single larger record is an archive of its own).
ARCHIVE_BYTES, RECORDS = 64 << 20, 2048
#: Captures of one merged range, about.
RANGE = 50_000
#: Captures without a date are dated one second apart from here, by page_id.
FIRST_DATE = 1_577_836_800
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CAPTURE = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
MERGED = T.StructType([*CAPTURE.fields, T.StructField("at", T.LongType())])


def _known(pages: DataFrame) -> DataFrame:
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    return known.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})


def deduplicated(pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """(responses with their payload, revisits without): page_id, url, payload_bytes, payload_digest, refers_to."""
    known = _known(pages)
    narrow = materialize(known.drop("payload"), "captures-narrow")
    firsts = narrow.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    revisits = narrow.where(F.col("payload_bytes") >= min_bytes).join(firsts.where("n > 1 and refers_to is not null").drop("n"), "payload_digest")
    revisits = materialize(revisits.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))), "revisits")
    gone = revisits.select(F.col("page_id").alias("gone_id"), F.col("payload_digest").alias("gone_digest")).distinct()
    same = known["page_id"].eqNullSafe(gone["gone_id"]) & (known["payload_digest"] == gone["gone_digest"])
    responses = known.join(gone, same, "left_anti")
    return responses.withColumn("refers_to", F.lit(None).cast("long")), revisits


def _id(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))


def _date(seconds: Column) -> Column:
    """Seconds since 1970 as a date and time in UTC, whatever the session's zone."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rest = F.pmod(seconds, F.lit(86_400))
    day = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


def _records(p: DataFrame, kind: str) -> DataFrame:
    """The text of a record of each row but for its closing line ends."""
    seconds = F.lit(FIRST_DATE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    if kind == "response":
        block, extra, content = F.concat(F.lit(_HTTP), F.col("payload")), F.lit(""), "application/http; msgtype=response"
    else:
        block, content = F.lit(_HTTP), "application/http"
        extra = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _id(F.col("refers_to")), F.lit("\r\n"))
    record = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), _id(F.col("page_id")),
        F.lit("\r\nWARC-Date: "), _date(seconds),
        F.lit("\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"), extra,
        F.lit(f"Content-Type: {content}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )
    return p.select(record.alias("value"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write one record per page to WARC files in folders under ``path``, one folder for each class of sizes."""
    responses, revisits = deduplicated(pages, min_bytes)

    def put(records: DataFrame, name: str, most: int) -> None:
        records.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", most).text(f"{path}/{name}")

    put(_records(revisits, "revisit"), "revisits", RECORDS)
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    low, records = -1, RECORDS
    while low < largest or low < 0:  # sizes up to archive_bytes / records, records sixteen times fewer each time
        high = archive_bytes // records if records > 1 else largest
        sized = responses.where((F.col("payload_bytes") > low) & (F.col("payload_bytes") <= high))
        put(_records(sized, "response"), f"to-{high}", records)
        low, records = max(high, 0), max(1, records // 16)


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers, block) of each record of an archive."""
    view, at, end = memoryview(data), 0, len(data)
    while at < end:
        head_end = data.find(b"\r\n\r\n", at)
        if head_end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:head_end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        start = head_end + 4
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end as its length says")
        yield at, stop + 4 - at, headers, view[start:stop]
        at = stop + 4


def url_key(url: str) -> str:
    """Host labels in reverse order, then the rest; keys of one site sort together."""
    scheme, sep, rest = url.partition("://")
    if not sep:
        return url
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _page(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def _sort_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives; those of one archive are sorted, one run of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, archive = [], name.as_py().rpartition("/")[2]
                for offset, length, h, block in records(content.as_py()):
                    kind, said = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(h["X-Payload-Length"])
                    if kind == "response":
                        payload = block[len(_HTTP) :]
                        found, size = hashlib.sha256(payload).hexdigest(), len(payload)
                        if found != said:
                            raise ValueError(f"{archive}: the payload at byte {offset} is damaged")
                    url = h["WARC-Target-URI"]
                    rows.append((url_key(url), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, kind, size, said, _page(h.get("WARC-Refers-To")), archive, offset, length))
                rows.sort(key=_sort_key)
                yield _batch(rows, CAPTURE)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, CAPTURE)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema)], names=schema.names)


class LoserTree:
    """Merge of k sorted sequences: each inner node keeps the loser of its match, the winner goes up."""

    _END = object()

    def __init__(self, runs: list[Iterator[Any]], key):
        self.runs, self.key, self.k = [iter(r) for r in runs], key, max(1, len(runs))
        if not runs:
            self.runs = [iter(())]
        self.heads = [next(r, self._END) for r in self.runs]
        self.keys = [None if h is self._END else key(h) for h in self.heads]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _before(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; ended runs come last, ties go to the earlier run."""
        if self.heads[a] is self._END or self.heads[b] is self._END:
            return self.heads[a] is not self._END or (self.heads[b] is self._END and a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        node = (i + self.k) >> 1
        while node > 0:
            other = self.tree[node]
            if other < 0:  # while the tree is built: wait for the opponent
                self.tree[node] = i
                return
            if self._before(other, i):
                self.tree[node], i = i, other
            node >>= 1
        self.tree[0] = i

    def __iter__(self) -> Iterator[Any]:
        while (head := self.heads[w := self.tree[0]]) is not self._END:
            yield head
            self.heads[w] = new = next(self.runs[w], self._END)
            self.keys[w] = None if new is self._END else self.key(new)
            self._play(w)


def merge_runs(runs: DataFrame, captures: int = RANGE) -> DataFrame:
    """Captures of all runs with ``part`` and ``at``: in that order they are sorted by URL key, time and page.

    ``runs`` must be a written table: it is counted, and looked at once to choose ranges of about ``captures`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:  # run after run, each in order
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                by_run.setdefault(row[8], []).append(row)
        out, at = [], 0
        for row in LoserTree(list(by_run.values()), _sort_key):
            out.append((*row, at))
            at += 1
            if len(out) == 4096:
                yield _batch(out, MERGED)
                out = []
        if out:
            yield _batch(out, MERGED)

    key = ["url_key", "time", "page_id"]
    ranges = max(1, -(-runs.count() // captures))
    dealt = runs.select(*CAPTURE.names).repartitionByRange(ranges, *key, "archive", "offset").sortWithinPartitions("archive", *key)
    return dealt.mapInArrow(run, MERGED).withColumn("part", F.spark_partition_id())


def archive_and_read(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archives under ``path``, read them back and return the merged index."""
    spark = pages.sparkSession
    write(pages, path, min_bytes)
    return merge_runs(materialize(read_runs(spark, path), "captures"))
