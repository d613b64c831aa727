"""WARC archives of web pages, and their capture index by an external merge.

Writing: each record is a gzip member of its own, so that one can be fetched by (file, offset, length); Spark's text sink
puts the members one after the other, on any file system Spark can write. Reading: each archive yields a run of captures
sorted by URL key and time; runs are dealt by key ranges of bounded size, and each range merges its parts of the runs
through a loser tree into globally ordered histories.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 1000
#: Records of an archive, fewer where pages have LARGE_BYTES or more: both bound what a reading task holds.
FILE_RECORDS, LARGE_RECORDS, LARGE_BYTES = 2000, 16, 1 << 20
#: Captures of one range of the index, and of a run's block that is taken into the merge at once.
RANGE_ROWS, BLOCK_ROWS = 200_000, 1024
#: A gzip member ends in the upper byte of its length, which is zero below this. Longer records take several members.
MEMBER_BYTES = (1 << 24) - 1
#: A hundred years: the dates that stand in for page ids stay within what a timestamp holds.
DATE_SECONDS = 3_155_760_000
_END = "\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the top domain down, then path and query; scheme, www, port 80/443 and fragment go."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "#.*$", ""), r"^[a-z][a-z0-9+.-]*://(?:www\d*\.)?", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), ":(80|443)$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_replace(bare, "^[^/?]*", ""))


def decide_records(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html, captured) with payload_bytes, payload_digest and refers_to (null: a response).

    Payloads are compared by length and SHA-1. Only ids and digests are grouped, with a partial maximum before the
    shuffle; pages of a very common payload meet its last page by broadcast; the join back is on the page. Rows without page_id are responses, and never referred to."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.withColumn("html", html).withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha1(F.col("html").cast("binary")))
    large = pages.filter(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_bytes", "payload_digest")
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    key = ["payload_digest", "payload_bytes"]
    groups = common.written(groups, "payloads")
    same = common.join_hot(large, groups.select(*key, "_last"), key, groups.select(*key, F.col("_n").alias("n")))
    again = same.filter("page_id < _last").select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("_last").alias("refers_to")).distinct()
    return pages.join(again, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")


def record_text(decided: DataFrame) -> DataFrame:
    """(value): one WARC/1.1 record a row, with its closing separator."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        line("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("_block").cast("string")),
        F.lit("\r\n"),
    )
    return decided.withColumn("_block", block).select(F.concat(header, "_block", F.lit(_END)).alias("value"))


def gzip_members(record: bytes) -> bytes:
    """record as gzip: one member, or several where it is very long."""
    out = b""
    for at in range(0, len(record), MEMBER_BYTES):
        coder = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += coder.compress(record[at : at + MEMBER_BYTES]) + coder.flush()
    return out


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members without their last byte, a zero: the sink's line separator supplies it."""
    for batch in common.slices(batches, "value"):
        members = [gzip_members(x.as_buffer().to_pybytes())[:-1] for x in common.column(batch, "value")]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["value"])


def write_warc(pages: DataFrame, path: str, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, min_bytes: int = REVISIT_BYTES) -> str:
    """Writes gzip-compressed archives under path; returns path.

    Without date_col, page ids, whatever their size or sign, count seconds from 2020 modulo DATE_SECONDS. Null html is an
    empty payload, a null url an empty address, a null page_id a record with a random id, which no other refers to or is
    merged with. Repeated ids: a record each; of equal payloads of the largest id one is the response. Empty table: no
    record. Other columns do not matter."""
    seconds = F.lit(1577836800) + F.pmod(F.coalesce(F.col(page_col).cast("long"), F.lit(0)), F.lit(DATE_SECONDS))
    when = F.col(date_col).cast("timestamp") if date_col else F.timestamp_seconds(seconds)
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), when.alias("captured"))
    decided = decide_records(rows, min_bytes)
    large = F.col("payload_bytes") >= LARGE_BYTES
    _append(decided.filter(~large), path, FILE_RECORDS)
    if rows.filter(F.octet_length("html") >= LARGE_BYTES).take(1):
        _append(decided.filter(large), path, LARGE_RECORDS)
    return path


def _append(decided: DataFrame, path: str, records_per_file: int) -> None:
    members = record_text(decided).mapInArrow(common.tidy(_compressed), "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _number(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def _capture(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']}: payload differs from its digest")
    return _number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), headers["WARC-Date"], size, digest, headers["WARC-Type"], _number(headers.get("WARC-Refers-To"))


def members(raw: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of an archive's records: members are unpacked one by one, until a record is whole."""
    at = 0
    while at < len(raw):
        start, record, whole = at, bytearray(), False
        while not whole:
            coder = zlib.decompressobj(31)
            while not coder.eof:
                piece = raw[at : at + (1 << 16)]
                if not piece:
                    raise ValueError(f"the record at byte {start} is cut off")
                record += coder.decompress(piece)
                at += len(piece) - len(coder.unused_data)
            end = record.find(b"\r\n\r\n")
            whole = end >= 0 and len(record) >= end + 8 + int(record[:end].rpartition(b"Content-Length: ")[2])
        yield start, at - start, bytes(record)


def fetch(raw: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at a place that the index names, of an archive's bytes."""
    return next(records(next(members(memoryview(raw)[offset : offset + length]))[2]))


_CAPTURES = "run string, offset long, length long, page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """(run, offset, length, page_id, url, payload_bytes, payload_digest, record_type, refers_to, url_key, captured) of the
    archives under path; run is the archive, and the record stands at offset in it. Payloads are checked against their
    digests, one record at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in _CAPTURES.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                found = [(name.as_py(), offset, length, *_capture(*next(records(record)))) for offset, length, record in members(memoryview(content.as_buffer()))]
                cols = list(zip(*found, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    parsed = files.mapInArrow(common.tidy(parse), _CAPTURES)
    return parsed.withColumn("url_key", url_key(F.col("url"))).withColumn("captured", F.to_timestamp("date")).drop("date")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a pop replays one path from leaf to root."""

    def __init__(self, runs: list):
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _less(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return a is not None and (b is None or (a, i) < (b, j))

    def _enter(self, i: int) -> None:
        """While the tree is built: i climbs until it meets an empty node, where it waits."""
        node = (i + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._less(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while self.k and (head := self.heads[i := self.losers[0]]) is not None:
            yield head
            self.heads[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node:
                if self._less(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.losers[0] = i


def capture_index(captures: DataFrame) -> DataFrame:
    """Captures in global order of (url_key, captured, page_id), partitions being ranges of it. Ties keep both rows.

    Captures (no payloads) are sorted in the tasks that read their archives and written once, then cut into ranges of about RANGE_ROWS, by time and page too, so that one
    much captured URL spreads over several and a merging task's rows are bounded; their keys are unpacked a block of
    each run at a time. Null page ids come first. No captures: empty result."""
    captures = common.written(captures.sortWithinPartitions("run", "url_key", "captured", "page_id"), "captures")
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // RANGE_ROWS))
    cols = captures.columns
    dealt = captures.repartitionByRange(n, F.col("url_key"), F.col("captured"), F.col("page_id")).sortWithinPartitions("run", "url_key", "captured", "page_id")
    run, key, time, page = (cols.index(c) for c in ("run", "url_key", "captured", "page_id"))

    def keys(table: pa.Table, begin: int, end: int) -> Iterator[tuple]:
        for at in range(begin, end, BLOCK_ROWS):
            block = table.slice(at, min(BLOCK_ROWS, end - at))
            for i, (k, t, p) in enumerate(zip(block.column(key).to_pylist(), block.column(time).cast(pa.int64()).to_pylist(), block.column(page).to_pylist(), strict=True), at):
                yield k, t, p is not None, p or 0, i

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        names = table.column(run).combine_chunks().dictionary_encode()
        names = (names.chunk(0) if isinstance(names, pa.ChunkedArray) else names).indices.to_numpy()
        begin = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]).tolist()
        order = [x[-1] for x in LoserTree([keys(table, a, b) for a, b in zip(begin, [*begin[1:], len(names)], strict=True)])]
        for at in range(0, len(order), 10_000):
            yield from table.take(pa.array(order[at : at + 10_000])).combine_chunks().to_batches()

    return dealt.mapInArrow(common.tidy(merge), captures.schema)
