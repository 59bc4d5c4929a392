"""Operator 2, WARC through a chunked record table.

A payload is carried as rows (record_id, chunk): each is a slice of the payload with the running digest of
the payload up to its end. A payload larger than one chunk becomes WARC segments: the first has the
record's type and WARC-Segment-Number 1, the others are continuation records with the first one's id, and the
last states the total length. Thus no task ever holds more of a record than a chunk besides the
column value that Spark itself holds, and a record may lie in more than one archive.

Digests are computed on reading and held against those in the headers: an unsegmented record's where its
archive is parsed (only the digest goes on), a segmented one's incrementally: its segments meet, sorted, each is fed to the
running SHA-256, compared with the running digest that its row carried, and let go. What is stated of a revisit is
what was read of the response that it refers to.

Archives are written by Spark's text sink with \\r\\n\\r\\n as the row end (which is how WARC ends a record), gzipped,
each file bounded in bytes (as many records as chunks fit in); they are read with the binary-file source, inflated in
bounded blocks and parsed by Content-Length, so a payload may contain anything. An archive that ends inside a record is an error.

Of records with equal payloads of `min_revisit` bytes or more that with the smallest id is a response; the others are
revisits without payload, which refer to it and state its digest and length.

Record ids number the rows of `pages` as they are scanned; pages that come out of a shuffle must be stored first, so that
a task that runs again gives the same numbers.

Cases: a null payload is empty; a null id is written as "null", read back as null, and never the response of
a group; of rows that repeat an id and a payload one is the response, the others revisit it; a null url is left out; an empty table writes no records; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, stored

#: The most bytes of chunks in an Arrow batch that leaves Python.
MOST = 1 << 20

#: Fixed values of WARC 1.1 for the header lines written here.
VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:foliodex:page:"
EOL = "\r\n"


_STRING, _INT, _LONG, _BYTES = ("string", pa.string()), ("int", pa.int32()), ("long", pa.int64()), ("binary", pa.binary())
RECORD = {"record_id": _STRING, "url": _STRING, "digest": _STRING, "length": _LONG, "refers_to": _STRING, "chunk": _INT, "chunks": _INT, "running": _STRING, "body": _BYTES}
SEGMENT = {
    "record_id": _STRING, "chunk": _INT, "type": _STRING, "url": _STRING, "digest": _STRING, "length": _LONG, "refers_to": _STRING, "running": _STRING, "whole_digest": _STRING, "body_bytes": _LONG,
    "body": _BYTES,
}
READ = {"record_id": _STRING, "url": _STRING, "payload_bytes": _LONG, "payload_digest": _STRING, "declared_digest": _STRING, "record_type": _STRING, "refers_to": _STRING, "running_ok": ("boolean", pa.bool_())}


def _packed(rows: list[tuple], columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))


def _schema(columns: dict) -> str:
    return ", ".join(f"{name} {kind}" for name, (kind, _) in columns.items())


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))


def record_rows(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", chunk_bytes: int = 256 << 10, min_revisit: int = 100) -> DataFrame:
    """The chunked record table: record_id, url, digest, length, refers_to, chunk, chunks, running (digest up to the chunk's end), body."""
    # the row's own number makes record ids unique where page ids repeat; it comes from the scan, before any exchange
    rows = pages.select(
        F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.monotonically_increasing_id().cast("string")).alias("record_id"),
        F.col(id_col).cast("long").alias("order_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.octet_length("payload").cast("long"))
    # only digests, not payloads, meet here; the groups are written, so that their size decides how they are joined
    place = F.struct("order_id", "record_id")
    able = rows.where((F.col("length") >= min_revisit) & F.col("order_id").isNotNull())
    groups = able.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    groups = stored(groups.select("digest", F.col("first.record_id").alias("first")), "payloads")
    typed = rows.join(groups, "digest", "left").withColumn("refers_to", F.when(F.col("record_id") != F.col("first"), F.col("first")))
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit("").cast("binary"))
    names = ["record_id", "url", "digest", "length", "refers_to"]

    def run(batches):
        for batch in batches:
            heads, payloads = [batch.column(n) for n in names], batch.column("payload")
            out, held = [], 0
            for i in range(batch.num_rows):
                head, payload, sha = tuple(h[i].as_py() for h in heads), memoryview(payloads[i].as_buffer()), hashlib.sha256()
                chunks = max(1, -(-len(payload) // chunk_bytes))
                for k in range(chunks):
                    part = bytes(payload[k * chunk_bytes : (k + 1) * chunk_bytes])
                    sha.update(part)
                    out.append((*head, k + 1, chunks, sha.hexdigest(), part))
                    held += len(part)
                    if held >= MOST or len(out) == 1024:
                        yield _packed(out, RECORD)
                        out, held = [], 0
            if out:
                yield _packed(out, RECORD)

    return arrow_map(typed.select(*names, body.alias("payload")), run, _schema(RECORD))


def write_archives(records: DataFrame, path: str, *, records_per_file: int) -> None:
    """Write the rows of record_rows as gzipped WARC files in the folder `path`; a file holds at most records_per_file chunks."""
    first = F.col("chunk") == 1
    uri = F.concat(F.lit(f"<{ID}"), F.col("record_id"), F.lit(">"))
    part = F.concat(F.lit(f"<{ID}"), F.col("record_id"), F.lit(":"), F.col("chunk").cast("string"), F.lit(">"))
    kind = F.when(~first, "continuation").when(F.col("refers_to").isNotNull(), "revisit").otherwise("response")
    none = F.lit("")
    header = F.concat(
        F.lit(VERSION + EOL),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.when(first, uri).otherwise(part)),
        _line("WARC-Date", F.lit(DATE)),
        F.when(first & F.col("url").isNotNull(), _line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", ""))).otherwise(none),
        F.when(first, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(none),
        F.when(first, _line("X-Payload-Length", F.col("length"))).otherwise(none),
        F.when(F.col("refers_to").isNotNull(), F.concat(_line("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("refers_to").cast("string"), F.lit(">"))), F.lit(f"WARC-Profile: {PROFILE}{EOL}"))).otherwise(none),
        F.when(F.col("chunks") > 1, _line("WARC-Segment-Number", F.col("chunk"))).otherwise(none),
        F.when(~first, _line("WARC-Segment-Origin-ID", uri)).otherwise(none),
        F.when((F.col("chunks") > 1) & (F.col("chunk") == F.col("chunks")), _line("WARC-Segment-Total-Length", F.col("length"))).otherwise(none),
        F.when(F.col("refers_to").isNull(), _line("X-Running-Digest", F.concat(F.lit("sha256:"), F.col("running")))).otherwise(none),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length("body")),
        F.lit(EOL),
    )
    value = F.concat(header.cast("binary"), F.col("body")).cast("string")
    records.select(value.alias("value")).write.option("compression", "gzip").option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_per_file).text(path)


class _Feed:
    """Reads lines and exact lengths from a gzipped archive (of one member or many), inflating at most a block at a time."""

    def __init__(self, raw, block: int = 1 << 18):
        self.raw, self.at, self.block, self.zip, self.have, self.pos = memoryview(raw), 0, block, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        while True:
            if self.zip.eof:
                rest = self.zip.unused_data
                if not rest and self.at >= len(self.raw):
                    return False
                self.zip = zlib.decompressobj(31)
            else:
                rest = self.zip.unconsumed_tail
            if not rest:
                if self.at >= len(self.raw):
                    if self.at:
                        raise ValueError("an archive ends inside a gzip member")
                    return False
                rest = self.raw[self.at : self.at + self.block]
                self.at += self.block
            if new := self.zip.decompress(rest, self.block):
                self.have, self.pos = self.have[self.pos :] + new, 0
                return True

    def line(self) -> bytes | None:
        """The next line, or None at the end of the archive."""
        while (end := self.have.find(b"\r\n", self.pos)) < 0:
            if not self._more():
                if len(self.have) > self.pos:
                    raise ValueError("an archive ends inside a line")
                return None
        out, self.pos = self.have[self.pos : end], end + 2
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) - self.pos < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        out, self.pos = self.have[self.pos : self.pos + n], self.pos + n
        return out

    def header(self) -> dict[str, str]:
        """The header fields up to the empty line."""
        fields = {}
        while line := self.line():
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        if line is None:
            raise ValueError("an archive ends inside a header")
        return fields


def _id_in(value: str | None) -> str | None:
    return value[1 + len(ID) : -1] if value else None


def _sha_in(value: str | None) -> str | None:
    return value.removeprefix("sha256:") if value else None


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record (segment) of the archives in `path`."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("content"):
                feed, rows, held = _Feed(raw.as_buffer()), [], 0
                while (start := feed.line()) is not None:
                    if not start:
                        continue
                    if start.decode() != VERSION:
                        raise ValueError(f"not a WARC record: {start[:40]!r}")
                    head = feed.header()
                    body = feed.take(int(head["Content-Length"]))
                    whole = "WARC-Segment-Number" not in head
                    rows.append(
                        (
                            _id_in(head.get("WARC-Segment-Origin-ID") or head["WARC-Record-ID"]),
                            int(head.get("WARC-Segment-Number", 1)),
                            head["WARC-Type"],
                            head.get("WARC-Target-URI"),
                            _sha_in(head.get("WARC-Payload-Digest")),
                            int(head["X-Payload-Length"]) if "X-Payload-Length" in head else None,
                            _id_in(head.get("WARC-Refers-To")),
                            _sha_in(head.get("X-Running-Digest")),
                            hashlib.sha256(body).hexdigest() if whole else None,
                            len(body),
                            None if whole else body,
                        )
                    )
                    held += 0 if whole else len(body)
                    if held >= MOST or len(rows) == 1024:
                        yield _packed(rows, SEGMENT)
                        rows, held = [], 0
                if rows:
                    yield _packed(rows, SEGMENT)

    files = spark.read.format("binaryFile").load(path).select("content")
    return arrow_map(files, run, _schema(SEGMENT))


def read_records(segments: DataFrame) -> DataFrame:
    """Per record: record_id, url, length and digest of its own payload as read, declared digest, type, refers_to, running_ok.

    Records in one segment are digested where they are. Segments of others meet sorted by
    (record, number); each updates the record's running digest, which is held against the segment's own, and is let go.
    """

    def run(batches):
        current, sha, size, head, good = None, None, 0, None, True

        def done():
            kind, url, digest, refers, whole = head
            return (current, url, size, whole or sha.hexdigest(), digest, kind, refers, good)

        for batch in batches:
            rows = []
            columns = [batch.column(n).to_pylist() for n in SEGMENT]
            for rid, chunk, kind, url, digest, _, refers, running, whole, n, body in zip(*columns, strict=True):
                if chunk == 1:
                    if head is not None:
                        rows.append(done())
                    current, sha, size, head, good = rid, hashlib.sha256(), 0, (kind, url, digest, refers, whole), True
                elif rid != current:
                    raise ValueError(f"a segment of record {rid} has no first segment before it")
                sha.update(body or b"")
                size += n
                good = good and running in (None, whole or sha.hexdigest())
            if rows:
                yield _packed(rows, READ)
        if head is not None:
            yield _packed([done()], READ)

    sorted_rows = segments.repartition("record_id").sortWithinPartitions("record_id", "chunk")
    return arrow_map(sorted_rows, run, _schema(READ))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """The rows of read_records, revisits with the length and digest that were read of the response they refer to (null if it is missing).

    Only revisits and responses that some revisit names are joined, so that rows without a reference meet nowhere.
    """
    records = stored(records, "records")
    revisits = records.where("refers_to IS NOT NULL")
    named = revisits.select("refers_to").distinct()
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"), F.col("running_ok").alias("_ok"))
    responses = responses.join(named, "refers_to", "left_semi").hint("merge")
    met = revisits.join(responses, "refers_to", "left").withColumns({"payload_bytes": F.col("_bytes"), "payload_digest": F.col("_digest"), "running_ok": F.coalesce("_ok", F.lit(False))})
    return records.where("refers_to IS NULL").unionByName(met.select(*records.columns))


def round_trip(pages: DataFrame, path: str, *, chunk_bytes: int = 256 << 10, file_bytes: int = 64 << 20, **options) -> DataFrame:
    """Write pages as archives and read them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to, digest_ok.

    An archive holds at most file_bytes of payload (one chunk at least).
    """
    write_archives(record_rows(pages, chunk_bytes=chunk_bytes, **options), path, records_per_file=max(1, file_bytes // chunk_bytes))
    read = resolve_revisits(read_records(read_segments(pages.sparkSession, path)))
    return read.select(
        F.expr("try_cast(split_part(record_id, ':', 1) AS BIGINT)").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(split_part(refers_to, ':', 1) AS BIGINT)").alias("refers_to"),
        (F.col("payload_digest").eqNullSafe(F.col("declared_digest")) & F.col("running_ok")).alias("digest_ok"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY 1)
SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to, TRUE AS digest_ok
FROM p LEFT JOIN f ON p.d = f.d
"""
