"""WARC archives: writing pages as records, and reading them back by reassembling segments.

A page becomes a ``response`` record whose block is an HTTP message in chunked transfer framing. A block over the
segment size is cut: the first segment keeps the record's type, the rest are ``continuation`` records that name
their origin, are numbered from 2 on, and the last of them states the total length. Pages whose payload another
page has too become ``revisit`` records that refer to it.

Archives are written by Spark's text writer: a record is a row and the separator of rows is the pair of line ends
that closes a record, so commits, retries and remote stores are Spark's. Payloads are UTF-8 text and cut between
characters. Reading parses each file as a stream, groups the segments by origin, orders them by number, verifies
the stated total, and decodes the chunks.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm.common import arrow_map, fresh_key

END = "\r\n"
CHUNK, SEGMENT = 8_192, 65_536  # code points
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORDS_PER_FILE = 4_000


def _lines(*parts: Column) -> Column:
    """Header lines; null ones are left out."""
    return F.concat(F.concat_ws(END, *parts), F.lit(END + END))


def _field(name: str, value: Column) -> Column:
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.concat(F.lit(f"{name}: "), clean)


def _cut(text: Column, size: int) -> Column:
    """Pieces of ``size`` code points, at least one."""
    last = F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, payload_bytes, record_id, refers_to (record id of the response; null for responses).

    Of rows with equal payloads of ``least_bytes`` or more that with the largest page_id is the response (rows that
    repeat this page_id too); the payload's SHA-1 and length stand for it. Rows equal in page_id, url and payload are
    the same record written again, and share its id.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # from the row's own values, so that any plan and any retry names a record alike
    name = F.md5(F.concat_ws(" ", F.col("digest"), F.col("url")))
    rows = rows.withColumn("record_id", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), name, F.lit(">")))
    large = rows.filter(F.col("payload_bytes") >= least_bytes)
    kept = large.groupBy("digest").agg(F.max(F.struct("page_id", "record_id")).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    kept = kept.select(fresh_key("digest").alias("digest"), F.col("k.page_id").alias("kept_id"), F.col("k.record_id").alias("kept_record"))
    joined = rows.withColumn("dup", F.when(F.col("payload_bytes") >= least_bytes, F.col("digest"))).join(kept.withColumnRenamed("digest", "dup"), "dup", "left")
    other = F.col("kept_record").isNotNull() & ~F.col("kept_id").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", "payload_bytes", "record_id", F.when(other, F.col("kept_record")).alias("refers_to"))


def records(planned: DataFrame, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """One row ``value`` for each WARC record, without the line ends that close it."""
    chunks = F.filter(_cut(F.col("payload"), chunk), lambda c: c != "")
    framed = F.concat(F.array_join(F.transform(chunks, lambda c: F.concat(F.lower(F.hex(F.octet_length(c))), F.lit(END), c, F.lit(END))), ""), F.lit(f"0{END}{END}"))
    status, kind = F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8")
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, _lines(status, kind, _field("Content-Length", F.col("payload_bytes")))).otherwise(F.concat(_lines(status, kind, F.lit("Transfer-Encoding: chunked")), framed))
    cut = planned.withColumn("block", block).withColumn("parts", _cut(F.col("block"), segment)).withColumn("total", F.octet_length("block"))
    cut = cut.drop("block", "payload").select("*", F.posexplode("parts").alias("at", "part")).withColumn("of", F.size("parts")).drop("parts")
    first, many, last = F.col("at") == 0, F.col("of") > 1, F.col("at") == F.col("of") - 1
    number = (F.col("at") + 1).cast("string")
    own = F.when(first, F.col("record_id")).otherwise(F.concat(F.regexp_replace("record_id", ">$", ""), F.lit("/"), number, F.lit(">")))
    header = _lines(
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _field("WARC-Record-ID", own),
        F.lit(f"WARC-Date: {DATE}"),
        _field("WARC-Target-URI", F.col("url")),
        F.when(first, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, _field("WARC-Refers-To", F.col("refers_to"))),
        F.when(many, _field("WARC-Segment-Number", number)),
        F.when(~first, _field("WARC-Segment-Origin-ID", F.col("record_id"))),
        F.when(many & last, _field("WARC-Segment-Total-Length", F.col("total"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        _field("Content-Length", F.octet_length("part")),
    )
    return cut.select(F.concat(header, F.col("part")).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, chunk: int = CHUNK, segment: int = SEGMENT) -> None:
    """Writes gzipped WARC files with a record for each page (and its continuations) below ``path``.

    A null html is an empty payload, a null url leaves its header out, other columns are ignored; an empty table
    writes no records. Hot payloads: their rows meet only in a join that adaptive execution can split.
    """
    rows = records(plan_records(pages, least_bytes), chunk, segment)
    rows.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


class _Stream:
    """Bytes of a file, plain or gzipped, read by line or by length."""

    def __init__(self, content: bytes):
        raw = io.BytesIO(content)
        self.file = io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)

    def headers(self) -> dict[str, str] | None:
        """Name (lower case) to value of a header block; None at the end of the file. The first line has the name ''."""
        line = self.file.readline()
        while line in (b"\r\n", b"\n"):
            line = self.file.readline()
        if not line:
            return None
        out = {"": line.decode().strip()}
        while (line := self.file.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            out[name.strip().lower()] = value.strip()
        return out


def parse_archive(content: bytes) -> Iterator[dict]:
    """The records of one archive file."""
    stream = _Stream(content)
    while (h := stream.headers()) is not None:
        if not h[""].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {h['']!r}")
        n = int(h["content-length"])
        block = stream.file.read(n)
        if len(block) != n:
            raise ValueError(f"record {h.get('warc-record-id')} ends after {len(block)} of {n} bytes")
        kind = h["warc-type"]
        total = h.get("warc-segment-total-length")
        yield {
            "origin": h["warc-segment-origin-id"] if kind == "continuation" else h["warc-record-id"],
            "segment": int(h.get("warc-segment-number", 0)),
            "total": int(total) if total else None,
            "record_type": None if kind == "continuation" else kind,
            "refers_to": h.get("warc-refers-to"),
            "digest": h.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "block": block,
        }


_RECORD = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("block", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below ``path``, one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for r in parse_archive(content.as_py()):
                    rows.append(r)
                    size += len(r["block"])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _RECORD)

    files = spark.read.format("binaryFile").load(path).select("content")
    return arrow_map(files, run, "origin string, segment int, total bigint, record_type string, refers_to string, digest string, block binary")


def reassemble(found: DataFrame) -> DataFrame:
    """One row for each original record: segments grouped by origin, in order, with ``complete`` (boolean).

    Records that are no segments pass without a shuffle. A group is as large as one page at most: a record that was
    written several times keeps each segment once, and gives as many rows as it has first segments.
    """
    whole = found.filter("segment = 0").select("origin", "record_type", "refers_to", "digest", "block", F.lit(True).alias("complete"))
    parts = found.filter("segment > 0").groupBy("origin").agg(
        F.array_distinct(F.sort_array(F.collect_set(F.struct("segment", "block")))).alias("parts"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("segment") == 1).alias("copies"),
        F.max("total").alias("total"),
        F.max("record_type").alias("record_type"),
        F.max("refers_to").alias("refers_to"),
        F.max("digest").alias("digest"),
    )
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["block"]))
    parts = parts.withColumn("block", joined).withColumn("numbers", F.transform("parts", lambda p: p["segment"]))
    in_order = F.col("numbers") == F.sequence(F.lit(1), F.size("numbers"))
    every = F.col("n") == F.col("copies") * F.size("parts")
    complete = F.coalesce(in_order & every & (F.octet_length("block") == F.col("total")), F.lit(False))
    rows = F.explode(F.sequence(F.lit(1), F.greatest(F.col("copies").cast("int"), F.lit(1)))).alias("row")
    parts = parts.select("origin", "record_type", "refers_to", "digest", "block", complete.alias("complete"), rows).drop("row")
    return whole.unionByName(parts)


def decode_chunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is shorter than its stated size")
        at = end + 4 + size


def http_payload(block: bytes) -> tuple[bytes, dict[str, str]]:
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return (decode_chunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body), fields


def read_pages(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and complete of every original record.

    For responses length and digest are those of the decoded payload, and complete is false where segments are
    missing, lengths differ or the stated digest is another; for revisits they are what the record states.
    """
    fields = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, complete boolean" + ", payload binary" * with_payload
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("complete", pa.bool_())] + [("payload", pa.binary())] * with_payload)

    def page_of(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").partition(":")[0]
        return int(number) if number else None

    def one(r: dict) -> dict:
        out = {"page_id": page_of(r["origin"]), "record_type": r["record_type"], "refers_to": page_of(r["refers_to"]), "payload": None}
        if not r["complete"]:
            return out | {"payload_bytes": None, "payload_digest": r["digest"], "complete": False}
        payload, http = http_payload(r["block"])
        if r["record_type"] == "revisit":
            return out | {"payload_bytes": int(http["content-length"]), "payload_digest": r["digest"], "complete": True}
        digest = hashlib.sha1(payload).hexdigest()
        return out | {"payload_bytes": len(payload), "payload_digest": digest, "complete": digest == r["digest"], "payload": payload}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield pa.RecordBatch.from_pylist([one(r) for r in batch.slice(at, 256).to_pylist()], schema)

    return arrow_map(reassemble(read_records(spark, path)), run, fields)
