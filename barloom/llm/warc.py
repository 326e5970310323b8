"""WARC archives as a chunked record table.

An archive is a table of rows (archive, record, chunk_no, last, bytes,
running_sha1): the chunks of an archive in order of record and chunk are a
WARC/1.1 file. Chunk 0 starts with the record's header, each chunk holds at most
``CHUNK`` bytes of payload and the SHA-1 of all payload up to its end, so writer
and reader hold a few chunks at a time and check every one.

Pages with equal payloads: the largest page_id holds the response, the others
are revisit records that refer to it and have no payload of their own.

Defined results: a null html is an empty payload, empty payloads are equal; a
null page_id is a record of its own and never the response of others; repeated
ids give repeated records, each by its own payload. An empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.storage import rewritten, small_batches

CHUNK = 1 << 20
SCHEMA = "archive string, record long, chunk_no int, last boolean, bytes binary, running_sha1 binary"
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, ok boolean"


def _header(kind: str, page: int | None, url: str | None, length: int, sha1: str, refers: int | None) -> bytes:
    """Line breaks in a URL would end its header line, so they are percent-encoded."""
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Target-URI: {target}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {length}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {length if refers is None else 0}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["archive", "record", "chunk_no", "last", "bytes", "running_sha1"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    rows, held = [], 0
    for batch in batches:
        for archive, record, page, url, html, sha1, refers in zip(*(batch.column(i) for i in range(7)), strict=True):
            payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
            refers = refers.as_py()
            piece = _header("response" if refers is None else "revisit", page.as_py(), url.as_py(), len(payload), sha1.as_py(), refers)
            stored = len(payload) if refers is None else 0
            sha, number, done = hashlib.sha1(), 0, 0
            while True:
                part = payload[done : min(stored, done + CHUNK)]
                sha.update(part)
                done += len(part)
                last = done >= stored
                rows.append((archive.as_py(), record.as_py(), number, last, b"".join((piece, part, b"\r\n\r\n" if last else b"")), sha.digest()))
                held += len(piece) + len(part)
                number, piece = number + 1, b""
                if held >= 4 * CHUNK:
                    yield _batch(rows, names, kinds)
                    rows, held = [], 0
                if last:
                    break
    if rows:
        yield _batch(rows, names, kinds)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records whose chunks come in order; ``ok``: length and every running digest agree with the bytes."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "ok"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    fields: dict[str, str] = {}
    sha, got, ok = hashlib.sha1(), 0, True
    for batch in batches:
        out = []
        rows = (batch.column(k) for k in ("chunk_no", "last", "bytes", "running_sha1"))
        for number, last, piece, running in zip(*rows, strict=True):
            data, start = memoryview(piece.as_buffer()), 0
            if number.as_py() == 0:
                start = bytes(data).index(b"\r\n\r\n") + 4
                fields = dict(x.split(": ", 1) for x in bytes(data[: start - 4]).decode().split("\r\n")[1:])
                sha, got, ok = hashlib.sha1(), 0, True
            body = data[start : len(data) - 4 * last.as_py()]
            sha.update(body)
            got += len(body)
            ok = ok and running.as_py() == sha.digest()
            if last.as_py():
                said, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                own = base64.b32encode(sha.digest()).decode() if kind == "response" else said
                whole = got == int(fields["Content-Length"])
                page, refers = (_id(fields.get(k, "")) for k in ("WARC-Record-ID", "WARC-Refers-To"))
                out.append((page, int(fields["X-Payload-Length"]), own, kind, refers, ok and whole and own == said))
        yield _batch(out, names, kinds)


def _id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def archive_table(pages: DataFrame, least: int = 0) -> DataFrame:
    """The chunk rows of ``pages`` (page_id, url, html); payloads under ``least`` bytes are never revisits."""
    small_batches(pages.sparkSession)
    html = F.encode("html", "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(F.coalesce(html, F.lit(b""))).alias("hexed"))
    light = rows.filter(F.coalesce(F.length("html"), F.lit(0)) >= least).select("page_id", "hexed")
    first = light.groupBy("hexed").agg(F.max("page_id").alias("response"))
    revisits = light.join(first, "hexed").filter("page_id < response").distinct()
    ready = rows.join(revisits, ["page_id", "hexed"], "left").select(
        F.format_string("part-%05d.warc", F.spark_partition_id()).alias("archive"),
        F.monotonically_increasing_id().alias("record"),
        "page_id",
        "url",
        "html",
        _base32(F.col("hexed")).alias("sha1"),
        "response",
    )
    return ready.mapInArrow(_write, SCHEMA)


def _base32(hexed):
    """Base32 of a column of 40 hexadecimal digits: 5 bits a letter, 32 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    out = [F.substring(F.lit(letters), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)]
    return F.concat(*out)


def read_archives(table: DataFrame) -> DataFrame:
    """A row of FIELDS for each record. Only records of several chunks are shuffled, to bring their chunks in order."""
    single = F.col("last") & (F.col("chunk_no") == 0)
    parted = table.filter(~single).repartition("record").sortWithinPartitions("record", "chunk_no")
    return table.filter(single).mapInArrow(_read, FIELDS).unionByName(parted.mapInArrow(_read, FIELDS))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(rewritten(archive_table(pages), "warc"))
    return records.filter(F.expr("assert_true(ok, 'a payload differs from its digest') IS NULL")).drop("ok")


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, max(page_id) AS response FROM p GROUP BY h),
d AS (SELECT page_id, h, response,
             list_transform(range(0, 160, 5), lambda b: list_sum(list_transform(range(0, 5), lambda k:
               (CASE WHEN (CAST(('0x' || substr(sha1(h), CAST((b + k) // 4 AS INT) + 1, 1)) AS INT) >> (3 - ((b + k) % 4)::INT)) & 1 = 1
                THEN 1 << (4 - k)::INT ELSE 0 END)))) AS v
      FROM p JOIN m USING (h))
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to
FROM d
"""
