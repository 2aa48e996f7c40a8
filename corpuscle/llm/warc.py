"""Legacy ARC archives converted to WARC, and WARC archives read back.

The converter reads an ARC file's version block, which names the fields of the record lines
that follow (version 1 has five, version 2 ten); each record line declares the length of its
content.  From these it synthesises what WARC wants: a record id from URL, date, page and
digest (repeated records are numbered), an ISO timestamp from the 14 digits, the record type, and block and payload digests.
Equal payloads are written once, as a response; the others become revisits that name it.

Records are uncompressed inside; Spark's own writer puts them into files (gzip as a whole),
so lost executors leave no half file.  Null html is an empty payload, null URLs and ids stay
null, repeated rows are records each (those with the response's own id are responses too),
an empty table gives no files and no rows; other columns, whatever their names, are left aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuscle.llm.support import bounded_batches, new_path

#: The record line of each version of the ARC format.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
END = b"\r\n\r\n"
FILE_BYTES = 8 << 20
DATE = "20240101000000"
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class Record(NamedTuple):
    """A record of an ARC file: the fields of its line and its content."""

    fields: dict[str, str]
    content: bytes


def arc_bytes(records: list[tuple[str | None, bytes]], version: int = 1, date: str = DATE, ip: str = "0.0.0.0") -> bytes:
    """An ARC file of the given version with one HTTP response for each (url, html)."""
    fields = ARC_FIELDS[version]
    head = f"{version} 0 corpuscle\n{' '.join(fields)}\n\n".encode()

    def line(url: str, kind: str, content: bytes) -> bytes:
        values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": "-", "Archive-length": str(len(content))}
        return " ".join(values[f] for f in fields).encode() + b"\n"

    out = [line("filedesc://pages.arc", "text/plain", head), head]
    for url, html in records:
        content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html) + html
        out += [b"\n", line(plain_url(url), "text/html", content), content]
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[Record]:
    """The records of an ARC file after its version block, by declared lengths."""
    end = data.index(b"\n")
    first = data[:end].split(b" ")
    if not first[0].startswith(b"filedesc://"):
        raise ValueError("no version block")
    at, size = end + 1, int(first[-1])
    block = data[at : at + size].split(b"\n")
    version, fields = int(block[0].split(b" ")[0]), tuple(block[1].decode().split(" "))
    if fields != ARC_FIELDS.get(version):
        raise ValueError(f"version {version} with fields {fields}")
    at += size
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if len(values) != len(fields):
            raise ValueError(f"a record line has {len(values)} of {len(fields)} fields")
        named = dict(zip(fields, values))
        at = end + 1 + int(named["Archive-length"])
        if at > len(data):
            raise ValueError("a record ends after its file")
        yield Record(named, data[end + 1 : at])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def http_payload(content: bytes) -> bytes:
    head, found, body = content.partition(b"\r\n\r\n")
    return body if found and head.startswith(b"HTTP/") else content


def record_id(url: str, date: str, page: int | None, digest: str, nth: int = 0) -> str:
    """The id of a record's ``nth`` copy with the same URL, date, page and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page} {digest} {nth}')}>"


def plain_url(url: str | None) -> str:
    """A URL as a record line has it: no white space, and a dash for none."""
    return re.sub(r"\s", "%20", url or "") or "-"


def warc_record(record: Record, page: int | None, refers_to: int | None, nth: int = 0, refers_url: str | None = None) -> bytes:
    """The WARC record, without its two closing line ends, of an ARC record; a revisit names the response's page and URL."""
    f, payload = record.fields, http_payload(record.content)
    digest, d = base32_sha1(payload), f["Archive-date"].ljust(14, "0")
    revisit = refers_to is not None
    block = record.content[: len(record.content) - len(payload)] if revisit else record.content
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(f['URL'], d, page, digest, nth)}",
        f"WARC-Target-URI: {f['URL']}",
        f"WARC-Date: {d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        f"WARC-IP-Address: {f['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
        *([] if page is None else [f"X-Page-Id: {page}"]),
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(plain_url(refers_url), d, refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + END + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of every record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(END, at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not at the start of a record")
        head = dict(line.split(": ", 1) for line in lines)
        at = end + len(END) + int(head["Content-Length"])
        block = data[end + len(END) : at]
        if data[at : at + len(END)] != END:
            raise ValueError("a record doesn't end where it declares")
        at += len(END)
        yield head, block


def with_response(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html (bytes), nth (of repeated rows), refers_to and refers_url: of equal payloads of at least ``least`` bytes, the response.

    Which page is the response is found on digests; payloads move once, by their page and url,
    so a payload that many pages share is no key of theirs.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("html"))
    keyed = rows.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    # One key that is never null: the join and the numbering share its only shuffle of payloads.
    keyed = keyed.withColumn("row", F.unhex(F.sha2(F.to_json(F.struct("page_id", "url", "digest", "size")), 256)))
    each = keyed.select("row", "page_id", "url", "digest", "size").groupBy("row", "page_id", "url", "digest", "size").agg(F.count("*").alias("n"))
    twice = each.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("response"), F.sum("n").alias("n")).where("n > 1 and response.page_id is not null")
    other = each.join(twice.select("digest", "size", "response"), ["digest", "size"]).where(~F.col("response.page_id").eqNullSafe(F.col("page_id"))).select("row", "response")
    joined = keyed.select("row", "page_id", "url", "html").join(other.hint("merge"), "row", "left")
    nth = F.row_number().over(Window.partitionBy("row").orderBy("row")) - 1
    return joined.select("page_id", "url", "html", nth.alias("nth"), F.col("response.page_id").alias("refers_to"), F.col("response.url").alias("refers_url"))


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write every page as a WARC record under ``path``, by way of ARC files of both versions."""
    bounded_batches(pages.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, urls, html, nth, refers, refers_urls = (batch.column(i).to_pylist() for i in range(6))
            for version in ARC_FIELDS:  # a page's version goes by its place: both are exercised
                mine = range(version - 1, len(ids), len(ARC_FIELDS))
                arc = arc_bytes([(urls[i], html[i]) for i in mine], version)
                for i, record in zip(mine, arc_records(arc)):
                    held.append(warc_record(record, ids[i], refers[i], nth[i], refers_urls[i]))
                    size += len(held[-1]) + len(END)
                    if size >= FILE_BYTES:
                        yield pa.record_batch({"value": pa.array([END.join(held)], pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.record_batch({"value": pa.array([END.join(held)], pa.binary())})

    files = with_response(pages, least).mapInArrow(convert, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", END.decode()).option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url, warc_date, refers_to_id.

    The digests of blocks, and of payloads that are there, are checked.
    """
    bounded_batches(spark)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string, refers_to_id string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for h, block in warc_records(zlib.decompress(data.as_py(), 47)):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or h["WARC-Type"] == "response" and digest != base32_sha1(http_payload(block)):
                        raise ValueError(f"{h['WARC-Record-ID']} doesn't have its digest")
                    page, refers = h.get("X-Page-Id"), h.get("X-Refers-To-Page")
                    rows.append((page and int(page), int(h["X-Payload-Length"]), digest, h["WARC-Type"], refers and int(refers), h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"], h.get("WARC-Refers-To")))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "url", "warc_date", "refers_to_id")
                yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(read, schema)


def convert_arc(files: DataFrame) -> DataFrame:
    """ARC files (``content``, as Spark's binaryFile gives it) to WARC records: value, record_id, url."""
    bounded_batches(files.sparkSession)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                seen: Counter = Counter()
                for record in arc_records(data.as_py()):
                    same = (record.fields["URL"], record.fields["Archive-date"], hashlib.sha1(record.content).digest())
                    out = warc_record(record, None, None, seen[same])
                    seen[same] += 1
                    head = dict(line.split(": ", 1) for line in out[: out.index(END)].decode().split("\r\n")[1:])
                    yield pa.record_batch({"value": pa.array([out + END], pa.binary()), "record_id": pa.array([head["WARC-Record-ID"]]), "url": pa.array([record.fields["URL"]])})

    return files.select("content").mapInArrow(convert, "value binary, record_id string, url string")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives in the shared folder and read them back."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path)
