"""Legacy archive converter: ARC files in, WARC files out, both read back by declared lengths.

ARC has two header forms.  Version 1 lines name URL, address, date, type and length; version 2
lines add result code, checksum, location, offset and file name.  The version block at the head
of each file says which form follows.  Every record is found by the length its header declares,
never by looking for a delimiter, so payloads may hold anything.

For each ARC record an equivalent WARC record is made: the identifier is a version 8 UUID that
holds the page id and bits of the payload digest (the same for every run, so a rerun task writes
the same record), the date is rewritten to ISO form, the type is ``response`` or ``revisit``, and
payload digests are SHA-1.  Of equal payloads of at least ``min_revisit`` bytes one record is a
response and the others revisit it.

A task cuts its records into archives, bounded in records and in bytes before compression, and
Spark's text writer puts each into a file of its own in the shared folder; readers hold one
archive as it lies there and one record.  Payloads move once, to meet their digest's keeper, in a
join that adaptive execution can split when one payload is very frequent.

Defined edge cases: null html is an empty payload; a null URL is written as ``-``; rows with a
null or repeated page id each get a record (rows that share the largest id of their payload are
responses alike); a text longer than the bound of an archive, up to the 2 GB of a Spark value,
gets an archive of its own and is never cut; extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.sources.shared import shared_folder

VERSION_LINES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
DATE = "20240101000000"
#: Bytes of an archive before compression: what a task holds of its output.
MAX_BYTES = 32 << 20
_RECORD = "page_id long, url string, date string, mime string, http binary, payload binary"


def arc_line(version: int, url: str, date: str, mime: str, block: bytes, name: str = "-") -> bytes:
    """The header line of one ARC record, without its line end."""
    if version == 1:
        fields = [url, "0.0.0.0", date, mime, str(len(block))]
    else:
        fields = [url, "0.0.0.0", date, mime, "200", hashlib.md5(block).hexdigest(), "-", "0", name, str(len(block))]
    return " ".join(fields).encode()


def arc_head(version: int, date: str = DATE) -> bytes:
    """The version block that starts an ARC file."""
    reserved = b"1 0 -" if version == 1 else b"2 0 -"
    block = reserved + b"\n" + VERSION_LINES[version] + b"\n"
    return arc_line(version, "filedesc://archive.arc", date, "text/plain", block) + b"\n" + block


def arc_records(stream: BinaryIO) -> Iterator[tuple[str, str, str, bytes]]:
    """(url, date, type, block) of each record of an ARC stream, either version."""
    version = 1
    while line := stream.readline():
        if line == b"\n":
            continue
        fields = line.rstrip(b"\n").decode("utf-8", "replace").split(" ")
        if len(fields) not in (5, 10):
            raise ValueError(f"an ARC header has {len(fields)} fields: {line[:200]!r}")
        block = _take(stream, int(fields[-1]))
        if fields[0].startswith("filedesc:"):
            version = int(block.split(b" ", 1)[0])
            continue
        if len(fields) != (5 if version == 1 else 10):
            raise ValueError(f"an ARC header does not fit version {version}: {line[:200]!r}")
        yield fields[0], fields[2], fields[3], block


def _take(stream: BinaryIO, size: int) -> bytes:
    block = stream.read(size)
    if len(block) != size:
        raise ValueError(f"a record of {size} bytes is cut short after {len(block)}")
    return block


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if page_id is not None:
        head += f"X-Page-Id: {page_id}\r\n"
    return f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def http_split(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, body, and headers by lower-case name."""
    head, _, body = block.partition(b"\r\n\r\n")
    named = dict(
        (k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])
    )
    return head + b"\r\n\r\n", body, named


def record_id(page_id: int | None, sha1: bytes) -> str:
    """Version 8 UUID: the page id in its first 64 free bits, 58 bits of the digest after it."""
    bits = ((page_id or 0) % 2**64) << 58 | int.from_bytes(sha1[:8], "big") >> 6
    a, b, c = bits >> 74, bits >> 62 & 0xFFF, bits & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=a << 80 | 8 << 76 | b << 64 | 2 << 62 | c)}>"


def page_of(urn: str) -> int:
    """The page id that ``record_id`` put into an identifier."""
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    bits = (n >> 80) << 74 | (n >> 64 & 0xFFF) << 62 | n & (2**62 - 1)
    page = bits >> 58
    return page - 2**64 if page >= 2**63 else page


def base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def warc_record(page_id, url, date, http: bytes, payload: bytes, keeper: int | None) -> bytes:
    """One WARC/1.1 record with its closing blank lines but the last line feed.

    ``keeper`` is the page whose response a revisit refers to; None makes a response.  A revisit
    keeps the HTTP head, whose Content-Length still tells the size of the payload.
    """
    sha1 = hashlib.sha1(payload).digest()
    block = http if keeper is not None else http + payload
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, sha1)}",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {iso}",
        f"WARC-Payload-Digest: {base32(sha1)}",
        f"WARC-Block-Digest: {base32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
    ]
    if keeper is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(keeper, sha1)}",
        ]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each WARC record, by declared lengths."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:200]!r}")
        named = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            named[name.strip().lower()] = value.strip()
        block = _take(stream, int(named["content-length"]))
        _take(stream, 4)
        yield named, block


def _open(content: bytes) -> BinaryIO:
    """A stream over an archive, unzipped as it is read, so that one record is held at a time."""
    stream = io.BytesIO(content)
    return gzip.GzipFile(fileobj=stream) if content[:2] == b"\x1f\x8b" else stream


class _Archives:
    """Cuts the records of a task into archives of at most ``per_file`` records and ``max_bytes``.

    Only a record that is larger by itself makes a larger archive.
    """

    def __init__(self, per_file: int, max_bytes: int, head: bytes = b""):
        self.per_file, self.max_bytes, self.head = per_file, max_bytes, head
        self.records, self.size = [], 0

    def add(self, record: bytes) -> Iterator[pd.DataFrame]:
        """The archive that ``record`` no longer fits into, if there is one."""
        if self.records and (len(self.records) >= self.per_file or self.size + len(record) > self.max_bytes):
            yield from self.rest()
        self.records.append(record)
        self.size += len(record)

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.records:
            whole = b"\n".join([self.head] * bool(self.head) + self.records)
            self.records, self.size = [], 0
            yield pd.DataFrame({"value": [whole]})


def _write(archives: DataFrame, tag: str) -> str:
    """Archives, one a row, as files; each ends with its writer's line feed."""
    path = f"{shared_folder(archives.sparkSession)}-{tag}"
    text = archives.select(F.col("value").cast("string"))
    out = text.write.option("compression", "gzip").option("maxRecordsPerFile", 1)
    out.option("zlib.compress.level", "FOUR").text(path)  # a third of the default level's time for 4 % more bytes
    return path


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _drop(spark, path: str) -> None:
    """Delete archives that no later step reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def write_arc(pages: DataFrame, per_file: int = 4096, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", max_bytes: int = MAX_BYTES) -> str:
    """Pages as ARC archives, half of the tasks in either version; returns their folder.

    Each archive starts with its own version block.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        archives = _Archives(per_file, max_bytes, arc_head(version))
        for batch in batches:
            for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                block = http_block(None if pd.isna(page) else int(page), (html or "").encode("utf-8", "surrogatepass"))
                where = re.sub(r"\s", "%20", url or "-")
                yield from archives.add(arc_line(version, where, DATE, "text/html", block) + b"\n" + block)
        yield from archives.rest()

    chosen = pages.select(
        F.col(id_col).cast("decimal(20,0)").cast("string").alias("page_id"),
        F.col(url_col).alias("url"), F.col(html_col).alias("html"),
    )
    return _write(chosen.mapInPandas(task, "value binary"), "arc")


def read_arc(spark, path: str) -> DataFrame:
    """Records of ARC archives with their payload digest."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for url, date, mime, block in arc_records(_open(content)):
                    head, body, named = http_split(block)
                    page = named.get("x-page-id")
                    rows.append((page and int(page), url, date, mime, head, body, hashlib.sha1(body).digest()))
                    if len(rows) == 256:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    def _frame(rows):
        names = ["page_id", "url", "date", "mime", "http", "payload", "sha1"]
        frame = pd.DataFrame(rows, columns=names)
        return frame.assign(page_id=pd.array(frame["page_id"], dtype="Int64"))

    return _files(spark, path).mapInPandas(task, _RECORD + ", sha1 binary")


def convert(spark, arc: str, per_file: int = 4096, min_revisit: int = 1000, max_bytes: int = MAX_BYTES) -> str:
    """ARC archives to WARC archives; returns their folder."""
    records = read_arc(spark, arc)
    keepers = (
        records.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("sha1", F.octet_length("payload").alias("size"))
        .agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("keep"))
        .filter("n > 1")
        .select(F.col("sha1").alias("k_sha1"), "size", F.col("keep.page_id").alias("keeper"),
                F.col("keep.url").alias("keep_url"))
    )
    joined = records.join(
        keepers, (F.col("sha1") == F.col("k_sha1")) & (F.octet_length("payload") == F.col("size")), "left"
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archives = _Archives(per_file, max_bytes)
        for batch in batches:
            for r in batch.itertuples(index=False):
                page = None if pd.isna(r.page_id) else int(r.page_id)
                keeper = None if pd.isna(r.keeper) else int(r.keeper)
                own = keeper is None or keeper == page
                yield from archives.add(warc_record(page, r.url, r.date, r.http, r.payload, None if own else keeper))
        yield from archives.rest()

    picked = joined.select("page_id", "url", "date", "http", "payload", "keeper")
    picked = picked.withColumn("page_id", F.col("page_id").cast("string")).withColumn(
        "keeper", F.col("keeper").cast("string")
    )
    return _write(picked.mapInPandas(task, "value binary"), "warc")


def read_warc(spark, path: str, with_payload: bool = False) -> DataFrame:
    """Records of WARC archives: headers, digests (checked for responses) and payload size."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for named, block in warc_records(_open(content)):
                    _, body, http = http_split(block)
                    sha1 = base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:"))
                    kind = named["warc-type"]
                    if kind == "response" and hashlib.sha1(body).digest() != sha1:
                        raise ValueError(f"{named['warc-record-id']}: the payload does not have its digest")
                    page, to = http.get("x-page-id"), named.get("warc-refers-to")
                    rows.append((
                        page and int(page), named["warc-record-id"], named["warc-target-uri"], named["warc-date"],
                        kind, int(http["content-length"]), sha1.hex(), to and page_of(to),
                        body if with_payload else None,
                    ))
                    if len(rows) == 256:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    def _frame(rows):
        names = ["page_id", "record_id", "url", "date", "record_type", "payload_bytes", "payload_digest", "refers_to",
                 "payload"]
        frame = pd.DataFrame(rows, columns=names)
        return frame.assign(
            page_id=pd.array(frame["page_id"], dtype="Int64"), refers_to=pd.array(frame["refers_to"], dtype="Int64")
        )

    return _files(spark, path).mapInPandas(
        task,
        "page_id long, record_id string, url string, date string, record_type string, payload_bytes long, "
        "payload_digest string, refers_to long, payload binary",
    )


def archive(pages: DataFrame, per_file: int = 4096, min_revisit: int = 1000, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC records read back; the ARC files go once converted."""
    spark = pages.sparkSession
    arc = write_arc(pages, per_file, max_bytes=max_bytes)
    converted = convert(spark, arc, per_file, min_revisit, max_bytes)
    _drop(spark, arc)
    return read_warc(spark, converted)
