"""WARC archives: a gzip member per record, written once per payload, and a sequential reader.

Writing: the smallest page of a payload of LEAST_REVISIT bytes or more is found by sums over digests (no text is
gathered). One join by page_id tells every page what it refers to; it moves each page once, and its tasks write
archives of up to ARCHIVE_BYTES. An archive's name is new for each attempt of a task; the table of archives is written
when their tasks have ended, and readers take names from it alone, so that files of lost or repeated tasks are never
read.

Reading: archives are dealt to as many tasks as there are archives, whatever their size. A task inflates a file in small blocks, takes each member's header
lines, then exactly as many bytes as its content length says, holds the payload against its digest, and goes on.

Defined cases: a null payload counts as empty; a null url has no target line; of rows with the same page_id and
payload, one is the response and its repetitions are responses too; a page without an id is a response and nothing
refers to it; an empty table gives no records; other columns are ignored. page_id is an integer (long).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import work_path

LEAST_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
BLOCK = 1 << 16
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str):
    """The file system of a folder that Spark wrote to, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path)))


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One gzip member: a response, or a revisit that names the page of the same payload."""
    content = HTTP if refers_to is not None else HTTP + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(content)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(content).hexdigest()}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + content + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes below folder; returns the table of archives (path as Spark knows it, records, bytes), which is stored there too."""
    html = F.coalesce(F.col("html"), F.lit(""))
    pages = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    slim = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    later = slim.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    records = pages.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(batches):
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        out, name, n, size, closed = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, text, digest, refers_to in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = record(page_id.as_py(), url.as_py(), text.as_py().encode(), digest.as_py(), refers_to.as_py(), date)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= archive_bytes:
                    out.close()
                    closed.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            closed.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in closed], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    records.mapInArrow(run, "path string, records long, bytes long").write.parquet(f"{folder}/archives")
    return pages.sparkSession.read.schema("path string, records long, bytes long").parquet(f"{folder}/archives")


class Reader:
    """Records of a stream of gzip members, one after another; only one record is held at a time."""

    def __init__(self, stream):
        self.stream, self.data, self.inflate, self.raw = stream, bytearray(), None, b""

    def _more(self) -> bool:
        """Inflates another block of the current member; False at its end."""
        while True:
            if self.inflate.eof:
                return False
            if not self.raw:
                self.raw = self.stream.read(BLOCK)
                if not self.raw:
                    raise ValueError("the archive ends inside a record")
            got = self.inflate.decompress(self.raw, BLOCK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if got:
                self.data += got
                return True

    def _take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._more():
                raise ValueError("a record is shorter than its content length")
        out = bytes(self.data[:n])
        del self.data[:n]
        return out

    def __iter__(self):
        while True:
            self.raw = self.raw or self.stream.read(BLOCK)
            if not self.raw:
                return
            self.inflate = zlib.decompressobj(31)
            self.data.clear()
            while (end := self.data.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError("a record has no header")
            version, *lines = self._take(end + 4)[:-4].decode().split("\r\n")
            if not version.startswith("WARC/1."):
                raise ValueError(f"not a WARC record: {version[:20]!r}")
            header = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
            content = self._take(int(header["content-length"]))
            if self._take(4) != b"\r\n\r\n" or self.data or self._more():
                raise ValueError("a record is longer than its content length")
            if header["warc-block-digest"] != "sha256:" + hashlib.sha256(content).hexdigest():
                raise ValueError("a record's content has another digest")
            yield header, content


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits)."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = _file_system(path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for header, content in Reader(stream):
                        digest = header["warc-payload-digest"].removeprefix("sha256:")
                        payload = content.partition(b"\r\n\r\n")[2]
                        response = header["warc-type"] == "response"
                        if response and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError("a payload has another digest")
                        page, refers = header.get("x-page-id"), header.get("x-refers-to-page-id")
                        size = len(payload) if response else int(header["x-payload-bytes"])
                        rows.append((page and int(page), header.get("warc-target-uri"), size, digest, header["warc-type"], refers and int(refers), payload.decode() if response else None))
                        held += len(payload)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    n = max(1, archives.count())  # a number that is given: adaptive execution would merge these few small rows into one task
    return archives.select("path").repartitionByRange(n, "path").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in FIELDS))


FIELDS = (("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()), ("record_type", "string", pa.string()), ("refers_to", "long", pa.int64()), ("payload", "string", pa.string()))


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(FIELDS)], [n for n, _, _ in FIELDS])


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages below the shared folder, reads them back, and returns a row per record without its payload."""
    archives = write_archives(pages, work_path(spark, "warc"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as html from pages),
f as (select html, min(page_id) as first from p group by html)
select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest,
  case when strlen(html) >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when strlen(html) >= 100 and page_id > first then first end as refers_to
from p join f using (html)
"""
