"""WARC archives in Zstandard frames: a writer, and a reader that checks every record.

An archive begins with a skippable frame that holds its dictionary; then each record is a frame of
its own. Archives are files in the folder that the cluster shares.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import by_size, cut, shared_folder, table

#: Magic number of the skippable frame with the dictionary.
SKIPPABLE = 0x184D2A5D
#: Payloads that are shorter are stored each time.
LEAST = 100
#: Records of an archive, roughly, and the bytes after which a writer begins another.
RECORDS, ARCHIVE_BYTES = 4096, 8 << 20
#: A dictionary is trained on so many bytes of an archive's first records.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
_CRLF = b"\r\n"


def headers(version: bytes, fields: list[tuple[str, str]]) -> bytes:
    return _CRLF.join([version, *(f"{k}: {v}".encode() for k, v in fields)]) + _CRLF + _CRLF


def digest_text(digest: bytes) -> str:
    """The labelled form of WARC digests."""
    return "sha256:" + base64.b32encode(digest).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, repeats: bool) -> bytes:
    """A response record, or a revisit: the same HTTP header without the payload."""
    own = hashlib.sha256(payload).digest()
    http = headers(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if repeats else http + payload
    fields = [
        ("WARC-Type", "revisit" if repeats else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", digest_text(own)),
        ("WARC-Block-Digest", digest_text(hashlib.sha256(block).digest())),
    ]
    if url is not None:
        # Line ends would end the header.
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if repeats:
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    fields.append(("Content-Length", str(len(block))))
    return headers(b"WARC/1.1", fields) + block + _CRLF + _CRLF


def archive(records: list[bytes]) -> bytes:
    """The dictionary's skippable frame, then a frame for each record."""
    samples, size = [], 0
    for r in records:
        samples.append(r[:131072])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        data = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short records: their beginning serves as plain content
        data = b"".join(samples)[:DICTIONARY_BYTES]
    kind = zstandard.ZstdCompressionDict(data)
    packer = zstandard.ZstdCompressor(level=3, dict_data=kind, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *map(packer.compress, records)])


def _fields(lines: bytes, at: int) -> dict[str, str]:
    out = {}
    for line in lines.split(_CRLF):
        name, mark, value = line.partition(b":")
        if not mark:
            raise ValueError(f"byte {at}: no header line: {line[:80]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def _number(fields: dict[str, str], name: str, at: int) -> int:
    value = fields.get(name, "")
    if not value.isdigit():
        raise ValueError(f"byte {at}: {name} is missing or no number")
    return int(value)


def _page(value: str | None, at: int) -> int | None:
    if value is None or not (value.startswith("<urn:page:") and value.endswith(">")):
        raise ValueError(f"byte {at}: no record id: {value!r}")
    return int(value[10:-1]) if value[10:-1] else None


def parse(data: bytes, at: int = 0) -> dict:
    """One record, its headers, lengths and digests checked. ``at`` is named in errors."""
    head, mark, rest = data.partition(_CRLF + _CRLF)
    version, _, lines = head.partition(_CRLF)
    if not mark or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError(f"byte {at}: not a WARC record")
    fields = _fields(lines, at)
    length = _number(fields, "content-length", at)
    if len(rest) != length + 4 or rest[length:] != _CRLF + _CRLF:
        raise ValueError(f"byte {at}: the block has {len(rest) - 4} bytes, its header says {length}")
    block = rest[:length]
    if fields.get("warc-block-digest") != digest_text(hashlib.sha256(block).digest()):
        raise ValueError(f"byte {at}: the block's digest is wrong")
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        raise ValueError(f"byte {at}: unknown type {kind!r}")
    http, mark, payload = block.partition(_CRLF + _CRLF)
    status, _, lines = http.partition(_CRLF)
    if not mark or not status.startswith(b"HTTP/"):
        raise ValueError(f"byte {at}: no HTTP header")
    size = _number(_fields(lines, at), "content-length", at)
    own = fields.get("warc-payload-digest", "")
    if not own.startswith("sha256:"):
        raise ValueError(f"byte {at}: no payload digest")
    if kind == "response":
        if len(payload) != size or own != digest_text(hashlib.sha256(payload).digest()):
            raise ValueError(f"byte {at}: the payload is not the one announced")
    elif payload:
        raise ValueError(f"byte {at}: a revisit with a payload")
    return {
        "page_id": _page(fields.get("warc-record-id"), at),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": base64.b32decode(own[7:]).hex(),
        "refers_to": _page(fields.get("warc-refers-to"), at) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive's bytes, one frame at a time."""
    if len(data) < 8:
        raise ValueError("no archive: shorter than a frame header")
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE or len(data) < 8 + size:
        raise ValueError("no archive: it does not begin with a whole dictionary frame")
    content = data[8 : 8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content)) if content else zstandard.ZstdDecompressor()
    view, at = memoryview(data), 8 + size
    while at < len(data):
        one = reader.decompressobj()
        frame, begin = [], at
        while not one.eof:
            if at >= len(data):
                raise ValueError(f"byte {begin}: the frame is cut off")
            step = view[at : at + 65536]
            frame.append(one.decompress(step))
            at += len(step) - len(one.unused_data)
        yield parse(b"".join(frame), begin)


def _file_system(folder: str):
    from pyarrow import fs

    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    import os

    return fs.LocalFileSystem(), os.path.abspath(folder)


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row into archives in ``folder`` and return their ``path`` and ``records``.

    Of rows with equal payloads (the html in UTF-8, null as empty) of at least 100 bytes, that with
    the smallest key is a response and the others revisit it; rows that repeat its key are responses
    too, and so are rows with a null key. A task writes each archive under a name of its own, so one
    that runs again never mixes with what it left; only archives in the returned table count.
    """
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha2(F.encode("html", "UTF-8"), 256)))
    first = (
        rows.where((F.octet_length("html") >= LEAST) & F.col("page_id").isNotNull())
        .groupBy(F.col("digest").alias("same"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("same", "first_id")
    )
    rows = rows.join(by_size(cut(first)), F.col("digest") == F.col("same"), "left").select("page_id", "url", "html", "first_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        held, size = [], 0

        def write():
            name = f"{uuid.uuid4().hex}.warc.zst"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{name}") as f:
                f.write(archive(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "records"]
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page, address, text, first_id = (batch.column(c)[i].as_py() for c in range(4))
                repeats = first_id is not None and page is not None and first_id != page
                held.append(record(page, address, text.encode("utf-8", "surrogatepass"), first_id, repeats))
                size += len(held[-1])
                if len(held) >= RECORDS or size >= ARCHIVE_BYTES:
                    yield write()
                    held, size = [], 0
        if held:
            yield write()

    return cut(rows.mapInArrow(run, "path string, records long"))


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the archives in column ``path``; one that breaks the format raises with its place.

    A revisit has no payload of its own, but its payload's length and digest.
    """
    names = [f.split()[0] for f in RECORD.split(", ")]
    names = names if payload else names[:-1]
    schema = ", ".join(RECORD.split(", ")[: len(names)])
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names
            )

        for batch in batches:
            for path, records in zip(*(c.to_pylist() for c in batch.columns)):
                folder, _, name = path.rpartition("/")
                system, base = _file_system(folder)
                with system.open_input_stream(f"{base}/{name}") as f:
                    data = f.read()
                rows, n, size = [], 0, 0
                for row in read_archive(data):
                    rows.append(row)
                    n += 1
                    size += len(row["payload"] or b"") if payload else 0
                    if len(rows) >= 1000 or size >= 4 << 20:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)
                if n != records:
                    raise ValueError(f"{path} has {n} records, {records} were written")

    wide = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path", "records").repartition(wide).mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    written = write_archives(pages, shared_folder(spark, f"warc-{uuid.uuid4().hex}"))
    return read_archives(written, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLE_OP10 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest,
         strlen(coalesce(html, '')) AS payload_bytes FROM pages
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
