"""WARC archives as seekable Zstandard bundles.

A bundle is one file: records grouped into independent Zstandard frames, and at its end
a skippable frame with the sizes of all others (the seek table of the public seekable
format). An index table maps record identifiers to a bundle, a frame, and an offset inside
the frame, so one record costs one frame. Any Zstandard reader can read the whole file.

Files are written by the tasks, under a name of their own for every attempt. The index,
written by Spark, names the files of the attempts that counted.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Staging, new_folder, written

FRAME_BYTES = 256 * 1024  # of records in a frame, at least, unless a bundle ends
BUNDLE_BYTES = 64 * 1024 * 1024  # of compressed frames after which a bundle ends
MIN_REVISIT_BYTES = 100
DATE = "2000-01-01T00:00:00Z"  # pages have no date of capture

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

# Fixed value of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "id long, record_id string, bundle string, frame int, frame_offset long, frame_bytes long, offset long, length long"
_RECORD = "id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"


# -- Records --------------------------------------------------------------------------


def record_id(ident: int | None) -> str:
    return "<urn:page:null>" if ident is None else f"<urn:page:{ident}>"


def _ident(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return None if value == "null" else int(value)


def record(ident: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP head of its payload but not the payload."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(ident)}",
        f"WARC-Date: {DATE}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$&'()*+,/:;=?@[]~%-._"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields. The digest of a response is taken from its payload and must agree
    with its header; a revisit has only its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"The payload of {fields['WARC-Record-ID']} does not have its digest.")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    return {
        "id": _ident(fields["WARC-Record-ID"]),
        "record_type": fields["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": stated,
        "refers_to": _ident(fields["WARC-Refers-To"]) if revisit else None,
        "url": fields.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
    }


# -- Bundles --------------------------------------------------------------------------


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame with (compressed, uncompressed) sizes of all frames."""
    entries = b"".join(struct.pack("<II", *sizes) for sizes in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, uncompressed) of the frames of an open file, from its end."""
    size = file.size()
    file.seek(size - FOOTER_BYTES)
    count, flags, magic = struct.unpack("<IBI", file.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("The file does not end with a seek table.")
    entry = 12 if flags & 0x80 else 8
    file.seek(size - FOOTER_BYTES - count * entry)
    table, frames, at = file.read(count * entry), [], 0
    for i in range(count):
        packed, plain = struct.unpack_from("<II", table, i * entry)
        frames.append((at, packed, plain))
        at += packed
    return frames


class BundleWriter:
    """Writes records to bundles in ``folder`` and gives index rows as frames end."""

    def __init__(self, folder: str, frame_bytes: int, bundle_bytes: int) -> None:
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.store, self.base = _opened(folder)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.out, self.frames, self.at = None, [], 0
        self.waiting, self.held = [], 0

    def add(self, ident: int | None, data: bytes) -> list[dict]:
        self.waiting.append((ident, data))
        self.held += len(data)
        return self._frame() if self.held >= self.frame_bytes else []

    def _frame(self) -> list[dict]:
        if not self.waiting:
            return []
        if self.out is None:
            self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.out, self.frames, self.at = self.store.open_output_stream(f"{self.base}/{self.name}", compression=None), [], 0
        plain = b"".join(d for _, d in self.waiting)
        packed = self.packer.compress(plain)
        self.out.write(packed)
        rows, offset = [], 0
        for ident, data in self.waiting:
            rows.append(
                {
                    "id": ident, "record_id": record_id(ident), "bundle": self.name, "frame": len(self.frames),
                    "frame_offset": self.at, "frame_bytes": len(packed), "offset": offset, "length": len(data),
                }
            )
            offset += len(data)
        self.frames.append((len(packed), len(plain)))
        self.at += len(packed)
        self.waiting, self.held = [], 0
        if self.at >= self.bundle_bytes:
            self._end()
        return rows

    def _end(self) -> None:
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
            self.out = None

    def close(self) -> list[dict]:
        rows = self._frame()
        self._end()
        return rows


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def write_archive(
    records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES
) -> DataFrame:
    """Write (id, url, payload, digest, refers_to, revisit) to bundles; returns the index.

    ``folder`` must be one that all executors see, on a file system that Arrow opens.
    A frame holds at least one whole record, so a frame can be as large as the largest
    payload; its sizes are limited to 4 GB by the format.
    """
    schema = _arrow_schema(_INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes, bundle_bytes)
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                rows += writer.add(
                    row["id"],
                    record(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["revisit"]),
                )
            yield pa.RecordBatch.from_pylist(rows, schema)
        yield pa.RecordBatch.from_pylist(writer.close(), schema)

    store, base = _opened(folder)
    store.create_dir(base, recursive=True)
    columns = records.select("id", "url", "payload", "digest", "refers_to", "revisit")
    return written(columns.mapInArrow(run, _INDEX), "warc-index", f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that the rows of ``index`` name: id, record_type, payload_bytes,
    payload_digest, refers_to, url, payload (null for a revisit).

    Each frame is fetched by its offset and unpacked once; what lies in other frames is
    not read. ``index`` may be any selection of an archive's index.
    """
    schema = _arrow_schema(_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _opened(folder)
        name, file, unpacker = None, None, zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if file is not None:
                        file.close()
                    name, file = row["bundle"], store.open_input_file(f"{base}/{row['bundle']}")
                file.seek(row["frame_offset"])
                plain = unpacker.decompress(file.read(row["frame_bytes"]))
                found = [parse_record(plain[o : o + n]) for o, n in zip(row["offsets"], row["lengths"])]
                yield pa.RecordBatch.from_pylist(found, schema)
        if file is not None:
            file.close()

    frames = (
        index.groupBy("bundle", "frame", "frame_offset", "frame_bytes")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
        .select("bundle", "frame_offset", "frame_bytes", F.col("places.offset").alias("offsets"), F.col("places.length").alias("lengths"))
    )  # a frame's records at most
    return frames.mapInArrow(run, _RECORD)


def scan_bundle(path: str) -> Iterator[dict]:
    """All records of one bundle, by its seek table alone: for archives without an index."""
    store, base = _opened(path)
    unpacker = zstandard.ZstdDecompressor()
    with store.open_input_file(base) as file:
        for offset, packed, _ in read_seek_table(file):
            file.seek(offset)
            plain, at = unpacker.decompress(file.read(packed)), 0
            while at < len(plain):
                head = plain.index(b"\r\n\r\n", at) + 4
                size = int(plain[at:head].lower().rsplit(b"content-length: ", 1)[1].split(b"\r\n")[0])
                yield parse_record(plain[at : head + size + 4])
                at = head + size + 4


# -- Pages ----------------------------------------------------------------------------


def page_records(
    pages: DataFrame,
    stage: Staging,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Rows to write: of equal payloads of enough bytes, all but that of the smallest id
    are revisits.

    SHA-256 stands for a payload; null counts as empty. Only digests are shuffled to find
    the repeated ones, and the html only to meet those. Rows with the same payload and the
    smallest id are all responses, and so are all rows of a payload that has only null ids.
    """
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").alias("url"),
        F.encode(html, "UTF-8").alias("payload"),
        F.sha2(html, 256).alias("digest"),
    )
    first = stage.write(
        rows.where(F.length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first_id"),
        "repeated",
    )
    joined = rows.join(first, "digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "id", "url", "payload", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to")
    )


def archive_pages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **sizes: int
) -> DataFrame:
    """Write ``pages`` as an archive below ``folder`` and return its index.

    Every row becomes a record, with a null id, url or html too. Other columns are not
    read. An empty table gives an empty index and no bundle.
    """
    with Staging(pages.sparkSession, "warc") as stage:
        return write_archive(page_records(pages, stage, id_col, url_col, html_col), folder, **sizes)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to bundles, and what the bundles say of them."""
    folder = new_folder(spark, "warc")
    index = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP1_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
