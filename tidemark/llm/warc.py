"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records to be
archived and embedded in a leading skippable frame of every file; each record
is one frame of its own, so any record can be read alone.  Tasks stream their
partition into files in the shared folder (through pyarrow's file systems, so
the folder may be on HDFS or in an object store) and return a manifest; files
of failed attempts are in no manifest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, hot_keys, spread_join, stored, texts

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Bounds of the dictionary's sample: records with the smallest id hashes, and pieces of them, by hash over their whole length.
SAMPLE_RECORDS, SAMPLE_PIECES, PIECE_BYTES = 400, 512, 16 << 10
#: A task begins a new file beyond this size.
FILE_BYTES = 256 << 20
LEVEL = 3
BATCH_ROWS = 256
_CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
_DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    revisit = refers_to is not None
    http = _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode(),
        f"WARC-Date: {_DATE}".encode(),
        b"WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A").encode("utf-8", "surrogatepass"),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        b"X-Payload-Length: %d" % len(payload),
    ]
    if revisit:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return _CRLF.join(head) + _CRLF + _CRLF + block + _CRLF + _CRLF


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload text, refers_to): which pages are revisits, and of which page.

    Of equal payloads of at least ``min_bytes`` bytes the largest page_id is the
    response.  Repeated rows of that page_id are all responses.
    """
    source = texts(pages, "page_id", "url", text="html").withColumn("key", F.sha1(F.col("text").cast("binary")))
    long = F.octet_length("text") >= min_bytes
    # Decided on ids and digests alone; the texts meet only one row of their key, those of a hot one dealt over tasks.
    again = stored(source.where(long).groupBy("key").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    joined = spread_join(source.withColumn("_row", F.xxhash64("page_id", "url")), again.select("key", "first"), "key", hot_keys(again, "key", "copies"), "_row", "left")
    refers = F.when(long & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "text", refers.alias("refers_to"))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records of the ``SAMPLE_RECORDS`` pages with the smallest id hashes.

    Long records are cut into pieces; all are used, or those with the smallest
    hashes where there are more than ``SAMPLE_PIECES``.  Too few or too small
    records to train on become a raw-content dictionary.
    """
    import zstandard

    source = texts(pages, "page_id", "url", text="html")
    picked = source.select("page_id", F.xxhash64("page_id").alias("h")).distinct().orderBy("h", "page_id").limit(SAMPLE_RECORDS).select(F.col("page_id").alias("id"))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length("text") - 1, F.lit(0)) / PIECE_BYTES).cast("int"))
    whole = source.join(F.broadcast(picked), F.col("page_id").eqNullSafe(F.col("id"))).select("page_id", "url", F.col("text").cast("binary").alias("data"), F.explode(starts).alias("k"))
    pieces = whole.select("page_id", "url", "k", F.substring("data", F.col("k") * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("b")).distinct()
    rows = pieces.orderBy(F.xxhash64("page_id", "k", "b"), "page_id", "k").limit(SAMPLE_PIECES).toArrow().to_pylist()
    samples = [record_bytes(r["page_id"], r["url"], r["b"], payload_digest(r["b"]), None) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or record_bytes(0, "", b"", payload_digest(b""), None))[-DICTIONARY_BYTES:]


def write_archives(plan: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write (page_id, url, text, refers_to) rows; the manifest (path, records, bytes)."""

    def run(batches):
        import zstandard

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        out, path, records, size, number = None, "", 0, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
                    out, number, records = store.open_output_stream(path, compression=None), number + 1, 0
                    info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
                    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (str(uuid.uuid5(uuid.NAMESPACE_URL, path)).encode(), _DATE.encode(), len(info), info)
                    size = out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary) + out.write(press.compress(info))
                payload = row["text"].encode("utf-8", "surrogatepass")
                size += out.write(press.compress(record_bytes(row["page_id"], row["url"], payload, payload_digest(payload), row["refers_to"])))
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}])
                    out = None
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records, "bytes": size}])

    return stored(plan.select("page_id", "url", "text", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "manifest")


def iter_records(stream):
    """(headers, block) of each record of an open archive, reading frame by frame."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(bytes(stream.read(size)))
    reader = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True), 1 << 18)
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := reader.readline().rstrip(_CRLF)) != b"":
            name, _, value = line.partition(b": ")
            headers[name.decode().lower()] = value.decode("utf-8", "surrogatepass")
        block = reader.read(int(headers["content-length"]))
        if reader.read(4) != _CRLF + _CRLF:
            raise ValueError("a record is cut short")
        yield headers, block


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def read_archives(manifest: DataFrame, folder: str, with_html: bool = True) -> DataFrame:
    """The records of archives, one row each; ``html`` is null for revisits.

    A response's payload is held against its digest and length.
    """
    n = max(1, manifest.count())

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for headers, block in iter_records(stream):
                        if headers["warc-type"] == "warcinfo":
                            continue
                        size, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                        payload = None
                        if headers["warc-type"] == "response":
                            payload = block[block.index(_CRLF + _CRLF) + 4 :]
                            if len(payload) != size or payload_digest(payload) != digest:
                                raise ValueError(f"a payload of {path} differs from its digest")
                        html = payload.decode("utf-8", "replace") if with_html and payload is not None else None
                        rows.append((number(headers["warc-record-id"]), headers["warc-target-uri"], size, digest, headers["warc-type"], number(headers["warc-refers-to"]) if "warc-refers-to" in headers else None, html))
                        if len(rows) >= BATCH_ROWS:
                            yield _batch(rows, names)
                            rows = []
                if rows:
                    yield _batch(rows, names)

    return manifest.select("path").repartition(n).mapInArrow(run, RECORDS)


_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, with_html: bool = True) -> DataFrame:
    """Write ``pages`` to archives and read them back.

    One record per row, repeated rows and null ids included; a null html is an
    empty payload; an empty table makes no archive; other columns are ignored.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(planned(pages, min_bytes), folder, train_dictionary(pages))
    return read_archives(manifest, folder, with_html)
