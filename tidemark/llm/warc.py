"""WARC archives with revisit records in place of repeated payloads.

Only headers (id, payload digest, payload length) are shuffled by digest. Of the records with equal payloads
of at least ``min_bytes`` the one with the smallest id is the response and the others are revisits of it;
smaller payloads are always responses. Archives are written with fresh headers, one compressed member per
record, and rolled at ``archive_bytes``; names hold a random part and only those of tasks that committed are
listed in the manifest, so a task that is run again leaves nothing that is read.

URIs are written as they are given; one that no header line can hold (line breaks, blanks at its ends) is written with
its line breaks percent-encoded, and whole, as JSON, in a field of its own. A revisit names the response by record id,
URI and date. All records of a call have the date of that call, or the one that is given.

Null payloads are empty ones. Records that repeat the smallest id with the same payload, and null ids, are
responses; if such records differ in their URI, revisits name the smallest. An empty table gives an empty manifest.
Other columns of the input are ignored. Archives in a folder that the caller names stay there, others go with the driver.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import folder as shared_folder
from tidemark.llm.common import lean, written
from tidemark.shared import delete_at_exit

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NAMESPACE = uuid.UUID("5d0f1c1e-5a0e-4c38-9d4e-1f6f3f0a7a10")
_RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve_revisits(headers: DataFrame, min_bytes: int = 100) -> DataFrame:
    """The revisits among ``headers`` (page_id, url, payload_digest, payload_bytes): page_id, payload_digest, refers_to, refers_to_url."""
    large = headers.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "payload_digest")
    firsts = large.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("other"))
    firsts = firsts.where(F.col("other") > F.col("first.page_id")).select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_to_url"))
    return large.join(firsts, "payload_digest").where(F.col("page_id") > F.col("refers_to")).select("page_id", "payload_digest", "refers_to", "refers_to_url").distinct()


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def _header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _uri(field: str, url: str | None) -> list[tuple[str, object]]:
    if url is None:
        return []
    line = url.replace("\r", "%0D").replace("\n", "%0A")
    return [(field, line)] if line == url == url.strip() else [(field, line), (f"X-{field}-JSON", json.dumps(url))]


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_to_url: str | None, date: str) -> bytes:
    revisit = refers_to is not None
    block = HTTP_HEAD + (b"" if revisit else payload)
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)), ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", page_id))
    fields += _uri("WARC-Target-URI", url)
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", refers_to)]
        fields += _uri("WARC-Refers-To-Target-URI", refers_to_url)
    return _header(fields) + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, wbits=31)
    return z.compress(record) + z.flush()


def _writer(folder: str, archive_bytes: int, level: int, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, written_bytes, records = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "refers_to_url")]
            for i in range(batch.num_rows):
                record = _record(*(c[i].as_py() for c in columns), date)
                if out is None:
                    path, written_bytes, records = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                written_bytes += out.write(_member(record, level)) or 0
                records += 1
                if out.tell() >= archive_bytes:
                    done.append((path, out.tell(), records))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, out.tell(), records))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return run


def _qualified(spark, folder: str) -> str:
    """The folder as a URI of the file system that Spark would write it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace(":/", ":///", 1)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 100, archive_bytes: int = 64 << 20, level: int = 4, date: str | None = None) -> tuple[str, DataFrame]:
    """Write one record per row of ``pages`` (page_id, url, html); the folder's URI and the manifest (path, bytes, records)."""
    spark = pages.sparkSession
    uri = _qualified(spark, folder or shared_folder(spark, "warc"))
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    revisits = resolve_revisits(rows.select("page_id", "url", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes")), min_bytes)
    tagged = rows.join(revisits, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to", "refers_to_url")
    manifest = written(tagged.mapInArrow(lean(_writer(uri, archive_bytes, level, date)), "path string, bytes long, records long"), "warc-manifest")
    if folder is None:
        delete_at_exit(spark, uri)
    return uri, manifest


def parse_archive(stream) -> Iterator[tuple]:
    """Records of one archive, read a block at a time: page_id, url, payload (null for revisits), payload_bytes, payload_digest, type, refers_to."""
    z, raw, plain = zlib.decompressobj(wbits=31), b"", bytearray()

    def more() -> bool:
        nonlocal z, raw
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                return False
        plain.extend(z.decompress(raw))
        raw = z.unused_data
        if z.eof:
            z = zlib.decompressobj(wbits=31)
        return True

    while True:
        while (end := plain.find(b"\r\n\r\n")) < 0:
            if not more():
                if plain:
                    raise ValueError("truncated archive")
                return
        lines = bytes(plain[:end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        while len(plain) < end + 8 + size:
            if not more():
                raise ValueError("truncated archive")
        block = bytes(plain[end + 4 : end + 4 + size])
        del plain[: end + 8 + size]
        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
        payload = block[block.find(b"\r\n\r\n") + 4 :] if kind == "response" else None
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
        whole = fields.get("X-WARC-Target-URI-JSON")
        url = json.loads(whole) if whole else fields.get("WARC-Target-URI")
        number = lambda k, f=fields: int(f[k]) if k in f else None
        yield number("X-Page-Id"), url, payload, number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page")


def _reader(folder: str, payloads: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split(" ")[0] for x in _RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for record in parse_archive(stream):
                        rows.append(record if payloads else (*record[:2], None, *record[3:]))
                        held += len(rows[-1][2] or b"")
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield out()
                            rows, held = [], 0
        yield out()

    return run


def read_archives(folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the manifest's archives; payloads are checked against their digests."""
    n = max(1, min(manifest.count(), 10_000))
    return manifest.select("path").repartition(n, "path").mapInArrow(lean(_reader(folder, payloads)), _RECORDS)
