"""WARC writing, and a normaliser for archives compressed as one gzip stream.

Pages are written as WARC 1.1 records, a file's records in one gzip stream, as some crawlers leave
them. The normaliser inflates such a file once, as a stream, writes every record as a gzip member
of its own and beside it an index of offsets, so that records can be read singly; reading goes
through the index. Files are written by tasks under names of their own attempt through Arrow's file
systems; only names that a finished task has reported are read, so a lost executor's leftovers
don't matter.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.session import materialise, scratch_path

_CHUNK = 1 << 20
_ID = "urn:x-page:"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that names the response."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Target-URI: {urllib.parse.quote(url, safe=':/?#[]@!$&()*+,;=%')}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) of a record, with its HTTP payload and the payload's declared length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    return out | {"payload": payload, "declared": int(declared[0]) if declared else len(payload)}


def inflate(stream):
    """Inflated pieces of a gzip stream of one or several members."""
    z = zlib.decompressobj(31)
    while data := stream.read(_CHUNK):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)


def records(pieces):
    """Raw records of inflated pieces; holds one record and a piece."""
    buffer = bytearray()
    need = None
    for piece in pieces:
        buffer += piece
        while True:
            if need is None:
                at = buffer.find(b"\r\n\r\n")
                if at < 0:
                    break
                sizes = [x for x in bytes(buffer[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                need = at + 4 + int(sizes[0].partition(b":")[2]) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer.strip():
        raise ValueError("the archive ends within a record")


def _write(folder: str, per_file: int):
    def run(batches):
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        sink = z = name = None
        used, done = 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if sink is None:
                    name, used = f"{uuid.uuid4().hex}.warc.gz", 0
                    sink, z = store.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"] or "", (row["html"] or "").encode(), row["digest"], row["refers_to"])
                sink.write(z.compress(raw))
                used += len(raw)
                if used >= per_file:
                    sink.write(z.flush())
                    sink.close()
                    done.append(name)
                    sink = None
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            done.append(name)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in done], pa.string())], ["path"])
    return run


def _normalise(folder: str):
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                source, at = opened(path)
                store, root = opened(folder)
                store.create_dir(root, recursive=True)
                name, offset, index = uuid.uuid4().hex, 0, []
                with source.open_input_stream(at, compression=None) as stream, store.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as sink:
                    for raw in records(inflate(stream)):
                        member = gzip.compress(raw, 6, mtime=0)
                        sink.write(member)
                        index.append(json.dumps({"offset": offset, "length": len(member)}))
                        offset += len(member)
                with store.open_output_stream(f"{root}/{name}.idx", compression=None) as sink:
                    sink.write("".join(f"{x}\n" for x in index).encode())
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"], pa.string()), pa.array([len(index)], pa.int64())], ["path", "n_records"])
    return run


def _read(batches):
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, at = opened(path)
            with store.open_input_stream(f"{at}.idx", compression=None) as f:
                index = [json.loads(x) for x in f.read().decode().splitlines()]
            with store.open_input_file(f"{at}.warc.gz") as f:
                for lo in range(0, len(index), 256):
                    rows = []
                    for x in index[lo:lo + 256]:
                        f.seek(x["offset"])
                        r = parse(gzip.decompress(f.read(x["length"])))
                        full = r["warc-type"] == "response"
                        digest = r["warc-payload-digest"].removeprefix("sha1:")
                        if full and (hashlib.sha1(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["declared"]):
                            raise ValueError(f"payload of {r['warc-record-id']} differs from its digest")
                        of = lambda k, r=r: int(r[k].strip("<>").removeprefix(_ID)) if k in r else None
                        rows.append((of("warc-record-id"), r["declared"], digest, r["warc-type"], of("warc-refers-to")))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, per_file: int = 64 << 20, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(path) of the archives written, each one gzip stream of about ``per_file`` inflated bytes.

    Null html is an empty payload, a null url an empty one. Of equal payloads of ``revisit_bytes``
    or more that with the largest page_id is the response, others revisit it; rows that repeat that
    id with that payload are responses too. Rows with a null page_id are left out; other columns
    are ignored; an empty table gives no archive.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"),
                         F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("bytes")).where("page_id is not null"))
    twins = (rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.min("page_id").alias("low"))
             .where("low < first_id").select("digest", "first_id"))
    twins, _ = materialise(twins, "warc-twins")
    if twins.count() <= broadcast_rows:
        twins = F.broadcast(twins)
    refers = F.when((F.col("bytes") >= revisit_bytes) & (F.col("first_id") != F.col("page_id")), F.col("first_id"))
    return materialise(rows.join(twins, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))
                       .mapInArrow(_write(folder, per_file), "path string"), "warc-written")[0]


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, n_records) of archives with one gzip member a record, ``path``.warc.gz, and their index ``path``.idx.

    Archives of no records give an empty file and index; a repeated path is normalised twice.
    """
    # a stated number of partitions, which Spark doesn't coalesce: the rows are tiny, their files are not
    paths = archives.select("path").where("path is not null")
    spread = paths.repartition(max(1, paths.count()), "path")
    return materialise(spread.mapInArrow(_normalise(folder), "path string, n_records long"), "warc-normalised")[0]


def read_archives(normalised: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read through the index."""
    return normalised.select("path").repartition(max(1, normalised.count()), "path").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages as archives, normalise these and read them back."""
    spark = pages.sparkSession
    written = write_archives(pages, scratch_path(spark, "warc"))
    return read_archives(normalise(written, scratch_path(spark, "warc-members")))
