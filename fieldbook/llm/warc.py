"""WARC archives: written with one gzip member for each record, read back record by record.

Of pages with equal payloads (by SHA-256; the SHA-1 that records carry can be made to collide) the one with the largest ``page_id`` is written as a response
and the others as revisits that refer to it. Which is which is found on digests alone, so a payload that many pages
share gathers nowhere.

Writing: each task writes files of bounded size under names of its own attempt, and the manifest, a table that Spark
commits, lists only the files of attempts that counted. Reading: files are dealt to tasks; each is read as a stream,
decompressed bit by bit, framed by Content-Length, and every digest is verified. One record is in memory at a time.

Null payloads count as empty, null urls as ``about:blank``. Pages with a null ``page_id`` are always responses and read back
as null. Repeated rows with the largest id are all responses. An empty table gives no archives and an empty result.
Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_BYTES = 256 << 20
CHUNK = 1 << 18
URN = "urn:fieldbook:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_store(path: str):
    """File system and path for a folder that all machines share, by its scheme (local, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_member(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    payload = (html or "").encode()
    url = "".join((url or "about:blank").split())
    name = f"<{URN}{page_id}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind, extra, block = "response", [], http + payload
    if refers_to is not None:
        kind, extra, block = "revisit", [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")], http
    return member(
        [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url),
         ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
         ("WARC-Block-Digest", f"sha1:{digest(block)}"), *extra], block,
    )


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``refers_to``, null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("d"))
    narrow = keyed.select("page_id", "d")
    groups = narrow.groupBy("d").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.select(F.col("d").alias("gd"), "refers_to")
    again = narrow.join(groups.hint("merge"), F.col("d") == F.col("gd")).where("page_id < refers_to")
    again = again.select(F.col("page_id").alias("rp"), "gd", "refers_to").distinct()
    met = keyed.join(again.hint("merge"), (F.col("page_id") == F.col("rp")) & (F.col("d") == F.col("gd")), "left")
    return met.select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, path: str) -> None:
    """Write ``path/files/*.warc.gz`` and ``path/manifest``."""
    store, root = open_store(f"{path}/files")
    store.create_dir(root, recursive=True)
    target = f"{path}/files"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_store(target)
        stem = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, name, size, records, done = None, "", 0, 0, []
        for b in batches:
            for r in b.itertuples(index=False):
                if out is None:
                    name = f"{stem}-{len(done):04d}.warc.gz"
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size, records = out.write(info), 0
                none = lambda x: None if pd.isna(x) else int(x)
                size += out.write(page_member(none(r.page_id), r.url, r.html, none(r.refers_to)))
                records += 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pd.DataFrame(done, columns=["file", "records"])

    rows = with_references(pages).withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    rows.mapInPandas(run, "file string, records long").write.parquet(f"{path}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open archive; at most one record is held."""
    raw = stream.read(CHUNK)
    while raw:
        z, held = zlib.decompressobj(31), bytearray()
        headers: dict[str, str] = {}
        while not z.eof:
            if not raw and not (raw := stream.read(CHUNK)):
                raise ValueError("the archive ends inside a record")
            held += z.decompress(raw)
            raw = b""
        raw = z.unused_data or stream.read(CHUNK)
        at = held.find(b"\r\n\r\n")
        version, *lines = held[:at].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"not a record: {version[:40]}")
        for line in lines:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        if held[at + 4 + n :] != b"\r\n\r\n":
            raise ValueError("Content-Length doesn't frame the record")
        yield headers, bytes(held[at + 4 : at + 4 + n])


def page_of(uri: str) -> int | None:
    text = uri.strip("<>").removeprefix(URN)
    return None if text == "None" else int(text)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each page record, with all digests verified."""
    source = f"{path}/files"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = open_store(source)
        for b in batches:
            for name, expected in zip(b["file"], b["records"]):
                rows = []
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for h, block in records(stream):
                        if h["warc-type"] == "warcinfo":
                            continue
                        if h["warc-block-digest"] != f"sha1:{digest(block)}":
                            raise ValueError(f"{name}: block digest differs")
                        head, _, payload = block.partition(b"\r\n\r\n")
                        size = int(head.rpartition(b"Content-Length: ")[2])
                        stated = h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and (len(payload) != size or digest(payload) != stated):
                            raise ValueError(f"{name}: payload digest differs")
                        to = page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None
                        rows.append((page_of(h["warc-record-id"]), size, stated, h["warc-type"], to))
                if len(rows) != expected:
                    raise ValueError(f"{name}: {len(rows)} of {expected} records")
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    files = spark.read.schema("file string, records long").parquet(f"{path}/manifest")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, RECORDS)
