"""WARC archives: a deduplicating writer and a splittable reader.

The writer makes one gzip member per record. Of records with equal payloads of
at least ``min_revisit`` bytes, that with the smallest identifier is a
response; the others are revisits that carry its identifier and no payload.

The reader plans byte ranges from the archives' lengths alone. A task scans its
range for gzip magic, validates a candidate by decoding it as far as a WARC
version line, and owns the records that start inside the range, reading past
its end to finish the last. Ranges need no index and no knowledge of each
other.

No record is lost in silence. Between the first record of a range and its end
members must follow one another without a gap; a member that opens as a record
and cannot be decoded to its end is damaged; and an archive must yield as many
records as the manifest says. Each of these fails the read by the archive's name.

Archives are reached by URI through Arrow's file systems, in the shared folder.
A writer task's file counts only if the task's manifest row does, so retried
tasks leave no duplicates.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import new_path, table

MAGIC = b"\x1f\x8b\x08"
SALTS = 64
CHUNK = 1 << 18
ARCHIVE = 256 << 20
#: Tasks over which byte ranges are dealt, at most.
TASKS = 50_000


class DamagedArchive(ValueError):
    """An archive does not hold the records that it should."""


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit: int) -> DataFrame:
    """id, url, payload (binary), digest, n_bytes, refers_to (null: a response).

    The smallest identifier of a digest is found in two levels and returned by
    the same way, so that a payload that a third of the rows share is spread
    over ``SALTS`` groups in both directions.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "n_bytes": F.octet_length("payload").cast("long"), "salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})
    low = table(rows.groupBy("digest", "salt").agg(F.min("id").alias("low"), F.sum("n_bytes").alias("volume")), "payloads", pages.count())
    # Archives of about ARCHIVE bytes of payload, or as many as there are cores.
    volume = low.agg(F.coalesce(F.sum("volume"), F.lit(0))).first()[0]
    files = max(pages.sparkSession.sparkContext.defaultParallelism, -(-int(volume) // ARCHIVE))
    first = low.join(low.groupBy("digest").agg(F.min("low").alias("first")), "digest").select("digest", "salt", "first")
    again = (F.col("n_bytes") >= min_revisit) & (F.col("id").isNull() | (F.col("id") != F.col("first")))
    out = rows.join(first, ["digest", "salt"]).select("id", "url", "payload", "digest", "n_bytes", F.when(again, F.col("first")).alias("refers_to"))
    return out.coalesce(files)


def record(key: str, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """The bytes of one record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{key}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_bytes}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = 100) -> DataFrame:
    """Writes a record for each row of ``pages``; returns the manifest: path, n_bytes, n_records.

    Null payloads are empty. A null identifier is written as ``null`` and is
    never the smallest; where all are null each record is a response. Rows
    that repeat in identifier and payload are each written alike. A very long
    payload is held whole by its task. An empty table gives an empty manifest.
    Other columns, whatever their names, are not read.
    """
    spark = pages.sparkSession
    where = new_path(spark, "warc")
    rows = with_revisits(pages, id_col, url_col, html_col, min_revisit)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rows = rows.select(text("id").alias("id"), "url", "payload", "digest", "n_bytes", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = None
        n = 0
        for b in batches:
            if out is None and len(b):
                store, folder = fs.FileSystem.from_uri(where)
                store.create_dir(folder, recursive=True)
                path = f"/{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(folder + path, compression=None)
            for key, url, payload, digest, size, refers in b.itertuples(index=False):
                out.write(member(record(key, url if isinstance(url, str) else None, bytes(payload), digest, size, refers if isinstance(refers, str) else None)))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pd.DataFrame({"path": [where + path], "n_bytes": [size], "n_records": [n]})

    return table(rows.mapInPandas(write, "path string, n_bytes long, n_records long"), "manifest")


def members(read, start: int, end: int, size: int, name: str = "archive", strict: bool = True) -> Iterator[bytes]:
    """Contents of the gzip members that begin in [start, end) and open with a WARC version line.

    ``read(at, n)`` gives bytes of the file. What only looks like a member, by
    its magic, fails to decode before a version line or opens otherwise, and is
    skipped by one byte. With ``strict`` a member that fails after its version
    line, and bytes between members that are none, raise :class:`DamagedArchive`;
    without it they are skipped too.
    """
    at, follows = start, start == 0
    while at < end:
        buf = read(at, min(CHUNK, end - at) + len(MAGIC) - 1)
        k = buf.find(MAGIC)
        if strict and follows and k != 0:
            raise DamagedArchive(f"{name}: no record at byte {at}")
        if k < 0:
            at += max(1, len(buf) - len(MAGIC) + 1)
            continue
        at += k
        if at >= end:
            return
        d, parts, pos, got, opened = zlib.decompressobj(31), [], at, 0, False
        try:
            while not d.eof and pos < size:
                data = read(pos, CHUNK)
                pos += len(data)
                parts.append(d.decompress(data))
                got += len(parts[-1])
                if got >= 5 and not opened:
                    if (parts[0] if len(parts[0]) >= 5 else b"".join(parts))[:5] != b"WARC/":
                        raise zlib.error("no WARC version line")
                    opened = True
            if not d.eof or got < 5:
                raise zlib.error("cut short")
        except zlib.error as e:
            if strict and (opened or follows):
                raise DamagedArchive(f"{name}: record at byte {at}: {e}") from e
            at += 1
            continue
        yield b"".join(parts)
        at, follows = pos - len(d.unused_data), True


def parse(data: bytes) -> dict:
    """A record's fields; the digest of a response's payload is computed, not believed."""
    head, _, rest = data.partition(b"\r\n\r\n")
    names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    urn = lambda x: x[len("<urn:x-page:") : -1] if x else None
    out = {"id": urn(names["WARC-Record-ID"]), "url": names.get("WARC-Target-URI"), "record_type": names["WARC-Type"], "refers_to": urn(names.get("WARC-Refers-To"))}
    if out["record_type"] == "response":
        return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
    return out | {"payload": None, "payload_bytes": int(names["X-Payload-Length"]), "payload_digest": names["WARC-Payload-Digest"].removeprefix("sha256:")}


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """The records of the archives in ``manifest`` (path, n_bytes, n_records): page_id, url, record_type,
    payload_bytes, payload_digest, refers_to and, if asked for, payload (null for revisits).

    Records are written to the shared folder and counted; an archive with others
    than ``n_records`` raises :class:`DamagedArchive`. Rows that repeat were
    written as often and are read as often. An empty manifest gives an empty
    result. A very long payload is held whole by the task that owns its record.
    Other columns of the manifest are not read.
    """
    ranges = manifest.where("n_bytes > 0").select("path", "n_bytes", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = min(TASKS, max(1, ranges.count()))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if with_payload else [])]
        for b in batches:
            for path, size, start in b.itertuples(index=False):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for data in members(lambda at, k, f=f: f.read_at(k, at), start, min(start + split_bytes, size), size, path):
                        rows.append(parse(data) | {"path": path})
                        held += len(data) if with_payload else 512
                        if held > 1 << 24:
                            yield pd.DataFrame(rows)[columns]
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows)[columns]

    schema = "path string, id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string" + ", payload binary" * with_payload
    out = table(ranges.repartition(n, "path", "start").mapInPandas(scan, schema), "records")
    found = out.groupBy("path").agg(F.count(F.lit(1)).alias("found"))
    short = manifest.join(found, "path", "left").where(F.coalesce("found", F.lit(0)) != F.col("n_records")).select("path", "found", "n_records").take(5)
    if short:
        raise DamagedArchive("; ".join(f"{r.path}: {r.found or 0} of {r.n_records} records" for r in short))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast("long")
    return out.select(number("id").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), *(["payload"] if with_payload else []))
