"""Operator 1: write and read WARC archives.

One gzip member a record. The writer names, for each payload digest, the
record that is stored in full; the others are ``revisit`` records that
refer to it. The reader is sequential: it inflates a member piece by piece,
frames the record by its Content-Length and checks both digests.

Archives lie in a shared folder; tasks open them through ``pyarrow.fs``
(file, hdfs, s3 and other schemes). A retried writer task uses new file
names, and only files in the manifest, which Spark commits, are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.scratch import Scratch, text_or_empty

MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, payload binary, status string")
ID_PREFIX, CHUNK = "urn:page:", 1 << 20
CRLF2 = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<{ID_PREFIX}{'null' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    m = re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, is_revisit: bool,
                  refers_to: int | None, date: str) -> bytes:
    """One record as one gzip member. A revisit holds the HTTP header alone."""
    digest = base32_sha1(payload)
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_uri(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}",
             f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = "\r\n".join(head).encode() + CRLF2 + block + CRLF2
    return deflate.compress(raw) + deflate.flush()


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The gzip members of a byte stream, each as an iterator of inflated pieces.

    A member must be used up before the next is taken. Raises ``EOFError``
    inside a member that the stream cuts off, ``zlib.error`` on bad data.
    """
    source, left = iter(chunks), b""

    def pieces(first: bytes) -> Iterator[bytes]:
        nonlocal left
        inflate, data = zlib.decompressobj(31), first
        while True:
            piece = inflate.decompress(data, CHUNK)
            if piece:
                yield piece
            if inflate.eof:
                left = inflate.unused_data
                return
            data = inflate.unconsumed_tail
            if not data:
                data = next(source, b"")
                if not data:
                    raise EOFError("the archive ends inside a record")

    while True:
        while not left:
            left = next(source, None)
            if left is None:
                return
        first, left = left, b""
        yield pieces(first)


def decode_record(pieces: Iterable[bytes], with_payload: bool = True) -> dict:
    """Frame one record by its Content-Length and verify its digests.

    ``status`` is ``ok`` or what is wrong with the record. A payload that is
    not wanted is hashed piece by piece and never held.
    """
    source, buf = iter(pieces), bytearray()

    def until_blank() -> bytes:
        nonlocal buf
        while (at := buf.find(CRLF2)) < 0:
            buf += next(source)
        head, buf = bytes(buf[:at]), buf[at + 4:]
        return head

    out = {"page_id": None, "url": None, "record_type": None, "refers_to": None, "payload_bytes": None,
           "payload_digest": None, "payload": None}
    try:
        lines = until_blank().decode("utf-8", "replace").split("\r\n")
    except StopIteration:
        return out | {"status": "no header"}
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out["record_type"], out["page_id"] = head.get("warc-type"), _page_id(head.get("warc-record-id"))
    out["refers_to"] = _page_id(head.get("warc-refers-to"))
    if "warc-target-uri" in head:
        out["url"] = re.sub(r"(?:%[0-9A-F]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"),
                            head["warc-target-uri"])
    out["payload_digest"] = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if not lines[0].startswith("WARC/") or not head.get("content-length", "").isdigit():
        return out | {"status": "bad header"}
    remaining = int(head["content-length"])
    block, payload, kept, n_payload, http = hashlib.sha1(), hashlib.sha1(), bytearray(), 0, None
    http_buf = bytearray()
    while remaining:
        if not buf:
            try:
                buf += next(source)
            except StopIteration:
                return out | {"status": "short block"}
        part, buf = bytes(buf[:remaining]), buf[remaining:]
        remaining -= len(part)
        block.update(part)
        if http is None:
            http_buf += part
            at = http_buf.find(CRLF2)
            if at < 0:
                continue
            http, part = bytes(http_buf[:at]), bytes(http_buf[at + 4:])
        payload.update(part)
        n_payload += len(part)
        if with_payload:
            kept += part
    for piece in source:
        buf += piece
    if bytes(buf) != CRLF2:
        return out | {"status": "bad end"}
    if head.get("warc-block-digest") != "sha1:" + base64.b32encode(block.digest()).decode():
        return out | {"status": "bad block digest"}
    stated = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http or b"")
    if out["record_type"] == "revisit":
        out["payload_bytes"] = int(stated[1]) if stated else None
        return out | {"status": "ok" if stated and not n_payload else "bad revisit"}
    out["payload_bytes"] = n_payload
    if out["payload_digest"] != base64.b32encode(payload.digest()).decode():
        return out | {"status": "bad payload digest"}
    if with_payload:
        out["payload"] = bytes(kept)
    return out | {"status": "ok"}


def plan_records(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, first_id, is_revisit``: which record of equal payloads is stored.

    Among payloads of at least ``min_bytes`` bytes the smallest page_id is
    the response. Smallest ids are partially aggregated, so a payload shared
    by a third of all pages is one row a task there; they are a written
    table, so that adaptive execution can split such a payload in the join.
    Null html is an empty payload. Rows that repeat the smallest page_id
    are all responses. A null page_id revisits unless all of its equals are
    null.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(text_or_empty("html"), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    first = scratch.save(rows.groupBy("sha").agg(F.min("page_id").alias("first_id")), "first")
    revisit = (F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "sha").select("page_id", "url", "payload", "first_id", revisit.alias("is_revisit"))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 64 << 20,
                   date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (of :func:`plan_records`) below ``folder``; returns the lazy manifest.

    Each task writes its own archives and starts a new one at
    ``roll_bytes``. Save the manifest: running it again writes new files.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "is_revisit", "first_id")]
            for i in range(batch.num_rows):
                page_id, url, payload, is_revisit, first = (c[i].as_py() for c in cols)
                data = encode_record(page_id, url, payload, is_revisit, first, date)
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", n, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], names=["path", "n_records", "n_bytes"])

    return records.mapInArrow(write, MANIFEST)


def read_archives(paths: DataFrame, with_payload: bool = True, batch_bytes: int = 16 << 20) -> DataFrame:
    """Every record of the archives named in ``paths.path``, in :data:`RECORDS` form.

    A record that cannot be framed or verified has a ``status`` other than
    ``ok``; after a cut-off or corrupt member the rest of that archive is
    one such row, as no later member can be found. Null paths are skipped.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[f.split()[1]] for f in RECORDS.split(", ")]

        def table(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                if path is None:
                    continue
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inner, compression=None) as f:
                    records = members(iter(lambda f=f: f.read(CHUNK), b""))
                    while True:
                        try:
                            pieces = next(records, None)
                            if pieces is None:
                                break
                            row = decode_record(pieces, with_payload)
                            for _ in pieces:  # to the member's end, if framing stopped early
                                pass
                        except (EOFError, zlib.error) as e:
                            rows.append(dict.fromkeys(names) | {"status": f"broken member: {e}"})
                            break
                        rows.append(row)
                        held += len(row["payload"] or b"") + 200
                        if held >= batch_bytes:
                            yield table(rows)
                            rows, held = [], 0
        if rows:
            yield table(rows)

    return paths.select("path").mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write all pages to archives in the shared folder, then read every archive back.

    An empty table writes no archive and reads no record.
    """
    manifest = scratch.save(write_archives(plan_records(pages, scratch, min_bytes), scratch.path("warc")), "manifest")
    n = max(1, manifest.count())
    return read_archives(manifest.repartition(n), with_payload)
