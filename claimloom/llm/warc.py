"""WARC archives: writing, normalising whole-file gzip streams to one member a record, and reading by offset."""

from __future__ import annotations

import gzip
import os
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm.common import fresh, local_path, table, written

LEVEL = 4
BLOCK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _opened(uri: str, mode: str) -> BinaryIO:
    """A file of any store that pyarrow reaches (file, hdfs, s3, gs); what is written lands under its name only when it is closed."""
    path = local_path(uri)
    if path is not None:
        if mode == "wb":
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return store.open_input_file(path)


def record_id(page_id: int | None, row: int) -> str:
    """The id of a page's record; the row's number keeps apart records of pages whose ids are null or repeat."""
    return f"<urn:claimloom:page:{'' if page_id is None else page_id}:{row}>"


def record(kind: str, rid: str, url: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record with its HTTP head; a revisit has no payload, but the full payload's digest and length, and its response's id."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's named fields (names in lower case), HTTP head and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    fields = {a.strip().lower(): b.strip() for a, _, b in (x.partition(":") for x in lines[1:])}
    body = rest[: int(fields["content-length"])]
    if not fields.get("content-type", "").startswith("application/http"):
        return fields, b"", body
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, http, payload


def inflated(f: BinaryIO) -> Iterator[bytes]:
    """What a gzip file holds, whatever its members, a block at a time: the file is read once."""
    z = zlib.decompressobj(31)
    while block := f.read(BLOCK):
        while block:
            yield z.decompress(block)
            block = z.unused_data
            if z.eof:
                yield z.flush()
                z = zlib.decompressobj(31)


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream; memory holds one record and a block."""
    held, searched, need = bytearray(), 0, -1
    for block in stream:
        held += block
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n", max(searched - 3, 0))
                if end < 0:
                    searched = len(held)
                    break
                fields = [x.partition(b":") for x in bytes(held[:end]).split(b"\r\n")]
                size = next(int(b) for a, _, b in fields if a.strip().lower() == b"content-length")
                need = end + 4 + size + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            searched, need = 0, -1
    if bytes(held).strip():
        raise ValueError(f"the stream ends within a record ({len(held)} bytes left)")


def normalise_file(source: str, target: str) -> Iterator[tuple[int, int, int, dict[str, str]]]:
    """Rewrites an archive with a member for each record: number, offset, length and fields of each; target is whole once exhausted."""
    at = 0
    with _opened(source, "rb") as f, _opened(target, "wb") as out:
        for n, raw in enumerate(records(inflated(f))):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            yield n, at, len(member), parsed(raw)[0]
            at += len(member)


INDEX = "archive string, sidecar string, record_no long, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string"


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The index of archives (column path: gzip of any members, such as one stream for the whole file), each rewritten in folder.

    A task inflates its archive once, as a stream, and writes every record as its own gzip member to <name>.warc.gz, and beside
    it a sidecar <name>.idx: offset, length, type, id and target of each record, with tabs. Names are new in every attempt
    of a task, and the index names those of the attempt that counted, so a lost or doubled task leaves no half archive in use.
    An archive without records gives no index rows. Files must lie where every executor reaches them.
    """

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                base, rows = f"{folder}/{uuid.uuid4().hex}", []
                with _opened(f"{base}.idx", "wb") as out:
                    for n, at, size, f in normalise_file(path, f"{base}.warc.gz"):
                        uri, kind, rid = (f.get(k, "") for k in ("warc-target-uri", "warc-type", "warc-record-id"))
                        out.write(f"{at}\t{size}\t{kind}\t{rid}\t{uri}\n".encode())
                        digest = f.get("warc-payload-digest", "").rpartition(":")[2]
                        rows.append((f"{base}.warc.gz", f"{base}.idx", n, at, size, rid, kind, uri, digest, int(f.get("warc-payload-length", -1)), f.get("warc-refers-to")))
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return archives.select("path").mapInArrow(run, INDEX)


def read_records(index: DataFrame) -> DataFrame:
    """archive, record_no, fields and payload of every index row, each record read at its offset as a member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, name = None, None
        for b in batches:
            rows = []
            for path, n, at, size in zip(*(b[k].to_pylist() for k in ("archive", "record_no", "offset", "length")), strict=True):
                if path != name:
                    if f:
                        f.close()
                    f, name = _opened(path, "rb"), path
                f.seek(at)
                fields, _, payload = parsed(gzip.decompress(f.read(size)))
                rows.append((path, n, list(fields.items()), payload))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "record_no", "fields", "payload"])
        if f:
            f.close()

    return index.select("archive", "record_no", "offset", "length").mapInArrow(run, "archive string, record_no long, fields map<string, string>, payload binary")


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, row, url, payload, payload_digest and refers_to (page_id and row): of equal payloads of at least `least` bytes the first row
    of the smallest page_id, for the others. row numbers the rows of a table as its files hold them. Only digests are grouped and
    joined; the join's skew is Spark's to split."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    own = own.withColumns({"payload_digest": F.sha2("payload", 256), "row": F.monotonically_increasing_id()})
    big = own.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    first = big.groupBy("payload_digest").agg(F.min(F.struct("page_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    out = own.join(first.where("n > 1").select("payload_digest", "keep"), "payload_digest", "left")
    return out.select("page_id", "row", "url", "payload", "payload_digest", F.when(F.col("keep.page_id") < F.col("page_id"), F.col("keep")).alias("refers_to"))


def write_archives(marked: DataFrame, folder: str, archive_bytes: int = 1 << 25, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives (path, n_records) that hold a record for each row of marked, each one gzip stream of about archive_bytes of records.

    A task streams its rows into its archives; names are new in every attempt, and only those of the attempt that counted are
    returned. The list is a table in the shared folder, so archives aren't written again when it is read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, z, size, n = [], None, None, 0, 0

        def close() -> None:
            out.write(z.flush())
            out.close()
            done.append((path, n))

        for b in batches:
            for page, row, url, payload, digest, refers in zip(*(b[k].to_pylist() for k in ("page_id", "row", "url", "payload", "payload_digest", "refers_to")), strict=True):
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    out, z, size, n = _opened(path, "wb"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                to = refers and record_id(refers["page_id"], refers["row"])
                raw = record("revisit" if to else "response", record_id(page, row), url, payload, digest, to, date)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "n_records"])

    return written(marked.mapInArrow(run, "path string, n_records long"), "warc-list")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Pages to archives, normalised and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, archive, offset.

    Each page gives a record (repeated rows too; of rows that repeat the smallest page_id all are responses). Null html is an
    empty payload, null url an empty target; a null page_id has a record and is no target of a revisit, nor is it one. Record ids differ
    even where page ids repeat or are null.
    A response's digest and length are those of the payload as read; a revisit's are its record's. An empty table gives no rows.
    Other columns are not read.
    """
    marked = revisits(pages)
    archives = write_archives(marked, f"{folder}/whole")
    tasks = max(1, archives.count())
    index = written(normalise(archives.repartition(tasks), f"{folder}/members"), "warc-index")
    read = read_records(index.repartition(tasks, "archive").sortWithinPartitions("archive", "offset"))
    field = lambda k: F.col("fields")[k]
    number = lambda k: F.regexp_extract(field(k), r"^<urn:claimloom:page:(-?\d+):\d+>$", 1).try_cast("long")
    response = field("warc-type") == "response"
    return read.select(
        number("warc-record-id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(field("warc-payload-length").cast("long")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index(field("warc-payload-digest"), ":", -1)).alias("payload_digest"),
        field("warc-type").alias("record_type"),
        number("warc-refers-to").alias("refers_to"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), fresh(spark, "warc"))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND keep < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND keep < page_id THEN keep END AS refers_to
FROM k
"""
