"""WARC archives: capture as monolithic gzip, normalisation to one member a
record with a sidecar offset index, and reading back by offset.

A capture file is one gzip stream over all its records, as naive crawlers write
them: nothing in it can be found without inflating from the start. The
normaliser inflates such a stream once, front to back, parses each record as
its bytes arrive, turns records whose payload another record already holds into
revisits, writes every record as its own gzip member, and lists page, offset,
length and digest in a sidecar index; a reader then seeks to any record.

Which record is the response is decided on digests alone: a map-side minimum
per digest, and only repeated digests travel back to the archives they are in,
salted, so no payload is ever shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import blocks
from .files import new_file, read_at
from .storage import fresh_dir, lean, release, written

ARCHIVE_BYTES, READ, SALTS = 32 << 20, 1 << 20, 16
_EPOCH = "1970-01-01T00:00:00Z"  # captures carry no time; a fixed one keeps files reproducible
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(value: str | None) -> str:
    """A header value stays on its line."""
    return " ".join((value or "").split())


def record(page_id: int | None, uri: str | None, payload: bytes, digest: str, size: int, original: int | None = None, revisit: bool = False) -> bytes:
    """One WARC record; the block is an HTTP response, without its body if a
    revisit (identical payload digest profile), with the full Content-Length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{digest}')}>", f"WARC-Date: {_EPOCH}", f"WARC-Target-URI: {_field(uri)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{original}|{digest}')}>", f"X-Refers-To-Page-ID: {'' if original is None else original}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def headers_of(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8").split("\r\n")[1:])}


class Records:
    """Parses records from chunks of an inflated stream, holding one at a time."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is not None:
            self.held += chunk
        return chunk is not None

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        at = 0
        while True:
            looked = at
            while (end := self.held.find(b"\r\n\r\n", looked)) < 0:
                looked = max(at, len(self.held) - 3)
                if not self._more():
                    if self.held[at:].strip():
                        raise ValueError("the archive ends within a record's headers")
                    return
            headers = headers_of(bytes(self.held[at:end]))
            stop = end + 4 + int(headers["content-length"])
            while len(self.held) < stop + 4:
                if not self._more():
                    raise ValueError("the archive ends within a record")
            yield headers, bytes(self.held[end + 4 : stop])
            at = stop + 4
            if at > 4 * READ:
                del self.held[:at]
                at = 0


def inflated(uri: str) -> Iterator[bytes]:
    """The whole file's bytes, each gzip member or the single stream, inflated once."""
    source, left = read_at(uri), b""
    stream = zlib.decompressobj(31)
    while raw := left or source.read(READ):
        left = b""
        yield stream.decompress(raw, 8 * READ)
        while stream.unconsumed_tail:
            yield stream.decompress(stream.unconsumed_tail, 8 * READ)
        if stream.eof:
            left, stream = stream.unused_data, zlib.decompressobj(31)
    source.close()


def capture(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> DataFrame:
    """Writes every page as a response record into monolithic gzip archives.

    Returns, from a table in the shared folder: page_id, archive, nth (place in
    it), bytes, digest. A task writes about ``ARCHIVE_BYTES`` of payload to a
    file, whole records only.
    """
    spark = pages.sparkSession
    lean(spark)
    folder = folder or fresh_dir(spark, "warc-capture")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = uri = packer = None
        nth = held = 0
        for block in blocks(batches, "html"):
            out: list[tuple] = []
            for page, url, html in zip(*(c.to_pylist() for c in (block.column(0), block.column(1), block.column(2).cast(pa.binary()))), strict=True):
                if sink is None:
                    uri, sink = new_file(folder, f"capture-{TaskContext.get().partitionId():06d}", ".warc.gz")
                    packer, nth, held = zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                payload = html or b""
                digest = digest_of(payload)
                sink.write(packer.compress(record(page, url, payload, digest, len(payload))))
                out.append((page, uri, nth, len(payload), digest))
                nth, held = nth + 1, held + len(payload) + 400
                if held >= ARCHIVE_BYTES:
                    sink.write(packer.flush())
                    sink.close()
                    sink = None
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip((("page_id", pa.int64()), ("archive", pa.string()), ("nth", pa.int64()), ("bytes", pa.int64()), ("digest", pa.string())), zip(*out, strict=True), strict=True)})
        if sink is not None:
            sink.write(packer.flush())
            sink.close()

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return written(rows.mapInArrow(run, "page_id long, archive string, nth long, bytes long, digest string"), "warc-captured")


def normalise(captured: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Rewrites each archive: one member a record, repeats as revisits, and a
    sidecar index beside it.

    Of records with equal payloads of at least ``min_bytes``, that with the
    smallest (page_id, archive, nth), null ids first, stays the response.
    Returns archive, index (URIs) and records of each normalised file.
    """
    spark = captured.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    place = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("p"), "archive", "nth")
    counted = captured.filter(F.col("bytes") >= min_bytes)
    first = counted.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # a digest may hold a third of all rows: salted on both sides, and only rows of ids travel
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = counted.withColumn("salt", F.pmod("nth", F.lit(SALTS)).cast("int")).join(first, ["digest", "salt"]).filter(place != F.col("first"))
    again = again.select(F.col("archive").alias("home"), F.col("nth").alias("place"), F.col("first.p").alias("original"))
    archives = captured.groupBy("archive").agg(F.count("*").alias("records"))
    # an archive is much work from one small row, which adaptive coalescing can't see
    archives = archives.repartition(max(spark.sparkContext.defaultParallelism, archives.count()), "archive")

    def run(table_: pa.Table, revisits: pa.Table) -> pa.Table:
        if not table_.num_rows:
            return empty
        original = dict(zip(revisits.column("place").to_pylist(), revisits.column("original").to_pylist(), strict=True))
        uri, out = new_file(folder, "archive", ".warc.gz")
        index_uri, index = new_file(folder, "archive", ".cdxj")
        at = n = 0
        for n, (head, block) in enumerate(Records(inflated(table_.column("archive")[0].as_py())), 1):
            page = int(head["x-page-id"]) if head["x-page-id"] else None
            digest = head["warc-payload-digest"].removeprefix("sha1:")
            http, _, payload = block.partition(b"\r\n\r\n")
            source = original.get(n - 1)
            revisit = source is not None
            source = None if source == -(1 << 63) else source
            raw = record(page, head["warc-target-uri"], payload, digest, len(payload), source, revisit)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(raw) + packer.flush()
            out.write(member)
            entry = {"page_id": page, "offset": at, "length": len(member), "digest": digest, "type": "revisit" if revisit else "response"}
            index.write(json.dumps(entry).encode() + b"\n")
            at += len(member)
        out.close()
        index.close()
        if n != table_.column("records")[0].as_py():
            raise ValueError("the archive has lost records")
        return pa.table({"archive": [uri], "index": [index_uri], "records": pa.array([n], pa.int64())})

    empty = pa.table({"archive": pa.array([], pa.string()), "index": pa.array([], pa.string()), "records": pa.array([], pa.int64())})
    # the decisions of one archive are bounded by its records
    done = archives.groupBy("archive").cogroup(again.groupBy("home")).applyInArrow(run, "archive string, index string, records long")
    done = written(done, "warc-normalised")
    release(spark)
    return done


def read_record(archive: str, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of the member at an index entry."""
    with read_at(archive) as f:
        f.seek(offset)
        return _parsed(f.read(length))


def _parsed(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, block = next(iter(Records(iter([raw]))))
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, headers_of(http), payload


def read_archives(normalised: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Every record, by seeking to its index entry: page_id, uri, payload_bytes
    and payload_digest (both of the full payload), record_type, refers_to,
    archive, offset, length and, if ``keep_payload``, payload (null for
    revisits). Responses whose payload does not have its digest raise."""
    names = ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset", "length", "payload"][: 10 if keep_payload else 9]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with read_at(archive) as members, read_at(index) as lines:
                    out, held = [], 0
                    for line in io.BufferedReader(lines):
                        entry = json.loads(line)
                        members.seek(entry["offset"])
                        head, http, payload = _parsed(members.read(entry["length"]))
                        kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and digest_of(payload) != digest:
                            raise ValueError(f"{archive} at {entry['offset']}: the payload is damaged")
                        source = head.get("x-refers-to-page-id")
                        row = (int(head["x-page-id"]) if head["x-page-id"] else None, head["warc-target-uri"] or None, int(http["content-length"]), digest, kind, int(source) if source else None, archive, entry["offset"], entry["length"], payload if kind == "response" else None)
                        out.append(row[: len(names)])
                        held += 300 + len(payload) * keep_payload
                        if held > 4 << 20:
                            yield _batch(out)
                            out, held = [], 0
                    if out:
                        yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=False)], names)

    schema = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long" + ", payload binary" * keep_payload
    n = max(normalised.sparkSession.sparkContext.defaultParallelism, normalised.count())
    return normalised.select("archive", "index").repartition(n, "archive").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Capture, normalisation and reading back of every row; see ``read_archives``.

    A null html is an empty payload; a null url an empty target; null page ids
    are kept and sort first (a revisit of one has a null refers_to). Rows of
    equal id are separate records. An empty table gives no rows.
    """
    return read_archives(normalise(capture(pages, **columns), min_bytes), keep_payload=False)
