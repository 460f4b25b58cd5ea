"""WARC archives: writing records, normalising monolithic gzip files, and reading records back.

write() puts one record per page into WARC files that are gzip streams as a whole (so a reader has to inflate them from
the start). normalise() inflates such a stream once, front to back, writes every record anew as a gzip member of its own
and beside each archive a sidecar index of where each member lies. index() reads the sidecars of a folder, and read()
fetches records by them, a member at a time.
Files go to a folder that all executors reach, by a URI; each has a name of its own and appears whole (written under a
passing name, then renamed), so a task that is tried again replaces what it wrote before.

Deduplication: of records with equal payloads of at least min_bytes bytes, that with the smallest id is a response and
the others are revisits that name it and carry no payload; smaller ones are all responses.

Defined cases: a null payload counts as empty; null urls are written as empty; pages that repeat an id are told apart by
their place in the archive, and a revisit names the smallest id; null ids sort last; an empty table gives an empty
result; further columns are not stored."""

from __future__ import annotations

import base64
import io
import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sottovoce.llm.common import materialise, prepare, shared_path, skew_join, table

#: A new archive is begun once one holds so many bytes before compression.
ARCHIVE_BYTES = 64 << 20
_CHUNK = 1 << 20
#: Archives are dealt over so many tasks, at most.
MOST_TASKS = 20_000


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """pages' id, url, payload, digest, record_type and refers_to; the payload of revisits is left out, its size kept."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    digest = F.to_binary(F.sha1(payload), F.lit("hex"))
    slim = pages.select(F.col(id_col).alias("id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), digest.alias("sha1"), F.length(payload).cast("long").alias("size"))
    keys = materialise(slim.select("id", "sha1", "size"), "digests")
    first = keys.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    joined = skew_join(slim, first, "sha1", "left", counted=keys)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select("id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha1", "size", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("first"))


def _record(id_: object, url: str, payload: bytes | None, sha1: bytes, size: int, first: object) -> bytes:
    """A response or revisit record; id, size and the target of a revisit are kept in headers."""
    name = base64.b32encode(sha1).decode()
    revisit = payload is None
    body = b"" if revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{json.dumps(id_)}>", f"WARC-Target-URI: {' '.join(url.split())}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{name}", f"X-Payload-Length: {size}",
        *([f"WARC-Refers-To: <urn:page:{json.dumps(first)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _put(uri: str, attempt: str, write: Callable[[io.RawIOBase], None]) -> None:
    """Writes a file under a passing name of this attempt, then renames it."""
    fs, path = _open(uri)
    with fs.open_output_stream(f"{path}.{attempt}", compression=None) as out:
        write(out)
    fs.move(f"{path}.{attempt}", path)


def _attempt() -> tuple[int, str]:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId(), str(task.taskAttemptId())


def write(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives, each one gzip stream; returns a row per archive (uri, records)."""
    spark = pages.sparkSession
    prepare(spark)
    _make(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = _attempt()
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "url", "payload", "sha1", "size", "first")), strict=True))
        number, row, done = 0, next(rows, None), []
        while row is not None:
            uri, records = f"{folder}/part-{part:06d}-{number:04d}.warc.gz", 0

            def fill(out: io.RawIOBase) -> None:
                nonlocal row, records
                pack, held = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                while row is not None and held < archive_bytes:
                    record = _record(*row)
                    out.write(pack.compress(record))
                    held, records, row = held + len(record), records + 1, next(rows, None)
                out.write(pack.flush())

            _put(uri, attempt, fill)
            done.append((uri, records))
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["uri", "records"])

    rows = with_revisits(pages, id_col, payload_col, min_bytes)
    return materialise(rows.select("id", "url", "payload", "sha1", "size", "first").mapInArrow(run, "uri string, records long"), "archives")


def _make(folder: str) -> None:
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)


def inflated(stream: io.RawIOBase) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, a chunk at a time."""
    unpack = zlib.decompressobj(31)
    while True:
        raw = stream.read(_CHUNK)
        if not raw:
            if not unpack.eof:
                raise ValueError("the gzip stream ends early")
            return
        while raw:
            if unpack.eof:
                unpack = zlib.decompressobj(31)
            yield unpack.decompress(raw, _CHUNK)
            raw = unpack.unconsumed_tail or unpack.unused_data


class _Records:
    """Takes the records of an inflated stream apart; holds a header and a chunk at a time."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def _body(self, left: int) -> Iterator[bytes]:
        while left:
            if not self.held and not self._more():
                raise ValueError("a record ends early")
            part = bytes(self.held[:left])
            del self.held[: len(part)]
            left -= len(part)
            yield part

    def __iter__(self) -> Iterator[tuple[bytes, Iterator[bytes]]]:
        """(header, body with the blank lines after it) of each record; take the body before the next record."""
        while True:
            while (end := self.held.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    if self.held.strip():
                        raise ValueError("a record header ends early")
                    return
            head = bytes(self.held[: end + 4])
            del self.held[: end + 4]
            yield head, self._body(int(fields(head)["content-length"]) + 4)


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites archives (a row with the uri of each) into folder, every record a gzip member of its own, and beside
    each archive X the index X.idx (a JSON line per record: offset, length, type, id). Returns the index: a row per record (uri, offset, length)."""
    prepare(archives.sparkSession)
    _make(folder)
    spread = archives.select("uri").repartition(min(max(archives.count(), 1), MOST_TASKS))  # dealt in turn, so evenly

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, attempt = _attempt()
        for uri in (u for batch in batches for u in batch.column("uri").to_pylist()):
            to, index = f"{folder}/{uri.rsplit('/', 1)[-1]}", []
            fs, path = _open(uri)

            def fill(out: io.RawIOBase) -> None:
                at = 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, body in _Records(inflated(stream)):
                        pack, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                        length += out.write(pack.compress(head)) or 0
                        for part in body:
                            length += out.write(pack.compress(part)) or 0
                        length += out.write(pack.flush()) or 0
                        named = fields(head)
                        index.append((at, length, named["warc-type"], named["warc-record-id"]))
                        at += length

            _put(to, attempt, fill)
            lines = "".join(json.dumps(dict(zip(("offset", "length", "type", "id"), x, strict=True))) + "\n" for x in index)
            _put(f"{to}.idx", attempt, lambda out, lines=lines: out.write(lines.encode()))
            yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([len(index)], pa.int64())], ["uri", "records"])

    return materialise(spread.mapInArrow(run, "uri string, records long"), "normalised")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """What the sidecars of a folder say: a row per record (uri of its archive, offset, length, type, id)."""
    lines = spark.read.schema("offset long, length long, type string, id string").option("pathGlobFilter", "*.warc.gz.idx").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.idx$", 1)
    return lines.select(F.concat(F.lit(f"{folder}/"), name).alias("uri"), "offset", "length", "type", "id")


def read(places: DataFrame) -> DataFrame:
    """The records at places (rows of uri, offset, length, as index() gives them): headers parsed, payload as stored (null for revisits)."""
    prepare(places.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "record_type", "digest", "size", "refers_to", "payload"]
        held: tuple[str, object] | None = None
        for batch in batches:
            out: list[tuple] = []
            for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("uri", "offset", "length")), strict=True):
                if held is None or held[0] != uri:
                    fs, path = _open(uri)
                    held = uri, fs.open_input_file(path)
                raw = zlib.decompress(held[1].read_at(length, offset), 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                named = fields(head + b"\r\n\r\n")
                body = rest[: int(named["content-length"])]
                revisit = named["warc-type"] == "revisit"
                out.append((named["warc-record-id"], named["warc-target-uri"], named["warc-type"], named["warc-payload-digest"].removeprefix("sha1:"), int(named["x-payload-length"]), named.get("warc-refers-to"), None if revisit else body.partition(b"\r\n\r\n")[2]))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return places.select("uri", "offset", "length").mapInArrow(run, "record_id string, url string, record_type string, digest string, size long, refers_to string, payload binary")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    pages = table(spark, sf_dir, "pages")
    normalise(write(pages, f"{folder}/whole"), f"{folder}/members")
    records = read(index(spark, f"{folder}/members"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)
    stored = F.when(F.col("record_type") == "response", F.length("payload").cast("long")).otherwise(F.col("size"))
    kind = dict(pages.dtypes)["page_id"]
    return records.select(
        F.when(page("record_id") != "null", page("record_id")).cast(kind).alias("page_id"), stored.alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).cast(kind).alias("refers_to"))


def op4_sql() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS x, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
