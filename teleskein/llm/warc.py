"""WARC: archives of pages, and a normaliser of archives that are one gzip stream.

``write_archives`` writes records in partitions, each task to files of its own, every file as
one gzip stream over all its records (the form that cannot be read at an offset).
``normalise`` inflates each file once, front to back, cuts it into records as they come,
writes every record as its own gzip member and an index beside the file: a line a record with
offset, length, type, id and digest. ``read_records`` opens members at their offsets.

Names of files carry a random part and reach the next step only through the rows of tasks that
ended, so a repeated or lost task leaves nothing that is read. Files are ``ARCHIVE_BYTES`` of
records each; a task holds one record and the inflater's window.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes``, that with the
smallest id is a response, others revisit it. Which payloads occur again is an aggregate over
digests; payloads meet it by a broadcast join up to a counted size, else a salted one.

Defined cases: a null payload is empty, a null URL is written as about:blank, line breaks in a
URL are percent-encoded; rows that repeat the smallest id of their payload are all responses;
responses of one page id share its record id, all other record ids differ; a null id is never
referred to and, where no row of its payload has an id, a response; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from teleskein.llm.common import join_small, row_batches, stored
from teleskein.session import scratch_dir
from teleskein.sources.paths import resolve

ARCHIVE_BYTES = 128_000_000
LEVEL = 3
READ = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"

MANIFEST = "path string, records long"
INDEX = "path string, offset long, length long, record_type string, record_id string, payload_digest string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. A revisit has the head of the exchange but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
    block = http if revisit else http + payload
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")
    # What others refer to is named by its page alone; revisits and rows without id are told apart.
    name = f"<urn:page:{page_id}:{uuid.uuid4().hex}>" if revisit or page_id is None else f"<urn:page:{page_id}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + END + block + END


def head_of(text: bytes) -> dict[str, str]:
    """The named fields of a record, names in lower case."""
    fields = (line.partition(":") for line in text.decode("utf-8").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def records_in(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and bytes of each record of a stream that arrives in pieces."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (end := held.find(END, at)) >= 0:
            head = head_of(bytes(held[at:end]))
            stop = end + len(END) + int(head["content-length"]) + len(END)
            if stop > len(held):
                break
            yield head, bytes(held[at:stop])
            at = stop
        del held[:at]
    if held:
        raise ValueError(f"archive ends inside a record, {len(held)} bytes left")


def inflated(stream, read: int = READ) -> Iterator[bytes]:
    """A gzip file of one or more members, inflated as it is read; never more than a few
    megabytes at once, however well it packs."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(read):
        while data:
            piece = unpack.decompress(data, 4 * read)
            if piece:
                yield piece
            data = unpack.unconsumed_tail
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
    if rest := unpack.flush():
        yield rest


def judged(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and first: the smallest id of an equal payload, null where the
    payload does not occur again or is too short."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("key", F.struct(F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size")))
    again = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = again.filter((F.col("n") > 1) & (F.col("key")["size"] >= min_bytes)).select("key", "first")
    return join_small(rows, stored(again, "warc-again"), "key", "left").drop("key")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each page; path and records of every file, in a written table."""

    def run(batches):
        stream, pack, size, records, path = None, None, 0, 0, None

        def closed():
            stream.write(pack.flush())
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], names=["path", "records"])

        for batch in row_batches(batches):
            for page, url, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first")), strict=True):
                if stream is None:
                    path, size, records = f"{folder}/whole-{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, own = resolve(path)
                    stream, pack = fs.open_output_stream(own, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(page, url, payload, base32_sha1(payload), first, first is not None and page != first)
                stream.write(pack.compress(data))
                size, records = size + len(data), records + 1
                if size >= archive_bytes:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    made = judged(pages, min_bytes).select("page_id", "url", "payload", "first")
    return stored(made.mapInArrow(run, MANIFEST), "warc-manifest")


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Each file of ``manifest`` rewritten with a member for each record and an index beside
    it; the rows of all indexes, in a written table."""

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path, offset, rows = f"{folder}/members-{uuid.uuid4().hex}.warc.gz", 0, []
                fs, own = resolve(source)
                to, target = resolve(path)
                with fs.open_input_stream(own, compression=None) as read, to.open_output_stream(target, compression=None) as write, to.open_output_stream(f"{target}.idx", compression=None) as side:
                    for head, data in records_in(inflated(read)):
                        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = pack.compress(data) + pack.flush()
                        write.write(member)
                        row = (path, offset, len(member), head["warc-type"], head["warc-record-id"], head["warc-payload-digest"])
                        side.write(("\t".join(map(str, row[1:])) + "\n").encode())
                        rows.append(row)
                        offset += len(member)
                        if len(rows) >= 10_000:
                            yield index_rows(rows)
                            rows = []
                if rows:
                    yield index_rows(rows)

    def index_rows(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in INDEX.split(", ")])

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(manifest.select("path").repartition(tasks, "path").mapInArrow(run, INDEX), "warc-index")


def page_of(urn: str) -> int | None:
    text = urn.strip("<>").removeprefix("urn:page:").partition(":")[0]
    return None if text == "None" else int(text)


def read_records(index: DataFrame) -> DataFrame:
    """The records behind index rows, each read at its offset; the payload of a response is
    counted and its digest checked, those of a revisit are the ones it states."""

    def run(batches):
        for batch in row_batches(batches, 200_000):
            rows, name, stream = [], None, None
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    if stream is not None:
                        stream.close()
                    fs, own = resolve(path)
                    name, stream = path, fs.open_input_file(own)
                stream.seek(offset)
                [(head, data)] = records_in(iter([zlib.decompress(stream.read(length), 31)]))
                block = data[data.index(END) + len(END) : -len(END)]
                http, _, payload = block.partition(END)
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                size = int(head_of(http)["content-length"])
                if head["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                    raise ValueError(f"{path} at {offset}: payload does not match its digest")
                refers = page_of(head["warc-refers-to"]) if "warc-refers-to" in head else None
                rows.append((page_of(head["warc-record-id"]), size, digest, head["warc-type"], refers))
            if stream is not None:
                stream.close()
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[p.split()[0] for p in RECORDS.split(", ")])

    return index.select("path", "offset", "length").mapInArrow(run, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives have it."""
    folder = scratch_dir(spark, "warc")
    fs, own = resolve(folder)
    fs.create_dir(own)
    return read_records(normalise(write_archives(pages, folder, min_bytes), folder))
