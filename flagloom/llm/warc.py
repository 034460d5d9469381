"""WARC archives: a writer with identical-payload revisits and a splittable reader.

Every record is a gzip member of its own. The reader's tasks take byte ranges
of the files: a task looks for gzip's magic bytes in its range, accepts a
candidate only if a record header can be decoded there, and owns the records
that start inside the range, reading past its end for the last one. After a
record it goes on behind that member, so magic bytes inside are never tried.

Files are opened by their full address (``file:``, ``hdfs:``, ``s3:`` ...)
through Arrow's file systems, so they may lie in any shared store.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagloom.llm.common import settle, shared_fs, slices
from flagloom.session import scratch_path

_MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 20
_HEADER = 1 << 16
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{sha1}')}>"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    head += f"Content-Length: {len(block)}\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + squeeze.flush()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the response with page id ``refers_to``."""
    sha1 = hashlib.sha1(payload).hexdigest()
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    uri = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", record_id(page_id, sha1) if refers_to is None else f"<urn:uuid:{uuid.uuid4()}>"),
              ("WARC-Date", _DATE), ("WARC-Target-URI", uri),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", digest), ("X-Page-ID", page_id)]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to, sha1)),
                   ("WARC-Refers-To-Date", _DATE)]
        return _member(fields, f"{http}\r\n".encode())
    return _member(fields, f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload)


def plan_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """``(page_id, url, html, refers_to)``: of equal payloads of at least
    ``least_bytes`` the largest page id's is the response, the others' refer to it.

    Only digests are grouped; of the pages, only ids and digests of those
    that repeat come back. Rows that share the largest id are all responses;
    a null id refers to the largest other, and where all ids are null nothing
    is a revisit.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    long = F.octet_length("html") >= least_bytes
    sums = rows.where(long).select("page_id", F.sha1("html").alias("sha1"))
    same = settle(sums.groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
                  .where("n > 1 AND holder IS NOT NULL").drop("n"), "warc-repeats")
    joined = rows.where(long).withColumn("sha1", F.sha1("html")).join(same, "sha1", "left")
    return joined.select("page_id", "url", "html",
                         F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder")).alias("refers_to")
                         ).unionByName(rows.where(~long).withColumn("refers_to", F.lit(None).cast("long")))


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 1000, records_name: str = "part") -> DataFrame:
    """Write a WARC record per row of ``pages`` (``page_id``, ``url``, ``html``;
    other columns are ignored) and return the files as ``(path, bytes, records)``.

    A task writes one file under a name of its attempt, so a repeated task
    leaves a stray file that the returned list does not name. A null html is
    an empty payload; an empty task writes no file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/{records_name}-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, size, count = None, 0, 0
        for batch in slices(batches, "html"):
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                if out is None:
                    files, name = shared_fs(path)
                    files.create_dir(name.rpartition("/")[0], recursive=True)
                    out = files.open_output_stream(name, compression=None)
                member = make_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to)
                out.write(member)
                size, count = size + len(member), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    return settle(plan_revisits(pages, least_bytes).mapInArrow(run, "path string, bytes long, records long"), "warc-files")


class _Range:
    """Reads a file forward from ``start`` with a small buffer."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.size, self.data = file, start, size, b""

    def fill(self, least: int) -> bytes:
        """At least ``least`` bytes from the current place, fewer at the file's end."""
        while len(self.data) < least and self.at + len(self.data) < self.size:
            got = self.file.read_at(min(_READ, self.size - self.at - len(self.data)), self.at + len(self.data))
            self.data += got
        return self.data

    def skip(self, n: int) -> None:
        self.at += n
        self.data = self.data[n:]


def _starts_record(data: bytes) -> bool:
    """Whether a gzip member with a WARC header begins here."""
    try:
        head = zlib.decompressobj(31).decompress(data, 16)
    except zlib.error:
        return False
    return head.startswith(b"WARC/1.")


def read_members(path: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of every gzip member with a record that starts in ``[start, stop)``."""
    files, name = shared_fs(path)
    with files.open_input_file(name) as f:
        size = f.size()
        view = _Range(f, start, size)
        while view.at < min(stop, size):
            data = view.fill(_HEADER)
            found = data.find(_MAGIC)
            if found < 0:
                view.skip(max(1, len(data) - len(_MAGIC) + 1))
                continue
            view.skip(found)
            if view.at >= stop:
                return
            if not _starts_record(view.fill(_HEADER)):
                view.skip(1)
                continue
            offset, squeeze, parts = view.at, zlib.decompressobj(31), []
            try:
                while not squeeze.eof:
                    data = view.fill(1)
                    if not data:
                        raise zlib.error("the file ends inside a member")
                    parts.append(squeeze.decompress(data))
                    view.skip(len(data) - len(squeeze.unused_data))
            except zlib.error as e:
                raise ValueError(f"{path}: broken record at byte {offset}: {e}") from e
            yield offset, b"".join(parts)


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields[k.decode().lower()] = v.strip().decode("utf-8", "surrogatepass")
    return fields, rest[:int(fields["content-length"])]


def http_payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


_RECORD = ("path string, offset long, record_type string, record_id string, url string, refers_to_id string, "
           "page_id long, payload_digest string, payload binary")


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = 8 << 20, ranges_per_task: int = 1) -> DataFrame:
    """The records of the files listed in ``files`` (``path``, ``bytes``).

    The files are cut into ranges of ``range_bytes``, and there is a task for every
    ``ranges_per_task`` of them (their number is one aggregate over ``files``), so a
    lost executor repeats no more than its own few. Files, records and ranges
    may have any size. ``payload`` is null for a revisit. ``payload_digest`` is
    bare lower-case hex, of the header.
    """
    last = F.greatest(F.col("bytes") - 1, F.lit(0))
    ranges = files.agg(F.sum(F.floor(last / range_bytes) + 1)).first()[0] or 1
    pieces = (files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(range_bytes).cast("long"))).alias("start"))
              .repartition(-(-ranges // ranges_per_task)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows, held = [], 0
                for offset, record in read_members(path, start, start + range_bytes):
                    h, block = parse_record(record)
                    kind = h["warc-type"]
                    payload = http_payload(block) if kind == "response" else None
                    digest = h.get("warc-payload-digest", "")
                    digest = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
                    page = h.get("x-page-id")
                    rows.append((path, offset, kind, h.get("warc-record-id"), h.get("warc-target-uri"),
                                 h.get("warc-refers-to"), int(page) if page is not None else None, digest, payload))
                    held += len(payload or b"")
                    if held > _READ * 4:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    return pieces.mapInArrow(run, _RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in _RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)


def page_digests(records: DataFrame) -> DataFrame:
    """Per record ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``,
    ``refers_to``: a revisit's payload is that of the response it names."""
    own = settle(records.select("page_id", "record_type", "record_id", "refers_to_id", "payload_digest",
                                F.octet_length("payload").cast("long").alias("payload_bytes"),
                                F.sha1("payload").alias("sha1")), "warc-records")
    wrong = own.where("record_type = 'response' AND payload_digest <> sha1").first()
    if wrong is not None:
        raise ValueError(f"payload of page {wrong['page_id']} does not match its digest")
    seen = own.where("record_type = 'revisit'")
    held = (own.where("record_type = 'response'")
            .groupBy("record_id").agg(F.max("page_id").alias("holder"), F.max("payload_bytes").alias("held_bytes"),
                                      F.max("sha1").alias("held_sha1")))
    held = settle(held.join(seen.select("refers_to_id").distinct(), F.col("record_id") == F.col("refers_to_id"),
                            "left_semi"), "warc-held")
    back = seen.join(held, seen["refers_to_id"] == held["record_id"], "left")
    return (own.where("record_type = 'response'")
            .select("page_id", "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type",
                    F.lit(None).cast("long").alias("refers_to"))
            .unionByName(back.select("page_id", F.col("held_bytes").alias("payload_bytes"),
                                     F.col("held_sha1").alias("payload_digest"), "record_type",
                                     F.col("holder").alias("refers_to"))))


def round_trip(pages: DataFrame, least_bytes: int = 1000, range_bytes: int = 8 << 20,
               ranges_per_task: int = 1) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and digest every record."""
    spark = pages.sparkSession
    files = write_warc(pages, scratch_path(spark, "warc"), least_bytes)
    return page_digests(read_warc(spark, files, range_bytes, ranges_per_task))
