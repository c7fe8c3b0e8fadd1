"""WARC: archives that are one gzip stream, rewritten as one member per record with an offset index beside them.

``write_archives`` turns pages into WARC 1.1 records, as a crawler writes them: one gzip stream per archive, records
behind each other. Of equal payloads one page is a response record, the others are revisit records that name it.
``normalise`` inflates each archive once, as a stream in pieces of ``PIECE`` bytes, writes every record as a gzip member of
its own and a sidecar index (JSON lines) of where each member lies; the same index comes back as a table. ``read_records``
takes that table, in ranges of neighbouring members, and inflates single records by offset.

Files lie in a folder under ``spark.checkpoint.dir``, which all executors share; it may be any that pyarrow opens by its
address (a mounted folder, HDFS, an object store). Each attempt of a task writes files with names of its own and only the names that a
successful attempt returned are in the staged tables, so lost executors and repeated tasks leave files that nothing names.

Which page is a response is decided on digests (SHA-1 and length); html leaves its partition only for the one response of
a group of equal payloads, and is copied to disk only for pages in such groups. A task holds one batch of pages, or one
record and a few pieces; archives end after ``ARCHIVE_BYTES`` of content, so a file is a bounded piece of work.

Defined cases: null html is an empty payload, and equal to other empty ones. Of equal payloads the page with the largest
page_id is the response (null is the smallest); of repeated rows of that id one is. A null url or page_id is left out of the
header. Further columns pass by. An archive that breaks off or is not WARC gives its records up to there and one row with
``problem`` set; nothing is skipped silently. Archives that already have a member per record, or several, are read as well.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import bitmap, maybe_in, stage
from quantloom.session import delete_at_end, shared_dir

PIECE = 1 << 20
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20  # compressed bytes that a reading task takes from an archive
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
c = F.col

RECORDS = "record string, type string, page_id long, url string, digest string, refers string, payload binary"
ARCHIVES = "archive string, records long"
INDEX = "archive string, start long, size long, record_id string, type string, uri string, page_id long, digest string, refers_to string, problem string"
READ = "record_id string, type string, uri string, page_id long, digest string, refers_to string, payload_bytes long, payload_digest string"


def opened(address: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(address)


def arrow(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def new_folder(spark: SparkSession) -> str:
    """A folder for archives under the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    system, inside = opened(path)
    system.create_dir(inside, recursive=True)
    delete_at_end(spark, path)
    return path


# ---- pages to records ----------------------------------------------------------------


def payload() -> Column:
    return F.coalesce(c("html").cast("binary"), F.lit(b""))


def record_number(digest: str, page_id: str, row: str) -> Column:
    """A number for a record, the same in every run of the same pages."""
    return F.md5(F.concat_ws("|", digest, F.coalesce(c(page_id).cast("string"), F.lit("none")), F.coalesce(c(row).cast("string"), F.lit("alone"))).cast("binary"))


def page_records(pages: DataFrame) -> DataFrame:
    """A record per page (``RECORDS``): response with its payload, or revisit of the response ``refers``."""
    digested = pages.select(c("page_id").cast("long").alias("page_id"), c("url").cast("string").alias("url"), payload().alias("payload")).withColumn("digest", F.sha1("payload"))
    counted = stage(digested.select("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    flagged = maybe_in(digested, "digest", bitmap(counted, "digest"), "_shared")
    alone = flagged.where("not _shared").withColumn("_row", F.lit(None).cast("long"))
    none = F.lit(None)
    singles = alone.select(record_number("digest", "page_id", "_row").alias("record"), F.lit("response").alias("type"), "page_id", "url", "digest", none.cast("string").alias("refers"), "payload")
    several = stage(flagged.where("_shared").drop("_shared").withColumn("_row", F.monotonically_increasing_id()))
    narrow = several.drop("payload")
    kept = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "_row")).alias("keep"))
    groups = stage(kept.select(c("digest").alias("_digest"), c("keep.page_id").alias("_keep_id"), c("keep._row").alias("_keep_row")))
    told = narrow.join(groups, c("digest") == c("_digest"))
    revisits = told.where("_row <> _keep_row").select(
        record_number("digest", "page_id", "_row").alias("record"), F.lit("revisit").alias("type"), "page_id", "url", "digest",
        record_number("digest", "_keep_id", "_keep_row").alias("refers"), none.cast("binary").alias("payload"))
    likely = maybe_in(several, "_row", bitmap(groups, "_keep_row"), "_maybe").where("_maybe")
    responses = likely.join(groups.select("_keep_row"), c("_row") == c("_keep_row")).select(
        record_number("digest", "page_id", "_row").alias("record"), F.lit("response").alias("type"), "page_id", "url", "digest", none.cast("string").alias("refers"), "payload")
    return singles.unionByName(responses).unionByName(revisits)


def record_bytes(record: str, kind: str, page_id: int | None, url: str | None, digest: str, refers: str | None, body: bytes | None) -> Iterator[bytes]:
    """A WARC record in pieces."""
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if kind == "response":
        http += f"Content-Length: {len(body or b'')}\r\n"
    block = (http + "\r\n").encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.UUID(record)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.UUID(refers)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block) + len(body or b'')}"]
    yield "\r\n".join(lines).encode("utf-8", "surrogatepass") + END + block
    if body:
        yield body
    yield END


INFO = ("\r\n".join(["WARC/1.1", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:{}>", "WARC-Date: " + DATE, "Content-Type: application/warc-fields", "Content-Length: 25"])
        + "\r\n\r\nformat: WARC File Format\n\r\n\r\n")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Staged (archive, records): each archive is one gzip stream of a warcinfo record and page records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = opened(folder)
        sink = packer = name = None
        held = count = 0

        def close() -> pa.RecordBatch:
            sink.write(packer.flush())
            sink.close()
            return arrow(ARCHIVES, [(f"{folder}/{name}", count)])

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)]):
                if sink is None:
                    name, packer, held, count = f"{uuid.uuid4().hex}.warc.gz", zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                    sink = system.open_output_stream(f"{inside}/{name}", compression=None)
                    sink.write(packer.compress(INFO.format(uuid.UUID(name[:32])).encode()))
                for piece in record_bytes(*[v.as_py() for v in row]):
                    held += len(piece)
                    sink.write(packer.compress(piece))
                count += 1
                if held >= archive_bytes:
                    yield close()
                    sink = None
        if sink is not None:
            yield close()

    return stage(records.select(*[f.split()[0] for f in RECORDS.split(", ")]).mapInArrow(run, ARCHIVES))


# ---- archives to members -------------------------------------------------------------


class Damaged(ValueError):
    """An archive ends or breaks inside a record."""


class Inflated:
    """The content of a gzip file of one or more members, as a stream of bounded pieces."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.unpacker, self.held, self.ended = source, zlib.decompressobj(31), bytearray(), False
        self.rest = b""
        self.begun = False

    def more(self) -> bool:
        """Add a piece; False at the end of the file."""
        while not self.ended:
            data = self.rest or self.source.read(PIECE)
            if not data:
                self.ended = True
                if self.begun:
                    raise Damaged("the gzip stream breaks off")
                return False
            try:
                if self.unpacker.eof:
                    self.unpacker = zlib.decompressobj(31)
                out = self.unpacker.decompress(data, PIECE)
            except zlib.error as error:
                raise Damaged(str(error)) from error
            self.rest = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            self.begun = not self.unpacker.eof
            if out:
                self.held += out
                return True
        return False

    def until(self, sign: bytes, limit: int = 1 << 20) -> bytes | None:
        """Bytes up to and with ``sign``; None at the end of the file."""
        start = 0
        while (at := self.held.find(sign, start)) < 0:
            start = max(0, len(self.held) - len(sign))
            if len(self.held) > limit:
                raise Damaged("a header is too long")
            if not self.more():
                if self.held.strip():
                    raise Damaged("the file ends inside a header")
                return None
        out = bytes(self.held[: at + len(sign)])
        del self.held[: at + len(sign)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces."""
        while size:
            if not self.held and not self.more():
                raise Damaged("the file ends inside a record")
            out = bytes(self.held[:size])
            del self.held[: len(out)]
            size -= len(out)
            yield out


def fields_of(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged("no WARC version line")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def bare_id(value: str | None) -> str | None:
    return value.removeprefix("<urn:uuid:").removesuffix(">") if value else None


def rewrite(source: pa.NativeFile, sink: pa.NativeFile) -> Iterator[tuple]:
    """Copy records, one gzip member each; yields (start, size, fields) and at damage (start, None, reason)."""
    stream, start = Inflated(source), 0
    while True:
        size, packer = 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        try:
            header = stream.until(END)
            if header is None:
                return
            header = header.lstrip(b"\r\n")
            found = fields_of(header)
            length = found.get("content-length", "")
            if not length.isdigit():
                raise Damaged("no content length")
            packed = [packer.compress(header)]
            for piece in stream.take(int(length)):
                packed.append(packer.compress(piece))
                if sum(map(len, packed)) >= PIECE:
                    size += sink.write(b"".join(packed))
                    packed = []
            if b"".join(stream.take(4)) != END:
                raise Damaged("a record is longer than its content length")
        except Damaged as error:
            yield start, None, str(error)
            return
        size += sink.write(b"".join([*packed, packer.compress(END), packer.flush()]))
        yield start, size, found
        start += size


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each of ``archives`` (column archive) into ``folder``; staged index of all members (``INDEX``)."""
    count = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inside = opened(folder)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                origin, path = opened(archive)
                name, rows = f"{uuid.uuid4().hex}.warc.gz", []
                with origin.open_input_stream(path, compression=None) as source, system.open_output_stream(f"{inside}/{name}", compression=None) as sink, \
                        system.open_output_stream(f"{inside}/{name}.index.jsonl", compression=None) as sidecar:
                    for start, size, found in rewrite(source, sink):
                        if size is None:
                            row = (f"{folder}/{name}", start, 0, None, None, None, None, None, None, f"{archive}: {found}")
                        else:
                            page = found.get("x-page-id")
                            row = (f"{folder}/{name}", start, size, bare_id(found.get("warc-record-id")), found.get("warc-type"), found.get("warc-target-uri"),
                                   None if page is None else int(page), (found.get("warc-payload-digest") or "").removeprefix("sha1:") or None, bare_id(found.get("warc-refers-to")), None)
                        sidecar.write(json.dumps(dict(zip([f.split()[0] for f in INDEX.split(", ")][1:], row[1:]))).encode() + b"\n")
                        rows.append(row)
                        if len(rows) >= 5000:
                            yield arrow(INDEX, rows)
                            rows = []
                yield arrow(INDEX, rows)

    return stage(archives.select("archive").repartition(max(1, count)).mapInArrow(run, INDEX))


def sidecar_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder of normalised archives, read from its sidecar files."""
    rows = spark.read.schema(INDEX.split(", ", 1)[1]).json(f"{folder}/*.index.jsonl").withColumn("archive", F.input_file_name())
    return rows.withColumn("archive", F.regexp_replace("archive", r"\.index\.jsonl$", "")).select(*[f.split()[0] for f in INDEX.split(", ")])


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Single records by offset (``READ``): payload length and SHA-1 as found in the file; with ``with_payload`` its bytes."""
    good = index.where(c("problem").isNull() & c("type").isin("response", "revisit", "resource"))
    ranges = (good.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES + good.select("archive").distinct().count()
    schema = READ + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = source = None
        names = ("archive", "start", "size", "record_id", "type", "uri", "page_id", "digest", "refers_to")
        for batch in batches:
            rows, held = [], 0
            for archive, start, size, *rest in zip(*[batch.column(n).to_pylist() for n in names]):
                if archive != at:
                    system, path = opened(archive)
                    at, source = archive, system.open_input_file(path)
                source.seek(start)
                member = zlib.decompress(source.read(size), 31)
                head = member.find(END) + 4
                body = member[head : len(member) - 4]
                if rest[1] == "resource":
                    content = body
                else:
                    content = body[body.find(END) + 4 :]
                row = (*rest, len(content), base64.b32encode(hashlib.sha1(content).digest()).decode())
                rows.append((*row, content) if with_payload else row)
                held += len(content) * with_payload
                if held > 16 * PIECE:
                    yield arrow(schema, rows)
                    rows, held = [], 0
            yield arrow(schema, rows)

    dealt = good.withColumn("_range", F.expr(f"start div {RANGE_BYTES}")).repartition(max(1, int(ranges)), "archive", "_range").sortWithinPartitions("archive", "start")
    return dealt.select("archive", "start", "size", "record_id", "type", "uri", "page_id", "digest", "refers_to").mapInArrow(run, schema)


def resolved(read: DataFrame) -> DataFrame:
    """Revisits get length and digest of the response they name; ``intact``: the digest in the header is that of the payload."""
    rows = stage(read)
    revisits, responses = rows.where("type = 'revisit'"), rows.where("type <> 'revisit'")
    named = stage(revisits.select(c("refers_to").alias("_named")).distinct())
    targets = stage(responses.join(named, c("record_id") == c("_named"), "left_semi").select(
        c("record_id").alias("_id"), c("page_id").alias("_page"), c("payload_bytes").alias("_bytes"), c("payload_digest").alias("_digest")))
    found = revisits.join(targets, c("refers_to") == c("_id"), "left").select(
        "page_id", c("_bytes").alias("payload_bytes"), c("_digest").alias("payload_digest"), c("type").alias("record_type"), c("_page").alias("refers_to"), "uri",
        F.coalesce(c("digest") == c("_digest"), F.lit(False)).alias("intact"))
    return responses.select("page_id", "payload_bytes", "payload_digest", c("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "uri",
                            F.coalesce(c("digest") == c("payload_digest"), F.lit(False)).alias("intact")).unionByName(found)


def archive_pages(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as archives, normalise these and read every record back by its offset; raises if an archive is damaged."""
    spark = pages.sparkSession
    raw = write_archives(page_records(pages), new_folder(spark), archive_bytes)
    index = normalise(raw, new_folder(spark))
    if problem := index.where("problem is not null").first():
        raise Damaged(problem.problem)
    return resolved(read_records(index))
