"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

An archive starts with a skippable frame that holds the dictionary, itself compressed; each
record is one frame made with that dictionary.  The reader takes the dictionary from the
archive alone, decodes frame by frame, and checks versions, headers, lengths and digests.

Pages with equal payloads of some length are written once as a response; the others become
revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelode.llm.common import Scratch

MAGIC = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this length are always written in full.
REVISIT_BYTES = 1000
#: An archive is closed beyond this many compressed bytes, so that it can be read as one row.
ARCHIVE_BYTES = 16 << 20
#: The dictionary of an archive is trained on its first records, up to this many.
TRAIN_RECORDS, DICTIONARY_BYTES, LEVEL = 200, 64 << 10, 6
#: Compressed bytes that the reader hands to a frame at once.
PIECE_BYTES = 8 << 10


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record; a revisit keeps the HTTP head and drops the payload.  A page without an id gets
    a generated record id."""
    kind = "response" if refers_to is None else "revisit"
    body = b"" if refers_to is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    target = "".join(c if " " < c != "\x7f" else "%{:02X}".format(ord(c)) for c in (url or ""))
    record_id = f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(http + body).hexdigest()}"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(body)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + http + body + b"\r\n\r\n"


def dictionary_frame(records: list[bytes]):
    """The dictionary learned from the first records, and the skippable frame that carries it."""
    import zstandard as zstd

    try:
        trained = zstd.train_dictionary(DICTIONARY_BYTES, records).as_bytes()
    except (zstd.ZstdError, ValueError):  # too few or too short records: their text itself serves
        trained = b"".join(records)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n"
    kind = zstd.DICT_TYPE_AUTO
    packed = zstd.ZstdCompressor(level=LEVEL).compress(trained)
    return zstd.ZstdCompressionDict(trained, dict_type=kind), struct.pack("<II", MAGIC, len(packed)) + packed


def archives(records: Iterator[bytes]) -> Iterator[bytes]:
    """Whole archives, each with its own dictionary."""
    import zstandard as zstd

    records = iter(records)
    rest: list[bytes] = []
    while True:
        first = rest
        while len(first) < TRAIN_RECORDS and sum(map(len, first)) < ARCHIVE_BYTES and (record := next(records, None)) is not None:
            first.append(record)
        if not first:
            return
        dictionary, head = dictionary_frame(first)
        writer = zstd.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
        frames = [head, *map(writer.compress, first)]
        size = sum(map(len, frames))
        rest = []
        while size < ARCHIVE_BYTES and (record := next(records, None)) is not None:
            frames.append(writer.compress(record))
            size += len(frames[-1])
        yield b"".join(frames)


def parse_head(data: bytes, start: int) -> tuple[dict[str, str], int]:
    """Header fields from ``start`` up to the empty line, and where the block begins."""
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise WarcError("header without an end")
    fields: dict[str, str] = {}
    for line in data[start:end].split(b"\r\n"):
        name, colon, value = line.decode().partition(":")
        if not colon or not name:
            raise WarcError(f"header line without a name: {line[:80]!r}")
        fields[name.lower()] = value.strip()
    return fields, end + 4


def parse_record(data: bytes) -> dict:
    """A record's fields and payload after all checks."""
    if not data.startswith(VERSION + b"\r\n"):
        raise WarcError("unknown version line")
    head, start = parse_head(data, len(VERSION) + 2)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"{name} is missing")
    if not head["content-length"].isdecimal():
        raise WarcError("content length is not a number")
    stop = start + int(head["content-length"])
    if data[stop:] != b"\r\n\r\n":
        raise WarcError("block length differs from the header")
    block = data[start:stop]
    if (said := head.get("warc-block-digest")) and said != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("block digest differs")
    if not block.startswith(b"HTTP/1.1 "):
        raise WarcError("block is no HTTP response")
    http, body = parse_head(block, block.find(b"\r\n") + 2)
    payload = block[body:]
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    page = lambda value: int(value[len("<urn:page:") : -1]) if value.startswith("<urn:page:") else None
    if head["warc-type"] == "response":
        if len(payload) != int(http["content-length"]):
            raise WarcError("payload length differs from the header")
        if digest != hashlib.sha1(payload).hexdigest():
            raise WarcError("payload digest differs")
    elif head["warc-type"] != "revisit" or payload or "warc-refers-to" not in head:
        raise WarcError("neither a response nor a revisit")
    refers = head.get("warc-refers-to")
    return {
        "page_id": page(head["warc-record-id"]), "url": head.get("warc-target-uri", ""), "payload": payload,
        "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": head["warc-type"],
        "refers_to": page(refers) if refers else None,
    }


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order."""
    import zstandard as zstd

    if len(data) < 8:
        raise WarcError("archive is too short")
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC or 8 + size > len(data):
        raise WarcError("no dictionary frame leads the archive")
    raw = data[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstd.ZstdDecompressor().decompress(raw)
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        # In small pieces, since what lies behind a frame is copied when the frame ends.
        frame, parts, begin = reader.decompressobj(), [], at
        while not frame.eof:
            if at >= len(data):
                raise WarcError(f"truncated frame at {begin}")
            try:
                parts.append(frame.decompress(view[at : at + PIECE_BYTES]))
            except zstd.ZstdError as error:
                raise WarcError(f"broken frame at {begin}: {error}") from error
            at = min(len(data), at + PIECE_BYTES)
        at -= len(frame.unused_data)
        yield parse_record(b"".join(parts))


def decided(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, n_bytes and refers_to (null for responses).

    Which pages are revisits is decided over (page, digest) rows; payloads meet the decisions by
    page, so equal payloads gather nowhere.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page, url = F.col("page_id").cast("long"), F.col("url").cast("string")
    rows = pages.select(page.alias("page_id"), url.alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("place", F.coalesce("page_id", F.xxhash64("url", "digest")))
    slim = rows.where(F.col("n_bytes") >= revisit_bytes).select("page_id", "place", "digest")
    keeper = slim.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    again = slim.join(keeper.select("digest", "keeper"), "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    again = again.groupBy("place", "digest", F.col("page_id").isNull().alias("nameless")).agg(F.max("keeper").alias("refers_to"))
    joined = rows.withColumn("nameless", F.col("page_id").isNull()).join(again, ["place", "digest", "nameless"], "left")
    return joined.select("page_id", "url", "payload", "digest", "n_bytes", "refers_to")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write ``.warc.zst`` files below ``folder`` and return their paths and sizes.

    Tasks write under a name of their own and rename when whole, so a task that is run again
    leaves no half-written archive; only the files of the returned rows belong to the result.
    Null html is an empty payload and a null url an empty target.  A page without an id is written
    under a generated record id and read back without one; it refers to an equal page with an id, if
    there is one.  Other columns are ignored.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield record_bytes(*(batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "digest", "n_bytes", "refers_to")))

        for data in archives(records()):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/.{name}.part") as out:
                out.write(data)
            store.move(f"{base}/.{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64())], ["name", "bytes"])

    return decided(pages, revisit_bytes).mapInArrow(task, "name string, bytes bigint")


def read_archives(spark, folder: str, names: DataFrame) -> DataFrame:
    """The records of the named archives of a folder, checked, with their payloads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(names.select("name"), "name", "left_semi")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in read_archive(content.as_py()):
                    rows.append(record)
                    size += len(record["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    ddl = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.mapInArrow(task, ddl).select(*columns)


def store_uri(spark, folder: str) -> str:
    """The folder with the scheme of the store it lies in, as Arrow's file systems want it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return f"file://{whole[5:]}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages into archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    written = scratch.save(write_archives(pages, store_uri(spark, folder), revisit_bytes), "names")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_archives(spark, folder, written)
