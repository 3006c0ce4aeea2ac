"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are rows of (path, length, content), the layout of Spark's `binaryFile` source, so the reader takes files on
any store as well as a table of archives. The writer leaves naming and committing to Spark's own writer: an archive of
a lost task is never seen half-written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
CRLF = b"\r\n"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"

RECORD_FIELDS = "path string, offset long, record_type string, page_id long, uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload_sha1 (hex) and refers_to: the smallest page_id with the same payload, null on that page itself.

    Only digests and ids are gathered; a digest with a third of all rows is summed up before the shuffle, and the join
    back is a plain equi-join that adaptive execution can split. Rows that repeat the smallest id are all responses,
    and so are rows without an id and copies of which none has an id.
    """
    pages = pages.select("page_id", "url", "html").withColumn("payload_sha1", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    first = pages.groupBy("payload_sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("payload_sha1", "first_id")
    return pages.join(first, "payload_sha1", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id"))).drop("first_id")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group()):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    return CRLF.join(x.encode() for x in head) + CRLF * 2 + block + CRLF * 2


def write_archives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 4_000_000, dictionary_bytes: int = 32_768, sample_bytes: int = 2_000_000) -> DataFrame:
    """Archives of `pages` (page_id, url, html, refers_to), as a frame of (path, length, content).

    A task writes one archive after the other and starts a new one beyond `archive_bytes`, so memory does not grow with
    the input. The dictionary of an archive is trained on its first records, `sample_bytes` of them; where they are too
    few to train on, the archive has none. Null html is the empty payload.
    """

    def work(batches):
        import zstandard

        def archive(records: list[bytes], dictionary) -> Iterator[bytes]:
            if dictionary is not None:
                packed = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
                yield struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
            compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
            for x in records:
                yield compressor.compress(x)

        def emit(records: list[bytes]) -> pa.RecordBatch:
            sample, size = [], 0
            for x in records:
                if size > sample_bytes:
                    break
                sample.append(x)
                size += len(x)
            try:
                dictionary = zstandard.train_dictionary(dictionary_bytes, sample, k=256, d=8)
            except zstandard.ZstdError:
                dictionary = None
            content = b"".join(archive(records, dictionary))
            return pa.RecordBatch.from_pydict({"path": [f"{uuid.uuid4().hex}.warc.zst"], "length": [len(content)], "content": [content]}, schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())]))

        held, size = [], 0
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                held.append(record(page_id, url, (html or "").encode(), refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(work, "path string, length long, content binary")


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, from its headers alone."""
    import zstandard

    head = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        if at + 3 > len(data):
            raise ValueError("frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if last:
            at += 4 * head.has_checksum
            if at > len(data):
                raise ValueError("frame is cut off")
            return at


def frames(content: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) for every record frame of an archive. After a broken frame header nothing more is read."""
    import zstandard

    data, at, dictionary = memoryview(content), 0, None
    decompressor = zstandard.ZstdDecompressor()
    while at < len(data):
        start = at
        try:
            if at + 8 > len(data):
                raise ValueError("frame is cut off")
            magic, size = struct.unpack_from("<II", data, at)
            if magic in SKIPPABLE:
                at += 8 + size
                if at > len(data):
                    raise ValueError("skippable frame is cut off")
                if magic == DICTIONARY_FRAME and start == 0:
                    raw = bytes(data[8:at])
                    if raw[:4] == struct.pack("<I", ZSTD_FRAME):
                        raw = decompressor.decompress(raw)
                    dictionary = zstandard.ZstdCompressionDict(raw)
                    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
                continue
            if magic != ZSTD_FRAME:
                raise ValueError("no frame starts here")
            at = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as error:
            yield start, None, str(error)
            return
        try:
            frame = data[start:at]
            size = zstandard.frame_content_size(frame)
            whole = decompressor.decompress(frame) if size >= 0 else decompressor.decompressobj().decompress(frame)
            if size >= 0 and len(whole) != size:
                raise ValueError("frame content has another length than its header says")
            yield start, whole, None
        except (ValueError, zstandard.ZstdError) as error:
            yield start, None, str(error)


def headers_of(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        out[name.strip().lower()] = value.strip()
    return out


def number_in(urn: str | None) -> int | None:
    found = re.fullmatch(rf"<{RECORD_ID}(\d+)>|<{RECORD_ID}(-\d+)>", urn or "")
    return int(found[1] or found[2]) if found else None


def parse(whole: bytes) -> dict:
    """The checked fields of one record; ValueError says what is wrong with it."""
    head, gap, rest = whole.partition(CRLF * 2)
    lines = head.split(CRLF)
    if not gap or lines[0] not in VERSIONS:
        raise ValueError("no WARC version line")
    fields = headers_of(lines[1:])
    if missing := [n for n in NEEDED if n not in fields]:
        raise ValueError(f"no {missing[0]}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != CRLF * 2:
        raise ValueError("block has another length than content-length says")
    kind, http, gap, payload = fields["warc-type"], *rest[:-4].partition(CRLF * 2)
    if kind not in ("response", "revisit") or not gap:
        raise ValueError("not a response or revisit with http headers")
    length = headers_of(http.split(CRLF)[1:]).get("content-length", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (str(len(payload)) != length or base32_sha1(payload) != digest):
        raise ValueError("payload has another length or digest than its headers say")
    if kind == "revisit" and (payload or not length.isdigit() or len(digest) != 32):
        raise ValueError("revisit with a payload, or without length and digest")
    return {
        "record_type": kind, "page_id": number_in(fields["warc-record-id"]), "uri": fields.get("warc-target-uri"), "refers_to": number_in(fields.get("warc-refers-to")),
        "payload_bytes": int(length), "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def read_archives(archives: DataFrame, payload: bool = True, batch_records: int = 512) -> DataFrame:
    """All records of the archives (path, content), one row each; a record that fails a check has `error` and no fields.

    The payload of a revisit is null: it is the one of the page in refers_to. An archive without frames has no rows.
    """
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def work(batches):
        held = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for offset, whole, error in frames(content.as_py() or b""):
                    row = {"path": path.as_py(), "offset": offset, "error": error}
                    if error is None:
                        try:
                            row |= parse(whole)
                        except ValueError as problem:
                            row["error"] = str(problem)
                    if not payload:
                        row["payload"] = None
                    held.append(row)
                    if len(held) >= batch_records:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select("path", "content").mapInArrow(work, RECORD_FIELDS)
