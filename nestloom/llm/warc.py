"""Web archives of one Zstandard frame for each record (operator 9).

A file starts with a skippable frame that holds the dictionary, itself compressed or not; each record after it is a frame of
its own. The dictionary is trained on a bounded sample of payloads and is at most DICTIONARY bytes. Readers load the
dictionary from the file, decode a frame at a time and check each record: version, mandatory fields, the length of the
block, the end marks, and the payload's length and digest. A task writes files under names of its attempt and returns them
in its result; only these are read, so a repeated or lost attempt neither doubles nor loses records.

Of equal payloads of at least `least` bytes the one with the largest id is stored; others become revisit records with the
same head but no payload. A null html is an empty payload. Repeated rows with the largest id are stored each. A null id is
written as such and read back; it is never referred to. Only id, url and html are read, so other columns can't clash. An
empty table gives no file.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_files, file_folder, put_file, small_side, text_batches, text_or_empty, written

DICTIONARY, SAMPLES, SAMPLE_CHARS = 32 << 10, 300, 50_000
FILE_BYTES = 8 << 20
#: Fixed values of the formats.
SKIPPABLE, ZSTD = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"
_URN = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + _END


def dictionary(pages: DataFrame, html_col: str) -> bytes:
    rows = pages.select(html_col).where(F.length(html_col).between(1, SAMPLE_CHARS)).limit(SAMPLES).collect()
    samples = [r[0].encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their ends serve as the dictionary
        return b"".join(samples)[-DICTIONARY:]


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write_archives(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2025-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Returns the folder of the archives, and their names and numbers of records."""
    spark = pages.sparkSession
    html = text_or_empty(html_col)
    text_batches(spark)
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    long = rows.where(F.octet_length("html") >= least)
    kept = written(long.groupBy("digest").agg(F.max("page_id").alias("stored"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "stored")
    rows = rows.join(small_side(kept), "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("stored")), F.col("stored")).alias("refers_to"))
    folder, shared = file_folder(spark, "warc"), spark.sparkContext.broadcast(dictionary(pages, html_col))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, part = shared.value, TaskContext.get().partitionId()
        packed = zstandard.ZstdCompressor(level=9).compress(raw)
        start = struct.pack("<II", SKIPPABLE, len(packed)) + packed
        z = zstandard.ZstdCompressor(level=3, dict_data=_loaded(raw), write_checksum=True)
        out, size, n, made = [start], 0, 0, []

        def close() -> None:
            nonlocal out, size, n
            made.append((f"{part:06d}-{len(made):05d}-{uuid.uuid4().hex}.warc.zst", n))
            put_file(folder, made[-1][0], b"".join(out))
            out, size, n = [start], 0, 0

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for page, url, text, digest, refers in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    out.append(z.compress(record(page, url, text.encode(), digest, refers, date)))
                    size += len(out[-1])
                    n += 1
                    if size >= FILE_BYTES:
                        close()
        if size:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in made], pa.string()), pa.array([x for _, x in made], pa.int64())], names=["name", "n"])

    return folder, written(rows.mapInArrow(run, "name string, n bigint"), "archives")


def records(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive."""
    view, at, known = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = data[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut short")
        at = 8 + size
        known = _loaded(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD else raw)
    z = zstandard.ZstdDecompressor(dict_data=known)
    while at < len(data):
        frame, parts = z.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("a record's frame is cut short")
            fed = view[at : at + (1 << 16)]
            parts.append(frame.decompress(fed))
            at += len(fed)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def _id(value: str) -> int | None:
    if not value.startswith(f"<{_URN}") or value[-1] != ">":
        raise ValueError(f"not a record's name: {value}")
    return int(value[len(_URN) + 1 : -1]) if len(value) > len(_URN) + 2 else None


def parsed(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload_bytes, digest, type, refers_to and block of a record, after its checks."""
    head, mark, rest = data.partition(_END)
    version, *lines = head.decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1") or not mark:
        raise ValueError("not a record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    if lacking := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"a record lacks {sorted(lacking)}")
    size = int(fields["content-length"])
    if len(rest) != size + len(_END) or rest[size:] != _END:
        raise ValueError("a record's length doesn't match its header")
    http, _, payload = rest[:size].partition(_END)
    told = int(re.search(rb"(?i)\ncontent-length: (\d+)", http)[1])
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != told or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't match its length or digest")
    return _id(fields["warc-record-id"]), told, digest, kind, _id(fields["warc-refers-to"]) if kind == "revisit" else None, payload


def read_archives(spark: SparkSession, folder: str, archives: DataFrame) -> DataFrame:
    """For each record of the archives named: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [parsed(r)[:5] for r in records(content.as_py())]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * len(rows), pa.string()), *arrays], names=["name", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = binary_files(spark, folder, ".warc.zst").mapInArrow(run, "name string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return found.join(small_side(archives.select("name")), "name", "left_semi").drop("name")


def archive_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    return read_archives(pages.sparkSession, *write_archives(pages, least))
