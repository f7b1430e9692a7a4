"""WARC archives compressed with a dictionary of their own.

Each task writes archives ``*.warc.zst``: a skippable frame with a Zstandard dictionary
built from a sample of the archive's records, then one frame per record. Any record can be read alone
with the dictionary and its offset. Payloads that occur again are archived once:
the page with the largest id is the response and the others are revisit records, whose
block has the HTTP header only.

A task tells which archives it finished, with a name of its own attempt; readers take
those alone, so files left by a lost executor or a second attempt are never read.

Defined cases: a null html is an empty payload, a null url the URN of the page, a null
page_id stays null; rows with equal page_id and payload are records each, all
responses if theirs is the largest id; no pages give no archives and an empty result;
other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import fresh_path, stored

# Fixed values of the formats: WARC's dictionary frame, Zstandard's frames.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE_MAGIC, SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0

ARCHIVE_BYTES = 16 << 20      # records of one archive, uncompressed
SAMPLE_BYTES = 1 << 20        # records that a dictionary is built from
DICTIONARY_BYTES = 64 << 10
LEAST_SHARED = 1000           # shorter payloads are never revisits
DATE = "2024-01-01T00:00:00Z"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _header(lines: list[tuple[str, str]], block: bytes) -> bytes:
    rows = [*lines, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in rows).encode() + b"\r\n" + block + b"\r\n\r\n"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    hex_digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = "".join(c for c in url if c >= " ") if url is not None else f"urn:page:{page_id}"
    lines = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id, hex_digest)),
             ("WARC-Date", DATE), ("WARC-Target-URI", target),
             ("Content-Type", "application/http; msgtype=response"),
             ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode())]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if is_revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                  ("WARC-Refers-To", record_id(refers_to, hex_digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _header(lines, http if is_revisit else http + payload)


def build_dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """From an even spread of the records; a sample too small to learn from is itself
    the dictionary's content."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1 << 10, sum(map(len, sample)) // 8)), sample)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> tuple[bytes, list[int]]:
    """An archive and its records' offsets."""
    words = build_dictionary(records)
    content = words.as_bytes()
    words.precompute_compress(level=3)
    compressor = zstd.ZstdCompressor(level=3, dict_data=words)
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(content)), content]
    at, offsets = 8 + len(content), []
    for record in records:
        frame = compressor.compress(record)
        offsets.append(at)
        out.append(frame)
        at += len(frame)
    return b"".join(out), offsets


def frames(archive: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of every frame that isn't skippable."""
    at, view = 0, memoryview(archive)
    while at < len(archive):
        magic, = struct.unpack_from("<I", archive, at)
        if magic & SKIPPABLE_MASK == SKIPPABLE_MAGIC:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        start = at
        at += zstd.frame_header_size(view[start:start + 18])
        last = False
        while not last:
            block = int.from_bytes(view[at:at + 3], "little")
            last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
            at += 3 + (1 if kind == 1 else size)
        at += 4 * zstd.get_frame_parameters(view[start:start + 18]).has_checksum
        yield start, at


def read_dictionary(archive: bytes) -> zstd.ZstdCompressionDict:
    magic, size = struct.unpack_from("<II", archive, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive has no leading dictionary")
    return zstd.ZstdCompressionDict(archive[8:8 + size])


def unpack(archive: bytes) -> Iterator[bytes]:
    reader = zstd.ZstdDecompressor(dict_data=read_dictionary(archive))
    for start, end in frames(archive):
        yield reader.decompress(archive[start:end])


def parse_record(record: bytes) -> tuple:
    """Values of the columns of ``RECORD``; raises if the payload isn't the recorded one."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = int(http.decode().lower().partition("content-length: ")[2].split("\r\n")[0])
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} doesn't hold its payload")
    number = lambda name: int(fields[name]) if name in fields else None
    return (number("X-Page-ID"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"],
            number("X-Refers-To-Page-ID"))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Writes archives below ``path``; returns the index, stored:
    ``(archive, page_id, offset, length)`` per record."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"))
    keyed = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    shared = (keyed.where(F.col("n") >= LEAST_SHARED).groupBy("digest")
              .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
              .where("copies > 1 AND response IS NOT NULL").select("digest", "response"))
    shared = stored(shared, "warc-shared")
    planned = keyed.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "response",
        (F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))).alias("is_revisit"))

    def write(batches):
        where, root = fs.FileSystem.from_uri(path)
        where.create_dir(root, recursive=True)
        attempt = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        done = 0

        def finish(ids, records):
            archive, offsets = pack(records)
            name = f"{attempt}-{done:05d}.warc.zst"
            with where.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(archive)
            ends = [*offsets[1:], len(archive)]
            return pa.record_batch([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(offsets, pa.int64()),
                                    pa.array([b - a for a, b in zip(offsets, ends)], pa.int64())],
                                   ["archive", "page_id", "offset", "length"])
        ids, records, size = [], [], 0
        for batch in batches:
            for page, url, body, response, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                ids.append(page)
                records.append(make_record(page, url, body, response, is_revisit))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield finish(ids, records)
                    ids, records, size, done = [], [], 0, done + 1
        if records:
            yield finish(ids, records)
    return stored(planned.mapInArrow(write, "archive string, page_id bigint, offset bigint, length bigint"), "warc-index")


def read_archives(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Every record of the archives that ``index`` names, with the columns of ``RECORD``."""
    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [parse_record(r) for r in unpack(content.as_py())]
                columns = list(zip(*rows)) if rows else [()] * 6
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.record_batch([pa.array([name] * len(rows), pa.string()),
                                       *(pa.array(c, t) for c, t in zip(columns, types))], ["archive", *names])
    if index.limit(1).count() == 0:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").mapInArrow(
        read, f"archive string, {RECORD}")
    return found.join(index.select("archive").distinct(), "archive", "left_semi").drop("archive")


def op2_warc_archives(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, index)


ORACLE_SQL = """
WITH keyed AS (
  SELECT page_id, coalesce(url, 'urn:page:' || page_id) AS url,
         CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
top AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS response FROM keyed)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response = page_id THEN NULL ELSE response END AS refers_to
FROM top
"""
