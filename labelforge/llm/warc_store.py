"""Operator 2: WARC archives with per-record Zstandard compression and an embedded dictionary.

Layout of an archive: a skippable frame (magic 0x184D2A5D) holding the
dictionary, then one Zstandard frame per WARC record, each compressed on its
own with that dictionary, so a record can be read from its offset alone.

* Dictionary: trained in one task on records of a bounded sample, at most
  ``SAMPLE_RECORDS`` rows of lowest key hash and ``SAMPLE_BYTES`` bytes of each,
  whatever the corpus size; every record of the corpus is archived. Where the
  sample is too small to train on, its bytes serve as a raw-content
  dictionary.
* Duplicates: payloads are equal when their SHA-256 is. Only (key, digest) is
  aggregated; groups with more than one key are joined back, and a hot group
  is split by the skew handling of the join. The record with the smallest key
  of a group is the response, the others are revisits without a payload.
* Writing: each task streams its rows into archives of at most
  ``archive_bytes`` in the shared folder, named by a fresh uuid; the manifest
  (archive, records, bytes) is written as a table when all tasks are done. A
  task that is run again writes new files, and files outside the manifest are
  never read, so lost executors and speculative tasks do no harm. Files go
  through ``pyarrow.fs``: local or shared mounts, HDFS, S3, GCS.
* Reading: one row of the manifest is one archive; a task streams it frame by
  frame, checks every digest against the payload, and holds one record.

Edge cases: a null html is an empty payload; a null url leaves out the target
field; rows with a null key are archived under an empty key and are never the
original of another row unless all rows of the group have none; rows that
repeat the key and payload of a response are responses too; payloads below
``min_revisit_bytes`` are always responses; an empty table gives no archives;
other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelforge.llm.common import hash_sample, map_batches, written
from labelforge.session import work_path

DICTIONARY_MAGIC = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 112_640
MANIFEST = T.StructType([T.StructField("archive", T.StringType()), T.StructField("records", T.LongType()),
                         T.StructField("bytes", T.LongType())])
RECORDS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                        T.StructField("payload", T.BinaryType()), T.StructField("payload_bytes", T.LongType()),
                        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
                        T.StructField("refers_to", T.LongType())])


def _file(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
           date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP headers and the digest, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {date}"]
    if url is not None:
        # only what would break a header line is escaped
        head.append("WARC-Target-URI: " + "".join(quote(c) if c < "!" or c == "%" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """A row of ``RECORDS`` from the bytes of one record; a payload that does not fit its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != declared or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return (_page_of(fields["WARC-Record-ID"]), None if url is None else unquote(url), None if revisit else payload,
            declared, digest, fields["WARC-Type"], _page_of(fields["WARC-Refers-To"]) if revisit else None)


def train_dictionary(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
                     sample_records: int = SAMPLE_RECORDS) -> bytes | None:
    """The dictionary's bytes (at most ``DICTIONARY_BYTES``); None for an empty table."""
    spread = F.xxhash64(F.col(key), F.col(url))
    start = F.lit(1) + F.pmod(spread, F.greatest(F.length(html) - SAMPLE_BYTES + 1, F.lit(1))).cast("int")
    # the start varies by row, so that bodies are learnt as well as openings
    piece = F.coalesce(F.when(F.pmod(spread, F.lit(2)) == 0, F.substring(html, 1, SAMPLE_BYTES))
                       .otherwise(F.col(html).substr(start, F.lit(SAMPLE_BYTES))), F.lit(""))
    sample = hash_sample(pages.select(key, url, piece.alias("_t")), F.xxhash64(F.col(key), F.col(url)), sample_records, key).coalesce(1)

    def train(given: Iterator[list]) -> Iterator[list]:
        import zstandard
        samples = [record(i, u, t.encode(), None, False) for batch in given for i, u, t in batch]
        if samples:
            try:
                made = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8 + 256), samples)
                yield [(made.as_bytes(),)]
            except zstandard.ZstdError:
                yield [(b"".join(samples)[-DICTIONARY_BYTES:],)]

    rows = map_batches(sample, train, T.StructType([T.StructField("d", T.BinaryType())])).collect()
    return bytes(rows[0].d) if rows else None


def revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
             min_revisit_bytes: int = 0) -> DataFrame:
    """``_key, _url, _html, _first``: ``_first`` is the key of the response a row revisits, else null."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("_key"), F.col(url).alias("_url"), body.alias("_html"),
                        F.sha2(body, 256).alias("_sum"))
    groups = (rows.where(F.octet_length("_html") >= min_revisit_bytes).groupBy("_sum")
              .agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return (rows.join(groups, "_sum", "left")
            .withColumn("_first", F.when(~F.col("_key").eqNullSafe(F.col("_least")), F.col("_least"))).drop("_least", "_sum"))


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html",
                   min_revisit_bytes: int = 0, archive_bytes: int = 1 << 30, level: int = 3) -> tuple[DataFrame, str]:
    """Writes all rows; returns the manifest (read from its table) and the folder."""
    spark = pages.sparkSession
    folder = folder or work_path(spark, "warc")
    dictionary = train_dictionary(pages, key, url, html)

    def write(given: Iterator[list]) -> Iterator[list]:
        import zstandard
        raw = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=raw, write_checksum=True)
        out, name, records, size = None, "", 0, 0
        try:
            for batch in given:
                for page_id, link, text, first in batch:
                    if out is None:
                        fs, top = _file(folder)
                        fs.create_dir(top, recursive=True)
                        name, records, size = f"{uuid.uuid4().hex}.warc.zst", 0, 0
                        out = fs.open_output_stream(f"{top}/{name}", compression=None)
                        if dictionary:
                            size += out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                    size += out.write(squeeze.compress(record(page_id, link, text.encode(), first, first is not None)))
                    records += 1
                    if size >= archive_bytes:
                        out.close()
                        out = None
                        yield [(name, records, size)]
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield [(name, records, size)]

    rows = revisits(pages, key, url, html, min_revisit_bytes).select("_key", "_url", "_html", "_first")
    return written(map_batches(rows, write, MANIFEST), "warc-manifest"), folder


def read_archive(stream, chunk: int = 1 << 18) -> Iterator[bytes]:
    """The records of one archive, one at a time, from a binary stream."""
    import zstandard
    held, raw = b"", None
    more = True

    def fill(n: int) -> bool:
        nonlocal held, more
        while more and len(held) < n:
            got = stream.read(chunk)
            more = bool(got)
            held += got
        return len(held) >= n

    while fill(8):
        magic, length = struct.unpack("<II", held[:8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if not fill(8 + length):
                raise ValueError("archive ends inside a skippable frame")
            if magic == DICTIONARY_MAGIC and raw is None:
                raw = zstandard.ZstdCompressionDict(held[8:8 + length])
            held = held[8 + length:]
            continue
        inflate = zstandard.ZstdDecompressor(dict_data=raw).decompressobj()
        out = io.BytesIO()
        while not inflate.eof:
            if not held and not fill(1):
                raise ValueError("archive ends inside a record")
            out.write(inflate.decompress(held))
            held = inflate.unused_data
        yield out.getvalue()
    if held:
        raise ValueError("archive ends inside a frame header")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``RECORDS`` of all archives of the manifest; a count that differs from the manifest is an error."""

    def read(given: Iterator[list]) -> Iterator[list]:
        for batch in given:
            for name, records in batch:
                fs, top = _file(folder)
                held, size, n = [], 0, 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for data in read_archive(stream):
                        held.append(parse_record(data))
                        size, n = size + len(data), n + 1
                        if size >= 8_000_000:
                            yield held
                            held, size = [], 0
                if held:
                    yield held
                if n != records:
                    raise ValueError(f"{name}: {n} records, the manifest has {records}")

    spark: SparkSession = manifest.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(manifest.select("archive", "records").repartition(tasks, "archive"), read, RECORDS)
