"""WARC archives with a dictionary-compressed writer and a reader.

Every task trains a Zstandard dictionary on the first records of its archive, writes it as a leading skippable
frame (magic 0x184D2A5D, the dictionary itself compressed) and then one frame a record, each compressed with
that dictionary, so a record is read on its own.  Archives go to the shared folder under names that belong to
one task attempt; the manifest, written by Spark's own commit protocol, lists the archives that count, so a
lost executor or a repeated task leaves at most unlisted files.

Of records with equal payloads the one with the largest page id is the response and the others are revisits
that name it.  Sizes and digests are grouped before anything moves: only digests with more than one page are
joined, and Catalyst broadcasts that list only when it is small.

Defined results: null html is the empty payload; repeated page ids with one payload give one revisit or
response each by row; null page ids are written as `null` and never win against another id; an empty table
writes nothing and gives an empty result; columns other than id, url and html are ignored; a null url is
written as an empty target.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import new_path, read_table, stored

# Fixed values of the published WARC and Zstandard-for-WARC formats.
SKIPPABLE_DICTIONARY = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICT_BYTES = 32 << 10
#: Records for a dictionary: the archive's first ones, up to so many bytes.
SAMPLE_BYTES = 1 << 20
#: An archive is closed at so many written bytes.
ARCHIVE_BYTES = 128 << 20
LEVEL = 3


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def _page_of(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def build_record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has no block but tells the payload's digest and length."""
    block = b"" if revisit else payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{record_uri(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        lines[5:5] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_uri(refers_to)}>")]
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines)])
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines)
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block does not have its stated length")
    return fields, rest[:n]


def train(sample: list[bytes]) -> bytes:
    """A dictionary of the records; raw content of the first ones where there are too few to train on."""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICT_BYTES]


class ArchiveWriter:
    """Appends records to one archive; the dictionary is built when the sample is full or the archive ends."""

    def __init__(self, stream):
        self.stream, self.sample, self.held, self.compress, self.written, self.records = stream, [], 0, None, 0, 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.written += len(data)

    def _start(self) -> None:
        dictionary = train(self.sample)
        frame = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self._put(struct.pack("<II", SKIPPABLE_DICTIONARY, len(frame)) + frame)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        for record in self.sample:
            self._put(self.compress.compress(record))
        self.sample = []

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compress:
            self._put(self.compress.compress(record))
            return
        self.sample.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self._start()

    def close(self) -> None:
        if not self.compress:
            self._start()
        self.stream.close()


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_DICTIONARY:
        raise ValueError("the archive does not start with a dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(n))
    decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    waiting, frame = b"", decompress.decompressobj()
    parts: list[bytes] = []
    while True:
        data = waiting or stream.read(1 << 20)
        waiting = b""
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(frame.decompress(data))
        if frame.eof:
            yield b"".join(parts)
            waiting, frame, parts = frame.unused_data, decompress.decompressobj(), []


def _open(path: str):
    """File system and path of a URI or an absolute local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit for every page."""
    plain = pages.select(
        pages[id_col].cast("long").alias("page_id"), F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(pages[html_col].cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    groups = plain.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    several = groups.where("n > 1").select("sha", "response")
    joined = plain.join(several, "sha", "left")
    revisit = F.coalesce(F.col("response") != F.col("page_id"), F.col("response").isNotNull() & F.col("page_id").isNull())
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("response")).alias("refers_to"), revisit.alias("revisit"))


MANIFEST = "archive string, records bigint, bytes bigint"


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write every row of plan_revisits' result below folder; the manifest of the archives, as stored rows."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        writer = path = None

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_pydict({"archive": [path], "records": [writer.records], "bytes": [writer.written]})

        for batch in batches:
            for page_id, url, payload, refers_to, revisit in zip(*(batch.column(c) for c in range(5)), strict=True):
                if writer is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    system.create_dir(root, recursive=True)
                    writer = ArchiveWriter(system.open_output_stream(path, compression=None))
                writer.add(build_record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py()))
                if writer.written >= ARCHIVE_BYTES:
                    yield closed()
                    writer = None
        if writer is not None:
            yield closed()

    return stored(planned.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, MANIFEST), "warc-manifest")


RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, block binary"


def read_archives(manifest: DataFrame, folder: str, with_blocks: bool = True) -> DataFrame:
    """One row a record of the manifest's archives; digests of responses are computed anew from their blocks."""
    folder = _uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for raw in read_archive(stream):
                        fields, block = parse_record(raw)
                        revisit, stated = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        digest, size = (stated, int(fields["X-Payload-Length"])) if revisit else (payload_digest(block), len(block))
                        if digest != stated:
                            raise ValueError(f"{path}: a payload does not have its stated digest")
                        target = _page_of(fields["WARC-Refers-To"]) if revisit else None
                        rows.append((_page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], target, digest, size, block if with_blocks else None))
                        held += len(block) + 200
                        if held >= 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    spark = manifest.sparkSession
    n = max(1, manifest.count())
    return manifest.repartition(min(n, 1 << 16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("archive")).select("archive").mapInArrow(run, RECORDS)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    manifest = write_archives(plan_revisits(read_table(spark, sf_dir, "pages")), folder)
    return read_archives(manifest, folder, with_blocks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS response FROM p GROUP BY payload),
d AS (SELECT page_id, payload, response, sha1(payload) AS h FROM p JOIN g USING (payload))
SELECT page_id, strlen(payload) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""
