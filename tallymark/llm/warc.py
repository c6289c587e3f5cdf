"""WARC archives with a Zstandard dictionary, written and read back by Spark tasks.

A task cuts its rows into archives of about ``ARCHIVE_BYTES``. It builds a
dictionary from the archive's records, puts it into a leading skippable frame and
compresses every record as a frame of its own, so that a record can be read alone
at its offset. Equal payloads are stored once: the others become revisit records.

Archives lie in the shared folder under names that belong to one task attempt. A
manifest, committed by Spark, lists those of the attempts that succeeded; files of
lost executors are not in it and are never read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import arrow_map
from tallymark.session import materialize, shared_folder

ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 65_536
# Payloads below this size are always stored.
REVISIT_BYTES = 1_000
LEVEL = 3
# The tables have no crawl time.
DATE = "1970-01-01T00:00:00Z"

# Magic number of the dictionary's frame, profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


# ---- records -------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without the payload when ``refers_to`` is given."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", digest),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return _header(fields) + block + END


def read_record(stream: io.BufferedIOBase) -> tuple[dict[str, str], bytes] | None:
    """Header fields and block of the next record; None at the end."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {line[:40]!r}")
    fields = {}
    while (line := stream.readline()) != b"\r\n":
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        fields[name] = value
    block = stream.read(int(fields["Content-Length"]))
    if stream.read(4) != END:
        raise ValueError("a record is cut short")
    return fields, block


def read_page(fields: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; a response is measured, a revisit quoted."""
    head, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    else:
        size = int(re.search(rb"(?i)^content-length: *(\d+)", head, re.M)[1])
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields.get("WARC-Refers-To")),
    }


# ---- archives ------------------------------------------------------------------


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> zstandard.ZstdCompressionDict:
    """A dictionary of the archive's records, at most a sixteenth of their size.

    Too few records to learn from give their last bytes as they are.
    """
    size = min(size, max(1024, sum(map(len, records)) // 16))
    try:
        return zstandard.train_dictionary(size, records, k=512, d=8, f=18, accel=4, split_point=1.0)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(records)[-size:] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    """Skippable frame with the dictionary, then a frame per record."""
    shared = dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True)
    data = shared.as_bytes()
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(data)), data, *map(packer.compress, records)])


def read_archive(file: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    shared = zstandard.ZstdCompressionDict(file.read(size))
    plain = zstandard.ZstdDecompressor(dict_data=shared).stream_reader(file, read_across_frames=True)
    stream = io.BufferedReader(plain, 1 << 18)
    while (found := read_record(stream)) is not None:
        yield found


def _store(base: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(base)


def _write_batches(batches, base: str, size: int) -> Iterator[pa.RecordBatch]:
    store, root = _store(base)
    attempt = uuid.uuid4().hex
    held, bytes_held, made = [], 0, 0

    def close() -> pa.RecordBatch:
        name = f"{attempt}-{made:05d}.warc.zst"
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(archive(held))
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], names=["file", "records"])

    for batch in batches:
        for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(record(page_id, url, (html or "").encode(), refers_to))
            bytes_held += len(held[-1])
            if bytes_held >= size:
                yield close()
                held, bytes_held, made = [], 0, made + 1
    if held:
        yield close()


def _read_batches(batches, base: str) -> Iterator[pa.RecordBatch]:
    store, root = _store(base)
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()], names=list(kinds))

    rows: list[dict] = []
    for batch in batches:
        for name in batch.column(0).to_pylist():
            with store.open_input_stream(f"{root}/{name}") as file:
                for fields, block in read_archive(file):
                    rows.append(read_page(fields, block))
                    if len(rows) >= 5000:
                        yield batch_of(rows)
                        rows = []
    if rows:
        yield batch_of(rows)


def _qualified(spark: SparkSession, path: str) -> str:
    """The folder as a uri that names its store, made if it is not there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    return re.sub(r"^file:/(?!/)", "file:///", str(store.makeQualified(at).toUri().toString()))


def record_kinds(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to (null for what is stored as a response)."""
    pages = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "coalesce(CAST(html AS STRING), '') AS html")
    content = F.sha2(F.col("html").cast("binary"), 256)
    large = F.octet_length("html") >= least
    groups = pages.where(large).groupBy(content.alias("content")).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    # Stored first, so that its size is known: pages move only if it is too large to broadcast.
    repeated = materialize(groups.where("n > 1 AND response IS NOT NULL").select("content", "response"), "warc-repeated")
    # Small pages have no partner; keys of their own keep them from meeting in one task.
    alone = F.concat_ws("-", F.lit("small"), F.xxhash64("page_id", "url").cast("string"), F.spark_partition_id().cast("string"))
    found = pages.withColumn("content", F.when(large, content).otherwise(alone)).join(repeated, "content", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return found.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, size: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """The archives' folder and the manifest (file, records) of the pages.

    Of payloads of at least ``REVISIT_BYTES`` that are equal, the page with the
    largest page_id is stored (every row that repeats that id), the others revisit
    it; groups of null ids alone are stored. Null html is an empty payload; null urls
    have no target; an empty table gives no archive; other columns are not read.
    """
    spark = pages.sparkSession
    base = _qualified(spark, shared_folder(spark, "warc"))
    written = arrow_map(record_kinds(pages), __name__, "_write_batches", "file string, records bigint", base, size)
    return base, materialize(written, "warc-manifest")


def read_archives(base: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the manifest's archives, measured from the files."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return arrow_map(
        manifest.select("file").repartition(parts, "file"),
        __name__,
        "_read_batches",
        "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
        base,
    )


def records_of(archives: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    for data in archives:
        yield from read_archive(io.BytesIO(data))
