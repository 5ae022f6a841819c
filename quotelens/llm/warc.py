"""WARC archives with an index: records are written once, found by byte range, read back by coalesced ranges.

Executors write gzip-per-record archives through the file system that the folder's URI names, and
every task returns the index rows of what it wrote: file, offset, length, URL and digest. Only files
that the stored index names exist for a reader, so a task that was repeated or ran twice leaves an
unread file and nothing wrong. Reading takes any selection of index rows, sorts them by place, joins
near ranges into one read and cuts the records out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import read, scratch_folder, stored

MIN_REVISIT = 100
SALTS = 32
FILE_BYTES = 256 << 20
GAP = 64 << 10
RANGE_BYTES = 8 << 20
_FIELDS = [("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("record_type", pa.string())]
_INDEX = StructType([StructField(n, LongType() if t == pa.int64() else StringType()) for n, t in _FIELDS])
_READ = StructType(
    [
        StructField("record_id", StringType()),
        StructField("payload_bytes", LongType()),
        StructField("payload_digest", StringType()),
        StructField("record_type", StringType()),
        StructField("refers_to", StringType()),
    ]
)


def _clean(value: str) -> str:
    """Control characters can't stand in a header line; they are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the digest and length of its payload, not the payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{_clean(record_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{_clean(refers_to)}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of a record; raises on a record that isn't whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record length doesn't agree with its header")
    return fields, rest[:size]


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows: dict[str, list] = {n: [] for n, _ in _FIELDS}
            for record_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                whole = record(record_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py())
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(whole) + packer.flush()
                out.write(member)
                kind = "response" if refers_to.as_py() is None else "revisit"
                for n, v in zip(rows, (url.as_py(), name, at, len(member), digest.as_py(), kind)):
                    rows[n].append(v)
                at += len(member)
                if at >= file_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(_FIELDS))
        if out is not None:
            out.close()

    return run


def _reader(folder: str, gap: int, range_bytes: int):
    """Index rows sorted by file and offset in; one row per record out."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        name, run = None, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if run and (file != name or offset - sum(run[-1]) > gap or offset + length - run[0][0] > range_bytes):
                    yield name, run
                    run = []
                name = file
                run.append((offset, length))
        if run:
            yield name, run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        opened, source = None, None
        for name, places in ranges(batches):
            if name != opened:
                if source is not None:
                    source.close()
                opened, source = name, store.open_input_file(f"{root}/{name}")
            start = places[0][0]
            data = source.read_at(sum(places[-1]) - start, start)
            rows: list[tuple] = []
            for offset, length in places:
                fields, body = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    size = len(body)
                    if hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                else:
                    size = int(fields["WARC-Payload-Length"])
                bare = lambda key, f=fields: f[key][len("<urn:page:") : -1] if key in f else None
                rows.append((bare("WARC-Record-ID"), size, digest, kind, bare("WARC-Refers-To")))
            yield pa.RecordBatch.from_pydict(dict(zip(_READ.names, map(list, zip(*rows)))), schema=_READ_ARROW)
        if source is not None:
            source.close()

    return run


_READ_ARROW = pa.schema([(f.name, pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for f in _READ])


def capture(pages: DataFrame) -> DataFrame:
    """Records to write: record_id, url, payload, digest, refers_to.

    Of pages with equal payloads of at least 100 bytes the smallest page_id is the response, the
    others revisit it. Groups are found on digests alone, added up before the shuffle; pages then
    meet their group on digest and one of 32 salts, so a payload that a third of all pages share is
    spread. Null html is an empty payload. A null page_id is a response, with id "null". Rows that
    repeat page_id and payload are the same capture: all of them are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= MIN_REVISIT)
    first = large.groupBy("digest").agg(F.min("page_id").alias("_first"), F.max("page_id").alias("_last"))
    # Only digests of several pages are joined.
    first = first.where(F.col("_first") < F.col("_last")).select("digest", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["digest", "_salt"], "left")
    return joined.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("record_id"),
        "url",
        F.encode("html", "UTF-8").alias("payload"),
        "digest",
        F.when(F.col("page_id") > F.col("_first"), F.col("_first").cast("string")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records to archives in ``folder`` and return the stored index: url, file, offset, length, digest, record_type."""
    columns = ["record_id", "url", "payload", "digest", "refers_to"]
    return stored(records.select(*columns).mapInArrow(_writer(folder, file_bytes), _INDEX))


def read_records(index: DataFrame, folder: str, gap: int = GAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records at the given index rows, each checked against its digest.

    Rows are gathered by file and stretch of ``range_bytes``, sorted by place; ranges closer than
    ``gap`` become one read of at most ``range_bytes`` (one record at least).
    """
    stretch = F.floor(F.col("offset") / range_bytes)
    placed = index.select("file", "offset", "length").repartition("file", stretch).sortWithinPartitions("file", "offset")
    return placed.mapInArrow(_reader(folder, gap, range_bytes), _READ)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    folder = scratch_folder(spark)
    folder = folder if "://" in folder else f"file://{folder}"
    index = write_archives(capture(pages), folder)
    kind = pages.schema["page_id"].dataType
    page = F.when(F.col("record_id") != "null", F.col("record_id")).cast(kind)
    return read_records(index, folder).select(
        page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id > first THEN first END AS refers_to
FROM f
"""
