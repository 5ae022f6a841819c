"""Shared helpers: the scratch folder all executors reach, stored tables, text as bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame once as parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(frame: DataFrame, name: str = "_row") -> DataFrame:
    """The frame, stored, with a number of its own for each row; only what is stored has numbers that stay."""
    return stored(frame.withColumn(name, F.monotonically_increasing_id()))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


#: Files of a bucketed table; chunks beyond share files.
TABLE_FILES = 10_000


def dealt(frame: DataFrame, chunks: int) -> DataFrame:
    """The frame with a column ``chunk``, in a table bucketed by it: grouping by chunk needs no further shuffle.

    Rows are dealt out by their number, so equal rows don't meet in one chunk. The table's name is
    dropped at once; its files stay in the scratch folder.
    """
    spark = frame.sparkSession
    files, name = min(chunks, TABLE_FILES), f"llm_chunks_{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("long")
    rows = frame.withColumn("chunk", number).repartition(files, "chunk")
    rows.write.bucketBy(files, "chunk").option("path", scratch_folder(spark)).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # analysed while the name is there
    spark.sql(f"DROP TABLE {name}")
    return table


#: Rows of a few numbers each that may be broadcast (about 64 MB); larger tables are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def small(frame: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast if a count shows that it has at most ``limit`` rows."""
    return F.broadcast(frame) if frame.count() <= limit else frame


#: A key with more rows than this is joined by broadcast, apart from the others.
HOT_ROWS = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str, how: str = "inner") -> DataFrame:
    """Join on a key of ``right`` whose column ``rows`` says how many rows of ``left`` have it.

    Rows of hot keys stay where they are; only the others are shuffled. There is at most one hot key for
    every ``HOT_ROWS`` rows; should they be too many to broadcast, adaptive execution splits them.
    """
    hot = right.where(F.col(rows) > HOT_ROWS)
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return left.join(right, key, how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col(rows) <= HOT_ROWS), key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)


def text_bytes(column: str = "text"):
    """UTF-8 length of a text; null counts as empty."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def blocks(frame: DataFrame, rows_per_block: int) -> int:
    """How many blocks of at most about so many rows a frame needs."""
    return max(1, -(-frame.count() // rows_per_block))


#: ASCII to word bytes: A-Z in lower case, 0-9 and a-z as they are, all else a space; bytes from 128 on stay.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random odd 64-bit value for each byte, for polynomial fingerprints."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Fingerprints:
    """Fingerprints of any span of a byte array from prefix sums of value * base^i, modulo 2^64."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))

    def __init__(self, data: np.ndarray, values: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        self.back = powers(self.INVERSE, n + 1)
        with np.errstate(over="ignore"):
            np.cumsum(values[data] * powers(self.BASE, n), out=self.sums[1:])

    def rolling(self, width: int) -> np.ndarray:
        """Fingerprints of all spans of one width, in order of their starts."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:n]) * self.back[:n] + np.uint64(width) * np.uint64(0xD6E8FEB86659FD93))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[end] - self.sums[start]) * self.back[start]
            return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the longest n seen."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.ones(max(n, 1 << 16), dtype=np.uint64)
        known[1:] = base
        with np.errstate(over="ignore"):
            np.cumprod(known, out=known)
        _POWERS[int(base)] = known
    return known[:n]


def slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive items whose lengths add up to about ``limit`` at most; a longer item goes alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
