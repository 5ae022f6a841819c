"""Extendible hashing: shards named by hash-prefix bits, split only where they exceed a byte limit.

The directory is a table, not a driver object: sizes are added up per cell of the finest prefix in
use, each cell takes the shortest prefix whose whole bucket fits, and rows find their bucket by an
equi-join on the cell. Only buckets that no prefix up to that depth makes small enough go on to a
next round with more bits. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored, text_bytes

KEY_BITS = 40
ROW_BITS = 20
ROUND_BITS = 8
LIMIT = 64 << 20


def _hash_bits(key, bits: int = KEY_BITS):
    return F.conv(F.substring(F.md5(key), 1, bits // 4), 16, 10).cast("long")


def _bits(value, width):
    """The ``width`` lowest bits of a number as text; empty for no bits."""
    return F.when(width == 0, F.lit("")).otherwise(F.lpad(F.bin(value), width, "0"))


def _directory(rows: DataFrame, bits: int, depth: int, floor: int, limit: int) -> DataFrame:
    """One row per cell of ``depth`` bits: its bucket's depth (null: no bucket fits yet), prefix and bytes."""
    cells = rows.groupBy(F.shiftrightunsigned("_hash", bits - depth).alias("_cell")).agg(F.sum("_bytes").alias("_bytes"))
    levels = cells.select("_cell", "_bytes", F.explode(F.sequence(F.lit(floor), F.lit(depth))).alias("depth")).withColumn(
        "_prefix", F.expr(f"shiftrightunsigned(_cell, {depth} - depth)")
    )
    sums = levels.groupBy("depth", "_prefix").agg(F.sum("_bytes").alias("shard_bytes"))
    fits = levels.select("_cell", "depth", "_prefix").join(sums.where(F.col("shard_bytes") <= limit), ["depth", "_prefix"])
    leaf = fits.groupBy("_cell").agg(F.min(F.struct("depth", "_prefix", "shard_bytes")).alias("_leaf"))
    return cells.select("_cell").join(leaf, "_cell", "left").select("_cell", "_leaf.depth", "_leaf._prefix", "_leaf.shard_bytes")


def _rounds(rows: DataFrame, bits: int, floor: int, limit: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Frames of placed rows, and the rows that even all bits leave in an oversized bucket."""
    total = rows.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    depth = max(floor, min(bits, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4))
    placed = []
    while True:
        directory = stored(_directory(rows, bits, depth, floor, limit))
        found = rows.withColumn("_cell", F.shiftrightunsigned("_hash", bits - depth)).join(directory, "_cell")
        placed.append(found.where("depth is not null").drop("_cell"))
        if directory.where("depth is null").isEmpty():
            return placed, None
        rows = stored(found.where("depth is null").drop("_cell", "depth", "_prefix", "shard_bytes"))
        if depth == bits:
            return placed, rows
        depth, floor = min(bits, depth + ROUND_BITS), depth + 1


_WORKING = ("_bytes", "_hash", "_cell", "_prefix", "_place", "_n", "_leaf")


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_bytes``, ``shard`` (its bits as text), ``depth``, ``shard_bytes`` and ``oversized`` to every row.

    The hash is MD5 of the key as text, so shards don't depend on the other columns or on row order.
    A shard's bits say which rows it holds; a bucket is split on its next bit only when its rows
    exceed ``limit`` bytes. Defined cases: a null key hashes by its text; a null text has no bytes;
    rows that share a key (beyond 40 equal bits) are split on further bits taken from their place in
    a stored table; a row larger than the limit can't share and gets a shard of its own, named
    ``big-<key>-<n>`` and marked oversized. Columns of the input with the names of added columns are
    replaced; other columns are kept, whatever their names. More rows of one key than 20 further bits
    can part raise a ValueError. An empty input gives an empty result.
    """
    added = ("n_bytes", "shard", "depth", "shard_bytes", "oversized")
    base = docs.drop(*added)
    # Columns that have the names of working columns step aside meanwhile.
    aside = {c: f"_aside{i}_of_{len(base.columns)}{c}" for i, c in enumerate(base.columns) if c.lower() in _WORKING}
    base, key, text = base.withColumnsRenamed(aside), aside.get(key, key), aside.get(text, text)
    known = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = base.withColumns({"_bytes": text_bytes(text), "_hash": _hash_bits(known)})
    big = (
        rows.where(F.col("_bytes") > limit)
        .withColumn("_n", F.row_number().over(Window.partitionBy("_hash").orderBy("_bytes")))
        .withColumns(
            {
                "shard": F.concat(F.lit("big-"), known, F.lit("-"), F.col("_n").cast("string")),
                "depth": F.lit(KEY_BITS),
                "shard_bytes": F.col("_bytes"),
                "oversized": F.lit(True),
            }
        )
        .drop("_n")
    )
    parts, rest = _rounds(rows.where(F.col("_bytes") <= limit), KEY_BITS, 0, limit)
    placed = [p.withColumn("shard", _bits(F.col("_prefix"), F.col("depth"))) for p in parts]
    if rest is not None:
        # Rows with one key: their key bits go first, then bits of the place each has in the stored table.
        place = stored(rest.withColumn("_place", F.monotonically_increasing_id()))
        row_bits = _hash_bits(F.col("_place").cast("string"), ROW_BITS)
        longer = place.withColumn("_hash", F.shiftleft("_hash", ROW_BITS) + row_bits).drop("_place")
        parts, crowded = _rounds(longer, KEY_BITS + ROW_BITS, KEY_BITS, limit)
        if crowded is not None:
            raise ValueError("more equal keys than row bits can separate; raise the limit")
        placed += [p.withColumn("shard", _bits(F.col("_prefix"), F.col("depth"))) for p in parts]
    out = [p.withColumn("oversized", F.lit(False)) for p in placed] + [big]
    columns = [*base.columns, F.col("_bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", "oversized"]
    result = out[0].select(*columns)
    for part in out[1:]:
        result = result.unionByName(part.select(*columns))
    return result.withColumnsRenamed({new: old for old, new in aside.items()})


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write every shard as a folder ``shard=bits-<bits>`` of parquet files, of at most ``limit`` bytes of text.

    The word before the bits keeps readers from taking them for a number.
    """
    assigned = assign_shards(docs, **options).withColumn("shard", F.concat(F.lit("bits-"), "shard"))
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)


def op10_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).drop("text")


SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))), 1, 10) AS BIGINT) AS h
  FROM documents
), small AS (SELECT * FROM d WHERE n_bytes <= {LIMIT}),
levels AS (SELECT h >> ({KEY_BITS} - g.depth) AS prefix, g.depth, sum(n_bytes) AS total
           FROM small, generate_series(0, {KEY_BITS}) AS g(depth) GROUP BY ALL),
leaf AS (SELECT doc_id, n_bytes, h, min(depth) AS depth
         FROM small, generate_series(0, {KEY_BITS}) AS g(depth)
         JOIN levels USING (depth) WHERE levels.prefix = h >> ({KEY_BITS} - depth) AND total <= {LIMIT} GROUP BY ALL)
SELECT doc_id, n_bytes,
       CASE WHEN l.depth = 0 THEN '' ELSE lpad(bin(l.h >> ({KEY_BITS} - l.depth)), CAST(l.depth AS INTEGER), '0') END AS shard,
       CAST(l.depth AS INTEGER) AS depth, CAST(v.total AS BIGINT) AS shard_bytes, false AS oversized
FROM leaf l JOIN levels v ON v.depth = l.depth AND v.prefix = l.h >> ({KEY_BITS} - l.depth)
"""
