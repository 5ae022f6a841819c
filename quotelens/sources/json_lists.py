"""The items of JSON lists, cut across partitions by byte range.

Spark splits a text file at any character, so a list is read in pieces between closing braces. Whether a
piece begins inside a string, and how deep, follows from running counts of quotes and of brackets outside
strings. Tasks take them over chunks of neighbouring pieces, both for a chunk that begins outside a string
and for one that begins inside, and store them beside the pieces; one small row per chunk then tells which holds and how
deep the chunk begins. An item ends where a brace closes at the depth of the list. A piece between two such braces is
a whole item and is not shuffled; only items of several pieces are grouped. No task holds more than one chunk or one item.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotelens.session import materialise

QUOTE, ESCAPE = ord('"'), ord("\\")
_WEIGHT = np.zeros(256, np.int64)
_WEIGHT[[ord("["), ord("{")]], _WEIGHT[ord("]")] = 1, -1
_SPECIAL = _WEIGHT != 0
_SPECIAL[[QUOTE, ESCAPE]] = True

_BLOCK = 1 << 20

_STATE = "_file string, _start long, _size long, _bytes long, _kind string, quotes long, depth_plain long, depth_quoted long"
_MEASURED = f"_chunk long, _place long, value string, plain int, plain_prior int, plain_rank int, quoted int, quoted_prior int, quoted_rank int, _state struct<{_STATE.replace(' ', ':').replace(',:', ',')}>"
_STATE_TYPE = pa.struct([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (f.split(" ") for f in _STATE.split(", "))])


def _specials(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, characters) of all quotes and brackets that no backslash of their piece escapes."""
    at = np.flatnonzero(_SPECIAL[data])
    found = data[at]
    slashes = at[found == ESCAPE]
    if not len(slashes):
        return at, found
    piece = np.searchsorted(offsets, slashes, side="right") - 1
    begins = np.flatnonzero(np.r_[True, (np.diff(slashes) != 1) | (np.diff(piece) != 0)])
    lengths = np.diff(np.r_[begins, len(slashes)])
    last = (begins + lengths - 1)[lengths % 2 == 1]
    escaped = slashes[last] + 1
    escaped = escaped[escaped < offsets[piece[last] + 1]]
    kept = (found != ESCAPE) & ~np.isin(at, escaped)
    return at[kept], found[kept]


def _ranks(levels: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """For every closing piece, how many pieces up to it close at its level."""
    ranks, closing = np.zeros(len(levels), np.int64), np.flatnonzero(closes)
    order = closing[np.argsort(levels[closing], kind="stable")]
    new = np.flatnonzero(np.diff(levels[order], prepend=levels[order[:1]] - 1))
    ranks[order] = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)])) + 1
    return ranks


def _measure(values: pa.Array) -> tuple[list[pa.Array], dict[str, int]]:
    """Per piece of a chunk: the level its brace closes at (null inside a string), that of the piece before, its rank; and the chunk's totals."""
    values = values.cast(pa.large_string())
    _, ends, text = values.buffers()
    offsets = np.frombuffer(ends, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(text, np.uint8)[offsets[0] : offsets[-1]] if text is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    at, found = _specials(data, offsets)
    upto = np.searchsorted(at, offsets[1:])
    seen = np.r_[0, np.cumsum(found == QUOTE)]
    columns, totals = [], {"quotes": int(seen[-1]), "_bytes": int(offsets[-1]) + len(values)}
    for name, inside in (("plain", 0), ("quoted", 1)):
        opened = np.r_[0, np.cumsum(_WEIGHT[found] * (seen[:-1] % 2 == inside))][upto]
        closes = seen[upto] % 2 == inside
        closed = np.cumsum(closes)
        levels = opened - closed + closes
        totals[f"depth_{name}"] = int(opened[-1] - closed[-1])
        prior = pa.array(np.r_[0, levels[:-1]], pa.int32(), mask=np.r_[True, ~closes[:-1]])
        columns += [pa.array(levels, pa.int32(), mask=~closes), prior, pa.array(_ranks(levels, closes), pa.int32())]
    return columns, totals


def _measured(batches):
    known = None
    for batch in batches:
        files, starts, sizes, places, values = batch.columns
        changed = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(starts[1:], starts[:-1])).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)] if len(batch) else []
        for low, high in zip(cuts, cuts[1:]):
            size, chunk = high - low, values[low:high]
            columns, totals = _measure(chunk)
            now = (files[low].as_py(), starts[low].as_py())
            first = re.match(r"[ \t\n\x0b\f\r﻿]*(.?)", chunk[0].as_py()) if now[1] == 0 and now != known else None
            known = now
            state = {"_file": now[0], "_start": now[1], "_size": sizes[low].as_py(), "_kind": first and first[1], **totals}
            states = pa.concat_arrays([pa.nulls(size - 1, _STATE_TYPE), pa.array([state], _STATE_TYPE)])
            mark = pa.repeat(places[low], size)
            names = ["_chunk", "_place", "value", "plain", "plain_prior", "plain_rank", "quoted", "quoted_prior", "quoted_rank", "_state"]
            yield pa.RecordBatch.from_arrays([mark, places[low:high], chunk.cast(pa.string()), *columns, states], names=names)


def _chunk_states(pieces: DataFrame) -> DataFrame:
    """One row per chunk: how it begins, the level at which its items end, and the items before it; refuses files by their counts."""
    order = Window.partitionBy("_file").orderBy("_start", "_chunk")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_file")

    def before(column):
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    chunks = pieces.where(F.col("_state").isNotNull()).select("_chunk", "_state.*")
    chunks = chunks.withColumn("_quoted", before("quotes") % 2 == 1)
    chunks = chunks.withColumn("_depth", F.when(F.col("_quoted"), F.col("depth_quoted")).otherwise(F.col("depth_plain")))
    # Each piece but a file's last ends with a brace; lengths tell whether the last one does too. A leading mark of 3 bytes is not read.
    braced = F.pmod(F.sum("_bytes").over(whole) - F.col("_size"), F.lit(3)) == 0
    listed = F.coalesce((F.max("_kind").over(whole) == "[").cast("int"), F.lit(0))
    chunks = chunks.select("_chunk", "_file", "_start", "_quoted", before("_depth").alias("_deep"), listed.alias("_list"), braced.alias("_braced"))
    chunks = materialise(chunks.withColumn("_level", F.col("_list") + 1 - F.col("_deep")).drop("_deep"))

    marked = _ending(pieces.join(chunks.select("_chunk", "_quoted", "_level"), "_chunk"))
    ends, first = F.col("_ends"), F.col("_place") == F.col("_chunk")
    counts = marked.groupBy("_chunk").agg(
        F.count_if(ends).alias("_items"),
        F.count_if(ends & F.col("_follows")).alias("_inner"),
        F.max(F.when(first, ends)).alias("_first"),
        F.max_by("_ends", "_place").alias("_last"),
    )
    states = chunks.join(counts, "_chunk").withColumn("_joined", F.coalesce(F.lag("_last").over(order), F.lit(True)))
    states = states.withColumn("_pieced", F.col("_items") - F.col("_inner") - (F.col("_first") & F.col("_joined")).cast("int"))
    states = states.withColumns({"_items_before": before("_items"), "_pieced_before": before("_pieced")})

    last = F.max_by("_last", F.struct("_start", "_chunk"))
    # A list has one bracket after its last item; a lone object is one item, closed in the file.
    right = F.when(F.max("_list") == 1, ~last).otherwise((F.sum("_items") == 1) & (F.bool_and("_braced") | ~last))
    files = states.groupBy("_file").agg(F.sum("_items").alias("_all"), right.alias("_right"))
    # One row per file.
    over = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    total = F.when(F.col("_right"), F.coalesce(F.sum("_all").over(over), F.lit(0))).otherwise(_refused("long"))
    files = files.select("_file", "_all", total.alias("_files_before"))
    kept = ["_chunk", "_file", "_start", "_quoted", "_level", "_list", "_joined", "_items_before", "_pieced_before", "_files_before", "_all"]
    return materialise(states.join(files, "_file").select(*kept))


def _ending(pieces: DataFrame) -> DataFrame:
    """Whether a piece ends an item, whether the piece before it in its chunk does, and its number among the chunk's items if it does."""

    def of(name):
        return F.when(F.col("_quoted"), F.col(f"quoted{name}")).otherwise(F.col(f"plain{name}"))

    def level(name):
        return F.coalesce(of(name) == F.col("_level"), F.lit(False))

    return pieces.withColumns({"_ends": level(""), "_follows": level("_prior"), "_rank": of("_rank")})


def _refused(kind: str):
    return F.raise_error(F.concat(F.lit("not a JSON list or object: "), "_file")).cast(kind)


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _start, _place, _number, item): the objects of one list per file, or a file's single object, as text.

    ``_start`` and ``_place`` give the order inside a file, ``_number`` counts from 0 over all files by name. Anything else
    than one list of objects or one object is an error that names the file; a file without any character has no items.
    """
    read = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_place"),
        "value",
    )
    # Ranges far below a block share files; larger ones keep a file each.
    length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).head()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, length // _BLOCK)
    stored = materialise(read.mapInArrow(_measured, _MEASURED).coalesce(files))
    pieces = _ending(stored.drop("_state").join(_chunk_states(stored), "_chunk"))
    alone = F.col("_ends") & F.when(F.col("_place") == F.col("_chunk"), F.col("_joined")).otherwise(F.col("_follows"))
    number = F.col("_items_before") + F.col("_rank") - 1
    kept = ["_file", "_start", "_place", "_list", "_files_before"]
    wholes = pieces.where(alone).select(*kept, number.alias("_before"), F.col("value").alias("_text"))

    inside = Window.partitionBy("_chunk").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.where(~alone).withColumn("_item", F.col("_pieced_before") + F.count_if("_ends").over(inside))
    texts = F.array_sort(F.collect_list(F.struct("_start", "_place", "value")))
    # Behind a file's last item come pieces that end none.
    before = F.coalesce(F.max(F.when(F.col("_ends"), number)), F.max("_all"))
    grouped = parts.groupBy("_file", "_list", "_files_before", "_item").agg(before.alias("_before"), F.max("_ends").alias("_whole"), texts.alias("_parts"))
    begin, text = F.col("_parts")[0], F.array_join(F.col("_parts")["value"], "}")
    joined = grouped.select("_file", begin["_start"].alias("_start"), begin["_place"].alias("_place"), "_list", "_files_before", "_before", "_whole", text.alias("_text"))

    # Literal patterns, so that each is compiled once.
    first, text = F.col("_before") == 0, F.col("_text")
    begins = F.when(~first, F.regexp(text, F.lit(r"^\s*,\s*\{")))
    begins = begins.when(F.col("_list") == 1, F.regexp(text, F.lit(r"^[\s\x{FEFF}]*\[\s*\{"))).otherwise(F.regexp(text, F.lit(r"^[\s\x{FEFF}]*\{")))
    rest = F.when(F.col("_list") == 0, F.regexp(text, F.lit(r"^\s*$")))
    rest = rest.when(~first, F.regexp(text, F.lit(r"^\s*\]\s*$"))).otherwise(F.regexp(text, F.lit(r"^[\s\x{FEFF}]*\[\s*\]\s*$")))
    whole = F.when(begins, F.concat(F.substr(text, F.instr(text, "{")), F.lit("}"))).otherwise(_refused("string"))
    named = ["_file", "_start", "_place", (F.col("_files_before") + F.col("_before")).alias("_number")]
    shown = F.when(F.col("_whole"), whole).when(~rest, _refused("string"))
    return wholes.select(*named, whole.alias("item")).unionByName(joined.select(*named, shown.alias("item")).where(F.col("item").isNotNull()))
