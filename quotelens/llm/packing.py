"""Packing by minimum bin slack: every window is filled by a subset-sum over the lengths that remain.

Documents are tokenised once, where they are read, and become pieces (whole documents, or windows of
long ones). The plan needs only how many pieces of each length there are, at most ``capacity``
numbers. Each step takes the longest length left, finds by a bitset subset-sum the lengths whose sum
comes closest to the room, backtracks how many of each it took, and repeats that fill as often as
the counts allow; so a plan has few fills, however many windows it makes. Pieces then take their
places by rank within their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import read, stored

MODEL = "word_bpe_49k.json"
CAPACITY = 4096
END = 2
#: Runs kept per Python worker with their ids (about 150 MB).
TABLE = 600_000
#: Latin letters beyond ASCII in lower case.
LATIN = "ß-öø-ɏ"
#: How byte-level vocabularies show the bytes of UTF-8: printable ones as themselves, the rest from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SHOWN = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PLAIN)}
RANK_ROWS = 50_000


class Table(dict):
    """Ids of letter runs, digits and signs as the model's byte strings, filled on demand."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(SHOWN)
        ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        if len(self) >= TABLE:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Tokenizer:
    """Ids by the ``tokenizers`` library, with its normaliser and splitter spared where they are plain.

    The vocabulary's rules drop white space, lower the case and cut words into letter runs, single
    digits and runs of signs. For text of printable ASCII and Latin letters (all stable under NFC) those rules
    are the two expressions below, so the library's model is asked once for each distinct run. Words
    with any other character, or with a special token's string, go through the whole library.
    """

    #: Fixed values of the vocabulary file: contractions, then letters, a digit, or signs.
    RUNS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^ \\n\\t\\ra-z0-9{LATIN}]+")
    OTHER = re.compile(f"[^ -~\\n\\t\\r{LATIN}]|<\\|")

    def __init__(self, path: str):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.table = Table(self.library.model)

    def ids(self, text: str) -> bytes:
        """A text's ids as little-endian unsigned 32-bit numbers."""
        low = text.lower()
        if self.OTHER.search(low) is None:
            return b"".join(map(self.table.__getitem__, self.RUNS.findall(low)))
        return b"".join(map(self.word, text.replace("\n", " ").split(" ")))

    def word(self, word: str) -> bytes:
        low = word.lower()
        if self.OTHER.search(low) is None:
            return b"".join(map(self.table.__getitem__, self.RUNS.findall(low)))
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


_LOADED: dict[str, Tokenizer] = {}
_PIECES = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]


def _cutter(model: str, capacity: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _LOADED:
            _LOADED[model] = Tokenizer(model)
        tokenizer = _LOADED[model]
        for batch in batches:
            taken: list[int] = []
            rows: dict[str, list] = {n: [] for n, _ in _PIECES}
            for k, text in enumerate(batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    for name, v in zip(rows, (start, len(piece) // 4, zlib.crc32(piece), n)):
                        rows[name].append(v)
                    taken.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(rows[n], t) for n, t in _PIECES)],
                ["doc_id", *rows],
            )

    return run


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: a document, cut only where it exceeds a window."""
    rows = docs.select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], *(StructField(n, LongType()) for n, _ in _PIECES)])
    return rows.mapInArrow(_cutter(model, capacity, end), schema)


def subset_sum(lengths: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How many of each length make the largest sum up to ``room``; stops at the first exact fill."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in zip(lengths, counts):
        left = min(count, room // length)
        group = 1
        while left:
            take = min(group, left)
            wider = reach | (reach << (take * length)) & mask
            if wider != reach:
                steps.append((length, take, reach))
                reach = wider
            left -= take
            group *= 2
        if reach >> room:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + take
            total -= take * length
    return taken


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Fills (times, {length: count}) that use every piece once."""
    left = {n: c for n, c in histogram.items() if c}
    order = sorted(left, reverse=True)
    fills = []
    while order:
        longest = order[0]
        rest = [n for n in order if n <= capacity - longest]
        counts = [left[n] - (n == longest) for n in rest]
        fill = subset_sum(rest, counts, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[n] // c for n, c in fill.items())
        fills.append((times, fill))
        for n, c in fill.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
                order.remove(n)
    return fills


_PLACE = [("sequence_id", pa.int64()), ("offset", pa.int64())]


def slots(fills: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length its runs of slots: first rank, slots in each window, first window, offset in the window."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, fill in fills:
        offset = 0
        for length in sorted(fill, reverse=True):
            each, rank = fill[length], ranks.get(length, 0)
            runs.setdefault(length, []).append((rank, each, sequence, offset))
            ranks[length] = rank + each * times
            offset += each * length
        sequence += times
    return {n: np.array(r, np.int64) for n, r in runs.items()}


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(n)).to_numpy() for n in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                runs = table[int(n)]
                first, each, window, place = runs[np.searchsorted(runs[:, 0], rank[at], "right") - 1].T
                k = rank[at] - first
                sequence[at] = window + k // each
                offset[at] = place + k % each * n
            kept = [i for i, name in enumerate(names) if name != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(names[i] for i in kept), "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, model: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``model`` is the vocabulary's path on every executor. Null and empty texts hold the end id only;
    rows that repeat a doc_id are packed each; other columns are ignored; an empty table gives an
    empty result. Ranks within a length are made in two levels, as a length may belong to a third of
    all pieces: rows are numbered within (length, bucket), and the buckets' counts are added up. The
    plan's slots (at most a few per length and fill) go to every executor; their number depends on
    the capacity, not on the corpus.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, model, capacity, end))
    counted = cut.groupBy("length").count().collect()
    total = sum(r[1] for r in counted)
    shared = spark.sparkContext.broadcast(slots(plan({r[0]: r[1] for r in counted}, capacity)))
    buckets = max(1, total // RANK_ROWS)
    bucketed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (
        bucketed.withColumn("_n", F.row_number().over(within) - 1)
        .join(sizes, ["length", "_bucket"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_n") + F.col("_before")).alias("_rank"))
    )
    schema = StructType([*(f for f in ranked.schema if f.name != "_rank"), *(StructField(n, LongType()) for n, _ in _PLACE)])
    return ranked.mapInArrow(_placer(shared), schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
