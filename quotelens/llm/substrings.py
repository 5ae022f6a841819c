"""Exact removal of repeated substrings by prefix-free parsing.

A rolling hash over 12 bytes picks triggers; phrases run from one trigger to the next and overlap by
the trigger, so no phrase's suffix is a prefix of another and equal text is parsed equally wherever it
stands. A string of ``length`` bytes is then a suffix of a phrase followed by a stretch of the parse,
and everything that a suffix order of the corpus would say about repeats is asked in that order, from
the dictionary down to single positions:

1. dictionary: phrases that occur once in the corpus rule out every string that holds them whole;
2. parse suffixes: the strings whose first trigger is the same lie in one stretch from the phrase's
   start to ``length`` bytes past the trigger; a repeated stretch settles all of them at once, and
   one place is elected to stand for it below;
3. suffixes: the strings that are left, and those of elected stretches, are compared one by one.

Only equality of suffixes up to ``length`` bytes is needed, so each level is sorted by fingerprints
within buckets, not by letters across the corpus. A fingerprint mixes three polynomials over the field
of 2^31 - 1 elements with independent random bases, so no pattern of bytes makes different strings
agree: two given strings of n bytes do with a chance of (n / 2^31)^3 at most, 2^-69 for 230 bytes;
what travels is 64 bits beside those that choose the bucket. Every chunk of documents sends each bucket a sorted list without repeats (so a
passage that millions of documents share is at most one entry per chunk), and gets back two bits per
entry: whether another chunk has it, and whether this chunk is the one elected. Texts are dealt out
to chunks once, in a bucketed table that all levels read without a further shuffle.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import Fingerprints, byte_values, dealt, mix, read, slices, stored, total_bytes

LENGTH = 200
TRIGGER, MODULUS = 12, 24
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
#: Texts are parsed in stretches whose arrays fit a processor's cache.
STRETCH, MARGIN = 1 << 17, 4096
_TRIGGER, _ODD = byte_values(21), 0xD6E8FEB86659FD93
PRIME = (1 << 31) - 1
#: Random bases, drawn once and for all.
BASES = [int(b) for b in np.random.default_rng(2161).integers(1 << 16, PRIME - 1, 3)]
LISTS = StructType([StructField("bucket", LongType()), StructField("chunk", LongType()), StructField("level", IntegerType()), StructField("entries", BinaryType())])
MARKS = StructType([*LISTS.fields[:3], StructField("shared", BinaryType()), StructField("elected", BinaryType())])
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Stretch(NamedTuple):
    """Bytes parsed together: whole documents, or a part of a long one with its margins.

    ``docs``: (number in the chunk, offset in the document of the first byte here, start, end here).
    Only strings and phrases that start in [low, high) belong to this stretch.
    """

    data: np.ndarray
    docs: list[tuple[int, int, int, int]]
    low: int
    high: int


def stretches(texts: list[bytes], length: int):
    """Cut a chunk's documents of at least ``length`` bytes into stretches of bounded size."""
    long = [i for i, t in enumerate(texts) if len(t) >= length]
    for a, b in slices([len(texts[i]) for i in long], STRETCH):
        if len(texts[long[a]]) <= STRETCH:
            at, docs = 0, []
            for i in long[a:b]:
                docs.append((i, 0, at, at + len(texts[i])))
                at += len(texts[i])
            yield Stretch(np.frombuffer(b"".join(texts[i] for i in long[a:b]), np.uint8), docs, 0, at)
        else:
            text = texts[long[a]]
            for s in range(0, len(text), STRETCH):
                first, last = max(0, s - MARGIN), min(len(text), s + STRETCH + length + MARGIN)
                part = np.frombuffer(text, np.uint8, last - first, first)
                yield Stretch(part, [(long[a], first, 0, len(part))], s - first, min(s + STRETCH, len(text)) - first)


def reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo 2^31 - 1."""
    for _ in range(2):
        x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


_TABLES: dict[int, np.ndarray] = {}


def field_powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) in the field; the longest table asked for is kept."""
    known = _TABLES.get(base)
    if known is None or len(known) < n:
        known = np.ones(1, np.uint64)
        while len(known) < n:
            known = np.concatenate([known, reduced(known * np.uint64(pow(base, len(known), PRIME)))])
        _TABLES[base] = known
    return known[:n]


class FieldFingerprints:
    """Polynomials of any span of a byte array over the field, one for each base.

    Prefix sums cannot overflow: a byte times 31 bits, a stretch long. A span is brought to one place by
    multiplying with base^(room - start), the same ``room`` for all.
    """

    def __init__(self, data: np.ndarray, room: int):
        if len(data) > room or room >= 1 << 22:
            raise ValueError("a stretch is longer than its room")
        self.room = room
        byte = data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base in BASES:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(byte * field_powers(base, room + 1)[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        shift = self.room - start
        return [reduced(reduced(s[end] - s[start]) * field_powers(base, self.room + 1)[shift]) for base, s in zip(BASES, self.sums)]


def triggers(data: np.ndarray) -> np.ndarray:
    """For each window of TRIGGER bytes whether it triggers: one in MODULUS does, by a rolling polynomial."""
    rolling = Fingerprints(data, _TRIGGER)
    n = max(0, len(data) - TRIGGER + 1)
    with np.errstate(over="ignore"):
        place = (rolling.sums[TRIGGER:] - rolling.sums[:n]) * rolling.back[:n] * np.uint64(_ODD)
    return place < np.uint64(2**64 // MODULUS)


class Parse:
    """Triggers, phrases and the strings' place among them, for one stretch."""

    def __init__(self, stretch: Stretch, length: int, buckets: int):
        self.stretch, self.length, self.buckets = stretch, length, buckets
        data, n = stretch.data, len(stretch.data)
        self._fields: FieldFingerprints | None = None
        ends = np.array([d[3] for d in stretch.docs])
        starts = np.array([d[2] for d in stretch.docs])
        sizes = ends - starts
        # Places fit 32 bits, as a stretch is bounded; fingerprints are what takes the memory.
        self.doc_end = np.repeat(ends, sizes).astype(np.int32)
        fits = np.ones(n + 1, bool)
        # A trigger's window [t - TRIGGER, t) must not reach over a document's start; at t = start it ends the document before.
        for k in range(1, TRIGGER):
            fits[np.minimum(starts + k, n)] = False
        fits[:TRIGGER] = False
        hit = np.zeros(n + 1, bool)
        hit[TRIGGER:] = triggers(data)
        hit &= fits
        self.at = np.flatnonzero(hit)
        until = np.cumsum(hit, dtype=np.int32)
        owner = np.searchsorted(ends, self.at, "left")
        self.joined = owner[1:] == owner[:-1]
        # Strings of this stretch, their first trigger inside and their last.
        span = np.arange(stretch.low, min(stretch.high, max(0, n - length + 1)), dtype=np.int32)
        self.strings = span[span + length <= self.doc_end[span]] if len(span) else span
        self.inside = until[self.strings + TRIGGER - 1] if len(self.strings) else span
        self.last = until[self.strings + length] - 1 if len(self.strings) else span

    def entries(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and fingerprints of spans, two different mixtures of both polynomials and the length."""
        if self._fields is None:
            self._fields = FieldFingerprints(self.stretch.data, STRETCH + 2 * MARGIN + self.length)
        one, two, three = self._fields.of(start, end)
        with np.errstate(over="ignore"):
            # 93 bits and the length in two words, mixed in two ways.
            left, right = one | (two << np.uint64(32)), three | ((end - start).astype(np.uint64) << np.uint64(32))
            return (mix(right + mix(left)) % np.uint64(self.buckets)).astype(np.int64), mix(left ^ mix(right ^ np.uint64(_ODD)))

    def phrases(self) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Numbers of the phrases that belong here (by their start), and their entries for all phrases."""
        start, end = self.at[:-1] - TRIGGER, self.at[1:]
        mine = self.joined & (start >= self.stretch.low) & (start < self.stretch.high)
        return np.flatnonzero(mine), self.entries(start, end)

    def candidates(self, once: np.ndarray) -> np.ndarray:
        """Which strings hold no whole phrase that occurs once; ``once`` has a flag for each phrase."""
        before = np.concatenate([[0], np.cumsum(once & self.joined)])
        several = self.last > self.inside
        out = ~several
        a, b = self.inside[several], self.last[several]
        out[several] = before[b] == before[a]
        return out

    def contexts(self) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """For each trigger: whether its strings' stretch is whole, whether it belongs here, and its entry."""
        n = len(self.at)
        whole = np.zeros(n, bool)
        start, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n > 1:
            start[1:], end[1:] = self.at[:-1] - TRIGGER, self.at[1:] - TRIGGER + self.length
            whole[1:] = self.joined & (end[1:] <= self.doc_end[self.at[1:] - 1])
        end[~whole] = start[~whole]
        key = self.at - TRIGGER
        return whole, whole & (key >= self.stretch.low) & (key < self.stretch.high), self.entries(start, end)


class Level:
    """A chunk's distinct entries of one level, in order, with what is known of each."""

    def __init__(self, buckets: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, buckets))
        b, v = buckets[order], values[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (b[1:] != b[:-1])
        self.buckets, self.values = b[new], v[new]
        self.several = np.diff(np.append(np.flatnonzero(new), len(v))) > 1
        #: The number of each given entry, and where each distinct one is given first.
        self.number = np.empty(len(v), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.first = order[new]
        self.repeated, self.elected = self.several.copy(), np.ones(len(self.values), bool)

    def lists(self, chunk: int, level: int) -> dict[str, list]:
        bounds = np.flatnonzero(np.diff(self.buckets, prepend=-1))
        out: dict[str, list] = {f.name: [] for f in LISTS}
        for a, b in zip(bounds, [*bounds[1:], len(self.values)]):
            out["bucket"].append(int(self.buckets[a]))
            out["chunk"].append(chunk)
            out["level"].append(level)
            out["entries"].append(self.values[a:b].tobytes())
        return out

    def mark(self, marks: pa.Table, level: int) -> None:
        """Take in the bits that the buckets sent back for this chunk."""
        for row in marks.filter(pc.equal(marks.column("level"), level)).to_pylist():
            a, b = np.searchsorted(self.buckets, [row["bucket"], row["bucket"] + 1])
            self.repeated[a:b] |= np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=b - a).astype(bool)
            self.elected[a:b] = np.unpackbits(np.frombuffer(row["elected"], np.uint8), count=b - a).astype(bool)


def gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> Level:
    empty = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    b, v = zip(*(parts or empty))
    return Level(np.concatenate(b), np.concatenate(v))


class Chunk:
    """A chunk's documents, taken down the levels as far as the marks given reach."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        table = table.sort_by([("doc_id", "ascending"), ("data", "ascending")])
        self.ids, self.length = table.column("doc_id"), length
        self.number = table.column("chunk")[0].as_py()
        self.texts = [t or b"" for t in table.column("data").to_pylist()]
        self.parses = [Parse(s, length, buckets) for s in stretches(self.texts, length)]

    def phrases(self) -> Level:
        self._phrases = [p.phrases() for p in self.parses]
        return gathered([(e[0][mine], e[1][mine]) for mine, e in self._phrases])

    def contexts(self, level: Level) -> Level:
        """Mark candidates by the phrases' level, and gather their contexts."""
        self.candidate, self._contexts, parts, at = [], [], [], 0
        for parse, (mine, _) in zip(self.parses, self._phrases):
            once = np.zeros(max(0, len(parse.at) - 1), bool)
            once[mine] = ~level.repeated[level.number[at : at + len(mine)]]
            at += len(mine)
            candidate = parse.candidates(once)
            whole, mine, entry = parse.contexts()
            wanted = np.zeros(len(parse.at) + 1, bool)
            wanted[parse.inside[candidate]] = True
            mine &= wanted[: len(parse.at)]
            self.candidate.append(candidate)
            self._contexts.append((np.flatnonzero(mine), entry))
            parts.append((entry[0][mine], entry[1][mine]))
        return gathered(parts)

    def suffixes(self, level: Level) -> Level:
        """Settle strings by the contexts' level, and gather the ones to compare singly."""
        self.settled, self.single, parts, at = [], [], [], 0
        first = np.zeros(len(level.number), bool)
        first[level.first] = True
        for parse, candidate, (mine, _) in zip(self.parses, self.candidate, self._contexts):
            number = level.number[at : at + len(mine)]
            repeated = np.zeros(len(parse.at) + 1, bool)
            repeated[mine] = level.repeated[number]
            stands = np.zeros(len(parse.at) + 1, bool)
            stands[mine] = level.elected[number] & first[at : at + len(mine)]
            at += len(mine)
            settled = candidate & repeated[parse.inside]
            single = np.flatnonzero(candidate & (~settled | stands[parse.inside]))
            self.settled.append(settled)
            self.single.append(single)
            i = parse.strings[single]
            parts.append(parse.entries(i, i + self.length))
        return gathered(parts)

    def removed(self, level: Level) -> list[np.ndarray]:
        """For each document the bytes that a repeated string covers."""
        out = [np.zeros(len(t), bool) for t in self.texts]
        at = 0
        for parse, settled, single in zip(self.parses, self.settled, self.single):
            repeated = settled.copy()
            repeated[single] |= level.repeated[level.number[at : at + len(single)]]
            at += len(single)
            edge = np.zeros(len(parse.stretch.data) + 1, np.int32)
            i = parse.strings[repeated]
            edge[i] += 1
            edge[i + self.length] -= 1
            covered = np.cumsum(edge)[:-1] > 0
            for doc, offset, a, b in parse.stretch.docs:
                out[doc][offset : offset + b - a] |= covered[a:b]
        return out


def _descend(length: int, buckets: int, level: int):
    """Chunk (and marks so far) to the lists of one level."""

    def start(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length, buckets)
        return pa.table(chunk.phrases().lists(chunk.number, 0), schema=_LISTS)

    def further(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _LISTS.empty_table()
        chunk = Chunk(table, length, buckets)
        phrases = chunk.phrases()
        phrases.mark(marks, 0)
        contexts = chunk.contexts(phrases)
        if level == 1:
            return pa.table(contexts.lists(chunk.number, 1), schema=_LISTS)
        contexts.mark(marks, 1)
        return pa.table(chunk.suffixes(contexts).lists(chunk.number, 2), schema=_LISTS)

    return further if level else start


def _finish(length: int, buckets: int, keep: bool):
    def run(table: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "spans", "kept_sha256", *(["kept"] if keep else [])]
        chunk = Chunk(table, length, buckets)
        phrases = chunk.phrases()
        phrases.mark(marks, 0)
        contexts = chunk.contexts(phrases)
        contexts.mark(marks, 1)
        suffixes = chunk.suffixes(contexts)
        suffixes.mark(marks, 2)
        rows: list[tuple] = []
        for text, gone in zip(chunk.texts, chunk.removed(suffixes)):
            edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if len(edges) else text
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
            rows.append((len(text), spans, hashlib.sha256(kept).hexdigest(), kept))
        n, spans, digest, kept = map(list, zip(*rows))
        of = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        columns = [chunk.ids, pa.array(n, pa.int64()), pa.array(spans, pa.list_(of)), pa.array(digest, pa.string()), pa.array(kept, pa.binary())]
        return pa.table(dict(zip(names, columns)))

    def safe(table: pa.Table, marks: pa.Table) -> pa.Table:
        if table.num_rows:
            return run(table, marks)
        of = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        types = {"doc_id": table.schema.field("doc_id").type, "n_bytes": pa.int64(), "spans": pa.list_(of), "kept_sha256": pa.string()}
        return pa.schema(types | ({"kept": pa.binary()} if keep else {})).empty_table()

    return safe


def _compare(table: pa.Table) -> pa.Table:
    """Lists of one bucket to marks: entries that several chunks have, and the first chunk of each."""
    table = table.sort_by([("chunk", "ascending")])
    lists = [np.frombuffer(e, np.uint64) for e in table.column("entries").to_pylist()]
    values = np.concatenate(lists)
    order = np.argsort(values, kind="stable")
    v = values[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = v[1:] == v[:-1]
    shared, elected = np.empty(len(v), bool), np.empty(len(v), bool)
    shared[order], elected[order] = same[1:] | same[:-1], ~same[:-1]
    bounds = np.cumsum([len(x) for x in lists])[:-1]
    bits = lambda flags: pa.array([np.packbits(x).tobytes() for x in np.split(flags, bounds)], pa.binary())
    return pa.table([table.column("bucket"), table.column("chunk"), table.column("level"), bits(shared), bits(elected)], schema=_MARKS)


_LISTS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("level", pa.int32()), ("entries", pa.binary())])
_MARKS = pa.schema([*(_LISTS.field(i) for i in range(3)), ("shared", pa.binary()), ("elected", pa.binary())])


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: bool = False, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (byte offsets to remove), kept_sha256, and ``kept`` if asked for.

    A byte goes when a string of ``length`` bytes over it also starts anywhere else, in this
    document or another; strings never cross documents, and are judged on the input as it is. Null
    texts are empty, rows with a null or repeated doc_id are documents like others, other columns
    are ignored, and an empty table gives an empty one. Rows are dealt out by number, so equal rows
    spread over all chunks.
    """
    total = total_bytes(docs)
    chunks, buckets = max(1, -(-total // chunk_bytes)), max(1, -(-total // bucket_bytes))
    texts = dealt(docs.select("doc_id", F.col("text").cast("binary").alias("data")), chunks)
    marks = None
    for level in range(3):
        step = _descend(length, buckets, level)
        if marks is None:
            lists = texts.groupBy("chunk").applyInArrow(step, LISTS)
        else:
            lists = texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(step, LISTS)
        found = stored(lists.groupBy("bucket").applyInArrow(_compare, MARKS))
        marks = found if marks is None else marks.unionByName(found)
    schema = StructType([texts.schema["doc_id"], StructField("n_bytes", LongType()), StructField("spans", SPANS), StructField("kept_sha256", StringType())])
    if keep:
        schema = schema.add("kept", BinaryType())
    return texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_finish(length, buckets, keep), schema)


def op4_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256",
    )
