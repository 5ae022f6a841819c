"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often corpus-wide.

Both tokenizers cut the same bytes, so their tokens meet at common ends, which cut a text into groups;
a token of one and a token of the other are linked where their byte ranges overlap. A linked pair of
ids counts once for each document that holds it.

1. Documents are tokenized once; their ids are dealt out to chunks of bounded size in a bucketed
   table. Each chunk is aligned and gives its distinct pairs with the number of its documents that
   hold them.
2. The distinct pairs of the corpus are cut into segments by a hash; a task builds each segment's
   minimal perfect hash and lays the keys out in its order.
3. Each leaf (a slice of the chunks' pairs of one segment) becomes a dense vector of counts indexed by the
   hash, keys verified; vectors are summed in a tree, some at a time.
4. The pairs of each chunk look their counts up through the hash, and go back to their chunk, where a
   second pass aligns the documents anew and sums over their links.

Nothing but one number for each id of the first vocabulary passes through the driver.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import dealt, read, slices, stored, total_bytes
from .perfecthash import PerfectHash

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 4 << 20
#: Text that is tokenized in one go, and packed ids that are aligned in one go inside a chunk; a longer text goes alone.
STRETCH, ALIGNED = 1 << 20, 1 << 19
#: Characters whose kind (letter, digit, space, other) no Unicode version disputes.
PLAIN = re.compile("[\t\n\r -~¡-ɏЀ-ҁ‐-‧ぁ-ゖァ-ヺ一-龥]*")
#: How byte-level tokenizers of this kind split words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEGMENT_KEYS, LEAF_ROWS, FAN = 1 << 20, 1 << 21, 8


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligned(NamedTuple):
    """Per text: token, group and link counts; per link: number of its text, and its pair; what the groups' text is made of."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    owner: np.ndarray
    pairs: np.ndarray
    cuts: tuple[np.ndarray, ...]


class Aligner:
    """A tokenizers file (first) and a sentencepiece model (second), with the bytes of every id."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        plain = byte_level()
        vocabulary = self.first.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # Each id followed by the sign inside its group, then by the sign that ends its side of the group.
        signs = [f"{i}{s}" for i in range(len(self.bytes_a)) for s in ",|"] + [f"{i}{s}" for i in range(len(self.bytes_b)) for s in ",;"]
        self.signs = np.array(signs, dtype=object)
        self.rapid = self._rapid()
        #: Ids travel in the smallest type that holds them.
        self.packed = [np.min_scalar_type(len(x) - 1) for x in (self.bytes_a, self.bytes_b)]

    @property
    def width(self) -> int:
        """A pair is id_a * width + id_b."""
        return len(self.bytes_b)

    def _rapid(self):
        """The first tokenizer as a rank table, several times as fast, if its merges are in the order of their ids."""
        setup = json.loads(self.first.to_str())
        words, model = setup["pre_tokenizer"] or {}, setup["model"]
        merged = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        ordered = all(model["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merged))
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if setup["normalizer"] or model["type"] != "BPE" or not ordered or any(words.get(k, v) != v for k, v in plain.items()):
            return None
        import tiktoken

        ranks = {self.bytes_a[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def tokens(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both tokenizers; none of either where one of them does not give back the text's bytes."""
        a: list[list[int]] = [[]] * len(texts)
        plain = [bool(self.rapid and PLAIN.fullmatch(t)) for t in texts]
        rest = [i for i, p in enumerate(plain) if not p]
        for i, found in zip(rest, self.first.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False)):
            a[i] = found.ids
        for i, text in enumerate(texts):
            if plain[i]:
                a[i] = self.rapid.encode_ordinary(" " + text)
        b = self.second.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            raw = (" " + text).encode("utf-8", "surrogatepass")
            if not text or b"".join(map(self.bytes_b.__getitem__, b[i])) != raw or b"".join(map(self.bytes_a.__getitem__, a[i])) != raw:
                a[i], b[i] = [], []
        return a, b

    def align(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
        """Align texts given as the ids of all of them in a row and the numbers of ids of each."""
        # Both sides of every text have the same bytes, so ends agree across the joined texts, and texts end together.
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        whole = int(ends_a[-1]) if len(a) else 0
        is_a, is_b = np.zeros(whole + 1, bool), np.zeros(whole + 1, bool)
        is_a[ends_a], is_b[ends_b] = True, True
        # Two tokens overlap in one run of bytes, and between two cuts lies one token of each: cuts are links.
        cuts = np.flatnonzero(is_a | is_b)
        a_ends, b_ends = is_a[cuts], is_b[cuts]
        at_a, at_b = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        pairs = a[at_a] * self.width + b[at_b]
        owner = np.repeat(np.arange(len(n_a)), n_a)[at_a]
        both = a_ends & b_ends
        n_links, n_groups = np.bincount(owner, minlength=len(n_a)), np.bincount(owner[both], minlength=len(n_a))
        return Aligned(n_a, n_b, n_groups, n_links, owner, pairs, (a, b, a_ends, b_ends, both))

    def groups(self, found: Aligned) -> list[str]:
        """Each text's groups, ids of the first before those of the second: ``a1,a2|b1;a3|b2,b3``."""
        a, b, a_ends, b_ends, both = found.cuts
        upto_a, upto_b = np.cumsum(a_ends), np.cumsum(b_ends)
        # A token stands behind all tokens of earlier groups, those of the second behind the first's of its own group too.
        closed = np.cumsum(both) - both
        before_b, through_a = np.concatenate([[0], upto_b[both]]), upto_a[both]
        signs = np.empty(len(a) + len(b), np.int64)
        signs[np.arange(len(a)) + before_b[closed[a_ends]]] = a * 2 + both[a_ends]
        signs[np.arange(len(b)) + through_a[closed[b_ends]]] = (len(self.bytes_a) + b) * 2 + both[b_ends]
        parts = self.signs[signs]
        edges = np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])
        return ["".join(parts[x:y].tolist())[:-1] for x, y in zip(edges[:-1], edges[1:])]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(first: str, second: str) -> Aligner:
    """One per Python worker and pair of files."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    return _ALIGNERS[first, second]


def _tokenize(first: str, second: str):
    """(doc_id, text) to the ids of both tokenizers, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for x, y in slices([len(t) for t in texts], STRETCH):
                aligner = _aligner(first, second)
                sides = zip(aligner.tokens(texts[x:y]), aligner.packed)
                packed = [pa.array([np.array(ids, kind).tobytes() for ids in side], pa.binary()) for side, kind in sides]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), *packed], ["doc_id", "a", "b"])

    return run


def _stretches(aligner: Aligner, table: pa.Table) -> Iterator[tuple[int, Aligned]]:
    """A chunk's documents, aligned some at a time, with the number of the first."""
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    for x, y in slices([len(t) for t in a], ALIGNED):
        sides = list(zip((a[x:y], b[x:y]), aligner.packed))
        ids = [np.frombuffer(b"".join(side), kind).astype(np.int64) for side, kind in sides]
        sizes = [np.array([len(t) // kind.itemsize for t in side], np.int64) for side, kind in sides]
        yield x, aligner.align(*ids, *sizes)


PARTIAL = StructType([StructField(n, LongType()) for n in ("chunk", "pair", "docs")])
HASH = StructType(
    [StructField("segment", LongType()), StructField("sizes", ArrayType(LongType())), StructField("bits", ArrayType(BinaryType())), StructField("keys", BinaryType())]
)
VECTOR = StructType([StructField("segment", LongType()), StructField("node", LongType()), StructField("counts", BinaryType())])
FOUND = StructType([StructField(n, LongType()) for n in ("chunk", "pair", "count")])
_TYPES = {LongType(): pa.int64(), BinaryType(): pa.binary(), ArrayType(LongType()): pa.list_(pa.int64()), ArrayType(BinaryType()): pa.list_(pa.binary())}


def _table(schema: StructType, *columns) -> pa.Table:
    return pa.table({f.name: pa.array(c, _TYPES[f.dataType]) for f, c in zip(schema, columns)})


def _count(first: str, second: str):
    """A chunk to its distinct pairs and how many of its documents hold each."""

    def run(table: pa.Table) -> pa.Table:
        aligner = _aligner(first, second)
        found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        span = len(aligner.bytes_a) * aligner.width
        for _, aligned in _stretches(aligner, table):
            held = np.unique(aligned.owner * span + aligned.pairs) % span
            pairs, docs = np.unique(held, return_counts=True)
            found.append(pairs)
            counts.append(docs)
        pairs, at = np.unique(np.concatenate(found), return_inverse=True)
        docs = np.zeros(len(pairs), np.int64)
        np.add.at(docs, at, np.concatenate(counts))
        chunk = table.column("chunk")[0].as_py()
        return _table(PARTIAL, np.full(len(pairs), chunk), pairs, docs)

    return run


def _build(table: pa.Table) -> pa.Table:
    """A segment's distinct pairs to their perfect hash, and the pairs in its order."""
    pairs = table.column("pair").to_numpy()
    hashed = PerfectHash.build(pairs)
    keys = np.empty(len(pairs), np.int64)
    keys[hashed.index(pairs)] = pairs
    return _table(HASH, [table.column("segment")[0].as_py()], [hashed.sizes], [hashed.bits], [keys.tobytes()])


def _numbers(hashes: pa.Table, pairs: np.ndarray) -> tuple[np.ndarray, int]:
    """Hash numbers of pairs, each verified against the key stored there."""
    row = hashes.slice(0, 1).to_pylist()[0]
    hashed, keys = PerfectHash(row["sizes"], row["bits"]), np.frombuffer(row["keys"], np.int64)
    at = hashed.index(pairs)
    if (at < 0).any() or (keys[at] != pairs).any():
        raise ValueError("a pair is not among the hash's keys")
    return at, len(keys)


def _leaf(partials: pa.Table, hashes: pa.Table) -> pa.Table:
    if not partials.num_rows:
        return _table(VECTOR, [], [], [])
    at, n = _numbers(hashes, partials.column("pair").to_numpy())
    counts = np.zeros(n, np.int64)
    np.add.at(counts, at, partials.column("docs").to_numpy())
    return _table(VECTOR, [partials.column("segment")[0].as_py()], [partials.column("node")[0].as_py()], [counts.tobytes()])


def _sum(table: pa.Table) -> pa.Table:
    vectors = [np.frombuffer(v, np.int64) for v in table.column("counts").to_pylist()]
    total = vectors[0].copy()
    for v in vectors[1:]:
        total += v
    return _table(VECTOR, [table.column("segment")[0].as_py()], [table.column("node")[0].as_py()], [total.tobytes()])


def _look_up(partials: pa.Table, hashes: pa.Table) -> pa.Table:
    if not partials.num_rows:
        return _table(FOUND, [], [], [])
    pairs = partials.column("pair").to_numpy()
    at, _ = _numbers(hashes, pairs)
    counts = np.frombuffer(hashes.column("counts")[0].as_py(), np.int64)
    return _table(FOUND, partials.column("chunk").to_numpy(), pairs, counts[at])


def _highest(width: int):
    """Segments to the highest count of each first id in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["counts"], np.int64)
                a, at = np.unique(keys // width, return_inverse=True)
                top = np.zeros(len(a), np.int64)
                np.maximum.at(top, at, counts)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(top)], ["a", "top"])

    return run


def _finish(first: str, second: str, highest: dict[int, int]):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
        types = [docs.schema.field("doc_id").type, *[pa.int64()] * 6, pa.string()]
        aligner = _aligner(first, second)
        order = np.argsort(found.column("pair").to_numpy())
        keys, counts = found.column("pair").to_numpy()[order], found.column("count").to_numpy()[order]
        best = counts == np.array([highest[a] for a in (keys // aligner.width).tolist()], np.int64)
        out = []
        for x, aligned in _stretches(aligner, docs):
            at, n = np.searchsorted(keys, aligned.pairs), len(aligned.n_a)
            sums = np.zeros((2, n), np.int64)
            np.add.at(sums[0], aligned.owner, best[at].astype(np.int64))
            np.add.at(sums[1], aligned.owner, counts[at])
            ids = docs.column("doc_id").slice(x, n).combine_chunks()
            columns = [ids, *aligned[:4], *sums, aligner.groups(aligned)]
            out.append(pa.table({n: pa.array(c, t) if n != "doc_id" else c for n, c, t in zip(names, columns, types)}))
        return pa.concat_tables(out) if out else pa.schema(list(zip(names, types))).empty_table()

    return run


class Alignment(NamedTuple):
    """``documents``: a row for each row of the input; ``pairs``: a_id, b_id, count over the corpus."""

    documents: DataFrame
    pairs: DataFrame


def _unpack(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], np.int64)
                counts = pa.array(np.frombuffer(row["counts"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys // width), pa.array(keys % width), counts], ["a_id", "b_id", "count"])

    return run


def aligned(
    docs: DataFrame, first: str, second: str, chunk_bytes: int = CHUNK_BYTES, segment_keys: int = SEGMENT_KEYS, leaf_rows: int = LEAF_ROWS
) -> Alignment:
    """Align the texts of ``docs`` under two vocabularies (paths that every executor has).

    ``documents`` holds doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups. Null and
    empty texts, and texts whose bytes a tokenizer does not give back, have zeros and empty groups.
    Each row is a document of its own, whatever its doc_id (null ones, repeated rows); a long text is
    aligned whole; other columns are ignored; an empty table gives empty tables.
    """
    width = _aligner(first, second).width
    schema = StructType([docs.schema["doc_id"], StructField("a", BinaryType()), StructField("b", BinaryType())])
    tokenized = docs.select("doc_id", "text").mapInArrow(_tokenize(first, second), schema)
    texts = dealt(tokenized, max(1, -(-total_bytes(docs) // chunk_bytes)))
    partials = stored(texts.groupBy("chunk").applyInArrow(_count(first, second), PARTIAL))
    keys = stored(partials.select("pair").distinct())
    segments = max(1, -(-keys.count() // segment_keys))
    segment = F.pmod(F.xxhash64("pair"), F.lit(segments)).alias("segment")
    hashes = stored(keys.select("pair", segment).groupBy("segment").applyInArrow(_build, HASH))

    nodes = max(1, -(-partials.count() // (segments * leaf_rows)))
    leaves = partials.select("*", segment, F.pmod(F.xxhash64("chunk"), F.lit(nodes)).alias("node"))
    each = lambda frame, n: frame.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    by = ["segment", "node"]
    vectors = leaves.groupBy(*by).cogroup(each(hashes, nodes).groupBy(*by)).applyInArrow(_leaf, VECTOR)
    level = nodes
    while level > 1:
        level = -(-level // FAN)
        vectors = vectors.withColumn("node", F.pmod("node", F.lit(level))).groupBy(*by).applyInArrow(_sum, VECTOR)
    counted = stored(hashes.join(vectors.drop("node"), "segment"))

    top = counted.select("keys", "counts").mapInArrow(_highest(width), "a long, top long").groupBy("a").agg(F.max("top").alias("top"))
    highest = {r.a: r.top for r in top.collect()}  # at most one row for each id of the first vocabulary
    found = leaves.groupBy(*by).cogroup(each(counted, nodes).groupBy(*by)).applyInArrow(_look_up, FOUND)
    schema = StructType(
        [texts.schema["doc_id"], *(StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), StructField("groups", StringType())]
    )
    documents = texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_finish(first, second, highest), schema)
    pairs = counted.select("keys", "counts").mapInArrow(_unpack(width), "a_id long, b_id long, count long")
    return Alignment(documents, pairs)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    found = aligned(docs, public_tokenizers.path(FIRST), public_tokenizers.path(SECOND)).documents
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256))
    return found.withColumn("groups_sha256", digest).drop("groups")
