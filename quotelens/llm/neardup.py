"""Near-duplicates by ProbMinHash over weighted word shingles, banding, and verification.

A text's shingles are runs of five words, weighted by how often they occur. Every shingle is a
Poisson process of arrivals at its weight's rate; each arrival falls on one of the signature's
registers, which keeps the shingle of its earliest one. All shingles take one arrival per round,
and a shingle stops once its next arrival is later than every register's: later ones can't win. The
share of equal registers estimates the probability Jaccard similarity

    J(a, b) = sum over shared s of 1 / sum over t of max(a[t]/a[s], b[t]/b[s]),

which is the plain Jaccard similarity when no shingle repeats. Documents that share a band of
registers are compared exactly, and those of similarity 0.8 or more are linked; a class is a
connected component of links.

Copies (equal words) become one representative before any banding, and buckets of equal members are
settled once. A band's bucket is never
expanded into all pairs: its members are compared with a hub, hubs of large buckets with hubs of
hubs, and only members that this leaves outside the bucket's largest component are compared with
the others, inside tasks that return links. Links and components stay tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import WORD_BYTES, Fingerprints, byte_values, hot_join, mix, read, slices, small, stored

SHINGLE = 5
SIMILARITY = 0.8
#: 40 bands of 8 registers: a pair misses all bands with probability 6e-4 at similarity 0.8, 3e-6 at 0.85.
#: Fewer, shorter bands would miss less, but let in many pairs of similarity 0.5 that must be compared.
BANDS, ROWS = 40, 8
REGISTERS = BANDS * ROWS
STRETCH = 1 << 19
FAN = 64
#: Members of one bucket that are compared in one task.
ALL_BLOCK, OUT_BLOCK = 500, 250
_VALUES = byte_values(11)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of all texts, and where each text's begin (one more bound at the end).

    Words are runs of ASCII letters and digits and of other characters beyond ASCII, in lower case. A
    text of one to four words is one shingle; a text without words has none.
    """
    clean = [t.translate(WORD_BYTES) for t in texts]
    joined = np.frombuffer(b" " + b" ".join(clean) + b" ", np.uint8)
    inside = joined != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    words = Fingerprints(joined, _VALUES).of(starts, ends)
    sizes = np.array([len(t) + 1 for t in clean])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)
    counts = np.diff(bounds)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - SHINGLE + 1)
        rolled = np.zeros(len(words), np.uint64)
        for k in range(SHINGLE):
            rolled[:n] = mix(rolled[:n] + words[k : n + k] * GOLDEN)
        for d in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
            h = np.uint64(counts[d])
            for w in words[bounds[d] : bounds[d + 1]]:
                h = mix(h + w * GOLDEN)
            rolled[bounds[d]] = h
    have = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(have)[:-1]]), have)
    return rolled[np.arange(have.sum()) + first], np.concatenate([[0], np.cumsum(have)])


def weighted(found: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text, their counts and new bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(found)))
    return found[at], counts, np.searchsorted(owner[at], np.arange(len(bounds)))


def signatures(found: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """ProbMinHash registers (texts x REGISTERS); a text without shingles keeps zeros."""
    n = len(bounds) - 1
    earliest = np.full(n * REGISTERS, np.inf)
    winner = np.zeros(n * REGISTERS, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    rate = 1 / counts
    element, state = found, found
    when = np.zeros(len(found))
    while len(element):
        with np.errstate(over="ignore"):
            state = mix(state + GOLDEN)
        when = when - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        register = owner * REGISTERS + ((mix(state ^ GOLDEN) >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, register, when)
        won = earliest[register] == when
        winner[register[won]] = element[won]
        latest = earliest.reshape(n, REGISTERS).max(1)
        going = when < latest[owner]
        element, state, when, owner, rate = element[going], state[going], when[going], owner[going], rate[going]
    return winner.reshape(n, REGISTERS)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A fingerprint for each band of each text."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            key = mix(key * GOLDEN + parts[:, :, r])
    return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights)."""
    (x, wx), (y, wy) = a, b
    shared, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    if wx.max() == 1 and wy.max() == 1:
        return len(shared) / (len(x) + len(y) - len(shared))
    union = np.concatenate([x, np.delete(y, j)])
    p = np.concatenate([wx, np.zeros(len(y) - len(j))]).astype(np.float64)
    q = np.zeros(len(union))
    q[i] = wy[j]
    q[len(x) :] = np.delete(wy, j)
    # For a shared s: sum of max(p/p[s], q/q[s]). By ratio r = q/p, the terms with q/p >= q[s]/p[s] take q's side.
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio, kind="stable")
    ratio, p, q = ratio[order], p[order], q[order]
    low, high = np.concatenate([[0], np.cumsum(p)]), np.concatenate([np.cumsum(q[::-1])[::-1], [0]])
    mine = np.flatnonzero((p > 0) & (q > 0))
    cut = np.searchsorted(ratio, ratio[mine], "left")
    return float((1 / (low[cut] / p[mine] + high[cut] / q[mine])).sum())


def _text_bytes(column) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "surrogatepass") for t in column.to_pylist()]


_PLACED = [("_words", BinaryType()), ("_bands", ArrayType(LongType()))]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text) to a fingerprint of the words in order and the band keys; nulls for a text without words."""
    for batch in batches:
        texts = _text_bytes(batch.column(1))
        for a, b in slices([len(t) for t in texts], STRETCH):
            found, bounds = shingles(texts[a:b])
            keys = band_keys(signatures(*weighted(found, bounds))).astype(np.int64)
            empty = np.diff(bounds) == 0
            words = [
                None if none else hashlib.blake2b(b" ".join(t.translate(WORD_BYTES).split()), digest_size=16).digest()
                for t, none in zip(texts[a:b], empty)
            ]
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32(), mask=np.append(empty, False))
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.binary()), lists], ["_doc", "_words", "_bands"])


def _verify(threshold: float):
    """(a, text_a, b, text_b) to the pairs of at least the threshold; the hub's (b's) shingles are kept while it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            mine, theirs = batch.column(1), batch.column(3)
            keep = []
            for i, b in enumerate(right):
                text = theirs[i].as_py()
                if hub != (b, text):
                    hub, hub_set = (b, text), _set(text)
                keep.append(similarity(_set(mine[i].as_py()), hub_set) >= threshold)
            kept = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in kept], pa.int64()), pa.array([right[i] for i in kept], pa.int64())], ["a", "b"])

    return run


def _set(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found, bounds = shingles([(text or "").lower().encode("utf-8", "surrogatepass")])
    elements, counts, _ = weighted(found, bounds)
    return elements, counts


PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


def verified(pairs: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose texts are similar enough, stored. Texts travel for the documents in pairs only."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(nodes, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return stored(both.select("a", "text_a", "b", "text_b").mapInArrow(_verify(threshold), PAIR).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link, root the smallest node it reaches: alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        sums = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sums == seen:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        seen = sums


def _across(threshold: float):
    """Links between outliers and all members of a bucket (blocks of each), where their components differ.

    One outlier at a time meets all members through the shingles they share. A pair's similarity is at
    most the share of either text's weight that lies on shared shingles, so most pairs end there; the
    rest are exact.
    """

    def run(out: pa.Table, every: pa.Table) -> pa.Table:
        links: tuple[list[int], list[int]] = ([], [])
        if out.num_rows and every.num_rows:
            nodes, roots = every.column("node").to_numpy(), every.column("root").to_numpy()
            found, bounds = shingles(_text_bytes(every.column("text")))
            found, counts, bounds = weighted(found, bounds)
            owner = np.repeat(np.arange(len(nodes)), np.diff(bounds))
            order = np.argsort(found, kind="stable")
            total = np.bincount(owner, counts, len(nodes))
            plain = np.bincount(owner, counts > 1, len(nodes)) == 0
            sizes, keys = np.diff(bounds), found[order]
            for node, root, text in zip(out.column("node").to_pylist(), out.column("root").to_pylist(), out.column("text").to_pylist()):
                own, weight = _set(text)
                low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
                hits = high - low
                at = order[np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())]
                mine = np.bincount(owner[at], np.repeat(weight, hits), len(nodes)) / weight.sum()
                theirs = np.bincount(owner[at], counts[at], len(nodes)) / np.maximum(total, 1)
                likely = np.flatnonzero((np.minimum(mine, theirs) >= threshold - 1e-9) & (roots != root))
                for k in likely:
                    if weight.max() == 1 and plain[k]:
                        shared = round(mine[k] * len(own))
                        same = shared / (len(own) + sizes[k] - shared)
                    else:
                        part = slice(bounds[k], bounds[k + 1])
                        same = similarity((own, weight), (found[part], counts[part]))
                    if same >= threshold:
                        links[0].append(node)
                        links[1].append(int(nodes[k]))
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return run


def torn_links(members: DataFrame, roots: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that the hubs missed, stored: members of one bucket that are still in different components.

    Each bucket's outliers (all but its largest component) are compared with all its members, in
    blocks of bounded size; what comes out are links, never pairs. In buckets of two the hub has
    compared them.
    """
    placed = members.where("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    groups = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    torn = groups.groupBy("key").agg(
        F.max_by("root", F.struct("m", "root")).alias("main"), F.sum("m").alias("all"), (F.sum("m") - F.max("m")).alias("out")
    )
    apart = stored(hot_join(placed, stored(torn.where("out > 0")), "key", "all"))
    texts = stored(docs.join(apart.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"))
    all_blocks, out_blocks = F.ceil(F.col("all") / ALL_BLOCK), F.ceil(F.col("out") / OUT_BLOCK)
    number = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    block = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    every = apart.withColumn("j", block(all_blocks, 0)).withColumn("i", number(out_blocks))
    out = apart.where("root <> main").withColumn("i", block(out_blocks, 1)).withColumn("j", number(all_blocks))
    names = ["node", "key", "i", "j", "root", "text"]
    # toDF gives each side columns of its own, though both come from one table.
    sides = [side.select(*names[:5]).join(texts, "node").toDF(*names).groupBy("key", "i", "j") for side in (out, every)]
    return stored(sides[0].cogroup(sides[1]).applyInArrow(_across(threshold), PAIR).distinct())


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id of every row: documents linked, directly or through others, have one class_id, its smallest doc_id.

    ``docs`` needs a whole-number doc_id and text; other columns are ignored. Texts of equal words
    are one class (case and signs don't count). A text without words (null and empty ones among
    them) and a row without doc_id are in no class but their own. A repeated doc_id stands for one
    document in all its rows. An empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = StructType([StructField("_doc", LongType()), *(StructField(n, t) for n, t in _PLACED)])
    signed = stored(rows.mapInArrow(_sign, schema))
    worded = signed.where("_words is not null and _doc is not null")
    # Equal words have equal bands, so any row's bands stand for the copies.
    copies = stored(worded.groupBy("_words").agg(F.min("_doc").alias("node"), F.min_by("_bands", "_doc").alias("_bands"), F.count("*").alias("_rows")))
    members = copies.select("node", F.explode("_bands").alias("key"))
    held = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"_set{salt}") for salt in range(2)]
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("top"), *held).where("n > 1")
    # Buckets of equal members (128 bits tell them apart) ask the same, so one of them stands for all.
    sizes = stored(sizes.groupBy("n", "top", "_set0", "_set1").agg(F.min("key").alias("key")).select("key", "n", "top"))
    members = stored(hot_join(members, sizes, "key", "n"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / FAN)))
    hubs = salted.groupBy("key", "salt").agg(F.min("node").alias("hub"), F.first("top").alias("top"))
    near = salted.join(hubs.select("key", "salt", "hub"), ["key", "salt"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    far = hubs.select(F.col("hub").alias("a"), F.col("top").alias("b"))
    pairs = stored(near.unionByName(far).where("a <> b").distinct())
    links = verified(pairs, rows, threshold)
    roots = components(links)
    late = torn_links(members, roots, rows, threshold)
    # A doc_id that repeats with other words holds those texts together.
    several = worded.groupBy("_doc").agg(F.min("_words").alias("_low"), F.max("_words").alias("_high")).where("_low <> _high").select("_doc")
    same = worded.join(several, "_doc").join(copies.select("_words", "node"), "_words").select(F.col("_doc").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(late).unionByName(same.where("a <> b")))
    # Classes are settled per distinct text before rows meet them, so a text of many copies joins by one stored row.
    settled = stored(copies.join(roots, "node", "left").select("_words", "_rows", F.coalesce("root", "node").alias("root")))
    kind = docs.schema["doc_id"].dataType
    return hot_join(signed.select("_doc", "_words"), settled, "_words", "_rows", "left").select(
        F.col("_doc").cast(kind).alias("doc_id"), F.when(F.col("_doc").isNotNull(), F.coalesce("root", "_doc")).cast(kind).alias("class_id")
    )


def keep_one_each(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Rows of ``docs``, all columns, without the documents whose class has a smaller doc_id, and once per doc_id.

    Rows without doc_id, and texts without words, stay.
    """
    classes = stored(near_duplicates(docs, threshold))
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    # Texts stay where they are as long as the ids to drop are few enough to broadcast.
    kept = docs.join(small(stored(gone)), "doc_id", "left_anti")
    twice = classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        once = kept.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
        kept = kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*"))
    return kept.select(*docs.columns)


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("representative", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
