"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows.

Texts become sequences of numbers (a benchmark word's number, 0 for any other word), so the automaton
has a node per word rather than per letter, a match ends at a word, and word numbers lead back to
offsets in the original text. Every document is scanned once.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import ascii_words, numbered, read, small, stored

WINDOW = 10
#: Benchmark bytes in one automaton (about 100 MB of nodes); a larger benchmark is scanned for in several.
BLOCK_BYTES = 2 << 20
#: Words of a text as it stands; capitals count as their lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "n_words long, words array<int>, items array<string>, spans array<struct<start:int,end:int>>"

#: The automaton this Python worker has built, by a name made on the driver.
_BUILT: dict[str, tuple] = {}


def build(items: list[tuple[str, str | None]], window: int):
    """(numbers of words, automaton): each window's words lead to its length and the ids of its items."""
    numbers: dict[bytes, int] = {}
    windows: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in ascii_words(text)]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            windows.setdefault(tuple(ids[i : i + window]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, ids in windows.items():
        automaton.add_word(key, (len(key), sorted(ids)))
    if windows:
        automaton.make_automaton()
    return numbers, automaton if windows else None


def scan(text: str | None, numbers: dict[bytes, int], automaton) -> tuple[int, list[int], list[str]]:
    """Number of words, the word numbers inside any match, and the items matched."""
    words = ascii_words(text)
    if automaton is None or not words:
        return len(words), [], []
    covered, items, until = [], set(), 0
    for end, (length, ids) in automaton.iter(tuple(map(numbers.get, words, repeat(0)))):
        # Windows have two lengths at most per item, so ends rise but starts may step back.
        start = end - length + 1
        if start < until:
            while covered and covered[-1] >= start:
                covered.pop()
        covered.extend(range(start, end + 1))
        until = end + 1
        items.update(ids)
    return len(words), covered, sorted(items)


def spans_of(text: str, words: list[int]) -> list[dict[str, int]]:
    """Code-point spans in the original text of runs of consecutive hit words."""
    offsets = [m.span() for m in WORD.finditer(text)]
    spans: list[dict[str, int]] = []
    for n, w in enumerate(words):
        if n and words[n - 1] == w - 1:
            spans[-1]["end"] = offsets[w][1]
        else:
            spans.append({"start": offsets[w][0], "end": offsets[w][1]})
    return spans


def _scanner(shared, window: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = build(shared.value, window)
        numbers, automaton = _BUILT[name]
        for batch in batches:
            out = {"_row": [], "n_words": [], "words": [], "items": [], "spans": []}
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                n, hit, items = scan(text, numbers, automaton)
                for column, value in zip(out, (row, n, hit, items, spans_of(text, hit) if hit else [])):
                    out[column].append(value)
            key = batch.schema.field(0)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("_row", key.type), *_ARROW]))

    return run


_ARROW = [
    ("n_words", pa.int64()),
    ("words", pa.list_(pa.int32())),
    ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
]


def _hits_schema(key) -> StructType:
    return StructType([StructField("_row", key), *StructType.fromDDL(HITS)])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (matched item ids as text), spans (hit code points).

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; more columns are ignored. Null
    texts have no words; an item without words matches nothing; a null item_id counts as the item
    "null"; repeated items count once per id; repeated documents each get their row. Empty tables
    work on either side.

    The benchmark is the one thing sent to every executor, in blocks whose bytes are added up first.
    Beyond one block, each block's hits become rows, and a document's rows are united by its number; the
    result is the same whatever the size of a block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    rows = docs.select("doc_id", "text")
    if n == 1:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        hits = rows.mapInArrow(_scanner(shared, window), _hits_schema(docs.schema["doc_id"].dataType))
        return hits.select(
            F.col("_row").alias("doc_id"), "n_words", F.size("words").cast("long").alias("n_hit"), "items", "spans"
        )
    # Numbers are stored before any block reads them: computed anew for each block they could differ.
    counted = numbered(rows.select("*", _n_words("text").alias("n_words")))
    united = _blockwise(counted, items, n, window).groupBy("_row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    # Words of different blocks make one span where they follow each other, as in one block.
    word = lambda at: F.element_at("places", at)["word"]
    first = F.filter("places", lambda p, i: (i == 0) | (F.when(i > 0, word(i)) < p["word"] - 1))
    last = F.filter("places", lambda p, i: (i == F.size("places") - 1) | (F.when(i < F.size("places") - 1, word(i + 2)) > p["word"] + 1))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))
    united = united.select("_row", "items", F.size("places").cast("long").alias("n_hit"), spans.alias("spans"))
    return counted.select("_row", "doc_id", "n_words").join(united, "_row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def _places(shared, window: int):
    """(_row, text) to the hit words with their offsets and the items, for rows with hits."""
    name = uuid.uuid4().hex
    schema = pa.schema([("_row", pa.int64()), ("places", pa.list_(pa.struct([(f, pa.int32()) for f in ("word", "start", "end")]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = build(shared.value, window)
        numbers, automaton = _BUILT[name]
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                _, hit, items = scan(text, numbers, automaton)
                if hit:
                    offsets = [m.span() for m in WORD.finditer(text)]
                    places = [{"word": w, "start": offsets[w][0], "end": offsets[w][1]} for w in hit]
                    for column, value in zip(schema.names, (row, places, items)):
                        out[column].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


def _blockwise(rows: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """Hits of numbered rows in each block of the benchmark; one block at a time is on the driver and the executors."""
    block, parts = F.pmod(F.xxhash64("item", "text"), F.lit(n)), []
    for k in range(n):
        shared = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in items.where(block == k).collect()])
        found = rows.select("_row", "text").mapInArrow(_places(shared, window), "_row long, places array<struct<word:int,start:int,end:int>>, items array<string>")
        parts.append(stored(found))
        shared.unpersist()
    return functools.reduce(DataFrame.unionByName, parts)


def _clean(shared, window: int, at: int):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = build(shared.value, window)
        numbers, automaton = _BUILT[name]
        for batch in batches:
            yield batch.filter(pa.array([not scan(t.as_py(), numbers, automaton)[1] for t in batch.column(at)], pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark window: a filter where documents are read.

    A benchmark of several blocks is scanned for block by block over the stored, numbered rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    n = max(1, -(-items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // block_bytes))
    if n == 1:
        shared = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])
        return docs.mapInArrow(_clean(shared, window, docs.columns.index("text")), docs.schema)
    rows = numbered(docs.select(F.struct(*docs.columns).alias("doc")))
    texts = rows.select("_row", F.col("doc.text").alias("text"))
    bad = stored(_blockwise(texts, items, n, window).select("_row").distinct())
    return rows.join(small(bad), "_row", "left_anti").select("doc.*")


def _n_words(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORD.pattern)), F.lit(0)).cast("long")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = f"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(w[i:i + {WINDOW - 1}]) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS win
  FROM b, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS g(i) WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(i)
), m AS (SELECT r, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM m, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN ids USING (r)
"""
