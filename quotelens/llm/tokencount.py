"""Token counts of a byte-fallback BPE vocabulary by a compiled transducer over pieces of text.

In such a vocabulary no piece holds a space mark after another character, and some characters are in
no longer piece at all. A merge can therefore never cross the place before a run of space marks or
beside such a lone character: those places synchronise. The transducer's input symbols are the units
between them; every transition is annotated with the number of tokens that the unit emits, compiled
on first use from the vocabulary's merge order. A chunk of text that begins or ends inside a unit
has a state map: what it holds before its first synchronising place, the count from there to its
last one, and what follows. Maps compose associatively, so the chunks of a long text are joined by a
scan in pairs, in any grouping.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import read, text_bytes

#: The vocabulary's space mark; inside the transducer a plain space stands for it.
MARK, SPACE = "▁", " "
MODEL = "piece_bpe_32k.model"
#: Transitions kept per Python worker (about 120 MB); the table starts anew when it is full.
TABLE = 800_000
CHUNK = 1 << 16
NONE = 1 << 30


class StateMap(NamedTuple):
    """What a chunk does from any entry state. Without a synchronising place (``open``) all of it is ``head``."""

    head: str
    count: int
    tail: str
    open: bool


class Transducer:
    def __init__(self, model: str):
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=model)
        size = vocabulary.get_piece_size()
        skipped = (vocabulary.is_unknown, vocabulary.is_control, vocabulary.is_byte, vocabulary.is_unused)
        pieces = [i for i in range(size) if not any(f(i) for f in skipped)]
        # Merge order: a higher score first.
        pieces.sort(key=lambda i: (-vocabulary.get_score(i), i))
        self.rank = {vocabulary.id_to_piece(i).replace(MARK, SPACE): n for n, i in enumerate(pieces)}
        joined = "".join(p for p in self.rank if len(p) > 1)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("this vocabulary has pieces with inner spaces; units would not be independent")
        # Only characters that stand in longer pieces can merge; the rest stand alone and synchronise.
        merging = re.escape("".join(sorted(set(joined) - {SPACE})))
        self.units = re.compile(f"{SPACE}*[{merging}]+|{SPACE}+|[^{SPACE}{merging}]")
        self.lone = re.compile(f"[^{SPACE}{merging}]")
        self.bare = frozenset(joined) - set(self.rank)
        self.table: dict[str, int] = {}

    def compile(self, unit: str) -> int:
        """Tokens of one unit: merge the best-ranked neighbours until none is a piece; unknown characters give their bytes."""
        rank = self.rank
        if len(unit) == 1:
            parts = [unit]
        elif len(unit) > 48:
            parts = self._merge_long(unit)
        else:
            parts = list(unit)
            get = rank.get
            best = [get(a + b, NONE) for a, b in zip(parts, unit[1:])]
            while best and (low := min(best)) != NONE:
                at = best.index(low)
                merged = parts[at] + parts.pop(at + 1)
                parts[at] = merged
                del best[at]
                if at:
                    best[at - 1] = get(parts[at - 1] + merged, NONE)
                if at < len(best):
                    best[at] = get(merged + parts[at + 1], NONE)
        if len(parts) == 1 or self.bare:
            return sum(1 if p in rank else len(p.encode("utf-8", "surrogatepass")) for p in parts)
        return len(parts)

    def _merge_long(self, unit: str) -> list[str]:
        """The same with a heap, for units of any length."""
        rank, parts = self.rank, list(unit)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and right[i] >= 0 and (r := rank.get(parts[i] + parts[right[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[right[i]]))

        for i in range(len(parts)):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(i)
            offer(left[i])
        return [p for p in parts if p]

    def emit(self, units: list[str]) -> int:
        """Tokens of whole units."""
        table = self.table
        try:
            return sum(map(table.__getitem__, units))
        except KeyError:
            pass
        total = 0
        for unit in units:
            n = table.get(unit)
            if n is None:
                n = self.compile(unit)
                if len(table) >= TABLE:
                    table.clear()
                if len(unit) <= 48:
                    table[unit] = n
            total += n
        return total

    def chunk(self, text: str) -> StateMap:
        """State map of a chunk (space marks in place of spaces).

        Places that synchronise: before a space mark that follows another character, and on either
        side of a lone character.
        """
        first = re.search(f"(?<=[^{SPACE}]){SPACE}|{self.lone.pattern}", text)
        if first is None:
            return StateMap(text, 0, "", True)
        start = first.start()
        end = start
        tail = len(text)
        # The last place: walk back over the last unit only.
        while tail > start:
            c = text[tail - 1]
            if self.lone.match(c):
                break
            if c == SPACE and tail - 1 > 0 and text[tail - 2] != SPACE:
                tail -= 1
                break
            tail -= 1
        end = max(start, tail)
        return StateMap(text[:start], self.emit(self.units.findall(text, start, end)), text[end:], False)

    def join(self, a: StateMap, b: StateMap) -> StateMap:
        """The map of a followed by b."""
        if a.open and b.open:
            return self.chunk(a.head + b.head)
        if a.open:
            m = self.chunk(a.head + b.head)
            return StateMap(m.head, m.count + self.emit(self.units.findall(m.tail)) + b.count, b.tail, False) if not m.open else StateMap(m.head, b.count, b.tail, False)
        if b.open:
            m = self.chunk(a.tail + b.head)
            if m.open:
                return StateMap(a.head, a.count, m.head, False)
            return StateMap(a.head, a.count + self.emit(self.units.findall(m.head)) + m.count, m.tail, False)
        return StateMap(a.head, a.count + self.emit(self.units.findall(a.tail + b.head)) + b.count, b.tail, False)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Compose maps in pairs, level by level."""
        while len(maps) > 1:
            maps = [self.join(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        marked = SPACE + text.replace(MARK, SPACE)
        if len(marked) <= chunk:
            return self.emit(self.units.findall(marked))
        whole = self.scan([self.chunk(marked[i : i + chunk]) for i in range(0, len(marked), chunk)])
        return whole.count + self.emit(self.units.findall(whole.head)) + self.emit(self.units.findall(whole.tail))


_COMPILED: dict[str, Transducer] = {}


def _counter(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _COMPILED:
            _COMPILED[model] = Transducer(model)
        count = _COMPILED[model].count
        for batch in batches:
            tokens = pa.array([count(t.as_py() or "") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tokens], ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document; ``model`` is the vocabulary's path on every executor.

    A null text is empty and has no tokens; repeated rows are counted each; other columns are ignored;
    an empty table gives an empty one. No shuffle: documents are counted where they are read.
    """
    rows = docs.select("doc_id", text_bytes().alias("n_bytes"), "text")
    schema = StructType([rows.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return rows.mapInArrow(_counter(model), schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)
