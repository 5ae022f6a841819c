"""Token counts and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_helpers import empty, frame, words

from quotelens.llm import packing, tokencount

COUNT, PACK = public_tokenizers.path(tokencount.MODEL), public_tokenizers.path(packing.MODEL)


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(4)
    parts = [*"aAbE  't09²½ªºµßÀ×ÿĐİıǅéç漢👍<|>_-.,ΣσẞK▁\n\t\x85\xa0\x1c\x00", "  ", "   ", "the ", " of", "</s>", "<unk>", "<|endoftext|>", "'ll", "'ve", "́"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + [words(rnd, 300), "", "x" * 5000]


def test_counts_and_scans_agree_with_the_library(odd_texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=COUNT)
    mine = tokencount.Transducer(COUNT)
    for text in odd_texts:
        wanted = len(library.encode(text))
        for chunk in (1 << 16, 17, 3, 1):
            assert mine.count(text, chunk) == wanted, (text, chunk)


def test_state_maps_compose_in_any_grouping(odd_texts):
    mine = tokencount.Transducer(COUNT)
    for text in odd_texts[:300]:
        maps = [mine.chunk(text[i : i + 4]) for i in range(0, len(text), 4)]
        if len(maps) > 2:
            left = maps[0]
            for m in maps[1:]:
                left = mine.join(left, m)
            whole = lambda m: m.count + mine.emit(mine.units.findall(m.head)) + mine.emit(mine.units.findall(m.tail))
            assert whole(left) == whole(mine.scan(maps))


def test_count_query_cases(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "a b"), (3, "a b")]
    found = tokencount.token_counts(frame(spark, rows, clash=("n_tokens", "n_bytes")), COUNT).collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in found) == [(0, 3, 2), (1, 0, 0), (2, 0, 0), (3, 3, 2), (3, 3, 2)]
    assert tokencount.token_counts(empty(spark), COUNT).count() == 0


def test_ids_agree_with_the_library(odd_texts):
    mine = packing.Tokenizer(PACK)
    for text in odd_texts:
        assert mine.ids(text) == np.array(mine.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_subset_sum_is_the_best_fill():
    rnd = random.Random(8)
    for _ in range(200):
        lengths = rnd.sample(range(1, 30), 4)
        counts = [rnd.randint(1, 3) for _ in lengths]
        room = rnd.randint(1, 60)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        taken = packing.subset_sum(lengths, counts, room)
        assert sum(n * c for n, c in taken.items()) == max(s for s in sums if s <= room)
        assert all(c <= counts[lengths.index(n)] for n, c in taken.items())


def check_packing(spark, rows, capacity):
    library = packing.Tokenizer(PACK)
    found = packing.pack(frame(spark, rows, clash=("length", "offset")), PACK, capacity).collect()
    ids = {i: np.frombuffer(library.ids(t or ""), "<u4").tolist() + [2] for i, t in rows}
    pieces, windows = {}, {}
    for r in found:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, t in rows:
        repeats = sum(1 for j, _ in rows if j == i)
        assert sum(n for _, n in pieces[i]) == repeats * len(ids[i])
    for places in windows.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(windows) == list(range(len(windows)))
    return len(windows) * capacity / sum(r.length for r in found)


def test_packing_places_every_id_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 20)
    rnd = random.Random(3)
    rows = [(i, words(rnd, rnd.randint(0, 60))) for i in range(200)] + [(500, None), (501, ""), (502, words(rnd, 400)), (503, "a"), (503, "a")]
    assert check_packing(spark, rows, 128) < 1.02
    assert check_packing(spark, [(i, "same text here") for i in range(50)], 16) < 1.4
    assert packing.pack(empty(spark), PACK).count() == 0
