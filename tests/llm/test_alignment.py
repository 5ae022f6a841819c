import hashlib
import random

import numpy as np
import pytest
from llm_helpers import empty, frame, words
from quotelens.llm import alignment
from quotelens.llm.perfecthash import PerfectHash

public_tokenizers = pytest.importorskip("public_tokenizers")
FIRST, SECOND = public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND)


def brute(texts):
    """Token by token and pair by pair, as the contract words it."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FIRST)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    plain = alignment.byte_level()
    rows, held = [], {}
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        b = second.encode(text or "")
        bytes_a = [bytes(plain[c] for c in first.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            a, b, bytes_a, bytes_b = [], [], [], []
        spans = []
        for sizes in (bytes_a, bytes_b):
            at = 0
            spans.append([(at := at + len(x)) - len(x) for x in sizes])
        ranges_a = [(s, s + len(x)) for s, x in zip(spans[0], bytes_a)]
        ranges_b = [(s, s + len(x)) for s, x in zip(spans[1], bytes_b)]
        links = [(x, y) for x, (s, e) in zip(a, ranges_a) for y, (u, v) in zip(b, ranges_b) if s < v and u < e]
        cuts = sorted({e for _, e in ranges_a} & {e for _, e in ranges_b})
        groups, low = [], 0
        for cut in cuts:
            side = [",".join(str(i) for i, (s, e) in zip(ids, ranges) if low <= s and e <= cut) for ids, ranges in ((a, ranges_a), (b, ranges_b))]
            groups.append("|".join(side))
            low = cut
        for pair in set(links):
            held[pair] = held.get(pair, 0) + 1
        rows.append((len(a), len(b), cuts, links, ";".join(groups)))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = [
        (n_a, n_b, len(cuts), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), groups)
        for n_a, n_b, cuts, links, groups in rows
    ]
    return out, held


def texts():
    rnd = random.Random(4)
    odd = ["", None, "a", " lead  two ", "ünï ç 日本語 한국 🙂🙂", "<|endoftext|> <s> </s> <0x41>", "tab\tand\nline\r\n", "▁mark ▁▁", "\x00zero", "x" * 3000, "naïve café — “quote”"]
    return odd + [words(rnd, rnd.randint(1, 60)) for _ in range(60)] + ["the same text again"] * 30 + ["<|endoftext|>"]


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 300, "segment_keys": 100, "leaf_rows": 5}])
def test_agrees_with_brute_force(spark, sizes):
    given = texts()
    docs = frame(spark, list(enumerate(given)), clash=("chunk_", "pair", "segment", "n_a"))
    found = alignment.aligned(docs.repartition(3), FIRST, SECOND, **sizes)
    rows, held = brute(given)
    got = {r.doc_id: tuple(r[1:]) for r in found.documents.collect()}
    assert got == {i: tuple(r) for i, r in enumerate(rows)}
    assert {(r.a_id, r.b_id): r["count"] for r in found.pairs.collect()} == held


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    docs = frame(spark, [(1, "one two"), (1, "one two"), (None, "one two"), (2, None)])
    rows = alignment.aligned(docs, FIRST, SECOND).documents.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_links and r.count_sum // r.n_links) for r in rows if r.doc_id) == [(False, 1, 3), (False, 1, 3), (False, 2, 0)]
    assert [r.count_sum // r.n_links for r in rows if r.doc_id is None] == [3]
    assert [(r.n_a, r.groups) for r in rows if r.doc_id == 2] == [(0, "")]


def test_empty_table(spark):
    found = alignment.aligned(empty(spark), FIRST, SECOND)
    assert found.documents.count() == 0 and found.pairs.count() == 0


def test_query_digests_the_groups(spark, tmp_path):
    frame(spark, [(1, "one two"), (2, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.groups_sha256 for r in alignment.op11_alignment(spark, str(tmp_path)).collect()}
    rows, _ = brute(["one two"])
    assert got == {1: hashlib.sha256(rows[0][-1].encode()).hexdigest(), 2: ""}


def test_perfect_hash_numbers_every_key_once():
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.random.default_rng(n).choice(2**40, n, replace=False)
        hashed = PerfectHash.build(keys)
        again = PerfectHash(hashed.sizes, hashed.bits)
        assert sorted(again.index(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([3, 3]))
