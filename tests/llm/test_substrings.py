import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
from llm_helpers import empty, frame, words

from quotelens.llm import substrings


def brute(rows, length):
    seen = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(gone, prepend=False, append=False))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), list(zip(edges[::2].tolist(), edges[1::2].tolist())), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    passages = [words(rnd, rnd.randint(20, 120)) for _ in range(10)]
    rows = [(None, None), (1, ""), (2, "ab" * 300), (3, "ba" * 150 + "x"), (4, "a" * 700), (5, passages[0]), (5, passages[0]), (6, passages[0][3:])]
    for i in range(40):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else words(rnd, rnd.randint(5, 150)) for _ in range(rnd.randint(1, 5))]
        parts = [p[rnd.randint(0, 40) : len(p) - rnd.randint(0, 40)] if rnd.random() < 0.6 else p for p in parts]
        rows.append((10 + i, " ".join(parts)))
    return rows


def test_spans_agree_with_brute_force(spark):
    for length in (200, 60):
        rows = corpus(length)
        found = substrings.repeated_spans(frame(spark, rows, clash=("spans", "chunk", "data")), length, True, 3000, 9000).collect()
        mine = sorted(((r[0], r[1], [tuple(s) for s in r[2]], r[3], bytes(r[4])) for r in found), key=str)
        assert mine == brute(rows, length)


def test_long_documents_are_cut_with_overlap(monkeypatch):
    """The levels run here without Spark, over stretches much shorter than the documents."""
    monkeypatch.setattr(substrings, "STRETCH", 500)
    monkeypatch.setattr(substrings, "MARGIN", 150)
    rows = [r for r in corpus(9) if r[0] is not None]
    tables = [
        pa.table({"doc_id": pa.array([d for d, _ in part]), "data": pa.array([(t or "").encode() for _, t in part], pa.binary()), "chunk": pa.array([c] * len(part))})
        for c, part in enumerate((rows[:20], rows[20:]))
    ]
    marks = substrings._MARKS.empty_table()
    for level in range(3):
        step = substrings._descend(60, 4, level)
        lists = pa.concat_tables([step(t, marks.filter(pa.compute.equal(marks["chunk"], c))) if level else step(t) for c, t in enumerate(tables)])
        for b in range(4):
            part = lists.filter(pa.compute.equal(lists["bucket"], b))
            if part.num_rows:
                marks = pa.concat_tables([marks, substrings._compare(part)])
    finish = substrings._finish(60, 4, True)
    out = [r for c, t in enumerate(tables) for r in finish(t, marks.filter(pa.compute.equal(marks["chunk"], c))).to_pylist()]
    mine = sorted(((r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"], r["kept"]) for r in out), key=str)
    assert mine == brute(rows, 60)


def test_triggers_at_document_ends(spark):
    """Documents end at every offset of a passage that one other document holds in its middle; one chunk, so one stretch."""
    rnd = random.Random(4)
    letters = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    passage = letters(24_000)
    rows = [(1000, letters(90) + passage + letters(90))]
    rows += [(k, letters(70) + passage[100 * k : 100 * k + 65 + k % 30]) for k in range(240)]
    found = substrings.repeated_spans(frame(spark, rows), 60, True).collect()
    mine = sorted(((r[0], r[1], [tuple(s) for s in r[2]], r[3], bytes(r[4])) for r in found), key=str)
    assert mine == brute(rows, 60)


def test_empty_table(spark):
    assert substrings.repeated_spans(empty(spark)).collect() == []


def thue_morse_pair():
    """Two texts, equal but for every 16th byte of their middle, which follows the bits' parity in one and the opposite in the other.

    Polynomials modulo a power of two cannot tell such middles apart. No window triggers, so whole stretches are compared.
    """
    rnd = np.random.default_rng(12)
    parity = [bin(i).count("1") % 2 for i in range(256)]
    texts = [bytearray(), bytearray()]

    def triggers(text):
        tail = np.frombuffer(bytes(text[-substrings.TRIGGER :]), np.uint8)
        return len(tail) == substrings.TRIGGER and substrings.triggers(tail)[0]

    at = 0
    while at < 5296:
        inside = 600 <= at < 4696 and (at - 600) % 16 == 15
        for _ in range(60):
            pick = rnd.integers(97, 123)
            for i, text in enumerate(texts):
                text.append((65 + (parity[(at - 600) // 16] ^ i)) if inside else int(pick))
            if not any(map(triggers, texts)):
                at += 1
                break
            for text in texts:
                text.pop()
        else:
            # Dead end: take other letters for the last ones.
            back = min(at, 8)
            for text in texts:
                del text[len(text) - back :]
            at -= back
    return [t.decode() for t in texts]


def test_patterns_that_fool_polynomials_modulo_powers_of_two(spark):
    rows = list(enumerate(thue_morse_pair()))
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in substrings.repeated_spans(frame(spark, rows)).collect()}
    # Before the middle's first byte that differs, and after its last.
    assert got == {i: [(0, 615), (4696, 5296)] for i in range(2)}


def test_equal_rows_spread_over_chunks(spark):
    rows = [(1, "x" * 150 + "same text " * 10)] * 400
    found = substrings.repeated_spans(frame(spark, rows), chunk_bytes=5000)
    assert [(r.n_bytes, [(s.start, s.end) for s in r.spans]) for r in found.collect()] == [(250, [(0, 250)])] * 400


def test_field_arithmetic():
    rnd = np.random.default_rng(3)
    x = rnd.integers(0, 2**62, 1000, dtype=np.uint64)
    assert substrings.reduced(x).tolist() == [int(v) % substrings.PRIME for v in x]
    data = rnd.integers(0, 256, 5000).astype(np.uint8)
    start = rnd.integers(0, 4000, 50)
    end = start + rnd.integers(0, 1000, 50)
    found = substrings.FieldFingerprints(data, 6000).of(start, end)
    shifted = substrings.FieldFingerprints(np.concatenate([data[:777], data]), 6000).of(start + 777, end + 777)
    for base, one, two in zip(substrings.BASES, found, shifted):
        slow = [sum((int(data[i]) + 1) * pow(base, int(i + 6000 - s), substrings.PRIME) for i in range(s, e)) % substrings.PRIME for s, e in zip(start, end)]
        assert one.tolist() == two.tolist() == slow
