import itertools
import random

import numpy as np
import pytest
from llm_helpers import empty, frame, words

from quotelens.llm import neardup


def by_definition(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(t, 0) / x[s], y.get(t, 0) / y[s]) for t in every) for s in x if s in y)


def test_similarity_is_the_probability_jaccard():
    rnd = random.Random(1)
    as_arrays = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    for _ in range(200):
        x, y = ({rnd.randint(1, 12): rnd.randint(1, 4) for _ in range(6)} for _ in range(2))
        assert neardup.similarity(as_arrays(x), as_arrays(y)) == pytest.approx(by_definition(x, y))


def test_signatures_estimate_the_similarity():
    rnd = random.Random(2)
    gaps = []
    for k in range(40):
        one = [f"w{rnd.randint(0, 200)}" for _ in range(300)]
        two = list(one)
        for _ in range(k % 10):
            two[rnd.randint(0, 299)] = "other"
        both = [" ".join(one).encode(), " ".join(two).encode()]
        found = neardup.signatures(*neardup.weighted(*neardup.shingles(both)))
        gaps.append((found[0] == found[1]).mean() - neardup.similarity(*(neardup._set(t.decode()) for t in both)))
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.05


def test_shingles_do_not_cross_texts_and_short_texts_have_one():
    found, bounds = neardup.shingles([b"a b c d e f", b"", b"x y", b"...", b"b c d e f"])
    assert np.diff(bounds).tolist() == [2, 0, 1, 0, 1]
    assert found[1] == found[3]


def brute(rows, threshold=0.8):
    ids = [i for i, t in rows if i is not None]
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [(i, neardup._set(t)) for i, t in rows if i is not None]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i == j or len(a[0]) and neardup.similarity(a, b) >= threshold:
            lo, hi = sorted((top(i), top(j)))
            parent[hi] = lo
    return {i: top(i) for i in ids}


def test_classes_agree_with_all_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    rows = []
    for base in range(12):
        text = words(rnd, 120)
        for k in range(rnd.randint(1, 9)):
            parts = text.split(" ")
            for _ in range(rnd.randint(0, 6)):
                parts[rnd.randint(0, 119)] = words(rnd, 1)
            rows.append((base * 100 + k, " ".join(parts)))
    rows += [(5000, rows[0][1].upper()), (5001, rows[0][1] + "!"), (6000, "one two"), (6001, "One, two."), (6002, "two one")]
    monkeypatch.setattr(neardup, "FAN", 3)
    found = neardup.near_duplicates(frame(spark, rows, clash=("class_id", "root"))).collect()
    assert {r.doc_id: r.class_id for r in found} == brute(rows)


def test_nulls_wordless_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(None, long), (1, None), (2, ""), (3, "..."), (4, long), (4, long), (7, long), (8, "...")]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == 8
    assert {(r.doc_id, r.class_id) for r in found} == {(None, None), (1, 1), (2, 2), (3, 3), (4, 4), (7, 4), (8, 8)}
    kept = neardup.keep_one_each(frame(spark, rows))
    assert sorted((r.doc_id or 0, r.text) for r in kept.where("doc_id is null or doc_id > 1").collect()) == sorted(
        [(0, long), (2, ""), (3, "..."), (4, long), (8, "...")]
    )
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.keep_one_each(empty(spark)).count() == 0


def test_an_id_with_two_texts_joins_them(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, one), (5, one), (5, two), (9, two), (3, two + " end")]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {(r.doc_id, r.class_id) for r in found} == {(1, 1), (5, 1), (9, 1), (3, 1)} and len(found) == 5


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    roots = {r.node: r.root for r in neardup.components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
