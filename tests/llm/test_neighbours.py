import numpy as np

from quotelens.llm import neighbours

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, k=10):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, p in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(np.square(v - p).sum())), i) for i, v in good if i != q)
            out[q] = near[:k]
    return out


def rows_of(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(n)]


def search(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).selectExpr("*", "1 AS segment", "2 AS vector")
    out = {}
    for r in neighbours.nearest(frame, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


def test_exact_when_the_ascent_takes_all(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 3)
    rows = rows_of(500, 1)
    rows += [(1000 + i, rows[7][1]) for i in range(20)] + [(2000, rows[7][1])]
    rows += [(None, rows[1][1]), (600, None), (601, [0.0] * 8), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] + [1.0] * 7), (700, [float("inf")] * 8), (604, [1.0]), (605, [])]
    assert search(spark, rows) == brute(rows)


def test_recall(spark):
    rows = rows_of(6000, 2)
    found, wanted = search(spark, rows, every=300, least=500), brute(rows, every=300)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in wanted[q]}) for q in wanted)
    assert hits / sum(map(len, wanted.values())) >= 0.9


def test_few_rows_and_none(spark):
    rows = rows_of(4, 3)
    assert search(spark, rows) == brute(rows) and len(search(spark, rows)[0]) == 3
    assert search(spark, []) == {} and search(spark, [(1, None)]) == {}


def test_every_length_is_searched(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SEGMENT_ROWS", 150)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 2)
    rng = np.random.default_rng(6)
    rows = rows_of(400, 4)
    other = [(1000 + i, rng.standard_normal(5).astype(np.float32).tolist()) for i in range(320)]
    alone = [(5000, [1.0, 2.0])]
    short = {}
    for q, p in other:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(np.square(np.array(v) - np.array(p)).sum())), i) for i, v in other if i != q)
            short[q] = near[:10]
    # An id with vectors of two lengths is a candidate in both, and asks with the smaller vector.
    both = (0, [-9.0, 0.0, 0.0, 0.0, 1.0])
    found = search(spark, rows + other + alone + [both])
    far = lambda p: sorted((float(np.sqrt(np.square(np.array(v) - np.array(p)).sum())), i) for i, v in other)[:10]
    assert 5000 not in found and found == {q: n for q, n in brute(rows).items() if q} | short | {0: far(both[1])}
