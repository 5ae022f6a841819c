import random
import zlib

import numpy as np
from llm_helpers import empty, frame, words

from quotelens.llm import quality


def labelled(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = words(rnd, rnd.randint(5, 80))
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "###" if bad and rnd.random() < 0.5 else w for w in text.split(" ")), 0 if bad else 1))
    return rows


def test_learns_and_generalises(spark):
    rows = labelled(400, 1)
    docs = frame(spark, [r[:2] for r in rows] + [(9001, None), (9002, ""), (None, "a"), (3, rows[3][1])], clash=("score", "quality"))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(docs, labels)
    scored = quality.score(docs, net).collect()
    assert len(scored) == 404 and all(0 <= r.score <= 1 for r in scored)
    truth = {i: q for i, _, q in rows}
    held = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in scored if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean(held) > 0.9
    kept = quality.score(docs.drop("score"), net, keep_text=True)
    assert kept.columns == [*docs.drop("score").columns, "score"]


def test_held_out_rows_teach_nothing(spark):
    rows = labelled(60, 2)
    docs = frame(spark, [r[:2] for r in rows])
    fold = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    labels = lambda part: spark.createDataFrame([(i, q) for i, _, q in part], "doc_id long, quality int")
    flipped = [(i, t, 1 - q if (i, t, q) in fold else q) for i, t, q in rows]
    one, two = quality.fit(docs, labels(rows)), quality.fit(docs, labels(flipped))
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def test_stretches_change_nothing(monkeypatch):
    net = quality.Network()
    texts = [words(random.Random(k), 60).encode() for k in range(6)] + [b"", b"a", b"abcdefgh"]
    whole = net.pooled(texts)
    monkeypatch.setattr(quality, "STRETCH", 64)
    assert np.allclose(net.pooled(texts), whole, atol=1e-5)


def test_nothing_to_learn_from(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5, 0.5]
    assert quality.score(empty(spark), quality.fit(empty(spark), none)).count() == 0


def test_repeated_ids_reach_the_driver_once(spark, monkeypatch):
    rows = labelled(40, 3)
    docs = frame(spark, [r[:2] for r in rows] + [(1, f"copy {k}") for k in range(50)])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels: seen.append(texts))
    quality.fit(docs, labels)
    learned = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert 1 in learned and len(seen[0]) == len(learned)
    assert seen[0][learned.index(1)] == min(rows[1][1].encode(), b"copy 0")


def test_repeats_of_unseen_words_are_bad():
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        text = words(rnd, rnd.randint(30, 80))
        if i % 4 == 0:
            text = " ".join(w for w in text.split(" ")[:6] for _ in range(12))
        rows.append((text.encode(), int(i % 4 != 0)))
    net = quality.train([t for t, _ in rows[:600]], np.array([q for _, q in rows[:600]], np.float32))
    accepted = net.scores([t for t, _ in rows[600:]]) >= quality.ACCEPT
    truth = np.array([q == 1 for _, q in rows[600:]])
    assert (~accepted[~truth]).mean() > 0.95 and accepted[truth].mean() > 0.95
