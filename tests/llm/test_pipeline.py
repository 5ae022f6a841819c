"""Every stage of the pipeline on a small folder, held against the operators' plain definitions."""

import random
import zlib

import numpy as np
import pytest
from llm_helpers import frame, words

import corpus_pipeline
from quotelens.llm import neardup
from test_decontam import brute as contaminated
from test_neardup import brute as classes
from test_pii import brute as personal


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    path = str(tmp_path_factory.mktemp("sf"))
    rows = []
    for i in range(240):
        text = words(rnd, rnd.randint(30, 120))
        if i % 4 == 0:
            text = " ".join(w + "###" for w in text.split(" "))
        if i % 10 == 1:
            text += f" write to a{i}@mail.example.com or +1 (017) 555-77{i % 90 + 10}"
        rows.append((i, text))
    item = words(rnd, 20)
    rows += [(300 + i, rows[i][1] + " end") for i in range(1, 40, 2)] + [(400, rows[2][1] + " " + item), (401, None), (402, "")]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, item


def test_stages(spark, folder, tmp_path):
    path, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            break
        assert docs.columns == names
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality classifier":
            judged = [i in after for i in before if i < 240]
            assert np.mean([a == (i % 4 != 0) for i, a in zip(range(240), judged)]) > 0.9
        elif name == "near-duplicates":
            roots = classes(list(before.items()))
            assert set(after) == {i for i in before if roots[i] == i}
        elif name == "decontamination":
            assert set(after) == {r[0] for r in contaminated(list(before.items()), [(1, item)]) if r[2] == 0}
        else:
            assert set(after) == set(before)
            assert all(personal(t) == "" for t in after.values())
            assert all(after[i] == t for i, t in before.items() if not personal(t) and "@" not in (t or ""))
        before = after
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(before)
    assert all(sum(r.length for r in packed if r.doc_id == i) == next(r.doc_tokens for r in packed if r.doc_id == i) for i in before)


@pytest.mark.parametrize("labels", [[], [(5, 0), (5, 1)], [(1, None)], [(0, 1), (1, 1)], [(0, 0), (1, 0)]])
def test_classifier_keeps_all_when_nothing_is_learned(spark, tmp_path, labels):
    """No label, only a held-out one (crc32 of "5" modulo 4 is 2), only null ones, one class only."""
    assert zlib.crc32(b"5") % 4 == 2
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, [(0, "a"), (1, "b"), (5, "c"), (5, None), (None, "d")])
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted(docs.collect(), key=str)


def test_run_returns_the_last_stage(spark, folder):
    assert neardup.SIMILARITY == 0.8 and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert corpus_pipeline.run(spark, folder[0]).columns[:3] == ["doc_id", "start", "length"]
