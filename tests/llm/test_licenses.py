import duckdb
import pandas as pd
import random

from llm_helpers import empty, frame, words
from quotelens.llm import licenses
from quotelens.llm.common import ascii_words

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def brute(text):
    """Places of the phrases, word by word."""
    given = [w.decode() for w in ascii_words(text)]
    places = sorted(
        (p, t.label) for t in licenses.PHRASES for p in range(len(given) - len(t.words) + 1) if given[p : p + len(t.words)] == t.words
    )
    return len(given), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({n for _, n in places}))


def query(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    return [tuple(r[n] for n in NAMES) for r in licenses.op13_licenses(spark, str(tmp_path)).collect()]


def given():
    rnd = random.Random(8)
    parts = [" ".join(t.words) for t in [*licenses.PHRASES, *licenses.NOTICES]]
    odd = ["", None, "mit", "under the", "CC BY-NC 4.0", "cc by nc cc by nc by nc", "Released UNDER THE MIT LICENSE under the mit license.", "Under the MIT Licénse", "apache license version 2" * 2]
    mixed = []
    for _ in range(80):
        pick = [w for part in rnd.sample(parts, rnd.randint(0, 3)) for w in [*words(rnd, rnd.randint(0, 9)).split(), *(w for w in part.split() if rnd.random() > 0.03)]]
        mixed.append(rnd.choice([" ", ", ", "-", "\n"]).join(pick))
    return odd + mixed


def test_base_places_agree_with_brute_force_and_all_with_sql(spark, tmp_path):
    texts = given()
    docs = frame(spark, list(enumerate(texts)), clash=("words", "hash", "place", "label", "_row"))
    got = query(spark, tmp_path, docs.repartition(3))
    assert {r[0]: r[1:6] for r in got} == {i: brute(t) for i, t in enumerate(texts)}
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    expected = duckdb.sql(licenses.SQL).fetchall()
    assert sorted(got) == sorted(expected)


def test_notices_are_found_when_changed(spark):
    notice = licenses.NOTICES[2].words
    changed = [w for i, w in enumerate(notice) if i not in (7, 20)]
    changed[30:30] = ["really", "any"]
    rows = {r.doc_id: r for r in licenses.license_scan(frame(spark, [(1, "some words before " + " ".join(changed) + " and after"), (2, " ".join(notice[:12]))])).collect()}
    (span,) = rows[1].spans
    assert span.label == "mit" and not span.exact and (span.start, span.end) == (3, 3 + len(changed)) and span.share > 0.7
    assert rows[2].spans == [] and 0 < rows[2].score < licenses.SHARE


def test_repeats_nulls_long_texts_and_empty_tables(spark, tmp_path):
    rows = [(1, "cc by nc")] * 3 + [(None, "cc by nc"), (2, None), (3, "cc by nc " * 20_000)]
    got = query(spark, tmp_path, frame(spark, rows))
    assert sorted((str(r[0]), r[2], r[4]) for r in got) == [("1", 1, 0)] * 3 + [("2", 0, None), ("3", 20_000, 59_997), ("None", 1, 0)]
    assert licenses.license_scan(empty(spark)).count() == 0
