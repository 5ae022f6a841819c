import random
import re

from llm_helpers import empty, frame, words

from quotelens.llm import decontam


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=10):
    out = []
    for d, text in rows:
        mine = split(text)
        hit, ids = set(), set()
        for i, t in items:
            w = split(t)
            for k in range(max(1, len(w) - size + 1) if w else 0):
                window = w[k : k + size]
                for at in range(len(mine) - len(window) + 1):
                    if mine[at : at + len(window)] == window:
                        hit.update(range(at, at + len(window)))
                        ids.add("null" if i is None else str(i))
        out.append((d, len(mine), len(hit), sorted(ids)))
    return sorted(out, key=str)


def cases():
    rnd = random.Random(6)
    items = [(i, words(rnd, rnd.randint(8, 30))) for i in range(12)] + [(20, "Two Words"), (21, None), (22, "..."), (None, words(rnd, 12))]
    items += [(23, items[0][1]), (0, items[0][1])]
    rows = [(None, items[0][1]), (1, None), (2, "")]
    for d in range(60):
        text = words(rnd, rnd.randint(1, 60))
        if d % 3 == 0:
            part = items[rnd.randint(0, 11)][1].split(" ")
            a = rnd.randint(0, 3)
            text += " É! " + ",\n".join(p.upper() if p.isascii() else p for p in part[a : a + rnd.randint(8, 25)]) + " " + words(rnd, 5)
        if d % 7 == 0:
            text = "two  words " + text + " TWO-WORDS two words"
        rows.append((d + 10, text))
    return rows + rows[-2:], items


def test_hits_agree_with_brute_force(spark):
    rows, items = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS n_hit")
    docs = frame(spark, rows, clash=("items", "spans"))
    for block in (decontam.BLOCK_BYTES, 300):
        found = decontam.contamination(docs, benchmark, block_bytes=block).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=str) == brute(rows, items)
        clean = decontam.drop_contaminated(docs, benchmark, block_bytes=block)
        assert clean.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted(
            (row for row, b in zip(rows, [brute([r], items)[0] for r in rows]) if b[2] == 0), key=str
        )


def test_spans_lead_back_to_the_text(spark):
    docs = frame(spark, [(1, "👍 one, TWO;three four and one two")])
    benchmark = spark.createDataFrame([(1, "two three"), (2, "one two")], "item_id long, text string")
    row = decontam.contamination(docs, benchmark).first()
    assert [docs.first().text[s.start : s.end] for s in row.spans] == ["one, TWO;three", "one two"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(empty(spark), none).count() == 0
    assert decontam.contamination(frame(spark, [(1, "a b")]), none).first().n_words == 2


def test_blocks_answer_alike_on_shuffled_input(spark):
    rnd = random.Random(9)
    items = [(i, words(rnd, 14)) for i in range(30)]
    rows = []
    for d in range(300):
        # Windows of several items meet: runs of words that only blocks together cover.
        own = words(rnd, 12).split()
        for i in rnd.sample(range(30), d % 4):
            own += items[i][1].split()
        rows.append((d, " ".join(own)))
    docs = frame(spark, rows, clash=("_row", "places")).repartition(7)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, blocks = (
        sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.spans)) for r in decontam.contamination(docs, benchmark, block_bytes=b).collect())
        for b in (decontam.BLOCK_BYTES, 200)
    )
    assert whole == blocks and sum(r[2] > 0 for r in whole) == 225
    kept = decontam.drop_contaminated(docs, benchmark, block_bytes=200)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in whole if not r[2]}
