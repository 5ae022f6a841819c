import re

import pytest
from llm_helpers import empty, frame

from quotelens.llm import pii

#: The base patterns as they are defined.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def stands(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if stands(k, m[0]))


TEXTS = [
    None, "", "a@b.c_x@d.e a@b@c.d", "1.2.3.4.5.6.7.8 255.256.1.1 00255.1.1.1", "👍 x@y.z é +1 (017) 555-7713 2390409500648960",
    "9" * 3000 + " 4111 1111 1111 1111", "a" * 20000 + "@" + "b." * 3000, "call (017) 555-7713 or joe (at) mail (dot) com", "+12345678901 +1(2)",
    "card 4111-1111-1111-1111 4111111111111111", "4111111111111112 order 1234567890123456", "host 10.0.0.1, 10.0.0.256", "\u0001a@b.co\u0002 +49 30 1234567.",
]


@pytest.fixture(scope="module")
def found(spark):
    docs = frame(spark, list(enumerate(TEXTS)) + [(None, TEXTS[2]), (2, TEXTS[2])], clash=("spans", "base_spans", "kind", "start"))
    model = pii.fit(docs)
    return model, pii.find(docs, model)


def test_base_spans_agree_with_the_definition(found):
    rows = found[1].select("text", pii._digest("base_spans").alias("b"), pii._digest("spans").alias("s")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r.b == brute(r.text)
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_the_classifier_adds_what_the_base_misses_and_not_numbers_that_fail(found):
    by_id = {r.doc_id: [(pii.KINDS[s.kind], r.text[s.start : s.end]) for s in r.spans] for r in found[1].where("doc_id is not null").collect()}
    assert ("phone", "(017) 555-7713") in by_id[7] and ("email", "joe (at) mail (dot) com") in by_id[7]
    assert by_id[10] == []
    assert by_id[9].count(("card", "4111111111111111")) == 1


def test_em_finds_the_better_labeler():
    rows = [((1, 1, 1, 1), 90.0, 1.0), ((-1, 1, -1, 1), 90.0, 0.0), ((1, 0, 1, 1), 10.0, None), ((-1, 1, -1, 1), 10.0, None)]
    belief, table = pii.estimate(rows)
    assert belief[2] > 0.9 and belief[3] < 0.1
    assert table["format"][1][0] > table["gazetteer"][1][0] - 0.2 and table["format"][-1][1] > 0.8


def test_redaction(found):
    rows = {r.doc_id: r.text for r in pii.redact(found[1]).where("doc_id is not null").collect()}
    assert rows[0] is None and rows[1] == ""
    assert rows[2] == "[EMAIL][EMAIL] a@[EMAIL]"
    assert rows[3] == "[IP].[IP] 255.256.1.1 [IP]"
    assert rows[11] == "host [IP], 10.0.0.256"


def test_empty_table(spark):
    docs = empty(spark)
    assert pii.find(docs, pii.fit(docs)).count() == 0
